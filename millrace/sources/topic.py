"""The change topic, as a stream or from its beginning as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.schemas import TOPIC


def _topic_columns(records: DataFrame) -> DataFrame:
    return records.select(*[F.col(field.name).cast(field.dataType) for field in TOPIC.fields])


def topic_stream(spark: SparkSession, source_format: str = "kafka", **options: str) -> DataFrame:
    """A stream of topic records.

    A Kafka topic is read from its earliest record unless the checkpoint holds
    a position. Any file format with the columns of ``TOPIC`` works as well
    (pass ``path``). ``maxOffsetsPerTrigger`` and ``minPartitions``, or
    ``maxFilesPerTrigger``, bound a batch and spread it.
    """
    reader = spark.readStream.format(source_format)
    if source_format == "kafka":
        options = {"startingOffsets": "earliest", **options}
    else:
        reader = reader.schema(TOPIC)
    return _topic_columns(reader.options(**options).load())


def topic_batch(spark: SparkSession, source_format: str = "kafka", **options: str) -> DataFrame:
    """All records of a topic, from the earliest to the latest."""
    reader = spark.read.format(source_format)
    if source_format == "kafka":
        options = {"startingOffsets": "earliest", "endingOffsets": "latest", **options}
    else:
        reader = reader.schema(TOPIC)
    return _topic_columns(reader.options(**options).load())


def route_topic(records: DataFrame, prefix: str, database: str, collection: str) -> DataFrame:
    """The records of one collection out of a mixed feed."""
    return records.where(F.col("topic") == ".".join((prefix, database, collection)))
