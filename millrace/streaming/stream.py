"""The continuous job: topic in, enriched records and quarantine out."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.decode import decode, transactions
from millrace.operators.enrich import enriched
from millrace.plans.jobs import BROADCAST_BYTES, write_enriched
from millrace.sinks.files import path_exists
from millrace.sinks.records import STREAM, check_owner, clear_owner, committed, read_batch
from millrace.sources.dimension import Dimension, current_dimension
from millrace.sources.ranges import PLACE
from millrace.streaming.runs import run_log

log = logging.getLogger(__name__)


def run_stream(
    source: DataFrame,
    dimension_path: str,
    sink: str,
    checkpoint: str,
    *,
    trigger: dict | None = None,
    reset: bool = False,
    publish: Callable[[DataFrame], None] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
    owner: str = STREAM,
    once_within: str | None = None,
) -> StreamingQuery:
    """Starts the enrichment of a topic stream.

    The newest dimension is looked up for every batch; a small one is kept in memory until
    a newer one comes. A batch that is
    replayed after a crash takes over from its former attempt. A sink may be shared with backfills and
    with streams of other ``owner`` names; ``reset`` drops the owner's batches and position together, without it they are
    only continued with their own checkpoint. ``publish`` gets each batch's enriched records, read
    back from the sink, to hand them on (to a document store, say); it may see
    a batch again after a crash. Outcome counts of all batches are kept in the sink
    (``read_counts``); those of decoding alone are also in the progress under ``decoded``. With ``once_within`` (an interval,
    '1 day', say) a message that a capture agent delivers again within that time is dropped, by topic, partition and offset; the
    places of that time are the stream's state. What became of each run is kept, too (``read_runs``).
    """
    spark = source.sparkSession
    check_owner(owner)
    if reset:
        clear_owner(spark, sink, owner, checkpoint)
    elif committed(spark, sink, owner).names() and not path_exists(spark, checkpoint):
        raise ValueError(f"{sink} holds batches of {owner} from another position; pass reset=True to drop them")

    kept: list[Dimension] = []

    def release() -> None:
        while kept:
            kept.pop().lookup.unpersist()

    def newest(session: SparkSession) -> Dimension:
        found = current_dimension(session, dimension_path)
        if found.lookup_bytes > broadcast_bytes:
            return found
        if not kept or kept[0].location != found.location:
            release()
            kept[:] = [replace(found, lookup=found.lookup.persist())]
        return kept[0]

    def process(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        dimension = newest(session)
        counts = write_enriched(batch, dimension, sink, batch_id, broadcast_bytes, owner)
        log.info("batch %d, dimension version %d: %s", batch_id, dimension.version, counts)
        if publish is not None:
            publish(enriched(read_batch(session, sink, batch_id, owner)))

    name = f"{owner}-{uuid.uuid4().hex}"
    run_log(spark).watch(name, sink, owner, release)
    return (
        decode(_once(source, once_within) if once_within else source)
        .writeStream.foreachBatch(process)
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )


def _once(source: DataFrame, within: str) -> DataFrame:
    """Each place of the topic once; messages without a time count as of now."""
    timed = source.withColumn("timestamp", F.coalesce("timestamp", F.current_timestamp()))
    return timed.withWatermark("timestamp", within).dropDuplicatesWithinWatermark(PLACE)


def run_raw_stream(
    source: DataFrame, path: str, checkpoint: str, *, trigger: dict | None = None
) -> StreamingQuery:
    """Starts the appending of the decoded transactions to a table of files."""
    return (
        transactions(decode(source))
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .start()
    )
