"""The given tables in the roles of users, transactions and change topic."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.encode import document_text, encode_envelope
from millrace.session import fresh_dir
from millrace.sinks.files import path_exists
from millrace.sources.dimension import Dimension, current_dimension, refresh_dimension
from millrace.sources.topic import topic_batch

TRANSACTIONS_TOPIC = "cdc.mydatabase.transactions"
USERS_TOPIC = "cdc.mydatabase.users"
CREATE_TYPES = ("purchase", "click", "view")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = read_table(spark, sf_dir, "customer")
    nation = read_table(spark, sf_dir, "nation")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.col("n_name").alias("city")
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without every seventh, so that some transactions find no user."""
    return all_customers(spark, sf_dir).where(F.col("user_id") % 7 != 0)


def instant(wall: Column) -> Column:
    """The instant of a UTC wall-clock time, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, wall))


def operation() -> Column:
    return (
        F.when(F.col("event_type").isin(*CREATE_TYPES), "c")
        .when(F.col("event_type") == "signup", "r")
        .otherwise("u")
    )


def events_as_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns ``TXN``, ``op`` and those of ``events`` that the fixtures go by."""
    return read_table(spark, sf_dir, "events").select(
        "event_id",
        "event_type",
        operation().alias("op"),
        F.lpad(F.lower(F.hex("event_id")), 24, "0").alias("transaction_id"),
        "user_id",
        F.col("value").alias("amount"),
        instant(F.col("ts")).alias("timestamp"),
    )


def as_topic(rows: DataFrame, topic: Column | None = None) -> DataFrame:
    """Topic records, keyed by event type, of rows with ``event_id`` and ``value``."""
    return rows.select(
        F.col("event_type").cast("binary").alias("key"),
        "value",
        (F.lit(TRANSACTIONS_TOPIC) if topic is None else topic).alias("topic"),
        (F.col("event_id") % 4).cast("int").alias("partition"),
        F.col("event_id").alias("offset"),
        F.col("timestamp"),
    )


def _broken() -> Column:
    """Four ways to break a message."""
    good = F.to_json(F.struct(F.lit("c").alias("op"), document_text().alias("after")))
    nested = F.to_json(F.struct(F.lit("c").alias("op"), F.struct("user_id", "amount").alias("after")))
    way = F.col("event_id") % 4
    text = (
        F.when(way == 0, F.substring(good, F.lit(1), (F.length(good) / 2).cast("int")))
        .when(way == 1, "{}")
        .when(way == 2, nested)
        .otherwise('{"op":"c","after":"null"}')
    )
    return text.cast("binary")


def _create(after: str) -> str:
    """A create envelope around the text of a document."""
    return json.dumps({"op": "c", "after": after})


# Messages by rung of the ladder of outcomes: events take turns. None is the event's own, good message.
LADDER: list[tuple[str | bytes | None, str, str]] = [
    (None, "ENRICHED", ""),
    (b"", "SKIPPED", "TOMBSTONE"),  # stands for a null value
    (b"\xff{}", "ERROR", "BAD_UTF8"),
    ("not json", "ERROR", "BAD_JSON"),
    *((text, "SKIPPED", "EMPTY_ENVELOPE") for text in ("null", "false", "0", '""', "[]", "{}")),
    *((text, "ERROR", "ENVELOPE_NOT_OBJECT") for text in ("[1]", "7", '"text"', "true")),
    *((text, "SKIPPED", "OP") for text in ('{"op":"u"}', '{"x":1}', '{"op":null}', '{"op":7}')),
    *((text, "ERROR", "AFTER_NOT_STRING") for text in ('{"op":"c"}', '{"op":"c","after":null}', '{"op":"c","after":{"a":1}}')),
    (_create("{") , "ERROR", "AFTER_BAD_JSON"),
    (_create(""), "ERROR", "AFTER_BAD_JSON"),
    *((_create(text), "EMPTY", "") for text in ("null", "false", "0", '""', "[]", "{}")),
    *((_create(text), "ERROR", "AFTER_NOT_OBJECT") for text in ("[1]", "7", "true")),
    *((_create(text), "ERROR", "ID") for text in ('{"a":1}', '{"_id":"x"}', '{"_id":null}')),
    *((_create(text), "ERROR", "ID_NO_OID") for text in ('{"_id":{}}', '{"_id":{"$oid":null}}')),
    *((_create(f'{{"_id":{{"$oid":"x"}}{text}}}'), "ERROR", "TIMESTAMP") for text in ("", ',"timestamp":null', ',"timestamp":5')),
    *(
        (_create(f'{{"_id":{{"$oid":{oid}}},"user_id":{user},"amount":{amount},"timestamp":{{"$date":{date}}}}}'), outcome, reason)
        for oid, user, amount, date, outcome, reason in (
            ("true", "1", "1.5", "0", "ERROR", "TYPE"),
            ('"x"', '"1"', "1.5", "0", "ERROR", "TYPE"),
            ('"x"', "1.5", "1.5", "0", "ERROR", "TYPE"),
            ('"x"', "1", '"1.5"', "0", "ERROR", "TYPE"),
            ('"x"', "1", "1.5", '"yesterday"', "ERROR", "TYPE"),
            ('"x"', "null", "null", "null", "ENRICHED", ""),
            ("17", "1", "1", "1.7e12", "ENRICHED", ""),
        )
    ),
]


def _ladder() -> Column:
    """The message of each event's rung."""
    rung = F.col("event_id") % len(LADDER)
    value = F.col("value")
    for i, (message, _, reason) in enumerate(LADDER):
        if message is not None:
            held = message if isinstance(message, bytes) else message.encode()
            value = F.when(rung == i, F.lit(None) if reason == "TOMBSTONE" else F.lit(bytearray(held))).otherwise(value)
    return value


def _extended() -> Column:
    """Documents of create messages by the form of their values, in turns of eight."""
    event, user, amount = F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.col("amount").cast("decimal(18,2)").cast("string")
    millis = F.unix_millis("timestamp").cast("string")
    seconds = F.date_format(F.col("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    late = F.date_format(F.col("timestamp") + F.expr("INTERVAL 7 HOURS"), "yyyy-MM-dd'T'HH:mm:ss")
    wrapped = lambda name, value: F.concat(F.lit(f'{{"${name}":"'), value, F.lit('"}'))
    quoted = lambda value: F.concat(F.lit('"'), value, F.lit('"'))
    forms = [
        (quoted(event), user, amount, millis),
        (event, wrapped("numberInt", user), wrapped("numberDouble", amount), wrapped("numberLong", millis)),
        (quoted(event), wrapped("numberLong", user), wrapped("numberDecimal", amount), quoted(F.concat(seconds, F.lit("Z")))),
        (event, F.concat(user, F.lit(".0")), F.concat(amount, F.lit("e0")), quoted(F.concat(late, F.lit("+07:00")))),
        (quoted(event), F.concat(user, F.lit("e0")), wrapped("numberDouble", F.concat(amount, F.lit("E0"))), quoted(F.concat(seconds, F.lit(".250Z")))),
        (quoted(event), wrapped("numberDouble", F.concat(user, F.lit(".0"))), F.lit("3"), F.lit("1.7e12")),
        (event, F.lit("null"), F.lit("null"), F.lit("null")),
        (quoted(event), None, None, wrapped("numberDouble", F.concat(millis, F.lit(".0")))),
    ]
    document = None
    for i, (oid, user_id, money, date) in enumerate(forms):
        fields = [F.lit('{"_id":{"$oid":'), oid, F.lit("}")]
        for name, value in (("user_id", user_id), ("amount", money)):
            fields += [] if value is None else [F.lit(f',"{name}":'), value]
        text = F.concat(*fields, F.lit(',"timestamp":{"$date":'), date, F.lit("}}"))
        document = F.when(F.col("event_id") % len(forms) == i, text).otherwise(F.lit(None) if document is None else document)
    return F.to_json(F.struct(F.lit("c").alias("op"), document.alias("after"))).cast("binary")


def messages(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """Every event as a change message.

    In a ``mixed`` topic sign-ups belong to the users' collection; in one of
    ``creates`` every operation is a create; in a ``damaged`` one errors are
    broken; in a ``ladder`` every outcome occurs, in an ``extended`` one every form of
    values. A ``plain`` one has none of this.
    """
    events = events_as_transactions(spark, sf_dir)
    if kind in ("creates", "ladder"):
        events = events.withColumn("op", F.lit("c"))
    rows = encode_envelope(events)
    if kind == "damaged":
        is_error = F.col("event_type") == "error"
        rows = rows.withColumn("value", F.when(is_error, _broken()).otherwise(F.col("value")))
    if kind in ("ladder", "extended"):
        rows = rows.withColumn("value", _ladder() if kind == "ladder" else _extended())
    if kind == "mixed":
        name = F.when(F.col("event_type") == "signup", USERS_TOPIC).otherwise(TRANSACTIONS_TOPIC)
        return as_topic(rows, name)
    return as_topic(rows)


_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], object]) -> str:
    """The path of something written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written or not path_exists(spark, _written[key]):
        path = fresh_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def topic_path(spark: SparkSession, sf_dir: str, kind: str = "plain") -> str:
    """Files with the messages, spread over as many parts as there are cores."""
    parts = spark.sparkContext.defaultParallelism

    def write(path: str) -> None:
        messages(spark, sf_dir, kind).repartition(parts, "offset").write.parquet(path)

    return _once(spark, sf_dir, f"topic-{kind}", write)


def topic(spark: SparkSession, sf_dir: str, kind: str = "plain") -> DataFrame:
    return topic_batch(spark, "parquet", path=topic_path(spark, sf_dir, kind))


def users_dimension(spark: SparkSession, sf_dir: str) -> tuple[str, Dimension]:
    """``users`` loaded as a dimension."""

    def write(path: str) -> None:
        refresh_dimension(users(spark, sf_dir), path)

    path = _once(spark, sf_dir, "users", write)
    return path, current_dimension(spark, path)
