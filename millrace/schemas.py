"""Declared schemas and the names of message outcomes."""

from __future__ import annotations

from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("name", T.StringType()),
    T.StructField("city", T.StringType()),
])

# The public shape of Spark's Kafka source.
TOPIC = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

TXN = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("timestamp", T.TimestampType()),
])

ENRICHED = T.StructType([
    *TXN.fields,
    T.StructField("user_name", T.StringType()),
    T.StructField("user_city", T.StringType()),
])

# Where a message came from, what became of it and, for errors found in the
# message itself, its untouched bytes (so that it can be fed in again).
VERDICT = T.StructType([
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("outcome", T.StringType()),
    T.StructField("reason", T.StringType()),
])

QUARANTINE = T.StructType([*VERDICT.fields, *TXN.fields])

# One row per message that reached a sink.
CLASSIFIED = T.StructType([*VERDICT.fields, *ENRICHED.fields])

ENRICHED_OUTCOME = "ENRICHED"
SKIPPED = "SKIPPED"
EMPTY = "EMPTY"
ERROR = "ERROR"
OUTCOMES = (ENRICHED_OUTCOME, SKIPPED, EMPTY, ERROR)

SKIP_REASONS = ("TOMBSTONE", "EMPTY_ENVELOPE", "OP")
UNKNOWN = "Unknown"
