"""One query per operator over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.decode import decode, transactions
from millrace.operators.encode import encode_envelope
from millrace.operators.enrich import enriched
from millrace.operators.inspect import first_rows, local_time, round_amount, utc_time
from millrace.operators.lookup import hot_keys, lookup_left, reduce_dimension
from millrace.plans import fixtures
from millrace.plans.jobs import BROADCAST_BYTES, FED_BACK, backfill, classify, feed_back
from millrace.schemas import TXN, UNKNOWN
from millrace.session import fresh_dir
from millrace.sinks.files import delete_path
from millrace.sinks.records import compact_sink, materialise_raw, read_counts, read_enriched, read_quarantine, read_sink, vacuum_sink
from millrace.sources.dimension import (
    current_dimension,
    refresh_dimension,
    load_documents,
    seed_users,
)
from millrace.sources.ranges import Slice
from millrace.sources.topic import route_topic, topic_batch, topic_stream
from millrace.streaming.stream import run_raw_stream, run_stream


def _utc(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", utc_time(F.col("timestamp")))


def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dimension = fixtures.users_dimension(spark, sf_dir)
    decoded = decode(fixtures.topic(spark, sf_dir))
    return _utc(enriched(classify(decoded, dimension, fresh_dir(spark, "decoded"))))


def decode_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _utc(transactions(decode(fixtures.topic(spark, sf_dir))))


def _with_default(joined: DataFrame, field: str, name: str) -> DataFrame:
    return joined.select("event_id", F.when(F.col("found"), F.col(field)).otherwise(UNKNOWN).alias(name))


def _lookup(events: DataFrame, lookup: DataFrame, on: str, key: str, small: bool) -> DataFrame:
    hot = None if small else hot_keys(events, on)
    return lookup_left(events, lookup, on, key, small=small, spread=["event_id"], hot=hot)


def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, dimension = fixtures.users_dimension(spark, sf_dir)
    events = fixtures.read_table(spark, sf_dir, "events").select("event_id", "user_id")
    small = dimension.lookup_bytes <= BROADCAST_BYTES
    lookup = dimension.lookup.select("user_id", "name")
    return _with_default(_lookup(events, lookup, "user_id", "user_id", small), "name", "user_name")


def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(fixtures.topic(spark, sf_dir, "damaged"))
    return decoded.groupBy("outcome", "reason").agg(F.count(F.lit(1)).alias("n"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    sink = fresh_dir(spark, "sink")
    path, _ = fixtures.users_dimension(spark, sf_dir)
    backfill(fixtures.topic(spark, sf_dir, "damaged"), path, sink)
    return read_quarantine(spark, sink).select("offset", "reason")


def null_key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    nobody = spark.createDataFrame([(None, "Anon", "Nowhere")], fixtures.users(spark, sf_dir).schema)
    path = fresh_dir(spark, "users")
    refresh_dimension(fixtures.users(spark, sf_dir).unionByName(nobody), path)
    dimension = current_dimension(spark, path)
    events = fixtures.read_table(spark, sf_dir, "events").select(
        "event_id", F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("k")
    )
    small = dimension.lookup_bytes <= BROADCAST_BYTES
    lookup = dimension.lookup.select("user_id", "name")
    return _with_default(_lookup(events, lookup, "k", "user_id", small), "name", "user_name")


def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders are as many as the events, so this join is a shuffled one."""
    orders = fixtures.read_table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderpriority"
    )
    lookup = reduce_dimension(orders, "o_custkey", "o_orderkey")
    events = fixtures.read_table(spark, sf_dir, "events").select("event_id", "user_id")
    joined = _lookup(events, lookup, "user_id", "o_custkey", small=False)
    return _with_default(joined, "o_orderpriority", "priority")


def lookup_skewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the events under one id and a third under none, in a shuffled join."""
    _, dimension = fixtures.users_dimension(spark, sf_dir)
    events = fixtures.read_table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, 1)
        .when(F.col("event_id") % 3 == 1, F.col("user_id"))
        .alias("k"),
    )
    lookup = dimension.lookup.select("user_id", "name")
    return _with_default(_lookup(events, lookup, "k", "user_id", small=False), "name", "user_name")


def dimension_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "users")
    refresh_dimension(seed_users(spark), path)
    refresh_dimension(fixtures.all_customers(spark, sf_dir), path)
    refresh_dimension(fixtures.users(spark, sf_dir), path)
    return current_dimension(spark, path).rows.agg(
        F.count(F.lit(1)).alias("n"), F.sum("user_id").alias("key_sum")
    )


def dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "users")
    refresh_dimension(fixtures.all_customers(spark, sf_dir), path)
    return current_dimension(spark, path).rows.select("user_id", "name", "city")


def _customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as JSON documents: some lack the name, the city or both, have a null name, or are no JSON."""
    kind = F.col("user_id") % 5
    return fixtures.all_customers(spark, sf_dir).select(
        F.when(kind == 0, F.to_json(F.struct("user_id", "name", "city")))
        .when(kind == 1, F.to_json(F.struct("user_id", "city")))
        .when(kind == 2, F.to_json(F.struct("user_id")))
        .when(kind == 3, F.concat(F.lit('{"name":null,'), F.substr(F.to_json(F.struct("user_id", "city")), F.lit(2))))
        .otherwise(F.concat(F.to_json(F.struct("user_id", "name", "city")), F.lit("}")))
        .alias("document")
    )


def dimension_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events against users read from documents, among them half users and rejected ones."""
    path = fresh_dir(spark, "users")
    load_documents(_customer_documents(spark, sf_dir), "document", path)
    dimension = current_dimension(spark, path)
    decoded = decode(fixtures.topic(spark, sf_dir))
    return classify(decoded, dimension, fresh_dir(spark, "decoded")).select(
        "offset", "outcome", "reason", "user_name", "user_city"
    )


def inspect_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_rows(enrich(spark, sf_dir), "transaction_id", 5)


def replay_earliest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topic_batch(spark, "parquet", path=fixtures.topic_path(spark, sf_dir)).select(
        "offset", F.col("key").cast("string").alias("event_type")
    )


def encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Read back by a path of its own, not by ``decode``."""
    text = F.col("value").cast("string")
    return encode_envelope(fixtures.events_as_transactions(spark, sf_dir)).select(
        F.get_json_object(text, "$.op").alias("op"),
        F.get_json_object(F.get_json_object(text, "$.after"), "$._id.$oid").alias("oid"),
    )


def local_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = decode(fixtures.topic(spark, sf_dir, "creates"))
    return decoded.select(
        F.col("offset").alias("event_id"), local_time(F.col("timestamp")).alias("local_time")
    )


def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = route_topic(fixtures.topic(spark, sf_dir, "mixed"), "cdc", "mydatabase", "transactions")
    return routed.select("offset")


def raw_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_dir(spark, "raw")
    materialise_raw(decode(fixtures.topic(spark, sf_dir)), path)
    return _utc(spark.read.schema(TXN).parquet(path))


def round_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.read_table(spark, sf_dir, "events").select(
        "event_id", round_amount(F.col("value") / 3).alias("amount")
    )


def _counted(spark: SparkSession, sink: str, *names: str) -> DataFrame:
    """The sink's counts, summed over its batches, a row for each name."""
    sums = read_counts(spark, sink).agg(*[F.sum(name).alias(name) for name in names])
    return sums.unpivot([], list(names), "metric", "n")


_OUTCOMES = ("received", "enriched", "skipped", "empty", "error")


def backfill_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts a backfill of the damaged topic left beside its records."""
    path, _ = fixtures.users_dimension(spark, sf_dir)
    sink = fresh_dir(spark, "sink")
    backfill(fixtures.topic(spark, sf_dir, "damaged"), path, sink)
    return _counted(spark, sink, *_OUTCOMES, "unknown")


def incomplete_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts of backfills against users read from documents: half users are errors."""
    path, sink = fresh_dir(spark, "users"), fresh_dir(spark, "sink")
    load_documents(_customer_documents(spark, sf_dir), "document", path)
    for half in (0, 1):
        backfill(fixtures.topic(spark, sf_dir).where(F.col("offset") % 2 == half), path, sink)
    return _counted(spark, sink, *_OUTCOMES, "unknown", "user_incomplete")


def seed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event against the seed users."""
    path = fresh_dir(spark, "users")
    refresh_dimension(seed_users(spark), path)
    decoded = decode(fixtures.topic(spark, sf_dir, "creates"))
    rows = classify(decoded, current_dimension(spark, path), fresh_dir(spark, "decoded"))
    return rows.select("offset", "user_name", "user_city")


def outcome_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic of all events in which every outcome occurs."""
    return decode(fixtures.topic(spark, sf_dir, "ladder")).select("offset", "outcome", "reason")


def extended_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic of all events with ids, amounts and dates in every accepted form."""
    decoded = decode(fixtures.topic(spark, sf_dir, "extended"))
    return _utc(decoded.select("offset", "transaction_id", "user_id", "amount", "timestamp"))


def backfill_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill by way of the staged, salted join for large dimensions."""
    path, _ = fixtures.users_dimension(spark, sf_dir)
    sink = fresh_dir(spark, "sink")
    backfill(fixtures.topic(spark, sf_dir), path, sink, broadcast_bytes=0)
    return _utc(read_enriched(spark, sink))


def load_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = refresh_dimension(fixtures.all_customers(spark, sf_dir), fresh_dir(spark, "users"))
    return spark.createDataFrame([(count,)], "n bigint")


def backfill_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A backfill of several ranges that fails between records and commit, and is called again."""
    path, _ = fixtures.users_dimension(spark, sf_dir)
    sink, topic = fresh_dir(spark, "sink"), fixtures.topic(spark, sf_dir)
    batch_rows = max(1, topic.count() // 3)
    calls = []

    def failing(slices: list[Slice]) -> DataFrame:
        calls.append(slices)
        if len(calls) == 2:
            raise OSError("the source is gone")
        return topic

    try:
        backfill(topic, path, sink, run="retry", batch_rows=batch_rows, read_range=failing)
    except OSError:
        backfill(topic, path, sink, run="retry", batch_rows=batch_rows)
    return _utc(read_enriched(spark, sink))


def feed_back_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half users become whole; the transactions that met them before leave the quarantine once, in two passes."""
    users, sink = fresh_dir(spark, "users"), fresh_dir(spark, "sink")
    load_documents(_customer_documents(spark, sf_dir), "document", users)
    backfill(fixtures.topic(spark, sf_dir), users, sink, run="first")
    refresh_dimension(fixtures.all_customers(spark, sf_dir), users)
    for _ in range(2):
        feed_back(spark, sink, users)
    fed = read_sink(spark, sink).where(F.col("owner") == FED_BACK)
    return fed.select("offset", "user_name", "user_city")


def compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a backfill of many ranges after most of them were merged and the merged ones deleted."""
    path, _ = fixtures.users_dimension(spark, sf_dir)
    sink, topic = fresh_dir(spark, "sink"), fixtures.topic(spark, sf_dir)
    backfill(topic, path, sink, run="many", batch_rows=max(1, topic.count() // 6))
    compact_sink(spark, sink)
    vacuum_sink(spark, sink, older_than=0.0)
    return _utc(read_enriched(spark, sink))


_ONCE = {"availableNow": True}


def _few_files(spark: SparkSession) -> str:
    """Files a batch: a quarter of a topic, which has one for every core."""
    return str(max(1, spark.sparkContext.defaultParallelism // 4))


def _run(spark: SparkSession, topic_path: str, dimension: str, sink: str, checkpoint: str, **options):
    source = topic_stream(spark, "parquet", path=topic_path, maxFilesPerTrigger=_few_files(spark))
    query = run_stream(source, dimension, sink, checkpoint, trigger=_ONCE, **options)
    query.awaitTermination()
    return query


def enrich_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    sink = fresh_dir(spark, "sink")
    _run(spark, fixtures.topic_path(spark, sf_dir), dimension, sink, fresh_dir(spark, "checkpoint"))
    return _utc(read_enriched(spark, sink))


def _append_half(spark: SparkSession, sf_dir: str, path: str, half: int, kind: str = "plain") -> None:
    records = fixtures.topic(spark, sf_dir, kind).where(F.col("offset") % 2 == half)
    records.write.mode("append").parquet(path)


def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs with one checkpoint; the second half of the topic arrives in between."""
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    topic_path, sink, checkpoint = (fresh_dir(spark, name) for name in ("topic", "sink", "checkpoint"))
    for half in (0, 1):
        _append_half(spark, sf_dir, topic_path, half)
        _run(spark, topic_path, dimension, sink, checkpoint)
    return _utc(read_enriched(spark, sink))


def dimension_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even events meet the users, odd ones, a batch later, all customers."""
    dimension = fresh_dir(spark, "users")
    topic_path, sink, checkpoint = (fresh_dir(spark, name) for name in ("topic", "sink", "checkpoint"))
    for half, people in ((0, fixtures.users), (1, fixtures.all_customers)):
        refresh_dimension(people(spark, sf_dir), dimension)
        _append_half(spark, sf_dir, topic_path, half, "creates")
        _run(spark, topic_path, dimension, sink, checkpoint)
    return read_enriched(spark, sink).select(
        F.conv("transaction_id", 16, 10).cast("bigint").alias("event_id"), "user_name"
    )


def replay_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last batch runs again, as after a crash between its write and its commit."""
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    topic_path = fixtures.topic_path(spark, sf_dir)
    sink, checkpoint = fresh_dir(spark, "sink"), fresh_dir(spark, "checkpoint")
    last = _run(spark, topic_path, dimension, sink, checkpoint).lastProgress["batchId"]
    delete_path(spark, f"{checkpoint}/commits/{last}")
    delete_path(spark, f"{checkpoint}/commits/.{last}.crc")
    _run(spark, topic_path, dimension, sink, checkpoint)
    return _utc(read_enriched(spark, sink))


def reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second run that starts over: sink and position cleared together."""
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    topic_path = fixtures.topic_path(spark, sf_dir)
    sink, checkpoint = fresh_dir(spark, "sink"), fresh_dir(spark, "checkpoint")
    _run(spark, topic_path, dimension, sink, checkpoint)
    _run(spark, topic_path, dimension, sink, checkpoint, reset=True)
    return _utc(read_enriched(spark, sink))


def raw_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    topic_path = fixtures.topic_path(spark, sf_dir)
    path, checkpoint = fresh_dir(spark, "raw"), fresh_dir(spark, "checkpoint")
    source = topic_stream(spark, "parquet", path=topic_path, maxFilesPerTrigger=_few_files(spark))
    run_raw_stream(source, path, checkpoint, trigger=_ONCE).awaitTermination()
    return _utc(spark.read.schema(TXN).parquet(path))


def stream_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts summed over all batches of a stream, as kept in its sink."""
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    topic_path, sink = fixtures.topic_path(spark, sf_dir, "damaged"), fresh_dir(spark, "sink")
    _run(spark, topic_path, dimension, sink, fresh_dir(spark, "checkpoint"))
    return _counted(spark, sink, *_OUTCOMES)


def backfill_then_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that starts, and starts over, on a sink that a backfill filled: both keep their own."""
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    topic_path, sink, checkpoint = fixtures.topic_path(spark, sf_dir), fresh_dir(spark, "sink"), fresh_dir(spark, "checkpoint")
    backfill(fixtures.topic(spark, sf_dir), dimension, sink)
    _run(spark, topic_path, dimension, sink, checkpoint)
    _run(spark, topic_path, dimension, sink, checkpoint, reset=True)
    return _utc(read_enriched(spark, sink))


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic's messages arrive twice, the second time in another run, and are kept once."""
    dimension, _ = fixtures.users_dimension(spark, sf_dir)
    topic_path, sink, checkpoint = (fresh_dir(spark, name) for name in ("topic", "sink", "checkpoint"))
    for _ in range(2):
        fixtures.topic(spark, sf_dir).write.mode("append").parquet(topic_path)
        _run(spark, topic_path, dimension, sink, checkpoint, once_within="365 days")
    return _utc(read_enriched(spark, sink))


QUERIES = {
    "q01_enrich": enrich,
    "q02_decode": decode_only,
    "q03_lookup_default": lookup_default,
    "q04_outcome_counts": outcome_counts,
    "q05_quarantine": quarantine,
    "q06_null_key_lookup": null_key_lookup,
    "q07_lookup_first_match": lookup_first_match,
    "q08_dimension_refresh": dimension_refresh,
    "q09_inspect_limit": inspect_limit,
    "q10_replay_earliest": replay_earliest,
    "q11_encode_envelope": encode,
    "q12_local_time": local_times,
    "q13_topic_route": route,
    "q14_raw_materialise": raw_materialise,
    "q15_round_amount": round_amounts,
    "q16_lookup_skewed": lookup_skewed,
    "q17_dimension_documents": dimension_documents,
    "q18_backfill_large": backfill_large,
    "q19_backfill_metrics": backfill_metrics,
    "q20_dimension_scan": dimension_scan,
    "q21_load_count": load_count,
    "q22_outcome_ladder": outcome_ladder,
    "q23_extended_json": extended_json,
    "q24_seed_lookup": seed_lookup,
    "q25_incomplete_metrics": incomplete_metrics,
    "q26_backfill_retry": backfill_retry,
    "q27_feed_back": feed_back_twice,
    "q28_compacted_sink": compacted,
    "s01_enrich_stream": enrich_stream,
    "s02_stream_resume": stream_resume,
    "s03_dimension_freshness": dimension_freshness,
    "s04_replay_idempotent": replay_idempotent,
    "s05_reset": reset,
    "s06_raw_stream": raw_stream,
    "s07_stream_metrics": stream_metrics,
    "s08_backfill_then_stream": backfill_then_stream,
    "s09_redelivered": redelivered,
}
