"""Dimension versions, sinks, inspection and the continuous job."""

import datetime as dt
import json
import math
from concurrent.futures import ThreadPoolExecutor

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators.decode import decode
from millrace.operators.inspect import first_rows, local_time, round_amount, utc_time
from millrace.plans import jobs
from millrace.plans.jobs import backfill, write_enriched
from millrace.schemas import ENRICHED, QUARANTINE, TOPIC
from millrace.session import fresh_dir, shared_dir
from millrace.sinks.files import delete_path, file_names, path_exists
from millrace.sinks.records import read_batch, read_counts, read_enriched, read_quarantine
from millrace.sources.dimension import current_dimension, load_documents, refresh_dimension, seed_users
from millrace.sources.topic import topic_stream
from millrace.streaming.stream import run_stream

ONCE = {"availableNow": True}


@pytest.fixture
def home(spark):
    return fresh_dir(spark, "test")


def change(number, user_id, op="c"):
    document = {"_id": {"$oid": f"{number:024x}"}, "user_id": user_id, "amount": 1.5, "timestamp": {"$date": 0}}
    return json.dumps({"op": op, "after": json.dumps(document)}).encode()


def topic(spark, values, first=0):
    rows = [(None, value, "t", 0, first + i, None) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, TOPIC).coalesce(1)


def run(spark, home, **options):
    source = topic_stream(spark, "parquet", path=f"{home}/topic", maxFilesPerTrigger="1")
    query = run_stream(source, f"{home}/users", f"{home}/sink", f"{home}/checkpoint", trigger=ONCE, **options)
    query.awaitTermination()
    return query


def names(spark, home):
    return sorted(row.user_name for row in read_enriched(spark, f"{home}/sink").collect())


def test_seed_users(spark, home):
    assert refresh_dimension(seed_users(spark), home) == 3
    assert [row.name for row in current_dimension(spark, home).rows.orderBy("user_id").collect()] == [
        "Alice", "Bob", "Charlie",
    ]


def test_refresh_replaces_and_old_readers_keep_their_version(spark, home):
    with pytest.raises(ValueError):
        current_dimension(spark, home)
    refresh_dimension(seed_users(spark), home)
    before = current_dimension(spark, home)
    refresh_dimension(seed_users(spark).where("user_id = 1"), home)
    after = current_dimension(spark, home)
    assert (before.rows.count(), after.rows.count()) == (3, 1)
    assert (before.version, after.version, after.row_count) == (1, 2, 1)
    refresh_dimension(seed_users(spark).limit(0), home)
    assert current_dimension(spark, home).lookup_bytes == 0


def test_unfinished_load_is_not_seen(spark, home):
    refresh_dimension(seed_users(spark), home)
    broken = seed_users(spark).withColumn("name", F.raise_error(F.lit("lost")))
    with pytest.raises(Exception, match="lost"):
        refresh_dimension(broken, home)
    assert current_dimension(spark, home).rows.count() == 3


def test_first_loaded_user_counts(spark, home):
    users = spark.createDataFrame([(1, "B", "x"), (1, "A", "y"), (None, "N", "z")], seed_users(spark).schema).coalesce(1)
    assert refresh_dimension(users, home) == 3
    dimension = current_dimension(spark, home)
    assert dimension.rows.count() == 3
    assert {(row.user_id, row.name) for row in dimension.lookup.collect()} == {(1, "B"), (None, "N")}


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_backfill(spark, home, broadcast_bytes):
    refresh_dimension(seed_users(spark), f"{home}/users")
    values = [change(1, 1), change(2, 9), b"{", None, change(3, 2, "u"), change(4, 1)]
    counts = backfill(topic(spark, values), f"{home}/users", f"{home}/sink", broadcast_bytes)
    assert counts == {"received": 6, "enriched": 3, "skipped": 2, "empty": 0, "error": 1, "unknown": 1, "user_incomplete": 0}
    assert names(spark, home) == ["Alice", "Alice", "Unknown"]
    bad = read_quarantine(spark, f"{home}/sink").collect()
    assert [(row.offset, bytes(row.value), row.reason) for row in bad] == [(2, b"{", "BAD_JSON")]
    assert read_enriched(spark, f"{home}/sink").columns == ENRICHED.names
    assert read_quarantine(spark, f"{home}/sink").columns == QUARANTINE.names


def test_staging_leaves_nothing_behind(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    backfill(topic(spark, [change(1, 1)]), f"{home}/users", f"{home}/sink", broadcast_bytes=0)
    assert "decoded-" not in " ".join(
        str(status.getPath())
        for status in spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
        .getFileSystem(spark._jsc.hadoopConfiguration())
        .listStatus(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)))
    )


def test_staging_is_removed_when_the_write_fails(spark, home, monkeypatch):
    refresh_dimension(seed_users(spark), f"{home}/users")

    def fail(*_):
        raise OSError("no room")

    monkeypatch.setattr(jobs, "write_batch", fail)
    before = set(file_names(spark, shared_dir(spark)))
    with pytest.raises(OSError):
        backfill(topic(spark, [change(1, 1)]), f"{home}/users", f"{home}/sink", broadcast_bytes=0)
    assert set(file_names(spark, shared_dir(spark))) == before


def test_backfills_add_to_the_sink(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    backfill(topic(spark, [change(1, 1), change(2, 2)]), f"{home}/users", f"{home}/sink")
    backfill(topic(spark, [change(3, 3)]), f"{home}/users", f"{home}/sink")
    assert names(spark, home) == ["Alice", "Bob", "Charlie"]
    assert read_counts(spark, f"{home}/sink").count() == 2


def test_backfill_into_the_sink_of_a_stream(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    topic(spark, [change(1, 1), change(2, 2)]).write.parquet(f"{home}/topic")
    run(spark, home)
    backfill(topic(spark, [change(3, 3)]), f"{home}/users", f"{home}/sink")
    topic(spark, [change(4, 1)]).write.mode("append").parquet(f"{home}/topic")
    run(spark, home)
    assert names(spark, home) == ["Alice", "Alice", "Bob", "Charlie"]


def test_counts_go_by_the_final_outcome(spark, home):
    """Half a user is an error; a user really named Unknown was found."""
    users = [(1, "Unknown", "Unknown", True, True), (2, "Half", None, True, False)]
    schema = "user_id bigint, name string, city string, has_name boolean, has_city boolean"
    refresh_dimension(spark.createDataFrame(users, schema), f"{home}/users")
    values = [change(1, 1), change(2, 2), change(3, 9), b"{", None]
    counts = backfill(topic(spark, values), f"{home}/users", f"{home}/sink")
    expected = {"received": 5, "enriched": 2, "skipped": 1, "empty": 0, "error": 2, "unknown": 1, "user_incomplete": 1}
    assert counts == expected
    row = read_counts(spark, f"{home}/sink").drop("owner", "batch_id").first().asDict()
    assert row == expected and read_quarantine(spark, f"{home}/sink").count() == 2


def test_counts_of_a_stream_outlive_its_progress(spark, home):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "1")
    try:
        refresh_dimension(seed_users(spark), f"{home}/users")
        for i in range(4):
            topic(spark, [change(i, 1), b"{"]).coalesce(1).write.mode("append").parquet(f"{home}/topic")
        run(spark, home)
        last = read_counts(spark, f"{home}/sink").agg({"batch_id": "max"}).first()[0]
        assert last >= 3
        for name in (f"{last}", f".{last}.crc"):
            delete_path(spark, f"{home}/checkpoint/commits/{name}")
        topic(spark, [change(9, 9)]).coalesce(1).write.mode("append").parquet(f"{home}/topic")
        run(spark, home)  # repeats the last batch and goes on
    finally:
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    sums = read_counts(spark, f"{home}/sink").agg(*[F.sum(c).alias(c) for c in ("received", "enriched", "error", "unknown")]).first()
    assert tuple(sums) == (9, 5, 4, 1)


def test_one_batch_is_read_without_listing_the_others(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    dimension = current_dimension(spark, f"{home}/users")
    for i in range(3):
        write_enriched(decode(topic(spark, [change(i, 1)])), dimension, f"{home}/sink", i)
    batch = read_batch(spark, f"{home}/sink", 1)
    assert all("attempt=00000000000000000001." in path for path in batch.inputFiles())
    assert [row.batch_id for row in batch.collect()] == [1]


def test_loads_at_the_same_time_are_all_listed(spark, home):
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda i: refresh_dimension(seed_users(spark).limit(i), home), (1, 2, 3)))
    assert len(file_names(spark, f"{home}/versions")) == 3
    assert current_dimension(spark, home).row_count in (1, 2, 3)


def test_old_versions_are_dropped(spark, home):
    for i in (1, 2, 3, 3):
        refresh_dimension(seed_users(spark).limit(i), home, keep=2)
    assert len(file_names(spark, f"{home}/versions")) == 2
    assert len([name for name in file_names(spark, home) if name.startswith("v0")]) == 2
    assert current_dimension(spark, home).rows.count() == 3


def test_documents_that_are_no_users_are_accounted_for(spark, home):
    texts = ['{"user_id":1,"name":"A","city":"B"}', "{", "[1]", '{"user_id":"x"}', '{"name":"N","city":"C"}', None]
    documents = spark.createDataFrame([(t,) for t in texts], "document string")
    assert load_documents(documents, "document", home) == (2, 4)
    dimension = current_dimension(spark, home)
    rejected = sorted((row.reason, row.document or "") for row in dimension.rejected.collect())
    assert rejected == [("BAD_JSON", ""), ("BAD_JSON", "{"), ("ID", '{"user_id":"x"}'), ("NOT_OBJECT", "[1]")]


def test_stream_by_processing_time(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    topic(spark, [change(1, 1), change(2, 2)]).write.parquet(f"{home}/topic")
    source = topic_stream(spark, "parquet", path=f"{home}/topic")
    query = run_stream(source, f"{home}/users", f"{home}/sink", f"{home}/checkpoint")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert names(spark, home) == ["Alice", "Bob"]


def test_replayed_batch_replaces_records_and_quarantine(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    dimension, sink = current_dimension(spark, f"{home}/users"), f"{home}/sink"
    write_enriched(decode(topic(spark, [change(1, 1), b"{"])), dimension, sink, 0)
    write_enriched(decode(topic(spark, [change(2, 2)])), dimension, sink, 1)
    write_enriched(decode(topic(spark, [change(1, 1)])), dimension, sink, 0)
    assert names(spark, home) == ["Alice", "Bob"]
    assert read_quarantine(spark, sink).isEmpty()


def test_redelivered_message_is_appended_again(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    backfill(topic(spark, [change(1, 1), change(1, 1)]), f"{home}/users", f"{home}/sink")
    assert names(spark, home) == ["Alice", "Alice"]


def test_empty_sink_reads_as_empty(spark, home):
    assert read_enriched(spark, f"{home}/sink").isEmpty()


def test_stream_resumes_and_sees_new_users(spark, home):
    refresh_dimension(seed_users(spark).where("user_id = 1"), f"{home}/users")
    topic(spark, [change(1, 1), change(2, 2)]).write.parquet(f"{home}/topic")
    query = run(spark, home)
    assert names(spark, home) == ["Alice", "Unknown"]
    assert query.recentProgress[0]["observedMetrics"]["decoded"].enriched == 2
    refresh_dimension(seed_users(spark), f"{home}/users")
    topic(spark, [change(3, 2)], first=2).write.mode("append").parquet(f"{home}/topic")
    run(spark, home)
    assert names(spark, home) == ["Alice", "Bob", "Unknown"]
    run(spark, home)
    assert names(spark, home) == ["Alice", "Bob", "Unknown"]


def test_crash_between_write_and_commit(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    topic(spark, [change(1, 1), b"{"]).write.parquet(f"{home}/topic")

    def crash(_):
        raise RuntimeError("lost driver")

    with pytest.raises(Exception, match="lost driver"):
        run(spark, home, publish=crash)
    assert names(spark, home) == ["Alice"]
    seen = []
    run(spark, home, publish=lambda records: seen.append(records.count()))
    assert names(spark, home) == ["Alice"] and seen == [1]
    assert read_quarantine(spark, f"{home}/sink").count() == 1


def test_reset_clears_position_and_records_together(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    topic(spark, [change(1, 1)]).write.parquet(f"{home}/topic")
    run(spark, home)
    refresh_dimension(seed_users(spark).where("user_id = 2"), f"{home}/users")
    run(spark, home, reset=True)
    assert names(spark, home) == ["Unknown"]
    delete_path(spark, f"{home}/checkpoint")
    with pytest.raises(ValueError, match="another position"):
        run(spark, home)
    run(spark, home, reset=True)
    assert names(spark, home) == ["Unknown"]
    assert path_exists(spark, f"{home}/checkpoint")


def test_stream_with_large_dimension(spark, home):
    refresh_dimension(seed_users(spark), f"{home}/users")
    topic(spark, [change(i, 1) for i in range(40)] + [b"{"]).write.parquet(f"{home}/topic")
    run(spark, home, broadcast_bytes=0)
    assert names(spark, home) == ["Alice"] * 40
    assert read_quarantine(spark, f"{home}/sink").count() == 1


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Ho_Chi_Minh"])
def test_times_do_not_depend_on_the_session_zone(spark, zone):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        instants = spark.createDataFrame([(1699164000000,), (1699167600000,)], "ms bigint").select(
            F.timestamp_millis("ms").alias("t")
        )
        row, later = instants.select(utc_time(F.col("t")).alias("u"), local_time(F.col("t")).alias("l")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (row.u, row.l) == (dt.datetime(2023, 11, 5, 6), dt.datetime(2023, 11, 5, 13))
    assert (later.u, later.l) == (dt.datetime(2023, 11, 5, 7), dt.datetime(2023, 11, 5, 14))


def test_first_rows(spark):
    assert [row.id for row in first_rows(spark.range(100), "id").collect()] == [0, 1, 2, 3, 4]


cents = st.integers(-(10**7), 10**7)
amounts = st.one_of(
    st.floats(10, 500),
    st.floats(allow_nan=False),
    cents.map(lambda n: n / 1000),
    cents.map(lambda n: n / 8),
    st.integers(-(2**55), 2**55).map(float),
)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(amounts, min_size=500, max_size=1000))
def test_rounding_goes_by_the_binary_value(spark, values):
    values = [1.005, 2.675, 0.125, 0.375, -0.125, -1.005, math.inf, math.nan, None, *values]
    frame = spark.createDataFrame([(v,) for v in values], "x double").coalesce(1)
    got = [row.y for row in frame.select(round_amount(F.col("x")).alias("y")).collect()]
    expected = [None if v is None else round(v, 2) for v in values]
    for value, a, b in zip(values, got, expected):
        assert a == b or (a != a and b != b), value
