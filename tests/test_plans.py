"""What the plans must look like to hold at scale."""

import re

import pytest
from pyspark.sql import functions as F

from millrace.operators.decode import decode, transactions
from millrace.operators.enrich import enrich_decoded, enriched
from millrace.operators.lookup import hot_keys, lookup_left, prune_lookup
from millrace.plans import fixtures
from millrace.plans.jobs import classify
from millrace.session import fresh_dir
from millrace.sources.dimension import current_dimension, refresh_dimension

SF_DIR = "/root/testdata/sf0.01"
# Longer methods are never compiled by the JVM.
JIT_LIMIT = 8000


@pytest.fixture(scope="module")
def topic(spark):
    return fixtures.topic(spark, SF_DIR)


def explained(frame, mode, capsys):
    capsys.readouterr()
    frame.explain(mode)
    return capsys.readouterr().out


def test_decode_is_compiled_and_parses_twice(topic, capsys):
    text = explained(decode(topic), "codegen", capsys)
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", text))) < JIT_LIMIT
    plan = explained(decode(topic), "formatted", capsys)
    assert plan.count("VariantExpressionEvalUtils.parseJson(") == 2


def test_filters_stay_above_decode(topic, capsys):
    plan = explained(transactions(decode(topic)), "formatted", capsys)
    assert plan.count("VariantExpressionEvalUtils.parseJson(") == 2


def test_scan_reads_only_what_is_decoded(topic, capsys):
    plan = explained(decode(topic), "formatted", capsys)
    (columns,) = re.findall(r"ReadSchema: struct<(.*)>", plan)
    assert {column.split(":")[0] for column in columns.split(",")} == {"value", "topic", "partition", "offset"}


def test_small_dimension_needs_no_shuffle(spark, topic, capsys):
    _, dimension = fixtures.users_dimension(spark, SF_DIR)
    frame = enriched(enrich_decoded(decode(topic), dimension.lookup, small=True))
    plan = explained(frame, "formatted", capsys)
    assert "BroadcastHashJoin" in plan
    assert "\n+- Exchange" not in plan and "SortMergeJoin" not in plan and "NestedLoop" not in plan
    assert plan.count("BroadcastExchange") >= 1 and "hashpartitioning" not in plan


def test_large_dimension_is_spread_by_salt(spark, topic, capsys):
    _, dimension = fixtures.users_dimension(spark, SF_DIR)
    frame = enrich_decoded(decode(topic), dimension.lookup, small=False, hot=[(1, 4), (None, 3)])
    plan = explained(frame, "formatted", capsys)
    assert "SortMergeJoin" in plan and "NestedLoop" not in plan and "Cartesian" not in plan
    assert re.search(r"hashpartitioning\(.*salt", plan)


def test_routing_is_pushed_to_the_scan(spark, topic, capsys):
    from millrace.sources.topic import route_topic

    plan = explained(route_topic(topic, "cdc", "mydatabase", "transactions"), "formatted", capsys)
    assert "EqualTo(topic,cdc.mydatabase.transactions)" in plan


def test_hot_keys_are_found_and_cut_to_fair_parts(spark):
    events = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, -7).when(F.col("id") % 3 == 1, F.col("id")).alias("k")
    )
    assert dict(hot_keys(events, "k", 12)) == {-7: 4, None: 4}
    assert hot_keys(events.limit(0), "k", 12) == []


def test_hot_keys_spread_over_the_join(spark):
    events = spark.range(30000).select(
        "id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 1000).alias("k")
    )
    lookup = spark.range(900).select(F.col("id").alias("key"), (F.col("id") * 2).alias("double"))
    hot = hot_keys(events, "k", 16)
    joined = lookup_left(events, lookup, "k", "key", small=False, spread=["id"], hot=hot)
    plain = events.join(lookup, events.k.eqNullSafe(lookup.key), "left").select("id", "double")
    assert joined.count() == 30000
    assert joined.select("id", "double").exceptAll(plain).isEmpty()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 10000


def test_rows_outside_only_find_nothing(spark):
    events = spark.createDataFrame([(1, 1), (2, 1), (3, None)], "id int, k int")
    lookup = spark.createDataFrame([(1, "a"), (None, "n")], "key int, name string")
    for small in (True, False):
        joined = lookup_left(events, lookup, "k", "key", small=small, only=F.col("id") != 2, hot=[(1, 2)])
        names = {row.id: row.name for row in joined.select("id", "name").collect()}
        assert names == {1: "a", 2: None, 3: "n"}


@pytest.fixture(scope="module")
def large(spark):
    """Users in eight buckets, the null key's row among them."""
    path = fresh_dir(spark, "users")
    users = spark.range(4000).select(
        F.when(F.col("id") > 0, F.col("id")).alias("user_id"), F.concat(F.lit("n"), "id").alias("name"), F.lit("c").alias("city")
    )
    refresh_dimension(users, path, bucket_rows=500)
    return path, users


def key_events(spark):
    """A third under one key, a third under none, the rest under some 6,000, of which 4,000 exist."""
    key = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 3 == 1, F.col("id") % 6000)
    return spark.range(30000).select(F.col("id").alias("n"), key.cast("long").alias("k"))


def test_a_lookup_in_buckets_is_not_shuffled(spark, large, capsys):
    dimension = current_dimension(spark, large[0])
    events = key_events(spark)
    hot = hot_keys(events, "k", 8)
    joined = lookup_left(events, dimension.laid_out, "k", "user_id", small=False, only=F.col("n") % 10 != 0, hot=hot, laid_out=True)
    plan = explained(joined, "formatted", capsys)
    tree = plan[: plan.index("\n(1) ")]
    merge = tree[tree.index("SortMergeJoin") :]
    sides = merge.split("\n")
    assert "Bucketed: true" in plan and tree.count("hashpartitioning") + plan.count("Arguments: hashpartitioning(k") >= 1
    assert sum("Exchange" in line and "Broadcast" not in line for line in sides) == 1  # the events'
    plain = events.join(large[1], (F.col("n") % 10 != 0) & events.k.eqNullSafe(F.col("user_id")), "left").select("n", "name")
    assert joined.select("n", "name").exceptAll(plain).isEmpty() and joined.count() == 30000
    assert dict(hot).keys() == {7, None}


def test_another_session_finds_the_buckets(spark, large):
    other = spark.newSession()
    dimension = current_dimension(other, large[0])
    assert dimension.laid_out.count() == dimension.lookup.count() == 4000


def test_hot_keys_of_a_lookup_in_buckets_stay_where_they_are(spark, large):
    events = key_events(spark)
    joined = lookup_left(events, current_dimension(spark, large[0]).laid_out, "k", "user_id", small=False, hot=[(7, 3), (None, 3)], laid_out=True)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [row["count"] for row in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(sizes) < 10000


@pytest.mark.parametrize("words", [1 << 17, 2])
def test_a_lookup_is_pruned_by_the_keys(spark, large, words):
    """Two words have 128 bits: most rows of other keys share one with an event's."""
    lookup = current_dimension(spark, large[0]).laid_out
    events = spark.range(20).select("id", F.when(F.col("id") > 1, F.col("id") * 3).alias("k"))
    pruned = prune_lookup(lookup, "user_id", events, "k", words)
    held = {row.user_id for row in pruned.collect()}
    assert {None, *range(6, 60, 3)} <= held and len(held) < (25 if words > 2 else 1200)
    whole, part = (lookup_left(events, side, "k", "user_id", small=False).select("id", "name") for side in (lookup, pruned))
    assert whole.exceptAll(part).isEmpty() and part.count() == 20
    assert prune_lookup(lookup, "user_id", events.limit(0), "k", words).count() == 1


@pytest.mark.parametrize("messages", [50, 6000])
def test_a_batch_against_a_lookup_in_buckets(spark, large, messages):
    """Fewer messages than users are met by the pruned rows, more by the buckets."""
    dimension = current_dimension(spark, large[0])
    decoded = decode(spark.read.parquet(fixtures.topic_path(spark, SF_DIR))).where(F.col("offset") < messages)
    classified = classify(decoded, dimension, fresh_dir(spark, "decoded"), broadcast_bytes=0)
    small = classify(decoded, dimension, fresh_dir(spark, "decoded"), broadcast_bytes=1 << 40)
    columns = ["offset", "outcome", "reason", "user_name", "matched"]
    assert classified.select(columns).exceptAll(small.select(columns)).isEmpty() and classified.count() == small.count() > 0
