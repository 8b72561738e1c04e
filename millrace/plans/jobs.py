"""Decoded messages to the sink: one pass for small dimensions, a staged one for large."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.operators.decode import decode
from millrace.operators.enrich import enrich_decoded
from millrace.operators.lookup import key_profile, prune_lookup
from millrace.schemas import ENRICHED_OUTCOME, ERROR, OUTCOMES
from millrace.session import fresh_dir
from millrace.sinks.files import delete_path, publish_first, read_text
from millrace.sinks.records import (
    COUNTED,
    STREAM,
    check_owner,
    commit_batch,
    committed,
    owner_folder,
    read_counts,
    read_quarantine,
    read_sink,
    write_batch,
)
from millrace.sources.dimension import Dimension, current_dimension
from millrace.sources.ranges import PLACE, Slice, offset_spans, plan_ranges, range_name, within

# Largest lookup table, as measured when it was loaded, that is sent to every executor.
BROADCAST_BYTES = 64 * 1024 * 1024
# Messages of a backfill that are done, and done again after a failure, at once.
BATCH_ROWS = 500_000_000
FED_BACK = "fed-back"
USER_INCOMPLETE = "USER_INCOMPLETE"


def classify(
    decoded: DataFrame,
    dimension: Dimension,
    staging: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Columns ``CLASSIFIED`` and ``matched`` of the records and errors among decoded messages.

    With a small dimension this is one stage without a shuffle. A large one lies in buckets by user and is
    joined by a shuffle of the transactions alone; they are first written to
    ``staging``, so that counting the hot keys decodes nothing twice and a lost
    executor costs no more than the join. Of a dimension with more users than there are transactions only the
    rows are joined that a bitmap of the transactions' users lets through. Errors have nothing to look up and
    bypass the shuffle.
    """
    relevant = decoded.where(F.col("outcome").isin(ENRICHED_OUTCOME, ERROR))
    if dimension.lookup_bytes <= broadcast_bytes:
        return enrich_decoded(relevant, dimension.lookup, small=True)
    relevant.write.partitionBy("outcome").parquet(staging)
    rows = decoded.sparkSession.read.schema(relevant.schema).parquet(staging)
    good = rows.where(F.col("outcome") == ENRICHED_OUTCOME)
    bad = rows.where(F.col("outcome") == ERROR)
    hot, total = key_profile(good, "user_id")
    lookup, laid_out = dimension.lookup, dimension.laid_out
    if total < dimension.row_count:
        lookup, laid_out = prune_lookup(laid_out or lookup, "user_id", good, "user_id"), None
    found = enrich_decoded(good, laid_out or lookup, small=False, hot=hot, laid_out=laid_out is not None)
    return found.unionByName(bad, allowMissingColumns=True)


def write_enriched(
    decoded: DataFrame,
    dimension: Dimension,
    sink: str,
    batch_id: int,
    broadcast_bytes: int = BROADCAST_BYTES,
    owner: str = STREAM,
) -> dict[str, int]:
    """Enriches one batch into the sink and returns what became of its messages.

    The counts go by the final outcome, add up to what was received, and are what commits the batch:
    a batch that runs again replaces records and counts at once.
    """
    spark = decoded.sparkSession
    staging = fresh_dir(spark, "decoded")
    given, lookups = Observation(), Observation()
    is_enriched = f"outcome = '{ENRICHED_OUTCOME}'"
    observed = decoded.observe(
        given,
        F.count(F.lit(1)).alias("received"),
        *[F.expr(f"count_if(outcome = '{name}')").alias(name.lower()) for name in OUTCOMES],
    )
    try:
        counted = classify(observed, dimension, staging, broadcast_bytes).observe(
            lookups,
            F.expr(f"count_if({is_enriched})").alias("enriched"),
            F.expr(f"count_if({is_enriched} AND NOT matched)").alias("unknown"),
            F.expr("count_if(reason = 'USER_INCOMPLETE')").alias("user_incomplete"),
        )
        attempt = write_batch(counted, sink, owner, batch_id)
    finally:
        delete_path(spark, staging)
    counts = {**given.get, **lookups.get}
    counts["error"] += counts["user_incomplete"]
    commit_batch(spark, sink, owner, attempt, counts)
    return counts


def backfill(
    topic: DataFrame,
    dimension_path: str,
    sink: str,
    broadcast_bytes: int = BROADCAST_BYTES,
    *,
    run: str | None = None,
    batch_rows: int = BATCH_ROWS,
    read_range: Callable[[list[Slice]], DataFrame] | None = None,
) -> dict[str, int]:
    """Enriches a whole topic, range by range, and adds it to the sink; returns the counts of all outcomes.

    The offsets of the topic are divided once per run into batches of about ``batch_rows`` messages. What a
    run has committed is not done again: called once more with the same ``run``, after a failure or at the same time,
    it goes on where the run stands, and every message is added once. Another run adds to the sink. Without
    a name the run is named by the topic's range, so that the same messages are not added twice. ``read_range``
    reads the messages of a batch from a source that does not skip by itself what a filter on offsets leaves out.
    """
    spark = topic.sparkSession
    spans = offset_spans(topic)
    owner = check_owner(f"run-{run}" if run is not None else f"range-{range_name(spans)}")
    plan = _plan_of(spark, sink, owner, plan_ranges(spans, batch_rows))
    dimension = current_dimension(spark, dimension_path)
    done = committed(spark, sink, owner)
    for batch_id, slices in enumerate(plan):
        if batch_id >= done.below and batch_id not in done.attempts:
            messages = read_range(slices) if read_range else topic
            decoded = decode(messages.where(within(slices, others=batch_id == 0)))
            write_enriched(decoded, dimension, sink, batch_id, broadcast_bytes, owner)
    sums = read_counts(spark, sink, owner).agg(*[F.sum(name).alias(name) for name in COUNTED]).first()
    return {name: sums[name] or 0 for name in COUNTED}


def _plan_of(spark: SparkSession, sink: str, owner: str, plan: list[list[Slice]]) -> list[list[Slice]]:
    """The run's ranges by batch: those it began with, or ``plan`` if it begins now."""
    text = json.dumps([[list(part) for part in slices] for slices in plan])
    publish_first(spark, owner_folder(sink, owner), "_plan", text.encode())
    return [[Slice(*part) for part in slices] for slices in json.loads(read_text(spark, f"{owner_folder(sink, owner)}/_plan"))]


def feed_back(
    spark: SparkSession, sink: str, dimension_path: str, broadcast_bytes: int = BROADCAST_BYTES, owner: str = FED_BACK
) -> dict[str, int]:
    """Tries the quarantine again: its bytes are decoded anew, its half-looked-up transactions meet the newest users.

    What becomes a record now is added to the sink in a batch of ``owner``; the rest stays where it is. What was
    fed back before is left out, so a message becomes a record once, however often this runs; passes at the
    same time are attempts at one batch, of which one counts.
    """
    waiting = open_quarantine(spark, sink, owner)
    bytes_kept = waiting.where(F.col("reason") != USER_INCOMPLETE).select(F.lit(None).cast("binary").alias("key"), "value", *PLACE, F.lit(None).cast("timestamp").alias("timestamp"))
    decoded_before = waiting.where(F.col("reason") == USER_INCOMPLETE)
    decoded_before = decoded_before.withColumns({"outcome": F.lit(ENRICHED_OUTCOME), "reason": F.lit("")})
    again = decode(bytes_kept, "fed_back").where(F.col("outcome") == ENRICHED_OUTCOME).unionByName(decoded_before)
    dimension, staging = current_dimension(spark, dimension_path), fresh_dir(spark, "decoded")
    now = committed(spark, sink, owner)
    batch_id = max([now.below - 1, *now.attempts]) + 1
    lookups = Observation()
    try:
        good = classify(again, dimension, staging, broadcast_bytes).where(F.col("outcome") == ENRICHED_OUTCOME)
        counted = good.observe(lookups, F.count(F.lit(1)).alias("enriched"), F.expr("count_if(NOT matched)").alias("unknown"))
        attempt = write_batch(counted, sink, owner, batch_id)
    finally:
        delete_path(spark, staging)
    found = lookups.get
    counts = {name: 0 for name in COUNTED} | {"received": found["enriched"], **found}
    commit_batch(spark, sink, owner, attempt, counts)
    return counts


def open_quarantine(spark: SparkSession, sink: str, owner: str = FED_BACK) -> DataFrame:
    """The quarantine without the messages that have become records since."""
    fed = read_sink(spark, sink).where(F.col("owner") == owner).select(*[F.col(name).alias(f"fed_{name}") for name in PLACE]).distinct()
    same = [F.col(name).eqNullSafe(F.col(f"fed_{name}")) for name in PLACE]
    return read_quarantine(spark, sink).join(fed, same, "left_anti")
