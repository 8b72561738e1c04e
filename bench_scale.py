"""

Prints one JSON line per measurement. ``BENCH_SF_DIR`` names the folder of
tables, ``BENCH_REPEAT`` the number of copies of each event (100).
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.decode import decode
from millrace.operators.encode import encode_envelope
from millrace.plans import fixtures
from millrace.plans.jobs import backfill
from millrace.session import fresh_dir
from millrace.sources.dimension import current_dimension, refresh_dimension
from millrace.sources.topic import topic_stream
from millrace.streaming.stream import run_stream

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
REPEAT = int(os.environ.get("BENCH_REPEAT", "100"))
CPUS = os.environ.get("BENCH_CPUS", "8")

LOOSE = (
    "struct<op: string, after: string>",
    "struct<_id: struct<`$oid`: string>, user_id: bigint, amount: double, timestamp: struct<`$date`: bigint>>",
)


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def loose_decode(topic: DataFrame) -> DataFrame:
    """What the built-in JSON reader gives, blind to most of the outcomes."""
    return (
        topic.select(F.from_json(F.col("value").cast("string"), LOOSE[0]).alias("e"))
        .where("e.op = 'c'")
        .select(F.from_json("e.after", LOOSE[1]).alias("a"))
    )


def report(name: str, run, messages: int) -> None:
    best = None
    for _ in range(2):
        start = time.perf_counter()
        run()
        seconds = time.perf_counter() - start
        best = seconds if best is None else min(best, seconds)
    print(json.dumps({"run": name, "sec": round(best, 2), "per_sec": round(messages / best)}), flush=True)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", "32")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    topic_path = fresh_dir(spark, "topic")
    copies = (
        fixtures.events_as_transactions(spark, SF_DIR)
        .repartition(32, "event_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(REPEAT))))
    )
    fixtures.as_topic(encode_envelope(copies)).write.option("compression", "zstd").parquet(topic_path)
    topic = spark.read.parquet(topic_path)
    messages = topic.count()

    small, _ = fixtures.users_dimension(spark, SF_DIR)
    large = fresh_dir(spark, "users")
    users = fixtures.users(spark, SF_DIR)
    more = users.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(99)))).select(
        (F.col("user_id") + F.col("copy") * 10_000_000).alias("user_id"), "name", "city"
    )
    refresh_dimension(more, large)
    print(json.dumps({"run": "large dimension", "bytes": current_dimension(spark, large).lookup_bytes}), flush=True)

    report("decode", lambda: consume(decode(topic)), messages)
    report("from_json only", lambda: consume(loose_decode(topic)), messages)
    for name, path in (("12,857 users", small), ("1.3 M users", large)):
        for way, limit in (("broadcast", 1 << 40), ("shuffled", 0)):
            report(
                f"backfill, {name}, {way}",
                lambda path=path, limit=limit: backfill(topic, path, fresh_dir(spark, "sink"), limit),
                messages,
            )
    for name, path in (("12,857 users", small), ("1.3 M users", large)):
        for files in ("4", "16"):

            def stream(path=path, files=files):
                source = topic_stream(spark, "parquet", path=topic_path, maxFilesPerTrigger=files)
                sink, checkpoint = fresh_dir(spark, "sink"), fresh_dir(spark, "checkpoint")
                query = run_stream(source, path, sink, checkpoint, trigger={"availableNow": True})
                query.awaitTermination()

            report(f"stream, {files} of 32 files per batch, {name}", stream, messages)
    spark.stop()


if __name__ == "__main__":
    main()
