"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the folder of tables, ``BENCH_CPUS`` the local cores.
Every query runs once to warm up and then ``BENCH_RUNS`` times; the median
counts. What the queries of the first group read (the change topic, the loaded
dimension) is written beforehand, as a topic and a dimension would be there.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.decode import decode, transactions
from millrace.operators.enrich import enriched
from millrace.plans import fixtures
from millrace.plans.jobs import backfill, classify
from millrace.plans.queries import QUERIES
from millrace.session import fresh_dir

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "5"))

WHOLE_QUERIES = (
    "q03_lookup_default",
    "q04_outcome_counts",
    "q06_null_key_lookup",
    "q07_lookup_first_match",
    "q08_dimension_refresh",
    "q11_encode_envelope",
    "q15_round_amount",
    "q16_lookup_skewed",
    "s01_enrich_stream",
)


def consume(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def median(run) -> float:
    run()
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    messages = fixtures.topic(spark, SF_DIR).count()
    users_path, dimension = fixtures.users_dimension(spark, SF_DIR)

    def topic() -> DataFrame:
        return fixtures.topic(spark, SF_DIR)

    timed = {
        "q01_enrich": lambda: consume(
            enriched(classify(decode(topic()), dimension, fresh_dir(spark, "decoded")))
        ),
        "q02_decode": lambda: consume(transactions(decode(topic()))),
        "backfill": lambda: backfill(topic(), users_path, fresh_dir(spark, "sink")),
        "backfill_shuffled": lambda: backfill(
            topic(), users_path, fresh_dir(spark, "sink"), broadcast_bytes=0
        ),
        **{
            name: lambda name=name: consume(QUERIES[name](spark, SF_DIR)) for name in WHOLE_QUERIES
        },
    }
    seconds = {name: median(run) for name, run in timed.items()}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "messages": messages,
                "q01_messages_per_second": round(messages / seconds["q01_enrich"]),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
