"""What several operators share: columns, words, size checks, written tables."""

from __future__ import annotations

import io
import os
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.session import fresh_dir
from millrace.sinks.files import delete_path, publish_bytes

# Words are runs of characters other than these (space, tab to carriage return).
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def share_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from the path the driver has it at, if it is there."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to Python workers, once an application, through the shared folder: theirs need not have it."""
    application = spark.sparkContext.applicationId
    if application in _SHIPPED:
        return
    root, packed = Path(__file__).resolve().parents[2], io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for file in sorted((root / "millrace").rglob("*.py")):
            archive.write(file, file.relative_to(root))
    folder = fresh_dir(spark, "package")
    publish_bytes(spark, folder, "millrace.zip", packed.getvalue())
    spark.sparkContext.addPyFile(f"{folder}/millrace.zip")
    _SHIPPED.add(application)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def written(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` from files in the shared folder: read often, computed once, safe from lost executors."""
    spark = frame.sparkSession
    path = fresh_dir(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go when it ends, not when the driver next collects its garbage."""
    before = spark.conf.get(DROP_SHUFFLES, None)
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.unset(DROP_SHUFFLES) if before is None else spark.conf.set(DROP_SHUFFLES, before)


class Scratch:
    """Tables that are written by name; the one before goes once the next of its name is there, as nothing lazy reads it then."""

    def __init__(self) -> None:
        self.paths: dict[str, str] = {}

    def write(self, frame: DataFrame, name: str) -> DataFrame:
        spark = frame.sparkSession
        path = fresh_dir(spark, name)
        with shuffles_dropped(spark):
            frame.write.parquet(path)
        before, self.paths[name] = self.paths.get(name), path
        if before:
            delete_path(spark, before)
        return spark.read.schema(frame.schema).parquet(path)

    def clear(self) -> None:
        spark = SparkSession.active()
        for path in self.paths.values():
            delete_path(spark, path)
        self.paths = {}


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+"), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"{WORD_CLASS}+")), F.lit(0)).cast("long")


def fold(seed: int, *columns: Column) -> Column:
    """A seeded 64-bit hash that is the same in every run."""
    return F.xxhash64(F.lit(seed), *columns)


def broadcast_if_small(frame: DataFrame, rows: int) -> DataFrame:
    """``frame`` marked for broadcast if it was counted to hold at most ``rows`` rows."""
    return F.broadcast(frame) if frame.limit(rows + 1).count() <= rows else frame


def join_unique(rows: DataFrame, table: DataFrame, on: list[str], weight: str, broadcast_rows: int, heaviest: int = 100_000) -> DataFrame:
    """``rows`` with the columns of ``table``, which has one row for each key that they hold.

    Where the table has more than ``broadcast_rows`` rows, the keys of the largest ``weight`` are broadcast, as many as
    ``heaviest`` says, and their rows dealt evenly; no other key has more than one row in so many, so the rest is joined by a shuffle.
    """
    if table.count() <= broadcast_rows:
        return rows.join(F.broadcast(table), on).drop(weight)
    row = F.struct(*(c for c in table.columns if c not in on))
    heavy = written(table.orderBy(F.desc(weight), *on).limit(min(heaviest, broadcast_rows)), "heavy-keys").select(*on, row.alias("heavy_row"))
    # heavy rows get numbers that no row of the table has: they only pass through the join
    number = F.when(F.col("heavy_row").isNull(), -1).otherwise(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20))).alias("dealt")
    dealt = rows.join(F.broadcast(heavy), on, "left").select(*rows.columns, "heavy_row", number)
    light = table.select(*on, row.alias("light_row"), F.lit(-1).cast("long").alias("dealt")).hint("shuffle_hash")  # one row a key: no part of it is large
    found = dealt.join(light, [*on, "dealt"], "left").withColumn("row_found", F.coalesce("heavy_row", "light_row"))
    return found.where("row_found IS NOT NULL").select(*rows.columns, "row_found.*").drop(weight)


def parallelism(spark: SparkSession) -> int:
    """Parts into which a key is split that may hold a large share of the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def fold_number(doc_id: Column, folds: int = 5) -> Column:
    """The fold of a document, by the crc32 of its id as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds
