"""The user dimension: versioned loads, each complete before it is seen.

A load writes its rows and, reduced to one row per user, its lookup table into
a folder of its own, and then publishes a file that names it. The file gets its number when it is
published, the next one that is free, so of loads at the same time the one that ends last is current. Readers take the
newest file by its name and open no other, so they never see an empty or
half-written dimension, and the reduction is paid once per load instead of once
per batch.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.extended_json import read_bigint
from millrace.functions.strict_json import (
    document_part,
    is_document,
    json_of,
    parse_guarded,
    string_of,
    use_last_duplicate_key,
)
from millrace.operators.enrich import with_presence
from millrace.operators.lookup import reduce_dimension
from millrace.schemas import USERS
from millrace.session import fresh_dir
from millrace.sinks.files import delete_path, file_names, publish_first, read_text

STORED_USERS = T.StructType([
    *USERS.fields,
    T.StructField("has_name", T.BooleanType()),
    T.StructField("has_city", T.BooleanType()),
    T.StructField("ord", T.LongType()),
])
LOOKUP = T.StructType(STORED_USERS.fields[:-1])
REJECTED = "document string, reason string"

# The seed users.
SEED_USERS = [(1, "Alice", "New York"), (2, "Bob", "London"), (3, "Charlie", "Paris")]

# Users from which a lookup table is laid out in buckets, and about the most in one.
BUCKET_ROWS = 100_000
_MOST_BUCKETS = 1 << 14

# Memory of a looked-up row beside its two texts.
_ROW_BYTES = 64


@dataclass(frozen=True)
class Dimension:
    """One version: all rows as loaded, the lookup table and its measured size; a large one also as a table in buckets by user.

    ``rejected`` are the documents of the load that are no users, with a reason.
    """

    version: int
    location: str
    row_count: int
    rejected_count: int
    rejected: DataFrame
    rows: DataFrame
    lookup: DataFrame
    lookup_bytes: int
    laid_out: DataFrame | None = None


def seed_users(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SEED_USERS, USERS)


def read_documents(documents: DataFrame, column: str) -> DataFrame:
    """Users from JSON documents, with the presence of name and city kept, and a ``reason`` for those that are none.

    Documents that are no JSON objects (``BAD_JSON``, ``NOT_OBJECT``) or whose id is no whole number (``ID``) can match
    no transaction; an absent id counts as null.
    """
    use_last_duplicate_key(documents.sparkSession)
    fields = "struct<user_id: variant, name: variant, city: variant>"
    others = [name for name in documents.columns if name != column]
    return (
        documents.selectExpr("*", f"{parse_guarded(column)} AS guarded")
        .selectExpr(
            "*",
            f"{is_document('guarded')} AS is_document",
            f"{document_part('guarded', as_type=fields)} AS user",
        )
        .selectExpr("*", f"{json_of('user.user_id')} AS id")
        .selectExpr("*", f"{read_bigint('id')} AS user_id")
        .selectExpr(
            *others,
            f"CAST(`{column}` AS STRING) AS document",
            """CASE WHEN NOT coalesce(is_document, false) THEN 'BAD_JSON' WHEN user IS NULL THEN 'NOT_OBJECT'
                WHEN user_id IS NULL AND coalesce(id, 'null') <> 'null' THEN 'ID' END AS reason""",
            "user_id",
            f"coalesce({string_of('user.name')}, nullif({json_of('user.name')}, 'null')) AS name",
            f"coalesce({string_of('user.city')}, nullif({json_of('user.city')}, 'null')) AS city",
            "user.name IS NOT NULL AS has_name",
            "user.city IS NOT NULL AS has_city",
        )
        # Keeps the filter from copying the parse into its condition, as in ``decode``.
        .observe("documents", F.count(F.lit(1)).alias("read"))
    )


def users_from_documents(documents: DataFrame, column: str) -> DataFrame:
    """The users among JSON documents; ``load_documents`` keeps the others, too."""
    return read_documents(documents, column).where("reason IS NULL").drop("reason", "document")


def _versions(spark: SparkSession, path: str) -> list[str]:
    return file_names(spark, f"{path}/versions")


def load_documents(documents: DataFrame, column: str, path: str, keep: int | None = None) -> tuple[int, int]:
    """Replaces the dimension by the users among ``documents``; returns the numbers of users and of rejected documents."""
    staged = fresh_dir(documents.sparkSession, "user-documents")
    try:
        read = read_documents(documents, column)
        read.write.parquet(staged)
        rows = documents.sparkSession.read.schema(read.schema).parquet(staged)
        rejected = rows.where("reason IS NOT NULL").select("document", "reason")
        loaded = refresh_dimension(rows.where("reason IS NULL").drop("reason", "document"), path, keep, rejected)
        return loaded, current_dimension(documents.sparkSession, path).rejected_count
    finally:
        delete_path(documents.sparkSession, staged)


def refresh_dimension(
    users: DataFrame, path: str, keep: int | None = None, rejected: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS
) -> int:
    """Replaces the dimension at ``path`` and returns the number of rows loaded.

    ``ord`` gives the load order, which decides between rows of one user; when
    the column is missing the order of the rows in ``users`` counts. With ``keep`` only so many
    of the newest versions are left: as many as are loaded while the longest batch runs, and one more. From
    ``bucket_rows`` on the lookup table is laid out in buckets of some such rows, so that joins need not shuffle it.
    """
    spark = users.sparkSession
    folder = f"v0-{uuid.uuid4().hex}"
    location = f"{path}/{folder}"

    if "ord" not in users.columns:
        users = users.withColumn("ord", F.monotonically_increasing_id())
    loaded = Observation("loaded")
    (
        with_presence(users)
        .select(*[F.col(field.name).cast(field.dataType) for field in STORED_USERS.fields])
        .observe(loaded, F.count(F.lit(1)).alias("row_count"))
        .write.parquet(f"{location}/rows")
    )
    measured = Observation("measured")
    row_bytes = (
        F.coalesce(F.octet_length("name"), F.lit(0))
        + F.coalesce(F.octet_length("city"), F.lit(0))
        + F.lit(_ROW_BYTES)
    )
    row_count = loaded.get["row_count"]
    reduced = reduce_dimension(spark.read.schema(STORED_USERS).parquet(f"{location}/rows"), "user_id", "ord")
    reduced = reduced.observe(measured, F.coalesce(F.sum(row_bytes), F.lit(0)).alias("bytes"))
    buckets = min(_MOST_BUCKETS, 1 << (row_count // bucket_rows).bit_length()) if row_count > bucket_rows else 0
    if buckets:
        laid_out = reduced.repartition(buckets, "user_id").write.bucketBy(buckets, "user_id").sortBy("user_id")
        laid_out.option("path", f"{location}/lookup").saveAsTable(_table(folder))
    else:
        reduced.write.parquet(f"{location}/lookup")
    turned_down = Observation("rejected")
    if rejected is None:
        rejected = spark.createDataFrame([], REJECTED)
    rejected.observe(turned_down, F.count(F.lit(1)).alias("n")).write.parquet(f"{location}/rejected")
    about = {"folder": folder, "buckets": buckets, "row_count": row_count, "lookup_bytes": measured.get["bytes"], "rejected_count": turned_down.get["n"]}
    own = _publish_next(spark, path, json.dumps(about))
    # later loads are newer, whatever they leave of this one is theirs to say
    for old in [name for name in _versions(spark, path) if name <= own][:-keep] if keep else []:
        held = json.loads(read_text(spark, f"{path}/versions/{old}"))["folder"]
        delete_path(spark, f"{path}/versions/{old}")
        delete_path(spark, f"{path}/{held}")
        spark.sql(f"DROP TABLE IF EXISTS {_table(held)}")
    return row_count


def _table(folder: str) -> str:
    """The session's name for a lookup table in buckets; its files lie with the version."""
    return f"lookup_{folder.split('-')[1]}"


def _laid_out(spark: SparkSession, location: str, folder: str, buckets: int) -> DataFrame:
    """The lookup table by its buckets, made known to the session where another one loaded it."""
    columns = ", ".join(f"{field.name} {field.dataType.simpleString()}" for field in LOOKUP.fields)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table(folder)} ({columns}) USING parquet"
        f" CLUSTERED BY (user_id) SORTED BY (user_id) INTO {buckets} BUCKETS LOCATION '{location}/lookup'"
    )
    return spark.table(_table(folder))


def _publish_next(spark: SparkSession, path: str, text: str) -> str:
    """Publishes under the next free number, again if another load takes it first."""
    while True:
        names = _versions(spark, path)
        name = f"{int(names[-1]) + 1 if names else 1:08d}"
        if publish_first(spark, f"{path}/versions", name, text.encode()):
            return name


def current_dimension(spark: SparkSession, path: str) -> Dimension:
    """The newest complete version; everything read from it stays at that version."""
    names = _versions(spark, path)
    if not names:
        raise ValueError(f"no dimension was loaded at {path}")
    about = json.loads(read_text(spark, f"{path}/versions/{names[-1]}"))
    location = f"{path}/{about['folder']}"
    return Dimension(
        int(names[-1]),
        location,
        about["row_count"],
        about["rejected_count"],
        spark.read.schema(REJECTED).parquet(f"{location}/rejected"),
        spark.read.schema(STORED_USERS).parquet(f"{location}/rows"),
        spark.read.schema(LOOKUP).parquet(f"{location}/lookup"),
        about["lookup_bytes"],
        _laid_out(spark, location, about["folder"], about["buckets"]) if about["buckets"] else None,
    )
