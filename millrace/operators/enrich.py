"""Decoded messages joined to users: the records for the sink and the quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.decode import decode
from millrace.operators.lookup import lookup_left, reduce_dimension
from millrace.schemas import CLASSIFIED, ENRICHED, ENRICHED_OUTCOME, ERROR, QUARANTINE, UNKNOWN

_PLACE = ["topic", "partition", "offset"]


def with_presence(users: DataFrame) -> DataFrame:
    """Adds the flags that tell a missing name or city from a null one; tables miss none."""
    for flag in ("has_name", "has_city"):
        if flag not in users.columns:
            users = users.withColumn(flag, F.lit(True))
    return users


def enrich_decoded(
    decoded: DataFrame,
    lookup: DataFrame,
    *,
    small: bool,
    hot: list[tuple[object, int]] | None = None,
    laid_out: bool = False,
) -> DataFrame:
    """Columns ``CLASSIFIED`` and ``matched`` of every decoded message; ``lookup`` has one row per user.

    ``small`` says that the size of ``lookup`` was checked, as ``Dimension`` records it, ``laid_out`` that it lies in buckets by user.
    A user with neither name nor city counts as not found; one with only one of
    them makes the record an error. Null names and cities stay null.
    """
    joined = lookup_left(
        decoded,
        with_presence(lookup),
        "user_id",
        "user_id",
        small=small,
        only=F.col("outcome") == ENRICHED_OUTCOME,
        spread=_PLACE,
        hot=hot,
        laid_out=laid_out,
    )
    judged = joined.selectExpr(
        "*",
        "coalesce(found AND has_name <> has_city, false) AS incomplete",
        "coalesce(found AND has_name AND has_city, false) AS matched",
    )
    field = f"CASE WHEN outcome = '{ENRICHED_OUTCOME}' AND NOT incomplete THEN"
    columns = {
        "outcome": f"CASE WHEN incomplete THEN '{ERROR}' ELSE outcome END",
        "reason": "CASE WHEN incomplete THEN 'USER_INCOMPLETE' ELSE reason END",
        "user_name": f"{field} CASE WHEN matched THEN name ELSE '{UNKNOWN}' END END",
        "user_city": f"{field} CASE WHEN matched THEN city ELSE '{UNKNOWN}' END END",
    }
    return judged.selectExpr(
        *[f"{columns.get(name, f'`{name}`')} AS `{name}`" for name in CLASSIFIED.names], "matched"
    )


def enrich(
    topic: DataFrame,
    users: DataFrame,
    *,
    order: str,
    small: bool,
    hot: list[tuple[object, int]] | None = None,
) -> DataFrame:
    """Columns ``CLASSIFIED`` of every message of a topic, against users as loaded.

    Of several users under one id the first by ``order`` counts.
    """
    lookup = reduce_dimension(with_presence(users), "user_id", order)
    return enrich_decoded(decode(topic), lookup, small=small, hot=hot).drop("matched")


def enriched(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == ENRICHED_OUTCOME).select(*ENRICHED.names)


def quarantined(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("outcome") == ERROR).select(*QUARANTINE.names)
