"""What one does to look at the tables by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL_ZONE = "Asia/Ho_Chi_Minh"


def first_rows(table: DataFrame, key: str, count: int = 5) -> DataFrame:
    """The first rows by ``key``; Spark keeps only ``count`` rows per task."""
    return table.orderBy(key).limit(count)


def local_time(instant: Column, zone: str = LOCAL_ZONE) -> Column:
    """Wall-clock time of an instant in ``zone``; storage stays UTC."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc_time(instant))


def utc_time(instant: Column) -> Column:
    """Wall-clock time of an instant in UTC, whatever the session's zone is."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(instant), epoch)


def round_amount(amount: Column) -> Column:
    """``amount`` to two decimals by its exact binary value, as scripting languages round.

    ``round`` would go by the shortest decimal text instead and turn 1.005,
    which is a little less than that, into 1.01. The product by 100 is split
    into its rounded value and the exact rest (the high half of ``amount`` has
    so few bits that its product is exact); the rest decides when the rounded
    value lies halfway. From 2**46 on the spacing of doubles exceeds 0.01.
    """
    high = amount * 134217729.0 - (amount * 134217729.0 - amount)
    product = amount * 100.0
    rest = (high * 100.0 - product) + (amount - high) * 100.0
    down = F.floor(product).cast("double")
    cents = (
        F.when((product - down != 0.5) | (rest == 0.0), F.rint(product))
        .when(rest > 0.0, down + 1.0)
        .otherwise(down)
    )
    return F.when(F.abs(amount) < 70368744177664.0, cents / 100.0).otherwise(amount)
