"""Transactions to change envelopes, for backfills and fixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def document_text() -> Column:
    """The document image as JSON text; null fields are left out.

    Amounts that JSON has no number for are wrapped, as extended JSON has it.
    """

    def document(amount: Column) -> Column:
        return F.to_json(
            F.struct(
                F.struct(F.col("transaction_id").alias("$oid")).alias("_id"),
                "user_id",
                amount.alias("amount"),
                F.struct(F.unix_millis("timestamp").alias("$date")).alias("timestamp"),
            )
        )

    amount = F.col("amount")
    endless = F.isnan(amount) | (F.abs(amount) == float("inf"))
    wrapped = F.struct(amount.cast("string").alias("$numberDouble"))
    return F.when(endless, document(wrapped)).otherwise(document(amount))


def encode_envelope(rows: DataFrame, op: str = "op") -> DataFrame:
    """Adds ``value``: the envelope, without a schema block, of columns ``TXN`` and ``op``.

    Extended JSON dates hold milliseconds, so anything finer is cut off.
    """
    envelope = F.to_json(F.struct(F.col(op).alias("op"), document_text().alias("after")))
    return rows.withColumn("value", envelope.cast("binary"))
