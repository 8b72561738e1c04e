"""Change messages to typed transactions, each with exactly one outcome.

A chain of projections, each building on the columns of the one before it:
parse the envelope, pick its two fields, parse the document inside, pick its
fields, read them as types, give the verdict. No message can fail the job;
whatever is wrong with it ends up in ``reason``.

Two limits shape the code. The generated method of the whole chain must stay
under 8,000 bytes, or the JVM interprets it (a third of the speed). And no
filter may be pushed into the chain, as it would copy both JSON parses into
its condition; the metrics collected at the end of the chain keep filters out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from millrace.functions.extended_json import (
    read_bigint,
    read_double,
    read_id,
    read_instant,
    read_milliseconds,
)
from millrace.functions.strict_json import (
    document_part,
    is_document,
    is_falsy,
    is_object,
    json_of,
    may_exceed_limits,
    parse_guarded,
    string_of,
    use_last_duplicate_key,
)
from millrace.schemas import EMPTY, ENRICHED_OUTCOME, ERROR, OUTCOMES, SKIP_REASONS, SKIPPED, TXN

_FIELDS = (
    "struct<_id: struct<`$oid`: variant>, user_id: variant, amount: variant,"
    " timestamp: struct<`$date`: variant>>"
)

# Why a message is no transaction, in the order of the tests; null when it is one.
_REASON = f"""CASE
    WHEN NOT is_create THEN CASE
        WHEN value IS NULL THEN 'TOMBSTONE'
        WHEN NOT is_utf8 THEN 'BAD_UTF8'
        WHEN NOT is_envelope THEN 'BAD_JSON'
        WHEN op IS NOT NULL THEN 'OP'
        WHEN is_falsy THEN 'EMPTY_ENVELOPE'
        WHEN is_object THEN 'OP'
        ELSE 'ENVELOPE_NOT_OBJECT'
    END
    WHEN after IS NULL THEN 'AFTER_NOT_STRING'
    WHEN NOT {is_document("document")} THEN 'AFTER_BAD_JSON'
    WHEN fields._id IS NULL THEN CASE
        WHEN is_falsy THEN '{EMPTY}'
        WHEN is_object THEN 'ID'
        ELSE 'AFTER_NOT_OBJECT'
    END
    WHEN oid IS NULL OR is_variant_null(oid) THEN 'ID_NO_OID'
    WHEN fields.timestamp IS NULL THEN 'TIMESTAMP'
    WHEN transaction_id IS NULL
        OR (user_id IS NULL AND user <> 'null')
        OR (amount IS NULL AND money <> 'null')
        OR (timestamp IS NULL AND date <> 'null') THEN 'TYPE'
END"""

# Text that does not parse is only looked at again to tell what is no JSON from what may be too much of it.
_LIMITED = f"""CASE
    WHEN endswith(verdict, 'BAD_JSON') AND {may_exceed_limits("coalesce(after, CAST(value AS STRING))")}
        THEN replace(verdict, 'BAD_JSON', 'LIMIT')
    ELSE verdict
END"""

_OUTCOME = f"""CASE
    WHEN verdict = '' THEN '{ENRICHED_OUTCOME}'
    WHEN verdict IN {SKIP_REASONS} THEN '{SKIPPED}'
    WHEN verdict = '{EMPTY}' THEN '{EMPTY}'
    ELSE '{ERROR}'
END"""


def decode(topic: DataFrame, metrics: str | Observation = "decoded") -> DataFrame:
    """Columns ``topic, partition, offset, value, outcome, reason`` and the transaction.

    The transaction's fields hold what could be read; they are complete when the
    outcome is ENRICHED. ``value`` is kept for errors only. ``reason`` is empty
    for ENRICHED and EMPTY. ``metrics`` counts the messages by outcome: under
    that name in a stream's progress, or in an ``Observation``.
    """
    use_last_duplicate_key(topic.sparkSession)
    place = ("topic", "partition", "offset", "value")
    text = "CAST(value AS STRING)"
    return (
        topic.selectExpr(*place, f"is_valid_utf8({text}) AS is_utf8")
        .selectExpr("*", f"CASE WHEN is_utf8 THEN {parse_guarded(text)} END AS envelope")
        .selectExpr(
            "*",
            f"{is_document('envelope')} AS is_envelope",
            f"{document_part('envelope', '.op')} AS op",
            f"{document_part('envelope', '.after')} AS after_value",
        )
        .selectExpr("*", f"is_envelope AND {string_of('op')} <=> 'c' AS is_create")
        .selectExpr("*", f"CASE WHEN is_create THEN {string_of('after_value')} END AS after")
        .selectExpr("*", f"{parse_guarded('after')} AS document")
        .selectExpr("*", f"{document_part('document', as_type=_FIELDS)} AS fields")
        .selectExpr(
            "*",
            # Only what is neither a usable envelope nor a usable document is looked at as a whole.
            f"""{json_of(f"""CASE
                WHEN NOT is_create THEN CASE WHEN op IS NULL THEN {document_part('envelope')} END
                WHEN fields._id IS NULL THEN {document_part('document')}
            END""")} AS odd""",
            "fields._id.`$oid` AS oid",
            f"{json_of('fields.user_id')} AS user",
            f"{json_of('fields.amount')} AS money",
            f"{json_of('fields.timestamp.`$date`')} AS date",
        )
        .selectExpr("*", f"{read_milliseconds('date')} AS milliseconds")
        .selectExpr(
            "*",
            f"{is_falsy('odd')} AS is_falsy",
            f"{is_object('odd')} AS is_object",
            f"{read_id('oid')} AS transaction_id",
            f"{read_bigint('user')} AS user_id",
            f"{read_double('money')} AS amount",
            f"{read_instant('date', 'milliseconds')} AS timestamp",
        )
        .selectExpr(*place, "after", f"coalesce({_REASON}, '') AS verdict", *TXN.names)
        .selectExpr(*place, f"{_LIMITED} AS verdict", *TXN.names)
        .selectExpr("*", f"{_OUTCOME} AS outcome")
        .selectExpr(
            "topic",
            "partition",
            "offset",
            f"CASE WHEN outcome = '{ERROR}' THEN value END AS value",
            "outcome",
            f"CASE WHEN outcome = '{EMPTY}' THEN '' ELSE verdict END AS reason",
            *TXN.names,
        )
        .observe(
            metrics,
            F.count(F.lit(1)).alias("received"),
            *[F.expr(f"count_if(outcome = '{name}')").alias(name.lower()) for name in OUTCOMES],
        )
    )


def transactions(decoded: DataFrame) -> DataFrame:
    """The decoded transactions alone."""
    return decoded.where(F.col("outcome") == ENRICHED_OUTCOME).select(*TXN.names)
