"""Strict JSON documents as VARIANT, as SQL expressions.

Spark's JSON readers stop after the first value and ignore whatever follows it.
To reject such text the document is parsed as the first element of an array
whose second element is a guard object that no message can know: the text is
one JSON value exactly when the guard comes second.
"""

from __future__ import annotations

import secrets

from pyspark.sql import SparkSession

_GUARD = "g" + secrets.token_hex(16)

# Null, false, 0, "", [] and {}, which count as "nothing there".
_FALSY = r'^(?:null|false|0|-?0\.0|""|\[\]|\{\})$'


def use_last_duplicate_key(spark: SparkSession) -> None:
    """Let the last of several equal keys of an object win.

    The setting is read when an expression is built, so every public function
    that parses JSON calls this first.
    """
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def parse_guarded(text: str) -> str:
    """VARIANT array ``[document, guard]``, or null for text that is no JSON."""
    return f"""try_parse_json(concat('[', {text}, ',{{"{_GUARD}":0}}]'))"""


# What Spark's JSON parser takes at most. Characters of a string, of a number, of a key; levels.
STRING_LIMIT, NUMBER_LIMIT, KEY_LIMIT, DEPTH_LIMIT = 20_000_000, 1_000, 50_000, 1_000
_DEPTH_SUSPECT = DEPTH_LIMIT - 5  # openings of a text; the guard and the parser's own count are levels, too


def may_exceed_limits(text: str) -> str:
    """Whether text that did not parse may be JSON beyond the parser's limits, rather than no JSON."""
    # a string beyond its limit is also longer than a key may be
    return f"""({text} RLIKE '[0-9]{{{NUMBER_LIMIT + 1}}}|"[^"]{{{KEY_LIMIT + 1}}}'
        OR length({text}) - length(translate({text}, '[{{', '')) > {_DEPTH_SUSPECT})"""


def is_document(guarded: str) -> str:
    """True when ``parse_guarded`` met one JSON value and nothing after it."""
    return f"(try_variant_get({guarded}, '$[1].{_GUARD}', 'variant') IS NOT NULL)"


def document_part(guarded: str, path: str = "", as_type: str = "variant") -> str:
    """The document, or what lies at ``path`` in it; null when absent."""
    return f"try_variant_get({guarded}, '$[0]{path}', '{as_type}')"


def string_of(value: str) -> str:
    """The content of a JSON string; null for any other value."""
    return f"CAST(try_variant_get({value}, '$', 'binary') AS STRING)"


def json_of(value: str) -> str:
    """JSON text of a value, which shows its type; null for a missing value.

    ``schema_of_variant`` would show the type, too, but on values nested some
    hundred levels deep it overflows the stack and takes the executor with it.
    """
    return f"to_json({value})"


def is_object(json: str) -> str:
    return f"startswith({json}, '{{')"


def is_falsy(json: str) -> str:
    return f"{json} RLIKE r'{_FALSY}'"
