"""Typed values out of the JSON text of extended JSON, as SQL expressions.

Each reader takes the canonical text of a value, as Spark writes it, and returns
null both for an absent value and for one outside its type. The usual form of
a value is tried first, other forms go by pattern.
"""

from __future__ import annotations

from millrace.functions.strict_json import json_of, string_of

# Numbers, plain or in one of the wrappers of extended JSON.
_WRAPPER = r'\{"\$number(?:Int|Long|Double|Decimal)":"'
_WHOLE = rf'^(?:{_WRAPPER})?([+-]?\d+)(?:\.0*)?(?:"\}})?$'
_LARGE = r"^-?\d\.\d+E\d+$"
_NUMBER = rf'^{_WRAPPER}([+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|Infinity|NaN))"\}}$'
_INSTANT = r'^"(\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,9})?(?:Z|[+-]\d\d:?\d\d))"$'

# The last whole millisecond that fits Spark's microsecond timestamps.
_LAST_MILLISECOND = 9223372036854775


def _match(json: str, pattern: str, as_type: str) -> str:
    return f"try_cast(regexp_extract({json}, r'{pattern}', 1) AS {as_type})"


def read_bigint(json: str) -> str:
    """A whole number in any numeric form; text, fractions and overflows give null."""
    double = f"try_cast({json} AS DOUBLE)"
    return f"""coalesce(
        try_cast({json} AS BIGINT),
        {_match(json, _WHOLE, "BIGINT")},
        CASE WHEN {json} RLIKE r'{_LARGE}' AND rint({double}) = {double} THEN try_cast({double} AS BIGINT) END
    )"""


def read_milliseconds(json: str) -> str:
    """Milliseconds since 1970 as a whole number in any numeric form."""
    return read_bigint(json)


def read_double(json: str) -> str:
    """A number in any form; text gives null."""
    return f"coalesce(try_cast({json} AS DOUBLE), {_match(json, _NUMBER, 'DOUBLE')})"


def read_instant(json: str, milliseconds: str) -> str:
    """The content of ``$date``: whole milliseconds, already read, or ISO text with a zone."""
    return f"""CASE
        WHEN {milliseconds} BETWEEN -{_LAST_MILLISECOND} AND {_LAST_MILLISECOND}
            THEN timestamp_millis({milliseconds})
        ELSE {_match(json, _INSTANT, "TIMESTAMP")}
    END"""


def read_id(value: str) -> str:
    """The text form of ``$oid``, a VARIANT given as text or as a 64-bit whole number.

    The type of a VARIANT is only asked for once its text shows it is a number.
    """
    json = json_of(value)
    is_whole = f"{json} RLIKE r'^-?\\d+$' AND schema_of_variant({value}) = 'BIGINT'"
    return f"coalesce({string_of(value)}, CASE WHEN {is_whole} THEN {json} END)"
