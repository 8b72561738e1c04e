"""The outcome of one message in plain Python, to hold against the DataFrame."""

from __future__ import annotations

import datetime as dt
import json
import re

MISSING = object()
UTC = dt.timezone.utc


def _no_constant(text):
    raise ValueError(text)


def _parse(text: str):
    return json.loads(text, parse_constant=_no_constant)


def _unwrap(value, wrappers):
    if isinstance(value, dict) and len(value) == 1:
        (key, text), = value.items()
        if key in wrappers and isinstance(text, str):
            return text
    return None


NUMBERS = ("$numberInt", "$numberLong", "$numberDouble", "$numberDecimal")


def whole(value):
    """The 64-bit whole number a value stands for, or None."""
    text = _unwrap(value, NUMBERS)
    if text is not None:
        match = re.fullmatch(r"([+-]?\d+)(\.0*)?", text, re.ASCII)
        value = int(match[1]) if match else None
    if isinstance(value, float) and value.is_integer():
        value = int(value)
    if isinstance(value, bool) or not isinstance(value, int):
        return None
    return value if -(2**63) <= value < 2**63 else None


def real(value):
    text = _unwrap(value, NUMBERS)
    if text is not None:
        match = re.fullmatch(r"[+-]?(\d+\.?\d*([eE][+-]?\d+)?|Infinity|NaN)", text, re.ASCII)
        return float(text) if match else None
    return None if isinstance(value, bool) or not isinstance(value, (int, float)) else float(value)


def instant(value):
    """Microseconds since 1970, or None."""
    if isinstance(value, str):
        pattern = r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{1,9})?(Z|[+-]\d\d:?\d\d)"
        if not re.fullmatch(pattern, value, re.ASCII):
            return None
        try:
            moment = dt.datetime.fromisoformat(value)
        except ValueError:
            return None
        return (moment - dt.datetime(1970, 1, 1, tzinfo=UTC)) // dt.timedelta(microseconds=1)
    millis = whole(value)
    return millis * 1000 if millis is not None and abs(millis) <= 9223372036854775 else None


def judge(value: bytes | None, users: dict):
    """(outcome, reason, record or None); ``users`` maps ids to documents."""
    if value is None:
        return "SKIPPED", "TOMBSTONE", None
    try:
        text = value.decode("utf-8")
    except UnicodeDecodeError:
        return "ERROR", "BAD_UTF8", None
    try:
        envelope = _parse(text)
    except ValueError:
        return "ERROR", "BAD_JSON", None
    if not envelope:
        return "SKIPPED", "EMPTY_ENVELOPE", None
    if not isinstance(envelope, dict):
        return "ERROR", "ENVELOPE_NOT_OBJECT", None
    if envelope.get("op") != "c":
        return "SKIPPED", "OP", None
    if not isinstance(envelope.get("after"), str):
        return "ERROR", "AFTER_NOT_STRING", None
    try:
        document = _parse(envelope["after"])
    except ValueError:
        return "ERROR", "AFTER_BAD_JSON", None
    if not document:
        return "EMPTY", "", None
    if not isinstance(document, dict):
        return "ERROR", "AFTER_NOT_OBJECT", None
    return _judge_document(document, users)


def _judge_document(document: dict, users: dict):
    if not isinstance(document.get("_id"), dict):
        return "ERROR", "ID", None
    oid = document["_id"].get("$oid")
    if oid is None:
        return "ERROR", "ID_NO_OID", None
    if not isinstance(document.get("timestamp"), dict):
        return "ERROR", "TIMESTAMP", None
    date = document["timestamp"].get("$date")
    given = [document.get("user_id"), document.get("amount"), date]
    read = [whole(given[0]), real(given[1]), instant(date)]
    small_id = isinstance(oid, str) or (type(oid) is int and -(2**63) <= oid < 2**63)
    if not small_id or any(a is not None and b is None for a, b in zip(given, read)):
        return "ERROR", "TYPE", None
    user = users.get(read[0]) or {"name": "Unknown", "city": "Unknown"}
    if len(user) < 2:
        return "ERROR", "USER_INCOMPLETE", None
    return "ENRICHED", "", (str(oid), *read, user["name"], user["city"])
