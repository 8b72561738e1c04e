"""Literal messages, and random ones against the plain restatement."""

import json
import math

import pytest
from hypothesis import HealthCheck, Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.operators.decode import decode, transactions
from millrace.operators.encode import encode_envelope
from millrace.operators.enrich import enrich, enrich_decoded
from millrace.operators.lookup import hot_keys
from millrace.schemas import TOPIC, TXN
from millrace.sources.dimension import current_dimension, refresh_dimension, users_from_documents
from tests.ladder import judge

USERS = {
    1: {"name": "Alice", "city": "New York"},
    2: {"name": "Bob", "city": "London"},
    3: {"name": "Charlie", "city": "Paris"},
    4: {},
    5: {"name": "Eve"},
    6: {"name": None, "city": "Rome"},
    None: {"name": "Anon", "city": "Nowhere"},
}
MILLIS = 1700000000123
GOOD = {"_id": {"$oid": "64a0000000000000000000a1"}, "user_id": 1, "amount": 10.5, "timestamp": {"$date": MILLIS}}


def message(after, op='"c"'):
    return f'{{"op":{op},"after":{after}}}'


def image(document):
    """An envelope around a document given as text."""
    return message(json.dumps(document))


def good(without=(), **changed):
    document = {**GOOD, **{key.lstrip("0"): value for key, value in changed.items()}}
    return image(json.dumps({key: value for key, value in document.items() if key not in without}))


G = json.dumps(json.dumps(GOOD))
ALICE = (GOOD["_id"]["$oid"], 1, 10.5, MILLIS * 1000, "Alice", "New York")


def alice(**changed):
    fields = dict(zip(("id", "user", "amount", "time", "name", "city"), ALICE))
    return "ENRICHED", "", tuple({**fields, **changed}.values())


ENRICHED = alice()
UNKNOWN = {"name": "Unknown", "city": "Unknown"}


def error(reason):
    return "ERROR", reason, None


def skipped(reason):
    return "SKIPPED", reason, None


CORPUS = [
    (None, skipped("TOMBSTONE")),
    (b"\xff{", error("BAD_UTF8")),
    (b'{"op":"\xc0\xaf"}', error("BAD_UTF8")),
    *[
        (text, error("BAD_JSON"))
        for text in (
            '{"op":', "", " ", '{"op":"c"} xyz', '{"op":"c"}] xyz', '{"op":"c"}} xyz', '{"op":"c"},{"op":"c"}',
            "{'op':'c'}", '{"op":"c",}', "01", "[1],", "\ufeff{}", '{"op":"c"}]', "1,2", "1],[2", "1,{}]",
            "nul", "/**/1", '{"op":"c"}//', f'{{"op":"c","after":{G},"x":NaN}}', '{op:"c"}', '"a\nb"',
        )
    ],
    *[(text, skipped("EMPTY_ENVELOPE")) for text in ("{}", "[]", "0", '""', "false", "null", " {} ", "0.0", "-0", "0e5")],
    *[(text, error("ENVELOPE_NOT_OBJECT")) for text in ("[1]", "5", '"x"', "true", "[null]", '"false"', '"0"', "[[]]", "0.5")],
    *[(message(G, op), skipped("OP")) for op in ('"r"', '"u"', '"d"', '"C"', "1", "null", '["c"]', '{"c":"c"}', '"c "')],
    (f'{{"after":{G}}}', skipped("OP")),
    (f'{{"OP":"c","after":{G}}}', skipped("OP")),
    (f'{{"op":"u","op":"c","after":{G}}}', ENRICHED),
    (f'{{"op":"c","op":"u","after":{G}}}', skipped("OP")),
    (f' {{ "x":[{{}}], "op" : "c", "after":{G}, "source":{{"op":"d"}} }}\n', ENRICHED),
    *[(message(after), error("AFTER_NOT_STRING")) for after in ("null", json.dumps(GOOD), "5", "[]", "{}", "true")],
    ('{"op":"c"}', error("AFTER_NOT_STRING")),
    *[(image(text), error("AFTER_BAD_JSON")) for text in ("{", "", json.dumps(GOOD) + " x", json.dumps(GOOD) + "] x")],
    *[(image(text), ("EMPTY", "", None)) for text in ("null", "{}", "[]", "0", "false", '""', "0.0", "-0.0", "0e0", "\t{ }")],
    *[(image(text), error("AFTER_NOT_OBJECT")) for text in ("[1]", "7", "true", '"x"', "[null]", "1e3", '" "')],
    (good(without=["_id"]), error("ID")),
    *[(good(_id=value), error("ID")) for value in (None, 7, "a", [], [{"$oid": "a"}])],
    *[(good(_id=value), error("ID_NO_OID")) for value in ({}, {"$oid": None}, {"oid": "a"})],
    (good(_id={"$oid": 7}), alice(id="7")),
    *[(good(_id={"$oid": value}), error("TYPE")) for value in (True, 1.5, [], {})],
    (good(without=["timestamp"]), error("TIMESTAMP")),
    *[(good(timestamp=value), error("TIMESTAMP")) for value in (None, 5, "x", [])],
    *[(good(timestamp=value), alice(time=None)) for value in ({}, {"$date": None}, {"date": 1})],
    *[
        (good(timestamp={"$date": value}), ENRICHED)
        for value in (
            MILLIS, "2023-11-14T22:13:20.123Z", "2023-11-15T05:13:20.123+07:00", "2023-11-15T05:13:20.123+0700",
            {"$numberLong": str(MILLIS)},
        )
    ],
    (good(timestamp={"$date": -1}), alice(time=-1000)),
    *[
        (good(timestamp={"$date": value}), error("TYPE"))
        for value in (2**63 - 1, -(2**63), 2**70, "2023-11-14T22:13:20.123", "x", "", "1700000000123", 1.5, True, [], {},
                      "2023-13-14T22:13:20Z")
    ],
    (good(user_id=99), alice(user=99, **UNKNOWN)),
    (good(user_id=4), alice(user=4, **UNKNOWN)),
    (good(user_id=5), error("USER_INCOMPLETE")),
    (good(user_id=6), alice(user=6, name=None, city="Rome")),
    *[(text, alice(user=None, name="Anon", city="Nowhere")) for text in (good(user_id=None), good(without=["user_id"]))],
    *[
        (good(user_id=value), ENRICHED)
        for value in (1.0, *({wrapper: "1"} for wrapper in ("$numberLong", "$numberInt", "$numberDecimal")), {"$numberDouble": "1.0"})
    ],
    (image(json.dumps(GOOD).replace('"user_id": 1', '"user_id": 1e0')), ENRICHED),
    (image(json.dumps(GOOD).replace('"user_id": 1', '"user_id": 1e10')), alice(user=10**10, **UNKNOWN)),
    *[
        (good(user_id=value), error("TYPE"))
        for value in ("1", True, 1.5, {"$gt": 0}, [1], 2**63, 10**40, {"$numberLong": 1}, {"$numberLong": "x"},
                      {"$numberLong": "1", "x": 1}, {}, 1e300, 1e-30, {"$numberLong": "9223372036854775808"})
    ],
    (image(json.dumps(GOOD).replace('"user_id": 1', '"user_id": 1, "user_id": "x"')), error("TYPE")),
    (image(json.dumps(GOOD).replace('"user_id": 1', '"user_id": "x", "user_id": 1')), ENRICHED),
    *[(text, alice(amount=None)) for text in (good(amount=None), good(without=["amount"]))],
    (good(amount={"$numberDecimal": "1.10"}), alice(amount=1.1)),
    (good(amount={"$numberDouble": "-1.5E+3"}), alice(amount=-1500.0)),
    (good(amount={"$numberDouble": "Infinity"}), alice(amount=math.inf)),
    (good(amount=7), alice(amount=7.0)),
    (good(amount=0.1 + 0.2), alice(amount=0.1 + 0.2)),
    (good(amount=1e300), alice(amount=1e300)),
    *[(good(amount=value), error("TYPE")) for value in ("1", True, [], {}, {"$numberDouble": "1d"}, {"$numberDouble": " 1"})],
    (good(_id=None, timestamp=None, user_id="x"), error("ID")),
    (good(timestamp=None, user_id="x"), error("TIMESTAMP")),
    (good(user_id=5, amount="x"), error("TYPE")),
    (good(_id={"$oid": 1.0}), error("TYPE")),
]


def as_bytes(text):
    return text.encode() if isinstance(text, str) else text


def topic_of(spark, values):
    rows = [(None, value, "t", i % 3, i, None) for i, value in enumerate(values)]
    return spark.createDataFrame(rows, TOPIC)


@pytest.fixture(scope="module")
def dimension(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("users") / "users")
    documents = [json.dumps({"user_id": key, **user}) for key, user in USERS.items()]
    documents += ['{"user_id":"1","name":"No","city":"No"}', "[]", "x", '{"user_id":1,"name":"Second","city":"Second"}']
    frame = spark.createDataFrame([(text, i) for i, text in enumerate(documents)], "document string, ord bigint")
    assert refresh_dimension(users_from_documents(frame, "document"), path) == len(USERS) + 1
    return current_dimension(spark, path)


def verdicts(classified):
    """By offset: outcome, reason and, for enriched messages, the record."""
    rows = classified.withColumn("micros", F.unix_micros("timestamp")).drop("timestamp").collect()
    found = {}
    for row in rows:
        record = (row.transaction_id, row.user_id, row.amount, row.micros, row.user_name, row.user_city)
        assert row.offset not in found
        found[row.offset] = (row.outcome, row.reason, record if row.outcome == "ENRICHED" else None)
    return [found[i] for i in range(len(rows))]


@pytest.mark.parametrize("small", [True, False])
def test_corpus(spark, dimension, small):
    decoded = decode(topic_of(spark, [as_bytes(value) for value, _ in CORPUS]))
    hot = hot_keys(decoded, "user_id", 8)
    result = verdicts(enrich_decoded(decoded, dimension.lookup, small=small, hot=hot))
    assert [(value, got) for (value, _), got in zip(CORPUS, result)] == CORPUS


def test_restatement_agrees_with_corpus():
    assert [(value, judge(as_bytes(value), USERS)) for value, _ in CORPUS] == CORPUS


def test_enrich_reduces_users_itself(spark):
    users = spark.createDataFrame(
        [(1, "Second", "B", 2), (1, "First", "A", 1), (2, "Bob", "C", 3)],
        "user_id bigint, name string, city string, ord bigint",
    )
    topic = topic_of(spark, [as_bytes(good()), as_bytes(good()), as_bytes(good(user_id=2))])
    for small in (True, False):
        result = verdicts(enrich(topic, users, order="ord", small=small))
        names = [record[4:] for _, _, record in result]
        assert names == [("First", "A"), ("First", "A"), ("Bob", "C")]


def test_errors_keep_their_bytes(spark):
    values = [b"\xff{", b'{"op":', as_bytes(good()), b"{}", as_bytes(good(user_id="x"))]
    kept = {row.offset: row.value for row in decode(topic_of(spark, values)).collect()}
    assert [kept[i] and bytes(kept[i]) for i in range(5)] == [values[0], values[1], None, None, values[4]]


scalars = st.one_of(
    st.none(), st.booleans(), st.integers(-5, 8), st.integers(-(2**70), 2**70), st.sampled_from(["", "c", "1", "0", "false"]),
    st.floats(allow_nan=False, allow_infinity=False, width=32), st.just(MILLIS), st.text(max_size=3),
)
wrappers = st.tuples(
    st.sampled_from(["$numberLong", "$numberInt", "$numberDouble", "$numberDecimal", "$oid", "$date", "x"]),
    st.sampled_from(["1", "2.0", "x", "", "-3", "1.5", 1, None, str(MILLIS)]),
).map(lambda pair: dict([pair]))
anything = st.one_of(scalars, wrappers, st.lists(scalars, max_size=2), st.dictionaries(st.sampled_from(["a", "op"]), scalars, max_size=2))


def mostly(value, other):
    """``value`` four times out of five, so that messages get deep into the ladder."""
    return st.integers(0, 4).flatmap(lambda i: other if i == 0 else value)


documents = st.fixed_dictionaries(
    {},
    optional={
        "_id": mostly(st.fixed_dictionaries({"$oid": mostly(st.just("64a0000000000000000000a1"), anything)}), anything),
        "user_id": mostly(st.one_of(st.integers(1, 8), st.none()), anything),
        "amount": mostly(st.floats(10, 500), anything),
        "timestamp": mostly(st.fixed_dictionaries({}, optional={"$date": mostly(st.integers(0, 2**41), anything)}), anything),
    },
)
after = mostly(documents, anything).map(json.dumps)
envelopes = st.fixed_dictionaries(
    {}, optional={"op": mostly(st.just("c"), anything), "after": mostly(after, st.one_of(anything, documents)), "source": anything}
)
texts = mostly(envelopes, anything).map(json.dumps)
garbled = st.tuples(texts, st.integers(0, 400), st.sampled_from(["", " ", "]", "}", ",", '"', "x", "0", "{}", "\u00e9"])).map(
    lambda t: t[0][: t[1]] + t[2] + t[0][t[1] :]
)


@settings(max_examples=8, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(st.one_of(texts, texts, garbled), min_size=300, max_size=400))
def test_random_messages(spark, dimension, values):
    values = [value.encode("utf-8", "surrogatepass") for value in values]
    decoded = decode(topic_of(spark, values))
    got = verdicts(enrich_decoded(decoded, dimension.lookup, small=True))
    expected = [judge(value, USERS) for value in values]
    assert [row for row in zip(values, got, expected) if row[1] != row[2]] == []


rows = st.tuples(
    st.text("0123456789abcdef", min_size=24, max_size=24),
    st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)),
    # Zero loses its sign, which equality does not see but repr does.
    st.one_of(st.none(), st.floats(allow_nan=False, allow_infinity=False).map(lambda x: x + 0.0)),
    st.one_of(st.none(), st.integers(-(10**14), 10**14)),
)


@settings(max_examples=5, deadline=None, phases=[Phase.explicit, Phase.generate], suppress_health_check=list(HealthCheck))
@given(st.lists(rows, min_size=50, max_size=200))
def test_decoding_undoes_encoding(spark, values):
    frame = spark.createDataFrame(
        values, "transaction_id string, user_id bigint, amount double, millis bigint"
    ).select("*", F.timestamp_millis("millis").alias("timestamp"), F.lit("c").alias("op"))
    topic = encode_envelope(frame).select(
        "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset")
    )
    back = transactions(decode(topic)).select(
        "transaction_id", "user_id", "amount", F.unix_millis("timestamp").alias("millis")
    )
    assert sorted(map(repr, map(tuple, back.collect()))) == sorted(map(repr, values))
    assert TXN.names == ["transaction_id", "user_id", "amount", "timestamp"]


def test_no_message_fails_the_job(spark, dimension):
    deep = "[" * 900 + "]" * 900
    values = [
        "[" * 100_000,
        "[" * 100_000 + "]" * 100_000,
        deep,
        '{"a":' * 900 + "1" + "}" * 900,
        f'{{"x":{deep}}}',
        f'{{"op":{deep},"after":{G}}}',
        f'{{"op":"c","x":{deep},"after":{G}}}',
        good(user_id=1).replace('\\"user_id\\": 1', f'\\"user_id\\": {deep}'),
        image(deep),
        "9" * 5000,
        "-1e-99999999",
        '{"op":"c","after":"' + "x" * 17_000_000 + '"}',
        '"' + "x" * 21_000_000 + '"',
        "{" + ",".join(f'"k{i}":{i}' for i in range(100_000)) + "}",
        good(user_id={"$numberLong": "9" * 5000}),
        good(amount={"$numberDouble": "9" * 5000}),
        good(timestamp={"$date": "9" * 5000}),
        good(timestamp={"$date": "9999-99-99T99:99:99Z"}),
        '{"op":"c","after":"\\ud800"}',
        "\x00",
        '"\\u0000"',
    ]
    decoded = decode(topic_of(spark, [as_bytes(value) for value in values]))
    got = [verdict[:2] for verdict in verdicts(enrich_decoded(decoded, dimension.lookup, small=True))]
    assert got[:3] == [("ERROR", "LIMIT"), ("ERROR", "LIMIT"), ("ERROR", "ENVELOPE_NOT_OBJECT")]
    assert got[5:9] == [
        ("SKIPPED", "OP"), ("ENRICHED", ""), ("ERROR", "TYPE"), ("ERROR", "AFTER_NOT_OBJECT"),
    ]
    assert got[14] == ("ERROR", "TYPE") and got[16:18] == [("ERROR", "TYPE")] * 2
    assert got[15] == ("ENRICHED", "")
    assert got[9] == ("ERROR", "LIMIT") and got[12] == ("ERROR", "LIMIT")
    assert all(outcome for outcome, _ in got)


def test_limits_are_not_called_bad_json(spark):
    values = [
        '{"op":"u","x":"' + "x" * 21_000_000 + '"}',
        '{"op":"u","x":' + "9" * 1001 + "}",
        '{"op":"u","' + "k" * 51_000 + '":1}',
        '{"op":"u","x":' + "[" * 1100 + "]" * 1100 + "}",
        image('{"x":' + "9" * 1001 + "}"),
        '{"op":"u"',
        image("{"),
    ]
    got = [(row.outcome, row.reason) for row in decode(topic_of(spark, [as_bytes(value) for value in values])).orderBy("offset").collect()]
    assert [reason for _, reason in got] == ["LIMIT"] * 4 + ["AFTER_LIMIT", "BAD_JSON", "AFTER_BAD_JSON"]
    assert {outcome for outcome, _ in got} == {"ERROR"}


def test_endless_amounts_survive_encoding(spark):
    amounts = [float("nan"), float("inf"), float("-inf"), 1.5, None]
    frame = spark.createDataFrame([(str(i), 1, a) for i, a in enumerate(amounts)], "transaction_id string, user_id bigint, amount double")
    topic = encode_envelope(frame.select("*", F.timestamp_millis(F.lit(0)).alias("timestamp"), F.lit("c").alias("op"))).select(
        "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset")
    )
    back = {row.transaction_id: row.amount for row in transactions(decode(topic)).collect()}
    assert [repr(back[str(i)]) for i in range(5)] == list(map(repr, amounts))


def test_dates_with_an_exponent(spark):
    texts = ["1.7e12", "1e3", "1.5e0", "1.7E12"]
    values = [as_bytes(json.dumps({"op": "c", "after": f'{{"_id":{{"$oid":"x"}},"timestamp":{{"$date":{text}}}}}'})) for text in texts]
    rows = decode(topic_of(spark, values)).orderBy("offset").select("reason", F.unix_millis("timestamp").alias("ms")).collect()
    assert [tuple(row) for row in rows] == [("", 1_700_000_000_000), ("", 1000), ("TYPE", None), ("", 1_700_000_000_000)]
    assert [judge(value, {})[:2] for value in values] == [("ENRICHED", "")] * 2 + [("ERROR", "TYPE"), ("ENRICHED", "")]
