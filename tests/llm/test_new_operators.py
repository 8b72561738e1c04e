"""The trie of conversations, the suffix dedup and the alignment of tokens against plain restatements."""

import hashlib
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.llm import alignment, prefix_trie, suffix_dedup
from millrace.llm.common import join_unique
from millrace.llm.queries import QUERIES
from millrace.session import fresh_dir
from tests.llm.tables import CLASHING, documents, edge_documents, edge_rows, empty_documents
from tests.oracle import TESTDATA

# -- 11 -----------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie(rows, rebuild):
    """Rows of the trie; ``rows`` are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append(((turn is not None, turn or 0), digest, (role, text)))
    own = {c: [said for *_, said in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        few = zlib.crc32(str(c).encode()) % 4 if rebuild else 0
        built[c] = tuple(own.get(c - c % 20, [])[:few] + turns[few:])
    members = defaultdict(list)
    for c, turns in built.items():
        for depth in range(len(turns) + 1):
            members[turns[:depth]].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        words = len([w for w in re.split(r"[\x20\x09-\x0D]+", node[-1][1]) if w]) if node else 0
        for depth in range(len(node) + 1):
            leaves[node[:depth]] += children[node] == 0
            saved[node[:depth]] += (len(convs) - 1) * words
    result = Counter()
    for node, convs in members.items():
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == node)
        parent = min(members[node[:-1]]) if node else None
        result[min(convs), len(node), parent, len(convs), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return result


def talk(seed):
    rng = random.Random(seed)
    rows = [
        (c, rng.choice([None, *range(5)]), rng.choice([None, "u", "a"]), rng.choice(["", "x y", "z", None]))
        for c in range(60)
        for _ in range(rng.choice([1, 2, 3, 9]))
    ]
    rows += [(c, i, "u", f"t {i % 3}") for c, n in ((100, 200), (120, 190)) for i in range(n)]  # long ones
    rows += [(140, None, "u", "same")] * 90 + [(None, 1, "u", "nobody's"), (2**60, 0, "u", "y" * 200_000)]
    return rows


@pytest.mark.parametrize("band", [3, 32])
def test_trie(spark, band):
    rows = talk(band)
    frame = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("x") for c in ("path", "hi", "node", "depth")}).repartition(5)
    assert Counter(tuple(r) for r in prefix_trie.shared_opening_trie(frame, band).collect()) == trie(rows, True)
    assert Counter(tuple(r) for r in prefix_trie.prefix_trie(frame, band).collect()) == trie(rows, False)


def test_trie_of_nothing(spark):
    assert prefix_trie.shared_opening_trie(spark.createDataFrame([], TURNS)).count() == 0
    turnless = spark.createDataFrame([(21, 0, "u", "x")], TURNS)  # its opening comes from a conversation that is absent
    (row,) = [r for r in prefix_trie.shared_opening_trie(turnless).collect() if r["depth"] == 0]
    assert (row["conv_id"], row["n_convs"], row["parent_conv_id"]) == (21, 1, None)


def test_a_conversation_lies_across_tasks(spark):
    """The keys do not depend on how the turns are dealt."""
    turns = prefix_trie.slim_turns(spark.createDataFrame([(c, i, "u", str(i)) for c in (1, 2) for i in range(400)], TURNS))
    keys = lambda: {(r["conv_id"], r["depth"]): (r["hi"], r["lo"]) for r in prefix_trie.positions(turns).collect()}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = keys()
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        whole = keys()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt == whole and len(whole) == 800
    assert all(whole[1, d] == whole[2, d] for d in range(1, 401)) and len(set(whole.values())) == 400


def test_unique_rows_are_joined_alike(spark):
    rows = spark.range(3000).select((F.col("id") % 300).alias("k"), "id").where("k < 250")
    table = spark.range(300).select(F.col("id").alias("k"), (F.col("id") * 7 % 31).alias("w"), (F.col("id") * 2).alias("v"))
    whole = Counter(tuple(r) for r in join_unique(rows, table, ["k"], "w", 1000).collect())
    assert whole == Counter(tuple(r) for r in join_unique(rows, table, ["k"], "w", 20).collect()) and sum(whole.values()) == 2500


# -- 12 -----------------------------------------------------------------------------------------


def without_repeats(rows):
    """(doc_id, bytes, removed, spans, kept) of rows (doc_id, text)."""
    place = lambda doc_id, at: (doc_id is not None, doc_id or 0, at)
    given, first = [(d, (t or "").encode()) for d, t in rows], {}
    for d, held in given:
        for at in range(len(held) - 99):
            window = held[at : at + 100]
            first[window] = min(first.get(window, place(d, at)), place(d, at))
    result = Counter()
    for d, held in given:
        gone = bytearray(len(held))
        for at in range(len(held) - 99):
            if first[held[at : at + 100]] < place(d, at):
                gone[at : at + 100] = b"\1" * 100
        spans = len([s for s in bytes(gone).split(b"\0") if s])
        kept = bytes(x for x, g in zip(held, gone) if not g)
        result[d, len(held), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return result


def removed(docs, group=suffix_dedup.GROUP, part_bytes=suffix_dedup.PART_BYTES):
    rows = suffix_dedup.remove_repeats(docs, group, part_bytes).collect()
    result = Counter()
    for r in rows:
        held = (r["doc"]["text"] or "").encode()
        result[r["doc"]["doc_id"], len(held), sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()] += 1
    return result


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 3])
def test_repeats_of_edge_rows(spark, group):
    docs = edge_documents(spark)
    assert removed(docs, group) == without_repeats([(r[0], r[1]) for r in edge_rows()])
    assert suffix_dedup.remove_repeats(docs, group).first()["doc"].asDict().keys() >= set(CLASHING)
    assert removed(empty_documents(spark)) == Counter()


@pytest.mark.parametrize("group", [suffix_dedup.GROUP, 2])
def test_repeats_of_overlapping_pieces(spark, group):
    rng = random.Random(group)
    base = ["".join(rng.choices("abé \n", k=rng.choice([90, 300, 900]))) for _ in range(8)]
    rows = []
    for i in range(120):
        pieces = [b[rng.randrange(0, 50) :][: rng.randrange(50, 600)] if rng.random() < 0.7 else "".join(rng.choices("ab", k=rng.randrange(200))) for b in rng.choices(base, k=3)]
        rows.append((rng.choice([i, i, i, None, 7]), "".join(pieces)))
    rows += rows[:5] + [(1000, "a" * 1000), (999, "a" * 150), (1001, "ab" * 300), (1002, "x" * 99), (1003, "x" * 99), (1004, "y" * 100), (1005, "y" * 100)]
    assert removed(documents(spark, rows), group) == without_repeats(rows)


def test_texts_longer_than_a_part(spark):
    rng = random.Random(0)
    long = "".join(rng.choices("abcdefgh ", k=6000))
    rows = [(1, long), (2, "q" + long[1500:4700] + "q"), (3, long[::-1] + long[990:1200])]
    assert removed(documents(spark, rows), part_bytes=1000) == without_repeats(rows)


@pytest.mark.parametrize("seed", range(4))
def test_deep_shallow_sorting(seed):
    rng = random.Random(seed)
    text = b"".join(bytes(rng.choices(b"ab\0\xff", k=rng.choice([3, 40]))) * rng.choice([1, 1, 4]) for _ in range(60)) + bytes(8)
    starts = np.array(rng.choices(range(len(text) - 8 - 60), k=500))
    segments = np.array([rng.randrange(3) for _ in starts])
    order, run = suffix_dedup.deep_shallow_sort(text, starts, segments, 60)
    keys = [(segments[i], text[starts[i] : starts[i] + 60]) for i in order]
    assert sorted(order) == list(range(500)) and keys == sorted(keys)
    assert all((run[i] == run[i - 1]) == (keys[i] == keys[i - 1]) for i in range(1, 500))


def test_stretches_hold_every_window_once():
    rng = random.Random(1)
    parts = [bytes(rng.choices(b"ab", k=n)) for n in (500, 99, 100, 0, 101, 700)]
    held, stops = np.frombuffer(b"".join(parts), "u1"), np.cumsum([len(p) for p in parts])
    _, _, first, sizes, _ = suffix_dedup.stretches(held, stops, suffix_dedup.Grams(4000))
    windows = [s + k for s, n in zip(first.tolist(), sizes.tolist()) for k in range(n)]
    begins = [0, *stops[:-1].tolist()]
    assert windows == [b + k for b, p in zip(begins, parts) for k in range(len(p) - 99)]


def test_equal_windows_have_one_anchor_and_equal_stretches_one_hash():
    rng = random.Random(2)
    shared = bytes(rng.choices(b"abc ", k=400))
    grams, anchors, contents = suffix_dedup.Grams(4000), [], defaultdict(set)
    for front in (b"", b"zz", bytes(rng.choices(b"abc ", k=77))):
        held = np.frombuffer(front + shared, "u1")
        found, content, first, sizes, _ = suffix_dedup.stretches(held, np.array([len(held)]), grams)
        anchors.append({int(s) + k - len(front): int(a) for a, s, n in zip(found, first, sizes) for k in range(n)})
        for c, s, n in zip(content.tolist(), first.tolist(), sizes.tolist()):
            contents[c].add(held[s : s + n + 99].tobytes())
    assert all(len({a[k] for a in anchors}) == 1 for k in range(301))
    assert all(len(c) == 1 for c in contents.values()) and len(contents) < 45


@pytest.mark.parametrize("period", [1, 3, 40, 61, 62, 99, 100, 130])
def test_stretches_that_repeat_themselves_are_known(period):
    rng = random.Random(period)
    text = bytes(rng.choices(b"abcd", k=period)) * (1 + 400 // period) + bytes(rng.choices(b"abcd", k=300))
    _, _, first, sizes, inner = suffix_dedup.stretches(np.frombuffer(text, "u1"), np.array([len(text)]), suffix_dedup.Grams(4000))
    for s, n, marked in zip(first.tolist(), sizes.tolist(), inner.tolist()):
        assert marked or len({text[i : i + 100] for i in range(s, s + n)}) == n


# -- 13 -----------------------------------------------------------------------------------------


def aligned(rows):
    """The contract, token by token."""
    a_tokens, b_tokens = alignment.ByteLevel(alignment.TOKENIZER_A).tokens, alignment.Pieces(alignment.TOKENIZER_B)
    tokenizer = Tokenizer.from_file(alignment.TOKENIZER_A)
    tokenizer.encode_special_tokens = True
    held, counts = [], Counter()
    for doc_id, text in rows:
        spelt = f" {text}".encode()
        a = tokenizer.encode(f" {text or ''}", add_special_tokens=False).ids
        (b,) = b_tokens.encode([text or ""])
        if not text or b"".join(a_tokens[i] for i in a) != spelt or b"".join(b_tokens.tokens[i] for i in b) != spelt:
            a, b = [], []
        a_ends, b_ends = list(np.cumsum([len(a_tokens[i]) for i in a])), list(np.cumsum([len(b_tokens.tokens[i]) for i in b]))
        links, i, j = [], 0, 0
        while i < len(a) and j < len(b):
            links.append((a[i], b[j]))
            step = (a_ends[i] <= b_ends[j], b_ends[j] <= a_ends[i])
            i, j = i + step[0], j + step[1]
        groups, i, j = [], 0, 0
        for end in sorted(set(a_ends) & set(b_ends)):
            k, m = a_ends.index(end) + 1, b_ends.index(end) + 1
            groups.append(",".join(map(str, a[i:k])) + "|" + ",".join(map(str, b[j:m])))
            i, j = k, m
        held.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        counts.update(set(links))
    best = defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    return Counter((d, a, b, g, len(ls), sum(counts[x] == best[x[0]] for x in ls), sum(counts[x] for x in ls), h) for d, a, b, g, ls, h in held)


@pytest.mark.parametrize("broadcast_pairs", [alignment.BROADCAST_PAIRS, 50])
def test_alignment_of_edge_rows(spark, broadcast_pairs):
    odd = ["<s> </s> <unk> <0x41> ▁ a▁b <|endoftext|>", " é é ﬁ ①", "🤖‍👩", " " * 300, "\r\nfoo\t\tbar  ", "​﻿", "日本語のテキスト"]
    rows = [(r[0], r[1][:3000] if r[1] else r[1]) for r in edge_rows()] + [(200 + i, t) for i, t in enumerate(odd)]
    got = alignment.alignment_summary(documents(spark, rows), broadcast_pairs=broadcast_pairs)
    assert Counter(tuple(r) for r in got.collect()) == aligned(rows)
    assert alignment.alignment_summary(empty_documents(spark)).count() == 0


def test_alignment_of_a_table(spark):
    sf_dir = f"{TESTDATA}/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op13_alignment"](spark, sf_dir).collect()) == aligned(rows)


def test_very_long_texts_are_aligned(spark):
    rows = {r["doc_id"]: r for r in alignment.align_documents(edge_documents(spark)).collect() if r["doc_id"] is not None}
    for doc_id in (5, 6):
        r = rows[doc_id]
        assert sum(r["a_sizes"]) == len(r["a_ids"]) > 10_000 and sum(r["b_sizes"]) == len(r["b_ids"]) and len(r["a_sizes"]) == len(r["b_sizes"])


def test_intervals_without_a_cut_are_groups():
    """A long one, so that the rings around the middle widen to all of it, beside one with cuts everywhere."""
    ends_b = np.array([5000, *range(5001, 5100)])
    ends_a = np.array([*range(1, 5000, 2), 5000, *range(5001, 5100)])
    a, b = (object.__new__(alignment.Tokens) for _ in range(2))
    a.ids, a.ends, a.counts, a.stops = np.zeros(len(ends_a)), ends_a, np.array([len(ends_a)]), np.array([len(ends_a)])
    b.ends = ends_b
    assert ends_a[alignment.shared_cuts(a, b)].tolist() == ends_b.tolist()


# -- all ----------------------------------------------------------------------------------------

ELSEWHERE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
sys.path.remove(sys.argv[1])
from millrace.llm import alignment
print(alignment.alignment_summary(spark.createDataFrame([(1, "a text")], "doc_id long, text string")).first()["n_a"])
"""


def test_workers_need_not_have_the_package(spark, tmp_path):
    """From another folder, the package on the driver's path alone."""
    root = str(__import__("pathlib").Path(__file__).resolve().parents[2])
    script = tmp_path / "elsewhere.py"
    script.write_text(ELSEWHERE.replace('sys.path.remove(sys.argv[1])\nfrom millrace.llm import alignment', 'from millrace.llm import alignment\nsys.path.remove(sys.argv[1])'))
    done = subprocess.run([sys.executable, str(script), root, fresh_dir(spark, "elsewhere")], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("2"), done.stderr[-2000:]
