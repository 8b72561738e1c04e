"""Each operator against a plain restatement of what it promises."""

import hashlib
import math
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import byte_gru, class_lm, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality, toxicity, url_filters
from millrace.llm.components import connected_components, merge_links
from millrace.llm.queries import QUERIES
from tests.llm.tables import CLASHING, documents, edge_documents, edge_labels, edge_rows, edited, empty_documents, prose

SPACE = r"[\x20\x09-\x0D]+"


def words(text):
    return [w for w in re.split(SPACE, text or "") if w]


def low(text):
    return (text or "").encode().lower().split()


# -- 1 ------------------------------------------------------------------------------------------


def test_packing_tokens_and_places(spark):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    rows = packing.pack_documents(edge_documents(spark)).collect()
    expected = Counter()
    for doc_id, text, *_ in edge_rows():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4").tobytes()
            expected[doc_id, piece, start, len(part) // 4, zlib.crc32(part), part] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in rows) == expected
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(empty_documents(spark)).count() == 0


def test_packing_looks_up_words_one_by_one():
    class Watched(packing.Chunks):
        def _whole(self):
            raise AssertionError("went through all that is kept")

        keys = __iter__ = items = values = _whole

    watched, plain = Watched(packing.TOKENIZER), Tokenizer.from_file(packing.TOKENIZER)
    for words in ({"some", "words", "again."}, {"some", "Words,", "more", "x1-y2", "again!"}):
        watched.learn(words)
        for word in words:
            assert np.frombuffer(watched[word], "<u4").tolist() == plain.encode(word, add_special_tokens=False).ids, word


@pytest.mark.parametrize("seed", range(20))
def test_packing_plan(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 100])
    counts = Counter(rng.randint(1, capacity) for _ in range(rng.choice([1, 8, 40, 3000])))
    rest = Counter(counts)
    fixed = packing.reduce_instance(rest, capacity)
    patterns = fixed + packing.best_fit(rest, capacity)
    used = Counter()
    for bins, held in patterns:
        assert bins > 0 and sum(held) <= capacity
        for x in held:
            used[x] += bins
    assert used == counts
    n, lower = sum(b for b, _ in patterns), -(-sum(k * v for k, v in counts.items()) // capacity)
    assert lower <= n <= lower * 1.25 + 1


def _fewest(lengths, capacity):
    best = len(lengths)

    def place(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(lengths):
            best = len(rooms)
            return
        for k in range(len(rooms)):
            if rooms[k] >= lengths[i] and rooms[k] not in rooms[:k]:
                place(i + 1, [*rooms[:k], rooms[k] - lengths[i], *rooms[k + 1 :]])
        place(i + 1, [*rooms, capacity - lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("seed", range(30))
def test_reduction_keeps_a_best_packing(seed):
    rng = random.Random(seed)
    lengths = sorted((rng.randint(2, 20) for _ in range(9)), reverse=True)
    rest = Counter(lengths)
    fixed = packing.reduce_instance(rest, 20)
    left = sorted(rest.elements(), reverse=True)
    assert sum(b for b, _ in fixed) + (_fewest(left, 20) if left else 0) == _fewest(lengths, 20)


# -- 2 ------------------------------------------------------------------------------------------


def shingles(text):
    w = low(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(texts):
    sets = {i: shingles(t) for i, t in texts}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    core, passage = prose(rng, 150), prose(rng, 60)
    texts = [core] + [edited(rng, core, rng.choice([1, 2, 4])) for _ in range(80)]  # a large group, many pairs of it unlinked
    texts += [passage + " " + prose(rng, n) for n in (5, 6, 8, 10, 12, 14, 16, 18, 20, 25, 30, 60) * 4]  # around the threshold
    texts += [prose(rng, rng.choice([1, 3, 5, 6, 40, 200])) for _ in range(40)]
    for _ in range(25):
        chain = prose(rng, 60)
        for _ in range(4):
            chain = edited(rng, chain, 1)
            texts.append(chain)
    texts += rng.sample(texts, 30) + [None, "", " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "ROUNDS", ((6, 3), (8, 4)))  # most lists take several rounds
    texts = near_copies(seed)
    found = ngram_join.near_duplicates(documents(spark, texts)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(texts)


def test_jaccard_join_pairs_no_sets_that_bitmaps_tell_apart(spark):
    rng = np.random.default_rng(2)
    shared = rng.integers(0, 1 << 63, 30, dtype="u8")
    sets = [np.r_[shared, rng.integers(0, 1 << 63, 10, dtype="u8")] for _ in range(100)]  # 60 % alike
    sets += [np.r_[s[:-2], rng.integers(0, 1 << 63, 2, dtype="u8")] for s in sets[:5]]  # 90 % like one of them
    rows = [(1, i, 40, 0, i, ngram_join.parities(s).tolist()) for i, s in enumerate(sets)]
    live = spark.createDataFrame(rows, "token long, sid long, n long, at long, component long, parities array<long>")
    pairs = {(r["a"], r["b"]) for r in ngram_join.candidate_pairs(live, live, len(rows)).collect()}
    assert {(i, 100 + i) for i in range(5)} <= pairs
    assert len(pairs) < 100  # of 5,460


def test_jaccard_join_compares_few_pairs_of_a_group(spark, monkeypatch):
    """A list of many groups is worked off from a few probes of each: the pairs follow its sets, not their pairs."""
    rng = np.random.default_rng(3)
    rare, groups = rng.integers(0, 1 << 63, 10, dtype="u8"), 20
    rows = []
    for _ in range(groups):
        core = rng.integers(0, 1 << 63, 90, dtype="u8")
        for k in range(30):
            tokens = np.unique(np.r_[rare, core[:60], np.delete(core[60:], k)])
            rows.append((ngram_join._set_id(tokens), len(tokens), bytearray(tokens.tobytes()), ngram_join.parities(tokens).tolist()))
    entries = [(7, sid, n, 0) for sid, n, _, _ in rows]
    sets = spark.createDataFrame(rows, "sid long, n long, tokens binary, parities array<long>")
    monkeypatch.setattr(ngram_join, "index_entries", lambda _: spark.createDataFrame(entries, "token long, sid long, n long, at long"))
    components, answers = ngram_join.linked_sets(sets)
    assert {r["count"] for r in components.groupBy("component").count().collect()} == {30}
    assert answers.count() <= 5 * len(rows)  # of 8,700 links


def test_bitmaps_differ_in_no_more_bits_than_sets_in_tokens():
    rng = np.random.default_rng(1)
    for n, own in ((5, 1), (40, 9), (300, 80), (3000, 2500)):
        tokens = rng.integers(0, 1 << 63, n + 2 * own, dtype="u8")
        a, b = (ngram_join.parities(x) for x in (tokens[: n + own], np.r_[tokens[:n], tokens[n + own :]]))
        assert len(a) == ngram_join.PARITIES // 64
        assert np.bitwise_count((a ^ b).view("u8")).sum() <= 2 * own


def test_jaccard_join_edges(spark):
    docs = edge_documents(spark)
    found = ngram_join.near_duplicates(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    expected = brute_components([(r[0], r[1]) for r in edge_rows() if r[0] is not None])
    rows = found.collect()
    assert len(rows) == len(edge_rows())
    assert all((r["n_shingles"], r["component_id"]) == expected[r["doc_id"]] for r in rows if r["doc_id"] is not None)
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    kept = ngram_join.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r[0] for r in edge_rows() if r[0] is None or expected[r[0]][1] == r[0])
    assert ngram_join.near_duplicates(empty_documents(spark)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(50)]
    parent = {x: x for e in edges for x in e}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in found} == {x: find(x) for x in parent}
    merged = spark.createDataFrame([], "node long, component long")
    for part in (edges[:70], edges[70:130], edges[130:]):
        merged = merge_links(merged, spark.createDataFrame(part, "a long, b long"))
    assert {r["node"]: r["component"] for r in merged.collect()} == {x: find(x) for x in parent}


# -- 3 ------------------------------------------------------------------------------------------


def toxic_corpus(seed=5, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text, toxic = prose(rng, 120), i % 5 == 0
        if toxic:
            for _ in range(6):
                text = text.replace(" ", f" {rng.choice(['vilest', 'scumlike', 'foulish'])} ", 1 + rng.randrange(3))
        rows.append((i, text))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_documents(spark):
    rows, labels = toxic_corpus()
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(documents(spark, rows), given).collect()
    assert len(found) == len(rows)
    held = [r for r in found if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert sum(r["predicted"] == labels[r["doc_id"]][2] for r in held) / len(held) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in found)
    # labels of held-out documents teach nothing
    held_ids = {r["doc_id"] for r in held}
    flipped = spark.createDataFrame([(i, q, 1 - t if i in held_ids else t) for i, q, t in labels], "doc_id long, quality int, toxic int")
    again = toxicity.score_toxicity(documents(spark, rows), flipped).collect()
    assert {r["doc_id"]: r["score"] for r in again} == {r["doc_id"]: r["score"] for r in found}


def test_toxicity_edges(spark):
    found = toxicity.score_toxicity(edge_documents(spark), edge_labels(spark))
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    assert len(found.collect()) == len(edge_rows())
    assert toxicity.score_toxicity(empty_documents(spark), edge_labels(spark)).count() == 0
    unlabelled = toxicity.score_toxicity(edge_documents(spark), edge_labels(spark).where("false")).collect()
    assert {r["score"] for r in unlabelled} == {0.5}


def test_ftrl_is_sparse():
    rng = np.random.default_rng(1)
    examples = [np.unique(np.append(rng.integers(10, 4000, 50), 1 if i % 2 else 2)).astype("i4") for i in range(400)]
    weights, _ = toxicity.train_ftrl(examples, np.arange(400) % 2.0, bits=12)
    assert weights[1] > 0.5 and weights[2] < -0.5
    assert (weights != 0).sum() < 400


# -- 4 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("head", [3, 1 << 18])
def test_language_model_counts(spark, head):
    rows = [r for r in edge_rows()]
    counts = Counter()
    tokens = lambda t: [*low(t), None]
    fold = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5
    for r in rows:
        if fold(r[0]) != 1:
            counts.update(tokens(r[1]))
    total, types = sum(counts.values()), len(counts)
    found = class_lm.score_documents(edge_documents(spark), head=head).collect()

    def expected(r):
        own = tokens(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (types + 1))) for w in own)
        return (r[0], fold(r[0]) == 1, len(own), sum(counts[w] > 0 for w in own), total, round(base, 4))

    assert Counter((*(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")), round(r["base_score"], 4)) for r in found) == Counter(map(expected, rows))
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in found)


def two_languages(spark):
    rng = random.Random(8)
    return [(i, prose(rng, 200, "de" if i % 3 == 0 else "en")) for i in range(150)]


def class_table(classed):
    """Count and class of every training word, by its hash."""
    return {r["word"]: (r["c"], r["class"]) for r in classed.collect()}


def hash_of(word):
    return int(class_lm.word_hashes([word])[0].view("i8")[0])


def test_language_model_is_a_distribution_and_does_better(spark):
    texts = two_languages(spark)
    docs = documents(spark, texts)
    model, classed = class_lm.fit_class_model(docs, class_lm.count_words(docs), head=50)
    np.testing.assert_allclose((10**model.transition).sum(1), 1, rtol=1e-9)
    # emissions of a class: its words, and the unknown as one type
    words = sorted({w for _, t in texts for w in low(t)})
    held = class_lm.score_texts(documents(spark, [(k, w.decode()) for k, w in enumerate(words)]), classed, model, F.lit(False))
    table, end = class_table(classed), class_lm.CLASSES - 1
    mass = np.zeros(class_lm.CLASSES)
    for r, word in zip(sorted(held.collect(), key=lambda r: r["doc_id"]), words, strict=True):
        cls = table[hash_of(word)][1]
        mass[cls] += 10 ** (r["score"] - model.transition[end, cls] - model.transition[cls, end])
    mass += 10**model.unknown / np.maximum(model.total, 1) * (mass > 0)
    np.testing.assert_allclose(mass[mass > 0], 1, rtol=1e-6)
    scored = [r for r in class_lm.score_documents(docs).collect() if r["held_out"]]
    assert sum(r["score"] for r in scored) > sum(r["base_score"] for r in scored)


@pytest.mark.parametrize("head", [0, 7, 1 << 18])
def test_language_model_against_brute_force(spark, head):
    texts = two_languages(spark)
    training = documents(spark, texts)
    model, classed = class_lm.fit_class_model(training, class_lm.count_words(training), head=head)
    table, end = class_table(classed), class_lm.CLASSES - 1
    counts = Counter(w for _, t in texts for w in low(t))
    # every word of the vocabulary has a class by its own count; the end is alone in its class
    assert {h: c for h, (c, _) in table.items() if h != hash_of_end()} == {hash_of(w): c for w, c in counts.items()}
    assert [h for h, (_, c) in table.items() if c == end] == [hash_of_end()] and table[hash_of_end()] == (len(texts), end)
    pairs = np.zeros((class_lm.CLASSES, class_lm.CLASSES))
    for _, t in texts:
        path = [end, *(table[hash_of(w)][1] for w in low(t)), end]
        np.add.at(pairs, (path[:-1], path[1:]), 1)
    np.testing.assert_allclose(model.transition, class_lm._smoothed(pairs))
    once, twice = (sum(c == k for c in counts.values()) for k in (1, 2))
    assert model.discount == (once / (once + 2 * twice) if once and twice else 0.5)
    types, total = Counter(c for h, (_, c) in table.items()), Counter()
    for c, cls in table.values():
        total[cls] += c

    def expected(text):
        score, before = 0.0, end
        for w in low(text):
            if hash_of(w) in table:
                c, cls = table[hash_of(w)]
                emission = math.log10(c - model.discount)
            else:
                cls = int(model.head.of_ending[class_lm.ending_groups([w])[0]])
                freed = model.discount * types[cls]
                emission = math.log10(freed) if freed else 0.0
            score += model.transition[before, cls] + emission - math.log10(max(total[cls], 1))
            before = cls
        return score + model.transition[before, end]

    new = [(1000, "unseen words only"), (1001, None), (1002, ""), (1003, "unseen unseen unseen " * 3000), (1004, texts[0][1] + " unseenen xx " + texts[1][1])]
    found = class_lm.score_texts(documents(spark, [*texts, *new]), classed, model, F.lit(False)).collect()
    for r, (_, text) in zip(sorted(found, key=lambda r: r["doc_id"]), [*texts, *new], strict=True):
        assert math.isclose(r["score"], expected(text), rel_tol=1e-9), r


def hash_of_end():
    return int(class_lm.END.reshape(1).view("i8")[0])


def test_scores_do_not_depend_on_the_head(spark):
    docs = documents(spark, [(i, f"{t} w{i} v{i % 7}") for i, t in two_languages(spark)])
    by_head = [{r["doc_id"]: r["score"] for r in class_lm.score_documents(docs, head=h).collect()} for h in (1, 600, 1 << 18)]
    for other in by_head[1:]:
        assert other.keys() == by_head[0].keys()
        assert all(math.isclose(other[k], v, rel_tol=1e-9) for k, v in by_head[0].items())


def test_words_move_to_the_class_of_their_neighbours(spark):
    """Words made up of chance letters start by their ending, then those of one language share classes."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    sides = [[word() for _ in range(900)], [word() for _ in range(900)]]
    texts = [(i, " ".join(rng.choice(sides[i % 2]) for _ in range(120))) for i in range(300)]
    training = documents(spark, texts)
    counted = class_lm.count_words(training)

    def mixed_share(sweeps):
        table = class_table(class_lm.fit_class_model(training, counted, sweeps=sweeps)[1])
        by_class = {}
        for side, words in enumerate(sides):
            for w in words:
                c, cls = table[hash_of(w.encode())]
                by_class.setdefault(cls, [0, 0])[side] += c
        return sum(min(v) for v in by_class.values()) / sum(sum(v) for v in by_class.values())

    assert mixed_share(class_lm.WORD_SWEEPS) < 0.5 * mixed_share(0)


def test_sweep_against_brute_force(spark, monkeypatch):
    """Every word moves by its own neighbours; the head's neighbours come in blocks, not in a row for each word and class."""
    monkeypatch.setattr(class_lm, "CONTEXT", 300)
    texts = [*two_languages(spark), (1000, None), (1001, "")]
    training, k = documents(spark, texts).repartition(3), class_lm.CLASSES
    words = class_lm.count_words(training)
    listing = class_lm.list_words(words, 400)  # more than the head
    numbered = class_lm.number_words(training, listing, F.lit(False)).cache()
    classed = words.select("word", "c", F.when(F.col("word") == hash_of_end(), k - 1).otherwise(F.pmod(F.xxhash64("word"), F.lit(k - 1))).cast("int").alias("class"))
    of_ending = np.arange(class_lm.ENDINGS) % (k - 1)
    head = class_lm.read_head(classed, class_lm.CONTEXT, of_ending)
    rows = class_lm.count_neighbours(numbered, listing, head).groupBy(F.spark_partition_id(), "block").count().where("block IS NOT NULL").collect()
    assert {r["count"] for r in rows} == {1} and {r["block"] for r in rows} == {0, 1}
    found = class_table(class_lm.sweep(numbered, listing, classed, head))
    table, listed = class_table(classed), set(head.words.view("i8").tolist())
    hashes = sorted(table)
    place = {h: i for i, h in enumerate(hashes)}
    near = np.zeros((len(hashes), 2 * k))
    for _, text in texts:
        path = [hash_of_end(), *map(hash_of, low(text))]
        seen = [table[h][1] if h in listed or h == hash_of_end() else int(of_ending[class_lm.ending_groups([w])[0]]) for h, w in zip(path, [b"", *low(text)])]
        for i, h in enumerate(path):
            near[place[h], seen[i - 1]] += 1
            near[place[h], k + seen[(i + 1) % len(path)]] += 1
    own = np.array([table[h][1] for h in hashes])
    pairs = np.zeros((k, k))
    np.add.at(pairs.T, own, near[:, :k])
    at, key = np.nonzero(near)
    best = class_lm.best_classes(own, at, key, near[at, key], pairs)
    assert found == {h: (table[h][0], int(c)) for h, c in zip(hashes, best)} and (best != own).any()


def test_language_model_without_training(spark):
    assert class_lm.score_documents(empty_documents(spark)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    row = class_lm.score_documents(documents(spark, [(only, "never seen")])).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0) and math.isfinite(row["score"])


def test_exchange_clusters_find_two_languages():
    rng = np.random.default_rng(2)
    table = np.zeros((41, 41))
    for _ in range(4000):
        side = rng.integers(0, 2) * 20
        path = [40, *(side + rng.integers(0, 20, 8)), 40]
        np.add.at(table, (path[:-1], path[1:]), 1)
    own = class_lm.exchange_clusters(table, classes=3)
    assert own[40] == 2 and len(set(own[:20])) == 1 and len(set(own[20:40])) == 1 and own[0] != own[20]


# -- 5 ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("max_bits", [1 << 15, exact_dedup.MAX_BITS])
@pytest.mark.parametrize("hot", [2, 1000])
def test_exact_duplicates(spark, max_bits, hot, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_GROUPS", hot)
    rows = [r for r in edge_rows()]
    rows += [(1000 + i, f"text {i % 9 if i % 2 else i}", None, None, 1, *("x" for _ in CLASHING)) for i in range(3000)]
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    expected = Counter()
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        expected.update((i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids)
    docs = spark.createDataFrame(rows, edge_documents(spark).schema).repartition(3)
    found = exact_dedup.exact_duplicates(docs, max_bits)
    assert Counter(tuple(r) for r in found.collect()) == expected


def test_bloom_passes_most_unique_rows(spark):
    rows = spark.range(20_000).select(F.col("id"), F.xxhash64("id").alias("a"), F.xxhash64(F.lit(1), "id").alias("b"))
    rows = rows.union(rows.where("id < 100"))
    found = exact_dedup.possibly_repeated(rows, 20_100, ("a", "b")).groupBy(F.col("id") < 100, "repeated").count().collect()
    counts = {(r[0], r[1]): r[2] for r in found}
    assert counts[True, True] == 200 and (True, False) not in counts
    assert counts.get((False, True), 0) < 1000


def test_drop_exact_duplicates(spark):
    docs = edge_documents(spark)
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert exact_dedup.exact_duplicates(empty_documents(spark)).count() == 0


# -- 6 ------------------------------------------------------------------------------------------

URLS = [
    None, "", "no scheme", "http://", "https://a.example.org/es/1", "https://EXAMPLE.org/es/1?x=/y", "http://example.org/ES/1", "http://notexample.org/es/",
    "http://a.b.com/fr/", "http://a.com/de/x#y", "http://a.com/dex", "http://x.com?/de/", "http://example.org/en/19", "http://example.org/en/2", "http://org/",
    "http://a.org", "http://shop.net/cart/1", "http://shop.net/carts/1", "http://ads.shop.net/x", "http://leads.net/x", "http://s.net/a/login", "http://s.net/?q=login",
    "ftp://x://y/z", "http://user@example.org/es/", "http://example.org:80/es/", "http://s.net/LOGIN/", "http://s.net/a-login.html", "x" * 100_000 + "://a.com/de/",
]


def plain_verdict(url):
    rest = (url or "").split("://", 1)[1] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({i: i + 32 for i in range(65, 91)})
    best = None
    for rule, verdict in (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")):
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    if best:
        return host, path, *best
    general = any(re.search(r.pattern, host + path) for r in url_filters.GENERAL)
    return host, path, None, "block" if general else "allow"


def test_url_filters(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)], "page_id long, url string, host string, token string").repartition(3)
    found = {r["page_id"]: tuple(r)[1:] for r in url_filters.judge_urls(pages).collect()}
    assert found == {i: plain_verdict(u) for i, u in enumerate(URLS)}
    assert found[16][3] == found[18][3] == found[20][3] == "block" and found[17][3] == found[19][3] == "allow"
    assert url_filters.judge_urls(pages.where("false")).count() == 0


def test_url_rules_are_filed_under_the_rarest_literal():
    rules = (url_filters.host_rule("block", "example.org/es/"), url_filters.Rule("any", "block", "x", ()))
    buckets, always = url_filters._index(rules, {"example": 9, "org": 5, "es": 7})
    assert [e for b in buckets for e in b] == [{"token": "org", "rules": [0]}] and always == [1]
    assert url_filters.host_rule("block", "example.org/en/1").literals == ("example", "org", "en")


# -- 7 ------------------------------------------------------------------------------------------


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_line_groups(spark):
    rng = random.Random(9)
    base = [" ".join(prose(rng, 60).split()) for _ in range(30)]
    texts = []
    for i in range(60):
        lines = [base[i % 30], prose(rng, 12).replace("\n", " ")]
        if i >= 30:
            lines[0] = lines[0].upper().replace(" ", "  ") + "!" if i % 2 else lines[0].replace(lines[0].split()[3], "thx", 1)
        texts.append((i, "\n".join([*lines, "too short"])))
    rows = line_dedup.line_groups(documents(spark, texts)).collect()
    norm = lambda x: re.sub(r"[\W_]+", " ", x.lower()).strip()
    held = {(i, k): norm(line) for i, t in texts for k, line in enumerate(t.split("\n")) if norm(line)}
    assert {(r["doc_id"], r["line_no"]) for r in rows} == held.keys()
    groups = defaultdict(list)
    for r in rows:
        groups[r["group_id"]].append(((r["doc_id"], r["line_no"]), r["kept"]))
    for members in groups.values():
        assert [k for k, kept in members if kept] == [min(k for k, _ in members)]
        first = held[min(k for k, _ in members)]
        assert all(10 * edit_distance(first, held[k]) <= 2 * max(len(first), len(held[k])) for k, _ in members)
    own = {k: r for r, members in groups.items() for k, _ in members}
    same = defaultdict(set)
    for k, line in held.items():
        same[line].add(own[k])
    assert all(len(g) == 1 for g in same.values())
    assert sum(own[i, 0] == own[i + 30, 0] for i in range(30) if (i + 30) % 2 == 0) >= 8  # one word of sixty changed


def near_line(rng, line, edits):
    """``line`` after so many changes of one character."""
    held = list(line)
    for _ in range(edits):
        i = rng.randrange(len(held))
        held[i : i + 1] = rng.choice([[], ["q"], [held[i], "z"]])
    return " ".join("".join(held).split())


def line_prints(spark, lines):
    """SimHash and clear bits of each line, restated: votes of the hashes of the halves of its words."""
    pieces = [[x for w in line.split() for x in ((1, w[: (len(w) + 1) // 2]), (2, w[len(w) // 2 :]))] for line in lines]
    distinct = sorted({x for p in pieces for x in p})
    hashed = spark.createDataFrame(distinct, "seed int, piece string").select("seed", "piece", F.xxhash64("seed", "piece").alias("h"))
    bits = {(r["seed"], r["piece"]): np.array([(r["h"] >> b) & 1 for b in range(64)]) for r in hashed.collect()}
    prints = []
    for held in pieces:
        votes, n = sum(bits[x] for x in held), len(held)
        clear = (votes > (n + (n / 2) ** 0.5) / 2) | (votes < (n - (n / 2) ** 0.5) / 2)
        prints.append((2 * votes > n, clear))
    return prints


def test_line_groups_by_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    lines = []
    for n in (8, 20, 40, 90) * 6:
        line = prose(rng, n).replace(".\n", " ")
        lines.append(line)
        for _ in range(rng.choice([1, 3, 12])):
            words = rng.choice(lines[-3:] if rng.random() < 0.3 else [line]).split()
            words[rng.randrange(len(words))] = prose(rng, 1)
            lines.append(" ".join(words))
    lines += [" ".join([w[1], w[0], *w[2:]]) for w in (x.split() for x in lines[:40])]  # the same SimHash and length
    lines = [x for x in dict.fromkeys(lines) if len(x) >= 20]
    prints, component = line_prints(spark, lines), list(range(len(lines)))
    near = 0
    for i, j in itertools.combinations(range(len(lines)), 2):
        longer = max(len(lines[i]), len(lines[j]))
        if 100 * min(len(lines[i]), len(lines[j])) < 95 * longer:
            continue
        differ = [int((x != y).sum()) for x, y in zip(prints[i], prints[j], strict=True)]
        if differ[0] <= 6 and sum(differ) <= 18 and edit_distance(lines[i], lines[j]) <= longer * 5 // 100:
            near += 1
            old, new = component[j], component[i]
            component = [new if c == old else c for c in component]
    expected = {tuple(i for i, c in enumerate(component) if c == k) for k in component}
    assert near > 100 and len(expected) < len(lines)

    def found():
        groups = defaultdict(list)
        for r in line_dedup.line_groups(documents(spark, list(enumerate(lines)))).collect():
            groups[r["group_id"]].append(r["doc_id"])
        return {tuple(sorted(g)) for g in groups.values()}

    assert found() == expected
    monkeypatch.setattr(line_dedup, "agreeing", lambda n: 3)  # as where lines are many
    assert found() == expected
    monkeypatch.setattr(line_dedup, "WIDE", 2)  # lists divided by length
    assert found() == expected
    monkeypatch.setattr(line_dedup, "HOT", 3)  # and lists that are not paired off
    monkeypatch.setattr(line_dedup, "ROUNDS", ((2, 1), (4, 2)))
    assert found() == expected


@pytest.mark.parametrize(("n_words", "share"), [(27, 0.8), (60, 0.85), (150, 0.9)])
def test_near_equal_lines_meet(spark, n_words, share):
    rng = random.Random(n_words)
    base = ["".join(prose(rng, n_words)).replace(".\n", " ") for _ in range(60)]
    swapped = [" ".join(w[:k] + ["the" + w[k]] + w[k + 1 :]) for w in (x.split() for x in base) for k in [rng.randrange(len(w))]]
    typed = [near_line(rng, x, 1) for x in base]
    pairs = [(a, b) for near in (swapped, typed) for a, b in zip(base, near, strict=True) if 100 * edit_distance(a, b) <= 5 * max(len(a), len(b))]
    texts = [(i, t) for i, t in enumerate(x for p in pairs for x in p)]
    group = {r["doc_id"]: r["group_id"] for r in line_dedup.line_groups(documents(spark, texts)).collect()}
    assert len(pairs) >= 60
    assert sum(group[2 * i] == group[2 * i + 1] for i in range(len(pairs))) >= share * len(pairs)


def test_groups_are_the_same_for_every_key_length(spark, monkeypatch):
    """Keys get longer where lines are many; what lies within the radius shares one all the same."""
    rng = random.Random(12)
    base = [prose(rng, n).replace(".\n", " ") for n in (12, 30, 60) * 8]
    docs = documents(spark, list(enumerate(base + [near_line(rng, x, 1) for x in base * 2]))).cache()
    groups = []
    for agree in (2, 3, 4):
        monkeypatch.setattr(line_dedup, "agreeing", lambda n, agree=agree: agree)
        groups.append(sorted(map(tuple, line_dedup.line_groups(docs).collect())))
    assert groups[0] == groups[1] == groups[2]
    assert len({r[2] for r in groups[0]}) < len(groups[0]) - 20


def test_groups_of_near_lines_are_not_paired_off(spark, monkeypatch):
    """A group is found from some of its lines: the comparisons follow its lines, not their pairs."""
    rng = random.Random(31)
    base = prose(rng, 90).replace(".\n", " ").split()
    lines = {" ".join([*base[:k], base[k] + rng.choice("bcdf"), *base[k + 1 :]]) for k in range(len(base))}
    compared, similar = [], line_dedup.similar_lines

    def counted(pairs):
        compared.append(pairs.count())
        return similar(pairs)

    monkeypatch.setattr(line_dedup, "similar_lines", counted)
    found = line_dedup.line_groups(documents(spark, list(enumerate(sorted(lines))))).collect()
    assert len(lines) >= 80 and len({r["group_id"] for r in found}) == 1
    assert sum(compared) <= 10 * len(lines)


@pytest.mark.parametrize("hot", [4096, 3])
def test_only_near_lines_are_worked_off(spark, monkeypatch, hot):
    """Lines that share keys but are near none by both fingerprints take no part in the rounds, however long their lists."""
    rng = random.Random(40)
    common = prose(rng, 60).replace(".\n", " ").split()
    lines = [" ".join(rng.sample(common, 50) + prose(rng, 12).replace(".\n", " ").split()) for _ in range(150)]
    lines += [near_line(rng, x, 1) for x in lines[:5]]
    ids = [r["id"] for r in spark.createDataFrame(list(enumerate(lines)), "i int, line string").orderBy("i").select(F.xxhash64("line").alias("id")).collect()]
    prints, near = line_prints(spark, lines), set()
    for i, j in itertools.combinations(range(len(lines)), 2):
        differ = [int((x != y).sum()) for x, y in zip(prints[i], prints[j], strict=True)]
        if differ[0] <= 6 and sum(differ) <= 18 and 100 * min(len(lines[i]), len(lines[j])) >= 95 * max(len(lines[i]), len(lines[j])):
            near |= {ids[i], ids[j]}
    worked, live = set(), line_dedup._live_lists

    def seen(entries, components):
        worked.update(r["line_id"] for r in entries.select("line_id").distinct().collect())
        return live(entries, components)

    monkeypatch.setattr(line_dedup, "_live_lists", seen)
    monkeypatch.setattr(line_dedup, "HOT", hot)
    line_dedup.line_groups(documents(spark, list(enumerate(lines)))).count()
    assert 10 <= len(near) < len(set(lines)) and worked == near


def test_very_long_lines(spark):
    rng = random.Random(3)
    line = prose(rng, 190_000).replace(".\n", " ")
    words = line.split()
    for _ in range(900):
        words[rng.randrange(len(words))] = "other"
    far = words[: len(words) // 2] + prose(rng, len(words) // 2).replace(".\n", " ").split()
    lines = [line, " ".join(words), " ".join(far)]
    assert min(map(len, lines)) > 800_000
    group = {r["doc_id"]: r["group_id"] for r in line_dedup.line_groups(documents(spark, list(enumerate(lines)))).collect()}
    assert group[0] == group[1] != group[2]


def test_long_lines_by_edit_distance(spark):
    rng = random.Random(8)
    base = prose(rng, 1200).replace(".\n", " ")
    words = base.split()
    assert len(base) > line_dedup.LONG
    spread = " ".join(["new", *(w + "z" if i % 10 == 0 else w for i, w in enumerate(words))])  # few characters of many words
    turned = " ".join(words[600:] + words[:600])  # the same words and, but for one, the same neighbours
    chinese = "".join(chr(0x4E00 + rng.randrange(2000)) for _ in range(4500))
    typed = "".join(chr(0x3042) if i % 50 == 0 else x for i, x in enumerate(chinese))  # one word each
    others = [spread, turned, " ".join(w + "zz" if i % 5 == 0 else w for i, w in enumerate(["new", *words]))]
    pairs = [(1, base, x) for x in others] + [(1, chinese, typed), (1, chinese, chinese[2250:] + chinese[:2250])]
    rows = spark.createDataFrame([(a, b, x, y) for b, (a, x, y) in enumerate(pairs)], "a long, b long, line_a string, line_b string")
    whole = rows.withColumn("edits", F.levenshtein("line_a", "line_b")).withColumn("chars", F.greatest(F.length("line_a"), F.length("line_b")))
    expected = {r["b"]: 100 * r["edits"] <= 5 * r["chars"] for r in whole.collect()}
    assert expected[0] and expected[3] and not expected[1] and not expected[4]
    assert {r["b"]: r["linked"] for r in line_dedup.similar_lines(rows).collect()} == expected
    group = {r["doc_id"]: r["group_id"] for r in line_dedup.line_groups(documents(spark, [(0, base), (1, turned)])).collect()}
    assert group[0] != group[1]


def test_longest_lines_by_edit_distance(spark):
    """Edits in many words link lines of any length; the same words in another order don't."""
    rng = random.Random(14)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(19_000)]
    spread = ["new", *(w + "z" if i % 80 == 0 else w for i, w in enumerate(words))]
    parts = [words[i : i + 100] for i in range(0, len(words), 100)]
    turned = [w for part in reversed(parts) for w in part]  # the same words, and almost the same neighbours
    lines = [" ".join(x) for x in (words, spread, turned)]
    assert min(map(len, lines)) > 1 << 17
    rows = spark.createDataFrame([(0, i, lines[0], lines[i]) for i in (1, 2)], "a long, b long, line_a string, line_b string")
    assert {r["b"]: r["linked"] for r in line_dedup.similar_lines(rows.repartition(2, "b")).collect()} == {1: True, 2: False}


def test_short_lines_and_scripts_without_spaces(spark, tmp_path):
    thai = "การเรียนรู้ของเครื่องเป็นสาขาหนึ่งของปัญญาประดิษฐ์ที่ศึกษาวิธีการ".replace("\u0e31", "")
    chinese = "我们今天在这里讨论如何从大量网页文本中删除重复的句子以便训练模型"
    texts = ["Read more!\n" + thai, "read  MORE\n" + chinese, chinese.replace("今天", "明天", 1) + "\nok", "OK\nread more\n...", thai + "\n..."]
    documents(spark, [(i, t) for i, t in enumerate(texts)]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {(r["doc_id"], r["line_no"]): (r["group_id"], r["kept"]) for r in QUERIES["op7_line_dedup"](spark, str(tmp_path)).collect()}
    assert rows.keys() == {(0, 0), (0, 1), (1, 0), (1, 1), (2, 0), (2, 1), (3, 0), (3, 1), (4, 0)}
    for same in ([(0, 0), (1, 0), (3, 1)], [(0, 1), (4, 0)], [(1, 1), (2, 0)], [(2, 1), (3, 0)]):
        assert len({rows[k][0] for k in same}) == 1 and [rows[k][1] for k in same] == [True] + [False] * (len(same) - 1)
    kept = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, documents(spark, [(i, t) for i, t in enumerate(texts)]), "").collect()}
    assert kept == {0: texts[0], 1: chinese, 2: "ok", 3: "...", 4: "..."}


def test_lines_of_repeated_rows(spark):
    rng = random.Random(21)
    lines = [prose(rng, 40).replace(".\n", " ") for _ in range(20)]
    near = [x.replace(x.split()[7], "then", 1) for x in lines]
    rows = [(i, x) for i, x in enumerate(lines) for _ in range(2 + i % 4)] + [(100 + i, x) for i, x in enumerate(near)]
    rows += [(None, x) for x in lines for _ in range(3)]
    found = line_dedup.line_groups(documents(spark, rows)).collect()
    group = {r["doc_id"]: r["group_id"] for r in found}
    assert len(found) == len(rows) and all(group[i] == group[100 + i] for i in range(20))
    assert all(r["kept"] == (r["doc_id"] is None or r["doc_id"] < 100) for r in found)
    sums = line_dedup.line_sums(documents(spark, rows))
    once = line_dedup.line_sums(documents(spark, [(i, x) for i, x in enumerate(lines + near)]))
    hashes = lambda frame: {r["line_id"]: r["simhash"] for r in line_dedup.line_hashes(frame).collect()}
    assert hashes(sums) == hashes(once)


def test_simhash_and_keys(spark):
    lines = [" ".join(prose(random.Random(i), n).replace(".", "").split()) for i, n in enumerate([8, 60, 127, 4095, 4096, 20_000])]
    frame = documents(spark, [*enumerate(lines), (9, lines[1] + "\n" + lines[4])])
    ids = {r["doc_id"]: r["id"] for r in frame.select("doc_id", F.xxhash64("text").alias("id")).collect()}
    found = {r["line_id"]: r for r in line_dedup.line_hashes(line_dedup.line_sums(frame)).collect()}
    for i, prints in enumerate(line_prints(spark, lines)):
        for name, bits in zip(("simhash", "clear"), prints, strict=True):
            assert found[ids[i]][name] & (2**64 - 1) == sum(1 << b for b in range(64) if bits[b])
    for agree in (2, 3, 4):  # any six bits may differ, the first shared key is one key
        signed = lambda x: x - 2**64 if x >> 63 else x
        flips = [(signed(7 << 60), signed((7 << 60) ^ sum(1 << b for b in random.Random(i).sample(range(64), i % 7)))) for i in range(70)]
        frame = spark.createDataFrame(sorted(set(flips)), "a long, b long")
        keys = frame.select("a", "b", F.explode(line_dedup.block_keys(F.col("a"), agree)).alias("k"), line_dedup.block_keys(F.col("b"), agree).alias("other"))
        first = F.array_contains("other", F.col("k")) & line_dedup._first_shared(F.col("a").bitwiseXOR(F.col("b")), line_dedup._last_block(F.col("k"), agree), agree)
        counts = keys.groupBy("a", "b").agg(F.count_if(first).alias("n")).select("n").distinct().collect()
        assert [r["n"] for r in counts] == [1]


def test_drop_repeated_lines_edges(spark):
    docs = edge_documents(spark)
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns
    rows = {(r["doc_id"], r["source"]): r for r in kept.collect()}
    assert {r[0] for r in edge_rows()} - {k[0] for k in rows} <= {4, 8, 9, 12, -3}  # their lines stand once
    given = {(r[0], r[3]): r for r in edge_rows()}
    for key, row in rows.items():
        lines = [] if given[key][1] is None else given[key][1].split("\n")
        assert set((row["text"] or "").split("\n")) <= {*lines, ""}
        assert row["n_chars"] == (None if row["text"] is None else len(row["text"]))
    assert line_dedup.drop_repeated_lines(empty_documents(spark)).count() == 0


# -- 8 ------------------------------------------------------------------------------------------


def filled(sizes, share=1.5, weights=(5, 2, 1), most=2):
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    rest, open_, target = share * sum(sizes.values()), set(order), {}
    while open_:
        level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if level[s] > most * sizes[s]]
        if not over:
            return target | level
        for s in over:
            target[s] = most * sizes[s]
            rest -= target[s]
            open_.remove(s)
    return target


def test_mixing_edges(spark):
    found = mixing.mix_documents(edge_documents(spark)).collect()
    sizes = Counter()
    for r in edge_rows():
        sizes[r[3]] += len(words(r[1]))
    target = filled(sizes)
    source = {(r[0], len(words(r[1]))): r[3] for r in edge_rows() if r[0] is not None}
    assert len(found) == len(edge_rows())
    taken = Counter()
    for r in found:
        assert 0 <= r["taken"] <= 2 * r["size"]
        if r["doc_id"] is not None:
            s = source[r["doc_id"], r["size"]]
            assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s])
        taken[r["source_size"]] += r["taken"]
    for s, n in sizes.items():
        assert abs(taken[n] - sum(target[x] for x in sizes if sizes[x] == n)) < 2 * len(sizes)
    assert sorted(map(tuple, mixing.mix_documents(edge_documents(spark)).collect()), key=str) == sorted(map(tuple, found), key=str)
    assert mixing.mix_documents(empty_documents(spark)).count() == 0


def test_repeated_documents_hold_what_was_taken(spark):
    docs = edge_documents(spark)
    mixed = mixing.repeat_documents(docs)
    assert mixed.columns == docs.columns
    plain = lambda rows: Counter({k: v for k, v in rows.items() if v})
    given = Counter()
    for r in mixing.mix_documents(docs).collect():
        given[r["doc_id"]] += r["taken"]
    found = Counter()
    for r in mixed.collect():
        found[r["doc_id"]] += len(words(r["text"]))
    assert plain(found) == plain(given)
    assert mixing.repeat_documents(empty_documents(spark)).count() == 0


# -- 9 ------------------------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    net = byte_gru.new_network(3, 4)
    for d in (net.forward, net.backward):
        d.table, d.recurrent, d.out = (x.astype("f8") for x in (d.table, d.recurrent, d.out))
    net.bias = net.bias.astype("f8")
    windows, labels = rng.integers(97, 101, (5, 7)).astype("u1"), rng.integers(0, 3, 5)
    _, found = byte_gru.gradients(net, windows, labels)
    for p, g in zip(net.parameters(), found, strict=True):
        for _ in range(4):
            at = tuple(98 if s == 256 else rng.integers(0, s) for s in p.shape)
            old, sides = p[at], []
            for step in (1e-3, -1e-3):
                p[at] = old + step
                sides.append(byte_gru.gradients(net, windows, labels)[0])
            p[at] = old
            assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(g[at], abs=2e-5)


def test_labels_cover_whole_texts():
    net = byte_gru.new_network(3)
    text = bytes(range(97, 122)) * 20
    one = language_id.document_probabilities(net, [text, b"", b"abc"], width=512)
    np.testing.assert_allclose(one[[0, 2]].sum(1), 1, rtol=1e-5)
    assert not one[1].any()
    alone = byte_gru.label_windows(net, np.frombuffer(b"abc" + bytes(9), "u1").reshape(1, -1), np.array([3]))
    np.testing.assert_allclose(alone / 3, one[[2]], rtol=1e-4)


def test_language_identification(spark):
    rng = random.Random(6)
    texts = [(i, prose(rng, 60, "de" if i % 2 else "en"), "de" if i % 2 else "en", "a") for i in range(120)]
    found = language_id.identify_languages(documents(spark, texts), steps=60).collect()
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == texts[r["doc_id"]][2] for r in held) / len(held) > 0.9
    edge = {(r["doc_id"], r["lang_pred"]): r["score"] for r in language_id.identify_languages(edge_documents(spark), steps=5).collect()}
    assert {i for (i, pred), _ in edge.items() if pred == "und"} == {0, 1, 2, 7, None} and all(0 <= s <= 1 for s in edge.values())
    assert language_id.identify_languages(empty_documents(spark)).count() == 0
    unknown = language_id.identify_languages(documents(spark, [(1, "some text")])).first()
    assert (unknown["lang_pred"], unknown["score"]) == ("und", 0)


# -- 10 -----------------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    times, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


REPEATS = ["a b c d e f g h i " * 5, "x " * 40, "l1 a b\nl1 a b\n \n\n#$%", "\n\n", "w1 w2 w3 w4 w5 w6 w7 w8 z w1 w2 w3 w4 w5 w6 w7 w8 w9"]


def test_quality_counts(spark):
    rows = [(r[0], r[1], r[2], r[3]) for r in edge_rows()] + [(500 + i, t, "en", "a") for i, t in enumerate(REPEATS)]
    found = quality.judge_quality(documents(spark, rows)).collect()
    key = lambda i, counts, failed: (i, *counts, failed)
    expected = Counter()
    for i, t, *_ in rows:
        c = plain_counts(t)
        expected[key(i, c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert Counter(key(r["doc_id"], [r[c] for c in quality.COUNTS], r["base_failed"]) for r in found) == expected
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_thresholds_follow_the_group(spark):
    rng = random.Random(12)
    rows = []
    for i in range(900):
        marks = {"a": "| ", "b": ""}["ab"[i % 2]] * 12  # marks are usual in one source, not in the other
        rows.append((i, marks + prose(rng, 60), "en", "ab"[i % 2]))
    rows.append((1000, "| " * 12 + prose(rng, 60), "en", "b"))
    rows.append((1001, "| " * 12 + prose(rng, 60), "en", "a"))
    rows.append((1002, "| " * 60 + prose(rng, 60), "en", None))  # a small group is judged by its language
    kept = {r["doc_id"]: r["kept"] for r in quality.judge_quality(documents(spark, rows)).collect()}
    assert all(kept[i] for i in range(900)) and not kept[1000] and kept[1001] and not kept[1002]


def test_each_metric_rejects_a_planted_outlier(spark):
    plain = lambda i: " ".join(f"w{chr(97 + j % 26)}{chr(97 + i % 26)}{chr(97 + j // 26)}" for j in range(200)).split()
    lines = lambda w: "\n".join(" ".join(w[i : i + 10]) for i in range(0, len(w), 10))
    w = plain(3)
    outliers = {
        "symbol_ratio": lines(w) + " " + "#" * 24,
        "upper_ratio": lines([x[0].upper() + x[1:] if i % 2 else x for i, x in enumerate(w)]),
        "repeat_ratio": lines(w[:175] + w[10:35]),
        "dup_line_ratio": "\n".join([lines(w), *["a b c"] * 16]),
        "stutter_ratio": lines([x for i, x in enumerate(w) for x in [x] * (1 + (i % 5 == 0))]),
        "word_length": lines([x + "zz" for x in w]),
    }
    rows = [(i, lines(plain(i)), "en", "a") for i in range(400)] + [(1000 + i, t, "en", "a") for i, t in enumerate(outliers.values())]
    found = {r["doc_id"]: r for r in quality.judge_quality(documents(spark, rows)).collect()}
    assert all(found[i]["kept"] for i in range(400))
    assert not any(found[1000 + i]["base_failed"] for i in range(len(outliers)))
    assert [m for i, m in enumerate(outliers) if found[1000 + i]["kept"]] == []
    assert set(outliers) == set(quality.METRICS)


def test_rejection_keeps_what_is_judged_good(spark):
    docs = edge_documents(spark)
    kept = quality.reject_low_quality(docs)
    assert kept.columns == docs.columns
    good = Counter(r["doc_id"] for r in quality.judge_quality(docs).collect() if r["kept"])
    assert Counter(r["doc_id"] for r in kept.collect()) == good and len(good) > 30
    assert quality.reject_low_quality(empty_documents(spark)).count() == 0
    assert quality.judge_quality(empty_documents(spark)).count() == 0


def plain_limit(values):
    """Third quartile and three spreads, of the sorted values themselves."""
    at = lambda q: float(np.quantile(values, q, method="inverted_cdf"))
    spans = [at(0.75) - at(0.25), at(0.9) - at(0.75), at(0.99) - at(0.75)]
    return math.ceil(round((at(0.75) + 3 * next((s for s in spans if s > 0), 0.0)) * 1000, 9)) / 1000


def test_limits_and_verdicts_by_brute_force(spark):
    """Fewer rows than a sketch keeps: its quantiles are exact."""
    rng = random.Random(21)
    rows = []
    for i in range(500):
        lines = prose(rng, rng.randint(30, 90)).split("\n")
        lines += rng.choices(lines, k=rng.choice([0] * 16 + [1, 1, 2, 6]))
        text = "\n".join(lines) + " #" * rng.choice([0] * 12 + [1, 1, 2, 3, 9]) + " Xx XX" * rng.choice([0, 0, 1, 4])
        rows.append((i, text, "en", "ab"[i % 2]))
    found = [r.asDict() for r in quality.quality_metrics(documents(spark, rows)).collect()]
    verdicts = {r["doc_id"]: r["kept"] for r in quality.judge_quality(documents(spark, rows)).collect()}
    limits = {s: {m: plain_limit([r[m] for r in found if r["source"] == s and not r["base_failed"]]) for m in quality.METRICS} for s in "ab"}
    learned = {r["source"]: r for r in quality.learn_thresholds(quality.quality_metrics(documents(spark, rows))).collect()}
    for source in "ab":
        assert all(abs(learned[source][f"max_{m}"] - limits[source][m]) < 1e-9 for m in quality.METRICS)
    more = lambda r, m, of: of is None or r[m] * r[of] > 1.5
    failed = {r["doc_id"] for r in found if r["base_failed"] or any(r[m] > limits[r["source"]][m] and more(r, m, of) for m, of in quality.METRICS.items())}
    assert {i for i, kept in verdicts.items() if not kept} == failed and 0 < len(failed) < 200


def test_one_symbol_or_one_repeated_line_is_no_reason(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = quality.judge_quality(docs).where("NOT kept AND NOT base_failed").collect()
    learned = {(r["lang"], r["source"]): r for r in quality.learn_thresholds(quality.quality_metrics(docs)).collect()}
    measured = {r["doc_id"]: r for r in quality.quality_metrics(docs).collect()}
    for row in rows:
        r = measured[row["doc_id"]]
        over = [m for m in quality.METRICS if r[m] > learned[r["lang"], r["source"]][f"max_{m}"]]
        assert any(quality.METRICS[m] is None or r[m] * r[quality.METRICS[m]] > 1.5 for m in over)
    assert 0 < len(rows) < 130


@pytest.mark.parametrize("counts, capacity", [({10: 1, 5: 2, 4: 2}, 20), ({11: 1, 5: 1, 4: 3}, 20)])
def test_sets_of_three_are_fixed(counts, capacity):
    left = Counter(counts)
    fixed = packing.reduce_instance(left, capacity)
    assert any(len(held) == 3 for _, held in fixed)
