"""Exact Jaccard join of word-shingle sets, and the groups that its links form.

Equal sets are one set. A coarse index over the smallest hashes of every set drops the sets that
share too little with all others. Of those that remain, every token's number of sets is counted, and
each set is indexed by its rarest tokens (prefix filter). An index list keeps its sets in blocks
of equal size and position: a probe reads a block's header and skips all of it if size and
position already rule a match out.

Lists are worked off in rounds, from a few probe sets each, of different groups as far as there are; the first takes one probe a list. Sets that are linked already, by whatever path, need
no comparison. In later rounds, parities of each set's tokens go along in a bitmap: two bitmaps differ in no more bits than the sets do in tokens, so
most sets that are almost similar are told apart within the list, without a row for the pair. And where a probe is similar to an earlier one, its answers are bounded by those
computed before: |x ∩ y| <= min(|x ∩ p|, |p ∩ y|) + min(|x - p|, |y - p|). So a group of near copies is
found from a few of its sets and never paired off, and no link between groups is lost.

Shingles are 64-bit hashes, sets are known by 64 bits of a digest. Null and empty texts have no shingle and are linked
with nothing; a text with fewer words than a shingle is one shingle. Rows with a null id are linked with
nothing. Repeated rows are equal sets. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, parallelism, written
from millrace.llm.components import merge_links
from millrace.llm.text import chunks, lowered, mixed, shingle_hashes, word_hashes

SHINGLE = 5
PERCENT = 75  # similarity: 100 * intersection >= PERCENT * union
COARSE_PERCENT = 15  # of a set: tokens that the coarse index wants shared among the smallest hashes
BUCKET_TOKENS = 1_500_000  # of an index bucket, which one task sorts
# By round: a list with at most so many sets outside its largest group is finished by them, a longer one gets so many
# probes. Linked sets are not paired, and few probes leave few sets of a large group unlinked; so each round takes some eight
# times the probes of the one before, and no list is finished by more probes than a round gives it.
ROUNDS = ((2, 1), (16, 16), (128, 128), (1024, 1024))
PARITIES = 1024  # bits of a set's bitmap
BLOCK = 1000  # sets in a block, about
BROADCAST_IDS = 2_000_000  # 16 MB


# -- sets -----------------------------------------------------------------------------------------


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(lowered(texts))
    sets = []
    for words in np.split(hashes, np.cumsum(counts)[:-1]):
        sets.append(np.unique(shingle_hashes(words, min(size, len(words)))) if len(words) else np.empty(0, "u8"))
    return sets


def _set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) >> 1


def _ceil_percent(n, percent: int):
    return -(-n * percent // 100)


def _least_overlap(n):
    """The least intersection of a set of ``n`` with any similar set; also that set's least size."""
    return _ceil_percent(n, PERCENT)


def _coarse_shared(n):
    return np.maximum(1, _ceil_percent(n, COARSE_PERCENT))


def _coarse_needed(n):
    """Tokens of its coarse prefix that a set of ``n`` shares with any similar set.

    Of a pair's common tokens, at most ``overlap - shared`` of a set's own lie outside its prefix; so the
    pair has in both prefixes the lesser of their ``shared``, and the partner is no smaller than the overlap.
    """
    return _coarse_shared(_least_overlap(n))


def _coarse_prefix(n):
    return n - _least_overlap(n) + _coarse_shared(n)


def read_sets(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, the number ``n`` of its shingles and its set's id ``sid`` (null if empty)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sets = shingle_sets(batch.column(1), size)
            ids = pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), ids], names=["doc_id", "n", "sid"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(read, "doc_id long, n long, sid long")


# -- the index: which tokens do sets share? ----------------------------------------------------


def _bucketed(sets: dict[int, np.ndarray], buckets: int) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Tokens by bucket: (bucket, set ids, tokens of each, tokens)."""
    if not sets:
        return
    ids = np.fromiter(sets, "i8", len(sets))
    counts = np.array([len(s) for s in sets.values()], "i8")
    tokens, owner = np.concatenate(list(sets.values())), np.repeat(np.arange(len(ids)), counts)
    bucket = (tokens % np.uint64(buckets)).astype("i4")  # prefixes are cut by the high bits
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        part = order[edges[b] : edges[b + 1]]
        owners, firsts, n = np.unique(owner[part], return_index=True, return_counts=True)
        yield b, ids[owners].tobytes(), n.astype("i4").tobytes(), tokens[part].tobytes()


def _joined(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _shared_in_bucket(table: pa.Table, parts: int, with_tokens: bool) -> pa.Table:
    """Of one bucket, the tokens of more than one set: by the part that a set falls to, set ids, how many tokens of
    each, the tokens and their numbers of sets."""
    tokens = _joined(table, "tokens", "u8")
    ids = np.repeat(_joined(table, "sids", "i8"), _joined(table, "counts", "i4"))
    order = np.lexsort((ids, tokens))
    tokens, ids = tokens[order], ids[order]
    new = np.r_[True, (tokens[1:] != tokens[:-1]) | (ids[1:] != ids[:-1])][: len(tokens)]
    tokens, ids = tokens[new], ids[new]  # copies of a set from several tasks
    starts = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]][: len(tokens)])
    lengths = np.diff(np.append(starts, len(tokens)))
    sharing = np.repeat(lengths, lengths)
    kept = sharing > 1
    tokens, ids, sharing = tokens[kept], ids[kept], sharing[kept].astype("i4")
    part = ids % parts
    order = np.lexsort((ids, part))
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    out = []
    for p in np.flatnonzero(np.diff(edges)).tolist():
        at = order[edges[p] : edges[p + 1]]
        owners, n = np.unique(ids[at], return_counts=True)
        held = (tokens[at].tobytes(), sharing[at].tobytes()) if with_tokens else (b"", b"")
        out.append((p, owners.tobytes(), n.astype("i4").tobytes(), *held))
    kinds = (pa.int32(), *[pa.binary()] * 4)
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["part", "sids", "counts", "tokens", "sharing"])


def _by_set(table: pa.Table) -> pa.Table:
    """Of one part: a row for each set with what all buckets say of it."""
    ids, n = _joined(table, "sids", "i8"), _joined(table, "counts", "i4").astype("i8")
    owners, place = np.unique(ids, return_inverse=True)
    shared = np.bincount(place, n, len(owners)).astype("i8")
    tokens, sharing = _joined(table, "tokens", "u8"), _joined(table, "sharing", "i4")
    order = np.argsort(np.repeat(place, n), kind="stable") if len(tokens) else np.empty(0, "i8")
    tokens, sharing, ends = tokens[order], sharing[order], np.cumsum(shared) if len(tokens) else np.zeros(len(owners), "i8")
    begins = np.append(0, ends[:-1])[: len(ends)]
    cut = [pa.array([x[a:b].tobytes() for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.binary()) for x in (tokens, sharing)]
    return pa.Table.from_arrays([pa.array(owners), pa.array(shared), *cut], names=["sid", "shared", "tokens", "sharing"])


def _shared_tokens(rows: DataFrame, sets_of: Callable[[pa.RecordBatch], dict[int, np.ndarray]], total: int, with_tokens: bool) -> DataFrame:
    """``sid``, its number of ``shared`` tokens and, if asked for, those tokens and their numbers of sets.

    Equal sets of a batch go out once, so that many copies of a set do not meet in a bucket.
    """
    buckets = max(parallelism(rows.sparkSession), -(-total // BUCKET_TOKENS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = list(_bucketed(sets_of(batch), buckets))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "sids", "counts", "tokens"])

    def shared(table: pa.Table) -> pa.Table:
        return _shared_in_bucket(table, buckets, with_tokens)

    dealt = rows.mapInArrow(deal, "bucket int, sids binary, counts binary, tokens binary")
    found = dealt.groupBy("bucket").applyInArrow(shared, "part int, sids binary, counts binary, tokens binary, sharing binary")
    return found.groupBy("part").applyInArrow(_by_set, "sid long, shared long, tokens binary, sharing binary")


def coarse_survivors(docs: DataFrame, sets: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``sid, n, doc_id`` (one of its documents) of every set that may have a similar one."""

    def prefixes(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        return {_set_id(s): s[: _coarse_prefix(len(s))] for s in shingle_sets(batch.column(0), size) if len(s)}

    total = sets.agg(F.sum("n")).first()[0] or 0
    classes = sets.where("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"))
    shared = _shared_tokens(docs.select("text"), prefixes, total // 2, with_tokens=False).select("sid", "shared")
    needed = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * PERCENT / 100) * COARSE_PERCENT / 100))
    return written(shared.join(classes, "sid").where(F.col("shared") >= needed).select("sid", "n", "doc_id"), "join-survivors")


def parities(tokens: np.ndarray) -> np.ndarray:
    """A bitmap (64-bit numbers): by a token's remainder, whether the set has an odd number of such tokens."""
    odd = np.bincount((tokens % np.uint64(PARITIES)).astype("i8"), minlength=PARITIES) & 1
    return np.packbits(odd.astype("u1")).view("i8")


def survivor_sets(docs: DataFrame, survivors: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``sid, n``, the sorted shingles (64-bit numbers) and the ``parities`` of each surviving set."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = {_set_id(s): s for s in shingle_sets(batch.column(0), size) if len(s)}
            columns = [pa.array(list(found), pa.int64()), pa.array([len(s) for s in found.values()], pa.int64()), pa.array([s.tobytes() for s in found.values()], pa.binary())]
            bitmaps = pa.array([parities(s) for s in found.values()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*columns, bitmaps], names=["sid", "n", "tokens", "parities"])

    ids = broadcast_if_small(survivors.select("doc_id"), BROADCAST_IDS)
    found = docs.select(F.col("doc_id").cast("long"), "text").join(ids, "doc_id", "left_semi").select("text")
    rows = found.mapInArrow(read, "sid long, n long, tokens binary, parities array<long>")
    # repeated rows and other texts of the same id bring further sets: one row for each that survived
    return written(rows.join(survivors.select("sid"), "sid", "left_semi").dropDuplicates(["sid"]), "join-sets")


def index_entries(sets: DataFrame) -> DataFrame:
    """The index: ``token``, ``sid``, ``n`` and the token's position, for the prefix of each set, rarest tokens first.

    Tokens of no other set come first and are only counted: a set with too many of them has no match.
    """

    def whole(batch: pa.RecordBatch) -> dict[int, np.ndarray]:
        return {sid: np.frombuffer(t, "u8") for sid, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)}

    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = _shared_tokens(sets.select("sid", "tokens"), whole, total, with_tokens=True).join(sets.select("sid", "n"), "sid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[list] = [[], [], [], []]
            for sid, n, tokens, sharing in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                tokens, sharing = np.frombuffer(tokens, "u8"), np.frombuffer(sharing, "i4")
                position = np.arange(len(tokens)) + n - len(tokens)  # after the tokens of this set alone
                prefix = position <= n - _least_overlap(n)
                order = np.lexsort((tokens, sharing))[prefix]
                for column, values in zip(out, (tokens[order].view("i8"), np.full(len(order), sid), np.full(len(order), n), position[prefix]), strict=True):
                    column.append(values)
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, names=["token", "sid", "n", "at"])

    found = shared.select("sid", "n", "tokens", "sharing").mapInArrow(cut, "token long, sid long, n long, at long")
    return written(found, "join-index")


# -- the join ---------------------------------------------------------------------------------


def _similar_size(a: Column, b: Column) -> Column:
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def _may_match(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether sizes allow it and, if these are the first common tokens, enough of both sets follows."""
    most = F.least(n_a - at_a, n_b - at_b)
    return _similar_size(n_a, n_b) & _enough(most, n_a, n_b)


def _enough(overlap: Column, n_a: Column, n_b: Column) -> Column:
    return (100 + PERCENT) * overlap >= PERCENT * (n_a + n_b)


def _may_be_similar(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """Whether bitmaps allow it: they differ in at most as many bits as the sets do in tokens. Without bitmaps it may be."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, x: n + x)
    return F.coalesce((100 + PERCENT) * (n_a + n_b - differ) >= 2 * PERCENT * (n_a + n_b), F.lit(True))


def _blocks(entries: DataFrame, longest: int) -> DataFrame:
    """Lists in blocks of equal size and position, each of a bounded number of sets."""
    parts = -(-longest // BLOCK)
    grouped = entries.groupBy("token", "n", "at", F.pmod("sid", F.lit(parts)).alias("part"))
    return grouped.agg(F.collect_list(F.struct("sid", "component", "parities")).alias("held"))


def live_lists(entries: DataFrame, components: DataFrame) -> DataFrame:
    """``entries`` of lists whose sets are not all linked yet, with each set's component, the list's largest, its
    ``length`` and the number of sets ``outside`` the largest."""
    labelled = entries.join(components.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    groups = labelled.groupBy("token", "component").agg(F.count(F.lit(1)).alias("held"))
    lists = groups.groupBy("token").agg(F.sum("held").alias("length"), F.max("held").alias("most"), F.max_by("component", "held").alias("largest"))
    lists = lists.where("most < length").select("token", "length", "largest", (F.col("length") - F.col("most")).alias("outside"))
    return labelled.join(lists, "token")


def probes_of(live: DataFrame, limit: int, probes_each: int) -> DataFrame:
    """Members of lists to compare with all others: all outside the largest group if they are few, else the
    smallest of each of a few slots. What is linked to none of its list's groups leaves the list then."""
    slot = F.when(F.col("outside") <= limit, F.col("sid")).otherwise(F.pmod(F.xxhash64("sid"), F.lit(probes_each)))
    chosen = live.where("component <> largest").groupBy("token", slot.alias("slot"))
    return chosen.agg(F.min(F.struct("n", "sid", "at", "component", "parities")).alias("p")).select("token", "p.*")


def candidate_pairs(live: DataFrame, probes: DataFrame, longest: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of unlinked sets to compare: each probe with the blocks of its list that may hold a match."""
    blocks = _blocks(live, longest).withColumnsRenamed({"n": "n_b", "at": "at_b"})
    met = probes.join(blocks, "token").where(_may_match(F.col("n"), F.col("at"), F.col("n_b"), F.col("at_b")))
    unlinked = F.filter("held", lambda x: (x["component"] != F.col("component")) & _may_be_similar(x["parities"], F.col("parities"), F.col("n"), F.col("n_b")))
    pairs = met.select(F.col("sid").alias("x"), F.col("n").alias("n_x"), "n_b", F.explode(F.transform(unlinked, lambda x: x["sid"])).alias("y"))
    first = F.col("x") < F.col("y")
    pairs = pairs.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.when(first, F.col("n_x")).otherwise(F.col("n_b")).alias("n_a"), F.when(first, F.col("n_b")).otherwise(F.col("n_x")).alias("n_b")
    )
    return pairs.distinct()


def without_answered(pairs: DataFrame, answers: DataFrame) -> DataFrame:
    """Pairs that were not compared yet and that no computed answers rule out.

    ``answers`` (a, b, n_a, n_b, common). If the set most similar to one of a pair, p, was compared with the other, too,
    what the pair has in common lies within p as far as both do, and outside it as far as both do.
    """
    fresh = pairs.join(answers.select("a", "b"), ["a", "b"], "left_anti")
    sides = answers.select(F.col("a").alias("s"), F.col("b").alias("p"), "common").union(answers.select(F.col("b"), F.col("a"), F.col("common")))
    nearest = sides.groupBy("s").agg(F.max(F.struct("common", "p")).alias("near"))  # one for each set

    def ruled_out(x: str, y: str) -> DataFrame:
        near = nearest.select(F.col("s").alias(x), F.col("near.p").alias("p"), F.col("near.common").alias("common_x"))
        known = sides.select(F.col("s").alias(y), "p", F.col("common").alias("common_y"))
        outside = F.least(F.col(f"n_{x}") - F.col("common_x"), F.col(f"n_{y}") - F.col("common_y"))
        bound = F.least("common_x", "common_y") + outside
        return fresh.join(near, x).join(known, [y, "p"]).where(~_enough(bound, F.col("n_a"), F.col("n_b"))).select("a", "b")

    return fresh.join(ruled_out("a", "b").union(ruled_out("b", "a")).distinct(), ["a", "b"], "left_anti")


def compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the number of ``common`` shingles."""

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            common = [
                len(np.intersect1d(np.frombuffer(x, "u8"), np.frombuffer(y, "u8"), assume_unique=True))
                for x, y in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(common, pa.int64())], names=["a", "b", "n_a", "n_b", "common"])

    held_b = sets.select(F.col("sid").alias("b"), F.col("tokens").alias("tokens_b"))
    held_a = sets.select(F.col("sid").alias("a"), F.col("tokens").alias("tokens_a"))
    joined = pairs.join(held_b, "b").join(held_a, "a").select("a", "b", "n_a", "n_b", "tokens_a", "tokens_b")
    return joined.mapInArrow(intersect, "a long, b long, n_a long, n_b long, common long")


def linked_sets(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``sid`` and ``component`` (its smallest sid) of every linked set, and all answers (a, b, n_a, n_b, common)."""
    spark = sets.sparkSession
    entries = index_entries(sets).withColumn("parities", F.lit(None).cast("array<long>"))  # most lists need no second round
    answers = spark.createDataFrame([], "a long, b long, n_a long, n_b long, common long")
    components = spark.createDataFrame([], "node long, component long")
    for number in count():
        limit, probes_each = ROUNDS[min(number, len(ROUNDS) - 1)]
        live = written(live_lists(entries, components), "join-live")
        longest = live.agg(F.max("length")).first()[0]
        if not longest:
            return components.withColumnRenamed("node", "sid"), answers
        probes = written(probes_of(live, limit, probes_each), "join-probes")
        met = written(candidate_pairs(live, probes, longest), "join-met")  # each pair once from here on, of however many lists
        pairs = written(without_answered(met, answers), "join-pairs")
        if pairs.limit(1).count():
            compared = written(compare(pairs, sets), "join-answers")
            components = merge_links(components, compared.where(_enough(F.col("common"), F.col("n_a"), F.col("n_b"))))
            answers = written(answers.unionByName(compared), "join-answers")
        left = live.where(F.col("outside") > limit).join(probes.select("token", "sid"), ["token", "sid"], "left_anti")
        entries = written(left.select("token", "sid", "n", "at").join(sets.select("sid", "parities"), "sid"), "join-left")


def near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` for each document."""
    sets = written(read_sets(docs, size), "join-read")
    survivors = coarse_survivors(docs, sets, size)
    components, _ = linked_sets(survivor_sets(docs, survivors, size))
    # documents of one set and of linked sets: through the smallest document of each
    grouped = sets.where("sid IS NOT NULL AND doc_id IS NOT NULL").groupBy("sid").agg(F.min("doc_id").alias("least"))
    grouped = grouped.join(components, "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    least = grouped.groupBy("component").agg(F.min("least").alias("component_id"))
    by_set = grouped.join(least, "component").select("sid", "component_id")
    joined = sets.join(by_set, "sid", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return joined.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows with a null id stay."""
    found = near_duplicates(docs, size).where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
