"""A trie of the turns that conversations begin with, with sums over every subtree.

A node is a sequence of first turns; its key is a hash of 107 bits of that sequence, taken in a scan over
the turns in order, whose partitions hand each other the state they end with. So a
conversation of any length may lie across tasks. Sums go up in depth bands: a node explodes to its ancestors within
its band of ``BAND`` levels alone; the roots of the bands are a trie of their own, a ``BAND``-th as deep, which is rolled up
the same way; what it completes is handed on to the ancestors in the band above each root. A trie
of depth d takes log(d) / log(BAND) rounds, and a node goes to at most ``BAND`` ancestors in each.

Turns go by ``turn``, null first, those of one number by a hash of role and text. Null role or text counts as empty; repeated
rows are turns of their own, since their order cannot matter. Rows without a conversation are in none and left
out. An empty table gives an empty table; other columns are ignored. Texts are hashed whole, of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import join_unique, ship_package, word_count, written

BAND = 32
ENDS_AT_ONCE = 8  # bits of a conversation's number: so many ends are joined at once
BROADCAST_PARENTS = 500_000
SHARED_AMONG = 20
MOST_SHARED = 3

_PRIME = (1 << 107) - 1
_FACTOR = 0x5851F42D4C957F2D14057B7EF767814F % _PRIME
_START = 1  # hash of no turns
_LOW = (1 << 63) - 1
KEY = ["hi", "lo"]
RANKED = "part int, conv_id long, n long, hi long, lo long, words long"
POSITIONS = "conv_id long, depth long, hi long, lo long, words long"


def _halves(key: int) -> tuple[int, int]:
    return key >> 63, key & _LOW


# -- turns ----------------------------------------------------------------------------------------


def slim_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, opening, turn, digest, row, words``: a turn without its text; ``row`` is its own."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    slim = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.lit(False).alias("opening"),
        F.col("turn").cast("long"),
        F.unhex(F.md5(said)).alias("digest"),
        F.monotonically_increasing_id().alias("row"),
        word_count(text).alias("words"),
    )
    return written(slim, "trie-turns")


def conversations_of(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id").distinct()


def with_shared_openings(turns: DataFrame, among: int = SHARED_AMONG) -> DataFrame:
    """Turns with the first few of each conversation replaced by as many of the first one of its ``among``.

    How many is decided by a hash of the conversation's number: at most ``MOST_SHARED``.
    """
    few = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(MOST_SHARED + 1))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest", "row")
    first = turns.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_SHARED)
    own = turns.join(first.where(F.col("place") <= few).select("row"), "row", "left_anti")
    openings = first.where(F.col("conv_id") % among == 0).withColumnRenamed("conv_id", "opener")
    taken = conversations_of(turns).withColumn("opener", F.col("conv_id") - F.col("conv_id") % among).join(openings, "opener").where(F.col("place") <= few)
    taken = taken.select("conv_id", F.lit(True).alias("opening"), F.col("place").cast("long").alias("turn"), "digest", "row", "words")
    return own.select(taken.columns).union(taken)


# -- keys of first turns --------------------------------------------------------------------------


def _ranked(turns: DataFrame) -> DataFrame:
    """``RANKED``: turns counted and hashed from the first that the same task has of the conversation."""
    ordered = [F.col("conv_id"), F.col("opening").desc(), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("row")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, current, n, key = TaskContext.get().partitionId(), None, 0, _START
        for batch in batches:
            counts, highs, lows = [], [], []
            for conv_id, digest in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if conv_id != current:
                    current, n, key = conv_id, 0, _START
                n, key = n + 1, (key * _FACTOR + int.from_bytes(digest, "big")) % _PRIME
                counts.append(n)
                highs.append(key >> 63)
                lows.append(key & _LOW)
            arrays = [pa.array(np.full(len(counts), part, "i4")), batch.column(0), *(pa.array(x, pa.int64()) for x in (counts, highs, lows)), batch.column(2)]
            yield pa.RecordBatch.from_arrays(arrays, names=["part", "conv_id", "n", "hi", "lo", "words"])

    dealt = turns.repartitionByRange(*ordered).sortWithinPartitions(*ordered)
    return dealt.select("conv_id", "digest", "words").mapInArrow(scan, RANKED)


def _carried(ranked: DataFrame) -> dict[int, tuple[int, int, int]]:
    """For each part that begins inside a conversation: that one, and its turns and key before. One row a part is collected."""
    ends = ranked.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "n", *KEY)).alias("end"))
    carried, before = {}, None
    for row in ends.orderBy("part").collect():
        conv_id, n, hi, lo = row["end"]
        key = hi << 63 | lo
        if before and before[0] == row["first"]:
            carried[row["part"]] = before
            if conv_id == row["first"]:
                n, key = before[1] + n, (key + (before[2] - _START) * pow(_FACTOR, n, _PRIME)) % _PRIME
        before = (conv_id, n, key)
    return carried


def positions(turns: DataFrame) -> DataFrame:
    """``POSITIONS``: of each conversation and depth the key of that many first turns, and the words of the last."""
    ship_package(turns.sparkSession)
    ranked = written(_ranked(turns), "trie-ranked")
    carried = _carried(ranked)

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, conv_id, n, hi, lo = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in range(5))
            for p in set(np.unique(part).tolist()) & carried.keys():
                before, turns_before, key_before = carried[p]
                for i in np.flatnonzero((part == p) & (conv_id == before)).tolist():
                    key = (int(hi[i]) << 63 | int(lo[i])) + (key_before - _START) * pow(_FACTOR, int(n[i]), _PRIME)
                    hi[i], lo[i] = _halves(key % _PRIME)
                    n[i] += turns_before
            arrays = [*map(pa.array, (conv_id, n, hi, lo)), batch.column(5)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "depth", "hi", "lo", "words"])

    return written(ranked.mapInArrow(carry, POSITIONS), "trie-positions")


# -- nodes ----------------------------------------------------------------------------------------


def _root_struct():
    hi, lo = _halves(_START)
    return F.struct(F.lit(0).cast("long").alias("depth"), F.lit(hi).cast("long").alias("hi"), F.lit(lo).cast("long").alias("lo"), F.lit(0).cast("long").alias("words"))


def _paths(places: DataFrame, band: int) -> DataFrame:
    """``conv_id, band, path``: a conversation's nodes in a band, from the band's root to the next band's, at most ``band`` + 1."""
    here = ((F.col("depth") - 1) / band).cast("long")
    held = F.when(F.col("depth") % band == 0, F.array(here, here + 1)).otherwise(F.array(here))
    node = F.struct("depth", *KEY, "words").alias("node")
    grouped = places.select("conv_id", F.explode(held).alias("band"), node).groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("node")).alias("path"))
    path = F.when(F.col("band") == 0, F.concat(F.array(_root_struct()), "path")).otherwise(F.col("path"))
    return written(grouped.select("conv_id", "band", path.alias("path")), "trie-paths")


def _nodes(paths: DataFrame, conversations: DataFrame) -> DataFrame:
    """``hi, lo, depth, conv_id, n_convs, words`` and the parent's key of every node, the root's among them."""
    pairs = F.arrays_zip(F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))).alias("node"), F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))).alias("parent"))
    steps = paths.select("conv_id", F.explode(pairs).alias("step"))
    nodes = steps.groupBy(F.col("step.node.hi").alias("hi"), F.col("step.node.lo").alias("lo")).agg(
        F.max("step.node.depth").alias("depth"),
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.max("step.node.words").alias("words"),
        F.max("step.parent.hi").alias("parent_hi"),
        F.max("step.parent.lo").alias("parent_lo"),
    )
    none = F.lit(None).cast("long")
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.withColumn("root", _root_struct()).select(
        "root.hi", "root.lo", "root.depth", "conv_id", "n_convs", "root.words", none.alias("parent_hi"), none.alias("parent_lo")
    )
    nodes = written(nodes.union(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent_hi").alias("hi"), F.col("parent_lo").alias("lo")).agg(F.count(F.lit(1)).alias("n_children"))
    return written(nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")


# -- sums -----------------------------------------------------------------------------------------


def _summed(rows: DataFrame, sums: list[str]) -> DataFrame:
    return rows.groupBy(*KEY).agg(*[F.sum(c).alias(c) for c in sums])


def _to_ancestors(nodes: DataFrame, paths: DataFrame, band: int, sums: list[str]) -> DataFrame:
    """The nodes' sums, once for each ancestor within the band that they hang in."""
    hung = nodes.withColumn("band", ((F.col("depth") - 1) / band).cast("long")).where("depth > 0")
    above = F.explode(F.slice("path", F.lit(1), (F.col("depth") - F.col("band") * band).cast("int"))).alias("ancestor")
    joined = hung.join(paths, ["conv_id", "band"]).select(above, *sums)
    return joined.select("ancestor.hi", "ancestor.lo", *sums)


def roll_up(nodes: DataFrame, places: DataFrame, paths: DataFrame, deepest: int, band: int, sums: list[str]) -> DataFrame:
    """``hi, lo`` and ``sums`` over the subtree of each of ``nodes`` (``hi, lo, conv_id, depth`` and the sums of the node itself).

    ``conv_id`` is any conversation through the node; ``places`` has its nodes by depth, ``paths`` the same by band.
    """
    inside = nodes.where(F.col("depth") % band > 0)
    within = written(_summed(nodes.select(*KEY, *sums).union(_to_ancestors(inside, paths, band, sums)), sums), "trie-sums")
    if deepest < band:
        return within
    higher = F.col("depth") / band
    roots = nodes.where(F.col("depth") % band == 0).drop(*sums).join(within, KEY)
    roots = written(roots.withColumn("depth", higher.cast("long")), "trie-band-roots")
    root_places = written(places.where(F.col("depth") % band == 0).withColumn("depth", higher.cast("long")), "trie-band-places")
    completed = roll_up(roots, root_places, _paths(root_places, band), deepest // band, band, sums)
    done = roots.drop(*sums).join(completed, KEY).withColumn("depth", F.col("depth") * band)
    return written(_summed(within.union(_to_ancestors(done, paths, band, sums)), sums), "trie-sums")


def _ends(places: DataFrame, conversations: DataFrame) -> DataFrame:
    """``hi, lo, ends_sha256`` of the nodes at which conversations end: a hash of their numbers in order.

    Numbers are joined some at a time; one task then streams the pieces of a node through the hash, which cannot be divided.
    """
    last = places.groupBy("conv_id").agg(F.max(F.struct("depth", *KEY)).alias("end"))
    ends = conversations.join(last, "conv_id", "left").withColumn("root", _root_struct())
    ends = ends.select("conv_id", *[F.coalesce(f"end.{k}", f"root.{k}").alias(k) for k in KEY])
    numbers = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    pieces = ends.groupBy(*KEY, F.shiftright("conv_id", ENDS_AT_ONCE).alias("piece")).agg(F.array_join(numbers, ",").alias("numbers"))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            done = []
            for hi, lo, numbers in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (hi, lo) == current:
                    digest.update(b",")
                else:
                    if current:
                        done.append((*current, digest.hexdigest()))
                    current, digest = (hi, lo), hashlib.sha256()
                digest.update(numbers.encode())
            yield _ended(done)
        if current:
            yield _ended([(*current, digest.hexdigest())])

    dealt = pieces.repartition(*KEY).sortWithinPartitions(*KEY, "piece").select(*KEY, "numbers")
    return dealt.mapInArrow(stream, "hi long, lo long, ends_sha256 string")


def _ended(rows: list[tuple]) -> pa.RecordBatch:
    hi, lo, digests = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(digests, pa.string())], names=[*KEY, "ends_sha256"])


# -- the trie -------------------------------------------------------------------------------------


def trie_of(turns: DataFrame, conversations: DataFrame, band: int = BAND) -> DataFrame:
    """A row per node of the conversations' ``slim_turns``; ``conversations`` also has those without any turn.

    ``conv_id`` (the smallest member's), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` (words that sharing the subtree's turns saves) and ``ends_sha256`` of the members that end there.
    """
    conversations = written(conversations, "trie-conversations")
    places = positions(turns)
    paths = _paths(places, band)
    nodes = _nodes(paths, conversations)
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    own = nodes.select(
        *KEY, "conv_id", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")
    )
    sums = roll_up(own, places, paths, deepest, band, ["n_leaves", "saved_tokens"])
    rows = nodes.join(sums, KEY).join(_ends(places, conversations), KEY, "left")
    parents = nodes.where("n_children > 0").select(F.col("hi").alias("parent_hi"), F.col("lo").alias("parent_lo"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("weight"))
    below = join_unique(rows.where("depth > 0"), parents, ["parent_hi", "parent_lo"], "weight", BROADCAST_PARENTS)
    top = rows.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    nothing = F.lit(hashlib.sha256().hexdigest())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")]
    return below.select(*columns).union(top.select(*columns))


def prefix_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of ``conversations`` (``conv_id, turn, role, text``) as they are."""
    turns = slim_turns(conversations)
    return trie_of(turns, conversations_of(turns), band)


def shared_opening_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """The trie of ``conversations`` rebuilt by ``with_shared_openings``."""
    turns = slim_turns(conversations)
    return trie_of(with_shared_openings(turns), conversations_of(turns), band)
