"""Removal of the bytes that a string of ``WINDOW`` bytes repeats from an earlier place in the corpus.

Equal windows have one anchor, the least of the hashes of the grams of ``GRAM`` bytes in them. A text is cut into
stretches, runs of windows with one anchor. A first pass counts anchors; only stretches whose anchor occurs twice are shuffled, by
anchor, as hashes. Of equal stretches the first stays in play and the others go as a whole. Where an anchor has different
stretches, or a stretch may repeat itself, their bytes are fetched and the suffixes that begin in them are sorted to the depth of a
window, deep-shallow: multikey quicksort by words of eight bytes to a shallow depth, then a blind trie for every group that
still shares its bytes. In each run of equal windows the smallest (document, start) stays, all others go.

Anchors of many stretches are dealt over several groups; what is left of each group, one place a
window, is sorted once more by window, where no more places meet than there were groups. Results are exact but for
collisions of 64-bit hashes among stretches with one anchor.

Null and empty texts have no bytes. Documents are ordered by ``doc_id``, null first. Rows with equal ids are the same document:
of equal windows in them those with the smallest start stay, in each row. Texts are read whole, of any length, in overlapping parts. An empty
table gives an empty table; columns of the input are kept apart from the operator's own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import broadcast_if_small, fold, join_unique, ship_package, written
from millrace.llm.text import mixed

WINDOW = 100
GRAM = 40
SHALLOW = 16  # bytes, in words of eight
GROUP = 20_000  # stretches of one anchor that meet in one group
PART_BYTES = 1 << 20  # of text hashed at once
SORTED_BYTES = 4 << 20  # of different stretches sorted at once
BROADCAST_ROWS = 1_000_000
HEAVY_SHARE = 1000  # anchors of more than one in so many stretches are met without a shuffle

_BASE = 0x9E3779B97F4A7C15  # odd: it has an inverse modulo 2**64
STRETCHES = "anchor long, content long, doc_id long, twin long, start long, stop long, inner boolean"
FOUND = "doc_id long, twin long, start long, stop long, bytes binary"


# -- stretches ------------------------------------------------------------------------------------


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, "u8"), np.full(n - 1, base, "u8")]))


class Grams:
    """Hashes of pieces of a part of the text, from sums that all pieces share."""

    def __init__(self, room: int):
        self.up, self.down = _powers(_BASE, room), _powers(pow(_BASE, -1, 1 << 64), room)

    def sums(self, held: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, "u8"), np.cumsum((held.astype("u8") + np.uint64(1)) * self.down[: len(held)], dtype="u8")])

    def hashes(self, sums: np.ndarray) -> np.ndarray:
        """Of every gram."""
        return mixed((sums[GRAM:] - sums[:-GRAM]) * self.up[: len(sums) - GRAM])

    def contents(self, sums: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mixed((sums[stop] - sums[first]) * self.up[first] + (stop - first).astype("u8"))


def extremes(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """The least or greatest (``pick``) of every ``width`` values in a row."""
    span = 1
    while 2 * span <= width:
        values = pick(values[: len(values) - span], values[span:])
        span *= 2
    rest = width - span
    return pick(values[: len(values) - rest], values[rest:]) if rest else values


def _inside(n: int, stops: np.ndarray) -> np.ndarray:
    """Which of ``n`` windows cross no stop."""
    crossing = np.zeros(n + 1, "i8")
    np.add.at(crossing, np.clip(stops - WINDOW + 1, 0, n), 1)
    np.add.at(crossing, np.clip(stops, 0, n), -1)
    return np.cumsum(crossing)[:n] == 0


def stretches(held: np.ndarray, stops: np.ndarray, grams: Grams) -> tuple[np.ndarray, ...]:
    """Anchor, hash of the bytes, first window, number of windows of every stretch, and whether it may hold a window twice."""
    n, width = len(held) - WINDOW + 1, WINDOW - GRAM + 1
    if n <= 0:
        return tuple(np.empty(0, kind) for kind in ("i8", "i8", "i8", "i8", "?"))
    sums = grams.sums(held)
    hashes = grams.hashes(sums)
    anchors, inside = extremes(hashes, width, np.minimum), _inside(n, stops)
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | ~inside[:-1]])
    first = np.flatnonzero(new & inside)
    ends = np.concatenate([np.flatnonzero(new | ~inside), [n]])
    last = ends[np.searchsorted(ends, first, "right")] - 1
    # a window twice in a stretch needs its anchor's gram twice, with no place between that is any window's anchor
    padding = np.zeros(width - 1, "u8")
    anchoring = np.flatnonzero(extremes(np.concatenate([padding, anchors, padding]), width, np.maximum) == hashes)
    twice = (hashes[anchoring[1:]] == hashes[anchoring[:-1]]) & (np.diff(anchoring) <= width)
    twice = anchoring[:-1][twice]
    inner = np.searchsorted(twice, first) < np.searchsorted(twice, last + width)
    contents = grams.contents(sums, first, last + WINDOW)
    return anchors[first].view("i8"), contents.view("i8"), first, last - first + 1, inner


def _parts(batches: Iterator[pa.RecordBatch], part_bytes: int) -> Iterator[list[tuple]]:
    """Rows of (doc_id, twin, offset, bytes), some bytes at once; longer texts overlap by all but one byte of a window."""
    some, held = [], 0
    for batch in batches:
        for doc_id, twin, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            for offset in range(0, max(len(text) - WINDOW + 1, 0), part_bytes):
                part = text[offset : offset + part_bytes + WINDOW - 1]
                some.append((doc_id, twin, offset, part))
                held += len(part)
                if held >= part_bytes:
                    yield some
                    some, held = [], 0
    if some:
        yield some


def stretches_of(texts: DataFrame, whole: bool, part_bytes: int = PART_BYTES) -> DataFrame:
    """``STRETCHES`` of ``texts`` (doc_id, twin, bytes), or their anchors alone, to be counted."""
    ship_package(texts.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(2 * part_bytes + WINDOW)
        for some in _parts(batches, part_bytes):
            held = np.frombuffer(b"".join(part for *_, part in some), "u1")
            stops = np.cumsum([len(part) for *_, part in some])
            anchors, contents, first, sizes, inner = stretches(held, stops, grams)
            if not whole:
                # a stretch that may repeat itself counts twice
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([anchors, anchors[inner]]))], names=["anchor"])
                continue
            row = np.searchsorted(stops, first, "right")
            begin, offset = np.concatenate([[0], stops[:-1]]), np.array([offset for _, _, offset, _ in some])
            ids, twins = (pa.array([x[i] for x in some], pa.int64()).take(pa.array(row)) for i in range(2))
            starts = first - begin[row] + offset[row]
            arrays = [pa.array(anchors), pa.array(contents), ids, twins, pa.array(starts), pa.array(starts + sizes + WINDOW - 1), pa.array(inner)]
            yield pa.RecordBatch.from_arrays(arrays, names=["anchor", "content", "doc_id", "twin", "start", "stop", "inner"])

    return texts.mapInArrow(cut, STRETCHES if whole else "anchor long")


# -- deep-shallow sorting -------------------------------------------------------------------------


def _words(held: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number that sorts as they do."""
    return np.ascontiguousarray(held[places[:, None] + np.arange(8)]).view(">u8").ravel().astype("u8")


def multikey_quicksort(held: np.ndarray, starts: np.ndarray, segments: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Orders ``starts`` within their ``segments`` by ``shallow`` bytes; also returns segments in which these are equal.

    All segments are parted in three around a pivot at once; the middle third goes on with the next word.
    """
    order = np.argsort(segments, kind="stable")
    segment, depth = segments[order], np.zeros(len(order), "i8")
    open_ = np.ones(len(order), bool)
    while True:
        first = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(segment) else np.empty(0, "i8")
        sizes = np.diff(np.append(first, len(segment)))
        open_ = np.repeat(sizes > 1, sizes) & (depth < shallow)
        at = np.flatnonzero(open_)
        if not len(at):
            return order, np.repeat(np.arange(len(first)), sizes)
        words = _words(held, starts[order[at]] + depth[at])
        inner = np.flatnonzero(np.concatenate([[True], segment[at][1:] != segment[at][:-1]]))
        counts = np.diff(np.append(inner, len(at)))
        three = np.sort(np.stack([words[inner], words[inner + counts // 2], words[inner + counts - 1]]), axis=0)
        pivot = np.repeat(three[1], counts)
        third = np.where(words < pivot, 0, np.where(words == pivot, 1, 2))
        held_by = np.repeat(np.arange(len(inner)), counts)
        moved = np.argsort(3 * held_by + third, kind="stable")
        order[at], depth[at] = order[at][moved], depth[at][moved] + 8 * (third[moved] == 1)
        # number the segments anew: parted ones count thrice
        rank = 3 * np.repeat(np.arange(len(first)), sizes)
        rank[at] += third[moved]
        segment = rank


class BlindTrie:
    """A trie of strings that keeps, of what lies between two forks, only the length."""

    def __init__(self, depth: int):
        self.depth, self.root = depth, None

    def _leaf_near(self, text: bytes) -> list:
        """Any leaf below the forks that ``text`` passes, without a look at what lies between them."""
        node = self.root
        while type(node) is tuple:
            children = node[1]
            node = children.get(text[node[0]]) or next(iter(children.values()))
        return node

    def add(self, text: bytes, member: int) -> None:
        """``text`` has ``depth`` bytes."""
        if self.root is None:
            self.root = [text, member]
            return
        near = self._leaf_near(text)
        if near[0] == text:
            near.append(member)
            return
        shared = _shared_length(near[0], text)
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < shared:
            parent, node = node, node[1][text[node[0]]]
        if isinstance(node, tuple) and node[0] == shared:
            node[1][text[shared]] = [text, member]
            return
        fork = (shared, {near[0][shared]: node, text[shared]: [text, member]})
        if parent is None:
            self.root = fork
        else:
            parent[1][text[parent[0]]] = fork

    def leaves(self) -> Iterator[list[int]]:
        """Members with equal strings, in the order of the strings."""
        waiting = [self.root] if self.root else []
        while waiting:
            node = waiting.pop()
            if isinstance(node, tuple):
                waiting += [node[1][byte] for byte in sorted(node[1], reverse=True)]
            else:
                yield node[1:]


def _shared_length(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix of two different strings of one length."""
    low, high = 0, len(a)  # a[:low] == b[:low], a[:high] != b[:high]
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def deep_shallow_sort(text: bytes, starts: np.ndarray, segments: np.ndarray, depth: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Orders the suffixes at ``starts`` within their ``segments`` by ``depth`` bytes; also numbers the runs of equal ones."""
    order, group = multikey_quicksort(np.frombuffer(text, "u1"), starts, segments)
    run = np.arange(len(order))
    sizes = np.bincount(group)
    shared = sizes[group] > 1 if len(order) else np.empty(0, bool)
    members, places = order[shared].tolist(), starts[order[shared]].tolist()
    deep, runs, at = [], [], 0
    for size in sizes[sizes > 1].tolist():
        stop = at + size
        if size == 2:  # a trie of two leaves
            one, two = text[places[at] : places[at] + depth], text[places[at + 1] : places[at + 1] + depth]
            deep += members[at:stop] if one <= two else (members[at + 1], members[at])
            runs += (at, at) if one == two else (at, at + 1)
        else:
            trie = BlindTrie(depth)
            for i in range(at, stop):
                trie.add(text[places[i] : places[i] + depth], members[i])
            for equal in trie.leaves():
                runs += [len(deep)] * len(equal)
                deep += equal
        at = stop
    order[shared], run[shared] = deep, np.flatnonzero(shared)[runs] if runs else runs
    return order, run


# -- repeats --------------------------------------------------------------------------------------


def _first_places(known: np.ndarray, ids: np.ndarray, starts: np.ndarray, run: np.ndarray) -> np.ndarray:
    """Which rows have the smallest (document, start) of their run; rows with equal places all have."""
    order = np.lexsort([starts, ids, known, run])
    first = np.flatnonzero(np.concatenate([[True], run[order][1:] != run[order][:-1]])) if len(run) else np.empty(0, "i8")
    best = np.repeat(order[first], np.diff(np.append(first, len(order))))
    is_first = np.empty(len(run), bool)
    is_first[order] = (starts[order] == starts[best]) & (ids[order] == ids[best]) & (known[order] == known[best])
    return is_first


def _sort_groups(rows: list[tuple], keep: bool) -> pa.RecordBatch:
    """``FOUND`` among stretches (group, doc_id, twin, start, bytes) of complete groups.

    Every row's windows that stand at a smaller place are found; with ``keep`` the other different windows are given, too.
    """
    known = np.array([row[1] is not None for row in rows])
    ids = np.array([row[1] or 0 for row in rows], "i8")
    starts = np.array([row[3] for row in rows], "i8")
    numbers: dict[tuple, int] = {}
    same = np.array([numbers.setdefault((row[0], row[4]), len(numbers)) for row in rows], "i8")
    first = _first_places(known, ids, starts, same)
    found = [(rows[i][1], rows[i][2], rows[i][3], rows[i][3] + len(rows[i][4]), None) for i in np.flatnonzero(~first).tolist()]

    # of equal stretches at the smallest place one is sorted
    chosen = np.full(len(numbers), -1, "i8")
    at_first = np.flatnonzero(first)
    chosen[same[at_first]] = at_first
    groups: dict[int, int] = {}
    group = np.array([groups.setdefault(rows[i][0], len(groups)) for i in chosen.tolist()], "i8")
    text = b"".join(rows[i][4] for i in chosen.tolist()) + bytes(8)
    lengths = np.array([len(rows[i][4]) for i in chosen.tolist()], "i8")
    windows = lengths - WINDOW + 1
    owner = np.repeat(np.arange(len(chosen)), windows)
    inner = np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)
    order, run = deep_shallow_sort(text, (np.cumsum(lengths) - lengths)[owner] + inner, group[owner])
    runs = np.empty(len(order), "i8")
    runs[order] = run
    row = chosen[owner]
    stays = _first_places(known[row], ids[row], starts[row] + inner, runs)
    # windows that go, in runs of one stretch; rows that share its bytes and place lose the same
    twins: dict[int, list[int]] = {}
    for i in at_first.tolist():
        twins.setdefault(int(same[i]), []).append(i)
    goes = np.flatnonzero(~stays)
    breaks = np.flatnonzero(np.concatenate([[True], (goes[1:] != goes[:-1] + 1) | (owner[goes[1:]] != owner[goes[:-1]])])) if len(goes) else np.empty(0, "i8")
    for begin, end in zip(goes[breaks].tolist(), goes[np.append(breaks[1:], len(goes)) - 1].tolist() if len(goes) else []):
        for i in twins[int(same[row[begin]])]:
            found.append((rows[i][1], rows[i][2], rows[i][3] + int(inner[begin]), rows[i][3] + int(inner[end]) + WINDOW, None))
    if keep:
        for k in np.flatnonzero(stays).tolist():
            for i in twins[int(same[row[k]])]:
                at = int(inner[k])
                found.append((rows[i][1], rows[i][2], rows[i][3] + at, rows[i][3] + at + WINDOW, rows[i][4][at : at + WINDOW]))
    columns = zip(*found, strict=True) if found else [[]] * 5
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "twin", "start", "stop", "bytes"])


def sorted_repeats(grouped: DataFrame, keep: bool) -> DataFrame:
    """``FOUND`` in stretches with their ``anchor`` and ``part``, dealt by both."""

    ship_package(grouped.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held, current = [], 0, None
        for batch in batches:
            for anchor, part, *row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if (anchor, part) != current:
                    if held >= SORTED_BYTES:
                        yield _sort_groups(rows, keep)
                        rows, held = [], 0
                    current = (anchor, part)
                rows.append((current, *row))
                held += len(row[-1])
        if rows:
            yield _sort_groups(rows, keep)

    dealt = grouped.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.select("anchor", "part", "doc_id", "twin", "start", "bytes").mapInArrow(scan, FOUND)


def _classed(others: DataFrame, group: int, part_bytes: int) -> DataFrame:
    """Stretches that are ``gone`` as a whole, and those that are to be sorted, in (anchor, part); ``parts`` > 1 if there are more of the anchor."""
    counted = stretches_of(others, False, part_bytes).groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    counted = written(counted.select("anchor", F.ceil(F.col("n") / group).cast("int").alias("parts"), "n"), "suffix-anchors")
    whole = stretches_of(others, True, part_bytes)
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    heavy = counted.where(F.col("n") * HEAVY_SHARE > total).count()  # fewer than HEAVY_SHARE
    held = join_unique(whole, counted, ["anchor"], "n", heavy, heavy)
    held = held.withColumn("part", F.pmod(fold(0, F.col("doc_id"), F.col("twin"), F.col("start")), F.col("parts")).cast("int"))
    # windows over one shuffle: by (anchor, part), and within it by content
    met = Window.partitionBy("anchor", "part")
    equal = Window.partitionBy("anchor", "part", "content")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "start")
    held = held.repartition("anchor", "part").withColumns({"gone": ~place.eqNullSafe(F.min(place).over(equal)), "least": F.min("content").over(met), "most": F.max("content").over(met)})
    held = held.where("gone OR inner OR parts > 1 OR least <> most")
    return written(held.select("anchor", "part", "parts", "doc_id", "twin", "start", "stop", "gone"), "suffix-stretches")


def _with_bytes(stretched: DataFrame, texts: DataFrame) -> DataFrame:
    """Stretches with their bytes, a list of which goes to each document."""
    wanted = stretched.groupBy("doc_id", "twin").agg(F.collect_list(F.struct("anchor", "part", "parts", "start", "stop")).alias("wanted"))
    wanted = written(wanted.select(F.col("doc_id").alias("wanted_doc"), F.col("twin").alias("wanted_twin"), "wanted"), "suffix-wanted")
    same = F.col("doc_id").eqNullSafe(F.col("wanted_doc")) & (F.col("twin") == F.col("wanted_twin"))
    rows = texts.join(wanted.hint("merge"), same).select("doc_id", "twin", "bytes", F.explode("wanted").alias("w"))
    piece = F.substring("bytes", (F.col("w.start") + 1).cast("int"), (F.col("w.stop") - F.col("w.start")).cast("int"))
    return rows.select("w.anchor", "w.part", "w.parts", "doc_id", "twin", "w.start", piece.alias("bytes"))


def repeated_spans(docs: DataFrame, group: int = GROUP, part_bytes: int = PART_BYTES) -> DataFrame:
    """``doc_id, twin, spans``: the maximal runs of bytes to remove (start, stop) of each document that has any.

    ``twin`` is the xxhash64 of the text, which tells rows with one id apart.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes"))
    texts = texts.where(F.octet_length("bytes") >= WINDOW).select("doc_id", F.xxhash64("bytes").alias("twin"), "bytes")
    copies = written(_whole_copies(texts), "suffix-copies")
    others = texts.join(broadcast_if_small(copies.select("doc_id", "twin"), BROADCAST_ROWS), ["doc_id", "twin"], "left_anti")

    classed = _classed(others, group, part_bytes)
    places = ["doc_id", "twin", "start", "stop"]
    held = _with_bytes(classed.where("NOT gone"), others)
    found = classed.where("gone").select(places).union(written(sorted_repeats(held.where("parts = 1"), False), "suffix-found").select(places))
    if classed.where("parts > 1").limit(1).count():
        dealt = written(sorted_repeats(held.where("parts > 1"), True), "suffix-found")
        left = dealt.where("bytes IS NOT NULL").select(fold(1, F.col("bytes")).alias("anchor"), F.lit(0).alias("part"), "doc_id", "twin", "start", "bytes")
        found = found.union(dealt.where("bytes IS NULL").select(places)).union(sorted_repeats(left, False).select(places))
    copied = copies.select("doc_id", "twin", F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("size").alias("stop"))).alias("spans"))
    return _maximal(found).unionByName(copied)


def _whole_copies(texts: DataFrame) -> DataFrame:
    """``doc_id, twin, size`` of documents whose whole text a document with a smaller id has, once each."""
    prints = texts.select("doc_id", "twin", F.sha2("bytes", 256).alias("print"), F.octet_length("bytes").cast("long").alias("size")).distinct()
    prints = written(prints, "suffix-prints")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")
    first = prints.groupBy("print").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = join_unique(prints, first.select("print", F.col("first.doc_id").alias("first"), "n"), ["print"], "n", BROADCAST_ROWS)
    return same.where("NOT doc_id <=> first").select("doc_id", "twin", "size")


def _maximal(found: DataFrame) -> DataFrame:
    """Overlapping and touching stretches of a document as one."""
    ordered = Window.partitionBy("doc_id", "twin").orderBy("start", "stop")
    before = F.max("stop").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    parted = found.withColumn("new", (before.isNull() | (F.col("start") > before)).cast("long")).withColumn("span", F.sum("new").over(ordered))
    spans = parted.groupBy("doc_id", "twin", "span").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return spans.groupBy("doc_id", "twin").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def _kept(text: Column, spans: Column) -> Column:
    """The bytes outside the spans; Latin-1 gives every byte a character, so that they can be joined."""
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["stop"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.octet_length(text).cast("long")))
    piece = lambda start, stop: F.decode(F.substring(text, (start + 1).cast("int"), (stop - start).cast("int")), "ISO-8859-1")
    return F.when(F.size(spans) == 0, text).otherwise(F.encode(F.array_join(F.zip_with(starts, stops, piece), ""), "ISO-8859-1"))


def remove_repeats(docs: DataFrame, group: int = GROUP, part_bytes: int = PART_BYTES) -> DataFrame:
    """Every row of ``docs`` as ``doc``, the ``spans`` to remove, and the bytes ``kept``."""
    spans = written(repeated_spans(docs, group, part_bytes), "suffix-spans")
    found = spans.select(F.col("doc_id").alias("span_doc"), F.col("twin").alias("span_twin"), "spans")
    text = F.coalesce(F.col("doc.text").cast("binary"), F.lit(b""))
    rows = docs.select(F.struct("*").alias("doc")).withColumn("twin", F.xxhash64(text))
    same = F.col("doc.doc_id").cast("long").eqNullSafe(F.col("span_doc")) & (F.col("twin") == F.col("span_twin"))
    joined = rows.join(broadcast_if_small(found, BROADCAST_ROWS), same, "left")
    held = F.coalesce("spans", F.expr("CAST(array() AS array<struct<start: bigint, stop: bigint>>)"))
    return joined.select("doc", held.alias("spans")).select("doc", "spans", _kept(text, F.col("spans")).alias("kept"))
