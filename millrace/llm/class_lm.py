"""Scores of a class-based bigram model after Brown.

The probability of a word is that of its class after the class before, times that of the word in its
class. The end of a text is a token of a class of its own, which also stands before the first word.
Classes come from exchange clustering. It starts from a bounded table: the most frequent words, and all others grouped
by their ending, are items; an item moves to the class that makes the training text most probable until none moves.
Then sweeps go over the whole vocabulary: every word's neighbours are counted by class, and it moves to its best class.
Within a sweep all words move at once, by the class counts as they stood before it, less their own.
A word of no training text has the class of its ending. Absolute discounting smooths both
parts; what it takes from the known words of a class goes to its unknown words, as one type.

Everything is counted over all training texts. Counts and classes of the ``head`` most frequent words are sent to all
tasks (a bounded table), and those of all others are joined: scores do not depend on ``head``. Texts are read twice: once to count
the words, once to number them, frequent words by their place in a list and others by hash; all else reads these numbers. As neighbours in
a sweep, words beyond the ``CONTEXT`` most frequent stand in the class of their ending; their own moves and the final
counts are as any word's. Words are kept as 64-bit hashes.

Null and empty texts are one end token. A null id counts as empty text for the folds. Repeated rows score alike,
an empty table gives an empty table, and other columns are ignored. A very long text is read whole, in one task. Of words
equally frequent the lesser hash comes first, of equally good classes the first. Without a training text
everything is unknown, and every token is as likely as any.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fold_number, written
from millrace.llm.text import chunks, endings, lowered, mixed, word_hashes

HELD_OUT = 1
CLASSES = 32
FREQUENT = 500  # words that start as items of their own
ENDINGS = 500  # groups in which all others start
HEAD = 1 << 18  # most frequent words whose counts and classes are sent to all tasks: 5 MB
CONTEXT = 1 << 18  # most frequent words that are neighbours by their own class in a sweep
BLOCK = 256  # such words whose neighbours are kept and summed together: 64 KB
SWEEPS = 12  # at most, over the items
WORD_SWEEPS = 2  # over the whole vocabulary
SMOOTHING = 100  # tokens spread over all classes that are added to the neighbours of a class
LEAST_GAIN = np.log(CLASSES)  # of a word's move in such a sweep, in nats: what naming one of the classes costs
PSEUDO = 0.5  # of the base score

END = np.frombuffer(xxhash.xxh3_64_digest(b""), ">u8").astype("u8")[0]  # no word is empty


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view("i8")


def ending_groups(texts: list[bytes]) -> np.ndarray:
    return (mixed(endings(texts)) % np.uint64(ENDINGS)).astype("i4")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word``, ``ending`` group and number ``n`` of each word in some texts; the end token has no ending."""
    for batch in chunks(batches, 4000):
        held, groups, ends = [], [], 0
        for part in chunks(iter([batch])):
            texts = lowered(part.column(0))
            held.append(word_hashes(texts)[0])
            groups.append(ending_groups(texts))
            ends += part.num_rows
        words, first, n = np.unique(np.concatenate(held), return_index=True, return_counts=True)
        ending = np.concatenate(groups)[first]
        words, ending, n = np.append(words, END), np.append(ending, -1), np.append(n, ends)
        yield pa.RecordBatch.from_arrays([pa.array(_signed(words)), pa.array(ending.astype("i4")), pa.array(n.astype("i8"))], names=["word", "ending", "n"])


def count_words(training: DataFrame) -> DataFrame:
    """``word``, ``ending`` and count ``c`` of all words of the training texts."""
    counted = training.select("text").mapInArrow(_count_words, "word long, ending int, n long")
    return written(counted.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("c")), "lm-words")


class Items:
    """The item of a word: its place among the frequent words, else that of its ending's group; the last is the end."""

    def __init__(self, frequent: np.ndarray):
        self.hashes = np.sort(frequent.astype("u8"))
        self.number = len(self.hashes) + ENDINGS + 1
        self.end = self.number - 1

    def of(self, words: np.ndarray, groups: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return groups.astype("i8")
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, at, len(self.hashes) + groups).astype("i8")


# -- numbered texts -----------------------------------------------------------------------------

NUMBERED = "doc_id long, held_out boolean, codes binary, others binary"


@dataclass(frozen=True)
class Listing:
    """The most frequent words, sorted by hash, and the ending group of each."""

    words: np.ndarray
    groups: np.ndarray


def list_words(words: DataFrame, size: int) -> Listing:
    """``words`` (word, ending, c); the end token is in no list."""
    top = words.where(F.col("word") != int(_signed(np.array([END]))[0])).orderBy(F.desc("c"), "word").limit(size).toArrow()
    held = top["word"].to_numpy().view("u8")
    order = np.argsort(held, kind="stable")
    return Listing(held[order], top["ending"].to_numpy()[order].astype("i8"))


def _places(listed: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The place of each word among sorted ones, or -1."""
    if not len(listed):
        return np.full(len(words), -1)
    at = np.minimum(np.searchsorted(listed, words), len(listed) - 1)
    return np.where(listed[at] == words, at, -1)


def number_words(docs: DataFrame, listing: Listing, held_out: Column) -> DataFrame:
    """``doc_id, held_out`` and the words of each text: ``codes`` (32 bits) are places in the list, or -1 less the ending group
    for words that it lacks, whose hashes are in ``others``, in order."""
    shared = docs.sparkSession.sparkContext.broadcast(listing)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = lowered(batch.column(2))
            words, lengths = word_hashes(texts)
            at = _places(shared.value.words, words)
            other = at < 0
            codes = np.where(other, -1 - ending_groups(texts), at).astype("<i4").tobytes()
            ends, rest = np.append(0, np.cumsum(lengths)), np.append(0, np.cumsum(other))
            hashes = words[other].astype("<u8").tobytes()
            own = [codes[4 * a : 4 * b] for a, b in zip(ends, ends[1:])]
            others = [hashes[8 * a : 8 * b] for a, b in zip(rest[ends], rest[ends[1:]])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(others, pa.binary())], names=["doc_id", "held_out", "codes", "others"])

    return docs.select(F.col("doc_id").cast("long"), held_out.alias("held_out"), "text").mapInArrow(number, NUMBERED)


def _read_codes(codes: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The codes of some texts and the number of each text's."""
    held = codes.to_pylist()
    return np.frombuffer(b"".join(held), "<i4"), np.array([len(x) // 4 for x in held], "i8")


def _ends(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the end tokens after texts of so many words, and whether a token is one."""
    ends = np.cumsum(lengths) + np.arange(len(lengths))
    is_end = np.zeros(int(lengths.sum()) + len(lengths), bool)
    is_end[ends] = True
    return ends, is_end


def count_bigrams(numbered: DataFrame, listing: Listing, items: Items) -> np.ndarray:
    """How often one item follows another in the training texts: a table bounded by the number of items."""
    m = items.number
    shared = numbered.sparkSession.sparkContext.broadcast(items.of(listing.words, listing.groups))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(m * m, "i8")
        for batch in chunks(batches):
            codes, lengths = _read_codes(batch.column(0))
            is_end = _ends(lengths)[1]
            own = np.full(len(is_end), items.end)
            listed = codes >= 0
            held = len(items.hashes) - 1 - codes.astype("i8")  # of an ending group
            held[listed] = shared.value[codes[listed]]
            own[~is_end] = held
            before = np.concatenate([[items.end], own[:-1]])
            table += np.bincount(before * m + own, minlength=m * m)
        pairs = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(table[pairs])], names=["pair", "n"])

    summed = numbered.select("codes").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(m * m)
    table[summed["pair"].to_numpy()] = summed["n"].to_numpy()
    return table.reshape(m, m)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange_clusters(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each item; the last item, the end, stays alone in the last class.

    Maximises the sum of n log n over pairs of classes less that over single classes before and after,
    which is the training text's log probability but for a constant.
    """
    m, last = len(bigrams), classes - 1
    before, after = bigrams.sum(1), bigrams.sum(0)
    order = np.argsort(-(before + after)[:-1], kind="stable")
    own = np.full(m, last)
    own[order] = np.arange(m - 1) % last
    one_hot = np.eye(classes)[own]
    right, left = bigrams @ one_hot, (one_hot.T @ bigrams).T  # of items: counts towards and from classes
    pairs = one_hot.T @ right
    heads, tails = one_hot.T @ before, one_hot.T @ after
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not before[w] + after[w]:
                continue
            a, r, f, loop = own[w], right[w].copy(), left[w].copy(), bigrams[w, w]
            r[a] -= loop
            f[a] -= loop
            pairs[a] -= r
            pairs[:, a] -= f
            pairs[a, a] -= loop
            heads[a] -= before[w]
            tails[a] -= after[w]
            # moving w to c changes row c, column c and their crossing
            gain = (_xlogx(pairs + r) - _xlogx(pairs)).sum(1) + (_xlogx(pairs.T + f) - _xlogx(pairs.T)).sum(1)
            cross = pairs.diagonal()
            gain += _xlogx(cross + r + f + loop) - _xlogx(cross + r) - _xlogx(cross + f) + _xlogx(cross)
            gain -= _xlogx(heads + before[w]) - _xlogx(heads) + _xlogx(tails + after[w]) - _xlogx(tails)
            gain[last] = -np.inf
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            pairs[b] += r
            pairs[:, b] += f
            pairs[b, b] += loop
            heads[b] += before[w]
            tails[b] += after[w]
            if b != a:
                own[w] = b
                moved += 1
                right[:, a] -= bigrams[:, w]
                right[:, b] += bigrams[:, w]
                left[:, a] -= bigrams[w]
                left[:, b] += bigrams[w]
        if not moved:
            break
    return own


# -- the whole vocabulary ----------------------------------------------------------------------


@dataclass(frozen=True)
class Head:
    """Counts and classes of the most frequent words, sorted by hash, and the class of each ending for all others."""

    words: np.ndarray
    counts: np.ndarray
    classes: np.ndarray
    of_ending: np.ndarray

    def of_listing(self, listing: Listing) -> tuple[np.ndarray, np.ndarray]:
        """Place and class of each listed word; the list holds the head. Words outside the head have place -1 and the class of their ending."""
        place = _places(self.words, listing.words)
        return place, np.where(place >= 0, self.classes[place], self.of_ending[listing.groups]) if len(self.words) else self.of_ending[listing.groups]


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts, an end after each: ``place`` in the head (-1: elsewhere), ``cls`` (by ending where the
    head has none), the ``text`` of each, and the token ``before`` and ``after``, in a circle through the text's end.
    ``words`` are the hashes of those outside the head."""

    words: np.ndarray
    place: np.ndarray
    cls: np.ndarray
    is_end: np.ndarray
    text: np.ndarray
    before: np.ndarray
    after: np.ndarray


def read_tokens(batches: Iterator[pa.RecordBatch], listing: Listing, head: Head) -> Iterator[tuple[pa.RecordBatch, Tokens]]:
    """Rows that begin with ``codes`` and ``others`` in small batches, and their tokens."""
    place_of, class_of = head.of_listing(listing)
    for batch in chunks(batches):
        codes, lengths = _read_codes(batch.column(0))
        ends, is_end = _ends(lengths)
        starts = ends - lengths
        listed = codes >= 0
        held, classes, hashes = np.full(len(codes), -1), np.empty(len(codes), "i8"), np.zeros(len(codes), "u8")
        held[listed], classes[listed] = place_of[codes[listed]], class_of[codes[listed]]
        classes[~listed] = head.of_ending[-1 - codes[~listed]]
        hashes[~listed] = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u8")
        rare = np.flatnonzero(listed & (held < 0))
        hashes[rare] = listing.words[codes[rare]]
        words, place, cls = np.full(len(is_end), END), np.full(len(is_end), -1), np.full(len(is_end), CLASSES - 1)
        words[~is_end], place[~is_end], cls[~is_end] = hashes, held, classes
        before, after = np.arange(len(is_end)) - 1, np.arange(len(is_end)) + 1
        before[starts], after[ends] = ends, starts
        yield batch, Tokens(words, place, cls, is_end, np.repeat(np.arange(len(lengths)), lengths + 1), before, after)


def start_classes(words: DataFrame, items: Items, classes: np.ndarray) -> DataFrame:
    """``word, c, class`` of every word, by its item."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word = batch.column(0).to_numpy().view("u8")
            own = np.where(word == END, items.end, items.of(word, batch.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(classes[own].astype("i4"))], names=["word", "c", "class"])

    return words.select("word", "ending", "c").mapInArrow(start, "word long, c long, class int")


def read_head(classed: DataFrame, size: int, of_ending: np.ndarray) -> Head:
    """``classed`` (word, c, class); the end token is in no head."""
    top = classed.where(F.col("word") != int(_signed(np.array([END]))[0])).orderBy(F.desc("c"), "word").limit(size).toArrow()
    words = top["word"].to_numpy().view("u8")
    order = np.argsort(words, kind="stable")
    return Head(words[order], top["c"].to_numpy()[order], top["class"].to_numpy()[order].astype("i8"), of_ending)


NEAR = "block int, cells binary, counts binary, word long, near int"


def count_neighbours(numbered: DataFrame, listing: Listing, head: Head) -> DataFrame:
    """How often which class stands before a word (key = class) and after it (``CLASSES`` + class).

    Words of the head and the end, by blocks of ``BLOCK`` and once a task: ``cells`` (16 bits, place in the block and key) and their ``counts``
    (64 bits). Every occurrence of another ``word`` is a row, with the classes before and after it in ``near``.
    """
    shared = numbered.sparkSession.sparkContext.broadcast((listing, head))
    keys = 2 * CLASSES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, size = shared.value[1], BLOCK * keys
        table = np.zeros(-(-(len(h.words) + 1) // BLOCK) * size, "i4")
        names = ["block", "cells", "counts", "word", "near"]
        for _, t in read_tokens(batches, *shared.value):
            own = np.where(t.is_end, len(h.words), t.place)
            known, rest = np.flatnonzero(own >= 0), np.flatnonzero(own < 0)
            before, after = t.cls[t.before], t.cls[t.after]
            codes, n = np.unique(np.concatenate([own[known] * keys + before[known], own[known] * keys + CLASSES + after[known]]), return_counts=True)
            table[codes] += n.astype("i4")
            nothing = [pa.nulls(len(rest), kind) for kind in (pa.int32(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([*nothing, pa.array(_signed(t.words[rest])), pa.array((before[rest] * CLASSES + after[rest]).astype("i4"))], names=names)
        for first in range(0, len(table), 64 * size):
            blocks = [(first // size + i, part) for i, part in enumerate(table[first : first + 64 * size].reshape(-1, size)) if part.any()]
            at = [np.flatnonzero(part) for _, part in blocks]
            cells = pa.array([x.astype("<u2").tobytes() for x in at], pa.binary())
            counts = pa.array([part[x].astype("<i8").tobytes() for (_, part), x in zip(blocks, at)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blocks], pa.int32()), cells, counts, pa.nulls(len(blocks), pa.int64()), pa.nulls(len(blocks), pa.int32())], names=names)

    return numbered.select("codes", "others").mapInArrow(count, NEAR)


def sum_blocks(blocks: DataFrame) -> DataFrame:
    """``block, cells, counts``, one row a block."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, table = None, np.zeros(BLOCK * 2 * CLASSES, "i8")

        def row() -> pa.RecordBatch:
            at = np.flatnonzero(table)
            columns = [pa.array([own], pa.int32()), pa.array([at.astype("<u2").tobytes()]), pa.array([table[at].astype("<i8").tobytes()])]
            return pa.RecordBatch.from_arrays(columns, names=["block", "cells", "counts"])

        for batch in batches:
            for block, cells, counts in zip(*(column.to_pylist() for column in batch.columns)):
                if own is not None and block != own:
                    yield row()
                    table[:] = 0
                own = block
                table[np.frombuffer(cells, "<u2")] += np.frombuffer(counts, "<i8")
        if own is not None:
            yield row()

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block int, cells binary, counts binary")


def _block_cells(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """First place, and place in the block, key and count of each cell, of each row of ``sum_blocks``."""
    for block, cells, counts in zip(*(column.to_pylist() for column in batch.columns)):
        at = np.frombuffer(cells, "<u2").astype("i8")
        yield block * BLOCK, at // (2 * CLASSES), at % (2 * CLASSES), np.frombuffer(counts, "<i8")


def best_classes(own: np.ndarray, place: np.ndarray, key: np.ndarray, n: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of each word under which its neighbours are the most probable, its own counts taken out of its present class.

    That is the slope of the criterion of ``exchange_clusters``; since all words move at once, shares of neighbours within a class are
    smoothed, or a small class would draw every word that would fit it alone.
    ``place, key, n``: the neighbours of words by class, as in ``count_neighbours``. ``pairs``: counts of pairs of classes.
    A word stays where no class is better by ``LEAST_GAIN``, so that chance neighbours of a rare word do not move it.
    """
    k, size = CLASSES, len(own)
    near = np.zeros((size, 2 * k))
    near[place, key] = n
    number = near[:, :k].sum(1)
    counts = np.concatenate([pairs.T, pairs], 1)  # of a class: the classes before and after it
    spread = SMOOTHING * counts.sum(0) / max(pairs.sum(), 1)
    held = counts[:, :k].sum(1)
    share = np.log(np.maximum(counts + spread, 1e-9)) - np.log(held + SMOOTHING)[:, None]
    gain = near @ share.T
    mine = own[place]
    without = np.log(np.maximum(counts[mine, key] - n + spread[key], 1e-9)) - np.log(np.maximum(held[mine] - number[place], 0) + SMOOTHING)
    stay = np.bincount(place, n * without, size)
    gain[np.arange(size), own] = stay
    gain[:, k - 1] = -np.inf  # the end is alone
    best = gain.argmax(1)
    return np.where((own < k - 1) & (gain[np.arange(size), best] > stay + LEAST_GAIN), best, own)


def sweep(numbered: DataFrame, listing: Listing, classed: DataFrame, head: Head) -> DataFrame:
    """``classed`` (word, c, class) after every word of the vocabulary has moved to its best class."""
    scratch, end = Scratch(), int(_signed(np.array([END]))[0])
    shared = numbered.sparkSession.sparkContext.broadcast(head)
    counted = scratch.write(count_neighbours(numbered, listing, head), "lm-near")
    blocks = scratch.write(sum_blocks(counted.where("block IS NOT NULL").select("block", "cells", "counts")), "lm-blocks")
    rest = counted.where("block IS NULL").select("word", "near").repartition("word").groupBy("word", "near").agg(F.count(F.lit(1)).alias("n"))
    rest = rest.groupBy("word").agg(F.sort_array(F.collect_list(F.struct("near", "n"))).alias("near"))  # at most one entry for each two classes
    rest = scratch.write(rest.join(classed, "word").select("word", "c", "class", "near"), "lm-neighbours")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, sums = np.append(shared.value.classes, CLASSES - 1), np.zeros(CLASSES * CLASSES, "i8")
        for batch in batches:
            for first, place, key, n in _block_cells(batch):
                before = key < CLASSES
                np.add.at(sums, key[before] * CLASSES + classes[first + place[before]], n[before])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype="i4")), pa.array(sums)], names=["pair", "n"])

    table = np.zeros(CLASSES * CLASSES)
    of_rest = rest.select("class", F.inline("near")).select((F.floor(F.col("near") / CLASSES) * CLASSES + F.col("class")).cast("int").alias("pair"), "n")
    for r in blocks.mapInArrow(pair, "pair int, n long").unionByName(of_rest).groupBy("pair").agg(F.sum("n").alias("n")).collect():
        table[r["pair"]] += r["n"]
    table = table.reshape(CLASSES, CLASSES)

    def choose_head(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = shared.value
        for batch in batches:
            for first, place, key, n in _block_cells(batch):
                own = h.classes[first : first + BLOCK]  # without the end
                word = place < len(own)
                best = best_classes(own, place[word], key[word], n[word], table)
                columns = [_signed(h.words[first : first + BLOCK]), h.counts[first : first + BLOCK], best.astype("i4")]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "c", "class"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 4000):
            lists, own = batch.column(3), batch.column(2).to_numpy()
            held, keys = lists.flatten(), 2 * CLASSES
            row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy()) * keys
            near, n = held.field("near").to_numpy(), held.field("n").to_numpy()
            sums = np.bincount(np.concatenate([row + near // CLASSES, row + CLASSES + near % CLASSES]), np.concatenate([n, n]), batch.num_rows * keys)
            at = np.flatnonzero(sums)
            best = best_classes(own, at // keys, at % keys, sums[at], table)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best.astype("i4"))], names=["word", "c", "class"])

    schema = "word long, c long, class int"
    moved = blocks.mapInArrow(choose_head, schema).unionByName(rest.mapInArrow(choose, schema)).unionByName(classed.where(F.col("word") == end))
    moved = written(moved, "lm-classes")
    scratch.clear()
    return moved


def count_class_pairs(numbered: DataFrame, listing: Listing, classed: DataFrame, head: Head) -> np.ndarray:
    """How often one class follows another in the training texts; words beyond the head are joined to their classes."""
    shared = numbered.sparkSession.sparkContext.broadcast((listing, head))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a", "class_a", "b", "class_b", "n"]
        table = np.zeros(CLASSES * CLASSES, "i8")
        for _, t in read_tokens(batches, *shared.value):
            rest = (t.place < 0) & ~t.is_end
            a, b = t.before, np.arange(len(t.words))
            known = ~(rest[a] | rest[b])
            table += np.bincount(t.cls[a[known]] * CLASSES + t.cls[b[known]], minlength=len(table))
            a, b = a[~known], b[~known]
            if len(a):
                columns = []
                for side in (a, b):
                    columns += [pa.array(_signed(t.words[side]), mask=~rest[side]), pa.array(t.cls[side].astype("i4"), mask=rest[side])]
                yield pa.Table.from_arrays([*columns, pa.array(np.ones(len(a), "i8"))], names=names).group_by(names[:4]).aggregate([("n", "sum")]).rename_columns(names).combine_chunks().to_batches()[0]
        at = np.flatnonzero(table)
        nothing = pa.nulls(len(at), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, pa.array((at // CLASSES).astype("i4")), nothing, pa.array((at % CLASSES).astype("i4")), pa.array(table[at])], names=names)

    rows = numbered.select("codes", "others").mapInArrow(count, "a long, class_a int, b long, class_b int, n long")
    rows = written(rows.groupBy("a", "class_a", "b", "class_b").agg(F.sum("n").alias("n")), "lm-pairs")
    for side, others in (("a", ["b", "class_b"]), ("b", ["class_a"])):
        named = classed.select(F.col("word").alias(side), F.col("class").alias(f"class_{side}"))
        open_rows = rows.where(F.col(side).isNotNull()).drop(f"class_{side}").join(named, side)
        columns = [f"class_{side}", *others]
        rows = open_rows.select(*columns, "n").unionByName(rows.where(F.col(side).isNull()).select(*columns, "n")).groupBy(*columns).agg(F.sum("n").alias("n"))
    pairs = np.zeros((CLASSES, CLASSES))
    for r in rows.collect():
        pairs[r["class_a"], r["class_b"]] = r["n"]
    return pairs


@dataclass(frozen=True)
class ClassModel:
    """All of bounded size."""

    listing: Listing
    head: Head
    transition: np.ndarray  # log10 P(class | class before)
    total: np.ndarray  # tokens by class
    unknown: np.ndarray  # log10 of the discounted mass by class
    discount: float
    tokens: int
    types: int
    ends: int

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """log10 P(word | class) by the word's count, 0 for unknown words; a class without tokens has its unknown type alone."""
        known = counts > 0
        return np.where(known, np.log10(np.where(known, counts - self.discount, 1.0)), self.unknown[classes]) - np.log10(np.maximum(self.total, 1))[classes]


def _smoothed(pairs: np.ndarray) -> np.ndarray:
    """log10 P(class | class before): absolute discounting, backed off to the class alone, and that to any class."""
    d, k = 0.5, len(pairs)
    after = pairs.sum(0)
    alone = (np.maximum(after - d, 0) + (after > 0).sum() * d / k) / max(after.sum(), 1) if after.sum() else np.full(k, 1 / k)
    sums = pairs.sum(1, keepdims=True)
    freed = (pairs > 0).sum(1, keepdims=True) * d
    held = (np.maximum(pairs - d, 0) + freed * alone) / np.maximum(sums, 1)
    return np.log10(np.where(sums > 0, held, alone))


def fit_class_model(
    training: DataFrame, words: DataFrame, head: int = HEAD, sweeps: int = WORD_SWEEPS, listing: Listing | None = None, numbered: DataFrame | None = None
) -> tuple[ClassModel, DataFrame]:
    """The model, and ``word, c, class`` of every training word. ``words``: the result of ``count_words``; ``listing`` and
    ``numbered``: of ``list_words`` and ``number_words``, where they are there already."""
    end = int(_signed(np.array([END]))[0])
    if listing is None or numbered is None:
        listing = list_words(words, max(head, CONTEXT))
        numbered = written(number_words(training, listing, F.lit(False)), "lm-numbered")
    top = words.where(F.col("word") != end).orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    items = Items(top["word"].to_numpy().view("u8"))
    classes = exchange_clusters(count_bigrams(numbered, listing, items))
    of_ending = classes[len(items.hashes) : -1]
    classed = written(start_classes(words, items, classes), "lm-classes")
    for _ in range(sweeps):
        classed = sweep(numbered, listing, classed, read_head(classed, CONTEXT, of_ending))
    held = read_head(classed, head, of_ending)
    pairs = count_class_pairs(numbered, listing, classed, held)
    total, types = np.zeros(CLASSES), np.zeros(CLASSES)
    whole = classed.groupBy("class").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).collect()
    for r in whole:
        total[r["class"]], types[r["class"]] = r["n"], r["v"]
    types[CLASSES - 1] = 0  # the end has no unknown words
    n1, n2 = (sum(r[name] for r in whole if r["class"] < CLASSES - 1) for name in ("n1", "n2"))
    discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    freed = discount * types
    ends = int(total[CLASSES - 1])
    model = ClassModel(listing, held, _smoothed(pairs), total, np.log10(np.where(freed > 0, freed, 1.0)), discount, int(total.sum()), sum(r["v"] for r in whole), ends)
    return model, classed


# -- scores -----------------------------------------------------------------------------------

PARTIAL = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<struct<word:long,class:int>>, uses array<struct<of:int,before:int,after:int,n:int>>"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _lists(rows: np.ndarray, number: int, **fields: np.ndarray) -> pa.ListArray:
    """Lists of structs, of sorted ``rows`` out of ``number``."""
    values = pa.StructArray.from_arrays([pa.array(v) for v in fields.values()], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(number + 1)).astype("i4")), values)


def score_texts(docs: DataFrame, classed: DataFrame, model: ClassModel, held_out: Column, numbered: DataFrame | None = None) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` for each document.

    One pass over the numbered texts (``numbered``, where they are there already) adds up what the head knows. Words beyond it are listed once a text, with the classes next to
    them, and joined to their counts and classes; then what they take part in is added.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    per_token = float(np.log10(model.tokens + PSEUDO * (model.types + 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, t in read_tokens(batches, m.listing, m.head):
            n = batch.num_rows
            rest = (t.place < 0) & ~t.is_end
            c = np.where(t.is_end, m.ends, 0)
            if len(m.head.words):
                c = np.where(t.place >= 0, m.head.counts[t.place], c)
            emission = np.where(rest | t.is_end, 0.0, m.emission(c, t.cls))
            moved = np.where(rest | rest[t.before], 0.0, m.transition[t.cls[t.before], t.cls])
            base = np.where(rest, 0.0, np.log10(c + PSEUDO)) - per_token
            add = lambda values: np.bincount(t.text, values, n)
            # the words beyond the head, once a text
            at = np.flatnonzero(rest)
            order = at[np.lexsort((t.words[at], t.text[at]))]
            new = np.r_[True, (t.words[order][1:] != t.words[order][:-1]) | (t.text[order][1:] != t.text[order][:-1])][: len(order)]
            firsts = order[new]
            text_of = t.text[firsts]
            number = np.empty(len(t.words), "i8")
            number[order] = np.cumsum(new) - 1 - np.searchsorted(text_of, t.text[order])
            before = np.where(rest[t.before[at]], CLASSES + number[t.before[at]], t.cls[t.before[at]])
            after = np.where(rest[t.after[at]], -1, t.cls[t.after[at]])
            uses, times = np.unique(np.stack([t.text[at], number[at], before, after], 1), axis=0, return_counts=True) if len(at) else (np.empty((0, 4), "i8"), np.empty(0))
            rare = _lists(text_of, n, word=_signed(t.words[firsts]), **{"class": t.cls[firsts].astype("i4")})
            used = _lists(uses[:, 0], n, of=uses[:, 1].astype("i4"), before=uses[:, 2].astype("i4"), after=uses[:, 3].astype("i4"), n=times.astype("i4"))
            sums = [pa.array(np.bincount(t.text, minlength=n)), pa.array(add(c > 0).astype("i8")), pa.array(add(base)), pa.array(add(emission + moved))]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), *sums, rare, used], names=["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare", "uses"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in chunks(batches):
            n, found, uses = batch.num_rows, batch.column(6).fill_null([]), batch.column(7)
            first, held, use = np.append(0, np.cumsum(found.value_lengths().to_numpy())), found.flatten(), uses.flatten()
            c, cls = held.field("c").to_numpy(), held.field("class").to_numpy()
            text = np.repeat(np.arange(n), uses.value_lengths().to_numpy())
            of, before, after, times = (use.field(name).to_numpy() for name in ("of", "before", "after", "n"))
            own, is_rare = first[text] + of, before >= CLASSES
            if len(own):
                before = np.where(is_rare, cls[np.where(is_rare, first[text] + before - CLASSES, 0)], before)
            score = m.emission(c[own], cls[own]) + m.transition[before, cls[own]] + np.where(after >= 0, m.transition[cls[own], after], 0.0)
            plus = lambda column, values: pa.array(batch.column(column).to_numpy() + np.bincount(text, values * times, n))
            known = batch.column(3).to_numpy() + np.bincount(text, (c[own] > 0) * times, n).astype("i8")
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(known), pa.array(np.full(n, m.tokens)), plus(4, np.log10(c[own] + PSEUDO)), plus(5, score)],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    numbered = number_words(docs, model.listing, held_out) if numbered is None else numbered
    rows = numbered.select("codes", "others", "doc_id", "held_out").mapInArrow(score, PARTIAL)
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    rare = rows.select("row", F.posexplode("rare").alias("at", "r")).select("row", "at", "r.word", F.col("r.class").alias("by_ending"))
    looked_up = rare.join(classed, "word", "left").select("row", F.struct("at", F.coalesce("c", F.lit(0)).alias("c"), F.coalesce("class", "by_ending").alias("class")).alias("found"))
    found = looked_up.groupBy("row").agg(F.sort_array(F.collect_list("found")).alias("found"))  # as many as the text has words
    joined = rows.drop("rare").join(found, "row", "left").select("doc_id", "held_out", "n_tokens", "n_known", "base", "score", "found", "uses")
    return joined.mapInArrow(finish, SCORED)


def score_documents(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Trains on the documents outside the held-out fold and scores all."""
    held_out = fold_number(F.col("doc_id")) == HELD_OUT
    training, scratch = docs.where(~held_out), Scratch()
    words = count_words(training)
    listing = list_words(words, max(head, CONTEXT))
    numbered = scratch.write(number_words(docs, listing, held_out), "lm-numbered")
    model, classed = fit_class_model(training, words, head, listing=listing, numbered=numbered.where(~F.col("held_out")))
    scores = score_texts(docs, classed, model, held_out, numbered)
    scratch.clear()
    return scores
