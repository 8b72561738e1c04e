"""Packing of tokenised documents into as few fixed-length sequences as can be.

Documents become pieces of at most the sequence length. Pieces of one length are alike, so
the instance is their number by length: a table of at most ``capacity`` rows, however large the corpus.
Martello and Toth's dominance criterion fixes sets that some best packing holds and shrinks
the instance, again and again; best fit, longest first, packs the remainder. The plan that comes of it gives
every run of equal pieces, in the order of their ranks, its sequences and offsets; ranks are
numbered in parallel within buckets.

Null and empty texts have the end id alone. Repeated rows are packed as often as they occur. An
empty table gives an empty table; other columns are ignored. Texts are tokenised whole,
chunk by chunk between spaces, which the tokenizer never joins.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress
from operator import add, not_

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millrace.llm.common import fold, parallelism, written

CAPACITY = 2048
END_ID = 0
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORD_END = "</w>"  # ends the last token of a word in the vocabulary
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"  # never part of a word's unit
WORDS_AT_ONCE = 500
CACHED_CHUNKS = 800_000  # per Python worker, some 160 MB
CACHED_LENGTH = 48
ROWS_AT_ONCE = 500

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


# -- tokens ---------------------------------------------------------------------------------------


class Chunks(dict):
    """Little-endian unsigned 32-bit ids of texts without a space, bounded in number.

    Most often only words are encoded: letters, which the tokenizer takes for one unit each, in lower case as far as they are ASCII.
    A chunk that is a word and closing marks has the ids of the one and then those of the other.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__({"": b""})
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def __missing__(self, chunk: str) -> bytes:
        return self.encode(chunk).tobytes()

    def _encode_words(self, words: list[str]) -> None:
        """Many words in one call: the last id of each is one that ends a word."""
        for i in range(0, len(words), WORDS_AT_ONCE):
            some = words[i : i + WORDS_AT_ONCE]
            ids = self.encode(" ".join(some))
            ends = (np.flatnonzero(self.final[ids]) + 1).tolist()
            if len(ends) != len(some):  # not the tokenizer this was written for
                self.update((word, self.encode(word).tobytes()) for word in some)
                continue
            held = ids.tobytes()
            self.update((word, held[4 * begin : 4 * end]) for word, begin, end in zip(some, [0, *ends], ends))

    def learn(self, chunks: set[str]) -> None:
        """Takes in all short chunks; the others are encoded where they stand."""
        if len(self) + 2 * len(chunks) > CACHED_CHUNKS:
            self.clear()
            self[""] = b""
        # one look at a time: a set less the keys of a dict goes through all that is kept
        new = [chunk for chunk in chunks if len(chunk) <= CACHED_LENGTH and chunk not in self]
        stems = [chunk.rstrip(MARKS) for chunk in new]
        plain = list(map(str.isalpha, stems))
        self.update((chunk, self.encode(chunk).tobytes()) for chunk in compress(new, map(not_, plain)))
        new, stems = list(compress(new, plain)), list(compress(stems, plain))
        words = [word.lower() if word.isascii() else word for word in stems]
        marks = [chunk[len(word) :] for chunk, word in zip(new, stems, strict=True)]
        self._encode_words([word for word in set(words) if word not in self])
        closing = {mark: self.encode(mark).tobytes() for mark in set(marks)}
        self.update(zip(new, map(add, map(self.__getitem__, words), map(closing.__getitem__, marks)), strict=True))


_CHUNKS: dict[str, Chunks] = {}  # a Python worker serves many tasks


def tokenised(texts: list[str | None], path: str) -> list[bytes]:
    """Ids of each text and the end id."""
    if path not in _CHUNKS:
        _CHUNKS[path] = Chunks(path)
    chunks = _CHUNKS[path]
    split = [(text or "").replace("\n", " ").split(" ") for text in texts]
    chunks.learn(set().union(*split))
    end = END_ID.to_bytes(4, "little")
    return [b"".join(map(chunks.__getitem__, parts)) + end for parts in split]


def pieces_of(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and ``ids`` (little-endian, null unless kept) of each piece."""
    schema = T.StructType.fromDDL(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                some = batch.slice(first, ROWS_AT_ONCE)
                rows = []
                for doc_id, ids in zip(some.column(0).to_pylist(), tokenised(some.column(1).to_pylist(), path), strict=True):
                    for piece, start in enumerate(range(0, len(ids) // 4, capacity)):
                        part = ids[4 * start : 4 * (start + capacity)]
                        rows.append((doc_id, piece, start, len(part) // 4, zlib.crc32(part), part if keep_ids else None))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=schema.names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, schema)


# -- the plan -------------------------------------------------------------------------------------


def _largest_pair(lengths: list[int], counts: Counter, limit: int) -> int:
    """The largest sum of two pieces that is at most ``limit``; 0 without any."""
    best, low, high = 0, 0, len(lengths) - 1
    while low <= high:
        if low == high and counts[lengths[low]] < 2:
            break
        total = lengths[low] + lengths[high]
        if total > limit:
            high -= 1
        else:
            best, low = max(best, total), low + 1
    return best


def reduce_instance(counts: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Takes dominating sets out of ``counts``; returns (how many, the lengths of one).

    For the longest piece a: alone if nothing fits beside it; with the largest piece b that
    fits, if both fill the sequence, or nothing else fits beside a and one more, or no two pieces
    that fit beside a are longer than b together; with b and the largest piece c that fits beside both, if no third fits
    beside a and two, and no two that fit beside a are both longer than c. Some best packing holds each such set.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for a in sorted(counts, reverse=True):
            while counts[a] > 0:
                others = _dominating(counts, a, capacity)
                if others is None:
                    break
                # what made the set dominate stays true as pieces go, until a length is used up
                taken = Counter((a, *others))
                same = min(counts[x] // n for x, n in taken.items())
                fixed.append((same, (a, *others)))
                for x in (a, *others):
                    counts[x] -= same
                changed = True
    return fixed


def _dominating(counts: Counter, a: int, capacity: int) -> tuple[int, ...] | None:
    """What to put beside one piece of length ``a``, if one choice dominates all others."""
    rest = counts.copy()
    rest[a] -= 1
    lengths = sorted(x for x in rest if rest[x] > 0)
    fitting = bisect.bisect_right(lengths, capacity - a)
    if not fitting:
        return ()
    b = lengths[fitting - 1]
    smallest = [x for x in lengths[:3] for _ in range(min(3, rest[x]))][:3]
    if a + b == capacity or a + sum(smallest[:2]) > capacity or len(smallest) < 2:
        return (b,)
    if a + sum(smallest) <= capacity and len(smallest) == 3:
        return None
    if _largest_pair(lengths, rest, capacity - a) <= b:
        return (b,)
    rest[b] -= 1
    c = max((x for x in lengths if rest[x] > 0 and a + b + x <= capacity), default=0)
    rest[b] += 1
    # at most two fit beside a: every such set has its longer piece at most b, and its shorter one at most c
    return (b, c) if c and c >= _longest_shorter(lengths, rest, capacity - a) else None


def _longest_shorter(lengths: list[int], counts: Counter, limit: int) -> int:
    """The longest piece that has one as long or longer beside it within ``limit``; 0 without any."""
    partners = {x: x if counts[x] > 1 else longer for x, longer in zip(lengths, [*lengths[1:], limit + 1])}
    return max((x for x, partner in partners.items() if x + partner <= limit), default=0)


def best_fit(counts: Counter, capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Longest first, each piece to the fullest sequence with room: equal sequences are handled together."""
    rooms: list[int] = []  # sorted
    groups: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)

    def put(room: int, bins: int, held: tuple[int, ...]) -> None:
        if bins:
            if not groups[room]:
                bisect.insort(rooms, room)
            groups[room].append((bins, held))

    for length in sorted((x for x in counts if counts[x] > 0), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, held = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, held = capacity, ()
                bins = -(-left // (capacity // length))
            each = room // length
            full = min(bins, left // each)
            put(room - each * length, full, held + (length,) * each)
            left -= full * each
            if full < bins and left:
                put(room - left * length, 1, held + (length,) * left)
                full, left = full + 1, 0
            put(room, bins - full, held)
    return [x for held in groups.values() for x in held]


def plan_sequences(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Rows (length, first rank, copies in a sequence, first sequence, offset), in order.

    The pieces of a length, by rank from ``first rank`` on, fill the places from ``offset`` on, ``copies`` in
    each of the sequences from ``first sequence`` on. The rows are bounded by the capacity alone: each length
    splits few groups of equal sequences, and a sequence holds at most some sixty different lengths.
    """
    rest = Counter({int(k): int(v) for k, v in counts.items() if v})
    patterns = reduce_instance(rest, capacity) + best_fit(rest, capacity)
    ranks: Counter = Counter()
    rows, sequence = [], 0
    for bins, held in patterns:
        offset = 0
        for length, copies in Counter(held).items():
            rows.append((length, ranks[length], copies, sequence, offset))
            ranks[length] += bins * copies
            offset += length * copies
        sequence += bins
    return np.array(sorted(rows), "i8").reshape(-1, 5)


# -- the pieces in their places -------------------------------------------------------------------


def _ranked(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank`` among those of equal length: numbers within buckets, added to the buckets before."""
    buckets = parallelism(pieces.sparkSession)
    held = pieces.withColumn("bucket", F.pmod(fold(3, F.col("doc_id"), F.col("piece")), F.lit(buckets)).cast("int"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    sums = held.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    numbered = held.withColumn("number", number).join(sums, ["length", "bucket"])
    return numbered.withColumn("rank", F.col("before") + F.col("number") - 1).drop("bucket", "number", "before")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (doc_id, piece, length and more) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counted = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``capacity`` rows
    plan = spark.sparkContext.broadcast(plan_sequences({r["length"]: r["n"] for r in counted}, capacity))
    ranked = _ranked(pieces)
    schema = T.StructType([*ranked.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, copies, sequence, offset = plan.value.T
        begins = length << 44 | first  # ranks stay below 2**44
        for batch in batches:
            own, rank = (batch.column(x).to_numpy().astype("i8") for x in ("length", "rank"))
            row = np.searchsorted(begins, own << 44 | rank, "right") - 1
            within = rank - first[row]
            found = (sequence[row] + within // copies[row], offset[row] + within % copies[row] * own)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, found)], names=schema.names)

    return ranked.mapInArrow(place, schema).drop("rank")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, path: str = TOKENIZER, keep_ids: bool = True) -> DataFrame:
    """Every piece of every document with its sequence, its offset there and, unless left out, its ids."""
    pieces = pieces_of(docs, capacity, path, keep_ids)
    return pack_pieces(written(pieces if keep_ids else pieces.drop("ids"), "packing-pieces"), capacity)


def sequence_ids(pieces: pd.DataFrame) -> np.ndarray:
    """The ids of one sequence from its pieces."""
    return np.frombuffer(b"".join(pieces.sort_values("offset")["ids"]), "<u4")
