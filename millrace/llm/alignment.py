"""Alignment of two tokenizers' tokens over the same bytes, and how often their ids meet.

Both encode a space and the text. Ends that both share cut the bytes into groups, found by divide and
conquer: of an interval's tokens the shared end nearest to the middle is looked for by bisection in
the other tokenizer's ends, both halves are searched again, and an interval without a shared end inside is
a group. All intervals of a batch of texts are searched side by side.

A null or empty text, and one whose tokens do not spell its bytes, has no tokens. Texts are encoded whole, of any
length. Repeated rows and rows with equal or null ids are documents of their own, and a pair of ids that
ties with another for the most documents is a best one, too. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import join_unique, ship_package, written

TOKENIZER_A = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER_B = public_tokenizers.path("piece_bpe_32k.model")
ID_BITS = 17  # of a token id where a pair of ids is one number
TEXT_BYTES_AT_ONCE = 1 << 20
BROADCAST_PAIRS = 2_000_000  # rows of (pair, documents); they are counted first

GROUPS = "doc_id long, a_ids array<int>, b_ids array<int>, a_sizes array<int>, b_sizes array<int>"
LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>"


# -- tokens ---------------------------------------------------------------------------------------


def _byte_of() -> dict[str, int]:
    """The byte that a character of a byte-level vocabulary stands for: itself if printable, else the next free code point from 256."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [byte for byte in range(256) if byte not in printable]
    return {chr(byte): byte for byte in printable} | {chr(256 + i): byte for i, byte in enumerate(others)}


class ByteLevel:
    """A byte-level BPE without special tokens; ``tokens`` has the bytes of each id."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        special = {token["content"] for token in described["added_tokens"]}
        byte_of = _byte_of()
        # ids are in the order of the merges, as the encoder wants its ranks
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in described["model"]["vocab"].items() if token not in special}
        self.encoder = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.tokens[i] = token

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoder.encode_ordinary(f" {text}") for text in texts]


class Pieces:
    """A piece vocabulary with byte fallback, which adds the space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.tokens = [self._bytes(i) for i in range(self.model.get_piece_size())]

    def _bytes(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


_LOADED: dict[tuple, ByteLevel | Pieces] = {}  # a Python worker serves many tasks


def _tokenizer(kind: type, path: str):
    if (kind, path) not in _LOADED:
        loaded = kind(path)
        if len(loaded.tokens) > 1 << ID_BITS:
            raise ValueError(f"{path} has more than {1 << ID_BITS} ids")
        _LOADED[kind, path] = loaded
    return _LOADED[kind, path]


class Tokens:
    """The tokens of one tokenizer in a batch of texts: ids, ends among all bytes, and each text's place."""

    def __init__(self, ids: list[list[int]], tokens: list[bytes]):
        lengths = np.array([len(token) for token in tokens], "i8")
        self.counts = np.array([len(some) for some in ids], "i8")
        self.ids = np.fromiter(chain.from_iterable(ids), "i8", int(self.counts.sum()))
        self.ends = np.cumsum(lengths[self.ids])
        self.stops = np.cumsum(self.counts)


def encode_pair(texts: list[str | None], a: ByteLevel, b: Pieces) -> tuple[Tokens, Tokens]:
    """The tokens of both; texts that either does not spell have none."""
    given = [text or "" for text in texts]
    a_ids, b_ids = a.encode(given), b.encode(given)
    for i, text in enumerate(given):
        spelt = f" {text}".encode()
        if not text or any(b"".join(map(x.tokens.__getitem__, ids[i])) != spelt for x, ids in ((a, a_ids), (b, b_ids))):
            a_ids[i], b_ids[i] = [], []
    return Tokens(a_ids, a.tokens), Tokens(b_ids, b.tokens)


# -- cuts -----------------------------------------------------------------------------------------


def _is_end(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``places`` are among the sorted ``ends``, by bisection; none is beyond the last."""
    return ends[np.searchsorted(ends, places)] == places


def _nearest_shared(ends_a: np.ndarray, ends_b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each interval the token from ``low`` to ``high - 1`` nearest to the middle whose end is shared, or -1.

    The middle is tried first, then rings around it that double in width.
    """
    middle, found = (low + high - 1) // 2, np.full(len(low), -1, "i8")
    looking, near, far = np.flatnonzero(high > low), 0, 1
    while len(looking):
        distances = np.arange(near, far)
        steps = np.stack([distances, -distances], axis=1).ravel()[int(near == 0) :]  # nearest first, later before earlier
        tried = middle[looking, None] + steps
        inside = (tried >= low[looking, None]) & (tried < high[looking, None])
        shared = np.zeros(tried.shape, bool)
        shared[inside] = _is_end(ends_a[tried[inside]], ends_b)
        first = shared.argmax(axis=1)
        hit = shared[np.arange(len(looking)), first]
        found[looking[hit]] = tried[hit, first[hit]]
        looking = looking[~hit & (high[looking] - low[looking] > 2 * (far - 1) + 1)]
        near, far = far, min(2 * far, far + 4096)
    return found


def shared_cuts(a: Tokens, b: Tokens) -> np.ndarray:
    """Whether each token of ``a`` ends where one of ``b`` ends."""
    cut = np.zeros(len(a.ids), bool)
    high = a.stops[a.counts > 0] - 1
    low = high + 1 - a.counts[a.counts > 0]
    cut[high] = True  # every text ends in both
    while len(low):
        at = _nearest_shared(a.ends, b.ends, low, high)
        split = at >= 0  # the other intervals are groups
        low, high, at = low[split], high[split], at[split]
        cut[at] = True
        low, high = np.concatenate([low, at + 1]), np.concatenate([at, high])
    return cut


class Aligned:
    """Groups and links of a batch of texts."""

    def __init__(self, texts: list[str | None], a: ByteLevel, b: Pieces):
        self.a, self.b = encode_pair(texts, a, b)
        self.cut_a = shared_cuts(self.a, self.b)
        self.cut_b = np.zeros(len(self.b.ids), bool)
        self.cut_b[np.searchsorted(self.b.ends, self.a.ends[self.cut_a])] = True

    def sizes(self, tokens: Tokens, cut: np.ndarray) -> list[np.ndarray]:
        """The numbers of tokens in the groups of each text."""
        last = np.flatnonzero(cut)
        return np.split(np.diff(last, prepend=-1), np.searchsorted(last, tokens.stops)[:-1])

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Places of the tokens of ``a`` and of ``b`` that overlap: one link up to every end of either."""
        others = np.flatnonzero(~self.cut_b)  # ends of b alone
        a = np.concatenate([np.arange(len(self.a.ids)), np.searchsorted(self.a.ends, self.b.ends[others])])
        return a, np.concatenate([np.searchsorted(self.b.ends, self.a.ends), others])


@cache
def _decimals() -> np.ndarray:
    """The digits of every id and a comma, in rows of equal width filled with zeros."""
    width = len(str(1 << ID_BITS))
    rows = np.full((1 << ID_BITS, width + 1), ord(","), "u1")
    rows[:, :width] = np.arange(1 << ID_BITS).astype(f"S{width}").view("u1").reshape(-1, width)
    return rows


def _spelt(some: Tokens, cut: np.ndarray, last: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids in decimal, a comma after each or ``last`` where a group ends: bytes in rows filled with zeros, and their group."""
    rows = _decimals()[some.ids]
    rows[cut, -1] = last[0]
    return rows, np.cumsum(cut) - cut


def group_texts(aligned: Aligned) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` of each text."""
    a_rows, a_group = _spelt(aligned.a, aligned.cut_a, b"|")
    b_rows, b_group = _spelt(aligned.b, aligned.cut_b, b";")
    order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
    rows = np.concatenate([a_rows, b_rows])[order]
    spelt, held = rows[rows > 0].tobytes(), np.cumsum((rows > 0).sum(axis=1))
    stops = [0, *(int(held[n - 1]) if n else 0 for n in (aligned.a.stops + aligned.b.stops).tolist())]
    return [spelt[first : stop - 1] if stop > first else b"" for first, stop in zip(stops, stops[1:])]


def _some_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    """Ids and texts, some bytes at once."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append(text)
            held += len(text or "")
            if held >= TEXT_BYTES_AT_ONCE:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


# -- tables ---------------------------------------------------------------------------------------


def align_documents(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """``GROUPS``: the ids of both tokenizers, and how many of them each group holds."""
    ship_package(docs.sparkSession)

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _tokenizer(ByteLevel, path_a), _tokenizer(Pieces, path_b)
        for ids, texts in _some_texts(batches):
            found = Aligned(texts, a, b)
            parts = [np.split(found.a.ids, found.a.stops[:-1]), np.split(found.b.ids, found.b.stops[:-1])]
            parts += [found.sizes(found.a, found.cut_a), found.sizes(found.b, found.cut_b)]
            arrays = [pa.array(ids, pa.int64()), *(pa.array(list(part), pa.list_(pa.int32())) for part in parts)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "a_ids", "b_ids", "a_sizes", "b_sizes"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(align, GROUPS)


def linked_ids(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B) -> DataFrame:
    """``LINKED``: what each document holds, and its different id pairs.

    A link is one number: how often the pair is linked, then the id of b, then that of a in its last ``ID_BITS`` bits.
    """
    ship_package(docs.sparkSession)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        a, b = _tokenizer(ByteLevel, path_a), _tokenizer(Pieces, path_b)
        row = TaskContext.get().partitionId() << 40
        for ids, texts in _some_texts(batches):
            found = Aligned(texts, a, b)
            a_at, b_at = found.links()
            text_of = np.searchsorted(found.a.stops, a_at, "right")
            pairs = found.b.ids[b_at] << ID_BITS | found.a.ids[a_at]
            keys, times = np.unique(text_of << 2 * ID_BITS | pairs, return_counts=True)
            held = keys >> 2 * ID_BITS
            links = times << 2 * ID_BITS | keys & (1 << 2 * ID_BITS) - 1
            places = np.searchsorted(held, np.arange(len(ids) + 1))
            texts_of_groups = group_texts(found)
            columns = {
                "row": pa.array(np.arange(row, row + len(ids))),
                "doc_id": pa.array(ids, pa.int64()),
                "n_a": pa.array(found.a.counts),
                "n_b": pa.array(found.b.counts),
                "n_groups": pa.array([len(x) for x in found.sizes(found.a, found.cut_a)], pa.int64()),
                "n_links": pa.array(np.bincount(text_of, minlength=len(ids)).astype("i8")),
                "groups_sha256": pa.array([hashlib.sha256(x).hexdigest() if x else "" for x in texts_of_groups]),
                "links": pa.ListArray.from_arrays(pa.array(places.astype("i4")), pa.array(links)),
            }
            row += len(ids)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(link, LINKED)


def count_pairs(linked: DataFrame) -> DataFrame:
    """``pair, held, best, weight`` of the id pairs of ``LINKED``: documents that hold it (twice), and whether no pair of its id of a is held by more."""
    pair = F.col("link").bitwiseAND((1 << 2 * ID_BITS) - 1)
    held = linked.select(F.explode("links").alias("link")).groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("held"))
    held = written(held.withColumn("a", F.col("pair").bitwiseAND((1 << ID_BITS) - 1)), "alignment-pairs")
    most = held.groupBy("a").agg(F.max("held").alias("most"))  # at most one row an id
    return held.join(F.broadcast(most), "a").select("pair", "held", (F.col("held") == F.col("most")).alias("best"), F.col("held").alias("weight"))


def alignment_summary(docs: DataFrame, path_a: str = TOKENIZER_A, path_b: str = TOKENIZER_B, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each document."""
    linked = written(linked_ids(docs, path_a, path_b), "alignment-links")
    pairs = written(count_pairs(linked), "alignment-counts")
    links = linked.select("row", F.explode("links").alias("link")).select(
        "row", F.shiftright("link", 2 * ID_BITS).alias("times"), F.col("link").bitwiseAND((1 << 2 * ID_BITS) - 1).alias("pair")
    )
    sums = (
        join_unique(links, pairs, ["pair"], "weight", broadcast_pairs)
        .groupBy("row")
        .agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("held")).alias("count_sum"))
    )
    zero = F.lit(0).cast("long")
    return linked.drop("links").join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256",
    )
