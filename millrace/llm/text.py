"""Words and their hashes inside Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

TEXTS_AT_ONCE = 500

_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def chunks(batches: Iterator[pa.RecordBatch], rows: int = TEXTS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, so that memory follows the texts and not Spark's batch size."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def lowered(texts: pa.Array) -> list[bytes]:
    """UTF-8 of each text with A-Z in lower case; null counts as empty."""
    return [(text or b"").lower() for text in texts.cast(pa.binary()).to_pylist()]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts in order, and the number of words of each text.

    Words are split at ASCII white space, as ``bytes.split`` does.
    """
    split = [text.split() for text in texts]
    digest = xxhash.xxh3_64_digest
    hashes = np.frombuffer(b"".join(b"".join(map(digest, words)) for words in split), ">u8").astype("u8")
    return hashes, np.array([len(words) for words in split], "i8")


def endings(texts: list[bytes]) -> np.ndarray:
    """The last three bytes of every word of all texts, in order, as one number; shorter words count from a space."""
    held = np.frombuffer(b"  " + b"\n".join(texts) + b"\n", "u1")
    space = _IS_SPACE[held]
    last = np.flatnonzero(~space[:-1] & space[1:])
    clean = np.where(space, 0x20, held).astype("i8")
    third = np.where(space[last - 1], 0x20, clean[last - 2])
    return clean[last] << 16 | clean[last - 1] << 8 | third


def mixed(hashes: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits (the finaliser of splitmix64)."""
    x = hashes.astype("u8")
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every ``size`` words in a row of one text."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, "u8")
    total = np.zeros(n, "u8")
    for i, factor in enumerate(mixed(np.arange(1, size + 1)) | np.uint64(1)):
        total += words[i : i + n] * factor
    return mixed(total)
