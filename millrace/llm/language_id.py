"""Language identification by a bidirectional recurrent network over bytes.

Every byte of every text is labelled, in windows that cover the whole text, and a document's
probabilities are the mean over its bytes. The languages are those of the training documents.

Training uses at most ``docs_per_lang`` documents of each language, those with the smallest seeded hash
among the training folds, and ``windows_per_doc`` windows of each. Null languages teach nothing. Null texts
and texts without a letter are ``und`` with score 0, and so is everything if nothing could be
learned. Repeated rows score alike, an empty table gives an empty table, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import byte_gru
from millrace.llm.common import fold, fold_number
from millrace.llm.text import chunks

DOCS_PER_LANG = 200
WINDOWS_PER_DOC = 8
TRAIN_WIDTH = 64
STEPS = 250
BATCH = 192
WIDTH = 128  # bytes of a window when labelling
GROUP = 2048  # windows labelled at a time
SEED = 5
UNDETERMINED = "und"
LETTER = r"\p{L}"


def training_documents(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """``doc_id`` and ``lang`` of the sample: at most ``docs_per_lang`` ids of each language."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold_number(F.col("doc_id")) != 0))
    known = known.select("doc_id", "lang", F.pmod(fold(SEED, F.col("doc_id")), F.lit(1 << 30)).alias("order"))
    # few more than needed by a threshold on the hash, then exactly the smallest: nothing large is sorted
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * docs_per_lang + 50) / F.count(F.lit(1))).alias("share"))
    few = known.join(F.broadcast(share), "lang").where(F.col("order") < F.col("share") * (1 << 30))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    return few.withColumn("number", number).where(F.col("number") <= docs_per_lang).select("doc_id", "lang")


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, steps: int = STEPS) -> tuple[list[str], byte_gru.Network | None]:
    """The languages and a network that tells them apart."""
    sample = training_documents(docs, docs_per_lang).withColumnRenamed("lang", "known")
    texts = docs.select("doc_id", "text").where(F.regexp_like("text", F.lit(LETTER)))
    texts = texts.join(F.broadcast(sample.distinct()), "doc_id").select("doc_id", "known", "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = []
            for doc_id, lang, text in zip(*(c.to_pylist() for c in (batch.column(0).cast(pa.int64()), batch.column(1), batch.column(2).cast(pa.binary()))), strict=True):
                rng = np.random.default_rng([SEED, doc_id & 0xFFFFFFFF])
                repeated = text * (-(-TRAIN_WIDTH // len(text)))  # short texts fill a window
                for i, at in enumerate(rng.integers(0, len(repeated) - TRAIN_WIDTH + 1, WINDOWS_PER_DOC).tolist()):
                    rows.append((doc_id, lang, i, repeated[at : at + TRAIN_WIDTH]))
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.binary())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "lang", "i", "window"])

    rows = sorted(texts.mapInArrow(cut, "doc_id long, lang string, i int, window binary").collect(), key=lambda r: (r["lang"], r["doc_id"], r["i"], bytes(r["window"])))
    langs = sorted({r["lang"] for r in rows})
    if not rows:
        return [], None
    windows = np.frombuffer(b"".join(bytes(r["window"]) for r in rows), "u1").reshape(-1, TRAIN_WIDTH)
    labels = np.array([langs.index(r["lang"]) for r in rows])
    # languages count alike, however many documents they have
    most = max(np.bincount(labels))
    balanced = np.concatenate([np.resize(np.flatnonzero(labels == k), most) for k in range(len(langs))])
    return langs, byte_gru.train(windows[balanced], labels[balanced], len(langs), steps, BATCH)


def document_probabilities(net: byte_gru.Network, texts: list[bytes], width: int = WIDTH) -> np.ndarray:
    """Mean probabilities over the bytes of each text; rows of zeros for empty texts."""
    sizes = np.array([len(x) for x in texts], "i8")
    counts = -(-sizes // width)
    first = np.concatenate([[0], np.cumsum(counts)])
    held = np.zeros((first[-1], width), "u1")
    flat = held.reshape(-1)
    for text, at in zip(texts, first.tolist(), strict=False):
        flat[at * width : at * width + len(text)] = np.frombuffer(text, "u1")
    lengths = np.full(first[-1], width)
    nonempty = np.flatnonzero(counts)
    lengths[first[1:][nonempty] - 1] = sizes[nonempty] - (counts[nonempty] - 1) * width
    sums = np.zeros((first[-1], len(net.bias)))
    order = np.argsort(lengths != width, kind="stable")  # whole windows need no mask
    for begin in range(0, len(order), GROUP):
        some = order[begin : begin + GROUP]
        sums[some] = byte_gru.label_windows(net, held[some], lengths[some])
    totals = np.zeros((len(texts), len(net.bias)))
    np.add.at(totals, np.repeat(np.arange(len(texts)), counts), sums)
    return totals / np.maximum(sizes, 1)[:, None]


def identify_languages(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, steps: int = STEPS) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` for each document."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, docs_per_lang, steps))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, net = model.value
        for batch in chunks(batches):
            lettered = np.array(batch.column(2).to_pylist(), bool)
            predicted, scores = np.full(batch.num_rows, UNDETERMINED, object), np.zeros(batch.num_rows)
            if net is not None and lettered.any():
                held = document_probabilities(net, batch.column(3).filter(pa.array(lettered)).cast(pa.binary()).to_pylist())
                predicted[lettered], scores[lettered] = np.array(langs, object)[held.argmax(1)], np.clip(held.max(1), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(predicted, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    lettered = F.coalesce(F.regexp_like("text", F.lit(LETTER)), F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), (fold_number(F.col("doc_id")) == 0).alias("held_out"), lettered.alias("lettered"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")
