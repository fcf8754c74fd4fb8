"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text's subwords are the byte n-grams (n in NGRAMS) of its lower-cased words, each word with
one blank at either side; they are hashed into BUCKETS embeddings.  The text's vector is their
average, a linear layer and softmax give the languages' probabilities.  Embeddings and
layer are trained together by stochastic gradient descent in numpy, on a bounded
sample of labelled rows (``per_language``, chosen by hash).

Calibration: a fifth of the sample is not trained on; there a temperature is fitted,
and the rejection threshold is the score that all but ``reject`` of these rows reach, at
most ``ceiling``.  A text is rejected if it scores below it or has no letter.

Prediction folds embeddings and layer into one value per (bucket, language), so a text's
logits are an average of table values; it is a map over whole texts without a shuffle.

Defined cases: null text, empty text and text without a letter give ``und`` with score 0;
rows without label are predicted but not learned from; without any learned
language every text is ``und``; repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapse.llm import wordhash as wh
from lapse.llm.common import BROADCAST_ROWS, numbered, stage

BITS = 16
BUCKETS = 1 << BITS
NGRAMS = (3, 4)
DIM = 16
SLICE = 1 << 17          # bytes of text classified at a time: some eighty times that are held meanwhile


def _letters(data: np.ndarray, off: np.ndarray, texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter (any alphabet)."""
    ascii_letter = ((data | 32) >= ord("a")) & ((data | 32) <= ord("z"))
    got = np.concatenate(([0], np.cumsum(ascii_letter)))
    has = got[off[1:]] > got[off[:-1]]
    for i in np.flatnonzero(~has):
        has[i] = any(c.isalpha() for c in texts[int(i)].as_py() or "")
    return has


def _grams(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: bucket ids of all n-grams in text order, and each text's first one (n + 1).

    White space counts as blank, n-grams that hold an inner blank or cross texts are left out, and
    every text has a blank at either end.
    """
    n_texts = len(off) - 1
    shift = np.arange(n_texts + 1)
    body = np.full(len(data) + n_texts + 1, 32, np.uint8)
    pad_off = off + shift                                   # position of the blank before each text
    at = np.arange(len(data)) + np.repeat(shift[:-1], np.diff(off)) + 1
    low = wh.LOWER[data]
    body[at] = np.where(wh.SPACE[low], 32, low)
    blank = body == 32
    code = body.astype(np.uint64)
    for n in NGRAMS:
        m = len(body) - n + 1
        if m <= 0:
            yield np.zeros(0, np.int64), np.zeros(n_texts + 1, np.int64)
            continue
        h = np.zeros(m, np.uint64)
        inner = np.zeros(m, bool)
        for k in range(n):
            h = h * np.uint64(257) + code[k:k + m]
            if 0 < k < n - 1:
                inner |= blank[k:k + m]
        ok = np.flatnonzero(~inner)
        ids = ((h[ok] + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        yield ids.astype(np.int64), np.searchsorted(ok, pad_off)


@dataclass
class Model:
    """labels; table: (buckets, labels) logits of each subword; bias; temperature; threshold."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        total, count = np.zeros((n, len(self.labels))), np.zeros(n)
        for ids, first in _grams(data, off):
            some = np.diff(first) > 0
            count += np.diff(first)
            if not len(ids):
                continue
            for j in range(len(self.labels)):
                v = np.concatenate((self.table[:, j][ids], [0.0]))
                total[some, j] += np.add.reduceat(v, first[:-1][some])[:some.sum()] if some.any() else 0.0
        return total / np.maximum(count, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Label, score and whether rejected, of every text."""
        data, off = wh.utf8(texts)
        pred = np.full(len(texts), -1)
        score = np.zeros(len(texts))
        for i, j in wh.slices(off, SLICE):
            d, o = data[off[i]:off[j]], off[i:j + 1] - off[i]
            has = _letters(d, o, texts.slice(i, j - i))
            if self.labels:
                p = _softmax(self.logits(d, o) / self.temperature)
                pred[i:j] = np.where(has, p.argmax(1), -1)
                score[i:j] = np.where(has, p.max(1), 0.0)
        return [self.labels[k] if k >= 0 else "und" for k in pred], score, (pred < 0) | (score < self.threshold)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _counts(texts: pa.Array) -> Iterator[tuple[list[int], list[int]]]:
    """Bucket ids with their counts, of every text."""
    data, off = wh.utf8(texts)
    for i in range(len(off) - 1):
        o = np.array([0, off[i + 1] - off[i]])
        ids = np.concatenate([g for g, _ in _grams(data[off[i]:off[i + 1]], o)])
        u, c = np.unique(ids, return_counts=True)
        yield u.tolist(), c.tolist()


def train(samples: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.5, seed: int = 7,
          reject: float = 0.001, ceiling: float = 0.5) -> Model:
    """``samples``: (label, bucket ids, counts) of each text, in a fixed order."""
    labels = sorted({s[0] for s in samples})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    lin, bias = rng.normal(0, 0.1, (DIM, len(labels))), np.zeros(len(labels))
    held = [k % 5 == 4 for k in range(len(samples))]
    learn = [k for k in range(len(samples)) if not held[k]] or list(range(len(samples)))
    total = epochs * len(learn)
    step = 0
    for _ in range(epochs):
        for k in rng.permutation(learn):
            label, ids, counts = samples[k]
            step += 1
            if not len(ids):
                continue
            lr = rate * (1 - step / (total + 1))
            w = counts / counts.sum()
            x = w @ emb[ids]
            z = x @ lin + bias
            g = np.exp(z - z.max())
            g /= g.sum()
            g[labels.index(label)] -= 1
            back = lin @ g
            lin -= lr * np.outer(x, g) * 10
            bias -= lr * g * 0.1
            # an n-gram's share of the average is small; steps are scaled to a mean share of 1
            emb[ids] -= (lr * len(ids) * np.minimum(w, 4 / len(ids)))[:, None] * back
    model = Model(labels, emb @ lin, bias)
    test = [k for k in range(len(samples)) if held[k] and len(samples[k][1])] or [k for k in learn if len(samples[k][1])]
    if test:
        z = np.array([(samples[k][2] / samples[k][2].sum()) @ model.table[samples[k][1]] + bias for k in test])
        y = np.array([labels.index(samples[k][0]) for k in test])
        grid = [2.0 ** e for e in np.arange(-3, 5.5, 0.5)]
        loss = [-np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / model.temperature)
        model.threshold = float(min(ceiling, np.quantile(p.max(1), reject)))
    return model


def fit(docs: DataFrame, learn: Column, per_language: int = 600, **options) -> Model:
    """Train on about ``per_language`` rows of each label among the rows where ``learn`` holds.

    The sample takes rows by a hash of doc_id, at the share that the label's number of rows
    gives (all rows of a label that has fewer); its subword counts come to the driver.
    """
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    n = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not n:
        return train([])
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, per_language / v))) for k, v in n.items()])
    u = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.where(u < share).select(F.coalesce("doc_id", F.lit(0)).cast("long").alias("doc_id"), "lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(_counts(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang").cast(pa.string()),
                 *[pa.array([np.array(g[i], np.int32).tobytes() for g in got], pa.binary()) for i in (0, 1)]],
                ["doc_id", "lang", "ids", "counts"])

    # the driver holds eight bytes for each n-gram of the sample and lets go of them when it has learned
    t = picked.mapInArrow(count, "doc_id long, lang string, ids binary, counts binary").toArrow()
    got = sorted(zip(*[t.column(i).to_pylist() for i in range(4)]),
                 key=lambda r: (math.floor(r[0] * 0.6180339887498949 % 1 * 1e9), *r[:3]))
    del t
    return train([(label, np.frombuffer(i, np.int32), np.frombuffer(c, np.int32)) for _, label, i, c in got], **options)


def _predictor(docs: DataFrame, model: Model):
    """Function of a text column: struct of lang_pred, score and rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred:string,score:double,rejected:boolean>")
    def score(text: pa.Array) -> pa.Array:
        label, s, rejected = shared.value.predict(text)
        return pa.StructArray.from_arrays([pa.array(label, pa.string()), pa.array(s, pa.float64()),
                                           pa.array(rejected, pa.bool_())], ["lang_pred", "score", "rejected"])

    return score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score and rejected (columns of these names are replaced)."""
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    return docs.select(*keep, _predictor(docs, model)("text").alias("_p")).select(*keep, "_p.*")


def held_out() -> Column:
    """Rows that no model learns from: crc32 of doc_id as text, mod 3, is 1 (null counts as 'null')."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), F.lit(3)) == 1


def identify(docs: DataFrame, **options) -> DataFrame:
    """Fit on the rows that are not held out and predict all: doc_id, held_out, lang_pred, score, rejected."""
    model = fit(docs, ~held_out(), **options)
    return predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model).select(
        "doc_id", "held_out", "lang_pred", "score", "rejected")


#: Spark's setting for the rows of an Arrow batch, and its value while whole documents are classified.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


def identified_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` without the rejected ones, same columns.  The rejected rows are listed by name; no text is copied."""
    spark = docs.sparkSession
    model = fit(docs, ~held_out(), **options)
    d, names = numbered(docs)
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, BATCH_ROWS)
    try:
        seen = d.select(*names, _predictor(docs, model)(F.col("_row.text")).alias("_p"))
        gone = stage(seen.where("_p.rejected").select(*names), "rejected")
    finally:
        spark.conf.set(BATCH, before)
    few = gone.count() <= BROADCAST_ROWS
    return d.join(F.broadcast(gone) if few else gone, names, "left_anti").select("_row.*")
