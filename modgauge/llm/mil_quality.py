"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words. Each passage is encoded by the make-up of its characters; a
small network embeds it, a gated attention (tanh times sigmoid) weighs the passages, and the weighted mean
is scored. Weights are learnt from labels of whole documents only, on the driver, from a bounded sample.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of

PASSAGE = 64
#: Documents to learn from, and characters each may have: the only bound, of the classifier's sample.
LEARN_DOCS, LEARN_CHARS = 3000, 30_000
THRESHOLD, SEED, EPOCHS, BATCH, RATE, WIDTH, GATE = 0.3, 5, 40, 128, 0.02, 12, 8

CLASSES = 16
_CLASS = np.full(256, 15, np.uint8)
for _k, _chars in enumerate((" \t\x0b\x0c\r", "\n", string.ascii_lowercase, string.ascii_uppercase, string.digits, ".", ",;:", "!", "?", "|", "#*$%&<>", "\"'`", "()[]{}", "@/\\_~^=+-", "")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 14
SIZE = CLASSES + 4


def passages(text: str | None) -> np.ndarray:
    """A row of SIZE numbers for each passage of the whole text; one row of zeros where there is no word."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    kind = _CLASS[raw]
    blank = kind <= 1
    starts = np.flatnonzero(~blank & np.concatenate(([True], blank[:-1]))) if len(raw) else np.zeros(0, np.int64)
    if not len(starts):
        return np.zeros((1, SIZE), np.float32)
    n = -(-len(starts) // PASSAGE)
    edges = np.concatenate(([0], starts[PASSAGE::PASSAGE]))
    of = np.repeat(np.arange(n), np.diff(np.append(edges, len(raw))))
    count = np.bincount(of * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    n_words = np.full(n, PASSAGE, np.float32)
    n_words[-1] = len(starts) - PASSAGE * (n - 1)
    solid = np.maximum(1, count[:, 2:].sum(axis=1))
    share = np.concatenate((count[:, :2] / n_words[:, None], count[:, 2:] / solid[:, None]), axis=1)
    more = np.stack((np.log1p(n_words), solid / n_words / 8, np.full(n, np.log1p(n)), count[:, 9:11].sum(axis=1) / n_words), axis=1)
    return np.concatenate((np.sqrt(share), more), axis=1).astype(np.float32)


def bags(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts, and where each text's begin."""
    rows = [passages(t) for t in texts]
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.concatenate(rows) if rows else np.zeros((0, SIZE), np.float32), np.cumsum(sizes) - sizes


class Model:
    """Gated attention pooling; plain numbers, so that it travels with the tasks."""

    def __init__(self, prior: float):
        r = np.random.default_rng(SEED)
        draw = lambda *shape: (r.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float64)
        self.mean, self.scale, self.prior = np.zeros(SIZE), np.ones(SIZE), prior
        self.w = {"e": draw(SIZE, WIDTH), "eb": np.zeros(WIDTH), "v": draw(WIDTH, GATE), "u": draw(WIDTH, GATE), "a": draw(GATE, 1), "o": draw(WIDTH, 1), "ob": np.zeros(1)}
        self.fitted = False

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ w["e"] + w["eb"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        logit = ((t * g) @ w["a"])[:, 0]
        sizes = np.diff(np.append(starts, len(x)))
        weight = np.exp(logit - np.repeat(np.maximum.reduceat(logit, starts), sizes))
        weight /= np.repeat(np.add.reduceat(weight, starts), sizes)
        z = np.add.reduceat(weight[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["o"] + w["ob"], -30, 30)[:, 0]))
        return p, (x, h, t, g, weight, z, sizes)

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict:
        w = self.w
        p, (x, h, t, g, weight, z, sizes) = self.forward(x, starts)
        d = ((p - y) / len(y))[:, None]
        out = {"o": z.T @ d, "ob": d.sum(axis=0)}
        dz = np.repeat(d @ w["o"].T, sizes, axis=0)
        dh = weight[:, None] * dz
        gain = (h * dz).sum(axis=1)
        mean = np.repeat(np.add.reduceat(weight * gain, starts), sizes)
        dl = (weight * (gain - mean))[:, None]
        out["a"] = (t * g).T @ dl
        dtg = dl @ w["a"].T
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        out["v"], out["u"] = h.T @ dt, h.T @ dg
        dh = (dh + dt @ w["v"].T + dg @ w["u"].T) * (1 - h * h)
        out["e"], out["eb"] = x.T @ dh, dh.sum(axis=0)
        return out

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> Model:
        """Adam over shuffled bags; the order of the bags and the seed fix the result."""
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 0.05
        r, ends = np.random.default_rng(SEED), np.append(starts[1:], len(x))
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        s, step = {k: np.zeros_like(v) for k, v in self.w.items()}, 0
        for epoch in range(EPOCHS):
            order = r.permutation(len(starts))
            for at in range(0, len(order), BATCH):
                some = order[at : at + BATCH]
                size = ends[some] - starts[some]
                first = np.cumsum(size) - size
                rows = np.repeat(starts[some] - first, size) + np.arange(size.sum())
                grad, step = self.gradients(x[rows], first, y[some]), step + 1
                for k, v in self.w.items():
                    gk = grad[k] + 1e-4 * v
                    m[k] = 0.9 * m[k] + 0.1 * gk
                    s[k] = 0.99 * s[k] + 0.01 * gk * gk
                    v -= RATE / (1 + epoch / 10) * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.99**step)) + 1e-8)
        self.fitted = True
        return self

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if not self.fitted:
            return np.full(len(texts), self.prior)
        return self.forward(*bags(texts))[0]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit from up to LEARN_DOCS labelled documents, drawn by a hash of doc_id at a rate set by their count.

    Null labels and held-out documents are left out. Without both labels the score is the share of label 1, or 0.5.
    """
    known = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_id"), F.col("quality").cast("int").alias("_y"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.col("_id").cast("string"), F.lit("quality")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = known.withColumn("_draw", draw).where(F.col("_draw") < min(1.0, LEARN_DOCS / max(1, total))).orderBy("_draw", "_id", "_y").limit(2 * LEARN_DOCS)
    short = docs.where(F.length("text") <= LEARN_CHARS).select("doc_id", "text")
    rows = short.join(F.broadcast(drawn), F.col("doc_id") == F.col("_id")).select("_draw", "_id", "_y", "text")
    rows = rows.orderBy("_draw", "_id", "_y", "text").limit(2 * LEARN_DOCS).collect()  # rows may repeat a doc_id
    y = np.array([float(r["_y"] > 0) for r in rows])
    model = Model(float(y.mean()) if len(y) else 0.5)
    return model.fit(*bags([r["text"] for r in rows]), y) if 0 < y.sum() < len(y) else model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = np.concatenate([sent.value.score(part) for _, part in parts_of(batch.column(2))] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64()), pa.array((score >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality(spark, sf_dir: str) -> DataFrame:
    """Contract of op8: doc_id, held_out, score, predicted.

    Null, empty and blank texts are one passage of zeros and get its score. Repeated rows are scored one by one; an
    empty table gives no row, and without labels every score is 0.5. Other columns are ignored.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scored(docs, learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
