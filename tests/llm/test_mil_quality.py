import math
import zlib

import numpy as np
import pytest

from modgauge.llm import mil_quality as op


def auc(score, y):
    order = np.argsort(np.argsort(score)) + 1
    n1 = y.sum()
    return (order[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.01"
    got = op.quality(spark, d).collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect() if r.quality is not None}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    y = np.array([label[r.doc_id] for r in held])
    assert auc(np.array([r.score for r in held]), y) > 0.9
    assert np.mean([r.predicted == label[r.doc_id] for r in held]) > 0.85
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()


def test_gradients_by_differences():
    model, r = op.Model(0.5), np.random.default_rng(1)
    x, starts, y = r.standard_normal((9, op.SIZE)), np.array([0, 2, 5]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean([np.log(p if t else 1 - p) for p, t in zip(model.forward(x, starts)[0], y, strict=True)])
    grad = model.gradients(x, starts, y)
    for k, w in model.w.items():
        for at in list(np.ndindex(w.shape))[:6]:
            was = w[at]
            w[at] = was + 1e-6
            up = loss()
            w[at] = was - 1e-6
            down = loss()
            w[at] = was
            assert grad[k][at] == pytest.approx((up - down) / 2e-6, abs=1e-6)


def test_attention_weighs_passages_of_whole_texts():
    x, starts = op.bags(["a b", "word " * 130, None, ""])
    assert starts.tolist() == [0, 1, 4, 5] and len(x) == 6 and not x[4].any()
    _, (_, _, _, _, weight, _, sizes) = op.Model(0.5).forward(x, starts)
    assert np.allclose(np.add.reduceat(weight, starts), 1) and sizes.tolist() == [1, 3, 1, 1]


def test_labels_outside_training_do_not_count(spark, docs, sf_dir):
    from pyspark.sql import functions as F

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    a = op.learnt(docs, labels)
    b = op.learnt(docs.withColumn("lang", F.lit("x")), labels.withColumn("quality", F.when(op.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert all(np.array_equal(a.w[k], b.w[k]) for k in a.w)


def test_edges(spark, edge, empty):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, None), (None, 1, 0), (6, 1, 0), (7, 0, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    got = op.scored(edge, op.learnt(edge, labels)).collect()
    assert len(got) == edge.count() and len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    none = op.learnt(edge, labels.where("false"))
    assert {r.score for r in op.scored(edge, none).collect()} == {0.5}
    assert op.scored(empty, none).count() == 0


def test_whole_table_against_plain_loops(spark, docs, sf_dir):
    """Scores of the query against a document at a time, passage by passage, with the learnt weights."""
    model = op.learnt(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    w = model.w

    def one(text):
        h = [np.tanh(np.clip((x - model.mean) / model.scale, -6, 6) @ w["e"] + w["eb"]) for x in op.passages(text)]
        raw = [float(((np.tanh(v @ w["v"]) / (1 + np.exp(-(v @ w["u"])))) @ w["a"])[0]) for v in h]
        share = [math.exp(r - max(raw)) for r in raw]
        z = sum(s * v for s, v in zip(share, h, strict=True)) / sum(share)
        return 1 / (1 + math.exp(-float((z @ w["o"] + w["ob"])[0])))

    got = {r.doc_id: r for r in op.quality(spark, sf_dir).collect()}
    for r in docs.collect():
        want = one(r.text)
        assert abs(got[r.doc_id].score - want) < 1e-6 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.3)
