import duckdb
import pytest

from modgauge.llm import mixing as op


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def by_sql(df):
    con = duckdb.connect()
    con.register("documents", df.toPandas() if df.count() else df.toPandas().astype({"text": "str", "source": "str"}))
    return con.execute("select doc_id, size, source_size, target, taken from (" + op.ORACLE + ")").fetchall()


def test_whole_table(docs):
    got = op.mix_report(docs)
    assert key(got.collect()) == key(by_sql(docs.select("doc_id", "text", "source")))
    total = got.agg({"size": "sum"}).first()[0]
    rows = got.collect()
    assert abs(sum(r.taken for r in rows) - total) < 0.05 * total and all(r.taken <= 3 * r.size for r in rows)


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 1, "c": 1}, {"a": 5, "b": 0}, {"a": 1, "b": 1, "c": 1, "d": 100_000}])
def test_water_level(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, _size long")
    got = {r.source: r.target for r in op.source_targets(df).collect()}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    total, open_, want = sum(sizes.values()), set(sizes), {}
    while True:  # clamp and reshare until none is above
        left = total - sum(want.values())
        shares = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if shares[s] > 3 * sizes[s]}
        if not over:
            break
        want |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over
    assert got == pytest.approx(want | shares)


def test_taken_follows_target(docs):
    rows = op.mix_report(docs).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    for s in {*source.values()}:
        mine = [r for r in rows if source[r.doc_id] == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine)


def test_edges_and_reruns(edge, empty):
    a = op.mix_report(edge)
    assert key(a.collect()) == key(op.mix_report(edge.repartition(7)).collect()) == key(by_sql(edge.select("doc_id", "text", "source")))
    assert a.count() == edge.count() and op.mix_report(empty).count() == op.mixed(empty).count() == 0


def test_mixed_repeats_documents(edge):
    got = op.mixed(edge)
    assert got.columns == edge.columns
    want = sum(r.taken for r in op.mix_report(edge).collect())
    from modgauge.llm.common import n_words
    from pyspark.sql import functions as F

    assert got.select(F.sum(n_words(F.col("text")))).first()[0] == want


def test_mixed_repeats_no_document_more_than_three_times(spark):
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate([("", "a"), (None, "a"), (" ", "a"), ("one two", "a"), *[("w " * 40, "b")] * 5])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r["count"] for r in op.mixed(df).groupBy("doc_id").count().collect()}
    assert got[3] == 3 and max(got.values()) == 3 and all(got.get(i, 0) <= 3 for i in range(3))
