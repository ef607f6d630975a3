"""Components within workers: the same results as rounds, no rounds where numbers or scopes are near, few reads."""

import random
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_oracle import TABLES, rows

from modgauge.operators import graph, local
from modgauge.plans import facts
from modgauge.plans import queries as plans


def brute(edges):
    """(node, root) by reachability from every node."""
    to = {}
    for s, d in edges:
        to.setdefault(s, set()).add(d)
    reach = {}
    for s in to:
        seen, left = set(), [s]
        while left:
            for d in to.get(left.pop(), ()):
                if d not in seen:
                    seen.add(d)
                    left.append(d)
        reach[s] = seen
    return {(s, r) for s in reach if (same := [d for d in reach[s] if d != s and s in reach.get(d, ())]) for r in [min(*same, s)]}


def of(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


@pytest.mark.parametrize("limit", [1_000_000, 20, 0])
@pytest.mark.parametrize("far", [0.0, 0.1, 1.0])
def test_numbers_across_buckets(spark, monkeypatch, far, limit):
    """Cycles within a bucket, through several, and buckets that are too large all come out as by brute force."""
    monkeypatch.setattr(local, "BUCKET_EDGES", limit)
    r = random.Random(far)
    node = lambda b: (b - 2) * 2**local.BUCKET_BITS + r.randrange(40)
    edges = [(node(b), node(b if r.random() >= far else r.randrange(5))) for b in range(5) for _ in range(45)]
    edges += [(x, x) for x, _ in edges[:3]] + edges[:9]
    want = brute([(s, d) for s, d in edges if s != d])
    assert want and {tuple(x) for x in graph.strong_components(of(spark, edges)).collect()} == want


def test_near_cycles_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "_by_closure", None)
    monkeypatch.setattr(graph, "_by_colour", None)
    edges = [(8 * o + i, 8 * o + i + 1) for o in range(2000) for i in range(6)] + [(8 * o + 6, 8 * o + 2) for o in range(0, 2000, 2)]
    assert graph.strong_components(of(spark, edges)).count() == 5000


def test_scopes_of_thousands_of_rows_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(graph, "_rounds", None)
    facts = [("s", i, (i + j) % 3000 if i % 3 else None) for i in range(3000) for j in range(2)] + [("t", None, None), ("u", 1, None), ("u", 2, 5)]
    got = {tuple(r) for r in graph.cohesion(spark.createDataFrame(facts, "scope string, method long, field long")).collect()}
    assert got == {("s", 2000), ("t", 0), ("u", 2)}


def test_partitions_grow_with_rows(spark):
    facts = spark.createDataFrame([(i, i, i) for i in range(50)], "scope long, method long, field long")
    got = graph.cohesion(facts, n_rows=20 * local.PART_ROWS)
    assert got.rdd.getNumPartitions() == 21 and got.count() == 50


def test_diff_reads_each_table_few_times(spark, sf_dir, monkeypatch):
    read, table = [], facts.table
    monkeypatch.setattr(facts, "table", lambda spark, sf, name: read.append(name) or table(spark, sf, name))
    plans.queries()["v3_verdict"](spark, sf_dir)
    assert read.count("lineitem") <= 3 and read.count("orders") <= 4


@pytest.mark.parametrize("name", ["m1_module_metrics", "a6_cohesion", "a8_strong_components", "j1_module_delta", "j2_cycle_delta", "v3_verdict", "f1_violations"])
def test_modules_of_several_customers(spark, sf_dir, tmp_path, name):
    """Customers of one name and nation are one module: their orders, edges and cycles are merged as SQL does."""
    con = duckdb.connect()
    for t in TABLES:
        cells = "* replace ('C' || (c_custkey // 2 % 40) as c_name, cast(c_custkey // 2 % 3 as integer) as c_nationkey)" if t == "customer" else "*"
        con.execute(f"copy (select {cells} from '{sf_dir}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    df = plans.queries()[name](spark, str(tmp_path))
    cursor = con.execute(plans.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([c[0] for c in cursor.description], cursor.fetchall())


def test_long_paths_take_few_rounds():
    """A path of 20,000 methods is one component, found by few passes over its rows; a scope's batch holds others beside it."""
    n = 20_000
    a = np.arange(n).repeat(2)
    b = (a + np.tile([0, 1], n)) % n
    scope = np.concatenate([np.zeros(2 * n, dtype=np.int64), [1, 1, 2]])
    began = time.perf_counter()
    got = local._lcom(scope, 3, pa.array([*a, 5, 6, None], pa.int64()), pa.array([*b, 5, None, 3], pa.int64()))
    assert got.tolist() == [1, 2, 0] and time.perf_counter() - began < 5


def test_scopes_across_batches(spark):
    """Scopes that span batches, and those handed back as too large, count as they do by rounds."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        r = random.Random(5)
        facts = [(r.choice("abcdefgh") if i % 3 else "large", r.choice([None, *range(30)]), r.choice([None, *range(20)])) for i in range(300)]
        by = [{tuple(x) for x in graph.cohesion(spark.createDataFrame(facts, "scope string, method long, field long"), n).collect()} for n in (0, 40, 1000)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert by[0] == by[1] == by[2] and len(by[0]) == 9


def test_diff_rows_are_linear_in_modules_of_many_customers(spark, sf_dir, tmp_path):
    """Equal rows of a module meet as counts: a row a module until the end, and as many rows at the end as SQL has."""
    con = duckdb.connect()
    for t in TABLES:
        cells = "* replace ('C' as c_name, 1 as c_nationkey)" if t == "customer" else "*"
        con.execute(f"copy (select {cells} from '{sf_dir}/{t}.parquet') to '{tmp_path}/{t}.parquet' (format parquet)")
    n = con.execute(f"select count(*) from '{tmp_path}/customer.parquet'").fetchone()[0]
    deltas = facts.diff(spark, str(tmp_path), cycles=False)[0]
    assert [(r.copies_b, r.copies_c) for r in deltas.collect()] == [(n, n)]
    assert plans.queries()["j1_module_delta"](spark, str(tmp_path)).count() == n * n
