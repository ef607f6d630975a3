"""Every registered query against its SQL, on whole small tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from modgauge.plans import queries as plans

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def rows(names, values):
    order = sorted(range(len(names)), key=names.__getitem__)
    plain = lambda v: None if v is None or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def close(a, b):
    return a == b or isinstance(a, float) and isinstance(b, (int, float)) and math.isclose(a, b, abs_tol=2e-5)


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, duck, name):
    df = plans.queries()[name](spark, sf_dir)
    cursor = duck.execute(plans.oracle_sql()[name])
    ours, theirs = rows(df.columns, df.collect()), rows([c[0] for c in cursor.description], cursor.fetchall())
    assert ours[0] == theirs[0] and len(ours[1]) == len(theirs[1])
    assert all(close(x, y) for a, b in zip(ours[1], theirs[1], strict=True) for x, y in zip(a, b, strict=True))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle_sql())
