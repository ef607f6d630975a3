"""Boundary values of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from modgauge.functions import encode, metrics as m


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("ca, ce, want", [(0, 0, 0.0), (0, 3, 1.0), (3, 0, 0.0), (1, 3, 0.75)])
def test_instability(spark, ca, ce, want):
    assert one(spark, m.instability(F.lit(ca), F.lit(ce))) == want


@pytest.mark.parametrize("a, i, want", [(0.8, 0.0, "main-sequence"), (0.0, 0.0, "zone-of-pain"), (1.0, 1.0, "zone-of-uselessness"), (0.2, 0.1, "normal"), (0.5, 0.5, "main-sequence"), (0.8, 0.9, "normal")])
def test_zone(spark, a, i, want):
    a, i = F.lit(a), F.lit(i)
    assert one(spark, m.zone(i, a, m.distance(a, i))) == want


@pytest.mark.parametrize("x, want", [(0.14995, 0.15), (0.14994, 0.1499), (-0.00005, -0.0001), (0.0, 0.0)])
def test_round4(spark, x, want):
    assert one(spark, m.round4(F.lit(x))) == want


@pytest.mark.parametrize("f, values", [
    (m.distance_grade, {0.0: "A", 0.0999: "A", 0.1: "B+", 0.2: "B", 0.3: "C+", 0.5: "C", 0.7: "F"}), (m.lcom_grade, {1: "A", 2: "B+", 3: "B", 4: "C+", 5: "C", 6: "F"}),
    (m.cycle_grade, {0: "A", 1: "F"}), (m.duplication_grade, {0.0: "A", 0.1: "B+", 3.0: "B", 5.0: "C+", 10.0: "C", 15.0: "F"}), (m.spread_grade, {0: "A", 1: "B", 2: "C+", 3: "F"}),
])
def test_grades(spark, f, values):
    assert {x: one(spark, f(F.lit(x))) for x in values} == values


def test_names_and_paths(spark):
    assert one(spark, m.identity(F.lit("./a/b"), "python")) == "a.b" and one(spark, m.identity(F.lit("a/b"), "typescript")) == "a/b"
    assert [one(spark, m.last_name(F.lit(x))) for x in (".", "a.b", "a/b", "c")] == [".", "b", "b", "c"]
    assert one(spark, m.percent(F.lit(2), F.lit(3))) == 66.6 and one(spark, m.percent(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, m.cycle_chain(F.array(F.lit("a"), F.lit("b")))) == "a → b → a"


def test_sparkline(spark):
    line = lambda v: one(spark, m.sparkline(F.array(*map(F.lit, v))))
    assert line([0.5] * 5) == "▄▄▄▄▄" and line([0.0, 0.5, 1.0]) == "▁▄█" and len(line([float(i) for i in range(45)])) == 30


@pytest.mark.parametrize("x, want", [(1.0, "1"), (0.19999999999999996, "0.19999999999999996"), (1e-7, "1e-07"), (1e21, "1e+21"), (1e20, "100000000000000000000"), (0.000001, "0.000001"), (2.5e-8, "2.5e-08"), (-0.5, "-0.5"), (1e100, "1e+100")])
def test_numbers(x, want):
    assert encode.number(x) == want


def test_json_text():
    assert encode.dumps({"a": ["x >= <&>", None, True], "b": {}, "c": []}) == '{\n  "a": [\n    "x \\u003e= \\u003c\\u0026\\u003e",\n    null,\n    true\n  ],\n  "b": {},\n  "c": []\n}'
