"""Operators on literal facts: coupling, cohesion, cycles, duplication, verdicts, rules, ratchet, drift."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from modgauge.operators import coupling, delta, duplication, graph, ratchet, report, resolve, trend


def pairs(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_coupling_counts_foreign_imports_out_only(spark):
    imports = pairs(spark, [("a", "fmt"), ("a", "b"), ("c", "b"), ("c", "b")], "module string, target string")
    packages = pairs(spark, [("a",), ("b",), ("c",)], "module string")
    assert {tuple(r) for r in coupling.coupling(imports, packages).collect()} == {("a", 0, 2), ("b", 2, 0), ("c", 0, 1)}


def test_type_counts(spark):
    types = [("m", f"T{i}", True, i in (5, 6), i in (0, 1, 5)) for i in range(7)] + [("m", "t", False, False, False)]
    got = coupling.type_counts(pairs(spark, types, "module string, type string, exported boolean, is_alias boolean, is_iface boolean")).first()
    assert (got.exported_types, got.abstract_types) == (7, 2)


@pytest.mark.parametrize("rows, want", [([("s", "m1", "f"), ("s", "m2", "f")], 1), ([("s", "m1", "f"), ("s", "m2", "g")], 2), ([("s", None, None)], 0), ([("s", "m", None)], 1), ([("s", "m1", "f"), ("s", "m2", "f"), ("s", "m2", "g"), ("s", "m3", "g"), ("s", "m4", None)], 2)])
@pytest.mark.parametrize("local_rows", [0, 256])
def test_cohesion(spark, rows, want, local_rows):
    assert graph.cohesion(pairs(spark, rows, "scope string, method string, field string"), local_rows).first().lcom == want


def test_cohesion_by_rounds_equals_that_within_rows(spark):
    rows = [(f"s{i % 7}", f"m{i * 31 % 97}", None if i % 11 == 0 else f"f{i * 17 % 61}") for i in range(400)]
    facts = pairs(spark, rows, "scope string, method string, field string")
    by = [{tuple(r) for r in graph.cohesion(facts, n).collect()} for n in (0, 57, 256)]
    assert len(by[0]) == 7 and by[0] == by[1] == by[2]


def test_implements_needs_all_methods_and_a_method(spark):
    ifaces = pairs(spark, [("i", 1), ("i", 2), ("i", 2), ("j", 1), ("k", 9), ("k", 1)], "iface string, method int")
    types = pairs(spark, [("a", 1), ("a", 2), ("b", 1), ("b", 1), ("c", 3)], "type string, method int")
    assert {tuple(r) for r in coupling.implements(ifaces, types).collect()} == {("i", "a"), ("j", "a"), ("j", "b")}


def test_steady_mean_of_any_order(spark):
    mean = lambda v: pairs(spark, [(x,) for x in v], "x double").agg(report.steady_mean(F.col("x")).alias("m")).first().m
    values = [0.1, 0.7, 1 / 3, 0.9, 0.2]
    assert mean(values) == mean(values[::-1]) == pytest.approx(sum(values) / 5) and mean([]) == 0


@pytest.mark.parametrize("square", [0, 64])
def test_cycles_by_both_ways(spark, square):
    edges = [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "c"), ("f", "f"), ("g", "a"), ("e", "h"), ("x", "y"), ("y", "z"), ("z", "x"), ("z", "a")]
    got = graph.strong_components(pairs(spark, edges, "src string, dst string"), square).collect()
    assert {tuple(r) for r in got} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("x", "x"), ("y", "x"), ("z", "x")}


@pytest.mark.parametrize("square", [0, 64])
def test_no_cycle(spark, square):
    assert graph.strong_components(pairs(spark, [("a", "b")], "src string, dst string"), square).count() == 0


def test_duplicates(spark):
    rows = [("m", f, 1, 9, 8, "body") for f in "abc"] + [("m", "d", 1, 5, 5, "body"), ("n", "e", 1, 9, 8, "body")]
    blocks = pairs(spark, rows, "module string, file string, start long, end long, sig_lines long, norm_body string")
    assert duplication.duplicate_pairs(blocks).count() == 3 and duplication.duplicate_classes(blocks).count() == 3


def test_percentages_take_first_or_longest(spark):
    blocks = pairs(spark, [("m", "f", 1, 9, 8, 0.9, 0), ("m", "f", 1, 9, 10, 0.9, 1)], "module string, file string, start long, end long, line_count long, similarity double, idx int")
    modules = pairs(spark, [("m", 100)], "module string, total_lines long")
    assert duplication.module_percent(blocks, modules).first().dup_percent == 8.0 and duplication.overall_percent(blocks, modules).first().dup_percent == 10.0


def graph_of(spark, rows):
    return pairs(spark, rows, "module string, ca long, ce long, instability double, abstractness double, distance double, lcom long")


def cycles_of(spark, rows):
    return pairs(spark, [(r,) for r in rows], "members array<string>")


@pytest.mark.parametrize("base, change, old, new, want, direction", [
    ((0.5, 0.2, 1), (0.5, 0.2, 1), [["a", "b"]], [], "APPROVE", "improving"), ((0.5, 0.2, 1), (0.5, 0.2, 1), [], [["a", "b"]], "REQUEST_CHANGES", "degrading"), ((0.5, 0.2, 1), (0.55, 0.2, 1), [], [], "COMMENT", "stable"),
    ((0.0, 0.2, 1), (0.14999, 0.2, 1), [], [], "REQUEST_CHANGES", "degrading"), ((0.0, 0.2, 1), (0.14994, 0.2, 1), [], [], "COMMENT", "stable"), ((0.5, 0.2, 1), (0.5, 0.2, 3), [], [], "REQUEST_CHANGES", "degrading"),
    ((0.5, 0.5, 1), (0.5, 0.2, 1), [], [], "APPROVE", "improving"), ((0.5, 0.2, 1), (0.49996, 0.2, 1), [], [], "APPROVE", "stable"), ((0.5, 0.2, 1), (0.5, 0.2, 1), [["b", "a"]], [["a", "b"]], "APPROVE", "stable"),
])
def test_verdict(spark, base, change, old, new, want, direction):
    row = lambda x: graph_of(spark, [("a", 1, 1, x[0], 0.0, x[1], x[2])])
    modules, cycles = delta.module_delta(row(base), row(change)), delta.cycle_delta(cycles_of(spark, old), cycles_of(spark, new))
    assert (delta.verdict(modules, cycles).first()[0], delta.direction(modules, cycles).first()[0]) == (want, direction)
    assert delta.verdict(modules, cycles, reliable=False).first()[0] == "COMMENT"


def test_thresholds_only_tighten():
    assert delta.Thresholds().tightened(instability=0.0).instability == 0.0
    for bad in (0.16, -0.1, float("nan")):
        with pytest.raises(ValueError):
            delta.Thresholds().tightened(instability=bad)


MODULE = "module string, ca long, ce long, exported_types long, abstract_types long, instability double, abstractness double, distance double, lcom long, zone string, total_lines long"
BLOCK = "module string, file string, start long, end long, line_count long, similarity double, idx int"


def test_rules_and_report(spark):
    modules = pairs(spark, [("pkg/monolith", 2, 2, 1, 0, 0.5, 0.0, 0.25, 5, "normal", 700), ("pkg/hub", 1, 21, 1, 0, 0.8, 0.0, 0.25, 1, "normal", 500)], MODULE)
    none = pairs(spark, [], BLOCK)
    cycles = cycles_of(spark, [])
    agg = report.graded(report.aggregates(modules, cycles, none)).first()
    assert (agg.mean_instability, agg.mean_distance, agg.max_lcom) == (0.65, 0.25, 5)
    assert (agg.g_distance, agg.g_lcom, agg.g_cycles, agg.g_duplication, agg.g_spread) == ("B", "C", "A", "A", "A")
    hits = report.rule_hits(modules, graph.participation(cycles), report.dup_facts(none, modules))
    assert [(r.rule, r.severity) for r in report.recommendations(hits).collect()] == [("lcom4-split", "red"), ("ce-decouple", "yellow")]
    assert [r.rule for r in report.recommendations(hits.where("false")).collect()] == ["all-clear"]


def test_violations_are_strict(spark):
    modules = pairs(spark, [("a", 0, 0, 0, 0, 0.5, 0.0, 0.5, 2, "normal", 1)], MODULE)
    dup = pairs(spark, [("a", 10.0)], "module string, dup_percent double")
    got = report.violations(modules, dup, {"instability": 0.5, "distance": 0.4, "lcom": 1, "duplication": 10}).collect()
    assert [(r.metric, r.value) for r in got] == [("distance", 0.5), ("lcom", 2.0)]
    with pytest.raises(ValueError):
        report.violations(modules, dup, {"lcom": 0})


def test_ratchet(spark):
    measured = pairs(spark, [("a", 100.0), ("b", 40.0), ("m", 60.0), ("n", 70.0), ("r", 90.5)], "package string, percent double")
    floors = pairs(spark, [("b", 80.0), ("gone", 50.0), ("m", 60.0), ("r", 90.0)], "package string, floor double")
    status = lambda df: {r.package: r.status for r in df.collect()}
    assert status(ratchet.evaluate(measured, floors)) == {"a": "unregistered", "b": "below-floor", "gone": "stale-floor", "m": "pass", "n": "unregistered", "r": "pass"}
    updated = ratchet.update(measured, floors)
    assert status(updated) == {"a": "added", "b": "below-floor", "gone": "stale-floor", "m": "unchanged", "n": "refused", "r": "raised"}
    assert {tuple(r) for r in ratchet.next_floors(updated, floors).collect()} == {tuple(r) for r in floors.collect()}
    good = ratchet.update(measured.where("package in ('a', 'm', 'r')"), floors.where("package in ('m', 'r')"))
    assert {tuple(r) for r in ratchet.next_floors(good, floors).collect()} == {("a", 100.0), ("m", 60.0), ("r", 90.5)}


@pytest.mark.parametrize("metric, values, want", [("instability", [0.30, 0.35, 0.39, 0.43, 0.48], "degrading"), ("distance", [0.50, 0.45, 0.41, 0.38, 0.34], "improving"), ("instability", [0.50, 0.52, 0.47, 0.53, 0.49], "stable"), ("lcom", [1.0, 2.0], "insufficient-data"), ("lcom", [2.0] * 5, "stable")])
def test_trends(spark, metric, values, want):
    day = datetime(2024, 3, 1)
    series = pairs(spark, [("p", metric, day + timedelta(i), v) for i, v in enumerate(values)], "package string, metric string, generated_at timestamp, value double")
    assert trend.classified(trend.regression(series, 7)).first().trend == want


def test_streaks(spark):
    day = datetime(2024, 3, 1)
    series = pairs(spark, [("p", "instability", day + timedelta(i), 0.1 * i) for i in range(6)] + [("q", "instability", day + timedelta(i), 0.5) for i in range(6)], "package string, metric string, generated_at timestamp, value double")
    assert [(r.package, r.streak) for r in trend.streaks(series).collect()] == [("p", 5)]


def test_paths(spark):
    targets = pairs(spark, [(1, "pkg.sub.mod"), (2, "os.path"), (3, "pkg")], "id int, target string")
    modules = pairs(spark, [("pkg",), ("pkg.sub",)], "module string")
    assert {tuple(r) for r in resolve.longest_prefix(targets, modules, "id").collect()} == {(1, "pkg.sub"), (2, None), (3, "pkg")}
    includes = pairs(spark, [("src/a", "../b"), ("src/a", "../../../x"), ("src/a", "./c")], "source string, target string")
    kinds = {r.target: r.kind for r in resolve.relative_targets(includes, pairs(spark, [("src/b",)], "module string")).collect()}
    assert kinds == {"../b": "edge", "../../../x": "external", "./c": "unresolved"}


def test_implements(spark):
    ifaces = pairs(spark, [("R", "read"), ("RW", "read"), ("RW", "write")], "iface string, method string")
    types = pairs(spark, [("F", "read"), ("F", "close")], "type string, method string")
    assert {tuple(r) for r in coupling.proximity(ifaces, types).collect()} == {("R", "producer"), ("RW", "consumer")}


def test_relabelling_keeps_components(spark):
    """The partition does not depend on row order or partitioning."""
    edges = pairs(spark, [(f"n{i * 7 % 50}", f"n{i * 11 % 50}") for i in range(60)], "src string, dst string")
    a = {tuple(r) for r in graph.strong_components(edges).collect()}
    assert a == {tuple(r) for r in graph.strong_components(edges.orderBy(F.desc("dst")).repartition(7), 0).collect()}
