"""Registered queries: each operator over whole tables, with columns named as in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..operators import coupling, delta, dialects, duplication, graph, ratchet, report, resolve, trend
from . import facts, registry
from .oracle import SQL
from .session import cut

LIMITS = {"instability": 0.8, "distance": 0.3, "lcom": 3}
REGISTRY: dict = {}


def query(name: str):
    def add(f):
        REGISTRY[name] = f
        return f

    return add


def _joined(members: str = "members"):
    return F.array_join(members, " ")


@query("m1_module_metrics")
def module_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return facts.modules(spark, sf)


@query("a1_a2_coupling")
def _(spark, sf):
    return coupling.coupling(facts.imports(spark, sf), facts.packages(spark, sf))


@query("j3_internal_edges")
def _(spark, sf):
    return coupling.internal_edges(facts.imports(spark, sf), facts.packages(spark, sf))


@query("a23_edge_counters")
def _(spark, sf):
    return coupling.counters(facts.imports(spark, sf), facts.packages(spark, sf))


@query("a4_type_counts")
def _(spark, sf):
    return coupling.type_counts(facts.types(spark, sf))


@query("a6_cohesion")
def _(spark, sf):
    return facts.cohesion(spark, sf)


@query("a8_cycles")
def _(spark, sf):
    return facts.cycles(spark, sf).select(_joined().alias("members"), F.size("members").cast("long").alias("n"))


@query("a8_strong_components")
def _(spark, sf):
    return facts.cycles(spark, sf).select(F.explode("members").alias("node"), F.col("members")[0].alias("root"))


@query("a16_participation")
def _(spark, sf):
    return graph.participation(facts.cycles(spark, sf)).withColumn("representative", _joined("representative"))


def _parts(spark, sf):
    """Modules, cycles and duplicate blocks: what a report is made of, computed once for a query."""
    modules, cycles = facts.graph_parts(spark, sf)
    return cut(modules), cut(cycles), cut(facts.dup_blocks(spark, sf))


def _agg(modules, cycles, blocks):
    return report.graded(report.aggregates(modules, cycles, blocks))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in names})


@query("a12_a13_aggregates")
def _(spark, sf):
    return _rounded(_agg(*_parts(spark, sf)), "mean_instability", "mean_distance", "dup_percent").drop("overall")


@query("a20_graph_stats")
def _(spark, sf):
    return facts.modules(spark, sf).agg(F.count("*").alias("n_modules"), F.sum("total_lines").cast("long").alias("total_lines"))


@query("a22_extremes")
def _(spark, sf):
    return coupling.extremes(facts.modules(spark, sf))


def _diff(spark, sf):
    modules, cycles = facts.diff(spark, sf)
    return cut(modules), cut(cycles)


@query("j1_module_delta")
def _(spark, sf):
    return delta.repeated(cut(facts.diff(spark, sf, cycles=False)[0]))


@query("j2_cycle_delta")
def _(spark, sf):
    return facts.diff(spark, sf, modules=False)[1].select(_joined().alias("members"), "state")


@query("a21_direction")
def _(spark, sf):
    return delta.direction(*_diff(spark, sf))


@query("o10_reasons")
def _(spark, sf):
    return delta.reasons(*_diff(spark, sf)).withColumn("subject", F.replace("subject", F.lit("\x00"), F.lit(" ")))


@query("v3_verdict")
def _(spark, sf):
    return delta.verdict(*_diff(spark, sf))


@query("f1_violations")
def _(spark, sf):
    modules, cycles = map(cut, facts.graph_parts(spark, sf))
    none = modules.where("false").select("module", F.lit(0.0).alias("dup_percent"))  # no duplication: counts as 0
    return _rounded(report.violations(modules, none, LIMITS, cycles), "value")


def _hits(modules, cycles, blocks):
    return report.rule_hits(modules, graph.participation(cycles), report.dup_facts(blocks, modules))


@query("v4_rule_hits")
def _(spark, sf):
    return _rounded(_hits(*_parts(spark, sf)), "extremity", "value")


@query("o9_recommendations")
def _(spark, sf):
    return _rounded(report.recommendations(_hits(*_parts(spark, sf))), "extremity", "value")


@query("v5_report_model")
def _(spark, sf):
    parts = _parts(spark, sf)
    one = _rounded(_agg(*parts), "mean_instability", "mean_distance", "dup_percent")
    return one.crossJoin(report.has_violations(_hits(*parts)))  # one row on either side


@query("f4_significant_lines")
def _(spark, sf):
    return facts.block_modules(spark, sf)


@query("j4_duplicate_pairs")
def _(spark, sf):
    return duplication.duplicate_pairs(facts.blocks(spark, sf)).select("module", "file_a", "file_b", "sig_lines_a", "sig_lines_b")


@query("j4_duplicate_classes")
def _(spark, sf):
    return duplication.duplicate_classes(facts.blocks(spark, sf)).select("module", "class", "n_blocks", "file", "sig_lines")


@query("a10_module_duplication")
def _(spark, sf):
    return _rounded(duplication.module_percent(facts.dup_blocks(spark, sf), facts.block_modules(spark, sf)), "dup_percent")


@query("a11_overall_duplication")
def _(spark, sf):
    return _rounded(duplication.overall_percent(facts.dup_blocks(spark, sf), facts.block_modules(spark, sf)), "dup_percent")


@query("a14_duplication_facts")
def _(spark, sf):
    return duplication.facts(facts.dup_blocks(spark, sf))


@query("a15_duplication_rows")
def _(spark, sf):
    return duplication.rows(facts.dup_blocks(spark, sf))


def _measured(spark, sf):
    return ratchet.coverage(facts.coverage_blocks(spark, sf))


@query("a17_coverage")
def _(spark, sf):
    return _measured(spark, sf)


@query("v6_ratchet_evaluate")
def _(spark, sf):
    return ratchet.evaluate(_measured(spark, sf), facts.floors(spark, sf))


@query("v7_ratchet_update")
def _(spark, sf):
    return ratchet.update(_measured(spark, sf), facts.floors(spark, sf))


@query("k8_next_floors")
def _(spark, sf):
    floors = facts.floors(spark, sf)
    return ratchet.next_floors(ratchet.update(_measured(spark, sf), floors), floors)


@query("a18_status_counts")
def _(spark, sf):
    return ratchet.status_counts(ratchet.evaluate(_measured(spark, sf), facts.floors(spark, sf)))


def _fits(spark, sf):
    series = facts.series(spark, sf)
    a, b, c = (trend.classified(trend.regression(series, d)) for d in trend.WINDOWS)
    return a.unionByName(b).unionByName(c)


@query("t1_t2_trends")
def _(spark, sf):
    return _rounded(_fits(spark, sf), "slope", "intercept", "r2", "current")


@query("t3_t5_crossings")
def _(spark, sf):
    return _rounded(trend.crossings(_fits(spark, sf)).select("package", "metric", "days", "days_ahead"), "days_ahead")


@query("t4_streaks")
def _(spark, sf):
    return trend.streaks(facts.series(spark, sf), 1)


@query("t6_retained")
def _(spark, sf):
    e = facts.table(spark, sf, "events").withColumnRenamed("ts", "generated_at")
    return trend.retained(e, F.lit("2024-06-20").cast("date")).select("event_id")


@query("t9_baseline")
def _(spark, sf):
    s = facts.series(spark, sf)
    last = s.agg(F.max("generated_at").alias("d"))
    with_last = s.crossJoin(last)  # one row on the right
    return trend.against_baseline(with_last.where("generated_at = d").select("package", "metric", "value"), with_last.where("generated_at < d"))


@query("j14_snapshot_dedup")
def _(spark, sf):
    e = facts.table(spark, sf, "events").select(F.col("event_type").alias("module_path"), F.col("user_id").cast("string").alias("commit"), "value")
    return trend.stored_once(e, e.where("value > 190").select("module_path", "commit")).select("module_path", "commit")


@query("j6_longest_prefix")
def _(spark, sf):
    u = facts.table(spark, sf, "pages").select("page_id", F.split(F.regexp_extract("url", "^[a-z]+://([^?#]*)", 1), "/").alias("seg"))
    two = u.where("size(seg) > 2").select(F.concat_ws("/", F.get("seg", F.lit(0)), F.get("seg", F.lit(1))).alias("module"))
    modules = two.union(u.select(F.get("seg", F.lit(0)))).distinct()
    return resolve.longest_prefix(u.select("page_id", F.array_join("seg", "/").alias("target")), modules, "page_id", "/")


@query("j12_implements")
def _(spark, sf):
    p = facts.table(spark, sf, "part")
    ifaces = p.select(F.concat_ws("/", "p_type", "p_name").alias("iface"), F.col("p_size").alias("method"))
    return coupling.implements(ifaces, p.select(F.col("p_brand").alias("type"), F.col("p_size").alias("method")))


@query("a19_interface_width")
def _(spark, sf):
    p = facts.table(spark, sf, "part").select(F.col("p_type").alias("module"), F.col("p_brand").alias("iface"), F.col("p_size").alias("method"))
    entries = F.transform(F.array_sort(F.map_entries("interface_width")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return coupling.interface_width(p).select("module", F.array_join(entries, ",").alias("widths"))


@query("u1_warning_union")
def _(spark, sf):
    files = facts.files(spark, sf)
    return dialects.warnings(files, *[a.warnings() for a in registry.default().adapters.values()])


@query("a5_python_type_counts")
def _(spark, sf):
    types = facts.types(spark, sf).withColumnRenamed("is_iface", "abstract")
    return coupling.python_type_counts(types)


@query("a8_order_components")
def _(spark, sf):
    return graph.strong_components(facts.line_edges(spark, sf))


@query("a9_lines_of_code")
def _(spark, sf):
    files = facts.files(spark, sf).withColumn("loc", F.size(F.split("text", "\n")).cast("long"))
    return duplication.loc_lines(files, (".py", ".ts"))


@query("f3_total_lines")
def _(spark, sf):
    return duplication.total_lines(facts.files(spark, sf).select(F.col("lang").alias("module"), F.col("path").alias("file"), "text"))


@query("f6_exported_names")
def _(spark, sf):
    p = facts.table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("_"), "p_name")).otherwise(F.col("p_name")).alias("name"))
    return p.select("p_partkey", m.exported_name(F.col("name"), "go").alias("go"), m.exported_name(F.col("name"), "python").alias("python"))


@query("f7_last_of_path")
def _(spark, sf):
    n = lambda i: F.col("o_orderkey") % i
    o = facts.table(spark, sf, "orders").select(F.col("o_custkey").alias("module"), F.col("o_orderkey").alias("idx"), n(7).alias("ca"), n(5).alias("ce"), (n(4) / 4.0).alias("instability"), (n(8) / 8.0).alias("abstractness"), (n(16) / 16.0).alias("distance"), n(3).alias("lcom"))
    return delta.last_of_path(o, "idx")


@query("j7_complete_join")
def _(spark, sf):
    parts = facts.table(spark, sf, "part").select("p_partkey", "p_brand")
    sold = facts.table(spark, sf, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_quantity")
    return resolve.complete(sold, parts, "p_partkey", "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("quantity"))


@query("j11_corroborated")
def _(spark, sf):
    derived, listed = (facts.order_sets(spark, sf, flag) for flag in ("R", "A"))
    return resolve.corroborated(derived, listed).select(_joined().alias("members"))


@query("t4_streaks_of_five")
def _(spark, sf):
    return trend.streaks(facts.rising_series(spark, sf))


@query("t8_overall")
def _(spark, sf):
    return trend.overall(_fits(spark, sf), trend.streaks(facts.series(spark, sf)))


@query("x6_proximity")
def _(spark, sf):
    p = facts.table(spark, sf, "part")
    return coupling.proximity(p.select(F.col("p_type").alias("iface"), (F.col("p_size") % 5).alias("method")), p.select(F.col("p_brand").alias("type"), (F.col("p_size") % 4 + F.length("p_brand") % 2).alias("method")))


@query("w5_sparklines")
def _(spark, sf):
    return trend.sparklines(facts.series(spark, sf))


@query("p1_p22_scalars")
def _(spark, sf):
    p = facts.table(spark, sf, "part").select("p_partkey", (F.col("p_size") - 1).alias("ca"), (F.col("p_size") % 7).alias("ce"), F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.col("p_brand")).alias("path"))
    name = m.identity(F.col("path"), "python")
    return p.select(
        "p_partkey", m.instability(F.col("ca"), F.col("ce")).alias("instability"), name.alias("identity"), m.count_word(F.col("p_partkey"), "part").alias("counted"),
        m.last_name(name).alias("last_name"), m.directory(F.col("path")).alias("directory"), m.round4(F.col("ce").cast("double") / 7).alias("round4"),
    )


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict:
    return {k: v for k, v in SQL.items() if k in REGISTRY}
