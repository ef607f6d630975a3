"""Health report: aggregates, grades, the rule engine and the scorecard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from . import duplication

TOP = 5
EXTREME = (0.001, 0.999)


def steady_mean(x: Column) -> Column:
    """Mean that doesn't depend on the order of rows, by decimal sums of 18 places; 0 of nothing. Values lie below 1e10."""
    return F.coalesce(F.sum(x.cast("decimal(28,18)")).cast("double") / F.nullif(F.count(x), F.lit(0)), F.lit(0.0))


def aggregates(modules: DataFrame, cycles: DataFrame, blocks: DataFrame) -> DataFrame:
    """One row: mean instability and distance, most lcom, cycles of any member, modules at either extreme, dup_percent."""
    i = F.col("instability")
    a = modules.agg(
        steady_mean(i).alias("mean_instability"), steady_mean(F.col("distance")).alias("mean_distance"), F.coalesce(F.max("lcom"), F.lit(0)).cast("long").alias("max_lcom"),
        F.count_if((i <= EXTREME[0]) | (i >= EXTREME[1])).alias("spread"), F.count("*").alias("n_modules"),
    )
    n = cycles.agg(F.count("*").alias("n_cycles"))
    return a.crossJoin(n).crossJoin(duplication.overall_percent(blocks, modules).select("dup_percent", "total_lines"))  # one row each


def graded(agg: DataFrame) -> DataFrame:
    """The five grades and the overall word, which is that of the worst."""
    g = {"g_distance": m.distance_grade(F.col("mean_distance")), "g_lcom": m.lcom_grade(F.col("max_lcom")), "g_cycles": m.cycle_grade(F.col("n_cycles")), "g_duplication": m.duplication_grade(F.col("dup_percent")), "g_spread": m.spread_grade(F.col("spread"))}
    out = agg.withColumns(g)
    worst = F.greatest(*[m.grade_rank(F.col(c)) for c in g])
    return out.withColumn("overall", m.look_up(F.element_at(F.array(*map(F.lit, m.GRADES)), (worst + 1).cast("int")), m.OVERALL, "Needs Attention"))


def _rule(when: Column, severity: Column, rule: str, extremity: Column, path: Column, value: Column, note: Column) -> Column:
    return F.when(when, F.struct(severity.alias("severity"), F.lit(rule).alias("rule"), path.alias("module_path"), extremity.cast("double").alias("extremity"), value.cast("double").alias("value"), note.alias("note")))


def _fired(df: DataFrame, *rules: Column) -> DataFrame:
    """The hits of all rules on each row, by one pass over the rows."""
    return df.select(F.explode(F.filter(F.array(*rules), lambda h: h.isNotNull())).alias("h")).select("h.*")


def ticked(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("`"), x, F.lit("`"))), ", ")


def rule_hits(modules: DataFrame, participation: DataFrame, dup: DataFrame) -> DataFrame:
    """All hits of the nine rules. dup is one row (dup_percent, n_blocks, files, similarity) of the whole graph.

    An extremity is how far a value lies beyond its bound; they compare across units on purpose. The message's
    arguments stand in subject, value and note; text is made from them when a report is rendered.
    """
    c = F.col
    i, d, none = c("instability"), c("distance"), F.lit("")
    over_dup = F.when(c("dup_percent") >= 5, "red").otherwise("green")
    shared = F.concat_ws("|", c("similarity").cast("string"), c("files"))
    hits = [
        _fired(
            modules,
            _rule(c("lcom") >= 4, F.lit("red"), "lcom4-split", c("lcom") - 4, c("module"), c("lcom"), none),
            _rule(d >= 0.5, F.lit("red"), "distance-refactor", d - 0.5, c("module"), d, c("zone")),
            _rule(i >= 0.95, F.lit("yellow"), "instability-isolate", i - 0.95, c("module"), i, none),
            _rule(i <= 0.05, F.lit("yellow"), "instability-protect", F.lit(0.05) - i, c("module"), i, none),
            _rule(c("ce") > 20, F.lit("yellow"), "ce-decouple", c("ce") - 20, c("module"), c("ce"), none),
            _rule((c("abstractness") == 0) & (c("exported_types") > 10), F.lit("yellow"), "abstractness-interfaces", c("exported_types") - 10, c("module"), c("exported_types"), none),
        ),
        _fired(participation, _rule(c("n_cycles") > 0, F.lit("red"), "cycle-break", c("n_cycles"), c("path"), c("n_cycles"), ticked(c("representative")))),
        _fired(
            dup,
            _rule(c("dup_percent") >= 5, over_dup, "duplication-eliminate", c("dup_percent") - 5, none, c("n_blocks"), shared),
            _rule((c("dup_percent") > 0) & (c("dup_percent") < 5), over_dup, "duplication-watch", c("dup_percent"), none, c("n_blocks"), shared),
        ),
    ]
    return reduce(DataFrame.unionByName, hits)


def dup_facts(blocks: DataFrame, modules: DataFrame) -> DataFrame:
    """One row of the whole graph: dup_percent, distinct blocks, their files in backticks, greatest similarity."""
    f = blocks.agg(F.countDistinct("file", "start", "end").alias("n_blocks"), ticked(F.array_sort(F.collect_set("file"))).alias("files"), F.coalesce(F.max("similarity"), F.lit(0.0)).alias("similarity"))
    return duplication.overall_percent(blocks, modules).select("dup_percent").crossJoin(f)  # one row on either side


def recommendations(hits: DataFrame, top: int = TOP) -> DataFrame:
    """The first few hits by severity, extremity, path and rule; the single all-clear where there is none."""
    rank = hits.withColumn("rank", m.severity_rank(F.col("severity")))
    best = rank.orderBy("rank", F.desc("extremity"), "module_path", "rule", "note").limit(top).drop("rank")
    none = hits.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("green").alias("severity"), F.lit("all-clear").alias("rule"), F.lit("").alias("module_path"), F.lit(0.0).alias("extremity"), F.lit(0.0).alias("value"), F.lit("").alias("note"))
    return best.unionByName(none)


def has_violations(hits: DataFrame) -> DataFrame:
    return hits.agg(F.coalesce(F.bool_or(F.col("severity").isin("red", "yellow")), F.lit(False)).alias("has_violations"))


def violations(modules: DataFrame, dup: DataFrame, limits: dict[str, float], n_cycles: DataFrame | None = None) -> DataFrame:
    """Values strictly over their limit: (module, metric, value, limit); unset limits never apply.

    Known limits: instability and distance from 0 to 1, lcom of 1 or more, duplication from 0 to 100. With
    n_cycles (members) any cycle is a violation as well, listed last.
    """
    ranges = {"instability": (0, 1), "distance": (0, 1), "lcom": (1, float("inf")), "duplication": (0, 100)}
    for name, value in limits.items():
        low, high = ranges[name]
        if not low <= value <= high:
            raise ValueError(f"{name} limit must lie between {low} and {high}")
    wide = modules.join(dup.select("module", F.col("dup_percent").alias("duplication")), "module", "left").na.fill(0.0, ["duplication"])
    cells = [F.struct(F.lit(i).cast("long").alias("rank"), F.lit(n).alias("metric"), F.col(n).cast("double").alias("value"), F.lit(float(limits[n])).alias("limit")) for i, n in enumerate(ranges) if n in limits]
    if cells:
        out = wide.select("module", F.explode(F.array(*cells)).alias("x")).where("x.value > x.limit").select("module", "x.rank", "x.metric", "x.value", "x.limit")
    else:
        out = wide.where("false").select("module", F.lit(0).cast("long").alias("rank"), F.lit("").alias("metric"), F.lit(0.0).alias("value"), F.lit(0.0).alias("limit"))
    if n_cycles is not None:
        row = n_cycles.agg(F.count("*").alias("n")).where("n > 0")
        out = out.unionByName(row.select(F.lit("").alias("module"), F.lit(99).cast("long").alias("rank"), F.lit("cycles").alias("metric"), F.col("n").cast("double").alias("value"), F.lit(0.0).alias("limit")))
    return out
