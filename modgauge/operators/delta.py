"""Base against change: module deltas, cycle deltas, direction and verdict."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m
from . import local

MEASURES = ("ca", "ce", "instability", "abstractness", "distance", "lcom")


@dataclass(frozen=True)
class Thresholds:
    """Gate widths; they can be tightened and never widened."""

    instability: float = 0.15
    distance: float = 0.20
    lcom: int = 2

    def tightened(self, **limits) -> Thresholds:
        for name, value in limits.items():
            most = getattr(Thresholds(), name)
            if not math.isfinite(value) or value < 0 or value > most:
                raise ValueError(f"{name} must be a finite number from 0 to {most}")
        return Thresholds(**{**self.__dict__, **limits})


def last_of_path(modules: DataFrame, order: str | None = None) -> DataFrame:
    """Of modules that share a path the last one counts; without an order all do."""
    if order is None:
        return modules.select("module", *MEASURES, *(["copies"] if "copies" in modules.columns else []))
    last = modules.groupBy("module").agg(F.max(F.struct(order, *MEASURES)).alias("x"))
    return last.select("module", *[f"x.{c}" for c in MEASURES])


#: How many equal rows of either side a row of a delta stands for.
COPIES = ("copies_b", "copies_c")


def _copies(modules: DataFrame) -> list[str]:
    return [c for c in COPIES if c in modules.columns]


def _pairs(modules: DataFrame) -> Column:
    return reduce(Column.__mul__, map(F.col, _copies(modules)), F.lit(1).cast("long"))


def repeated(df: DataFrame) -> DataFrame:
    """Each row of a delta as often as its copies say, which are dropped.

    Pairs can be many times the rows: one side's copies are made first and dealt again, so that those of a single
    row too are made in partitions that grow with the result.
    """
    if not (copies := _copies(df)):
        return df
    rows, total = df.agg(F.count("*"), F.sum(_pairs(df))).first()
    if rows == (total or 0):
        return df.drop(*copies)
    for c in copies:
        df = df.repartition(local.parts(df, total)).withColumn(c, F.explode(F.sequence(F.lit(1).cast("long"), c))).drop(c)
    return df


def module_delta(base: DataFrame, change: DataFrame, order: str | None = None) -> DataFrame:
    """One row a path on either side: state (both, added, removed) and change minus base, rounded to four decimals.

    A side may give one row for equal ones, with their number as copies. The row of a delta then has these numbers
    (copies_b, copies_c) instead of being joined pair by pair; repeated() makes the pairs.
    """
    cell = lambda x, name: F.struct(*MEASURES, *(["copies"] if "copies" in x.columns else [])).alias(name)
    b, c = ((y := last_of_path(x, order)).select("module", cell(y, name)) for x, name in ((base, "b"), (change, "c")))
    both = b.join(c, "module", "full_outer")
    state = F.when(F.col("b").isNull(), "added").when(F.col("c").isNull(), "removed").otherwise("both")
    diff = [(m.no_negative_zero(m.round4(F.col(f"c.{x}") - F.col(f"b.{x}"))) if x in ("instability", "abstractness", "distance") else F.col(f"c.{x}") - F.col(f"b.{x}")).alias(f"d_{x}") for x in MEASURES]
    copies = [F.coalesce(f"{s}.copies", F.lit(1)).cast("long").alias(f"copies_{s}") for s, x in (("b", base), ("c", change)) if order is None and "copies" in x.columns]
    return both.select("module", state.alias("state"), *diff, *copies)


def cycle_delta(base: DataFrame, change: DataFrame) -> DataFrame:
    """Cycles of one side only, by their sorted members: (key, members, state new or resolved)."""
    b, c = (x.select(m.cycle_key(F.col("members")).alias("key"), F.array_sort("members").alias("members")).dropDuplicates(["key"]) for x in (base, change))
    new = c.join(b, "key", "left_anti").withColumn("state", F.lit("new"))
    return new.unionByName(b.join(c, "key", "left_anti").withColumn("state", F.lit("resolved")))


def unreliable(status: str, warning_codes: list[str]) -> bool:
    return status != "complete" or "load-error" in warning_codes


def _gates(t: Thresholds):
    return {"instability": t.instability, "distance": t.distance, "lcom": t.lcom}


def direction(modules: DataFrame, cycles: DataFrame, reliable: bool = True) -> DataFrame:
    """One row: degrading if a default gate is reached or a cycle is new, improving by the opposite, else stable."""
    if not reliable:
        return modules.sparkSession.range(1).select(F.lit("stable").alias("direction"))
    worse, better = F.lit(False), F.lit(False)
    for name, width in _gates(Thresholds()).items():
        worse, better = worse | (F.col(f"d_{name}") >= width), better | (F.col(f"d_{name}") <= -width)
    a = modules.where("state = 'both'").agg(F.coalesce(F.bool_or(worse), F.lit(False)).alias("w"), F.coalesce(F.bool_or(better), F.lit(False)).alias("i"))
    b = cycles.agg(F.count_if(F.col("state") == "new").alias("n"), F.count_if(F.col("state") == "resolved").alias("r"))
    word = F.when(F.col("w") | (F.col("n") > 0), "degrading").when(F.col("i") | (F.col("r") > 0), "improving").otherwise("stable")
    return a.crossJoin(b).select(word.alias("direction"))  # one row on either side


def _gated(modules: DataFrame, t: Thresholds) -> DataFrame:
    rows = [F.struct(F.lit(i).cast("long").alias("metric_rank"), F.lit(n).alias("metric"), F.col(f"d_{n}").cast("double").alias("value"), F.lit(float(w)).alias("gate")) for i, (n, w) in enumerate(_gates(t).items())]
    return modules.where("state = 'both'").select("module", *_copies(modules), F.explode(F.array(*rows)).alias("g")).where("g.value >= g.gate")


def reasons(modules: DataFrame, cycles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(kind_rank, subject, metric_rank, metric, value): new cycles by key, then modules by path, gates inclusive."""
    new = cycles.where("state = 'new'").select(F.lit(0).cast("long").alias("kind_rank"), F.col("key").alias("subject"), F.lit(0).cast("long").alias("metric_rank"), F.lit("new-cycle").alias("metric"), F.lit(None).cast("double").alias("value"))
    gates = repeated(_gated(modules, t))
    return new.unionByName(gates.select(F.lit(1).cast("long").alias("kind_rank"), F.col("module").alias("subject"), "g.metric_rank", "g.metric", "g.value"))


def verdict(modules: DataFrame, cycles: DataFrame, reliable: bool = True, t: Thresholds = Thresholds()) -> DataFrame:
    """One row: COMMENT when unreliable; REQUEST_CHANGES on a reason; COMMENT on any rise; else APPROVE."""
    if not reliable:
        return modules.sparkSession.range(1).select(F.lit("COMMENT").alias("verdict"), F.lit(0).cast("long").alias("n_reasons"))
    rise = (F.col("d_instability") > 0) | (F.col("d_distance") > 0) | (F.col("d_lcom") > 0)
    shift = modules.where("state = 'both'").agg(F.coalesce(F.bool_or(rise), F.lit(False)).alias("shift"))
    rows = cycles.where("state = 'new'").select(F.lit(1).cast("long").alias("n")).unionByName(_gated(modules, t).select(_pairs(modules).alias("n")))
    count = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_reasons"))
    word = F.when(F.col("n_reasons") > 0, "REQUEST_CHANGES").when(F.col("shift"), "COMMENT").otherwise("APPROVE")
    return shift.crossJoin(count).select(word.alias("verdict"), "n_reasons")  # one row on either side
