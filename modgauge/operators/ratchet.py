"""Coverage floors that only rise: evaluation and update."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import metrics as m

BAR = 80.0


def coverage(blocks: DataFrame) -> DataFrame:
    """covered, total and percent of statements by package; packages without statements are left out."""
    covered = F.sum(F.when(F.col("count") > 0, F.col("num_stmt")).otherwise(0)).cast("long")
    sums = blocks.groupBy("package").agg(covered.alias("covered"), F.sum("num_stmt").cast("long").alias("total")).where("total > 0")
    return sums.withColumn("percent", m.percent(F.col("covered"), F.col("total")))


def evaluate(measured: DataFrame, floors: DataFrame) -> DataFrame:
    """(package, percent, floor, status) over packages on either side."""
    both = measured.select("package", "percent").join(floors.select("package", "floor"), "package", "full_outer")
    p, f = F.col("percent"), F.col("floor")
    return both.withColumn("status", F.when(p.isNull(), "stale-floor").when(f.isNull(), "unregistered").when(p < f, "below-floor").otherwise("pass"))


def update(measured: DataFrame, floors: DataFrame, bar: float = BAR) -> DataFrame:
    """(package, percent, floor, status): raised, added, unchanged, refused, below-floor or stale-floor.

    New packages need the bar. Raised and added rows show the floor that the update gives them.
    """
    e = evaluate(measured, floors)
    p, f, s = F.col("percent"), F.col("floor"), F.col("status")
    action = F.when(s == "unregistered", F.when(p < bar, "refused").otherwise("added")).when(s.isin("stale-floor", "below-floor"), s).when(p > f, "raised").otherwise("unchanged")
    return e.select("package", "percent", F.when(action.isin("added", "raised"), p).otherwise(f).alias("floor"), action.alias("status"))


def next_floors(updated: DataFrame, floors: DataFrame) -> DataFrame:
    """The floors to write: those of update(), or the old ones if any row is a violation."""
    bad = updated.agg(F.coalesce(F.bool_or(F.col("status").isin("stale-floor", "below-floor", "refused")), F.lit(False)).alias("bad"))
    new = updated.where("floor is not null").select("package", "floor", F.lit(True).alias("new"))
    both = new.unionByName(floors.select("package", "floor", F.lit(False).alias("new")))
    return both.crossJoin(bad).where("new <> bad").select("package", "floor")  # one row on the right


def status_counts(result: DataFrame) -> DataFrame:
    return result.groupBy("status").agg(F.count("*").alias("n"))


def passed(result: DataFrame) -> DataFrame:
    return result.agg(F.coalesce(F.every(F.col("status").isin("pass", "raised", "added", "unchanged")), F.lit(True)).alias("passed"))
