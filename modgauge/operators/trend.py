"""Drift over stored snapshots: regression windows, classes, projections, streaks, retention, sparklines.

A series has (package, metric, generated_at, value). Days are whole days from a window's first snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m

WINDOWS = (7, 30, 90)
SLOPE = {"instability": 0.01, "distance": 0.01, "lcom": 0.5}
LIMIT = {"instability": 0.75, "distance": 0.7, "lcom": 5.0}
STEP = {"instability": 0.05, "distance": 0.10, "lcom": 1.0}
FIT, HORIZON, STREAK = 0.5, 30, 5


def _per(metric: Column, values: dict) -> Column:
    return m.look_up(metric, values, 0.0).cast("double")


def regression(series: DataFrame, days: int) -> DataFrame:
    """Slope, intercept and fit of each series over its last days; nulls with fewer than three snapshots.

    Sums are decimal, so that the order of rows does not show; a series that doesn't vary has fit 0.
    """
    keys = ["package", "metric"]
    day = F.to_date("generated_at")
    last = series.groupBy(*keys).agg(F.max(day).alias("last"))
    inside = series.join(last, keys).where(F.datediff("last", day) < days)
    first = inside.groupBy(*keys).agg(F.min(day).alias("first"))
    xy = inside.join(first, keys).select(*keys, F.datediff(day, F.col("first")).cast("double").alias("x"), F.round("value", 6).cast("decimal(18,6)").alias("y"), day.alias("day"))
    y = F.col("y")
    s = xy.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(y).cast("double").alias("sy"), F.sum(y * y).cast("double").alias("syy"),
        F.sum(F.col("x").cast("decimal(9,0)") * y).cast("double").alias("sxy"), F.max(F.struct("day", "y"))["y"].cast("double").alias("current"),
    )
    n = F.col("n").cast("double")
    vx, vy, c = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy"), n * F.col("sxy") - F.col("sx") * F.col("sy")
    s = s.select(*keys, "n", "current", "sx", "sy", vx.alias("vx"), F.when(F.abs(vy) < 1e-9, 0.0).otherwise(vy).alias("vy"), c.alias("c"))
    ok = (F.col("n") >= 3) & (F.col("vx") > 0)
    slope = F.when(ok, F.col("c") / F.nullif("vx", F.lit(0.0)))
    fit = F.when(ok, F.coalesce(F.col("c") * F.col("c") / F.nullif(F.col("vx") * F.col("vy"), F.lit(0.0)), F.lit(0.0)))
    out = s.select(*keys, "n", "current", slope.alias("slope"), fit.alias("r2"), "sx", "sy")
    return out.select(*keys, F.lit(days).cast("long").alias("days"), "n", "current", "slope", ((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "r2")


def classified(fits: DataFrame) -> DataFrame:
    """Add trend: insufficient-data, stable, degrading or improving."""
    slope = F.col("slope")
    return fits.withColumn("trend", F.when((F.col("n") < 3) | slope.isNull(), "insufficient-data").when((F.col("r2") < FIT) | (F.abs(slope) < _per(F.col("metric"), SLOPE)), "stable").when(slope > 0, "degrading").otherwise("improving"))


def crossings(fits: DataFrame) -> DataFrame:
    """Days until the limit is met at this slope, where within the horizon and the fit allows it."""
    ahead = (_per(F.col("metric"), LIMIT) - F.col("current")) / F.nullif("slope", F.lit(0.0))
    return fits.where(F.col("r2") >= FIT).withColumn("days_ahead", ahead).where((F.col("days_ahead") > 0) & (F.col("days_ahead") <= HORIZON))


def streaks(series: DataFrame, least: int = STREAK) -> DataFrame:
    """Series whose last steps were degradations in a row, least of them or more: (package, metric, streak)."""
    w = Window.partitionBy("package", "metric").orderBy("generated_at")
    up = F.coalesce(F.round(F.col("value") - F.lag("value").over(w), 9) >= _per(F.col("metric"), STEP), F.lit(False))
    s = series.withColumn("up", up).withColumn("i", F.row_number().over(w))
    ends = s.groupBy("package", "metric").agg(F.max("i").alias("n"), F.max(F.when(~F.col("up"), F.col("i"))).alias("broken"))
    return ends.select("package", "metric", (F.col("n") - F.col("broken")).cast("long").alias("streak")).where(F.col("streak") >= least)


def retained(snapshots: DataFrame, now: Column) -> DataFrame:
    """Snapshots of the last 90 days, and Sundays' of the last 365."""
    age = F.datediff(now, "generated_at")
    return snapshots.where((age <= 90) | ((age <= 365) & (F.dayofweek("generated_at") == 1)))


def sparklines(series: DataFrame) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("generated_at", "value"))), lambda x: x["value"])
    return series.groupBy("package", "metric").agg(m.sparkline(ordered).alias("sparkline"))


def overall(trends: DataFrame, alerts: DataFrame) -> DataFrame:
    """Degrading with a sustained alert, Drifting with a degrading trend, else Healthy."""
    a = trends.agg(F.coalesce(F.bool_or(F.col("trend") == "degrading"), F.lit(False)).alias("any"))
    b = alerts.agg((F.count("*") > 0).alias("alert"))
    return a.crossJoin(b).select(F.when(F.col("alert"), "Degrading").when(F.col("any"), "Drifting").otherwise("Healthy").alias("overall"))  # one row each


def against_baseline(current: DataFrame, history: DataFrame) -> DataFrame:
    """Each value against the latest stored one: higher, lower or equal within 0.01 (1 for lcom)."""
    latest = history.groupBy("package", "metric").agg(F.max(F.struct("generated_at", "value"))["value"].alias("was"))
    d, band = F.round(F.col("value") - F.col("was"), 6), F.when(F.col("metric") == "lcom", 1.0).otherwise(0.01)
    word = F.when(F.col("was").isNull(), "new").when(d > band, "higher").when(d < -band, "lower").otherwise("equal")
    return current.join(latest, ["package", "metric"], "left").select("package", "metric", "value", "was", word.alias("against"))


def stored_once(new: DataFrame, store: DataFrame) -> DataFrame:
    """New snapshots whose (module_path, commit) is not stored yet, one of each."""
    return new.dropDuplicates(["module_path", "commit"]).join(store, ["module_path", "commit"], "left_anti")


def history(snapshots: DataFrame, module_path: str) -> DataFrame:
    """A module's readable snapshots by time; rows of others, and those without a time, are skipped."""
    return snapshots.where((F.col("module_path") == module_path) & F.col("generated_at").isNotNull()).orderBy("generated_at")
