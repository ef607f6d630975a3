"""Resolution of include targets to modules: dotted prefixes, relative paths, and completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def longest_prefix(targets: DataFrame, modules: DataFrame, key: str, separator: str = ".") -> DataFrame:
    """(key, module): the module that is the longest prefix of target by whole segments; null where none is.

    Prefixes are exploded and equi-joined, so that the cost is the number of segments.
    """
    parts = F.split("target", r"\." if separator == "." else separator)
    prefixes = targets.select(key, F.posexplode(F.transform(parts, lambda x, i: F.array_join(F.slice(parts, F.lit(1), i + 1), separator))).alias("depth", "prefix"))
    best = prefixes.join(modules.select(F.col("module").alias("prefix")).distinct(), "prefix").groupBy(key).agg(F.max(F.struct("depth", "prefix"))["prefix"].alias("module"))
    return targets.select(key).distinct().join(best, key, "left")


def clean_path(path: Column) -> Column:
    """Path with "." and ".." resolved; leading ".." stay, and nothing becomes "."."""
    kept = F.aggregate(
        F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
    )
    return F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/"))


def relative_targets(includes: DataFrame, modules: DataFrame) -> DataFrame:
    """(source, target, module, kind) of TypeScript includes: edge, external (leaves the root) or unresolved."""
    joined = includes.withColumn("path", clean_path(F.concat_ws("/", "source", "target")))
    out = joined.join(modules.select(F.col("module").alias("path"), F.lit(True).alias("hit")).distinct(), "path", "left")
    outside = (F.col("path") == "..") | F.col("path").startswith("../")
    kind = F.when(F.col("hit"), "edge").when(outside, "external").otherwise("unresolved")
    return out.select("source", "target", F.when(F.col("hit"), F.col("path")).alias("module"), kind.alias("kind"))


def complete(left: DataFrame, right: DataFrame, key: str, what: str) -> DataFrame:
    """Inner join that fails on rows of left without a match."""
    out = left.join(right.withColumn("_hit", F.lit(True)), key, "left")
    check = F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit(f"no {what} for "), F.col(key).cast("string")))).otherwise(F.col(key))
    return out.withColumn(key, check).drop("_hit")


def corroborated(derived: DataFrame, listed: DataFrame) -> DataFrame:
    """Derived cycles that are not among the listed ones; empty if all are."""
    key = lambda df: df.select(F.array_join(F.array_sort("members"), "\x00").alias("key"), "members")
    return key(derived).join(key(listed).select("key"), "key", "left_anti").select("members")
