"""Duplicate blocks: significant lines, block filters, pairs, and the two duplication percentages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metrics as m
from ..plans.session import cut

MIN_LINES = 6
SKIPPED_DIRS = ("mock", "generated", "mocks", "testdata")


def significant_lines(text: Column) -> Column:
    """Lines other than blank ones and lone braces."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~F.trim(x).isin("", "{", "}"))).cast("long")


def excluded(path: Column) -> Column:
    """Generated files, and files with a skipped directory anywhere above them."""
    return path.rlike(r"\.(gen|pb)\.go$") | F.arrays_overlap(F.split(m.directory(path), "/"), F.array(*map(F.lit, SKIPPED_DIRS)))


def total_lines(lines: DataFrame) -> DataFrame:
    """Significant lines a module, of files that are not excluded."""
    return lines.where(~excluded(F.col("file"))).groupBy("module").agg(F.sum(significant_lines(F.col("text"))).cast("long").alias("total_lines"))


def loc_lines(files: DataFrame, extensions: tuple[str, ...]) -> DataFrame:
    """Sum of lines of source files by directory."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    return files.where(ext.isin(*extensions)).groupBy(m.directory(F.col("path")).alias("module")).agg(F.sum("loc").cast("long").alias("total_lines"))


def duplicate_pairs(blocks: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Pairs of equal normalised bodies within a module, by digest and then by the bodies themselves.

    A body that occurs n times has n * (n - 1) / 2 pairs, as users of pairwise reports expect; use
    duplicate_classes() where groups can be large.
    """
    b = blocks.where(F.col("sig_lines") >= min_lines).withColumn("digest", F.sha2("norm_body", 256))
    left = b.select("module", "digest", *[F.col(c).alias(f"{c}_a") for c in ("file", "start", "end", "sig_lines", "norm_body")])
    right = b.select("module", "digest", *[F.col(c).alias(f"{c}_b") for c in ("file", "start", "end", "sig_lines", "norm_body")])
    order = F.struct("file_a", "start_a", "end_a") < F.struct("file_b", "start_b", "end_b")
    return left.join(right, ["module", "digest"]).where((F.col("norm_body_a") == F.col("norm_body_b")) & order).drop("norm_body_a", "norm_body_b", "digest")


def duplicate_classes(blocks: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """Each block that has a duplicate, with its class and the class's number of blocks; linear in the blocks, whose bodies are read once."""
    b = cut(blocks.where(F.col("sig_lines") >= min_lines).select("module", F.sha2("norm_body", 256).alias("class"), "file", "start", "end", "sig_lines"))
    size = b.groupBy("module", "class").agg(F.count("*").alias("n_blocks")).where("n_blocks > 1")
    return b.join(size, ["module", "class"]).select("module", "class", "n_blocks", "file", "start", "end", "sig_lines")


def module_percent(blocks: DataFrame, modules: DataFrame) -> DataFrame:
    """Duplicated share of each module's lines; of a block listed twice the first row counts."""
    w = Window.partitionBy("module", "file", "start", "end").orderBy("idx")
    once = blocks.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").groupBy("module").agg(F.sum("line_count").alias("dup_lines"))
    share = F.when(F.col("total_lines") > 0, F.coalesce("dup_lines", F.lit(0)) * 100.0 / F.nullif("total_lines", F.lit(0))).otherwise(0.0)
    return modules.select("module", "total_lines").join(once, "module", "left").select("module", share.alias("dup_percent"))


def overall_percent(blocks: DataFrame, modules: DataFrame) -> DataFrame:
    """Duplicated share of all lines; of a block listed twice the longest counts, whichever module lists it."""
    lines = blocks.groupBy("file", "start", "end").agg(F.max("line_count").alias("lc")).agg(F.coalesce(F.sum("lc"), F.lit(0)).alias("dup_lines"))
    total = modules.agg(F.coalesce(F.sum("total_lines"), F.lit(0)).alias("total_lines"))
    share = F.when(F.col("total_lines") > 0, F.col("dup_lines") * 100.0 / F.nullif("total_lines", F.lit(0))).otherwise(0.0)
    return lines.crossJoin(total).select("dup_lines", "total_lines", share.alias("dup_percent"))  # one row on either side


def facts(blocks: DataFrame) -> DataFrame:
    """For each module: distinct blocks, sorted distinct files, greatest similarity."""
    return blocks.groupBy("module").agg(
        F.countDistinct("file", "start", "end").alias("n_blocks"), F.array_join(F.array_sort(F.collect_set("file")), ",").alias("files"), F.max("similarity").alias("similarity")
    )


def rows(blocks: DataFrame) -> DataFrame:
    """For each block: most lines, greatest similarity, and how often it is listed."""
    return blocks.groupBy("file", "start", "end").agg(F.max("line_count").alias("line_count"), F.max("similarity").alias("similarity"), F.count("*").alias("occurrences"))
