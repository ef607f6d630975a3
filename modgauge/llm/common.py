"""Pieces shared by the corpus operators: word expressions, lineage cuts, running totals, small joins, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Largest table, in counted rows, that is offered for broadcast; beyond it joins shuffle.
BROADCAST_ROWS = 100_000
#: Bytes of text that a worker turns into strings at once.
PART_BYTES = 2_000_000


def parts_of(texts: pa.Array, size: int = PART_BYTES) -> Iterator[tuple[int, list[str | None]]]:
    """Consecutive parts of a batch's texts as (place, strings), of about so many bytes and one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield at, texts.slice(at, end - at).to_pylist()
        at = end


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or on a local master a temporary one where that is unset (tests)."""
    sc = spark.sparkContext
    if base := spark.conf.get("spark.checkpoint.dir", None):
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(base)
        return base.rstrip("/")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="modgauge-"))
    return sc._jsc.sc().getCheckpointDir().get().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, and it survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def in_parts(df: DataFrame, rows: int) -> DataFrame:
    """A result of about so many small rows in few partitions, before it is checkpointed.

    Each file of a checkpoint costs an executor two processes (Hadoop's local file system runs chmod), which hold
    the executor's memory until they start.
    """
    return df.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, rows // 1_000 + 1), rows // BROADCAST_ROWS))


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df as Parquet under the shared folder and read it back; the files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts have none."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, SPACE)).otherwise(F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def join_small(df: DataFrame, small: DataFrame, on: Column, rows: int, how: str = "inner") -> DataFrame:
    """Join with a table of counted rows: broadcast up to BROADCAST_ROWS, else a shuffled join that AQE may split."""
    return df.join(F.broadcast(small) if rows <= BROADCAST_ROWS else small, on, how)


def running_total(df: DataFrame, order: list[Column], value: str, before: str) -> DataFrame:
    """Add the sum of value over all rows ahead in the order, without a single-task window.

    Rows are dealt by range, each range is summed by itself, and the ranges' totals (one row for each
    partition) are added up. Rows that tie in every ordering column share a range, in any order.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    base = ranged.groupBy("_range").agg(F.sum(value).alias("_sum")).select("_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_base"))
    inside = ranged.withColumn(before, F.coalesce(F.sum(value).over(own), F.lit(0)))
    return inside.join(F.broadcast(base), "_range").withColumn(before, F.col(before) + F.col("_base")).drop("_range", "_base")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components as (node, root): root is the least node, and roots themselves have no row.

    Alternates large-star and small-star steps; each round ends in a checkpoint and a fingerprint of the
    edges, so neither edges nor labels ever reach the driver. Hot nodes only meet partial minima and
    equi-joins, which AQE splits.
    """
    e = cut(edges.select(F.greatest(a, b).alias("n"), F.least(a, b).alias("p")).where("n <> p").distinct())
    seen = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("n", "p"))).first())
        if now == seen or not now[0]:
            return e.select(F.col("n").alias("node"), F.col("p").alias("root"))
        seen = now
        both = e.union(e.select("p", "n")).toDF("n", "p")
        low = both.groupBy("n").agg(F.min("p").alias("m")).select("n", F.least("n", "m").alias("m"))
        large = both.where("p > n").join(low, "n").select(F.col("p").alias("n"), F.col("m").alias("p")).distinct()
        least = large.groupBy("n").agg(F.min("p").alias("m"))
        small = large.join(least, "n").select(F.explode(F.array(F.struct("n", F.col("m").alias("p")), F.struct(F.col("p").alias("n"), F.col("m").alias("p")))).alias("e"))
        e = cut(small.select("e.n", "e.p").where("n <> p").distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def let(value: Column, body) -> Column:
    """Bind value to a lambda variable, so that body may use it many times and it is computed once."""
    return F.transform(F.array(value), body)[0]
