"""Mixing sources to target weights by capped water-filling, then seeded whole and fractional repetitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_small, n_words, running_total

WEIGHTS = (1.0, 2.0, 3.0)
MAX_EPOCHS = 3.0
SEED = 17


def sized(docs: DataFrame, *more) -> DataFrame:
    draw = F.md5(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    return docs.select("doc_id", "source", n_words(F.col("text")).alias("_size"), draw.alias("_draw"), *more)


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row for each source: its size and its target.

    Sources rank by code point, null last, and take the weights in turn. The water level rises until the
    targets min(max_epochs * size, level * weight) add up to all sizes; only four numbers a round reach the driver.
    """
    by_source = sizes.groupBy("source").agg(F.sum("_size").alias("source_size")).withColumn("_one", F.lit(1))
    ranked = running_total(by_source, [F.col("source").asc_nulls_last()], "_one", "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = cut(ranked.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap")))
    level, was = 0.0, None
    while level != was:
        was = level
        full = F.col("cap") <= F.lit(was) * F.col("weight")
        total, fixed, open_weight = table.agg(F.sum("source_size"), F.sum(F.when(full, F.col("cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if open_weight:
            level = max(was, (total - fixed) / open_weight)
    return table.select("source", "source_size", F.least("cap", F.col("weight") * F.lit(level)).alias("target"))


def mix_plan(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """One row for each source: whole repetitions of every document, and the last draw that gets one more.

    Within a source documents are ordered by a seeded digest of doc_id. Those whose middle word lies within
    the fractional part of the target get one more repetition; they are the first ones of that order, so
    the plan needs no row for each document, and taken words miss the target by half a document at most.
    """
    targets = source_targets(sizes, weights, max_epochs)
    order = [F.col("source").asc_nulls_last(), F.col("_draw"), F.col("doc_id").asc_nulls_first(), F.col("_size")]
    placed = running_total(sizes, order, "_size", "before")
    rows = targets.count()
    start = placed.groupBy("source").agg(F.min("before").alias("start")).withColumnRenamed("source", "_s")
    per = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = cut(targets.join(start, F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), "source_size", "target", per.alias("whole"), "start", (F.col("target") - per * F.col("source_size")).alias("part")))
    inside = join_small(placed, plan, F.col("source").eqNullSafe(F.col("_s")), rows).where(F.col("before") - F.col("start") + F.col("_size") / F.lit(2.0) <= F.col("part"))
    last = inside.groupBy("source").agg(F.max(F.struct("_draw", "doc_id", "_size")).alias("last"))
    return cut(plan.join(last, F.col("source").eqNullSafe(F.col("_s")), "left").select("_s", "source_size", "target", "whole", "last"))


def with_repetitions(sizes: DataFrame, plan: DataFrame) -> DataFrame:
    more = F.coalesce((F.col("_size") > 0) & (F.struct("_draw", "doc_id", "_size") <= F.col("last")), F.lit(False)).cast("long")
    return join_small(sizes, plan, F.col("source").eqNullSafe(F.col("_s")), plan.count()).withColumn("repeats", F.col("whole") + more).drop("_s", "whole", "last")


def mix_report(docs: DataFrame) -> DataFrame:
    """Contract of op6: doc_id, size, source_size, target, taken.

    Null texts have size 0. Null sources are one source, last in rank. Sources of size 0 have target 0.
    Repeated rows are rows of their own. An empty table gives an empty result; other columns are ignored.
    """
    sizes = cut(sized(docs))
    out = with_repetitions(sizes, mix_plan(sizes))
    return out.select("doc_id", F.col("_size").alias("size"), "source_size", F.round("target", 6).alias("target"), (F.col("_size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The documents themselves, each as often as the mix takes it; rows taken no time at all are left out.

    A null or blank text has size 0 and takes the whole repetitions of its source and no more, so that none comes
    more than three times; a source without any words is left out. Rows that repeat a document are rows of their own and
    share its draw, so that ties are taken together. An empty table stays empty; other columns stay as they are.
    """
    plan = mix_plan(cut(sized(docs)))
    out = with_repetitions(sized(docs, F.struct("*").alias("_doc")), plan).where("repeats > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int")))).select("_doc.*")


ORACLE = r"""
with s as (
  select doc_id, source, cast(case when trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) = '' then 0
         else len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) end as bigint) as size, md5('17:' || coalesce(cast(doc_id as varchar), '')) as draw
  from documents),
g as (select source, cast(sum(size) as bigint) as source_size from s group by source),
r as (select *, cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as double) as weight, 3.0::double * source_size as cap from g),
o as (select *, row_number() over (order by cap / weight, source nulls last) as k, coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as fixed,
      sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as open_weight, sum(source_size) over () as total from r),
l as (select coalesce(arg_min((total - fixed) / open_weight, k) filter (where cap / weight > (total - fixed) / open_weight), 0.0) as level from o),
t as (select source, source_size, least(cap, weight * level) as target from r, l),
p as (select s.*, t.source_size, t.target, case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end as whole,
      coalesce(sum(size) over (partition by s.source order by draw, doc_id nulls first, size rows between unbounded preceding and 1 preceding), 0) as before
      from s join t on s.source is not distinct from t.source)
select doc_id, size, source_size, round(target, 6) as target,
       cast(size * (whole + case when before + size / 2.0::double <= target - whole * source_size then 1 else 0 end) as bigint) as taken from p
"""
