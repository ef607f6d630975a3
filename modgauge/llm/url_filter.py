"""URL filters, natively: host and path rules, then a blocked Bloom filter in front of an exact hash join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ascii_lower

#: (verdict, host, path) of the production rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BITS_PER_KEY = 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return ascii_lower(host), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def canonical(host: Column, path: Column) -> Column:
    """Scheme, query, fragment, www. or m., trailing slash and .html dropped; null without a host."""
    return F.when(host != "", F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", "")))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits as a struct (rule, verdict), or null; among equals the first listed."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def bloom_bits(key: Column, blocks: int) -> tuple[Column, Column]:
    """Block number and the key's four bits in that block's 64-bit word."""
    h = F.xxhash64(key)
    one = lambda by: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, by).bitwiseAND(F.lit(63)).cast("int"))
    return h.bitwiseAND(F.lit(blocks - 1)), one(40).bitwiseOR(one(46)).bitwiseOR(one(52)).bitwiseOR(one(58))


def in_list(pages: DataFrame, key: str, listed: DataFrame, bits_per_key: int = BITS_PER_KEY) -> DataFrame:
    """Add listed: whether the key is in the one-column table listed. Null keys are not.

    The filter is one 64-bit word for each block, or-ed together by a shuffle of distinct keys. It is
    broadcast while its words number at most BROADCAST_ROWS, else joined by block. Pages that pass it meet
    the exact list in an equi-join; the others skip that join and its shuffle.
    """
    keys = listed.select(F.col(listed.columns[0]).alias("_key")).where("_key is not null").distinct()
    blocks = 1 << max(6, (keys.count() * bits_per_key // 64).bit_length())
    block, mask = bloom_bits(F.col("_key"), blocks)
    words = keys.select(block.alias("_block"), mask.alias("_mask")).groupBy("_block").agg(F.bit_or("_mask").alias("_word"))
    block, mask = bloom_bits(F.col(key), blocks)
    probe = pages.withColumns({"_at": block, "_bits": mask}).join(F.broadcast(words) if blocks <= BROADCAST_ROWS else words, F.col("_at") == F.col("_block"), "left")
    may = F.coalesce((F.col("_word").bitwiseAND(F.col("_bits")) == F.col("_bits")) & F.col(key).isNotNull(), F.lit(False))
    probe = probe.withColumn("_may", may).drop("_at", "_bits", "_block", "_word")
    passed = probe.where("_may").join(keys, F.col(key) == F.col("_key"), "left").withColumn("listed", F.col("_key").isNotNull()).drop("_key")
    return probe.where("not _may").withColumn("listed", F.lit(False)).unionByName(passed).drop("_may")


def judge(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Contract of op10: page_id, host, path, rule, verdict (and listed).

    Without a list of canonical URLs the pages found through a feed (utm_source=feed in the query) give it.
    Where no rule fits, listed pages are blocked and the others allowed. A null url, or one without
    "://", has empty host and path, no rule, and is allowed. Repeated rows are judged one by one. An empty table gives
    no row; an empty list blocks nothing; other columns are ignored, whatever their names.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_canonical", canonical(F.col("host"), F.col("path")))
    if listed is None:
        listed = split.where(F.col("url").contains("utm_source=feed")).select("_canonical")
    out = in_list(split, "_canonical", listed).withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("listed"), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), "listed")


ORACLE = r"""
with a as (select page_id, url, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
b as (select page_id, url, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from a),
c as (select *, case when host <> '' then regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '(\.html|/)$', '') end as canon from b),
l as (select distinct canon from c where contains(url, 'utm_source=feed') and canon is not null),
d as (select c.*, l.canon is not null as listed, case
  when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
  when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
  when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
  when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
  from c left join l on c.canon = l.canon)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow' when listed then 'block' else 'allow' end as verdict, listed from d
"""
