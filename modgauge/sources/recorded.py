"""Recorded tool output: metric and dependency XML, the complexity tree, coverage profiles, floors, versions."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WARNED = "has_more"
ARCH = "struct<metrics: struct<m: array<struct<_path: string, _ce: bigint, _ca: bigint, _types: bigint, _abstract: bigint, _I: double, _A: double, _D: double, _zone: string, _reachable: string, _isolated: string>>>>"
DEPS = "struct<_total_files: bigint, _returned: bigint, _offset: bigint, _has_more: bigint, f: array<struct<_p: string, _includes: bigint, _afferent: bigint, _instab: double, _transitive: bigint, inc: array<struct<_t: string>>>>, cycles: struct<scc: array<struct<_size: bigint, f: array<string>>>>>"
ROW = {"path": "_path", "ca": "_ca", "ce": "_ce", "types": "_types", "abstract": "_abstract", "instability": "_I", "abstractness": "_A", "distance": "_D", "zone": "_zone"}


def _must(ok: Column, value: Column, said: Column) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(said))


def arch_rows(documents: DataFrame) -> DataFrame:
    """Rows of <arch><metrics><m .../>; a missing table or attribute, another root or a repeated path is an error."""
    text = F.col("value")
    parsed = F.from_xml(text, ARCH, {"mode": "FAILFAST"})
    checked = _must(text.rlike(r"<arch[\s>]") & text.rlike(r"<metrics[\s/>]"), parsed, F.lit("not a metrics table"))
    m = documents.select(F.explode(F.coalesce(checked["metrics"]["m"], F.array())).alias("m"))
    full = F.lit(True)
    for c in ROW.values():
        full = full & F.col(f"m.{c}").isNotNull()
    rows = m.select(*[(_must(full, F.col(f"m.{c}"), F.lit("incomplete metrics row")) if name == "path" else F.col(f"m.{c}")).alias(name) for name, c in ROW.items()])
    once = rows.groupBy("path").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ROW if c != "path"])
    return once.select(_must(F.col("n") == 1, F.col("path"), F.concat(F.lit("repeated path "), F.col("path"))).alias("path"), *[c for c in ROW if c != "path"])


def includes(documents: DataFrame) -> DataFrame:
    """(path, target) of the dependency XML, one row an include; files without any have a null target."""
    f = documents.select(F.explode(F.from_xml("value", DEPS, {"mode": "FAILFAST"})["f"]).alias("f"))
    return f.select(F.col("f._p").alias("path"), F.explode_outer("f.inc._t").alias("target"))


def truncated(documents: DataFrame) -> DataFrame:
    """One row: whether the window of dependencies was cut off."""
    more = F.from_xml("value", DEPS, {"mode": "FAILFAST"})["_has_more"]
    return documents.agg(F.coalesce(F.bool_or(more != 0), F.lit(False)).alias("truncated"))


def listed_cycles(documents: DataFrame) -> DataFrame:
    """Cycles the tool lists, as sorted directories of their files; repeats stay."""
    from ..functions.metrics import directory

    c = documents.select(F.explode(F.from_xml("value", DEPS, {"mode": "FAILFAST"})["cycles"]["scc"]).alias("c"))
    return c.select(F.array_sort(F.transform("c.f", directory)).alias("members"))


def tree_files(document: str) -> Iterator[dict]:
    """File nodes of the complexity tree; the made-up top folder is no part of a path."""
    top = json.loads(document)
    nodes = top.get("nodes", [top] if "type" in top else None)
    if not nodes:
        raise ValueError("no nodes")
    walk = [(n, "") for n in nodes]
    while walk:
        node, above = walk.pop()
        name = node.get("name", "")
        path = above if not above and name == "root" and node.get("type") == "Folder" else f"{above}/{name}".lstrip("/")
        if node.get("type") == "File":
            a = node.get("attributes", {})
            yield {"path": path} | {c: int(a.get(c, 0)) for c in ("loc", "symbols", "cx", "cognitive_cx", "fan_in", "fan_out", "churn")}
        elif node.get("type") == "Folder":
            walk += [(n, path) for n in node.get("children", [])]


TREE = "path string, loc long, symbols long, cx long, cognitive_cx long, fan_in long, fan_out long, churn long"


def complexity(documents: DataFrame) -> DataFrame:
    """File rows of complexity trees of any depth, a document at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for document in batch["value"]:
                yield pd.DataFrame(list(tree_files(document)), columns=[c.split()[0] for c in TREE.split(", ")])

    return documents.select("value").mapInPandas(run, TREE)


def documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def profile(spark: SparkSession, path: str, module: str) -> DataFrame:
    """(package, num_stmt, count) of a coverage profile; packages are directories without the module's prefix."""
    line = r"^(.+):\d+\.\d+,\d+\.\d+ (\d+) (\d+)$"
    rows = spark.read.text(path).where(~F.col("value").startswith("mode:") & (F.trim("value") != ""))
    folder = F.regexp_replace(F.regexp_extract("value", line, 1), "/[^/]*$", "")
    package = F.when(folder == module, ".").when(folder.startswith(module + "/"), F.substring(folder, len(module) + 2, 1 << 30)).otherwise(folder)
    number = lambda i: F.regexp_extract("value", line, i).cast("long")
    good = F.when(F.col("value").rlike(line), package).otherwise(F.raise_error(F.concat(F.lit("bad profile line: "), "value")))
    return rows.select(good.alias("package"), number(2).alias("num_stmt"), number(3).alias("count"))


def read_floors(document: str) -> dict[str, float]:
    """Floors by package: version 1, each in (0, 100] with one decimal at most."""
    value = json.loads(document)
    if value.get("version") != 1:
        raise ValueError("floors must be of version 1")
    for package, floor in value.get("floors", {}).items():
        if not 0 < floor <= 100 or abs(floor * 10 - round(floor * 10)) > 1e-9:
            raise ValueError(f"floor of {package} must be over 0, at most 100, and have one decimal at most")
    return {k: float(v) for k, v in value.get("floors", {}).items()}


def write_floors(path: str, floors: dict[str, float]) -> None:
    """Sorted, and never half written."""
    import os
    import tempfile

    from ..functions.encode import dumps

    with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(path) or ".", delete=False) as f:
        f.write(dumps({"version": 1, "floors": {k: float(floors[k]) for k in sorted(floors)}}) + "\n")
    os.replace(f.name, path)


def pinned(line: str, version: str, commit: str) -> tuple[str, str]:
    """Version and commit of a tool's version line; anything but the pinned ones is an error."""
    found = re.fullmatch(r"(\S+) (\S+) \((?:.*[ ,(])?built_from=([0-9a-f]+)[^)]*\)", line.strip())
    if not found or found[2] != version or not found[3].startswith(commit):
        raise ValueError(f"need version {version} built from {commit}, not {line.strip()[:80]!r}")
    return found[2], found[3]
