"""Snapshots of a module graph: schema, checks, strict reading, and the tables that they flatten into."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSIONS = ("1.0", "1.1", "1.2", "1.3")
STATUSES = ("complete", "partial", "error")
ZONES = ("main-sequence", "zone-of-pain", "zone-of-uselessness", "normal")
SCHEMA = """schemaVersion string, language string, status string,
modules array<struct<path string, name string, ca bigint, ce bigint, exportedTypes bigint, abstractTypes bigint, instability double, abstractness double,
  distance double, lcom bigint, zone string, duplications array<struct<modulePath string, similarity double, blocks array<struct<file string, startLine bigint, endLine bigint, lineCount bigint>>>>,
  totalLines bigint, extensions map<string, string>>>,
cycles array<array<string>>, warnings array<struct<code string, message string, module string>>,
provenance struct<producer string, version string, generatedAt string, input struct<path string, modulePath string, commitSHA string, branch string, sourceTool string, sourceToolVersion string, sourceToolCommit string>>""".replace("\n", " ")
RATIOS, COUNTS = ("instability", "abstractness", "distance"), ("ca", "ce", "lcom", "exportedTypes", "abstractTypes")

Check = Callable[[object, str], Iterator[str]]
_number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)


def a_string(filled: bool = False) -> Check:
    def run(v, at):
        if not isinstance(v, str):
            yield f"{at} must be a string"
        elif filled and not v:
            yield f"{at} must be non-empty"

    return run


def one_of(allowed: tuple[str, ...]) -> Check:
    def run(v, at):
        if not isinstance(v, str):
            yield f"{at} must be a string"
        elif v not in allowed:
            yield f"{at} is {v!r} and must be one of {', '.join(allowed)}"

    return run


def a_number(low: float = 0, high: float = float("inf")) -> Check:
    def run(v, at):
        if not _number(v):
            yield f"{at} must be a number"
        elif not low <= v <= high:
            yield f"{at} is {v:g} and must lie in [{low:g}, {high:g}]" if high < float("inf") else f"{at} is {v:g} and must be at least {low:g}"

    return run


def items(check: Check | None = None, null: bool = False) -> Check:
    def run(v, at):
        if v is None and null:
            return
        if not isinstance(v, list):
            yield f"{at} must be an array"
        elif check:
            for i, x in enumerate(v):
                yield from check(x, f"{at}[{i}]")

    return run


def record(required: tuple[str, ...], *checks: tuple[str, Check]) -> Check:
    """All required fields are looked for first; then the checks run in order on the fields that are there."""

    def run(v, at):
        if not isinstance(v, dict):
            yield f"{at or 'snapshot'} must be an object"
            return
        inside = f"{at}." if at else ""
        yield from (f"missing required field {inside}{name}" for name in required if name not in v)
        for name, check in checks:
            if name in v:
                yield from check(v[name], inside + name)

    return run


_lines = ("startLine", "endLine", "lineCount")
_block = record(("file", *_lines), ("file", a_string()), *[(c, a_number()) for c in _lines])
_duplicate = record(("modulePath", "blocks", "similarity"), ("modulePath", a_string()), ("similarity", a_number(0, 1)), ("blocks", items(_block)))
_module = record(
    ("path", "name", "ca", "ce", *RATIOS, "lcom", "exportedTypes", "abstractTypes", "zone"),
    ("zone", one_of(ZONES)), ("extensions", record(())), *[(c, a_number(0, 1)) for c in RATIOS], *[(c, a_number()) for c in COUNTS], ("totalLines", a_number()), ("duplications", items(_duplicate, null=True)),
)
_input = record(("path", "modulePath"), ("path", a_string(True)), ("modulePath", a_string(True)))
_origin = record(("producer", "version", "generatedAt", "input"), ("producer", a_string()), ("version", a_string()), ("generatedAt", a_string()), ("input", _input))
_snapshot = record(
    ("schemaVersion", "language", "modules", "cycles", "warnings", "status"),
    ("schemaVersion", one_of(VERSIONS)), ("language", a_string(True)), ("status", one_of(STATUSES)), ("modules", items(_module)), ("cycles", items()), ("warnings", items(record(("code", "message")))), ("provenance", _origin),
)


def first_fault(document: str | None) -> str | None:
    """The first thing wrong with a snapshot's JSON, or None. Unknown fields and null duplications are allowed."""
    if not document or not document.strip():
        return "empty input"
    try:
        value = json.loads(document)
    except ValueError as e:
        return f"not JSON: {e}"
    return next(_snapshot(value, ""), None)


@F.pandas_udf(T.StringType())
def fault(documents: pd.Series) -> pd.Series:
    return documents.map(first_fault)


def parsed(document: Column) -> Column:
    """Typed snapshot, failing on values of another type (a fraction where a count stands, say)."""
    return F.from_json(document, SCHEMA, {"mode": "FAILFAST"})


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(snapshot_id, fault, graph) of JSON files, one snapshot each; strict reading fails on the first faulty one.

    Otherwise faulty snapshots stay as rows with a fault and no graph, so that one bad file costs nothing else.
    """
    docs = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("snapshot_id"), "value").withColumn("fault", fault("value"))
    if strict:
        docs = docs.withColumn("fault", F.when(F.col("fault").isNotNull(), F.raise_error(F.concat_ws(": ", "snapshot_id", "fault"))))
        return docs.select("snapshot_id", "fault", F.when(F.col("fault").isNull(), parsed(F.col("value"))).alias("graph"))
    loose = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE"})
    return docs.select("snapshot_id", "fault", F.when(F.col("fault").isNull(), loose).alias("graph"))


def modules(snapshots: DataFrame) -> DataFrame:
    """One row a module, in the columns of the module table, with its place in the snapshot."""
    m = snapshots.select("snapshot_id", F.posexplode("graph.modules").alias("idx", "m"))
    plain = {"module": "path", "name": "name", "ca": "ca", "ce": "ce", "exported_types": "exportedTypes", "abstract_types": "abstractTypes", "instability": "instability", "abstractness": "abstractness", "distance": "distance", "lcom": "lcom", "zone": "zone"}
    return m.select("snapshot_id", "idx", *[F.col(f"m.{c}").alias(name) for name, c in plain.items()], F.coalesce("m.totalLines", F.lit(0)).alias("total_lines"), F.col("m.duplications").alias("duplications"), F.col("m.extensions").alias("extensions"))


def cycles(snapshots: DataFrame) -> DataFrame:
    return snapshots.select("snapshot_id", F.explode("graph.cycles").alias("members"))


def warnings(snapshots: DataFrame) -> DataFrame:
    """code, message and module ("" for the whole graph), in report order when sorted by module, code, message."""
    w = snapshots.select("snapshot_id", F.explode("graph.warnings").alias("w"))
    return w.select("snapshot_id", F.coalesce("w.module", F.lit("")).alias("module"), F.col("w.code").alias("code"), F.col("w.message").alias("message"))


def dup_blocks(snapshots: DataFrame) -> DataFrame:
    """module, similarity, file, start, end, line_count and idx, the order of listing."""
    d = modules(snapshots).where("duplications is not null").select("snapshot_id", "module", F.posexplode("duplications").alias("i", "d"))
    b = d.select("snapshot_id", "module", "i", F.col("d.similarity").alias("similarity"), F.posexplode("d.blocks").alias("j", "b"))
    return b.select("snapshot_id", "module", "similarity", F.col("b.file").alias("file"), F.col("b.startLine").alias("start"), F.col("b.endLine").alias("end"), F.col("b.lineCount").alias("line_count"), F.struct("i", "j").alias("idx"))


def series(snapshots: DataFrame, module_path: str) -> DataFrame:
    """(package, metric, generated_at, value) of one project's readable snapshots, for the drift operators."""
    mine = snapshots.where(F.col("graph").isNotNull() & (F.col("graph.provenance.input.modulePath") == module_path))
    rows = mine.select(F.try_to_timestamp("graph.provenance.generatedAt").alias("generated_at"), F.explode("graph.modules").alias("m")).where("generated_at is not null")
    cell = lambda c: F.struct(F.lit(c).alias("metric"), F.col(f"m.{c}").cast("double").alias("value"))
    return rows.select(F.col("m.path").alias("package"), "generated_at", F.explode(F.array(*map(cell, ("instability", "distance", "lcom")))).alias("x")).select("package", "x.metric", "generated_at", "x.value")


def store(new: DataFrame, path: str) -> None:
    """Append (snapshot_id, module_path, commit, value) rows whose project and commit are not stored yet."""
    from ..operators.trend import stored_once

    spark = new.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    old = spark.read.parquet(path) if there else new.where("false")
    stored_once(new, old.select("module_path", "commit")).write.mode("append").partitionBy("module_path").parquet(path)
