"""A Go tree as a snapshot: files to facts, to the module table, to JSON with warnings, provenance and an exit code."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encode
from ..functions import metrics as m
from ..operators import coupling, dialects, duplication, graph, render
from ..operators import report as rules
from ..sources import snapshots, tree
from .session import cut

SKIPPED = r"(^|/)(vendor|testdata|[._][^/]+)(/|$)"


def go_facts(spark: SparkSession, root: str) -> tuple[str, dict[str, DataFrame]]:
    """The module path, and the fact tables of a Go tree; tests and folders that builds leave out are left out.

    A file that can't be read gives a warning and no facts. Without a go.mod at the top there is no module path: an error.
    """
    all_of = tree.files(spark, root)
    top = tree.module_path(all_of).first()
    if not top or not top[0]:
        raise ValueError("no go.mod with a module line at the top")
    files = cut(all_of.where("ext = '.go'").where(~F.col("name").endswith("_test.go") & ~F.concat("dir", F.lit("/")).rlike(SKIPPED)))
    if not files.where("text is not null").limit(1).count():
        raise ValueError("no readable Go file")
    module = lambda path: F.when(m.directory(path) == ".", F.lit(top[0])).otherwise(F.concat(F.lit(top[0] + "/"), m.directory(path))).alias("module")
    fact = lambda kind: dialects.facts(files, "go", kind).withColumn("module", module(F.col("path")))
    fields = fact("fields").select(F.col("module").alias("scope"), F.concat_ws("\x02", "path", F.col("method_no").cast("string")).alias("method"), "field")
    readable = files.where("text is not null").select(module(F.col("path")), F.col("path").alias("file"), "text")
    name = F.min(F.nullif(F.regexp_extract("text", r"(?m)^package[ \t]+(\w+)", 1), F.lit(""))).alias("name")
    return top[0], {
        "packages": readable.groupBy("module").agg(name),
        "imports": fact("imports").select("module", "target"),
        "types": fact("types").drop("path"),
        "lcom": graph.cohesion(fields).withColumnRenamed("scope", "module"),
        "lines": duplication.total_lines(readable),
        "blocks": fact("blocks").where(~duplication.excluded(F.col("path"))).withColumnRenamed("path", "file"),
        "warnings": dialects.warnings(files),
    }


def _text(value, otherwise: str) -> str:
    return otherwise if value is None else value


def analyze(spark: SparkSession, root: str, limits: dict[str, float] | None = None, fail_on_cycles: bool = False, provenance: bool = True, now: str | None = None, commit: str = "", branch: str = "") -> tuple[str, int]:
    """The snapshot's JSON, without a line end, and the exit code: 1 where a value is over its limit.

    The rows of one project's modules are gathered to write one document. Modules stand by path, cycles by first member
    and warnings by module, code and message.
    """
    path, f = go_facts(spark, root)
    packages = cut(f["packages"])
    modules = cut(coupling.module_table(packages, f["imports"], f["types"], f["lcom"], f["lines"]).join(packages, "module"))
    inside = coupling.internal_edges(f["imports"], packages).toDF("src", "dst")
    cycles = cut(graph.cycles(inside))
    pairs = cut(duplication.duplicate_pairs(f["blocks"]))
    side = lambda s: F.struct(*[F.col(f"{c}_{s}").alias(c) for c in ("file", "start", "end")], F.col(f"sig_lines_{s}").alias("line_count"))
    listed = pairs.select("module", F.explode(F.array(side("a"), side("b"))).alias("b")).select("module", "b.*", F.struct("b.file", "b.start", "b.end").alias("idx"), F.lit(1.0).alias("similarity"))
    percent = duplication.module_percent(listed, modules)
    over = rules.violations(modules, percent, limits or {}, cycles if fail_on_cycles else None).limit(1).count()

    found: dict[str, list] = {}
    for r in pairs.orderBy("module", "file_a", "start_a", "file_b", "start_b").collect():
        block = lambda s, r=r: {"file": r[f"file_{s}"], "startLine": r[f"start_{s}"], "endLine": r[f"end_{s}"], "lineCount": r[f"sig_lines_{s}"]}
        found.setdefault(r["module"], []).append({"modulePath": r["module"], "blocks": [block("a"), block("b")], "similarity": 1.0})
    rows = []
    for r in modules.orderBy("module").collect():
        row = {"path": r["module"], "name": _text(r["name"], r["module"].rsplit("/", 1)[-1])} | {key: r[c] for c, key in (("ca", "ca"), ("ce", "ce"), ("exported_types", "exportedTypes"), ("abstract_types", "abstractTypes"), ("instability", "instability"), ("abstractness", "abstractness"), ("distance", "distance"), ("lcom", "lcom"), ("zone", "zone"))}
        rows.append(row | ({"duplications": found[r["module"]]} if r["module"] in found else {}) | {"totalLines": r["total_lines"]})
    warned = [r.asDict() for r in f["warnings"].orderBy("module", "code", "message").collect()]
    out = {"schemaVersion": snapshots.VERSIONS[-1], "language": "go", "modules": rows, "cycles": sorted(list(r["members"]) for r in cycles.collect()), "warnings": warned}
    if provenance:
        origin = {"path": root, "modulePath": path} | ({"commitSHA": commit} if commit else {}) | ({"branch": branch} if branch else {})
        out["provenance"] = {"producer": render.PRODUCER, "version": render.VERSION, "generatedAt": now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"), "input": origin}
    text = encode.dumps(out | {"status": "partial" if warned else "complete"})
    if fault := snapshots.first_fault(text):
        raise ValueError(fault)
    return text, int(over > 0)
