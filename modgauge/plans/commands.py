"""The commands users run, over snapshot files: report, diff, ratchet; each returns (text, exit code)."""

from __future__ import annotations

import argparse
import sys
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import delta, duplication, graph, ratchet, render
from ..operators import report as rules
from ..sources import recorded, snapshots
from . import analyze

LIMITS = ("instability", "distance", "lcom", "duplication")
_rows = lambda df: [r.asDict() for r in df.collect()]


def report(spark: SparkSession, path: str, mode: str = "summary", as_json: bool = False) -> tuple[str, int]:
    """Exit code 1 where a red or yellow rule fires."""
    if mode not in ("summary", "detailed"):
        raise ValueError("mode is summary or detailed")
    snap = snapshots.read(spark, path)
    modules, cycles, blocks = snapshots.modules(snap), snapshots.cycles(snap), snapshots.dup_blocks(snap)
    agg = rules.graded(rules.aggregates(modules, cycles, blocks)).first().asDict()
    top = _rows(rules.recommendations(rules.rule_hits(modules, graph.participation(cycles), rules.dup_facts(blocks, modules))))
    if as_json:
        text = render.report_model(agg, top)
    else:
        origin = snap.select("graph.provenance.producer", "graph.provenance.version").first()
        plain = modules.drop("duplications", "extensions")
        text = render.report(agg, top, _rows(plain), [list(r["members"]) for r in cycles.collect()], _rows(duplication.rows(blocks)), _rows(snapshots.warnings(snap)), mode == "detailed", origin[0] or render.PRODUCER, origin[1] or render.VERSION)
    return text, int(any(h["severity"] in ("red", "yellow") for h in top))


def _unreliable(snap: DataFrame) -> bool:
    bad = (F.col("graph.status") != "complete") | F.exists("graph.warnings", lambda w: w["code"] == "load-error")
    return bool(snap.agg(F.bool_or(bad)).first()[0])


def diff(spark: SparkSession, base: str, change: str, form: str = "table", gate: bool = False, **tighter) -> tuple[str, int]:
    """Exit code 1 where the gate is on and changes are requested. Thresholds can only be tightened."""
    limits = delta.Thresholds().tightened(**tighter)
    old, new = snapshots.read(spark, base), snapshots.read(spark, change)
    reliable = not (_unreliable(old) or _unreliable(new))
    modules = delta.module_delta(snapshots.modules(old), snapshots.modules(new), "idx")
    cycles = delta.cycle_delta(snapshots.cycles(old), snapshots.cycles(new))
    direction = delta.direction(modules, cycles, reliable).first()[0]
    verdict = delta.verdict(modules, cycles, reliable, limits).first()[0]
    if reliable:
        reasons = render.reason_lines(_rows(delta.reasons(modules, cycles, limits)), limits)
        if verdict == "COMMENT":
            reasons = ["materiality: a metric rose below its threshold"]
    else:
        reasons = ["unreliable: a snapshot is not complete"]
    rows, chains = _rows(modules), _rows(cycles)
    if form == "markdown":
        text = render.diff_markdown(rows, chains, direction, verdict, reasons)
    else:
        text = (render.diff_model if form == "json" else render.diff_table)(rows, chains, direction, verdict, reasons, not reliable)
    return text, int(gate and verdict == "REQUEST_CHANGES")


def run_ratchet(spark: SparkSession, profile: str, floors_path: str, module: str, update: bool = False, as_json: bool = False, now: str | None = None) -> tuple[str, int]:
    """Exit code 1 on a violation; floors are written only by an update without any."""
    with open(floors_path, encoding="utf-8") as f:
        floors = recorded.read_floors(f.read())
    table = spark.createDataFrame(sorted(floors.items()), "package string, floor double")
    measured = ratchet.coverage(recorded.profile(spark, profile, module))
    result = (ratchet.update if update else ratchet.evaluate)(measured, table)
    rows, good = _rows(result), ratchet.passed(result).first()[0]
    if update and good:
        recorded.write_floors(floors_path, {r["package"]: r["floor"] for r in rows})
    stamp = now or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    return render.ratchet_model(rows, update and good, stamp) if as_json else render.ratchet_table(rows), int(not good)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("modgauge")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("report")
    r.add_argument("graph")
    either = r.add_mutually_exclusive_group()
    either.add_argument("--mode", choices=("summary", "detailed"), default="summary")
    either.add_argument("--json", action="store_true")
    d = sub.add_parser("diff")
    d.add_argument("base")
    d.add_argument("change")
    d.add_argument("--form", choices=("table", "json", "markdown"), default="table")
    d.add_argument("--gate", action="store_true")
    c = sub.add_parser("ratchet")
    for name in ("profile", "floors", "module"):
        c.add_argument(name)
    c.add_argument("--update", action="store_true")
    c.add_argument("--json", action="store_true")
    z = sub.add_parser("analyze")
    z.add_argument("root")
    for name in LIMITS:
        z.add_argument(f"--max-{name}", type=float)
    z.add_argument("--fail-on-cycles", action="store_true")
    z.add_argument("--no-provenance", action="store_true")
    z.add_argument("--out")
    for name in ("instability", "distance", "lcom"):
        d.add_argument(f"--max-{name}-rise", type=float)
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        if a.command == "report":
            text, code = report(spark, a.graph, a.mode, a.json)
        elif a.command == "diff":
            rises = {x: getattr(a, f"max_{x}_rise") for x in ("instability", "distance", "lcom")}
            text, code = diff(spark, a.base, a.change, a.form, a.gate, **{x: v for x, v in rises.items() if v is not None})
        elif a.command == "analyze":
            limits = {x: v for x in LIMITS if (v := getattr(a, f"max_{x}")) is not None}
            text, code = analyze.analyze(spark, a.root, limits, a.fail_on_cycles, not a.no_provenance)
            if a.out:
                with open(a.out, "w", encoding="utf-8") as f:
                    f.write(text)
            text = "" if a.out else text + "\n"
        else:
            text, code = run_ratchet(spark, a.profile, a.floors, a.module, a.update, a.json)
    except Exception as e:  # a command that fails prints nothing on stdout
        print(e, file=sys.stderr)
        return 2
    sys.stdout.write(text)
    return code


if __name__ == "__main__":
    sys.exit(main())
