"""Reports as text: Markdown, tables and JSON models from a snapshot's small result tables, on the driver.

Everything here takes plain rows that were counted and cut down before; nothing is computed from modules
beyond one line for each of them.
"""

from __future__ import annotations

from collections import Counter

from ..functions.encode import columns, count, dumps, ticked
from ..functions.metrics import EMOJI, GRADES, OVERALL, SEVERITY_RANK

PRODUCER, VERSION = "modgauge", "dev"
#: Fixed words of reports.
SEVERITY = {"red": "🔴", "yellow": "🟡", "green": "🟢"}
ZONE = {"main-sequence": "🟢 Main Sequence", "normal": "🟡 Balanced", "zone-of-pain": "🔴 Zone of Pain", "zone-of-uselessness": "🔴 Zone of Uselessness"}
WORD = {"Healthy": "🟢", "Mixed": "🟡", "Needs Attention": "🔴"}
STATUSES = ("pass", "raised", "added", "unchanged", "below-floor", "unregistered", "stale-floor", "refused")
LEGEND = "📖 Instability = outgoing dependencies / all dependencies | Abstractness = abstract types / all types | Distance = gap to the ideal balance | LCOM4 = unrelated parts (1 is best, ≥4 suggests a split) | Ca = packages that depend on this one | Ce = packages it depends on"
MESSAGES = {
    "lcom4-split": "Split `{path}` — LCOM4 of `{value:.0f}` suggests multiple unrelated responsibilities",
    "distance-refactor": "Refactor `{path}` — Distance of `{value:.2f}` from Main Sequence places it in `{note}`",
    "cycle-break": "Break cycle between {note} — circular dependencies prevent independent testing",
    "instability-isolate": "Isolate `{path}` — Instability of `{value:.2f}`; depends on everything, nothing depends on it; appropriate for CLI layers",
    "instability-protect": "Protect `{path}` — Instability of `{value:.2f}` makes it maximally stable; changes ripple widely",
    "ce-decouple": "Decouple `{path}` — `{value:.0f}` efferent couplings; consider interface extraction",
    "abstractness-interfaces": "Add interfaces to `{path}` — 0 abstractness with `{value:.0f}` exported types leaves no room for abstraction",
    "duplication-eliminate": "Eliminate duplicate blocks — `{value:.0f}` blocks at `{similarity:.0f}`% similarity in {files}",
    "duplication-watch": "Watch duplication in {files} — `{value:.0f}` blocks at `{similarity:.0f}`% similarity",
    "all-clear": "Architecture is healthy — no significant issues detected; keep monitoring",
}


def message(hit) -> str:
    similarity, _, files = hit["note"].partition("|") if hit["rule"].startswith("duplication") else ("0", "", "")
    return MESSAGES[hit["rule"]].format(path=hit["module_path"], value=hit["value"], note=hit["note"], similarity=100 * float(similarity), files=files)


def listing(rows: list[str], none: str) -> list[str]:
    return [f"- {x}" for x in rows] or [none]


def table(head: list[str], rows: list[list[str]]) -> list[str]:
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return [line(head), "|" + "|".join("-" * (len(h) + 2) for h in head) + "|", *map(line, rows)]


def cycle_lines(cycles: list[list[str]], none: str) -> list[str]:
    some = sorted(c for c in cycles if c)
    if not some:
        return [none]
    return [f"🔴 **{count(len(some), 'cycle')} detected:**", "", "```", *[" → ".join([*c, c[0]]) for c in some], "```"]


def joined(sections: list[list[str]]) -> str:
    return "\n\n".join("\n".join(s) for s in sections).rstrip("\n") + "\n"


def report(agg, hits: list, modules: list, cycles: list[list[str]], blocks: list, warnings: list, detailed: bool = True, producer: str = PRODUCER, version: str = VERSION) -> str:
    """Markdown report. agg is the graded one-row aggregate; the others are the rows of their tables."""
    modules = sorted(modules, key=lambda m: (m["module"], m["ca"], m["ce"]))
    bad = any(h["severity"] in ("red", "yellow") for h in hits)
    status = f"{'Needs Attention' if bad else 'All Clear'} | {count(len(modules), 'package')} | Avg Instability: {agg['mean_instability']:.2f} | Avg Distance: {agg['mean_distance']:.2f} | Max LCOM4: {agg['max_lcom']} | Cycles: {agg['n_cycles']}"
    head = f"**Provenance**: {producer} {version} | {count(len(modules), 'package')} | {count(sum(m['total_lines'] for m in modules), 'line')}"
    out = [["# 🏗️ Architectural Health Report"], [head], [LEGEND], [status], ["## Prioritized Recommendations"], [f"{i}. {SEVERITY[h['severity']]} {message(h)}" for i, h in enumerate(hits, 1)]]
    if not detailed:
        return joined(out)
    out += [["## 📊 Package Metrics"], table(["Package", "Instability", "Abstractness", "Distance", "LCOM4", "Ca", "Ce", "Zone"], [[f"`{m['module']}`", *(f"{m[c]:.2f}" for c in ("instability", "abstractness", "distance")), *(str(m[c]) for c in ("lcom", "ca", "ce")), ZONE[m["zone"]]] for m in modules])]
    names = lambda test: ticked(m["module"] for m in modules if test(m)) or "none"
    most = lambda c, sign: min(modules, key=lambda m: (sign * m[c], m["module"])) if modules else None
    said = lambda m, text: f"`{m['module']}` ({text(m)})" if m else "none"
    plural = lambda n, one, many: f"{n} {one if n == 1 else many}"
    out += [["## 🔗 Coupling Summary"], [
        "- **Max Ca**: " + said(most("ca", -1), lambda m: plural(m["ca"], "dependent", "dependents")), "- **Max Ce**: " + said(most("ce", -1), lambda m: plural(m["ce"], "dependency", "dependencies")),
        "- **Leaves (Ce=0)**: " + names(lambda m: m["ce"] == 0), "- **Heavily depended-on (Ca > 10)**: " + names(lambda m: m["ca"] > 10)]]
    out += [["## 🧩 Cohesion Summary"], [
        "- **Best**: " + said(most("lcom", 1), lambda m: f"LCOM4={m['lcom']}"), "- **Worst**: " + said(most("lcom", -1), lambda m: f"LCOM4={m['lcom']}"), "- **Packages needing review (LCOM4 ≥ 4)**: " + names(lambda m: m["lcom"] >= 4)]]
    out += [["## 🔄 Circular Dependencies"], cycle_lines(cycles, "🟢 No circular dependencies detected."), ["## 📋 Code Duplication"]]
    rows = [[f"`{b['file']}:{b['start']}-{b['end']}`", count(b["line_count"], "line"), f"{100 * b['similarity']:.0f}%", str(b["occurrences"])] for b in sorted(blocks, key=lambda b: (b["file"], b["start"], b["end"]))]
    out += [[f"**{count(len(rows), 'duplicated block')} detected (overall {agg['dup_percent']:.1f}%):**"], table(["File", "Lines", "Similarity", "Occurrences"], rows)] if rows else [["No duplicated blocks detected."]]
    scores = [("Avg Distance from Main Sequence", f"{agg['mean_distance']:.2f}", "g_distance"), ("Max LCOM4", str(agg["max_lcom"]), "g_lcom"), ("Cycle Count", str(agg["n_cycles"]), "g_cycles"), ("Duplication %", f"{agg['dup_percent']:.1f}%", "g_duplication"), ("Instability Spread", count(agg["spread"], "extreme"), "g_spread")]
    overall = OVERALL[max((agg[g] for _, _, g in scores), key=GRADES.index)]
    out += [["## 🏥 Health Scorecard"], table(["Dimension", "Value", "Grade", "Status"], [[n, v, agg[g], EMOJI[agg[g]]] for n, v, g in scores]), [f"**Overall**: {WORD[overall]} {overall}"]]
    noted = [f"`{w['module']}`: {w['message']}" if w["module"] else w["message"] for w in sorted(warnings, key=lambda w: (w["module"], w["code"], w["message"]))]
    noted += [f"`{m['module']}` is in the {ZONE[m['zone']][2:]}" for m in modules if m["zone"].startswith("zone-")]
    return joined([*out, ["## ⚠️ Warnings"], listing(noted, "No warnings.")])


def report_model(agg, hits: list) -> str:
    """The report as JSON, keys in fixed order."""
    bad = any(h["severity"] in ("red", "yellow") for h in hits)
    value = {
        "aggregates": {"meanInstability": agg["mean_instability"], "meanDistance": agg["mean_distance"], "maxLCOM4": agg["max_lcom"], "cycleCount": agg["n_cycles"], "instabilitySpread": agg["spread"], "duplicationPercent": agg["dup_percent"]},
        "grades": {"averageDistance": agg["g_distance"], "maxLCOM4": agg["g_lcom"], "cycleCount": agg["g_cycles"], "duplicationPercent": agg["g_duplication"], "instabilitySpread": agg["g_spread"]},
        "status": "Needs Attention" if bad else "All Clear",
        "recommendations": [{"severity": h["severity"], "rule": h["rule"], "modulePath": h["module_path"], "message": message(h)} for h in sorted(hits, key=lambda h: SEVERITY_RANK[h["severity"]])],
    }
    return dumps(value) + "\n"


def reason_lines(reasons: list, thresholds) -> list[str]:
    """Reasons in their order: new cycles by key, then modules by path and metric."""
    out = []
    for r in sorted(reasons, key=lambda r: (r["kind_rank"], r["subject"], r["metric_rank"])):
        if r["kind_rank"] == 0:
            out.append("new-cycle: " + r["subject"].replace("\x00", " "))
        else:
            form = "d" if r["metric"] == "lcom" else ".4f"
            whole = int if r["metric"] == "lcom" else float
            out.append(f'{r["metric"]}: module {dumps(r["subject"])} delta {whole(r["value"]):{form}} >= threshold {whole(getattr(thresholds, r["metric"])):{form}}')
    return out


def _cells(d) -> dict[str, str]:
    return {c: f"{d[f'd_{c}'] + 0.0:.4f}" for c in ("instability", "abstractness", "distance")} | {c: str(d[f"d_{c}"]) for c in ("ca", "ce", "lcom")}


def diff_table(deltas: list, cycles: list, direction: str, verdict: str, reasons: list[str], unreliable: bool = False) -> str:
    both = sorted((d for d in deltas if d["state"] == "both"), key=lambda d: d["module"])
    rows = [["PATH", "Ca", "Ce", "Instability", "Abstractness", "Distance", "LCOM"], *[[d["module"], *(_cells(d)[c] for c in ("ca", "ce", "instability", "abstractness", "distance", "lcom"))] for d in both]]
    block = lambda title, some: f"{title}:\n" + "".join(f"  - {x}\n" for x in some or []) + ("" if some else "  (none)\n")
    of = lambda state: [" ".join(c["members"]) for c in sorted((c for c in cycles if c["state"] == state), key=lambda c: c["key"])]
    at = lambda state: [] if unreliable else sorted(d["module"] for d in deltas if d["state"] == state)
    text = "Per-module deltas (PR minus base):\n" + columns(rows) + block("New cycles", of("new")) + block("Resolved cycles", of("resolved")) + block("Added packages", at("added")) + block("Removed packages", at("removed"))
    return text + f"\nEntropy direction: {direction}\nVerdict: {verdict}\n" + (block("Reasons", reasons) if reasons else "")


def diff_markdown(deltas: list, cycles: list, direction: str, verdict: str, reasons: list[str]) -> str:
    both = sorted((d for d in deltas if d["state"] == "both"), key=lambda d: d["module"])
    names = ("instability", "abstractness", "distance", "lcom", "ca", "ce")
    rows = [[f"`{d['module']}`", *(_cells(d)[c] for c in names)] for d in both]
    of = lambda state: [c["members"] for c in cycles if c["state"] == state]
    return joined([
        ["# 🏗️ Structural Entropy Diff"], [f"**Verdict**: {verdict} | **Entropy direction**: {direction}"], ["## ⚠️ Verdict Reasons"], listing(reasons, "None."), ["## 📊 Per-module Deltas (PR minus base)"],
        table(["Package", "Instability", "Abstractness", "Distance", "LCOM4", "Ca", "Ce"], rows) if rows else ["None."], ["## 🔄 New Cycles"], cycle_lines(of("new"), "None."), ["## 🔄 Resolved Cycles"], cycle_lines(of("resolved"), "None."),
    ])


def diff_model(deltas: list, cycles: list, direction: str, verdict: str, reasons: list[str], unreliable: bool = False) -> str:
    """The diff as JSON; added and removed are left out where empty, and reasons never are."""
    at = lambda state: [] if unreliable else sorted(d["module"] for d in deltas if d["state"] == state)
    of = lambda state: [list(c["members"]) for c in sorted((c for c in cycles if c["state"] == state), key=lambda c: c["key"])]
    value = {"modules": [{"path": d["module"]} | {c: d[f"d_{c}"] for c in ("ca", "ce", "instability", "abstractness", "distance", "lcom")} for d in sorted(deltas, key=lambda d: d["module"]) if d["state"] == "both"]}
    value |= {k: v for k, v in (("added", at("added")), ("removed", at("removed"))) if v}
    return dumps(value | {"newCycles": of("new"), "resolvedCycles": of("resolved"), "direction": direction, "unreliable": unreliable, "verdict": verdict, "reasons": reasons}) + "\n"


def ratchet_table(rows: list) -> str:
    """Packages with their measured percent, floor and status, and a summary line."""
    rows = sorted(rows, key=lambda r: r["package"])
    share = lambda x: "-" if x is None else f"{x:.1f}%"
    width = max([28, *(len(r["package"]) + 2 for r in rows)])
    line = lambda a, b, c, d: f"{a:<{width}}{b:>12}{c:>9}  {d}\n"
    n = Counter(r["status"] for r in rows)
    summary = ", ".join([count(len(rows), "package"), *(f"{n[s]} {s}" for s in STATUSES if n[s])])
    return line("package", "measured", "floor", "status") + "".join(line(r["package"], share(r["percent"]), share(r["floor"]), r["status"]) for r in rows) + f"summary: {summary}\n"


def ratchet_model(rows: list, updated: bool, generated_at: str, producer: str = PRODUCER, version: str = VERSION) -> str:
    rows = sorted(rows, key=lambda r: r["package"])
    good = all(r["status"] in STATUSES[:4] for r in rows)
    value = {"packages": [{"package": r["package"], "measured": r["percent"], "floor": r["floor"], "status": r["status"]} for r in rows], "verdict": "pass" if good else "fail", "updated": updated}
    return dumps(value | {"provenance": {"producer": producer, "version": version, "generatedAt": generated_at}}) + "\n"


def violation_lines(rows: list) -> list[str]:
    """One line a violation, modules first and by path, cycles last."""
    out = []
    for r in sorted(rows, key=lambda r: (r["rank"] == 99, r["module"], r["rank"])):
        out.append(f"{count(int(r['value']), 'circular dependency chain')} found" if r["metric"] == "cycles" else f"{r['module']}: {r['metric']} {r['value']:.4g} exceeds {r['limit']:.4g}")
    return out
