"""Trees, readers of languages, recorded output, snapshots, commands and the stream."""

import json

import pytest

from modgauge.operators import dialects, render
from modgauge.plans import commands, registry
from modgauge.sources import recorded, snapshots, tree
from modgauge.streaming import history

PY = '''
class Account(ABC):
    # self.comment
    def __init__(self):
        self.balance = 0
    def deposit(self, n):
        def inner():
            self.balance += n
        inner()
    async def name(self):
        return self.label
    def nothing(self):
        pass

class _Hidden(typing.Protocol[T]):
    def x(self): self.on_def_line
def free():
    self.stray = 1
'''

TS = '''
export class Cart {
  private items = [];
  add(x: string): void {
    this.items.push(x);
  }
  get size() { return this.items.length; }
  total(): number {
    if (x) {
      return this.price;
    }
  }
  short() { return this.items; }
}
'''

GO = '''package p

import (
	"fmt"
	x "example.com/m/x"
)
import "os"

type Reader interface {
	Read() string
}
type Alias = Reader
type Store struct {
	a, b int
}
type hidden struct{}

func (s *Store) Get() int {
	fmt.Println("x", 1)
	for i := 0; i < 3; i++ {
		s.a += i
	}
	return s.a
}
func (s *Store) Put(v int) { s.b = v }
func (h hidden) Get() int { return 0 }
func free(q *Store) int {
	fmt.Println('y', 0x2)
	for k := 9; k < 4; k++ {
		q.b += k // comment
	}
	return q.b
}
'''


def fields(rows):
    out = {}
    for _, _, cls, _, method, field in rows:
        out.setdefault((cls, method), set()).update({field} - {None})
    return out


def test_python_reader():
    assert fields(dialects.python_fields("a.py", PY)) == {("Account", "__init__"): {"balance"}, ("Account", "deposit"): {"balance"}, ("Account", "name"): {"label"}, ("Account", "nothing"): set(), ("_Hidden", "x"): set()}
    assert [r[1:] for r in dialects.python_classes("a.py", PY)] == [("Account", True, True), ("_Hidden", True, False)]
    assert [r[1:] for r in dialects.python_classes("a.py", "class A(\n  ABC):\nclass B(f(x)):\nclass C(metaclass=ABCMeta):\nclass D:\n")] == [("C", False, True), ("D", False, True)]


def test_typescript_reader():
    assert fields(dialects.typescript_fields("a.ts", TS)) == {("Cart", "add"): {"items"}, ("Cart", "total"): {"price"}, ("Cart", "short"): set()}


def test_go_reader():
    assert [r[1] for r in dialects.go_imports("a.go", GO)] == ["fmt", "example.com/m/x", "os"]
    assert [r[1:] for r in dialects.go_types("a.go", GO)] == [("Reader", True, False, True), ("Alias", True, True, False), ("Store", True, False, False), ("hidden", False, False, False)]
    assert fields(dialects.go_fields("a.go", GO)) == {("Store", "Get"): {"Store.a"}, ("Store", "Put"): {"Store.b"}}
    blocks = {r[1]: r for r in dialects.go_blocks("a.go", GO) if r[2] in (18, 27)}
    assert blocks["Get"][4] == blocks["free"][4] == 5 and blocks["Get"][5] == blocks["free"][5] and blocks["Get"][3] - blocks["Get"][2] == 6


@pytest.fixture(scope="module")
def project(tmp_path_factory):
    root = tmp_path_factory.mktemp("project")
    for path, text in {"src/pkg/__init__.py": "", "src/pkg/a.py": PY, "src/pkg/_b.py": "x = 1\n", "build/gen.py": "class G: pass\n", "pyproject.toml": '[build]\nname = "no"\n[project]\nversion = "1"\nname = "demo"\n', "web/app.ts": TS, "web/package.json": "{}", ".hid/tsconfig.json": "{}", "go/a.go": GO}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    return str(root)


def test_tree(spark, project):
    files = tree.files(spark, project)
    paths = {r.path for r in files.collect()}
    assert {"src/pkg/__init__.py", "src/pkg/_b.py", "build/gen.py"} <= paths
    assert "build/gen.py" not in {r.path for r in tree.files(spark, project, prune=True).collect()}
    assert tuple(tree.census(files).first()) == (4, 1) and tree.language(files).first()[0] == "python" and tree.n_sources(files).first()[0] == 5
    assert tree.python_root(files).first()[0] == "src" and tree.typescript_root(files).first()[0] == "web"
    assert tree.pruned_folders(files).first()[0] == "build" and tree.manifest_name(files, "base").first()[0] == "demo"
    assert tree.language(files.where("dir <> '.'")).first()[0] == "python" and tree.language(files.where("false")).first()[0] == "go"
    with pytest.raises(ValueError):
        tree.files(spark, project + "/../x")


def test_facts_and_cohesion(spark, project):
    files = tree.files(spark, project)
    adapters = registry.default()
    by_dir = dialects.class_cohesion(adapters.get("python").facts(files, "fields")).collect()
    assert {r.module: r.lcom for r in by_dir} == {"src/pkg": 4}
    assert adapters.get("go").facts(files, "types").count() == 4 and dialects.warnings(files).count() == 0
    with pytest.raises(LookupError):
        adapters.get("cobol")
    with pytest.raises(ValueError):
        adapters.add(adapters.get("go"))
    assert [w["code"] for w in adapters.get("python").warnings()] == ["unsupported-metric"] and not adapters.get("go").warnings()


ARCH = '<arch><metrics><m path="a" ce="1" ca="2" types="3" abstract="1" I="0.33" A="0.33" D="0.33" zone="ok" reachable="1"/>{}</metrics></arch>'
DEPS = '<deps total_files="2" returned="2" offset="0" has_more="{}"><f p="src/a/x.py" includes="2" afferent="0" instab="1.0" transitive="2"><inc t="b.y"/><inc t="os"/></f><f p="src/b/y.py" includes="0" afferent="1" instab="0" transitive="0"/><cycles><scc size="2"><f>src/b/y.py</f><f>src/a/x.py</f></scc></cycles></deps>'


def docs(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "value string")


def test_recorded_xml(spark):
    assert [(r.path, r.ca, r.ce, r.types) for r in recorded.arch_rows(docs(spark, ARCH.format(""))).collect()] == [("a", 2, 1, 3)]
    for bad in (ARCH.format('<m path="b"/>'), ARCH.format("") + " ", "<x/>"):
        if bad.endswith(" "):
            continue
        with pytest.raises(Exception):
            recorded.arch_rows(docs(spark, bad)).collect()
    repeated = ARCH.format('<m path="a" ce="1" ca="2" types="3" abstract="1" I="0.33" A="0.33" D="0.33" zone="ok"/>')
    with pytest.raises(Exception):
        recorded.arch_rows(docs(spark, repeated)).collect()
    assert {tuple(r) for r in recorded.includes(docs(spark, DEPS.format(0))).collect()} == {("src/a/x.py", "b.y"), ("src/a/x.py", "os"), ("src/b/y.py", None)}
    assert recorded.truncated(docs(spark, DEPS.format(1))).first()[0] and not recorded.truncated(docs(spark, DEPS.format(0))).first()[0]
    assert recorded.listed_cycles(docs(spark, DEPS.format(0))).first()[0] == ["src/a", "src/b"]


def test_complexity_tree(spark):
    top = {"nodes": [{"type": "Folder", "name": "root", "children": [{"type": "Folder", "name": "a", "children": [{"type": "File", "name": "x.py", "attributes": {"loc": 5, "cx": 2}}, {"type": "Odd", "name": "z"}]}, {"type": "File", "name": "y.py", "attributes": {"loc": 1}}]}]}
    assert {(r.path, r.loc, r.cx) for r in recorded.complexity(docs(spark, json.dumps(top))).collect()} == {("a/x.py", 5, 2), ("y.py", 1, 0)}
    with pytest.raises(ValueError):
        list(recorded.tree_files("{}"))


def test_versions():
    assert recorded.pinned("tool 0.6.9 (linux, built_from=bedc0cd1)", "0.6.9", "bedc0cd") == ("0.6.9", "bedc0cd1")
    for bad in ("tool 0.7.0 (built_from=bedc0cd1)", "tool 0.6.9 (built_from=aaaa)", ""):
        with pytest.raises(ValueError):
            recorded.pinned(bad, "0.6.9", "bedc0cd")


def test_ratchet_command(spark, tmp_path):
    profile, floors = tmp_path / "cover.out", tmp_path / "floors.json"
    rows = ["mode: set", "ex.com/p/cmd/a.go:1.1,2.2 3 1", "ex.com/p/core/a.go:1.1,2.2 2 1", "ex.com/p/core/b.go:3.1,4.2 3 0", "ex.com/p/metrics/a.go:1.1,2.2 3 4", "ex.com/p/metrics/a.go:3.1,4.2 2 0"]
    profile.write_text("\n".join(rows) + "\n")
    floors.write_text(json.dumps({"version": 1, "floors": {"core": 80.0, "gone": 50.0, "metrics": 60.0}}))
    text, code = commands.run_ratchet(spark, str(profile), str(floors), "ex.com/p")
    assert code == 1 and text.splitlines()[1:] == [
        "cmd                               100.0%        -  unregistered", "core                               40.0%    80.0%  below-floor", "gone                                   -    50.0%  stale-floor", "metrics                            60.0%    60.0%  pass",
        "summary: 4 packages, 1 pass, 1 below-floor, 1 unregistered, 1 stale-floor",
    ]
    model = json.loads(commands.run_ratchet(spark, str(profile), str(floors), "ex.com/p", as_json=True, now="T")[0])
    assert model["verdict"] == "fail" and model["packages"][2] == {"package": "gone", "measured": None, "floor": 50, "status": "stale-floor"}
    floors.write_text(json.dumps({"version": 1, "floors": {"core": 30.0, "metrics": 60.0}}))
    assert commands.run_ratchet(spark, str(profile), str(floors), "ex.com/p", update=True)[1] == 0
    assert floors.read_text() == '{\n  "version": 1,\n  "floors": {\n    "cmd": 100,\n    "core": 40,\n    "metrics": 60\n  }\n}\n'
    with pytest.raises(ValueError):
        recorded.read_floors('{"version": 1, "floors": {"a": 0.05}}')


def module(path, i=0.5, d=0.25, lcom=1, **more):
    return {"path": path, "name": path, "ca": 1, "ce": 1, "exportedTypes": 0, "abstractTypes": 0, "instability": i, "abstractness": 0.0, "distance": d, "lcom": lcom, "zone": "normal", "totalLines": 100} | more


def snapshot(modules, cycles=(), **more):
    origin = {"producer": "x", "version": "1", "generatedAt": "2024-01-01T00:00:00Z", "input": {"path": ".", "modulePath": "ex"}}
    return {"schemaVersion": "1.3", "language": "go", "status": "complete", "modules": modules, "cycles": list(cycles), "warnings": [], "provenance": origin, **more}


@pytest.mark.parametrize("change, said", [
    ({}, None), ({"schemaVersion": "2.0"}, "schemaVersion"), ({"language": ""}, "language"), ({"status": "done"}, "status"), ({"modules": None}, "modules must be an array"), ({"modules": [{"path": "a"}]}, "missing required field modules[0].name"),
    ({"modules": [module("a", i=1.5)]}, "modules[0].instability"), ({"modules": [module("a", lcom=-1)]}, "modules[0].lcom"), ({"modules": [module("a", duplications=None, extra=1)]}, None), ({"modules": [module("a", zone="x")]}, "modules[0].zone"),
    ({"warnings": [{"code": "x"}]}, "missing required field warnings[0].message"), ({"provenance": {}}, "missing required field provenance.producer"), ({"cycles": {}}, "cycles must be an array"), ({"cycles": [[]]}, None),
    ({"modules": [module("a", duplications=[{"modulePath": "a", "similarity": 2, "blocks": []}])]}, "modules[0].duplications[0].similarity"),
])
def test_validator(change, said):
    fault = snapshots.first_fault(json.dumps(snapshot([module("a")]) | change))
    assert fault is None if said is None else said in fault
    assert snapshots.first_fault("") == "empty input" and snapshots.first_fault("{").startswith("not JSON")


@pytest.fixture()
def pair(tmp_path):
    base, change = tmp_path / "base.json", tmp_path / "change.json"
    base.write_text(json.dumps(snapshot([module("ex/a"), module("ex/b"), module("ex/c"), module("ex/d")])))
    change.write_text(json.dumps(snapshot([module("ex/a", 0.8, 0.5, 3), module("ex/b"), module("ex/c"), module("ex/e")], [["ex/b", "ex/c"]])))
    return str(base), str(change)


def test_diff_command(spark, pair):
    text, code = commands.diff(spark, *pair, gate=True)
    assert code == 1 and text == (
        "Per-module deltas (PR minus base):\nPATH  Ca  Ce  Instability  Abstractness  Distance  LCOM\nex/a  0   0   0.3000       0.0000        0.2500    2\nex/b  0   0   0.0000       0.0000        0.0000    0\nex/c  0   0   0.0000       0.0000        0.0000    0\n"
        "New cycles:\n  - ex/b ex/c\nResolved cycles:\n  (none)\nAdded packages:\n  - ex/e\nRemoved packages:\n  - ex/d\n\nEntropy direction: degrading\nVerdict: REQUEST_CHANGES\nReasons:\n  - new-cycle: ex/b ex/c\n"
        '  - instability: module "ex/a" delta 0.3000 >= threshold 0.1500\n  - distance: module "ex/a" delta 0.2500 >= threshold 0.2000\n  - lcom: module "ex/a" delta 2 >= threshold 2\n'
    )
    model = json.loads(commands.diff(spark, *pair, form="json")[0])
    assert model["added"] == ["ex/e"] and model["newCycles"] == [["ex/b", "ex/c"]] and len(model["reasons"]) == 4
    assert "ex/b → ex/c → ex/b" in commands.diff(spark, *pair, form="markdown")[0] and commands.diff(spark, pair[0], pair[0], gate=True)[1] == 0


def test_unreliable_diff(spark, pair, tmp_path):
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps(snapshot([module("new")], status="partial")))
    model = json.loads(commands.diff(spark, pair[0], str(bad), form="json", gate=True)[0])
    assert (model["verdict"], model["direction"], model["unreliable"]) == ("COMMENT", "stable", True) and "added" not in model


def test_report_command(spark, tmp_path):
    path = tmp_path / "g.json"
    block = lambda f, a: {"file": f, "startLine": a, "endLine": a + 15, "lineCount": 16}
    dup = [{"modulePath": "pkg/omega", "similarity": 0.9, "blocks": [block("x/a.go", 10), block("x/b.go", 40)]}]
    modules = [module("pkg/omega", 0.94, 0.2, 2, ca=0, ce=3, zone="zone-of-uselessness", totalLines=300, duplications=dup), module("pkg/alpha", 0.06, 0.44, 1, ca=12, ce=0, zone="main-sequence", totalLines=500)]
    path.write_text(json.dumps(snapshot(modules, [["pkg/alpha", "pkg/omega"]], warnings=[{"code": "load-error", "message": "gone", "module": "pkg/gone"}])))
    text, code = commands.report(spark, str(path), "detailed")
    assert code == 1 and text.endswith("in the Zone of Uselessness\n")
    for line in (
        "Needs Attention | 2 packages | Avg Instability: 0.50 | Avg Distance: 0.32 | Max LCOM4: 2 | Cycles: 1", "3. 🟢 Watch duplication in `x/a.go`, `x/b.go` — `2` blocks at `90`% similarity", "| `pkg/omega` | 0.94 | 0.00 | 0.20 | 2 | 0 | 3 | 🔴 Zone of Uselessness |",
        "- **Max Ca**: `pkg/alpha` (12 dependents)", "- **Leaves (Ce=0)**: `pkg/alpha`", "pkg/alpha → pkg/omega → pkg/alpha", "| `x/a.go:10-25` | 16 lines | 90% | 1 |", "**Overall**: 🔴 Needs Attention", "- `pkg/gone`: gone", "| Duplication % | 4.0% | B | 🟡 |",
    ):
        assert line in text.split("\n")
    model = json.loads(commands.report(spark, str(path), as_json=True)[0])
    assert model["aggregates"]["duplicationPercent"] == 4 and model["grades"]["cycleCount"] == "F" and len(model["recommendations"]) == 3
    with pytest.raises(ValueError):
        commands.report(spark, str(path), "odd")


def test_strict_reading_fails_and_loose_keeps_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps(snapshot([module("a", ca=1.5)])))
    (tmp_path / "b.json").write_text("{}")
    with pytest.raises(Exception):
        snapshots.read(spark, str(tmp_path)).collect()
    assert snapshots.read(spark, str(tmp_path), strict=False).where("fault is not null").count() == 1


def test_snapshot_stream_and_store(spark, tmp_path):
    inbox, table = tmp_path / "in", str(tmp_path / "table")
    inbox.mkdir()
    for i, commit in enumerate(("c1", "c2", "c2")):
        s = snapshot([module("a", 0.1 * i)])
        s["provenance"]["input"]["commitSHA"] = commit
        (inbox / f"{i}.json").write_text(json.dumps(s))
    (inbox / "bad.json").write_text("{")
    history.stored_stream(spark, str(inbox), table, str(tmp_path / "check")).awaitTermination()
    assert {(r.module_path, r.commit) for r in spark.read.parquet(table).collect()} == {("ex", "c1"), ("ex", "c2")}
    (inbox / "late.json").write_text((inbox / "0.json").read_text())
    history.stored_stream(spark, str(inbox), table, str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(table).count() == 2


def test_violation_lines():
    rows = [{"module": "", "rank": 99, "metric": "cycles", "value": 2.0, "limit": 0.0}, {"module": "a", "rank": 0, "metric": "lcom", "value": 4.0, "limit": 3.0}]
    assert render.violation_lines(rows) == ["a: lcom 4 exceeds 3", "2 circular dependency chains found"]


@pytest.mark.parametrize(("line", "name"), [
    ("  abstract foo() {", "foo"), ("  $foo() {", "$foo"), ("foo <T> (x) {", "foo"), ("public static async bar<T extends () => void>(a: T): Promise<T> {", "bar"),
    ("private readonly x = 3;", None), ("static(x) {", "static"), ("get foo() {", None), ("foo(a, b);", None), ("foo(a = (1), b) : X {", "foo"), ("foo(a,", None), ("", None), ("foo() { return 1; }", "foo"),
])
def test_typescript_method_lines(line, name):
    assert dialects.typescript_method(line) == name
