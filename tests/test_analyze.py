import json

import pytest

from modgauge.plans import commands
from modgauge.plans.analyze import analyze
from modgauge.sources import snapshots

BODY = "\n".join(f"\tx{i} := {i}\n\tuse(x{i})" for i in range(5))


@pytest.fixture
def project(tmp_path):
    def put(name, text):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)

    put("go.mod", "module example.org/shop\n\ngo 1.22\n")
    put("main.go", 'package main\n\nimport (\n\t"fmt"\n\t"example.org/shop/store"\n)\n\nfunc main() {\n\tfmt.Println(store.Get())\n}\n')
    put("store/store.go", f'package store\n\nimport "example.org/shop/price"\n\ntype Reader interface {{\n\tGet() int\n}}\n\ntype Box struct {{\n\ta, b int\n}}\n\nfunc (x *Box) A() int {{\n\treturn x.a\n}}\n\nfunc (x *Box) B() int {{\n\treturn x.b\n}}\n\nfunc one() {{\n{BODY}\n}}\n\nfunc two() {{\n{BODY.replace("x", "y")}\n}}\n')
    put("price/price.go", 'package price\n\nimport "example.org/shop/store"\n\ntype Tag struct{}\n')
    put("price/price_test.go", 'package price\n\nimport "testing"\n')
    put("vendor/other/o.go", "package other\n")
    return tmp_path


def test_snapshot_of_a_tree(spark, project):
    text, code = analyze(spark, str(project), now="2024-01-02T03:04:05Z", commit="abc")
    got = json.loads(text)
    assert code == 0 and snapshots.first_fault(text) is None and not text.endswith("\n")
    by = {x["path"]: x for x in got["modules"]}
    assert [*by] == ["example.org/shop", "example.org/shop/price", "example.org/shop/store"]
    assert [(x["name"], x["ca"], x["ce"]) for x in got["modules"]] == [("main", 0, 2), ("price", 1, 1), ("store", 2, 1)]
    store = by["example.org/shop/store"]
    assert (store["exportedTypes"], store["abstractTypes"], store["abstractness"], store["lcom"]) == (2, 1, 0.5, 2)
    assert got["cycles"] == [["example.org/shop/price", "example.org/shop/store"]] and got["status"] == "complete" and got["warnings"] == []
    assert len(store["duplications"]) == 1 and [b["lineCount"] for b in store["duplications"][0]["blocks"]] == [11, 11]
    assert got["provenance"]["input"] == {"path": str(project), "modulePath": "example.org/shop", "commitSHA": "abc"}
    assert "provenance" not in json.loads(analyze(spark, str(project), provenance=False)[0])


def test_limits_decide_the_exit_code(spark, project):
    assert analyze(spark, str(project), {"lcom": 1})[1] == 1 and analyze(spark, str(project), {"lcom": 2})[1] == 0
    assert analyze(spark, str(project), {}, fail_on_cycles=True)[1] == 1
    with pytest.raises(ValueError):
        analyze(spark, str(project), {"distance": 2})


def test_report_and_diff_read_it(spark, project, tmp_path, capsys):
    out = project / "graph.json"
    assert commands.main(["analyze", str(project), "--out", str(out)]) == 0 and capsys.readouterr().out == ""
    assert "example.org/shop" in commands.report(spark, str(out), "detailed")[0]
    assert commands.main(["diff", str(out), str(out), "--gate", "--max-lcom-rise", "1"]) == 0
    assert commands.main(["diff", str(out), str(out), "--max-lcom-rise", "9"]) == 2
    assert commands.main(["analyze", str(project / "vendor")]) == 2
