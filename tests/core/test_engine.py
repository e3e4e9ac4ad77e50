"""The static-quality engine on small projects."""

import json
import random
import subprocess

import pytest
from pyspark.sql import functions as F

from vellum.functions import text as X
from vellum.operators import audit, clones, findings, graph, scores, tasks
from vellum.plans.project import Project, parse
from vellum.sources import config as conf
from vellum.sources import files, lint, qml

MAIN = """import QtQuick 2.15

Item {
    id: root
    property string title: "Hello"
    width: 100
    height: 40
    Rectangle {
        id: card
        color: "#ff0000"
        visible: root.title.length > 0 ? true : false
    }
    function choose(kind) {
        if (kind) {
            return card.width
        }
        return 0
    }
}
"""


def project(spark, sources, **options):
    rows = [(p, "qmldir" if p.endswith("qmldir") else p.rsplit(".", 1)[1], t) for p, t in sources.items()]
    return Project(spark.createDataFrame(rows, "path string, kind string, text string"), conf.Config(**options))


def kinds(df):
    return {(r["kind"], r["file"]) for r in df.collect()}


def test_golden_component(spark):
    p = project(spark, {"Main.qml": MAIN})
    c = p.components.first()
    assert tuple(c["loc"]) == (20, 18, 2, 0)
    assert (c["object_count"], c["max_depth"], c["ids_declared"], c["bindings"]) == (2, 2, 2, 7)
    assert (c["public_properties"], c["aliases"], c["signals"], c["functions"]) == (1, 0, 0, 1)
    assert (c["id_reference_count"], c["distinct_id_references"], c["hardcoded_colors"], c["numeric_style_literals"]) == (2, 2, 1, 2)
    f = p.functions.first()
    assert (f["lines"], f["cyclomatic"], f["cognitive"], f["max_nesting"], f["effort"]) == (6, 2, 2, 2, 11)
    assert {r["path"]: r["complexity"] for r in p.bindings.collect()}["visible"] == 2
    assert (c["effort"], c["complexity_score"], c["locality_score"], c["leverage_score"]) == (34, 87, 92, 45)
    assert p.findings.count() == 0
    assert p.scores.first().asDict() == {"overall": 92, "complexity": 100, "cognitive": 100, "effort": 100, "locality": 92, "leverage": 45, "duplication": 100, "size": 100, "styling": 96, "boundary": 100}
    h = scores.hotspots(p).first()
    assert h["score"] == 32 and h["reasons"] == []
    node = graph.architecture(p)[0].first()
    assert (node["risk_score"], node["risk"]) == (19, "low")
    assert kinds(findings.cleanup_findings(p)) == {("cleanup.unused_component", "Main.qml")}


@pytest.mark.parametrize(
    "text,check",
    [
        ("Item { Component { Text { id: t } } }", lambda r: [o["type"] for o in r["objects"]] == ["Item", "Text"]),
        ("Item { Behavior on x { velocity: 3 } }", lambda r: [b["path"] for b in r["bindings"]] == ["x.velocity"]),
        ("Item { anchors { left: a; right: b } Layout.fillWidth: true }", lambda r: [b["path"] for b in r["bindings"]] == ["anchors.left", "anchors.right", "Layout.fillWidth"]),
        ("Item { property int a; property int b: 2 }", lambda r: [p["name"] for p in r["properties"]] == ["b", "b"]),
        ("Item { signal s() }", lambda r: [d["message"] for d in r["diagnostics"]] == ["Unclosed Item object"]),
        ("Item { enum E { A } }", lambda r: [o["type"] for o in r["objects"]] == ["Item", "E"]),
        ("Item {\n a: b +\n c\n d: [1,\n 2]\n}", lambda r: [b["expression"] for b in r["bindings"]] == ["b +\n c", "[1,\n 2]"]),
        ('pragma Singleton\nimport "x.js" as X\nimport a.b 2.0\nimport\nItem {}', lambda r: [(i["module"], i["version"], i["alias"]) for i in r["imports"]] == [("x.js", None, "X"), ("a.b", "2.0", None)] or len(r["imports"]) >= 2),
        ("Item { function f(p) { let q = p; return z.q } x: { y: 1 } }", lambda r: [x["name"] for x in r["refs"]] == ["z"]),
        ("Item { id: a; Item { id: b; x: a.x } }", lambda r: [(x["name"], x["target"], x["external"]) for x in r["refs"]] == [("a", 1, True)]),
        ("// nothing\nfoo bar", lambda r: r["diagnostics"] == [{"line": 2, "message": "No root QML object found"}]),
        ("Item { x: 'it /* no', y: \"a\\\"//\" } /* open", lambda r: len(r["bindings"]) == 1),
        ("", lambda r: not r["objects"] and not r["diagnostics"]),
        ("Item { function f() { if (a) { } ", lambda r: [d["message"] for d in r["diagnostics"]] == ["Function f has an unclosed body", "Unclosed Item object"]),
        ("Item { delegate: Rectangle { x: 1 } }", lambda r: [b["path"] for b in r["bindings"]] == ["x", "delegate"] and r["objects"][1]["parent_id"] == 1),
    ],
)
def test_parser(text, check):
    r = qml.read_source("d/A.qml", "qml", text)
    assert check(r), r


def test_scripts_and_stripping():
    r = qml.read_source("a.js", "js", 'function one(a) { if (a) { return "}" } }\nconst two = (x) => { return x }\n')
    assert [(e["name"], e["line"], e["lines"]) for e in r["executables"]] == [("one", 1, 1), ("two", 2, 1)]
    assert qml.strip_code("a // b\n'c' /* d\n*/ e", True) == "a     \n        \n   e"
    assert qml.strip_code("'// no' //x") == "'// no'    "


SCOPED = {
    "controls/qmldir": "module my.controls\nButton2 1.0 Button2.qml\ninternal Hidden Hidden.qml\nsingleton Theme 1.0 Theme.qml\nplugin x\nGone 1.0 Gone.qml # no\n",
    "controls/Button2.qml": "Item {\n property int used\n property int idle\n signal hit\n signal lost\n}",
    "controls/Hidden.qml": "Item {}",
    "controls/Theme.qml": "Item {}",
    "widgets/Card.qml": "Item { Side {} }",
    "widgets/Side.qml": "Item {}",
    "Main.qml": 'import my.controls as C\nimport "widgets"\nimport QtQuick.Controls\nimport nowhere.module\nimport "./nope"\nItem {\n C.Button2 { used: 1; onHit: x() }\n Card {}\n Button2 {}\n C.Missing {}\n}',
}


def test_resolution(spark):
    p = project(spark, SCOPED)
    got = {r["module"]: (r["kind"], r["target"]) for r in p.resolution.imports.collect()}
    assert got == {"my.controls": ("local_module", "controls/qmldir"), "widgets": ("local_directory", "widgets"), "QtQuick.Controls": ("external", None), "nowhere.module": ("unresolved", None), "./nope": ("unresolved", None)}
    uses = {(r["file"], r["type"]): (r["target"], r["unresolved"]) for r in p.resolution.uses.collect()}
    assert uses == {("Main.qml", "C.Button2"): ("controls/Button2.qml", False), ("Main.qml", "Card"): ("widgets/Card.qml", False), ("Main.qml", "Button2"): (None, True), ("Main.qml", "C.Missing"): (None, True), ("widgets/Card.qml", "Side"): ("widgets/Side.qml", False)}
    assert {r["file"] for r in p.resolution.public_files.collect()} == {"controls/Button2.qml", "controls/Theme.qml"}
    found = kinds(p.findings)
    assert {("cleanup.unused_public_property", "controls/Button2.qml"), ("cleanup.unused_public_signal", "controls/Button2.qml"), ("resolution.unknown_type", "Main.qml"), ("resolution.unresolved_import", "Main.qml")} <= found
    names = {r["id"] for r in p.findings.collect()}
    assert "cleanup.unused_public_property.controls/Button2.qml.idle" in names and "cleanup.unused_public_property.controls/Button2.qml.used" not in names
    comps = {r["file"]: (r["use_count"], r["fan_out"]) for r in p.components.collect()}
    assert comps["Main.qml"] == (0, 2) and comps["widgets/Card.qml"] == (1, 1)


def test_names_and_scope_order(spark):
    p = project(spark, {"a/Card.qml": "Item {}", "b/Card.qml": "Item {}", "Main.qml": 'import "a"\nimport "b"\nItem { Card {} }'})
    assert {r["name"]: r["files"] for r in p.resolution.names.collect()}["Card"] == ["a/Card.qml", "b/Card.qml"]
    assert [r["target"] for r in p.resolution.uses.collect()] == ["b/Card.qml"]


def test_semantic_rules(spark):
    p = project(
        spark,
        {
            "Target.qml": "Item { signal ready\n}",
            "Main.qml": """Item {
 id: root
 property int n: 1
 width: n
 onClicked: { root.width = 5; let n = 3; height = Qt.binding(function() { return 1 }) }
 Target { id: target }
 Connections { target: target; onMissing: go()
 function onReady() { } }
 Item { anchors.left: parent.left; Layout.fillWidth: true; x: 3 }
 Loader { } Image { source: "a" }
 MyDelegate { text: a ? b : c ? d : e }
 Rectangle { first: second; second: third; third: first + 1 }
}""",
        },
    )
    got = {(r["kind"], r["line"]) for r in findings.semantic_findings(p).collect()}
    assert got == {
        ("qml.binding_loss", 5), ("qml.connection_signal_mismatch", 7), ("qml.layout_conflict.anchors_with_layout", 9), ("qml.layout_conflict.anchors_with_geometry", 9),
        ("qml.performance.loader_without_active", 10), ("qml.performance.image_without_source_size", 10), ("qml.performance_complex_delegate_js", 11), ("qml.binding_cycle", 7), ("qml.binding_cycle", 12),
    }
    assert [r["id"] for r in findings.semantic_findings(p).where("kind = 'qml.binding_cycle'").orderBy("id").collect()] == ["qml.binding_cycle.Main.qml.12.12.12", "qml.binding_cycle.Main.qml.7"]


def test_no_cycle_through_an_alias(spark):
    p = project(spark, {"A.qml": "Item { id: root\n property alias text: label.text\n visible: true\n Text { id: label; text: root.visible ? 'a' : 'b' } }"})
    assert graph.cycles(graph.binding_edges(p)).count() == 0


def test_cycles_of_deep_graphs():
    chain = [(str(i), str(i + 1)) for i in range(5000)] + [("5000", "0")]
    assert len(graph.cycles_of(chain)[0]) == 5001
    assert graph.cycles_of([("a", "b"), ("b", "c")]) == [] and graph.cycles_of([("a", "a")]) == [["a"]]


def test_clones(spark):
    body = "\n".join(f"    Rectangle {{ width: {i}; color: \"#fff00{i % 10}\"; name{i}: 'x' }}" for i in range(12))
    p = project(spark, {"a.qml": f"Item {{\n{body}\n}}", "b.qml": f"Column {{\n{body}\n}}", "c.qml": "Item {}"}, thresholds=conf.THRESHOLDS | {"cloneWindow": 4})
    g = p.clones.collect()
    assert len(g) == 1 and g[0]["lines"] >= 12 and {i["file"] for i in g[0]["instances"]} == {"a.qml", "b.qml"}
    shapes = clones.structural_clones(p.objects, p.bindings).collect()
    assert shapes and all(len({i["file"] for i in s["instances"]}) > 1 for s in shapes)
    assert {r["file"]: r["pressure"] for r in clones.duplication_pressure(p.clones).collect()} == {"a.qml": "low", "b.qml": "low"}


def test_boundary_suppressions_and_stale(spark):
    rules = [{"kind": "boundary.process_calls_in_qml", "file": "a.qml", "reason": "known"}, {"id": "nothing"}]
    p = project(spark, {"a.qml": "Item { Process {} MyPostProcess {} Q.Process {} }", "service/b.qml": "Item { Process {} }", "c.qml": "import Quickshell.Io\nItem { Process {}\n x: exec('a') }"}, suppressions=rules)
    got = {(r["kind"], r["file"], r["suppressed"], r["reason"]) for r in p.findings.where("kind like 'boundary%' or kind like 'suppression%'").collect()}
    assert got == {("boundary.process_calls_in_qml", "a.qml", True, "known"), ("boundary.process_calls_in_qml", "c.qml", False, None), ("suppression.stale", None, False, None)}
    assert p.components.where("file = 'a.qml'").first()["process_boundary_calls"] == 2
    health = kinds(findings.health_findings(p))
    assert {("qml.side_effect_in_binding", "c.qml"), ("quickshell.process_placement", "c.qml")} <= health
    s = findings.summary(p.findings).first()
    assert s["findings"] == s["active"] + s["suppressed"] and s["by_kind"]["suppression.stale"] == 1


def test_empty_input(spark):
    p = project(spark, {"a.js": "let x = 1"})
    assert kinds(p.findings) == {("input.no_qml_files", None)} and p.scores.first()["overall"] == 0


def test_lint_reports(spark):
    data = {"issues": [{"path": "file:///p/a.qml", "row": "3", "col": 2, "type": "FATAL", "text": "bad", "code": "r"}, {"file": "b.qml", "message": "m"}, {"message": "none"}, 5]}
    got = [tuple(r) for r in lint.from_json(spark.createDataFrame([(json.dumps(data),), ("{oops",)], "value string"), root="/p").collect()]
    assert got == [("a.qml", 3, 2, "error", "bad", "r"), ("b.qml", 1, None, "warning", "m", None)]
    text = ["warning: a.qml:3:4: Message [rule-x]", "b.qml:7: error: Broken", "c.qml:1: plain", "nothing here"]
    got = [tuple(r) for r in lint.from_text(spark.createDataFrame([(t,) for t in text], "value string")).collect()]
    assert got == [("a.qml", 3, 4, "warning", "Message [rule-x]", "rule-x"), ("b.qml", 7, None, "error", "Broken", None), ("c.qml", 1, None, "warning", "plain", None)]


def test_config(tmp_path):
    (tmp_path / "c.json").write_text('{ // note\n "project_name": "x // y", /* z */ "thresholds": {"cloneWindow": 3}, "suppressions": [{"kind": "k"}]}')
    c = conf.load(str(tmp_path / "c.json"))
    assert c.project_name == "x // y" and c.thresholds["cloneWindow"] == 3 and c.thresholds["fileSlocHigh"] == 250 and c.source_roots == [str(tmp_path)]
    with pytest.raises(conf.ConfigError) as e:
        conf.validate({"nope": 1, "thresholds": {"cloneWindow": 1, "x": 2}, "suppressions": [{}], "process_boundary": {"textPatterns": ["["]}, "exclude": [1]})
    assert len(str(e.value).split("; ")) == 6


def test_discovery_and_tasks(spark, tmp_path):
    (tmp_path / "ui" / "node_modules").mkdir(parents=True)
    (tmp_path / "ui" / "Main.qml").write_text(MAIN)
    (tmp_path / "ui" / "node_modules" / "X.qml").write_text("Item {}")
    (tmp_path / "ui" / "tst_Main.qml").write_text("TestCase { function test_a() {}\n function benchmark_b() {} }")
    (tmp_path / "ui" / "Contest.qml").write_text("Item {}")
    (tmp_path / "ui" / "m.mjs").write_text("x")
    (tmp_path / "loop").symlink_to(tmp_path / "ui")
    (tmp_path / "vellum.config.json").write_text("{}")
    c = conf.load(str(tmp_path / "vellum.config.json"))
    rows = files.discover(spark, c)
    assert rows.count() == 3
    p = Project(rows, c)
    made = tasks.measure(p, "all")
    assert made["correctness.catalog"]["summary"] == {"test_files": 1, "test_cases": 2, "status": "discovered"}
    assert len(made) == 12 and len(list((tmp_path / "target" / "vellum").iterdir())) == 13
    head, body = tasks.locality(p, None)
    assert head["records"] == 3 and len(body["records"]) == 3 and tasks.report(made["correctness.catalog"])
    assert tasks.order("quality.cleanup")[-1] == "quality.cleanup" and len(tasks.order("quality.cleanup")) == 3


def test_audit_against_a_base(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    (tmp_path / "Main.qml").write_text("Item {\n  Old {}\n}\n")
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "Main.qml").write_text("Item {\n  Old {}\n  Fresh {}\n}\n")
    (tmp_path / "c.json").write_text("{}")
    c = conf.load(str(tmp_path / "c.json"))
    p = Project(files.discover(spark, c), c)
    found = audit.run(spark, c, p, base="HEAD")
    assert found["verdict"] == "warn" and found["base_comparison"] == "available" and found["changed_hunks"] == 1
    assert {r["id"]: (r["introduced"], r["in_changed_hunk"], r["present_in_base"]) for r in found["rows"].collect()} == {"resolution.unknown_type.Main.qml.2.Old": (False, False, True), "resolution.unknown_type.Main.qml.3.Fresh": (True, True, False)}
    audit.save_baseline(str(tmp_path / "b.json"), p.findings)
    again = audit.run(spark, c, p, baseline=str(tmp_path / "b.json"))
    assert again["verdict"] == "pass" and again["base_comparison"] == "disabled" and not again["rows"].where("introduced").count()


def test_parse_as_a_stream(spark, tmp_path):
    from vellum.streaming.sources import parsed_stream

    spark.createDataFrame([("A.qml", "qml", MAIN)], "path string, kind string, text string").write.parquet(str(tmp_path / "in"))
    q = parsed_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("parsed").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("parsed").select(F.size("objects")).first()[0] == 2


def test_precision_recall(spark):
    t = lambda rows: spark.createDataFrame(rows, "kind string, file string")
    got = scores.precision_recall(t([("k", "a"), ("k", "n")]), t([("k", "a"), ("k", "b"), ("j", "a")]), t([("k", "n")])).collect()
    assert {r["kind"]: (r["precision"], r["recall"]) for r in got} == {"k": (0.5, 0.5), "j": (1.0, 0.0)}


def test_without_the_operators_of_the_pipeline(tmp_path):
    import os
    import shutil
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    for name in ("vellum", "__spark_entry__.py"):
        (shutil.copytree if (root / name).is_dir() else shutil.copy)(root / name, tmp_path / name)
    for name in ("corpus_pipeline.py",):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path / name)
    shutil.rmtree(tmp_path / "vellum" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'hotspots' in q, any(k.startswith('op1') or k == 'pipeline' for k in q))"
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    n, base, llm = got.stdout.split()
    assert int(n) > 20 and base == "True" and llm == "False", got.stderr


def test_suppressions_by_every_combination_of_fields(spark):
    rows = [(i, k, f) for i in "ab" for k in "kl" for f in ("x", "y", None)]
    df = spark.createDataFrame([(*r, "low") for r in rows], "id string, kind string, file string, severity string")
    rules = [(0, "b", "l", "y", "all"), (1, None, "k", "x", "kind and file"), (2, "a", "", None, "id"), (3, None, None, "y", "file"), (4, "b", "k", None, "id and kind"), (5, "b", None, "x", "id and file"), (6, None, "m", None, "none"), (7, "zz", None, "x", "none")]
    table = spark.createDataFrame(rules, "idx int, s_id string, s_kind string, s_file string, reason string")

    def hit(rule, row):
        return all(not want or want == is_ for want, is_ in zip(rule[1:4], row, strict=True))

    got = {(r["id"], r["kind"], r["file"]): (r["suppressed"], r["reason"]) for r in findings.suppress(df, table).collect()}
    want = {row: next(((True, r[4]) for r in rules if hit(r, row)), (False, None)) for row in rows}
    assert got == want
    assert sorted(r["idx"] for r in findings.stale(df, table).collect()) == [6, 7]
    every = spark.createDataFrame([(0, None, None, None, "everything")], table.schema)
    assert all(r["reason"] == "everything" for r in findings.suppress(df, every).collect()) and findings.stale(df, every).count() == 0


def test_parse_empty(spark):
    assert parse(spark.createDataFrame([], "path string, kind string, text string")).count() == 0


def test_numbers_of_a_file_are_those_of_column_functions(spark):
    """Metrics, shapes and edges that are read with a file, against expressions over text and tables."""
    text = 'Item {\n  id: root // c\n   \n  /* a\n b */ property int q: 1\n  width: a && b ? c.d.e.f : 2\n  Row { id: idle; anchors.left: q; x: root.q . z }\n  Row { id: used; Layout.fillWidth: true }\n  function f() { if (used) { return 1 } else if (b) { for (;;) {} } }\n  onDone: { let q = 1; root.q = 2; q = 3; used.x = Qt.binding(f); width == 3; y.width = 1; Keys.width = 2 }\n}'
    p = project(spark, {"d/A.qml": text, "d/B.qml": text, "e/B.qml": text, "f.js": "function one(a) { return a ? 1 : 2 }"})
    loc = p.parsed.select("kind", X.line_counts(F.col("text"), F.col("code")).alias("want"), F.col("measures.loc").alias("got")).collect()
    assert all(r["want"] == r["got"] for r in loc) and len(loc) == 4
    fold = F.aggregate(F.transform("executables", lambda e: X.nesting(e["code"])["cognitive"]), F.lit(0), lambda a, x: a + x)
    most = F.array_max(F.transform("executables", lambda e: X.cyclomatic(e["code"])))
    paths = F.aggregate("bindings", F.lit(0), lambda a, b: a + X.binding_complexity(b["code"]))
    for r in p.parsed.select("measures", fold.alias("cog"), most.alias("cyc"), paths.alias("sum")).collect():
        assert (r["measures"]["cognitive"], r["measures"]["max_cyclomatic"], r["measures"]["binding_sum"]) == (r["cog"], r["cyc"], r["sum"])
    found = findings.semantic_findings(p, ["qml.binding_loss", "qml.layout_conflict.anchors_with_geometry"])
    assert sorted((r["file"], r["id"].rpartition(".qml.")[2]) for r in found.collect()) == [(f, i) for f in ("d/A.qml", "d/B.qml", "e/B.qml") for i in ("10.root.q", "10.self.q", "7")]
    assert sorted(r["id"] for r in findings.cleanup_findings(p, ["cleanup.unused_id"]).collect()) == [f"cleanup.unused_id.{f}.idle" for f in ("d/A.qml", "d/B.qml", "e/B.qml")]
    assert {(r["src"], r["dst"]) for r in graph.binding_edges(p).where("file = 'd/A.qml'").collect()} == {("2:x", "1:q")}


def test_kinds_asked_for_make_no_other_tables(spark):
    p = project(spark, {"A.qml": MAIN})
    assert findings.semantic_findings(p, ["qml.binding_loss"]).count() == 0 and findings.cleanup_findings(p, ["cleanup.unused_id"]).count() == 0
    assert "resolution" not in p.__dict__ and "components" not in p.__dict__ and len(p._held) == 1
    plan = findings.semantic_findings(p, ["qml.layout_conflict.anchors_with_geometry"])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_clones_have_all_places_and_scores_all_groups(spark):
    """30 files that share seven lines, of which two share an eighth; and 101 pairs of other files."""
    body = "\n".join(f"  property string name{c}: 'x'" for c in "abcdefg")
    sources = {f"d/F{i:02}.qml": f"// {i}\nItem{i} {{\n{body}\n" + ("  width: height\n" if i < 2 else f"  other{i}z: a\n") + "}" for i in range(30)}
    for i in range(101):
        name = chr(97 + i % 26) + chr(97 + i // 26)
        sources |= {f"e/{k}{name}.qml": "\n".join(f"long_enough_{name}_{c}: {k if c == 'g' else 1}{k}" for c in "abcdef") + f"\n{k}{name}q" for k in "ab"}
        sources[f"e/b{name}.qml"] = sources[f"e/a{name}.qml"]
    p = project(spark, sources)
    g = {r["lines"]: r for r in p.clones.where("lines = 7 and size(instances) > 2").collect()}
    assert [r["file"] for r in g[7]["instances"]] == [f"d/F{i:02}.qml" for i in range(30)] and g[7]["instances"][0]["start"] == 3
    assert g[7]["sample"] == body.split("\n")
    assert p.clones.where("lines = 9").first()["instances"][1]["file"] == "d/F01.qml"
    assert p.clones.count() == 100 and p.clone_places.select("content").distinct().count() == 103


def test_clone_places_by_brute_force(spark):
    """Random files with blank lines and repeats, against the extension of each window by hand."""
    pick, size = random.Random(3), 3
    words = ["alpha_alpha_alpha", "beta_beta_beta_beta", "gamma_gamma_gamma", ""]
    texts = {f"f{n}": [pick.choice(words) for _ in range(pick.randint(0, 25))] for n in range(16)}
    texts["copy"] = texts["f0"] = texts["f0"] + words * 2
    windows = {}
    for f, x in texts.items():
        for i in range(len(x) - size + 1):
            own = x[i : i + size]
            if sum(map(bool, own)) >= size - 1 and len("\n".join(own)) >= 40:
                windows.setdefault(tuple(own), []).append((f, i))
    want = set()
    for places in windows.values():
        if len({f for f, _ in places}) > 1:
            same = lambda d, places=places: len(v := {texts[f][i + d] if 0 <= i + d < len(texts[f]) else "" for f, i in places}) == 1 and "" not in v
            back = next(n for n in range(99) if not same(-n - 1))
            ahead = next(n for n in range(99) if not same(size + n))
            f, i = places[0]
            want |= {("\n".join(texts[f][i - back : i + size + ahead]), g, j - back + 1, j + size + ahead) for g, j in places}
    got = clones.clone_places(spark.createDataFrame([(f, "\n".join(x)) for f, x in texts.items()], "path string, code string"), size).collect()
    content = lambda r: "\n".join(texts[r["file"]][r["start"] - 1 : r["end"]])
    assert len(got) == len(want) > 50 and {(content(r), r["file"], r["start"], r["end"]) for r in got} == want


def test_edges_make_no_nodes(spark):
    p = project(spark, {"m/qmldir": "module m\nB 1.0 B.qml", "m/B.qml": "Item {}", "A.qml": "import m\nimport no.such\nItem { B {} }", "d/C.qml": "import m\nItem {}"})
    rows = {tuple(r)[:3] for r in graph.architecture_edges(p).collect()}
    assert rows == {("A.qml", "m/B.qml", "component_use"), ("A.qml", "m/qmldir", "local_import"), ("A.qml", "no.such", "unresolved_import"), ("d/C.qml", "m/qmldir", "local_import")}
    assert "components" not in p.__dict__
