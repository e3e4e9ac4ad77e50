"""Measure tasks: each a summary and records of one project, written as one JSON artifact."""

from __future__ import annotations

import datetime
import json
import os
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.project import Project
from . import clones, findings, graph, scores


def _rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def confidence(project: Project, lint: dict | None = None) -> dict:
    r = project.resolution
    diagnostics = project.diagnostics.count()
    imports, types = r.imports.where("kind = 'unresolved'").count(), r.uses.where("unresolved").count()
    kinds = {x["kind"]: x["count"] for x in project.parsed.groupBy("kind").count().collect()}
    missing = [p for p in project.config.source_roots if project.config.path and not os.path.exists(p)]
    partial = bool(diagnostics or imports or types or missing or not kinds.get("qml"))
    sample = project.diagnostics.orderBy(F.collate("file", "UNICODE"), "ord").limit(20)
    return {"complete": not partial, "partial": partial, "observed_inputs": ["qml_files", "js_files", "project_resolution", *(["qmldir"] if kinds.get("qmldir") else [])], "qml_files": kinds.get("qml", 0), "missing_source_roots": missing, "unresolved_imports": imports, "unresolved_types": types, "unsupported_pattern": _rows(sample), "lint": lint or {"source": "none"}}


def quality(p: Project, lint) -> tuple[dict, dict]:
    files, score = p.files.select("kind", "loc.source"), p.scores.first().asDict()
    head = files.agg(F.count("*").alias("files"), F.count_if(F.col("kind") == "qml").alias("qmlFiles"), F.count_if(F.col("kind") == "js").alias("jsFiles"), F.sum("source").alias("sourceLines")).first().asDict()
    counts = {"components": p.components, "functions": p.functions, "bindings": p.bindings, "cloneGroups": p.clones, "parserDiagnostics": p.diagnostics, "findings": p.findings.where("not suppressed")}
    records = {"files": p.files.drop("place"), "components": p.components.drop("place"), "functions": p.functions, "bindings": p.bindings.drop("refs", "code"), "parserDiagnostics": p.diagnostics}
    return head | {k: v.count() for k, v in counts.items()} | {"score": score["overall"]}, {"scores": score, "records": {k: _rows(v) for k, v in records.items()}, "clones": _rows(p.clones), "findings": _rows(p.findings)}


def hotspots(p: Project, lint) -> tuple[dict, dict]:
    rows = _rows(scores.hotspots(p))
    return {"hotspots": len(rows), "highest_score": rows[0]["score"] if rows else 0, "high_risk": sum(r["score"] >= 100 for r in rows)}, {"records": rows}


def clone_task(p: Project, lint) -> tuple[dict, dict]:
    shapes = clones.structural_clones(p.objects, p.bindings)
    every = p.clones.drop("rank").unionByName(shapes)
    pressure = _rows(clones.duplication_pressure(every).orderBy(F.desc("repeated_lines"), "file"))
    a, b = p.clones.count(), shapes.count()
    return {"groups": a + b, "normalized_line_groups": a, "qml_structural_groups": b, "files_with_duplication": len(pressure)}, {"groups": _rows(every), "duplication_pressure": pressure}


def resolution(p: Project, lint) -> tuple[dict, dict]:
    r = p.resolution
    comps = p.components.select("name", "file").join(r.public_files.withColumn("public", F.lit(True)), "file", "left").join(r.referenced.withColumn("referenced", F.lit(True)), "file", "left").fillna(False)
    tables = {"components": comps, "ambiguous_component_names": r.names.where("size(files) > 1"), "qmldir_modules": p.parsed.where("kind = 'qmldir'").select(F.col("path").alias("file"), "module", "entries"), "imports": r.imports, "component_uses": r.uses, "unresolved_imports": r.imports.where("kind = 'unresolved'"), "unresolved_types": r.uses.where("unresolved")}
    rows = {k: _rows(v) for k, v in tables.items()}
    return {"ambiguous_component_names": len(rows["ambiguous_component_names"]), "public_files": r.public_files.count()} | {k: len(v) for k, v in rows.items() if k != "ambiguous_component_names"}, rows


def _found(df: DataFrame) -> tuple[dict, dict]:
    return _rows(findings.summary(df))[0], {"findings": _rows(df)}


def lint_task(p: Project, lint) -> tuple[dict, dict]:
    rows, about = lint if lint else (None, {"source": "none"})
    if rows is None:
        return about | {"findings": 0, "errors": 0, "warnings": 0, "info": 0}, {"diagnostics": [], "findings": []}
    head, body = _found(findings.suppress(findings.lint_findings(rows), findings._suppressions(p)))
    return about | head | {"errors": head["high"], "warnings": head["medium"], "info": head["low"]}, body | {"diagnostics": _rows(rows)}


def semantic(p: Project, lint) -> tuple[dict, dict]:
    return _found(findings.suppress(findings.semantic_findings(p), findings._suppressions(p)))


def health(p: Project, lint) -> tuple[dict, dict]:
    head, body = _found(findings.health_findings(p, lint[0] if lint else None))
    return head | {"components": p.components.count(), "qmllint_findings": lint[0].count() if lint else 0}, body


def locality(p: Project, lint) -> tuple[dict, dict]:
    rows = _rows(scores.locality(p))
    return {"records": len(rows), "low_locality": sum(r["locality_score"] < 50 for r in rows)}, {"records": rows}


def leverage(p: Project, lint) -> tuple[dict, dict]:
    rows = _rows(scores.leverage(p))
    return {"records": len(rows)} | {k: sum(r["classification"] == k for r in rows) for k in ("high_leverage", "central_risky")}, {"records": rows}


def cleanup(p: Project, lint) -> tuple[dict, dict]:
    head, body = _found(findings.cleanup_findings(p))
    kinds = head.get("by_kind") or {}
    return {k: head[k] for k in ("findings", "active", "suppressed")} | {"unused_components": kinds.get("cleanup.unused_component", 0), "unused_ids": kinds.get("cleanup.unused_id", 0)}, body


def correctness(p: Project, lint) -> tuple[dict, dict]:
    tests = _rows(scores.test_catalog(p.parsed))
    none = [] if tests else [{"id": "correctness.no_qml_tests", "kind": "correctness.no_qml_tests", "severity": "medium", "message": "There are no tests", "actions": ["Test the components that matter."]}]
    return {"test_files": len(tests), "test_cases": sum(len(t["test_cases"]) for t in tests), "status": "discovered" if tests else "missing"}, {"tests": tests, "findings": none}


def architecture(p: Project, lint) -> tuple[dict, dict]:
    nodes, edges = map(_rows, graph.architecture(p))
    return {"nodes": len(nodes), "edges": len(edges), "entrypoints": sum(n["entrypoint"] for n in nodes), "high_risk_nodes": sum(n["risk"] == "high" for n in nodes)}, {"graph": {"nodes": nodes, "edges": edges}}


#: task: (artifact, function, tasks before it)
TASKS = {
    "quality.qml": ("qml_quality_report", quality, ()),
    "quality.hotspots": ("hotspots", hotspots, ("quality.qml",)),
    "quality.clones": ("clones", clone_task, ("quality.qml",)),
    "map.resolution": ("resolution", resolution, ("quality.qml",)),
    "quality.qmllint": ("qmllint", lint_task, ()),
    "quality.semantic_rules": ("semantic_rules", semantic, ("map.resolution",)),
    "quality.qml_health": ("qml_health", health, ("quality.qml", "quality.qmllint", "quality.semantic_rules")),
    "quality.locality_dynamic": ("locality_metrics", locality, ("quality.qml", "map.resolution")),
    "quality.locality_leverage": ("leverage_metrics", leverage, ("quality.qml", "map.resolution")),
    "quality.cleanup": ("cleanup", cleanup, ("quality.qml", "map.resolution")),
    "correctness.catalog": ("correctness_review", correctness, ()),
    "map.architecture": ("map", architecture, ("quality.qml", "map.resolution")),
}


def order(task: str | None = None) -> list[str]:
    """All tasks, or one behind those it needs."""
    if task in (None, "all"):
        return list(TASKS)
    if task not in TASKS:
        raise KeyError(f"no task {task}")
    need, todo = {}, [task]
    while todo:
        t = todo.pop()
        need[t] = TASKS[t][2]
        todo += [x for x in need[t] if x not in need]
    return list(TopologicalSorter(need).static_order())


def artifact(project: Project, task: str, lint=None, command: str = "") -> dict:
    head, body = TASKS[task][1](project, lint)
    config = project.config
    about = {"generated_at": datetime.datetime.now(datetime.UTC).isoformat(), "command": command, "config_path": config.path, "project_root": config.project_root, "engine": "vellum", "engine_version": "0.1.0"}
    return {"schema_version": "0.1.0", "task_id": task, "project": {"name": config.project_name, "root": config.project_root}, "provenance": about, "confidence": confidence(project, lint[1] if lint else None), "summary": head} | body


def write(config, name: str, content: dict) -> str:
    os.makedirs(config.output_dir, exist_ok=True)
    path = os.path.join(config.output_dir, f"{name}.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(content, f, indent=2)
        f.write("\n")
    return path


def measure(project: Project, task: str | None = None, lint=None, command: str = "") -> dict[str, dict]:
    out = {}
    for t in order(task):
        out[t] = artifact(project, t, lint, command)
        write(project.config, TASKS[t][0], out[t])
        if t == "correctness.catalog":
            write(project.config, "test_catalog", {"schema_version": "0.1.0", "project": out[t]["project"], "tests": out[t]["tests"]})
    return out


def report(a: dict, markdown: bool = False) -> str:
    """Summary, the top findings, and the components of most effort."""
    mark = "## " if markdown else ""
    lines = [f"{mark}{a['task_id']}: {a['project']['name']}", *(f"- {k}: {v}" for k, v in a["summary"].items())]
    rank = {"high": 0, "medium": 1, "low": 2}
    found = [f for f in a.get("findings", []) if not f.get("suppressed")]
    found.sort(key=lambda f: (rank.get(f["severity"], 2), -(f.get("metric", 0) - f.get("threshold", 0)), f.get("file", ""), f.get("line", 0)))
    if found:
        lines.append(f"{mark}Findings")
        lines += [f"- {f['severity']} {':'.join(str(f[k]) for k in ('file', 'line') if f.get(k))} {f['kind']}: {f['message']}" for f in found[:8]]
    comps = sorted(a.get("records", {}).get("components", []) if isinstance(a.get("records"), dict) else [], key=lambda c: -c["effort"])
    if comps:
        lines.append(f"{mark}Effort")
        lines += [f"- {c['file']}: {c['effort']}" for c in comps[:10]]
    return "\n".join(lines) + "\n"
