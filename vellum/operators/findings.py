"""Rules as filters and projections to one table of findings; suppressions; summaries.

Findings: id, kind, severity, file, line, message, metric, threshold, action, ord. Kinds, ids, lines, severities and metrics
are those of the SURVEY; the wording of messages and advice is ours.
"""

from __future__ import annotations

from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph import binding_edges, cycles

SCHEMA = "id string, kind string, severity string, file string, line int, message string, metric double, threshold double, action string"


def finding(df: DataFrame, kind: str, severity: str | Column, id_: list, message: Column | str, action: str, file: str | None = "file", line: Column | str | None = "line", metric=None, threshold=None) -> DataFrame:
    """id_: strings that name columns, or columns; joined by dots."""
    text = lambda x: (F.col(x) if isinstance(x, str) else x).cast("string")
    value = lambda x, t: (F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)).cast(t)
    return df.select(
        F.concat_ws(".", *map(text, id_)).alias("id"), F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        value(file if file else F.lit(None), "string").alias("file"), value(line if line is not None else F.lit(None), "int").alias("line"),
        (F.lit(message) if isinstance(message, str) else message).alias("message"), value(metric, "double").alias("metric"), value(threshold, "double").alias("threshold"), F.lit(action).alias("action"),
    )


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def input_findings(project) -> DataFrame:
    spark, config = project.spark, project.config
    rows = []
    for top in config.source_roots:
        if config.path and not Path(top).exists():
            import os

            rows.append((f"input.missing_source_root.{os.path.relpath(top, config.project_root)}", "input.missing_source_root", "high", None, None, f"There is no source root {top}", None, None, "Create the folder or correct source_roots."))
    none = finding(project.parsed.agg(F.count_if(F.col("kind") == "qml").alias("n")).where("n = 0"), "input.no_qml_files", "high", [F.lit("input"), F.lit("no_qml_files")], "No file of the main kind was found, so a score means nothing", "Look at project_root, source_roots and exclude.", None, None)
    return spark.createDataFrame(rows, SCHEMA).union(none) if rows else none


def derived_findings(project) -> DataFrame:
    t = project.config.thresholds
    comps, fns = project.components, project.functions
    size = project.files.select(F.col("path").alias("file"), "loc.source").where(F.col("source") > t["fileSlocHigh"])
    rate = F.when(F.col("cognitive") > t["functionCognitiveHigh"] * 1.5, "high").otherwise("medium")
    hard = fns.where((F.col("cyclomatic") > t["functionCyclomaticHigh"]) | (F.col("cognitive") > t["functionCognitiveHigh"]) | (F.col("lines") > t["handlerLinesHigh"]))
    spots = project.clones.where("rank <= 20")
    r = project.resolution
    return _all([
        finding(size, "size.file_sloc", "medium", [F.lit("size"), "file"], F.concat_ws(" ", F.col("source"), F.lit("source lines")), "Divide the file by what its parts show or do.", line=None, metric="source", threshold=t["fileSlocHigh"]),
        finding(project.diagnostics, "parser.diagnostic", "medium", [F.lit("parser"), "file", "line", "message"], F.col("message"), "Look at the source here: numbers for this file may be off."),
        finding(comps.where(F.col("object_count") > t["componentObjectCountHigh"]), "component.large_object_tree", "medium", [F.lit("component.large"), "file"], F.concat_ws(" ", F.lit("Objects:"), "object_count"), "Give repeated or stateful parts components of their own.", metric="object_count", threshold=t["componentObjectCountHigh"]),
        finding(comps.where("distinct_id_references >= 8"), "locality.id_coupling", "medium", [F.lit("locality.id_coupling"), "file"], F.concat_ws(" ", F.lit("Foreign ids:"), "distinct_id_references"), "Pass values by properties and signals.", metric="distinct_id_references", threshold=8),
        finding(comps.where("hardcoded_colors >= 4"), "styling.hardcoded_colors", "low", [F.lit("styling.colors"), "file"], F.concat_ws(" ", F.lit("Literal colours:"), "hardcoded_colors"), "Name the colours in a theme.", line=None, metric="hardcoded_colors", threshold=4),
        finding(comps.where("process_boundary_violations > 0"), "boundary.process_calls_in_qml", "high", [F.lit("boundary.process"), "file"], F.concat_ws(" ", F.lit("Process calls:"), "process_boundary_violations"), "Keep processes and protocols in one boundary module.", line=None, metric="process_boundary_violations", threshold=0),
        finding(hard, "complexity.function", rate, [F.lit("complexity"), "file", "line", "name"], F.format_string("%s: cyclomatic %d, cognitive %d, %d lines", "name", "cyclomatic", "cognitive", "lines"), "Name the decisions and keep side effects apart.", metric=F.greatest("cyclomatic", "cognitive", "lines")),
        finding(project.bindings.where(F.col("complexity") > t["bindingComplexityHigh"]), "complexity.binding", "low", [F.lit("binding"), "file", "line", "path"], F.concat_ws(" ", F.col("path"), F.lit("is of complexity"), "complexity"), "Use a named readonly property or a function.", metric="complexity", threshold=t["bindingComplexityHigh"]),
        finding(spots.withColumn("i", F.col("instances")[0]), "duplication.normalized_clone", "low", [F.lit("duplication"), "id"], F.concat_ws(" ", "lines", F.lit("lines again in"), F.size(F.array_distinct(F.transform("instances", lambda x: x["file"]))), F.lit("files")), "Share a component, a style name or a helper.", file="i.file", line="i.start", metric=F.size("instances")),
        finding(r.imports.where("kind = 'unresolved'"), "resolution.unresolved_import", "medium", [F.lit("resolution.unresolved_import"), "file", "line", "module"], F.concat_ws(" ", F.lit("Nothing known under"), "module"), "Correct the import, add a qmldir, or list the module as external."),
        finding(r.uses.where("unresolved"), "resolution.unknown_type", "medium", [F.lit("resolution.unknown_type"), "file", "line", "type"], F.concat_ws(" ", F.lit("Unknown type"), "type"), "Add or import the component, or list the type as external."),
    ])


def _ids(project) -> DataFrame:
    return project.objects.where("id_name is not null").groupBy("file", F.col("id_name").alias("by")).agg(F.max_by(F.struct("object_id", "type", "line"), "ord").alias("o")).select("file", "by", F.col("o.object_id").alias("target"), F.col("o.type").alias("type"), F.col("o.line").alias("at"))


def _lost(project) -> DataFrame:
    """Assignments that break a binding."""
    return finding(project._rows("losses"), "qml.binding_loss", "high", [F.lit("qml.binding_loss"), "file", "line", F.coalesce("by", F.lit("self")), "prop"], F.concat_ws(" ", F.lit("An assignment ends the binding of"), "prop"), "Keep the changing value in another property, or assign Qt.binding().")


def _rings(project) -> DataFrame:
    lines = project.bindings.where(~X.is_handler(F.col("path"))).groupBy("file", F.concat_ws(":", F.col("owner").cast("string"), "path").alias("node")).agg(F.max_by("line", "ord").alias("line"))
    ring = cycles(binding_edges(project), together=True).withColumn("n", F.col("nodes")[0])
    ring = ring.select("file", "n", F.explode("nodes").alias("node")).join(lines, ["file", "node"], "left")
    ring = ring.groupBy("file", "n").agg(F.array_sort(F.collect_list(F.coalesce("line", F.lit(1)))).alias("lines"), F.array_sort(F.collect_list(F.regexp_replace("node", "^[0-9]+:", ""))).alias("labels"))
    return finding(ring, "qml.binding_cycle", "high", [F.lit("qml.binding_cycle"), "file", F.concat_ws(".", F.transform("lines", lambda x: x.cast("string")))], F.concat(F.lit("Bindings depend on each other: "), F.concat_ws(", ", "labels")), "Let values flow one way from a single source.", line=F.col("lines")[0])


def _unused_members(project) -> tuple[DataFrame, DataFrame]:
    """Public properties and signals that nobody uses."""
    b, o = project.bindings, project.objects
    targets = project.resolution.uses.where("target is not null").select("file", "object_id", "target")
    foreign = targets.where("target <> file")
    leaf = X.leaf(F.col("path"))
    used = b.withColumnRenamed("owner", "object_id").join(foreign, ["file", "object_id"]).select(F.col("target").alias("file"), F.when(X.is_handler(F.col("path")), X.signal_of(F.col("path"))).otherwise(leaf).alias("name"))
    root = o.where("object_id = 1").select("file", F.col("id_name").alias("root_id"))
    reads = b.where("owner <> 1").join(root.where("root_id is not null"), "file").select("file", "root_id", F.explode(F.arrays_zip(X.matches(F.col("expression"), r"\b([A-Za-z_$][A-Za-z0-9_$]*)(?=\.([A-Za-z0-9_$.]+))", 1).alias("i"), X.matches(F.col("expression"), r"\b([A-Za-z_$][A-Za-z0-9_$]*)(?=\.([A-Za-z0-9_$.]+))", 2).alias("p"))).alias("z")).where("z.i = root_id").select("file", F.explode(F.array(F.col("z.p"), F.substring_index("z.p", ".", 1))).alias("name"))
    calls = b.select("file", F.explode(F.array_distinct(X.matches(F.col("expression"), r"\b([A-Za-z_$][A-Za-z0-9_$]*)\s*\(", 1))).alias("name"))
    open_files = project.resolution.public_files.join(foreign.select(F.col("target").alias("file")).distinct(), "file", "left_semi")
    props = project.properties.where("owner = 1 and not alias").join(open_files, "file", "left_semi").join(used.union(reads), ["file", "name"], "left_anti")
    sigs = project.signals.where("owner = 1").join(open_files, "file", "left_semi").join(used.union(calls), ["file", "name"], "left_anti")
    return (
        finding(props, "cleanup.unused_public_property", "low", [F.lit("cleanup.unused_public_property"), "file", "name"], F.concat_ws(" ", F.lit("Property without a user:"), "name"), "Remove it, hide it, or use it."),
        finding(sigs, "cleanup.unused_public_signal", "low", [F.lit("cleanup.unused_public_signal"), "file", "name"], F.concat_ws(" ", F.lit("Signal without a user:"), "name"), "Remove it or handle it."),
    )


def _mismatches(project) -> DataFrame:
    """Handlers of Connections whose target has no such signal."""
    b, o, ids = project.bindings, project.objects, _ids(project)
    conn = o.where(X.leaf(F.col("type")) == "Connections").select("file", "object_id")
    aim = b.where("path = 'target'").groupBy("file", F.col("owner").alias("object_id")).agg(F.min_by(X.trimmed(F.col("expression")), "ord").alias("by"))
    aimed = conn.join(aim, ["file", "object_id"]).join(ids, ["file", "by"])
    kinds = project.resolution.uses.where("target is not null").groupBy("file", "type").agg(F.first("target").alias("source"))
    aimed = aimed.join(kinds, ["file", "type"]).select("file", "object_id", "source", "type")
    root_signals = project.signals.where("owner = 1").select(F.col("file").alias("source"), F.col("name").alias("signal"))
    aimed = aimed.join(root_signals.select("source").distinct(), "source", "left_semi")
    handlers = project._rows("executables").where("(kind = 'signal_handler' or name rlike '^on[A-Z]') and owner is not null").select("file", F.col("owner").alias("object_id"), "name", "line")
    wrong = aimed.join(handlers, ["file", "object_id"]).withColumn("signal", F.when(X.is_handler(F.col("name")), X.signal_of(F.col("name")))).where("signal is not null").join(root_signals, ["source", "signal"], "left_anti")
    return finding(wrong, "qml.connection_signal_mismatch", "medium", [F.lit("qml.connection_mismatch"), "file", "line", "name"], F.concat_ws(" ", "type", F.lit("has no signal for"), "name"), "Correct the handler or declare the signal.")


_CONFLICT = "qml.layout_conflict.anchors_with_"
#: Kinds that the shape of an object gives: (condition, severity, name in ids, whether the type begins the message, message, advice).
_SHAPES = {
    _CONFLICT + "layout": ("anchors and layout", "medium", "qml.layout_conflict.anchors_layout", True, "has anchors and layout properties", "Place the item by one of both."),
    _CONFLICT + "geometry": ("anchors and geometry", "medium", "qml.layout_conflict.anchors_geometry", True, "has anchors and a fixed place or size", "Leave out what the anchors decide."),
    "qml.performance.loader_without_active": ("base = 'Loader' and not active", "low", "qml.performance.loader_active", False, "A Loader doesn't say when it is active", "Bind active where loading can wait."),
    "qml.performance.image_without_source_size": ("base = 'Image' and not source_size", "low", "qml.performance.image_source_size", False, "An Image is decoded in its full size", "Bind the source size."),
    "qml.performance_complex_delegate_js": ("base like '%Delegate' and script", "medium", "qml.performance.delegate_js", True, "computes in its bindings", "Compute in the model or once in a property."),
}


def semantic_findings(project, kinds: list[str] | None = None) -> DataFrame:
    """All of them, or those of some kinds; tables that no wanted kind reads aren't made."""
    want = lambda k: kinds is None or k in kinds
    parts = [made(project) for kind, made in (("qml.binding_loss", _lost), ("qml.binding_cycle", _rings), ("qml.connection_signal_mismatch", _mismatches)) if want(kind)]
    shaped = project._rows("shapes").withColumn("base", X.leaf(F.col("type"))) if any(map(want, _SHAPES)) else None
    for kind, (condition, severity, name, typed, message, advice) in _SHAPES.items():
        if want(kind):
            parts.append(finding(shaped.where(condition), kind, severity, [F.lit(name), "file", "line"], F.concat_ws(" ", "type", F.lit(message)) if typed else message, advice))
    members = ("cleanup.unused_public_property", "cleanup.unused_public_signal")
    if any(map(want, members)):
        parts += [df for kind, df in zip(members, _unused_members(project), strict=True) if want(kind)]
    return _all(parts)


def _suppressions(project) -> DataFrame | None:
    rows = [(i, s.get("id"), s.get("kind"), s.get("file"), s.get("reason") or "configured suppression") for i, s in enumerate(project.config.suppressions)]
    return project.spark.createDataFrame(rows, "idx int, s_id string, s_kind string, s_file string, reason string") if rows else None


_FIELDS = ("id", "kind", "file")


def _by_fields(rules: DataFrame) -> list[tuple[list[str], DataFrame]]:
    """Rules by the fields that they set (empty ones count as not set): (fields, rules), at most eight."""
    isset = {f: F.coalesce(F.col(f"s_{f}"), F.lit("")) != "" for f in _FIELDS}
    out = []
    for mask in range(1 << len(_FIELDS)):
        fields = [f for i, f in enumerate(_FIELDS) if mask >> i & 1]
        out.append((fields, rules.where(reduce(lambda a, f: a & (isset[f] if f in fields else ~isset[f]), _FIELDS, F.lit(True)))))
    return out


def suppress(findings: DataFrame, rules: DataFrame | None) -> DataFrame:
    """findings with suppressed and reason, by the first rule that matches; rules: (idx, s_id, s_kind, s_file, reason).

    Rules are joined by the fields that they set, the first of each combination of values, so that a finding meets at most eight.
    """
    if rules is None:
        return findings.withColumn("suppressed", F.lit(False)).withColumn("reason", F.lit(None).cast("string"))
    out, made = findings, []
    for n, (fields, some) in enumerate(_by_fields(rules)):
        name = f"_rule{n}"
        first = some.groupBy(*(F.col(f"s_{f}").alias(f) for f in fields)).agg(F.min(F.struct("idx", "reason")).alias(name))
        out = out.join(first, fields, "left") if fields else out.join(F.broadcast(first), F.lit(True), "left")
        made.append(name)
    best = F.least(*made)
    return out.select(*findings.columns, best.isNotNull().alias("suppressed"), best["reason"].alias("reason"))


def stale(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that match no finding."""
    parts = []
    for fields, some in _by_fields(rules):
        seen = findings.select(*(F.col(f).alias(f"s_{f}") for f in fields)).distinct() if fields else findings.limit(1).select(F.lit(True).alias("any"))
        parts.append(some.join(seen, [f"s_{f}" for f in fields], "left_anti") if fields else some.join(F.broadcast(seen), F.lit(True), "left_anti"))
    return reduce(DataFrame.unionByName, parts)


def main_findings(project) -> DataFrame:
    raw = project._keep(_all([input_findings(project), derived_findings(project), semantic_findings(project)]), "raw")
    rules = _suppressions(project)
    out = suppress(raw, rules)
    if rules is None:
        return out
    old = finding(stale(raw, rules), "suppression.stale", "low", [F.lit("suppression.stale"), "idx"], F.concat_ws(" ", F.lit("No finding for"), "s_id", "s_kind", "s_file"), "Remove or correct the suppression.", file="s_file", line=None)
    return out.unionByName(old.withColumn("suppressed", F.lit(False)).withColumn("reason", F.lit(None).cast("string")))


def health_findings(project, lint: DataFrame | None = None) -> DataFrame:
    comps, config = project.components, project.config
    api = F.col("public_properties") + F.col("aliases")
    calls = project.bindings.where(X.found(F.col("code"), r"\b(?:exec|spawn|openUrlExternally)\s*\("))
    processes = F.filter("objects", lambda o: project.is_process(o["type"]))
    placed = project.parsed.where(F.exists("imports", lambda i: i["module"].contains("Quickshell")) & (F.size(processes) > 0) & ~project.allowed & (F.col("kind") == "qml")).select(F.col("path").alias("file"), F.get(processes, F.lit(0))["line"].alias("line"), F.size(processes).alias("n"))
    parts = [
        finding(comps.where(api > 18), "qml.api_surface", "medium", [F.lit("qml.api_surface"), "file"], F.concat_ws(" ", F.lit("Public members:"), api), "Split the interface or group its state."),
        finding(comps.where("aliases > 6"), "qml.alias_leakage", "medium", [F.lit("qml.alias_leakage"), "file"], F.concat_ws(" ", F.lit("Aliases:"), "aliases"), "Show meanings, not parts."),
        finding(comps.where("bindings > 90"), "qml.binding_pressure", "medium", [F.lit("qml.binding_pressure"), "file"], F.concat_ws(" ", F.lit("Bindings:"), "bindings"), "Move parts to components, and derived values to named properties."),
        finding(calls, "qml.side_effect_in_binding", "high", [F.lit("qml.side_effect_binding"), "file", "line"], F.concat_ws(" ", "path", F.lit("calls something with effects")), "Call it in a handler or a service."),
        finding(placed, "quickshell.process_placement", "medium", [F.lit("quickshell.process_placement"), "file"], F.concat_ws(" ", F.lit("Process objects:"), "n"), "Give processes a service component."),
        semantic_findings(project),
    ]
    if lint is not None:
        parts.append(lint_findings(lint))
    return suppress(_all(parts), _suppressions(project))


def lint_findings(lint: DataFrame) -> DataFrame:
    severity = F.when(F.col("severity") == "error", "high").when(F.col("severity") == "warning", "medium").otherwise("low")
    return finding(lint, "qmllint.diagnostic", severity, [F.lit("qmllint"), "file", "line", F.coalesce("column", F.lit(0)), F.coalesce("rule", "message")], F.col("message"), "See the linter's own advice.")


def _alone(project) -> DataFrame:
    r = project.resolution
    alone = project.components.where("use_count = 0").join(r.public_files, "file", "left_anti").join(r.referenced, "file", "left_anti")
    return finding(alone, "cleanup.unused_component", "low", [F.lit("cleanup.unused_component"), "file"], "No other component uses this one", "Remove it, or make it public in a qmldir.")


def _idle(project) -> DataFrame:
    return finding(project._rows("idle"), "cleanup.unused_id", "low", [F.lit("cleanup.unused_id"), "file", "id_name"], F.concat_ws(" ", F.lit("Nothing refers to the id"), "id_name"), "Remove the id unless something outside needs it.")


def cleanup_findings(project, kinds: list[str] | None = None) -> DataFrame:
    """All of them, or those of some kinds; tables that no wanted kind reads aren't made."""
    parts = [made(project) for kind, made in (("cleanup.unused_component", _alone), ("cleanup.unused_id", _idle)) if kinds is None or kind in kinds]
    return suppress(_all(parts), _suppressions(project))


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings, active, suppressed, high, medium, low (of the active), by_kind map."""
    on = ~F.col("suppressed")
    kinds = findings.where(on).groupBy("kind").count().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", F.col("count").cast("int"))))).alias("by_kind"))
    n = findings.agg(F.count("*").alias("findings"), F.count_if(on).alias("active"), F.count_if(~on).alias("suppressed"), *(F.count_if(on & (F.col("severity") == s)).alias(s) for s in ("high", "medium", "low")))
    return n.join(kinds, F.lit(True), "left")


def top(findings: DataFrame, n: int = 8) -> DataFrame:
    """The n active findings of the highest severity, then of the largest excess over their thresholds."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    excess = F.coalesce("metric", F.lit(0.0)) - F.coalesce("threshold", F.lit(0.0))
    return findings.where("not suppressed").orderBy(rank, F.desc(excess), F.coalesce("file", F.lit("")), F.coalesce("line", F.lit(0)), "id").limit(n)
