"""Audits: findings against a baseline, changed lines and another revision."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tempfile
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.config import Config


def parse_diff(text: str) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Changed files, and (file, first line, lines) of each hunk of a diff without context."""
    files, hunks, now = [], [], None
    for line in text.splitlines():
        if line.startswith("+++ b/"):
            now = line[6:]
            files.append(now)
        elif line.startswith("+++ "):
            now = None  # a deleted file has no lines to look at
        elif now and (m := re.match(r"@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@", line)):
            hunks.append((now, int(m[1]), int(m[2]) if m[2] else 1))
    return list(dict.fromkeys(files)), hunks


def git(root: str, *args: str) -> subprocess.CompletedProcess:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True)


def flags(findings: DataFrame, baseline: DataFrame, files: DataFrame, lines: DataFrame, base: DataFrame | None, compared: bool = True) -> DataFrame:
    """findings with suppressed (baseline included), changed_file, in_changed_hunk, present_in_base, introduced.

    baseline, base: (id); files: (file); lines: (file, line).
    """
    rows = findings.join(baseline.select("id").distinct().withColumn("_b", F.lit(True)), "id", "left")
    rows = rows.join(files.select("file").distinct().withColumn("_f", F.lit(True)), "file", "left").join(lines.select("file", "line").distinct().withColumn("_l", F.lit(True)), ["file", "line"], "left")
    if base is not None:
        rows = rows.join(base.select("id").distinct().withColumn("_p", F.lit(True)), "id", "left").withColumn("present_in_base", F.coalesce("_p", F.lit(False))).drop("_p")
    else:
        rows = rows.withColumn("present_in_base", F.lit(None).cast("boolean"))
    rows = rows.withColumn("suppressed", F.col("suppressed") | F.coalesce("_b", F.lit(False))).withColumn("changed_file", F.coalesce("_f", F.lit(False))).withColumn("in_changed_hunk", F.coalesce("_l", F.lit(False))).drop("_b", "_f", "_l")
    new = F.col("changed_file") & (F.col("line").isNull() | F.col("in_changed_hunk")) & ~F.coalesce("present_in_base", F.lit(False))
    return rows.withColumn("introduced", new & F.lit(compared))


def verdict(rows: DataFrame, only_new: bool) -> DataFrame:
    """One row (verdict): fail with an active high finding, warn with a medium one, else pass."""
    gate = rows.where("not suppressed" + (" and introduced" if only_new else ""))
    worst = gate.agg(F.max(F.when(F.col("severity") == "high", 2).when(F.col("severity") == "medium", 1).otherwise(0)).alias("w"))
    return worst.select(F.when(F.col("w") == 2, "fail").when(F.col("w") == 1, "warn").otherwise("pass").alias("verdict"))


def read_baseline(path: str | None) -> list[str]:
    if not path or not os.path.exists(path):
        return []
    with open(path, encoding="utf-8") as f:
        return [x["id"] for x in json.load(f).get("findings", []) if x.get("id")]


def save_baseline(path: str, findings: DataFrame) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    rows = [r.asDict() for r in findings.select("id", "kind", "file", "line").orderBy("id").collect()]
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"schema_version": "0.1.0", "findings": rows}, f, indent=2)


def run(spark: SparkSession, config: Config, project, baseline: str | None = None, base: str | None = None) -> dict:
    """rows (a DataFrame), verdict, and what was compared. Diff paths count from the project's root."""
    from ..plans.project import Project
    from ..sources.files import discover

    files, hunks, status, reason, base_rows = [], [], "disabled", None, None
    if base:
        diff = git(config.project_root, "diff", "--unified=0", "--no-ext-diff", "--relative", base, "--", ".")
        status = "unavailable" if diff.returncode else "available"
        reason = diff.stderr.strip() or None
        files, hunks = parse_diff(diff.stdout) if not diff.returncode else ([], [])
        with tempfile.TemporaryDirectory() as temp:
            tree = os.path.join(temp, "base")
            if git(config.project_root, "worktree", "add", "--detach", "--quiet", tree, base).returncode == 0:
                inside = git(config.project_root, "rev-parse", "--show-prefix").stdout.strip().rstrip("/")
                root = os.path.join(tree, inside) if inside else tree
                move = lambda p: os.path.normpath(os.path.join(root, os.path.relpath(p, config.project_root)))
                old = Project(discover(spark, replace(config, project_root=root, source_roots=[move(p) for p in config.source_roots], lint_report=None, lint_command=None)), replace(config, project_root=root, source_roots=[move(p) for p in config.source_roots]))
                base_rows = spark.createDataFrame([(r["id"],) for r in old.findings.select("id").distinct().collect()], "id string")
                old.close()
                git(config.project_root, "worktree", "remove", "--force", tree)
            else:
                status, reason = "unavailable", "no worktree of the base"
    lines = spark.createDataFrame(hunks, "file string, start int, n int").where("n > 0").select("file", F.explode(F.expr("sequence(start, start + n - 1)")).alias("line"))
    rows = project._keep(flags(project.findings, spark.createDataFrame([(i,) for i in read_baseline(baseline)], "id string"), spark.createDataFrame([(f,) for f in files], "file string"), lines, base_rows, status != "disabled"), "audit")
    return {"rows": rows, "verdict": verdict(rows, bool(base)).first()["verdict"], "base": base, "changed_files": len(files), "changed_hunks": len(hunks), "base_comparison": status, "base_reason": reason}
