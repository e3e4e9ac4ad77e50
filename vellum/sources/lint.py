"""Linter reports, JSON or text, to rows (file, line, column, severity, message, rule)."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config

COLUMNS = ["file", "line", "column", "severity", "message", "rule"]


def _severity(x: Column) -> Column:
    low = F.lower(x)
    return F.when(low.isin("error", "fatal"), "error").when(low.isin("info", "note"), "info").otherwise("warning")


def _relative(file: Column, root: str) -> Column:
    plain = F.regexp_replace(file, "^file://", "")
    return F.when(plain.startswith(root + "/"), F.substring(plain, len(root) + 2, 1 << 20)).otherwise(F.regexp_replace(plain, r"^\./", ""))


def from_json(df: DataFrame, column: str = "value", root: str = ".") -> DataFrame:
    """df.column holds whole JSON reports: a list of entries, or an object with diagnostics, messages or issues."""
    v = F.try_parse_json(F.col(column))
    pick = F.coalesce(*(F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("diagnostics", "messages", "issues")), F.try_variant_get(v, "$", "array<variant>"))
    rows = df.select(F.explode(pick).alias("e"))
    text = lambda *keys: F.coalesce(*(F.when(F.schema_of_variant(F.try_variant_get("e", f"$.{k}", "variant")) == "STRING", F.try_variant_get("e", f"$.{k}", "string")) for k in keys))
    whole = lambda *keys: F.coalesce(*(F.when(F.try_variant_get("e", f"$.{k}", "string").rlike("^[0-9]+$"), F.try_variant_get("e", f"$.{k}", "int")) for k in keys))
    out = rows.select(text("file", "path", "url", "filename").alias("file"), F.coalesce(whole("line", "row"), F.lit(1)).alias("line"), whole("column", "col").alias("column"), _severity(text("severity", "type", "level")).alias("severity"), text("message", "description", "text").alias("message"), text("rule", "code", "id").alias("rule"))
    return out.where("file <> '' and message <> ''").withColumn("file", _relative(F.col("file"), root))


_FIRST = r"(?i)^(warning|error|info|note):\s*(.*?):([0-9]+)(?::([0-9]+))?:\s*(.*)$"
_PLAIN = r"(?i)^(.*?):([0-9]+)(?::([0-9]+))?:\s*(?:(warning|error|info|note):\s*)?(.*)$"


def from_text(df: DataFrame, column: str = "value", root: str = ".") -> DataFrame:
    """df.column holds one report line a row."""
    line = F.col(column)
    get = lambda p, i: F.nullif(F.regexp_extract(line, p, i), F.lit(""))
    ahead = line.rlike(_FIRST)
    two = lambda a, b: F.when(ahead, get(_FIRST, a)).otherwise(get(_PLAIN, b))
    message = two(5, 5)
    out = df.select(two(2, 1).alias("file"), two(3, 2).try_cast("int").alias("line"), two(4, 3).try_cast("int").alias("column"), _severity(two(1, 4)).alias("severity"), F.trim(message).alias("message"), F.nullif(F.regexp_extract(message, r"\[([^\]]+)\]\s*$", 1), F.lit("")).alias("rule"))
    return out.where("file is not null and line is not null and message is not null").withColumn("file", _relative(F.col("file"), root))


def load(spark: SparkSession, config: Config, run_command: bool = False) -> tuple[DataFrame, dict]:
    """The rows, and where they came from. A report goes before a command, which runs only if asked for."""
    about = {"source": "none", "command": None, "report": config.lint_report, "exit_code": None, "error": None}
    text = None
    if config.lint_report and os.path.exists(config.lint_report):
        about["source"] = "report"
        with open(config.lint_report, encoding="utf-8") as f:
            text = f.read()
    elif config.lint_command and run_command:
        done = subprocess.run(config.lint_command, shell=True, cwd=config.project_root, capture_output=True, text=True, timeout=600)
        about |= {"source": "command", "command": config.lint_command, "report": None, "exit_code": done.returncode}
        text = f"{done.stdout}\n{done.stderr}"
    plain = (text or "").strip()
    if plain[:1] in ("{", "["):
        import json

        try:
            json.loads(plain)
        except ValueError as e:
            about["error"] = f"the report can't be read: {e}"
        return from_json(spark.createDataFrame([(plain,)], "value string"), root=config.project_root), about
    return from_text(spark.createDataFrame([(x,) for x in (text or "").splitlines()], "value string"), root=config.project_root), about
