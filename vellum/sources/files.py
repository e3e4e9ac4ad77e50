"""Source discovery: files of a tree, or a table of them, as rows (path, kind, text)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config

SCHEMA = "path string, kind string, text string"


def source_kind(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.when(name == "qmldir", "qmldir").when(name.endswith(".qml"), "qml").when(name.endswith(".js"), "js")


def is_excluded(path: Column, patterns: list[str]) -> Column:
    hits = [(path == p) | path.startswith(p + "/") | path.contains(f"/{p}/") for p in patterns]
    out = F.lit(False)
    for h in hits:
        out = out | h
    return out


def from_table(df: DataFrame, path: str = "path", text: str = "text", exclude: list[str] | None = None) -> DataFrame:
    """Rows of a corpus table with a path each; other kinds of file and excluded paths go before text is read."""
    p = F.col(path)
    return df.where(source_kind(p).isNotNull() & ~is_excluded(p, exclude or [])).select(p.alias("path"), source_kind(p).alias("kind"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def discover(spark: SparkSession, config: Config) -> DataFrame:
    """All sources below the configured roots. Links are followed once: paths are told apart by their real places.

    Only names are listed on the driver; executors read the texts.
    """
    root, seen, names = config.project_root, set(), []
    for top in config.source_roots:
        for folder, folders, files in os.walk(top, followlinks=True):
            here = os.path.relpath(folder, root).replace(os.sep, "/")
            rel = lambda n, here=here: n if here == "." else f"{here}/{n}"
            folders[:] = [d for d in folders if not _excluded(rel(d), config.exclude) and not _again(os.path.join(folder, d), seen)]
            for f in files:
                full = os.path.join(folder, f)
                if (f == "qmldir" or f.endswith((".qml", ".js"))) and not _excluded(rel(f), config.exclude) and not _again(full, seen):
                    names.append((rel(f), full))
    listed = spark.createDataFrame(names, "path string, full string")
    if not names:
        return spark.createDataFrame([], SCHEMA)

    def read(batches):
        for pdf in batches:
            pdf["text"] = [open(f, encoding="utf-8", errors="replace", newline="").read() for f in pdf["full"]]
            yield pdf[["path", "text"]]

    return from_table(listed.repartition(max(1, min(len(names) // 64, 1024) or 1)).mapInPandas(read, "path string, text string"))


def _excluded(path: str, patterns: list[str]) -> bool:
    return any(path == p or path.startswith(p + "/") or f"/{p}/" in path for p in patterns)


def _again(path: str, seen: set[str]) -> bool:
    real = os.path.realpath(path)
    if real in seen:
        return True
    seen.add(real)
    return False
