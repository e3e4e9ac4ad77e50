"""Project scores and input confidence: one row each, sums of whole numbers before any weighting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

WEIGHTS = {"complexity": 0.18, "cognitive": 0.14, "effort": 0.12, "locality": 0.14, "leverage": 0.12, "duplication": 0.1, "size": 0.08, "styling": 0.06, "boundary": 0.06}


def project_scores(project) -> DataFrame:
    over = lambda c, t: F.coalesce(F.avg(F.greatest(F.col(c) - t, F.lit(0))), F.lit(0.0))
    limit = project.config.thresholds["fileSlocHigh"]
    f = project.functions.agg(over("cyclomatic", 4).alias("cyc"), over("cognitive", 6).alias("cog"))
    c = project.components.agg(
        F.count("*").alias("n"), over("effort", 90).alias("eff"), F.coalesce(F.avg("locality_score"), F.lit(100.0)).alias("loc"), F.coalesce(F.avg("leverage_score"), F.lit(70.0)).alias("lev"),
        F.avg(F.col("hardcoded_colors") + F.greatest(F.col("numeric_style_literals") - 8, F.lit(0))).alias("sty"), F.avg("process_boundary_violations").alias("bnd"),
    )
    s = project.files.select("loc.source").agg(F.greatest(F.sum("source"), F.lit(1)).alias("lines"), over("source", limit).alias("big"))
    # Of all groups, not of the report's list.
    d = project.clone_places.groupBy("content").agg(F.max("lines").alias("lines"), F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("lines") * F.greatest(F.col("n") - 1, F.lit(1))), F.lit(0)).alias("again"))
    a = project.findings.where("not suppressed").agg(F.count_if(F.col("severity") == "high").alias("hi"), F.count_if(F.col("severity") == "medium").alias("mid"))
    row = f.join(c, F.lit(True)).join(s, F.lit(True)).join(d, F.lit(True)).join(a, F.lit(True))
    made = {
        "complexity": 100 - F.col("cyc") * 10, "cognitive": 100 - F.col("cog") * 7, "effort": 100 - F.col("eff") * 0.2, "locality": F.col("loc"), "leverage": F.col("lev"),
        "duplication": 100 - F.col("again") / F.col("lines") * 100, "size": 100 - F.col("big") * 0.4, "styling": 100 - F.col("sty") * 4, "boundary": 100 - F.col("bnd") * 20,
    }
    row = row.select("n", "hi", "mid", *(F.when(F.col("n") == 0, 0).otherwise(X.bounded(v.cast("double"))).alias(k) for k, v in made.items()))
    total = sum((F.col(k) * w for k, w in WEIGHTS.items()), F.lit(0.0)) - F.col("hi") / F.col("n") * 4 - F.col("mid") / F.col("n") * 2
    return row.select(F.when(F.col("n") == 0, 0).otherwise(X.bounded(total)).alias("overall"), *made)


def hotspots(project) -> DataFrame:
    t = project.config.thresholds
    score = X.rounded(F.col("loc.source") * 0.08 + F.col("object_count") * 1.5 + F.col("max_depth") * 5 + F.col("distinct_id_references") * 4 + F.col("process_boundary_violations") * 12 + F.col("max_cyclomatic") * 3 + F.col("max_cognitive") * 2 + F.greatest(F.col("bindings") - 30, F.lit(0)) * 0.4)
    tests = [
        ("large_file", F.col("loc.source") > t["fileSlocHigh"]), ("large_object_tree", F.col("object_count") > t["componentObjectCountHigh"]), ("deep_object_tree", F.col("max_depth") > 5), ("id_coupling", F.col("distinct_id_references") >= 8),
        ("misplaced_process_boundary", F.col("process_boundary_violations") > 0), ("cyclomatic_complexity", F.col("max_cyclomatic") >= t["functionCyclomaticHigh"]), ("cognitive_complexity", F.col("max_cognitive") >= t["functionCognitiveHigh"]), ("binding_pressure", F.col("bindings") > 80),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, n) for n, c in tests)))
    return project.components.select("file", F.col("name").alias("component"), "root_type", score.alias("score"), reasons.alias("reasons"), F.col("loc.source").alias("source_lines"), F.col("object_count").alias("objects"), "max_depth", "bindings", "distinct_id_references", "process_boundary_calls", "process_boundary_violations", "max_cyclomatic", "max_cognitive", "effort", "place").orderBy(F.desc("score"), "place").drop("place")


def locality(project) -> DataFrame:
    return project.components.orderBy("locality_score", "place").select("file", F.col("name").alias("component"), "locality_score", "id_reference_count", "distinct_id_references", "process_boundary_calls", "process_boundary_violations", "fan_out")


def leverage(project) -> DataFrame:
    kind = F.when((F.col("use_count") >= 3) & (F.col("effort") < 100), "high_leverage").when(F.col("use_count") >= 3, "central_risky").when(F.col("use_count") == 0, "low_reuse").otherwise("ordinary")
    return project.components.orderBy(F.desc("leverage_score"), "place").select("file", F.col("name").alias("component"), "leverage_score", "use_count", "fan_out", "effort", kind.alias("classification"))


def test_catalog(sources: DataFrame) -> DataFrame:
    """(file, kind, framework, test_cases array<struct<name,line>>) of rows (path, kind, text)."""
    case = X.found(F.col("text"), r"\bTestCase\s*\{")
    is_test = F.col("path").rlike(r"(?i)(^|/)tst_[^/]*\.qml$") | F.col("path").rlike(r"(?i)(^|/)(?:test|tests|testing|spec|specs)(?:/|$)") | case
    found = F.flatten(F.transform(X.lines(F.col("text")), lambda x, i: F.transform(F.regexp_extract_all(x, F.lit(r"(?<![A-Za-z0-9_])function\s+((?:test|benchmark)_[A-Za-z0-9_]+)"), F.lit(1)), lambda n: F.struct(n.alias("name"), (i + 1).alias("line")))))
    return sources.where((F.col("kind") != "qmldir") & is_test).select(F.col("path").alias("file"), "kind", F.when(case, "qt_quick_test").otherwise("unknown").alias("framework"), found.alias("test_cases"))


def precision_recall(found: DataFrame, positives: DataFrame, negatives: DataFrame) -> DataFrame:
    """(kind, true_positives, false_positives, false_negatives, precision, recall), three decimals, over tables (kind, file)."""
    hit = positives.join(found.select("kind", "file").distinct().withColumn("f", F.lit(1)), ["kind", "file"], "left").groupBy("kind").agg(F.count("f").alias("true_positives"), F.count_if(F.col("f").isNull()).alias("false_negatives"))
    bad = negatives.join(found.select("kind", "file").distinct(), ["kind", "file"], "left_semi").groupBy("kind").agg(F.count("*").alias("false_positives"))
    rows = hit.join(bad, "kind", "full").fillna(0)
    share = lambda a, b: F.when(a + b == 0, 1.0).otherwise(F.floor(a / (a + b) * 1000 + 0.5) / 1000)
    return rows.select("kind", "true_positives", "false_positives", "false_negatives", share(F.col("true_positives"), F.col("false_positives")).alias("precision"), share(F.col("true_positives"), F.col("false_negatives")).alias("recall"))
