"""Repeated line windows across files, extended as far as all their places agree, and structural clones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

GROUPS = 100


def normal_lines(files: DataFrame, code: str = "code", key: str = "path") -> DataFrame:
    """(path, line, norm) of every line."""
    return files.select(F.col(key).alias("path"), F.posexplode(X.lines(F.col(code))).alias("i", "raw")).select("path", (F.col("i") + 1).alias("line"), X.clone_line(F.col("raw")).alias("norm"))


def windows(lines: DataFrame, size: int, least: int = 40) -> DataFrame:
    """(path, line, key): `size` lines from each on, if at most one is blank and they have `least` characters together."""
    w = Window.partitionBy("path").orderBy("line").rowsBetween(0, size - 1)
    rows = lines.select("path", "line", F.collect_list("norm").over(w).alias("some"))
    text = F.concat_ws("\n", "some")
    full = (F.size("some") == size) & (F.size(F.filter("some", lambda x: x != "")) >= size - 1) & (X.utf16_length(text) >= least)
    return rows.where(full).select("path", "line", F.sha2(text, 256).alias("key"))


def clone_places(files: DataFrame, size: int) -> DataFrame:
    """(content, lines, file, start, end): all places of all groups of windows that two files or more have.

    files: (path, code). The places of a window are extended by the lines that all of them share: the common beginning of many
    lists is that of the least and the greatest, so that no place is left out and none are gathered. A window whose places all
    continue those of the window a line before, and are as many, says nothing new and isn't extended.
    """
    norm = files.select("path", F.transform(X.lines(F.col("code")), X.clone_line).alias("norm"))
    lines = norm.select("path", F.posexplode("norm").alias("i", "norm")).select("path", (F.col("i") + 1).alias("line"), "norm")
    wins = windows(lines, size)
    near = Window.partitionBy("path").orderBy("line")
    before = F.when(F.lag("line").over(near) == F.col("line") - 1, F.lag("key").over(near))
    keys = wins.withColumn("last", before).groupBy("key").agg(
        F.min("path").alias("a"), F.max("path").alias("b"), F.count("*").alias("n"), F.count("last").alias("led"), F.min("last").alias("last"), F.max("last").alias("other"),
    ).where("a <> b")
    whole = keys.select(F.col("key").alias("last"), F.col("n").alias("before"))
    heads = keys.withColumn("last", F.when((F.col("led") == F.col("n")) & (F.col("last") == F.col("other")), F.col("last"))).join(whole.hint("merge"), "last", "left")
    # The line before and the window's last have to be of text, as extension stops at blank ones: looked up in the file below.
    marked = heads.select("key", F.coalesce(F.col("before") == F.col("n"), F.lit(False)).alias("follows"))
    spots = wins.join(marked.hint("merge"), "key").join(norm.hint("merge"), "path")
    prior = F.when(F.col("line") > 1, F.get("norm", F.col("line") - 2)).otherwise("")
    spots = spots.where(~(F.col("follows") & (prior != "") & (F.get("norm", F.col("line") + size - 2) != "")))
    until = lambda x: F.when(F.array_position(x, "") > 0, F.slice(x, F.lit(1), (F.array_position(x, "") - 1).cast("int"))).otherwise(x)
    spots = spots.select(
        "key", "path", "line", until(F.reverse(F.slice("norm", F.lit(1), F.col("line") - 1))).alias("back"), until(F.slice("norm", F.col("line") + size, F.size("norm"))).alias("ahead"),
        F.slice("norm", F.col("line"), F.lit(size)).alias("own"),
    )
    shared = lambda x, y: F.when(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False) > 0, F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False) - 1).otherwise(F.size(x)).cast("int")
    grown = spots.groupBy("key").agg(F.min("back").alias("b0"), F.max("back").alias("b1"), F.min("ahead").alias("a0"), F.max("ahead").alias("a1"), F.min("own").alias("own"))
    grown = grown.withColumns({"nb": shared(F.col("b0"), F.col("b1")), "na": shared(F.col("a0"), F.col("a1"))})
    content = F.sha1(F.concat_ws("\n", F.reverse(F.slice("b0", F.lit(1), F.col("nb"))), "own", F.slice("a0", F.lit(1), F.col("na"))))
    grown = grown.select("key", content.alias("content"), "nb", (F.col("nb") + size + F.col("na")).alias("lines"))
    start = F.col("line") - F.col("nb")
    return spots.select("key", "path", "line").join(grown.hint("merge"), "key").select("content", "lines", F.col("path").alias("file"), start.alias("start"), (start + F.col("lines") - 1).alias("end")).distinct()


def clone_groups(files: DataFrame, size: int, places: DataFrame | None = None) -> DataFrame:
    """(id, rank, kind, lines, instances array<struct<file,start,end>>, sample array<string>): the report's list of the GROUPS
    longest, each with all its places; files: (path, text, code)."""
    places = clone_places(files, size) if places is None else places
    first = F.struct(F.collate("file", "UNICODE").alias("place"), "start", "file")
    groups = places.groupBy("content").agg(F.max("lines").alias("lines"), F.count("*").alias("n"), F.min(first).alias("first"))
    top = [F.desc("lines"), F.desc("n"), F.col("first.place"), F.col("first.start"), "content"]
    best = groups.orderBy(*top).limit(GROUPS).withColumn("rank", F.row_number().over(Window.orderBy(*top)))
    best = best.select("content", "rank", F.col("first.file").alias("path"), F.col("first.start").alias("start"))
    spot = F.struct(F.collate("file", "UNICODE").alias("place"), "start", "file", "end")
    all_ = places.join(F.broadcast(best.select("content", "rank")), "content").groupBy("content").agg(F.first("lines").alias("lines"), F.array_sort(F.collect_list(spot)).alias("all"))
    sample = files.join(F.broadcast(best.select("path").distinct()), "path").select("path", X.lines(F.col("text")).alias("raw"))
    rows = best.join(all_, "content").join(sample, "path")
    instances = F.transform("all", lambda x: F.struct(x["file"].alias("file"), x["start"].alias("start"), x["end"].alias("end")))
    return rows.select(F.concat(F.lit("clone."), F.col("rank").cast("string")).alias("id"), "rank", F.lit("normalized_line_window").alias("kind"), "lines", instances.alias("instances"), F.slice("raw", F.col("start"), F.col("lines")).alias("sample"))


def structural_clones(objects: DataFrame, bindings: DataFrame) -> DataFrame:
    """(id, kind, lines, instances, sample): objects of one shape, in two files or more; the first GROUPS seen."""
    names = bindings.groupBy("file", F.col("owner").alias("object_id")).agg(F.slice(F.array_sort(F.collect_list(F.regexp_replace("path", r"^.+\.", ""))), 1, 12).alias("b"), F.count("*").alias("nb"))
    kids = objects.where("parent_id is not null").groupBy("file", F.col("parent_id").alias("object_id")).agg(F.slice(F.array_sort(F.collect_list("type")), 1, 8).alias("c"))
    rows = objects.join(names, ["file", "object_id"], "left").join(kids, ["file", "object_id"], "left").where((F.coalesce("nb", F.lit(0)) >= 3) | F.col("c").isNotNull())
    shape = F.concat(F.col("type"), F.lit("|b:"), F.coalesce(F.concat_ws(",", "b"), F.lit("")), F.lit("|c:"), F.coalesce(F.concat_ws(",", "c"), F.lit("")))
    rows = rows.withColumn("shape", shape).where(X.utf16_length(F.col("shape")) >= 18)
    seen = F.struct(F.collate("file", "UNICODE").alias("place"), "ord", "file", F.col("line").alias("start"), F.col("line").alias("end"))
    groups = rows.groupBy("shape").agg(F.array_sort(F.collect_list(seen)).alias("all"), F.countDistinct("file").alias("files")).where("files > 1")
    first = Window.orderBy(F.col("all")[0]["place"], F.col("all")[0]["ord"])
    best = groups.orderBy(F.col("all")[0]["place"], F.col("all")[0]["ord"]).limit(GROUPS).withColumn("n", F.row_number().over(first))
    spots = F.transform("all", lambda x: F.struct(x["file"].alias("file"), x["start"].alias("start"), x["end"].alias("end")))
    return best.select(F.concat(F.lit("qml-structural."), F.col("n").cast("string")).alias("id"), F.lit("qml_structural").alias("kind"), F.lit(1).alias("lines"), spots.alias("instances"), F.array("shape").alias("sample"))


def duplication_pressure(groups: DataFrame) -> DataFrame:
    """(file, repeated_lines, pressure) from groups with instances and lines."""
    rows = groups.select("lines", F.explode("instances").alias("i")).groupBy(F.col("i.file").alias("file")).agg(F.sum("lines").alias("repeated_lines"))
    return rows.withColumn("pressure", F.when(F.col("repeated_lines") >= 60, "high").when(F.col("repeated_lines") >= 24, "medium").otherwise("low"))
