"""A project as tables: one vectorised parse, then everything else by DataFrame operations."""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text as X
from ..sources.config import Config
from ..sources import measures as M
from ..sources.qml import read_source
from .tables import removed, stored

_REF = "struct<owner:int,name:string,line:int,target:int,external:boolean>"
PARSED = {
    "path": "string",
    "kind": "string",
    "text": "string",
    "code": "string",
    "module": "string",
    "entries": "array<struct<name:string,file:string,line:int,public:boolean,singleton:boolean>>",
    "imports": "array<struct<module:string,version:string,alias:string,line:int,candidate:string>>",
    "objects": "array<struct<object_id:int,parent_id:int,type:string,line:int,end_line:int,depth:int,id_name:string>>",
    "bindings": f"array<struct<owner:int,path:string,line:int,expression:string,code:string,refs:array<{_REF}>>>",
    "properties": "array<struct<owner:int,name:string,line:int,alias:boolean>>",
    "signals": "array<struct<owner:int,name:string,line:int>>",
    "executables": "array<struct<owner:int,kind:string,name:string,line:int,lines:int,code:string>>",
    "refs": f"array<{_REF}>",
    "diagnostics": "array<struct<line:int,message:string>>",
    "measures": "struct<root_type:string,line:int,loc:struct<physical:int,source:int,blank:int,comment:int>,object_count:int,max_depth:int,public_properties:int,aliases:int,signals:int,functions:int,handlers:int,"
    "bindings:int,ids_declared:int,id_reference_count:int,distinct_id_references:int,hardcoded_colors:int,numeric_style_literals:int,process_objects:int,executables:int,efforts:int,cognitive:int,max_cyclomatic:int,"
    "max_cognitive:int,binding_sum:int>",
    "shapes": "array<struct<object_id:int,type:string,line:int,anchors:boolean,layout:boolean,geometry:boolean,active:boolean,source_size:boolean,script:boolean>>",
    "idle": "array<struct<id_name:string,line:int>>",
    "losses": "array<struct<line:int,by:string,prop:string>>",
    "edges": "array<struct<src:string,dst:string>>",
}
#: Files and characters of text that are read before their rows are passed on, and characters of texts whose records a worker keeps.
_FILES, _CHARS, _KEPT = 2048, 1 << 20, 1 << 20


def _record(path: str, kind: str, text: str | None, names: list[str], process_types: frozenset[str]) -> tuple:
    r = {"path": path, "kind": kind, "text": text} | read_source(path, kind, text or "")
    for name, made in (("shapes", M.shapes), ("idle", M.idle), ("losses", M.losses)):
        if name in names:
            r[name] = made(r) if kind == "qml" else []
    if "measures" in names:
        r["measures"] = M.measures(r, process_types)
    if "edges" in names:
        r["edges"] = [{"src": a, "dst": b} for a, b in M.edges(r)] if kind == "qml" else []
    return tuple(r[n] for n in names)


def parse(sources: DataFrame, columns: list[str] | None = None, process_types: list[str] | None = None) -> DataFrame:
    """Rows (path, kind, text) to one nested row a file, of all PARSED columns or of those named. Filter sources before:
    nothing is pushed through this stage.

    What a file says depends on its folder, kind and text alone (a qmldir's on its path), so that equal ones are read once
    among the files at hand and those lately read.
    """
    names = [k for k in PARSED if columns is None or k in columns]
    schema = T.StructType([T.StructField(k, T._parse_datatype_string(PARSED[k])) for k in names])
    arrow, types = to_arrow_schema(schema), frozenset(process_types or ())
    made = [n for n in names if n not in ("path", "kind", "text")]

    def run(batches):
        kept, older, size = {}, {}, 0

        def rows(paths, kinds, texts):
            nonlocal kept, older, size
            at, index, out = {}, [], []
            for path, kind, text in zip(paths, kinds, texts, strict=True):
                key = (kind, path if kind == "qmldir" else path.rpartition("/")[0], text)
                n = at.get(key)
                if n is None:
                    n = at[key] = len(out)
                    record = kept.get(key) or older.get(key)
                    if record is None:
                        record = _record(path, kind, text, made, types)
                    if key not in kept and len(text or "") < 1 << 14:
                        kept[key] = record
                        size += len(text or "")
                        if size > _KEPT:
                            kept, older, size = {}, kept, 0
                    out.append(record)
                index.append(n)
            given = {"path": paths, "kind": kinds, "text": texts}
            index = pa.array(index, pa.int32()) if len(out) < len(index) else None
            arrays = []
            for f in arrow:
                if f.name in given:
                    arrays.append(pa.array(given[f.name], f.type))
                else:
                    i = made.index(f.name)
                    a = pa.array([r[i] for r in out], f.type)
                    arrays.append(a if index is None else a.take(index))
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            paths, kinds, texts = (c.to_pylist() for c in batch.columns)
            lo = chars = 0
            for i, text in enumerate(texts):
                chars += len(text or "")
                if chars >= _CHARS or i + 1 - lo >= _FILES or i + 1 == len(texts):
                    yield rows(paths[lo : i + 1], kinds[lo : i + 1], texts[lo : i + 1])
                    lo, chars = i + 1, 0

    return sources.select("path", "kind", "text").mapInArrow(run, schema)


class Project:
    """Lazy tables over one parsed corpus; what several of them read is written once to the shared folder.

    columns: the PARSED columns that what is asked for reads, if only they are needed; once: and read in one pass, so that
    nothing is written before.
    """

    def __init__(self, sources: DataFrame, config: Config | None = None, columns: list[str] | None = None, once: bool = False) -> None:
        self.columns, self.once = columns, once
        self.config = config or Config()
        self.spark = sources.sparkSession
        self.sources = sources
        self._held: list[DataFrame] = []

    def close(self) -> None:
        """Deletes the written tables."""
        for df in self._held:
            removed(self.spark, df)
        self._held = []

    def _keep(self, df: DataFrame, name: str) -> DataFrame:
        """df, written; its column `place`, if any, is made anew from the path behind it."""
        plain = stored(df.drop("place"), name)
        self._held.append(plain)
        return plain.withColumn("place", F.collate(F.col("path" if "path" in df.columns else "file"), "UNICODE")) if "place" in df.columns else plain

    @cached_property
    def parsed(self) -> DataFrame:
        rows = parse(self.sources, self.columns, self.config.boundary["objectTypes"]).withColumn("place", F.col("path"))
        return rows.withColumn("place", F.collate("path", "UNICODE")) if self.once else self._keep(rows, "parsed")

    def _rows(self, column: str) -> DataFrame:
        return self.parsed.select(F.col("path").alias("file"), F.posexplode(column).alias("ord", "x")).select("file", "ord", "x.*")

    @cached_property
    def objects(self) -> DataFrame:
        return self._rows("objects")

    @cached_property
    def bindings(self) -> DataFrame:
        rows = self._rows("bindings")
        return rows.withColumn("complexity", X.binding_complexity(F.col("code"))).withColumn("dependency_count", F.size(F.array_distinct(F.transform("refs", lambda r: r["name"]))))

    @cached_property
    def properties(self) -> DataFrame:
        return self._rows("properties")

    @cached_property
    def signals(self) -> DataFrame:
        return self._rows("signals")

    @cached_property
    def refs(self) -> DataFrame:
        return self._rows("refs")

    @cached_property
    def imports(self) -> DataFrame:
        return self._rows("imports")

    @cached_property
    def diagnostics(self) -> DataFrame:
        return self._rows("diagnostics")

    @cached_property
    def functions(self) -> DataFrame:
        rows = self._rows("executables").withColumn("n", X.nesting(F.col("code"))).withColumn("cyclomatic", X.cyclomatic(F.col("code")))
        return rows.select(
            F.concat_ws(":", "file", F.col("line").cast("string"), "name").alias("id"), "file", "ord", "name", "kind", "line", "lines", "cyclomatic",
            F.col("n.cognitive").alias("cognitive"), F.col("n.deepest").alias("max_nesting"),
            X.rounded(F.col("lines") * 0.7 + F.col("cyclomatic") * 1.5 + F.col("n.cognitive") * 2).alias("effort"),
        )

    @cached_property
    def files(self) -> DataFrame:
        return self.parsed.select("path", "kind", "place", F.col("measures.loc").alias("loc"))

    @cached_property
    def allowed(self):
        """Column: the file may hold process calls."""
        patterns = self.config.boundary["allowedFilePatterns"]
        return F.col("path").rlike("(?i)" + "|".join(f"(?:{X.ascii_words(p)})" for p in patterns)) if patterns else F.lit(False)

    def is_process(self, kind):
        types = self.config.boundary["objectTypes"]
        return kind.isin(*types) | X.leaf(kind).isin(*types) if types else F.lit(False)

    @cached_property
    def base_components(self) -> DataFrame:
        """Component metrics of one file alone, from its nested row: no shuffle."""
        m = F.col("measures")
        calls = m["process_objects"]
        for p in self.config.boundary["textPatterns"]:
            calls = calls + X.count(F.col("code"), p)
        rows = self.parsed.where("kind = 'qml'").select(
            F.col("path").alias("file"), "path", "place",
            F.regexp_replace(F.substring_index("path", "/", -1), r"\.qml$", "").alias("name"),
            *(m[k].alias(k) for k in ("root_type", "line", "loc", "object_count", "max_depth", "public_properties", "aliases", "signals", "functions", "handlers", "bindings", "ids_declared", "id_reference_count", "distinct_id_references", "hardcoded_colors", "numeric_style_literals")),
            calls.alias("process_boundary_calls"),
            *(m[k].alias(k) for k in ("executables", "efforts", "cognitive", "max_cyclomatic", "max_cognitive", "binding_sum")),
        )
        rows = rows.withColumn("process_boundary_violations", F.when(self.allowed, 0).otherwise(F.col("process_boundary_calls")))
        mean = F.when(F.col("executables") > 0, F.col("cognitive") / F.col("executables")).otherwise(0.0)
        rows = rows.withColumn("effort", X.rounded(F.col("loc.source") * 0.35 + F.col("object_count") * 1.4 + F.col("max_depth") * 4 + F.col("efforts") * 0.7 + F.col("binding_sum") * 0.6 + F.col("distinct_id_references") * 2 + F.col("process_boundary_violations") * 8))
        rows = rows.withColumn("complexity_score", X.bounded(100 - F.col("max_depth") * 4 - F.col("object_count") * 0.7 - mean * 2))
        rows = rows.withColumn("locality_score", X.bounded((100 - F.col("distinct_id_references") * 4 - F.col("process_boundary_violations") * 10 - F.greatest(F.col("bindings") - 25, F.lit(0))).cast("double")))
        return rows.drop("executables", "efforts", "cognitive", "binding_sum", "path")

    @cached_property
    def components(self) -> DataFrame:
        """With reuse: how often others use the component, and how many it uses."""
        uses = self.resolution.uses.where(F.col("target").isNotNull() & (F.col("target") != F.col("file")))
        used = uses.groupBy(F.col("target").alias("file")).agg(F.count("*").cast("int").alias("use_count"))
        out = uses.groupBy("file").agg(F.countDistinct("target").cast("int").alias("fan_out"))
        rows = self.base_components.join(used.hint("merge"), "file", "left").join(out.hint("merge"), "file", "left").fillna(0, ["use_count", "fan_out"])
        return self._keep(rows.withColumn("leverage_score", X.bounded(50 + F.col("use_count") * 15 - F.col("effort") * 0.15 - F.col("fan_out") * 2)), "components")

    @cached_property
    def resolution(self):
        from ..operators.resolution import Resolution

        return Resolution(self)

    @cached_property
    def clone_places(self) -> DataFrame:
        """All places of all groups of repeated lines."""
        from ..operators.clones import clone_places

        return self._keep(clone_places(self.parsed.where("kind <> 'qmldir'").select("path", "code"), int(self.config.thresholds["cloneWindow"])), "clone_places")

    @cached_property
    def clones(self) -> DataFrame:
        """The report's list of the longest groups."""
        from ..operators.clones import clone_groups

        return self._keep(clone_groups(self.parsed.where("kind <> 'qmldir'").select("path", "text", "code"), int(self.config.thresholds["cloneWindow"]), self.clone_places), "clones")

    @cached_property
    def findings(self) -> DataFrame:
        from ..operators.findings import main_findings

        return self._keep(main_findings(self), "findings")

    @cached_property
    def scores(self) -> DataFrame:
        from ..operators.scores import project_scores

        return project_scores(self)

    def order(self, *more) -> Window:
        return Window.orderBy("place", *more)
