"""Queries of the static-quality engine over the driver's tables, with their DuckDB SQL.

The tables hold no source files; so a templated corpus (one file an order, one object a line item) goes through the real
parser, and text and relational operators run on documents and events as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit, clones, findings, graph, scores
from ..sources import files as source_files
from ..sources import lint
from ..sources.config import THRESHOLDS, Config
from .project import Project


def load(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all shuffle partitions, by keys or evenly. Reading a file costs far more than its bytes say, by which partitions
    would be merged or scans divided."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def order_sources(spark: SparkSession, d: str) -> DataFrame:
    items = spread(load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"), "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"))).alias("items"))
    child = lambda x, i: (
        F.when(x["l_returnflag"] == "R", F.concat(F.lit("  Rectangle { id: c"), i.cast("string"), F.lit("; width: root.total; anchors.left: root.left }")))
        .when(x["l_returnflag"] == "A", F.concat(F.lit("  Loader { active: root.total > "), x["l_quantity"].cast("int").cast("string"), F.lit("; onLoaded: { if (root) { root.total = 1 } } }")))
        .otherwise(F.lit("  Image { source: 'x.png' }"))
    )
    text = F.concat(F.lit("import QtQuick 2.15\n\nItem { // an order\n  id: root\n  property int total: 1\n"), F.concat_ws("\n", F.transform("items", child)), F.lit("\n}"))
    return items.select(F.concat(F.lit("orders/o"), F.col("l_orderkey").cast("string"), F.lit(".qml")).alias("path"), F.lit("qml").alias("kind"), text.alias("text"))


def supplier_sources(spark: SparkSession, d: str) -> DataFrame:
    """A module folder for each nation, a component for each supplier, and a page for each customer that uses two."""
    s, c = load(spark, d, "supplier"), spread(load(spark, d, "customer").select("c_custkey", "c_nationkey"))
    folder = F.concat(F.lit("n"), F.col("s_nationkey").cast("string"))
    name = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    comps = s.select(F.concat(folder, F.lit("/"), name, F.lit(".qml")).alias("path"), F.lit("qml").alias("kind"), F.lit("Item {\n  id: root\n  property int size\n  signal done\n}").alias("text"))
    lines = F.concat_ws("\n", F.sort_array(F.collect_list(F.concat(name, F.lit(" 1.0 "), name, F.lit(".qml")))))
    dirs = s.groupBy("s_nationkey").agg(lines.alias("l")).select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/qmldir")).alias("path"), F.lit("qmldir").alias("kind"), F.concat(F.lit("module nation.n"), F.col("s_nationkey").cast("string"), F.lit("\n"), F.col("l")).alias("text"))
    n = s.agg(F.count("*").alias("n"))
    near = F.concat(F.lit("S"), (F.col("c_custkey") % F.col("n")).cast("string"))
    far = F.concat(F.lit("S"), ((F.col("c_custkey") * 7 + 3) % F.col("n")).cast("string"))
    pages = c.crossJoin(F.broadcast(n)).select(
        F.concat(F.lit("pages/P"), F.col("c_custkey").cast("string"), F.lit(".qml")).alias("path"), F.lit("qml").alias("kind"),
        F.concat(F.lit("import nation.n"), F.col("c_nationkey").cast("string"), F.lit("\nimport nation.n"), ((F.col("c_nationkey") + 1) % 25).cast("string"), F.lit(" as Next\nItem {\n  "), near, F.lit(" { size: 1 }\n  Next."), far, F.lit(" { onDone: x() }\n}")).alias("text"),
    )
    return comps.union(dirs).union(pages)


def q_component_metrics(spark, d):
    p = Project(order_sources(spark, d), columns=["path", "kind", "code", "measures"], once=True)
    return p.base_components.select("file", F.col("loc.source").alias("source"), F.col("loc.blank").alias("blank"), "object_count", "max_depth", "bindings", "handlers", "ids_declared", "id_reference_count", "distinct_id_references", "numeric_style_literals", "max_cyclomatic", "max_cognitive", "locality_score", "complexity_score", "effort")


_ORDERS = """with o as (select l_orderkey k, count(*) n, count(*) filter (l_returnflag = 'R') r, count(*) filter (l_returnflag = 'A') a, count(*) filter (l_returnflag not in ('R', 'A')) i from lineitem group by 1),
f as (select 'orders/o' || k || '.qml' as file, n, r, a, i, n + 5 as source, 1 + n as objects, 2 as depth, 2 + 3 * r + 2 * a + i as bindings, case when r + a > 0 then 1 else 0 end as ids, case when a > 0 then 2 else 0 end as cyc, case when a > 0 then 1 else 0 end as cog from o)"""
_EFFORT = "floor(source * 0.35::double + objects * 1.4::double + depth * 4 + a * 6 * 0.7::double + (bindings + a) * 0.6::double + ids * 2 + 0.5)"
S_component_metrics = f"""{_ORDERS} select file, source::bigint as source, 1::bigint as blank, objects::bigint as object_count, depth::bigint as max_depth, bindings::bigint as bindings, a::bigint as handlers, (1 + r)::bigint as ids_declared, (2 * r + 3 * a)::bigint as id_reference_count, ids::bigint as distinct_id_references, 0::bigint as numeric_style_literals, cyc::bigint as max_cyclomatic, cog::bigint as max_cognitive,
greatest(0, least(100, 100 - ids * 4 - greatest(bindings - 25, 0)))::bigint as locality_score, greatest(0, least(100, floor(100 - depth * 4 - objects * 0.7::double - cog * 2 + 0.5)))::bigint as complexity_score, {_EFFORT}::bigint as effort from f"""


def q_hotspots(spark, d):
    p = Project(order_sources(spark, d), columns=["path", "kind", "code", "measures"], once=True)
    # Written before it is sorted, as sorting reads its rows twice.
    p.components = p._keep(p.base_components, "components").withColumn("use_count", F.lit(0)).withColumn("fan_out", F.lit(0))
    return scores.hotspots(p).select("file", "score", "objects", "effort", F.concat_ws(",", "reasons").alias("reasons"))


S_hotspots = f"""{_ORDERS} select file, floor(source * 0.08::double + objects * 1.5::double + depth * 5 + ids * 4 + cyc * 3 + cog * 2 + greatest(bindings - 30, 0) * 0.4::double + 0.5)::bigint as score, objects::bigint as objects, {_EFFORT}::bigint as effort, '' as reasons from f"""


def _semantic(kind, column):
    def run(spark, d):
        return findings.semantic_findings(Project(order_sources(spark, d), columns=["path", "kind", column], once=True), [kind]).groupBy("file", "severity").agg(F.count("*").alias("n"))

    return run


def _semantic_sql(column, severity):
    return f"{_ORDERS} select file, '{severity}' as severity, {column}::bigint as n from f where {column} > 0"


def q_unused_ids(spark, d):
    return findings.cleanup_findings(Project(order_sources(spark, d), columns=["path", "kind", "idle"], once=True), ["cleanup.unused_id"]).select("id", "file", "line")


S_unused_ids = """with o as (select l_orderkey k, l_returnflag f, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) as i from lineitem)
select 'cleanup.unused_id.orders/o' || k || '.qml.c' || (i - 1) as id, 'orders/o' || k || '.qml' as file, (i + 5)::bigint as line from o where f = 'R'"""


#: What resolution reads.
_RESOLVED = ["path", "kind", "module", "entries", "imports", "objects"]


def q_import_resolution(spark, d):
    return Project(supplier_sources(spark, d), columns=["path", "kind", "module", "imports"]).resolution.imports.select("file", "module", "alias", "kind", "target")


S_import_resolution = """with m as (select distinct s_nationkey n from supplier), i as (select c_custkey c, c_nationkey n, null as alias from customer union all select c_custkey, (c_nationkey + 1) % 25, 'Next' from customer)
select 'pages/P' || c || '.qml' as file, 'nation.n' || i.n as module, alias, case when m.n is null then 'unresolved' else 'local_module' end as kind, case when m.n is not null then 'n' || m.n || '/qmldir' end as target from i left join m on i.n = m.n"""


def q_component_uses(spark, d):
    return Project(supplier_sources(spark, d), columns=_RESOLVED).resolution.uses.select("file", "type", "target", "unresolved")


S_component_uses = """with t as (select count(*) n from supplier), u as (select c_custkey c, c_nationkey n, c_custkey % t.n as s, '' as pre from customer, t union all select c_custkey, (c_nationkey + 1) % 25, (c_custkey * 7 + 3) % t.n, 'Next.' from customer, t)
select 'pages/P' || c || '.qml' as file, pre || 'S' || s as type, case when s_suppkey is not null then 'n' || s_nationkey || '/S' || s_suppkey || '.qml' end as target, s_suppkey is null as unresolved from u left join supplier on s = s_suppkey and n = s_nationkey"""


def q_leverage(spark, d):
    return scores.leverage(Project(supplier_sources(spark, d), columns=[*_RESOLVED, "code", "measures"])).where("file not like 'pages/%'").select("file", "use_count", "fan_out", "effort", "leverage_score", "classification")


S_leverage = f"""with uses as ({S_component_uses}), n as (select target, count(*) c from uses where target is not null group by 1), f as (select 'n' || s_nationkey || '/S' || s_suppkey || '.qml' as file, coalesce(c, 0) c from supplier left join n on target = 'n' || s_nationkey || '/S' || s_suppkey || '.qml')
select file, c::bigint as use_count, 0::bigint as fan_out, 8::bigint as effort, greatest(0, least(100, floor(50 + c * 15 - 8 * 0.15 + 0.5)))::bigint as leverage_score, case when c >= 3 then 'high_leverage' when c = 0 then 'low_reuse' else 'ordinary' end as classification from f"""


def q_architecture_edges(spark, d):
    return graph.architecture_edges(Project(supplier_sources(spark, d), columns=[*_RESOLVED, "refs"])).groupBy("kind").agg(F.count("*").alias("n"))


S_architecture_edges = f"""with uses as ({S_component_uses}), imps as ({S_import_resolution}) select 'component_use' as kind, count(*)::bigint as n from uses where target is not null union all select case when kind = 'unresolved' then 'unresolved_import' else 'local_import' end, count(*)::bigint from imps group by 1"""


def q_ambiguous_names(spark, d):
    p = load(spark, d, "part").select(F.concat(F.lit("b"), F.regexp_replace("p_brand", "[^0-9]", ""), F.lit("/"), F.initcap(F.regexp_replace("p_name", "[^A-Za-z]", "")), F.lit(".qml")).alias("path")).distinct()
    r = Project(p.select("path", F.lit("qml").alias("kind"), F.lit("Item {}").alias("text"))).resolution
    return r.names.where("size(files) > 1").select("name", F.size("files").cast("long").alias("files"), F.col("files")[0].alias("first_file"))


S_ambiguous_names = """with p as (select distinct 'b' || regexp_replace(p_brand, '[^0-9]', '', 'g') as b, regexp_replace(p_name, '[^A-Za-z]', '', 'g') as n from part), q as (select b || '/' || upper(n[1:1]) || lower(n[2:]) || '.qml' as file, upper(n[1:1]) || lower(n[2:]) as name from p)
select name, count(*)::bigint as files, min(file) as first_file from q group by name having count(*) > 1"""


def q_binding_cycles(spark, d):
    """A ring of as many bindings as an order has line items, of those with three or more."""
    n = spread(load(spark, d, "lineitem").select("l_orderkey"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    ring = F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: F.concat(F.lit("  p"), i.cast("string"), F.lit(": p"), F.when(i < F.col("n"), i + 1).when(F.col("n") >= 3, F.lit(1)).otherwise(F.lit(99)).cast("string"), F.lit(" + 1")))
    text = F.concat(F.lit("Item {\n"), F.concat_ws("\n", ring), F.lit("\n}"))
    p = Project(n.select(F.concat(F.lit("r"), F.col("l_orderkey").cast("string"), F.lit(".qml")).alias("path"), F.lit("qml").alias("kind"), text.alias("text")), columns=["path", "kind", "edges"], once=True)
    return graph.cycles(graph.binding_edges(p), together=True).select("file", F.size("nodes").cast("long").alias("nodes"))


S_binding_cycles = "select 'r' || l_orderkey || '.qml' as file, count(*)::bigint as nodes from lineitem group by l_orderkey having count(*) >= 3"


def q_loc_metrics(spark, d):
    rows = load(spark, d, "documents").select("doc_id", X.line_counts(F.col("text"), F.col("text")).alias("l"))
    return rows.select("doc_id", *(F.col(f"l.{k}").cast("long").alias(k) for k in ("physical", "source", "blank", "comment")))


S_loc_metrics = r"""with l as (select doc_id, string_split_regex(text, '\r?\n') as x from documents) select doc_id, len(x)::bigint as physical, len(list_filter(x, lambda e: regexp_matches(e, '[^\s]')))::bigint as source, len(list_filter(x, lambda e: not regexp_matches(e, '[^\s]')))::bigint as blank, 0::bigint as comment from l"""


def q_decision_count(spark, d):
    return load(spark, d, "documents").select("doc_id", X.count(F.col("text"), r"\b(?:for|de|en|the|if)\b|\?|&&|\|\|").cast("long").alias("n"))


S_decision_count = r"""select doc_id, len(regexp_extract_all(text, '\b(?:for|de|en|the|if)\b|\?|&&|\|\|'))::bigint as n from documents"""


def q_cognitive_fold(spark, d):
    """Nested ifs, as deep as an order has line items."""
    n = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"))
    code = F.concat(F.lit("{"), F.repeat(F.lit("if (a) {"), F.col("n")), F.repeat(F.lit("}"), F.col("n")), F.lit("}"))
    fold = X.nesting(code)
    return n.select("l_orderkey", fold["cognitive"].cast("long").alias("cognitive"), fold["deepest"].cast("long").alias("deepest"), X.cyclomatic(code).cast("long").alias("cyclomatic"))


S_cognitive_fold = "select l_orderkey, (count(*) * (count(*) + 1) / 2)::bigint as cognitive, (count(*) + 1)::bigint as deepest, (count(*) + 1)::bigint as cyclomatic from lineitem group by 1"


def q_clone_windows(spark, d):
    lines = clones.normal_lines(load(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text"), "text")
    w = clones.windows(lines, 3).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("path").alias("docs")).where("docs > 1")
    return w.agg(F.count("*").alias("groups"), F.sum("n").alias("instances"), F.max("docs").alias("most_docs"))


S_clone_windows = r"""with l as (select doc_id, unnest(string_split_regex(text, '\r?\n')) as raw, generate_subscripts(string_split_regex(text, '\r?\n'), 1) as i from documents),
n as (select doc_id, i, regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '#[0-9a-fA-F]{3,8}\b', '#COLOR', 'g'), '"(?:\\.|[^"])*"|''(?:\\.|[^''])*''', 'STR', 'g'), '\b[0-9]+(?:\.[0-9]+)?\b', 'NUM', 'g'), '^\s+|\s+$', '', 'g') as norm from l),
w as (select doc_id, norm || chr(10) || lead(norm, 1) over p || chr(10) || lead(norm, 2) over p as t, (norm <> '')::int + (lead(norm, 1) over p <> '')::int + (lead(norm, 2) over p <> '')::int as full_lines from n window p as (partition by doc_id order by i)),
g as (select t, count(*) n, count(distinct doc_id) docs from w where t is not null and full_lines >= 2 and length(t) >= 40 group by t having count(distinct doc_id) > 1)
select count(*)::bigint as groups, sum(n)::bigint as instances, max(docs)::bigint as most_docs from g"""


def _event_findings(spark, d):
    e = load(spark, d, "events")
    severity = F.when(F.col("value") >= 80, "high").when(F.col("value") >= 40, "medium").otherwise("low")
    return e.select(F.concat(F.lit("e."), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), severity.alias("severity"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), (F.col("event_id") % 50).cast("int").alias("line"), F.lit("m").alias("message"), F.col("value").alias("metric"), F.lit(10.0).alias("threshold"), F.lit("a").alias("action"))


def _rules(spark):
    return spark.createDataFrame([(0, None, "click", "u1", "one"), (1, None, "click", None, "two"), (2, "e.5", None, None, "three"), (3, None, "absent", None, "four"), (4, None, None, "u3", "five")], "idx int, s_id string, s_kind string, s_file string, reason string")


_RULES = "(values (0, null, 'click', 'u1', 'one'), (1, null, 'click', null, 'two'), (2, 'e.5', null, null, 'three'), (3, null, 'absent', null, 'four'), (4, null, null, 'u3', 'five')) r(idx, s_id, s_kind, s_file, reason)"
_EVENTS = "ev as (select 'e.' || event_id as id, event_type as kind, case when value >= 80 then 'high' when value >= 40 then 'medium' else 'low' end as severity, 'u' || user_id as file, event_id % 50 as line, value as metric from events)"
_ON = "(s_id is null or s_id = id) and (s_kind is null or s_kind = kind) and (s_file is null or s_file = file)"


def q_suppress(spark, d):
    return findings.suppress(_event_findings(spark, d), _rules(spark)).select("id", "suppressed", "reason")


S_suppress = f"with {_EVENTS}, m as (select id, arg_min(reason, idx) as reason from ev join {_RULES} on {_ON} group by id) select ev.id, m.id is not null as suppressed, m.reason from ev left join m on ev.id = m.id"


def q_stale_suppressions(spark, d):
    return findings.stale(_event_findings(spark, d), _rules(spark)).select("idx", "reason")


S_stale_suppressions = f"with {_EVENTS} select idx::bigint as idx, reason from {_RULES} where not exists (select 1 from ev where {_ON})"


def q_finding_summary(spark, d):
    return findings.summary(findings.suppress(_event_findings(spark, d), _rules(spark))).drop("by_kind")


S_finding_summary = f"with {_EVENTS}, m as (select distinct id from ev join {_RULES} on {_ON}), j as (select ev.*, m.id is not null as s from ev left join m on ev.id = m.id) select count(*)::bigint as findings, (count(*) filter (not s))::bigint as active, (count(*) filter (s))::bigint as suppressed, (count(*) filter (not s and severity = 'high'))::bigint as high, (count(*) filter (not s and severity = 'medium'))::bigint as medium, (count(*) filter (not s and severity = 'low'))::bigint as low from j"


def q_top_findings(spark, d):
    """The report's list of eight."""
    return findings.top(findings.suppress(_event_findings(spark, d), None)).select("id", "severity", "metric")


S_top_findings = f"with {_EVENTS} select id, severity, metric from ev order by case severity when 'high' then 0 when 'medium' then 1 else 2 end, metric - 10 desc, file, line, id limit 8"


def q_audit_flags(spark, d):
    e = findings.suppress(_event_findings(spark, d), None)
    n = F.regexp_replace("id", "e.", "").cast("long")
    base, accepted = e.where(n % 3 == 0).select("id"), e.where(n % 7 == 0).select("id")
    files, lines = e.where(n % 5 == 0).select("file"), e.where(n % 4 == 0).select("file", "line")
    return audit.flags(e, accepted, files, lines, base).select("id", "suppressed", "changed_file", "in_changed_hunk", "present_in_base", "introduced")


S_audit_flags = f"""with {_EVENTS}, e as (select *, substr(id, 3)::bigint as n from ev), f as (select distinct file from e where n % 5 = 0), l as (select distinct file, line from e where n % 4 = 0)
select id, n % 7 = 0 as suppressed, f.file is not null as changed_file, l.file is not null as in_changed_hunk, n % 3 = 0 as present_in_base, f.file is not null and l.file is not null and n % 3 <> 0 as introduced from e left join f on e.file = f.file left join l on e.file = l.file and e.line = l.line"""


def q_lint_ingest(spark, d):
    e = load(spark, d, "events").select(F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("src/u"), F.col("user_id").cast("string"), F.lit(".qml")).alias("path"), (F.col("event_id") % 90 + 1).alias("row"), F.col("event_type").alias("level"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("description"))).alias("issues"))).alias("value"))
    return lint.from_json(e).select("file", F.col("line").cast("long").alias("line"), "severity", "message")


S_lint_ingest = "select 'src/u' || user_id || '.qml' as file, (event_id % 90 + 1)::bigint as line, case when event_type = 'error' then 'error' else 'warning' end as severity, 'event ' || event_id as message from events"


def q_oracle_precision(spark, d):
    labels, docs = load(spark, d, "labels"), load(spark, d, "documents")
    t = lambda df: df.select(F.lit("short_or_marked").alias("kind"), F.col("doc_id").cast("string").alias("file"))
    return scores.precision_recall(t(docs.where("n_chars < 400 or text like '%#%'")), t(labels.where("quality = 0")), t(labels.where("quality = 1")))


S_oracle_precision = """with f as (select doc_id from documents where n_chars < 400 or text like '%#%'), c as (select count(*) filter (quality = 0 and f.doc_id is not null) tp, count(*) filter (quality = 0 and f.doc_id is null) fn, count(*) filter (quality = 1 and f.doc_id is not null) fp from labels left join f on labels.doc_id = f.doc_id)
select 'short_or_marked' as kind, tp::bigint as true_positives, fp::bigint as false_positives, fn::bigint as false_negatives, floor(tp / (tp + fp) * 1000 + 0.5) / 1000 as precision, floor(tp / (tp + fn) * 1000 + 0.5) / 1000 as recall from c"""


def q_discovery(spark, d):
    p = load(spark, d, "part").select(F.concat(F.when(F.col("p_size") % 5 == 0, "build/").when(F.col("p_size") % 5 == 1, "a/build/").otherwise("ui/"), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 3 == 0, ".qml").when(F.col("p_size") % 3 == 1, ".js").otherwise(".mjs")).alias("path"), F.col("p_name").alias("text"))
    return source_files.from_table(p, exclude=["build"]).groupBy("kind").agg(F.count("*").alias("n"))


S_discovery = "select case when p_size % 3 = 0 then 'qml' else 'js' end as kind, count(*)::bigint as n from part where p_size % 5 > 1 and p_size % 3 < 2 group by 1"


def q_test_catalog(spark, d):
    o = order_sources(spark, d).withColumn("path", F.regexp_replace("path", "orders/o([0-9]*)7.qml", "tests/tst_$1_7.qml"))
    return scores.test_catalog(o).select("file", "kind", "framework", F.size("test_cases").cast("long").alias("test_cases"))


S_test_catalog = "select distinct 'tests/tst_' || (l_orderkey // 10)::varchar || '_7.qml' as file, 'qml' as kind, 'unknown' as framework, 0::bigint as test_cases from lineitem where l_orderkey % 10 = 7 and l_orderkey >= 10 union all select distinct 'tests/tst__7.qml', 'qml', 'unknown', 0::bigint from lineitem where l_orderkey = 7"


def q_project_scores(spark, d):
    return Project(supplier_sources(spark, d), Config(thresholds=dict(THRESHOLDS))).scores


_SQL = {k[2:]: v for k, v in list(globals().items()) if k.startswith("S_")}
_RUN = {k[2:]: v for k, v in list(globals().items()) if k.startswith("q_")}
for _name, _kind, _column, _severity, _read in (
    ("binding_loss", "qml.binding_loss", "a", "high", "losses"),
    ("layout_conflict", "qml.layout_conflict.anchors_with_geometry", "r", "medium", "shapes"),
    ("image_smells", "qml.performance.image_without_source_size", "i", "low", "shapes"),
):
    _RUN[_name], _SQL[_name] = _semantic(_kind, _read), _semantic_sql(_column, _severity)

QUERIES, ORACLE_SQL = dict(sorted(_RUN.items())), dict(sorted(_SQL.items()))
