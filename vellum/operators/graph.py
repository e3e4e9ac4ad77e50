"""Binding dependencies and their cycles; the architecture graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def cycles_of(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Strongly connected sets of two nodes or more, or of one with an edge to itself. Iterative."""
    after: dict[str, list[str]] = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
    order, low, on, stack, out = {}, {}, set(), [], []
    for root in after:
        if root in order:
            continue
        work = [(root, iter(after[root]))]
        order[root] = low[root] = len(order)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in after:
                    continue
                if to not in order:
                    order[to] = low[to] = len(order)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(after[to])))
                    break
                if to in on:
                    low[node] = min(low[node], order[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == order[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    if len(part) > 1 or node in after[node]:
                        out.append(part)
    return out


def cycles(edges: DataFrame, file: str = "file", together: bool = False) -> DataFrame:
    """(file, nodes array<string>) of edges (file, src, dst). Edges come in order of file, so that one call takes many files
    and holds the graph of one; a node is in one cycle at most. together: a file's edges stand side by side already."""

    def run(batches):
        import pyarrow as pa

        def made(rows):
            found = [(key, sorted(c)) for key, part in rows for c in cycles_of(part)]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.string()), pa.array([c for _, c in found], pa.list_(pa.string()))], names=[file, "nodes"])

        now, held = None, []
        for batch in batches:
            done = []
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != now and held:
                    done.append((now, held))
                    held = []
                now = key
                held.append((a, b))
            yield made(done)
        yield made([(now, held)] if held else [])

    ordered = edges.select(file, "src", "dst")
    ordered = ordered if together else ordered.repartition(file).sortWithinPartitions(file)
    return ordered.mapInArrow(run, f"{file} string, nodes array<string>")


def binding_edges(project) -> DataFrame:
    """(file, src, dst): bindings that read a property bound in the same object, or one of an object named by id; a file's
    stand side by side."""
    return project._rows("edges").select("file", "src", "dst")


def architecture(project) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind, entrypoint, source_lines, ..., risk_score, risk) and edges (src, dst, kind, line)."""
    path, low = F.col("path"), F.lower("path")
    comps = project.components.select(F.col("file").alias("path"), "root_type", "object_count", "effort", "locality_score", "leverage_score", "distinct_id_references", "process_boundary_calls", "process_boundary_violations")
    files = project.files.join(comps, "path", "left")
    shell = path.endswith("shell.qml")
    role = F.when(shell, "shell_entrypoint").when(low.contains("theme"), "theme").when(low.rlike("row|delegate"), "delegate_component").when(low.rlike("pane|dialog|popup"), "container_component").when(F.col("root_type").contains("Window") | (F.col("root_type") == "ShellRoot"), "shell_surface").otherwise("visual_component")
    score = X.rounded(F.col("effort") * 0.25 + F.col("distinct_id_references") * 5 + F.col("process_boundary_violations") * 15 + F.greatest(F.col("object_count") - 20, F.lit(0)) * 2 + F.greatest(F.col("loc.source") - 200, F.lit(0)) * 0.1)
    nodes = files.select(
        path.alias("id"), F.substring_index("path", "/", -1).alias("label"), F.when(F.col("kind") == "qml", role).otherwise(F.col("kind")).alias("kind"), shell.alias("entrypoint"), F.col("loc.source").alias("source_lines"),
        F.col("object_count").alias("objects"), "effort", F.col("locality_score").alias("locality"), F.col("leverage_score").alias("leverage"), "process_boundary_calls", "process_boundary_violations", F.coalesce(score, F.lit(0)).alias("risk_score"),
    ).withColumn("risk", F.when(F.col("risk_score") >= 120, "high").when(F.col("risk_score") >= 60, "medium").otherwise("low"))
    return nodes, architecture_edges(project)


def architecture_edges(project) -> DataFrame:
    use = project.resolution.uses.where("target is not null and target <> file").select(F.col("file").alias("src"), F.col("target").alias("dst"), F.lit("component_use").alias("kind"), "line")
    kind = F.when(F.col("kind") == "external", "external_import").when(F.col("kind") == "unresolved", "unresolved_import").otherwise("local_import")
    imp = project.resolution.imports.select(F.col("file"), F.coalesce("target", "module"), kind, "line")
    ids = project.refs.where("external").select("file", F.concat_ws("#", "file", "name"), F.lit("id_reference"), "line")
    return use.union(imp).union(ids)
