"""Commands: init, catalog, analyze, measure, audit."""

from __future__ import annotations

import argparse
import json
import os
import sys

from .operators import audit, tasks
from .plans.project import Project
from .sources import config as conf
from .sources import files, lint


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("vellum").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="vellum", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("init", "catalog", "analyze", "measure", "audit"):
        c = sub.add_parser(name)
        c.add_argument("--config")
        if name == "init":
            c.add_argument("--force", action="store_true")
        if name == "measure":
            c.add_argument("task", nargs="?", default="all")
        if name in ("analyze", "measure"):
            c.add_argument("--format", choices=("summary", "json", "markdown"), default="summary")
            c.add_argument("--run-lint-command", action="store_true")
        if name == "audit":
            for x in ("--base", "--baseline", "--save-baseline"):
                c.add_argument(x)
    a = p.parse_args(argv)
    try:
        return _run(a, " ".join(argv if argv is not None else sys.argv[1:]))
    except (conf.ConfigError, KeyError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


def _run(a: argparse.Namespace, command: str) -> int:
    if a.command == "init":
        path = a.config or "vellum.config.json"
        if os.path.exists(path) and not a.force:
            raise FileExistsError(f"{path} exists; use --force")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(conf.starter(), f, indent=2)
        return 0
    if a.command == "catalog":
        print(json.dumps([{"task": t, "artifact": f"{n}.json", "needs": list(d)} for t, (n, _, d) in tasks.TASKS.items()], indent=2))
        return 0
    config, spark = conf.load(a.config), _session()
    project = Project(files.discover(spark, config), config)
    if a.command == "audit":
        found = audit.run(spark, config, project, a.baseline, a.base)
        head = tasks.findings.summary(found["rows"])
        out = {"task_id": "audit", "summary": tasks._rows(head)[0] | {k: v for k, v in found.items() if k != "rows"} | {"introduced": found["rows"].where("introduced").count(), "active_introduced": found["rows"].where("introduced and not suppressed").count()}, "findings": tasks._rows(found["rows"]), "project": {"name": config.project_name, "root": config.project_root}}
        tasks.write(config, "audit", out)
        if a.save_baseline:
            audit.save_baseline(a.save_baseline, project.findings)
        print(tasks.report(out), end="")
        return int(found["verdict"] == "fail")
    rows = lint.load(spark, config, a.run_lint_command)
    made = tasks.measure(project, "quality.qml" if a.command == "analyze" else a.task, rows, command)
    for x in made.values():
        print(json.dumps(x, indent=2) if a.format == "json" else tasks.report(x, a.format == "markdown"))
    return 0


if __name__ == "__main__":
    sys.exit(main())
