"""Configuration: JSON with comments, checked as a whole, with defaults."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field
from pathlib import Path

EXCLUDE = [".direnv", "build", "target", "dist", ".git", "node_modules"]
THRESHOLDS = {"cloneWindow": 6, "bindingComplexityHigh": 5, "handlerLinesHigh": 25, "functionCognitiveHigh": 15, "functionCyclomaticHigh": 10, "componentObjectCountHigh": 45, "fileSlocHigh": 250}
BOUNDARY = {
    "objectTypes": ["Process", "ShellCommand"],
    "textPatterns": [r"\b(?:openUrlExternally|quickshell\s+ipc|nm-api)\b"],
    "allowedFilePatterns": [r"(^|/)(?:process|api|service)(?:[._/-]|$)", r"(^|/)shell\.qml$"],
}


class ConfigError(ValueError):
    """All that is wrong with a configuration, a line for each."""


@dataclass
class Config:
    project_name: str = "project"
    project_root: str = "."
    source_roots: list[str] = field(default_factory=lambda: ["."])
    output_dir: str = "target/vellum"
    exclude: list[str] = field(default_factory=lambda: list(EXCLUDE))
    lint_report: str | None = None
    lint_command: str | None = None
    external_modules: list[str] = field(default_factory=list)
    external_types: list[str] = field(default_factory=list)
    boundary: dict = field(default_factory=lambda: dict(BOUNDARY))
    suppressions: list[dict] = field(default_factory=list)
    thresholds: dict = field(default_factory=lambda: dict(THRESHOLDS))
    path: str | None = None


_KEYS = {
    "$schema": str, "project_name": str, "project_root": str, "output_dir": str, "qmllint_report": str, "qmllint_command": str,
    "source_roots": list, "exclude": list, "external_modules": list, "external_types": list, "process_boundary": dict, "suppressions": list, "thresholds": dict,
}


def without_comments(text: str) -> str:
    return re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m.group(1) or " ", text, flags=re.S)


def _strings(value: object) -> bool:
    return isinstance(value, list) and all(isinstance(x, str) for x in value)


def validate(raw: object) -> dict:
    """The raw configuration, or ConfigError with every fault."""
    if not isinstance(raw, dict):
        raise ConfigError("the configuration is not an object")
    faults = [f"unknown key {k}" for k in raw if k not in _KEYS]
    faults += [f"{k} is not of type {kind.__name__}" for k, kind in _KEYS.items() if k in raw and raw[k] is not None and not isinstance(raw[k], kind)]
    faults += [f"{k} is not a list of strings" for k in ("source_roots", "exclude", "external_modules", "external_types") if isinstance(raw.get(k), list) and not _strings(raw[k])]
    boundary = raw.get("process_boundary")
    for k, value in boundary.items() if isinstance(boundary, dict) else ():
        if k not in BOUNDARY or not _strings(value):
            faults.append(f"process_boundary.{k} is unknown or not a list of strings")
        elif k != "objectTypes":
            for pattern in value:
                try:
                    re.compile(pattern)
                except re.error as e:
                    faults.append(f"process_boundary.{k}: {pattern}: {e}")
    limits = raw.get("thresholds")
    for k, value in limits.items() if isinstance(limits, dict) else ():
        if k not in THRESHOLDS or isinstance(value, bool) or not isinstance(value, (int, float)) or value <= 0:
            faults.append(f"thresholds.{k} is unknown or not a positive number")
        elif k == "cloneWindow" and (int(value) != value or value < 2):
            faults.append("thresholds.cloneWindow is not a whole number of 2 or more")
    for i, s in enumerate(raw.get("suppressions") if isinstance(raw.get("suppressions"), list) else ()):
        if not isinstance(s, dict) or not set(s) <= {"id", "kind", "file", "reason"} or not any(s.get(k) for k in ("id", "kind", "file")) or not all(isinstance(x, str) for x in s.values()):
            faults.append(f"suppressions[{i}] needs an id, kind or file, all of them strings")
    if faults:
        raise ConfigError("; ".join(faults))
    return raw


def load(path: str | None) -> Config:
    """Relative paths count from the configuration's folder, then from the project's root. A missing file gives defaults."""
    file = Path(path or "vellum.config.json").resolve()
    raw = validate(json.loads(without_comments(file.read_text("utf-8"))) if file.exists() else {})
    root = (file.parent / (raw.get("project_root") or ".")).resolve()
    at = lambda p: str((root / p).resolve())
    return Config(
        project_name=raw.get("project_name") or root.name,
        project_root=str(root),
        source_roots=[at(p) for p in raw.get("source_roots") or ["."]],
        output_dir=at(raw.get("output_dir") or "target/vellum"),
        exclude=raw["exclude"] if raw.get("exclude") is not None else list(EXCLUDE),
        lint_report=at(raw["qmllint_report"]) if raw.get("qmllint_report") else None,
        lint_command=raw.get("qmllint_command"),
        external_modules=raw.get("external_modules") or [],
        external_types=raw.get("external_types") or [],
        boundary=BOUNDARY | (raw.get("process_boundary") or {}),
        suppressions=raw.get("suppressions") or [],
        thresholds=THRESHOLDS | (raw.get("thresholds") or {}),
        path=str(file),
    )


def starter() -> dict:
    return {"project_name": "my-project", "project_root": ".", "source_roots": ["."], "output_dir": "target/vellum", "qmllint_report": "target/qmllint.json", "qmllint_command": "qmllint .", "external_modules": [], "external_types": [], "process_boundary": BOUNDARY, "exclude": EXCLUDE, "thresholds": THRESHOLDS}
