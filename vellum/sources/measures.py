"""What the records of one file say without any other file. Plain Python, no Spark; patterns are those of functions/text.py."""

from __future__ import annotations

import re

from ..functions import text as X

_DECISIONS, _CYCLOMATIC, _STEPS, _COLORS, _STYLE_NUMBERS = (re.compile(p, re.A) for p in (X.DECISIONS, X.CYCLOMATIC, X.STEPS, X.COLORS, X.STYLE_NUMBERS))
_BREAK = re.compile(r"\r?\n")
#: White space of any script, and byte order marks.
_WHITE = "\t\n\x0b\x0c\r \x85\xa0                　﻿"
_HANDLER = re.compile(r"on[A-Z]")
_ASSIGNED = re.compile(r"\b([A-Za-z_][A-Za-z0-9_]*)(?:\.([A-Za-z_][A-Za-z0-9_]*))?\s*=(?![=>])(?!\s*Qt\.binding\s*\()", re.A)
_DECLARES = re.compile(r"\b(?:const|let|var|property)\s{1,12}\Z", re.A)
_ATTACHED = frozenset(("Component", "Keys", "Accessible", "Layout", "anchors"))
_FIRST = re.compile(r"(?<![A-Za-z0-9_$.])[A-Za-z_$][A-Za-z0-9_$]*")
_PATH = re.compile(r"(?<![A-Za-z0-9_])([A-Za-z_$][A-Za-z0-9_$]*)(?=\s*\.\s*([A-Za-z_][A-Za-z0-9_]*(?:\s*\.\s*[A-Za-z_][A-Za-z0-9_]*)*))", re.A)
_SPACES = re.compile(r"\s+", re.A)


def leaf(path: str) -> str:
    return path.rpartition(".")[2]


def is_handler(path: str) -> bool:
    return bool(_HANDLER.match(leaf(path)))


def utf16_length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + sum(c > "￿" for c in text)


def line_counts(text: str, code: str) -> dict:
    raw = [x.strip(_WHITE) for x in _BREAK.split(text)]
    blank, comment = raw.count(""), 0
    if code != text:
        plain = [x.strip(_WHITE) for x in _BREAK.split(code)]
        comment = sum(a != "" and (i >= len(plain) or plain[i] == "") for i, a in enumerate(raw))
    return {"physical": len(raw), "source": len(raw) - blank - comment, "blank": blank, "comment": comment}


def cyclomatic(code: str) -> int:
    return 1 + sum(1 for _ in _CYCLOMATIC.finditer(code))


def nesting(code: str) -> tuple[int, int]:
    """(cognitive, deepest), as text.nesting has them."""
    depth = deepest = cognitive = 0
    for t in _STEPS.findall(code):
        if t == "{":
            depth += 1
            deepest = max(deepest, depth)
        elif t == "}":
            depth = max(depth - 1, 0)
        elif t == "return":
            cognitive += depth > 1
        else:
            cognitive += 1 + max(depth - 1, 0)
    return cognitive, deepest


def binding_complexity(code: str) -> int:
    return 1 + sum(1 for _ in _DECISIONS.finditer(code)) + max(code.count(".") - 2, 0)


def measures(record: dict, process_types: frozenset[str]) -> dict:
    """Numbers of a component, but for those that configured patterns give."""
    objects, bindings, executables = record["objects"], record["bindings"], record["executables"]
    outside = [r["name"] for r in record["refs"] if r["external"]]
    efforts = cognitive_sum = max_cyclomatic = max_cognitive = 0
    for e in executables:
        cyc, cog = cyclomatic(e["code"]), nesting(e["code"])[0]
        efforts += int(e["lines"] * 0.7 + cyc * 1.5 + cog * 2 + 0.5)
        cognitive_sum += cog
        max_cyclomatic, max_cognitive = max(max_cyclomatic, cyc), max(max_cognitive, cog)
    own = [p["alias"] for p in record["properties"] if p["owner"] == 1]
    return {
        "root_type": objects[0]["type"] if objects else None, "line": objects[0]["line"] if objects else 1, "loc": line_counts(record["text"] or "", record["code"]),
        "object_count": len(objects), "max_depth": max((o["depth"] for o in objects), default=0), "public_properties": own.count(False), "aliases": own.count(True),
        "signals": sum(s["owner"] == 1 for s in record["signals"]), "functions": sum(e["kind"] == "qml_function" for e in executables), "handlers": sum(e["kind"] == "signal_handler" for e in executables),
        "bindings": len(bindings), "ids_declared": sum(o["id_name"] is not None for o in objects), "id_reference_count": len(outside), "distinct_id_references": len(set(outside)),
        "hardcoded_colors": sum(1 for _ in _COLORS.finditer(record["code"])), "numeric_style_literals": sum(1 for _ in _STYLE_NUMBERS.finditer(record["code"])),
        "process_objects": sum(o["type"] in process_types or leaf(o["type"]) in process_types for o in objects),
        "executables": len(executables), "efforts": efforts, "cognitive": cognitive_sum, "max_cyclomatic": max_cyclomatic, "max_cognitive": max_cognitive,
        "binding_sum": sum(binding_complexity(b["code"]) for b in bindings),
    }


def shapes(record: dict) -> list[dict]:
    """Objects with what their own bindings place or set."""
    out = {}
    for o in record["objects"]:
        out[o["object_id"]] = {"object_id": o["object_id"], "type": o["type"], "line": o["line"], **dict.fromkeys(("anchors", "layout", "geometry", "active", "source_size", "script"), False)}
    for b in record["bindings"]:
        o, path = out[b["owner"]], b["path"]
        if path.startswith("anchors."):
            o["anchors"] = True
        elif path.startswith("Layout."):
            o["layout"] = True
        elif path.startswith("sourceSize."):
            o["source_size"] = True
        elif path in ("x", "y", "width", "height"):
            o["geometry"] = True
        elif path == "active":
            o["active"] = True
        if not o["script"] and leaf(o["type"]).endswith("Delegate"):
            o["script"] = utf16_length(b["expression"]) > 120 or sum(1 for _ in _DECISIONS.finditer(b["code"])) >= 2
    return list(out.values())


def idle(record: dict) -> list[dict]:
    """Objects with an id, other than root, that no reference reaches."""
    reached = {r["target"] for r in record["refs"]}
    return [{"id_name": o["id_name"], "line": o["line"]} for o in record["objects"] if o["id_name"] not in (None, "root") and o["object_id"] not in reached]


def assigned(expression: str) -> list[tuple[str | None, str]]:
    """(object or none, property) of each assignment; declarations, attached names and Qt.binding() aside."""
    out, at = [], 0
    while m := _ASSIGNED.search(expression, at):
        if _DECLARES.search(expression[max(0, m.start() - 21) : m.start()]):
            # A name that is declared; the search goes on behind its first letter.
            at = m.start() + 1
            continue
        at = m.end()
        by, prop = (m.group(1), m.group(2)) if m.group(2) else (None, m.group(1))
        if (by or prop) not in _ATTACHED:
            out.append((by, prop))
    return out


def losses(record: dict) -> list[dict]:
    """Assignments in handlers that end a binding, in order."""
    plain, ids, out = set(), {o["id_name"]: o["object_id"] for o in record["objects"] if o["id_name"] is not None}, []
    handlers = []
    for b in record["bindings"]:
        if is_handler(b["path"]):
            handlers.append(b)
        else:
            plain.add((b["owner"], leaf(b["path"])))
    for b in handlers:
        for by, prop in assigned(b["expression"]):
            if (b["owner"] if by is None else ids.get(by), prop) in plain:
                out.append({"line": b["line"], "by": by, "prop": prop})
    return out


def edges(record: dict) -> list[tuple[str, str]]:
    """(src, dst), nodes as `object:property`: bindings that read a property bound in the same object, or one of an object named by id."""
    own = [b for b in record["bindings"] if not is_handler(b["path"])]
    here: dict[tuple[int, str], set[str]] = {}
    known = {(b["owner"], b["path"]) for b in record["bindings"]} | {(p["owner"], p["name"]) for p in record["properties"]}
    for b in own:
        here.setdefault((b["owner"], b["path"].partition(".")[0]), set()).add(f"{b['owner']}:{b['path']}")
    found: dict[tuple[str, str], None] = {}
    for b in own:
        src = f"{b['owner']}:{b['path']}"
        for first in set(_FIRST.findall(b["code"])):
            for dst in here.get((b["owner"], first), ()):
                found[src, dst] = None
        foreign: dict[str, set[int]] = {}
        for r in b["refs"]:
            if r["target"] is not None and r["target"] != b["owner"]:
                foreign.setdefault(r["name"], set()).add(r["target"])
        if not foreign:
            continue
        for name, rest in set(_PATH.findall(b["expression"])):
            seg = _SPACES.sub("", rest).split(".")
            for target in foreign.get(name, ()):
                prop = next((k for n in range(len(seg), 0, -1) if (target, k := ".".join(seg[:n])) in known), seg[0])
                found[src, f"{target}:{prop}"] = None
    return list(found)
