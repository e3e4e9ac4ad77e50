"""Reading one source file: tokens, object tree, bindings, references, functions. Plain Python, no Spark.

The grammar is the tolerant one that the SURVEY describes: whatever can't be read is skipped a token at a time, and
attached groups (`Layout {`, `Component {`) are prefixes of members, never objects.
"""

from __future__ import annotations

import posixpath
import re
import sys

_TOKEN = re.compile(
    r"""(?P<skip>[\s\ufeff]+|//[^\n]*|/\*.*?\*/)|(?P<open>/\*.*)|(?P<identifier>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<number>[0-9][0-9._a-fA-FxX]*)"""
    r"""|(?P<string>"(?:\\.|[^"\\])*(?:"|\\\Z)?|'(?:\\.|[^'\\])*(?:'|\\\Z)?|`(?:\\.|[^`\\])*(?:`|\\\Z)?)|(?P<symbol>.)""",
    re.S,
)
ATTACHED = frozenset("Layout Component Keys Accessible Drag KeyNavigation Universal Palette Material".split())
JOINING = frozenset(".?:,+-*/%=!<>&|^")
RESERVED = frozenset(
    "while void var undefined typeof true this switch signal return required readonly property pragma of null new let "
    "instanceof in import if function for false else default continue const catch case break as".split()
)
LOCAL_WORDS = frozenset(("const", "let", "var", "function"))
_HANDLER = re.compile(r"on[A-Z]")
_OPEN, _CLOSE = {"(": 0, "[": 1, "{": 2}, {")": 0, "]": 1, "}": 2}


def tokenize(text: str) -> list[tuple[str, str, int, int, int]]:
    """(kind, value, start, end, line)"""
    out, line = [], 1
    for m in _TOKEN.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "skip":
            line += value.count("\n")
        elif kind == "open":
            out.append(("symbol", "/*unclosed*/", m.start(), m.end(), line))
        else:
            out.append((kind, value, m.start(), m.end(), line))
            if kind == "string":
                line += value.count("\n")
    return out


def strip_code(text: str, strings: bool = False) -> str:
    """Comments, and the insides and quotes of strings if asked for, become blanks; offsets and lines stay."""

    def blank(m: re.Match) -> str:
        s = m.group()
        if s[0] == "/" or strings:
            return re.sub(r"[^\n]", " ", s)
        return s

    return _BLANKED.sub(blank, text) if _MARKS.search(text) else text


_MARKS = re.compile(r"""["'`/]""")
_BLANKED = re.compile(r"""//[^\n]*|/\*.*?\*/|/\*.*|"(?:\\.|[^"\\])*(?:"|\\\Z)?|'(?:\\.|[^'\\])*(?:'|\\\Z)?|`(?:\\.|[^`\\])*(?:`|\\\Z)?""", re.S)


class _Reader:
    def __init__(self, text: str) -> None:
        self.text, self.tokens, self.at = text, tokenize(text), 0
        # Columns of the tokens with blanks behind them, as all that reads ahead looks a few tokens beyond the end.
        self.kinds, self.values, self.lines = ([t[n] for t in self.tokens] + [None] * 4 for n in (0, 1, 4))
        self.objects: list[dict] = []
        self.bindings: list[dict] = []
        self.refs: list[dict] = []
        self.imports: list[dict] = []
        self.diagnostics: list[dict] = []
        self.members: dict[str, list[dict]] = {"properties": [], "signals": [], "executables": []}

    # Tokens by index; beyond the end, and before the start, there is a blank one.
    def v(self, i: int) -> str | None:
        return self.values[i]

    def k(self, i: int) -> str | None:
        return self.kinds[i]

    def line(self, i: int) -> int | None:
        return self.lines[i]

    def complain(self, line: int, message: str) -> None:
        self.diagnostics.append({"line": line, "message": message})

    def path(self, i: int) -> tuple[list[str], int] | None:
        """Dotted identifiers at i and the index behind them."""
        kinds, values = self.kinds, self.values
        if kinds[i] != "identifier":
            return None
        names, i = [values[i]], i + 1
        while values[i] == "." and kinds[i + 1] == "identifier":
            names.append(values[i + 1])
            i += 2
        return names, i

    def object_at(self, i: int) -> bool:
        if self.kinds[i] != "identifier" or self.values[i + 1] not in ("{", "."):
            return False
        p = self.path(i)
        return bool(p) and self.v(p[1]) == "{" and "A" <= p[0][0][0] <= "Z" and not self._attached(p[0])

    @staticmethod
    def _attached(names: list[str]) -> bool:
        return names[0] in ATTACHED or ".".join(names) in ATTACHED

    def group_at(self, i: int) -> tuple[str, int] | None:
        p = self.path(i)
        if not p or self.v(p[1]) != "{" or not (re.match("[a-z_]", p[0][0]) or self._attached(p[0])):
            return None
        return ".".join(p[0]), p[1]

    def binding_at(self, i: int) -> tuple[list[str], int] | None:
        p = self.path(i)
        return p if p and self.v(p[1]) == ":" else None

    def named(self, i: int, word: str) -> bool:
        return self.v(i) == word and self.k(i + 1) == "identifier"

    def property_at(self, i: int) -> bool:
        return self.v(i) == "property" or self.v(i) in ("readonly", "required") and self.v(i + 1) == "property"

    def member_at(self, i: int) -> bool:
        if self.kinds[i] != "identifier":
            return False
        return self.property_at(i) or self.named(i, "signal") or self.named(i, "function") or self.binding_at(i) is not None or self.group_at(i) is not None or self.object_at(i)

    def line_end(self, i: int) -> int:
        line = self.line(i)
        while i < len(self.tokens) and self.line(i) == line:
            i += 1
        return i

    def top_level(self, i: int, symbol: str, limit: int) -> int | None:
        depth = [0, 0, 0]
        for j in range(i, limit):
            value = self.v(j)
            if value == symbol and not any(depth):
                return j
            if value in _OPEN:
                depth[_OPEN[value]] += 1
            elif value in _CLOSE:
                depth[_CLOSE[value]] = max(0, depth[_CLOSE[value]] - 1)
        return None

    def closing(self, i: int) -> int | None:
        depth = 0
        for j in range(i, len(self.tokens)):
            depth += {"{": 1, "}": -1}.get(self.v(j), 0)
            if not depth and self.v(j) == "}":
                return j
        return None

    def skip_statement(self, i: int) -> None:
        line = self.line(i)
        while self.at < len(self.tokens) and self.line(self.at) == line and self.v(self.at) != ";":
            self.at += 1
        if self.v(self.at) == ";":
            self.at += 1

    def read(self) -> None:
        self.header()
        root = next((i for i in range(self.at, len(self.tokens)) if self.object_at(i)), None)
        if root is not None:
            self.object(root, None, 1)
        elif self.tokens:
            self.complain(self.line(0), "No root QML object found")
        ids = {o["id_name"]: o["object_id"] for o in self.objects if o["id_name"]}
        for r in self.refs:
            r["target"] = ids.get(r["name"])
            r["external"] = r["target"] is not None and r["target"] != r["owner"]

    def header(self) -> None:
        while self.v(self.at) in ("import", "pragma"):
            line = self.line(self.at)
            if self.v(self.at) == "import":
                self._import(line)
            while self.at < len(self.tokens) and self.line(self.at) == line:
                self.at += 1

    def _import(self, line: int) -> None:
        first = self.at + 1
        if self.k(first) == "string":
            raw = self.v(first)
            module, after, version = raw[1:-1] if len(raw) > 1 and raw[0] == raw[-1] else raw, first + 1, None
        else:
            p = self.path(first)
            if p is None:
                self.complain(line, "Import declaration is missing a module path")
                return
            module, after = ".".join(p[0]), p[1]
            version = self.v(after) if self.k(after) == "number" else None
            after += version is not None
        alias = None
        while self.line(after) == line:
            if self.v(after) == "as":
                alias = self.v(after + 1) if self.k(after + 1) == "identifier" else None
                break
            after += 1
        self.imports.append({"module": module, "version": version, "alias": alias, "line": line})

    def object(self, i: int, parent: dict | None, depth: int) -> None:
        names, brace = self.path(i)
        line = self.line(i)
        o = {"object_id": len(self.objects) + 1, "parent_id": parent and parent["object_id"], "type": ".".join(names), "line": line, "end_line": line, "depth": depth, "id_name": None}
        self.objects.append(o)
        self.at = brace + 1
        end = self.block(o, None, depth + 1)
        if end is None:
            self.complain(line, f"Unclosed {o['type']} object")
        else:
            o["end_line"] = end

    def block(self, o: dict, prefix: str | None, depth: int) -> int | None:
        """Members up to the closing brace, whose line is returned."""
        while self.at < len(self.tokens):
            if self.v(self.at) == "}":
                self.at += 1
                return self.line(self.at - 1)
            if not self.member(o, prefix, depth):
                self.at += 1
        return None

    def member(self, o: dict, prefix: str | None, depth: int) -> bool:
        i = self.at
        dotted = lambda name: f"{prefix}.{name}" if prefix else name
        if self.v(i) in (";", ","):
            self.at += 1
        elif self.named(i, "function"):
            self.function(o)
        elif self.named(i, "signal"):
            self.members["signals"].append({"owner": o["object_id"], "name": self.v(i + 1), "line": self.line(i)})
            self.skip_statement(i)
        elif self.property_at(i):
            self.property(o, prefix)
        elif group := self.group_at(i):
            self.at = group[1] + 1
            name = dotted(group[0])
            if self.block(o, name, o["depth"] + 1) is None:
                self.complain(self.line(group[1]), f"Unclosed {name} grouped property scope")
        elif p := self.binding_at(i):
            name = dotted(".".join(p[0]))
            b = self.binding(o, name, p[1])
            if _HANDLER.match(p[0][-1]):
                self.members["executables"].append({"owner": o["object_id"], "kind": "signal_handler", "name": name, "line": b["line"], "body": b["expression"]})
        elif self.object_at(i):
            self.object(i, o, depth)
        else:
            return False
        return True

    def property(self, o: dict, prefix: str | None) -> None:
        i, end = self.at, self.line_end(self.at)
        colon, stop = self.top_level(i, ":", end), self.top_level(i, ";", end)
        if colon is not None and stop is not None and stop < colon:
            colon = None
        until = end if colon is None else colon
        name = next((self.v(j) for j in range(until - 1, i - 1, -1) if self.k(j) == "identifier"), None)
        full = f"{prefix}.{name}" if prefix and name else name
        if full:
            self.members["properties"].append({"owner": o["object_id"], "name": full, "line": self.line(i), "alias": any(self.v(j) == "alias" for j in range(i, until))})
        if colon is None:
            self.skip_statement(i)
        else:
            self.binding(o, full or f"{prefix + '.' if prefix else ''}property", colon)

    def function(self, o: dict) -> None:
        i, name = self.at, self.v(self.at + 1)
        brace = self.top_level(i, "{", len(self.tokens))
        if brace is None:
            self.complain(self.line(i), f"Function {name} is missing a body")
            self.skip_statement(i)
            return
        end = self.closing(brace)
        stop = len(self.tokens) if end is None else end
        own = set()
        j = next((j for j in range(i, brace) if self.v(j) == "("), None)
        while j is not None and j + 1 < brace and self.v(j + 1) != ")":
            j += 1
            if self.k(j) == "identifier" and self.v(j - 1) in ("(", ","):
                own.add(self.v(j))
        own |= {self.v(j + 1) for j in range(brace + 1, stop) if self.v(j) in LOCAL_WORDS and self.k(j + 1) == "identifier"}
        for j in range(brace + 1, stop):
            if self.v(j) not in own:
                self.refer(o, j)
        body = self.text[self.tokens[brace][2] : len(self.text) if end is None else self.tokens[end][3]]
        self.members["executables"].append({"owner": o["object_id"], "kind": "qml_function", "name": name, "line": self.line(i), "body": body})
        if end is None:
            self.complain(self.line(i), f"Function {name} has an unclosed body")
        self.at = len(self.tokens) if end is None else end + 1

    def binding(self, o: dict, name: str, colon: int) -> dict:
        known, first = len(self.refs), colon + 1
        text, stop = self.expression(o, first, name != "id")
        b = {"owner": o["object_id"], "path": name, "line": self.line(colon), "expression": text.strip("\ufeff \t\n\r\x0b\x0c\xa0"), "refs": self.refs[known:]}
        self.bindings.append(b)
        if name == "id":
            o["id_name"] = next((self.v(j) for j in range(first, stop) if self.k(j) == "identifier"), None)
        return b

    def expression(self, o: dict, first: int, refer: bool) -> tuple[str, int]:
        i, count, kinds, values, lines = first, len(self.tokens), self.kinds, self.values, self.lines
        while values[i] == ";":
            i += 1
        start = i if i < count else first
        depth, before = [0, 0, 0], i
        while i < count:
            value = values[i]
            if not any(depth):
                if value in (";", "}"):
                    break
                if i > first and lines[i] != lines[before] and self.member_at(i) and not (values[before] in JOINING or value in JOINING):
                    break
            if kinds[i] == "identifier":
                if not depth[2] and self.object_at(i):
                    self.object(i, o, o["depth"] + 1)
                    i = self.at
                    before = i - 1
                    continue
                if refer:
                    self.refer(o, i)
            if value in _OPEN:
                depth[_OPEN[value]] += 1
            elif value in _CLOSE:
                depth[_CLOSE[value]] = max(0, depth[_CLOSE[value]] - 1)
            before = i
            i += 1
        if any(depth):
            self.complain(self.line(start) or 1, "Expression ended with unmatched delimiter")
        self.at = i + (self.v(i) == ";")
        if start >= len(self.tokens):
            return "", i
        last = min(max(first, i - 1), len(self.tokens) - 1)
        return self.text[self.tokens[start][2] : self.tokens[last][3]], i

    def refer(self, o: dict, i: int) -> None:
        name, before = self.values[i], self.values[i - 1]
        if self.kinds[i] != "identifier" or name in RESERVED or before == "." or before in LOCAL_WORDS:
            return
        if self.values[i + 1] == ":" and before in ("{", ",", "("):
            return
        self.refs.append({"owner": o["object_id"], "name": name, "line": self.lines[i], "target": None, "external": False})


_JS_FUNCTION = re.compile(r"\bfunction\s+([A-Za-z_]\w*)\s*\([^)]*\)\s*\{", re.A)
_JS_ARROW = re.compile(r"\b(?:const|let|var)\s+([A-Za-z_]\w*)\s*=\s*(?:\([^)]*\)|[A-Za-z_]\w*)\s*=>\s*\{", re.A)
_BRACE_OR_STRING = re.compile(r"""[{}]|"(?:\\.|[^"\\])*(?:"|\\?\Z)|'(?:\\.|[^'\\])*(?:'|\\?\Z)|`(?:\\.|[^`\\])*(?:`|\\?\Z)""", re.S)


def brace_block(text: str, start: int) -> str:
    """From an opening brace to its match; braces in strings don't count."""
    depth = 0
    for m in _BRACE_OR_STRING.finditer(text, start):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if not depth and m.group() == "}":
            return text[start : m.end()]
    return text[start:]


def script_functions(text: str, kind: str) -> list[dict]:
    out = []
    for pattern in (_JS_FUNCTION, _JS_ARROW) if kind == "js" else (_JS_FUNCTION,):
        for m in pattern.finditer(text):
            out.append({"owner": None, "kind": "js_function", "name": m.group(1), "line": text.count("\n", 0, m.start()) + 1, "body": brace_block(text, m.end() - 1)})
    return out


def normal_path(base: str, value: str) -> str:
    joined = value if base in (".", "") else posixpath.join(base, value)
    out = posixpath.normpath(joined) if joined else "."
    return "" if out == "." else out.lstrip("/") if out.startswith("//") else out


def qmldir_entries(path: str, text: str) -> tuple[str | None, list[dict]]:
    """Module name (the last one given) and component entries, with the files they name."""
    module, entries = None, []
    for number, line in enumerate(re.split(r"\r?\n", text), 1):
        parts = re.sub(r"//.*$", "", re.sub("#.*", "", line)).split()
        if not parts:
            continue
        if parts[0] == "module":
            module = parts[1] if len(parts) > 1 else None
            continue
        if parts[0] in ("plugin", "classname", "typeinfo", "depends", "prefer", "designersupported"):
            continue
        rest = parts[1:] if parts[0] in ("singleton", "internal") else parts
        file = next((p for p in rest[1:] if p.lower().endswith(".qml")), rest[1] if len(rest) > 1 else None)
        if rest and file:
            entries.append({"name": rest[0], "file": normal_path(posixpath.dirname(path) or ".", file), "line": number, "public": parts[0] != "internal", "singleton": parts[0] == "singleton"})
    return module, entries


def read_source(path: str, kind: str, text: str) -> dict:
    """All records of one file as plain lists."""
    out = {"code": strip_code(text), "module": None, "entries": [], **{k: [] for k in ("imports", "objects", "bindings", "properties", "signals", "executables", "refs", "diagnostics")}}
    if kind == "qmldir":
        out["module"], out["entries"] = qmldir_entries(path, text)
    if kind != "qml":
        out["executables"] = script_functions(text, kind)
    else:
        reader, limit = _Reader(text), sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 20_000))
        try:
            reader.read()
        except RecursionError:
            reader.complain(1, "Objects are nested too deeply")
        finally:
            sys.setrecursionlimit(limit)
        # Per object first its functions, then its handlers.
        reader.members["executables"].sort(key=lambda e: (e["owner"], e["kind"] == "signal_handler"))
        out |= {"imports": reader.imports, "objects": reader.objects, "bindings": reader.bindings, "refs": reader.refs, "diagnostics": reader.diagnostics, **reader.members}
        folder = posixpath.dirname(path) or "."
        for i in out["imports"]:
            i["candidate"] = normal_path(folder, i["module"])
        for b in out["bindings"]:
            b["code"] = strip_code(b["expression"], True)
    for e in out["executables"]:
        e["code"] = strip_code(e["body"], True)
        e["lines"] = max(1, len(re.split(r"\r?\n", e["body"])))
    return out
