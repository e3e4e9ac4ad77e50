"""Column functions over source text. Word boundaries are ASCII ones, whatever Java's \\b says."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
DECISIONS = r"\?|&&|\|\||\b(?:if|for|while|switch)\b"
CYCLOMATIC = r"\b(?:if|for|while|case|catch)\b|\?|&&|\|\|"
STEPS = r"\bif\b|\belse\s+if\b|\bfor\b|\bwhile\b|\bswitch\b|\bcase\b|\bcatch\b|\breturn\b|[{}?]|&&|\|\|"
COLORS = r"#[0-9a-fA-F]{3,8}\b|\bQt\.rgba\s*\("
STYLE_NUMBERS = r"\b(?:padding|margins?|spacing|radius|implicitHeight|implicitWidth|height|width|font\.pixelSize)\s*:\s*[0-9]+(?:\.[0-9]+)?\b"


def ascii_words(pattern: str) -> str:
    """The pattern with each \\b an ASCII boundary, and \\w and \\d ASCII as in Java anyway."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(_BOUNDARY if pattern[i + 1] == "b" else pattern[i : i + 2])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(ascii_words(pattern)))


def found(text: Column, pattern: str) -> Column:
    return text.rlike(ascii_words(pattern))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(ascii_words(pattern)), F.lit(group))


def trimmed(text: Column) -> Column:
    """Without white space of any script, or byte order marks, at both ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n", -1)


def rounded(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("int")


def bounded(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(100), rounded(x)))


def utf16_length(text: Column) -> Column:
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def line_counts(text: Column, code: Column) -> Column:
    """struct<physical,source,blank,comment>: code is text with its comments blanked."""
    raw, plain = F.transform(lines(text), trimmed), F.transform(lines(code), trimmed)
    blank = F.size(F.filter(raw, lambda x: x == ""))
    comment = F.size(F.filter(F.arrays_zip(raw.alias("a"), plain.alias("b")), lambda z: (z["a"] != "") & (F.coalesce(z["b"], F.lit("")) == "")))
    return F.struct(F.size(raw).alias("physical"), (F.size(raw) - blank - comment).alias("source"), blank.alias("blank"), comment.alias("comment"))


def cyclomatic(code: Column) -> Column:
    return 1 + count(code, CYCLOMATIC)


def nesting(code: Column) -> Column:
    """struct<depth,deepest,cognitive>, a fold over braces and decisions."""
    state = "struct<depth:int,deepest:int,cognitive:int>"

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t == "{", s["depth"] + 1).when(t == "}", F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        gain = F.when(t.isin("{", "}"), 0).when(t == "return", F.when(s["depth"] > 1, 1).otherwise(0)).otherwise(1 + F.greatest(s["depth"] - 1, F.lit(0)))
        return F.struct(depth.alias("depth"), F.greatest(s["deepest"], depth).alias("deepest"), (s["cognitive"] + gain).alias("cognitive")).cast(state)

    zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("deepest"), F.lit(0).alias("cognitive")).cast(state)
    return F.aggregate(matches(code, STEPS), zero, step)


def binding_complexity(code: Column) -> Column:
    return 1 + count(code, DECISIONS) + F.greatest(F.regexp_count(code, F.lit(r"\.")) - 2, F.lit(0))


def clone_line(line: Column) -> Column:
    out = F.regexp_replace(line, ascii_words(r"#[0-9a-fA-F]{3,8}\b"), "#COLOR")
    out = F.regexp_replace(out, r""""(?:\\.|[^"])*"|'(?:\\.|[^'])*'""", "STR")
    return trimmed(F.regexp_replace(out, ascii_words(r"\b[0-9]+(?:\.[0-9]+)?\b"), "NUM"))


def leaf(path: Column) -> Column:
    return F.substring_index(path, ".", -1)


def folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def is_handler(path: Column) -> Column:
    return leaf(path).rlike("^on[A-Z]")


def signal_of(name: Column) -> Column:
    last = leaf(name)
    return F.concat(F.lower(F.substring(last, 3, 1)), F.substring(last, 4, 1 << 20))
