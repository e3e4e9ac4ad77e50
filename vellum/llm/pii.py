"""Operator 4: personal data by rules and boosted candidates, in DataFrame functions only.

Rules give e-mail addresses, IP addresses, card and telephone numbers. Generators of high recall propose further spans,
which may overlap; boosted trees judge each by its format and by the words before it, and those whose calibrated
probability reaches a threshold are added. The trees are fitted on a bounded, generated set of labelled rows
(TRAIN_ROWS) and enter the query as one expression.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Labelled rows that the trees are fitted and calibrated on: the documented bound of the sample.
TRAIN_ROWS = 6000
PRECISION = 0.99
#: Spans put together at once; their positions are running sums.
STEP = 128
#: Characters before a candidate that count as its context.
CONTEXT = 24

# A run of an address's characters is tried from its first character on, or from where the last match ended: later
# starts in it can't match if that one doesn't. Possessive repeats give the same matches without going back.
_BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SIGN = {"email": "@", "ip": ".", "card": "", "phone": "+"}
_GENERATORS = {
    # Every run of 12 characters; right after a credential's name and an assignment every run.
    "secret": r"(?<![A-Za-z0-9_+/-])(?:[A-Za-z0-9_+/-]{12,}+|(?<=[=:][\x20\t]?[\"']?)(?<=(?i:password|passwd|pwd|secret|token|api[_\x20-]?key|access[_\x20-]?key|credential|auth)[^\n]{0,8})[A-Za-z0-9_+/-]++)",
    "contact": r"(?<![0-9+])\(?[0-9][\x20().0-9-]{6,}[0-9]",
}
FORMAT = ("digits", "upper", "lower", "mixed", "long", "very_long", "grouped", "many_digits", "hex", "capitals")
NEAR = ("near_secret", "near_contact", "assigned", "quoted")
FEATURES = [*FORMAT, *NEAR]
_NEAR_SECRET = r"(?i)(?:password|passwd|pwd|secret|token|api[_ -]?key|access[_ -]?key|credential|auth)[^\n]{0,8}$"
_NEAR_CONTACT = r"(?i)(?:tel|phone|mobile|fax|ssn|passport|iban|social security)[^\n]{0,8}$"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), which is evaluated once, however often and in whatever lambda `use` names it."""
    return F.transform(F.array(value), use)[0]


def _spans(text: Column, pattern: str, context: int = 0) -> Column:
    """array<struct<start,end int, match string>> of a pattern's matches, in code points; with a context also `before`, as many characters before each.

    Matches and what lies between them alternate, so that positions are running sums of their lengths. They are summed
    in steps, a step's start being the sum of those before, which keeps a text of very many matches from copying its
    list for each.
    """
    row = f"struct<start:int,end:int,match:string{',before:string' if context else ''}>"
    tail = ",tail:string" if context else ""
    inner = f"struct<at:int,out:array<{row}>{tail}>"
    outer = f"struct<at:int,out:array<array<{row}>>{tail}>"
    last = lambda *parts: F.substring(F.concat(*parts), -context, context)

    def one(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.char_length(p["gap"])
        found = [start.alias("start"), (start + F.char_length(p["match"])).alias("end"), p["match"].alias("match")]
        if context:
            found.append(last(acc["tail"], p["gap"]).alias("before"))
        return _once(F.struct(*found), lambda s: F.struct(s["end"].alias("at"), F.array_append(acc["out"], s).alias("out"), *([last(s["before"], s["match"]).alias("tail")] if context else [])).cast(inner))

    def step(pairs: Column, acc: Column, k: Column) -> Column:
        held = [acc["at"].alias("at"), F.array().cast(f"array<{row}>").alias("out"), *([acc["tail"].alias("tail")] if context else [])]
        done = F.aggregate(F.slice(pairs, k * STEP + 1, F.lit(STEP)), F.struct(*held).cast(inner), one)
        return _once(done, lambda d: F.struct(d["at"].alias("at"), F.array_append(acc["out"], d["out"]).alias("out"), *([d["tail"].alias("tail")] if context else [])).cast(outer))

    def positions(pairs: Column) -> Column:
        steps = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(pairs) / STEP).cast("int") - 1, F.lit(0)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{row}>>").alias("out"), *([F.lit("").alias("tail")] if context else [])).cast(outer)
        return F.flatten(F.aggregate(steps, zero, lambda acc, k: step(pairs, acc, k))["out"])

    pairs = _once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(m)).alias("gap"), m.alias("match")))
    return _once(pairs, positions)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(F.filter(each, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    digits = _digits(match)
    if kind == "card":
        return F.char_length(digits).between(16, 19) & _luhn(digits)
    return F.char_length(digits).between(8, 15)


def _features(match: Column, before: Column) -> Column:
    """The struct of FEATURES of a candidate and the text before it."""
    n = F.char_length(match)
    n_digits = F.char_length(_digits(match))
    made = {
        "digits": n_digits * 4 >= n,
        "upper": match.rlike("[A-Z]"),
        "lower": match.rlike("[a-z]"),
        "mixed": match.rlike("[0-9]") & match.rlike("[A-Za-z]"),
        "long": n >= 16,
        "very_long": n >= 32,
        "grouped": match.rlike(r"^\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}$"),
        "many_digits": n_digits >= 9,
        "hex": match.rlike("^[0-9a-f]+$"),
        "capitals": match.rlike("^[A-Z0-9]+$"),
        "near_secret": before.rlike(_NEAR_SECRET),
        "near_contact": before.rlike(_NEAR_CONTACT),
        "assigned": before.rlike(r"[=:]\s?[\"']?$"),
        "quoted": before.rlike("[\"']$"),
    }
    return F.struct(*(made[f].alias(f) for f in FEATURES))


def features_of(match: str, before: str) -> tuple[int, ...]:
    """The same in Python, for the labelled rows."""
    n, digits = len(match), len(re.sub("[^0-9]", "", match))
    has = lambda p, s=match: re.search(p, s) is not None
    return tuple(
        map(
            int,
            (
                digits * 4 >= n,
                has("[A-Z]"),
                has("[a-z]"),
                has("[0-9]") and has("[A-Za-z]"),
                n >= 16,
                n >= 32,
                has(r"^\(?[0-9]{2,4}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{3,4}$"),
                digits >= 9,
                has("^[0-9a-f]+$"),
                has("^[A-Z0-9]+$"),
                has(_NEAR_SECRET, before),
                has(_NEAR_CONTACT, before),
                has(r"[=:]\s?[\"']?$", before),
                has("[\"']$", before),
            ),
        )
    )


def labelled_rows(n: int = TRAIN_ROWS, seed: int = 7) -> list[tuple[str, str, str, int]]:
    """(generator, candidate, text before it, label): credentials and contact numbers, and look-alikes that are none."""
    r = random.Random(seed)
    pick = lambda s, k: "".join(r.choice(s) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda k: pick(low, k)
    rows = []
    while len(rows) < n:
        kind = r.randrange(14)
        plain = f"{word(5)} {word(4)} "
        if kind == 0:
            rows.append(("secret", pick("0123456789abcdef", r.choice([16, 18, 24, 32, 40])), plain + r.choice(["password=", "pwd: ", "secret = ", "auth=", "token = \"", "api_key = '"]), 1))
        elif kind == 1:
            rows.append(("secret", r.choice(["AKIA", "ASIA", ""]) + pick(up + dig, r.choice([16, 20])), plain, 1))
        elif kind == 2:
            rows.append(("secret", pick(low + up + dig, r.choice([20, 32, 40])), plain + r.choice(["token=", "access key: ", "secret: \"", ""]), 1))
        elif kind == 3:
            rows.append(("contact", f"({pick(dig, 3)}) {pick(dig, 3)}-{pick(dig, 4)}", plain + r.choice(["tel ", "phone: ", ""]), 1))
        elif kind == 4:
            rows.append(("contact", r.choice(["{}-{}-{}", "{} {} {}", "{}.{}.{}"]).format(pick(dig, 3), pick(dig, r.choice([2, 3])), pick(dig, 4)), plain + r.choice(["ssn ", "phone ", "fax: ", "mobile: "]), 1))
        elif kind in (5, 6):
            rows.append(("secret", r.choice([word(r.randint(12, 40)), word(12).capitalize(), word(6) + "-" + word(8), word(7) + "_" + word(7) + "_" + word(4)]), plain + r.choice(["", "", "the password ", "token ", "= "]), 0))
        elif kind == 7:
            rows.append(("secret", r.choice([up, up[:9]])[0] + pick(up, r.randint(11, 24)), plain, 0))
        elif kind == 8:
            rows.append(("secret", r.choice([pick(dig, r.randint(12, 30)), "-" * r.randint(12, 40), "_" * 14, word(9) + "/" + word(6) + "/" + pick(dig, 4), word(10) + pick(dig, r.choice([1, 2, 4])), pick(up, 11) + pick(dig, 2)]), plain, 0))
        elif kind == 9:
            rows.append(("contact", r.choice([f"20{pick(dig, 2)}-{pick(dig, 2)}-{pick(dig, 2)}", pick(dig, r.randint(8, 20)), f"{pick(dig, 4)} - {pick(dig, 4)}", f"{pick(dig, 2)}.{pick(dig, 2)}.20{pick(dig, 2)}"]), plain, 0))
        elif kind == 10:
            rows.append(("contact", " ".join(pick(dig, r.randint(1, 3)) for _ in range(r.randint(4, 9))), plain, 0))
        elif kind == 11:
            name = r.choice(["password=", "pwd: ", "secret = ", "auth=", "token: \"", "api_key = '", "token=\"", "passwd:"])
            rows.append(("secret", r.choice([pick(low, r.randint(6, 30)), pick(low + up, r.randint(6, 30)), pick(low + up + dig, r.randint(6, 11)), word(r.randint(5, 12)).capitalize()]), plain + name, 1))
        elif kind == 12:
            rows.append(("secret", r.choice([word(r.randint(12, 20)), word(12).capitalize(), word(6) + "-" + word(8)]), plain + r.choice(["note: ", "see: \"", "password of ", "token and ", "x = ", "'"]), 0))
        else:
            rows.append(("contact", ".".join(pick(dig, r.randint(1, 3)) for _ in range(r.choice([4, 5]))), plain, 0))
    return rows


@cache
def models(n: int = TRAIN_ROWS, precision: float = PRECISION) -> dict[str, tuple[BoostedTrees, float]]:
    """For each generator trees fitted on two thirds of its rows, calibrated on the rest, and the threshold."""
    out = {}
    for kind in _GENERATORS:
        parts: list[dict] = [{}, {}]
        for i, (g, match, before, label) in enumerate(labelled_rows(n)):
            if g == kind:
                held = parts[i % 3 == 0].setdefault(features_of(match, before), [0, 0])
                held[1 - label] += 1
        fit, rest = ([(x, p, m) for x, (p, m) in sorted(part.items())] for part in parts)
        trees = BoostedTrees().fit(fit).calibrate(rest)
        out[kind] = trees, trees.threshold(rest, precision)
    return out


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start,end,match>> of a rule's valid matches."""
    some = text.contains(_SIGN[kind]) if _SIGN[kind] else F.lit(True)
    if kind in ("ip", "card"):
        some = some & text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){15}")
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    return F.when(some, F.filter(_spans(text, _BASE[kind]), lambda s: _valid(kind, s["match"]))).otherwise(empty)


def _added(text: Column, kind: str, taken: Column) -> Column:
    trees, cut = models()[kind]
    sign = r"[A-Za-z0-9_+/-]{12}|[=:][\x20\t]?[\"']?[A-Za-z0-9_+/-]" if kind == "secret" else r"[0-9][\x20().0-9-]{6}"
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")

    def chosen(taken: Column) -> Column:
        def good(s: Column) -> Column:
            apart = ~F.exists(taken, lambda t: (t["start"] < s["end"]) & (s["start"] < t["end"]))
            return apart & _once(_features(s["match"], s["before"]), lambda f: trees.column(f, FEATURES) >= F.lit(cut))

        return F.transform(F.filter(_spans(text, _GENERATORS[kind], CONTEXT), good), lambda s: F.struct(*(s[k].alias(k) for k in ("start", "end", "match"))))

    return F.when(text.rlike(sign), _once(taken, chosen)).otherwise(empty)


def _joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))


def spans(df: DataFrame, text_col: str = "text", out: str = "pii") -> DataFrame:
    """df with a struct column `out`: an array of (start, end, match) for each of KINDS and each generator.

    Positions are code points, ends exclusive. Null and empty texts have none. Base spans are those of the rules, however
    generators overlap them; a generator's span that overlaps a base span, or one of the generator before, is dropped. Repeated
    rows and other columns are left alone; a column of df named like `out` is replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = df.withColumn(out, F.struct(*(base_spans(text, k).alias(k) for k in KINDS)))
    base = F.flatten(F.array(*(F.col(out)[k] for k in KINDS)))
    for kind in _GENERATORS:
        taken = reduce(lambda a, k: F.concat(a, F.col(out)[k]), [k for k in _GENERATORS if list(_GENERATORS).index(k) < list(_GENERATORS).index(kind)], base)
        found = found.withColumn(out, F.col(out).withField(kind, _added(text, kind, taken)))
    return found


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_email, n_ip, n_card, n_phone long, base_sha256, spans string)."""
    found = spans(df.select(id_col, text_col), text_col, "_pii").select(id_col, "_pii")
    every = [*KINDS, *_GENERATORS]
    text = lambda kinds: F.concat_ws(",", F.flatten(F.array(*(_joined(k, F.col("_pii")[k]) for k in kinds))))
    return found.select(id_col, *(F.size(F.col("_pii")[k]).cast("long").alias(f"n_{k}") for k in KINDS), F.sha2(text(KINDS), 256).alias("base_sha256"), text(every).alias("spans"))


def redacted(df: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """df with each span of its text replaced by its kind in brackets; spans that overlap become one.

    chars_col, if df has it, is the new text's length. Null texts stay null.
    """
    every = [*KINDS, *_GENERATORS]
    found = spans(df, text_col, "_pii")

    def marked(kind: str) -> Column:
        return F.transform(F.col("_pii")[kind], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{kind.upper()}]").alias("mark")))

    flat = F.array_sort(F.flatten(F.array(*map(marked, every))))
    # A span that begins before an earlier one ends is part of it: the furthest end so far decides.
    row = "struct<start:int,end:int,mark:string>"

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["mark"].alias("mark"))))
        return F.when((F.size(acc) > 0) & (s["start"] < F.try_element_at(acc, F.lit(-1))["end"]), longer).otherwise(F.array_append(acc, s))

    merged = found.withColumn("_flat", flat).withColumn("_m", F.aggregate("_flat", F.array().cast(f"array<{row}>"), join))
    ends = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col("_m"), i - 1)["end"])
    pieces = F.transform("_m", lambda s, i: F.concat(F.substring(F.col(text_col), ends(i) + 1, s["start"] - ends(i)), s["mark"]))
    tail = F.substring(F.col(text_col), F.element_at("_m", -1)["end"] + 1, F.lit(2**31 - 1))
    out = merged.withColumn(text_col, F.when(F.size("_m") > 0, F.concat(F.concat_ws("", pieces), tail)).otherwise(F.col(text_col))).drop("_pii", "_flat", "_m")
    if chars_col and chars_col in df.columns:
        out = out.withColumn(chars_col, F.char_length(text_col).cast(df.schema[chars_col].dataType))
    return out.select(df.columns)
