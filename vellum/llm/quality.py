"""Operator 3: quality rules with robust multivariate outliers, in DataFrame functions only.

Each document gets counts from its whole text. Per language and source, the minimum covariance determinant gives a
location and scatter that outliers don't move: from two starts (medians and spreads; mean and covariance of all rows),
concentration steps keep the three quarters of the rows nearest by Mahalanobis distance and estimate again, until the
determinant stops falling; the start with the least one wins. A document whose transformed vector lies beyond a chi-square
quantile of its group is rejected. Features stand on a grid of 1 / UNIT and enter as counts and sums of whole numbers, so
that verdicts don't depend on how rows are partitioned; no row set is ever gathered.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

MIN_WORDS = 50
#: Rows that a group needs for an estimate of its own; smaller ones use their language's, then that of all rows.
MIN_GROUP = 200
SUBSET = 0.75
#: Steps of a feature to 1, as a power of two: sums of products of deviations stay within 64 bits for 2**31 rows a group and more.
UNIT = 1 << 12
#: Cells to a factor e of a distance, and fall of the determinant's logarithm that counts as one.
CELLS = 256
FALL = 1e-3
#: Chance that a row of a Gaussian group is rejected.
TAIL = 1e-9
FEATURES = ("f_words", "f_length", "f_symbols", "f_lines", "f_repeats")
#: The least standard deviation of each feature: counts that are nearly always zero else have none.
FLOOR = (0.5, 0.1, 0.25, 0.25, 0.08)
#: Groups whose estimates are broadcast; more are joined by shuffle.
BROADCAST_GROUPS = 20_000
_GROUP = ["g_lang", "g_source"]
#: The language or source that stands for all of them; those of rows begin with an equals sign.
_ALL = "*"


def chi2_cdf(x: float, p: int) -> float:
    """Regularised lower incomplete gamma function P(p/2, x/2) by its series."""
    a, y = p / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= y / n
        total += term
    return total * math.exp(-y + a * math.log(y) - math.lgamma(a)) if x > 0 else 0.0


def chi2_quantile(q: float, p: int) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, p) < q else (lo, mid)
    return hi


def words(text: Column) -> Column:
    """Maximal runs of characters other than space, \\t, \\n, \\v, \\f and \\r."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", F.coalesce(text, F.lit("")))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def repeated_words(words_: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the text.

    Windows are told apart by 64-bit hashes and sorted with their positions; equal neighbours are repeats. Their starts
    in ascending order give the size of the union: each adds the words up to the next start, three at most.
    """
    n = F.size(words_)
    starts = F.transform(F.slice(words_, F.lit(1), n - 2), lambda w, i: F.struct(F.xxhash64(w, F.get(words_, i + 1), F.get(words_, i + 2)).alias("h"), i.alias("i")))
    return F.when(n < 3, F.array().cast("array<struct<h:bigint,i:int>>")).otherwise(F.sort_array(starts))


def _covered(windows: Column) -> Column:
    same = lambda a, b: F.get(windows, a)["h"] == F.get(windows, b)["h"]
    return F.sort_array(F.transform(F.filter(windows, lambda s, j: ((j > 0) & F.coalesce(s["h"] == F.get(windows, F.greatest(j - 1, F.lit(0)))["h"], F.lit(False))) | F.coalesce(s["h"] == F.get(windows, j + 1)["h"], F.lit(False))), lambda s: s["i"]))


def _union(starts: Column) -> Column:
    each = F.transform(starts, lambda s, j: F.coalesce(F.least(F.lit(3), F.get(starts, j + 1) - s), F.lit(3)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def statistics(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """Rows (kept columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long) of whole texts; null: none."""
    plain = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(plain, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    base = df.select(*keep, plain.alias("_t"), words(F.col(text_col)).alias("_w"))
    counted = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.aggregate("_w", F.lit(0).cast("long"), lambda a, w: a + F.char_length(w)).alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("_l"),
        repeated_words(F.col("_w")).alias("_s"),
    )
    flagged = counted.select(*keep, "n_words", "word_chars", "n_symbols", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), _covered(F.col("_s")).alias("_c"))
    return flagged.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", _union(F.col("_c")).cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> list[Column]:
    """The features on the grid, as whole numbers."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    made = [
        F.log1p(n),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(100 * F.col("n_symbols") / n),
        F.log1p(100 * F.col("n_dup_lines") / n),
        F.col("n_repeat_words") / n,
    ]
    return [F.floor(x * UNIT + 0.5).cast("long").alias(f) for x, f in zip(made, FEATURES, strict=True)]


def _distance() -> Column:
    """Squared Mahalanobis distance of the features from m_i under the covariance with the Cholesky factor l_i_j."""
    y: list[Column] = []
    for i, f in enumerate(FEATURES):
        rest = reduce(lambda a, j: a - F.col(f"l_{i}_{j}") * y[j], range(i), F.col(f) / UNIT - F.col(f"m_{i}"))
        y.append(rest / F.col(f"l_{i}_{i}"))
    return reduce(lambda a, b: a + b * b, y[1:], y[0] * y[0])


def _factored(estimates: DataFrame) -> DataFrame:
    """l_i_j, the Cholesky factor of c_i_j, column by column, and half the logarithm of its determinant."""
    out, p = estimates, len(FEATURES)
    for j in range(p):
        own = reduce(lambda a, k: a - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{j}_{j}"))
        out = out.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(own, F.lit(FLOOR[j] ** 2 / 4))))
        for i in range(j + 1, p):
            rest = reduce(lambda a, k: a - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}"), range(j), F.col(f"c_{i}_{j}"))
            out = out.withColumn(f"l_{i}_{j}", rest / F.col(f"l_{j}_{j}"))
    return out.withColumn("log_det", reduce(lambda a, j: a + F.log(F.col(f"l_{j}_{j}")), range(1, p), F.log(F.col("l_0_0")))).drop(*(f"c_{i}_{j}" for i in range(p) for j in range(i + 1)))


def _with(rows: DataFrame, estimates: DataFrame, groups: int, on: list[str] = _GROUP, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates, on, how)


def _quantiles(cells: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """For each group the least cell up to which a share of its rows lies; cells: (by, cell, n)."""
    order = Window.partitionBy(*by).orderBy("cell")
    ranked = cells.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("cell"))).alias(name) for name, q in shares.items()))


def _moments(rows: DataFrame, by: list[str], factor: float) -> DataFrame:
    """m_i and c_i_j of rows with FEATURES and whole numbers o_i near their means."""
    p = len(FEATURES)
    dev = [F.col(f) - F.col(f"o_{i}") for i, f in enumerate(FEATURES)]
    sums = [F.sum(dev[i]).alias(f"a_{i}") for i in range(p)] + [F.sum(dev[i] * dev[j]).alias(f"b_{i}_{j}") for i in range(p) for j in range(i + 1)] + [F.min(f"o_{i}").alias(f"o_{i}") for i in range(p)]
    mean = [F.col(f"a_{i}") / F.col("n") for i in range(p)]
    cols = [((F.col(f"o_{i}") + mean[i]) / UNIT).alias(f"m_{i}") for i in range(p)]
    for i in range(p):
        for j in range(i + 1):
            c = (F.col(f"b_{i}_{j}") / F.col("n") - mean[i] * mean[j]) / UNIT**2 * factor
            cols.append((F.greatest(c, F.lit(FLOOR[i] ** 2)) if i == j else c).alias(f"c_{i}_{j}"))
    return _factored(rows.groupBy(*by).agg(F.count("*").alias("n"), *sums).select(*by, *cols))


def _near() -> list[Column]:
    return [F.floor(F.col(f"m_{i}") * UNIT + 0.5).cast("long").alias(f"o_{i}") for i in range(len(FEATURES))]


def starts(rows: DataFrame, groups: int) -> DataFrame:
    """(group, start, m_i, l_i_j, log_det): 0 from medians and quartiles, 1 from the mean and covariance of all rows."""
    p = len(FEATURES)
    values = rows.select(*_GROUP, F.posexplode(F.array(*FEATURES)).alias("f", "x"))
    cells = values.groupBy(*_GROUP, "f", F.shiftright("x", 4).alias("cell")).agg(F.count("*").alias("n"))
    found = _quantiles(cells, [*_GROUP, "f"], {"lo": 0.25, "mid": 0.5, "hi": 0.75})
    of = lambda c, i: F.max(F.when(F.col("f") == i, F.col(c))) * 16 / UNIT
    cols = []
    for i in range(p):
        cols.append((of("mid", i)).alias(f"m_{i}"))
        for j in range(i + 1):
            spread = F.greatest((of("hi", i) - of("lo", i)) / 1.349, F.lit(FLOOR[i]))
            cols.append((spread * spread if i == j else F.lit(0.0)).alias(f"c_{i}_{j}"))
    middle = stored(_factored(found.groupBy(*_GROUP).agg(*cols)).withColumn("start", F.lit(0)), "middle")
    around = _with(rows, middle.select(*_GROUP, *_near()), groups)
    return middle.unionByName(_moments(around, _GROUP, 1.0).withColumn("start", F.lit(1)))


def concentrated(rows: DataFrame, now: DataFrame, groups: int, subset: float = SUBSET) -> DataFrame:
    """One concentration step of the estimates in `now`: (group, start, m_i, l_i_j, log_det) of the nearest rows."""
    p, by = len(FEATURES), [*_GROUP, "start"]
    factor = subset / chi2_cdf(chi2_quantile(subset, p), p + 2)
    cell = F.floor(F.log1p(_distance()) * CELLS)
    far = _with(rows, now, groups).select(*by, *FEATURES, *_near(), cell.alias("cell"))
    cut = _quantiles(far.groupBy(*by, "cell").agg(F.count("*").alias("n")), by, {"cut": subset})
    return _moments(_with(far, cut, groups, by).where("cell <= cut"), by, factor)


def estimates(rows: DataFrame, groups: int, subset: float = SUBSET) -> DataFrame:
    """Location m_i and Cholesky factor l_i_j of each group (g_lang, g_source) of rows with FEATURES."""
    by = [*_GROUP, "start"]
    whole = lambda df: df.select(*by, F.struct("log_det", "start", *(c for c in df.columns if c[:2] in ("m_", "l_") and c != "log_det")).alias("e"))
    # A start's own determinant isn't one of a subset: the first step replaces it whatever its own is.
    state = whole(concentrated(rows, stored(starts(rows, groups), "starts"), groups, subset)).withColumn("falls", F.lit(True))
    while True:
        state = stored(state, "state")
        if state.where("falls").isEmpty():
            break
        new = whole(concentrated(rows, state.where("falls").select(*_GROUP, "e.*"), groups, subset)).withColumnRenamed("e", "new")
        falls = F.coalesce(F.col("new.log_det") < F.col("e.log_det") - FALL, F.lit(False))
        state = state.join(new, by, "left").select(*by, F.when(falls, F.col("new")).otherwise(F.col("e")).alias("e"), falls.alias("falls"))
    return stored(state.groupBy(*_GROUP).agg(F.min("e").alias("e")).select(*_GROUP, "e.*").drop("log_det", "start"), "estimates")


def _judged(df: DataFrame, row: Column, text_col: str, lang_col: str, source_col: str, tail: float) -> DataFrame:
    """(row, the counts, base_failed, kept, distance) of each row of df; `row` is a struct that is carried along."""
    key = lambda c: F.concat(F.lit("="), F.col(c).cast("string"))
    taken = df.select(row.alias("row"), F.coalesce(key(lang_col), F.lit("")).alias("g_lang"), F.coalesce(key(source_col), F.lit("")).alias("g_source"), F.col(text_col).alias("text"))
    rows = stored(statistics(taken, "text", ("row", *_GROUP)).withColumn("base_failed", base_failed()), "statistics")
    valued = rows.where("not base_failed").select(*_GROUP, *vector())
    sizes = stored(valued.groupBy(*_GROUP).count(), "sizes")
    of_lang = sizes.groupBy("g_lang").agg(F.sum("count").alias("of_lang"))
    small = F.col("count") < MIN_GROUP
    pooled = stored(
        sizes.join(of_lang, "g_lang").select(
            *_GROUP,
            F.when(small & (F.col("of_lang") < MIN_GROUP), F.lit(_ALL)).otherwise(F.col("g_lang")).alias("p_lang"),
            F.when(small, F.lit(_ALL)).otherwise(F.col("g_source")).alias("p_source"),
        ),
        "groups",
    )
    groups = pooled.count()
    # A pooled estimate covers all rows of its language, or all rows, not only those of its small groups.
    own = pooled.where(F.col("p_source") != _ALL).select(*_GROUP)
    langs = pooled.where((F.col("p_source") == _ALL) & (F.col("p_lang") != _ALL)).select("g_lang").distinct()
    pools = [_with(valued, own, groups), _with(valued, langs, groups, ["g_lang"]).withColumn("g_source", F.lit(_ALL)).select(*_GROUP, *FEATURES)]
    if not pooled.where(F.col("p_lang") == _ALL).isEmpty():
        pools.append(valued.withColumns({"g_lang": F.lit(_ALL), "g_source": F.lit(_ALL)}))
    known = estimates(stored(reduce(DataFrame.unionByName, pools), "features"), groups)
    placed = stored(pooled.join(known.withColumnsRenamed({"g_lang": "p_lang", "g_source": "p_source"}), ["p_lang", "p_source"], "left").drop("p_lang", "p_source"), "placed")
    limit = chi2_quantile(1 - tail, len(FEATURES))
    scored = _with(rows.select("*", *vector()), placed, groups, _GROUP, "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True))
    return scored.select("row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance")


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words long, base_failed, kept boolean, distance double).

    Null and empty texts have no words and fail the base rule. A null language or source is a group like any other.
    Documents that fail the base rule have no distance and don't enter estimates. Repeated rows count as often as they
    come; an empty table gives no rows.
    """
    return _judged(df, F.struct(F.col(id_col).alias("id")), text_col, lang_col, source_col, tail).withColumn("row", F.col("row.id")).withColumnRenamed("row", id_col)


def filtered(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", tail: float = TAIL) -> DataFrame:
    """The rows of df that verdicts() keeps, each judged by itself: rows go along with their counts, not through a join."""
    return _judged(df, F.struct(*df.columns), text_col, lang_col, source_col, tail).where("kept").select("row.*")
