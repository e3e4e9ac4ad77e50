"""Operator 10: benchmark decontamination by one Aho-Corasick automaton.

Texts are normalised byte by byte: A-Z lower-cased, whatever is neither a letter, a digit nor beyond ASCII a space. Words
of items are numbered, and a text becomes the sequence of its words' numbers, which is scanned once. Of each item the
automaton holds aligned pieces of half a window: one of them is inside any window, so that a match, extended on both sides
as far as text and item agree, finds every window, at one node a word instead of one for each byte of each window. Word
positions lead back to character offsets in the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from itertools import groupby

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, small, stored, unused

WINDOW = 13
#: Bytes of items in one automaton, of some 12 bytes of memory each (measured); a larger benchmark is scanned for in parts.
PART_BYTES = 16 << 20
_NORMAL = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_NORMAL).split()


class Matcher:
    """Finds the windows of items in texts. An item of fewer words than a window is one window."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW) -> None:
        self.size, piece = size, (size + 1) // 2
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        self.items: list[array] = []
        places: dict[tuple, list[tuple[int, int]]] = {}
        for name, text in items:
            own = array("I", [self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)])
            if not own:
                continue
            k = len(self.items)
            self.names.append(name)
            self.items.append(own)
            if len(own) < size:
                places.setdefault(tuple(own), []).append((k, -1))
            else:
                for p in range(0, len(own) - piece + 1, piece):
                    places.setdefault(tuple(own[p : p + piece]), []).append((k, p))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for key, held in places.items():
            self.automaton.add_word(key, (len(key), held))
        if places:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, str]]:
        """(first word, word behind the last, item) of each run of windows."""
        if not self.items or not words:
            return []
        get = self.number.get
        text = tuple([get(w, 0) for w in words])
        if not any(text):
            return []
        out, reached, n = [], {}, len(text)
        for end, (size, held) in self.automaton.iter(text):
            at = end + 1 - size
            for k, p in held:
                if p < 0:
                    out.append((at, end + 1, self.names[k]))
                    continue
                if reached.get((k, at - p), -1) > at:
                    continue
                item = self.items[k]
                lo, hi, more = at, end + 1, p + size
                while lo and p and text[lo - 1] == item[p - 1]:
                    lo, p = lo - 1, p - 1
                while hi < n and more < len(item) and text[hi] == item[more]:
                    hi, more = hi + 1, more + 1
                reached[k, lo - p] = hi
                if hi - lo >= self.size:
                    out.append((lo, hi, self.names[k]))
        return out


def spans_of(hits: list) -> list[list[int]]:
    """The union of the hits as maximal runs of words."""
    runs: list[list[int]] = []
    for lo, hi in sorted({(lo, hi) for lo, hi, _ in hits}):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


_READY: dict[tuple[str, int], Matcher] = {}


def _scanned(df: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    rows = items.distinct().orderBy("i", "t").collect()
    shared = df.sparkSession.sparkContext.broadcast([(r["i"], bytes(r["t"] or b"")) for r in rows])

    name = uuid.uuid4().hex

    def setup():
        key = (name, window)
        if key not in _READY:
            _READY.clear()
            _READY[key] = Matcher(shared.value, window)
        one = _READY[key]

        def work(texts):
            n_words, n_hit, longest, items, spans = [], [], [], [], []
            for text in texts:
                words = words_of(text)
                found = one.hits(words)
                runs = spans_of(found)
                n_words.append(len(words))
                n_hit.append(sum(hi - lo for lo, hi in runs))
                longest.append(max((hi - lo for lo, hi in runs), default=0))
                items.append(sorted({i for *_, i in found}))
                at = [m.span() for m in _WORD.finditer(text.decode())] if runs else []
                spans.append([{"start": at[lo][0], "end": at[hi - 1][1]} for lo, hi in runs])
            return [n_words, n_hit, longest, items, spans]

        return work

    fields = [field("n_words", "long"), field("n_hit", "long"), field("longest", "long"), field("items", "array<string>"), field("spans", "array<struct<start:long,end:long>>")]
    return map_texts(df, id_col, text_col, setup, fields, as_bytes=True)


def contamination(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows (id, n_words long, n_hit long, longest long, items array<string> sorted, spans array<struct<start,end>>).

    longest is the number of words of the longest hit run; spans are the hit runs of words in code points of the original text. Null and empty texts have no words; an empty
    benchmark, and items without words, hit nothing. Repeated items count once by their id; a null item id counts as
    the string "null". Texts are scanned whole; other columns aren't read. A benchmark of more than part_bytes is taken in
    parts by a hash of its items: each part is collected, broadcast and scanned for alone, and what the parts find in a text is
    put together by the text's digest.
    """
    size = int(benchmark.agg(F.sum(F.octet_length(item_text)).alias("n")).first()["n"] or 0)
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("i"), F.encode(F.col(item_text), "UTF-8").alias("t"))
    parts = max(1, -(-size // part_bytes))
    if parts == 1:
        return _scanned(df, items, id_col, text_col, window)
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    texts = stored(df.select(digest.alias("digest"), F.col(text_col).alias("text")).dropDuplicates(["digest"]), "texts")
    items = stored(items.withColumn("part", F.pmod(F.xxhash64("i", "t"), F.lit(parts))), "items")
    found = None
    for part in range(parts):
        one = stored(_scanned(texts, items.where(F.col("part") == part).select("i", "t"), "digest", "text", window), "scanned")
        found = one if found is None else found.union(one)
    whole = stored(found.groupBy("digest").agg(F.max("n_words").alias("n_words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")), "found")

    def setup():
        def work(texts, spans):
            n_hit, longest, merged = [], [], []
            for text, some in zip(texts, spans, strict=True):
                runs = spans_of([(s["start"], s["end"], None) for s in some])
                at = [m.span() for m in _WORD.finditer((text or b"").decode())] if runs else []
                inside = _inside(at, runs)
                n_hit.append(sum(inside))
                longest.append(max((len(list(run)) for hit, run in groupby(inside) if hit), default=0))
                merged.append([{"start": a, "end": b} for a, b in _joined(at, inside)])
            return n_hit, longest, merged

        return work

    joined = texts.join(whole, "digest").mapInArrow(lambda batches: _merged(batches, setup()), "digest string, n_words long, n_hit long, longest long, items array<string>, spans array<struct<start:long,end:long>>")
    return df.select(F.col(id_col), digest.alias("digest")).join(joined, "digest").select(id_col, "n_words", "n_hit", "longest", "items", "spans")


def _inside(at: list[tuple[int, int]], runs: list[list[int]]) -> list[bool]:
    out, k = [], 0
    for lo, hi in at:
        while k < len(runs) and runs[k][1] <= lo:
            k += 1
        out.append(k < len(runs) and runs[k][0] <= lo and hi <= runs[k][1])
    return out


def _joined(at: list[tuple[int, int]], inside: list[bool]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    before = False
    for (lo, hi), hit in zip(at, inside, strict=True):
        if hit:
            out[-1:] = [(out[-1][0], hi)] if before else [*out[-1:], (lo, hi)]
        before = hit
    return out


def _merged(batches, work):
    import pyarrow as pa

    for batch in batches:
        n_hit, longest, spans = work(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist())
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("digest"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array(longest, pa.int64()), batch.column("items"), pa.array(spans, kind)], names=["digest", "n_words", "n_hit", "longest", "items", "spans"])


def verdicts(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **names) -> DataFrame:
    """The digest columns of contamination(): a document is contaminated if a twentieth of its words is hit."""
    found = contamination(df, benchmark, id_col, **names)
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def clean(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES, passages: bool = False) -> DataFrame:
    """The rows of df that verdicts() doesn't call contaminated, null ids and repeated ids judged each by its own text.

    passages: nor may a row have a hit run of a window or more, however long its text is. Items of fewer words, which
    any text may have, then still count by their share alone.

    Only the digests of contaminated texts are joined; while they are few, that is a broadcast, and texts stay where they are.
    """
    key = unused("key", df)
    digest = F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)
    found = contamination(df.select(digest.alias(key), F.col(text_col).alias("text")), benchmark, key, "text", window=window, part_bytes=part_bytes)
    dirty = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    if passages:
        dirty |= F.col("longest") >= window
    bad = stored(found.where(dirty).select(key).distinct(), "contaminated")
    return df.withColumn(key, digest).join(small(bad, key), key, "left_anti").select(df.columns)


def item_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
