"""Repeated windows of a fixed length over a whole corpus, for the two substring operators.

A window's minimiser, the least hash of its short grams, depends on the window alone; so equal windows have equal
minimisers, wherever they stand. Consecutive starts with one minimiser form a segment. The stages are:

1. equal texts of a batch are merged, and texts go to blocks by a hash of their content (one exchange, used by 2, 4, 6);
2. each block sends its sorted distinct minimiser hashes, packed, to buckets of the hash;
3. a bucket tells each block which of its hashes another place has too;
4. blocks send the segments of those hashes to the buckets, each distinct segment once;
5. a bucket merges equal segments and hands those that differ to the operator's index, which finds repeated windows;
6. blocks turn the windows found into spans of each text, which are joined to all documents by the text's digest.

A hash whose segments have more than a bucket's bytes has its windows spread over buckets one by one; a block sends each
of those once. Block and bucket numbers follow the size of the corpus; nothing is capped, and nothing is sent to the
driver. Hashes only route: what is equal is decided on bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import chunks, field, total_bytes

BLOCK_BYTES = 4 << 20
#: Bytes of text for each bucket of minimiser hashes.
ASK_BYTES = 16 << 20
#: Symbols of a block whose grams are held at once.
SLICE = 1 << 18
#: Starts of a segment at most; longer runs (periodic text) are cut.
LONGEST = 256
NULL_ID = -(1 << 63)
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _M1
    x ^= x >> np.uint64(32)
    x *= _M2
    x ^= x >> np.uint64(29)
    return x


@dataclass(frozen=True)
class View:
    """How texts become symbols: bytes (uint8), or words. `length` symbols are a window."""

    length: int
    gram: int
    words: bool
    #: A window that starts earlier in the same document counts too.
    within: bool
    bucket_bytes: int


_SYMBOL = mix(np.arange(1, 257, dtype=np.uint64))


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (maximal run of bytes other than spaces), where it begins, and where it ends."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = raw == 32
    edge = np.diff(np.concatenate([[1], space.view(np.int8), [1]]))
    starts, stops = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, stops
    out = np.empty(len(starts), dtype=np.uint64)
    for lo in range(0, len(starts), SLICE):
        first, last = starts[lo : lo + SLICE], stops[lo : lo + SLICE]
        base = int(first[0])
        piece = raw[base : int(last[-1])]
        sizes = last - first
        powers = np.ones(int((np.append(first[1:], last[-1]) - first).max()), dtype=np.uint64)
        powers[1:] = _M1
        powers = np.multiply.accumulate(powers)
        heads = first - base
        at = np.arange(len(piece)) - np.repeat(heads, np.diff(np.append(heads, len(piece))))
        terms = _SYMBOL[piece] * powers[at]
        terms[piece == 32] = 0
        out[lo : lo + SLICE] = mix(np.add.reduceat(terms, heads) + sizes.astype(np.uint64))
    return out, starts, stops


def gram_hashes(symbols: np.ndarray, view: View) -> np.ndarray:
    """A hash of the `gram` symbols from each position on."""
    m = len(symbols) - view.gram + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    if view.words:
        grams = mix(symbols[:m])
        for i in range(1, view.gram):
            grams = mix(grams ^ symbols[i : i + m])
        return grams
    eight = np.ndarray((len(symbols) - 7,), dtype="<u8", buffer=symbols.tobytes(), strides=(1,))
    grams = mix(eight[:m])
    for i in sorted({*range(8, view.gram - 7, 8), view.gram - 8} - {0}):
        grams = mix(grams ^ eight[i : i + m])
    return grams


class Block:
    """The distinct texts of a block in order of digest, with their segments."""

    def __init__(self, table: pa.Table, view: View) -> None:
        found: dict[bytes, list] = {}
        for text, first in zip(table.column("text").to_pylist(), table.column("first").to_pylist(), strict=True):
            key = hashlib.sha256(text).digest()
            held = found.setdefault(key, [text, first])
            held[1] = min(held[1], first)
        self.view, self.digests = view, sorted(found)
        self.texts = [found[k][0] for k in self.digests]
        self.first = np.array([found[k][1] for k in self.digests], dtype=np.int64)
        if view.words:
            # Words stand one space apart, so that bytes of equal runs of words are equal.
            split = [t.split() for t in self.texts]
            self.counts = np.array(list(map(len, split)), dtype=np.int64)
            self.raw = b" ".join([b" ".join(w) for w in split])
            self.symbols, self.low, self.high = word_hashes(self.raw)
        else:
            self.raw = b"".join(self.texts)
            self.symbols = np.frombuffer(self.raw, dtype=np.uint8)
            self.counts = np.array([len(t) for t in self.texts], dtype=np.int64)
        self.ends = np.cumsum(self.counts)
        self.begins = self.ends - self.counts

    def where(self, start: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
        """The bytes in raw of n windows from each start on."""
        last = start + n + self.view.length - 2
        return (self.low[start].tolist(), self.high[last].tolist()) if self.view.words else (start.tolist(), (last + 1).tolist())

    def segments(self) -> None:
        """seg_hash, seg_start (position in symbols), seg_n (starts), seg_doc, seg_again (the minimiser comes twice)."""
        parts = [self._slice(lo, min(lo + SLICE, len(self.symbols))) for lo in range(0, len(self.symbols), SLICE)]
        parts = [p for p in parts if p is not None]
        if not parts:
            self.seg_hash, self.seg_start = np.zeros(0, np.uint64), np.zeros(0, np.int64)
            self.seg_n = self.seg_doc = np.zeros(0, np.int64)
            self.seg_again = np.zeros(0, bool)
            return
        self.seg_hash, self.seg_start, self.seg_n, self.seg_doc, self.seg_again = map(np.concatenate, zip(*parts, strict=True))

    def _slice(self, lo: int, hi: int) -> tuple | None:
        """The segments of the windows that start in symbols lo..hi-1; a segment across a slice's end is cut there."""
        view = self.view
        width = view.length - view.gram + 1
        a, b = np.searchsorted(self.ends, [lo, hi - 1], side="right")
        begins = np.maximum(self.begins[a : b + 1], lo)
        usable = np.maximum(np.minimum(self.ends[a : b + 1] - view.length + 1, hi) - begins, 0)
        total = int(usable.sum())
        if not total:
            return None
        grams = gram_hashes(self.symbols[lo : hi + view.length - 1], view)
        least, done = grams.copy(), 1
        while done < width:
            step = min(done, width - done)
            np.minimum(least[:-step], least[step:], out=least[:-step])
            done += step
        docs = np.repeat(np.arange(a, b + 1), usable)
        starts = np.arange(total) + np.repeat(begins - lo - np.cumsum(usable) + usable, usable)
        hashes = least[starts]
        new = np.ones(total, dtype=bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(np.append(heads, total))
        # The minimiser stands twice in a run: at two of its starts, or at one and behind its last start.
        hit = np.add.reduceat((grams[starts] == hashes).astype(np.int64), heads)
        last, own = starts[heads + sizes - 1], hashes[heads]
        for i in range(1, width):
            hit += grams[np.minimum(last + i, len(grams) - 1)] == own
        if sizes.max() > LONGEST:
            pieces = -(-sizes // LONGEST)
            k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            heads, hit = np.repeat(heads, pieces) + k * LONGEST, np.repeat(hit, pieces)
            sizes = np.diff(np.append(heads, total))
        return hashes[heads], starts[heads] + lo, sizes, docs[heads], hit > 1

    def bucketed(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes in order of bucket, then hash; the bucket of each; whether the block alone repeats it; the
        power of two that its segments' bytes don't exceed."""
        hashes, first, inverse, counts = np.unique(self.seg_hash, return_index=True, return_inverse=True, return_counts=True)
        docs = self.seg_doc
        if self.view.within:
            again = counts > 1
            again |= np.bincount(inverse, weights=self.seg_again, minlength=len(hashes)) > 0
        else:
            again = np.bincount(inverse, weights=docs != docs[first][inverse], minlength=len(hashes)) > 0
        symbols = np.bincount(inverse, weights=self.seg_n + self.view.length - 1, minlength=len(hashes))
        size = np.ceil(np.log2(np.maximum(symbols * (8 if self.view.words else 1), 1))).astype(np.uint8)
        where = bucket_of(hashes, buckets)
        order = np.argsort(where, kind="stable")
        return hashes[order], where[order], again[order], size[order]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(hashes ^ _M2) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Candidates:
    """Segments of one bucket: hash, symbols, id and place of the first holder (id, block, document, start)."""

    view: View
    hashes: list[int]
    #: Bytes, or for words numbers that stand for one word each.
    symbols: list[np.ndarray] | list[list[int]]
    places: list[tuple[int, int, int, int]]


#: Given candidates (distinct symbols, in order of place), the starts of each that an earlier place has too.
Index = Callable[[Candidates], list[np.ndarray]]


def _pack(**arrays: np.ndarray) -> bytes:
    head = b"".join(len(a).to_bytes(8, "little") for a in arrays.values())
    return head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


def _unpack(data: bytes, *kinds: str) -> list[np.ndarray]:
    out, at = [], 8 * len(kinds)
    for i, kind in enumerate(kinds):
        n = int.from_bytes(data[8 * i : 8 * i + 8], "little")
        out.append(np.frombuffer(data, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


_SEGMENTS = ("<u8", "<u4", "<i8", "<u4", "<u4", "<u4", "<u4", "<u4", "<u4")


def _segment_rows(block: Block, number: int, states: dict[int, np.ndarray], asked: int, buckets: int) -> list[tuple[int, int, bytes]]:
    view = block.view
    hashes, where, *_ = block.bucketed(asked)
    if not len(hashes):
        return []
    state = np.zeros(len(hashes), np.uint8)
    for b, values in states.items():
        lo, hi = np.searchsorted(where, [b, b + 1])
        state[lo:hi] = values
    order = np.argsort(hashes, kind="stable")
    of = state[order][np.searchsorted(hashes[order], block.seg_hash)]
    pick = np.flatnonzero(of > 0)
    h, start, n, doc, hot = block.seg_hash[pick], block.seg_start[pick], block.seg_n[pick], block.seg_doc[pick], of[pick] > 1
    raw = block.raw
    if hot.any():
        rep = np.where(hot, n, 1)
        k = np.arange(rep.sum()) - np.repeat(np.cumsum(rep) - rep, rep)
        single = np.repeat(hot, rep)
        start, doc, n, h = np.repeat(start, rep) + k, np.repeat(doc, rep), np.where(single, 1, np.repeat(n, rep)), np.repeat(h, rep)
        own = [xxhash.xxh3_64_intdigest(raw[a:b]) for a, b in zip(*block.where(start[single], n[single]), strict=True)]
        h = h.copy()
        h[single] = np.array(own, dtype=np.uint64)
    ids = block.first[doc]
    place = np.lexsort((start, doc, ids))
    h, start, n, doc, ids = h[place], start[place], n[place], doc[place], ids[place]
    seen: dict[bytes, int] = {}
    sent, gone = np.zeros(len(h), bool), np.zeros(len(h), bool)
    low, high = block.where(start, n)
    id_list = ids.tolist()
    for i, key in enumerate(map(raw.__getitem__, map(slice, low, high))):
        held = seen.get(key)
        if held is None:
            seen[key] = id_list[i]
            sent[i] = True
        elif view.within or id_list[i] > held:
            gone[i] = True
        else:
            sent[i] = True
    del seen
    bucket = bucket_of(h, buckets)
    local = start - block.begins[doc]
    rows = []
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, edges):
        s, g = part[sent[part]], part[gone[part]]
        if not len(part):
            continue
        bodies = [raw[low[i] : high[i]] for i in s.tolist()]
        packed = _pack(h=h[s].astype("<u8"), doc=doc[s].astype("<u4"), ids=ids[s].astype("<i8"), start=local[s].astype("<u4"), n=n[s].astype("<u4"), size=np.array(list(map(len, bodies)), "<u4"), gone_doc=doc[g].astype("<u4"), gone_start=local[g].astype("<u4"), gone_n=n[g].astype("<u4"))
        rows.append((int(bucket[part[0]]), number, b"".join([packed, *bodies])))
    return rows


def _bucket_rows(rows: list[tuple[int, bytes]], view: View, index: Index) -> list[tuple[int, bytes]]:
    """Of one bucket: for each block the removed starts as (document, start, number)."""
    merged: dict[bytes, list] = {}
    whole: dict[int, list[np.ndarray]] = {}
    out: dict[int, list[tuple[int, int, int]]] = {block: [] for block, _ in rows}
    for block, data in rows:
        h, doc, ids, start, n, sizes, gone_doc, gone_start, gone_n = _unpack(data, *_SEGMENTS)
        if len(gone_doc):
            whole.setdefault(block, []).append(np.stack([gone_doc, gone_start, gone_n]))
        ends = len(data) - int(sizes.sum(dtype=np.int64)) + np.cumsum(sizes, dtype=np.int64)
        keys = map(data.__getitem__, map(slice, (ends - sizes).tolist(), ends.tolist()))
        for key, entry in zip(keys, zip(ids.tolist(), repeat(block), doc.tolist(), start.tolist(), n.tolist(), h.tolist()), strict=False):
            held = merged.get(key)
            if held is None:
                merged[key] = [entry]
            else:
                held.append(entry)
    groups: dict[int, list[bytes]] = {}
    for key, held in merged.items():
        if len(held) > 1:
            held.sort()
            least = held[0][0]
            for e in held[1:]:
                if view.within or e[0] > least:
                    out[e[1]].append(e[2:5])
        groups.setdefault(held[0][5], []).append(key)
    number: dict[bytes, int] = {}

    def symbols(key: bytes):
        return [number.setdefault(w, len(number)) for w in key.split(b" ")] if view.words else np.frombuffer(key, np.uint8)

    wanted = [k for keys in groups.values() for k in keys if len(keys) > 1 or view.within and _periodic(symbols(k), view.gram)]
    wanted.sort(key=lambda k: merged[k][0])
    if wanted:
        found = index(Candidates(view, [merged[k][0][5] for k in wanted], [symbols(k) for k in wanted], [merged[k][0][:4] for k in wanted]))
        for key, starts in zip(wanted, found, strict=True):
            if len(starts):
                cut = np.flatnonzero(np.diff(starts) != 1) + 1
                runs = [(int(r[0]), len(r)) for r in np.split(starts, cut)]
                first = merged[key][0]
                for e in merged[key]:
                    if e is first or not view.within and e[0] == first[0]:
                        for lo, n in runs:
                            out[e[1]].append((e[2], e[3] + lo, n))
    result = []
    for block, found in out.items():
        parts = [*whole.get(block, []), *([np.array(found, dtype="<u4").T] if found else [])]
        if parts:
            doc, start, n = np.concatenate(parts, axis=1)
            result.append((block, _pack(doc=doc, start=start, n=n)))
    return result


def _periodic(symbols: list[int], gram: int) -> bool:
    if len(set(symbols)) == len(symbols):
        return False
    grams = list(zip(*(symbols[i:] for i in range(gram)), strict=False))
    return len(set(grams)) < len(grams)


class Removed:
    """The result for a block: a mask over its symbols."""

    def __init__(self, block: Block, rows: list[bytes]) -> None:
        change = np.zeros(len(block.symbols) + 1, dtype=np.int64)
        for data in rows:
            doc, start, n = _unpack(data, "<u4", "<u4", "<u4")
            at = block.begins[doc] + start
            np.add.at(change, at, 1)
            np.add.at(change, at + n + block.view.length - 1, -1)
        self.mask = np.cumsum(change[:-1]) > 0

    def of(self, block: Block, i: int) -> np.ndarray:
        return self.mask[block.begins[i] : block.ends[i]]


def removal(df: DataFrame, view: View, index: Index, summarise: Callable, fields: list[T.StructField], id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES, hot: int | None = None) -> DataFrame:
    """Rows (digest binary, first long, *fields): the summary of each distinct text and the least id that has it.

    summarise(text, mask) makes the values of `fields` from the mask of removed symbols. hot: bytes of a hash's segments
    from which on its windows are spread one by one, else those of a bucket.
    """
    size = total_bytes(df, text_col)
    blocks, asked, buckets = (max(1, -(-size // n)) for n in (block_bytes, max(ASK_BYTES, view.bucket_bytes) if block_bytes == BLOCK_BYTES else view.bucket_bytes, view.bucket_bytes))
    hot = view.bucket_bytes if hot is None else hot

    def spread(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for lo, hi in chunks(texts, 16 << 20):
                least: dict[bytes, int] = {}
                for text, i in zip(texts.slice(lo, hi - lo).to_pylist(), batch.column(0).slice(lo, hi - lo).to_pylist(), strict=True):
                    i = NULL_ID if i is None else i
                    text = text or b""
                    if least.get(text, i) >= i:
                        least[text] = i
                for a, b in chunks(pa.array(list(least), pa.binary())):
                    some = list(least)[a:b]
                    yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(t) % blocks for t in some], pa.int32()), pa.array([least[t] for t in some], pa.int64()), pa.array(some, pa.binary())], names=["block", "first", "text"])

    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(spread, "block int, first long, text binary")

    packed = T.StructType([field("bucket", T.IntegerType()), field("block", T.IntegerType()), field("data", T.BinaryType())])
    of_block = T.StructType(packed.fields[1:])
    packed_arrow, block_arrow = to_arrow_schema(packed), to_arrow_schema(of_block)

    def table(rows: list, arrow: pa.Schema) -> pa.Table:
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def minimisers(part: pa.Table) -> pa.Table:
        block = Block(part, view)
        block.segments()
        hashes, where, again, sizes = block.bucketed(asked)
        number = part.column("block")[0].as_py()
        edges = np.flatnonzero(np.diff(where)) + 1
        rows = [(int(where[p[0]]), number, _pack(h=hashes[p], again=np.packbits(again[p]), size=sizes[p])) for p in np.split(np.arange(len(hashes)), edges) if len(p)]
        return table(rows, packed_arrow)

    def shared(part: pa.Table) -> pa.Table:
        numbers = part.column("block").to_pylist()
        each = [_unpack(d, "<u8", "u1", "u1") for d in part.column("data").to_pylist()]
        every, inverse, counts = np.unique(np.concatenate([h for h, *_ in each]), return_inverse=True, return_counts=True)
        again = np.concatenate([np.unpackbits(a, count=len(h)).astype(bool) for h, a, _ in each])
        needed = (counts > 1) | (np.bincount(inverse, weights=again, minlength=len(every)) > 0)
        held = np.bincount(inverse, weights=np.exp2(np.concatenate([z for *_, z in each])), minlength=len(every))
        state = needed.astype(np.uint8) + (needed & (held > hot))
        mine = np.split(state[inverse], np.cumsum([len(h) for h, *_ in each])[:-1])
        bucket = part.column("bucket")[0].as_py()
        return table([(bucket, b, m.tobytes()) for b, m in zip(numbers, mine, strict=True) if m.any()], packed_arrow)

    def segments(part: pa.Table, answers: pa.Table) -> pa.Table:
        if not part.num_rows or not answers.num_rows:
            return table([], packed_arrow)
        block = Block(part, view)
        block.segments()
        states = {b: np.frombuffer(d, np.uint8) for b, d in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True)}
        return table(_segment_rows(block, part.column("block")[0].as_py(), states, asked, buckets), packed_arrow)

    def repeated(part: pa.Table) -> pa.Table:
        rows = list(zip(part.column("block").to_pylist(), part.column("data").to_pylist(), strict=True))
        return table(_bucket_rows(rows, view, index), block_arrow)

    result = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("first", T.LongType()), *fields])
    arrow = to_arrow_schema(result)

    def finish(part: pa.Table, removed: pa.Table) -> pa.Table:
        if not part.num_rows:
            return arrow.empty_table()
        block = Block(part, view)
        found = Removed(block, removed.column("data").to_pylist())
        rows = [(d, int(f), *summarise(t, found.of(block, i))) for i, (d, f, t) in enumerate(zip(block.digests, block.first, block.texts, strict=True))]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    by_block = lambda x: x.groupBy("block")
    hashes = by_block(texts).applyInArrow(minimisers, packed)
    answers = hashes.groupBy("bucket").applyInArrow(shared, packed)
    sent = by_block(texts).cogroup(by_block(answers)).applyInArrow(segments, packed)
    removed = sent.groupBy("bucket").applyInArrow(repeated, of_block)
    return by_block(texts).cogroup(by_block(removed)).applyInArrow(finish, result)


def to_documents(df: DataFrame, summary: DataFrame, copies: dict, id_col: str, text_col: str) -> DataFrame:
    """The summary's fields for each row of df: its text's own for the least id, `copies` for later copies.

    copies maps a field to a column over the summary's fields.
    """
    docs = df.select(F.col(id_col), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest"))
    later = F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)) > F.col("first")
    return docs.join(summary, "digest").select(id_col, *(F.when(later, value).otherwise(F.col(name)).alias(name) for name, value in copies.items()))
