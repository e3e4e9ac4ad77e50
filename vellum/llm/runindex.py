"""Operator 2: byte-level suffix deduplication by a run-length index.

Segments that may repeat (see windows.py) are gathered in buckets, in groups of one minimiser. A group is halved by document id
again and again: each time the half of the smaller ids is indexed and the other half streamed through it, all groups
together, one index a level; a group's part has a colour, which keeps the parts apart. Levels go from the largest halves to the
smallest, and windows that were found leave at the segments' ends: of many copies few windows reach the later levels. The index is the Burrows-Wheeler
transform as runs, with suffix positions sampled at the runs' ends. Texts are streamed backwards, all in step: where the next byte
continues the run's rows, the match grows; else it moves to the nearest run of that byte above or below, whichever shares
more, as the samples tell. Where the matching statistic reaches the threshold, a document of a smaller id has the string.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field
from .windows import Candidates, View, gram_hashes, mix, removal, to_documents

LENGTH = 50
GRAM = 24
BUCKET_BYTES = 8 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def suffix_array(symbols: np.ndarray, plain: np.ndarray) -> np.ndarray:
    """Order of all suffixes; each 0 counts as a symbol of its own, in order of position.

    plain: symbols of at most 9 bits that order the symbols behind a suffix's first one up to the next 0 in the same way.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    depth = 1 + max(0, 63 - bits) // 9
    key = symbols.astype(np.int64)
    open_ = symbols != 0
    for i in range(1, depth):
        ahead = np.zeros(n, dtype=np.int64)
        ahead[: n - i] = plain[i:]
        key = (key << 9) | np.where(open_, ahead, 0)
        open_ &= ahead != 0
    order = np.argsort(key, kind="stable").astype(np.int32)
    k = key[order]
    new = np.ones(n, dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | ~open_[order][1:]
    del key, k
    rank = np.empty(n, dtype=np.int32)
    heads = np.flatnonzero(new)
    rank[order] = np.repeat(heads, np.diff(np.append(heads, n)))
    rows = np.arange(n)
    while len(heads) < n:
        # Only rows in groups of more than one are sorted again, by the group and the rank `depth` further on.
        rows = rows[~(new & np.append(new[1:], True))[rows]]
        at = order[rows]
        group = rank[at]
        ahead = np.where(at + depth < n, rank[np.minimum(at + depth, n - 1)] + 1, 0)
        sub = np.argsort(group * np.int64(n + 1) + ahead, kind="stable")
        order[rows] = at[sub]
        g, a = group[sub], ahead[sub]
        fresh = np.ones(len(rows), dtype=bool)
        fresh[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1])
        new[rows] = fresh
        first = rows[fresh]
        rank[order[rows]] = np.repeat(first, np.diff(np.append(np.flatnonzero(fresh), len(rows))))
        heads = np.flatnonzero(new)
        depth *= 2
    return order


class RunLengthIndex:
    """Run-compressed BWT of texts with colours; a text that is streamed meets the texts of its own colour only.

    Kept are the runs (symbol, start, samples at both ends) and the texts, which matches are compared on.
    """

    def __init__(self, texts: list[np.ndarray], colours: np.ndarray, length: int) -> None:
        self.length = length
        sizes = np.array([len(t) + 1 for t in texts])
        codes = np.concatenate(texts).astype(np.int64) + 256 * np.repeat(np.asarray(colours, dtype=np.int64), sizes - 1)
        self.codes, dense = np.unique(codes, return_inverse=True)
        n = int(sizes.sum())
        ends = np.cumsum(sizes) - 1
        keep = np.ones(n, dtype=bool)
        keep[ends] = False
        symbols, plain = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int16)
        symbols[keep], plain[keep] = dense + 1, (codes & 255) + 1
        #: Eight bytes from each position on, and the symbols left up to the text's end.
        raw = np.zeros(n + length + 16, dtype=np.uint8)
        raw[:n][keep] = codes & 255
        self.eight = np.ndarray((n + length + 9,), dtype="<u8", buffer=raw.tobytes(), strides=(1,))
        self.left = np.repeat(ends, sizes).astype(np.int32) - np.arange(n, dtype=np.int32)
        sa = suffix_array(symbols, plain)
        bwt = symbols[sa - 1]
        new = np.ones(n, dtype=bool)
        new[1:] = bwt[1:] != bwt[:-1]
        self.run_start = np.flatnonzero(new)
        self.runs = len(self.run_start)
        sizes_of_runs = np.diff(np.append(self.run_start, n))
        self.head = bwt[self.run_start].astype(np.int64)
        self.run_last = self.run_start + sizes_of_runs - 1
        self.first_sample, self.last_sample = sa[self.run_start].astype(np.int64), sa[self.run_last].astype(np.int64)
        #: By symbol; the last one stands for symbols that no text has.
        self.counts = np.bincount(symbols, minlength=len(self.codes) + 2)
        self.before = np.concatenate([[0], np.cumsum(self.counts)[:-1]])
        self.char_sample = sa[np.minimum(self.before, n - 1)].astype(np.int64)
        by_char = np.argsort(self.head, kind="stable")
        ahead = np.cumsum(sizes_of_runs[by_char]) - sizes_of_runs[by_char]
        self.base = np.empty(self.runs, dtype=np.int64)
        self.base[by_char] = ahead
        self.keys = self.head[by_char] * np.int64(self.runs) + by_char

    def _shared(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """Symbols that the suffixes at a and b, of one colour, share; `most` at most. Eight are compared at once."""
        out = np.minimum(np.minimum(self.left[a], self.left[b]), most)
        going = np.flatnonzero(out > 0)
        for i in range(0, most, 8):
            x = self.eight[a[going] + i] ^ self.eight[b[going] + i]
            other = x != 0
            ends = x[other]
            out[going[other]] = np.minimum(out[going[other]], i + np.bitwise_count((ends & -ends) - np.uint64(1)) // 8)
            going = going[~other]
            going = going[out[going] > i + 8]
            if not len(going):
                break
        return out

    def stream(self, texts: list[np.ndarray], colours: np.ndarray) -> list[np.ndarray]:
        """For each text the starts of windows that a text of the index of the same colour has too."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        sizes = np.array([len(texts[i]) for i in order])
        codes = np.concatenate([texts[i] for i in order]).astype(np.int64) + 256 * np.repeat(np.asarray(colours, dtype=np.int64)[order], sizes)
        place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        flat = np.where(self.codes[place] == codes, place + 1, len(self.codes) + 1)
        tails = np.cumsum(sizes) - 1
        row, at, size = (np.zeros(len(order), dtype=np.int64) for _ in range(3))
        marks: list[tuple[np.ndarray, np.ndarray]] = []
        for t in range(int(sizes[0])):
            k = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t come first
            c = flat[tails[:k] - t]
            r, p, m = row[:k], at[:k], size[:k]
            run = np.searchsorted(self.run_start, r, side="right") - 1
            on = (m > 0) & (self.head[run] == c)
            if on.any():
                i = np.flatnonzero(on)
                r[i] = self.base[run[i]] + r[i] - self.run_start[run[i]]
                p[i] -= 1
                m[i] += 1
            off = np.flatnonzero(~on & (m > 0))
            if len(off):
                j = np.searchsorted(self.keys, c[off] * np.int64(self.runs) + run[off])
                most = int(min(self.length, m[off].max()))
                q = np.concatenate([j - 1, j])
                key = self.keys[np.clip(q, 0, self.runs - 1)]
                near = np.flatnonzero((q >= 0) & (q < self.runs) & (key // self.runs == np.tile(c[off], 2)))
                found = key[near] % self.runs
                lce = np.full(2 * len(off), -1)
                sample = np.where(near < len(off), self.last_sample[found], self.first_sample[found])
                lce[near] = self._shared(p[off[near % len(off)]], sample, most)
                below = lce[len(off) :] > lce[: len(off)]
                best = np.maximum(lce[len(off) :], lce[: len(off)])
                to = (key % self.runs).reshape(2, -1)[below.astype(np.int8), np.arange(len(off))]
                moved = np.flatnonzero(best >= 0)
                o, f, first = off[moved], to[moved], below[moved]
                r[o] = np.where(first, self.base[f], self.base[f] + self.run_last[f] - self.run_start[f])
                p[o] = np.where(first, self.first_sample[f], self.last_sample[f]) - 1
                m[o] = np.minimum(m[o], best[moved]) + 1
                m[off[best < 0]] = 0
            fresh = np.flatnonzero(m == 0)
            fresh = fresh[self.counts[c[fresh]] > 0]
            if len(fresh):
                r[fresh], p[fresh], m[fresh] = self.before[c[fresh]], self.char_sample[c[fresh]], 1
            if t + 1 >= self.length:
                long = np.flatnonzero(m >= self.length)
                if len(long):
                    marks.append((long, sizes[long] - 1 - t))
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(texts)
        if marks:
            who, start = np.concatenate([a for a, _ in marks]), np.concatenate([b for _, b in marks])
            by = np.lexsort((start, who))
            who, start = who[by], start[by]
            for part in np.split(np.arange(len(who)), np.flatnonzero(np.diff(who)) + 1):
                out[int(order[who[part[0]]])] = start[part]
        return out


def related(c: Candidates) -> np.ndarray:
    """Which candidates share a minimiser and half of what a window has besides it, on either side, with another one.

    A window reaches `half` symbols beyond its minimiser on one side at least. Only these candidates can share a window.
    """
    view = c.view
    half = (view.length - view.gram) // 2
    if half < 8:
        return np.ones(len(c.symbols), dtype=bool)
    flat = np.concatenate(c.symbols)
    sizes = np.array([len(s) for s in c.symbols])
    ends = np.cumsum(sizes)
    grams = gram_hashes(flat, view)
    eight = np.ndarray((len(flat) - 7,), dtype="<u8", buffer=flat.tobytes(), strides=(1,))
    owners = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    at = np.flatnonzero(grams == np.array(c.hashes, dtype=np.uint64)[owners[: len(grams)]])
    owner = owners[at]
    inside = at + view.gram <= ends[owner]
    at, owner = at[inside], owner[inside]
    out = np.ones(len(sizes), dtype=bool)
    out[owner] = False
    for side in (-1, 1):
        ok = at - half >= (ends - sizes)[owner] if side < 0 else at + view.gram + half <= ends[owner]
        p, who = at[ok] + (-half if side < 0 else view.gram), owner[ok]
        key = mix(mix(grams[at[ok]] ^ eight[p]) ^ eight[p + half - 8])
        by = np.lexsort((who, key))
        key, who = key[by], who[by]
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
        if len(heads):
            many = np.minimum.reduceat(who, heads) != np.maximum.reduceat(who, heads)
            out[who[np.repeat(many, np.diff(np.append(heads, len(key))))]] = True
    return out


def _index(c: Candidates) -> list[np.ndarray]:
    """The starts of each candidate that a candidate of a smaller id has too: halves by id, one index a level."""
    pick = np.flatnonzero(related(c))
    out: list[np.ndarray] = [np.zeros(0, dtype=np.int64)] * len(c.symbols)
    if not len(pick):
        return out
    hashes = np.array(c.hashes, dtype=np.uint64)[pick]
    ids = np.array([p[0] for p in c.places], dtype=np.int64)[pick]
    by = np.lexsort((ids, hashes))
    pick, hashes, ids = pick[by], hashes[by], ids[by]
    new_group = np.append(True, hashes[1:] != hashes[:-1])
    step = np.append(True, ids[1:] != ids[:-1]) | new_group
    group = np.cumsum(new_group) - 1
    # Ids of a group are numbered from 0 on; equal ones have the same number and never meet.
    rank = np.cumsum(step)
    rank -= rank[np.flatnonzero(new_group)][group]
    found: dict[int, list[np.ndarray]] = {}
    # What is left of each: from the first to the last start that no smaller id is known to have. As the halves are taken from
    # the largest on, a window found in a smaller id has met all that its own part's later halves hold, and goes.
    texts, low = [c.symbols[i] for i in pick], np.zeros(len(pick), dtype=np.int64)
    live = np.ones(len(pick), dtype=bool)
    for level in reversed(range(int(rank.max()).bit_length())):
        _, colour = np.unique(group * np.int64(1 << 32) + (rank >> (level + 1)), return_inverse=True)
        right = (rank >> level & 1).astype(bool)
        met = (np.bincount(colour[right & live], minlength=colour.max() + 1) > 0) & (np.bincount(colour[~right & live], minlength=colour.max() + 1) > 0)
        a, b = (np.flatnonzero(met[colour] & live & side) for side in (~right, right))
        if not len(a):
            continue
        index = RunLengthIndex([texts[i] for i in a], colour[a], c.view.length)
        for i, starts in zip(b.tolist(), index.stream([texts[i] for i in b], colour[b]), strict=True):
            if len(starts):
                found.setdefault(int(pick[i]), []).append(starts + low[i])
                rest = np.ones(len(texts[i]) - c.view.length + 1, dtype=bool)
                rest[starts] = False
                rest = np.flatnonzero(rest)
                live[i] = len(rest) > 0
                if len(rest):
                    texts[i] = texts[i][rest[0] : rest[-1] + c.view.length]
                    low[i] += rest[0]
    for i, parts in found.items():
        out[i] = np.unique(np.concatenate(parts)) if len(parts) > 1 else parts[0]
    return out


def suffix_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kept_bytes: bool = False, **sizes) -> DataFrame:
    """Rows (id, n_bytes, n_removed, n_spans long, kept_sha256 string, and kept binary if asked for), one a row of df.

    A byte goes if a string of `length` bytes around it also starts in a document of smaller id. Null texts are empty.
    A null id counts as the least. Rows with the same id never remove each other's bytes, repeated rows included; an
    empty table gives none. Texts are taken whole, and other columns aren't read.
    """
    gram = min(GRAM, length)
    view = View(length, gram, False, False, sizes.pop("bucket_bytes", BUCKET_BYTES))

    def summarise(text: bytes, gone: np.ndarray) -> tuple:
        n = int(gone.sum())
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes() if n else text
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if n else 0
        return len(text), n, spans, hashlib.sha256(kept).hexdigest(), *([kept] if kept_bytes else [])

    fields = [field("n_bytes", "long"), field("n_removed", "long"), field("n_spans", "long"), field("kept_sha256", "string"), *([field("kept", "binary")] if kept_bytes else [])]
    summary = removal(df, view, _index, summarise, fields, id_col, text_col, **sizes)
    long = F.col("n_bytes") >= length
    copies = {
        "n_bytes": F.col("n_bytes"),
        "n_removed": F.when(long, F.col("n_bytes")).otherwise(F.col("n_removed")),
        "n_spans": F.when(long, F.lit(1).cast("long")).otherwise(F.col("n_spans")),
        "kept_sha256": F.when(long, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")),
    }
    if kept_bytes:
        copies["kept"] = F.when(long, F.lit(b"")).otherwise(F.col("kept"))
    return to_documents(df, summary, copies, id_col, text_col)
