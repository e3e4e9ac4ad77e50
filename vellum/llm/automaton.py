"""Operator 9: word-level substring deduplication by suffix automata.

Reference shards are the buckets of windows.py: segments that share a minimiser meet in one. A shard's automaton is
built in order of document and start, and each segment is streamed through it while it is added: where the matching
statistic reaches the window's length, an earlier place has the same words. Broadcasting automata of the whole corpus
would send every task a copy that grows with the corpus; so a shard is sent only what may match it.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field
from .windows import Candidates, View, removal, to_documents

LENGTH = 20
GRAM = 4
BUCKET_BYTES = 4 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


class SuffixAutomaton:
    """All substrings of the sequences added so far, built symbol by symbol."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]

    def _state(self, size: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, q: int, symbol: int) -> int:
        new = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = new
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = new
            p = self.link[p]
        return new

    def extend(self, last: int, symbol: int) -> int:
        """The state of the sequence at `last` with one more symbol."""
        known = self.next[last].get(symbol)
        if known is not None:
            return known if self.size[known] == self.size[last] + 1 else self._clone(last, known, symbol)
        new, p = self._state(self.size[last] + 1, {}, 0), last
        while p >= 0 and symbol not in self.next[p]:
            self.next[p][symbol] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][symbol]
            self.link[new] = q if self.size[q] == self.size[p] + 1 else self._clone(p, q, symbol)
        return new

    def stream(self, symbols: list[int], length: int) -> list[int]:
        """Starts of windows that were added before, or stand earlier in `symbols`; symbols are added meanwhile."""
        moves, link, size = self.next, self.link, self.size
        state = matched = last = 0
        starts = []
        for i, s in enumerate(symbols):
            while state and s not in moves[state]:
                state = link[state]
                matched = size[state]
            to = moves[state].get(s)
            if to is not None:
                state, matched = to, matched + 1
            if matched >= length:
                starts.append(i + 1 - length)
            last = self.extend(last, s)
            while state and matched <= size[link[state]]:
                state = link[state]
        return starts


def _index(c: Candidates) -> list[np.ndarray]:
    shard = SuffixAutomaton()
    return [np.array(shard.stream(s, c.view.length), dtype=np.int64) for s in c.symbols]


def word_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, kept_text: bool = False, **sizes) -> DataFrame:
    """Rows (id, n_words, n_removed long, kept_sha256 string, and kept binary if asked for), one a row of df.

    A word goes if a window of `length` words around it also starts earlier: in a document of smaller id, or before in the
    same. Words are compared by their bytes; hashes only decide where windows meet. Null texts have no words. A null id counts as the
    least. Rows with the same id and text get the same result; with different texts they count as one document, in a
    fixed order of their digests. An empty table gives no rows. Texts are taken whole, and other columns aren't read.
    """
    view = View(length, min(GRAM, length), True, True, sizes.pop("bucket_bytes", BUCKET_BYTES))

    def summarise(text: bytes, gone: np.ndarray) -> tuple:
        n = int(gone.sum())
        words = text.split()
        kept = b" ".join(compress(words, (~gone).tolist()) if n else words)
        return len(words), n, hashlib.sha256(kept).hexdigest(), *([kept] if kept_text else [])

    fields = [field("n_words", "long"), field("n_removed", "long"), field("kept_sha256", "string"), *([field("kept", "binary")] if kept_text else [])]
    summary = removal(df, view, _index, summarise, fields, id_col, text_col, **sizes)
    long = F.col("n_words") >= length
    copies = {
        "n_words": F.col("n_words"),
        "n_removed": F.when(long, F.col("n_words")).otherwise(F.col("n_removed")),
        "kept_sha256": F.when(long, F.lit(_EMPTY)).otherwise(F.col("kept_sha256")),
    }
    if kept_text:
        copies["kept"] = F.when(long, F.lit(b"")).otherwise(F.col("kept"))
    return to_documents(df, summary, copies, id_col, text_col)
