"""Operator 6: token counts by a Viterbi pass that keeps counts only.

An Aho-Corasick automaton lists the vocabulary's matches that end at each character; dynamic programming carries the
best score and its number of pieces. Ties go as in the tokenizers library's Unigram model: starts are tried from the
left and only a strictly better score replaces an earlier one. Characters that no piece covers cost ten below the
least score and count one piece for each of their bytes (byte fallback).
"""

from __future__ import annotations

import ahocorasick
from pyspark.sql import DataFrame

from .common import field, map_texts

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_ENTRIES = 400_000
MAX_MODEL_BYTES = 64 << 20


def vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) by id of a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())]


class CountingViterbi(dict):
    """Piece counts of words, by word; a word is a space mark and what follows up to the next one."""

    def __init__(self, vocab: list[tuple[str, float]]) -> None:
        self.automaton = ahocorasick.Automaton()
        last = {piece: score for piece, score in vocab if piece}
        for piece, score in last.items():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocab) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n, unknown = len(word), self.unknown
        score, pieces = [0.0] * (n + 1), [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.automaton.iter(word):
            ends[end].append(match)
        for end in range(n):
            best, single = None, False
            for length, gain in sorted(ends[end], reverse=True):
                start = end + 1 - length
                single |= length == 1
                total = score[start] + gain
                if best is None or total > best:
                    best, count = total, pieces[start] + 1
            if not single:
                total = score[end] + unknown
                if best is None or total > best:
                    best, count = total, pieces[end] + len(word[end].encode())
            score[end + 1], pieces[end + 1] = best, count
        return pieces[n]

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_ENTRIES:
            self.clear()
        n = self.count(word)
        if len(word) < 64:
            self[word] = n
        return n

    def text(self, text: str | None) -> int:
        """Pieces of a text whose spaces become marks, one being put in front unless it begins with one."""
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        if marked[0] != SPACE:
            marked = SPACE + marked
        return sum(self[SPACE + w] for w in marked[1:].split(SPACE))


_READY: dict[int, CountingViterbi] = {}


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_tokens long). Null and empty texts count zero; texts are taken whole; other columns aren't read.

    The vocabulary, of a file of at most MAX_MODEL_BYTES, is broadcast.
    """
    import os

    if os.path.getsize(path) > MAX_MODEL_BYTES:
        raise ValueError(f"{path} has more than {MAX_MODEL_BYTES} bytes")
    shared = df.sparkSession.sparkContext.broadcast(vocabulary(path))

    def setup():
        key = hash(tuple(shared.value))
        if key not in _READY:
            _READY.clear()
            _READY[key] = CountingViterbi(shared.value)
        return lambda texts: [list(map(_READY[key].text, texts))]

    return map_texts(df, id_col, text_col, setup, [field("n_tokens", "long")])
