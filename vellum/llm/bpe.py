"""Operator 1: byte-level BPE encoding and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary finds the longest token
at each position. A sequence of tokens is the result of the merges exactly if each adjacent pair is its own encoding;
so the encoder takes longest matches and backtracks to shorter ones wherever a pair isn't. Pair tests are memoised, and
a position found hopeless is never tried again, which makes the time linear in the length of a piece.
"""

from __future__ import annotations

import base64
import hashlib
import sys
from array import array

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, map_texts

#: The vocabulary file is broadcast; a larger one is refused.
MAX_VOCABULARY_BYTES = 64 << 20
#: Bytes of a generation of a Python worker's cache of parts; there are two, and a quarter as much for pieces.
CACHE_BYTES = 32 << 20
#: Bytes that an entry takes besides the characters of its key and its value.
ENTRY_BYTES = 200
#: Memoised pairs of tokens; a full memo starts anew.
PAIR_ENTRIES = 200_000


def parse_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class BacktrackEncoder:
    """The exact merges of a table of ranks, without merging."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self.width = max(ranks.values()) + 1
        self.automaton = ahocorasick.Automaton()
        #: By id: bytes of a token, its longest proper prefix that is a token (-1: none), and the two tokens that its last merge joins.
        self.length, self.shorter, self.halves = {}, {}, {}
        self.joined: dict[int, int] = {}
        self.pairs: dict[int, bool] = {}
        for b, i in sorted(ranks.items(), key=lambda x: (len(x[0]) > 1, x[1])):
            if self._learn(b, i):
                self.automaton.add_word(b.decode("latin-1"), (i, len(b)))
        self.automaton.make_automaton()
        for b, i in ranks.items():
            if i in self.halves:
                self.shorter[i] = next((ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if ranks.get(b[:n]) in self.halves), -1)

    def _learn(self, b: bytes, i: int) -> bool:
        """Finds the last merge of a token from tokens of lower rank; False if there is none, so that merges never make it."""
        ranks, known = self.ranks, self.halves
        if len(b) == 1:
            known[i] = (i, i)
        for n in range(len(b) - 1, 0, -1):
            a, rest = ranks.get(b[:n]), ranks.get(b[n:])
            if a in known and rest in known and self._compatible(a, rest):
                known[i] = (a, rest)
                self.joined[a * self.width + rest] = i
                break
        self.length[i] = len(b)
        return i in known

    def _compatible(self, a: int, b: int) -> bool:
        """Whether merging keeps the border between tokens a and b.

        Merges are undone from the latest on, beside the border: had two of the tokens met there been joined before a later
        merge of either side, the border would be gone.
        """
        joined, halves, width, limit = self.joined, self.halves, self.width, 1 << 62
        while True:
            if joined.get(a * width + b, limit) < limit:
                return False
            # A single byte is its own half and can't be undone.
            one, two = halves[a][1], halves[b][0]
            if one != a and (a > b or two == b):
                limit, a = a, one
            elif two != b:
                limit, b = b + 1, two
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        key = a * self.width + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIR_ENTRIES:
                self.pairs.clear()
            known = self.pairs[key] = self._compatible(a, b)
        return known

    def encode(self, piece: bytes) -> list[int]:
        """Token ids of one piece, a match of the splitting pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n, length, shorter = len(piece), self.length, self.shorter
        # Matches come by their ends, so that the last one seen from a start is the longest.
        longest = [-1] * n
        for end, (i, size) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = i
        tokens: list[int] = []
        dead, at, take = bytearray(n + 1), 0, longest[0] if n else -1
        while at < n:
            end = at + length[take]
            if not dead[end] and (not tokens or self.fits(tokens[-1], take)):
                tokens.append(take)
                at = end
                if at < n:
                    take = longest[at]
                continue
            take = shorter[take]
            while take < 0:
                dead[at] = 1
                last = tokens.pop()
                at -= length[last]
                take = shorter[last]
        return tokens


class Unsafe(Exception):
    """A text that can't be cut before each of its spaces."""


class Cache(dict):
    """Values by key, in two generations of at most `limit` bytes each: a full one becomes the old one, from which what is used again comes back."""

    def __init__(self, limit: int) -> None:
        self.limit, self.most, self.size, self.old = limit, limit // 64, 0, {}

    def keep(self, key: str, value: bytes) -> bytes:
        cost = 4 * len(key) + len(value) + ENTRY_BYTES
        if cost <= self.most:
            self.size += cost
            if self.size > self.limit:
                self.old = dict(self)
                self.clear()
                self.size = cost
            self[key] = value
        return value


class PieceCache(Cache):
    """Packed ids of a piece."""

    def __init__(self, encode, code: str, limit: int) -> None:
        super().__init__(limit)
        self.encode, self.code = encode, code

    def __missing__(self, piece: str) -> bytes:
        known = self.old.get(piece)
        return self.keep(piece, self.pack(piece) if known is None else known)

    def pack(self, piece: str) -> bytes:
        return array(self.code, self.encode(piece)).tobytes()


class PartCache(Cache):
    """Packed ids of a space and the text up to the next one.

    A space with something other than white space behind it always begins a match of the pattern, so that a text can be
    cut there; a part that is empty or begins with white space tells that this isn't so.
    """

    def __init__(self, pieces: PieceCache, pattern: regex.Pattern, limit: int) -> None:
        super().__init__(limit)
        self.pieces, self.findall = pieces, pattern.findall

    def __missing__(self, part: str) -> bytes:
        packed = self.old.get(part)
        if packed is None:
            if part.isalpha():
                packed = self.pieces.pack(" " + part)
            else:
                first, *rest = self.findall(" " + part)
                if len(first) < 2 or first[1].isspace() or first[1] in "\x85᠎":
                    raise Unsafe
                packed = b"".join([self[first[1:]], *map(self.pieces.__getitem__, rest)]) if rest else self.pieces.pack(first)
        return self.keep(part, packed)


class TextEncoder:
    """Whole texts to packed little-endian ids, with caches of bounded bytes over an encoder of pieces.

    code: array's type code of an id, I (32 bits) or H (16 bits).
    """

    def __init__(self, encode_piece, pattern: str, code: str = "I", limit: int = CACHE_BYTES) -> None:
        if sys.byteorder != "little":
            raise NotImplementedError("ids are packed in the machine's byte order, which must be little-endian")
        self.pattern = regex.compile(pattern)
        self.pieces = PieceCache(encode_piece, code, limit // 4)
        self.parts = PartCache(self.pieces, self.pattern, limit)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            tail = b"".join(map(self.parts.__getitem__, rest))
        except Unsafe:
            return b"".join([self.pieces[p] for p in self.pattern.findall(text)])
        return b"".join([self.pieces[p] for p in self.pattern.findall(first)]) + tail


class Decoder:
    """The bytes of ids; an id that the vocabulary lacks stands for nothing."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.table = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            self.table[i] = b

    def __call__(self, packed: bytes | None) -> bytes:
        ids = np.frombuffer(packed or b"", dtype="<u4")
        if len(ids) and int(ids.max()) >= len(self.table):
            ids = ids[ids < len(self.table)]
        return b"".join(map(self.table.__getitem__, ids.tolist()))


_READY: dict[str, tuple[TextEncoder, Decoder]] = {}


def _coders(data: bytes, pattern: str) -> tuple[TextEncoder, Decoder]:
    """One pair a Python worker: both share the vocabulary's bytes."""
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        ranks = parse_ranks(data)
        bpe = BacktrackEncoder(ranks)
        _READY[key] = TextEncoder(lambda piece: bpe.encode(piece.encode()), pattern), Decoder(ranks)
    return _READY[key]


def _vocabulary(spark: SparkSession, path: str):
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(data)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids binary): the token ids of each text as little-endian unsigned 32-bit integers.

    A null or empty text has none. Repeated rows and null ids stay as they are; other columns aren't read. Texts of any
    length are taken whole.
    """
    data = _vocabulary(df.sparkSession, path)

    def setup():
        one, _ = _coders(data.value, pattern)
        return lambda texts: [[one(t) for t in texts]]

    return map_texts(df, id_col, text_col, setup, [field("ids", "binary")])


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Rows (id, ids, decoded binary): the bytes that the ids stand for.

    Null or empty ids give empty bytes; ids that the vocabulary lacks stand for nothing.
    """
    data = _vocabulary(df.sparkSession, path)

    def setup():
        one = Decoder(parse_ranks(data.value))
        return lambda rows: [rows, [one(r) for r in rows]]

    return map_texts(df, id_col, ids_col, setup, [field(ids_col, "binary"), field("decoded", "binary")])


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, ids binary, decoded binary): encode(), then decode() of its ids, in one pass of one Python worker."""
    data = _vocabulary(df.sparkSession, path)

    def setup():
        one, back = _coders(data.value, pattern)

        def work(texts):
            ids = [one(t) for t in texts]
            return [ids, [back(i) for i in ids]]

        return work

    return map_texts(df, id_col, text_col, setup, [field("ids", "binary"), field("decoded", "binary")])


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encoded, then decoded: counts and digests of both."""
    both = round_trip(df, path, pattern, id_col, text_col)
    return both.select(id_col, (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
