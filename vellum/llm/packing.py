"""Operator 5: token ids in fixed-width bit-packed files.

A file holds the ids of documents in ascending order of id. Each id takes the bits of the largest id of the
vocabulary. Ids come in blocks of BLOCK, each of which begins at a byte whose offset the footer keeps, so that any
document is read from its first block on and a block is unpacked by numpy at once.

Layout: magic, blocks, footer (bits, counts, block offsets, document ids, null flags, lengths), footer length, magic.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import struct
import uuid
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import TextEncoder
from .common import chunks, shared_dir, total_bytes

MAGIC = b"VTB1"
BLOCK = 1 << 15
#: Text bytes whose ids go to one file.
FILE_BYTES = 16 << 20
#: Bytes of a generation of a Python worker's cache of parts of texts.
CACHE_BYTES = 112 << 20
#: Files at most, and rows for each of them that decide where files begin.
MAX_FILES = 1 << 16
SAMPLED = 200
MAX_VOCABULARY_BYTES = 64 << 20


def pack(ids: np.ndarray, bits: int) -> bytes:
    """ids in `bits` bits each, lowest bit first, the last byte filled with zeros."""
    if bits in (8, 16, 32):
        return np.ascontiguousarray(ids, dtype=f"<u{bits // 8}").tobytes()
    flat = np.unpackbits(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(flat[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    flat = np.unpackbits(np.frombuffer(data, dtype=np.uint8), bitorder="little", count=n * bits).reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(n)


class TokenFileWriter:
    """Streams documents to a file; the ids of less than one block are held."""

    def __init__(self, sink, bits: int, block: int = BLOCK) -> None:
        self.sink, self.bits, self.block = sink, bits, block
        self.sink.write(MAGIC)
        self.at, self.held, self.n_held = len(MAGIC), [], 0
        self.offsets, self.ids, self.lengths = [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            flat = np.concatenate(self.held)
            for lo in range(0, len(flat) - self.block + 1, self.block):
                self._write(flat[lo : lo + self.block])
            rest = flat[len(flat) // self.block * self.block :].copy()
            self.held, self.n_held = [rest], len(rest)

    def _write(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.sink.write(data)
        self.at += len(data)

    def close(self) -> None:
        if self.n_held:
            self._write(np.concatenate(self.held))
        footer = struct.pack("<IIQQ", self.bits, self.block, len(self.ids), sum(self.lengths))
        footer += np.array(self.offsets, dtype="<u8").tobytes()
        footer += np.array([i or 0 for i in self.ids], dtype="<i8").tobytes() + np.array([i is None for i in self.ids], dtype=np.uint8).tobytes()
        footer += np.array(self.lengths, dtype="<u8").tobytes()
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        self.sink.close()


class TokenFile:
    """Random access to a packed file by a seekable source: documents by index, ids by position."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        source.seek(size - 12)
        n, magic = struct.unpack("<Q4s", source.read(12))
        if magic != MAGIC:
            raise ValueError("no token file, or one that was cut off")
        source.seek(size - 12 - n)
        footer = source.read(n)
        self.bits, self.block, docs, self.n_tokens = struct.unpack_from("<IIQQ", footer)
        at, blocks = 24, -(-self.n_tokens // self.block)
        self.offsets = np.frombuffer(footer, "<u8", blocks, at)
        at += 8 * blocks
        ids = np.frombuffer(footer, "<i8", docs, at)
        nulls = np.frombuffer(footer, np.uint8, docs, at + 8 * docs)
        self.lengths = np.frombuffer(footer, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.doc_ids = [None if z else int(i) for i, z in zip(ids, nulls, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)]).astype(np.int64)

    def tokens(self, lo: int, hi: int) -> np.ndarray:
        """The ids at positions lo..hi-1, from the blocks that hold them."""
        if hi <= lo:
            return np.zeros(0, dtype="<u4")
        first, last = lo // self.block, (hi - 1) // self.block
        out = []
        for k in range(first, last + 1):
            n = min(self.block, self.n_tokens - k * self.block)
            self.source.seek(int(self.offsets[k]))
            out.append(unpack(self.source.read(-(-n * self.bits // 8)), n, self.bits))
        return np.concatenate(out)[lo - first * self.block : hi - first * self.block]

    def document(self, index: int) -> np.ndarray:
        return self.tokens(int(self.starts[index]), int(self.starts[index + 1]))

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, position of the first token, ids) of each document, one block in memory at a time."""
        held, base, k = np.zeros(0, dtype="<u4"), 0, 0
        for i, doc_id in enumerate(self.doc_ids):
            lo, hi = int(self.starts[i]), int(self.starts[i + 1])
            parts = [held]
            while base + sum(map(len, parts)) < hi:
                parts.append(self.tokens(k * self.block, min(self.n_tokens, (k + 1) * self.block)))
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, lo, held[lo - base : hi - base]
            held, base = held[hi - base :], hi


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


class LibraryPieces:
    """Token ids of pieces by the tokenizers library's own model.

    The pieces are those of the library's byte-level splitting; its characters for bytes are applied here, so that
    known pieces needn't pass through the whole library again.
    """

    def __init__(self, config: str) -> None:
        import json

        from tokenizers import Tokenizer

        plain = json.loads(config)
        split = plain.get("pre_tokenizer") or {}
        if plain.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("a byte-level tokenizer without normalizer and prefix space is expected")
        if any(t.get(k) for t in plain.get("added_tokens") or [] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError("added tokens that look at their surroundings aren't known")
        self.tokenizer = Tokenizer.from_str(config)
        self.model = self.tokenizer.model
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # the library's own cache is full of the first words; ours follows what is used
        #: Strings that the library takes out of a text before it splits the rest.
        self.added = {t["content"]: t["id"] for t in plain.get("added_tokens") or []}
        self.largest = max(self.tokenizer.get_vocab().values())
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.table = {b: chr(b) for b in printable} | {b: chr(256 + n) for n, b in enumerate(others)}
        self.space = self.table[32]

    def __call__(self, piece: str) -> list[int]:
        plain = piece.replace(" ", self.space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.table)
        return [t.id for t in self.model.tokenize(plain)]


class LibraryEncoder:
    """Packed ids of whole texts as the library encodes them, with its added tokens' ids for their strings."""

    def __init__(self, config: str, pattern: str, bits: int) -> None:
        pieces = LibraryPieces(config)
        self.code = _code(bits)
        self.text = TextEncoder(pieces, pattern, self.code, CACHE_BYTES)
        self.added = {k: array(self.code, [i]).tobytes() for k, i in pieces.added.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def __call__(self, text: str | None) -> bytes:
        if not text or not any(k in text for k in self.added):
            return self.text(text)
        return b"".join([self.added[x] if x in self.added else self.text(x) for x in self.cut.split(text)])


def _code(bits: int) -> str:
    return "H" if bits <= 16 else "I"


_READY: dict[str, LibraryEncoder] = {}


def _library(config: str, pattern: str, bits: int) -> LibraryEncoder:
    key = hashlib.sha256(f"{bits}\n{pattern}\n{config}".encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = LibraryEncoder(config, pattern, bits)
    return _READY[key]


def _bounds(rows: DataFrame, files: int) -> list[tuple]:
    """At most files - 1 rising pairs (id is known, id, h), each the first of a file; rows: (id, h).

    They come from Spark's range partitioning of a part of the rows. The part only decides how even the files are, never what
    is in them. h, which takes a pass over all texts, is looked at only where some id has more rows than a file.
    """
    if files < 2:
        return []
    some = rows.sample(min(1.0, files * SAMPLED / max(1, rows.count())), seed=1)
    hot = not some.groupBy("id").count().where(F.col("count") > SAMPLED).isEmpty()
    least = F.col("h") if hot else F.lit(-(1 << 63)).cast("long")
    order = F.struct(F.col("id").isNotNull().alias("known"), F.coalesce("id", F.lit(0)).alias("id"), least.alias("h"))
    ranged = some.select(order.alias("x")).repartitionByRange(files, "x")
    firsts = ranged.groupBy(F.spark_partition_id().alias("p")).agg(F.min("x").alias("x")).select("x.*").collect()
    return sorted({(r["known"], r["id"], r["h"]) for r in firsts})[1:]


def write(df: DataFrame, path: str, pattern: str, end_id: int, out: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> list[dict]:
    """Writes the ids of every text, `end_id` behind each, in ascending order of id; returns a manifest entry per file.

    Null ids come first; rows with the same id come in order of a hash of their texts, so that an id that very many rows
    share spreads over files too. A null or empty text has the end id alone. An empty table gives no file. Each file is
    written under another name and then moved, so that a task that runs twice does no harm. The manifest has one short
    entry for each `file_bytes` of text, and MAX_FILES at most: beyond, files are larger. Other columns aren't read.
    """
    spark = df.sparkSession
    with open(path, encoding="utf-8") as f:
        config = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(config) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} has more than {MAX_VOCABULARY_BYTES} bytes")
    bits = max(LibraryPieces(config).largest, end_id).bit_length()
    code, kind = _code(bits), "<u2" if _code(bits) == "H" else "<u4"
    shared, out = spark.sparkContext.broadcast(config), out or f"{shared_dir(spark)}/tokens"
    files = min(MAX_FILES, max(1, -(-total_bytes(df, text_col) // file_bytes)))
    plain = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.col(text_col).alias("text"))
    edges = _bounds(plain.select("id", "h"), files)

    def encode(batches):
        one = _library(shared.value, pattern, bits)
        end = array(code, [end_id]).tobytes()
        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                ids, h = (batch.column(i).slice(lo, hi - lo).cast(pa.int64()) for i in (0, 1))
                whole = [one(t) + end for t in batch.column(2).slice(lo, hi - lo).to_pylist()]
                part = [bisect_right(edges, (i is not None, i or 0, x)) for i, x in zip(ids.to_pylist(), h.to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), ids, h, pa.array(whole, pa.binary())], names=["part", "id", "h", "ids"])

    def save(batches):
        fs, root = _filesystem(out)
        fs.create_dir(root, recursive=True)
        writer = current = name = None
        done = []

        def finish():
            if writer is not None:
                writer.close()
                final = posixpath.join(root, f"part-{current:08d}.vtb")
                fs.move(name, final)
                done.append((current, len(writer.ids), sum(writer.lengths)))

        for batch in batches:
            for lo, hi in chunks(batch.column(2)):
                for part, doc_id, ids in zip(*(batch.column(i).slice(lo, hi - lo).to_pylist() for i in range(3)), strict=True):
                    if part != current:
                        finish()
                        current, name = part, posixpath.join(root, f".{part}-{uuid.uuid4().hex}")
                        writer = TokenFileWriter(fs.open_output_stream(name), bits)
                    writer.add(doc_id, np.frombuffer(ids, kind))
        finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["part", "n_docs", "n_tokens"])

    encoded = plain.mapInArrow(encode, "part int, id long, h long, ids binary")
    ordered = encoded.repartition(files + 1, "part").sortWithinPartitions("part", F.asc_nulls_first("id"), "h", "ids")
    rows = sorted(ordered.select("part", "id", "ids").mapInArrow(save, "part int, n_docs long, n_tokens long").collect())
    start, manifest = 0, []
    for part, n_docs, n_tokens in rows:
        manifest.append({"path": f"{out.rstrip('/')}/part-{part:08d}.vtb", "start": start, "n_docs": n_docs, "n_tokens": n_tokens})
        start += n_tokens
    return manifest


def read(spark: SparkSession, manifest: list[dict], id_col: str = "doc_id") -> DataFrame:
    """Rows (id, start long, n_tokens long, ids binary as little-endian unsigned 32-bit integers) of written files."""
    files = spark.createDataFrame([(m["path"], m["start"]) for m in manifest], "path string, start long")

    def load(batches):
        for batch in batches:
            for uri, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = _filesystem(uri)
                with fs.open_input_file(name) as source:
                    rows, size = [], 0
                    for doc_id, lo, ids in TokenFile(source).documents():
                        rows.append((doc_id, base + lo, len(ids), ids.tobytes()))
                        size += 4 * len(ids)
                        if size > 4 << 20:
                            yield _rows(rows, id_col)
                            rows, size = [], 0
                    yield _rows(rows, id_col)

    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return files.repartition(max(1, len(manifest))).mapInArrow(load, schema)


def _rows(rows: list, id_col: str) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[id_col, "start", "n_tokens", "ids"])


def round_trip(df: DataFrame, path: str, pattern: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, n_tokens, ids_crc32 long) from files written for df. spark's crc32 is the same unsigned one as zlib's."""
    manifest = write(df, path, pattern, end_id, id_col=id_col, text_col=text_col)
    return read(df.sparkSession, manifest, id_col).select(id_col, "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
