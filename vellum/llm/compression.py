"""Operator 7: a language-model score from compression.

Two zstandard dictionaries are made of the corpus: the words of all documents, and those of the in-domain ones, each
by count times length, the best at the end, where matches are cheapest. A text's score is the difference of its sizes under both, for
each of its bytes: a positive score means that the in-domain dictionary serves it better.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, field, map_texts, stored, unused

DICTIONARY_BYTES = 110 << 10
LEVEL = 3
#: Distinct terms that a Python worker holds before it passes its counts on.
TERMS = 200_000
#: Bitmaps of 32,768 ids, of 4 KB each, that are broadcast at most.
BITMAPS = 16_384


def term_counts(df: DataFrame, domain_col: str, text_col: str = "text") -> DataFrame:
    """Rows (term binary, n long, n_in long): counts of each word, with the space before it, over all documents and in-domain ones."""

    def count(batches):
        whole: Counter = Counter()
        inner: Counter = Counter()

        def rows():
            terms = list(whole)
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([whole[t] for t in terms], pa.int64()), pa.array([inner[t] for t in terms], pa.int64())], names=["term", "n", "n_in"])

        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            for lo, hi in chunks(texts):
                for text, flag in zip(texts.slice(lo, hi - lo).to_pylist(), batch.column(1).slice(lo, hi - lo).to_pylist(), strict=True):
                    words = (text or b"").split()
                    whole.update(words)
                    if flag:
                        inner.update(words)
                    if len(whole) > TERMS:
                        yield rows()
                        whole.clear()
                        inner.clear()
        yield rows()

    partial = df.select(F.col(text_col).alias("text"), F.coalesce(F.col(domain_col), F.lit(False)).alias("flag")).mapInArrow(count, "term binary, n long, n_in long")
    return partial.groupBy("term").agg(F.sum("n").alias("n"), F.sum("n_in").alias("n_in"))


def dictionary(counts: DataFrame, n_col: str, size: int = DICTIONARY_BYTES) -> bytes:
    """The terms of the greatest count times length, as many as fit into `size` bytes, the greatest last.

    A histogram of gains, in steps of a sixteenth of a power of two, tells from which gain on the terms fill the dictionary;
    only those are sorted and reach the driver, whatever the number of partitions.
    """
    n_bytes = F.octet_length("term") + 1
    rows = counts.where(F.col(n_col) > 0).select("term", (F.col(n_col) * n_bytes).alias("gain"), n_bytes.alias("bytes")).withColumn("step", F.floor(F.log2("gain") * 16))
    cut, filled = None, 0
    for r in sorted(rows.where(F.col("bytes") <= size).groupBy("step").agg(F.sum("bytes").alias("bytes")).collect(), reverse=True):
        if filled >= size:
            break
        cut, filled = r["step"], filled + r["bytes"]
    if cut is None:
        return b""
    best = rows.where((F.col("step") >= cut) & (F.col("bytes") <= size)).select("term", "gain").orderBy(F.desc("gain"), "term").limit(size // 2).collect()
    out: list[bytes] = []
    for row in best:
        term = b" " + bytes(row["term"])
        if len(term) > size:
            break
        size -= len(term)
        out.append(term)
    return b"".join(reversed(out))


def sizes(df: DataFrame, general: bytes, inner: bytes, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """Rows (id, n_bytes long, size_in long, size_general long, score double).

    Null and empty texts have n_bytes 0 and score 0.0. Texts are compressed whole.
    """
    shared = df.sparkSession.sparkContext.broadcast((general, inner))

    def setup():
        def compressor(data: bytes):
            if len(data) < 8:
                return zstandard.ZstdCompressor(level=level)
            held = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(level=level)
            return zstandard.ZstdCompressor(level=level, dict_data=held)

        plain, own = map(compressor, shared.value)

        def work(texts):
            n = [len(t or b"") for t in texts]
            a = [len(own.compress(t or b"")) for t in texts]
            b = [len(plain.compress(t or b"")) for t in texts]
            return [n, a, b, [(y - x) / k if k else 0.0 for k, x, y in zip(n, a, b, strict=True)]]

        return work

    return map_texts(df, id_col, text_col, setup, [field("n_bytes", "long"), field("size_in", "long"), field("size_general", "long"), field("score", "double")], as_bytes=True)


def in_domain_ids(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The distinct ids of all rows labelled as of good quality and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(id_col).where(F.col(id_col).isNotNull()).distinct()


def flagged(df: DataFrame, ids: DataFrame, flag: str, id_col: str = "doc_id") -> DataFrame:
    """df with a boolean column `flag`: whether its id is one of `ids`, which are distinct; null for an id that isn't.

    Whole numbers become bitmaps, which are broadcast, so that df stays where it is at any size: a bit for each number in
    their range. Other ids, and numbers so far apart that they fill more than BITMAPS, are joined as they are.
    """
    if all(isinstance(x.schema[id_col].dataType, T.IntegralType) for x in (df, ids)):
        number, bits = unused("number", df), unused("bits", df)
        bucket = lambda x: F.bitmap_bucket_number(x[id_col].cast("long"))
        numbers = ids.select(bucket(ids).alias(number), F.bitmap_bit_position(ids[id_col].cast("long")).alias(bits))
        if numbers.select(number).distinct().limit(BITMAPS + 1).count() <= BITMAPS:
            maps = numbers.repartition(number).groupBy(number).agg(F.bitmap_construct_agg(bits).alias(bits))
            at = F.bitmap_bit_position(F.col(id_col).cast("long"))
            byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
            found = df.join(F.broadcast(maps), bucket(df) == maps[number], "left")
            return found.select(*(df[c] for c in df.columns), (F.getbit(byte, (at % 8).cast("int")) == 1).alias(flag))
    return df.join(ids.withColumn(flag, F.lit(True)), id_col, "left")


def compression_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """sizes() under dictionaries of df itself; the in-domain documents are all those of in_domain_ids().

    An empty table has no rows; without any labelled document the in-domain dictionary is empty.
    """
    texts = df.select(id_col, text_col)
    flag = unused("in", texts)
    counts = stored(term_counts(flagged(texts, in_domain_ids(labels, id_col), flag, id_col), flag, text_col), "terms")
    return sizes(df, dictionary(counts, "n"), dictionary(counts, "n_in"), id_col, text_col)
