"""Operator 8: SimHash near-duplicates by pigeonhole blocks.

Equal fingerprints are merged first, so that thousands of copies are one row. A fingerprint is cut into `blocks` parts;
two that differ in at most `distance` bits agree in blocks - distance parts at least, so each choice of that many parts
is a join key. With six parts and distance two a key has 42 bits or more. The join tests the Hamming distance itself, so that no
candidate pair leaves it; components come from alternating label propagation with pointer jumping over written tables.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import field, map_texts, stored

SEED = 42
DISTANCE = 2
BLOCKS = 6
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_SPACE = bytes(32 if i in (9, 10, 11, 12, 13) else i for i in range(256))
#: Hashes whose bits are counted at once.
SLICE = 1 << 16


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = SEED) -> int:
    """64 bits: bit b is 1 if over half of the shingles' hashes have it. No words: zero."""
    words = [w for w in (text or b"").translate(_LOWER).translate(_SPACE).split(b" ") if w]
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, seed) for s in shingles], dtype="<u8")
    counts = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), SLICE):
        counts += np.unpackbits(hashes[lo : lo + SLICE].view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """Rows (id, fp long): the fingerprint's 64 bits as a signed long. Null and empty texts have fingerprint zero."""

    def setup():
        return lambda texts: [np.array([fingerprint(t, shingle) for t in texts], dtype="<u8").view("<i8").tolist()]

    return map_texts(df, id_col, text_col, setup, [field("fp", "long")], as_bytes=True)


def links(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct fingerprints in fps.fp at most `distance` bits apart; a pair may repeat."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    keys = []
    for n, kept in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in kept)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        keys.append(F.struct(F.lit(n).cast("byte").alias("n"), F.col("fp").bitwiseAND(F.lit(signed).cast("long")).alias("v")))
    keyed = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", F.col("k.n").alias("n"), F.col("k.v").alias("v"))
    # Rows alone in their block meet nobody: only blocks of two or more are joined.
    shared = keyed.groupBy("n", "v").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("n", "v")
    left = keyed.join(shared, ["n", "v"]).alias("a")
    right = keyed.alias("b")
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= distance
    return left.join(right, (F.col("a.n") == F.col("b.n")) & (F.col("a.v") == F.col("b.v")) & (F.col("a.fp") < F.col("b.fp")) & near).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))


def components(nodes: DataFrame, edges: DataFrame, limit: int = 60) -> DataFrame:
    """Rows (node, root): the least label reachable. nodes: (node, label); edges: (a, b) over nodes.

    Each round takes the least label of the neighbours, then of the label's own holder (pointer jumping), until
    nothing changes; labels only fall, so that a repeated round does no harm. Rounds are written tables.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    linked = both.select(F.col("a").alias("node")).distinct()
    labels = stored(nodes.join(linked, "node", "left_semi").select("node", F.col("label").alias("root")), "labels")
    for _ in range(limit):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        # A label is the name of a group of nodes: the least label that any of its members has reached serves them all.
        jump = step.groupBy(F.col("old").alias("name")).agg(F.min("root").alias("best"))
        step = step.join(jump, F.col("old") == F.col("name")).select("node", "old", F.least("root", "best").alias("root"))
        step = stored(step, "round")
        if step.where("old <> root").isEmpty():
            break
        labels = step.select("node", "root")
    else:
        raise RuntimeError(f"components didn't settle in {limit} rounds")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("root", "label").alias("root"))


def classes(fps: DataFrame, id_col: str = "doc_id", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Rows (fp, component_id) for the distinct fingerprints of fps, a table that is read more than once.

    component_id is the least id reachable over links; a null id counts for nothing there, and a component of null ids
    alone has a null component_id.
    """
    nodes = stored(fps.groupBy("fp").agg(F.min(id_col).alias("label")), "nodes")
    known = nodes.select(F.col("fp").alias("node"), F.coalesce(F.col("label"), F.lit(2**63 - 1)).cast("long").alias("label"))
    # Nodes are told apart by fingerprint and named by label; ids that repeat with different texts share a label,
    # which would join their groups, so the name is made unique first.
    named = known.select("node", F.struct("label", "node").alias("label"))
    done = components(named, links(nodes.select("fp"), distance, blocks))
    return done.select(F.col("node").alias("fp"), F.nullif(F.col("root.label"), F.lit(2**63 - 1)).alias("component_id"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """Rows (id, fingerprint string, component_id long), one for each row of df.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows
    are in one component; an empty table gives none.
    """
    fps = stored(fingerprints(df, id_col, text_col, shingle), "fps")
    found = classes(fps, id_col, distance, blocks)
    return fps.join(found, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The rows of df without all but one document of each component: that with the least id.

    Of repeated rows with that id, one stays. Rows with a null id stay only where their whole component has none.
    """
    one = stored(near_duplicates(df, id_col, text_col, shingle), "classes")
    if one.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return df.join(one.where(F.col(id_col) == F.col("component_id")).select(id_col), id_col, "left_semi").select(df.columns)
    return _exact(df, id_col, text_col, shingle)


def _exact(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """The same where ids repeat or are null: rows are told apart by a digest of id and text."""
    digest = F.sha2(F.concat_ws("\x00", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = stored(df.withColumn("_vellum_key", digest), "rows")
    fps = stored(fingerprints(rows.dropDuplicates(["_vellum_key"]), "_vellum_key", text_col, shingle).join(rows.select("_vellum_key", id_col).distinct(), "_vellum_key"), "keyed")
    found = fps.join(classes(fps.select("fp", id_col), id_col), "fp")
    group = F.struct(F.coalesce("component_id", F.lit(2**63 - 1)), F.when(F.col("component_id").isNull(), F.col("fp")))
    kept = found.groupBy(group.alias("g")).agg(F.min(F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("i"), F.col("_vellum_key"))).alias("m")).select(F.col("m._vellum_key").alias("_vellum_key"))
    return rows.join(kept, "_vellum_key", "left_semi").dropDuplicates(["_vellum_key"]).drop("_vellum_key").select(df.columns)
