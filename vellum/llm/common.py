"""Helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..plans.tables import shared_dir, stored  # noqa: F401 (operators take them from here)

#: Bytes of text given to a Python function at once; a longer text goes alone.
CHUNK_BYTES = 4 << 20
#: Rows of a few dozen bytes that are broadcast at most.
BROADCAST_ROWS = 100_000


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def unused(name: str, *frames: DataFrame) -> str:
    """A name like `name` that no column of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while f"_{name}" in taken:
        name += "_"
    return f"_{name}"


def small(keys: DataFrame, column: str) -> DataFrame:
    """A written table of keys of a few dozen bytes, to be broadcast while there are at most BROADCAST_ROWS, else joined by shuffle."""
    return F.broadcast(keys) if keys.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else keys


def total_bytes(df: DataFrame, text_col: str) -> int:
    return int(df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0)


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most `limit` bytes, one row at least."""
    import pyarrow.compute as pc

    lo = size = 0
    for i, n in enumerate(pc.binary_length(column).to_pylist()):
        if i > lo and size + (n or 0) > limit:
            yield lo, i
            lo, size = i, 0
        size += n or 0
    if lo < len(column):
        yield lo, len(column)


def map_texts(df: DataFrame, id_col: str, text_col: str, setup: Callable[[], Callable[[list], list]], fields: list[T.StructField], as_bytes: bool = False) -> DataFrame:
    """One row for each row of df: its id, then `fields`, computed from chunks of texts in Arrow batches.

    setup() runs once a partition and returns the function of a list of texts (None for null). Columns of df other
    than these two aren't read, so that their names can't clash.
    """
    out = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), *fields])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            texts = batch.column(1)
            if as_bytes:
                texts = texts.cast(pa.binary())
            for lo, hi in chunks(texts):
                columns = work(texts.slice(lo, hi - lo).to_pylist())
                ids = batch.column(0).slice(lo, hi - lo).cast(arrow.field(0).type)
                yield pa.RecordBatch.from_arrays([ids, *(c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, out)


def field(name: str, kind: T.DataType | str) -> T.StructField:
    return T.StructField(name, T._parse_datatype_string(kind) if isinstance(kind, str) else kind)
