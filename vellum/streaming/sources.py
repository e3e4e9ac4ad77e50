"""Sources that arrive over time: parsed records of each new file, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.project import parse


def parsed_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parse() rows for Parquet files (path, kind, text) that appear in a folder. Stateless: resolution
    across files needs the whole project and runs on what the stream has written."""
    return parse(spark.readStream.schema("path string, kind string, text string").parquet(folder))
