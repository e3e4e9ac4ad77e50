"""The queries of the training-data operators, over the driver's tables, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import automaton, bpe, compression, decontam, packing, pii, quality, runindex, simhash, unigram
from .common import load

END_ID = 2


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runindex.suffix_dedup(load(spark, sf_dir, "documents"))


def op3_robust_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(load(spark, sf_dir, "documents")).drop("distance")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(load(spark, sf_dir, "documents"))


def op5_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.round_trip(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, END_ID)


def op6_unigram_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_compression_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.compression_scores(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(load(spark, sf_dir, "documents"))


def op9_word_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.word_dedup(load(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.verdicts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_byte_bpe, op2_suffix_dedup, op3_robust_quality, op4_pii, op5_packed_ids, op6_unigram_counts, op7_compression_scores, op8_simhash, op9_word_dedup, op10_decontamination)}

ORACLE_SQL: dict[str, str] = {}
