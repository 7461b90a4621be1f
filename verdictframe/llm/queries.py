"""The registered queries of this subpackage, one for each operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdictframe.llm import language_id, media, mixing, packing, simhash, substring_dedup, token_counts, token_files, topk, toxicity

#: The vocabulary that the token queries use.
VOCABULARY = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.nearest_of_every(table(spark, sf_dir, "embeddings"), k=20, every=20, scale=64)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_spans(table(spark, sf_dir, "documents")).drop("tag")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pack_along_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), length=2048, end_id=1)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    uri, shards = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), end_id=0)
    return token_files.read_token_files(uri, shards)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pivot_topk": op1_pivot_topk,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_pack_along_curve": op5_pack_along_curve,
    "op6_simhash": op6_simhash,
    "op7_media_chunks": op7_media_chunks,
    "op8_token_counts": op8_token_counts,
    "op9_token_files": op9_token_files,
    "op10_language_id": op10_language_id,
}

#: DuckDB SQL of those that SQL can express.
SQL: dict[str, str] = {
    "op1_pivot_topk": (
        "WITH e AS (SELECT row_number() OVER () AS nr, vec_id, [floor(64 * CAST(c AS DOUBLE)) FOR c IN embedding] AS v FROM embeddings "
        "WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0), "
        "x AS (SELECT nr, vec_id, v FROM e WHERE coalesce(list_sum([c * c FOR c IN v]), 0) < 4611686018427387904), "
        "s AS (SELECT q.nr AS query, q.vec_id AS query_id, x.vec_id, CAST(list_dot_product(q.v, x.v) AS BIGINT) AS score FROM x AS q JOIN x ON q.nr <> x.nr AND len(q.v) = len(x.v) WHERE q.vec_id % 20 = 0), "
        "r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) SELECT * FROM r WHERE rank <= 20"
    ),
}
