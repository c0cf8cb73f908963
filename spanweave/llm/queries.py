"""The thin ``opN_<name>`` queries: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from spanweave.llm import bpe, counts, langid, licenses, media, mixing, neighbours, shards, simhash, substrings
from spanweave.llm.common import documents

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_order(documents(spark, sf_dir))


def op2_media_png(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_and_describe(documents(spark, sf_dir))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_documents(documents(spark, sf_dir))


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_tokens(documents(spark, sf_dir), PIECE_BPE)


def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest(vectors, lambda vec_id: vec_id % 50 == 0)


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op10_substring_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_digests(documents(spark, sf_dir))


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), BYTE_BPE)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_training_order": op1_training_order,
        "op2_media_png": op2_media_png,
        "op3_license_scan": op3_license_scan,
        "op4_crf_language": op4_crf_language,
        "op5_simhash_groups": op5_simhash_groups,
        "op6_projection_forest": op6_projection_forest,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_pivotal_mix": op8_pivotal_mix,
        "op9_token_counts": op9_token_counts,
        "op10_substring_spans": op10_substring_spans,
    }


#: Windows of 50 words, the least doc_id of each, and the words they cover.
OP10_SQL = r"""
WITH split AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k
    FROM split, unnest(range(1, len(w) - 48)) AS t(i)
), least AS (
    SELECT k, min(doc_id) AS low FROM windows GROUP BY k
), gone AS (
    SELECT doc_id, i + j AS place
    FROM windows JOIN least USING (k), unnest(range(0, 50)) AS t(j)
    WHERE low < doc_id
    GROUP BY doc_id, i + j
), lists AS (
    SELECT doc_id, list(place) AS places FROM gone GROUP BY doc_id
), words AS (
    SELECT doc_id, i, w[i] AS word FROM split, unnest(range(1, len(w) + 1)) AS t(i)
), kept AS (
    SELECT words.doc_id, string_agg(word, ' ' ORDER BY i) AS text
    FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.place = words.i
    WHERE gone.place IS NULL GROUP BY words.doc_id
)
SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(lists.places), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM split LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op10_substring_spans": OP10_SQL}
