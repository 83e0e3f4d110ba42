"""One query per operator over the documents table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import common


def _op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.substring import substring_dedup

    return substring_dedup(common.documents(spark, sf_dir), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")


def _op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.suffix import suffix_dedup

    return suffix_dedup(common.documents(spark, sf_dir), keep_bytes=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.simhash import simhash_components

    return simhash_components(common.documents(spark, sf_dir))


def _op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.rans import token_files

    return token_files(common.documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def _op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from plumbline.llm.bpe import bpe_round_trip

    out = bpe_round_trip(common.documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def _op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.media import text_media

    return text_media(common.documents(spark, sf_dir))


def _op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item found in every document: doc_id, item_id, distance."""
    from plumbline.llm.decontam import matches

    return matches(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "item_id", "distance")


def _remainder(n: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def _op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.langid import identify

    out = identify(common.documents(spark, sf_dir), _remainder(5) != 0)
    return out.select("doc_id", (_remainder(5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


def _op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.quality import classify

    out = classify(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", _remainder(4) != 2)
    return out.select("doc_id", (_remainder(4) == 2).alias("held_out"), "score", "predicted")


def _op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm import pii

    out = pii.find_spans(common.documents(spark, sf_dir))
    n = [pii.counts("spans", k).alias(f"n_{kind}") for k, kind in enumerate(pii.KINDS)]
    return out.select("doc_id", *n[:4], F.sha2(pii.written("base"), 256).alias("base_sha256"), pii.written("spans").alias("spans"), n[4])


def _op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.jaccard import jaccard_components

    return jaccard_components(common.documents(spark, sf_dir))


def _op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.divergence import source_divergence

    return source_divergence(common.documents(spark, sf_dir))


def repeat_words(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting that the query of op13 is defined with: every tenth document gets a period by its id; no id, no change."""
    h = zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if doc_id is None or h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from plumbline.llm.periodic import periodic_runs

    out = periodic_runs(common.documents(spark, sf_dir), rewrite=repeat_words, keep_text=False)
    size = lambda x, y: x["length"] * y["period"]
    before = lambda x, y: (size(x, y) > size(y, x)) | ((size(x, y) == size(y, x)) & ((x["start"] < y["start"]) | ((x["start"] == y["start"]) & (x["period"] < y["period"]))))
    best = F.get(F.array_sort("runs", lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0)), F.lit(0))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), "collapsed_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": _op1,
    "op2_decontamination": _op2,
    "op3_language_id": _op3,
    "op4_token_files": _op4,
    "op5_quality": _op5,
    "op6_suffix_dedup": _op6,
    "op7_simhash_near_dedup": _op7,
    "op8_byte_bpe": _op8,
    "op9_media_columns": _op9,
    "op10_pii": _op10,
    "op11_jaccard_join": _op11,
    "op12_source_divergence": _op12,
    "op13_periodic_runs": _op13,
}
