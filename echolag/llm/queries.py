"""One query per operator over its whole table, and the SQL equal to it where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    exact_dedup,
    language_id,
    licenses,
    minhash,
    mixing,
    packing,
    personal,
    quality_knn,
    quality_rules,
    sql,
    toxicity,
    variants,
    warc,
    whitening,
)
from .text import table


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    names = F.array_sort(F.array_distinct("matches.license"))
    return scanned.select(
        "doc_id",
        "n_units",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(names, ",").alias("licenses"),
        F.array_max("matches.dice").alias("best_dice"),
    )


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def _held_out(parts: int, part: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == part


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    machine = toxicity.learn(docs, table(spark, sf_dir, "labels"), _held_out(3, 1))
    scored = toxicity.score(docs, machine)
    return scored.select("doc_id", _held_out(3, 1).alias("held_out"), "score", "predicted")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tree = language_id.learn(docs, _held_out(4, 2))
    found = language_id.identify(docs.select("doc_id", "text"), tree)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), "lang_pred", "score")


def op10_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    neighbours = quality_knn.learn(docs, table(spark, sf_dir, "labels"), _held_out(5, 0))
    scored = quality_knn.score(docs, neighbours)
    return scored.select("doc_id", _held_out(5, 0).alias("held_out"), "score", "predicted")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.find_personal(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[personal.count_kind(F.col("base"), kind).alias(f"n_{kind}") for kind in personal.KINDS],
        F.sha2(personal.spans_text(F.col("base")), 256).alias("base_sha256"),
        personal.spans_text(F.col("spans")).alias("spans"),
    )


QUERIES = {
    "op11_spelling_variants": op11_spelling_variants,
    "op12_whitening": op12_whitening,
    "op13_personal_data": op13_personal_data,
    "op10_quality_knn": op10_quality_knn,
    "op5_toxicity": op5_toxicity,
    "op8_language_id": op8_language_id,
    "op1_minhash": op1_minhash,
    "op2_license_scan": op2_license_scan,
    "op3_source_mix": op3_source_mix,
    "op4_warc": op4_warc,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_packing": op7_packing,
    "op9_quality_rules": op9_quality_rules,
}

SQL = {
    "op11_spelling_variants": sql.SPELLING_VARIANTS,
    "op2_license_scan": sql.LICENSE_SCAN,
    "op4_warc": sql.WARC,
    "op3_source_mix": sql.SOURCE_MIX,
    "op6_exact_dedup": sql.EXACT_DEDUP,
    "op9_quality_rules": sql.QUALITY_RULES,
}
