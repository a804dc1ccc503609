"""Queries that apply the operators to the driver tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelkit.llm import cotraining, exact_dedup, jaccard, line_dedup, lm, merkle, mixing, packing, repetition, search, toxicity, url_rules, warc

# The rules of the URL query.
URL_RULES = [
    url_rules.Rule("allow", "com", "/"),
    url_rules.Rule("block", "example.com", "/en/"),
    url_rules.Rule("allow", "www.example.com", "/en/"),
    url_rules.Rule("block", "net", "/es/"),
    url_rules.Rule("block", "net", "/fr/"),
]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf: str) -> DataFrame:
    judged = url_rules.judge_urls(table(spark, sf, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.repeated_lines(table(spark, sf, "documents"))
    # a document is one row of the table, so the number of its text is not needed to tell it
    return found.select(
        "doc_id",
        "n_lines",
        F.size("removed_lines").cast("bigint").alias("n_removed"),
        F.array_join("removed_lines", ",").alias("removed_lines"),
    )


def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents")).drop("source")


def op4_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return repetition.repetition_rules(table(spark, sf, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return cotraining.quality_scores(table(spark, sf, "documents"), table(spark, sf, "labels"))


def op7_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf, "documents"))


def op8_warc(spark: SparkSession, sf: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf, "pages"))
    return records.select(
        F.col("record_id").try_cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op9_lm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return lm.lm_scores(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    # of every other row, by a checksum of its key, a copy without line ends is held against the manifest
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = F.when(tampered, F.translate("text", "\n", "")).otherwise(F.col("text"))
    claimed = F.unhex(merkle.record_digest([*map(F.col, fields[:-1]), found]))
    rows = merkle.merkle_manifest(table(spark, sf, "documents"), fields=fields, carry={"claimed": claimed})
    siblings = F.array_join(F.zip_with("lefts", "rights", lambda a, b: F.concat(a, b)), "")
    rows = rows.withColumn("folded_root", merkle.folded_root(F.lower(F.hex("claimed")), F.col("lefts"), F.col("rights")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = table(spark, sf, "labels").where(~held_out)
    scored = toxicity.toxicity_scores(table(spark, sf, "documents"), labels)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    return search.ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_url_filters,
        op2_line_dedup,
        op3_source_mixing,
        op4_quality_rules,
        op5_best_fit_packing,
        op6_quality_classifier,
        op7_exact_dedup,
        op8_warc,
        op9_lm_scores,
        op10_jaccard_join,
        op11_merkle_manifest,
        op12_toxicity,
        op13_ranked_search,
    )
}
