"""Registered queries of the folder: the operators over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticktote.llm import chat, decontaminate, exact_dedup, line_dedup, ngram_join, packing, ppm, quality, spelling, suffix_dedup, surrogates, warc, whitening
from ticktote.llm.common import shared_path
from ticktote.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    got = decontaminate.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return got.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


@query
def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")


@query
def op3_quality_classifier(spark: SparkSession, sf: str) -> DataFrame:
    got = quality.quality_scores(table(spark, sf, "documents"), quality.good_labels(table(spark, sf, "labels")))
    return got.select(F.col("id").alias("doc_id"), *[F.round(c, 6).alias(c) for c in ("text_score", "meta_score", "score")], (F.col("score") >= 0.5).alias("kept"))


@query
def op4_warc(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_archive(table(spark, sf, "pages"), path)
    got = warc.captures(spark, path).where("record_type is not null")
    return got.select(F.col("page").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_page").cast("long").alias("refers_to"))


@query
def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    got = chat.rotate(table(spark, sf, "conversations"))
    size = F.aggregate("masks", F.lit(0).cast("long"), lambda a, m: a + m["end"] - m["start"])
    return got.select(
        F.col("conv").alias("conv_id"), "part", "speaker", "n_turns", F.length("text").cast("long").alias("n_chars"), size.alias("n_masked"),
        F.array_join(F.transform("masks", lambda m: F.concat_ws("-", m["start"], m["end"])), ",").alias("masks"), F.sha2("text", 256).alias("text_sha256"))


@query
def op6_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_components(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query
def op7_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = suffix_dedup.cut_repeats(table(spark, sf, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


@query
def op8_ppm_scores(spark: SparkSession, sf: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf, "documents")).withColumnRenamed("id", "doc_id")


@query
def op9_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = exact_dedup.exact_groups(table(spark, sf, "documents"))
    return got.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


@query
def op10_pii_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    got = surrogates.pseudonymise(docs, key="ticktote")

    def of(kind: str) -> Column:
        return F.size(F.filter("entity_kinds", lambda k: F.split(k, ":")[0] == kind)).cast("long").alias(f"n_{kind}")

    return got.select("doc_id", F.size("entity_kinds").cast("long").alias("n_entities"), *[of(kind) for kind in surrogates.TYPES], "text")


@query
def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf, "documents"), typo_step=spelling.TYPO_STEP)


@query
def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.whitened_rows(table(spark, sf, "embeddings")).withColumnRenamed("id", "vec_id")


@query
def op13_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    got = line_dedup.drop_lines(table(spark, sf, "documents"))
    return got.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))
