"""One query for each training-data operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import audit, decontam, langid, linededup, media, mixing, negatives, quality, rules, secrets, sharding, simhash, tokens
from weft.llm.common import fold
from weft.runtime import load


def _held_out(parts: int, part: int):
    return F.coalesce(fold("doc_id", parts) == part, F.lit(False)).alias("held_out")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(load(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(load(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_contamination(docs, load(spark, sf_dir, "benchmark"))
    result = F.col("contamination")
    return found.select("doc_id", result["n_words"].alias("n_words"), result["n_hit"].alias("n_hit"), F.size(result["items"]).cast("long").alias("n_items"), decontam.items_digest(result["items"]).alias("items_sha256"), decontam.contaminated(result).alias("contaminated"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = langid.fit(docs)
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", _held_out(langid.FOLDS, langid.HELD_OUT), "lang_pred", "score")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "layers")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_report(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.section_tokens(load(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", _held_out(quality.FOLDS, quality.HELD_OUT), "score", (F.col("score") >= quality.ACCEPT).cast("int").alias("predicted"))


def op10_sharding(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    text = F.col("text")
    rows = load(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = sharding.assign_shards(rows, "doc_id", [1.0] * shards)
    placed = sharding.assign_shards(placed, "doc_id", [1.0] * (shards + 1), "grown_shard")
    return sharding.number_slots(placed).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(audit.mask_counts(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.quantized(load(spark, sf_dir, "embeddings")), F.col("id") % 100 == 0)


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.judged(load(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_language": op4_language,
    "op5_media": op5_media,
    "op6_secrets": op6_secrets,
    "op7_line_dedup": op7_line_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_sharding": op10_sharding,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_rules": op13_quality_rules,
}
ORACLES: dict[str, str] = {"op2_mixing": mixing.ORACLE, "op3_decontamination": decontam.ORACLE, "op7_line_dedup": linededup.ORACLE, "op11_filter_audit": audit.ORACLE, "op12_hard_negatives": negatives.ORACLE}
