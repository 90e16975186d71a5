"""Registered queries of the subpackage: each applies one operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from penmark.llm import centroid_clusters, chat_format, decontaminate, line_dedup, ngram_score, phrase_mining, pii, quality_classifier, quality_rules, sharding, simhash_dedup, source_mix, sql, substring_dedup
from penmark.plans.registry import Registry
from penmark.plans.tables import table

register = Registry()


@register()
def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash_dedup.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "fingerprint", "component_id")


@register(sql.line_dedup_sql())
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_templates(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register(sql.quality_rules_sql())
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = quality_rules.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdicts.select("doc_id", *quality_rules.COUNTS, "base_failed", "kept")


@register()
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mix.Mix(table(spark, sf_dir, "documents")).taken()


@register(sql.decontaminate_sql())
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", F.col("start").cast("bigint").alias("start"))


@register()
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register()
def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = chat_format.format_chats(table(spark, sf_dir, "conversations"))
    return chats.select("conv_id", "turn", "role", "n_parts", F.sha2("rendered", 256).alias("rendered_sha256"))


@register()
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [f"n_{k}" for k in pii.BASE_KINDS]
    n_spans = F.when(F.col("spans") == "", 0).otherwise(F.size(F.split("spans", ","))).cast("bigint")
    return found.select("doc_id", *counts, F.sha2("base", 256).alias("base_sha256"), "spans", n_spans.alias("n_spans"))


@register(sql.sharding_sql())
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.place(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "slot", "shard")


@register()
def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register()
def op11_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))


@register()
def op12_ngram_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_score.score_documents(table(spark, sf_dir, "documents"))


@register()
def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroid_clusters.cluster_vectors(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES, SQL = register.queries, register.sql
