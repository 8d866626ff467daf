"""Registered queries of the corpus operators and their portable SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deeptime.llm import chat_format, decontaminate, exact_dedup, language_id, lsh_forest, merkle, packing, sanitise, simhash, token_alignment, toxicity, url_filters, warc
from deeptime.llm.common import table


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_archives(manifest, with_html=False).drop("url")


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    return chat_format.digest_chats(chat_format.format_chats(turns.unionByName(extra)))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sanitise.span_lists(*sanitise.find_spans(table(spark, sf_dir, "documents")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.ingest(table(spark, sf_dir, "documents"), exact_dedup.DigestIndex(spark))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_filters.RULES, "host string, path string, action string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_groups(table(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.count_links(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


def queries():
    return {f.__name__: f for f in (op1_packing, op2_language_id, op3_warc, op4_chat_formatting, op5_pii, op6_simhash, op7_exact_dedup, op8_url_filters, op9_toxicity, op10_decontaminate, op11_lsh_forest, op12_token_alignment, op13_merkle)}


def oracle_sql():
    return {"op3_warc": warc.SQL, "op4_chat_formatting": chat_format.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_url_filters": url_filters.SQL, "op10_decontaminate": decontaminate.SQL, "op11_lsh_forest": lsh_forest.SQL, "op13_merkle": merkle.SQL}
