"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_text, language_id, line_templates, metric_search, near_duplicates, packing, records, token_counts, toxicity
from .common import fresh_dir, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_metric_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metric_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.label_categories())
    return toxicity.score(docs.select("doc_id", "text"), chain, reject="toxic").drop("text")


def op3_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fresh_dir(spark, "records")
    index = records.write_records(table(spark, sf_dir, "documents"), out, tokenizer_path("word_bpe_49k.json"), end_id=2)
    return records.read_records(index, out, checks_only=True).select("doc_id", "start", "n_tokens", "ids_crc32")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.drop_recurring_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_dropped")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    found = language_id.identify(docs, language_id.train(docs, ~held_out))
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), fresh_dir(spark, "cache"), tokenizer_path("byte_bpe_50k.json"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_metric_search, op2_toxicity, op3_token_records, op4_html_text, op5_decontamination, op6_line_templates, op7_near_duplicates, op8_language_id, op9_packing, op10_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op1_metric_search": metric_search.ORACLE_SQL, "op6_line_templates": line_templates.ORACLE_SQL}
