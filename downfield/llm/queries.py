"""The registered queries of this package: each applies one operator, with its production parameters, to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from downfield.llm import decontaminate, html_text, line_dedup, ngram_join, pieces, pii, quality, secrets, simple8b, toxicity
from downfield.llm.shared import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    hits = decontaminate.decontaminate(docs, items)
    n_hit = F.size("hits").cast("long")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), decontaminate.items_digest().alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(toxicity.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= toxicity.REJECT).cast("int").alias("predicted"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_paths(table(spark, sf_dir, "documents")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    out = pieces.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model, round_trip="round_trip")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "round_trip")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.decisions(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("dropped").cast("long").alias("n_dropped"), "dropped")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.quality(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_ids(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return simple8b.token_table(table(spark, sf_dir, "documents"), tokenizer).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_toxicity, op3_secret_scans, op4_sentencepiece, op5_personal_data, op6_line_dedup, op7_ngram_join, op8_html_extraction, op9_quality_rules, op10_token_ids)}
