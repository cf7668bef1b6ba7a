"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txrisk.llm import audit, bytebpe, decontam, html, infill, langid, lines, lm, neardup, packing, quality, toxicity, warc
from txrisk.llm.common import table
from txrisk.llm.sql import oracle_sql

__all__ = ["oracle_sql", "queries"]


def word_tokenizer() -> str:
    """The installed vocabulary file; its place is a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.measured(table(spark, sf_dir, "documents")).drop("divergence")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lines.line_counts(table(spark, sf_dir, "documents"))
    return counted.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "pages").select("page_id", "url", html.extracted(F.col("html")).alias("text"))
    return text.select("*", F.char_length("text").cast("long").alias("n_chars"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def id_remainder(name: str, parts: int) -> Column:
    return F.crc32(F.col(name).cast("string").cast("binary")) % parts


def toxicity_held_out() -> Column:
    return F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False))


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(~toxicity_held_out())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, learnable_labels(spark, sf_dir))
    scored = docs.select("doc_id", toxicity_held_out().alias("held_out"), toxicity.scored(model, F.col("text"), spark).alias("score"))
    return scored.select("*", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)
    kept = neardup.is_kept(F.col("doc_id"), F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(id_remainder("doc_id", 5) == 0, F.lit(False))
    model = langid.fit(docs.filter(~held_out))
    guessed = docs.select("doc_id", held_out.alias("held_out"), langid.predict(model, F.col("text"), spark).alias("of"))
    return guessed.select("doc_id", "held_out", F.col("of.lang").alias("lang_pred"), F.col("of.score").alias("score"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated"
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.transformed(infill.store(table(spark, sf_dir, "documents")))
    return made.select(
        "doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", infill.digests(F.col("output"), F.col("form")).alias("of")
    ).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.col("of.output").alias("output_sha256"),
        F.col("of.restored").alias("restored_sha256"),
    )


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = byte_tokenizer()
    ids = table(spark, sf_dir, "documents").select("doc_id", bytebpe.encoded(F.col("text"), file).alias("ids"))
    return ids.select(
        "doc_id", bytebpe.n_ids(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(bytebpe.decoded(F.col("ids"), file), 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_line_dedup": op2_line_dedup,
        "op3_html_extraction": op3_html_extraction,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_toxicity": op5_toxicity,
        "op6_warc": op6_warc,
        "op7_minhash_near_dedup": op7_minhash_near_dedup,
        "op8_language_id": op8_language_id,
        "op9_best_fit_packing": op9_best_fit_packing,
        "op10_benchmark_decontamination": op10_benchmark_decontamination,
        "op11_filter_audit": op11_filter_audit,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_byte_bpe": op13_byte_bpe,
    }
