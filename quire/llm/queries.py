"""The queries of this subpackage: thin contracts over the operators, applied to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import capfilter, mixing, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import simhash_groups

    found = simhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.mixing import mix_sources, word_count
    from quire.llm.shared import written

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(written(docs, "sizes"), size=F.col("size"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.tokens import read_tokens, write_tokens

    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import fold, identify, train

    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    found = identify(docs, train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.langid import fold
    from quire.llm.toxicity import score_toxicity, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op9_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.capfilter import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_template_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.templates import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.warc import header_lines, records_of, resolve_revisits

    found = resolve_revisits(records_of(table(spark, sf_dir, "pages")))
    return found.withColumn("headers", header_lines(F.col("headers")))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.repeats import without_repeats

    return without_repeats(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_personal_data": op4_personal_data,
    "op5_token_files": op5_token_files,
    "op6_language_id": op6_language_id,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_cap_filters": op9_cap_filters,
    "op10_template_leaks": op10_template_leaks,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc_revisits": warc.ORACLE,
    "op3_mix_sources": mixing.ORACLE,
    "op9_cap_filters": capfilter.ORACLE,
}
