"""The operators over the whole generated tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.llm import (
    alignment,
    decontaminate,
    jaccard,
    language,
    linededup,
    minhash,
    mixing,
    mtree,
    periodic,
    secrets,
    tokencounts,
    toxicity,
    warc,
)
from tillbook.llm.oracle import SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.remove_repeated_lines(documents)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.contamination(documents, _table(spark, sf_dir, "benchmark")).drop("text")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"), 4, 2)
    profiles = language.learn(documents.where(~apart))
    found = language.identify(documents.select("doc_id", "text"), profiles)
    return found.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencounts.count_tokens(documents, tokencounts.ranks(spark), tokencounts.scrub_edits).drop("text")


def op5_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_scores(_table(spark, sf_dir, "embeddings"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    apart = language.held_out(F.col("doc_id"), 5, 0)
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(documents, labels.where(~apart))
    found = toxicity.score(documents.select("doc_id", "text"), model)
    return found.select("doc_id", apart.alias("held_out"), "score", "predicted")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(documents, secrets.learn(documents)).drop("text")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"), plant=True)


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_tokenizers(documents, *alignment.vocabularies(spark))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontamination": op2_decontamination,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_top_scores": op5_top_scores,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_secrets": op8_secrets,
    "op9_warc": op9_warc,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_minhash_dedup": op11_minhash_dedup,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}
