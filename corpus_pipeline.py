"""A training corpus from documents: five stages, each written as Parquet and read by the next.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns documents
again, the last one with ``copy`` and ``shuffle_key`` added. ``run`` applies them in turn.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tillbook.llm import decontaminate, jaccard, language, linededup, mixing
from tillbook.llm.common import scratch_path, written

#: A text of which hardly any n-gram stands in any language's profile is in none of the languages.
LEAST_SCORE = 0.05


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in a language that the corpus names; texts without a letter go.

    Where it names none, as without labels, there is nothing to reject by and all documents stay.
    """
    learned = language.learn(docs.where(~language.held_out(docs["doc_id"], 4, 2)))
    if not learned.languages:
        return docs
    return language.identify(docs, learned).where(
        (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    ).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that repeat three consecutive lines; one that repeats whole goes."""
    cleaned = linededup.remove_repeated_lines(docs)
    left = (F.col("n_removed") == 0) | F.col("text").rlike(r"\S")
    columns = [F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return cleaned.where(left).select(*columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links connect: that of the smallest doc_id, without one only if no other has one.

    Rows are numbered first, as ids may be null, shared or repeated; the numbered rows are written,
    so that a row has the same number in each job.
    """
    row = "_row"
    while row in (c.lower() for c in docs.columns):
        row += "_"
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    chosen = jaccard.first_of_groups(numbered, row)
    return numbered.join(chosen, numbered[row] == chosen["row"], "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.contamination(docs, benchmark).where("NOT contaminated").select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents repeated to the sources' target weights, in random order."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing", mixture),
]

#: Language profiles and MinHash have no SQL twin; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed corpus of the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
