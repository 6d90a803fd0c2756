"""From raw documents to token files: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontam, jaccard_join, mixing, quality, token_files
from quillspark.llm.common import stored
from quillspark.llm.queries import tokenizer_path


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this table's labelled rows, takes for the second grade or better."""
    model = quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, model).where("tail_probability >= 0.5").select("row.*")


def graded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, str]:
    """docs with the quality classifier's expected grade, and the name of that column, which no column of docs has.

    The classifier learns from labelled rows of all documents, as those of low grades are gone by the stages before.
    """
    model = quality.train_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = "_".join(["grade", *docs.columns])
    return quality.score_quality(docs, model).select("row.*", F.col("expected_grade").alias(name)), name


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the document with the smallest id."""
    groups = stored(jaccard_join.jaccard_join(docs))
    dropped = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(stored(dropped), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item contaminates."""
    marked = decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marked.where(~F.col("contaminated")).select("row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: within a source, those with a better expected grade are likelier to be taken once more."""
    rows, grade = graded(spark, docs, sf_dir)
    return mixing.take_mix(rows, quality_weight=F.col(grade)).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold of each document."""
    return token_files.read_token_files(stored(token_files.write_token_files(docs, tokenizer_path())))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_good),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_benchmarks),
    ("mixing sources", mix),
    ("token files", tokens),
]

#: A trained classifier and a tokenizer are no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
