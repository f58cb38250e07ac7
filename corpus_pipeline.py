"""Corpus pipeline: language ID, exact dedup, near-duplicate join, decontamination, packing."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tabwise.llm.decontaminate import remove_contaminated
from tabwise.llm.exact_dedup import exact_dedup
from tabwise.llm.language_id import keep_identified, remainder, train_language_model
from tabwise.llm.ngram_join import similar_components
from tabwise.llm.packing import best_fit_packing
from tabwise.llm.queries import tokenizer_path
from tabwise.llm.scratch import Scratch


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; learned from those whose crc32(doc_id) mod 3 is not 1."""
    return keep_identified(docs, train_language_model(docs.where(remainder(F.col("doc_id"), 3) != 1)))


def _row() -> Column:
    """A row's key: its place in the stored table."""
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def _stored(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a plain scan of files whose rows have a place; anything else is written first."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        try:
            docs.select(_row())
            return docs
        except AnalysisException:      # files without places
            pass
    return Scratch(docs.sparkSession, f"pipeline-{name}").write(docs, "docs")


def _keep_rows(docs: DataFrame, keep: DataFrame) -> DataFrame:
    """The rows of the stored table ``docs`` whose place is in ``keep (key)``."""
    placed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), _row().alias("key"))
    return placed.join(keep.select("key"), "key", "left_semi").select("doc.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, with or without doc_id."""
    docs = _stored(docs, "exact")
    return _keep_rows(docs, exact_dedup(docs, key=_row()).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, the first of the smallest id (null last), of each group linked by 5-word shingles at Jaccard 0.8 or more.

    Texts without words are linked with nothing: all stay."""
    docs = _stored(docs, "near")
    rows = similar_components(docs, key=_row())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))["key"].alias("key")
    keep = rows.where("component IS NOT NULL").groupBy("component").agg(first).select("key")
    return _keep_rows(docs, keep.unionByName(rows.where("component IS NULL").select("key")))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's passages do not contaminate."""
    return remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in packed sequences."""
    return best_fit_packing(docs, tokenizer_path())


STAGES = [("language_id", identified), ("exact_dedup", exact), ("near_duplicates", near),
          ("decontamination", decontaminated), ("packing", packed)]

#: Tokenisation and best-fit packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each stage's rows are written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
