"""The corpus pipeline: five stages over `documents`, each an operator of tracetide.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracetide.llm.decontaminate import find_leaks
from tracetide.llm.line_dedup import dedup_lines
from tracetide.llm.near_dedup import near_duplicates
from tracetide.llm.pieces import encode_texts
from tracetide.llm.quality import classify
from tracetide.llm.shared import materialise

#: The columns every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No single statement expresses a classifier fit, near-duplicate classes, alignments or piece ids.
ORACLE_SQL = None
#: Percent of the union that two sets of word shingles must share here.
SIMILAR = 80


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The documents whose id isn't in `gone(doc_id)`; null ids stay."""
    return docs.join(gone.select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, taught by `labels`, gives label 0 go."""
    judged = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return without(docs, judged.where("predicted = 0"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; every document stays, with its new length."""
    return dedup_lines(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays; rows that share an id stay or go together."""
    return without(docs, near_duplicates(docs, percent=SIMILAR).where("not kept"))


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return without(docs, find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece ids of every document that is left."""
    return encode_texts(docs)


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("decontamination", leak_stage), ("pieces", piece_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, with a table in the shared folder between them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
