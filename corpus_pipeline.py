"""A corpus from raw documents to packed sequences, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir), with docs read from files, and returns a DataFrame. run() writes what a stage returns as
Parquet in the shared folder and reads it again as the next one's docs; all but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cirrus.llm import decontamination, line_dedup, near_dedup, packing, toxicity
from cirrus.llm.common import durable


def toxic_documents_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labelled ones among docs, scores below one half."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).where("score < 0.5").select("doc.*")


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that a document with a smaller doc_id has too."""
    return line_dedup.without_repeats(docs)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dedup.keep_one(docs)


def benchmark_passages_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that windows of benchmark items cover."""
    return decontamination.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_documents_out),
    ("line_dedup", repeated_lines_out),
    ("near_dedup", near_duplicates_out),
    ("decontamination", benchmark_passages_out),
    ("packing", packed),
]

#: SQL can't express the trained model, the sketches or the tokenizer; the tests hold line dedup, near-duplicates and packing's limit against plain versions, the other stages against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of the documents that all stages keep.

    A null text counts as empty; empty texts, and texts that line dedup empties, are alike to nothing and stay. A row with a null doc_id goes through as any other. Of equal
    rows with an id one stays, unless they are empty. Further columns come as they are up to packing, whatever their names. An empty table gives an empty result.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
