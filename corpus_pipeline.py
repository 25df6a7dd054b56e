"""The corpus pipeline: quality, near duplicates, benchmark passages, personal data, packing.

Each stage is called as stage(spark, docs, sf_dir), is written as Parquet, and its rows are the next stage's docs. All
but the last return the columns of documents. Rows with null, empty or repeated texts pass each stage as its operator
says; tables without rows pass all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import common, decontaminate, jaccard_groups, ngram_quality, packing, surrogates
from factloom.llm.encoding import default_vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    trusted = common.table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return ngram_quality.judged(docs, trusted).filter("_kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of five-word shingle sets with a similarity of 0.8 or more stays."""
    return jaccard_groups.keep_first(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_contaminated(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by surrogates; n_chars follows the text."""
    from pyspark.sql import functions as F

    out = surrogates.pseudonymised(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, packed into sequences of at most 2048 ids."""
    return packing.pack_documents(docs, default_vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("PII surrogates", personal_data),
    ("best-fit packing", packed),
]

#: SQL cannot express the stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
