"""Stored sources: a dataset a source, partitioned by run, and a manifest that says which run readers follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source_id string, run_id string, schema int, partial boolean, retrieved_at timestamp, complete_at timestamp"


def write_source(df: DataFrame, base: str, source_id: str, run_id: str, schema: int, partial: bool, retrieved_at, complete_at) -> None:
    """The data first, in a folder of its own, then one row of the manifest: readers never see half a write."""
    df.write.mode("overwrite").parquet(f"{base}/data/{source_id}/run_id={run_id}")
    row = df.sparkSession.createDataFrame([(source_id, run_id, schema, partial, retrieved_at, complete_at)], MANIFEST)
    row.coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def latest(spark: SparkSession, base: str, not_after=None) -> DataFrame:
    """The newest manifest row of each source; none newer than `not_after`, so that all reads are of one generation."""
    rows = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    rows = rows if not_after is None else rows.filter(F.col("retrieved_at") <= F.lit(not_after))
    return rows.groupBy("source_id").agg(F.max_by(F.struct("run_id", "schema", "partial", "retrieved_at", "complete_at"), F.struct("retrieved_at", "run_id")).alias("m")).select("source_id", "m.*")


def load_sources(spark: SparkSession, base: str, expected: dict[str, int], not_after=None) -> tuple[dict[str, DataFrame], list[str]]:
    """The data of each expected source, and a warning for each that is missing or of another schema version."""
    found = {r["source_id"]: r for r in latest(spark, base, not_after).collect()}  # a row a source
    data, warnings = {}, []
    for source_id, schema in expected.items():
        row = found.get(source_id)
        if row is None:
            warnings.append(f"{source_id}: never stored")
        elif row["schema"] != schema:
            warnings.append(f"{source_id}: stored under schema {row['schema']}, expected {schema}")
        else:
            data[source_id] = spark.read.parquet(f"{base}/data/{source_id}/run_id={row['run_id']}")
    return data, warnings


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: file, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def publish(tables: dict[str, DataFrame], folder: str) -> None:
    """Derived tables as JSON, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{folder}/{name}")
