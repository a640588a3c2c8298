"""Tables in versioned folders: a new version is written beside the old one, then named current."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def bucketed(chunks: DataFrame, key: str = "doc_id", buckets: int = BUCKETS) -> DataFrame:
    """Adds bucket, by which chunks lie in folders: some of a document's chunks are read without the others'."""
    return chunks.withColumn("bucket", F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).cast("int"))


def write_version(df: DataFrame, base: str, version: str, partition: str | None = "bucket") -> str:
    path = f"{base}/v={version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(partition) if partition and partition in df.columns else writer).parquet(path)
    return path


def read_version(spark: SparkSession, base: str, version: str) -> DataFrame:
    return spark.read.parquet(f"{base}/v={version}")


def write_report(results: DataFrame, base: str) -> None:
    """An evaluation's results as JSON lines and as text."""
    results.write.mode("overwrite").json(f"{base}.results")
    results.select(F.concat_ws(" | ", *(F.col(c).cast("string") for c in results.columns)).alias("value")).write.mode("overwrite").text(f"{base}.report")
