"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is named and there is one machine."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all machines share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table written and read again: later steps start from it, also after an executor is lost."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
