"""What the training-data operators share: scratch tables, table access, words."""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"

#: Every ASCII byte that is neither a letter nor a digit becomes a space, A-Z become a-z;
#: bytes of other characters stay, so ``split()`` yields the words.
WORD_BYTES = bytes(
    (c | 0x20) if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

#: The same words for Java's and DuckDB's regular expressions, before lower-casing.
SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder all machines share; a temporary one only where the session names none and has one machine."""
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError(f"{CHECKPOINT_DIR} must name a folder that all machines share")
        import tempfile

        folder = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
        spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it back.

    Cuts the lineage: a lost executor costs a re-read, not the whole history, and a table
    that several later steps use is computed once.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_fold(column: str, folds: int, held: int) -> Column:
    """True where crc32 of the id as text, modulo folds, is held; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % folds == held


def row_key(text: str = "text") -> Column:
    """Tells apart rows that share a doc_id but not a text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def columns_without(df: DataFrame, *taken: str) -> list[str]:
    """df's columns but for those whose names a result takes (names clash without case)."""
    low = {t.lower() for t in taken}
    return [c for c in df.columns if c.lower() not in low]


def binary(batch, name: str) -> list[bytes | None]:
    """A string column of an Arrow batch as UTF-8 bytes, without decoding."""
    import pyarrow as pa

    column = batch.column(name)
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def hash_sample(df: DataFrame, total: int, rows: int, *by: str) -> DataFrame:
    """At most rows of df's total rows, those with the smallest hashes of the given columns.

    A threshold on the hash leaves about twice as many before they are ordered, so that tasks
    and driver exchange a number of rows that doesn't grow with df.
    """
    draw = F.pmod(F.xxhash64(*by), F.lit(1 << 30))
    most = min(1 << 30, max(64, (2 << 30) * rows // max(1, total)))
    return df.where(draw < most).orderBy(draw, *by).limit(rows)


def running(df: DataFrame, order: list[str], weight: str, group: str | None = None, into: str = "before", tag: str = "running") -> DataFrame:
    """df with the sum of the weights before each row of its group, in the order given; a written table.

    Rows are sorted by range over the cluster (a group may lie in many tasks; order begins with
    it), each task sums up its own, and the sums of the tasks before, a row for each, are added.
    Weights and groups are integers without nulls.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__task", F.spark_partition_id())

    def run(batches):
        at, held, first = 0, None, -1
        for batch in batches:
            w = batch.column(weight).to_numpy()
            if not len(w):
                continue
            before = at + np.cumsum(w) - w
            g = batch.column(group).to_numpy() if group else np.zeros(len(w), np.int64)
            new = np.append(held is None or g[0] != held, g[1:] != g[:-1])
            start = before.copy()
            if held is None:
                start[0] = -1  # the task before may have the group's beginning
            last = np.maximum.accumulate(np.where(new, np.arange(len(w)), -1))
            own = np.where(last >= 0, start[np.maximum(last, 0)], first)
            at, held, first = int(before[-1] + w[-1]), g[-1], int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.int64()), pa.array(own, pa.int64())], names=[*batch.schema.names, "__before", "__first"])

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    written = materialise(rows.mapInArrow(run, shape + ", __before bigint, __first bigint"), tag)
    ends = F.col(group) if group else F.lit(0)
    sums = written.groupBy("__task").agg(F.sum(weight).alias("n"), F.max("__first").alias("tail"), F.min(ends).alias("lo"), F.max(ends).alias("hi"))
    base, carried, plan = 0, (None, 0), []
    for r in sums.orderBy("__task").collect():
        first = carried[1] if carried[0] == r.lo else base
        plan.append((r["__task"], base, first))
        carried = (r.hi, first if r.tail < 0 else base + r.tail)
        base += r.n
    bases = df.sparkSession.createDataFrame(plan, "__task int, __base bigint, __lo bigint")
    start = F.when(F.col("__first") < 0, F.col("__lo")).otherwise(F.col("__base") + F.col("__first"))
    return written.join(F.broadcast(bases), "__task").select(*df.columns, (F.col("__base") + F.col("__before") - start).alias(into))
