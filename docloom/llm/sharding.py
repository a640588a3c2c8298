"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Documents with equal texts are a group (two 64-bit hashes of the text; texts that clashed in
both would share one), and a group goes to one shard whole as long as it is at most WHOLE of
a shard's even share of the bytes, tokens and rows; a larger group is cut into as few parts as
are within that, by a hash of its rows.

Items are packed. A heavy group, one with more than an even share of 1/LOTS_PER_SHARD of a
shard in any measure, is an item of its own (or one for each of its parts); the light groups
are dealt by a hash of the group into LOTS_PER_SHARD lots for each shard, whatever the input.
At most 3 * shards * LOTS_PER_SHARD groups can be heavy, so the items' sums are bounded, and
only these reach the driver. There the items, largest first, each go to the shard whose
residual capacity has the highest dot product with the item's vector, among the shards that
still have the bytes. A row's slot is its place in its item after the items before it in the
shard. Rows are numbered by windows over slices of an item (by a hash of the row) of about a
lot's share each, whose counts are added up, so that an item of very many rows is no single
task's.

Cases: a null text is an empty one of 0 bytes; empty texts are one group like any other.
Repeated rows are placed each on its own (a row number written with the slim table tells
them apart). A null doc_id is kept. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

SHARDS = 40
LOTS_PER_SHARD = 256
#: Of a shard's even share, what a group that stays whole may have.
WHOLE = 0.9
ROW_BYTES = 16
#: Weights of bytes, tokens and rows in the dot product; the law is that of bytes.
WEIGHTS = (1.0, 0.25, 0.25)
MEASURES = ("size", "tokens", "one")


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, tokens, the group's key (two hashes) and a row number."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", r"\s+"))).cast("bigint").alias("tokens"), F.lit(1).cast("bigint").alias("one"),
        F.xxhash64(text).alias("key"), F.xxhash64(text, F.lit(1)).alias("key2"), F.monotonically_increasing_id().alias("row_no"),
    )


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each lot; vectors has a row (bytes, tokens, rows) for each."""
    share = vectors / np.maximum(vectors.sum(0), 1) * shards  # 1 is a shard's even share
    weights = np.array(WEIGHTS)
    rest, out = np.ones((shards, 3)), np.zeros(len(vectors), np.int64)
    for i in np.lexsort((np.arange(len(share)), -share[:, 0])):
        fits = rest[:, 0] >= share[i, 0]
        value = rest @ (weights * share[i])
        if fits.any():
            value = np.where(fits, value, -np.inf)
        else:
            value = rest[:, 0]
        out[i] = value.argmax()
        rest[out[i]] -= share[i]
    return out


def sharded(docs: DataFrame, shards: int = SHARDS, lots_per_shard: int = LOTS_PER_SHARD) -> DataFrame:
    """doc_id, size, text_crc32, tokens, group (key, key2), shard and slot."""
    spark = docs.sparkSession
    rows = materialise(sizes(docs), "sizes")
    light = shards * lots_per_shard
    total = rows.agg(*(F.sum(m).alias(m) for m in MEASURES)).first()
    share = {m: max(1.0, (total[m] or 0) / light) for m in MEASURES}
    groups = rows.groupBy("key", "key2").agg(*(F.sum(m).alias(m) for m in MEASURES))
    over = F.greatest(*(F.col(m) / share[m] for m in MEASURES))
    parts = F.least(F.ceil(over / (WHOLE * lots_per_shard)), F.col("one")).cast("int")
    heavy = groups.where(over > 1).select("key", "key2", parts.alias("parts"), F.ceil(over / parts).cast("int").alias("slices")).orderBy("key", "key2").collect()
    starts = light + np.concatenate([[0], np.cumsum([h.parts for h in heavy])]).astype(np.int64)
    cut = spark.createDataFrame([(*h, int(s)) for h, s in zip(heavy, starts, strict=False)], "key bigint, key2 bigint, parts int, slices int, start bigint")
    own = F.col("start") + F.pmod(F.xxhash64("row_no"), F.col("parts"))
    lotted = rows.join(F.broadcast(cut), ["key", "key2"], "left").withColumn("lot", F.coalesce(own, F.pmod(F.xxhash64("key", "key2"), F.lit(light))))
    lotted = lotted.withColumn("slice", F.pmod(F.xxhash64("row_no", F.lit(2)), F.coalesce("slices", F.lit(1))))
    sums = lotted.groupBy("lot", "slice").agg(*(F.sum(m).alias(m) for m in MEASURES)).groupBy("lot").agg(
        *(F.sum(m).alias(m) for m in MEASURES), F.sort_array(F.collect_list(F.struct("slice", F.col("one").alias("n")))).alias("slices")
    )
    sums = sums.orderBy("lot").collect()
    where = place(np.array([[r[m] for m in MEASURES] for r in sums], float).reshape(-1, 3), shards)
    base, plan = [0] * shards, []
    for r, shard in zip(sums, where.tolist(), strict=True):
        for s in r.slices:
            plan.append((r.lot, s.slice, shard, base[shard]))
            base[shard] += s.n
    lots = spark.createDataFrame(plan, "lot bigint, slice bigint, shard int, base bigint")
    number = F.row_number().over(Window.partitionBy("lot", "slice").orderBy("doc_id", "row_no")) - 1
    numbered = lotted.withColumn("number", number).join(F.broadcast(lots), ["lot", "slice"])
    return numbered.select("doc_id", "size", "text_crc32", "tokens", "key", "key2", "shard", (F.col("base") + F.col("number")).alias("slot"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict[str, str] = {}
