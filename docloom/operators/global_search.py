"""Search over all chunks, without a document: a blocked top-k join.

A batch of questions is cut into blocks of a checked size, and each block's vectors are
broadcast. The tasks that read the chunks hold, for every question of the block, the best k
so far; products of a tile of chunks with a tile of questions say which pairs can still be
among them, and only these are measured one by one. What leaves a task is k rows a question,
whatever it has read: no pair is shuffled, and no row of the chunks. The tasks' rows meet by
question, and the k best are joined to their texts.

Equal vectors tie, and ties go by doc_id, then chunk_index: distances of the pairs kept are
summed in the order of the components, as the column functions do, so that they are equal
where the vectors are.

Cases: a question or chunk with no vector (null, empty, of zeros under cosine is at distance 1)
of the questions' length takes no part. Blank questions find nothing; blank chunks are fetched
like any other but are no hits. Fewer than k chunks: all are candidates. Chunks without a
doc_id or chunk_index are left out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from docloom.config import Config
from docloom.functions import params
from docloom.functions.text import ws_trim

from .retrieval import finish

#: Bytes of question vectors that are broadcast at a time.
BLOCK_BYTES = 32 << 20
#: Chunks and questions whose products are taken together.
TILE = (2048, 512)
#: By how much a product may differ from the sum in order, of the larger of 1 and the value.
SLACK = 1e-9


def _distances(a: np.ndarray, b: np.ndarray, space: str) -> np.ndarray:
    """Row by row, summed in the components' order."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        if space in ("cosine", "ip"):
            out += a[:, j] * b[:, j]
        else:
            d = a[:, j] - b[:, j]
            out += d * d
    return 1.0 - out if space == "cosine" else -out if space == "ip" else out


def _estimates(x: np.ndarray, q: np.ndarray, space: str) -> np.ndarray:
    product = x @ q.T
    if space == "cosine":
        return 1.0 - product
    return -product if space == "ip" else (x * x).sum(1)[:, None] + (q * q).sum(1)[None, :] - 2.0 * product


class Best:
    """The k nearest rows so far of each of some questions."""

    def __init__(self, vectors: np.ndarray, k: int, space: str):
        self.vectors, self.k, self.space = vectors, k, space
        self.bound = np.full(len(vectors), np.inf)
        self.rows: list[pd.DataFrame] = []
        self.waiting = 0

    def add(self, keys: pd.DataFrame, x: np.ndarray) -> None:
        tall, wide = TILE
        for a in range(0, len(x), tall):
            part = x[a : a + tall]
            for b in range(0, len(self.vectors), wide):
                q = self.vectors[b : b + wide]
                near = _estimates(part, q, self.space)
                if len(part) > self.k:  # the tile alone bounds what can stay
                    own = np.partition(near, self.k - 1, axis=0)[self.k - 1]
                    self.bound[b : b + wide] = np.minimum(self.bound[b : b + wide], own + SLACK * np.maximum(1, abs(own)))
                limit = self.bound[b : b + wide]
                row, col = np.nonzero(near <= limit + SLACK * np.maximum(1, np.abs(np.where(np.isinf(limit), 0, limit))))
                if len(row):
                    found = keys.iloc[a + row].assign(q=b + col, distance=_distances(part[row], q[col], self.space))
                    self.rows.append(found)
                    self.waiting += len(found)
                    if self.waiting > 4 * self.k * len(self.vectors) + tall * wide:
                        self.prune()

    def prune(self) -> None:
        if not self.rows:
            return
        every = pd.concat(self.rows).sort_values(["q", "distance", "doc_id", "chunk_index"], kind="stable")
        place = every.groupby("q").cumcount()
        every = every[place < self.k]
        last = every[place[place < self.k] == self.k - 1]
        self.bound[last.q.to_numpy()] = np.minimum(self.bound[last.q.to_numpy()], last.distance.to_numpy())
        self.rows, self.waiting = [every], 0


def _matrix(column, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the right length, and which these are."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = lengths == size
    flat = column.filter(right).flatten()
    whole = flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    fine = np.isfinite(whole).all(1)
    return whole[fine], np.flatnonzero(right)[fine]


def nearest(questions: DataFrame, chunks: DataFrame, k: int, space: str = "l2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """query_id, doc_id, chunk_index and distance: of each question (query_id, q_embedding) the k nearest of all chunks (doc_id, chunk_index, embedding)."""
    spark = questions.sparkSession
    asked = questions.where(F.size("q_embedding") > 0).select("query_id", F.col("q_embedding").cast("array<double>").alias("v"))
    sizes = asked.groupBy(F.size("v").alias("size")).agg(F.count("*").alias("n")).collect()  # a row a length of vectors
    rows = chunks.where(F.col("doc_id").isNotNull() & F.col("chunk_index").isNotNull()).select("doc_id", "chunk_index", F.col("embedding").cast("array<double>").alias("v"))
    id_type, doc_type = questions.schema["query_id"].dataType.simpleString(), chunks.schema["doc_id"].dataType.simpleString()
    id_kind = to_arrow_type(questions.schema["query_id"].dataType)
    shape = f"query_id {id_type}, doc_id {doc_type}, chunk_index {chunks.schema['chunk_index'].dataType.simpleString()}, distance double"
    found = []
    for s in sizes:
        blocks = -(-s.n * s["size"] * 8 // block_bytes)
        for block in range(blocks):
            own = asked.where((F.size("v") == s["size"]) & (F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block)).collect()
            if len(own) * s["size"] * 8 > 2 * block_bytes:
                raise ValueError("questions of one id are more than a block")
            sent = spark.sparkContext.broadcast(([r.query_id for r in own], np.array([r.v for r in own], float).reshape(len(own), s["size"])))
            found.append(rows.mapInArrow(_searching(sent, k, space, id_kind), shape))
    if not found:
        return spark.createDataFrame([], shape)
    every = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy("distance", "doc_id", "chunk_index")
    return every.withColumn("__no", F.row_number().over(order)).where(F.col("__no") <= k).drop("__no")


def _searching(sent, k: int, space: str, id_kind: pa.DataType):
    def run(batches):
        ids, vectors = sent.value
        best, kinds = None, None
        for batch in batches:
            if best is None and len(vectors):
                best = Best(vectors, k, space)
            if best is None or not batch.num_rows:
                continue
            x, at = _matrix(batch.column("v"), vectors.shape[1])
            kinds = [batch.schema.field(c).type for c in ("doc_id", "chunk_index")]
            keys = pd.DataFrame({c: batch.column(c).to_pandas().to_numpy()[at] for c in ("doc_id", "chunk_index")})
            if len(x):
                best.add(keys, x)
        if best is not None and best.rows:
            best.prune()
            out = best.rows[0]
            columns = [pa.array([ids[i] for i in out.q], id_kind), pa.array(out.doc_id, kinds[0]), pa.array(out.chunk_index, kinds[1]), pa.array(out.distance, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["query_id", "doc_id", "chunk_index", "distance"])

    return run


def search_all(questions: DataFrame, chunks: DataFrame, config: Config = Config(), space: str = "l2", fuzzy: bool = True, dedupe: bool = True, reranker=None, cut: str = "final_k") -> DataFrame:
    """``retrieval.search`` over all chunks: no document, so no count of its chunks; parameters are those of an unknown one.

    questions: query_id, question, q_embedding. chunks is read twice, once for its vectors and
    once for the texts of what was found: give a stored table.
    """
    none = F.lit(0)
    final_k = params.top_k(none, config=config)
    fetch = params.recall_k(none, final_k, config=config, of_document=False)
    k = min(config.recall_cap, max(3 * _final(config), 8, 5 * _final(config)))
    asked = questions.where(ws_trim("question") != "")
    near = nearest(asked, chunks, k, space)
    hits = near.join(asked.select("query_id", "question"), "query_id").join(chunks.drop("embedding"), ["doc_id", "chunk_index"])
    hits = hits.where(ws_trim("text") != "").withColumn("__known", F.lit(True)).withColumn("doc_chunks", none).withColumn("final_k", final_k).withColumn("fetch_k", fetch)
    hits = hits.withColumn("threshold", params.score_threshold(none, F.lit(config.min_score), F.lit(reranker is not None)))
    return finish(hits, config, space, fuzzy, dedupe, reranker, cut, ("query_id",), ("distance", "doc_id", "chunk_index"))


def _final(config: Config) -> int:
    """The number of results for a document of unknown size, as ``params.top_k`` has it."""
    return max(config.top_k_low, min(max(config.top_k_low, config.top_k_high), max(config.top_k_low, 3)))
