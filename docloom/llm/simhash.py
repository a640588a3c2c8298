"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints have 64 bits. For a radius r, every bit i gets a vector m(i) of r + 1 bits;
each of the 2**(r+1) - 1 vectors v other than zero gives a table whose mask has the bits i
with <m(i), v> = 1 (mod 2). Two fingerprints that differ in at most r bits collide in some
table: the vectors of the differing bits span at most r dimensions, so some v is orthogonal
to them all, and v's mask has none of these bits. No pair within the radius is missed.

Only different fingerprints are compared; copies meet in one row first. A bucket gives the
edges of a spanning forest of its links, never all its pairs. A bucket of over SPLIT rows is
split by a second covering family on the bits that its mask leaves out; with these at most
14 bits stay free, so that no bucket then has over 2**14 fingerprints.

Components come from alternating star rounds on the edges, each a shuffle join of written
tables that Spark may split where one fingerprint has very many neighbours.

Cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows
share a component; a null doc_id is ignored as a representative (a component of null ids
only has a null component_id). Other columns are not read.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, materialise, row_key, table

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
SPLIT = 4096
BLOCK = 1 << 15


def fingerprint(text: bytes | None, k: int = SHINGLE) -> int:
    """A bit is 1 if it is set in over half of the shingles' hashes."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    n = max(1, len(words) - k + 1)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:n].tolist()
    stops = (ends[min(k, len(words)) - 1 :] - 1).tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, row_key (a hash of the text) and fp, the fingerprint as a signed long."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, k) for t in binary(batch, "text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row_key"), pa.array(fp)], names=["doc_id", "row_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, fp bigint")


def covering_masks(radius: int, bits: list[int]) -> list[int]:
    """Masks over the given bit numbers, one for each vector v but zero."""
    size = 2 ** (radius + 1)
    m = {b: 1 + i % (size - 1) for i, b in enumerate(bits)}
    masks = [sum(1 << b for b in bits if (m[b] & v).bit_count() % 2) for v in range(1, size)]
    return sorted({x for x in masks if x}) or [0]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def _buckets(fps: DataFrame, masks: list[int]) -> DataFrame:
    """fp with each of its (tag, key) pairs."""
    every = F.array(*(F.struct(F.lit(i).alias("tag"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks)))
    return fps.select("fp", F.explode(every).alias("b")).select("b.tag", "b.key", "fp")


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links within the radius."""
    edges, left = [], fps
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            p = stack.pop()
            near = np.bitwise_count(left ^ p) <= radius
            hit = left[near]
            if len(hit):
                edges += [(int(p), int(q)) for q in hit]
                stack.extend(hit)
                left = left[~near]
    return edges


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """Forest edges (u, v) of every bucket; rows of a bucket stand together after one shuffle."""

    def run(batches):
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            new = [np.concatenate([a, batch.column(c).to_numpy()]) for a, c in zip(held, ("tag", "key", "fp"), strict=True)]
            change = np.flatnonzero((np.diff(new[0]) != 0) | (np.diff(new[1]) != 0))
            whole = change[-1] + 1 if len(change) else 0
            yield edges(new[0][:whole], new[1][:whole], new[2][:whole])
            held = [x[whole:] for x in new]
        yield edges(*held)

    def edges(tag, key, fp):
        fp = fp.view(np.uint64)
        start = np.concatenate([[0], np.flatnonzero((np.diff(tag) != 0) | (np.diff(key) != 0)) + 1, [len(fp)]]) if len(fp) else np.zeros(1, np.int64)
        size = np.diff(start)
        first = start[:-1][size == 2]
        near = first[np.bitwise_count(fp[first] ^ fp[first + 1]) <= radius]
        u, v = [fp[near]], [fp[near + 1]]
        for a, n in zip(start[:-1][size > 2].tolist(), size[size > 2].tolist(), strict=True):
            if pairs := forest(fp[a : a + n], radius):
                both = np.array(pairs, np.uint64)
                u.append(both[:, 0])
                v.append(both[:, 1])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (u, v)], names=["u", "v"])

    rows = buckets.repartition("tag", "key").sortWithinPartitions("tag", "key", "fp")
    return rows.select(F.col("tag").cast("bigint").alias("tag"), "key", "fp").mapInArrow(run, "u bigint, v bigint")


def links(fps: DataFrame, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """Edges between different fingerprints whose components are those of all links within the radius."""
    masks = covering_masks(radius, list(range(BITS)))
    first = _buckets(fps, masks)
    large = first.groupBy("tag", "key").count().where(F.col("count") > split).select("tag", "key")
    large = materialise(large, "large-buckets")
    if large.isEmpty():
        return _links(first, radius)
    small = first.join(large, ["tag", "key"], "left_anti")
    parts = [_links(small, radius)]
    inside = materialise(first.join(large, ["tag", "key"], "left_semi"), "large-rows")
    for i, mask in enumerate(masks):
        free = [b for b in range(BITS) if not mask >> b & 1]
        finer = [mask | m for m in covering_masks(radius, free)]
        parts.append(_links(_buckets(inside.where(F.col("tag") == i).select("fp"), finer), radius))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): root is the smallest node of node's component. Nodes without edges are left out.

    Rounds go on until the edges stay as they are, which then are stars.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return materialise(pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    ordered = lambda e: e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    now = materialise(ordered(edges), "edges")
    before = state(now)
    while before[0]:
        both = materialise(now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        large = materialise(both.join(minima(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        large = materialise(ordered(large), "large-star")
        # small star: u and its smaller neighbours go to the smallest of these
        low = minima(large)
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = materialise(ordered(small.unionByName(low.select("u", F.col("m").alias("v")))), "small-star")
        after = state(now)
        if after == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, split: int = SPLIT) -> DataFrame:
    """doc_id, row_key, fp, root (the component's smallest fingerprint) and component_id, the smallest doc_id that links reach."""
    prints = materialise(fingerprints(docs, k), "fingerprints")
    own = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "own")
    roots = components(links(own.select("fp"), radius, split))
    placed = own.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    placed = materialise(placed, "placed")
    least = materialise(placed.groupBy("root").agg(F.min("low").alias("component_id")), "least")
    named = materialise(placed.join(least, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select("doc_id", "row_key", "fp", "root", "component_id")


def hexadecimal(fp: str) -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, as ``first_of_each`` picks it."""
    return first_of_each(docs, near_duplicates(docs, **options))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each root of found (doc_id, row_key, root): the first by doc_id (nulls last), then by text hash.

    Rows that repeat both id and text are one document; one of them stays.
    """
    found = materialise(found, "near-duplicates")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    kept = found.groupBy("root").agg(F.min(order).alias("first"))
    kept = kept.select(F.col("first.doc_id").alias("__id"), F.col("first.row_key").alias("__key"))
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc"), row_key().alias("row_key"))
    joined = rows.join(kept, rows["doc"]["doc_id"].eqNullSafe(kept["__id"]) & (rows["row_key"] == kept["__key"]), "left_semi")
    if not found.groupBy("doc_id", "row_key").count().where("count > 1").isEmpty():
        joined = joined.withColumn("doc_id", F.col("doc.doc_id")).dropDuplicates(["doc_id", "row_key"])  # whole texts are dealt out once more only if rows repeat
    return joined.select(*(F.col("doc").getField(c).alias(c) for c in names))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash": op3_simhash}
ORACLES: dict[str, str] = {}
