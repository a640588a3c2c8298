"""Near copies by the Jaccard similarity of word shingles: covering LSH, every link confirmed.

A text's words are those of ``simhash``; its set is its distinct shingles of WORDS words (a
shorter text is one shingle) as 64-bit hashes. Its fingerprint has COORDINATES minima of the
set in each of PARTS parts; two fingerprints differ in a coordinate with probability 1 - s, s
being the similarity. (The 64 majority bits of ``simhash`` differ in about ten at 0.8, which is
too many for covering masks; of a part's minima two or three do.) A part's coordinates are
covered as the bits of ``simhash`` are: each mask of ``covering_masks`` for RADIUS gives a
bucket key of the coordinates that it has. Fingerprints that differ in at most RADIUS
coordinates of some part meet, so no pair is missed that differs in under PARTS * (RADIUS + 1)
coordinates in all. Over the draw of the minima a pair meets with probability 0.999986 at
0.8 and 0.9999999 at 0.85. A link is a pair that met and whose sets have a similarity of at least
``least``, counted on the whole sets; what only met in a bucket is no link.

Texts of equal sets meet in one row first. Then every bucket's members are held against its
smallest member, so that a large group of near copies costs a comparison for each of them.
Members of buckets that are in several components after that are held against each other by
an exact set-similarity join: with a set's shingles ordered by how many of these members have
them, rarest first, two sets alike by ``least`` share one of their first n - ceil(least * n) + 1,
at places that leave room for the overlap asked for. A bitmap of the parities of each set's
shingles bounds the number of shingles in which two sets differ from below; pairs that differ in
too many are left out inside the join. What many texts have in common stands last in the order,
so that a bucket of many texts that are alike by less than ``least`` costs few pairs.

Cases: null and empty texts have one empty shingle and are near copies of each other only.
Repeated rows share a component. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import binary, materialise, row_key
from .simhash import components, covering_masks, first_of_each

WORDS = 5
LEAST = 0.8
PARTS, COORDINATES, RADIUS = 9, 11, 2
SEED = 42
#: Shingles whose minima are taken at a time; the block stays in a core's cache.
BLOCK = 256

#: Longs of a set's parity bitmap.
PARITY = 8

_draw = np.random.default_rng(SEED)
_TIMES = _draw.integers(0, 1 << 31, PARTS * COORDINATES, dtype=np.uint32)[:, None] * np.uint32(2) + np.uint32(1)
_PLUS = _draw.integers(0, 1 << 32, PARTS * COORDINATES, dtype=np.uint32)[:, None]
_SALT = _draw.integers(0, 1 << 64, PARTS * COORDINATES, dtype=np.uint64)
_MASKS = covering_masks(RADIUS, list(range(COORDINATES)))
#: A row for each coordinate, a column for each mask: 1 if the mask has the coordinate.
_HAS = np.array([[mask >> c & 1 for mask in _MASKS] for c in range(COORDINATES)], np.uint64)
_TAG = _draw.integers(0, 1 << 64, (PARTS, len(_MASKS)), dtype=np.uint64)
_POWERS = [pow(0x9E3779B97F4A7C15, j, 1 << 64) for j in range(64)]


def shingles(text: bytes | None, k: int = WORDS) -> np.ndarray:
    """The distinct shingles' hashes, ascending."""
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(1, np.uint64)
    digest = xxhash.xxh64_intdigest
    one = np.fromiter(map(digest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    h = one[:n].copy()
    for j in range(1, k):
        h += one[j : n + j] * np.uint64(_POWERS[j])
    return np.unique(_mixed(h + np.uint64(k)))  # a text of fewer words is no shingle of another


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def fingerprint(found: np.ndarray) -> np.ndarray:
    """PARTS * COORDINATES minima of a set."""
    low = (found >> np.uint64(32)).astype(np.uint32)
    out = np.full(PARTS * COORDINATES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(low), BLOCK):
        np.minimum(out, (low[None, a : a + BLOCK] * _TIMES + _PLUS).min(1), out=out)
    return out


def bucket_keys(fingerprints: np.ndarray) -> np.ndarray:
    """Of each fingerprint (a row) a key for each part and mask: a sum of hashes of the coordinates that the mask has."""
    own = _mixed(fingerprints.astype(np.uint64) + _SALT).reshape(-1, PARTS, COORDINATES)
    return (own @ _HAS + _TAG).reshape(-1, PARTS * len(_MASKS))


def prints(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """doc_id, row_key, node (a hash of the set), n (its size) and keys, one for each part and mask."""

    def run(batches):
        for batch in batches:
            nodes, sizes, found_prints = [], [], [np.zeros((0, PARTS * COORDINATES), np.uint32)]
            for text in binary(batch, "text"):
                found = shingles(text, k)
                nodes.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sizes.append(len(found))
                found_prints.append(fingerprint(found)[None])
            keys = bucket_keys(np.concatenate(found_prints)).view(np.int64)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.ravel()))
            columns = [batch.column("doc_id"), batch.column("row_key"), pa.array(np.array(nodes, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), listed]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_key", "node", "n", "keys"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), "text")
    return rows.mapInArrow(run, "doc_id bigint, row_key bigint, node bigint, n bigint, keys array<bigint>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """node and its set, of the wanted nodes (node, row_key of one of its texts)."""

    def run(batches):
        for batch in batches:
            found = [shingles(t, k).view(np.int64) for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(found, pa.list_(pa.int64()))], names=["node", "found"])

    texts = docs.select(row_key().alias("row_key"), "text").join(wanted, "row_key").select("node", "text").dropDuplicates(["node"])
    return texts.mapInArrow(run, "node bigint, found array<bigint>")


def _confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (u, v) whose sets are alike by at least least."""
    a = sets.select(F.col("node").alias("u"), F.col("found").alias("a"))
    b = sets.select(F.col("node").alias("v"), F.col("found").alias("b"))
    both = F.size(F.array_intersect("a", "b")).alias("both")
    rows = pairs.join(b, "v").join(a, "u").select("u", "v", both, (F.size("a") + F.size("b")).alias("sum"))
    return rows.where(F.col("both") >= F.lit(least) * (F.col("sum") - F.col("both"))).select("u", "v")


def links(docs: DataFrame, found: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """Links (u, v) between nodes, enough for the components of all links; found is a written table of prints."""
    own = materialise(found.groupBy("node").agg(F.min("n").alias("n"), F.min("row_key").alias("row_key"), F.first("keys").alias("keys")), "own-sets")
    rows = own.select("node", F.explode("keys").alias("key"))
    crowded = rows.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub <> last").select("key", "hub")
    members = materialise(rows.join(crowded, "key").select("key", "node", "hub"), "members")
    near = lambda x, y: F.least(x, y) >= F.lit(least) * F.greatest(x, y)  # noqa: E731  else no such similarity is possible
    wanted = members.select("node").distinct().join(own.select("node", "row_key"), "node")
    sets = materialise(_sets(docs, wanted, k), "sets")
    stars = members.where("node <> hub").select(F.col("hub").alias("u"), F.col("node").alias("v")).distinct()
    size = lambda x: own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"))
    stars = stars.join(size("u"), "u").join(size("v"), "v").where(near("n_u", "n_v")).select("u", "v")
    first = materialise(_confirmed(stars, sets, least), "star-links")
    placed = members.join(components(first), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = materialise(placed, "placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    open_ = placed.join(mixed, "key", "left_semi").select("node", "root").distinct().join(own.select("node", "n"), "node")
    open_ = materialise(open_.select("node", "n", "root"), "open")
    rest = materialise(_confirmed(_prefix_pairs(open_, sets, least), sets, least), "other-links")
    return first.unionByName(rest)


def _parities(found: str) -> list[Column]:
    """Bits of 64 * PARITY places, each the parity of the shingles that fall to it: two sets differ in as many shingles at least as bits."""
    place = lambda x: F.pmod(F.shiftright(x, 6), F.lit(PARITY))
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(x, F.lit(64)).cast("int"))

    def part(k: int) -> Column:
        return F.aggregate(F.filter(found, lambda x: place(x) == k), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(one(x)))

    return [part(k) for k in range(PARITY)]


def _prefix_pairs(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) of nodes (node, n, root) of different roots that pass the prefix, length, position and parity filters."""
    bits = [f"b{k}" for k in range(PARITY)]
    own = nodes.join(sets, "node").select("node", "n", "root", "found", *(c.alias(b) for c, b in zip(_parities("found"), bits, strict=True)))
    rows = nodes.join(sets, "node").select("node", F.explode("found").alias("token"))
    often = materialise(rows.groupBy("token").agg(F.count("*").alias("f")).where("f > 1"), "token-counts")
    shared = rows.join(often, "token").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("f", "token"))).alias("t"))
    shared = shared.join(own.drop("found"), "node")
    alone = (F.col("n") - F.size("t")).cast("int")  # tokens that no other has come first of all
    prefix = (F.col("n") - F.ceil(F.lit(least) * F.col("n") - 1e-9) + 1).cast("int")
    first = F.slice("t", F.lit(1), F.greatest(prefix - alone, F.lit(0)))
    heads = shared.select("node", "n", "root", *bits, alone.alias("alone"), F.posexplode(first).alias("i", "t"))
    heads = materialise(heads.select("node", "n", "root", *bits, (F.col("alone") + F.col("i")).alias("at"), "t.token"), "prefixes")
    other = heads.select("token", *(F.col(c).alias(f"{c}_2") for c in ("node", "n", "root", "at", *bits)))
    wanted = F.ceil(F.lit(least / (1 + least)) * (F.col("n") + F.col("n_2")) - 1e-9)
    room = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("n_2") - F.col("at_2") - 1)
    differ = sum((F.bit_count(F.col(b).bitwiseXOR(F.col(f"{b}_2"))) for b in bits), F.lit(0))
    may = (F.col("node") < F.col("node_2")) & (F.col("root") != F.col("root_2")) & (F.least("n", "n_2") >= F.lit(least) * F.greatest("n", "n_2")) & (room >= wanted)
    may = may & (differ <= F.col("n") + F.col("n_2") - 2 * wanted)
    return heads.join(other, "token").where(may).select(F.col("node").alias("u"), F.col("node_2").alias("v")).distinct()


def near_copies(docs: DataFrame, k: int = WORDS, least: float = LEAST) -> DataFrame:
    """doc_id, row_key and root, the same for all texts that links reach."""
    found = materialise(prints(docs, k), "prints")
    roots = components(links(docs, found, k, least))
    return found.select("doc_id", "row_key", "node").join(roots, "node", "left").select("doc_id", "row_key", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each component, as ``simhash.first_of_each`` picks it."""
    return first_of_each(docs, near_copies(docs, **options))
