"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Texts are sequences of words. A pattern is a window of ``window`` consecutive words of a
benchmark item; an item of fewer words is one pattern. Patterns of one length m form one
searcher with the tables of Wu and Manber, as arrays over the benchmark's words:

* SHIFT tells for a block (two neighbouring words; one where m is 1), by a checksum of it,
  how far the search may jump: the distance from the block's last place in any pattern to
  the pattern's end, or m - b + 1 for a block in no pattern; blocks that share a checksum
  share the smaller shift;
* HASH has, for the checksums with shift 0, the patterns that end in such a block, ordered by
  their first words (the method's prefix check);
* a direct comparison of all m words confirms an occurrence.

Equal windows of several items are one pattern. About GROUP_BYTES of benchmark text are
searched for in one pass: the driver builds their tables, which every worker gets once by
broadcast (about five bytes for each of the text). A larger benchmark takes several passes
over the documents, one after the other, each writing what it found by a key of the text;
only the last step joins these to the documents. An item of over PIECE_WORDS words is cut
into pieces that overlap by a window, so that no group grows with an item.

Cases: null and empty texts have no words (n_hit 0, no items). Repeated rows are scored
each on its own. Null item texts give no pattern; a null item_id is named by the empty
string. Other columns of either table are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, WORD_BYTES, binary, materialise, table

WINDOW = 10
GROUP_BYTES = 16 << 20
PIECE_WORDS = 1 << 16


def words(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class Searcher:
    """Wu-Manber tables for patterns of one length; a pattern may stand for several items.

    ids: the words of all items by their numbers, one after the other; sums: their checksums;
    starts and items: where a window begins and whose it is.
    """

    def __init__(self, m: int, ids: np.ndarray, sums: list[int], texts: list[bytes], starts: np.ndarray, items: np.ndarray):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.bits = max(10, min(22, int(8 * len(starts)).bit_length()))
        code = np.array(sums if self.b == 1 else [0, *(crc32(w, s) for w, s in zip(texts[1:], sums))], np.int64) & self.mask  # of the block that ends here
        # equal windows are one pattern: by a hash, and where that is equal word by word
        h = np.zeros(len(starts), np.uint64)
        for j in range(m):
            h = h * np.uint64(0x9E3779B97F4A7C15) + ids[starts + j].astype(np.uint64)
        last, first = code[starts + m - 1], ids[starts]
        order = np.lexsort((items, h, first, last))
        starts, items, h = starts[order], items[order], h[order]
        same = np.append(False, (h[1:] == h[:-1]) & (last[order][1:] == last[order][:-1])) if len(order) else np.zeros(0, bool)
        for j in range(m):
            same[1:] &= ids[starts[1:] + j] == ids[starts[:-1] + j]
        own = np.flatnonzero(~same)
        self.places = starts[own]  # of the patterns, by block and first word
        self.first = first[order][own].tolist()
        number = np.cumsum(~same) - 1
        pairs = np.unique(np.stack([number, items], 1), axis=0) if len(items) else np.zeros((0, 2), np.int64)
        self.owners = pairs[:, 1].astype(np.int32)
        self.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(own) + 1)).astype(np.int32)
        self.bucket = np.searchsorted(last[order][own], np.arange((1 << self.bits) + 1)).astype(np.int32)
        shift = np.full(1 << self.bits, self.most, np.uint8 if self.most < 256 else np.int32)
        for end in range(self.b, m + 1):  # the smaller shifts last
            shift[code[self.places + end - 1]] = m - end
        self.shift = shift.tobytes() if self.most < 256 else shift.tolist()
        self.ids = ids

    @property
    def mask(self) -> int:
        return (1 << self.bits) - 1

    def occurrences(self, seq: list[bytes], number: dict[bytes, int]) -> Iterator[tuple[int, np.ndarray]]:
        """Start of each occurrence and the items the pattern stands for."""
        m, shift, mask, two = self.m, self.shift, self.mask, self.b == 2
        at, n = m - 1, len(seq)
        while at < n:
            code = (crc32(seq[at], crc32(seq[at - 1])) if two else crc32(seq[at])) & mask
            jump = shift[code]
            if jump:
                at += jump
                continue
            start = at - m + 1
            head = number.get(seq[start])
            if head is not None:
                low, high = self.bucket[code], self.bucket[code + 1]
                low, high = bisect_left(self.first, head, low, high), bisect_right(self.first, head, low, high)
                window = [number.get(w, -1) for w in seq[start : at + 1]] if low < high else []
                for k in range(low, high):
                    place = self.places[k]
                    if self.ids[place : place + m].tolist() == window:
                        yield start, self.owners[self.owner_at[k] : self.owner_at[k + 1]]
            at += 1


class Searchers:
    """One searcher for each length of patterns of (item id, text) pairs; an id may come several times."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.names = sorted({name for name, _ in items})
        item = {name: i for i, name in enumerate(self.names)}
        self.number: dict[bytes, int] = {}
        texts: list[bytes] = []
        by_length: dict[int, tuple[list, list]] = {}
        for name, text in items:
            seq = words(text)
            m = min(window, len(seq))
            if m:
                starts, whose = by_length.setdefault(m, ([], []))
                n = len(seq) - m + 1
                starts.append(np.arange(len(texts), len(texts) + n))
                whose.append(np.full(n, item[name]))
                texts += seq
        ids = np.array([self.number.setdefault(w, len(self.number)) for w in texts], np.int32)
        sums = [crc32(w) for w in texts]
        self.all = [Searcher(m, ids, sums, texts, np.concatenate(starts), np.concatenate(whose)) for m, (starts, whose) in sorted(by_length.items())]

    def find(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """Merged spans of hit words and the ids of the items found, sorted."""
        places, which = [], set()
        for s in self.all:
            for start, owners in s.occurrences(seq, self.number):
                places.append((start, start + s.m))
                which.update(owners.tolist())
        return merged(places), sorted(self.names[w] for w in which)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


FOUND = "n_words bigint, starts array<bigint>, ends array<bigint>, item_ids array<string>"


def _search(rows: DataFrame, found: Searchers) -> DataFrame:
    """rows without text, with FOUND."""
    held = rows.sparkSession.sparkContext.broadcast(found)

    def run(batches):
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for text in binary(batch, "text"):
                seq = words(text)
                places, ids = held.value.find(seq)
                for column, value in zip(out, (len(seq), [a for a, _ in places], [b for _, b in places], ids), strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[*names, "n_words", "starts", "ends", "item_ids"])

    shape = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields if f.name != "text")
    return rows.mapInArrow(run, shape + FOUND)


def _pieces(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id and text of different items; one of over PIECE_WORDS words in overlapping pieces."""

    def run(batches):
        for batch in batches:
            ids, texts = [], []
            for item, text in zip(batch.column("item_id").to_pylist(), binary(batch, "text"), strict=True):
                seq = words(text)
                for a in range(0, max(1, len(seq) - window + 1), PIECE_WORDS):
                    ids.append(item)
                    texts.append(b" ".join(seq[a : a + PIECE_WORDS + window - 1]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string())], names=["item_id", "text"])

    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return rows.mapInArrow(run, "item_id string, text string").distinct()


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per document: the kept columns, n_words, spans of hit words (starts, ends: merged,
    end exclusive) and the sorted ids of the items found (item_ids, as strings).
    """
    items = materialise(_pieces(benchmark, window), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-size // group_bytes))

    def searchers(g: int) -> Searchers:
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(groups)) == g)
        return Searchers([(r.item_id, r.text.encode()) for r in part.orderBy("item_id", "text").collect()], window)

    if groups == 1:
        return _search(docs.select(*keep, "text"), searchers(0))
    text = F.coalesce("text", F.lit(""))
    key = {"__k1": F.xxhash64(text), "__k2": F.xxhash64(text, F.lit(1))}
    rows = docs.select(*(c.alias(n) for n, c in key.items()), "text")
    passes = [materialise(_search(rows, searchers(g)).where(F.size("starts") > 0).drop("n_words").dropDuplicates([*key]), "pass") for g in range(groups)]
    found = passes[0]
    for p in passes[1:]:
        found = found.unionByName(p)
    both = F.zip_with("starts", "ends", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    found = found.groupBy(*key).agg(F.sort_array(F.flatten(F.collect_list(both))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    found = found.select(*key, _joined("s").alias("s"), "item_ids")
    n_words = F.size(F.filter(F.split(text, SEPARATORS + "+"), lambda w: w != "")).cast("bigint")
    every = docs.select(*keep, n_words.alias("n_words"), *(c.alias(n) for n, c in key.items())).join(found, [*key], "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    return every.select(*keep, "n_words", F.coalesce("s.a", none("bigint")).alias("starts"), F.coalesce("s.b", none("bigint")).alias("ends"), F.coalesce("item_ids", none("string")).alias("item_ids"))


def _joined(sorted_spans: str) -> Column:
    """Sorted spans (a, b), merged where they touch."""
    kind = "array<struct<a: bigint, b: bigint>>"

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = F.struct(last["a"].alias("a"), F.greatest(last["b"], x["b"]).alias("b"))
        return F.when((F.size(done) > 0) & (x["a"] <= last["b"]), F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(sorted_spans, F.array().cast(kind), step)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = spans(docs, benchmark, window, group_bytes)
    hit = F.aggregate(F.zip_with("ends", "starts", lambda b, a: b - a), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns."""
    others = [c for c in docs.columns if c != "text"]
    taken = {"n_words", "starts", "ends", "item_ids"}
    safe = docs.select(*(F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(others)), "text", F.col("text").alias("__text"))
    kept = spans(safe, benchmark, window, group_bytes, keep=(*(f"__{i}" for i in range(len(others))), "__text"))
    kept = kept.where(F.size("starts") == 0).drop(*taken)
    back = {c: F.col(f"__{others.index(c)}" if c != "text" else "__text").alias(c) for c in docs.columns}
    return kept.select(*(back[c] for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"


def _lowered(column: str) -> str:
    return f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '{_WORDS}') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all({_lowered("coalesce(text, '')")}, '{_WORDS}') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS m, array_to_string(w[i : i + least({WINDOW}, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
), ms AS (SELECT DISTINCT m FROM bw), dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)
), occ AS (SELECT doc_id, i, dw.m AS m, item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.s = bw.s),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM occ)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS l FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

QUERIES = {"op4_decontaminate": op4_decontaminate}
ORACLES = {"op4_decontaminate": SQL}
