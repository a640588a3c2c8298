import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from docloom.llm import fixity as W
from docloom.llm import neighbours as A
from docloom.llm import packing as P
from docloom.llm import sharding as B
from docloom.llm import simhash as S


# --- op3 ---


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    parent = {p: p for p in prints}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 3:
                parent[top(a)] = top(b)
    return top


def test_masks_cover_the_radius():
    masks = S.covering_masks(3, list(range(64)))
    assert len(masks) == 15
    r = random.Random(1)
    for _ in range(3000):
        diff = sum(1 << b for b in r.sample(range(64), r.randrange(4)))
        assert any(not diff & m for m in masks)
        free = sorted(b for b in range(64) if not masks[0] >> b & 1)
        diff = sum(1 << b for b in r.sample(free, r.randrange(4)))
        assert any(not diff & m for m in S.covering_masks(3, free))


@pytest.mark.parametrize("split", [4096, 2])
def test_links_by_definition(spark, split):
    r = random.Random(3)
    prints = set()
    for _ in range(12):
        x = r.getrandbits(64)
        for _ in range(6):
            prints.add(x)
            for b in r.sample(range(64), r.randrange(1, 5)):
                x ^= 1 << b
    df = spark.createDataFrame([(S._signed(p),) for p in prints], "fp bigint")
    roots = {x.node % 2**64: x.root for x in S.components(S.links(df, 3, split)).collect()}
    top = linked(prints)
    groups = defaultdict(set)
    for p in prints:
        groups[top(p)].add(p)
    for g in groups.values():
        want = min(map(S._signed, g))
        assert all(roots.get(p, S._signed(p)) == want for p in g)


def test_near_duplicates_by_definition(spark, odd, none):
    found = S.near_duplicates(odd).collect()
    texts = odd.collect()
    prints = {fingerprint(r.text) for r in texts}
    top = linked(prints)
    least = {}
    for r in texts:
        if r.doc_id is not None:
            k = top(fingerprint(r.text))
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, fingerprint(r.text), least.get(top(fingerprint(r.text)))) for r in texts)
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == want
    kept = S.one_of_each(odd)
    assert kept.columns == odd.columns
    assert Counter(top(fingerprint(r.text)) for r in kept.collect()) == Counter({top(p) for p in prints})
    assert S.near_duplicates(none).count() == 0 and S.one_of_each(none).count() == 0


def test_fingerprint_in_blocks():
    text = " ".join(map(str, range(S.BLOCK + 10)))
    assert S.fingerprint(text.encode()) == fingerprint(text)
    assert S.fingerprint(None) == S.fingerprint(b" \n") == 0


# --- op5 ---


def test_packing_is_whole(spark, odd, none):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    more = spark.createDataFrame([(40, "a<|endoftext|>b"), (41, "<|endoftext|>" * 3)], "doc_id bigint, text string")
    df = odd.select("doc_id", "text").unionByName(more)
    out = P.packed(df, group_pieces=8).collect()
    ids = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in df.collect()]
    want = Counter()
    for doc, x in ids:
        for a in range(0, len(x), 2048):
            part = np.array(x[a : a + 2048], "<u4")
            want[doc, a, len(part), zlib.crc32(part.tobytes()), len(x)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for rows in bins.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert P.packed(none).count() == 0


def test_ids_are_those_of_the_other_library(spark, sf):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    fast = P.encoder()
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    mark = "<|endoftext|>"
    texts += [mark, mark + "a", "a" + mark, "x " + mark + " y", mark + mark, "a " + mark + "\n\n " + mark + " b", "<|endoftext" + mark + "|>", " <|endoftext|", mark + "  "]
    texts += ["  a\n\n b\t ", "é́ 中文 🙂", " " * 3000 + "x", "x" * 5000, "I'll 'LL 12345", "\r\n\x00"]
    for x in texts:
        assert list(fast(x)) == t.encode(x, add_special_tokens=False).ids


def test_repeated_rows_are_dealt_out(spark):
    """Groups stay small where all rows repeat id and text."""
    df = spark.createDataFrame([(None, "same")] * 400, "doc_id bigint, text string")
    out = P.packed(df, length=4, group_pieces=50).collect()
    per = Counter(r.sequence_id >> 32 for r in out)
    assert len(out) == 400 and len(per) == 8 and max(per.values()) < 100


def test_first_fit_takes_the_first_bin():
    r = random.Random(4)
    for _ in range(50):
        lengths = np.array([r.randrange(1, 101) for _ in range(r.randrange(1, 60))])
        bins, offsets = P.first_fit_decreasing(lengths, 100)
        free = []
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if k == len(free):
                free.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - free[k])
            free[k] -= lengths[i]


# --- op6 ---


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, cell int")


@pytest.mark.parametrize("cell_rows", [8192, 40])
def test_neighbours_against_brute_force(spark, cell_rows):
    r = np.random.default_rng(6)
    centres = r.normal(size=(12, 32))
    x = (centres[r.integers(0, 12, 900)] + 0.4 * r.normal(size=(900, 32))).astype(np.float32)
    x[200:500] = x[200]  # a third of all rows are one vector
    rows = [(i, v.tolist(), 0, 0) for i, v in enumerate(x)]
    rows += [(1000, None, 0, 0), (1001, [0.0] * 32, 0, 0), (1002, [float("nan")] + [1.0] * 31, 0, 0), (1003, [None] + [1.0] * 31, 0, 0), (1004, [1.0] * 5, 0, 0), (None, x[0].tolist(), 0, 0), (7, x[7].tolist(), 0, 0)]
    df = vectors(spark, rows)
    out = defaultdict(list)
    for q in A.nearest(df, df.where("vec_id % 50 = 0"), cell_rows=cell_rows).collect():
        out[q.query_id].append((q.rank, q.score, q.vec_id))
    ids = np.array([*range(900), 7])
    every = np.concatenate([x, x[7:8]]).astype(float)
    hit = 0
    asked = range(0, 900, 50)
    for q in asked:
        d = np.sqrt(((every - x[q].astype(float)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        got = sorted(out[q])
        assert [g[0] for g in got] == list(range(1, 11)) and [g[1:] for g in got] == sorted(g[1:] for g in got)
        assert all(abs(s - d[ids == v][0]) < 1e-12 for _, s, v in got)
        hit += len({g[2] for g in got} & {ids[i] for i in order})
        if 200 <= q < 500:
            assert [g[2] for g in got] == [ids[i] for i in order]  # ties go to the smaller id
    assert hit >= 0.9 * 10 * len(asked)


def brute(rows, asked, k=10):
    """For each (id, vector) asked once: the k nearest of all rows but those of its id."""
    out = []
    for q, v in sorted({(i, tuple(x)) for i, x in asked}):
        near = sorted((float(np.sqrt(((np.array(x, float) - np.array(v, float)) ** 2).sum())), i) for i, x in rows if i != q)[:k]
        out += [(q, r + 1, i, round(d, 9)) for r, (d, i) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("cell_rows, query_block", [(8192, 16384), (30, 2)])
def test_repeated_and_conflicting_query_rows(spark, cell_rows, query_block):
    r = np.random.default_rng(9)
    x = r.integers(-9, 10, (300, 4)).astype(float)
    x[(x == 0).all(1)] = 1
    x[50:150] = x[50]  # equal vectors of a hundred ids
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [rows[100], rows[100], rows[200], (200, [7.0, -7.0, 7.0, -7.0]), *[rows[60]] * 15, *[rows[250]] * 30]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id bigint, embedding array<double>, label int, cell int").repartition(5)
    for every in (100, 1):
        out = A.nearest(df, df.where(f"vec_id % {every} = 0"), confidence=0.999999, cell_rows=cell_rows, query_block=query_block).collect()
        assert sorted((q.query_id, q.rank, q.vec_id, round(q.score, 9)) for q in out) == brute(rows, [(i, v) for i, v in rows if i % every == 0])
        assert len({(q.query_no, q.rank) for q in out}) == len(out)


def test_index_is_not_copied(spark, monkeypatch):
    """Ten times the queries: the rows that the searches look at stay those of the table."""
    r = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist(), 0, 0) for i, v in enumerate(r.normal(size=(2000, 8)))], "vec_id bigint, embedding array<double>, label int, cell int")
    seen = []

    def written(frame, tag, keep=A.materialise):
        out = keep(frame, tag)
        if tag in ("projected", "cells"):
            seen.append((tag, out.count()))
        return out

    monkeypatch.setattr(A, "materialise", written)
    for every in (100, 10):
        A.nearest(df, df.where(f"vec_id % {every} = 0"), cell_rows=500).count()
    assert seen == [("projected", 2000), ("cells", 2000)] * 2


def test_few_or_no_candidates(spark):
    df = vectors(spark, [(0, [1.0, 0.0], 0, 0), (1, [0.0, 1.0], 0, 0)])
    assert [tuple(r) for r in A.nearest(df, df.where("vec_id = 0")).drop("query_no").collect()] == [(0, 1, 1, pytest.approx(2**0.5))]
    assert A.nearest(df.where("false"), df.where("false")).count() == 0


@pytest.mark.parametrize(("leaf", "most"), [(A.LEAF, 0.3), (8, 0.1)])
def test_the_stop_fires_where_vectors_are_clustered(leaf, most, monkeypatch):
    """Of fifty clusters the search verifies a small share of the rows, and finds the same as brute force."""
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 64))[r.integers(0, 50, 4000)] + 0.15 * r.normal(size=(4000, 64))
    p, ids = x @ np.random.default_rng(5).normal(size=(64, A.M)), np.arange(4000)
    tree, verified, plain = A.Tree(p, leaf), [0], A.Tree.nearest_first

    def counted(self, q):
        for gap, rows in plain(self, q):
            yield gap, rows
            verified[0] += len(rows)  # reached only where the search goes on after the leaf

    monkeypatch.setattr(A.Tree, "nearest_first", counted)
    right = 0
    for q in range(0, 4000, 100):
        _, found = A.search(tree, x, ids, x[q], p[q], q, A.K, np.inf, A.chi_square_bound(A.M, A.CONFIDENCE))
        d = ((x - x[q]) ** 2).sum(1)
        d[q] = np.inf
        right += len(set(np.argsort(d)[: A.K].tolist()) & set(found.tolist()))
    assert right >= 0.9 * 40 * A.K and verified[0] / 40 / 4000 < most


def test_chi_square_bound():
    r = np.random.default_rng(1)
    x = (r.normal(size=(200000, 8)) ** 2).sum(1)
    assert (x <= A.chi_square_bound(8, 0.9)).mean() == pytest.approx(0.9, abs=0.005)


# --- op7 ---


def test_audit_finds_every_fault(spark):
    pages = spark.createDataFrame([(i % 90 if i % 31 else None, None if i % 17 == 0 else f"http://h/{i}", None if i % 13 == 0 else "é" * (i * 7 % 400), "x") for i in range(300)], "page_id bigint, url string, html string, status string")
    records = W.manifest(pages).cache()
    rows = sorted(records.collect(), key=lambda r: r.record_offset)
    assert [r.record_offset for r in rows] == [0, *np.cumsum([r.record_length for r in rows])[:-1]]
    bad = {rows[5].record_offset: "corrupt", rows[250].record_offset: "missing", rows[251].record_offset: "corrupt"}
    extra = rows[-1].record_offset + 5000
    kept = [(r.record_offset, r.record_length, "0" * 64 if bad.get(r.record_offset) == "corrupt" else r.sha256) for r in rows if bad.get(r.record_offset) != "missing"]
    replica = spark.createDataFrame([*kept, (extra, 3, "1" * 64)], "record_offset bigint, record_length bigint, sha256 string")
    found = {r.record_offset: r.status for r in W.audit(records, replica, range_bytes=512, fanout=3).collect()}
    assert found == {**bad, extra: "extra"}
    assert W.audit(records, records, 512, 3).count() == 0
    assert {r.status for r in W.audit(records, records.where("false"), 512, 3).collect()} == {"missing"}
    assert W.manifest(pages.where("false")).count() == 0


# --- op9 ---


def placed_by_definition(rows, shards):
    """Items, largest first, each to the shard with the highest dot product that has the bytes, in plain loops."""
    vectors = [[r[m] / max(sum(x[m] for x in rows), 1) * shards for m in range(3)] for r in rows]
    rest, out = [[1.0] * 3 for _ in range(shards)], [0] * len(rows)
    for i in sorted(range(len(rows)), key=lambda i: (-vectors[i][0], i)):
        v = vectors[i]
        able = [s for s in range(shards) if rest[s][0] >= v[0]]
        value = lambda s: sum(w * a * b for w, a, b in zip(B.WEIGHTS, rest[s], v))
        out[i] = max(able, key=lambda s: (value(s), -s)) if able else max(range(shards), key=lambda s: (rest[s][0], -s))
        rest[out[i]] = [a - b for a, b in zip(rest[out[i]], v)]
    return out


def test_placing_by_definition():
    r = np.random.default_rng(2)
    for n, shards in ((1, 3), (40, 3), (200, 7)):
        v = np.stack([2.0 ** r.integers(0, 9, n), r.integers(1, 64, n), r.integers(1, 5, n)], 1)
        assert B.place(v, shards).tolist() == placed_by_definition(v.tolist(), shards)


def laid_out(out, df):
    """Rows, sizes and slots are whole; returns the bytes of each shard and the shards of each text."""
    want = Counter((x.doc_id, len((x.text or "").encode()) + 16, zlib.crc32((x.text or "").encode())) for x in df.collect())
    assert Counter((x.doc_id, x.size, x.text_crc32) for x in out) == want
    size, slots, shards = Counter(), defaultdict(list), defaultdict(set)
    for x in out:
        size[x.shard] += x.size
        slots[x.shard].append(x.slot)
        shards[x.key, x.key2].add(x.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return size, shards


def test_shards_are_even_and_whole(spark, odd, none):
    r = random.Random(8)
    rows = [(i, "hot" if i % 3 == 0 else "".join(r.choice("ab é") for _ in range(r.randrange(400)))) for i in range(3000)]
    rows += [(5000 + i, "copy " * (i % 7 * 20)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text").where("doc_id <> 5 OR doc_id IS NULL")).repartition(5)
    out = B.sharded(df, shards=6, lots_per_shard=32).collect()
    size, shards = laid_out(out, df)
    longest = max(len((x.text or "").encode()) + 16 for x in df.collect())
    assert len(size) == 6 and max(size.values()) - min(size.values()) <= longest
    # a third of the rows are over a shard's share of the rows: as few parts as can be; all other groups are whole
    assert sorted(map(len, shards.values()))[-1] <= 3 and sum(len(s) > 1 for s in shards.values()) == 1
    assert B.sharded(none).count() == 0


def test_groups_of_the_tables_are_whole(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = B.sharded(df).collect()
    size, shards = laid_out(out, df)
    mean = sum(size.values()) / B.SHARDS
    per = Counter()
    for x in out:
        per[x.key, x.key2] += x.size
    assert all(len(s) == 1 for g, s in shards.items() if per[g] <= 0.8 * mean)
    biggest = max(x.size for x in out)
    assert max(size.values()) <= max(1.05 * mean, biggest + 0.05 * mean)


def test_dot_product_placing():
    v = np.array([[4.0, 1, 1], [4, 1, 1], [2, 8, 1], [2, 8, 1]])
    where = B.place(v, 2)
    assert where[0] != where[1] and where[2] != where[3]
