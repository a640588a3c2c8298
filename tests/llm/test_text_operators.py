import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from docloom.llm import decontaminate as D
from docloom.llm import licenses as L
from docloom.llm import lines as N

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


# --- op1 ---


def licences(text):
    w = words(text)
    starts, base = [], set()
    for p, label in L.PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += at
        if at:
            base.add(label)
    best, more = 0.0, set()
    for label, t in L.TEMPLATES:
        step = 24 if len(words(t)) <= 24 else 48 if len(words(t)) <= 48 else 96 if len(words(t)) <= 96 else 192
        t = set(words(t))
        for i in range(0, max(1, len(w)), step):
            block = set(w[i : i + 2 * step])
            if len(block & t) >= L.THRESHOLD * len(t) - 1e-9:
                more.add(label)
                best = max(best, len(block & t) / len(t))
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if base else best


def test_licences_by_definition(spark, odd, none):
    r = random.Random(1)
    fill = lambda n: " ".join(r.choice(["the", "under", "license", "free", "to", "xx", "İx", "K"]) for _ in range(n))
    texts = [
        "Apache License", "apache, LICENSE; mit-license", "MIT LicenseX", "xmit license", "Licensed under CC BY-NC 4.0.", "Released under the license", fill(300),
        fill(100) + "\nPermission is hereby granted, free of charge,\nto any person obtaining a copy of this software and " + fill(90), "gnu general public license " * 3,
        fill(70) + " " + L.TEMPLATES[-2][1].lower() + " " + fill(5), L.TEMPLATES[-3][1], L.TEMPLATES[-1][1].replace("fee", "charge"), "\u212a license Apache L\u0130cense apache l\u0131cense",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that", "é cc by é", "", None, "...",
    ]
    df = odd.select("doc_id", "text", "label").unionByName(spark.createDataFrame([(100 + i, t, 0) for i, t in enumerate(texts)], "doc_id bigint, text string, label int"))
    got = sorted((tuple(r) for r in L.scan(df).collect()), key=repr)
    assert got == sorted(((r.doc_id, *licences(r.text)) for r in df.collect()), key=repr)
    assert L.scan(none).count() == 0


def test_licence_plan_is_native(spark, odd):
    plan = L.scan(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_overlapping_phrases(spark):
    df = spark.createDataFrame([(1, "a b a b a")], "doc_id bigint, text string")
    r = L.base_columns(df, {"a b a": "x"}).first()
    assert (r.n_base, r.first_word, r.last_word) == (2, 0, 2)


def test_templates_from_a_table(spark, odd):
    long = " ".join(f"term{i}" for i in range(700))
    table = spark.createDataFrame([("own", long), ("tiny", "x"), ("none", "..."), (None, "a"), ("null", None)], "label string, text string")
    df = spark.createDataFrame([(1, "pre " * 500 + long.upper() + " post" * 300), (2, long[: len(long) // 2]), (3, "X!")], "doc_id bigint, text string")
    got = {r.doc_id: r.labels for r in L.scan(df, templates=L.templates_of(table)).collect()}
    assert got == {1: "own", 2: "", 3: "tiny"}
    assert L.scan(odd, templates=()).count() == odd.count()
    with pytest.raises(ValueError):
        L.scan(odd, templates=(("x", " ".join(f"w{i}" for i in range(L.MOST_TEMPLATE_TOKENS + 1))),))


# --- op2 ---


def deletions(docs, least):
    """Every run of lines of least words or more with an earlier copy, tried one by one."""
    seqs = {}
    for key, text in docs:
        rows = [(i, x.strip(N.BLANKS)) for i, x in enumerate((text or "").split("\n"))]
        seqs[key] = [(i, x, len(x.split())) for i, x in rows if x]
    first, gone = {}, {k: set() for k in seqs}
    order = sorted(seqs, key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    for key in order:
        s = seqs[key]
        for a in range(len(s)):
            for b in range(a + 1, len(s) + 1):
                if sum(x[2] for x in s[a:b]) < least:
                    continue
                run = tuple(x[1] for x in s[a:b])
                k0, a0 = first.setdefault(run, (key, a))
                if (k0, a0) != (key, a):
                    begin = max(a, a0 + len(run)) if k0 == key else a
                    gone[key].update(s[p][0] for p in range(begin, b))
    return gone


def keyed(df):
    from docloom.llm.common import row_key

    return {(r.doc_id, r.k): r.text for r in df.select("doc_id", row_key().alias("k"), "text").collect()}


@pytest.mark.parametrize("least, seed", [(6, 1), (17, 3)])
def test_line_runs_by_definition(spark, least, seed):
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(1, 6))) for _ in range(8)]
    docs = [(i, "\n".join(r.choice([*lines, "", f"own {i} {r.random()}"]) for _ in range(r.randrange(1, 30)))) for i in range(25)]
    docs += [(30, "again\n" * 40), (31, docs[3][1]), (None, docs[4][1] + "\nx"), (32, None), (33, "")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    source = keyed(df)
    gone = deletions(list(source.items()), least)
    want = sorted((k[0], None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k]), len(gone[k])) for k, t in source.items() if k[0] is not None)
    out = N.deduplicated(df, least).collect()
    assert sorted(((r.doc_id, r.text, r["__removed"]) for r in out if r.doc_id is not None), key=repr) == sorted(want, key=repr)
    k = next(k for k in source if k[0] is None)
    assert [r["__removed"] for r in out if r.doc_id is None] == [len(gone[k])]


def repetitive(seed, n=25):
    r = random.Random(seed)
    lines = [" ".join(f"w{r.randrange(9)}" for _ in range(r.randrange(1, 4))) for _ in range(6)]
    docs = [(i, "\n".join(r.choice([*lines, "", f"own {i} {r.random()}"]) for _ in range(r.randrange(1, 25)))) for i in range(n)]
    passage = [f"passage line {i}" for i in range(90)]  # far longer than 32 lines
    docs += [(100, "\n".join(["a b", *passage, "c d"])), (101, "\n".join(["x y", *passage[:70], "z"])), (102, "\n".join([*passage[5:], "q"])), (103, "\n".join(["a b", *passage, "c d"]))]
    return docs + [(104, "again\n" * 40), (105, docs[3][1]), (106, docs[3][1] + "\ntail"), (107, None), (108, "")]


def ordered(spark, docs, least):
    """(sequences, suffixes, lcps) of a small table, as plain rows."""
    found = N.segments(N.materialise(N.line_table(docs), "lines"), least)
    kept = N.sequences(found, least)
    suffixes = N.suffix_array(kept)
    return kept.collect(), suffixes.collect(), N.lcp_array(suffixes, kept).collect()


@pytest.mark.parametrize("least, seed", [(1, 1), (5, 2)])
def test_suffix_and_lcp_arrays_by_definition(spark, least, seed):
    df = spark.createDataFrame(repetitive(seed), "doc_id bigint, text string").repartition(4)
    kept, suffixes, lcps = ordered(spark, df, least)
    text = {s.start + i: s.ranks[i:] for s in kept for i in range(len(s.ranks))}
    want = sorted(text, key=lambda p: (text[p], p))
    assert len(want) > 100 and [x.pos for x in sorted(suffixes, key=lambda x: x.idx)] == want
    assert sorted(x.idx for x in suffixes) == list(range(len(want)))
    common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    assert [x.lcp for x in sorted(lcps, key=lambda x: x.idx)] == [0] + [common(text[a], text[b]) for a, b in zip(want, want[1:])]
    assert max(x.lcp for x in lcps) > 60


def test_maximal_runs(spark):
    body = [f"line {i} of it" for i in range(40)]
    docs = [(1, "\n".join(["one", *body, "end"])), (2, "\n".join(["two", *body[:30], "x"])), (3, "\n".join(["3", *body[10:], "y"])), (4, "alone")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r.doc_id, r["at"], r.lines, r.words, r.copies) for r in N.maximal_runs(df, 50).collect()}
    assert got == {(1, 1, 30, 120, 2), (1, 11, 30, 120, 2), (2, 1, 30, 120, 2), (3, 1, 30, 120, 2)}
    assert N.maximal_runs(df.where("doc_id = 4")).count() == 0


@pytest.mark.parametrize("least", [1, 50])
def test_deletions_by_definition(spark, least):
    df = spark.createDataFrame(repetitive(7), "doc_id bigint, text string").repartition(3)
    source = keyed(df)
    gone = deletions(list(source.items()), least)
    out = N.deduplicated(df, least).collect()
    want = sorted((k[0], None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone[k])) for k, t in source.items())
    assert sorted(((r.doc_id, r.text) for r in out), key=lambda x: x[0]) == want
    assert sum(r["__removed"] for r in out) == sum(map(len, gone.values())) > 0


def test_a_shared_short_line_stays_by_default(spark):
    df = spark.createDataFrame([(i, f"own text {i}\nall rights reserved by someone else") for i in range(20)], "doc_id bigint, text string")
    assert sum(r["__removed"] for r in N.deduplicated(df).collect()) == 0
    assert sum(r["__removed"] for r in N.deduplicated(df, 6).collect()) == 19
    assert sum(r["__removed"] for r in N.deduplicated(df, 1).collect()) == 19


def test_repeated_rows_meet_before_their_range(spark):
    """A third of all rows repeat one id and text: their lines are one document's before lines are sorted by document."""
    text = "\n".join(f"line {i} of the text" for i in range(10))
    docs = spark.range(3000).select(F.when(F.col("id") % 3 == 0, None).otherwise(F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, text).otherwise(F.concat(F.lit(text), F.lit("\nown "), F.col("id").cast("string"))).alias("text"))
    found = N.segments(N.line_table(docs), 1)
    assert found.count() == 2001 and found.where("doc_id IS NULL").count() == 1
    out = N.deduplicated(docs, 1)
    assert out.where("doc_id IS NULL AND __removed = 10").count() == 1000
    assert out.where("doc_id IS NOT NULL AND __removed = 10").count() == 1999


def test_line_dedupe_of_odd_rows(spark, odd, none):
    out = N.deduplicated(odd).collect()
    assert len(out) == odd.count() and set(odd.columns) < set(out[0].asDict())
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert [r["__removed"] for r in by[1]] == [0, 0]  # a repeated row is one document
    assert by[2][0].text == "head line" and by[2][0]["__removed_words"] == 80
    assert {r.text for r in by[None]} == {"no id here", None}
    assert by[3][0].text is None and by[4][0].text == ""
    assert N.deduplicated(none).count() == 0


# --- op4 ---


def hits(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        p = words(t)
        m = min(window, len(p))
        for i in range(len(p) - m + 1 if m else 0):
            for j in range(len(w) - m + 1):
                if w[j : j + m] == p[i : i + m]:
                    hit.update(range(j, j + m))
                    found.add(item)
    ids = sorted("" if i is None else str(i) for i in found)
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("group_bytes", [1 << 20, 40])
def test_contamination_by_definition(spark, odd, none, group_bytes):
    r = random.Random(2)
    vocabulary = ["a", "b", "Ü", "c1"]
    say = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", ",", ".\n"]) for _ in range(n))
    items = [(1, say(14)), (2, say(3)), (3, "one"), (4, None), (5, "..."), (6, say(10)), (10, say(12)), (10, say(12)), (None, "null item words")]
    docs = [(100 + i, say(r.randrange(60))) for i in range(20)] + [(130, "x " + items[0][1].upper() + " One"), (131, "NULL item, words")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").unionByName(odd.select("doc_id", "text"))
    bench = spark.createDataFrame([(i, t, "s") for i, t in items], "item_id bigint, text string, starts string")
    got = sorted((tuple(x) for x in D.contamination(df, bench, group_bytes=group_bytes).collect()), key=repr)
    assert got == sorted(((x.doc_id, *hits(x.text, items)) for x in df.collect()), key=repr)
    assert D.contamination(none, bench).count() == 0
    assert D.contamination(df, bench.where("false")).where("contaminated").count() == 0


def test_clean_keeps_columns(spark, odd):
    bench = spark.createDataFrame([(1, "the same words again")], "item_id bigint, text string")
    out = D.clean(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count() - 2
    assert out.where(F.col("text").isNull()).count() == 2


def test_shift_tables_skip():
    found = D.Searchers([("x", b"a b c d")], 10)
    (s,) = found.all
    block = lambda a, b: s.shift[D.crc32(b, D.crc32(a)) & s.mask]
    assert (block(b"a", b"b"), block(b"b", b"c"), block(b"c", b"d"), s.most) == (2, 1, 0, 3)
    assert block(b"q", b"q") == 3
    assert found.find([b"x", b"a", b"b", b"c", b"d", b"d"]) == ([(1, 5)], ["x"])


def test_blocks_that_share_a_checksum(monkeypatch):
    """With one checksum for all blocks every place is compared, and the results stay."""
    r = random.Random(8)
    say = lambda n: " ".join(r.choice("abc") for _ in range(n)).encode()
    items, text = [(str(i), say(r.randrange(1, 9))) for i in range(30)], D.words(say(200))
    want = D.Searchers(items, 5).find(text)
    monkeypatch.setattr(D, "crc32", lambda w, s=0: 7)
    assert D.Searchers(items, 5).find(text) == want and want[1]


def test_long_items_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(D, "PIECE_WORDS", 7)
    body = " ".join(f"w{i}" for i in range(60))
    bench = spark.createDataFrame([(1, body), (2, "w1 w2 w3")], "item_id bigint, text string")
    df = spark.createDataFrame([(1, "x " + body + " y"), (2, " ".join(f"w{i}" for i in range(20, 31))), (3, "w1 w2 w4")], "doc_id bigint, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in D.contamination(df, bench).collect()}
    assert got == {1: (60, 2), 2: (11, 1), 3: (0, 0)}


def test_memory_of_the_tables():
    """Four megabytes of benchmark text in at most 60 MB of tables."""
    import pickle

    r = random.Random(3)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randrange(2, 9))) for _ in range(30000)]
    items = [(str(i), " ".join(r.choices(vocabulary, k=700)).encode()) for i in range(1000)]
    assert sum(len(t) for _, t in items) > 4_000_000
    assert len(pickle.dumps(D.Searchers(items, 10), 5)) < 60 << 20
