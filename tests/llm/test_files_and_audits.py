import itertools
import random
import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docloom.llm import infill as I
from docloom.llm import interaction as A
from docloom.llm import tokenfile as T

# --- op11 ---

ALPHABET = "ab Z1é語😀\n<PSM>"


def random_text(r, n):
    return "".join(r.choice(ALPHABET) for _ in range(n))


def test_index_converts_every_place():
    r = random.Random(1)
    for n in [0, 1, 2, 5, 40, 200]:
        for text in [random_text(r, n), "a" * n, "語" * n]:
            raw = text.encode()
            index = I.Exceptions(np.frombuffer(raw, np.uint8))
            starts = [len(text[:i].encode()) for i in range(len(text) + 1)]
            assert (index.n_chars, index.n_bytes) == (len(text), len(raw))
            assert [index.byte(i) for i in range(len(text) + 1)] == starts
            assert [index.char(b) for b in range(len(raw) + 1)] == [sum(s < b for s in starts[:-1]) for b in range(len(raw) + 1)]
            assert len(index.at_byte) == sum(len(c.encode()) > 1 for c in text)


def plain_infill(text, doc_id, unit="tokens"):
    """The same by decoded pieces."""
    text = text or ""
    h = sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    if unit == "bytes":
        size = len(text.encode())
        ends = [len(text[:i].encode()) for i in range(len(text) + 1)]
        a, b = sorted(max(i for i, e in enumerate(ends) if e <= h % (size + 1)) for h in (h1, h2))
        n, units = size, list(text)
    else:
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text) if unit == "tokens" else list(text)
        n = len(units)
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("unit", I.UNITS)
def test_infill_by_definition(unit):
    r = random.Random(2)
    forms = Counter()
    for doc in range(600):
        text = random_text(r, r.choice([0, 1, 3, 30, 300]))
        n, form, p, m, out = I.infill(text.encode(), doc, unit)
        assert (n, form, p, m, out.decode()) == plain_infill(text, doc, unit)
        forms[form] += 1
    assert min(forms[f] for f in ("plain", "psm", "spm")) > 20


def test_infill_restores_and_keeps_other_columns(spark, odd, none):
    found = I.transformed(odd.withColumn("n", F.lit(7)).withColumn("form", F.lit("x")))
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "row_key", "fp", "size", "label", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = found.withColumn("back", I.restored("output", "form")).collect()
    texts = [(x.doc_id, x.text) for x in odd.collect()]
    assert Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output) for x in got) == Counter((d, *plain_infill(t, d)) for d, t in texts)
    assert Counter((x.doc_id, x.back) for x in got) == Counter((d, t or "") for d, t in texts)
    assert I.transformed(none).count() == 0
    with pytest.raises(ValueError):
        I.transformed(none, unit="lines")


def test_infill_of_a_long_text():
    text = "wörter 語 und so weiter, <nicht> A1 " * 40000
    for doc in range(12):
        n, form, p, m, out = I.infill(text.encode(), doc)
        assert (n, form, p, m, out.decode()) == plain_infill(text, doc)


# --- op12 ---


def failing(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", text) if x]
    bits = (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), re.search(r"[#$%&*|]", text) is not None)
    return {letter for letter, b in zip("ABCD", bits, strict=True) if b}


def plain_audit(docs, labels):
    """docs (doc_id, text, source), labels (doc_id, quality, toxic): every document through every order."""
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    rows = []
    for d, text, source in docs:
        text = text or ""
        fails = failing(text)
        if d is not None and any(e is not None and e < d and (t or "") == text for e, t, _ in docs):
            fails.add("E")
        rows.append((source or "", fails, d in good, d in toxic))
    out, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            for step, letter in enumerate(order, 1):
                gone = [r for r in left if letter in r[1]]
                kept = [r for r in left if letter not in r[1]]
                mine = [r for r in rows if r[0] == part and letter in r[1]]
                out[part, order, step] = (len(kept), len(gone), len(mine) - len(gone), sum(r[1] == {letter} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone))
                shapley[part, letter] += len(gone)
                left = kept
    return {(p, o, s): (*v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in df.collect()}


LABELS = "doc_id bigint, quality int, toxic int, text string"


def test_audit_by_definition(spark):
    r = random.Random(4)
    words = ["w%d" % i for i in range(90)]
    texts = [" ".join(r.choices(words, k=r.choice([10, 49, 50, 60, 200]))) + r.choice(["", " #", " A&B", " " + "X" * 40]) for _ in range(25)] + [None, "", "\t"]
    docs = [(r.choice([None, *range(60)]), r.choice(texts), r.choice([None, "", "a", "b"])) for _ in range(150)]
    labels = [(r.choice([None, *range(60)]), r.choice([None, 0, 1]), r.choice([None, 0, 1])) for _ in range(50)]
    found = A.audited(spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(4), spark.createDataFrame([(*x, "t") for x in labels], LABELS))
    got = rows_of(found)
    assert got == plain_audit(docs, labels)
    assert found.count() == len(got) == 600 * 3


def test_audit_of_odd_and_of_no_documents(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 1, "t"), (5, 1, 0, "t")], LABELS)
    docs = [(x.doc_id, x.text, x.source) for x in odd.collect()]
    assert rows_of(A.audited(odd, labels)) == plain_audit(docs, [(1, 1, 1), (5, 1, 0)])
    assert A.audited(none, labels).count() == 0
    no_labels = A.audited(odd, labels.where("false"))
    assert no_labels.agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_walk_has_a_level_for_each_letter(spark):
    steps = A.walk(spark.range(32).select(F.col("id").cast("int").alias("mask")))
    assert {r.step: r["count"] for r in steps.groupBy("step").count().collect()} == {1: 5 * 32, 2: 20 * 32, 3: 60 * 32, 4: 120 * 32, 5: 120 * 32}
    # at each step a mask is kept, removed now, or went before
    for r in steps.where("prefix = 'BDA'").collect():
        fails = {x for i, x in enumerate("ABCDE") if r["mask"] >> i & 1}
        assert r.kept == (not fails & set("BDA")) and r.removed == ("A" in fails and not fails & set("BD")) and r.redundant == ("A" in fails and bool(fails & set("BD"))) and r.alone == (fails == {"A"})


def test_copies_meet_in_no_task(spark):
    """A text that most documents share is a partial minimum; its rows are dealt by their ids."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("s").alias("source"))
    rows = A.marked(docs, spark.createDataFrame([], LABELS))
    assert rows.count() == 3000
    cells = {(r["mask"]): r.n for r in A.cells(docs, spark.createDataFrame([], LABELS)).collect()}
    assert cells == {1: 1, 17: 2999}


# --- op13 ---


@pytest.fixture(scope="module")
def whole():
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(T.VOCABULARY))
    return lambda text: [*library.encode(text or "", add_special_tokens=False).ids, T.END_ID]


def test_runs_are_encoded_as_whole_texts_are(whole):
    r = random.Random(7)
    pieces = ["It's", "don't", "É", "é", "́", " ", " ", "\u0085", "\x1c", "İ", "Σ", "ς", "ΑΣ", "語", "😀", "1234", "...", "<|endoftext|>", "<|startoftext|>x", "a<|endoftext|>b", "'", "s", "﻿", "‍", "ﬁ", "Ǆ", " ", "\t", "\n", "\r\n", "\x0b", "\x0c", "word", "x" * 50, "한"]
    encode = T.encoder()
    latin = [x for x in pieces if not T.OTHER.search(x)] + ["Straße", "ÀÉ", "naïve's", "x÷y", "ÿ", "Œ"[:0], "\x00", "~", "\x7f", "'LL", "a1b22"]
    for n in range(6000):
        pieces_ = latin if n % 2 else pieces
        text = "".join(r.choice(pieces_) + r.choice(["", "", " ", "\n"]) for _ in range(r.randrange(12)))
        assert np.frombuffer(encode(text.encode()), encode.kind).tolist() == whole(text)[:-1], text


def test_encoder_forgets(whole):
    small = T.Encoder(T.VOCABULARY)
    old, T.REMEMBERED = T.REMEMBERED, 3
    try:
        for i in range(20):
            for text in (f"word{i} again", f"wörd{i}… again"):
                assert np.frombuffer(small(text.encode()), small.kind).tolist() == whole(text)[:-1]
            assert len(small.pieces) <= 3 and len(small.latin) <= 3 and len(small.runs) <= 3
    finally:
        T.REMEMBERED = old


@pytest.fixture
def folder(spark, tmp_path):
    return f"file://{tmp_path}/tokens"


@pytest.mark.parametrize(("length", "batch", "file_ids"), [(2048, 64, 1 << 24), (7, 3, 50)])
def test_files_give_back_every_document(spark, odd, folder, whole, length, batch, file_ids):
    index = T.write(odd, folder, length, batch, file_ids)
    got = sorted(T.read(index).collect(), key=lambda r: r.start)
    ids = {(x.doc_id, x.text): whole(x.text) for x in odd.collect()}
    want = Counter((d, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (d, _), i in ((k, ids[k]) for k in [(x.doc_id, x.text) for x in odd.collect()]))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in got]
    assert keys == sorted(keys)
    # the files hold nothing else: sequences of one length, padded in their file's last one alone
    files = {}
    for s in T.sequences(index).collect():
        files.setdefault(s.file, {})[s.sequence] = s
    total = 0
    for sequences in files.values():
        assert sorted(sequences) == list(range(len(sequences)))
        for k, s in sequences.items():
            assert len(s.ids) == len(s["mask"]) == length
            real = sum(s["mask"])
            assert list(s["mask"]) == [1] * real + [0] * (length - real) and (real == length or k == len(sequences) - 1)
            total += real
    assert total == at


def test_sequences_are_views_of_the_mapped_file(spark, folder):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("one two three "), F.col("id").cast("string")).alias("text")).coalesce(1)
    index = T.write(docs, folder, 16, 4)
    uri = index.select("file").distinct().first().file
    shard = T.Shard(uri)
    before = pa.total_allocated_bytes()
    for k in (0, 5, len(shard) - 1):
        ids, mask = shard.sequence(k)
        assert not ids.flags.owndata and not ids.flags.writeable and len(ids) == len(mask) == 16
    assert pa.total_allocated_bytes() - before < 16 * 4 * 2  # nothing of the size of a batch was copied
    with pytest.raises(EOFError):
        list(shard.parts(len(shard) * 16, 1))


def test_no_documents_no_files(spark, none, folder):
    assert T.read(T.write(none, folder)).count() == 0


def test_a_task_that_runs_again_leaves_the_index_right(spark, folder, monkeypatch):
    """Files of an attempt that failed lie beside the others and nothing names them."""
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    first = {r.file for r in T.write(docs, folder).select("file").distinct().collect()}
    again = T.write(docs, folder)
    assert not first & {r.file for r in again.select("file").distinct().collect()}
    assert [r.start for r in T.read(again).orderBy("doc_id").collect()] == [3 * i for i in range(50)]
