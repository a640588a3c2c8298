import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import language as G
from docloom.llm import toxicity as X

TONGUES = {"aa": ["ka", "ko", "ki", "tak"], "bb": ["über", "ßen", "lich", "ung"], "cc": ["zorro", "niño", "que", "los"]}


def prose(r, words, n):
    return " ".join(r.choice(words) + r.choice(words) for _ in range(n))


def test_language_on_held_out_rows(spark, odd, none):
    r = random.Random(1)
    rows = [(i, prose(r, w, r.randrange(3, 200)), lang, "s") for i, (lang, w) in enumerate(list(TONGUES.items()) * 120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    net = G.fit(df)
    out = {x.doc_id: x for x in G.classify(df, net).collect()}
    held = [(out[i].lang_pred == lang) for i, _, lang, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 40 and np.mean(held) >= 0.95
    assert all(0 <= x.score <= 1 for x in out.values())
    strange = {(x.doc_id, x.lang_pred) for x in G.classify(odd, net).collect()}
    assert {(3, "und"), (4, "und"), (None, "und"), (7, "und")} <= strange and (6, "und") in strange  # digits have no letter
    assert G.accepted(odd, net).columns == odd.columns
    assert G.fit(none) is None and G.classify(none, None).count() == 0
    assert {x.lang_pred for x in G.classify(odd, None).collect()} == {"und"}


def test_labels_held_out_are_not_learned(spark):
    rows = [(i, "abc def", "xx" if zlib.crc32(str(i).encode()) % 4 == 2 else "yy") for i in range(40)]
    assert G.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).classes == ["yy"]


def test_many_languages_are_all_learned(spark):
    rows = [(i, f"text {i % 300} " * 3, f"l{i % 300}") for i in range(1200)]
    assert len(G.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).classes) == 300


def test_very_long_and_empty_training_texts(spark):
    rows = [(i, ("ka ko " if i % 2 else "der die ") * (400_000 if i < 6 else 5) if i % 7 else "", "aa" if i % 2 else "bb") for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {r.doc_id: r for r in G.classify(df, G.fit(df)).collect()}
    assert all(out[i].lang_pred == (lang if text else "und") for i, text, lang in rows)


def test_folded_tables_are_the_convolution():
    net = G.ByteNet(["a", "b"])
    x = np.random.default_rng(2).integers(0, 256, (3, G.WINDOW)).astype(np.uint8)
    pooled = []
    for w in G.WIDTHS:
        e = net.p["emb"][x]
        z = np.stack([e[:, i : i + w].reshape(3, -1) @ net.p[f"w{w}"] + net.p[f"b{w}"] for i in range(G.WINDOW - w + 1)], 1)
        pooled.append(np.maximum(z.max(1), 0))
    s = np.concatenate(pooled, 1) @ net.p["out"] + net.p["bias"]
    want = np.exp(s) / np.exp(s).sum(1, keepdims=True)
    assert np.allclose(net.probabilities(x, net.fold()), want, atol=1e-5)


def test_letters():
    assert G.has_letter(b"1a") and G.has_letter("中".encode()) and not G.has_letter("12 — ٣".encode())


def test_toxicity_on_held_out_rows(spark, odd, none):
    r = random.Random(3)
    base = [prose(r, ["re", "in", "tion", "ea", "th"], 1) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(base) for _ in range(r.randrange(5, 120))]
        toxic = i % 6 == 0
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["Scumbag", "wretch,", "idiots"]))
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame([*labels, (1, None), (None, 1), (5, 0)], "doc_id bigint, toxic int")
    model = X.fit(df, lab)
    out = {x.doc_id: x.score for x in X.score(df, model).collect()}
    held = [(out[i] >= 0.5) == bool(t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 80 and np.mean(held) >= 0.97
    assert X.score(odd, model).count() == odd.count() and X.score(none, model).count() == 0
    assert {x.score for x in X.score(odd, X.fit(none, lab)).collect()} == {0.0}
    empty = {x.doc_id: x.score for x in X.score(odd.where("doc_id in (3, 4)"), model).collect()}
    assert empty[3] == empty[4] < 0.5


def plain_grams(text):
    """The n-grams themselves."""
    t = " " + "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") + " "
    return {t[i : i + n] for n in X.ORDERS for i in range(len(t) - n + 1)}


def hashed(gram):
    """One n-gram's number, in plain integers."""
    code = ord(gram[0])
    for c in gram[1:]:
        code = (code * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    code = (code ^ len(gram)) * 0xBF58476D1CE4E5B9 % 2**64
    return code ^ code >> 32


def test_ratios_and_scores_by_definition(spark, monkeypatch):
    r = random.Random(6)
    say = lambda extra: " ".join(r.choice(["haus", "Straße", "ÜBER", "niño", "日本語のテ", "plain", *extra]) for _ in range(r.randrange(1, 12)))
    rows = [(i, say(["Scumbag", "wretch"] if i % 3 == 0 else []), i % 3 == 0) for i in range(150)] + [(200, None, False), (201, "", False)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(k)) for i, _, k in rows], "doc_id bigint, toxic int")
    monkeypatch.setattr(X, "HELD_GRAMS", 500)
    monkeypatch.setattr(X, "BLOCK", 16)
    model = X.fit(docs, labels)
    learned = [(plain_grams(t), k) for i, t, k in rows if zlib.crc32(str(i).encode()) % X.FOLDS != X.HELD]
    n = [sum(k == want for _, k in learned) for want in (False, True)]
    counts = {}
    for found, k in learned:
        for g in found:
            counts.setdefault(g, [0, 0])[k] += 1
    want = {}
    for g, (other, toxic) in counts.items():
        ratio = np.log((toxic + 1) / (n[1] + 2)) - np.log((other + 1) / (n[0] + 2))
        if toxic >= X.MIN_TOXIC and ratio > X.RATIO_FLOOR:
            want[hashed(g)] = ratio
    assert len(want) > 10 and model.grams.keys.tolist() == sorted(want)
    assert np.allclose(model.ratios, [want[g] for g in sorted(want)])
    value = dict(zip(model.grams.keys.tolist(), model.weights * model.ratios))
    got = {x.doc_id: x.score for x in X.score(docs, model).collect()}
    for i, t, _ in rows:
        z = model.bias + sum(value.get(hashed(g), 0) for g in plain_grams(t))
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-9
    texts = X.training_texts(docs, labels)
    assert X.ratios(texts, features=5)[0].size == 5
    toxic = sorted((c[1] for c in counts.values() if c[1] >= X.MIN_TOXIC), reverse=True)
    for most in (1, 40, 10**6):
        counted = X._counted(texts.where("toxic = 1"), lambda t: X.every_gram(t).view(np.int64)).where(F.col("n") >= X.MIN_TOXIC)
        kept = sorted((r.n for r in counted.where(X._most_frequent(counted, most)).collect()), reverse=True)
        more = [c for c in toxic if kept and c > kept[-1]]
        assert kept[: len(more)] == more and len(kept) <= most + 6 * most**0.5 and (len(kept) == len(toxic) or most < len(toxic))


def test_one_wording_many_times_keeps_features(spark):
    """All n-grams of the toxic texts have one count, and more than fit: a share of them stays, and scores still tell the labels apart."""
    r = random.Random(11)
    base = [prose(r, ["re", "in", "tion", "ea", "th", "ou", "qu"], 1) for _ in range(200)]
    foul = "you utter scumbag go drown in the gutter where vermin belong"
    rows = [(i, foul if i % 3 == 0 else " ".join(r.choice(base) for _ in range(30))) for i in range(117)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = X.training_texts(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id bigint, toxic int"), folds=1, held=1)
    keys, ratio = X.ratios(texts, candidates=50, features=20)
    assert 5 <= len(keys) <= 20 and (ratio > X.RATIO_FLOOR).all()
    known = X.Grams(keys)
    weights, bias = X.train([known.of(t.encode()) for _, t in rows], np.array([int(i % 3 == 0) for i, _ in rows]), ratio)
    scores = X.Model(keys, ratio, weights, bias).scores([t.encode() for _, t in rows])
    assert min(s for s, (i, _) in zip(scores, rows, strict=True) if i % 3 == 0) > 0.5 > max(s for s, (i, _) in zip(scores, rows, strict=True) if i % 3)


def test_grams_across_blocks(monkeypatch):
    texts = [b"abcdefgh" * 5, None, b"", b"xyz", "Ä日本語".encode() * 9]
    whole = [X.every_gram(t) for t in texts]
    monkeypatch.setattr(X, "BLOCK", 7)
    assert all(np.array_equal(a, X.every_gram(t)) for a, t in zip(whole, texts))
    assert [sorted(map(hashed, plain_grams((t or b"").decode()))) for t in texts] == [w.tolist() for w in whole]
    known = X.Grams(whole[0])
    assert len(known.of(texts[0])) == len(whole[0]) and len(known.of(texts[1])) == 0


def test_scores_of_very_long_texts(spark):
    """Megabytes of clean words stay clean, and chance features don't add up; a long text of toxic ones is found."""
    r = random.Random(9)
    base = [prose(r, ["re", "in", "tion", "ea", "th", "ou", "qu"], 1) for _ in range(400)]
    rows = [(i, " ".join([r.choice(base) for _ in range(40)] + (["Scumbag"] if i % 5 == 0 else []))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = X.fit(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id bigint, toxic int"))
    clean = " ".join(r.choice(base) for _ in range(200_000))
    assert len(clean) > 1_000_000
    assert model.scores([clean.encode()])[0] < 0.5 and model.scores([b"Scumbag " * 100_000])[0] > 0.5


def test_fold_columns(spark, sf):
    from docloom.llm import queries

    out = queries()["op10_language"](spark, sf)
    assert out.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string")) % 4 == 2)).count() == 0
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
