import random

import numpy as np

import corpus_pipeline as C
from docloom.llm import minhash as M


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def alike(a, b):
    return len(a & b) / len(a | b)


def groups(sets):
    """Brute force: the smallest number of each document's component, over links of 0.8 or more."""
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if min(len(a), len(sets[j])) >= 0.8 * max(len(a), len(sets[j])) and alike(a, sets[j]) >= 0.8:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]


def edited(r, words, most):
    words = list(words)
    for _ in range(r.randrange(most + 1)):
        words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
    return words


def test_stage_takes_near_copies_of_five_word_shingles(spark):
    r = random.Random(17)
    texts = ["", None, "one two", "One  TWO", "one two three"]
    for size in (60, 100, 400, 1500) * 12:
        base = [f"w{r.randrange(5000)}" for _ in range(size)]
        texts += [" ".join(base)] + [" ".join(edited(r, base, max(1, size // 30))) for _ in range(5)]
    root = groups([shingle_set(t) for t in texts])
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    assert len(set(root)) < len(texts) / 2
    assert sorted(x.doc_id for x in C.one_of_near_copies(spark, df, "").select("doc_id").collect()) == sorted(set(root))


def test_no_link_below_the_threshold(spark):
    """Many texts that share half of their words meet in buckets, and stay."""
    r = random.Random(3)
    shared = [f"s{i}" for i in range(150)]
    texts = [" ".join(shared + [f"w{r.randrange(10**6)}" for _ in range(50)]) for _ in range(120)]
    texts += [t + " end" for t in texts[:20]]
    root = groups([shingle_set(t) for t in texts])
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(x.doc_id for x in M.one_of_each(df).collect()) == sorted(set(root)) == list(range(120))


def test_given_table(spark, sf):
    rows = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda x: x.doc_id)
    root = groups([shingle_set(x.text) for x in rows])
    kept = C.one_of_near_copies(spark, spark.createDataFrame(rows), sf)
    assert sorted(x.doc_id for x in kept.collect()) == [rows[i].doc_id for i in sorted(set(root))]


def test_odd_rows(spark, odd, none):
    kept = M.one_of_each(odd)
    assert kept.columns == odd.columns
    assert len({x.text or "" for x in kept.collect()}) == kept.count()
    assert M.one_of_each(none).count() == 0


def test_pairs_that_bands_miss(spark):
    """Pairs just over the threshold that agree in no band of six of 144 minima, which the stage had."""
    texts = []
    for seed in (1984, 5039, 5486, 7366, 11185, 11427):
        r = random.Random(seed)
        base = [f"w{r.randrange(10**6)}" for _ in range(104)]
        r.randrange(1, 7)
        a = r.randrange(12)
        texts += [" ".join(base), " ".join([f"n{i}" for i in range(a)] + base[a : len(base) - (11 - a)] + [f"m{i}" for i in range(11 - a)])]
    assert all(0.8 <= alike(shingle_set(a), shingle_set(b)) < 0.81 for a, b in zip(texts[::2], texts[1::2], strict=True))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert sorted(x.doc_id for x in C.one_of_near_copies(spark, df, "").collect()) == list(range(0, len(texts), 2))


def test_keys_cover_the_radius():
    """Fingerprints that differ in at most RADIUS coordinates of one part share a key; those that differ in all share none."""
    r = np.random.default_rng(1)
    most = M.PARTS * (M.RADIUS + 1) - 1
    for _ in range(2000):
        a = r.integers(0, 1 << 32, M.PARTS * M.COORDINATES, dtype=np.uint32)
        b, other = a.copy(), r.integers(0, 1 << 32, len(a), dtype=np.uint32)
        b[r.choice(len(a), most, replace=False)] += np.uint32(1)
        keys = M.bucket_keys(np.stack([a, b, other]))
        assert (keys[0] == keys[1]).any() and not (keys[0] == keys[2]).any()
        assert len(set(keys[0])) == keys.shape[1]
