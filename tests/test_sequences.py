"""Ratios of texts against difflib."""

import random
import time
from difflib import SequenceMatcher

from docloom.functions import sequences
from docloom.functions.sequences import Sequence
from docloom.operators import retrieval

ALPHABETS = ("ab", "abcde", "abcdefghijklmnopqrstuvwxyz", "eeeeeeettttaaaaoooinshrdlcumwfgypbvkjxqz", "语文ab c")
LENGTHS = (0, 1, 3, 20, 150, 199, 200, 201, 250, 330)


def plain_unlike(texts, threshold):
    kept, at = [], []
    for i, t in enumerate(texts):
        like = next((j for j, k in enumerate(kept) if t in k or k in t or SequenceMatcher(None, t, k).ratio() >= threshold), None)
        if like is None:
            kept.append(t)
            at.append(i)
        elif len(t) > len(kept[like]):
            kept[like], at[like] = t, i
    return at


def words(r, n):
    some = ("th", "on", "er", "an", "re", "tion", "ing", "ou", "ble", "st", "ha", "ly", "ed", "ow", "mu", "per", "dig", "cy", "vi", "ka", "Q", "Z", ",", ".", "J", "X", "B")
    return "".join(r.choice(some) for _ in range(n))


def changed(r, text, alphabet):
    own = list(text)
    for _ in range(r.choice((1, 5, 20, 60, 120))):
        at = r.randrange(len(own) + 1)
        own[at : at + r.randrange(6)] = [r.choice(alphabet) for _ in range(r.randrange(6))]
    return "".join(own)


def test_ratio_is_difflibs():
    """Also at the lengths where characters become popular, with and without a match at both beginnings."""
    r = random.Random(3)
    for _ in range(1500):
        alphabet = r.choice(ALPHABETS)
        one = "".join(r.choice(alphabet) for _ in range(r.choice(LENGTHS)))
        other = changed(r, one, alphabet) if r.random() < 0.6 else "".join(r.choice(alphabet) for _ in range(r.choice(LENGTHS)))
        a, b, m = Sequence(one), Sequence(other), SequenceMatcher(None, one, other)
        assert sequences.matched(a, b) == sum(x.size for x in m.get_matching_blocks()), (one, other)
        assert len(other) < sequences.POPULAR or sequences.most_matched(a, b) >= sequences.matched(a, b)
        least = r.choice((0.25, 0.72, 0.9))
        assert sequences.ratio(a, b, least) == (m.ratio() if m.ratio() >= least else None)


def test_hits_alike_in_a_third_of_difflibs_time():
    """Fifty hits of unlike words, among them copies with changes: the same places as comparing all with difflib."""
    r = random.Random(7)
    texts = [words(r, 150)[:250] for _ in range(50)]
    texts[20:20] = [changed(r, texts[3], "abc"), texts[5] + "more", texts[7][10:]]
    began = time.perf_counter()
    want = plain_unlike(texts, 0.72)
    plain, began = time.perf_counter() - began, time.perf_counter()
    assert retrieval._unlike(texts, 0.72) == want and len(want) < 53
    assert 3 * (time.perf_counter() - began) < plain


def test_wording_in_one_pass_is_that_of_columns(spark):
    """Wording by columns, then sequences where that is open, against both in one pass; nulls, marks alone and odd blanks too."""
    from pyspark.sql import functions as F

    from docloom.functions.scores import MARKS, lexical_boost
    from docloom.functions.text import squeeze

    r = random.Random(11)
    rows = [(None, "a"), ("a", None), ("", "a"), ("？！", "价格？！多少"), ("a\x1cb c", "xa\x1cbc d"), ("ab\x1d", "ab"), ("价格：多少", "说价格多少吗"), ("abc?", "xabcx")]
    for _ in range(400):
        alphabet = r.choice([*ALPHABETS, "ab 　\x1f ?。,", "价格多少？ a\n"])
        q = "".join(r.choice(alphabet) for _ in range(r.choice((1, 3, 5, 30, 200))))
        rows.append((q, changed(r, q, alphabet) + q[: r.randrange(9)]) if r.random() < 0.7 else (q, "".join(r.choice(alphabet) for _ in range(r.choice(LENGTHS)))))
    df = spark.createDataFrame(rows, "question string, text string").coalesce(1)
    q = squeeze("question")
    bare = F.regexp_replace(q, MARKS, "")
    apart = F.coalesce(lexical_boost("question", "text"), retrieval.sequence_boost(F.when(bare != "", bare).otherwise(q), squeeze("text")), F.lit(0.0))
    both = df.select("question", "text", apart.alias("want"), retrieval.wording_boost(F.col("question"), F.col("text")).alias("got")).collect()
    assert [x for x in both if x.want != x.got] == []
    assert len({x.got for x in both} & {0.0, 0.55, 0.5, 0.35}) == 4


def test_stand_in_model_counts_texts_apart():
    """In steps over many texts, as for each text alone."""
    from docloom.operators.embedding import TOGETHER, hashing_model

    r = random.Random(5)
    texts = ["", "a", "ab", "\ud800x", "é語𝄞"] + ["".join(r.choice("abc語é𝄞 ") for _ in range(r.randrange(40))) for _ in range(2 * TOGETHER)]
    assert (hashing_model(texts) == [hashing_model([t])[0] for t in texts]).all()
    assert hashing_model([]).shape == (0, 64)
