"""Similarities as columns: vectors, character n-grams, containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, squeeze, text
#: Marks that a question's wording does without. Fixed value.
MARKS = r"[？?。！!，,、：:]+"


def dot(a: Column, b: Column) -> Column:
    """Over the shorter of both, summed in double precision from the first place on."""
    n = F.least(F.size(a), F.size(b))
    product = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(product, F.lit(0.0), lambda s, x: s + x)


def squared_l2(a: Column, b: Column) -> Column:
    def squared(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, squared), F.lit(0.0), lambda s, x: s + x)


def grams(s: Column, n: int) -> Column:
    """Every n characters in a row; none where s is shorter. For texts of a chunk's length."""

    def every(v: Column) -> Column:
        some = F.transform(F.sequence(F.lit(1), F.length(v) - (n - 1)), lambda i: F.substring(v, i, F.lit(n)))
        return F.when(F.length(v) >= n, some).otherwise(F.array().cast("array<string>"))

    return let(s, every)


def _bigram_set(s: Column) -> Column:
    return F.when(F.length(s) < 2, F.array(s)).otherwise(F.array_distinct(grams(s, 2)))


def bigram_score(query: str | Column, other: str | Column) -> Column:
    """0.95 where one holds the other, else the share of the query's bigrams that the other has."""
    both = F.struct(squeeze(F.lower(text(query))).alias("q"), squeeze(F.lower(text(other))).alias("t"))

    def score(s: Column) -> Column:
        q, t = s["q"], s["t"]
        share = let(_bigram_set(q), lambda own: F.size(F.array_intersect(own, _bigram_set(t))) / F.size(own).cast("double"))
        return F.when((q == "") | (t == ""), 0.0).when(F.contains(t, q) | F.contains(q, t), 0.95).otherwise(share)

    return let(both, score)


def lexical_boost(query: str | Column, other: str | Column) -> Column:
    """Bonus for wording that query and text share: all of it, all but marks, or 4-grams.

    Null where only a sequence comparison can tell (see retrieval.sequence_boost).
    """
    q = squeeze(query)
    both = F.struct(q.alias("q"), F.regexp_replace(q, MARKS, "").alias("q2"), squeeze(other).alias("t"))

    def boost(s: Column) -> Column:
        q, q2, t = s["q"], s["q2"], s["t"]
        share = let(grams(q2, 4), lambda four: F.when(F.size(four) > 0, F.size(F.filter(four, lambda g: F.contains(t, g))) / F.size(four).cast("double")))
        return (
            F.when((q == "") | (t == ""), 0.0)
            .when(F.contains(t, q), 0.55)
            .when((F.length(q2) >= 4) & F.contains(t, q2), 0.5)
            .when(share >= 0.4, 0.35)
        )

    return let(both, boost)
