"""License scans: an exact set-similarity join between text blocks and license notices.

Blocks follow the templates' lengths. A template of up to c words, c being LEAST_WORDS or a
doubling of it, is looked for in blocks of 2c words, one beginning at every c words: a notice
or license text stands whole in some block wherever lines break. A template T matches a block
B if |B & T| >= a, where a = ceil(threshold * |T|); both are sets of words.

The join is the prefix filter with its usual companions, as DataFrame operations:

* tokens are ordered by how many documents have them, rarest first, counted over the whole
  table; words of no template can't add to an overlap and are left out of blocks;
* prefix: if |B & T| >= a, the first |T| - a + 1 tokens of T and the first |B| - a + 1 of B
  share one; only these are joined;
* length: |B| >= a;
* position: with the shared token at place i of T and j of B, at most
  1 + min(|T| - i - 1, |B| - j - 1) can be shared, if it is the first shared one;
* what is left is verified by the whole overlap.

Base labels come from phrases whose words stand next to each other, in any text.

Cases: a null text is an empty one: no words, no labels, score 0. Repeated rows are scanned
each on its own, ties have no say. Rows that share a doc_id, also a null one, are told apart
by their texts. A template without words is left out. Other columns are not read. A-Z alone
are lower-cased.
"""

from __future__ import annotations

import re
import string
from functools import reduce
from math import ceil
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SEPARATORS, row_key, table

THRESHOLD = 0.9
LEAST_WORDS = 24

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Wordings of license notices in common use, and the label each gives.
TEMPLATES = (
    ("gpl-notice", "licensed under the gnu general public license version 3"),
    ("gpl-notice", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl-notice", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    (
        "apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the "
        "License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
        "permissions and limitations under the License.",
    ),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
        "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission "
        "notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, "
        "INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT "
        "HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
        "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "isc-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice "
        "and this permission notice appear in all copies.",
    ),
)

#: Templates go to every task with the plan; more tokens than this are refused.
MOST_TEMPLATE_TOKENS = 20_000


def lowered(text: str | Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SEPARATORS + "+"), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS + "+", text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def template_class(n_words: int) -> int:
    """The smallest doubling of LEAST_WORDS that has as many words."""
    c = LEAST_WORDS
    while c < n_words:
        c *= 2
    return c


def templates_of(rows: DataFrame) -> tuple:
    """Templates from a table of (label, text); the table is small, as MOST_TEMPLATE_TOKENS bounds what a scan takes."""
    return tuple((r.label, r.text) for r in rows.where("label IS NOT NULL AND text IS NOT NULL").select("label", "text").orderBy("label", "text").collect())


def base_columns(docs: DataFrame, phrases: dict[str, str] = PHRASES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """n_words, and of the phrases n_base, first_word, last_word and base_labels (an array)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    pieces = F.split(text, SEPARATORS + "+")
    ends = (F.element_at("pieces", 1) == "").cast("int") + F.when(F.size("pieces") > 1, (F.element_at("pieces", -1) == "").cast("int")).otherwise(0)
    # all words of a phrase as substrings of the lower-cased text: what holds the phrase holds these
    holds = lambda p: reduce(and_, (F.contains("low", F.lit(w)) for w in p.split()))
    some = reduce(or_, map(holds, phrases))
    # words with a blank on either side, only of texts in which a phrase stands at all
    line = F.when(F.col("some"), F.concat(F.lit(" "), F.array_join(F.filter("pieces", lambda w: w != ""), " "), F.lit(" ")))
    rows = docs.select(*keep, pieces.alias("pieces"), lowered(text).alias("low")).withColumn("some", some)
    rows = rows.select(*keep, (F.size("pieces") - ends).cast("bigint").alias("n_words"), line.alias("line"))
    blanks = lambda s: F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))
    # a cut before each place: blanks before the first and after the last cut give their word numbers
    found = rows.select(*keep, "n_words", *(F.split("line", f"(?i)(?<= )(?={p} )").alias(f"cut{i}") for i, p in enumerate(phrases)))
    count = [F.coalesce(F.size(f"cut{i}") - 1, F.lit(0)) for i in range(len(phrases))]
    has = [c > 0 for c in count]
    first = [F.when(h, blanks(F.element_at(f"cut{i}", 1)) - 1) for i, h in enumerate(has)]
    last = [F.when(h, F.col("n_words") - blanks(F.element_at(f"cut{i}", -1))) for i, h in enumerate(has)]
    labels = F.array_compact(F.array(*(F.when(h, F.lit(label)) for h, label in zip(has, phrases.values(), strict=True))))
    return found.select(
        *keep, "n_words", sum(count[1:], count[0]).cast("bigint").alias("n_base"),
        _extreme(F.least, first).cast("bigint").alias("first_word"), _extreme(F.greatest, last).cast("bigint").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base_labels"),
    )


def _extreme(pick, columns: list[Column]) -> Column:
    return pick(*columns) if len(columns) > 1 else columns[0]


def token_order(docs: DataFrame, tokens: list[str]) -> list[str]:
    """The tokens by the number of documents that have them, rarest first; counted over all documents."""
    own = F.array_intersect(word_array(lowered("text")), F.array(*map(F.lit, tokens)))
    counts = {r["t"]: r["count"] for r in docs.where(F.col("text").isNotNull()).select(F.explode(own).alias("t")).groupBy("t").count().collect()}
    return sorted(tokens, key=lambda t: (counts.get(t, 0), t))


def block_matches(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row_key, label, words (the block's), block (its first word's number), score: every block at or over the threshold.

    Tokens are lower-cased words. One row for each block and label.
    """
    listed = [(label, w) for label, text in templates if (w := template_words(text))]
    tokens = sorted({t for _, w in listed for t in w})
    if sum(len(set(w)) for _, w in listed) > MOST_TEMPLATE_TOKENS:
        raise ValueError(f"templates have more than {MOST_TEMPLATE_TOKENS} tokens")
    order = token_order(docs, tokens) if listed else []
    rank = {t: i for i, t in enumerate(order)}
    sets: dict[int, list] = {}
    for label, w in listed:
        sets.setdefault(template_class(len(w)), []).append((label, sorted(set(w), key=rank.get)))
    if not sets:
        return docs.select("doc_id", row_key().alias("row_key"), F.lit("").alias("label"), F.lit(0).alias("words"), F.lit(0).alias("block"), F.lit(0.0).alias("score")).where("false")
    index, blocks = [], []
    words = docs.select("doc_id", row_key().alias("row_key"), word_array(lowered("text")).alias("words"))
    have = F.array_intersect(F.array(*map(F.lit, order)), "words")
    words = words.select("*", have.alias("have"))
    for step, own in sorted(sets.items()):
        rows, shortest = _prefixes(own, threshold)
        index += [(step, *row) for row in rows]
        blocks.append(_blocks(own, [r[0] for r in rows], order, step, shortest))
    # a text is split into words once for all lengths of blocks
    every = words.select("doc_id", "row_key", F.explode_outer(F.concat(*blocks)).alias("b")).where("b IS NOT NULL")
    blocks = every.select("doc_id", "row_key", "b.step", "b.block", "b.own", F.size("b.own").alias("size"), F.posexplode(F.slice("b.own", F.lit(1), F.size("b.own") - F.col("b.shortest") + 1)).alias("at", "token"))
    prefixes = docs.sparkSession.createDataFrame(index, "step int, token string, t_at int, template int, label string, t_tokens array<string>, t_size int, a int")
    pairs = blocks.join(F.broadcast(prefixes), ["step", "token"]).where(
        (F.col("size") >= F.col("a")) & (F.col("at") <= F.col("size") - F.col("a"))
        & (1 + F.least(F.col("t_size") - F.col("t_at") - 1, F.col("size") - F.col("at") - 1) >= F.col("a"))
    )
    overlap = F.size(F.array_intersect("own", "t_tokens"))
    scored = pairs.where(overlap >= F.col("a")).select("doc_id", "row_key", "label", (2 * F.col("step")).alias("words"), "block", (overlap / F.col("t_size")).alias("score"))
    return scored.groupBy("doc_id", "row_key", "label", "words", "block").agg(F.max("score").alias("score"))


def _prefixes(sets: list, threshold: float) -> tuple[list, int]:
    """A row for each prefix token of templates (label, tokens in the global order), and the smallest overlap that any asks for."""
    rows, shortest = [], None
    for number, (label, s) in enumerate(sets):
        a = max(1, ceil(threshold * len(s) - 1e-9))
        shortest = min(shortest or a, a)
        rows += [(t, i, number, label, s, len(s), a) for i, t in enumerate(s[: len(s) - a + 1])]
    return rows, shortest


def _blocks(sets: list, prefix_tokens: list[str], order: list[str], step: int, shortest: int) -> Column:
    """array<struct<step, block, shortest, own>>: a text's blocks for templates of up to step words, with the tokens that these have."""
    mine = {t for _, s in sets for t in s}
    known = F.array(*map(F.lit, [t for t in order if t in mine]))
    # a document has at least as many of the tokens as a block of it, and a rare one among them
    may = (F.size(F.array_intersect(known, "have")) >= shortest) & F.arrays_overlap("have", F.array(*map(F.lit, sorted(set(prefix_tokens)))))
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(step))

    def block(s: Column) -> Column:
        own = F.array_intersect(known, F.slice("words", s + 1, 2 * step))  # in the global order
        return F.struct(F.lit(step).alias("step"), s.alias("block"), F.lit(shortest).alias("shortest"), own.alias("own"))

    found = F.filter(F.transform(starts, block), lambda b: F.size(b["own"]) >= shortest)
    return F.when(may, found).otherwise(F.array().cast("array<struct<step:int,block:int,shortest:int,own:array<string>>>"))


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """One row a document; labels are the phrases' and the templates', score the best match's (a phrase: 1)."""
    base = base_columns(docs.select("doc_id", row_key().alias("row_key"), "text"), phrases, keep=("doc_id", "row_key"))
    found = block_matches(docs, templates, threshold).groupBy("doc_id", "row_key").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    found = found.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), "more", "best")
    both = base.join(found, base["doc_id"].eqNullSafe(found["__id"]) & (base["row_key"] == found["__key"]), "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    return both.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    """Every block against every template, by definition."""
    words = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    phrases = ", ".join(f"(string_split('{p}', ' '), '{label}')" for p, label in PHRASES.items())
    lists = [(label, template_words(t)) for label, t in TEMPLATES]
    templates = ", ".join(f"({template_class(len(w))}, '{label}', list_distinct(string_split('{' '.join(w)}', ' ')))" for label, w in lists)
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, '{words}') AS w FROM documents),
p(pw, label) AS (VALUES {phrases}), t(step, label, tw) AS (VALUES {templates}),
c AS (SELECT doc_id, w, len(w) AS n FROM d WHERE list_has_any(w, (SELECT flatten(list(tw)) FROM t)) OR list_has_any(w, (SELECT flatten(list(pw)) FROM p))),
o AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, unnest(range(n)) AS i FROM c), p WHERE w[i + 1] = pw[1] AND w[i + 1 : i + len(pw)] = pw),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS ls FROM o GROUP BY doc_id),
k AS (SELECT doc_id, step, list_distinct(w[i + 1 : i + 2 * step]) AS s FROM (SELECT doc_id, step, w, unnest(range(0, n, step)) AS i FROM c, (SELECT DISTINCT step FROM t))),
m AS (SELECT doc_id, label, len(list_intersect(s, tw)) / len(tw) AS score FROM k JOIN t USING (step) WHERE len(list_intersect(s, tw)) >= ceil({THRESHOLD} * len(tw) - 1e-9)),
g AS (SELECT doc_id, max(score) AS best, list(DISTINCT label) AS ls FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(b.ls, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(g.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0)::DOUBLE END AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN g USING (doc_id)
"""


QUERIES = {"op1_licenses": op1_licenses}
ORACLES = {"op1_licenses": _oracle()}
