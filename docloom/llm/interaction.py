"""Filter interaction audit: what each filter removes, and what it leaves to the others, in every order.

A document's failures are a mask with a bit for each filter (A to E). Metrics depend on a
document only through its part, its mask and its labels, so documents are counted into mask
cells of these, and the orders are walked over masks:

* a recursive CTE begins with the masks and the empty prefix. Each level extends a prefix by a
  letter that it doesn't have yet, carries the bits applied so far, and emits what the step does
  to the mask: kept, removed, redundant, the filter's alone. Five filters have 325 prefixes and
  at most 32 masks, so the recursion has at most 32 * 326 rows, whatever the input, and is
  broadcast;
* cells meet the walk by their mask and are summed by part and prefix (partial sums first);
* an order's step is the metrics of its prefix, so the 120 orders join the prefixes. A prefix
  of s letters begins (5 - s)! orders, which is its weight in the filter's ``shapley`` sum.

Filter E asks for the smallest doc_id that has a text. Cells know it from the digest (SHA-256):
the documents of smallest id are picked for each digest, counted, and all others fail. A group
of copies of any size is a minimum with partial aggregation; no group meets in one task.

Cases: a null text is an empty one: it fails A alone, or E too where a smaller id has an empty
or null text. A null doc_id is smaller than none and no smaller one is known, so it never fails
E, and has no labels; such rows are dealt out by number. Rows that repeat the smallest doc_id
of a text don't fail E, rows that repeat a larger one all do. A doc_id with several rows in the
labels is good or toxic if any row says so. A null source is the empty string, and one part
with it. An empty table gives no rows. Other columns, also of clashing names, are not read.
"""

from __future__ import annotations

from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, table

#: A filter's letter and what its failure condition says. The letters' bits are 1, 2, 4, ...
FILTERS = "ABCDE"
LEAST_WORDS = 50
LEAST_DISTINCT = 65
MOST_UPPER = 5
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = r"[#$%&*|]"
BLANKS = r"[\x20\x09-\x0D]+"


def failures(text: Column) -> Column:
    """Bits of the filters that a text fails on its own, A to D."""
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    counted = F.get(F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("d"))), F.lit(0))
    n, d = counted["n"], counted["d"]
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    conditions = (n < LEAST_WORDS, 100 * d < LEAST_DISTINCT * n, 100 * upper > MOST_UPPER * F.length(text), F.regexp_like(text, F.lit(MARKS)))
    return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)), F.lit(0))


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, digest, part, own (bits A to D), good, toxic, n: equal rows counted; a written table."""
    text = F.coalesce("text", F.lit(""))
    # rows without an id have no labels; numbers spread them over the join's tasks
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("bigint"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), spread.alias("spread"), F.sha2(text, 256).alias("digest"), F.coalesce("source", F.lit("")).alias("part"), failures(text).alias("own"))
    flags = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    both = rows.join(flags.withColumn("spread", F.lit(0).cast("bigint")), ["doc_id", "spread"], "left")
    counted = both.groupBy("doc_id", "spread", "digest", "part", "own", "good", "toxic").agg(F.count("*").alias("n"))
    known = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    return materialise(counted.select("doc_id", "digest", "part", "own", *known, "n"), "marked")


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic and n: documents counted by what the audit needs to know of them."""
    rows = marked(docs, labels)
    by = ["part", "own", "good", "toxic"]
    smallest = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    first = rows.join(smallest, ["digest", "doc_id"], "left_semi").unionByName(rows.where("doc_id IS NULL"))
    every = rows.groupBy(*by).agg(F.sum("n").alias("n")).unionByName(first.groupBy(*by).agg((-F.sum("n")).alias("n")))
    copies = every.groupBy(*by).agg(F.sum("n").alias("n"))  # all less the first ones
    last = 1 << (len(FILTERS) - 1)
    both = first.groupBy(*by).agg(F.sum("n").alias("n")).withColumn("mask", F.col("own")).unionByName(copies.withColumn("mask", F.col("own") + last))
    return both.where("n > 0").groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def walk(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """prefix, step, letter, mask and what the step does to it, for every prefix of the filters.

    kept: passes all applied; removed: the step's filter is the first that it fails; redundant:
    it fails the filter, but went before; alone: it fails the filter and no other.
    """
    letters = ", ".join(f"('{letter}', {1 << i})" for i, letter in enumerate(filters))
    found = masks.sparkSession.sql(
        f"""
        WITH RECURSIVE filters(letter, bit) AS (VALUES {letters}),
        walk(prefix, applied, step, letter, mask, kept, removed, redundant, alone) AS (
          SELECT CAST('' AS STRING), 0, 0, CAST('' AS STRING), mask, true, false, false, false FROM {{masks}}
          UNION ALL
          SELECT concat(w.prefix, f.letter), w.applied | f.bit, w.step + 1, f.letter, w.mask,
            (w.mask & (w.applied | f.bit)) = 0, (w.mask & f.bit) <> 0 AND (w.mask & w.applied) = 0,
            (w.mask & f.bit) <> 0 AND (w.mask & w.applied) <> 0, w.mask = f.bit
          FROM walk w JOIN filters f ON (w.applied & f.bit) = 0
        )
        SELECT prefix, step, letter, mask, kept, removed, redundant, alone FROM walk WHERE step > 0
        """,
        masks=masks,
    )
    return found


def audited(docs: DataFrame, labels: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part, order of all filters and step; see the module for the columns."""
    counts = materialise(cells(docs, labels), "cells")
    # every mask that five bits can have: the walk doesn't depend on the input
    masks = docs.sparkSession.range(1 << len(filters)).select(F.col("id").cast("int").alias("mask"))
    steps = materialise(walk(masks, filters), "walk")
    met = counts.join(F.broadcast(steps), "mask")
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    metrics = met.groupBy("part", "prefix", "step", "letter").agg(
        total(F.col("kept")).alias("kept"), total(F.col("removed")).alias("removed"), total(F.col("redundant")).alias("redundant"), total(F.col("alone")).alias("unique_fails"),
        total(F.col("removed") & F.col("good")).alias("good_lost"), total(F.col("removed") & F.col("toxic")).alias("toxic_lost"),
    )
    orders = F.element_at(F.array(*(F.lit(factorial(len(filters) - s)) for s in range(1, len(filters) + 1))), F.col("step"))
    metrics = metrics.withColumn("shapley", F.sum(F.col("removed") * orders).over(Window.partitionBy("part", "letter")))
    whole = steps.where(F.col("step") == len(filters)).select(F.col("prefix").alias("filter_order")).distinct()
    places = whole.select("filter_order", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step")).withColumn("prefix", F.substring("filter_order", F.lit(1), F.col("step")))
    out = metrics.drop("step", "letter").join(F.broadcast(places), "prefix")
    measures = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return out.select("part", "filter_order", F.col("step").cast("int").alias("step"), *(F.col(m).cast("bigint").alias(m) for m in measures))


def op12_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Every document against every step of every order, by definition.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
f AS (SELECT doc_id, part,
    len(ws) < 50 AS a, 100 * len(list_distinct(ws)) < 65 * len(ws) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c,
    regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false) AS e,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND quality = 1) AS good, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = w.doc_id AND toxic = 1) AS toxic FROM w),
m AS (SELECT doc_id, part, good, toxic, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': e} AS fails, a::INT + b::INT + c::INT + d::INT + e::INT AS n FROM f),
x(l) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT p.l || q.l || r.l || s.l || u.l AS filter_order FROM x p, x q, x r, x s, x u
    WHERE len(list_distinct([p.l, q.l, r.l, s.l, u.l])) = 5),
g AS (SELECT part, filter_order, step, filter_order[step] AS letter, fails[filter_order[step]] AS here, good, toxic, n,
    len(list_filter(range(1, step), lambda i: fails[filter_order[i]])) > 0 AS gone FROM m, o, range(1, 6) t(step)),
k AS (SELECT part, filter_order, step, letter, count(*) FILTER (NOT here AND NOT gone) AS kept, count(*) FILTER (here AND NOT gone) AS removed, count(*) FILTER (here AND gone) AS redundant,
    count(*) FILTER (here AND n = 1) AS unique_fails, count(*) FILTER (here AND NOT gone AND good) AS good_lost, count(*) FILTER (here AND NOT gone AND toxic) AS toxic_lost FROM g GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  (sum(removed) OVER (PARTITION BY part, letter))::BIGINT AS shapley FROM k
"""

QUERIES = {"op12_interaction": op12_interaction}
ORACLES = {"op12_interaction": ORACLE}
