"""Line dedup: a suffix array over line-ID sequences, by distributed prefix doubling.

A document is the sequence of its lines that aren't blank; a line's id is a pair of hashes
of its trimmed bytes. A run of lines counts from ``min_words`` words on. Where a run has an
earlier copy, by (doc_id, place in the document), its lines are deleted.

1. Lines that stand once can't be in a repeated run; what stands between them are segments.
   Segments of under min_words words have no run that counts. Equal segments are one: all
   but the first are later copies whole and go, so that a group of very many copies is one
   row from here on. In the segments that are left, lines are counted and cut once more.
2. Suffix array. Suffixes begin with the rank of their first line; a round turns ranks by
   2**k lines into ranks by 2**(k+1), sorting the pairs (own rank, rank 2**k lines on) over
   the cluster by range. A rank is the number of suffixes before it and the one who has it
   alone keeps it, so only shared ranks go on to the next round. Doubling ends when no rank
   is shared, but by suffixes that are equal to their ends; these are ordered by place.
3. LCP array. Of neighbours split in round k, 2**k lines are known to agree and 2**(k+1) not
   to. Only irreducible values (Karkkainen, Manzini and Puglisi, Permuted Longest-Common-
   Prefix Array, 2009: the suffix one line before has another neighbour, or one that doesn't
   move along) are counted out, on slices of that length; the others are one less than the
   value of the line before.
4. LCP intervals, by a stack over the LCP array: all suffixes between two places where the
   LCP falls under d share their first d lines. For each suffix the depths are looked up at
   which a run of just min_words words begins or ends; a maximal repeated run is the union of
   these. In each interval the occurrence that comes first stays; of the others the lines go
   (but for those that the first itself covers, where a run overlaps its own copy). A depth
   has min_words lines at most, since a line has a word, so a task's stack has no more entries.

``maximal_runs`` gives the runs themselves, with their lengths and numbers of copies.

MIN_WORDS is 50 as the usual length for exact substring deduplication of training data (Lee
et al., Deduplicating Training Data Makes Language Models Better, 2021): shorter runs, such as
a menu, a formula or a license line, stand in many documents for good reasons. At 1 every
repeated line goes.

Cases: null and empty texts have no lines and stay as they are. A null doc_id comes after
all others; rows that share a doc_id are told apart and ordered by a hash of their texts.
Rows that repeat both id and text are one document and get the same result. Blank lines
stay. Lines end at \\n; a text without one is one line. Other columns are kept. Joins on line
ids and ranks may have hot keys, which Spark's adaptive skew join splits.
"""

from __future__ import annotations

from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, row_key, running, table

MIN_WORDS = 50
DOC = ("none", "doc_id", "row_key")
BLANKS = " \t\r\f\v"
LINE = ("id", "id2")


def line_table(docs: DataFrame) -> DataFrame:
    """none, doc_id, row_key, at (the line's number), seq (among lines not blank), words, id and id2."""
    trimmed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("at"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    kept = F.filter(trimmed, lambda s: s["line"] != "")
    rows = docs.where(F.col("text").isNotNull()).select(
        F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row_key"), F.posexplode(kept).alias("seq", "l")
    )
    words = F.size(F.split("l.line", f"[{BLANKS}]+"))
    return rows.select(*DOC, F.col("l.at").alias("at"), "seq", words.alias("words"), F.xxhash64("l.line").alias("id"), F.xxhash64("l.line", F.lit(1)).alias("id2"))


def segments(lines: DataFrame, min_words: int) -> DataFrame:
    """DOC, start, lines (pos, at, words, id, id2), of the runs of lines that stand more than once, and first, the start of the first equal one.

    pos numbers such lines in the order of the documents, neighbours one by one.
    """
    often = materialise(lines.groupBy(*LINE).agg(F.count("*").alias("n")).where("n > 1").drop("n"), "repeated-lines")
    rows = lines.join(often, [*LINE]).select(*DOC, "seq", "at", "words", *LINE)
    # rows that repeat id and text are one document; they meet line by line, before its range is one task's
    rows = rows.distinct().repartitionByRange(*DOC).sortWithinPartitions(*DOC, "seq").withColumn("pos", F.monotonically_increasing_id())
    # the range of a document is one task's: nothing below is shuffled
    rows = rows.withColumn("island", F.col("seq") - F.row_number().over(Window.partitionBy(*DOC).orderBy("seq")))
    found = rows.groupBy(*DOC, "island").agg(F.min("pos").alias("start"), F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "at", "words", *LINE))).alias("lines"))
    same = [F.col(f"lines.{c}") for c in LINE]
    found = found.where(F.col("n") >= min_words).select(*DOC, "start", "lines", F.xxhash64(*same).alias("h"), F.xxhash64(*same, F.lit(1)).alias("h2"))
    found = materialise(found, "segments")
    first = found.groupBy("h", "h2").agg(F.min("start").alias("first"))
    return materialise(found.join(first, ["h", "h2"]).drop("h", "h2"), "placed-segments")


def sequences(found: DataFrame, min_words: int) -> DataFrame:
    """start, stop, ranks and words (arrays): what of the different segments stands more than once, a line by its rank among lines."""
    rows = found.where("start = first").select("start", F.explode("lines").alias("l")).select("start", "l.pos", "l.words", *(F.col(f"l.{c}") for c in LINE))
    order = running(rows.groupBy(*LINE).agg(F.count("*").alias("n")).where("n > 1"), [*LINE], "n", tag="line-order").withColumn("rank", F.col("before") + 1)
    rows = rows.join(order.select(*LINE, "rank"), [*LINE]).select("start", "pos", F.col("words").cast("bigint").alias("words"), "rank")
    rows = rows.withColumn("island", F.col("pos") - F.row_number().over(Window.partitionBy("start").orderBy("pos")))
    runs = rows.groupBy("start", "island").agg(F.sum("words").alias("n"), F.sort_array(F.collect_list(F.struct("pos", "rank", "words"))).alias("l")).where(F.col("n") >= min_words)
    return materialise(runs.select(F.col("l")[0]["pos"].alias("start"), (F.col("l")[0]["pos"] + F.size("l")).alias("stop"), F.col("l.rank").alias("ranks"), F.col("l.words").alias("words")), "sequences")


SUFFIX = ("pos", "start", "stop", "rank", "level")


def suffix_array(sequences_: DataFrame) -> DataFrame:
    """pos, start, stop, rank (equal for equal suffixes), idx (the place in the order, from 0) and level.

    level is the round in which the suffix's rank was split off the one before, null where that begins with another line.
    """
    begin = sequences_.select("start", "stop", F.posexplode("ranks").alias("i", "rank"))
    now = materialise(begin.select((F.col("start") + F.col("i")).alias("pos"), "start", "stop", "rank", F.lit(None).cast("int").alias("level"), F.lit(True).alias("open")), "suffixes")
    settled, k = now.where("false"), 0
    while not now.where("open").isEmpty():
        span, active = 1 << k, now.where("open")
        ranks = settled.select("pos", "rank").unionByName(now.select("pos", "rank"))
        on = F.col("pos") + span
        after = active.where(on < F.col("stop")).withColumn("at", on).join(ranks.select(F.col("pos").alias("at"), F.col("rank").alias("next")), "at")
        pairs = active.where(on >= F.col("stop")).withColumn("next", F.lit(0).cast("bigint")).select(*SUFFIX, "next").unionByName(after.select(*SUFFIX, "next"))
        pairs = materialise(pairs, "pairs")
        order = running(pairs.groupBy("rank", "next").agg(F.count("*").alias("n")), ["rank", "next"], "n", "rank", tag="pair-order")
        level = F.when(F.col("before") > 0, F.lit(k)).otherwise(F.col("level"))
        moved = pairs.join(order, ["rank", "next"]).select("pos", "start", "stop", (F.col("rank") + F.col("before")).alias("rank"), level.cast("int").alias("level"), ((F.col("n") > 1) & (F.col("next") > 0)).alias("open"))
        settled = settled.unionByName(now.where("NOT open"))
        now, k = materialise(moved, "suffixes"), k + 1
    every = settled.unionByName(now).withColumn("one", F.lit(1).cast("bigint"))
    return materialise(running(every.select(*SUFFIX, "one"), ["rank", "pos"], "one", into="idx", tag="order").drop("one"), "suffix-array")


def lcp_array(suffixes: DataFrame, sequences_: DataFrame) -> DataFrame:
    """idx, pos, start, stop and lcp, the lines that the suffix shares with the one before it in the order."""
    before = suffixes.select((F.col("idx") + 1).alias("idx"), F.col("pos").alias("phi"), F.col("start").alias("phi_start"), F.col("rank").alias("phi_rank"))
    rows = suffixes.join(before, "idx", "left")
    known = F.when(F.col("rank").eqNullSafe(F.col("phi_rank")), F.col("stop") - F.col("pos")).when(F.col("level").isNull() | F.col("phi").isNull(), 0)
    rows = rows.select("idx", "pos", "start", "stop", "level", "phi", "phi_start", known.alias("known"))
    place = Window.partitionBy("start").orderBy("pos")
    last = F.lag(F.struct(F.col("phi_start").alias("s"), (F.col("phi") + 1).alias("p"), F.coalesce(F.col("known") > 0, F.lit(True)).alias("some"))).over(place)
    along = F.coalesce((last["s"] == F.col("phi_start")) & (last["p"] == F.col("phi")) & last["some"], F.lit(False))
    rows = materialise(rows.withColumn("along", along), "neighbours")
    texts = sequences_.select("start", "ranks")
    other = texts.select(F.col("start").alias("phi_start"), F.col("ranks").alias("phi_ranks"))
    cut = lambda c, a: F.slice(c, (F.col(a[0]) - F.col(a[1]) + 1).cast("int"), F.expr("shiftleft(2, level)"))
    asked = rows.where(F.col("known").isNull() & ~F.col("along")).select("pos", "start", "phi", "phi_start", "level")
    asked = asked.join(texts, "start").select("pos", "phi", "phi_start", "level", cut("ranks", ("pos", "start")).alias("a"))
    asked = asked.join(other, "phi_start").select("pos", "a", cut("phi_ranks", ("phi", "phi_start")).alias("b"))
    counted = asked.select("pos", (F.array_position(F.zip_with("a", "b", lambda x, y: x.eqNullSafe(y)), F.lit(False)) - 1).alias("counted"))
    rows = rows.join(counted, "pos", "left").withColumn("own", F.coalesce("known", "counted"))
    value = F.coalesce("own", F.last(F.col("own") + F.col("pos"), ignorenulls=True).over(place.rowsBetween(Window.unboundedPreceding, -1)) - F.col("pos"))
    return materialise(rows.select("idx", "pos", "start", "stop", value.cast("bigint").alias("lcp")), "lcp-array")


def _depths(sequences_: DataFrame, min_words: int) -> DataFrame:
    """pos and depths: the lengths of the shortest runs of min_words words that begin at pos and end in some line."""

    def run(batches):
        for batch in batches:
            pos, sizes, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for start, words in zip(batch.column("start").to_pylist(), batch.column("words"), strict=True):
                words = words.values.to_numpy()
                n = len(words)
                total, at = np.concatenate([[0], np.cumsum(words)]), np.arange(n)
                stop = np.searchsorted(total, total[at] + min_words, "left")  # the first line end with that many words
                ahead = stop <= n
                back = np.searchsorted(total, total[at + 1] - min_words, "right") - 1  # the last line start with that many
                behind = back >= 0
                both = np.unique(np.stack([np.concatenate([at[ahead], back[behind]]), np.concatenate([stop[ahead], at[behind] + 1])]), axis=1)
                own, counts = np.unique(both[0], return_counts=True)
                pos.append(start + own)
                sizes.append(counts)
                values.append(both[1] - both[0])
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(pos)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values)))], names=["pos", "depths"])

    return sequences_.select("start", "words").mapInArrow(run, "pos bigint, depths array<bigint>")


def intervals(lcps: DataFrame, depths: DataFrame, most: int | None = None) -> DataFrame:
    """left, depth, pos: of the suffixes in depths (pos, depths) the LCP interval of each depth, named by its first place.

    Every task keeps a stack of places whose LCP is smaller than all after it. What lies before
    a task's rows is looked up in the stacks of the tasks before, which go through the driver:
    of at most ``most`` entries each, the largest depth.
    """

    def run(batches):
        places: list[int] = []
        values: list[int] = []
        task = 0
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            columns = [batch.column(c) for c in ("task", "idx", "lcp", "pos", "depths")]
            for task, idx, lcp, pos, wanted in zip(*(c.to_pylist() for c in columns), strict=True):
                lcp = lcp if most is None else min(lcp, most)
                del places[(cut := bisect_left(values, lcp)) :], values[cut:]
                places.append(idx)
                values.append(lcp)
                for d in wanted or ():
                    k = bisect_left(values, d) - 1
                    for column, x in zip(out, (places[k] if k >= 0 else None, d, pos), strict=True):
                        column.append(x)
            yield rows_of([task] * len(out[0]), *out)
        yield rows_of([task] * len(places), places, values, [-1] * len(places))

    def rows_of(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["task", "left", "depth", "pos"])

    rows = lcps.join(depths, "pos", "left").select("idx", "lcp", "pos", "depths")
    rows = rows.repartitionByRange("idx").sortWithinPartitions("idx").withColumn("task", F.spark_partition_id().cast("bigint"))
    found = materialise(rows.mapInArrow(run, "task bigint, left bigint, depth bigint, pos bigint"), "intervals")
    stacks: dict[int, list] = {}
    for r in found.where("pos < 0").orderBy("task", "left").collect():
        stacks.setdefault(r.task, []).append((r.left, r.depth))
    plan, held = [], []
    for task, own in sorted(stacks.items()):
        plan.append((task, held))
        held = [h for h in held if h[1] < own[0][1]] + own
    known = lcps.sparkSession.createDataFrame(plan, "task bigint, held array<struct<place: bigint, value: bigint>>")
    before = F.element_at(F.filter("held", lambda h: h["value"] < F.col("depth")), -1)["place"]
    return found.where("pos >= 0").join(F.broadcast(known), "task").select(F.coalesce("left", before).alias("left"), "depth", "pos")


def later_copies(lcps: DataFrame, sequences_: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """start and stop (of pos, stop exclusive) of the lines to delete."""
    runs = materialise(intervals(lcps, _depths(sequences_, min_words), max(1, min_words)), "runs")
    first = runs.groupBy("left", "depth").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = runs.join(first, ["left", "depth"]).where("pos <> first")
    return later.select(F.greatest("pos", F.col("first") + F.col("depth")).alias("start"), (F.col("pos") + F.col("depth")).alias("stop")).where("start < stop")


def _suffixes(docs: DataFrame, min_words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    found = segments(materialise(line_table(docs), "lines"), min_words)
    kept = sequences(found, min_words)
    return found, kept, lcp_array(suffix_array(kept), kept)


def maximal_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """DOC, at (the first line's number), lines, words, run (a number for equal runs) and copies: every longest run of min_words
    words or more that stands at another place too and isn't the rest of a longer one. Of equal segments the first counts.
    """
    found, kept, lcps = _suffixes(docs, min_words)
    after = lcps.select((F.col("idx") - 1).alias("idx"), F.col("lcp").alias("lcp2"))
    lcps = materialise(lcps.join(after, "idx", "left").withColumn("lcp2", F.coalesce("lcp2", F.lit(0))), "both-lcps")
    rows = lcps.select("pos", "start", F.greatest("lcp", "lcp2").alias("lines"))
    longer = F.coalesce(F.lag("lines").over(Window.partitionBy("start").orderBy("pos")) == F.col("lines") + 1, F.lit(False))
    texts = kept.select("start", "words")
    words = F.aggregate(F.slice("words", (F.col("pos") - F.col("start") + 1).cast("int"), F.col("lines").cast("int")), F.lit(0).cast("bigint"), lambda s, x: s + x)
    rows = rows.withColumn("longer", longer).where("lines > 0 AND NOT longer").join(texts, "start").select("pos", "lines", words.alias("words"))
    rows = materialise(rows.where(F.col("words") >= min_words), "maximal")
    wanted = rows.select("pos", F.array("lines").alias("depths"))
    left = intervals(lcps, wanted).select("pos", "left")
    # the order turned round: the interval's other end
    right = intervals(lcps.select((-F.col("idx")).alias("idx"), F.col("lcp2").alias("lcp"), "pos"), wanted).select("pos", (-F.col("left")).alias("right"))
    places = found.where("start = first").select(*DOC, F.explode("lines").alias("l")).select(*DOC, F.col("l.pos").alias("pos"), F.col("l.at").alias("at"))
    sized = rows.join(left, "pos").join(right, "pos").join(places, "pos")
    return sized.select(*DOC, "at", "lines", "words", F.col("left").alias("run"), (F.col("right") - F.col("left") + 1).alias("copies"))


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """DOC, the sorted numbers of the lines to delete (removed) and their words, of documents that have any."""
    found, kept, lcps = _suffixes(docs, min_words)
    spans = later_copies(lcps, kept, min_words).distinct()
    drop = spans.select(F.explode(F.sequence("start", F.col("stop") - 1)).alias("pos")).distinct()
    lines = lambda rows: rows.select(*DOC, F.explode("lines").alias("l")).select(*DOC, F.col("l.pos").alias("pos"), F.col("l.at").alias("at"), F.col("l.words").alias("words"))
    parts = lines(found.where("start = first")).join(drop, "pos").unionByName(lines(found.where("start <> first")))
    return parts.groupBy(*DOC).agg(F.sort_array(F.collect_list("at")).alias("removed"), F.sum("words").alias("removed_words"))


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies' lines deleted, and __removed and __removed_words, which tell how many."""
    found = removals(docs, min_words)
    found = found.select(F.col("doc_id").alias("__id"), F.col("row_key").alias("__key"), F.col("removed").alias("__lines"), F.col("removed_words").alias("__words"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("__doc"), "doc_id", "text", row_key().alias("__row"))
    both = rows.join(found, rows["doc_id"].eqNullSafe(found["__id"]) & (rows["__row"] == found["__key"]), "left")
    both = both.withColumn("__all", F.when(F.col("__lines").isNotNull(), F.split("text", "\n")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), "__lines")
    text = F.when(F.col("__lines").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__all", i)), "\n"))
    columns = [text.alias(c) if c == "text" else F.col("__doc").getField(c).alias(c) for c in docs.columns]
    return both.select(*columns, F.coalesce(F.size("__lines"), F.lit(0)).cast("bigint").alias("__removed"), F.coalesce("__words", F.lit(0)).cast("bigint").alias("__removed_words"))


def op2_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", F.col("__removed").alias("n_removed"), F.col("__removed_words").alias("removed_words"))


QUERIES = {"op2_lines": op2_lines}
ORACLES: dict[str, str] = {}
