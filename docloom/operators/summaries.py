"""Map-reduce summaries with an injected model; sections are cut natively."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import exploded, ws_trim

from .chunking import merge_pieces

LlmFn = Callable[[str], str]


def newline_split(s: Column, size: int) -> Column:
    """Pieces of at most size, cut after the last blank line, or line end, in the last two thirds, where more follows than fits."""
    least = size // 3
    pattern = f"(?s)(?=.{{{size + 1}}})(?:.{{{least},{size - 2}}}\n(?=\n)|.{{{least},{size - 1}}}\n)|.{{1,{size}}}"
    return F.filter(F.transform(F.regexp_extract_all(s, F.lit(pattern), 0), ws_trim), lambda p: p != "")


def sampled(buckets: Column, most: int) -> Column:
    """Of more than most buckets, evenly spread ones with the first and the last."""
    n = F.size(buckets)
    if most <= 1:
        return F.slice(buckets, 1, 1)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (n - 1) / float(most - 1)).cast("int")))
    return F.when(n <= most, buckets).otherwise(F.filter(F.transform(buckets, lambda b, i: F.when(F.array_contains(at, i), b)), lambda b: b.isNotNull()))


def with_sections(df: DataFrame, text: str = "text", into: str = "sections", size: int = 2500, most: int = 8) -> DataFrame:
    """Adds array<string> into: a text's pages, or pieces, joined to the size; at most most of them."""
    df = df.withColumn("__raw", ws_trim(text))
    pages = F.filter(F.transform(F.split("__raw", r"(?=【第\d+页】)"), ws_trim), lambda p: p != "")
    df = df.withColumn("__parts", pages)
    df = df.withColumn("__parts", F.when(F.size("__parts") <= 1, newline_split(F.col("__raw"), size)).otherwise(F.col("__parts")))
    # a line end goes with each piece while joining, and comes off again
    lined = merge_pieces(F.transform("__parts", lambda p: F.concat(p, F.lit("\n"))), size + 1)
    df = df.withColumn("__bins", F.transform(lined, ws_trim))
    short = F.length("__raw") <= size
    out = F.when(F.col("__raw") == "", F.array().cast("array<string>")).when(short, F.array("__raw")).otherwise(sampled(F.col("__bins"), most))
    return df.withColumn(into, out).drop("__raw", "__parts", "__bins")


def summarise(docs: DataFrame, llm: LlmFn, section_prompt: Column, merge_prompt: Callable[[Column], Column], key: str = "doc_id", size: int = 2500, most: int = 8, single_prompt: Column | None = None) -> DataFrame:
    """key, n_sections, summary. section_prompt is over ``section``, its number ``no`` (from 1) and their number ``total``;
    one section is asked once, by single_prompt over ``section``; answers of more are merged.

    merge_prompt is given the answers, numbered, a line each. Blank answers are dropped; one answer left is the summary; a
    blank merge gives them as they are, a line each.
    """
    single = section_prompt if single_prompt is None else single_prompt

    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        return prompts.map(lambda p: (llm(p) or "").strip() if p else "")

    cut = with_sections(docs.repartition(key), size=size, most=most).withColumn("total", F.size("sections"))
    rows = exploded(cut, "sections", "no", "section", key, "total").withColumn("no", F.col("no") + 1)
    partial = rows.withColumn("answer", ask(F.when(F.col("total") == 1, single).otherwise(section_prompt)))
    out = partial.groupBy(key).agg(F.count("*").alias("n_sections"), F.sort_array(F.collect_list(F.when(F.col("answer") != "", F.struct("no", "answer")))).alias("l"))
    answers = F.col("l.answer")
    numbered = F.array_join(F.transform(answers, lambda a, i: F.concat((i + 1).cast("string"), F.lit(". "), a)), "\n")
    out = out.select(key, "n_sections", F.size("l").alias("k"), F.array_join(answers, "\n").alias("parts"), numbered.alias("numbered"))
    merged = out.withColumn("merged", ask(F.when(F.col("k") > 1, merge_prompt(F.col("numbered"))).otherwise("")))
    return merged.select(key, "n_sections", F.when((F.col("k") > 1) & (F.col("merged") != ""), F.col("merged")).otherwise(F.col("parts")).alias("summary"))


def bucket_sample(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The same even sample over rows, by windows."""
    by = Window.partitionBy(key)
    rows = rows.withColumn("__i", F.row_number().over(by.orderBy(order)) - 1).withColumn("__n", F.count("*").over(by))
    at = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.bround(i * (F.col("__n") - 1) / float(max(1, most - 1))).cast("int"))
    return rows.where((F.col("__n") <= most) | F.array_contains(at, F.col("__i").cast("int"))).drop("__i", "__n")
