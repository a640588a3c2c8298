"""Repeated lines and sentences in answers, as arrays of a row."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType
from pyspark.sql.window import Window

from docloom.functions.text import exploded, let, rtrim, text, ws_trim

#: Page citations, invisible characters and list marks that a line's key leaves out. Fixed values.
CITATION = r"[（(]第\s*\d+(?:\s*[、,，\-–—]\s*\d+)*\s*页[）)]"
INVISIBLE = "[\u200b\u200c\u200d\ufeff\u00a0]"
LIST_MARK = r"^[\-\*\d\.、•]+"
SENTENCE_END = r"(?<=[。！？；])"


ASCII_ONLY = r"^[\x00-\x7F]*$"


@F.pandas_udf(StringType())
def _nfkc(batch: pd.Series) -> pd.Series:
    return batch.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


@F.pandas_udf(ArrayType(StringType()))
def _nfkc_each(batch: pd.Series) -> pd.Series:
    return batch.map(lambda xs: [unicodedata.normalize("NFKC", x) for x in xs], na_action="ignore")


def nfkc(c: str | Column) -> Column:
    """Compatibility form; a text in ASCII is its own, and nothing of it goes to Python."""
    s = text(c)
    return F.coalesce(_nfkc(F.when(~s.rlike(ASCII_ONLY), s)), s)


def _bare(s: Column) -> Column:
    for pattern in (INVISIBLE, CITATION, r"(?U)\s+", LIST_MARK):
        s = F.regexp_replace(s, pattern, "")
    return s


def line_key(c: str | Column) -> Column:
    """What two lines that say the same have in common, full-width and half-width forms included."""
    return _bare(nfkc(c))


def exploded_lines(df: DataFrame, key: str, column: str = "text") -> DataFrame:
    return exploded(df, F.split(text(column), "\n"), "at", "line", key)


def _after(rows: Column, same) -> Column:
    """The rows of an array whose predecessor isn't the same, or that have none."""
    return let(rows, lambda a: F.filter(a, lambda x, i: (i == 0) | ~F.coalesce(same(F.get(a, i - 1), x), F.lit(False))))


def _without_echoes(parts: Column, normal: Column) -> Column:
    """array<struct<at, p, n>>: parts with their normal forms, without those whose key equals that of the last one before with a key."""
    every = F.zip_with(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p.alias("p"))), normal, lambda s, n: F.struct(s["at"].alias("at"), s["p"].alias("p"), n.alias("n"), _bare(n).alias("k")))

    def kept(a: Column) -> Column:
        said = _after(F.filter(a, lambda x: x["k"] != ""), lambda x, y: x["k"] == y["k"])
        return F.array_sort(F.concat(F.filter(a, lambda x: x["k"] == ""), said))

    return let(every, kept)


def _joined(rows: Column, field: str, by: str = "") -> Column:
    return F.array_join(F.transform(rows, lambda x: x[field]), by)


def collapse_sentences(c: str | Column) -> Column:
    """Without a sentence whose key equals that of the last one with a key."""
    parts = F.split(text(c), SENTENCE_END)
    normal = F.coalesce(_nfkc_each(F.when(~text(c).rlike(ASCII_ONLY), parts)), parts)
    return _joined(_without_echoes(parts, normal), "p")


def collapse_lines(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and text: repeated sentences, then repeated lines go; one blank line in a row, none at the ends.

    Line ends of any kind become \\n. The first line of a key stays. Lines without a key count
    as blank, and a line that goes for being a repeat ends a run of blank ones. A blank text
    stays as it is. A text in ASCII has no sentence ends and is its own normal form: sorting in
    the row's array finds its first lines. Others go to Python. Nothing is shuffled.
    """
    rows = df.select(key, text(column).alias("__raw"), F.regexp_replace(text(column), "\r\n?", "\n").alias("t")).withColumn("plain", F.col("t").rlike(ASCII_ONLY))
    lines = F.transform(F.split(F.when(F.col("plain"), F.col("t")), "\n"), lambda x, i: F.struct(i.alias("at"), rtrim(x).alias("line"), _bare(x).alias("k")))

    def kept(a: Column) -> Column:
        blank = F.filter(_after(a, lambda x, y: (x["k"] == "") & (y["k"] == "")), lambda x: x["k"] == "")
        first = _after(F.array_sort(F.transform(F.filter(a, lambda x: x["k"] != ""), lambda x: F.struct(x["k"].alias("k"), x["at"].alias("at"), x["line"].alias("line")))), lambda x, y: x["k"] == y["k"])
        placed = lambda rows, line: F.transform(rows, lambda x: F.struct(x["at"].alias("at"), line(x).alias("line")))
        return F.array_sort(F.concat(placed(blank, lambda x: F.lit("")), placed(first, lambda x: x["line"])))

    ascii_ = F.regexp_replace(_joined(let(lines, kept), "line", "\n"), "^\n+|\n+\\z", "")
    rows = rows.withColumn("other", _collapsed(F.when(~F.col("plain"), F.col("t"))))
    return rows.select(key, F.when(ws_trim("__raw") == "", F.col("__raw")).when(F.col("plain"), ascii_).otherwise(F.col("other")).alias("text"))


@F.pandas_udf(StringType())
def _collapsed(batch: pd.Series) -> pd.Series:
    bare = [re.compile(p) for p in (INVISIBLE, CITATION, r"\s+", LIST_MARK)]
    ends = re.compile(SENTENCE_END)

    def key(s: str) -> str:
        s = unicodedata.normalize("NFKC", s)
        for p in bare:
            s = p.sub("", s)
        return s

    def sentences(s: str) -> str:
        said, out = "", []
        for part in ends.split(s):
            k = key(part)
            if not k or k != said:
                out.append(part)
            said = k or said
        return "".join(out)

    def one(s: str) -> str:
        seen: set[str] = set()
        out, blank = [], False
        for line in sentences(s).split("\n"):
            line = sentences(line).rstrip()
            k = key(line)
            if not k and not blank:
                out.append("")
            elif k and k not in seen:
                out.append(line)
            blank = not k
            seen.add(k)
        return "\n".join(out).strip("\n")

    return batch.map(one, na_action="ignore")


def repetition(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_lines (with a key), n_distinct, ratio of repeats and repetitive (4 lines, a quarter repeated)."""
    rows = exploded_lines(df, key, column).select(key, line_key("line").alias("k")).where("k <> ''")
    # counts of a document's keys first: no list of a document's lines meets in one place
    per = rows.groupBy(key, "k").agg(F.count("*").alias("n")).groupBy(key).agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_distinct"))
    share = (F.col("n_lines") - F.col("n_distinct")) / F.col("n_lines").cast("double")
    return per.select(key, "n_lines", "n_distinct", share.alias("ratio"), ((F.col("n_lines") >= 4) & (share >= 0.25)).alias("repetitive"))


def blank_runs(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, n_lines kept when a run of blank lines counts as one."""
    rows = exploded_lines(df, key, column).withColumn("blank", ws_trim("line") == "")
    rows = rows.withColumn("before", F.lag("blank", 1, False).over(Window.partitionBy(key).orderBy("at")))
    return rows.groupBy(key).agg(F.count_if(~(F.col("blank") & F.col("before"))).alias("n_kept"), F.count("*").alias("n_lines"))
