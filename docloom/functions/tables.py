"""Tables in text: Markdown from cells and from HTML, OCR lines that repeat cells."""

from __future__ import annotations

import html as html_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from .text import let, squeeze, text, ws_trim

#: Heads of numbered table blocks. Fixed values.
TABLE_HEAD, IMAGE_TABLE_HEAD = "【表格 ", "【图像表格 "


@F.pandas_udf(ArrayType(ArrayType(StringType())))
def _unescaped(batch: pd.Series) -> pd.Series:
    """Every HTML entity by its character; there are over two thousand."""
    return batch.map(lambda rows: [[html_.unescape(c) for c in row] for row in rows], na_action="ignore")


def table_markdown(rows: str | Column) -> Column:
    """array<array<string>> as a Markdown table; rows without any text are left out."""
    rows = F.col(rows) if isinstance(rows, str) else rows
    cells = F.transform(F.coalesce(rows, F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: ws_trim(F.regexp_replace(text(c), r"\r\n|[\r\n]", " "))))
    full = F.filter(cells, lambda r: F.exists(r, lambda c: c != ""))
    bar = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))

    def drawn(rows: Column) -> Column:
        width = F.array_max(F.transform(rows, F.size))
        bars = F.transform(rows, lambda r: bar(F.concat(r, F.array_repeat(F.lit(""), width - F.size(r)))))
        rule = bar(F.array_repeat(F.lit("---"), width))
        body = F.slice(bars, F.lit(2), F.greatest(F.size(bars) - 1, F.lit(0)))
        return F.when(F.size(rows) == 0, "").otherwise(F.array_join(F.concat(F.array(bars[0], rule), body), "\n"))

    return let(full, drawn)


def html_table_rows(html: str | Column) -> Column:
    """Cells of every tr in the text: entities resolved, then tags dropped."""
    found = F.regexp_extract_all(text(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), 1)
    raw = F.filter(F.transform(found, lambda r: F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), 1)), lambda r: F.size(r) > 0)
    plain = F.coalesce(_unescaped(F.when(text(html).contains("&"), raw)), raw)  # without an entity nothing goes to Python
    return F.transform(plain, lambda r: F.transform(r, lambda c: ws_trim(F.regexp_replace(c, r"<[^>]+>", ""))))


def html_table_markdown(html: str | Column) -> Column:
    return F.when(F.lower(text(html)).contains("<table"), table_markdown(html_table_rows(html))).otherwise("")


def headed_tables(tables: str | Column, head: str = TABLE_HEAD) -> Column:
    """array<array<array<string>>>, an extractor's tables, as Markdown blocks under their numbers; empty ones are left out, but count."""
    tables = F.col(tables) if isinstance(tables, str) else tables
    return _headed(F.transform(F.coalesce(tables, F.array().cast("array<array<array<string>>>")), table_markdown), head)


def headed_markdown(tables: str | Column, head: str = IMAGE_TABLE_HEAD) -> Column:
    """Tables in Markdown (array), as those that a recogniser gave in HTML, under their numbers."""
    return _headed(F.col(tables) if isinstance(tables, str) else tables, head)


def _headed(blocks: Column, head: str) -> Column:
    numbered = F.transform(blocks, lambda m, i: F.when(text(m) != "", F.concat(F.lit(head), (i + 1).cast("string"), F.lit("】\n"), m)))
    return F.array_join(F.array_compact(numbered), "\n\n")


def without_table_lines(ocr: str | Column, tables: str | Column) -> Column:
    """OCR lines but for those that only repeat a table's cell, with or without its blanks."""
    rows = F.filter(F.transform(F.split(text(tables), "\n"), ws_trim), lambda x: x.startswith("|") & ~x.rlike(r"^\|[\s:\-|]+$"))
    cells = F.filter(F.flatten(F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), ws_trim))), lambda c: c != "")
    known = F.array_union(cells, F.transform(cells, squeeze))
    kept = F.filter(F.transform(F.split(text(ocr), "\n"), ws_trim), lambda x: (x != "") & ~F.array_contains(known, x) & ~F.array_contains(known, squeeze(x)))
    return F.array_join(kept, "\n")


def merged_page(digital: str | Column, tables: str | Column, ocr: str | Column, prefer_ocr: Column) -> Column:
    """struct<text, mode>: digital or OCR text, tables under it; OCR as the last resort."""
    d, t, o = ws_trim(digital), ws_trim(tables), ws_trim(ocr)
    own_ocr = prefer_ocr & (o != "")
    body = F.when(own_ocr, o).otherwise(d)
    parts = F.filter(F.array(body, t), lambda x: x != "")
    last = (F.size(parts) == 0) & (o != "")
    mode = (
        F.when(last, "ocr")
        .when((body != "") & (t != ""), "mixed")
        .when(own_ocr, "ocr")
        .when(body != "", "text")
        .when(t != "", "table")
        .otherwise("empty")
    )
    return F.struct(F.when(last, o).otherwise(F.array_join(parts, "\n\n")).alias("text"), mode.alias("mode"))
