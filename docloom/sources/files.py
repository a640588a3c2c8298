"""File sources: text with unknown encoding, pages by an injected extractor, case files, event frames."""

from __future__ import annotations

import codecs
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.text import as_bool, exploded, file_extension, text as text_, ws_trim

#: Tried in this order. Fixed values.
ENCODINGS = ("utf-8-sig", "utf-8", "gb18030", "gbk")
SUPPORTED = ("pdf", "txt")
EMPTY, FAILED = "[TXT读取错误：文件内容为空]", "[PDF解析错误: {}]"
TOO_MANY = "pages after the first {} were not read"

#: (bytes, name) -> (page number, text) of each page
ExtractFn = Callable[[bytes, str], Iterable[tuple[int, str]]]


def decode(content: bytes) -> str:
    for name in ENCODINGS:
        try:
            return content.decode(name).lstrip(codecs.BOM_UTF8.decode("utf-8"))
        except UnicodeDecodeError:
            continue
    return content.decode("utf-8", "ignore").lstrip("﻿")


def decoded(content: str) -> Column:
    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(lambda b: decode(bytes(b)), na_action="ignore")

    return run(content)


def binary_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path, name, ext, content, length, modificationTime."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.withColumn("name", F.regexp_extract("path", r"([^/]*)$", 1)).withColumn("ext", file_extension("name"))


def repaired_name(name: str | Column) -> Column:
    """A name whose UTF-8 bytes were read as Latin-1, as it was, if that gives Chinese characters."""
    name = F.col(name) if isinstance(name, str) else name
    latin = name.rlike(r"^[\x00-\xFF]*$") & name.rlike(r"[\x80-\xFF]")
    bytes_ = F.encode(F.when(latin, name), "ISO-8859-1")
    was = F.when(F.is_valid_utf8(bytes_.cast("string")), bytes_.cast("string"))
    return F.when(was.rlike("[\u4e00-\u9fff]"), was).otherwise(name)


def accepted(files: DataFrame, max_bytes: int = 20 * 1024 * 1024) -> DataFrame:
    """Files of a supported kind and size."""
    return files.where(F.col("ext").isin(*SUPPORTED) & (F.col("length") <= max_bytes))


def read_text(files: DataFrame) -> DataFrame:
    """doc_id (the path), page 0, text, source_ext and error (null if read) of text files; kinds not supported are errors."""
    text = decoded("content")
    rows = files.select(F.col("path").alias("doc_id"), F.lit(0).alias("page"), F.when(F.col("ext") == "txt", text).alias("text"), F.col("ext").alias("source_ext"))
    error = F.when(F.col("source_ext") != "txt", F.concat(F.lit("[不支持的文件类型："), "source_ext", F.lit("]"))).when(ws_trim("text") == "", EMPTY)
    return rows.withColumn("error", error)


def read_pages(files: DataFrame, extract: ExtractFn, max_pages: int = 120) -> DataFrame:
    """doc_id, page, text, source_ext, error by an extractor; a failing file is one row with an error.

    Of a file with more than max_pages pages the rest is not extracted; one more row, without a
    text, says so in its error.
    """

    def run(frames):
        for frame in frames:
            rows = []
            for path, name, ext, content in zip(frame.path, frame.name, frame.ext, frame.content, strict=True):
                try:
                    for number, (page, text) in enumerate(extract(bytes(content), name)):
                        if number >= max_pages:
                            rows.append((path, int(page), None, ext, TOO_MANY.format(max_pages)))
                            break
                        rows.append((path, int(page), text, ext, None))
                except Exception as e:  # one file's failure is a row
                    rows.append((path, 0, None, ext, FAILED.format(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "source_ext", "error"])

    return files.select("path", "name", "ext", "content").mapInPandas(run, "doc_id string, page int, text string, source_ext string, error string")


def read_files(files: DataFrame, extract: ExtractFn, max_pages: int = 120) -> DataFrame:
    """read_text and read_pages for files of either kind: pages by the extractor for all but text files."""
    whole = read_text(files.where((F.col("ext") == "txt") | ~F.col("ext").isin(*SUPPORTED)))
    return whole.unionByName(read_pages(files.where((F.col("ext") != "txt") & F.col("ext").isin(*SUPPORTED)), extract, max_pages))


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from a JSON array, or from an object with ``cases``; keys may be Chinese."""
    rows = spark.read.option("multiLine", "true").json(path)
    if "cases" in rows.columns:
        rows = rows.select(F.explode("cases").alias("c")).select("c.*")
    pick = lambda *names: F.coalesce(*(F.col(f"`{n}`") for n in names if n in rows.columns), F.lit(None))
    return rows.select(
        pick("question", "问题").cast("string").alias("question"), pick("doc_id", "文档ID").cast("string").alias("doc_id"),
        pick("gold_pages", "金标页码").cast("array<int>").alias("gold_pages"), pick("gold_contains", "金标原文").cast("array<string>").alias("gold_contains"),
        as_bool(pick("启用重排", "use_rerank").cast("string")).alias("use_rerank"), as_bool(pick("对比重排", "compare_rerank").cast("string")).alias("compare_rerank"),
    )


def event_frames(lines: DataFrame, column: str = "value") -> DataFrame:
    """Payloads of ``data:`` lines of an event stream; comments and other fields are left out."""
    body = ws_trim(F.regexp_extract(column, r"^data:(.*)$", 1))
    return lines.where(F.col(column).startswith("data:") & (body != "")).select(body.alias("payload"))


def event_blocks(blocks: DataFrame, key: str, column: str = "value", schema: str = "map<string,string>") -> DataFrame:
    """key, at, payload and data (the payload as JSON; null if it isn't) of received blocks of an event stream.

    A block's last line counts only if its end has come.
    """
    whole = F.regexp_replace(text_(column), r"[^\n]*$", "")
    rows = exploded(blocks, F.split(whole, r"\r?\n"), "at", "value", key)
    payload = ws_trim(F.regexp_extract("value", r"^data:(.*)$", 1))
    return rows.where(F.col("value").startswith("data:") & (payload != "")).select(key, "at", payload.alias("payload"), F.from_json(payload, schema).alias("data"))
