"""Retrieval evaluation: recall and precision by pages and by wording, at the pool and the final cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.config import Config
from docloom.functions.text import as_bool, ratio, text, ws_trim

from . import retrieval

METRICS = ("page_recall", "page_precision", "text_recall", "text_precision")


def metrics(cases: DataFrame, hits: DataFrame) -> DataFrame:
    """cases (query_id, gold_pages, gold_contains), hits (query_id, rank, page, text): one row a case.

    A wanted phrase, its ends trimmed, is looked for as it stands in all hits of the case, joined
    by line ends in the order of rank; recall is over all phrases given, also repeated ones.
    Precision by pages is distinct pages hit over chunks returned; by wording, chunks with
    any wanted phrase over chunks returned. A metric without a gold list is null.
    """
    gold = F.filter(F.transform(F.coalesce("gold_contains", F.array().cast("array<string>")), ws_trim), lambda g: g != "")
    cases = cases.select("query_id", F.array_distinct("gold_pages").alias("gold_pages"), gold.alias("needles"))
    own = hits.select("query_id", "rank", F.coalesce("page", F.lit(0)).alias("page"), text("text").alias("text")).join(cases.select("query_id", "needles"), "query_id")
    useful = F.exists("needles", lambda n: F.contains("text", n))
    per = own.groupBy("query_id").agg(
        F.count("*").alias("returned"), F.collect_set("page").alias("pages"), F.count_if(useful).alias("useful"), F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("l")
    )
    per = per.select("query_id", "returned", "pages", "useful", F.array_join(F.transform("l", lambda x: x["text"]), "\n").alias("blob"))
    both = cases.join(per, "query_id", "left")
    returned = F.coalesce("returned", F.lit(0))
    hit = F.coalesce(F.size(F.array_intersect("gold_pages", "pages")), F.lit(0))
    found = F.coalesce(F.size(F.array_distinct(F.filter("needles", lambda n: F.contains("blob", n)))), F.lit(0))
    asked_pages, asked_text = F.size("gold_pages") > 0, F.size("needles") > 0
    return both.select(
        "query_id", returned.alias("returned"),
        F.when(asked_pages, ratio(hit, F.size("gold_pages"))).alias("page_recall"), F.when(asked_pages, ratio(hit, returned)).alias("page_precision"),
        F.when(asked_text, ratio(F.when(F.col("blob").isNull(), 0).otherwise(found), F.size("needles"))).alias("text_recall"),
        F.when(asked_text, ratio(F.coalesce("useful", F.lit(0)), returned)).alias("text_precision"),
    )


#: What is wrong with a case. Fixed values.
INCOMPLETE, NO_VECTORS, NO_GOLD = "缺少 question/问题 或 doc_id/文档ID", "文档无向量 doc_id=", "需要 gold_pages/金标页码 或 gold_contains/金标原文"


def with_errors(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """cases (question, doc_id, and gold_pages and gold_contains where given) with error: incomplete, of a document without chunks,
    or nothing wanted of it; null for a case to be run."""
    have = chunks.select("doc_id").distinct().withColumn("__has", F.lit(True))
    said = F.when((ws_trim("question") == "") | (ws_trim(F.col("doc_id").cast("string")) == ""), INCOMPLETE)
    said = said.when(F.col("__has").isNull(), F.concat(F.lit(NO_VECTORS), F.col("doc_id").cast("string")))
    if {"gold_pages", "gold_contains"} <= set(cases.columns):
        phrases = F.filter(F.coalesce("gold_contains", F.array().cast("array<string>")), lambda g: ws_trim(g) != "")
        said = said.when((F.coalesce(F.size("gold_pages"), F.lit(0)) <= 0) & (F.size(phrases) == 0), NO_GOLD)
    return cases.join(have, "doc_id", "left").withColumn("error", said).drop("__has")


def with_settings(cases: DataFrame, rerank: bool = True, compare: bool = False) -> DataFrame:
    """cases with use_rerank and compare_rerank as booleans: a case's own word for yes or no, else the default."""
    given = lambda c: F.col(c).cast("string") if c in cases.columns else F.lit(None).cast("string")
    return cases.withColumns({"use_rerank": as_bool(given("use_rerank"), rerank), "compare_rerank": as_bool(given("compare_rerank"), compare)})


def run_cases(cases: DataFrame, chunks: DataFrame, config: Config = Config(), reranker=None, **options) -> DataFrame:
    """cases (query_id, doc_id, question, q_embedding, gold lists, settings) with error or their metrics at the pool and the final cut.

    A case is searched with the re-ranker as it asks; one that asks for the comparison is
    searched both ways, and verdict says what the re-ranker does to it (null without pages).
    """
    every = with_settings(with_errors(cases, chunks))
    to_run = every.where(F.col("error").isNull())

    def measured(rows: DataFrame, model) -> tuple[DataFrame, DataFrame]:
        asked = rows.select("query_id", "doc_id", "question", "q_embedding")
        return tuple(metrics(rows, h) for h in pool_and_final(asked, chunks, config, reranker=model, **options))

    sides = [measured(to_run.where(F.col("use_rerank")), reranker), measured(to_run.where(~F.col("use_rerank")), None)]
    pool, final = (a.unionByName(b) for a, b in zip(*sides, strict=True))
    pool = pool.select("query_id", F.col("page_recall").alias("pool_page_recall"), F.col("text_recall").alias("pool_text_recall"))
    compared = to_run.where(F.col("compare_rerank"))
    said = compare(measured(compared, None)[1], measured(compared, reranker)[1])
    out = every.select("query_id", "doc_id", "error").join(final, "query_id", "left").join(pool, "query_id", "left")
    return out.join(said, "query_id", "left").withColumn("verdict", F.when(F.col("page_recall").isNotNull(), F.col("verdict")))


def pool_and_final(questions: DataFrame, chunks: DataFrame, config: Config = Config(), **options) -> tuple[DataFrame, DataFrame]:
    """A search's hits before and after the cut to the top k; what ``retrieval.search`` takes."""
    return tuple(retrieval.search(questions, chunks, config, cut=cut, **options) for cut in ("fetch_k", "final_k"))


def verdict(recall_off: Column, recall_on: Column, precision_off: Column, precision_on: Column) -> Column:
    """improve, worse or tie: recall first, then precision."""
    better = (recall_on > recall_off) | ((recall_on == recall_off) & (precision_on > precision_off))
    worse = (recall_on < recall_off) | ((recall_on == recall_off) & (precision_on < precision_off))
    return F.when(better, "improve").when(worse, "worse").otherwise("tie")


def compare(off: DataFrame, on: DataFrame, kind: str = "page") -> DataFrame:
    r, p = f"{kind}_recall", f"{kind}_precision"
    both = off.select("query_id", F.col(r).alias("r0"), F.col(p).alias("p0")).join(on.select("query_id", F.col(r).alias("r1"), F.col(p).alias("p1")), "query_id")
    return both.select("query_id", verdict(*(F.col(c) for c in ("r0", "r1", "p0", "p1"))).alias("verdict"))


def summary(results: DataFrame) -> DataFrame:
    """Means over the cases that have the metric."""
    return results.agg(*(F.avg(m).alias(m) for m in METRICS), F.count("*").alias("cases"))
