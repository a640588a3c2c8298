"""Search of questions over the chunks of their documents, as joins and windows.

A batch of questions is a DataFrame; chunks meet their question by an equi-join on doc_id,
ranks come from windows per question, so that no step pairs all with all.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType
from pyspark.sql.window import Window

from docloom.config import Config
from docloom.functions import params
from docloom.functions.scores import MARKS, dot, lexical_boost, squared_l2
from docloom.functions.sequences import Sequence, ratio
from docloom.functions.text import ws_trim

TIES = ("distance", "chunk_index")

#: (question, text) pairs -> how well the text answers the question, as logits
PairModel = Callable[[list[tuple[str, str]]], list[float]]


def _keys(by: str | tuple[str, ...]) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def _rank(by: str | tuple[str, ...], *order) -> Column:
    return F.row_number().over(Window.partitionBy(*_keys(by)).orderBy(*order))


def with_chunk_count(questions: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds doc_chunks, the number of rows with the question's key; 0 without any."""
    counts = chunks.groupBy(key).agg(F.count("*").cast("int").alias("doc_chunks"))
    return questions.join(counts, key, "left").withColumn("doc_chunks", F.coalesce("doc_chunks", F.lit(0)))


def with_search_params(questions: DataFrame, config: Config = Config(), rerank: bool = False) -> DataFrame:
    """Adds final_k, fetch_k and threshold from doc_chunks."""
    q = questions.withColumn("final_k", params.top_k(F.col("doc_chunks"), config=config))
    q = q.withColumn("fetch_k", params.recall_k(F.col("doc_chunks"), F.col("final_k"), config=config))
    return q.withColumn("threshold", params.score_threshold(F.col("doc_chunks"), F.lit(config.min_score), F.lit(rerank)))


def distance(a: Column, b: Column, space: str) -> Column:
    if space == "cosine":
        return 1.0 - dot(a, b)
    return -dot(a, b) if space == "ip" else squared_l2(a, b)


def knn(questions: DataFrame, chunks: DataFrame, space: str = "l2", limit: str | int = "fetch_k") -> DataFrame:
    """questions (query_id, doc_id, q_embedding, ...) with their nearest chunks: adds the chunk's columns and distance."""
    hits = questions.join(chunks, "doc_id").withColumn("distance", distance(F.col("q_embedding"), F.col("embedding"), space))
    ranked = hits.withColumn("__rank", _rank("query_id", "distance", "chunk_index"))
    most = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    return ranked.where(F.col("__rank") <= most).drop("__rank", "embedding", "q_embedding")


def fuse(hits: DataFrame, space: str = "l2", boost: Column | None = None) -> DataFrame:
    """Adds dense_score, lexical_boost and score, their sum up to 1."""
    hits = hits.withColumn("dense_score", params.score_from_distance(F.col("distance"), space))
    hits = hits.withColumn("lexical_boost", F.coalesce(boost if boost is not None else lexical_boost("question", "text"), F.lit(0.0)))
    return hits.withColumn("score", F.least(F.lit(1.0), F.col("dense_score") + F.col("lexical_boost")))


def above_threshold(hits: DataFrame, score: str = "score", by: str | tuple[str, ...] = "query_id") -> DataFrame:
    """Hits at or over the question's threshold; if none is, all of them."""
    over = F.col(score) >= F.col("threshold")
    any_over = F.max(over).over(Window.partitionBy(*_keys(by)))
    return hits.withColumn("__any", any_over).where(over | ~F.col("__any")).drop("__any")


def sequence_boost(question: Column, text: Column) -> Column:
    """Half the matching ratio of two texts, up to 0.3; 0 under a ratio of 0.25, null for nulls.

    Upper bounds of the ratio, by lengths and by common characters, go before it.
    """

    @F.pandas_udf(DoubleType())
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        asked = Sequence("")

        def one(q: str, t: str) -> float:
            nonlocal asked
            if asked.text != q:  # a question's texts come one after the other
                asked = Sequence(q)
            r = ratio(asked, Sequence(t), 0.25)
            return 0.0 if r is None else min(0.3, r * 0.5)

        return pd.Series([None if q is None or t is None else one(q, t) for q, t in zip(questions, texts, strict=True)], dtype=float)

    return run(question, text)


#: White space to Python and not to ``squeeze``.
SEPARATORS = re.compile("[\x1c-\x1f]+")


def _squeezed(s: str | None) -> str:
    """As ``text.squeeze``."""
    s = s or ""
    parts = [s] if SEPARATORS.search(s) is None else re.split(f"({SEPARATORS.pattern})", s)
    return "".join(p if SEPARATORS.fullmatch(p) else "".join(p.split()) for p in parts)


def wording_boost(question: Column, text: Column) -> Column:
    """``lexical_boost``, and ``sequence_boost`` where that leaves it open, in one pass over plain question and text."""

    @F.pandas_udf(DoubleType())
    def wording(questions: pd.Series, texts: pd.Series) -> pd.Series:
        marks = re.compile(MARKS)
        held: list = [None]

        def one(question: str | None, text: str | None) -> float:
            if held[0] != (question or ""):  # a question's texts come one after the other
                q = _squeezed(question)
                bare = marks.sub("", q)
                held[:] = question or "", q, bare, [bare[i : i + 4] for i in range(len(bare) - 3)], Sequence(bare or q)
            _, q, bare, four, asked = held
            t = _squeezed(text)
            if not q or not t:
                return 0.0
            if q in t:
                return 0.55
            if four and bare in t:
                return 0.5
            if four and sum(g in t for g in four) / len(four) >= 0.4:
                return 0.35
            r = ratio(asked, Sequence(t), 0.25)
            return 0.0 if r is None else min(0.3, r * 0.5)

        return pd.Series([one(q, t) for q, t in zip(questions, texts, strict=True)], dtype=float)

    return wording(question, text)


def with_boost(hits: DataFrame, fuzzy: bool = True) -> DataFrame:
    """Adds lexical_boost; fuzzy: what the cheaper tests leave open is compared as sequences."""
    if fuzzy:
        return hits.withColumn("lexical_boost", wording_boost(F.col("question"), F.col("text")))
    return hits.withColumn("lexical_boost", F.coalesce(lexical_boost("question", "text"), F.lit(0.0)))


def lexical_only(questions: DataFrame, chunks: DataFrame, fuzzy: bool = False) -> DataFrame:
    """All chunks of each question's document, scored by wording alone."""
    rows = with_boost(questions.join(chunks, "doc_id"), fuzzy)
    rows = rows.drop(*({"embedding", "q_embedding"} & set(rows.columns)))
    return rows.withColumn("distance", F.lit(0.0)).withColumn("dense_score", F.lit(0.0)).withColumn("score", F.col("lexical_boost"))


def dedupe_hits(hits: DataFrame, threshold: float = 0.72, by: str | tuple[str, ...] = "query_id") -> DataFrame:
    """Greedy in rank order: a hit like a kept one is dropped, or takes its place if longer.

    hits needs ``rank``; a question's hits are at most its fetch_k, so its array is bounded.
    Many questions' arrays of texts go to Python in a batch, and places come back.
    """
    columns = hits.columns

    @F.pandas_udf("array<int>")
    def places(groups: pd.Series) -> pd.Series:
        return groups.map(lambda texts: _unlike(texts, threshold))

    row = F.struct(F.col("rank").alias("__by"), F.struct(*columns).alias("__row"))
    grouped = hits.groupBy(*_keys(by)).agg(F.collect_list(row).alias("__hits"))
    grouped = grouped.select(F.array_sort("__hits", lambda a, b: (a["__by"] - b["__by"]).cast("int")).alias("__hits"))
    kept = grouped.withColumn("__kept", places(F.transform("__hits", lambda h: h["__row"]["text"])))
    found = kept.select(F.posexplode(F.transform("__kept", lambda i: F.get("__hits", i)["__row"])).alias("__at", "__row"))
    return found.select(*(((F.col("__at") + 1).cast(hits.schema["rank"].dataType) if c == "rank" else F.col("__row").getField(c)).alias(c) for c in columns))


def _unlike(texts, threshold: float) -> list[int]:
    """Places of the texts that stay, in the order in which their own or the one whose place they took was met."""
    kept: list[Kept] = []
    at: list[int] = []
    for i, text in enumerate(texts):
        bare = "".join((text or "").split())
        if not bare:
            continue
        new = Kept(bare)
        like = next((j for j, k in enumerate(kept) if k.like(new, threshold)), None)
        if like is None:
            kept.append(new)
            at.append(i)
        elif len(bare) > len(kept[like].text):
            kept[like], at[like] = new, i
    return at


class Kept(Sequence):
    """A text that newcomers are compared with; what the comparison needs of either is computed once."""

    def like(self, new: str | Sequence, threshold: float) -> bool:
        """Whether one holds the other or the ratio reaches the threshold."""
        new = Sequence(new) if isinstance(new, str) else new
        return new.text in self.text or self.text in new.text or ratio(new, self, threshold) is not None


def pair_scores(make: Callable[[], PairModel], batch: int = 32):
    """A column function (question, text) -> a pair model's logit; null where the model fails.

    make is called once a task, when the first pair comes. Pairs go to the model sorted by
    length, in batches, so that a batch pads little. A batch that fails is asked again pair by
    pair, and only pairs that fail alone are null; without a model all are.
    """

    @F.pandas_udf(DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model: list = []

        def asked(pairs: list[tuple[str, str]]) -> list[float | None]:
            try:
                if not model:
                    model.append(make())
                return [float(x) for x in model[0](pairs)]
            except Exception:  # a model's failure is a null; callers fall back
                return [None] if len(pairs) == 1 or not model else [x for p in pairs for x in asked([p])]

        for questions, texts in batches:
            pairs = list(zip(questions.fillna(""), texts.fillna(""), strict=True))
            out: list[float | None] = [None] * len(pairs)
            order = sorted(range(len(pairs)), key=lambda i: len(pairs[i][0]) + len(pairs[i][1]))
            for a in range(0, len(order), batch):
                own = order[a : a + batch]
                for i, x in zip(own, asked([pairs[i] for i in own]) if own else [], strict=False):
                    out[i] = x
            yield pd.Series(out, dtype=float)

    return score


def rerank(hits: DataFrame, logit: Column, final_k: Column | int, pool: int = 8, min_score: float = 0.0, by: str | tuple[str, ...] = "query_id") -> DataFrame:
    """The pool's hits by a second model's score; the fused score becomes dense_score.

    If none of a question's hits reaches min_score all stay. A question for which the model
    failed on any hit (logit null) keeps its fused scores and their order. hits needs rank; the
    model runs on the pool alone.
    """
    k = F.lit(final_k) if isinstance(final_k, int) else final_k
    pooled = hits.where(F.col("rank") <= F.greatest(k, F.lit(pool))).withColumn("__logit", logit)
    second = params.sigmoid(F.col("__logit"))
    every = Window.partitionBy(*_keys(by))
    kept = pooled.withColumn("__second", second).withColumn("__over", F.col("__second") >= min_score)
    kept = kept.withColumn("__good", F.min(F.col("__logit").isNotNull()).over(every)).withColumn("__any", F.max("__over").over(every))
    kept = kept.where(~F.col("__good") | F.col("__over") | ~F.col("__any"))
    had = F.col("dense_score") if "dense_score" in hits.columns else F.lit(None).cast("double")
    kept = kept.withColumn("dense_score", F.when(F.col("__good"), F.col("score")).otherwise(had)).withColumn("score", F.when(F.col("__good"), F.col("__second")).otherwise(F.col("score")))
    ranked = kept.withColumn("rank", _rank(by, F.when(F.col("__good"), F.col("score")).desc_nulls_last(), "rank"))
    return ranked.where(F.col("rank") <= F.greatest(k, F.lit(1))).drop("__logit", "__second", "__over", "__any", "__good")


def search(questions: DataFrame, chunks: DataFrame, config: Config = Config(), space: str = "l2", fuzzy: bool = True, dedupe: bool = True, reranker=None, cut: str = "final_k", embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """The whole search: counts, parameters, neighbours, fusion, threshold, fallback, dedupe, rerank, top k.

    questions: query_id, doc_id, question, q_embedding (``embedding.question_embedding``). Blank
    questions find nothing. A blank chunk is fetched like any other, but never a hit. A question
    whose chunks have no vectors is answered by wording alone, from all of them. dedupe: hits
    alike count once, as ``dedupe_hits`` says.

    cut: final_k, or fetch_k for the pool before the last cut. embed: makes the vectors of chunks
    that have none, after they have met their question; for a question a document, since a second
    one's chunks would be embedded again. A vector then is in no shuffle.

    Questions meet chunks once. All that follows is of a question and so of a document: its
    windows find the join's partitioning, and nothing is read, embedded or shuffled twice.
    """
    by = Window.partitionBy("doc_id", "query_id")
    joined = questions.where(ws_trim("question") != "").join(chunks, "doc_id")
    joined = joined if embed is None else joined.withColumn("embedding", embed(F.col("text")))
    hits = joined.withColumn("distance", distance(F.col("q_embedding"), F.col("embedding"), space)).drop("embedding", "q_embedding")
    known = F.col("distance").isNotNull()
    hits = hits.withColumn("doc_chunks", F.count("*").over(by).cast("int")).withColumn("__known", F.max(known).over(by))
    hits = with_search_params(hits, config, reranker is not None)
    near = F.row_number().over(by.orderBy(F.col("distance").asc_nulls_last(), "chunk_index"))
    hits = hits.withColumn("__near", near).where(~F.col("__known") | (known & (F.col("__near") <= F.col("fetch_k"))))
    return finish(hits.where(ws_trim("text") != "").drop("__near"), config, space, fuzzy, dedupe, reranker, cut, ("doc_id", "query_id"), TIES)


def finish(hits: DataFrame, config: Config, space: str, fuzzy: bool, dedupe: bool, reranker, cut: str, keys: tuple[str, ...], ties: tuple[str, ...]) -> DataFrame:
    """What follows the neighbours of a search: fusion, threshold, fallback, dedupe, rerank, top k.

    hits: question, text, distance, final_k, fetch_k, threshold, and __known, whether the
    question's chunks have vectors; keys tell questions apart, ties order equal scores.
    """
    by = Window.partitionBy(*keys)
    hits = with_boost(hits, fuzzy).withColumn("distance", F.coalesce("distance", F.lit(0.0)))
    dense = F.when(F.col("__known"), params.score_from_distance(F.col("distance"), space)).otherwise(0.0)
    hits = hits.withColumn("dense_score", dense).withColumn("score", F.least(F.lit(1.0), F.col("dense_score") + F.col("lexical_boost")))
    over = F.col("score") >= F.col("threshold")
    hits = hits.withColumn("__any", F.max(over).over(by)).where(over | ~F.col("__any") | ~F.col("__known"))
    ranked = hits.withColumn("rank", F.row_number().over(by.orderBy(F.desc("score"), *ties))).where(F.col("rank") <= F.greatest("final_k", "fetch_k"))
    ranked = ranked.drop("__known", "__any")
    if dedupe:
        ranked = dedupe_hits(ranked, config.dedupe_similarity, keys)
    if reranker is not None:
        return rerank(ranked, reranker(F.col("question"), F.substring("text", 1, config.rerank_text_chars)), F.col(cut), config.rerank_pool, config.rerank_min_score, keys)
    return ranked.where(F.col("rank") <= F.col(cut))


def page_texts(pages: DataFrame) -> DataFrame:
    """doc_id, text: a document's pages (page, text) in order, each under its number, a blank line between."""
    block = F.concat(F.lit("【第"), F.col("page").cast("string"), F.lit("页】\n"), F.col("text"))
    rows = pages.where(ws_trim("text") != "").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page", block.alias("b")))).alias("l"))
    return rows.select("doc_id", F.array_join(F.transform("l", lambda x: x["b"]), "\n\n").alias("text"))


def document_text(chunks: DataFrame, max_chars: int | None = None) -> DataFrame:
    """doc_id, text: chunks in order, a page marker where the page changes; text files have none."""
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    page = F.when((F.lower("source_ext") == "txt") | (F.col("page") <= 0), None).otherwise(F.col("page"))
    before = F.last(page, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = F.when(page.isNotNull() & ~page.eqNullSafe(before), F.concat(F.lit("【第"), page.cast("string"), F.lit("页】\n"), F.col("text"))).otherwise(F.col("text"))
    rows = chunks.select("doc_id", "chunk_index", marked.alias("line"))
    out = rows.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return out if max_chars is None else out.withColumn("text", F.substring("text", 1, max_chars))


def prompt_context(hits: DataFrame, dedupe: float | None = None) -> DataFrame:
    """query_id, context (numbered blocks) and the sorted positive pages they come from; dedupe: hits as alike as that count once."""
    if dedupe is not None:
        hits = dedupe_hits(hits, dedupe)
    blocks = hits.where(ws_trim("text") != "").withColumn("no", _rank("query_id", "rank"))
    line = F.concat(F.lit("【片段"), F.col("no").cast("string"), F.lit("】\n"), ws_trim("text"))
    rows = blocks.groupBy("query_id").agg(
        F.sort_array(F.collect_list(F.struct("no", line.alias("b")))).alias("blocks"), F.sort_array(F.collect_set(F.when(F.col("page") > 0, F.col("page")))).alias("pages")
    )
    return rows.select("query_id", F.array_join(F.transform("blocks", lambda x: x["b"]), "\n\n").alias("context"), "pages")


def chunk_dump(chunks: DataFrame, preview: int = 120) -> DataFrame:
    """doc_id, chunk_index, id, page, kind, chars, preview and text of stored chunks, in order within a document."""
    head = F.regexp_replace(F.substring("text", 1, preview), r"\s+", " ")
    return chunks.select("doc_id", "chunk_index", "id", "page", "kind", F.length("text").alias("chars"), head.alias("preview"), "text").repartition("doc_id").sortWithinPartitions("doc_id", "chunk_index")


def observation(hits: DataFrame, max_chars: int = 2400) -> DataFrame:
    """query_id, observation: blocks up to the first that would pass the limit; the first always stands.

    Numbers count blank chunks too; each block costs two characters more for the blank line.
    """
    page, source = F.col("page"), F.coalesce("source", F.lit(""))
    head = F.concat(F.lit("【片段"), F.col("rank").cast("string"), F.lit("】"), F.when(source != "", F.concat(F.lit(" source="), source)).otherwise(""), F.when(page > 0, F.concat(F.lit(" page="), page.cast("string"))).otherwise(""))
    rows = hits.where(ws_trim("text") != "").withColumn("block", F.concat(head, F.lit("\n"), ws_trim("text")))
    order = Window.partitionBy("query_id").orderBy("rank")
    used = F.coalesce(F.sum(F.length("block") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("over", (used + F.length("block") > max_chars) & (used > 0))
    rows = rows.withColumn("stopped", F.max("over").over(order)).where(~F.col("stopped"))
    out = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "block"))).alias("b"))
    return out.select("query_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("observation"))


def merge_hits(hits: DataFrame, by: str = "query_id", order=("step", "rank")) -> DataFrame:
    """First hit of each text's first 80 characters; blank ones go."""
    key = ws_trim(F.substring("text", 1, 80))
    first = F.row_number().over(Window.partitionBy(by, "__key").orderBy(*order))
    return hits.withColumn("__key", key).where(F.col("__key") != "").withColumn("__no", first).where(F.col("__no") == 1).drop("__key", "__no")
