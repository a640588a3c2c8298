"""Registered queries over the given tables. Each has a twin in ``sql`` where SQL can express it.

Tables stand in for the operators' own: ``documents`` are pages, cut into chunks; items of
``benchmark`` are questions, each asked of the documents whose id falls to it; ``embeddings``
are vectors scoped by their label; ``conversations`` are turns.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import Config
from docloom.functions import params, tables
from docloom.functions import text as T
from docloom.functions.scores import bigram_score, dot, lexical_boost
from docloom.operators import agent, answers, catalog, chunking, cleanup, evaluation, global_search, layout, memory, retrieval, sql_functions, summaries
from docloom.operators.embedding import embedder, question_embedding
from docloom.sources import scratch
from docloom.sources.pages import PageSource
from docloom.streaming import jobs, progress

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def windows(docs: DataFrame, size: int = 300, overlap: int = 50) -> DataFrame:
    """doc_id, chunk_index, page, text: fixed windows of the documents; four chunks make a page."""
    rows = T.exploded(docs, chunking.hard_cut(T.text("text"), size, overlap), "chunk_index", "text", "doc_id")
    return rows.select("doc_id", "chunk_index", (F.floor(F.col("chunk_index") / 4) + 1).cast("int").alias("page"), "text")


def questions(spark: SparkSession, sf: str) -> DataFrame:
    """query_id, doc_id, question: each document is asked the benchmark item that its id falls to."""
    items = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"))
    n = items.agg(F.count("*")).scalar()
    docs = read(spark, sf, "documents").select("doc_id", F.pmod("doc_id", n).alias("item_id"))
    return docs.join(items, "item_id").select(F.col("doc_id").alias("query_id"), "doc_id", "question")


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"))


# --- classifiers and scalars ------------------------------------------------------------------


@query
def readable_documents(spark, sf):
    d = read(spark, sf, "documents")
    name = F.concat(F.lit("Report."), F.col("source"), F.when(F.col("lang") == "en", ".TXT").otherwise(".pdf"))
    return d.select("doc_id", T.is_read_error("text").alias("unreadable"), T.file_extension(name).alias("ext"), T.file_extension(name).isin("pdf", "txt").alias("supported"))


def _page_signals() -> tuple[Column, Column, Column]:
    """Characters, image share and image regions as a page might have them, from text and id."""
    chars = F.pmod(F.length(T.ws_trim("text")), F.lit(97))
    cover = F.pmod("doc_id", F.lit(101)) / 100.0
    regions = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.array().cast("array<double>")).otherwise(F.array(F.pmod("doc_id", F.lit(97)) / 96.0, F.pmod("doc_id", F.lit(13)) / 100.0))
    return chars, cover, regions


@query
def parse_strategy(spark, sf):
    chars, cover, regions = _page_signals()
    d = read(spark, sf, "documents").select("doc_id", chars.cast("int").alias("chars"), cover.alias("cover"), regions.alias("regions"))
    return d.select("doc_id", params.needs_ocr(F.col("chars"), F.col("cover")).alias("needs_ocr"), params.parse_strategy(F.col("chars"), F.col("cover"), F.col("regions")).alias("strategy"))


@query
def chunk_strategy(spark, sf):
    d = read(spark, sf, "documents")
    table = F.concat(F.lit("intro\n| a | b |\n"), T.text("text"))
    page = F.when(F.pmod("doc_id", F.lit(4)) == 1, table).otherwise(T.text("text"))
    ext = F.when(F.pmod("doc_id", F.lit(3)) == 0, ".TXT").otherwise("pdf")
    return d.select("doc_id", T.chunk_strategy(page, ext).alias("strategy"))


@query
def adaptive_params(spark, sf):
    counts = windows(read(spark, sf, "documents")).groupBy("doc_id").agg(F.count("*").cast("int").alias("n"))
    n = F.col("n")
    k = params.top_k(n)
    return counts.select(
        "doc_id", n.alias("chunks"), k.alias("top_k"), params.top_k(n, F.pmod("doc_id", F.lit(9)).cast("int")).alias("asked_k"),
        params.top_k(n, candidates=F.pmod("doc_id", F.lit(5)).cast("int")).alias("held_k"), params.recall_k(n, k).alias("recall_k"),
        params.recall_k(n, k, of_document=False).alias("free_recall_k"), params.score_threshold(n, F.lit(0.35), F.pmod("doc_id", F.lit(2)) == 0).alias("threshold"),
    )


@query
def clipped_text(spark, sf):
    d = read(spark, sf, "documents")
    return d.select("doc_id", T.clip("text", 80).alias("clipped"), T.trim_blocks("text", 400).alias("trimmed"), T.file_size("n_chars").alias("size"))


@query
def router(spark, sf):
    """Routing of turns as questions; a word in each fifth turn's place makes it about document or talk."""
    hint = F.element_at(F.array(*map(F.lit, ("", "订单金额是多少", "我们之前聊了什么", "之前的合同金额", "那个呢"))), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(5)) + 1).cast("int"))
    q = F.concat(hint, T.text("text"))
    c = read(spark, sf, "conversations")
    return c.select("conv_id", "turn", agent.route(q).alias("path"), T.needs_rewrite(q).alias("rewrite"), T.needs_rewrite(hint).alias("rewrite_hint"))


@query
def planner_decisions(spark, sf):
    c = read(spark, sf, "conversations")
    name = F.element_at(F.array(*map(F.lit, agent.ACTIONS)), (F.pmod(F.col("turn"), F.lit(4)) + 1).cast("int"))
    words = F.regexp_replace(T.text("text"), r"[^A-Za-z ]", "")
    answer = (
        F.when(F.col("role") == "user", F.concat(F.lit('ok {"thought":"t","action":"'), name, F.lit('","action_input":"'), words, F.lit('"} end')))
        .when(F.col("role") == "assistant", F.concat(F.lit("Thought: look\nAction: "), name, F.lit("\nAction Input: "), words))
        .otherwise(F.concat(F.lit("maybe "), name))
    )
    return c.select("conv_id", "turn", agent.decision(answer).alias("d")).select("conv_id", "turn", "d.thought", "d.action", "d.action_input")


# --- chunking ---------------------------------------------------------------------------------


@query
def hard_cut_chunks(spark, sf):
    return windows(read(spark, sf, "documents"))


@query
def chunk_counts(spark, sf):
    w = windows(read(spark, sf, "documents"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.max("page").alias("pages"), F.sum(F.length("text")).alias("chars"))


@query
def merged_pieces(spark, sf):
    d = read(spark, sf, "documents")
    merged = chunking.split_merged(T.text("text"), "\n", 300)
    return T.exploded(d, merged, "piece_no", "piece", "doc_id")


@query
def overlapped_chunks(spark, sf):
    d = read(spark, sf, "documents")
    return T.exploded(d, chunking.with_overlap(chunking.hard_cut(T.ws_trim("text"), 250), 50, 280), "chunk_index", "text", "doc_id")


@query
def document_chunks(spark, sf):
    """All documents through the cutting of pages, by strategy."""
    d = read(spark, sf, "documents")
    pages = d.select("doc_id", F.lit(1).alias("page"), "text", F.when(F.col("lang") == "en", "pdf").otherwise("txt").alias("source_ext"))
    return chunking.chunk_pages(pages)


@query
def summary_sections(spark, sf):
    d = summaries.with_sections(read(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"), size=1000, most=4)
    return T.exploded(d, "sections", "section_no", "section", "doc_id")


@query
def sampled_chunks(spark, sf):
    return summaries.bucket_sample(windows(read(spark, sf, "documents")), "doc_id", "chunk_index", 5).select("doc_id", "chunk_index")


# --- vectors ----------------------------------------------------------------------------------


def _vectors(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Vectors in documents of two hundred, by number; every tenth asks the others of its document.

    The number of documents grows with the table, a document's chunks don't, as in the search
    of a question over its document.
    """
    v = read(spark, sf, "embeddings").withColumn("doc_id", F.floor(F.col("vec_id") / 200))
    chunks = v.select("doc_id", F.col("vec_id").alias("chunk_index"), "embedding")
    asked = v.where(F.col("vec_id") % 10 == 0).select(F.col("vec_id").alias("query_id"), "doc_id", F.col("embedding").alias("q_embedding"))
    return asked, chunks


@query
def knn_topk(spark, sf):
    asked, chunks = _vectors(spark, sf)
    hits = retrieval.knn(asked, chunks, "l2", 8)
    return hits.select("query_id", "chunk_index", "distance")


@query
def distance_scores(spark, sf):
    asked, chunks = _vectors(spark, sf)
    pairs = asked.join(chunks, "doc_id")
    spaces = {s: retrieval.distance(F.col("q_embedding"), F.col("embedding"), s) for s in ("l2", "cosine", "ip")}
    return pairs.groupBy("query_id").agg(*(F.avg(params.score_from_distance(d, s)).alias(f"mean_{s}") for s, d in spaces.items()), F.max(dot(F.col("q_embedding"), F.col("embedding"))).alias("best"))


@query
def threshold_fallback(spark, sf):
    asked, chunks = _vectors(spark, sf)
    hits = retrieval.knn(asked, chunks, "cosine", 8).withColumn("score", params.score_from_distance(F.col("distance"), "cosine"))
    limit = F.when(F.col("query_id") % 20 == 0, 1.5).otherwise(0.5)
    return retrieval.above_threshold(hits.where(F.col("chunk_index") != F.col("query_id")).withColumn("threshold", limit)).select("query_id", "chunk_index")


@query
def rerank_topk(spark, sf):
    asked, chunks = _vectors(spark, sf)
    hits = retrieval.knn(asked, chunks, "cosine", 10).withColumn("score", params.score_from_distance(F.col("distance"), "cosine"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "chunk_index")))
    logit = (F.pmod(F.col("chunk_index") * 7 + F.col("query_id"), F.lit(11)) - 5).cast("double")
    return retrieval.rerank(hits, logit, 3, pool=8, min_score=0.5).select("query_id", "rank", "chunk_index", "score")


# --- in SQL text alone ------------------------------------------------------------------------


def _sql(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """A statement over the library's SQL functions and the given tables by name."""
    sql_functions.register(spark)
    return spark.sql(text, **tables)


@query
def sql_windows(spark, sf):
    text = """SELECT doc_id, w.at AS chunk_index, docloom_clip(w.piece, 60) AS clipped, docloom_strategy(w.piece, '.TXT') AS strategy, docloom_read_error(w.piece) AS unreadable
    FROM {documents}, LATERAL docloom_windows(text, 400, 80) w"""
    return _sql(spark, text, documents=read(spark, sf, "documents"))


@query
def sql_chunks(spark, sf):
    return _sql(spark, "SELECT doc_id, c.at AS chunk_index, c.piece AS text FROM {documents}, LATERAL docloom_chunks(text, 300, 50, 90) c", documents=read(spark, sf, "documents"))


@query
def sql_search(spark, sf):
    asked, chunks = _vectors(spark, sf)
    sql_functions.register(spark)
    asked.withColumnRenamed("q_embedding", "vector").createOrReplaceTempView("docloom_questions")
    chunks.createOrReplaceTempView("docloom_vectors")
    sql_functions.register_search(spark, "docloom_questions", "docloom_vectors", "docloom_nearest", "l2")
    return spark.sql("SELECT query_id, rank, doc_id, chunk_index, distance FROM docloom_nearest(6)")


# --- wording ----------------------------------------------------------------------------------


@query
def lexical_boosts(spark, sf):
    """The best of a document's chunks."""
    q = questions(spark, sf).join(windows(read(spark, sf, "documents")).select("doc_id", "text"), "doc_id")
    return q.groupBy("doc_id").agg(F.max(F.coalesce(lexical_boost("question", "text"), F.lit(0.0))).alias("boost"))


@query
def bigram_scores(spark, sf):
    """Each turn against the one before."""
    c = read(spark, sf, "conversations")
    pairs = c.withColumn("before", F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where(F.col("before").isNotNull())
    return pairs.select("conv_id", "turn", bigram_score("before", "text").alias("score"))


@query
def passage_hits(spark, sf):
    """Documents that hold a benchmark passage of seven words or more.

    Where a text holds the passage, its second to sixth words stand there between blanks. A
    text's runs of five words are hashed in its row, and only the different hashes are joined to
    the passages' own.
    """
    parts = F.split("text", " ")
    items = read(spark, sf, "benchmark").select("item_id", F.col("text").alias("needle"), parts.alias("p")).where(F.size("p") >= 7)
    items = items.select("item_id", "needle", F.xxhash64(F.slice("p", 2, 5)).alias("k"))
    docs = read(spark, sf, "documents").select("doc_id", "text")
    runs = T.let(F.split("text", " "), lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 4, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, F.lit(5))))))
    pairs = docs.select("doc_id", F.explode_outer(runs).alias("k")).join(items, "k").select("doc_id", "item_id", "needle").distinct()
    return pairs.join(docs, "doc_id").where(F.contains("text", F.col("needle"))).select("doc_id", "item_id").distinct()


# --- search -----------------------------------------------------------------------------------


def _search_tables(spark, sf) -> tuple[DataFrame, DataFrame]:
    embed = embedder()
    # dealt by document before the model runs; the join on doc_id finds that partitioning
    chunks = windows(read(spark, sf, "documents").select("doc_id", "text").repartition("doc_id")).withColumn("embedding", embed("text"))
    asked = questions(spark, sf).withColumn("q_embedding", question_embedding("question", embed))
    return asked, chunks


@query
def fused_search(spark, sf):
    """Every document is asked its question: neighbours, wording, threshold with fallback, top k.

    Without the comparison of sequences, which SQL has not; search_with_dedupe has it.
    """
    asked, chunks = _search_tables(spark, sf)
    return retrieval.search(asked, chunks, space="cosine", fuzzy=False, dedupe=False).select("query_id", "rank", "chunk_index", "page", F.round("score", 6).alias("score"))


@query
def search_with_dedupe(spark, sf):
    """As fused_search, with the comparison of sequences; a chunk is embedded when it has met its one question."""
    asked, chunks = _search_tables(spark, sf)
    found = retrieval.search(asked, chunks.drop("embedding"), space="cosine", embed=embedder(), reranker=lambda q, t: F.size(F.split(t, " ")).cast("double") / 50.0)
    return found.select("query_id", "rank", "chunk_index", "score")


@query
def global_knn(spark, sf):
    """Every hundredth vector asks all others, without a document."""
    v = read(spark, sf, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("chunk_index"), "embedding")
    asked = v.where(F.col("chunk_index") % 100 == 0).select(F.col("chunk_index").alias("query_id"), F.col("embedding").alias("q_embedding"))
    return global_search.nearest(asked, v, 15, "l2")


@query
def global_search_all(spark, sf):
    """Every item of the benchmark is asked of the chunks of all documents."""
    embed = embedder()
    chunks = windows(read(spark, sf, "documents").select("doc_id", "text")).withColumn("embedding", embed("text"))
    base = f"{scratch.shared_dir(spark)}/chunks-{uuid.uuid4().hex}"
    chunks.write.parquet(base)
    asked = read(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question")).withColumn("q_embedding", question_embedding("question", embed))
    found = global_search.search_all(asked, spark.read.parquet(base), space="cosine", fuzzy=False, dedupe=False)
    return found.select("query_id", "rank", "doc_id", "chunk_index", F.round("score", 6).alias("score"))


@query
def rerank_fallback(spark, sf):
    """Documents' vectors re-ranked by a pair model that fails for some questions, which keep their order."""
    asked, chunks = _vectors(spark, sf)
    hits = retrieval.knn(asked, chunks, "cosine", 10).withColumn("score", params.score_from_distance(F.col("distance"), "cosine"))
    hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "distance", "chunk_index")))

    def make():
        def model(pairs):
            if any(int(q) % 30 == 0 for q, _ in pairs):
                raise RuntimeError("no model for this question")
            return [(int(t) * 7 + int(q)) % 11 - 5 for q, t in pairs]

        return model

    logit = retrieval.pair_scores(make)(F.col("query_id").cast("string"), F.col("chunk_index").cast("string"))
    return retrieval.rerank(hits, logit, 3, pool=8, min_score=0.5).select("query_id", "rank", "chunk_index", "score")


@query
def lexical_fallback(spark, sf):
    """Questions whose vectors find nothing are answered by wording alone: here all of them."""
    chunks = windows(read(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"))
    asked = questions(spark, sf)
    rows = retrieval.lexical_only(asked, chunks)
    best = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_index"))
    return rows.withColumn("rank", best).where("rank <= 2").select("query_id", "rank", "chunk_index", "score")


@query
def document_texts(spark, sf):
    c = windows(read(spark, sf, "documents"), 300, 0).withColumn("source_ext", F.when(F.pmod("doc_id", F.lit(4)) == 0, "txt").otherwise("pdf"))
    return retrieval.document_text(c)


def _hits(spark, sf) -> DataFrame:
    """All chunks of a document as its question's hits."""
    w = windows(read(spark, sf, "documents"))
    return w.select(F.col("doc_id").alias("query_id"), (F.col("chunk_index") + 1).alias("rank"), "page", "text", F.lit("text").alias("source"))


@query
def prompt_contexts(spark, sf):
    found = retrieval.prompt_context(_hits(spark, sf))
    return found.select("query_id", "context", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query
def observation_budget(spark, sf):
    return retrieval.observation(_hits(spark, sf))


@query
def merged_hits(spark, sf):
    """First chunk of each opening among a source's documents."""
    d = read(spark, sf, "documents")
    rows = d.select(F.col("source").alias("query_id"), F.col("doc_id").alias("rank"), F.lit(1).alias("step"), "text")
    return retrieval.merge_hits(rows).select("query_id", "rank")


@query
def client_errors(spark, sf):
    """Events as errors of the services behind."""
    e = read(spark, sf, "events")
    said = F.element_at(F.array(*map(F.lit, ("The operation was aborted", "fetch failed", "摘要 failed: 502", "文档处理返回 500", "问答 status 404", "gateway 502", "plain english", "问题 question 太长  了", ""))), (F.pmod("event_id", F.lit(9)) + 1).cast("int"))
    return e.select("event_id", T.client_error(said).alias("message"))


@query
def image_coverage(spark, sf):
    """An order's lines as images on a page."""
    b = _boxes(spark, sf)
    return b.select("l_orderkey", F.round(layout.image_coverage("boxes", F.lit(300), F.lit(400)), 9).alias("coverage"))


@query
def headed_tables(spark, sf):
    """A document's lines as tables of a row, numbered; blank ones are left out but count."""
    d = read(spark, sf, "documents")
    found = F.transform(F.split(T.text("text"), "\n"), lambda x: F.array(F.split(x, " ")))
    return d.select("doc_id", F.md5(tables.headed_tables(found)).alias("text_md5"))


@query
def page_texts(spark, sf):
    found = retrieval.page_texts(windows(read(spark, sf, "documents"), 300, 0).select("doc_id", F.col("chunk_index").alias("page"), "text"))
    return found.select("doc_id", F.md5("text").alias("text_md5"))


# --- conversations ----------------------------------------------------------------------------


@query
def history_recent(spark, sf):
    return memory.recent(messages(spark, sf), 4).select("conv_id", "turn", "pos", "role")


@query
def history_overflow(spark, sf):
    c = messages(spark, sf)
    state = c.select("conv_id").distinct().withColumn("covered", F.pmod("conv_id", F.lit(3)).cast("int"))
    return memory.overflow(c, 4, state).select("conv_id", "pos", "covered", "covered_after")


@query
def overflow_ids(spark, sf):
    return memory.overflow_records(messages(spark, sf), 4)


@query
def turns_text(spark, sf):
    return memory.turns_text(messages(spark, sf))


@query
def final_turns(spark, sf):
    return memory.final_turns(messages(spark, sf), 4, 60).select("conv_id", "pos", "content")


def _facts(spark, sf) -> DataFrame:
    """A conversation's turns as facts, each third pinned; its last turn is the question."""
    c = read(spark, sf, "conversations")
    line = F.concat(F.when(F.pmod("turn", F.lit(3)) == 0, "- [pinned] ").otherwise("- "), F.regexp_replace(T.text("text"), r"\s+", " "))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"), F.max_by("text", "turn").alias("question"))
    return g.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("facts"), "question")


@query
def facts_parsed(spark, sf):
    f = _facts(spark, sf).select("conv_id", F.posexplode_outer(T.fact_lines("facts")).alias("no", "line")).where("no IS NOT NULL")
    return f.select("conv_id", "no", "line", T.is_pinned("line").alias("pinned"), T.fact_key("line").alias("fact_key"))


@query
def facts_merged(spark, sf):
    """Facts of a conversation into those of the one before it."""
    f = _facts(spark, sf)
    old = f.select((F.col("conv_id") + 1).alias("conv_id"), F.col("facts").alias("existing"))
    both = f.join(old, "conv_id", "left")
    return both.select("conv_id", memory.merged_facts(T.text("existing"), F.split("facts", "\n"), 300).alias("facts"))


@query
def facts_retrieved(spark, sf):
    return memory.relevant_facts(_facts(spark, sf), "conv_id", "question", "facts", 2, 400)


@query
def summaries_retrieved(spark, sf):
    c = read(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", T.text("text").alias("t")))).alias("l"), F.max_by("text", "turn").alias("question"))
    c = c.select("conv_id", "question", F.array_join(F.transform("l", lambda x: x["t"]), "\n").alias("summary"))
    return memory.relevant_summary(c, "conv_id", "question", "summary", 2, 300)


@query
def prompt_messages(spark, sf):
    c = messages(spark, sf)
    mem = _facts(spark, sf).select("conv_id", "facts", F.lit("").alias("summary"))
    m = memory.prompt_messages(memory.final_turns(c, 2, 40), mem).select("conv_id", F.posexplode("messages").alias("no", "m"))
    return m.select("conv_id", "no", "m.role", "m.content")


# --- cleanup ----------------------------------------------------------------------------------


@query
def line_dedupe(spark, sf):
    return cleanup.collapse_lines(read(spark, sf, "documents").select("doc_id", "text"))


@query
def repetitive_documents(spark, sf):
    return cleanup.repetition(read(spark, sf, "documents"))


@query
def blank_runs(spark, sf):
    return cleanup.blank_runs(read(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_replace("html", r"<[^>]+>", "").alias("text")))


@query
def page_merge(spark, sf):
    d = read(spark, sf, "documents")
    digital = F.when(F.pmod("doc_id", F.lit(3)) == 0, "").otherwise(T.text("text"))
    table = F.when(F.pmod("doc_id", F.lit(2)) == 0, "").otherwise("| a | b |")
    ocr = F.when(F.pmod("doc_id", F.lit(5)) == 0, "").otherwise(F.concat(F.lit("ocr "), T.text("text")))
    return d.select("doc_id", tables.merged_page(digital, table, ocr, F.pmod("doc_id", F.lit(7)) == 0).alias("p")).select("doc_id", F.md5("p.text").alias("text_md5"), "p.mode")


@query
def html_tables(spark, sf):
    """Paragraphs of a page as a two-column table, then as Markdown."""
    p = read(spark, sf, "pages")
    cells = F.transform(F.regexp_extract_all(T.text("html"), F.lit(r"(?s)<p[^>]*>(.*?)</p>"), 1), lambda x: F.concat(F.lit("<tr><th>"), x, F.lit("</th><td>a &amp; b</td></tr>")))
    html = F.concat(F.lit("<table>"), F.array_join(cells, ""), F.lit("</table>"))
    return p.select("page_id", F.size(tables.html_table_rows(html)).alias("n_rows"), tables.html_table_markdown(html).alias("markdown"))


@query
def cell_markdown(spark, sf):
    d = read(spark, sf, "documents")
    cells = F.transform(F.split(T.text("text"), "\n"), lambda x: F.split(x, " "))
    return d.select("doc_id", F.md5(tables.table_markdown(cells)).alias("markdown_md5"))


# --- layout -----------------------------------------------------------------------------------


def _boxes(spark, sf) -> DataFrame:
    """An order's lines as boxes on a page."""
    li = read(spark, sf, "lineitem")
    x, y = (F.pmod(F.col("l_partkey") * 7, F.lit(200))).cast("double"), (F.pmod(F.col("l_suppkey") * 13 + F.col("l_linenumber") * 5, F.lit(300))).cast("double")
    box = F.struct(F.col("l_linenumber").alias("n"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity").cast("double") + 20.0).alias("x1"), (y + 40.0).alias("y1"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(box)).alias("boxes"))


@query
def reading_order(spark, sf):
    b = _boxes(spark, sf)
    return b.select("l_orderkey", layout.reading_order(F.transform("boxes", lambda x: F.struct(x["n"].cast("string").alias("text"), x["y0"].alias("y"), x["x0"].alias("x")))).alias("text"))


@query
def merged_regions(spark, sf):
    b = _boxes(spark, sf).select("l_orderkey", layout.merged_regions("boxes", 0.3).alias("kept"), F.size("boxes").alias("n_boxes"))
    return b.select("l_orderkey", "n_boxes", F.array_join(F.transform("kept", lambda x: x["n"].cast("string")), ",").alias("kept"))


@query
def deduped_lines(spark, sf):
    # dealt by document: a file of few row groups would leave all pages to few tasks
    return read(spark, sf, "documents").select("doc_id", "text").repartition("doc_id").select("doc_id", layout.dedupe_lines("text").alias("text"))


# --- catalog ----------------------------------------------------------------------------------

NOW = "2024-01-31 00:00:00"


def _registry(spark, sf) -> DataFrame:
    """Users of events as documents: registered at their first event, linked to their last."""
    e = read(spark, sf, "events")
    return e.groupBy("user_id").agg(F.max("ts").alias("created_at"), F.max("event_id").alias("conversation_id")).select(F.col("user_id").cast("string").alias("doc_id"), "created_at", F.col("conversation_id").cast("string").alias("conversation_id"))


def _stored(spark, sf) -> DataFrame:
    return read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", F.length("text").alias("chars"))


def _conversation_docs(spark, sf) -> DataFrame:
    return read(spark, sf, "conversations").where("turn = 0").select(F.col("conv_id").cast("string").alias("id"), (F.col("conv_id") * 3).cast("string").alias("doc_id"))


@query
def grace_keep(spark, sf):
    return catalog.keep_set(_conversation_docs(spark, sf), _registry(spark, sf), F.lit(NOW).cast("timestamp"))


@query
def reconcile_orphans(spark, sf):
    keep = catalog.keep_set(_conversation_docs(spark, sf), _registry(spark, sf), F.lit(NOW).cast("timestamp"))
    return catalog.orphans(_stored(spark, sf), keep)


@query
def replace_documents(spark, sf):
    d = read(spark, sf, "documents")
    new = read(spark, sf, "labels").where("toxic = 1").select("doc_id", F.lit("new").alias("source"), F.lit(0).alias("chars"))
    return catalog.replace_documents(d.select("doc_id", "source", F.length("text").alias("chars")), new).select("doc_id", "source", "chars")


@query
def delete_documents(spark, sf):
    gone = read(spark, sf, "labels").where("quality = 0").select("doc_id")
    return catalog.delete_documents(read(spark, sf, "documents"), gone).select("doc_id", "n_chars")


@query
def upsert_latest(spark, sf):
    """Turns stored by role, later ones in place of earlier ones."""
    c = read(spark, sf, "conversations")
    key = F.concat_ws("|", F.col("conv_id").cast("string"), "role")
    rows = c.where("turn = 0").select(key.alias("id"), "text")
    new = c.where("turn > 0").select(key.alias("id"), "text", F.col("turn").alias("batch_no"))
    return catalog.upsert(rows, new)


@query
def insert_ignore(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("ts").alias("created_at"), "event_type")
    old = e.where("event_type = 'click'").groupBy("doc_id").agg(F.min("created_at").alias("created_at"))
    return catalog.insert_or_ignore(old, e.select("doc_id", "created_at"))


@query
def link_documents(spark, sf):
    e = read(spark, sf, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("conversation_id"), F.col("event_id").alias("linked_at"), F.col("ts").alias("created_at"), "event_type")
    old = e.where("event_type <> 'click'").groupBy("doc_id").agg(F.min("created_at").alias("created_at")).withColumn("conversation_id", F.lit(None).cast("bigint"))
    return catalog.link(old, e.where("event_type = 'click'").drop("event_type")).select("doc_id", "created_at", "conversation_id")


@query
def update_columns(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source", "lang")
    changes = read(spark, sf, "labels").select("doc_id", F.when(F.col("toxic") == 1, "flagged").alias("source"), F.when(F.col("quality") == 0, "low").alias("lang"))
    return catalog.update_columns(d, changes, "doc_id", ["source", "lang"])


@query
def cascade_delete(spark, sf):
    """Rows left in each table after the conversations with a system turn are deleted."""
    conv = _conversation_docs(spark, sf)
    gone = read(spark, sf, "conversations").where("role = 'system'").select(F.col("conv_id").cast("string").alias("id")).distinct()
    chat = read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("conversation_id"), "turn")
    left = catalog.cascade_delete(conv, _registry(spark, sf), _stored(spark, sf), chat, gone)
    return catalog.union([t.agg(F.count("*").alias("n_left")).withColumn("name", F.lit(name)) for name, t in left.items()])


@query
def upsert_conversations(spark, sf):
    c = read(spark, sf, "conversations")
    old = c.where("turn = 0 AND conv_id % 2 = 0").select(F.col("conv_id").cast("string").alias("id"), F.lit("[]").alias("messages"), F.lit("old").alias("summary"), F.lit("").alias("doc_id"), F.lit("").alias("document_name"), F.lit("2024-01-01").alias("created_at"), F.lit(1).alias("memory_covered"))
    return catalog.upsert_conversations(old, _puts(spark, sf), F.lit("2024-02-01")).select(
        "id", "summary", "doc_id", "document_name", "created_at", "memory_covered", F.size(F.from_json("messages", catalog.MESSAGES)).alias("n_messages")
    )


def _puts(spark, sf) -> DataFrame:
    """Conversations of two turns or more as puts: each third without messages, each fifth of no list at all, some with a document, a name, a time or a memory."""
    c = read(spark, sf, "conversations")
    every = c.groupBy("conv_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.lpad(F.col("turn").cast("string"), 6, "0").alias("id"), "role", F.col("text").alias("content"))))).alias("body"), F.count("*").alias("n"))
    nth = lambda n: F.pmod("conv_id", F.lit(n)) == 0
    return every.where("n > 1").select(
        F.col("conv_id").cast("string").alias("id"), F.when(nth(5), '{"id": "1"}').when(nth(3), "[]").otherwise(F.col("body")).alias("messages"), F.when(~nth(6), "new").alias("summary"),
        F.when(nth(4), F.concat(F.lit("d"), (F.col("conv_id") % 16).cast("string"))).alias("doc_id"), F.when(nth(8), "paper").alias("document_name"), F.when(nth(7), "2024-01-15").alias("created_at"), F.when(nth(2), 3).alias("memory_covered"),
    )


@query
def put_links(spark, sf):
    """The registry after the puts have linked their documents: the last of several by the conversation's id."""
    links = catalog.put_links(_puts(spark, sf), F.lit(NOW).cast("timestamp")).withColumn("linked_at", F.col("conversation_id").cast("bigint"))
    registry = read(spark, sf, "events").where("event_type = 'click'").groupBy(F.concat(F.lit("d"), (F.col("user_id") % 64).cast("string")).alias("doc_id")).agg(F.min("ts").alias("created_at"), F.lit("none").alias("conversation_id"))
    return catalog.link(registry, links)


@query
def history_page(spark, sf):
    c = read(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("turn").alias("created_at"), F.count_if(F.col("role") != "system").alias("dialog"))
    return catalog.page(c, 2)


# --- evaluation -------------------------------------------------------------------------------


def _evaluation(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as cases, the pool of their hits (all chunks) and the final cut (the three best by wording).

    Pages 1 and 3 are wanted; of phrases a document's first and last twelve characters, the
    latter twice, and the characters on both sides of the second window's end, which a line end parts.
    """
    d = read(spark, sf, "documents")
    cases = d.select(F.col("doc_id").alias("query_id"), F.array(F.lit(1), F.lit(3)).alias("gold_pages"), F.array(F.substring("text", 1, 12), F.right("text", F.lit(12)), F.right("text", F.lit(12)), F.concat(F.substring("text", 545, 6), F.lit("\n"), F.substring("text", 501, 6))).alias("gold_contains"))
    rows = retrieval.lexical_only(questions(spark, sf), windows(d))
    best = F.row_number().over(Window.partitionBy("doc_id", "query_id").orderBy(F.desc("score"), "chunk_index"))
    pool = rows.withColumn("rank", best).select("query_id", "chunk_index", "page", "text", "rank")
    return cases, pool, pool.where("rank <= 3")


@query
def eval_metrics(spark, sf):
    cases, pool, _ = _evaluation(spark, sf)
    return evaluation.metrics(cases, pool)


@query
def eval_final(spark, sf):
    """What the final cut leaves of the pool's recall."""
    cases, _, final = _evaluation(spark, sf)
    return evaluation.metrics(cases, final)


@query
def eval_verdict(spark, sf):
    cases, pool, final = _evaluation(spark, sf)
    off = evaluation.metrics(cases, pool)
    return evaluation.compare(off, evaluation.metrics(cases, final)).groupBy("verdict").agg(F.count("*").alias("cases"))


@query
def eval_summary(spark, sf):
    cases, pool, _ = _evaluation(spark, sf)
    return evaluation.summary(evaluation.metrics(cases, pool))


@query
def case_errors(spark, sf):
    """Every third document has no question, every fifth no chunks, of every seventh nothing is wanted, every eleventh wants a blank."""
    d = read(spark, sf, "documents")
    nth = lambda n: F.pmod("doc_id", F.lit(n)) == 0
    cases = d.select(
        F.col("doc_id").cast("string").alias("doc_id"), F.when(nth(3), " ").otherwise("q").alias("question"),
        F.when(nth(7), F.array().cast("array<int>")).when(~nth(11), F.array(F.lit(1))).alias("gold_pages"), F.when(nth(11), F.array(F.lit(" "))).alias("gold_contains"),
    )
    chunks = windows(d).where(F.pmod("doc_id", F.lit(5)) != 0).select(F.col("doc_id").cast("string").alias("doc_id"))
    return evaluation.with_errors(cases, chunks).select("doc_id", "error")


# --- models stood in for ----------------------------------------------------------------------


@query
def map_reduce_summary(spark, sf):
    """A stand-in for the model reads a whole prompt: it answers its length and checksum."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    section = F.concat(F.col("no").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("\n"), F.col("section"))
    return summaries.summarise(d, lambda p: f"{len(p)}:{zlib.crc32(p.encode())}", section, lambda parts: F.concat(F.lit("merged: "), parts), size=1000, most=4, single_prompt=F.col("section"))


@query
def react_loop(spark, sf):
    """Turns of users as questions about the document with their conversation's number.

    The planner stand-in asks the talk first, then the document, then ends; a search of the
    document gives the two chunks that share most wording with the question, one of the talk
    its two first turns.
    """
    c = read(spark, sf, "conversations")
    hint = F.when(F.pmod("conv_id", F.lit(3)) == 0, "合同金额 ").when(F.pmod("conv_id", F.lit(7)) == 0, "之前的合同 ").otherwise("")
    asked = c.where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("conv_id").alias("doc_id"), F.concat(hint, T.text("text")).alias("question"))
    docs = read(spark, sf, "documents").select("doc_id", "text")

    def search_doc(q: DataFrame) -> DataFrame:
        # only documents that a question is about are cut
        rows = retrieval.lexical_only(q, windows(docs.join(q.select("doc_id").distinct(), "doc_id", "left_semi"))).where("score > 0")
        best = F.row_number().over(Window.partitionBy("doc_id", "query_id").orderBy(F.desc("score"), "chunk_index"))
        return rows.withColumn("rank", best).where("rank <= 2").select("query_id", "rank", "text", "page")

    def search_chat(q: DataFrame) -> DataFrame:
        turns = c.where("turn < 2").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("rank"), "text")
        return q.select("query_id", "doc_id").join(turns, "doc_id").select("query_id", "rank", "text")

    def plan(prompt: str) -> str:
        done = "search_doc" if "已搜旧对话：是" in prompt else "search_chat"
        return '{"action":"finish"}' if "已搜文档：是" in prompt else f'{{"action":"{done}"}}'

    out = agent.run(asked, plan, search_doc, search_chat, max_steps=3)
    return out.select("query_id", "path", "steps", F.size("doc_queries").alias("n_doc_queries"), F.size("chat_queries").alias("n_chat_queries"), F.size("hits").alias("n_hits"), "used_memory", "finish_reason", F.size("trace").alias("n_steps"))


def _streamed(spark, sf, tag: str, parts: list[DataFrame]) -> tuple[str, str]:
    """A folder that the parts are written to one after the other, as a stream's triggers find them, and its schema."""
    base = f"{scratch.shared_dir(spark)}/stream-{tag}-{uuid.uuid4().hex}"
    for part in parts:
        part.coalesce(4).write.mode("append").parquet(f"{base}/in")
    return base, parts[0].schema


ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _run(spark, base: str, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stateful stream gives, with n, the trigger's number. The session's own state store comes back after it."""
    was = spark.conf.get(ROCKS[0], None)
    spark.conf.set(*ROCKS)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        writer.foreachBatch(lambda batch, n: batch.withColumn("n", F.lit(n)).write.mode("overwrite").parquet(f"{base}/out/batch={n}")).start().awaitTermination()
    finally:
        spark.conf.set(ROCKS[0], was) if was else spark.conf.unset(ROCKS[0])
    return spark.read.parquet(f"{base}/out")


@query
def stream_memory(spark, sf):
    """Turns as a stream in three parts, the middle one sent twice, folded into each conversation's state: the last row of each.

    The beginning of a turn that leaves the window is a fact.
    """
    c = read(spark, sf, "conversations")
    middle = c.where("turn >= 3 AND turn < 6")
    base, schema = _streamed(spark, sf, "memory", [c.where("turn < 3"), middle, middle, c.where("turn >= 6")])
    turns = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")
    rows = _run(spark, base, jobs.rolling_memory(turns, facts=lambda block: [line[:30] for line in block.split("\n")]), "update")
    last = rows.withColumn("no", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("n")))).where("no = 1")
    return last.select("conv_id", "covered", "kept", "summary", F.array_join("facts", "|").alias("facts"))


@query
def stream_events(spark, sf):
    """Turns as lines of a connection's event stream, cut into blocks of 37 bytes wherever that falls, in three parts."""
    c = read(spark, sf, "conversations")
    line = F.concat(F.lit("data: "), F.regexp_replace(T.text("text"), r"\s+", " "), F.lit("\r\n: ping\n"))
    body = c.groupBy(F.col("conv_id").alias("connection")).agg(F.sort_array(F.collect_list(F.struct("turn", line.alias("line")))).alias("l"))
    body = body.select("connection", F.encode(F.concat(F.array_join(F.col("l.line"), ""), F.lit("data: without an end")), "UTF-8").alias("b"))
    places = F.posexplode(F.sequence(F.lit(1), F.octet_length("b"), F.lit(37)))
    blocks = body.select("connection", "b", places.alias("seq", "at")).select("connection", F.col("seq").cast("bigint").alias("seq"), F.substring("b", F.col("at"), F.lit(37)).alias("value"))
    base, schema = _streamed(spark, sf, "events", [blocks.where("seq < 3"), blocks.where("seq >= 3 AND seq < 20"), blocks.where("seq >= 20")])
    rows = _run(spark, base, jobs.event_payloads(spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{base}/in")), "append")
    out = rows.groupBy("connection").agg(F.sort_array(F.collect_list(F.struct("at", "payload"))).alias("l"))
    return out.select("connection", F.size("l").alias("n_payloads"), F.md5(F.array_join(F.col("l.payload"), "|")).alias("payloads_md5"))


@query
def stream_ingest(spark, sf):
    """Documents as a stream of pages, a document's pages over several batches; each fifth document comes again, shorter and changed.

    What of the store holds at the end.
    """
    w = windows(read(spark, sf, "documents"), 300, 0).select("doc_id", (F.col("chunk_index") + 1).alias("page"), "text", F.lit("txt").alias("source_ext"), F.lit(1).cast("bigint").alias("upload"))
    again = w.where("doc_id % 5 = 0 AND page <= 2").withColumn("text", F.concat(F.lit("v2 "), F.substring("text", 1, 200))).withColumn("upload", F.lit(2).cast("bigint"))
    base, schema = _streamed(spark, sf, "ingest", [w.where("page % 2 = 0").unionByName(again.where("page = 1")), w.where("page % 2 = 1").unionByName(again.where("page = 2"))])
    jobs.ingest(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state", files_per_batch=4, buckets=8).awaitTermination()
    out = jobs.current(spark, f"{base}/out").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))).alias("l"))
    return out.select("doc_id", F.size("l").alias("n_chunks"), F.md5(F.array_join(F.col("l.text"), "\n")).alias("text_md5"))


@query
def watched_ingest(spark, sf):
    """Documents are stored under a watch; then shorter ones of the same ids, which is stopped on the way. What holds, and what was reported.

    n_falls counts the reports that were no higher than the one before.
    """
    w = windows(read(spark, sf, "documents"), 300, 0).select("doc_id", (F.col("chunk_index") + 1).alias("page"), "text", F.lit("txt").alias("source_ext"), F.lit(1).cast("bigint").alias("upload"))
    base, told = f"{scratch.shared_dir(spark)}/watched-{uuid.uuid4().hex}", []
    progress.ingest_watched(progress.Watch(spark, lambda name, percent: told.append(percent)), spark, w, 0, base, buckets=8)

    def stop(name: str, percent: int) -> None:
        if name == "chunks":
            watch.cancel()

    watch, stopped = progress.Watch(spark, stop), False
    try:
        progress.ingest_watched(watch, spark, w.where("page = 1").withColumn("upload", F.lit(2).cast("bigint")), 1, base, buckets=8)
    except progress.Cancelled:
        stopped = True
    falls = sum(b <= a for a, b in zip(told, told[1:], strict=False))
    out = jobs.current(spark, base).groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("chars"))
    return out.select("*", F.lit(falls).alias("n_falls"), F.lit(told[-1]).alias("last_report"), F.lit(stopped).alias("stopped"))


@query
def paged_files(spark, sf):
    """Fifty documents to a file of pages, read page by page in ranges of a file; of more than 300 pages the rest is marked."""
    w = windows(read(spark, sf, "documents"), 300, 0).select(F.floor(F.col("doc_id") / 50).alias("book"), "doc_id", "chunk_index", F.translate("text", "\f", " ").alias("value"))
    base = f"{scratch.shared_dir(spark)}/paged-{uuid.uuid4().hex}"
    ordered = w.repartition("book").sortWithinPartitions("book", "doc_id", "chunk_index").select("book", "value")
    ordered.write.partitionBy("book").option("lineSep", "\f").text(base)
    spark.dataSource.register(PageSource)
    found = spark.read.format(PageSource.name()).option("path", base).option("maxPages", 300).option("rangeBytes", 1 << 15).load()
    return found.select(F.regexp_extract("doc_id", r"book=(\d+)", 1).cast("bigint").alias("book"), "page", "text", "source_ext", "error")


# --- answers ----------------------------------------------------------------------------------


@query
def pages_to_scan(spark, sf):
    """Windows as pages; those of every other source have lost most of their text."""
    d = read(spark, sf, "documents")
    lost = d.select("doc_id", F.substring("source", 4, 9).cast("int").alias("no"))
    w = windows(d).join(lost, "doc_id")
    kept = F.when((F.col("no") % 2 == 0) & (F.col("chunk_index") > 1), "").otherwise(F.col("text"))
    return answers.pages_to_scan(w.select("doc_id", (F.col("chunk_index") + 1).alias("page"), kept.alias("text")), 5)


@query
def error_messages(spark, sf):
    e = read(spark, sf, "events")
    said = F.element_at(F.array(*map(F.lit, ("HTTP 502", "Service Unavailable", "model not found", "Connection refused", "request timed out", "Error code: 7", ""))), (F.pmod("event_id", F.lit(7)) + 1).cast("int"))
    return e.select("event_id", answers.error_message(said).alias("message"), answers.summary_failed(answers.error_message(said)).alias("failed"), answers.summary_failed(F.col("event_type")).alias("type_failed"))


@query
def turn_search(spark, sf):
    """Vectors as stored turns; conversations as for the other searches."""
    asked, chunks = _vectors(spark, sf)
    turns = chunks.select(F.col("doc_id").alias("conversation_id"), F.col("chunk_index").alias("msg_index"), "embedding")
    return answers.search_turns(asked.withColumnRenamed("doc_id", "conversation_id"), turns, 4, "cosine").select("query_id", "rank", "msg_index", "score")


@query
def answer_prompts(spark, sf):
    """The user's message for each document's question: with its chunks where it has any, else of memory alone."""
    context = retrieval.prompt_context(_hits(spark, sf))
    counts = windows(read(spark, sf, "documents")).groupBy(F.col("doc_id").alias("query_id")).agg(F.count("*").alias("n"))
    both = questions(spark, sf).join(context, "query_id", "left").join(counts, "query_id", "left")
    n, none = F.coalesce("n", F.lit(0)), F.pmod("query_id", F.lit(3)) == 0
    return both.select("query_id", F.md5(answers.doc_message("question", "context", F.lit(""), Config(final_doc_chars=500))).alias("prompt_md5"), answers.not_found(n, F.when(none, 0).otherwise(n), F.lit(False)).alias("message"))


@query
def answer_messages(spark, sf):
    """All that the model is sent for a conversation's last turn: its document is the one of its number, its memory its own turns as facts."""
    f = _facts(spark, sf)
    asked = f.select(F.col("conv_id").alias("query_id"), "conv_id", "question")
    state = f.select("conv_id", F.col("facts").alias("memory_facts"), F.lit("").alias("memory_summary"))
    hits = _hits(spark, sf).where("rank <= 3 AND query_id % 4 <> 0")
    chat = read(spark, sf, "conversations").where("turn < 2 AND conv_id % 3 <> 0").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).alias("rank"), "text")
    out = answers.answer_messages(asked, hits, chat, messages(spark, sf), state, Config(final_facts_top_k=2, final_facts_chars=400, final_doc_chars=500, final_chat_chars=300, final_chat_chars_with_doc=200))
    whole = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")
    return out.select("query_id", "with_doc", F.size("messages").alias("n_messages"), "n_chars", F.md5(whole).alias("messages_md5"))
