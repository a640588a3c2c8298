"""What a question gets back: stored turns, messages instead of an answer, prompts; and which pages need OCR."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import Config
from docloom.functions import params
from docloom.functions.text import starts_with_any, text, trim_blocks, ws_trim

from .memory import final_turns, relevant_facts, relevant_summary
from .retrieval import distance, prompt_context

#: Starts of summaries that stand for a failure. Fixed values.
FAILED_SUMMARIES = ("AI 摘要生成失败", "AI 摘要生成超时", "文件内容提取失败", "请求已取消")
#: What an error says, in this order, and what the user is told. Fixed values.
ERRORS = (
    ("502|bad gateway", "AI 摘要生成失败：LM Studio 服务不可用，请启动 Local Server 并加载模型"),
    ("503|service unavailable", "AI 摘要生成失败：LM Studio 服务繁忙或未就绪，请稍后重试"),
    ("404|not found", "AI 摘要生成失败：模型不存在，请检查 LM Studio 中是否已加载对应模型"),
    ("connection|refused|connect", "AI 摘要生成失败：无法连接 LM Studio，请确认 Local Server 已启动"),
    ("timeout|timed out", "AI 摘要生成超时"),
    ("error code", "AI 摘要生成失败：LM Studio 调用异常，请检查服务与模型是否就绪"),
)
OTHER_ERROR = "AI 摘要生成失败：请检查 LM Studio 是否已启动并加载模型"
NOTHING_CLOSE = "未找到与问题足够相关的内容，请换种问法或换个角度描述。"
NO_DOCUMENT = "未找到相关文档内容，请先上传文档。"
CONTENTS = ("目录", "CONTENTS", "Contents", "目 录")


def summary_failed(c: str | Column) -> Column:
    return (ws_trim(c) == "") | starts_with_any(text(c), FAILED_SUMMARIES)


def error_message(c: str | Column) -> Column:
    out = F.lit(OTHER_ERROR)
    for pattern, said in reversed(ERRORS):
        out = F.when(F.lower(text(c)).rlike(pattern), said).otherwise(out)
    return out


def search_turns(questions: DataFrame, turns: DataFrame, k: int | None = None, space: str = "l2", config: Config = Config()) -> DataFrame:
    """questions (query_id, conversation_id, q_embedding) with their conversation's k nearest stored turns (chat_top_k if not given), best first."""
    k = config.chat_top_k if k is None else k
    hits = questions.join(turns, "conversation_id").withColumn("distance", distance(F.col("q_embedding"), F.col("embedding"), space))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "msg_index"))).where(F.col("rank") <= k)
    return ranked.withColumn("score", params.score_from_distance(F.col("distance"), space)).drop("embedding", "q_embedding")


def not_found(doc_chunks: Column, hits: Column, used_memory: Column) -> Column:
    """The message for a question that found nothing; null where it found something."""
    return F.when((hits > 0) | used_memory, None).when(doc_chunks > 0, NOTHING_CLOSE).otherwise(NO_DOCUMENT)


#: Heads of a prompt's parts, and what stands for a part that is missing. Fixed values.
DOC_HEAD, CHAT_HEAD, QUESTION_HEAD, FACTS_HEAD, SUMMARY_HEAD = "【文档片段】\n", "【相关历史对话】\n", "【用户问题】\n", "【相关硬事实】\n", "【相关摘要】\n"
NO_MEMORY, NO_CHAT = "（无相关摘要/事实）", "（无旧对话命中）"
#: What the model is told it is, with and without pieces of a document, and what it is asked for at the end.
DOC_ROLE = "根据【文档片段】回答，对话记忆只作参考；要点说全，每点一次，不标页码。"
TALK_ROLE = "根据记忆和旧对话回答；不知道就说不知道。"
DOC_ASK, TALK_ASK = "请给出完整答案：", "请根据以上材料回答："


def _filled(c: str | Column) -> Column:
    return ws_trim(c) != ""


def doc_message(question: str | Column, context: str | Column, chat: str | Column, config: Config = Config()) -> Column:
    """Document blocks, then stored turns if any, each cut at a block's end within its budget, then the question."""
    chat = trim_blocks(chat, config.final_chat_chars_with_doc)
    talk = F.when(chat != "", F.concat(F.lit("\n\n" + CHAT_HEAD), chat, F.lit("\n"))).otherwise("")
    return F.concat(F.lit(DOC_HEAD), trim_blocks(context, config.final_doc_chars), talk, F.lit("\n" + QUESTION_HEAD), text(question), F.lit("\n\n" + DOC_ASK))


def talk_message(question: str | Column, facts: str | Column, summary: str | Column, chat: str | Column, config: Config = Config()) -> Column:
    """For a question that found nothing in a document: facts and summary, stored turns, the question."""
    part = lambda head, c: F.when(_filled(c), F.concat(F.lit(head), ws_trim(c)))
    memory = F.concat_ws("\n\n", part(FACTS_HEAD, facts), part(SUMMARY_HEAD, summary))
    chat = trim_blocks(chat, config.final_chat_chars)
    return F.concat(
        F.when(memory != "", memory).otherwise(NO_MEMORY), F.lit("\n\n" + CHAT_HEAD), F.when(chat != "", chat).otherwise(NO_CHAT),
        F.lit("\n\n" + QUESTION_HEAD), text(question), F.lit("\n\n" + TALK_ASK),
    )


def chat_block(hits: DataFrame) -> DataFrame:
    """query_id and chat: stored turns (query_id, rank, text) under their numbers; blank ones are left out but count."""
    line = F.concat(F.lit("【旧对话"), F.col("rank").cast("string"), F.lit("】\n"), ws_trim("text"))
    rows = hits.where(_filled("text")).groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", line.alias("b")))).alias("l"))
    return rows.select("query_id", F.array_join(F.col("l.b"), "\n\n").alias("chat"))


def answer_messages(asked: DataFrame, hits: DataFrame, chat_hits: DataFrame, turns: DataFrame, state: DataFrame, config: Config = Config(), embed=None) -> DataFrame:
    """query_id, with_doc, messages (array<struct<role, content>>) and n_chars: what the model is sent for each question.

    asked: query_id, conv_id, question; hits: query_id, rank, page, text; chat_hits: query_id,
    rank, text; turns: conv_id, turn, role, content; state: conv_id, memory_facts and
    memory_summary. Of both the lines and sentences that bear on the question are taken. With
    hits: role, facts, summary, the last turns, then document and question; without: role, then
    memory, stored turns and question in one message.
    """
    known = asked.join(state.select("conv_id", "memory_facts", "memory_summary"), "conv_id", "left")
    facts = relevant_facts(known, "query_id", "question", "memory_facts", config.final_facts_top_k, config.final_facts_chars, embed)
    summary = relevant_summary(known, "query_id", "question", "memory_summary", config.final_summary_sentences, config.final_summary_chars, embed)
    last = final_turns(turns, config.final_recent_messages, config.final_message_chars)
    last = last.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("recent"))
    every = asked.join(prompt_context(hits).select("query_id", "context"), "query_id", "left").join(chat_block(chat_hits), "query_id", "left")
    every = every.join(facts, "query_id").join(summary, "query_id").join(last, "conv_id", "left")
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    some = lambda c, head: F.when(_filled(c), F.array(message("system", F.concat(F.lit(head), ws_trim(c))))).otherwise(none)
    none = F.array().cast("array<struct<role:string,content:string>>")
    with_doc = F.col("context").isNotNull()
    doc = F.concat(
        F.array(message("system", F.lit(DOC_ROLE))), some("facts", FACTS_HEAD), some("summary", SUMMARY_HEAD), F.coalesce("recent", none),
        F.array(message("user", doc_message("question", "context", "chat", config))),
    )
    talk = F.array(message("system", F.lit(TALK_ROLE)), message("user", talk_message("question", "facts", "summary", "chat", config)))
    out = every.select("query_id", with_doc.alias("with_doc"), F.when(with_doc, doc).otherwise(talk).alias("messages"))
    return out.withColumn("n_chars", F.aggregate("messages", F.lit(0), lambda n, m: n + F.length(m["content"])))


def pages_to_scan(pages: DataFrame, first: int = 35) -> DataFrame:
    """pages (doc_id, page, text): those that OCR should read.

    A document is scanned if it has fewer pages with text than the larger of 3 and a fifth of
    its pages. Of it the first pages are read, and others whose text looks like contents.
    """
    by = Window.partitionBy("doc_id")
    full = F.count_if(ws_trim("text") != "").over(by)
    scanned = full < F.greatest(F.lit(3), F.floor(F.count("*").over(by) / 5))
    contents = reduce(lambda a, b: a | b, (F.contains(text("text"), F.lit(k)) for k in CONTENTS))
    rows = pages.withColumn("scanned", scanned)
    return rows.where(F.col("scanned") & ((F.col("page") <= first) | contents)).select("doc_id", "page")
