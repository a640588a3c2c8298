"""Routing of questions and a bounded tool loop, a batch of questions at a time."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import let, looks_like_doc_query, looks_like_memory_query, needs_rewrite, squeeze, text, ws_trim
from docloom.sources.scratch import written

#: What a planner may answer. Fixed values.
ACTIONS = ("read_memory", "search_chat", "search_doc", "finish")


def route(question: str | Column) -> Column:
    """fast_doc, fast_memory or planner, by what the question hints at."""
    doc, memory = looks_like_doc_query(question), looks_like_memory_query(question)
    return F.when(doc & ~memory, "fast_doc").when(memory & ~doc, "fast_memory").otherwise("planner")


def decision(answer: str | Column) -> Column:
    """struct<thought, action, action_input> of a planner's answer: JSON, else marked lines, else a name in it, else finish."""
    return let(ws_trim(answer), _decided)


def _decided(raw: Column) -> Column:
    inner = F.regexp_extract(raw, r"(?s)\{.*\}", 0)
    body = F.when(inner != "", inner).otherwise(raw)
    field = lambda *names: F.coalesce(*(F.when(F.trim(F.get_json_object(body, f"$['{n}']")) != "", F.trim(F.get_json_object(body, f"$['{n}']"))) for n in names), F.lit(""))
    own = F.lower(field("action", "Action"))
    is_json = own.isin(*ACTIONS)
    marked = F.lower(F.regexp_extract(raw, r"(?i)Action\s*[:：]\s*(read_memory|search_chat|search_doc|finish)", 1))
    said = F.regexp_extract(raw, r"(?is)Action\s*[:：]\s*(?:read_memory|search_chat|search_doc|finish)\s*Action\s*Input\s*[:：]\s*(.*)", 1)
    said = ws_trim(F.regexp_replace(said, r"(?is)\n\s*(Thought|Action)\s*[:：].*$", ""))
    thought = ws_trim(F.regexp_extract(raw, r"(?is)Thought\s*[:：]\s*(.+?)(?=\n\s*Action\s*[:：]|$)", 1))
    named = F.lit("finish")
    for a in reversed(ACTIONS):
        named = F.when(F.lower(raw).contains(a), a).otherwise(named)
    return F.struct(
        F.when(raw == "", "").when(is_json, field("thought", "Thought")).otherwise(thought).alias("thought"),
        F.when(raw == "", "finish").when(is_json, own).when(marked != "", marked).otherwise(named).alias("action"),
        F.when(raw == "", "").when(is_json, field("action_input", "Action Input", "input")).when(marked != "", said).otherwise("").alias("action_input"),
    )


#: rows of queries (query_id, question, ...) -> their hits (query_id, rank, text, page, source)
SearchFn = Callable[[DataFrame], DataFrame]
#: Notices in place of an observation. Fixed values.
NO_MEMORY = "（记忆为空：尚无摘要、硬事实或最近对话）"
NO_HITS, NO_TURNS = "（未检索到相关文档片段）", "（未检索到相关旧对话片段）"
REPEATED_DOC, REPEATED_CHAT, ENDED = "（已用过相同检索词，跳过重复搜索）query=", "（已用过相同旧对话检索词，跳过）query=", "（结束工具循环）"
HIT = "struct<text:string,page:int,source:string>"
STEP = "struct<step:int,thought:string,action:string,action_input:string,observation:string>"
STATE = ("path", "steps", "doc_queries", "chat_queries", "hits", "chat_hits", "used_memory", "memory_observation", "finish_reason", "trace")


def memory_observation(facts: str | Column, summary: str | Column, turns: str | Column) -> Column:
    """Facts, summary and last turns under their headings, or a notice that there is nothing."""
    part = lambda head, c: F.when(ws_trim(c) != "", F.concat(F.lit(head), ws_trim(c)))
    every = F.concat_ws("\n\n", part("【硬事实】\n", facts), part("【对话摘要】\n", summary), part("【最近对话】\n", turns))
    return F.when(every == "", NO_MEMORY).otherwise(every)


def search_observation(hits: str | Column, empty: str = NO_HITS, max_chars: int = 2400) -> Column:
    """array<HIT> as numbered blocks, up to the first that would pass the limit; the first always stands."""
    start = F.struct(F.array().cast("array<string>").alias("blocks"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(a: Column, x: Column) -> Column:
        h, t = x["h"], ws_trim(x["h"]["text"])
        source = F.when(text(h["source"]) != "", F.concat(F.lit(" source="), h["source"])).otherwise("")
        page = F.when(F.coalesce(h["page"], F.lit(0)) != 0, F.concat(F.lit(" page="), h["page"].cast("string"))).otherwise("")

        def added(block: Column) -> Column:
            full = a["full"] | ((a["used"] + F.length(block) > max_chars) & (F.size(a["blocks"]) > 0))
            return F.struct(
                F.when(full, a["blocks"]).otherwise(F.array_append(a["blocks"], block)).alias("blocks"),
                F.when(full, a["used"]).otherwise(a["used"] + F.length(block) + 2).alias("used"), full.alias("full"),
            )

        return F.when(t == "", a).otherwise(let(F.concat(F.lit("【片段"), x["no"].cast("string"), F.lit("】"), source, page, F.lit("\n"), t), added))

    numbered = F.transform(hits, lambda h, i: F.struct(h.alias("h"), (i + 1).alias("no")))
    out = F.aggregate(numbered, start, step, lambda a: F.array_join(a["blocks"], "\n\n"))
    return F.when(text(out) == "", empty).otherwise(out)


def merged(old: Column, new: Column) -> Column:
    """old with the hits of new whose first 80 characters aren't there yet; blank ones are left out."""
    key = lambda h: ws_trim(F.substring(text(h["text"]), 1, 80))
    return F.aggregate(new, old, lambda a, h: F.when((key(h) == "") | F.exists(a, lambda k: key(k) == key(h)), a).otherwise(F.array_append(a, h)))


def planner_prompt(question: Column, step: int, max_steps: int, trace: Column, searched_doc: Column, searched_chat: Column, read: Column, chat_available: bool) -> Column:
    """Tools, rules, what was done and seen so far (400 characters of each observation), and the question."""
    tools = ["read_memory：查看对话摘要、硬事实与最近对话", "search_doc：检索文档，Action Input 填检索问句", "finish：信息已够，去回答"]
    rules = ["涉及文档的实体、数字、条款、页码时，至少 search_doc 一次", "信息够了就 finish；同一检索词不要重复", f"现在是第 {step}/{max_steps} 步"]
    if chat_available:
        tools.insert(1, "search_chat：检索已移出窗口的旧对话原文，Action Input 填检索问句")
    head = "\n".join(["为下面的问题选下一步工具。工具：", *(f"- {t}" for t in tools), "规则：", *(f"- {r}" for r in rules)])
    head += '\n只输出 JSON：{"thought":"...","action":"' + "|".join(a for a in ACTIONS if chat_available or a != "search_chat") + '","action_input":"..."}'
    yes = lambda c: F.when(c, "是").otherwise("否")
    done = F.concat(F.lit("已读记忆："), yes(read), F.lit("；已搜旧对话："), yes(searched_chat), F.lit("；已搜文档："), yes(searched_doc))
    line = lambda t, i: F.concat((i + 1).cast("string"), F.lit(". Thought: "), text(t["thought"]), F.lit("\n   Action: "), t["action"], F.lit("("), text(t["action_input"]), F.lit(")\n   Observation: "), F.substring(text(t["observation"]), 1, 400))
    steps = F.when(F.size(trace) == 0, "（尚无）").otherwise(F.array_join(F.transform(trace, line), "\n"))
    return F.concat(F.lit(head + "\n【问题】\n"), question, F.lit("\n【状态】\n"), done, F.lit("\n【已有步骤】\n"), steps, F.lit("\n下一步："))


def guarded(d: Column, question: Column, searched_doc: Column, searched_chat: Column, read: Column, chat_available: bool) -> Column:
    """A decision held to the rules: document facts need a search, recall needs none, chat only if it is there."""
    doc, memory, available = looks_like_doc_query(question), looks_like_memory_query(question), F.lit(chat_available)
    put = lambda d, action, given, note: F.struct(ws_trim(F.concat_ws("；", F.when(d["thought"] != "", d["thought"]), F.lit(note))).alias("thought"), action.alias("action"), given.alias("action_input"))
    own = lambda d: F.when(d["action_input"] != "", d["action_input"]).otherwise(question)
    first = lambda d: F.when(doc & ~searched_doc & (d["action"] != "search_doc"), put(d, F.lit("search_doc"), own(d), "护栏：文档向问题必须先检索")).otherwise(d)
    instead = F.when(memory & ~read, "read_memory").otherwise("finish")
    second = lambda d: F.when((d["action"] == "search_chat") & ~available, put(d, instead, d["action_input"], "护栏：无旧对话库")).otherwise(d)

    def third(d: Column) -> Column:
        off = (d["action"] == "search_doc") & memory & ~doc
        return (
            F.when(off & available & ~searched_chat, put(d, F.lit("search_chat"), own(d), "护栏：回顾类改搜旧对话"))
            .when(off & read & ~(available & ~searched_chat), put(d, F.lit("finish"), F.lit(""), "护栏：回顾类已读记忆，结束")).otherwise(d)
        )

    return let(let(let(d, first), second), third)


def _found(rows: DataFrame, search: SearchFn, key: str = "query_id") -> DataFrame:
    """key and found (array<HIT>, in rank order) of the rows' queries (column query), each in place of its question."""
    asked = rows.drop("question").withColumnRenamed("query", "question")
    hits = search(asked)
    have = set(hits.columns)
    hit = F.struct(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in (("text", "string"), ("page", "int"), ("source", "string"))))
    listed = hits.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("rank", hit.alias("h")))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["h"]).alias("found"))


def _with_found(rows: DataFrame, wanted: Column, search: SearchFn | None, into: str) -> DataFrame:
    """rows with the hits of their query where it is wanted; none elsewhere. A question's hits are at most a search's top k."""
    empty = F.array().cast(f"array<{HIT}>")
    if search is None:
        return rows.withColumn(into, empty)
    context = [c for c in rows.columns if c not in (*STATE, "query") and not c.startswith("__")]
    found = _found(rows.where(wanted).select(*context, "query"), search)
    return rows.join(found.withColumnRenamed("found", into), "query_id", "left").withColumn(into, F.coalesce(into, empty))


def _step(number: Column, thought: Column, action: Column, given: Column, observation: Column) -> Column:
    return F.struct(number.cast("int").alias("step"), thought.alias("thought"), action.alias("action"), given.alias("action_input"), observation.alias("observation"))


def run(questions: DataFrame, plan: Callable[[str], str], search_doc: SearchFn, search_chat: SearchFn | None = None, rewrite: Callable[[str], str] | None = None, max_steps: int = 2) -> DataFrame:
    """query_id and STATE of every question: what was searched and found, seen and decided.

    questions: query_id, question, and what the searches need (a document, a conversation, a
    vector); memory_facts, memory_summary and recent_turns if there are any. A search takes
    rows of these columns with its query as ``question`` and returns query_id, rank, text and,
    where known, page and source. Plain questions about document or talk take a fast path
    without the planner; the others take at most max_steps rounds over those still open. Each
    round is written, so that no planner is asked and no search made twice.
    """

    def of_model(model: Callable[[str], str]):
        @F.pandas_udf("string")
        def ask(prompts: pd.Series) -> pd.Series:
            def one(p):
                try:
                    return model(p) or ""
                except Exception:  # a model's failure is an empty answer: finish, or the question as it is
                    return ""

            return prompts.map(one, na_action="ignore")

        return ask

    none = lambda kind: F.array().cast(f"array<{kind}>")
    names = set(questions.columns)
    memory = memory_observation(*(F.col(c) if c in names else F.lit("") for c in ("memory_facts", "memory_summary", "recent_turns")))
    rows = questions.withColumn("question", ws_trim("question")).withColumn("path", route("question"))
    if rewrite is not None:
        better = ws_trim(of_model(rewrite)(F.when(needs_rewrite("question"), F.col("question"))))
        rows = rows.withColumn("__q", F.when(text(better) != "", better).otherwise(F.col("question")))
    else:
        rows = rows.withColumn("__q", F.col("question"))
    start = {
        "steps": F.lit(0), "doc_queries": none("string"), "chat_queries": none("string"), "hits": none(HIT), "chat_hits": none(HIT), "used_memory": F.lit(False),
        "memory_observation": F.lit(""), "finish_reason": F.lit(None).cast("string"), "trace": none(STEP),
    }
    rows = written(rows.withColumns({**start, "__read": F.lit(False), "__memory": memory}), "questions")

    fast_doc = _with_found(rows.where("path = 'fast_doc'").withColumn("query", F.col("__q")), F.lit(True), search_doc, "__found")
    fast_doc = fast_doc.withColumns({
        "doc_queries": F.array("query"), "hits": merged(F.col("hits"), F.col("__found")), "finish_reason": F.lit("fast_doc"),
        "trace": F.array(_step(F.lit(1), F.lit("快路径：文档向问题直接检索，跳过规划"), F.lit("search_doc"), F.col("query"), search_observation("__found"))),
    })
    recall = rows.where("path = 'fast_memory'").withColumn("query", F.col("question"))
    recall = _with_found(recall, F.lit(True), search_chat, "__found")
    look = _step(F.lit(1), F.lit("快路径：回顾类先读记忆"), F.lit("read_memory"), F.lit(""), F.col("__memory"))
    more = [] if search_chat is None else [_step(F.lit(2), F.lit("快路径：补检索旧对话"), F.lit("search_chat"), F.col("query"), search_observation("__found", NO_TURNS))]
    recall = recall.withColumns({
        "chat_queries": F.array("query") if more else none("string"), "chat_hits": merged(F.col("chat_hits"), F.col("__found")), "used_memory": F.lit(True),
        "memory_observation": F.col("__memory"), "finish_reason": F.lit("fast_memory"), "trace": F.array(look, *more),
    })

    live = rows.where("path = 'planner'")
    for step in range(1, max(1, max_steps) + 1):
        live = _round(live, of_model(plan), step, max(1, max_steps), search_doc, search_chat)
    # recall that never read the memory reads it now
    late = looks_like_memory_query("question") & ~F.col("__read")
    extra = _step(F.size("trace") + 1, F.lit("补读记忆供回顾类问题作答"), F.lit("read_memory"), F.lit(""), F.col("__memory"))
    live = live.withColumns({
        "finish_reason": F.coalesce("finish_reason", F.lit("max_steps")), "trace": F.when(late, F.array_append("trace", extra)).otherwise(F.col("trace")),
        "used_memory": F.col("used_memory") | late, "memory_observation": F.when(late, F.col("__memory")).otherwise(F.col("memory_observation")),
    })
    pick = lambda df: df.select("query_id", *STATE)
    return pick(fast_doc).unionByName(pick(recall)).unionByName(pick(live))


def _round(live: DataFrame, ask, step: int, max_steps: int, search_doc: SearchFn, search_chat: SearchFn | None) -> DataFrame:
    """The state after one more decision of the planner, for the questions without a finish_reason."""
    chat_available = search_chat is not None
    open_ = F.col("finish_reason").isNull()
    searched = [F.size(c) > 0 for c in ("doc_queries", "chat_queries")]
    prompt = planner_prompt(F.col("question"), step, max_steps, F.col("trace"), *searched, F.col("__read"), chat_available)
    rows = live.withColumn("__answer", ask(F.when(open_, prompt)))
    rows = rows.withColumn("__d", guarded(decision("__answer"), F.col("question"), *searched, F.col("__read"), chat_available))
    action = F.col("__d.action")
    given = F.when(ws_trim("__d.action_input") != "", ws_trim("__d.action_input")).otherwise(F.col("question"))
    rows = rows.withColumn("query", F.when((action == "search_doc") & (given == F.col("question")), F.col("__q")).otherwise(given))
    key = lambda c: F.lower(squeeze(c))
    again = lambda queries: F.exists(queries, lambda x: key(x) == key(F.col("query")))
    rows = rows.withColumn("__again", F.when(action == "search_doc", again("doc_queries")).when(action == "search_chat", again("chat_queries")).otherwise(F.lit(False)))
    rows = written(rows, "decisions")
    action, new = F.col("__d.action"), open_ & ~F.col("__again")
    rows = _with_found(rows, new & (action == "search_doc"), search_doc, "__doc")
    rows = _with_found(rows, new & (action == "search_chat"), search_chat, "__chat")
    read = action == "read_memory"
    seen = (
        F.when(read, F.col("__memory")).when((action == "search_doc") & F.col("__again"), F.concat(F.lit(REPEATED_DOC), F.col("query")))
        .when((action == "search_chat") & F.col("__again"), F.concat(F.lit(REPEATED_CHAT), F.col("query"))).when(action == "search_doc", search_observation("__doc"))
        .when(action == "search_chat", search_observation("__chat", NO_TURNS)).otherwise(ENDED)
    )
    hits = merged(F.col("hits"), F.col("__doc"))
    add = lambda c, on: F.when(new & on, F.array_append(c, F.col("query"))).otherwise(F.col(c))
    if_open = lambda value, c: F.when(open_, value).otherwise(F.col(c))
    changed = {
        "steps": if_open(F.lit(step), "steps"), "doc_queries": add("doc_queries", action == "search_doc"), "chat_queries": add("chat_queries", action == "search_chat"),
        "hits": hits, "chat_hits": merged(F.col("chat_hits"), F.col("__chat")), "used_memory": if_open(F.col("used_memory") | read | (F.size("__chat") > 0), "used_memory"),
        "memory_observation": if_open(F.when(read, F.col("__memory")).otherwise(F.col("memory_observation")), "memory_observation"), "__read": if_open(F.col("__read") | read, "__read"),
        "trace": if_open(F.array_append("trace", _step(F.lit(step), F.col("__d.thought"), action, F.col("__d.action_input"), seen)), "trace"),
        "finish_reason": if_open(F.when((action == "finish") | ((action == "search_doc") & (F.size(hits) > 0)), "finish"), "finish_reason"),
    }
    return written(rows.withColumns(changed).select(*live.columns), "round")
