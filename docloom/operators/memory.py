"""Conversation memory: windows over turns, overflow ids, facts and their retrieval."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import EMBED_INSTRUCTION
from docloom.functions.scores import bigram_score, dot
from docloom.functions.text import clip, exploded, fact_key, fact_lines, fact_text, is_pinned, query_for_embedding, sentences, stable_id, text, turn_line, ws_trim

#: (prompt, most tokens) -> answer
ChatFn = Callable[[str, int], str]

#: Up to so many lines are scored by wording alone.
BY_WORDING = 24
#: Answers that mean that there are no facts. Fixed values.
NO_FACTS = ("无", "（无）", "无。", "暂无", "没有")


def normalised(messages: DataFrame) -> DataFrame:
    """Turns of user and assistant with a text, numbered from 0 in each conversation (pos), and the number of them (n)."""
    rows = messages.where(F.col("role").isin("user", "assistant") & (ws_trim("content") != "")).withColumn("content", ws_trim("content"))
    by = Window.partitionBy("conv_id")
    return rows.withColumn("pos", F.row_number().over(by.orderBy("turn", "role", "content")) - 1).withColumn("n", F.count("*").over(by))


def recent(messages: DataFrame, keep: int) -> DataFrame:
    """The last keep turns."""
    return normalised(messages).where(F.col("pos") >= F.col("n") - keep)


def overflow(messages: DataFrame, keep: int, state: DataFrame | None = None) -> DataFrame:
    """Turns before the last keep that the state (conv_id, covered) hasn't covered yet; covered_after is the new state.

    A conversation of at most keep turns starts anew from 0.
    """
    rows = normalised(messages)
    if state is not None:
        rows = rows.join(state.select("conv_id", "covered"), "conv_id", "left")
    else:
        rows = rows.withColumn("covered", F.lit(0))
    end = F.greatest(F.col("n") - keep, F.lit(0))
    rows = rows.withColumn("covered", F.greatest(F.least(F.coalesce("covered", F.lit(0)), end), F.lit(0))).withColumn("covered_after", end)
    return rows.where((F.col("pos") >= F.col("covered")) & (F.col("pos") < end))


def overflow_records(messages: DataFrame, keep: int, state: DataFrame | None = None) -> DataFrame:
    """What is stored of overflowing turns: a stable id, so that storing twice changes nothing, and a labelled text."""
    rows = overflow(messages, keep, state).where(ws_trim(F.col("conv_id").cast("string")) != "")
    conversation = F.col("conv_id").cast("string")
    return rows.select("conv_id", F.col("pos").cast("int").alias("msg_index"), "role", stable_id(conversation, F.col("pos"), F.col("role"), F.col("content")).alias("id"), turn_line(F.col("role"), F.col("content")).alias("text"))


def turns_text(messages: DataFrame) -> DataFrame:
    rows = normalised(messages).select("conv_id", "pos", turn_line(F.col("role"), F.col("content")).alias("line"), F.length("content").alias("chars"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("l"), F.sum("chars").alias("n_chars"))
    return out.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("turns"), "n_chars")


def merged_facts(existing: Column, new: Column, max_chars: int = 2000) -> Column:
    """Text of existing facts with new lines (array) added: the first of a key stays, but gets pinned if a new one is.

    Over the limit pinned ones come first and the oldest others go; then the text is cut.
    """
    keyed = lambda a: F.transform(a, lambda x: F.struct(fact_key(x).alias("k"), x.alias("x"), is_pinned(x).alias("p")))
    old = keyed(fact_lines(existing))
    fresh = F.filter(keyed(F.transform(new, lambda x: ws_trim(F.regexp_replace(ws_trim(x), r"^(- |• |\* |· )", "")))), lambda s: s["k"] != "")

    def step(done: Column, f: Column) -> Column:
        known = F.exists(done, lambda d: d["k"] == f["k"])
        pinned = F.transform(done, lambda d: F.when((d["k"] == f["k"]) & f["p"] & ~d["p"], f).otherwise(d))
        return F.when(known, pinned).otherwise(F.concat(done, F.array(f)))

    every = F.aggregate(fresh, old, step)
    return _within(every, max_chars)


def _within(facts: Column, max_chars: int) -> Column:
    pinned = lambda a: F.filter(a, lambda f: f["p"])
    line = lambda a: fact_text(F.transform(a, lambda f: f["x"]))

    def shortest(a: Column) -> Column:
        normal = F.filter(a, lambda f: ~f["p"])
        start = F.struct(F.concat(pinned(a), normal).alias("left"), F.size(pinned(a)).alias("at"))

        def drop(s: Column, _: Column) -> Column:
            less = F.concat(F.slice(s["left"], F.lit(1), s["at"]), F.slice(s["left"], s["at"] + 2, F.size(s["left"])))
            return F.when(F.length(line(s["left"])) > max_chars, F.struct(less.alias("left"), s["at"].alias("at"))).otherwise(s)

        return F.aggregate(normal, start, drop, lambda s: F.substring(line(s["left"]), 1, max_chars))

    return F.when(F.length(line(facts)) <= max_chars, line(facts)).otherwise(shortest(facts))


def with_scores(units: DataFrame, key: str, question: str, unit: str, embed: Callable[[Column], Column] | None = None, most: int = BY_WORDING) -> DataFrame:
    """Adds score, how like the question a unit is: by wording; by vectors (embed: text -> vector) where the key has over ``most`` units."""
    wording = F.when(F.col(question) == "", 0.0).otherwise(bigram_score(question, unit))
    if embed is None:
        return units.withColumn("score", wording)
    units = units.withColumn("__many", F.count("*").over(Window.partitionBy(key)) > most)
    many = F.col("__many") & (F.col(question) != "")
    # blank texts are cheap to the model: only what is scored by vectors goes there
    units = units.withColumn("__q", embed(F.when(many, query_for_embedding(question, EMBED_INSTRUCTION)).otherwise(""))).withColumn("__u", embed(F.when(many, F.col(unit)).otherwise("")))
    return units.withColumn("score", F.when(many, dot(F.col("__q"), F.col("__u"))).otherwise(wording)).drop("__many", "__q", "__u")


def relevant_facts(rows: DataFrame, key: str, question: str, facts: str, k: int = 5, max_chars: int = 600, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, facts: pinned lines and the k others most like the question, in that order, once each."""
    lines = exploded(rows, fact_lines(facts), "at", "line", key, ws_trim(question).alias("q"))
    lines = with_scores(lines.withColumn("pinned", is_pinned("line")), key, "q", "line", embed)
    best = F.row_number().over(Window.partitionBy(key, "pinned").orderBy(F.desc("score"), "at"))
    lines = lines.withColumn("no", best).where(F.col("pinned") | (F.col("no") <= k))
    lines = lines.withColumn("place", F.when(F.col("pinned"), F.col("at")).otherwise(F.col("no")))
    first = F.row_number().over(Window.partitionBy(key, "fact").orderBy(F.desc("pinned"), "place"))
    lines = lines.withColumn("fact", F.when(F.col("q") == "", F.col("at").cast("string")).otherwise(fact_key("line"))).withColumn("once", first).where("once = 1")
    out = lines.groupBy(key).agg(F.sort_array(F.collect_list(F.struct((~F.col("pinned")).alias("o"), "place", "line"))).alias("l"))
    picked = out.select(key, clip(fact_text(F.transform("l", lambda x: x["line"])), max_chars).alias("facts"))
    return rows.select(key).distinct().join(picked, key, "left").select(key, F.coalesce("facts", F.lit("")).alias("facts"))


def relevant_summary(rows: DataFrame, key: str, question: str, summary: str, n: int = 3, max_chars: int = 500, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """key, summary: the n sentences most like the question in their own order; a short summary whole."""
    units = rows.select(key, ws_trim(question).alias("q"), ws_trim(summary).alias("s"))
    units = exploded(units, sentences("s"), "at", "unit", "*").withColumn("units", F.count("*").over(Window.partitionBy(key)))
    best = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), "at"))
    picked = with_scores(units.where((F.col("units") > n) & (F.col("q") != "")), key, "q", "unit", embed).withColumn("no", best).where(F.col("no") <= n)
    ended = F.when(F.right("unit", F.lit(1)).isin("。", "！", "？", ";", "；"), F.col("unit")).otherwise(F.concat("unit", F.lit("。")))
    out = picked.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("at", ended.alias("u")))).alias("l"))
    out = out.select(key, clip(F.regexp_replace(F.array_join(F.transform("l", lambda x: x["u"]), ""), "。{2,}", "。"), max_chars).alias("__picked"))
    return rows.join(out, key, "left").select(key, F.coalesce("__picked", clip(summary, max_chars)).alias("summary"))


def _chat(chat_fn: ChatFn, tokens: int):
    @F.pandas_udf("string")
    def ask(prompts: pd.Series) -> pd.Series:
        def one(p):
            try:
                return (chat_fn(p, tokens) or "").strip()
            except Exception:  # a model's failure is an empty answer; callers fall back
                return ""

        return prompts.map(one)

    return ask


def extracted_facts(prompt: Column, chat_fn: ChatFn, tokens: int = 300) -> Column:
    """Fact lines (array) of a model's answer; none for an answer that says so, or a failure."""
    answer = _chat(chat_fn, tokens)(prompt)
    return F.when(ws_trim(answer).isin(*NO_FACTS), F.array().cast("array<string>")).otherwise(fact_lines(answer))


def merged_summary(previous: Column, block: Column, chat_fn: ChatFn | None = None, max_chars: int = 1200, prompt: Column | None = None) -> Column:
    """A model's merge of both; without one, or without an answer, one under the other."""
    both = F.when(ws_trim(previous) == "", block).otherwise(ws_trim(F.concat(ws_trim(previous), F.lit("\n"), block)))
    if chat_fn is None:
        return F.substring(both, 1, max_chars)
    answer = _chat(chat_fn, 400)(prompt if prompt is not None else both)
    return F.substring(F.when(answer == "", both).otherwise(answer), 1, max_chars)


def compressed(messages: DataFrame, state: DataFrame, keep: int, chat_fn: ChatFn | None = None, facts_chars: int = 2000, summary_chars: int = 1200, facts_prompt=None, summary_prompt=None) -> DataFrame:
    """The state (conv_id, covered, memory_summary, memory_facts) after what has left the window since goes into summary and facts.

    A conversation without new overflow keeps its summary and facts. The prompts are functions
    of columns, (facts so far, block) and (summary so far, block); chat_fn's failures leave the
    block itself in the summary and add no facts. The overflowing turns' records for later
    search are ``overflow_records`` with the same state.
    """
    new = overflow(messages, keep, state)
    block = new.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", turn_line(F.col("role"), F.col("content")).alias("line")))).alias("l"))
    block = block.select("conv_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("__block"))
    ends = normalised(messages).groupBy("conv_id").agg(F.greatest(F.max("n") - keep, F.lit(0)).cast("int").alias("__end"))
    rows = ends.join(state, "conv_id", "full").join(block, "conv_id", "left")
    facts, summary, more = text("memory_facts"), text("memory_summary"), F.col("__block")
    if chat_fn is None:
        new_facts = facts
    else:
        prompt = facts_prompt(facts, more) if facts_prompt else more
        new_facts = merged_facts(facts, extracted_facts(F.when(more.isNotNull(), prompt).otherwise(""), chat_fn), facts_chars)
    new_summary = merged_summary(summary, text("__block"), chat_fn, summary_chars, summary_prompt(summary, more) if summary_prompt else None)
    some = more.isNotNull()
    return rows.select(
        "conv_id", F.coalesce("__end", F.lit(0)).alias("covered"), F.when(some, new_summary).otherwise(summary).alias("memory_summary"), F.when(some, new_facts).otherwise(facts).alias("memory_facts")
    )


def rewritten_question(question: Column, needs: Column, has_context: Column, prompt: Column, chat_fn: ChatFn) -> Column:
    """A model's standalone question where one is needed; blank or over 500 characters keeps the old one."""
    answer = F.regexp_replace(_chat(chat_fn, 120)(F.when(needs & has_context, prompt).otherwise("")), "^[「」\"'\\s]+|[「」\"'\\s]+$", "")
    return F.when(needs & has_context & (answer != "") & (F.length(answer) <= 500), answer).otherwise(ws_trim(question))


def final_turns(messages: DataFrame, keep: int = 4, chars: int = 200) -> DataFrame:
    """The last keep turns, each clipped."""
    return recent(messages, keep).withColumn("content", clip("content", chars))


def final_messages(messages: DataFrame, memory: DataFrame, keep: int = 4, chars: int = 200, embed: Callable[[Column], Column] | None = None) -> DataFrame:
    """prompt_messages for the answer itself: the facts and sentences that bear on the question, and the last turns clipped.

    memory: conv_id, question, facts, summary.
    """
    facts = relevant_facts(memory, "conv_id", "question", "facts", embed=embed)
    both = facts.join(relevant_summary(memory, "conv_id", "question", "summary", embed=embed), "conv_id")
    return prompt_messages(final_turns(messages, keep, chars), both)


def prompt_messages(turns: DataFrame, memory: DataFrame) -> DataFrame:
    """conv_id, messages: facts, then summary (conv_id, facts, summary), then turns; blank parts left out."""
    system = lambda c, n, head: memory.where(ws_trim(c) != "").select("conv_id", F.lit(n).cast("bigint").alias("no"), F.lit("system").alias("role"), F.concat(F.lit(head), ws_trim(c)).alias("content"))
    every = system("facts", -2, "【已确认硬事实】\n").unionByName(system("summary", -1, "【对话摘要】\n")).unionByName(turns.select("conv_id", F.col("pos").cast("bigint").alias("no"), "role", "content"))
    return every.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("no", "role", "content"))), lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
