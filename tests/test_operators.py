import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from docloom.config import Config
from docloom.operators import agent, answers, catalog, cleanup, evaluation, global_search, layout, memory, retrieval, summaries
from docloom.operators.embedding import embedder


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, question string, chunk_index int, page int, text string, distance double, threshold double")


def test_threshold_keeps_what_passes_or_all(spark):
    df = hits(spark, [(1, "q", 0, 1, "a", 0.8, 0.35), (1, "q", 1, 2, "b", 0.1, 0.35), (2, "q", 0, 1, "a", 0.9, 0.35), (2, "q", 1, 1, "b", 0.8, 0.35)])
    out = retrieval.above_threshold(retrieval.fuse(df, "cosine")).select("query_id", "page").collect()
    assert sorted(map(tuple, out)) == [(1, 2), (2, 1), (2, 1)]


def test_dedupe_prefers_the_longer(spark):
    a, b = "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy dog again"
    df = spark.createDataFrame([(1, 1, a), (1, 2, b), (1, 3, "something else entirely"), (2, 1, a)], "query_id int, rank int, text string")
    out = sorted(map(tuple, retrieval.dedupe_hits(df).collect()))
    assert out == [(1, 1, b), (1, 2, "something else entirely"), (2, 1, a)]


def test_rerank_orders_by_logit(spark):
    df = spark.createDataFrame([(1, 1, 0.9, 0.0), (1, 2, 0.8, 2.0), (1, 3, 0.7, -1.0)], "query_id int, rank int, score double, logit double")
    out = retrieval.rerank(df, F.col("logit"), 2).orderBy("rank").collect()
    assert [r.logit for r in out] == [2.0, 0.0] and out[0].dense_score == 0.8
    assert retrieval.rerank(df, F.col("logit"), 3, min_score=0.99).count() == 3  # none passes: all stay


def test_search_end_to_end(spark):
    pages = [("d", 0, 1, "苹果的单价是十元"), ("d", 1, 2, "香蕉的产地是海南"), ("d", 2, 3, "交付日期是五月")]
    chunks = spark.createDataFrame(pages, "doc_id string, chunk_index int, page int, text string").withColumn("embedding", embedder()("text"))
    q = spark.createDataFrame([(1, "d", "香蕉的产地"), (2, "none", "x"), (3, "d", "  ")], "query_id int, doc_id string, question string")
    q = q.withColumn("q_embedding", embedder()("question"))
    out = retrieval.search(q, chunks, Config(), "cosine", fuzzy=True, dedupe=True).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in out} == {1} and out[0].page == 2 and out[0].score == 1.0


def test_fuzzy_boost_only_where_open(spark):
    df = spark.createDataFrame([(1, "abcdefghij", "abXdeYghZj"), (2, "abc", "zzzzzzzz")], "query_id int, question string, text string")
    got = {r.query_id: r.lexical_boost for r in retrieval.with_boost(df).collect()}
    assert 0.25 <= got[1] <= 0.3 and got[2] == 0.0


def test_document_text_marks_pages(spark):
    rows = [("d", 0, 1, "a", "pdf"), ("d", 1, 1, "b", "pdf"), ("d", 2, 0, "c", "pdf"), ("d", 3, 1, "d", "pdf"), ("d", 4, 2, "e", "pdf"), ("t", 0, 0, "x", "txt")]
    df = spark.createDataFrame(rows, "doc_id string, chunk_index int, page int, text string, source_ext string")
    got = {r.doc_id: r.text for r in retrieval.document_text(df).collect()}
    assert got == {"d": "【第1页】\na\nb\nc\nd\n【第2页】\ne", "t": "x"}


def test_observation_stops_at_the_budget(spark):
    rows = [(1, 1, "a" * 50), (1, 2, "  "), (1, 3, "b" * 50), (1, 4, "c")]
    df = spark.createDataFrame(rows, "query_id int, rank int, text string").withColumn("page", F.lit(0)).withColumn("source", F.lit(""))
    assert retrieval.observation(df, 100).first().observation == "【片段1】\n" + "a" * 50
    assert "【片段4】" in retrieval.observation(df, 1000).first().observation


def turns(spark, n, conv="c"):
    rows = [(conv, i, "user" if i % 2 == 0 else "assistant", f"{'u' if i % 2 == 0 else 'a'}{i // 2}") for i in range(n)]
    return spark.createDataFrame(rows, "conv_id string, turn int, role string, content string")


def test_windows_of_turns(spark):
    m = turns(spark, 16)
    assert [r.content for r in memory.recent(m, 6).orderBy("pos").collect()] == ["u5", "a5", "u6", "a6", "u7", "a7"]
    assert [r.content for r in memory.overflow(m, 6).orderBy("pos").collect()][0] == "u0"
    state = spark.createDataFrame([("c", 4)], "conv_id string, covered int")
    left = memory.overflow(m, 6, state).orderBy("pos").collect()
    assert [r.pos for r in left] == [4, 5, 6, 7, 8, 9] and {r.covered_after for r in left} == {10}
    assert memory.overflow(turns(spark, 4), 6, state).count() == 0


def test_roles_and_blanks_are_left_out(spark):
    df = spark.createDataFrame([("c", 0, "system", "x"), ("c", 1, "user", "  "), ("c", 2, "user", " hi ")], "conv_id string, turn int, role string, content string")
    assert [(r.pos, r.content) for r in memory.normalised(df).collect()] == [(0, "hi")]


def test_overflow_ids_are_stable(spark):
    a, b = (sorted(r.id for r in memory.overflow_records(turns(spark, 8), 4).collect()) for _ in range(2))
    assert a == b and len(a) == 4 and all(x.startswith("chat:c:") for x in a)


def test_facts_merge(spark):
    existing = "- 金额：100\n- 甲方：A"
    new = F.array(F.lit("[pinned] 金额：100"), F.lit("• 日期：五月"), F.lit("甲方： a"), F.lit(""))
    out = spark.range(1).select(memory.merged_facts(F.lit(existing), new)).first()[0]
    assert out == "- [pinned] 金额：100\n- 甲方：A\n- 日期：五月"
    short = spark.range(1).select(memory.merged_facts(F.lit("- aaaa\n- [pinned] bbbb\n- cccc"), F.array(F.lit("dddd")), 32)).first()[0]
    assert short == "- [pinned] bbbb\n- cccc\n- dddd"


def test_facts_and_summary_by_question(spark):
    df = spark.createDataFrame([(1, "苹果的价格", "- [pinned] 客户：甲\n- 香蕉的产地：海南\n- 苹果的价格：十元")], "k int, q string, f string")
    assert memory.relevant_facts(df, "k", "q", "f", 1).first().facts == "- [pinned] 客户：甲\n- 苹果的价格：十元"
    s = spark.createDataFrame([(1, "苹果", "先谈香蕉。再谈苹果。后谈天气。又谈苹果树。"), (2, "", "一。二。三。四。")], "k int, q string, s string")
    got = {r.k: r.summary for r in memory.relevant_summary(s, "k", "q", "s", 2).collect()}
    assert got == {1: "再谈苹果。又谈苹果树。", 2: "一。二。三。四。"}


def test_models_that_fail_fall_back(spark):
    def broken(prompt, tokens):
        raise RuntimeError("no model")

    df = spark.createDataFrame([("old", "new")], "p string, b string")
    assert df.select(memory.merged_summary(F.col("p"), F.col("b"), broken)).first()[0] == "old\nnew"
    assert df.select(memory.extracted_facts(F.col("b"), lambda p, n: "无")).first()[0] == []
    q = memory.rewritten_question(F.col("p"), F.lit(True), F.lit(True), F.col("b"), lambda p, n: "「完整的问题」")
    assert df.select(q).first()[0] == "完整的问题"


def test_repeated_lines_and_sentences(spark):
    text = "一、要点（第1页）\n一、 要点（第 2、3 页）\n\n\n内容。内容。别的。\n- 要点二\n* 要点二\n\n"
    out = cleanup.collapse_lines(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"))
    assert {r.doc_id: r.text for r in out.collect()} == {1: "一、要点（第1页）\n\n内容。别的。\n- 要点二", 2: ""}


def test_lines_by_the_rule(spark):
    cases = [
        ("A\n\nA\n\nB", "A\n\n\nB"),  # the repeat goes and ends the run of blank lines
        ("A\n\n\n\nB", "A\n\nB"), ("\n\n  A  \n\n", "  A"), ("A\r\nB\rA\n", "A\nB"), ("A\u3000\nB\u00a0", "A\nB"), (" \n ", " \n "), ("- \n*\nA", "A"),
        ("好。好。\n好。\n\n坏！坏！", "好。\n\n坏！"), ("x。\n\n\u2028\ny", "x。\n\ny"),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id int, text string")
    assert {r.doc_id: r.text for r in cleanup.collapse_lines(df).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_lines_in_a_row_as_in_python(spark):
    """Native work on ASCII against the Python that other texts go to."""
    import random

    r = random.Random(3)
    texts = ["".join(r.choice(["a", "b", "- a", "1. b", " ", "", "c  "]) + r.choice(["\n", "\n", "\n\n"]) for _ in range(r.randrange(30))) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    native = {x.doc_id: x.text for x in cleanup.collapse_lines(df).collect()}
    other = {x.doc_id: x.t for x in df.select("doc_id", cleanup._collapsed("text").alias("t")).collect()}
    assert {k: v for k, v in native.items() if texts[k].strip()} == {k: v for k, v in other.items() if texts[k].strip()}


def test_repetition(spark):
    df = spark.createDataFrame([(1, "a\na\nb\nc"), (2, "a\nb\nc"), (3, "a\nb\nc\nd\ne")], "doc_id int, text string")
    assert {r.doc_id: r.repetitive for r in cleanup.repetition(df).collect()} == {1: True, 2: False, 3: False}


def test_layout(spark):
    blocks = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(y).alias("y"), F.lit(x).alias("x")) for t, y, x in (("下面", 100.0, 0.0), ("右侧", 11.0, 50.0), ("上面", 10.0, 0.0))))
    assert spark.range(1).select(layout.reading_order(blocks)).first()[0] == "上面\n\n右侧\n\n下面"
    box = lambda *v: F.struct(*(F.lit(float(a)).alias(n) for a, n in zip(v, ("x0", "y0", "x1", "y1"))))
    kept = spark.range(1).select(layout.merged_regions(F.array(box(0, 0, 10, 10), box(0, 0, 10, 11), box(50, 0, 60, 10)))).first()[0]
    assert [(b.x0, b.y1) for b in kept] == [(0.0, 11.0), (50.0, 10.0)]
    df = spark.createDataFrame([("标题 一\n标题一\n\n\n正文内容很长很长\n正文内容",)], "t string")
    assert df.select(layout.dedupe_lines("t")).first()[0] == "标题 一\n\n正文内容很长很长"


def plain_distinct(text):
    from difflib import SequenceMatcher

    seen, out = [], []
    for line in text.splitlines():
        bare = "".join(line.split())
        if not bare:
            if out and out[-1]:
                out.append("")
        elif not any(bare in s or s in bare or SequenceMatcher(None, bare, s).ratio() >= 0.9 for s in seen):
            seen.append(bare)
            out.append(line.strip())
    return "\n".join(out).strip()


def test_distinct_lines_against_all_pairs():
    """Lines that equal, hold, are held by or resemble one another at every length, against comparing all with all."""
    import random

    r = random.Random(1)
    for _ in range(500):
        alphabet = r.choice(["ab", "abcde", "abcdefghijklmnop", "语文 ab"])
        lines = []
        for _ in range(r.randrange(1, 14)):
            x = list(r.choice(lines)) if lines and r.random() < 0.5 else [r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 18, 20, 24, 25, 27, 30, 34, 60, 120, 250]))]
            for _ in range(r.randrange(4)):
                at = r.randrange(len(x) + 1)
                x[at : at + r.randrange(2)] = [r.choice(alphabet)] * r.randrange(2)
            lines.append("".join(x) + r.choice(["", " "]))
        text = "\n".join(lines)
        assert layout._distinct_lines(text) == plain_distinct(text)


def test_lines_too_long_to_count():
    """Over 65535 characters, where counts of characters stop: equal, held, like and unlike lines."""
    long = ["ab" * 40_000, "ab" * 40_000 + "c", "ba" * 39_000 + "xyz", "abab", "q" * 70_000, "q" * 69_000 + "r" * 1000, "zy" * 36_000, "r" * 900]
    for text in ("\n".join(long), "\n".join(reversed(long)), "\n".join(x for x in long if len(x) > 1000)):
        assert layout._distinct_lines(text) == plain_distinct(text)


def test_a_page_of_long_lines_takes_ten_counts():
    """800 lines of 300 characters of one vocabulary, in at most ten times what counting their characters in a loop takes."""
    import random
    import time

    r = random.Random(2)
    some = ["".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randrange(2, 5))) for _ in range(60)]
    text = "\n".join(" ".join(r.choice(some) for _ in range(76)) for _ in range(800))
    began, counts = time.perf_counter(), {}
    for c in text:
        counts[c] = counts.get(c, 0) + 1
    plain, began = time.perf_counter() - began, time.perf_counter()
    assert layout._distinct_lines(text) == text
    assert time.perf_counter() - began < 10 * plain


def test_pages_are_dealt_before_their_lines_are_compared(spark, sf):
    from docloom.plans.queries import QUERIES

    plan = QUERIES["deduped_lines"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_COL" in plan.split("ArrowEvalPython")[1]


def test_new_lines_meet_few_old_ones(monkeypatch):
    """Of 3000 unlike lines hardly any two are compared."""
    import random

    r = random.Random(5)
    text = "\n".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(70)) for _ in range(3000))
    asked = []
    monkeypatch.setattr(layout, "_close", lambda a, b: asked.append(1) or False)
    assert layout._distinct_lines(text) == text and len(asked) < 100


def test_sections_and_summary(spark):
    pages = "\n".join(f"【第{i}页】\n" + f"内容{i}。" * 20 for i in range(1, 21))
    df = spark.createDataFrame([(1, "短文"), (2, pages), (3, "")], "doc_id int, text string")
    got = {r.doc_id: r.sections for r in summaries.with_sections(df, size=150, most=4).collect()}
    assert got[1] == ["短文"] and got[3] == [] and 2 <= len(got[2]) <= 4
    assert "【第1页】" in got[2][0] and "【第20页】" in got[2][-1]
    out = summaries.summarise(df, lambda p: p[:6], F.col("section"), lambda p: F.concat(F.lit("合并:"), p), size=150, most=4)
    assert {r.doc_id: r.summary for r in out.collect()} == {1: "短文", 2: "合并:1."}
    section = F.concat(F.lit("part "), F.col("no").cast("string"), F.lit("/"), F.col("total").cast("string"))
    silent = summaries.summarise(df, lambda p: "" if p.startswith("merge") else p[:8], section, lambda p: F.concat(F.lit("merge"), p), size=150, most=4, single_prompt=F.lit("alone"))
    got = {r.doc_id: r.summary for r in silent.collect()}
    assert got[1] == "alone" and got[2].split("\n")[0].startswith("part 1/") and "\n\n" not in got[2]


@pytest.mark.parametrize(
    "answer, want",
    [
        ('ok {"thought":"t","action":"SEARCH_DOC","action_input":"x"} end', ("t", "search_doc", "x")),
        ("Thought: think\nAction: read_memory", ("think", "read_memory", "")),
        ("Action: search_chat\nAction Input: 旧事\nThought: no", ("no", "search_chat", "旧事")),
        ("I would search_doc", ("", "search_doc", "")),
        ("", ("", "finish", "")),
        ("nothing", ("", "finish", "")),
    ],
)
def test_decisions(spark, answer, want):
    assert tuple(spark.range(1).select(agent.decision(F.lit(answer))).first()[0]) == want


def found(*rows):
    """A search that gives the rows (text, page) for queries with a word in them."""

    def search(q):
        spark = q.sparkSession
        hits = spark.createDataFrame([(w, i + 1, t, p) for i, (w, t, p) in enumerate(rows)], "word string, rank int, text string, page int")
        return q.join(hits, F.contains(q["question"], hits["word"])).select("query_id", "rank", "text", "page")

    return search


def asked(spark, *questions):
    return spark.createDataFrame([(i, q) for i, q in enumerate(questions, 1)], "query_id int, question string")


def test_agent_fast_paths(spark):
    def plan(prompt):
        raise AssertionError("the planner is not asked")

    q = asked(spark, "合同金额是多少", "我们之前聊了啥").withColumn("memory_facts", F.lit("- 甲方：A")).withColumn("recent_turns", F.lit("用户：hi"))
    out = {r.query_id: r for r in agent.run(q, plan, found(("合同", "金额十元", 2), ("合同", "金额十元", 2), ("合同", " ", 3)), found(("之前", "旧话", 0))).collect()}
    doc, talk = out[1], out[2]
    assert (doc.path, doc.finish_reason, doc.doc_queries, doc.steps) == ("fast_doc", "fast_doc", ["合同金额是多少"], 0)
    assert [(h.text, h.page) for h in doc.hits] == [("金额十元", 2)] and doc.trace[0].observation == "【片段1】 page=2\n金额十元\n\n【片段2】 page=2\n金额十元"
    assert (talk.path, talk.used_memory, talk.chat_queries) == ("fast_memory", True, ["我们之前聊了啥"])
    assert talk.memory_observation == "【硬事实】\n- 甲方：A\n\n【最近对话】\n用户：hi" and [(t.step, t.action) for t in talk.trace] == [(1, "read_memory"), (2, "search_chat")]
    alone = agent.run(q.drop("memory_facts", "recent_turns"), plan, found()).orderBy("query_id").collect()
    assert alone[0].trace[0].observation == agent.NO_HITS and alone[1].memory_observation == agent.NO_MEMORY and len(alone[1].trace) == 1


def test_agent_looks_at_what_it_found(spark):
    """The planner sees each round's observation and words its next query by it."""

    def plan(prompt):
        if "Observation: 【片段1】\nask for blue" in prompt:
            return '{"thought":"now blue","action":"search_doc","action_input":"blue"}'
        return '{"thought":"talk first","action":"search_chat","action_input":"hello"}'

    out = agent.run(asked(spark, "tell me"), plan, found(("blue", "it is blue", 4)), found(("hello", "ask for blue", 0)), max_steps=3).first()
    assert (out.steps, out.finish_reason, out.doc_queries, out.chat_queries) == (2, "finish", ["blue"], ["hello"])
    assert [h.text for h in out.hits] == ["it is blue"] and [h.text for h in out.chat_hits] == ["ask for blue"] and out.used_memory
    assert [(t.step, t.thought, t.action, t.action_input) for t in out.trace] == [(1, "talk first", "search_chat", "hello"), (2, "now blue", "search_doc", "blue")]


def test_agent_keeps_the_two_searches_apart(spark):
    """Words asked of the talk may be asked of the document; only the same search again is skipped, and the loop goes on."""

    def plan(prompt):
        step = prompt[prompt.index("第 ") + 2]
        return {"1": '{"action":"search_chat","action_input":"w w"}', "2": '{"action":"search_doc","action_input":"W w"}', "3": '{"action":"search_doc","action_input":"ww"}', "4": '{"action":"finish"}'}[step]

    out = agent.run(asked(spark, "hi"), plan, found(), found(("w", "x", 0)), max_steps=4).first()
    assert (out.chat_queries, out.doc_queries, out.steps, out.finish_reason) == (["w w"], ["W w"], 4, "finish")
    assert [t.observation for t in out.trace][1:] == [agent.NO_HITS, agent.REPEATED_DOC + "ww", agent.ENDED]
    short = agent.run(asked(spark, "hi"), plan, found(), found(("w", "x", 0)), max_steps=3).first()
    assert (short.steps, short.finish_reason) == (3, "max_steps")


def test_agent_guards(spark):
    """A document question is searched for before it may end, though the talk was searched; without a talk nothing searches it."""
    both = "我们之前说的合同金额"  # about document and talk: the planner's
    finish = lambda p: '{"action":"finish"}'
    out = agent.run(asked(spark, both), finish, found(("合同", "十元", 1)), found(("合同", "旧话", 0)), max_steps=3).first()
    assert [t.action for t in out.trace] == ["search_doc", "read_memory"] and "护栏" in out.trace[0].thought and out.used_memory
    chat = lambda p: '{"action":"search_chat"}'
    first = agent.run(asked(spark, both), chat, found(), found(("合同", "旧话", 0)), max_steps=1).first()
    assert [t.action for t in first.trace][0] == "search_doc"
    none = agent.run(asked(spark, "随便说说"), chat, found(), None, max_steps=2).first()
    assert [t.action for t in none.trace] == ["finish"] and none.chat_queries == []


def test_agent_models_that_fail(spark):
    def broken(prompt):
        raise RuntimeError("no model")

    out = agent.run(asked(spark, "hi"), broken, found(), rewrite=broken).first()
    assert (out.finish_reason, out.steps) == ("finish", 1)
    better = agent.run(asked(spark, "那金额呢"), broken, found(("合同", "十元", 1)), rewrite=lambda q: "合同的金额").first()
    assert better.doc_queries == ["合同的金额"] and better.hits[0].text == "十元"


def test_rerank_falls_back(spark):
    """A model that fails for a question leaves it its order; one that fails in a batch is asked pair by pair."""
    asked_pairs = []

    def make():
        def model(pairs):
            asked_pairs.append(len(pairs))
            if any(q == "bad" for q, _ in pairs):
                raise RuntimeError("no")
            return [float(len(t)) for _, t in pairs]

        return model

    rows = [(1, "good", 1, 0.9, 0.5, "a"), (1, "good", 2, 0.8, 0.4, "aaa"), (2, "bad", 1, 0.7, 0.3, "b"), (2, "bad", 2, 0.6, 0.2, "bbb")]
    df = spark.createDataFrame(rows, "query_id int, question string, rank int, score double, dense_score double, text string").coalesce(1)
    out = retrieval.rerank(df, retrieval.pair_scores(make)(F.col("question"), F.col("text")), 2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.text, r.dense_score) for r in out] == [(1, "aaa", 0.8), (1, "a", 0.9), (2, "b", 0.3), (2, "bbb", 0.2)] and out[2].score == 0.7

    def none():
        raise RuntimeError("no model at all")

    out = retrieval.rerank(df, retrieval.pair_scores(none)(F.col("question"), F.col("text")), 2).orderBy("query_id", "rank").collect()
    assert [r.text for r in out] == ["a", "aaa", "b", "bbb"]


def test_blank_chunks_are_no_hits(spark):
    chunks = spark.createDataFrame([("d", 0, "   ", [1.0, 0.0]), ("d", 1, "苹果", [0.0, 1.0])], "doc_id string, chunk_index int, text string, embedding array<double>").withColumn("page", F.lit(1))
    q = spark.createDataFrame([(1, "d", "香蕉", [1.0, 0.0])], "query_id int, doc_id string, question string, q_embedding array<double>")
    assert [(r["rank"], r.chunk_index) for r in retrieval.search(q, chunks, Config(), "cosine").collect()] == [(1, 1)]


def plain_nearest(questions, chunks, k, space):
    def distance(a, b):
        p = 0.0
        for x, y in zip(a, b, strict=True):
            p += x * y if space != "l2" else (x - y) * (x - y)
        return {"cosine": 1.0 - p, "ip": -p, "l2": p}[space]

    out = []
    for q, v in questions:
        near = sorted((distance(v, w), d, c) for d, c, w in chunks if w and len(w) == len(v))
        out += [(q, d, c, x) for x, d, c in near[:k]]
    return sorted(out)


@pytest.mark.parametrize("space", ["l2", "cosine", "ip"])
def test_global_search_by_definition(spark, space, monkeypatch):
    """Against all pairs: ties, equal vectors in crowds, odd lengths, null vectors, several blocks of questions and small tiles."""
    import random

    r = random.Random(8)
    vector = lambda: [r.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    same = vector()
    chunks = [(f"d{i % 7}", i, r.choice([vector(), same, None, [1.0], []])) for i in range(300)]
    asked = [(q, vector()) for q in range(25)]
    df = spark.createDataFrame(chunks, "doc_id string, chunk_index int, embedding array<double>").repartition(5)
    q = spark.createDataFrame(asked, "query_id int, q_embedding array<double>")
    monkeypatch.setattr(global_search, "TILE", (16, 3))
    for block in (10**9, 300):
        got = sorted(map(tuple, global_search.nearest(q, df, 6, space, block).collect()))
        assert got == plain_nearest(asked, chunks, 6, space)
    assert global_search.nearest(q, df.where("false"), 6, space).count() == 0 and global_search.nearest(q.where("false"), df, 6, space).count() == 0


def test_global_search_shuffles_its_answers_alone(spark):
    """No pairs and no chunks in a shuffle: the join below the windows is no join, and each task gives k rows a question."""
    chunks = spark.range(5000, numPartitions=4).select((F.col("id") % 9).alias("doc_id"), F.col("id").cast("int").alias("chunk_index"), F.array(F.rand(1), F.rand(2)).alias("embedding"))
    q = spark.range(3).select("id", F.array(F.lit(0.5), F.rand(3)).alias("q_embedding")).withColumnRenamed("id", "query_id")
    found = global_search.nearest(q, chunks, 5, "l2")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan and plan.count("Exchange") == 1
    assert found.count() == 15
    assert found.groupBy("query_id").count().where("count <> 5").count() == 0


def test_global_search_as_a_search(spark):
    pages = [("a", 0, 1, "苹果的单价是十元"), ("b", 0, 2, "香蕉的产地是海南"), ("c", 0, 1, "  "), ("d", 5, 3, "香蕉的产地是海南")]
    chunks = spark.createDataFrame(pages, "doc_id string, chunk_index int, page int, text string").withColumn("embedding", embedder()("text"))
    q = spark.createDataFrame([(1, "香蕉的产地"), (2, " ")], "query_id int, question string").withColumn("q_embedding", embedder()("question"))
    out = global_search.search_all(q, chunks, space="cosine").orderBy("rank").collect()
    assert [(r.query_id, r.doc_id, r.score) for r in out][:1] == [(1, "b", 1.0)]
    assert all(r.text.strip() for r in out) and [r.doc_id for r in out].count("d") == 0  # alike: the first of equal ones
    assert [r.doc_id for r in global_search.search_all(q, chunks, space="cosine", dedupe=False).orderBy("rank").collect()][:2] == ["b", "d"]


def test_search_reads_documents_once(spark, sf):
    """The plan of a search has one scan of the texts and one embedding of the chunks."""
    from docloom.plans.queries import QUERIES

    plan = QUERIES["search_with_dedupe"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    scans = [line for line in plan.splitlines() if "Relation [" in line and "n_chars" in line]
    assert len(scans) == 2 and plan.count("embed(") == 2  # the other scan is of ids, for the questions
    physical = QUERIES["search_with_dedupe"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert sum("text:string" in line and "doc_id" in line for line in physical.splitlines() if "ReadSchema" in line) == 1


def test_search_without_vectors(spark):
    """Chunks without vectors are found by wording, from all of the document's."""
    chunks = spark.createDataFrame([("d", 0, "苹果的单价是十元", None), ("d", 1, "香蕉的产地是海南", None)], "doc_id string, chunk_index int, text string, embedding array<double>").withColumn("page", F.lit(1))
    q = spark.createDataFrame([(1, "d", "香蕉的产地", [1.0, 0.0])], "query_id int, doc_id string, question string, q_embedding array<double>")
    out = retrieval.search(q, chunks, Config(), "cosine").orderBy("rank").collect()
    assert [r.chunk_index for r in out] == [1, 0] and out[0].score == out[0].lexical_boost == 0.55 and out[0].dense_score == 0.0
    pool, final = evaluation.pool_and_final(q, chunks, Config(), space="cosine")
    assert pool.count() >= final.count() == 2


def test_line_keys_by_unicodedata(spark):
    import re
    import unicodedata

    def key(line):
        s = unicodedata.normalize("NFKC", line)
        for p in (cleanup.INVISIBLE, cleanup.CITATION, r"\s+", cleanup.LIST_MARK):
            s = re.sub(p, "", s)
        return s

    lines = ["ＡＢＣ１", "ABC1", "ｱｲｳ アイウ", "ﬁne", "１、要点（第１页）", "①②", "a\u00a0b", "plain", "é", "e\u0301", "", "…"]
    df = spark.createDataFrame([(x,) for x in lines], "t string")
    assert [r.k for r in df.select(cleanup.line_key("t").alias("k")).collect()] == [key(x) for x in lines]
    out = cleanup.collapse_lines(spark.createDataFrame([(1, "ＡＢＣ１\nABC1\n别的。别的。\nﬁne\nfine")], "doc_id int, text string"))
    assert out.first().text == "ＡＢＣ１\n别的。\nﬁne"


def test_memory_compression(spark):
    state = spark.createDataFrame([("c", 2, "早先", "- 甲方：A"), ("gone", 3, "留着", "- x")], "conv_id string, covered int, memory_summary string, memory_facts string")
    answers = lambda p, n: "- 乙方：B" if n == 300 else ""
    got = {r.conv_id: tuple(r)[1:] for r in memory.compressed(turns(spark, 8), state, 4, answers).collect()}
    assert got["c"] == (4, "早先\n用户：u1\n助手：a1", "- 甲方：A\n- 乙方：B")
    assert got["gone"] == (0, "留着", "- x")
    same = memory.compressed(turns(spark, 3), state, 4).where("conv_id = 'c'").first()
    assert tuple(same) == ("c", 0, "早先", "- 甲方：A")


def test_many_facts_are_scored_by_vectors(spark):
    lines = "\n".join(f"- fact number {i}" for i in range(30))
    df = spark.createDataFrame([(1, "qq", lines + "\n- wanted"), (2, "qq", "- other\n- qq here")], "k int, q string, f string")

    def embed(c):
        return F.when(c.contains("wanted") | c.contains("qq"), F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0)))

    got = {r.k: r.facts for r in memory.relevant_facts(df, "k", "q", "f", 1, embed=embed).collect()}
    assert got == {1: "- wanted", 2: "- qq here"}


def test_answer_messages(spark):
    asked = spark.createDataFrame([(1, "c", "苹果？"), (2, "c", "说过什么")], "query_id int, conv_id string, question string")
    hits = spark.createDataFrame([(1, 1, 2, "甲" * 260), (1, 2, 3, "乙" * 260)], "query_id int, rank int, page int, text string")
    chat = spark.createDataFrame([(2, 1, " "), (2, 2, "旧话")], "query_id int, rank int, text string")
    state = spark.createDataFrame([("c", "- [pinned] 客户：甲", "")], "conv_id string, memory_facts string, memory_summary string")
    out = {r.query_id: r for r in answers.answer_messages(asked, hits, chat, turns(spark, 8), state, Config(final_doc_chars=500, final_recent_messages=2)).collect()}
    doc, talk = out[1], out[2]
    assert doc.with_doc and [(m.role, m.content) for m in doc.messages[1:4]] == [("system", "【相关硬事实】\n- [pinned] 客户：甲"), ("user", "u3"), ("assistant", "a3")]
    # cut at the end of the first block, not in the middle of the second
    assert doc.messages[4].content == "【文档片段】\n【片段1】\n" + "甲" * 260 + "…\n【用户问题】\n苹果？\n\n请给出完整答案："
    assert not talk.with_doc and talk.messages[1].content == "【相关硬事实】\n- [pinned] 客户：甲\n\n【相关历史对话】\n【旧对话2】\n旧话\n\n【用户问题】\n说过什么\n\n请根据以上材料回答："
    none = answers.answer_messages(asked.where("query_id = 2"), hits, chat.where("false"), turns(spark, 0), state.where("false")).first()
    assert none.messages[1].content.startswith(answers.NO_MEMORY + "\n\n【相关历史对话】\n" + answers.NO_CHAT)
    assert none.n_chars == sum(len(m.content) for m in none.messages)


def test_final_messages(spark):
    mem = spark.createDataFrame([("c", "苹果", "- [pinned] 客户：甲", "")], "conv_id string, question string, facts string, summary string")
    out = memory.final_messages(turns(spark, 8), mem, 2).first()
    assert [(m.role, m.content) for m in out.messages] == [("system", "【已确认硬事实】\n- [pinned] 客户：甲"), ("user", "u3"), ("assistant", "a3")]


def test_coverage_and_table_heads(spark):
    box = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("x1"), F.lit(5.0).alias("y1")))
    c = lambda b, w, h: spark.range(1).select(layout.image_coverage(b, F.lit(w), F.lit(h))).first()[0]
    assert (c(box, 10, 10), c(box, 1, 1), c(box, 0, 10), c(F.lit(None).cast("array<struct<x0:double,y0:double,x1:double,y1:double>>"), 1, 1)) == (0.5, 1.0, 0.0, 0.0)


def test_stale_files_and_blocks(spark):
    t = lambda h: dt.datetime(2024, 1, 30, h)
    rows = spark.createDataFrame([("a", t(1)), ("b", t(1)), ("c", t(23))], "path string, modificationTime timestamp")
    active = spark.createDataFrame([("b",)], "path string")
    assert [r.path for r in catalog.stale_files(rows, active, F.lit("2024-01-31 12:00:00").cast("timestamp")).collect()] == ["a"]
    lines = F.array(F.array(F.lit("a"), F.lit("b ")), F.array(F.lit(" ")), F.array(F.lit("c")))
    assert spark.range(1).select(layout.block_text(lines)).first()[0] == "ab\nc"
    ocr = F.array(*(F.struct(F.lit(t).alias("text"), F.lit(y).alias("y"), F.lit(0.0).alias("x")) for t, y in (("again", 50.0), ("again", 10.0), ("other words", 30.0))))
    assert spark.range(1).select(layout.ocr_text(ocr)).first()[0].split() == ["again", "other", "words"]


def test_null_ids_and_ties(spark):
    registry = spark.createDataFrame([("a", dt.datetime(2024, 1, 1))], "doc_id string, created_at timestamp")
    new = spark.createDataFrame([(None, dt.datetime(2024, 1, 2)), ("b", dt.datetime(2024, 1, 2))], "doc_id string, created_at timestamp")
    assert {r.doc_id for r in catalog.insert_or_ignore(registry, new).collect()} == {"a", "b"}
    rows = spark.createDataFrame([("k", 0)], "id string, v int")
    new = [("k", v, 1) for v in range(5)]
    got = {catalog.upsert(rows, spark.createDataFrame(list(x), "id string, v int, batch_no bigint")).first().v for x in (new, reversed(new))}
    assert len(got) == 1  # the same row of equal ones whatever their order


def test_cascade_counts(spark):
    a, b = spark.range(5), spark.range(2)
    got = {r.name: r.n_deleted for r in catalog.cascade_counts({"x": a, "y": b}, {"x": b, "y": b}).collect()}
    assert got == {"x": 3, "y": 0}


def test_catalog(spark):
    now = F.lit("2024-01-31 12:00:00").cast("timestamp")
    t = lambda h, s=0: dt.datetime(2024, 1, 31, h, 0, s)
    registry = spark.createDataFrame([("old", t(0)), ("edge", t(0)), ("new", t(0, 1)), ("", t(11))], "doc_id string, created_at timestamp")
    conversations = spark.createDataFrame([("c", "old"), ("e", None)], "id string, doc_id string")
    keep = catalog.keep_set(conversations, registry, now)
    assert {r.doc_id for r in keep.collect()} == {"old", "new"}
    stored = spark.createDataFrame([("old",), ("edge",), ("edge",), ("x",)], "doc_id string")
    assert {r.doc_id for r in catalog.orphans(stored, keep).collect()} == {"edge", "x"}
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, batch_no long")
    assert {tuple(r) for r in catalog.upsert(rows, new).collect()} == {("a", 1), ("b", 4), ("c", 5)}
    assert catalog.delete_documents(stored, spark.createDataFrame([("edge",), ("",)], "doc_id string")).count() == 2
    assert spark.range(1).select(catalog.last_page(F.lit(0)), catalog.last_page(F.lit(13))).first()[:] == (1, 3)


def test_put_conversations(spark):
    some = json.dumps([{"id": "1", "role": "user", "content": "x"}])
    old = spark.createDataFrame([("a", "[]", "s", "d", "n", "t", 1), ("z", some, "s", "", "", "t", 0)], "id string, messages string, summary string, doc_id string, document_name string, created_at string, memory_covered int")
    puts = [
        ("a", some, "new", "other", "name", "2020", 5),  # exists: summary, memory and messages; its document and time stay
        ("b", some, "given", None, None, "2020", None),  # new: takes its own summary and time
        ("c", "[]", "n", "doc", None, None, None),  # no messages, and a document without a name: skipped
        ("d", "[]", None, "doc", "paper", None, None),  # a draft with its document alone
        ("e", "oops", "n", "doc", "paper", None, None),  # no list: refused
        ("f", '{"id": "1"}', "n", "doc", "paper", None, None),
        ("z", "[]", "n", None, None, None, 9),  # nothing said and no document: skipped
    ]
    puts = spark.createDataFrame(puts, "id string, messages string, summary string, doc_id string, document_name string, created_at string, memory_covered int")
    got = {r.id: tuple(r)[1:] for r in catalog.upsert_conversations(old, puts, F.lit("now")).collect()}
    assert got == {
        "a": (some, "new", "d", "n", "t", 5), "b": (some, "given", "", "", "2020", 0), "d": ("[]", "", "doc", "paper", "now", 0), "z": (some, "s", "", "", "t", 0),
    }
    links = catalog.put_links(puts, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted((r.doc_id, r.conversation_id) for r in links) == [("doc", "d"), ("other", "a")]


def test_metrics_by_the_rule(spark):
    """Phrases as they stand, over all hits joined in rank order, against all phrases given."""
    cases = [(1, ["alpha beta"]), (2, ["x\ny"]), (3, ["gamma", "gamma", "delta"]), (4, [" pad ", ""]), (5, ["  "])]
    cases = spark.createDataFrame([(i, [], g) for i, g in cases], "query_id int, gold_pages array<int>, gold_contains array<string>")
    hits = [(1, 1, "alphabeta here"), (2, 2, "y second"), (2, 1, "first x"), (3, 1, "gamma"), (4, 1, "xpadx"), (4, 2, None), (5, 1, "any")]
    hits = spark.createDataFrame([(q, r, 1, t) for q, r, t in hits], "query_id int, rank int, page int, text string")
    got = {r.query_id: (r.text_recall, r.text_precision) for r in evaluation.metrics(cases, hits).collect()}
    assert got == {1: (0.0, 0.0), 2: (1.0, 0.0), 3: (pytest.approx(1 / 3), 1.0), 4: (1.0, 0.5), 5: (None, None)}


def test_cases_with_errors_and_settings(spark):
    cases = [(1, "d", "q", [1], None, "no", "yes"), (2, "d", " ", [1], None, None, None), (3, "gone", "q", [1], None, None, None), (4, "d", "q", [], [" "], None, None), (5, "d", "q", None, ["香蕉"], "maybe", None)]
    cases = spark.createDataFrame(cases, "query_id int, doc_id string, question string, gold_pages array<int>, gold_contains array<string>, use_rerank string, compare_rerank string")
    chunks = spark.createDataFrame([("d", 0, 1, "香蕉的产地是海南"), ("d", 1, 2, "苹果的单价是十元")], "doc_id string, chunk_index int, page int, text string").withColumn("embedding", embedder()("text"))
    said = {r.query_id: (r.error, r.use_rerank, r.compare_rerank) for r in evaluation.with_settings(evaluation.with_errors(cases, chunks)).collect()}
    assert said == {1: (None, False, True), 2: (evaluation.INCOMPLETE, True, False), 3: (evaluation.NO_VECTORS + "gone", True, False), 4: (evaluation.NO_GOLD, True, False), 5: (None, True, False)}
    out = evaluation.run_cases(cases.withColumn("q_embedding", embedder()("question")), chunks, space="cosine", reranker=lambda q, t: F.length(t).cast("double"))
    got = {r.query_id: r for r in out.collect()}
    assert {q for q, r in got.items() if r.error} == {2, 3, 4} and got[1].verdict in ("improve", "worse", "tie") and got[5].verdict is None
    assert got[1].page_recall == 1.0 and got[5].text_recall == 1.0 and got[2].page_recall is None


def test_metrics(spark):
    cases = spark.createDataFrame([(1, [1, 2], ["苹果"]), (2, [], ["x"])], "query_id int, gold_pages array<int>, gold_contains array<string>")
    found = spark.createDataFrame([(1, 1, 1, "有苹果"), (1, 2, 1, "没有"), (1, 3, 3, "一个苹果")], "query_id int, rank int, page int, text string")
    got = {r.query_id: r for r in evaluation.metrics(cases, found).collect()}
    assert (got[1].page_recall, got[1].page_precision, got[1].text_recall) == (0.5, pytest.approx(1 / 3), 1.0)
    assert got[1].text_precision == pytest.approx(2 / 3) and got[2].page_recall is None and got[2].text_precision == 0.0
    v = lambda *x: spark.range(1).select(evaluation.verdict(*map(F.lit, x))).first()[0]
    assert (v(0.5, 1.0, 0.5, 0.1), v(0.5, 0.5, 0.5, 0.4), v(0.5, 0.5, 0.5, 0.5)) == ("improve", "worse", "tie")
