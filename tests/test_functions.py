import difflib
import math

import pytest
from helpers import one
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docloom.config import Config, held
from docloom.functions import params, scores, tables
from docloom.functions import text as T


@pytest.mark.parametrize("n, want", [(0, 3), (8, 2), (12, 2), (13, 3), (40, 3), (60, 3), (61, 4), (200, 4), (201, 5), (300, 5)])
def test_top_k_by_size(spark, n, want):
    assert one(spark, params.top_k(F.lit(n))) == want


@pytest.mark.parametrize("asked, candidates, want", [(10, None, 5), (1, None, 2), (4, 2, 2), (3, 0, 0), (3, 1, 1)])
def test_top_k_asked(spark, asked, candidates, want):
    c = None if candidates is None else F.lit(candidates)
    assert one(spark, params.top_k(F.lit(50), F.lit(asked), c)) == want


@pytest.mark.parametrize("n, want", [(0, 15), (8, 8), (9, 9), (10, 10), (100, 15), (417, 50), (500, 50)])
def test_recall_k(spark, n, want):
    assert one(spark, params.recall_k(F.lit(n), F.lit(3))) == want


def test_recall_k_asked(spark):
    assert one(spark, params.recall_k(F.lit(100), F.lit(3), F.lit(7))) == 7


@pytest.mark.parametrize("n, rerank, want", [(100, False, 0.35), (3, False, 0.05), (100, True, 0.12), (10, True, 0.05), (11, False, 0.35)])
def test_threshold(spark, n, rerank, want):
    assert one(spark, params.score_threshold(F.lit(n), F.lit(0.35), F.lit(rerank))) == want


@pytest.mark.parametrize("d, space, want", [(0.0, "cosine", 1.0), (0.2, "cosine", 0.8), (0.0, "l2", 1.0), (0.5, "l2", 0.875), (-0.7, "ip", 0.7), (3.0, "l2", 0.0)])
def test_score_from_distance(spark, d, space, want):
    assert one(spark, params.score_from_distance(F.lit(d), space)) == pytest.approx(want)


@pytest.mark.parametrize("n, cover, want", [(100, 0.9, False), (0, 0.8, True), (5, 0.6, True), (0, 0.0, False), (1, 0.05, False)])
def test_needs_ocr(spark, n, cover, want):
    assert one(spark, params.needs_ocr(F.lit(n), F.lit(cover))) is want


def test_sigmoid(spark):
    for x in (-800.0, -1.0, 0.0, 2.0, 800.0):
        want = 1 / (1 + math.exp(-x)) if x > -700 else 0.0
        assert one(spark, params.sigmoid(F.lit(x))) == pytest.approx(want)


def test_clip(spark):
    assert one(spark, T.clip(F.lit("abcdefghij"), 5)) == "abcd…"
    assert one(spark, T.clip(F.lit("　abc \n"), 5)) == "abc"
    assert one(spark, T.clip(F.lit("abc"), 1)) == "…"
    assert one(spark, T.clip(F.lit(None).cast("string"), 5)) == ""


def test_trim_blocks(spark):
    assert one(spark, T.trim_blocks(F.lit("aaaa\n\nbbbb cccc"), 10)) == "aaaa…"
    assert one(spark, T.trim_blocks(F.lit("aaaaaa\n\nbbbb"), 10)) == "aaaaaa…"


def test_read_error(spark):
    assert one(spark, T.is_read_error(F.lit("[PDF解析错误: x]")))
    assert one(spark, T.is_read_error(F.lit(" 　\n")))
    assert not one(spark, T.is_read_error(F.lit("[重要] 内容")))


def test_facts(spark):
    assert one(spark, T.fact_lines(F.lit("- a\n• b\n\n* [pinned] C d\n– e"))) == ["a", "b", "[pinned] C d", "e"]
    assert one(spark, T.fact_key(F.lit(" [PINNED] C d"))) == "cd"


def test_table_markdown(spark):
    rows = F.array(F.array(F.lit("a"), F.lit("b\nc")), F.array(F.lit(None).cast("string"), F.lit(" ")), F.array(F.lit("x")))
    assert one(spark, tables.table_markdown(rows)) == "| a | b c |\n| --- | --- |\n| x |  |"
    assert one(spark, tables.table_markdown(F.array().cast("array<array<string>>"))) == ""


def test_html_table(spark):
    html = "<TABLE><tr><th>A</th><td>1 &lt; 2</td></tr><tr><td>b &amp; <b>c</b></td><td></td></tr></TABLE>"
    assert one(spark, tables.html_table_markdown(F.lit(html))) == "| A | 1 < 2 |\n| --- | --- |\n| b & c |  |"
    assert one(spark, tables.html_table_markdown(F.lit("<tr><td>a</td></tr>"))) == ""


def test_ocr_lines_against_cells(spark):
    out = one(spark, tables.without_table_lines(F.lit("标题\n甲 方\n甲方\n备注\n\n100"), F.lit("| 甲 方 | 100 |\n|---|---|\n| x | y |")))
    assert out == "标题\n备注"


def test_lexical_boost_tiers(spark):
    b = lambda q, t: one(spark, scores.lexical_boost(F.lit(q), F.lit(t)))
    assert b("单价 是多少", "合同单价是多少元") == 0.55
    assert b("合同，单价？", "合同单价 100") == 0.5
    assert b("abcdefgh", "xx abcdef yy") == 0.35
    assert b("", "x") == 0.0
    assert b("abc", "xyz") is None


def _bigrams(q, t):
    q, t = "".join(q.lower().split()), "".join(t.lower().split())
    if not q or not t:
        return 0.0
    if q in t or t in q:
        return 0.95
    a, b = ({x[i : i + 2] for i in range(len(x) - 1)} or {x} for x in (q, t))
    return len(a & b) / len(a)


WORDS = st.text(alphabet="abcAB 　\n中文é", max_size=12)


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(q=WORDS, t=WORDS)
def test_bigram_score(spark, q, t):
    assert one(spark, scores.bigram_score(F.lit(q), F.lit(t))) == pytest.approx(_bigrams(q, t))


def test_config_is_held():
    c = Config.from_env({"DOCLOOM_HISTORY_TURNS": "99", "DOCLOOM_CHUNK_SIZE": "5", "DOCLOOM_RECALL_CAP": "x"})
    assert (c.history_turns, c.keep_messages, c.chunk_size, c.recall_cap) == (6, 12, 100, 50)
    assert held("history_turns", 2) == 4


def test_alike_matches_sequence_ratio():
    from docloom.operators.retrieval import Kept

    for a, b in [("abcdefgh", "abcdefgx"), ("abc", "xyz"), ("a" * 300, "a" * 150 + "b" * 150)]:
        assert Kept(b).like(a, 0.72) == (a in b or b in a or difflib.SequenceMatcher(None, a, b).ratio() >= 0.72)


@pytest.mark.parametrize(
    "said, want",
    [
        ("This operation was aborted", "请求已取消"), ("fetch failed", "无法连接 AI 服务，请确认服务已启动"), ("摘要接口返回 502", "摘要服务异常"), ("embedding failed: 500", "文档处理服务异常"),
        ("问答 (503)", "问答服务异常"), ("error code: 7", "服务异常，请稍后重试"), ("some english", "服务异常，请稍后重试"), (None, "服务异常，请稍后重试"), ("  ", "服务异常，请稍后重试"),
        ("缺少 doc_id  参数", "缺少 参数"), ("第 300 行太长", "第 300 行太长"), ("文件不存在", "文件不存在"),
    ],
)
def test_client_errors(spark, said, want):
    assert one(spark, T.client_error(F.lit(said).cast("string"))) == want


def test_numbered_tables_and_entities(spark):
    rows = F.array(F.array(F.array(F.lit("a"), F.lit(None).cast("string"))), F.array(F.array(F.lit(""))), F.array(F.array(F.lit("b"))))
    assert one(spark, tables.headed_tables(rows)) == "【表格 1】\n| a |  |\n| --- | --- |\n\n【表格 3】\n| b |\n| --- |".replace("|\n\n", "|\n\n")
    html = "<TABLE><tr><td>a &lt;b&gt;x&lt;/b&gt; &eacute;&hellip;&#8364;</td><td>1 &lt; 2 &amp;amp;</td></tr></TABLE>"
    assert one(spark, tables.html_table_rows(F.lit(html))) == [["a x é…€", "1 < 2 &amp;"]]
    assert one(spark, tables.headed_markdown(F.array(F.lit(""), F.lit("| x |")))) == "【图像表格 2】\n| x |"


def test_words_for_true_and_false(spark):
    got = [one(spark, T.as_bool(F.lit(w), True)) for w in ("否", "OFF ", "0", "关", "maybe")] + [one(spark, T.as_bool(F.lit(w))) for w in ("是", "Yes", "开")]
    assert got == [False, False, False, True, True, True, True, False]


def test_small_measures(spark):
    box = F.array(*(F.lit(float(v)) for v in (0, 0, 5, 4)))
    assert [one(spark, params.area_ratio(box, F.lit(a))) for a in (40.0, 10.0, 0.0)] == [0.5, 1.0, 0.0]
    assert one(spark, params.progress(F.lit(3), F.lit(4), 10, 40)) == 40 and one(spark, params.progress(F.lit(0), F.lit(0), 10, 40)) == 10
    said = lambda n, m: one(spark, T.pdf_error(F.lit(n), F.lit(m)))
    assert "加密" in said("E", "needs Password") and "损坏" in said("XrefError", "x") and said("E", "other") == "[PDF解析错误: other]"
