"""SQL functions against the column functions that they stand beside."""

import pytest
from pyspark.sql import functions as F

from docloom.config import EMBED_INSTRUCTION
from docloom.functions import text as T
from docloom.operators import chunking as C
from docloom.operators import retrieval
from docloom.operators import sql_functions as S

TEXTS = [None, "", " \n", "short", "[错误：x", "x\n| a | b |\nend", "one. two! three, four " * 20, "a\n\nb" * 40, "x" * 200, "第一句。第二句！第三句？" * 10, "甲" * 25 + " " + "🙂é" * 25, "a\\Qb\\E$1 'q' " * 9, EMBED_INSTRUCTION + "q"]


@pytest.fixture()
def texts(spark):
    S.register(spark)
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    rows.createOrReplaceTempView("sql_texts")
    return rows


def test_texts_are_the_columns(spark, texts):
    got = spark.sql("SELECT i, docloom_trim(t), docloom_clip(t, 9), docloom_clip(t, 1), docloom_clip(t, 0), docloom_question(t), coalesce(docloom_read_error(t), true), docloom_strategy(t, 'pdf'), docloom_strategy(t, '.TXT') FROM sql_texts")
    want = texts.select("i", T.ws_trim("t"), T.clip("t", 9), T.clip("t", 1), T.clip("t", 0), T.query_for_embedding("t", EMBED_INSTRUCTION), T.is_read_error("t"), T.chunk_strategy("t", F.lit("pdf")), T.chunk_strategy("t", F.lit(".TXT")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("size, overlap, least", [(30, 0, 1), (30, 12, 8), (80, 40, 30), (1, 0, 0), (7, -2, 3)])
def test_cutting_is_the_columns(spark, texts, size, overlap, least):
    got = spark.sql(f"SELECT i, c.at, c.piece FROM sql_texts, LATERAL docloom_chunks(t, {size}, {overlap}, {least}) c").collect()
    rows = C.with_recursive_chunks(texts, "t", "c", size, overlap, least)
    assert sorted(map(tuple, got)) == sorted(map(tuple, T.exploded(rows, "c", "at", "piece", "i").collect()))
    got = spark.sql(f"SELECT i, w.at, w.piece FROM sql_texts, LATERAL docloom_windows(t, {size}, {overlap}) w").collect()
    want = T.exploded(texts, C.hard_cut(T.text("t"), size, overlap), "at", "piece", "i").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_cutting_is_a_projection(spark, texts):
    plan = spark.sql("SELECT i, c.at FROM sql_texts, LATERAL docloom_chunks(t, 300, 50, 90) c")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_whole_documents(spark, sf, texts):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = spark.sql("SELECT doc_id, c.at, c.piece FROM {d}, LATERAL docloom_chunks(text, 300, 50, 90) c", d=docs)
    want = T.exploded(C.with_recursive_chunks(docs, "text", "c"), "c", "at", "piece", "doc_id")
    assert got.count() > 0 and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("space", sorted(S.DISTANCES))
def test_search_is_the_columns(spark, texts, space):
    chunks = spark.createDataFrame([("a", i, [float(i % 3), 1.0, i / 7]) for i in range(9)] + [("a", 9, None), ("b", 0, [1.0, 0.0, 0.0]), (None, 0, [1.0, 1.0, 1.0])], "doc_id string, chunk_index int, embedding array<double>")
    asked = spark.createDataFrame([(1, "a", [1.0, 0.5, 0.0]), (2, "b", [0.0, 1.0, 0.0]), (3, "c", [1.0, 1.0, 1.0]), (4, None, [1.0, 1.0, 1.0]), (5, "a", None)], "query_id int, doc_id string, vector array<double>")
    chunks.createOrReplaceTempView("sql_chunks_of")
    asked.createOrReplaceTempView("sql_asked")
    S.register_search(spark, "sql_asked", "sql_chunks_of", "search_here", space)
    found = spark.sql("SELECT query_id, doc_id, chunk_index, distance, rank FROM search_here(4)")
    want = retrieval.knn(asked.where("vector IS NOT NULL").withColumnRenamed("vector", "q_embedding"), chunks.where("embedding IS NOT NULL"), space, 4)
    assert sorted(tuple(r)[:4] for r in found.collect()) == sorted(map(tuple, want.select("query_id", "doc_id", "chunk_index", "distance").collect()))
    assert [r.rank for r in found.where("query_id = 1").orderBy("rank").collect()] == [1, 2, 3, 4]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "WindowGroupLimit" in plan
