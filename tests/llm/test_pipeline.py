import os
from collections import Counter

import duckdb
import pytest

import corpus_pipeline as C
from docloom.llm import decontaminate, language, lines, oracle_sql, packing, queries


def test_stages_keep_their_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in C.STAGES[:-1]:
        docs = C.materialise(stage(spark, docs, sf), name)
        assert docs.columns == columns, name
    assert 0 < docs.count() <= 200


def test_stages_by_their_operators(spark, sf):
    """Each stage's effect against its operator's own result."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    one = C.known_language(spark, docs, sf)
    pred = language.classify(docs, language.fit(docs))
    assert ids(one) == ids(pred.where("lang_pred <> 'und' AND score >= 0.5"))
    two = C.without_repeated_lines(spark, docs, sf)
    clean = {r.doc_id: (r.text, r["__removed_words"]) for r in lines.deduplicated(docs).collect()}
    stays = lambda t, gone: gone == 0 or (n := len(t.split())) and n >= C.LEAST_LEFT * (n + gone)
    assert {r.doc_id: (r.text, r.n_chars) for r in two.collect()} == {d: (t, len(t)) for d, (t, gone) in clean.items() if stays(t, gone)}
    three = C.one_of_near_copies(spark, docs, sf)
    assert ids(three) == first_of_near_copies([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    four = C.without_benchmark(spark, docs, sf)
    assert ids(four) == ids(decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("NOT contaminated"))


def first_of_near_copies(rows):
    """The first id of each group whose texts are linked by a Jaccard similarity of 0.8 of five-word shingles, pair by pair."""

    def shingles(text):
        w = (text or "").encode().lower().split()
        return {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rows = sorted(rows)
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [rows[i][0] for i in range(len(rows)) if top(i) == i]


def test_stages_on_odd_rows(spark, odd):
    """Null and repeated ids and texts, long texts and clashing columns through all stages but the first, whose model finds no second language here."""
    bench = spark.createDataFrame([(1, "the same words again")], "item_id bigint, text string")
    columns = [*odd.columns, "__row", "doc", "key"]
    docs = odd.selectExpr("*", "1 AS __row", "2 AS doc", "'k' AS key")
    by = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    first = C.known_language(spark, docs, "")
    assert first.columns == columns and by(first).keys() <= by(docs).keys() and {r.key for r in first.collect()} == {"k"}
    two = C.without_repeated_lines(spark, docs, "")
    assert two.columns == columns and by(two)[2, "head line"] == 0 and by(two)[None, None] == 1 and by(two)[4, ""] == 1
    assert by(two)[1, by_id(odd, 1)] == 2
    three = C.one_of_near_copies(spark, docs, "")
    assert three.columns == columns and [r.doc_id for r in three.collect()].count(1) == 1
    assert sorted(r.doc_id for r in three.collect() if r.doc_id in (3, 4, 7)) == [3]  # texts without words are copies of each other
    four = C.decontaminate.clean(docs, bench)
    assert four.columns == columns and four.count() == docs.count() - 2
    five = C.packed(spark, docs, "")
    assert five.count() >= docs.count()


def by_id(df, i):
    return df.where(f"doc_id = {i}").first().text


def test_stumps_go(spark):
    """A document that keeps under a fifth of its words is a copy of others; one that keeps more stays with what is its own."""
    passage = "\n".join(f"shared words of line {i} in a passage" for i in range(12))
    own = lambda k, n: " ".join(f"own{k}x{i}" for i in range(n))
    rows = [(1, passage), (2, own(2, 10) + "\n" + passage), (3, own(3, 60) + "\n" + passage)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id bigint, text string, n_chars bigint")
    out = {r.doc_id: (r.text, r.n_chars) for r in C.without_repeated_lines(spark, docs, "").collect()}
    assert out == {1: (passage, len(passage)), 3: (own(3, 60), len(own(3, 60)))}


def test_run(spark, sf):
    out = C.run(spark, sf)
    per = out.groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert per and all(r["sum(length)"] == r["max(doc_tokens)"] for r in per)
    assert out.groupBy("sequence_id").agg({"length": "sum"}).where(f"`sum(length)` > {packing.LENGTH}").count() == 0


def test_empty_pipeline(spark, none):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in C.STAGES:
        docs = C.materialise(stage(spark, docs, "/root/testdata/sf0.001"), name)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_twin(spark, sf, name):
    db = duckdb.connect()
    for f in os.listdir(sf):
        db.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    df = queries()[name](spark, sf)
    columns = sorted(df.columns)
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    out = db.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})")
    assert got == sorted((tuple(map(plain, r)) for r in out.fetchall()), key=repr)


def test_ten_queries():
    names = {n.split("_")[0] for n in queries()}
    assert names == {f"op{n}" for n in range(1, 11)}
