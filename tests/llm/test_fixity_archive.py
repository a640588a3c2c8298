from collections import Counter

from pyspark.sql import functions as F

from docloom.llm import fixity as W

PAGES = "page_id bigint, url string, html string"


def test_faults_in_a_replica_stay_in_their_ranges(spark):
    rows = [(None if i == 0 else i // 2, None if i % 17 == 0 else f"http://h/{i}", "é" * (i * 7 % 400)) for i in range(300)]
    other = {40: rows[40][2] + "longer", 90: "x" + rows[90][2][1:], 200: "cut"}
    replica = [(p, u, other.get(i, h)) for i, (p, u, h) in enumerate(rows) if i not in (5, 250)] + [(77, "http://added", "new"), rows[120]]
    a, b = (W.materialise(W.manifest(spark.createDataFrame(x, PAGES).repartition(3)), "m") for x in (rows, replica))
    found = {(r.page_id, r.url, r.status) for r in W.audit_archive(a, b, 512, 3).collect()}
    want = {(*rows[i][:2], "corrupt") for i in other} | {(*rows[i][:2], "missing") for i in (5, 250)}
    want |= {(77, "http://added", "extra"), (*rows[120][:2], "extra")}
    assert found == {(p, u or "", s) for p, u, s in want}
    assert W.audit_archive(a, a, 512, 3).count() == 0
    assert {r.status for r in W.audit_archive(a, a.where("false"), 512, 3).collect()} == {"missing"}
    assert {r.status for r in W.audit_archive(a.where("false"), a, 512, 3).collect()} == {"extra"}


def test_replica_is_hashed_from_its_own_bytes(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    mine, hurt = W.manifest(pages).collect(), W.manifest(W.damaged(pages)).collect()
    lost = [r for r in mine if r.sha256[:2] in W.MISSING]
    wrong = [r for r in mine if r.sha256[:2] in W.CORRUPT]
    assert lost or wrong
    assert len(hurt) == len(mine) - len(lost)
    assert len({r.sha256 for r in hurt} - {r.sha256 for r in mine}) == len(wrong)


def test_a_repeated_key_lies_in_many_ranges(spark):
    """Half of all records have one key: they are spread over the ranges that their bytes fill, and a fault among them is found."""
    rows = [(None if i % 2 else i, "http://h/same" if i % 2 else f"http://h/{i}", "same body" if i % 4 == 1 else f"body {i}") for i in range(3000)]
    replica = [r for i, r in enumerate(rows) if i not in (1, 3)] + [(None, "http://h/same", "another")] * 5
    a, b = (W.materialise(W.manifest(spark.createDataFrame(x, PAGES).repartition(4)), "m") for x in (rows, replica))
    sides = W.ranged(a, b, 4096)
    per = [r["count"] for r in sides[0].groupBy("node").count().collect()]
    assert len(per) > 50 and max(per) <= 4096 // 100
    found = Counter(r.status for r in W.audit_archive(a, b, 4096, 4).collect())
    assert found == {"corrupt": 2, "extra": 3}


def test_a_crowded_range_is_a_sum(spark):
    """A replica with very many records between two of the primary's keys: their digest has partial aggregation, and no list of them."""
    a = W.manifest(spark.createDataFrame([(1, "a", "x"), (9, "b", "y")], PAGES))
    b = W.manifest(spark.range(5000).select((F.col("id") % 3 + 2).alias("page_id"), F.lit("u").alias("url"), F.lit("z").alias("html")))
    sides = W.ranged(W.materialise(a, "m"), W.materialise(b, "m"), 1 << 18)
    plan = W.summed(sides[1])._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "partial_sum" in plan
    assert W.audit_archive(a, b, 1 << 18).groupBy("status").count().count() == 2


def test_order_of_equal_records_is_no_difference(spark):
    rows = [(1, "u", "x")] * 4 + [(1, "u", "y")] * 3
    a, b = (W.manifest(spark.createDataFrame(x, PAGES).coalesce(1)) for x in (rows, rows[::-1]))
    assert W.audit_archive(a, b, 64, 2).count() == 0
