import json

import pytest
from pyspark.sql import functions as F

from docloom.sources import files, pages, tables
from docloom.streaming import jobs, progress


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿正文".encode())
    (tmp_path / "b.TXT").write_bytes("中文内容".encode("gbk"))
    (tmp_path / "c.txt").write_bytes(b" \n")
    (tmp_path / "d.docx").write_bytes(b"x")
    out = {r.doc_id.rsplit("/", 1)[1]: r for r in files.read_text(files.binary_files(spark, str(tmp_path))).collect()}
    assert out["a.txt"].text == "正文" and out["b.TXT"].text == "中文内容" and out["a.txt"].error is None
    assert out["c.txt"].error == files.EMPTY and "docx" in out["d.docx"].error
    assert files.accepted(files.binary_files(spark, str(tmp_path))).count() == 3


def test_pages_by_an_extractor(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one|two|three")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def extract(content, name):
        if content == b"bad":
            raise ValueError("broken xref")
        return enumerate(content.decode().split("|"), 1)

    rows = files.read_pages(files.binary_files(spark, str(tmp_path), "*.pdf"), extract, max_pages=2).collect()
    assert sorted((r.page, r.text) for r in rows if r.error is None) == [(1, "one"), (2, "two")]
    assert sorted(r.error for r in rows if r.error) == ["[PDF解析错误: broken xref]", "pages after the first 2 were not read"]
    (tmp_path / "c.txt").write_bytes("正文".encode())
    both = files.read_files(files.binary_files(spark, str(tmp_path)), extract).collect()
    assert {(r.doc_id.rsplit("/", 1)[1], r.page, r.text) for r in both if not r.error} == {("a.pdf", 1, "one"), ("a.pdf", 2, "two"), ("a.pdf", 3, "three"), ("c.txt", 0, "正文")}


def test_names_are_repaired(spark):
    broken = "合同.pdf".encode().decode("latin-1")
    names = [broken, "plain.pdf", "合同.pdf", "café.pdf", "caf\u00c3\u00a9.pdf", "\u00ff\u00fe", None]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "name string").select(files.repaired_name("name").alias("n")).collect()]
    assert got == ["合同.pdf", *names[1:]]


def test_cases_and_frames(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"问题": "q", "doc_id": "d", "gold_pages": [1], "gold_contains": ["x"]}]}))
    r = files.read_cases(spark, str(tmp_path / "c.json")).first()
    assert (r.question, r.doc_id, r.gold_pages, r.gold_contains) == ("q", "d", [1], ["x"])
    lines = spark.createDataFrame([("data: {\"a\":1}",), (": ping",), ("event: x",), ("data:",)], "value string")
    assert [x.payload for x in files.event_frames(lines).collect()] == ['{"a":1}']
    blocks = spark.createDataFrame([(1, 'data: {"a":"1"}\r\n: ping\ndata: oops\ndata: {"b":"2"}'), (2, "data: x")], "k int, value string")
    got = [(r.k, r.payload, r.data) for r in files.event_blocks(blocks, "k").orderBy("k", "at").collect()]
    assert got[0] == (1, '{"a":"1"}', {"a": "1"}) and got[1][1] == "oops" and not got[1][2] and len(got) == 2  # what has no end yet is not read


def test_case_files_in_chinese(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"问题": "q", "文档ID": "d", "金标页码": [1, 2], "金标原文": ["x"], "启用重排": "是"}, {"问题": "r"}]))
    a, b = files.read_cases(spark, str(tmp_path / "c.json")).collect()
    assert (a.doc_id, a.gold_pages, a.gold_contains, a.use_rerank) == ("d", [1, 2], ["x"], True) and (b.doc_id, b.use_rerank) == (None, False)


def test_reports_and_dumps(spark, tmp_path):
    """An evaluation's results as JSON and text; stored chunks with a preview, in order."""
    from docloom.operators import retrieval

    results = spark.createDataFrame([(1, 0.5, None), (2, 1.0, "tie")], "query_id int, page_recall double, verdict string")
    tables.write_report(results, str(tmp_path / "r"))
    assert {(r.query_id, r.page_recall) for r in spark.read.json(str(tmp_path / "r.results")).collect()} == {(1, 0.5), (2, 1.0)}
    assert {r.value for r in spark.read.text(str(tmp_path / "r.report")).collect()} == {"1 | 0.5", "2 | 1.0 | tie"}
    rows = [("d", 1, "d_chunk_1", 2, "text", "two\n\n  lines " + "x" * 200), ("d", 0, "d_chunk_0", 1, "table", "first"), ("e", 0, "e_chunk_0", 1, "text", "")]
    dump = retrieval.chunk_dump(spark.createDataFrame(rows, "doc_id string, chunk_index int, id string, page int, kind string, text string"), 16).collect()
    assert [(r.doc_id, r.chunk_index) for r in dump if r.doc_id == "d"] == [("d", 0), ("d", 1)]
    assert {r.id: (r.chars, r.preview) for r in dump} == {"d_chunk_0": (5, "first"), "d_chunk_1": (213, "two lines xxx"), "e_chunk_0": (0, "")}


def test_versions(spark, tmp_path):
    df = tables.bucketed(spark.range(10).select(F.col("id").cast("string").alias("doc_id")), buckets=4)
    tables.write_version(df, str(tmp_path / "t"), "1")
    assert tables.read_version(spark, str(tmp_path / "t"), "1").count() == 10


PAGES = "doc_id string, page int, text string, source_ext string"


def test_ingest_stream_stores_each_page_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, "一段文字。", "pdf"), ("b", 1, "另一段。", "txt")], PAGES)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # a restart finds nothing new
        jobs.ingest(spark, str(tmp_path / "in"), PAGES, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert jobs.current(spark, str(tmp_path / "out")).count() == 2


def test_a_document_that_comes_again(spark, tmp_path):
    for n, text in enumerate(("旧的一段。", "新的一段。")):
        spark.createDataFrame([("a", 1, text, "pdf"), (f"only{n}", 1, "别的。", "pdf")], PAGES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        jobs.ingest(spark, str(tmp_path / "in"), PAGES, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert {(r.doc_id, r.text) for r in jobs.current(spark, str(tmp_path / "out")).collect()} == {("a", "新的一段。"), ("only0", "别的。"), ("only1", "别的。")}


UPLOADS = PAGES + ", upload bigint"


def put(spark, tmp_path, number, rows, schema=UPLOADS, **options):
    jobs.store(spark, spark.createDataFrame(rows, schema), number, str(tmp_path / "out"), buckets=3, **options)
    return {(r.doc_id, r.page, r.text) for r in jobs.current(spark, str(tmp_path / "out")).collect()}


def test_a_document_over_two_batches_is_whole(spark, tmp_path):
    assert put(spark, tmp_path, 0, [("a", 2, "第二页。", "pdf", 1), ("b", 1, "别的。", "pdf", 1)]) == {("a", 2, "第二页。"), ("b", 1, "别的。")}
    assert put(spark, tmp_path, 1, [("a", 1, "第一页。", "pdf", 1)]) == {("a", 1, "第一页。"), ("a", 2, "第二页。"), ("b", 1, "别的。")}
    ids = {(r.id, r.page) for r in jobs.current(spark, str(tmp_path / "out")).where("doc_id = 'a'").collect()}
    assert ids == {("a_chunk_0", 1), ("a_chunk_1", 2)}


def test_a_new_upload_replaces_the_document_whole(spark, tmp_path):
    put(spark, tmp_path, 0, [("a", 1, "旧一。", "pdf", 1), ("a", 2, "旧二。", "pdf", 1)])
    assert put(spark, tmp_path, 1, [("a", 1, " ", "pdf", 2)]) == {("a", 1, "旧一。"), ("a", 2, "旧二。")}  # nothing to read yet: the old one holds
    assert put(spark, tmp_path, 2, [("a", 2, "新二。", "pdf", 2)]) == {("a", 2, "新二。")}
    assert put(spark, tmp_path, 3, [("a", 1, "旧三。", "pdf", 1)]) == {("a", 2, "新二。")}  # too late
    assert put(spark, tmp_path, 4, [("a", 1, "新一。", "pdf", 2), ("a", 2, "新二改。", "pdf", 2)]) == {("a", 1, "新一。"), ("a", 2, "新二改。")}


def test_a_batch_that_fails_leaves_the_old(spark, tmp_path, monkeypatch):
    put(spark, tmp_path, 0, [("a", 1, "旧。", "pdf", 1)])
    cut = jobs.chunk_pages

    def broken(pages, config):
        return cut(pages, config).withColumn("text", F.raise_error(F.lit("no model")).cast("string"))

    monkeypatch.setattr(jobs, "chunk_pages", broken)
    try:
        put(spark, tmp_path, 1, [("a", 1, "新。", "pdf", 2)])
        raise AssertionError("the batch should have failed")
    except Exception as e:
        assert "no model" in str(e)
    assert {r.text for r in jobs.current(spark, str(tmp_path / "out")).collect()} == {"旧。"}
    monkeypatch.setattr(jobs, "chunk_pages", cut)
    assert put(spark, tmp_path, 1, [("a", 1, "新。", "pdf", 2)]) == {("a", 1, "新。")}  # the same batch again
    assert put(spark, tmp_path, 1, [("a", 1, "其他。", "pdf", 2)]) == {("a", 1, "新。")}  # once committed, a replay changes nothing


def test_a_batch_reads_and_writes_its_buckets_alone(spark, tmp_path):
    put(spark, tmp_path, 0, [(f"d{i}", 1, f"文字{i}。", "pdf", 1) for i in range(30)])
    put(spark, tmp_path, 1, [("d1", 1, "新。", "pdf", 2)])
    put(spark, tmp_path, 2, [], UPLOADS)
    assert [r["count"] for r in spark.read.parquet(str(tmp_path / "out" / "commits")).groupBy("version").count().orderBy("version").collect()] == [3, 1]
    read = {f.split("/out/")[1] for f in jobs._folders(spark, str(tmp_path / "out"), "chunks")}
    assert sorted(x.split("/")[1] for x in read) == ["version=0", "version=0", "version=1"]
    assert jobs.current(spark, str(tmp_path / "out")).count() == 30


def test_facts_by_the_rule_of_the_batch_form(spark):
    """with_facts against memory.merged_facts, line by line."""
    import random

    from docloom.operators import memory

    r = random.Random(2)
    line = lambda: r.choice(["", "[pinned] ", "- ", "• [PINNED]"]) + r.choice(["金额 100", "金额100", "甲方 A", "a" * 9, "b" * 12, " "])
    for most in (2000, 60, 25):
        known: list[str] = []
        for _ in range(3):
            new = [line() for _ in range(3)]
            text = "\n".join(f"- {x}" for x in known)
            want = spark.range(1).select(memory.merged_facts(F.lit(text), F.array(*map(F.lit, new)), most)).first()[0]
            known = jobs.with_facts(known, new, most)
            assert "\n".join(f"- {x}" for x in known) == want.rstrip(), (most, text, new)


def run(stream, tmp_path, mode="update"):
    got = []
    q = stream.writeStream.foreachBatch(lambda b, n: got.append(b.collect())).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return got


TURNS = "conv_id bigint, turn int, role string, text string"


def test_memory_over_triggers_is_that_of_the_whole(spark, tmp_path):
    from docloom.operators import memory

    said = [(c, i, "user" if i % 2 == 0 else "assistant", f"fact {i % 4} of {c}") for c in (1, 2) for i in range(9)]
    for part in ([x for x in said if x[1] < 3], [x for x in said if 2 <= x[1] < 7], [x for x in said if x[1] >= 7]):  # turn 2 comes twice
        spark.createDataFrame(part, TURNS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    facts = lambda block: [x.split(": ", 1)[1] for x in block.split("\n")]
    stream = jobs.rolling_memory(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), keep=4, facts=facts)
    last = {r.conv_id: r for batch in run(stream, tmp_path) for r in batch}
    state = spark.createDataFrame([], "conv_id bigint, covered int, memory_summary string, memory_facts string")
    whole = memory.compressed(spark.createDataFrame(said, TURNS).withColumnRenamed("text", "content"), state, 4, lambda p, n: "\n".join(x.split("：", 1)[1] for x in p.split("\n")) if n == 300 else "")
    for r in whole.collect():
        assert last[r.conv_id].covered == r.covered == 5
        assert "\n".join(f"- {x}" for x in last[r.conv_id].facts) == r.memory_facts
        assert [x.split(": ")[1] for x in last[r.conv_id].summary.split("\n")] == [x.split("：")[1] for x in r.memory_summary.split("\n")]


def test_memory_begins_with_a_batch_table_and_forgets(spark, tmp_path):
    spark.createDataFrame([(1, 7, "user", "x"), (1, 3, "user", "long covered"), (1, 8, "user", "y")], TURNS).coalesce(1).write.parquet(str(tmp_path / "in"))
    initial = spark.createDataFrame([(1, 5, 4, "早先", ["[pinned] a"])], "conv_id bigint, covered bigint, last bigint, summary string, facts array<string>")
    stream = jobs.rolling_memory(spark.readStream.schema(TURNS).parquet(str(tmp_path / "in")), keep=1, facts=lambda b: ["A", "b"], ttl_ms=3_600_000, initial=initial)
    r = run(stream, tmp_path)[0][0]
    assert (r.covered, r.kept, r.summary, r.facts) == (6, 1, "早先\nuser: x", ["[pinned] a", "b"])


def test_event_lines_cut_anywhere(spark, tmp_path):
    body = 'data: {"a":1}\r\n: ping\ndata:\ndata: 合同金额\nevent: x\ndata: last\ndata: no end'.encode()
    for part in ([(1, 0, body[:9]), (2, 0, b"data: other\n")], [(1, 2, body[30:36]), (1, 1, body[9:30])], [(1, 3, body[36:])]):
        spark.createDataFrame(part, "connection bigint, seq bigint, value binary").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    blocks = spark.readStream.schema("connection bigint, seq bigint, value binary").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    rows = sorted((r.connection, r["at"], r.payload) for batch in run(jobs.event_payloads(blocks), tmp_path, "append") for r in batch)
    assert rows == [(1, 0, '{"a":1}'), (1, 3, "合同金额"), (1, 5, "last"), (2, 0, "other")]


def test_rolling_memory_keeps_summary_and_facts(spark, tmp_path):
    schema = "conv_id bigint, turn int, role string, text string"
    last = {}
    for n in range(2):  # two batches
        rows = [(1, 10 * n + i, "user", f"batch {n} turn {i}") for i in range(3)] + [(1, 10 * n + 5, "user", "  "), (1, 10 * n + 6, "system", "x")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = jobs.rolling_memory(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), keep=2, facts=lambda block: [f"said {block.count('turn')}", "Said 1"])
        q = stream.writeStream.foreachBatch(lambda b, _: last.update({r.conv_id: r for r in b.collect()})).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    r = last[1]
    assert (r.covered, r.kept, r.overflowed) == (4, 2, 3)
    assert r.summary == "user: batch 0 turn 0\nuser: batch 0 turn 1\nuser: batch 0 turn 2\nuser: batch 1 turn 0" and r.facts == ["said 1", "said 3"]


def test_rolling_memory_stream(spark, sf, tmp_path):
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    turns.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.rolling_memory(spark.readStream.schema(turns.schema).parquet(str(tmp_path / "in")), keep=2)
    q = stream.writeStream.format("memory").queryName("rolling").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r.conv_id: (r.covered, r.kept) for r in spark.table("rolling").collect()}
    want = {r.conv_id: (max(0, r.n - 2), min(2, r.n)) for r in turns.where("role <> 'system' AND trim(text) <> ''").groupBy("conv_id").agg(F.count("*").alias("n")).collect()}
    assert got == want


class Broken(pages.FormFeeds):
    """Fails on the fourth page, and on files that say so."""

    def count(self, file):
        if file.read(4) == b"lost":
            raise ValueError("no such page tree")
        file.seek(0)
        return super().count(file)

    def pages(self, file, first, last):
        for i, text in enumerate(super().pages(file, first, last), first):
            if i == 3:
                raise ValueError("broken page")
            yield text


def test_pages_of_files_in_ranges(spark, tmp_path):
    spark.dataSource.register(pages.PageSource)
    (tmp_path / "in" / "sub").mkdir(parents=True)
    texts = {"a.txt": [f"page {i} " + "x" * (i * 37 % 90) for i in range(57)], "sub/b.TXT": ["one"], "c.txt": ["", "", "three"], "d": ["é語"], "empty.txt": []}
    for name, own in texts.items():
        (tmp_path / "in" / name).write_bytes("\f".join(own).encode())
    (tmp_path / "in" / "_SUCCESS").write_bytes(b"")
    for most, size in ((120, 10**6), (120, 64), (20, 100)):
        df = spark.read.format("docloom_pages").option("path", f"file://{tmp_path}/in").option("maxPages", most).option("rangeBytes", size).load()
        rows = df.collect()
        got = {(r.doc_id.split("/in/")[1], r.page): r.text for r in rows if r.error is None}
        assert got == {(n, i + 1): t for n, own in texts.items() for i, t in enumerate(own[:most])}
        assert [(r.page, r.error) for r in rows if r.error] == ([] if most > 57 else [(21, files.TOO_MANY.format(20))])
        assert {r.source_ext for r in rows} == {"txt", ""} and (df.rdd.getNumPartitions() > 6) == (size < 1000)
    whole = spark.read.format("docloom_pages").option("path", f"file://{tmp_path}/in/sub/b.TXT").load().collect()
    assert [(r.page, r.text) for r in whole] == [(1, "one")]


def test_ranges_of_many_files_share_partitions(tmp_path):
    """A million ranges in some thousand tasks; each range in one, and read as if it were alone."""
    reader = pages.PageReader({"path": f"file://{tmp_path}", "rangeBytes": "4000"})
    found = reader.ranges([(0, f"f{i}", 40_000 + i % 900) for i in range(100_000)])
    assert len(found) <= 2 * 2048 + 1
    assert [x for r in found for x in r.parts] == [(f"f{i}", k, 10 if i % 900 == 0 else 11) for i in range(100_000) for k in range(10 if i % 900 == 0 else 11)]
    assert [len(r.parts) for r in reader.ranges([(0, "a", 9000), (0, "b", 10), (0, "c", 20), (0, "d", 8001)])] == [1, 1, 3, 1, 1, 1]  # the last of a with b and c
    (tmp_path / "a.txt").write_bytes(b"\f".join(b"%d" % i for i in range(57)))
    (tmp_path / "b.txt").write_bytes(b"x\fy")
    parts = [(f"{tmp_path}/a.txt", k, 10) for k in range(3, 10)] + [(f"{tmp_path}/b.txt", 0, 1)]
    got = [(path.rsplit("/", 1)[1], page, text) for path, page, text, _, error in reader.read(pages.Ranges(parts)) if error is None]
    assert got == [("a.txt", i + 1, str(i)) for i in range(17, 57)] + [("b.txt", 1, "x"), ("b.txt", 2, "y")]


def test_ranges_that_fail_are_rows(spark, tmp_path):
    spark.dataSource.register(pages.PageSource)
    (tmp_path / "a.txt").write_bytes(b"\f".join(b"%d" % i for i in range(6)))
    (tmp_path / "lost.txt").write_bytes(b"lost")
    df = spark.read.format("docloom_pages").option("path", f"file://{tmp_path}").option("extractor", "tests.test_sources_streams:Broken").option("rangeBytes", 4).load()
    rows = df.collect()
    assert sorted((r.page, r.text) for r in rows if not r.error) == [(1, "0"), (2, "1"), (3, "2"), (5, "4"), (6, "5")]
    assert sorted((r.page, r.error) for r in rows if r.error) == [(0, files.FAILED.format("no such page tree")), (3, files.FAILED.format("broken page"))]


def test_pages_as_a_stream(spark, tmp_path):
    spark.dataSource.register(pages.PageSource)
    (tmp_path / "in").mkdir()
    seen = []
    for n in range(3):
        if n < 2:
            (tmp_path / "in" / f"{n}.txt").write_bytes(b"x\fy%d" % n)
        stream = spark.readStream.format("docloom_pages").option("path", f"file://{tmp_path}/in").load()
        q = stream.writeStream.foreachBatch(lambda b, i: seen.extend((r.doc_id[-5:], r.page, r.text) for r in b.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert sorted(seen) == [("0.txt", 1, "x"), ("0.txt", 2, "y0"), ("1.txt", 1, "x"), ("1.txt", 2, "y1")]


def test_a_watched_ingest_reports_and_stops(spark, tmp_path):
    out, told = str(tmp_path / "out"), []
    rows = spark.createDataFrame([(f"d{i}", 1, f"文字{i}。", "pdf", 1) for i in range(40)], UPLOADS)
    progress.ingest_watched(progress.Watch(spark, lambda name, percent: told.append((name, percent)), every=0.01), spark, rows, 0, out, buckets=3)
    assert [p for _, p in told] == sorted({p for _, p in told}) and told[-1][1] == 100 and [n for n in dict.fromkeys(n for n, _ in told)] == ["pages", "chunks", "commit"]
    before = {(r.doc_id, r.text) for r in jobs.current(spark, out).collect()}
    for name in ("pages", "chunks", "commit"):
        watch = progress.Watch(spark, lambda n, percent, name=name: watch.cancel() if n == name else None)
        with pytest.raises(progress.Cancelled):
            progress.ingest_watched(watch, spark, rows.withColumn("upload", F.lit(2).cast("bigint")).withColumn("text", F.lit("新。")), 1, out, buckets=3)
        assert {(r.doc_id, r.text) for r in jobs.current(spark, out).collect()} == before
    with pytest.raises(ValueError):
        progress.Watch(spark).run(lambda step: (_ for _ in ()).throw(ValueError("work's own")))


def test_jobs_stop_by_the_tag(spark):
    """A job that would take minutes ends when the watch is cancelled."""
    import time

    def slow(batches):
        time.sleep(60)
        yield from batches

    watch = progress.Watch(spark, lambda name, percent: watch.cancel() if percent > 0 else None, every=0.05)

    def work(step):
        step("chunks")
        spark.range(4).mapInArrow(slow, "id bigint").count()

    start = time.time()
    with pytest.raises(progress.Cancelled):
        watch.run(work)
    assert time.time() - start < 50
