"""Streams: new pages replace a document's chunks, new turns fold into a conversation's state, event blocks become payloads."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from docloom.config import Config
from docloom.functions.text import FACT_PREFIXES, PINNED, ws_trim
from docloom.operators.chunking import chunk_pages
from docloom.sources.tables import BUCKETS, bucketed

PAGE = ("doc_id", "page", "text", "source_ext", "upload")


# --- documents --------------------------------------------------------------------------------
#
# A store has two tables, pages and chunks, each in folders version=<batch>/bucket=<n>, and a
# table of commits with the buckets that each version has. What holds is of each bucket its last
# committed version. A batch reads the buckets that its documents lie in as they were before it,
# writes them anew under its own number, and commits; until then nothing of it is seen, so a
# batch that fails leaves all as it was, and one that is replayed writes the same again. Commits
# are read by the driver: a row a bucket.


def _commits(spark: SparkSession, out: str) -> DataFrame | None:
    try:
        return spark.read.schema("bucket int, pages bigint, chunks bigint, version bigint").parquet(f"{out}/commits")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _folders(spark: SparkSession, out: str, table: str, before: int | None = None, buckets: set[int] | None = None) -> list[str]:
    """The folders that hold for the buckets (all, if not given), by the commits before a version."""
    rows = _commits(spark, out)
    if rows is None:
        return []
    rows = rows if before is None else rows.where(F.col("version") < before)
    last = rows.groupBy("bucket").agg(F.max_by(F.struct("version", table), "version").alias("l")).select("bucket", "l.*").collect()
    return [f"{out}/{table}/version={r.version}/bucket={r.bucket}" for r in last if r[table] and (buckets is None or r.bucket in buckets)]


def stored(spark: SparkSession, out: str, table: str, schema: str | StructType, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
    """A table of the store as it holds, or as it held before a version; only the folders named are listed and read."""
    folders = _folders(spark, out, table, before, buckets)
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def with_upload(pages: DataFrame) -> DataFrame:
    """PAGE of the pages that have a document; without an upload of their own all are of one."""
    upload = F.coalesce(F.col("upload").cast("bigint"), F.lit(0).cast("bigint")) if "upload" in pages.columns else F.lit(0).cast("bigint")
    return pages.where(F.col("doc_id").isNotNull()).select("doc_id", "page", "text", "source_ext", upload.alias("upload"))


def merged_pages(old: DataFrame, new: DataFrame) -> DataFrame:
    """PAGE of both, each page of an upload once: the new one (of several the one of the largest hash)."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    again = Window.partitionBy("doc_id", "upload", "page").orderBy(F.desc("__new"), F.desc(F.xxhash64("text", "source_ext")))
    return both.withColumn("__no", F.row_number().over(again)).where("__no = 1").drop("__no", "__new")


def with_last(pages: DataFrame) -> DataFrame:
    """Adds last, the last upload of the document that has any text; null if none has."""
    return pages.withColumn("last", F.max(F.when(ws_trim("text") != "", F.col("upload"))).over(Window.partitionBy("doc_id")))


def store(spark: SparkSession, batch: DataFrame, number: int, out: str, config: Config = Config(), buckets: int = BUCKETS, step: Callable[[str], None] = lambda name: None) -> None:
    """Puts a batch of pages into the store as its version ``number``; see above.

    Of a document the last upload with any text holds; its pages are kept, and later ones'.
    step is called with the name of each step before it begins; what it raises ends the batch.
    """
    commits = _commits(spark, out)
    if commits is not None and not commits.where(F.col("version") == number).isEmpty():
        return  # replayed after it was committed
    step("pages")
    new = with_upload(batch)
    touched = {r.bucket for r in bucketed(new, buckets=buckets).select("bucket").distinct().collect()}  # at most the buckets there are

    def written(rows: DataFrame, table: str) -> DataFrame:
        path, shape = f"{out}/{table}/version={number}", StructType([*rows.schema.fields, *StructType.fromDDL("bucket int").fields])
        bucketed(rows, buckets=buckets).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return spark.read.schema(shape).parquet(path)

    old = stored(spark, out, "pages", new.schema, number, touched)
    pages = written(with_last(merged_pages(old, new)).where("last IS NULL OR upload >= last").drop("last"), "pages")
    step("chunks")
    ids = new.select("doc_id").distinct()
    cut = chunk_pages(with_last(pages.join(ids, "doc_id", "left_semi")).where("upload = last").select(*PAGE[:4]), config)
    kept = stored(spark, out, "chunks", cut.schema, number, touched).join(ids, "doc_id", "left_anti")
    chunks = written(kept.unionByName(cut), "chunks")
    step("commit")
    counts = spark.createDataFrame([(b,) for b in sorted(touched)], "bucket int")
    for name, rows in (("pages", pages), ("chunks", chunks)):
        counts = counts.join(rows.groupBy("bucket").agg(F.count("*").alias(name)), "bucket", "left")
    counts.na.fill(0).coalesce(1).write.mode("overwrite").parquet(f"{out}/commits/version={number}")


def ingest(spark: SparkSession, source: str, schema: str, out: str, checkpoint: str, config: Config = Config(), files_per_batch: int = 16, buckets: int = BUCKETS):
    """A stream of pages (doc_id, page, text, source_ext and, if known, upload) arriving as Parquet, cut and stored batch by batch.

    upload grows with each coming of a document. Pages of one upload may come in any number of
    batches; a later upload that has any text replaces the earlier ones whole, and one that comes
    late changes nothing. Without uploads a page replaces the page of its number.
    """
    pages = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    writer = pages.writeStream.foreachBatch(lambda batch, number: store(batch.sparkSession, batch, number, out, config, buckets))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, out: str, table: str = "chunks") -> DataFrame:
    """The chunks (or pages) that hold."""
    folders = _folders(spark, out, table)
    if not folders:
        raise ValueError(f"nothing is stored under {out}")
    return spark.read.parquet(*folders)


# --- conversations ----------------------------------------------------------------------------

#: (summary so far, the turns that left the window) -> summary
SummaryFn = Callable[[str, str], str]
#: the turns that left the window -> facts, one a line
FactsFn = Callable[[str], list[str]]


def appended(summary: str, block: str, most: int = 1200) -> str:
    return "\n".join(x for x in (summary, block) if x)[:most]


def fact_key(line: str) -> str:
    line = line.strip()
    return "".join((line[len(PINNED) :] if line.lower().startswith(PINNED) else line).lower().split())


def with_facts(known: list[str], new: list[str], most: int = 2000) -> list[str]:
    """The rule of ``memory.merged_facts`` for lines: the first of a key stays, a pinned one takes its place; over the limit
    pinned ones come first, and of the others the oldest go, and last the text is cut."""
    pinned = lambda x: x.strip().lower().startswith(PINNED)
    facts: dict[str, str] = {}
    for line in known:
        facts.setdefault(fact_key(line), line)
    for line in new:
        line = line.strip()
        line = next((line[len(p) :].strip() for p in FACT_PREFIXES[:4] if line.startswith(p)), line)
        if (k := fact_key(line)) and (k not in facts or (pinned(line) and not pinned(facts[k]))):
            facts[k] = line
    lines, size = list(facts.values()), lambda a: sum(len(x) + 3 for x in a) - 1
    if size(lines) <= most:
        return lines
    first, others = [x for x in lines if pinned(x)], [x for x in lines if not pinned(x)]
    while others and size(first + others) > most:
        others.pop(0)
    cut = "\n".join(f"- {x}" for x in first + others)[:most]
    return [x[2:].strip() for x in cut.split("\n") if x[2:].strip()]


class RollingMemory(StatefulProcessor):
    """A conversation's last turns (a map by their number), the facts (a list) and the summary of those that have left the window.

    Each turn leaves it once: a turn sent again takes its own place, and one of a number that
    has left already is passed over.
    """

    def __init__(self, keep: int, summarise: SummaryFn = appended, facts: FactsFn | None = None, facts_chars: int = 2000, ttl_ms: int | None = None):
        self.keep, self.summarise, self.facts_of, self.facts_chars, self.ttl = keep, summarise, facts, facts_chars, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn bigint", "role string, text string", self.ttl)
        self.facts = handle.getListState("facts", "line string", self.ttl)
        self.done = handle.getValueState("done", "covered bigint, last bigint, summary string", self.ttl)

    def handleInitialState(self, key, rows: pd.DataFrame, timerValues) -> None:
        """covered, last (the number of the last turn covered), summary and facts (lines) of a batch table."""
        for r in rows.itertuples():
            self.done.update((int(r.covered), int(r.last), r.summary or ""))
            if r.facts is not None and len(r.facts):
                self.facts.put([(x,) for x in r.facts])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        covered, last, summary = self.done.get() if self.done.exists() else (0, -1, "")
        turns = {k[0]: v for k, v in self.turns.iterator()}
        for frame in rows:
            for turn, role, text in sorted(zip(frame.turn, frame.role, frame.text, strict=True)):
                if turn > last:
                    turns[int(turn)] = (role, text)
                    self.turns.updateValue((int(turn),), (role, text))
        gone = sorted(turns)[: max(0, len(turns) - self.keep)]
        facts = [x[0] for x in self.facts.get()]
        if gone:
            block = "\n".join(f"{turns[t][0]}: {turns[t][1]}" for t in gone)
            summary, covered, last = self.summarise(summary, block), covered + len(gone), gone[-1]
            if self.facts_of:
                facts = with_facts(facts, self.facts_of(block), self.facts_chars)
                self.facts.put([(x,) for x in facts])
            for t in gone:
                self.turns.removeKey((t,))
            self.done.update((covered, last, summary))
        yield pd.DataFrame({"conv_id": [key[0]], "covered": [covered], "kept": [len(turns) - len(gone)], "overflowed": [len(gone)], "summary": [summary], "facts": [facts]})

    def close(self) -> None:
        pass


MEMORY = "conv_id bigint, covered bigint, kept bigint, overflowed bigint, summary string, facts array<string>"


def rolling_memory(
    turns: DataFrame, keep: int = 4, summarise: SummaryFn = appended, facts: FactsFn | None = None, facts_chars: int = 2000, ttl_ms: int | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """turns, a stream of conv_id, turn, role, text; blank ones don't count. Needs the RocksDB state store.

    ttl_ms: after so long without a change a conversation's state is forgotten. initial: conv_id,
    covered, last, summary and facts (array), with which conversations begin.
    """
    said = turns.where(F.col("role").isin("user", "assistant") & (ws_trim("text") != "")).withColumn("text", ws_trim("text"))
    mode = "None" if ttl_ms is None else "ProcessingTime"
    processor = RollingMemory(keep, summarise, facts, facts_chars, ttl_ms)
    begin = None if initial is None else initial.groupBy("conv_id")
    return said.groupBy("conv_id").transformWithStateInPandas(processor, outputStructType=MEMORY, outputMode="Update", timeMode=mode, initialState=begin)


# --- event streams ----------------------------------------------------------------------------


class EventLines(StatefulProcessor):
    """Payloads of a connection's ``data:`` lines; a line that has no end yet waits, in bytes, for the next block."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "bytes binary, lines bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        tail, n = self.tail.get() if self.tail.exists() else (b"", 0)
        blocks = sorted((int(s), bytes(b)) for frame in rows for s, b in zip(frame.seq, frame.value, strict=True) if b is not None)
        *lines, tail = b"".join([bytes(tail or b""), *(b for _, b in blocks)]).split(b"\n")
        self.tail.update((tail, n + len(lines)))
        found = [(n + i, line[5:].decode("utf-8", "replace").strip()) for i, line in enumerate(lines) if line.startswith(b"data:")]
        found = [(i, payload) for i, payload in found if payload]
        if found:
            yield pd.DataFrame({"connection": [key[0]] * len(found), "at": [i for i, _ in found], "payload": pd.Series([p for _, p in found], dtype=object)})

    def close(self) -> None:
        pass


def event_payloads(blocks: DataFrame) -> DataFrame:
    """connection, at (the line's number) and payload of a stream of blocks: connection (bigint), seq and value (binary), cut anywhere.

    Blocks of a connection come in the order of seq over the triggers. Needs the RocksDB state store.
    """
    return blocks.groupBy("connection").transformWithStateInPandas(EventLines(), outputStructType="connection bigint, at bigint, payload string", outputMode="Append", timeMode="None")
