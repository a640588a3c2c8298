"""Catalog tables: registry and conversations. Mutations return the new table; a writer swaps it in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions.text import ws_trim

MESSAGES = "array<struct<id:string,role:string,content:string,timestamp:bigint,isStreaming:boolean>>"
CONVERSATION = "id string, document_name string, document_size bigint, summary string, doc_id string, messages string, created_at string, memory_summary string, memory_covered int, memory_facts string"
REGISTRY = "doc_id string, created_at timestamp, conversation_id string"


def union(tables: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def replace_documents(chunks: DataFrame, new: DataFrame, key: str = "doc_id") -> DataFrame:
    """The chunks of the new rows' documents replaced by the new rows."""
    return union([chunks.join(new.select(key).distinct(), key, "left_anti"), new])


def delete_documents(chunks: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows whose key isn't in gone; blank keys in gone delete nothing."""
    return chunks.join(gone.where(ws_trim(F.col(key).cast("string")) != "").select(key).distinct(), key, "left_anti")


def upsert(rows: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """One row a key; a new one takes an old one's place, the last of several new ones by batch_no (of equal ones, by a hash of the row)."""
    both = union([rows.withColumn("batch_no", F.lit(-1).cast("bigint")), new if "batch_no" in new.columns else new.withColumn("batch_no", F.lit(0).cast("bigint"))])
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("batch_no"), F.xxhash64(*both.columns)))
    return both.withColumn("__no", last).where("__no = 1").drop("__no", "batch_no")


def insert_or_ignore(registry: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that aren't there yet, with their first time. A null id is none."""
    first = new.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("created_at").alias("created_at"))
    return union([registry, first.join(registry.select("doc_id"), "doc_id", "left_anti")])


def link(registry: DataFrame, links: DataFrame) -> DataFrame:
    """links (doc_id, conversation_id, linked_at, created_at): registers what is missing; the last link holds."""
    known = insert_or_ignore(registry, links.select("doc_id", "created_at"))
    last = links.groupBy("doc_id").agg(F.max_by("conversation_id", "linked_at").alias("__to"))
    to = F.when(F.col("__to").isNotNull(), F.col("__to")).otherwise(F.col("conversation_id"))
    return known.join(last, "doc_id", "left").withColumn("conversation_id", to).drop("__to")


def update_columns(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with the given columns from changes where a change has them (null: no change)."""
    given = changes.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    new = {c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in columns}
    return rows.join(given, key, "left").select(*(new[c].alias(c) if c in new else F.col(c) for c in rows.columns))


#: What a new conversation has where a put says nothing. Fixed values.
NEW = {"document_name": "", "document_size": 0, "summary": "", "doc_id": "", "memory_summary": "", "memory_covered": 0, "memory_facts": ""}


def accepted_puts(puts: DataFrame) -> DataFrame:
    """puts whose messages are a list (has_messages: a list with any); of those without messages, such as have a document's id and name."""
    listed = F.when(ws_trim("messages").startswith("["), F.size(F.from_json("messages", MESSAGES)))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != "" if c in puts.columns else F.lit(False)
    rows = puts.withColumn("has_messages", listed > 0).where(listed.isNotNull())
    return rows.where(F.col("has_messages") | (filled("doc_id") & filled("document_name")))


def upsert_conversations(rows: DataFrame, puts: DataFrame, now: Column) -> DataFrame:
    """puts (one a key): id and any columns, null where not given.

    A put that isn't accepted (``accepted_puts``) changes nothing. A new conversation takes all
    that is given. Of an existing one the summary, the memory and, if there are any, the
    messages change; its document and its time stay. A document that a put names is linked in
    the registry instead: ``link`` with ``put_links``.
    """
    given = accepted_puts(puts)
    old = rows.select(*(F.col(c).alias(f"__{c}") for c in rows.columns))
    both = old.join(given, old["__id"] == given["id"], "full")
    was, put = F.col("__id").isNotNull(), lambda c: F.col(c) if c in puts.columns else F.lit(None)
    value = {}
    for c in rows.columns:
        new = F.coalesce(put(c), F.lit(NEW[c])) if c in NEW else put(c)
        kept = F.coalesce(put(c), F.col(f"__{c}")) if c in ("summary", "memory_summary", "memory_covered", "memory_facts") else F.col(f"__{c}")
        value[c] = F.when(was, kept).otherwise(new)
    value["id"] = F.coalesce("__id", "id")
    value["messages"] = F.when(F.col("has_messages"), F.col("messages")).otherwise(F.coalesce("__messages", F.lit("[]")))
    value["created_at"] = F.when(was, F.col("__created_at")).otherwise(F.coalesce(F.nullif(put("created_at").cast("string"), F.lit("")), now))
    return both.select(*(value[c].cast(rows.schema[c].dataType).alias(c) for c in rows.columns))


def put_links(puts: DataFrame, now: Column) -> DataFrame:
    """doc_id, conversation_id, linked_at and created_at for ``link``: documents that accepted puts name."""
    named = accepted_puts(puts).where(F.coalesce("doc_id", F.lit("")) != "")
    return named.select("doc_id", F.col("id").alias("conversation_id"), now.alias("linked_at"), now.alias("created_at"))


def cascade_delete(conversations: DataFrame, registry: DataFrame, chunks: DataFrame, chat: DataFrame, gone: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the conversations of gone (id), their documents and their turns."""
    docs = conversations.join(gone, "id", "left_semi").select("doc_id").where(F.coalesce("doc_id", F.lit("")) != "").distinct()
    return {
        "conversations": conversations.join(gone, "id", "left_anti"),
        "registry": registry.join(docs, "doc_id", "left_anti"),
        "chunks": chunks.join(docs, "doc_id", "left_anti"),
        "chat": chat.join(gone.select(F.col("id").alias("conversation_id")), "conversation_id", "left_anti"),
    }


def cascade_counts(before: dict[str, DataFrame], after: dict[str, DataFrame]) -> DataFrame:
    """name and n_deleted: how many rows of each table went; 0 where nothing changed."""
    sides = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), (F.col("n") * sign).alias("n")) for tables, sign in ((before, 1), (after, -1)) for name, t in tables.items()]
    return union(sides).groupBy("name").agg(F.sum("n").alias("n_deleted"))


def keep_set(conversations: DataFrame, registry: DataFrame, now: Column, hours: int = 12) -> DataFrame:
    """Ids that a conversation refers to, or that were registered within the hours (strictly, in whole seconds)."""
    fresh = F.date_trunc("second", "created_at") > F.date_trunc("second", now) - F.make_interval(hours=F.lit(hours))
    every = conversations.select("doc_id").unionByName(registry.where(fresh).select("doc_id"))
    return every.where(F.col("doc_id").isNotNull() & (ws_trim(F.col("doc_id").cast("string")) != "")).distinct()


def orphans(stored: DataFrame, keep: DataFrame) -> DataFrame:
    """Stored document ids that nothing keeps."""
    return stored.select("doc_id").distinct().join(keep, "doc_id", "left_anti")


def stale_files(files: DataFrame, active: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Files (path, modificationTime) older than the hours that no upload is using."""
    return files.where(F.col("modificationTime") < now - F.make_interval(hours=F.lit(hours))).join(active.select("path"), "path", "left_anti")


def page(rows: DataFrame, number: int, size: int = 6, order=(("created_at", False), ("id", True))) -> DataFrame:
    """The number-th page (from 1) of the rows, newest first."""
    by = [F.col(c).asc() if up else F.col(c).desc() for c, up in order]
    return rows.orderBy(*by).offset(max(0, number - 1) * size).limit(size)


def last_page(n: Column, size: int = 6) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(float(size)))).cast("int")
