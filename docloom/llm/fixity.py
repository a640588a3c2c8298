"""WARC fixity audit with Merkle trees over ordered offset ranges.

Pages become WARC resource records in the order of (page_id, url, digest), laid end to end;
a record's offset is the sum of the lengths before it. Its leaf is offset, length and
SHA-256. The records that begin in one range of RANGE_BYTES make a node of the lowest level,
FANOUT neighbouring nodes one of the next, up to a root. Two replicas are compared from the
root down: only children of nodes that differ are looked at, and only in the lowest ranges
that differ records are compared one by one.

``audit`` compares by offset, for replicas whose records lie where the primary's do. In a
replica archive of its own a record that is gone, added or of another length moves all after
it; ``audit_archive`` therefore cuts both archives at the keys (page_id, url, digest, and the
number among equal ones) with which the primary's ranges begin, and a leaf there is length and
SHA-256, so that a fault stays in its range. The cuts and the records of both archives are
sorted together, and a record's range is the number of cuts before it.

Between two of the primary's cuts a replica may have any number of records. A range's digest is
therefore made of sums: each leaf's SHA-256 is four numbers of 64 bits, which are added up as
exact decimals, with the number of leaves. Records of a range differ from others of the range
in their keys alone, which fix their order, so equal sums are equal sequences; and sums have
partial aggregation, so that no list of a range's records is held anywhere.

Offsets and numbers among equals are global without a global task: rows are sorted by range
over the cluster, each task sums up its own, and the sums of the tasks before are added.

Cases: null url and html count as empty; a null page_id sorts first and is written as
nothing. Repeated rows are records of their own. An empty archive has no nodes; compared
with one that isn't, all records of the other are missing or extra. Other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, running, table

RANGE_BYTES = 1 << 18
FANOUT = 16


def record(page_id: str = "page_id", url: str = "url", html: str = "html") -> Column:
    """The bytes of a WARC resource record, as text."""
    empty = F.lit("")
    body = F.coalesce(F.col(html), empty)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(page_id).cast("string"), empty),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(F.col(url), empty), F.lit("\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def manifest(pages: DataFrame) -> DataFrame:
    """page_id, url, record_offset, record_length, sha256: where each record lies and what it is."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), record().alias("r")).select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.octet_length("r").cast("bigint").alias("record_length"), F.sha2("r", 256).alias("sha256")
    )
    # the row's number deals out rows that repeat all three; written, so that sorting by range doesn't hash all pages twice
    order = ["page_id", "url", "sha256", "row_no"]
    rows = materialise(rows.withColumn("row_no", F.monotonically_increasing_id()), "hashed")
    rows = running(rows, order, "record_length", into="record_offset", tag="manifest")
    return rows.select("page_id", "url", "record_offset", "record_length", "sha256")


def leaves(records: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The lowest level: node and digest of each range's records in the order of their offsets."""
    part = F.concat_ws(":", F.col("record_offset").cast("string"), F.col("record_length").cast("string"), F.col("sha256"))
    nodes = records.groupBy(F.floor(F.col("record_offset") / range_bytes).alias("node")).agg(F.sort_array(F.collect_list(F.struct("record_offset", part.alias("leaf")))).alias("l"))
    return nodes.select("node", F.sha2(F.array_join(F.col("l.leaf"), ";"), 256).alias("digest"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    up = nodes.groupBy(F.floor(F.col("node") / fanout).alias("node")).agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("n"), "digest"))).alias("l"))
    return up.select("node", F.sha2(F.array_join(F.transform("l", lambda x: F.concat_ws(":", x["n"].cast("string"), x["digest"])), ";"), 256).alias("digest"))


def tree(lowest: DataFrame, height: int, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the ranges to the root."""
    levels = [materialise(lowest, "leaves")]
    for _ in range(height):
        levels.append(parents(levels[-1], fanout))
    return levels


def _odd_ranges(primary: DataFrame, replica: DataFrame, top: int, fanout: int) -> DataFrame:
    """The ranges (node) up to number top whose leaves differ, found from the root down."""
    height = 0
    while top:
        top //= fanout
        height += 1
    a, b = tree(primary, height, fanout), tree(replica, height, fanout)

    def differing(x: DataFrame, y: DataFrame) -> DataFrame:
        y = y.select(F.col("node").alias("n2"), F.col("digest").alias("d2"))
        return x.join(y, x["node"] == y["n2"], "full").where(~F.col("digest").eqNullSafe(F.col("d2"))).select(F.coalesce("node", "n2").alias("node"))

    odd = materialise(differing(a[-1], b[-1]), "differ")
    for level in range(height - 1, -1, -1):
        below = [t.join(odd.withColumnRenamed("node", "parent"), F.floor(t["node"] / fanout) == F.col("parent"), "left_semi") for t in (a[level], b[level])]
        odd = materialise(differing(*below), "differ")
    return odd


def audit(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The records at which the replicas differ: record_offset and status (corrupt, missing or extra).

    Both have record_offset, record_length and sha256; each offset stands once.
    """
    last = primary.select("record_offset").unionByName(replica.select("record_offset")).agg(F.max("record_offset")).first()[0] or 0
    odd = _odd_ranges(leaves(primary, range_bytes), leaves(replica, range_bytes), last // range_bytes, fanout)
    near = [t.join(odd, F.floor(t["record_offset"] / range_bytes) == odd["node"], "left_semi").select("record_offset", F.struct("record_length", "sha256").alias("what")) for t in (primary, replica)]
    other = near[1].select(F.col("record_offset").alias("o2"), F.col("what").alias("w2"))
    both = near[0].join(other, F.col("record_offset") == F.col("o2"), "full").where(~F.col("what").eqNullSafe(F.col("w2")))
    status = F.when(F.col("o2").isNull(), "missing").when(F.col("record_offset").isNull(), "extra").otherwise("corrupt")
    return both.select(F.coalesce("record_offset", "o2").alias("record_offset"), status.alias("status"))


KEY = ("page_id", "url", "sha256", "nth")


def numbered(rows: DataFrame, by: tuple[str, ...], order: str, into: str, tag: str) -> DataFrame:
    """rows with their number, from 0, among those equal in ``by``, in the order given; a group of any size lies in many tasks."""
    keyed = rows.withColumn("__group", F.xxhash64(*by)).withColumn("__one", F.lit(1).cast("bigint"))
    return running(keyed, ["__group", order], "__one", "__group", into=into, tag=tag).drop("__group", "__one")


def ranged(primary: DataFrame, replica: DataFrame, range_bytes: int) -> list[DataFrame]:
    """Both manifests with nth, the number among equal records, and node, the number of the last cut at or before the record's key (0, if none is)."""
    shape = [*KEY, "record_offset", "record_length"]
    sides = [numbered(t.select("page_id", "url", "sha256", "record_offset", "record_length"), KEY[:3], "record_offset", "nth", "numbered") for t in (primary, replica)]
    cuts = sides[0].groupBy(F.floor(F.col("record_offset") / range_bytes)).agg(F.min(F.struct(*KEY)).alias("k")).select("k.*", F.lit(0).alias("side"), F.lit(1).cast("bigint").alias("cut"))
    rows = [t.select(*shape, F.lit(i).alias("side"), F.lit(0).cast("bigint").alias("cut")) for i, t in enumerate(sides, 1)]
    every = cuts.unionByName(rows[0], allowMissingColumns=True).unionByName(rows[1])
    found = running(every, [*KEY, "side"], "cut", into="cuts", tag="ranged")
    found = found.withColumn("node", F.greatest(F.col("cuts") - 1, F.lit(0))).drop("cuts", "cut")
    return [found.where(F.col("side") == i).drop("side") for i in (1, 2)]


def summed(records: DataFrame) -> DataFrame:
    """node and digest of each range (see the module)."""
    leaf = F.sha2(F.concat_ws(":", F.col("record_length").cast("string"), F.col("sha256")), 256)
    words = [F.conv(F.substring("leaf", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = records.select("node", leaf.alias("leaf")).groupBy("node").agg(*(F.sum(w).cast("string").alias(f"s{i}") for i, w in enumerate(words)), F.count("*").cast("string").alias("n"))
    return sums.select("node", F.sha2(F.concat_ws(":", "n", *(f"s{i}" for i in range(4))), 256).alias("digest"))


def audit_archive(primary: DataFrame, replica: DataFrame, range_bytes: int = RANGE_BYTES, fanout: int = FANOUT) -> DataFrame:
    """The records at which two manifests differ: page_id, url, record_offset (the primary's), replica_offset and status.

    Equal records of a key are taken off first; of the others each of the primary's is corrupt
    if the replica has another for it, else missing, and what the replica has over is extra.
    """
    sides = ranged(primary, replica, range_bytes)
    top = sides[0].agg(F.max("node")).first()[0] or 0
    odd = _odd_ranges(*map(summed, sides), top, fanout)
    near = [materialise(t.join(odd, "node", "left_semi"), "odd-ranges") for t in sides]
    same, key = [*KEY, "record_length"], ["page_id", "url"]

    def over(x: DataFrame, y: DataFrame, offset: str) -> DataFrame:
        y = y.select(*(F.col(c).alias(f"y_{c}") for c in same))
        alone = x.join(y, [F.col(c).eqNullSafe(F.col(f"y_{c}")) for c in same], "left_anti")
        return numbered(alone.select(*key, "record_offset"), tuple(key), "record_offset", "place", "alone").withColumnRenamed("record_offset", offset)

    a, b = over(near[0], near[1], "record_offset"), over(near[1], near[0], "replica_offset")
    b = b.select(*(F.col(c).alias(f"y_{c}") for c in (*key, "place")), "replica_offset")
    both = a.join(b, [F.col(c).eqNullSafe(F.col(f"y_{c}")) for c in (*key, "place")], "full")
    status = F.when(F.col("replica_offset").isNull(), "missing").when(F.col("record_offset").isNull(), "extra").otherwise("corrupt")
    return both.select(F.coalesce("page_id", "y_page_id").alias("page_id"), F.coalesce("url", "y_url").alias("url"), "record_offset", "replica_offset", status.alias("status"))


#: First two digits of the digests of the records that the query's replica has wrong (changed, cut, lengthened), or not at all.
CORRUPT, MISSING = ("00", "01", "02"), ("03", "04")


def damaged(pages: DataFrame) -> DataFrame:
    """Pages of a replica with faults in their bytes: of 256 about three are corrupt and two missing, by their records' digests."""
    start, html = F.substring(F.sha2(record(), 256), 1, 2), F.coalesce("html", F.lit(""))
    longer = F.concat(html, F.lit("!"))
    changed = F.concat(F.when(F.substring(html, 1, 1) == "X", "Y").otherwise("X"), F.substring(html, 2, 1 << 30))
    cut = F.substring(html, F.lit(1), F.floor(F.length(html) / 2).cast("int"))
    wrong = F.when((html == "") | (F.col("start") == CORRUPT[2]), longer).when(F.col("start") == CORRUPT[0], changed).otherwise(cut)
    rows = pages.select("page_id", "url", "html", start.alias("start")).where(~F.col("start").isin(*MISSING))
    return rows.select("page_id", "url", F.when(F.col("start").isin(*CORRUPT), wrong).otherwise(F.col("html")).alias("html"))


def op7_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the archive of pages, with the audit's verdict on a replica archive of damaged pages, hashed on its own."""
    pages = table(spark, sf_dir, "pages")
    records = materialise(manifest(pages), "records")
    found = audit_archive(records, materialise(manifest(damaged(pages)), "replica")).where("record_offset IS NOT NULL").select("record_offset", "status")
    return records.join(found, "record_offset", "left").select(
        "page_id", "record_offset", "record_length", "sha256", F.floor(F.col("record_offset") / RANGE_BYTES).alias("range_no"), F.coalesce("status", F.lit("ok")).alias("status")
    )


SQL = rf"""
WITH r AS (
  SELECT page_id, coalesce(url, '') AS url, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(page_id::VARCHAR, '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || octet_length(encode(coalesce(html, '')))::VARCHAR
    || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS rec FROM pages
), s AS (SELECT page_id, url, octet_length(encode(rec))::BIGINT AS record_length, sha256(rec) AS sha256 FROM r),
o AS (SELECT page_id, (sum(record_length) OVER (ORDER BY page_id NULLS FIRST, url, sha256 ROWS UNBOUNDED PRECEDING) - record_length)::BIGINT AS record_offset, record_length, sha256 FROM s)
SELECT page_id, record_offset, record_length, sha256, (record_offset // {RANGE_BYTES})::BIGINT AS range_no,
  CASE WHEN sha256[1:2] IN {CORRUPT} THEN 'corrupt' WHEN sha256[1:2] IN {MISSING} THEN 'missing' ELSE 'ok' END AS status
FROM o
"""

QUERIES = {"op7_fixity": op7_fixity}
ORACLES = {"op7_fixity": SQL}
