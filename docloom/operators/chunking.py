"""Cutting pages into chunks, as expressions over arrays: split, fold, explode.

Nothing here shuffles: a page's chunks are made in its row and then exploded. A fold
(``aggregate``) copies its state at every step, so none goes over a page's lines or sentences:
where units and chunks begin is looked up in running sums and by pointer doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.config import Config
from docloom.functions.text import chunk_strategy, exploded, let, ws_trim

#: From coarse to fine. Fixed values.
SEPARATORS = ("\n\n", "\n", "。", "！", "？", "；", ". ", "! ", "? ", "; ", "，", "、", ", ", " ")
#: Heading of a figure's or table's text. Fixed values.
HEADING = r"^(【图内文字\s*[^】]*】|【表格\s*[^】]*】|【图像表格\s*[^】]*】)"
FIGURE = r"^【图内文字\s*([^】]*)】"

STRINGS = "array<string>"
UNIT = "struct<text:string,kind:string,figure_id:string>"


def _empty(kind: str = STRINGS) -> Column:
    return F.array().cast(kind)


def _unit(text: Column, kind: Column | str, figure: Column | str = "") -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(text.alias("text"), lit(kind).alias("kind"), lit(figure).alias("figure_id"))


def split_after(s: Column, separator: str) -> Column:
    """Pieces that keep the separator at their right end."""
    return F.filter(F.split(s, "(?<=\\Q" + separator + "\\E)"), lambda p: p != "")


def merge_pieces(pieces: Column, size: int) -> Column:
    """Neighbours joined while they fit. A fold, for as many pieces as a page has; see split_merged for any text."""
    start = F.struct(_empty().alias("done"), F.lit("").alias("last"))

    def step(a: Column, p: Column) -> Column:
        fits = (a["last"] == "") | (F.length(a["last"]) + F.length(p) <= size)
        return F.when(fits, F.struct(a["done"].alias("done"), F.concat(a["last"], p).alias("last"))).otherwise(F.struct(F.array_append(a["done"], a["last"]).alias("done"), p.alias("last")))

    return F.aggregate(F.filter(pieces, lambda p: p != ""), start, step, lambda a: F.when(a["last"] == "", a["done"]).otherwise(F.array_append(a["done"], a["last"])))


def split_merged(s: Column, separator: str, size: int) -> Column:
    """merge_pieces of split_after, in one pass: the rest if it fits, else the longest part that ends in a separator
    and fits, else all up to the first separator, else the rest.
    """
    end = "(?<=\\Q" + separator + "\\E)"
    return F.regexp_extract_all(s, F.lit(f"(?s).{{1,{size}}}\\z|.{{1,{size}}}{end}|.+?{end}|.+"), 0)


def hard_cut(s: Column, size: int, overlap: int = 0) -> Column:
    """Windows of size characters; the last is the first that reaches the end.

    By one pass of an expression that looks size characters ahead and moves on by size less overlap.
    """
    step = max(1, size - max(0, overlap))
    found = F.regexp_extract_all(s, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), 1)
    n = F.greatest(F.ceil((F.length(s) - size) / float(step)), F.lit(0)).cast("int") + 1
    return F.when(F.length(s) == 0, _empty()).otherwise(F.slice(found, F.lit(1), n))


def with_overlap(chunks: Column, overlap: int, size: int) -> Column:
    """Each chunk begins with the tail of the one before, as far as there is room."""
    if overlap <= 0:
        return chunks
    before = F.slice(F.concat(F.array(F.lit(None).cast("string")), chunks), F.lit(1), F.size(chunks))

    def join(pair: Column) -> Column:
        c, p = pair["c"], pair["p"]
        take = F.least(F.lit(overlap), F.greatest(F.lit(0), size - F.length(c)), F.length(p))
        tail = F.right(p, take)
        return F.when(p.isNull() | (take <= 0) | c.startswith(tail), c).otherwise(ws_trim(F.concat(tail, c)))

    return F.transform(F.zip_with(chunks, before, lambda c, p: F.struct(c.alias("c"), p.alias("p"))), join)


def merge_tiny(chunks: Column, least: int) -> Column:
    """Chunks shorter than least go to the one before; a short last one as well."""
    if least <= 1:
        return F.filter(F.transform(chunks, ws_trim), lambda c: c != "")


    def joined(v: Column) -> Column:
        """Every chunk that isn't short, and the first, opens a group."""
        n = F.size(v["c"])
        opens = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (F.length(F.get(v["c"], i)) >= least))
        whole = F.struct(v["c"].alias("c"), opens.alias("at"), n.alias("n"))
        groups = let(whole, lambda g: F.transform(g["at"], lambda i, j: F.array_join(F.slice(g["c"], i + 1, F.coalesce(F.get(g["at"], j + 1), g["n"]) - i), "")))
        return F.when(n == 0, _empty()).otherwise(groups)

    return let(F.struct(F.filter(F.transform(chunks, ws_trim), lambda c: c != "").alias("c")), joined)


def with_recursive_chunks(df: DataFrame, text: str | Column, into: str, size: int = 300, overlap: int = 50, least: int = 90, separators=SEPARATORS) -> DataFrame:
    """Adds array<string> into: pieces over the size are split again by the next finer separator, last by length.

    One select for each separator; each level is an expression over the one before.
    """
    raw = F.col("__raw")
    df = df.withColumn("__raw", ws_trim(text)).withColumn(into, F.array(raw))
    for s in separators:
        df = df.withColumn(into, F.flatten(F.transform(into, _finer(s, size))))
    df = df.withColumn(into, F.flatten(F.transform(into, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(hard_cut(p, size)))))
    df = df.withColumn(into, merge_tiny(with_overlap(F.col(into), overlap, size), least))
    return df.withColumn(into, F.when(raw == "", _empty()).when(F.length(raw) <= size, F.array(raw)).otherwise(F.col(into))).drop("__raw")


def _finer(separator: str, size: int):
    """A piece within the size stays, and one without the separator is for the next level."""
    return lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(_trimmed(split_merged(p, separator, size)))


def _trimmed(pieces: Column) -> Column:
    return F.filter(F.transform(pieces, ws_trim), lambda p: p != "")


def running_sums(values: Column) -> Column:
    """Sums up to and with each element, in as many rounds as the size has bits: a fold over the elements would copy its state for each."""

    def doubled(sums: Column, k: Column) -> Column:
        return F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0)))

    return let(values, lambda v: F.aggregate(_rounds(v), v, doubled))


def chain(jump: Column) -> Column:
    """0 and the places that following jump (array<int>, null at the end) leads to, by pointer doubling: each round has twice
    the places and jumps twice as far.
    """

    def doubled(s: Column, _: Column) -> Column:
        on = F.filter(F.transform(s["at"], lambda i: F.get(s["jump"], i)), lambda i: i.isNotNull())
        return F.struct(F.concat(s["at"], on).alias("at"), F.transform(s["jump"], lambda j: F.get(s["jump"], j)).alias("jump"))

    start = lambda j: F.struct(F.array(F.lit(0)).alias("at"), j.alias("jump"))
    return let(jump, lambda j: F.when(F.size(j) == 0, _empty("array<int>")).otherwise(F.aggregate(_rounds(j), start(j), doubled, lambda s: s["at"])))


def _rounds(a: Column) -> Column:
    return F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(a), F.lit(1)))).cast("int"))


def _last_within(sums: Column, i: Column, bound: Column, size: int) -> Column:
    """How many elements from the first have a sum within the bound, or i if that is fewer; more than size after i never have."""
    steps = [F.lit(1 << k) for k in reversed(range(max(1, size).bit_length() + 1))]
    return F.aggregate(F.array(*steps), i, lambda j, step: F.when(F.get(sums, j + step - 1) <= bound, j + step).otherwise(j))


def structural_units(text: str | Column) -> Column:
    """array<UNIT>: runs of table rows, headed figures or tables, and the text between them.

    A headed unit ends at the next heading or table row, or at its second blank line in a row.
    """
    found = F.split(F.regexp_replace(ws_trim(text), r"\r\n|\r", "\n"), "\n")

    def line(x: Column) -> Column:
        t = ws_trim(x)
        return let(t, lambda t: F.struct(F.when(t.rlike(HEADING), t).otherwise(x).alias("line"), t.startswith("|").alias("row"), t.rlike(HEADING).alias("head"), (t == "").alias("blank")))

    return let(F.transform(found, line), _units_of)


def _units_of(lines: Column) -> Column:
    """array<UNIT> of array<struct<line, row, head, blank>>. Where a unit begins shows in a line and the one before it."""
    at = lambda i: F.get(lines, i)
    begins = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | at(i)["head"] | (at(i)["row"] != at(i - 1)["row"]))
    spans = let(begins, lambda b: F.transform(b, lambda i, k: F.struct(i.alias("at"), F.coalesce(F.get(b, k + 1), F.size(lines)).alias("end"))))

    def parts(span: Column) -> Column:
        """The span, or what lies before and after the second blank line below a heading."""
        own = F.sequence(span["at"], span["end"] - 1)
        gap = F.get(F.filter(own, lambda i: at(i)["blank"] & at(i - 1)["blank"]), F.lit(0))
        part = lambda a, b, headed: F.struct(a.alias("at"), b.alias("end"), F.lit(headed).alias("headed"))
        two = lambda g: F.array(part(span["at"], F.coalesce(g, span["end"]), True), part(F.coalesce(g + 1, span["end"]), span["end"], False))
        return F.when(at(span["at"])["head"], let(gap, two)).otherwise(F.array(part(span["at"], span["end"], False)))

    def unit(p: Column) -> Column:
        # by places: a slice would go through all lines for each unit
        own = ws_trim(F.array_join(F.transform(F.sequence(p["at"], p["end"] - 1), lambda i: at(i)["line"]), "\n"))
        first = at(p["at"])
        figure = first["line"].startswith("【图内") | first["line"].startswith("【图像表格")
        kind = F.when(first["row"], "table").when(~p["headed"], "text").when(figure, "figure").otherwise("table")
        number = F.when(p["headed"] & figure, ws_trim(F.regexp_extract(first["line"], FIGURE, 1))).otherwise("")
        return _unit(own, kind, number)

    whole = F.filter(F.flatten(F.transform(spans, parts)), lambda p: p["at"] < p["end"])
    return F.filter(F.transform(whole, unit), lambda u: u["text"] != "")


def hard_split(s: Column, size: Column) -> Column:
    """Pieces of at most size characters, cut after the last comma or blank in the last two thirds, where more follows than fits."""
    n = lambda x: x.cast("int").cast("string")
    pattern = F.concat(F.lit("(?s)(?=.{"), n(size + 1), F.lit("}).{"), n(F.floor(size / 3)), F.lit(","), n(size - 1), F.lit("}[，、, ]|.{1,"), n(size), F.lit("}"))
    return _trimmed(F.regexp_extract_all(s, pattern, 0))


#: Where a sentence ends. Fixed value.
SENTENCE = r"(?<=[。！？；.!?;])(?U)\s*"


def split_sentences(s: Column) -> Column:
    return _trimmed(F.split(s, r"\n+|" + SENTENCE))


def pack_sentences(text: Column, size: int, overlap: int, marker: Column) -> Column:
    """Sentences joined by line ends up to the size less the marker's; too long ones are cut.

    A full chunk's tail opens the next one where there is room. Where a chunk ends depends on
    where it begins alone, so ends are looked up for every sentence in running sums of lengths,
    and the chain of ends from the first sentence is what is made. (A tail's blanks count as
    part of its length, also where they were trimmed off a chunk shorter than the overlap.)
    """
    limit = F.when(marker == "", F.lit(size)).otherwise(F.greatest(F.lit(32), size - F.length(marker) - 1))
    sentences = F.filter(split_sentences(text), lambda x: ~x.rlike(FIGURE) | (marker == ""))

    def packed(v: Column) -> Column:
        s, most = v["s"], v["most"]
        long = lambda i: F.length(F.get(s, i)) > most
        room = lambda i: F.least(F.lit(overlap), F.greatest(F.lit(0), most - F.length(F.get(s, i)) - 1))
        carried = lambda i: F.when((i == 0) | long(i) | long(i - 1), 0).otherwise(room(i))
        taken = lambda i: let(carried(i), lambda c: F.when(c > 0, c + 1).otherwise(0))

        def ends(sums: Column) -> Column:
            """For each sentence the first that isn't in its chunk; null for none."""
            end = lambda i: F.greatest(i + 1, _last_within(sums, i, F.coalesce(F.get(sums, i - 1), F.lit(0)) + 1 + most - taken(i), max(size, 32)))
            return F.transform(s, lambda _, i: let(end(i), lambda e: F.when(e < F.size(s), e)))

        def chunk(i: Column, end: Column) -> Column:
            back = F.sequence(F.greatest(i - 1 - overlap // 2, F.lit(0)), F.greatest(i - 1, F.lit(0)))
            tail = let(carried(i), lambda c: F.when(c > 0, F.concat(F.right(F.array_join(F.transform(back, lambda j: F.get(s, j)), "\n"), c), F.lit("\n"))).otherwise(""))
            body = F.array_join(F.transform(F.sequence(i, end - 1), lambda j: F.get(s, j)), "\n")
            return F.when(long(i), hard_split(F.get(s, i), most)).otherwise(F.array(ws_trim(F.concat(tail, body))))

        sums = running_sums(F.transform(s, lambda x: F.length(x) + 1))
        begins = chain(let(sums, ends))
        return let(begins, lambda b: F.flatten(F.transform(b, lambda i, k: chunk(i, F.coalesce(F.get(b, k + 1), F.size(s))))))

    return let(F.struct(sentences.alias("s"), limit.alias("most")), packed)


def split_table(table: Column, size: int) -> Column:
    """A long table's rows in pieces that each begin with its header. An empty row opens no piece."""
    rows = F.split(table, "\n")
    ruled = (F.size(rows) >= 2) & F.trim(F.get(rows, F.lit(1))).rlike(r"^\|?\s*:?-{3,}")
    heads = F.when(ruled, 2).when(F.trim(F.get(rows, F.lit(0))).startswith("|"), 1).otherwise(0)
    header = F.array_join(F.slice(rows, F.lit(1), heads), "\n")
    body = F.slice(rows, heads + 1, F.size(rows))

    def pieces(v: Column) -> Column:
        r, head = v["r"], v["head"]
        width = F.when(head == "", 0).otherwise(F.length(head) + 1)

        def ends(sums: Column) -> Column:
            end = lambda i: F.when(F.get(r, i) == "", i + 1).otherwise(F.greatest(i + 1, _last_within(sums, i, F.coalesce(F.get(sums, i - 1), F.lit(0)) + size - width, size)))
            return F.transform(r, lambda _, i: let(end(i), lambda e: F.when(e < F.size(r), e)))

        def piece(i: Column, end: Column) -> Column:
            own = F.array_join(F.transform(F.sequence(i, end - 1), lambda j: F.get(r, j)), "\n")
            return F.when(F.get(r, i) != "", ws_trim(F.when(head == "", own).otherwise(F.concat(head, F.lit("\n"), own))))

        begins = chain(let(running_sums(F.transform(r, lambda x: F.length(x) + 1)), ends))
        return let(begins, lambda b: F.filter(F.transform(b, lambda i, k: piece(i, F.coalesce(F.get(b, k + 1), F.size(r)))), lambda p: p.isNotNull()))

    alone = F.filter(F.array(ws_trim(header)), lambda h: h != "")
    return F.when(F.size(rows) <= heads, alone).otherwise(let(F.struct(body.alias("r"), header.alias("head")), pieces))


def figure_marker(figure: Column) -> Column:
    return F.when(figure == "", "【图内文字】").otherwise(F.concat(F.lit("【图内文字 "), figure, F.lit("】")))


def pack_units(units: Column, size: int, overlap: int) -> Column:
    """Units cut to the size: tables by rows, text and figures by sentences; figures keep their marker."""

    def pack(u: Column) -> Column:
        tables = F.transform(F.when(F.length(u["text"]) <= size, F.array(u["text"])).otherwise(split_table(u["text"], size)), lambda t: _unit(t, "table"))
        headed = (u["kind"] == "figure") & F.split(u["text"], "\n")[0].rlike(FIGURE)
        body = F.when(headed, ws_trim(F.regexp_replace(u["text"], r"^[^\n]*\n?", ""))).otherwise(u["text"])
        marked = (u["kind"] == "figure") & (u["figure_id"] != "")
        marker = F.when(marked, figure_marker(u["figure_id"])).otherwise("")
        chunks = pack_sentences(body, size, overlap, marker)
        packed = F.transform(chunks, lambda t: _unit(F.when(marked, F.concat(marker, F.lit("\n"), t)).otherwise(t), u["kind"], u["figure_id"]))
        return F.when(u["kind"] == "table", tables).when(body == "", _empty(f"array<{UNIT}>")).otherwise(packed)

    return F.flatten(F.transform(units, pack))


def merge_tiny_units(units: Column, least: int) -> Column:
    """Short units go to the one before of the same kind, figures only to the same figure."""

    def merged(v: Column) -> Column:
        u = v["u"]
        at = lambda i: F.get(u, i)
        same = lambda i: (at(i)["kind"] == at(i - 1)["kind"]) & ((at(i)["kind"] != "figure") | (at(i)["figure_id"] == at(i - 1)["figure_id"]))
        begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size(u) - 1, F.lit(0))), lambda i: (i == 0) | (F.length(at(i)["text"]) >= least) | ~same(i))

        def group(i: Column, end: Column) -> Column:
            texts = F.filter(F.transform(F.sequence(i, end - 1), lambda j: at(j)["text"]), lambda t: t != "")
            return _unit(F.array_join(texts, "\n"), at(i)["kind"], at(i)["figure_id"])

        groups = let(begins, lambda b: F.transform(b, lambda i, k: group(i, F.coalesce(F.get(b, k + 1), F.size(u)))))
        return F.when(F.size(u) == 0, _empty(f"array<{UNIT}>")).otherwise(groups)

    return let(F.struct(units.alias("u")), merged)


def with_units(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Adds units, the array<UNIT> of a page's text by its strategy."""
    plain = F.when(F.col("strategy") == "recursive", F.col("text"))
    df = with_recursive_chunks(pages, plain, "__plain", config.chunk_size, config.chunk_overlap, config.min_chunk_chars)
    df = df.withColumn("__parts", structural_units(F.when(F.col("strategy") != "recursive", F.col("text"))))
    df = df.withColumn("__packed", pack_units(F.col("__parts"), config.chunk_size, config.chunk_overlap))
    units = F.when(F.col("strategy") == "recursive", F.transform("__plain", lambda t: _unit(t, "text"))).otherwise(F.col("__packed"))
    return df.withColumn("units", merge_tiny_units(units, config.min_chunk_chars)).drop("__plain", "__parts", "__packed")


def chunk_pages(pages: DataFrame, config: Config = Config(), strategy: str = "auto") -> DataFrame:
    """pages (doc_id, page, text, source_ext) -> id, doc_id, chunk_index, page, kind, strategy, figure_id, text, source_ext.

    Page 0 or an unreadable one counts as 1 while cutting; text files are stored with page 0.
    """
    page = F.coalesce(F.expr("try_cast(page AS int)"), F.lit(0))
    page = F.when(page == 0, 1).otherwise(page)
    rows = pages.where(ws_trim("text") != "").select("doc_id", page.alias("page"), "text", "source_ext", chunk_strategy("text", "source_ext", strategy).alias("strategy"))
    # dealt by document before cutting: the index below needs that anyway, and texts are smaller than their chunks
    rows = rows.repartition("doc_id")
    # a page of one strategy is an empty text to the other
    units = exploded(with_units(rows, config), "units", "at", "u", "doc_id", "page", "source_ext", "strategy")
    found = F.when(F.col("u.figure_id") != "", F.col("u.figure_id")).when(F.col("u.kind") == "figure", ws_trim(F.regexp_extract("u.text", FIGURE, 1))).otherwise("")
    figure = F.when(found.rlike(r"^\d+$"), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("-"), found)).otherwise(found)
    stamped = F.concat(figure_marker(F.col("figure_id")), F.lit("\n"), ws_trim(F.regexp_replace("u.text", FIGURE + r"[^\n]*\n?", "")))
    units = units.withColumn("figure_id", figure)
    text = F.when((F.col("u.kind") == "figure") & (F.col("figure_id") != ""), stamped).otherwise(F.col("u.text"))
    index = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "at")) - 1
    out = units.select("doc_id", index.alias("chunk_index"), "page", F.col("u.kind").alias("kind"), "strategy", "figure_id", text.alias("text"), "source_ext")
    stored = F.when(F.lower("source_ext") == "txt", 0).otherwise(F.col("page"))
    return out.select(F.concat(F.col("doc_id").cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("id"), *(c if c != "page" else stored.alias("page") for c in out.columns))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("kind", "strategy").agg(F.count("*").alias("n"))
