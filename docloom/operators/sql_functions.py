"""The library's functions for users of SQL text alone: temporary functions whose bodies are SQL.

    register(spark)
    SELECT doc_id, c.at, c.piece FROM documents, LATERAL docloom_chunks(text, 300, 50, 90) c

    register_search(spark, "questions", "chunks")
    SELECT * FROM docloom_search(5)

Bodies in SQL are inlined by the optimizer, as the column functions are: filters and columns
reach the scan through them, and nothing but the model of docloom_embed runs in Python. A
lateral join of a cutting function is a generator over the row, without a join. A search is a
table function over two tables, an equi-join by doc_id and a window, as ``retrieval.knn`` is:
one of a row's vector, joined laterally, would be decorrelated by the vector, to a nested loop
of all vectors with all chunks.

Cases: a null text counts as empty, which has no pieces; a size under 1 is an error, an overlap
under 0 counts as 0. A question whose vector or doc_id is null finds nothing; a chunk without a
vector isn't found. Ties go by chunk_index; fewer chunks than asked for are all of them.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from docloom.config import EMBED_INSTRUCTION
from docloom.functions.text import ELLIPSIS, READ_ERRORS, STRUCTURE

from .chunking import SEPARATORS
from .embedding import embedder

NONE = "CAST(array() AS ARRAY<STRING>)"


def _let(name: str, value: str, body: str) -> str:
    """As ``text.let``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _trim(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), r'(?U)^\s+|\s+$', '')"


def _rtrim(x: str) -> str:
    return rf"regexp_replace({x}, r'(?U)\s+$', '')"


def _trimmed(pieces: str) -> str:
    return f"filter(transform({pieces}, x -> {_trim('x')}), x -> x <> '')"


def _windows(text: str, size: str, overlap: str) -> str:
    step = f"greatest(1, {size} - greatest(0, {overlap}))"
    found = f"regexp_extract_all({text}, concat('(?s)(?=(.{{1,', {size}, '}})).{{1,', {step}, '}}'), 1)"
    n = f"CAST(greatest(ceil((length({text}) - {size}) / CAST({step} AS DOUBLE)), 0) AS INT) + 1"
    return f"CASE WHEN length({text}) = 0 THEN {NONE} ELSE slice({found}, 1, {n}) END"


def _chunks(text: str, size: str, overlap: str, least: str) -> str:
    """``chunking.with_recursive_chunks`` in SQL."""
    fits = f"length(p) <= {size}"
    cut = "array(v)"
    for separator in SEPARATORS:
        end = rf"(?<=\Q{separator}\E)"
        pattern = rf"concat('(?s).{{1,', {size}, r'}}\z|.{{1,', {size}, r'}}{end}|.+?{end}|.+')"
        cut = f"flatten(transform({cut}, p -> CASE WHEN {fits} THEN array(p) ELSE {_trimmed(f'regexp_extract_all(p, {pattern}, 0)')} END))"
    cut = f"flatten(transform({cut}, p -> CASE WHEN {fits} THEN array(p) ELSE {_windows('p', size, '0')} END))"
    take = f"least({overlap}, greatest(0, {size} - length(a)), length(b))"
    joined = f"CASE WHEN b IS NULL OR {take} <= 0 OR startswith(a, right(b, {take})) THEN a ELSE {_trim(f'concat(right(b, {take}), a)')} END"
    before = "slice(concat(array(CAST(NULL AS STRING)), c), 1, size(c))"
    cut = _let("c", cut, f"zip_with(c, {before}, (a, b) -> {joined})")
    opens = f"filter(sequence(0, greatest(size(d) - 1, 0)), i -> i = 0 OR {least} <= 1 OR length(get(d, i)) >= {least})"
    groups = _let("g", opens, "transform(g, (i, j) -> array_join(slice(d, i + 1, coalesce(get(g, j + 1), size(d)) - i), ''))")
    cut = _let("d", _trimmed(cut), f"CASE WHEN size(d) = 0 THEN {NONE} ELSE {groups} END")
    return _let("v", _trim(text), f"CASE WHEN v = '' THEN {NONE} WHEN length(v) <= {size} THEN array(v) ELSE {cut} END")


def _clip(text: str, n: str) -> str:
    cut = f"CASE WHEN {n} = 1 THEN '{ELLIPSIS}' ELSE concat({_rtrim(f'substring(v, 1, {n} - 1)')}, '{ELLIPSIS}') END"
    return _let("v", _trim(text), f"CASE WHEN {n} <= 0 OR length(v) <= {n} THEN v ELSE {cut} END")


def _question(q: str) -> str:
    return _let("v", _trim(q), f"CASE WHEN v = '' THEN '' WHEN startswith(v, '{EMBED_INSTRUCTION}') THEN v ELSE concat('{EMBED_INSTRUCTION}', v) END")


def _read_error(text: str) -> str:
    return " OR ".join([f"{_trim(text)} = ''", *(f"startswith({text}, '{p}')" for p in READ_ERRORS)])


def _strategy(text: str, ext: str) -> str:
    suffix = f"regexp_replace(lower(coalesce({ext}, '')), r'^\\.+', '')"
    return f"CASE WHEN {suffix} = 'txt' THEN 'recursive' WHEN coalesce({text}, '') RLIKE r'{STRUCTURE}' THEN 'structure' ELSE 'recursive' END"


def _dot(a: str, b: str) -> str:
    n = f"least(size({a}), size({b}))"
    return f"aggregate(zip_with(slice({a}, 1, {n}), slice({b}, 1, {n}), (x, y) -> x * y), 0.0D, (s, x) -> s + x)"


def _l2(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> (x - y) * (x - y)), 0.0D, (s, x) -> s + x)"


#: name: parameters, result and body.
FUNCTIONS = {
    "docloom_trim": ("t STRING", "STRING", _trim("t")),
    "docloom_clip": ("t STRING, n INT", "STRING", _clip("t", "n")),
    "docloom_question": ("q STRING", "STRING", _question("q")),
    "docloom_read_error": ("t STRING", "BOOLEAN", _read_error("t")),
    "docloom_strategy": ("t STRING, ext STRING", "STRING", _strategy("t", "ext")),
    "docloom_dot": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _dot("a", "b")),
    "docloom_l2": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", _l2("a", "b")),
}
#: name: parameters and body, an array whose elements are the rows.
TABLE_FUNCTIONS = {
    "docloom_windows": ("t STRING, most INT, overlap INT", _let("w", "coalesce(docloom_windows.t, '')", _windows("w", "docloom_windows.most", "docloom_windows.overlap"))),
    "docloom_chunks": ("t STRING, most INT, overlap INT, least INT", _chunks(*(f"docloom_chunks.{p}" for p in ("t", "most", "overlap", "least")))),
}


def register(spark: SparkSession, embed=None) -> None:
    """Creates the functions in the session, and docloom_embed of the given model (``embedder``'s)."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    for name, (parameters, body) in TABLE_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE(at INT, piece STRING) RETURN SELECT pos, col FROM (SELECT posexplode({body}))")
    spark.udf.register("docloom_embed", embed or embedder())


#: Smaller is nearer.
DISTANCES = {"cosine": "1.0D - docloom_dot(q.vector, c.embedding)", "ip": "-docloom_dot(q.vector, c.embedding)", "l2": "docloom_l2(q.vector, c.embedding)"}


def register_search(spark: SparkSession, questions: str, chunks: str, name: str = "docloom_search", space: str = "l2") -> None:
    """Creates a table function name(k) over tables or views questions (query_id, doc_id, vector) and chunks (doc_id, chunk_index, embedding).

    It gives query_id, rank, doc_id, chunk_index and distance of each question's k nearest chunks
    of its document. register comes first.
    """
    kind = lambda table, column: spark.table(table).schema[column].dataType.simpleString()
    shape = f"query_id {kind(questions, 'query_id')}, rank INT, doc_id {kind(chunks, 'doc_id')}, chunk_index {kind(chunks, 'chunk_index')}, distance DOUBLE"
    near = f"SELECT q.query_id, c.doc_id, c.chunk_index, {DISTANCES[space]} AS distance FROM {questions} q JOIN {chunks} c ON q.doc_id = c.doc_id WHERE q.vector IS NOT NULL AND c.embedding IS NOT NULL"
    ranked = f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_index) AS rank FROM ({near})"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(k INT) RETURNS TABLE({shape}) RETURN SELECT query_id, rank, doc_id, chunk_index, distance FROM ({ranked}) WHERE rank <= {name}.k")
