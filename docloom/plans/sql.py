"""The registered queries in DuckDB's SQL."""

from __future__ import annotations

#: Values that results depend on, written out: nothing of the library is imported here.
DOC_HINT = r"(?i)(订单|合同|条款|金额|单价|总价|页码|第\s*\d+\s*页|比例|税率|日期|交付|编号|单号|发票|附件|定义|多少|几号|哪一章|哪一节)"
MEMORY_HINT = r"(?i)(之前|刚才|上次|我们聊|聊过|说过|回顾|总结一下对话|对话里|你记得)"
POINTS_BACK = r"(那|这|它|他|她|该|上述|上面|刚才|之前|这个|那个|哪个|多少来着|呢\s*$|吗\s*$)"
READ_ERRORS = ("[错误：", "[PDF解析错误", "[TXT读取错误", "[不支持的文件类型")
FACT_PREFIXES = ("- ", "• ", "* ", "· ", "– ", "— ")
INSTRUCTION = "为这个句子生成表示以用于检索相关文章："

#: What is white space in all of Unicode.
WS = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def trim(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '^{WS}+|{WS}+$', '', 'g')"


def rtrim(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"


def squeeze(x: str) -> str:
    return f"regexp_replace(coalesce({x}, ''), '{WS}+', '', 'g')"


def clip(x: str, n: int) -> str:
    t = trim(x)
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE {rtrim(f'substr({t}, 1, {n - 1})')} || '…' END"


def starts(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, '{p}')" for p in prefixes) + ")"


def windows(size: int = 300, overlap: int = 50) -> str:
    step = size - overlap
    n = f"CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(ceil((length(text) - {size}) / {step}.0), 0)::INT + 1 END"
    return f"(SELECT doc_id, i::INT AS chunk_index, (i // 4 + 1)::INT AS page, substr(text, (i * {step} + 1)::BIGINT, {size}) AS text FROM (SELECT doc_id, text, unnest(range({n})) AS i FROM documents))"


QUESTIONS = "(SELECT doc_id AS query_id, doc_id, b.text AS question FROM documents d JOIN benchmark b ON d.doc_id % (SELECT count(*) FROM benchmark) = b.item_id)"
TURNS = f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM (SELECT conv_id, turn, role, {trim('text')} AS content FROM conversations WHERE role IN ('user', 'assistant') AND {trim('text')} <> ''))"
LINE = "CASE WHEN role = 'user' THEN '用户：' ELSE '助手：' END || content"


def dot(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


SCORE = {"cosine": "greatest(0, least(1, 1.0::DOUBLE - (1.0::DOUBLE - d)))"}
_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {}))"
PAIRS = "(SELECT a.vec_id AS query_id, b.vec_id AS chunk_index, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON a.vec_id // 200 = b.vec_id // 200 WHERE a.vec_id % 10 = 0)"
L2 = "list_sum(list_transform(list_zip(x::DOUBLE[], y::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"


def bigram(q: str, t: str) -> str:
    """Over columns q and t that are squeezed and lower already."""
    grams = lambda c: f"CASE WHEN length({c}) < 2 THEN [{c}] ELSE list_distinct(list_transform(range(1, length({c})), lambda i: substr({c}, i, 2))) END"
    return f"CASE WHEN {q} = '' OR {t} = '' THEN 0.0 WHEN contains({t}, {q}) OR contains({q}, {t}) THEN 0.95 ELSE len(list_intersect({grams(q)}, {grams(t)})) / len({grams(q)})::DOUBLE END"


def boost(q: str, q2: str, t: str) -> str:
    four = f"list_transform(range(1, length({q2}) - 2), lambda i: substr({q2}, i, 4))"
    return f"CASE WHEN {q} = '' OR {t} = '' THEN 0.0 WHEN contains({t}, {q}) THEN 0.55 WHEN length({q2}) >= 4 AND contains({t}, {q2}) THEN 0.5 WHEN length({q2}) >= 4 AND len(list_filter({four}, lambda g: contains({t}, g))) / len({four})::DOUBLE >= 0.4 THEN 0.35 ELSE 0.0 END::DOUBLE"


MARKS = "[？?。！!，,、：:]+"
FACT = f"regexp_replace({trim('l')}, '^(" + "|".join(p.replace("*", r"\*") for p in FACT_PREFIXES) + ")', '')"
FACTS = f"""(SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS facts, arg_max(text, turn) AS question FROM (
  SELECT conv_id, turn, text, CASE WHEN turn % 3 = 0 THEN '- [pinned] ' ELSE '- ' END || regexp_replace(coalesce(text, ''), '[\\t-\\r ]+', ' ', 'g') AS line FROM conversations) GROUP BY conv_id)"""
FACT_LINES = f"""(SELECT conv_id, question, no - 1 AS no, line FROM (SELECT conv_id, question, unnest(ls) AS line, generate_subscripts(ls, 1) AS no FROM (
  SELECT conv_id, question, list_filter(list_transform(string_split(facts, chr(10)), lambda l: {trim(FACT)}), lambda x: x <> '') AS ls FROM {FACTS})))"""
KEY = "lower(" + squeeze(f"regexp_replace({trim('line')}, '(?i)^\\[pinned\\]', '')") + ")"
KEYED = f"regexp_replace(regexp_replace(regexp_replace({squeeze('line')}, '[\\x{{200b}}\\x{{200c}}\\x{{200d}}\\x{{feff}}\\x{{a0}}]', '', 'g'), '[（(]第[0-9]+(?:[、,，\\-–—][0-9]+)*页[）)]', '', 'g'), '^[\\-\\*0-9\\.、•]+', '')"
BOXES = """(SELECT l_orderkey, list({n: l_linenumber, x0: (l_partkey * 7 % 200)::DOUBLE, y0: ((l_suppkey * 13 + l_linenumber * 5) % 300)::DOUBLE} ORDER BY l_linenumber, (l_partkey * 7 % 200), ((l_suppkey * 13 + l_linenumber * 5) % 300)) AS boxes FROM lineitem GROUP BY 1)"""
REGISTRY = "(SELECT user_id::VARCHAR AS doc_id, max(ts) AS created_at, max(event_id)::VARCHAR AS conversation_id FROM events GROUP BY user_id)"
CONVERSATIONS = "(SELECT conv_id::VARCHAR AS id, (conv_id * 3)::VARCHAR AS doc_id FROM conversations WHERE turn = 0)"
KEEP = f"(SELECT doc_id FROM {CONVERSATIONS} UNION SELECT doc_id FROM {REGISTRY} WHERE date_trunc('second', created_at) > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 12 HOURS)"
FIRST = f"(SELECT doc_id AS query_id, chunk_index + 1 AS rank, page, text FROM {windows()})"
ASKED = f"(SELECT query_id, q.doc_id, {squeeze('question')} AS q, regexp_replace({squeeze('question')}, '{MARKS}', '', 'g') AS q2 FROM {QUESTIONS} q)"
POOL = f"(SELECT query_id, chunk_index, page, text, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) AS rank FROM (SELECT q.query_id, w.chunk_index, w.page, w.text, {boost('q', 'q2', 't')} AS score FROM {ASKED} q JOIN (SELECT *, {squeeze('text')} AS t FROM {windows()}) w USING (doc_id)))"
NEEDLES = f"list_filter(list_transform([substr(text, 1, 12), right(text, 12), right(text, 12), substr(text, 545, 6) || chr(10) || substr(text, 501, 6)], lambda g: {trim('g')}), lambda g: g <> '')"


def trimmed(t: str, n: int) -> str:
    """A column without blanks at its ends, cut at n, back to the last blank line or line end in the second half."""
    h = f"substr({t}, 1, {n})"
    at = lambda mark, size: f"(CASE WHEN strpos(reverse({h}), {mark}) = 0 THEN -1 ELSE length({h}) - strpos(reverse({h}), {mark}) - {size - 1} END)"
    block, line = at("chr(10) || chr(10)", 2), at("chr(10)", 1)
    cut = f"(CASE WHEN {block} >= {n // 2} THEN {block} WHEN {line} >= {n // 2} THEN {line} ELSE {n} END)::BIGINT"
    return f"CASE WHEN length({t}) <= {n} THEN {t} ELSE {rtrim(f'substr({h}, 1, {cut})')} || '…' END"


def metrics(where: str = "true") -> str:
    return f"""(SELECT d.query_id, coalesce(r, 0)::BIGINT AS returned, coalesce(hp, 0) / 2.0::DOUBLE AS page_recall, CASE WHEN r > 0 THEN hp / r::DOUBLE ELSE 0 END AS page_precision,
  CASE WHEN len(needles) > 0 THEN coalesce(len(list_distinct(list_filter(needles, lambda g: contains(blob, g)))), 0) / len(needles)::DOUBLE END AS text_recall,
  CASE WHEN len(needles) > 0 THEN CASE WHEN r > 0 THEN wt / r::DOUBLE ELSE 0 END END AS text_precision
  FROM (SELECT doc_id AS query_id, {NEEDLES} AS needles FROM documents) d LEFT JOIN (
    SELECT query_id, count(*) AS r, count(DISTINCT page) FILTER (page IN (1, 3)) AS hp, count(*) FILTER (len(list_filter(needles, lambda g: contains(text, g))) > 0) AS wt, string_agg(text, chr(10) ORDER BY rank) AS blob
    FROM {POOL} p JOIN (SELECT doc_id AS query_id, {NEEDLES} AS needles FROM documents) n USING (query_id) WHERE {where} GROUP BY query_id) h USING (query_id))"""


HINTS = "['', '订单金额是多少', '我们之前聊了什么', '之前的合同金额', '那个呢'][(conv_id + turn) % 5 + 1]"
NAME = "['read_memory', 'search_chat', 'search_doc', 'finish'][turn % 4 + 1]"
LETTERS = "regexp_replace(coalesce(text, ''), '[^A-Za-z ]', '', 'g')"

SQL: dict[str, str] = {}

SQL["readable_documents"] = f"""SELECT doc_id, {trim('text')} = '' OR {starts("coalesce(text, '')", READ_ERRORS)} AS unreadable,
  CASE WHEN lang = 'en' THEN 'txt' ELSE 'pdf' END AS ext, true AS supported FROM documents"""
SQL["parse_strategy"] = f"""WITH s AS (SELECT doc_id, length({trim('text')}) % 97 AS n, doc_id % 101 / 100.0::DOUBLE AS c, doc_id % 3 = 0 AS bare, doc_id % 97 / 96.0::DOUBLE AS r1, doc_id % 13 / 100.0::DOUBLE AS r2 FROM documents),
t AS (SELECT *, CASE WHEN bare THEN 0 ELSE greatest(r1, r2) END AS m, NOT bare AND (r1 < 0.85 OR r2 < 0.85) AS part FROM s)
SELECT doc_id, CASE WHEN n >= 80 THEN false WHEN n = 0 AND c >= 0.15 THEN true ELSE n < 40 AND c >= 0.35 END AS needs_ocr,
  CASE WHEN n = 0 AND c >= 0.15 THEN 'full_ocr' WHEN n < 40 AND c >= 0.35 THEN 'full_ocr' WHEN n < 40 AND m >= 0.85 THEN 'full_ocr' WHEN n >= 80 AND part THEN 'hybrid'
    WHEN n > 0 AND part AND m >= 0.04 THEN 'hybrid' WHEN n > 0 THEN 'digital' WHEN part THEN 'hybrid' ELSE 'digital' END AS strategy FROM t"""
SQL["chunk_strategy"] = r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'recursive' WHEN doc_id % 4 = 1 OR regexp_matches(coalesce(text, ''), '(?m)【图内文字|【表格|【图像表格|^\s*\|.+\|\s*$') THEN 'structure' ELSE 'recursive' END AS strategy FROM documents"""
SQL["adaptive_params"] = f"""WITH c AS (SELECT doc_id, count(*)::INT AS n FROM {windows()} GROUP BY 1), k AS (SELECT *, CASE WHEN n <= 12 THEN 2 WHEN n <= 60 THEN 3 WHEN n <= 200 THEN 4 ELSE 5 END AS k FROM c),
f AS (SELECT *, greatest(3 * k, 8) AS fl FROM k)
SELECT doc_id, n AS chunks, k AS top_k, least(5, greatest(2, doc_id % 9))::INT AS asked_k, CASE WHEN doc_id % 5 <= 0 THEN 0 ELSE least(k, doc_id % 5) END::INT AS held_k,
  CASE WHEN n <= fl THEN n ELSE least(50, n, greatest(fl, ceil(n * 0.12::DOUBLE)::INT, 5 * k)) END::INT AS recall_k, least(50, greatest(fl, 5 * k))::INT AS free_recall_k,
  CASE WHEN n <= 10 THEN 0.05 WHEN doc_id % 2 = 0 THEN 0.12 ELSE 0.35 END::DOUBLE AS threshold FROM f"""
SQL["clipped_text"] = f"""SELECT doc_id, {clip('text', 80)} AS clipped, {trimmed('t', 400)} AS trimmed,
  CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{{:.1f}} KB', floor(n_chars / 102.4::DOUBLE + 0.5) / 10) ELSE format('{{:.1f}} MB', floor(n_chars / 104857.6::DOUBLE + 0.5) / 10) END AS size
  FROM (SELECT *, {trim('text')} AS t FROM documents)"""
SQL["router"] = f"""WITH q AS (SELECT conv_id, turn, {HINTS} AS h, {HINTS} || coalesce(text, '') AS q FROM conversations), r AS (SELECT *, regexp_matches(q, '{DOC_HINT}') AS d, regexp_matches(q, '{MEMORY_HINT}') AS m FROM q)
SELECT conv_id, turn, CASE WHEN d AND NOT m THEN 'fast_doc' WHEN m AND NOT d THEN 'fast_memory' ELSE 'planner' END AS path,
  CASE WHEN {trim('q')} = '' THEN false WHEN length({trim('q')}) < 10 THEN true ELSE regexp_matches({trim('q')}, '{POINTS_BACK}') END AS rewrite,
  CASE WHEN h = '' THEN false WHEN length(h) < 10 THEN true ELSE regexp_matches(h, '{POINTS_BACK}') END AS rewrite_hint FROM r"""
SQL["planner_decisions"] = f"""SELECT conv_id, turn, CASE role WHEN 'user' THEN 't' WHEN 'assistant' THEN 'look' ELSE '' END AS thought, {NAME} AS action,
  CASE WHEN role = 'system' THEN '' ELSE trim({LETTERS}) END AS action_input FROM conversations"""
SQL["hard_cut_chunks"] = f"SELECT * FROM {windows()}"
SQL["chunk_counts"] = f"SELECT doc_id, count(*) AS n_chunks, max(page) AS pages, sum(length(text))::BIGINT AS chars FROM {windows()} GROUP BY 1"
SQL["merged_pieces"] = r"""WITH p AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+$'), lambda x: x <> '') AS ps FROM documents),
f AS (SELECT doc_id, list_reduce(ps, lambda a, x: CASE WHEN length(string_split(a, chr(1))[-1]) + length(x) <= 300 THEN a || x ELSE a || chr(1) || x END) AS m FROM p WHERE len(ps) > 0),
s AS (SELECT doc_id, string_split(m, chr(1)) AS m FROM f)
SELECT doc_id, (generate_subscripts(m, 1) - 1)::INT AS piece_no, unnest(m) AS piece FROM s"""
_CUT = trim("text")
SQL["overlapped_chunks"] = f"""WITH d AS (SELECT doc_id, {_CUT} AS text FROM documents), c AS (SELECT doc_id, i::INT AS i, substr(text, (i * 250 + 1)::BIGINT, 250) AS t FROM (SELECT doc_id, text, unnest(range(CASE WHEN text = '' THEN 0 ELSE greatest(ceil((length(text) - 250) / 250.0), 0)::INT + 1 END)) AS i FROM d)),
l AS (SELECT *, lag(t) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM c), k AS (SELECT *, least(50, greatest(0, 280 - length(t)), length(p)) AS k FROM l)
SELECT doc_id, i AS chunk_index, CASE WHEN p IS NULL OR k <= 0 OR starts_with(t, right(p, k)) THEN t ELSE {trim('right(p, k) || t')} END AS text FROM k"""
SQL["sampled_chunks"] = f"""WITH w AS (SELECT doc_id, chunk_index, count(*) OVER (PARTITION BY doc_id) AS n FROM {windows()})
SELECT doc_id, chunk_index FROM w WHERE n <= 5 OR chunk_index IN (0, round_even((n - 1) / 4.0::DOUBLE, 0), round_even(2 * (n - 1) / 4.0::DOUBLE, 0), round_even(3 * (n - 1) / 4.0::DOUBLE, 0), n - 1)"""
SQL["knn_topk"] = f"SELECT query_id, chunk_index, {L2} AS distance FROM {PAIRS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {L2}, chunk_index) <= 8"
SQL["sql_search"] = f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY {L2}, chunk_index)::INT AS rank, query_id // 200 AS doc_id, chunk_index, {L2} AS distance
FROM {PAIRS} QUALIFY rank <= 6"""
SQL["sql_windows"] = f"SELECT doc_id, chunk_index, {clip('text', 60)} AS clipped, 'recursive' AS strategy, {trim('text')} = '' OR text LIKE '[错误：%' OR text LIKE '[PDF解析错误%' OR text LIKE '[TXT读取错误%' OR text LIKE '[不支持的文件类型%' AS unreadable FROM {windows(400, 80)}"
SQL["distance_scores"] = f"""WITH d AS (SELECT query_id, {L2} AS l2, {dot('x', 'y')} AS p FROM {PAIRS})
SELECT query_id, avg({_CLAMP.format('1.0::DOUBLE - l2 * l2 / 2.0::DOUBLE')}) AS mean_l2, avg({_CLAMP.format('1.0::DOUBLE - (1.0::DOUBLE - p)')}) AS mean_cosine, avg({_CLAMP.format('abs(-p)')}) AS mean_ip, max(p) AS best FROM d GROUP BY 1"""
_COS = f"(SELECT query_id, chunk_index, 1.0::DOUBLE - {dot('x', 'y')} AS d FROM {PAIRS})"
SQL["threshold_fallback"] = f"""WITH n AS (SELECT * FROM {_COS} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_index) <= 8), s AS (SELECT query_id, chunk_index, {_CLAMP.format('1.0::DOUBLE - d')} >= CASE WHEN query_id % 20 = 0 THEN 1.5 ELSE 0.5 END AS o FROM n WHERE query_id <> chunk_index)
SELECT query_id, chunk_index FROM s QUALIFY o OR NOT bool_or(o) OVER (PARTITION BY query_id)"""
SQL["rerank_topk"] = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_index) AS r0 FROM {_COS} QUALIFY r0 <= 10), s AS (SELECT *, {_CLAMP.format('1.0::DOUBLE - d')} AS sc FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, d, chunk_index) AS r FROM s QUALIFY r <= 8), l AS (SELECT *, ((chunk_index * 7 + query_id) % 11 - 5)::DOUBLE AS x FROM r),
g AS (SELECT query_id, chunk_index, r, CASE WHEN x >= 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-x)) ELSE exp(x) / (1.0::DOUBLE + exp(x)) END AS score FROM l), k AS (SELECT * FROM g QUALIFY score >= 0.5 OR NOT bool_or(score >= 0.5) OVER (PARTITION BY query_id))
SELECT query_id, rank, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r)::INT AS rank FROM k) WHERE rank <= 3"""
_Q = ASKED
SQL["lexical_boosts"] = f"SELECT doc_id, max({boost('q', 'q2', 't')}) AS boost FROM (SELECT q.doc_id, q, q2, {squeeze('text')} AS t FROM {_Q} q JOIN {windows()} d USING (doc_id)) GROUP BY 1"
SQL["bigram_scores"] = f"""WITH p AS (SELECT conv_id, turn, lower({squeeze('text')}) AS t, lag(lower({squeeze('text')})) OVER (PARTITION BY conv_id ORDER BY turn) AS q FROM conversations)
SELECT conv_id, turn, {bigram('q', 't')} AS score FROM p WHERE q IS NOT NULL"""
SQL["passage_hits"] = "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE len(string_split(b.text, ' ')) >= 7"
SQL["lexical_fallback"] = f"""WITH s AS (SELECT query_id, chunk_index, {boost('q', 'q2', 't')} AS score FROM (SELECT q.query_id, w.chunk_index, q, q2, {squeeze('w.text')} AS t FROM {_Q} q JOIN {windows()} w USING (doc_id)))
SELECT query_id, rank, chunk_index, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index)::INT AS rank FROM s) WHERE rank <= 2"""


def _embedding(rows: str, key: str) -> str:
    """key and e, the unit vector of bigram counts."""
    return f"""(SELECT {key}, list_transform(range(64), lambda i: coalesce(m[i], 0) / nullif(sqrt(list_sum(list_transform(map_values(m), lambda c: c * c))::DOUBLE), 0)) AS e FROM (
      SELECT {key}, map_from_entries(list((b, n))) AS m FROM (SELECT {key}, (ord(substr(text, i, 1)) * 31 + ord(substr(text, i + 1, 1))) % 64 AS b, count(*)::DOUBLE AS n FROM (SELECT {key}, text, unnest(range(1, length(text))) AS i FROM {rows}) GROUP BY ALL) GROUP BY {key}))"""


ASKED_TEXT = f"(SELECT item_id, '{INSTRUCTION}' || {trim('text')} AS text FROM benchmark)"
SQL["global_knn"] = f"""SELECT query_id, doc_id, chunk_index, distance FROM (SELECT *, {L2} AS distance FROM (SELECT a.vec_id AS query_id, b.label AS doc_id, b.vec_id AS chunk_index, a.embedding AS x, b.embedding AS y FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0))
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id, chunk_index) <= 15"""
SQL["global_search_all"] = f"""WITH w AS (SELECT * FROM {windows()}), we AS {_embedding('w', 'doc_id, chunk_index')}, q AS (SELECT item_id, {squeeze('text')} AS q, regexp_replace({squeeze('text')}, '{MARKS}', '', 'g') AS q2 FROM benchmark), qe AS {_embedding(ASKED_TEXT, 'item_id')},
n AS (SELECT item_id, doc_id, chunk_index, d FROM (SELECT item_id, w.doc_id, w.chunk_index, 1.0::DOUBLE - coalesce(list_inner_product(qe.e, we.e), 0) AS d FROM w LEFT JOIN we USING (doc_id, chunk_index), qe) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY d, doc_id, chunk_index) <= 15),
t AS (SELECT n.*, q, q2, {squeeze('w.text')} AS t FROM n JOIN q USING (item_id) JOIN w USING (doc_id, chunk_index)), s AS (SELECT *, least(1.0::DOUBLE, {_CLAMP.format('1.0::DOUBLE - d')} + {boost('q', 'q2', 't')}) AS score FROM t WHERE t <> ''),
a AS (SELECT * FROM s QUALIFY score >= 0.15 OR NOT bool_or(score >= 0.15) OVER (PARTITION BY item_id))
SELECT item_id AS query_id, rank, doc_id, chunk_index, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, d, doc_id, chunk_index)::INT AS rank FROM a) WHERE rank <= 3"""
SQL["rerank_fallback"] = f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_index) AS r0 FROM {_COS} QUALIFY r0 <= 10), s AS (SELECT *, {_CLAMP.format('1.0::DOUBLE - d')} AS sc FROM n),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, d, chunk_index) AS r FROM s QUALIFY r <= 8), l AS (SELECT *, CASE WHEN query_id % 30 = 0 THEN NULL ELSE ((chunk_index * 7 + query_id) % 11 - 5)::DOUBLE END AS x FROM r),
g AS (SELECT query_id, chunk_index, r, sc, CASE WHEN x >= 0 THEN 1.0::DOUBLE / (1.0::DOUBLE + exp(-x)) ELSE exp(x) / (1.0::DOUBLE + exp(x)) END AS second FROM l),
k AS (SELECT * FROM g QUALIFY second IS NULL OR second >= 0.5 OR NOT bool_or(second >= 0.5) OVER (PARTITION BY query_id))
SELECT query_id, rank, chunk_index, coalesce(second, sc) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY second DESC, r)::INT AS rank FROM k) WHERE rank <= 3"""
SQL["fused_search"] = f"""WITH w AS (SELECT * FROM {windows()}), we AS {_embedding('w', 'doc_id, chunk_index')}, q AS (SELECT * FROM {_Q}), qe AS {_embedding(ASKED_TEXT, 'item_id')},
n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY 1), p AS (SELECT doc_id, n, CASE WHEN n <= 12 THEN 2 WHEN n <= 60 THEN 3 WHEN n <= 200 THEN 4 ELSE 5 END AS k FROM n),
f AS (SELECT *, greatest(3 * k, 8) AS fl, CASE WHEN n <= 10 THEN 0.05 ELSE 0.15 END AS th FROM p), g AS (SELECT *, CASE WHEN n <= fl THEN n ELSE least(50, n, greatest(fl, ceil(n * 0.12::DOUBLE)::INT, 5 * k)) END AS rk FROM f),
h AS (SELECT q.query_id, w.doc_id, w.chunk_index, w.page, w.text, q, q2, k, th, rk, 1.0::DOUBLE - coalesce(list_inner_product(qe.e, we.e), 0) AS d FROM q JOIN w USING (doc_id) JOIN g USING (doc_id)
  JOIN qe ON q.doc_id % (SELECT count(*) FROM benchmark) = qe.item_id LEFT JOIN we ON w.doc_id = we.doc_id AND w.chunk_index = we.chunk_index),
t AS (SELECT *, {squeeze('text')} AS t FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_index) <= rk), s AS (SELECT *, least(1.0::DOUBLE, {_CLAMP.format('1.0::DOUBLE - d')} + {boost('q', 'q2', 't')}) AS score FROM t),
a AS (SELECT * FROM s QUALIFY score >= th OR NOT bool_or(score >= th) OVER (PARTITION BY query_id))
SELECT query_id, rank, chunk_index, page, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, d, chunk_index)::INT AS rank FROM a) WHERE rank <= k"""
SQL["document_texts"] = f"""WITH w AS (SELECT *, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE page END AS p FROM {windows(300, 0)}), m AS (SELECT doc_id, chunk_index, CASE WHEN p IS NOT NULL AND p IS DISTINCT FROM lag(p) OVER (PARTITION BY doc_id ORDER BY chunk_index) THEN '【第' || p || '页】' || chr(10) || text ELSE text END AS l FROM w)
SELECT doc_id, string_agg(l, chr(10) ORDER BY chunk_index) AS text FROM m GROUP BY 1"""
_BLOCK = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM {FIRST} WHERE {trim('text')} <> '')"
SQL["prompt_contexts"] = f"SELECT query_id, string_agg('【片段' || no || '】' || chr(10) || {trim('text')}, chr(10) || chr(10) ORDER BY no) AS context, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM {_BLOCK} GROUP BY 1"
SQL["observation_budget"] = f"""WITH b AS (SELECT query_id, rank, '【片段' || rank || '】 source=text page=' || page || chr(10) || {trim('text')} AS b FROM {FIRST} WHERE {trim('text')} <> ''),
u AS (SELECT *, coalesce(sum(length(b) + 2) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS u FROM b), o AS (SELECT *, bool_or(u > 0 AND u + length(b) > 2400) OVER (PARTITION BY query_id ORDER BY rank) AS o FROM u)
SELECT query_id, string_agg(b, chr(10) || chr(10) ORDER BY rank) AS observation FROM o WHERE NOT o GROUP BY 1"""
SQL["merged_hits"] = f"SELECT source AS query_id, doc_id AS rank FROM documents WHERE {trim('substr(text, 1, 80)')} <> '' QUALIFY row_number() OVER (PARTITION BY source, {trim('substr(text, 1, 80)')} ORDER BY doc_id) = 1"
SQL["history_recent"] = f"SELECT conv_id, turn, pos, role FROM {TURNS} WHERE pos >= n - 4"
SQL["history_overflow"] = f"""SELECT conv_id, pos, covered, e AS covered_after FROM (SELECT *, greatest(n - 4, 0) AS e, greatest(least(conv_id % 3, greatest(n - 4, 0)), 0) AS covered FROM {TURNS}) WHERE pos >= covered AND pos < e"""
SQL["overflow_ids"] = f"""SELECT conv_id, pos::INT AS msg_index, role, 'chat:' || conv_id || ':' || pos || ':' || substr(sha1(conv_id || '|' || pos || '|' || role || '|' || content), 1, 16) AS id, {LINE} AS text FROM {TURNS} WHERE pos < greatest(n - 4, 0)"""
SQL["turns_text"] = f"SELECT conv_id, string_agg({LINE}, chr(10) ORDER BY pos) AS turns, sum(length(content))::BIGINT AS n_chars FROM {TURNS} GROUP BY 1"
SQL["final_turns"] = f"SELECT conv_id, pos, {clip('content', 60)} AS content FROM {TURNS} WHERE pos >= n - 4"
SQL["facts_parsed"] = f"SELECT conv_id, no::INT AS no, line, starts_with(lower({trim('line')}), '[pinned]') AS pinned, {KEY} AS fact_key FROM {FACT_LINES}"
_FL = f"(SELECT conv_id, {trim('question')} AS q, no, line, starts_with(lower(line), '[pinned]') AS pinned, {KEY} AS k FROM {FACT_LINES})"
SQL["facts_retrieved"] = f"""WITH s AS (SELECT *, CASE WHEN q = '' THEN 0.0 ELSE {bigram(f"lower({squeeze('q')})", f"lower({squeeze('line')})")} END AS score FROM {_FL}),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id, pinned ORDER BY score DESC, no) AS r FROM s), c AS (SELECT *, CASE WHEN pinned THEN no ELSE r END AS place FROM b WHERE pinned OR r <= 2),
o AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, CASE WHEN q = '' THEN no::VARCHAR ELSE k END ORDER BY pinned DESC, place) = 1), t AS (SELECT conv_id, string_agg('- ' || line, chr(10) ORDER BY pinned DESC, place) AS f FROM o GROUP BY 1)
SELECT conv_id, coalesce({clip('f', 400)}, '') AS facts FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id)"""
SQL["prompt_messages"] = f"""WITH e AS (SELECT conv_id, -2 AS no, 'system' AS role, '【已确认硬事实】' || chr(10) || {trim('facts')} AS content FROM {FACTS} WHERE {trim('facts')} <> '' UNION ALL
  SELECT conv_id, pos, role, {clip('content', 40)} FROM {TURNS} WHERE pos >= n - 2)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY no) - 1)::INT AS no, role, content FROM e"""
_LINES = "(SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))"
SQL["line_dedupe"] = f"""WITH u AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM (SELECT doc_id, string_split(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM documents)),
k AS (SELECT doc_id, ln, {rtrim('line')} AS line, {KEYED} AS k FROM u), f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k ORDER BY ln) AS nth, coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY ln), '?') AS before FROM k),
t AS (SELECT doc_id, string_agg(CASE WHEN k = '' THEN '' ELSE line END, chr(10) ORDER BY ln) AS t FROM f WHERE CASE WHEN k = '' THEN before <> '' ELSE nth = 1 END GROUP BY 1)
SELECT doc_id, CASE WHEN {trim('text')} = '' THEN coalesce(text, '') ELSE coalesce(regexp_replace(t, '^\n+|\n+$', '', 'g'), '') END AS text FROM documents LEFT JOIN t USING (doc_id)"""
SQL["repetitive_documents"] = f"""WITH k AS (SELECT doc_id, {KEYED} AS k FROM {_LINES} WHERE {KEYED} <> ''), c AS (SELECT doc_id, count(*) AS n_lines, count(DISTINCT k) AS n_distinct FROM k GROUP BY 1)
SELECT *, (n_lines - n_distinct) / n_lines::DOUBLE AS ratio, n_lines >= 4 AND (n_lines - n_distinct) / n_lines::DOUBLE >= 0.25 AS repetitive FROM c"""
SQL["blank_runs"] = f"""WITH p AS (SELECT page_id AS doc_id, string_split(regexp_replace(html, '<[^>]+>', '', 'g'), chr(10)) AS ls FROM pages), l AS (SELECT doc_id, {trim('unnest(ls)')} = '' AS blank, generate_subscripts(ls, 1) AS ln FROM p),
b AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY doc_id ORDER BY ln), false) AS before FROM l)
SELECT doc_id, count(*) FILTER (NOT (blank AND before)) AS n_kept, count(*) AS n_lines FROM b GROUP BY 1"""
SQL["page_merge"] = f"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE {trim('text')} END AS d, CASE WHEN doc_id % 2 = 0 THEN '' ELSE '| a | b |' END AS t, CASE WHEN doc_id % 5 = 0 THEN '' ELSE {trim("'ocr ' || coalesce(text, '')")} END AS o, doc_id % 7 = 0 AS pref FROM documents),
b AS (SELECT *, CASE WHEN pref AND o <> '' THEN o ELSE d END AS b FROM p)
SELECT doc_id, md5(CASE WHEN b = '' AND t = '' THEN o WHEN b <> '' AND t <> '' THEN b || chr(10) || chr(10) || t ELSE b || t END) AS text_md5,
  CASE WHEN b = '' AND t = '' AND o <> '' THEN 'ocr' WHEN b <> '' AND t <> '' THEN 'mixed' WHEN pref AND o <> '' THEN 'ocr' WHEN b <> '' THEN 'text' WHEN t <> '' THEN 'table' ELSE 'empty' END AS mode FROM b"""
_CELL = trim("regexp_replace(replace(replace(replace(replace(replace(replace(c, '&nbsp;', chr(160)), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&amp;', '&'), '<[^>]+>', '', 'g')")
SQL["html_tables"] = f"""WITH p AS (SELECT page_id, list_transform(regexp_extract_all(html, '(?s)<p[^>]*>(.*?)</p>', 1), lambda c: {_CELL}) AS cs FROM pages),
r AS (SELECT page_id, cs, list_transform(cs, lambda x: '| ' || regexp_replace(x, '\\r\\n|[\\r\\n]', ' ', 'g') || ' | a & b |') AS rows FROM p)
SELECT page_id, len(cs)::INT AS n_rows, CASE WHEN len(cs) = 0 THEN '' ELSE array_to_string(list_concat([rows[1], '| --- | --- |'], rows[2:]), chr(10)) END AS markdown FROM r"""
SQL["reading_order"] = f"""WITH b AS (SELECT l_orderkey, unnest(boxes) AS b, generate_subscripts(boxes, 1) AS i FROM {BOXES})
SELECT l_orderkey, string_agg(b.n::VARCHAR, chr(10) || chr(10) ORDER BY round_even(b.y0 / 8.0::DOUBLE, 0), b.x0, i) AS text FROM b GROUP BY 1"""


def _area(b: str) -> str:
    return f"(greatest({b}.x1 - {b}.x0, 0) * greatest({b}.y1 - {b}.y0, 0))"


def _iou(a: str, b: str) -> str:
    both = f"(greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0))"
    return f"(CASE WHEN {_area(a)} + {_area(b)} - {both} > 0 THEN {both} / ({_area(a)} + {_area(b)} - {both}) ELSE 0 END)"


SQL["merged_regions"] = f"""WITH l AS (SELECT l_orderkey, l_linenumber AS n, (l_partkey * 7 % 200)::DOUBLE AS x0, ((l_suppkey * 13 + l_linenumber * 5) % 300)::DOUBLE AS y0, l_quantity::DOUBLE AS q FROM lineitem),
b AS (SELECT l_orderkey, list({{n: n, x0: x0, y0: y0, x1: x0 + q + 20, y1: y0 + 40}} ORDER BY n, x0, y0, q) AS boxes FROM l GROUP BY 1),
s AS (SELECT l_orderkey, boxes, list_sort(list_transform(boxes, lambda b, i: {{a: -{_area('b')}, i: i, b: b}})) AS s FROM b),
k AS (SELECT l_orderkey, boxes, list_reduce(list_transform(s, lambda r: [r.b]), lambda done, r: CASE WHEN len(list_filter(done, lambda d: {_iou('d', 'r[1]')} >= 0.3)) > 0 THEN done ELSE list_concat(done, r) END) AS kept FROM s),
p AS (SELECT l_orderkey, boxes, list_sort(list_transform(kept, lambda b, i: {{r: round_even(b.y0 / 8, 0), x: b.x0, i: i, n: b.n}})) AS p FROM k)
SELECT l_orderkey, len(boxes)::INT AS n_boxes, array_to_string(list_transform(p, lambda x: x.n), ',') AS kept FROM p"""
SQL["grace_keep"] = f"SELECT doc_id FROM {KEEP}"
SQL["reconcile_orphans"] = f"SELECT DISTINCT doc_id::VARCHAR AS doc_id FROM documents WHERE doc_id::VARCHAR NOT IN (SELECT doc_id FROM {KEEP})"
SQL["replace_documents"] = "SELECT doc_id, source, length(text)::INT AS chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT doc_id, 'new', 0 FROM labels WHERE toxic = 1"
SQL["delete_documents"] = "SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)"
SQL["upsert_latest"] = "SELECT id, text FROM (SELECT conv_id || '|' || role AS id, text, turn FROM conversations) QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC) = 1"
SQL["insert_ignore"] = """WITH o AS (SELECT user_id AS doc_id, min(ts) AS created_at FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT * FROM o UNION ALL SELECT user_id, min(ts) FROM events WHERE user_id NOT IN (SELECT doc_id FROM o) GROUP BY 1"""
SQL["link_documents"] = """WITH o AS (SELECT user_id AS doc_id, min(ts) AS c FROM events WHERE event_type <> 'click' GROUP BY 1), n AS (SELECT user_id AS doc_id, min(ts) AS c, max(event_id) AS l FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT doc_id, coalesce(o.c, n.c) AS created_at, n.l AS conversation_id FROM o FULL JOIN n USING (doc_id)"""
SQL["update_columns"] = "SELECT d.doc_id, CASE WHEN toxic = 1 THEN 'flagged' ELSE source END AS source, CASE WHEN quality = 0 THEN 'low' ELSE lang END AS lang FROM documents d LEFT JOIN labels USING (doc_id)"
SQL["cascade_delete"] = f"""WITH g AS (SELECT DISTINCT conv_id::VARCHAR AS id FROM conversations WHERE role = 'system'), d AS (SELECT doc_id FROM {CONVERSATIONS} WHERE id IN (FROM g))
SELECT 'conversations' AS name, count(*) AS n_left FROM {CONVERSATIONS} WHERE id NOT IN (FROM g) UNION ALL SELECT 'registry', count(*) FROM {REGISTRY} WHERE doc_id NOT IN (FROM d)
UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id::VARCHAR NOT IN (FROM d) UNION ALL SELECT 'chat', count(*) FROM conversations WHERE conv_id::VARCHAR NOT IN (FROM g)"""
_PUT = "(SELECT conv_id, count(*) AS n, conv_id % 3 <> 0 AS filled FROM conversations WHERE conv_id % 5 <> 0 AND (conv_id % 3 <> 0 OR conv_id % 8 = 0) GROUP BY conv_id HAVING count(*) > 1)"
SQL["upsert_conversations"] = f"""WITH o AS (SELECT conv_id FROM conversations WHERE turn = 0 AND conv_id % 2 = 0), p AS (SELECT * FROM {_PUT}), b AS (SELECT coalesce(o.conv_id, p.conv_id) AS c, o.conv_id IS NOT NULL AS was, p.conv_id IS NOT NULL AS put, filled, n FROM o FULL JOIN p ON o.conv_id = p.conv_id)
SELECT c::VARCHAR AS id, CASE WHEN put AND c % 6 <> 0 THEN 'new' WHEN was THEN 'old' ELSE '' END AS summary, CASE WHEN NOT was AND c % 4 = 0 THEN 'd' || c % 16 ELSE '' END AS doc_id, CASE WHEN NOT was AND c % 8 = 0 THEN 'paper' ELSE '' END AS document_name,
  CASE WHEN was THEN '2024-01-01' WHEN c % 7 = 0 THEN '2024-01-15' ELSE '2024-02-01' END AS created_at, CASE WHEN put AND c % 2 = 0 THEN 3 WHEN was THEN 1 ELSE 0 END::INT AS memory_covered, CASE WHEN put AND filled THEN n ELSE 0 END::INT AS n_messages FROM b"""
SQL["put_links"] = f"""WITH r AS (SELECT 'd' || user_id % 64 AS doc_id, min(ts) AS c FROM events WHERE event_type = 'click' GROUP BY 1), p AS (SELECT 'd' || conv_id % 16 AS doc_id, max(conv_id) AS m FROM {_PUT} WHERE conv_id % 4 = 0 GROUP BY 1)
SELECT doc_id, coalesce(c, TIMESTAMP '2024-01-31 00:00:00') AS created_at, coalesce(m::VARCHAR, 'none') AS conversation_id FROM r FULL JOIN p USING (doc_id)"""
SQL["history_page"] = "SELECT conv_id AS id, max(turn) AS created_at, count(*) FILTER (role <> 'system') AS dialog FROM conversations GROUP BY 1 ORDER BY created_at DESC, id LIMIT 6 OFFSET 6"
SQL["eval_metrics"] = f"SELECT * FROM {metrics()}"
SQL["eval_final"] = f"SELECT * FROM {metrics('rank <= 3')}"
SQL["eval_verdict"] = f"""WITH v AS (SELECT CASE WHEN b.page_recall > a.page_recall OR (b.page_recall = a.page_recall AND b.page_precision > a.page_precision) THEN 'improve'
  WHEN b.page_recall < a.page_recall OR (b.page_recall = a.page_recall AND b.page_precision < a.page_precision) THEN 'worse' ELSE 'tie' END AS verdict
  FROM {metrics()} a JOIN {metrics('rank <= 3')} b USING (query_id)) SELECT verdict, count(*) AS cases FROM v GROUP BY 1"""
SQL["eval_summary"] = f"SELECT avg(page_recall) AS page_recall, avg(page_precision) AS page_precision, avg(text_recall) AS text_recall, avg(text_precision) AS text_precision, count(*) AS cases FROM {metrics()}"
SQL["case_errors"] = """SELECT doc_id::VARCHAR AS doc_id, CASE WHEN doc_id % 3 = 0 THEN '缺少 question/问题 或 doc_id/文档ID' WHEN doc_id % 5 = 0 OR length(coalesce(text, '')) = 0 THEN '文档无向量 doc_id=' || doc_id
  WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN '需要 gold_pages/金标页码 或 gold_contains/金标原文' END AS error FROM documents"""
SQL["client_errors"] = """SELECT event_id, ['请求已取消', '无法连接 AI 服务，请确认服务已启动', '摘要服务异常', '文档处理服务异常', '问答服务异常', '服务异常，请稍后重试', '服务异常，请稍后重试', '问题 太长 了', '服务异常，请稍后重试'][event_id % 9 + 1] AS message FROM events"""
SQL["image_coverage"] = "SELECT l_orderkey, round(least(1, sum((l_quantity::DOUBLE + 20) * 40) / 120000), 9) AS coverage FROM lineitem GROUP BY 1"
_ROW = f"list_transform(string_split(l, ' '), lambda c: {trim('c')})"
SQL["cell_markdown"] = f"""WITH r AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {_ROW}), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM documents),
w AS (SELECT *, coalesce(list_max(list_transform(rows, lambda r: len(r))), 0) AS w FROM r),
b AS (SELECT *, list_transform(rows, lambda r: '| ' || array_to_string(list_concat(r, list_transform(range(w - len(r)), lambda i: '')), ' | ') || ' |') AS bars, '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |' AS rule FROM w)
SELECT doc_id, md5(CASE WHEN w = 0 THEN '' ELSE array_to_string(list_concat([bars[1], rule], bars[2:]), chr(10)) END) AS markdown_md5 FROM b"""
SQL["headed_tables"] = f"""WITH l AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
r AS (SELECT doc_id, no, {_ROW} AS r FROM l), t AS (SELECT doc_id, string_agg('【表格 ' || no || '】' || chr(10) || '| ' || array_to_string(r, ' | ') || ' |' || chr(10) || '| ' || array_to_string(list_transform(r, lambda c: '---'), ' | ') || ' |', chr(10) || chr(10) ORDER BY no) AS t
  FROM r WHERE len(list_filter(r, lambda c: c <> '')) > 0 GROUP BY 1) SELECT doc_id, md5(coalesce(t, '')) AS text_md5 FROM documents LEFT JOIN t USING (doc_id)"""
SQL["page_texts"] = f"SELECT doc_id, md5(string_agg('【第' || chunk_index || '页】' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5 FROM {windows(300, 0)} WHERE {trim('text')} <> '' GROUP BY 1"
_TALK = f"(SELECT conv_id, string_agg({trim('text')}, chr(1) ORDER BY turn) AS s0, {trim('string_agg(coalesce(text, chr(32)), chr(10) ORDER BY turn)')} AS s, {trim('arg_max(text, turn)')} AS q FROM conversations GROUP BY 1)"
SQL["summaries_retrieved"] = f"""WITH c AS (SELECT conv_id, s, q, list_filter(list_transform(string_split(regexp_replace(regexp_replace(s, chr(10) || '+', chr(1), 'g'), '([。！？；!?]){WS}*', '\\1' || chr(1), 'g'), chr(1)), lambda u: {trim('u')}), lambda u: u <> '') AS us FROM {_TALK}),
u AS (SELECT conv_id, q, unnest(us) AS u, generate_subscripts(us, 1) AS un FROM c WHERE len(us) > 2 AND q <> ''), b AS (SELECT *, {bigram(f"lower({squeeze('q')})", f"lower({squeeze('u')})")} AS score FROM u),
p AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY score DESC, un) <= 2),
t AS (SELECT conv_id, regexp_replace(string_agg(CASE WHEN right(u, 1) IN ('。', '！', '？', ';', '；') THEN u ELSE u || '。' END, '' ORDER BY un), '。{{2,}}', '。', 'g') AS t FROM p GROUP BY 1)
SELECT conv_id, CASE WHEN t IS NULL THEN {clip('s', 300)} ELSE {clip('t', 300)} END AS summary FROM c LEFT JOIN t USING (conv_id)"""
SQL["stream_memory"] = f"""WITH t AS (SELECT *, role || ': ' || content AS l FROM {TURNS}), c AS (SELECT conv_id, max(n) AS n, string_agg(l, chr(10) ORDER BY pos) FILTER (pos < n - 4) AS s FROM t GROUP BY 1),
f AS (SELECT conv_id, {trim('unnest(ls)')} AS f, generate_subscripts(ls, 1) AS no FROM (SELECT conv_id, list_transform(string_split(s, chr(10)), lambda x: substr(x, 1, 30)) AS ls FROM c WHERE s IS NOT NULL)),
o AS (SELECT conv_id, f, no FROM f WHERE f <> '' QUALIFY row_number() OVER (PARTITION BY conv_id, lower({squeeze('f')}) ORDER BY no) = 1)
SELECT conv_id, greatest(n - 4, 0)::BIGINT AS covered, least(n, 4)::BIGINT AS kept, substr(coalesce(s, ''), 1, 1200) AS summary, coalesce(facts, '') AS facts FROM c LEFT JOIN (SELECT conv_id, string_agg(f, '|' ORDER BY no) AS facts FROM o GROUP BY 1) USING (conv_id)"""
SQL["stream_events"] = f"""SELECT conv_id AS connection, count(*)::INT AS n_payloads, md5(string_agg(p, '|' ORDER BY turn)) AS payloads_md5 FROM (SELECT conv_id, turn, {trim("regexp_replace(coalesce(text, ''), '[\\t-\\r ]+', ' ', 'g')")} AS p FROM conversations) WHERE p <> '' GROUP BY 1"""
SQL["stream_ingest"] = f"""WITH w AS (SELECT doc_id, chunk_index, {trim("CASE WHEN doc_id % 5 = 0 THEN 'v2 ' || substr(text, 1, 200) ELSE text END")} AS t FROM {windows(300, 0)} WHERE doc_id % 5 <> 0 OR chunk_index < 2)
SELECT doc_id, count(*)::INT AS n_chunks, md5(string_agg(t, chr(10) ORDER BY chunk_index)) AS text_md5 FROM w WHERE t <> '' GROUP BY 1"""
SQL["react_loop"] = f"""WITH q AS (SELECT conv_id * 1000 + turn AS query_id, conv_id, {trim("CASE WHEN conv_id % 3 = 0 THEN '合同金额 ' WHEN conv_id % 7 = 0 THEN '之前的合同 ' ELSE '' END || coalesce(text, '')")} AS q FROM conversations WHERE role = 'user'),
r AS (SELECT *, regexp_matches(q, '{DOC_HINT}') AS d, regexp_matches(q, '{MEMORY_HINT}') AS m FROM q),
w AS (SELECT doc_id, left(text, 80) AS k, chunk_index, {squeeze('text')} AS t FROM {windows()}),
s AS (SELECT query_id, chunk_index, k, {boost('q', 'q2', 't')} AS score FROM (SELECT query_id, conv_id, {squeeze('q')} AS q, regexp_replace({squeeze('q')}, '{MARKS}', '', 'g') AS q2 FROM r) z JOIN w ON conv_id = doc_id),
h AS (SELECT query_id, count(DISTINCT {trim('k')}) FILTER ({trim('k')} <> '') AS h FROM (SELECT * FROM s WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_index) <= 2) GROUP BY 1),
c AS (SELECT conv_id, count(*) > 0 AS talked FROM conversations WHERE turn < 2 GROUP BY 1),
p AS (SELECT query_id, CASE WHEN d AND NOT m THEN 'fast_doc' WHEN m AND NOT d THEN 'fast_memory' ELSE 'planner' END AS path, d, m, coalesce(h, 0) AS h, coalesce(talked, false) AS talked FROM r LEFT JOIN h USING (query_id) LEFT JOIN c USING (conv_id)),
t AS (SELECT *, CASE WHEN path <> 'planner' THEN 0 WHEN d AND h > 0 THEN 1 WHEN h > 0 THEN 2 WHEN d THEN 2 ELSE 3 END AS steps FROM p)
SELECT query_id, path, steps::INT AS steps, CASE WHEN path = 'fast_memory' THEN 0 ELSE 1 END::INT AS n_doc_queries, CASE WHEN path = 'fast_doc' OR (path = 'planner' AND d) THEN 0 ELSE 1 END::INT AS n_chat_queries,
  CASE WHEN path = 'fast_memory' THEN 0 ELSE h END::INT AS n_hits, path = 'fast_memory' OR (path = 'planner' AND (m OR (NOT d AND talked))) AS used_memory,
  CASE WHEN path = 'planner' THEN 'finish' ELSE path END AS finish_reason, CASE WHEN path = 'fast_doc' THEN 1 WHEN path = 'fast_memory' THEN 2 ELSE steps + CASE WHEN m THEN 1 ELSE 0 END END::INT AS n_steps FROM t"""
SQL["pages_to_scan"] = f"""WITH w AS (SELECT doc_id, chunk_index + 1 AS page, CASE WHEN substr(source, 4)::INT % 2 = 0 AND chunk_index > 1 THEN '' ELSE w.text END AS text FROM {windows()} w JOIN documents d USING (doc_id)),
s AS (SELECT *, count(*) FILTER ({trim('text')} <> '') OVER (PARTITION BY doc_id) < greatest(3, count(*) OVER (PARTITION BY doc_id) // 5) AS scanned FROM w)
SELECT doc_id, page FROM s WHERE scanned AND (page <= 5 OR regexp_matches(text, '目录|CONTENTS|Contents|目 录'))"""
SQL["error_messages"] = f"""WITH e AS (SELECT event_id, event_type, lower(['HTTP 502', 'Service Unavailable', 'model not found', 'Connection refused', 'request timed out', 'Error code: 7', ''][event_id % 7 + 1]) AS s FROM events)
SELECT event_id, CASE s WHEN 'http 502' THEN 'AI 摘要生成失败：LM Studio 服务不可用，请启动 Local Server 并加载模型' WHEN 'service unavailable' THEN 'AI 摘要生成失败：LM Studio 服务繁忙或未就绪，请稍后重试'
  WHEN 'model not found' THEN 'AI 摘要生成失败：模型不存在，请检查 LM Studio 中是否已加载对应模型' WHEN 'connection refused' THEN 'AI 摘要生成失败：无法连接 LM Studio，请确认 Local Server 已启动'
  WHEN 'request timed out' THEN 'AI 摘要生成超时' WHEN 'error code: 7' THEN 'AI 摘要生成失败：LM Studio 调用异常，请检查服务与模型是否就绪' ELSE 'AI 摘要生成失败：请检查 LM Studio 是否已启动并加载模型' END AS message, true AS failed, false AS type_failed FROM e"""
SQL["turn_search"] = f"""SELECT query_id, rank, chunk_index AS msg_index, {_CLAMP.format('1.0::DOUBLE - d')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, chunk_index)::INT AS rank FROM {_COS}) WHERE rank <= 4"""
_DOC = lambda c, chat, q: f"'【文档片段】' || chr(10) || {c} || {chat} || chr(10) || '【用户问题】' || chr(10) || coalesce({q}, '') || chr(10) || chr(10) || '请给出完整答案：'"
SQL["answer_prompts"] = f"""WITH c AS (SELECT query_id, string_agg('【片段' || no || '】' || chr(10) || {trim('text')}, chr(10) || chr(10) ORDER BY no) AS c FROM {_BLOCK} GROUP BY 1), n AS (SELECT doc_id AS query_id, count(*) AS n FROM {windows()} GROUP BY 1)
SELECT query_id, md5({_DOC(trimmed('t', 500), "''", 'question')}) AS prompt_md5,
  CASE WHEN coalesce(n, 0) > 0 AND query_id % 3 <> 0 THEN NULL WHEN coalesce(n, 0) > 0 THEN '未找到与问题足够相关的内容，请换种问法或换个角度描述。' ELSE '未找到相关文档内容，请先上传文档。' END AS message
  FROM (SELECT *, {trim('c')} AS t FROM {QUESTIONS} LEFT JOIN c USING (query_id) LEFT JOIN n USING (query_id))"""
_TALKED = "CASE WHEN h2 <> '' THEN chr(10) || chr(10) || '【相关历史对话】' || chr(10) || h2 || chr(10) ELSE '' END"
SQL["answer_messages"] = f"""WITH f AS ({SQL["facts_retrieved"]}), q AS (SELECT conv_id, arg_max(text, turn) AS q FROM conversations GROUP BY 1),
r AS (SELECT conv_id, string_agg(role || ':' || c || '|', '' ORDER BY pos) AS r, count(*) AS nr, sum(length(c)) AS cr FROM (SELECT conv_id, pos, role, {clip('content', 200)} AS c FROM {TURNS} WHERE pos >= n - 4) GROUP BY 1),
c AS (SELECT query_id, string_agg('【片段' || no || '】' || chr(10) || {trim('text')}, chr(10) || chr(10) ORDER BY no) AS c FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS no FROM {FIRST} WHERE rank <= 3 AND query_id % 4 <> 0 AND {trim('text')} <> '') GROUP BY 1),
h AS (SELECT conv_id, string_agg('【旧对话' || turn + 1 || '】' || chr(10) || {trim('text')}, chr(10) || chr(10) ORDER BY turn) AS h FROM conversations WHERE turn < 2 AND conv_id % 3 <> 0 AND {trim('text')} <> '' GROUP BY 1),
j AS (SELECT q.conv_id AS query_id, q, coalesce(facts, '') AS facts, coalesce(r, '') AS r, coalesce(nr, 0) AS nr, coalesce(cr, 0) AS cr, c IS NOT NULL AS with_doc, {trim('c')} AS c1, {trim('h')} AS h1 FROM q LEFT JOIN f USING (conv_id) LEFT JOIN r USING (conv_id) LEFT JOIN c ON q.conv_id = c.query_id LEFT JOIN h ON q.conv_id = h.conv_id),
t AS (SELECT *, {trimmed('c1', 500)} AS c2, CASE WHEN with_doc THEN {trimmed('h1', 200)} ELSE {trimmed('h1', 300)} END AS h2 FROM j),
m AS (SELECT *, CASE WHEN with_doc THEN '根据【文档片段】回答，对话记忆只作参考；要点说全，每点一次，不标页码。' ELSE '根据记忆和旧对话回答；不知道就说不知道。' END AS s,
  CASE WHEN with_doc AND facts <> '' THEN '【相关硬事实】' || chr(10) || {trim('facts')} ELSE '' END AS fm,
  CASE WHEN with_doc THEN {_DOC('c2', _TALKED, 'q')} ELSE CASE WHEN facts <> '' THEN '【相关硬事实】' || chr(10) || {trim('facts')} ELSE '（无相关摘要/事实）' END || chr(10) || chr(10) || '【相关历史对话】' || chr(10) || CASE WHEN h2 <> '' THEN h2 ELSE '（无旧对话命中）' END
    || chr(10) || chr(10) || '【用户问题】' || chr(10) || coalesce(q, '') || chr(10) || chr(10) || '请根据以上材料回答：' END AS u FROM t)
SELECT query_id, with_doc, (2 + CASE WHEN with_doc THEN nr + CASE WHEN fm <> '' THEN 1 ELSE 0 END ELSE 0 END)::INT AS n_messages,
  (length(s) + length(fm) + length(u) + CASE WHEN with_doc THEN cr ELSE 0 END)::INT AS n_chars,
  md5('system:' || s || '|' || CASE WHEN fm <> '' THEN 'system:' || fm || '|' ELSE '' END || CASE WHEN with_doc THEN r ELSE '' END || 'user:' || u) AS messages_md5 FROM m"""
SQL["paged_files"] = f"""WITH w AS (SELECT doc_id // 50 AS book, row_number() OVER (PARTITION BY doc_id // 50 ORDER BY doc_id, chunk_index) AS page, replace(text, chr(12), ' ') AS text FROM {windows(300, 0)})
SELECT book, page::INT AS page, text, 'txt' AS source_ext, NULL::VARCHAR AS error FROM w WHERE page <= 300
UNION ALL SELECT book, 301, NULL, 'txt', 'pages after the first 300 were not read' FROM w GROUP BY book HAVING count(*) > 300"""
SQL["watched_ingest"] = f"""SELECT doc_id, count(*) AS n_chunks, sum(length(t))::BIGINT AS chars, 0 AS n_falls, 100 AS last_report, true AS stopped FROM (SELECT doc_id, {trim('text')} AS t FROM {windows(300, 0)}) WHERE t <> '' GROUP BY 1"""
SQL["facts_merged"] = f"""WITH l AS (SELECT conv_id + 1 AS conv_id, 0 AS o, no, line FROM {FACT_LINES} UNION ALL SELECT conv_id, 1, no, line FROM {FACT_LINES}),
k AS (SELECT conv_id, o, no, line, starts_with(lower(line), '[pinned]') AS p, {KEY} AS k FROM l WHERE conv_id IN (SELECT conv_id FROM conversations)),
fp AS (SELECT conv_id, k, arg_min(line, no) AS pl FROM k WHERE o = 1 AND p GROUP BY ALL),
e AS (SELECT conv_id, o, no, line, p, k FROM k WHERE o = 0 UNION ALL SELECT conv_id, o, no, line, p, k FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY no) AS nth FROM k WHERE o = 1 AND k <> '') n WHERE nth = 1 AND NOT EXISTS (SELECT 1 FROM k y WHERE y.o = 0 AND y.conv_id = n.conv_id AND y.k = n.k)),
f AS (SELECT e.conv_id, o, no, CASE WHEN p OR pl IS NULL THEN line ELSE pl END AS line FROM e LEFT JOIN fp ON e.conv_id = fp.conv_id AND e.k = fp.k),
g AS (SELECT *, starts_with(lower(line), '[pinned]') AS p, sum(length(line) + 3) OVER (PARTITION BY conv_id) - 1 AS total FROM f),
h AS (SELECT *, sum(CASE WHEN p THEN length(line) + 3 ELSE 0 END) OVER (PARTITION BY conv_id) + sum(CASE WHEN p THEN 0 ELSE length(line) + 3 END) OVER (PARTITION BY conv_id ORDER BY o DESC, no DESC ROWS UNBOUNDED PRECEDING) - 1 AS size FROM g),
t AS (SELECT conv_id, substr(string_agg('- ' || line, chr(10) ORDER BY CASE WHEN total <= 300 OR p THEN 0 ELSE 1 END, o, no), 1, 300) AS facts FROM h WHERE total <= 300 OR p OR size <= 300 GROUP BY 1)
SELECT conv_id, coalesce(facts, '') AS facts FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN t USING (conv_id)"""
