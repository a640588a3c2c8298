"""Text functions as Spark columns; each is a plain expression that Catalyst can push and fold."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers at the start of a text that stands for a failed read. Fixed values.
READ_ERRORS = ("[错误：", "[PDF解析错误", "[TXT读取错误", "[不支持的文件类型")
#: Signs that a page has tables or figures. Fixed value.
STRUCTURE = r"(?m)【图内文字|【表格|【图像表格|^\s*\|.+\|\s*$"
#: Hints that a question is about the document, about the talk, or leans on what was said. Fixed values.
DOC_HINT = (
    r"(?i)(订单|合同|条款|金额|单价|总价|页码|第\s*\d+\s*页|比例|税率|日期|交付|编号|单号|发票|附件|定义|多少|几号|哪一章|哪一节)"
)
MEMORY_HINT = r"(?i)(之前|刚才|上次|我们聊|聊过|说过|回顾|总结一下对话|对话里|你记得)"
POINTS_BACK = r"(那|这|它|他|她|该|上述|上面|刚才|之前|这个|那个|哪个|多少来着|呢\s*$|吗\s*$)"
#: Prefixes of a list line. Fixed values.
FACT_PREFIXES = ("- ", "• ", "* ", "· ", "– ", "— ")
PINNED = "[pinned]"
ELLIPSIS = "…"


def text(c: str | Column) -> Column:
    """A column by name; null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over a value that is computed once a row.

    A lambda of a higher-order function computes any outer expression anew for each element;
    as the element of an array of one, the value is a variable instead.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exploded(df: DataFrame, array: str | Column, at: str, item: str, *keep: str | Column) -> DataFrame:
    """A row for each element, with its place. Rows without elements go.

    An inner explode would make the optimizer filter by the array's size below it, which
    computes the array twice, and a chain of array columns many times over.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(at, item)).where(F.col(at).isNotNull())


def ws_trim(c: str | Column) -> Column:
    """Without white space, of all of Unicode, at both ends."""
    return F.regexp_replace(text(c), r"(?U)^\s+|\s+$", "")


def rtrim(c: str | Column) -> Column:
    return F.regexp_replace(text(c), r"(?U)\s+$", "")


def squeeze(c: str | Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(text(c), r"(?U)\s+", "")


def starts_with_any(c: Column, prefixes) -> Column:
    return reduce(lambda a, b: a | b, (c.startswith(p) for p in prefixes))


def is_read_error(c: str | Column) -> Column:
    return (ws_trim(c) == "") | starts_with_any(text(c), READ_ERRORS)


def file_extension(name: str | Column) -> Column:
    """Lower-case suffix after the last dot, or empty."""
    return F.lower(F.trim(F.regexp_extract(text(name), r"\.([^.]*)$", 1)))


def chunk_strategy(page: str | Column, extension: str | Column, asked: str = "auto") -> Column:
    """structure or recursive: as asked, else by the page's extension and its marks."""
    if asked.strip().lower() in ("structure", "recursive"):
        return F.lit(asked.strip().lower())
    suffix = F.regexp_replace(F.lower(text(extension)), r"^\.+", "")
    return F.when(suffix == "txt", "recursive").when(text(page).rlike(STRUCTURE), "structure").otherwise("recursive")


def looks_like_doc_query(q: str | Column) -> Column:
    return text(q).rlike(DOC_HINT)


def looks_like_memory_query(q: str | Column) -> Column:
    return text(q).rlike(MEMORY_HINT)


def needs_rewrite(q: str | Column) -> Column:
    s = ws_trim(q)
    return F.when(s == "", False).when(F.length(s) < 10, True).otherwise(s.rlike(POINTS_BACK))


def clip(c: str | Column, n: int) -> Column:
    """At most n characters, the last an ellipsis where something is cut."""
    s = ws_trim(c)
    if n <= 0:
        return s
    cut = F.lit(ELLIPSIS) if n == 1 else F.concat(rtrim(F.substring(s, 1, n - 1)), F.lit(ELLIPSIS))
    return F.when(F.length(s) <= n, s).otherwise(cut)


def last_index(c: Column, needle: str) -> Column:
    """Position of needle's last occurrence, from 0; -1 if there is none."""
    at = F.instr(F.reverse(c), F.lit(needle[::-1]))
    return F.when(at == 0, -1).otherwise(F.length(c) - at - len(needle) + 1)


def trim_blocks(c: str | Column, n: int) -> Column:
    """Without blanks at the ends; cut at n, back to the last blank line, or line end, in the second half."""
    s = ws_trim(c)
    if n <= 0:
        return s
    head = F.substring(s, 1, n)
    block, line = last_index(head, "\n\n"), last_index(head, "\n")
    at = F.when(block >= n // 2, block).when(line >= n // 2, line).otherwise(F.lit(n))
    return F.when(F.length(s) <= n, s).otherwise(F.concat(rtrim(F.substring(head, F.lit(1), at)), F.lit(ELLIPSIS)))


def lines(c: str | Column) -> Column:
    return F.split(text(c), "\n")


def fact_lines(c: str | Column) -> Column:
    """Lines, trimmed, less one list prefix each and the blank ones."""
    prefix = "^(" + "|".join(p.replace("*", r"\*") for p in FACT_PREFIXES) + ")"
    return F.filter(F.transform(lines(c), lambda x: ws_trim(F.regexp_replace(ws_trim(x), prefix, ""))), lambda x: x != "")


def fact_text(facts: str | Column) -> Column:
    return F.array_join(F.transform(facts, lambda x: F.concat(F.lit("- "), x)), "\n")


def is_pinned(c: str | Column) -> Column:
    return F.lower(ws_trim(c)).startswith(PINNED)


def fact_key(c: str | Column) -> Column:
    return F.lower(squeeze(F.regexp_replace(ws_trim(c), r"(?i)^\[pinned\]", "")))


def sentences(c: str | Column, ends: str = "。！？；!?") -> Column:
    """Split at line ends and after the given marks; blanks trimmed, empty ones dropped."""
    split = F.split(text(c), rf"\n+|(?<=[{ends}])(?U)\s*")
    return F.filter(F.transform(split, ws_trim), lambda x: x != "")


def stable_id(conversation: Column, index: Column, role: Column, content: Column) -> Column:
    seed = F.concat_ws("|", conversation, index.cast("string"), role, content)
    return F.concat(F.lit("chat:"), conversation, F.lit(":"), index.cast("string"), F.lit(":"), F.substring(F.sha1(seed), 1, 16))


def turn_line(role: Column, content: Column) -> Column:
    return F.concat(F.when(role == "user", "用户：").otherwise("助手："), content)


def query_for_embedding(q: str | Column, instruction: str) -> Column:
    s = ws_trim(q)
    return F.when(s == "", "").when(s.startswith(instruction), s).otherwise(F.concat(F.lit(instruction), s))


def file_size(n: str | Column) -> Column:
    n = F.col(n) if isinstance(n, str) else n
    return (
        F.when(n < 1024, F.format_string("%d B", n.cast("bigint")))
        .when(n < 1024 * 1024, F.format_string("%.1f KB", n / 1024.0))
        .otherwise(F.format_string("%.1f MB", n / (1024.0 * 1024.0)))
    )


#: Words for true and false in case files. Fixed values.
TRUE_WORDS = ("1", "true", "yes", "y", "on", "是")
FALSE_WORDS = ("0", "false", "no", "n", "off", "否")


def as_bool(c: str | Column, default: bool = False) -> Column:
    s = F.lower(ws_trim(c))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False).otherwise(default)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


#: What a reader's exception says, and the class of message it gets. Fixed values.
PDF_ERRORS = (
    ("password|encrypt|authentication|密码", "[PDF解析错误：PDF 已加密，请解除密码后再上传]"),
    ("damaged|corrupt|invalid pdf|xref|broken", "[PDF解析错误：PDF 文件损坏或格式无效]"),
)


def pdf_error(name: Column, message: Column) -> Column:
    blob = F.lower(F.concat_ws(" ", name, message))
    out = F.concat(F.lit("[PDF解析错误: "), message, F.lit("]"))
    for pattern, said in reversed(PDF_ERRORS):
        out = F.when(blob.rlike(pattern), said).otherwise(out)
    return out


#: What an error's text says, and the message shown in its place, in this order. Fixed values.
CANCELLED = "请求已取消"
UNREACHABLE = "无法连接 AI 服务，请确认服务已启动"
SERVICE_ERROR = "服务异常，请稍后重试"
TECHNICAL = r"(?i)\berror code:\s*\d+|\b(返回|failed|status)\s*[:：]?\s*\d{3}\b|\(\s*\d{3}\s*\)"
TECHNICAL_WORDS = r"(?i)返回|failed|status|code|gateway"
SERVICES = (("摘要", "摘要服务异常"), ("(?i)文档|处理|vector|embedding", "文档处理服务异常"), ("(?i)问答|ask", "问答服务异常"))
FIELD_NAMES = r"(?i)\b(doc_id|docId|taskId|question|messages|AbortError)\b|error code:\s*\d+"
CHINESE = "[\u4e00-\u9fff]"


def client_error(c: str | Column, fallback: str = SERVICE_ERROR) -> Column:
    """What a user is told of an internal error: no codes, no English, no names of fields."""

    def said(s: Column) -> Column:
        technical = s.rlike(TECHNICAL) | (s.rlike(r"\b\d{3}\b") & s.rlike(TECHNICAL_WORDS))
        service = F.lit(fallback)
        for pattern, message in reversed(SERVICES):
            service = F.when(s.rlike(pattern), message).otherwise(service)
        bare = ws_trim(F.regexp_replace(F.regexp_replace(s, FIELD_NAMES, ""), r"(?U)\s{2,}", " "))
        return (
            F.when(s == "", fallback).when(s.rlike("(?i)abort"), CANCELLED).when(s.rlike("(?i)fetch failed|ECONNREFUSED|ENOTFOUND|network"), UNREACHABLE)
            .when(technical, service).when(~s.rlike(CHINESE), fallback).otherwise(F.when(bare.rlike(CHINESE), bare).otherwise(fallback))
        )

    return let(ws_trim(c), said)
