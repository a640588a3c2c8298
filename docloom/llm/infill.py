"""Fill-in-middle: a text cut into prefix, middle and suffix, and put together again in another order.

Cuts are asked in one unit and needed in two others: code points (what lengths are reported in)
and bytes (what is cut). ``Exceptions`` is the sparse index that converts between them: it has
an entry for each character of several bytes alone, its place and the bytes that it and those
before it have beyond one. A place is converted by a binary search in it (``searchsorted``); a
span without entries, and so all of an ASCII text, is plain arithmetic. Texts are neither
decoded nor spread out into an array of offsets.

Where a text is cut, and into which form, is drawn from a digest of its doc_id, so that any
run on any cluster gives the same.

Cases: a null text is an empty one; an empty text stays as it is (form plain), and so does one
that holds one of the three markers, since it could not be told from the output's own. A null
doc_id draws like the empty string. Repeated rows are each transformed; there are no ties. An
empty table gives no rows. ``transformed`` keeps the caller's other columns but for those whose
names it gives itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import binary, columns_without, table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts those that are transformed, and of a hundred of these those of the form spm.
RATE, SPM_RATE = 90, 20
UNITS = ("tokens", "chars", "bytes")
SEED = "1"

_P, _S, _M = (m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


class Exceptions:
    """The characters of several bytes of a text: their places, in bytes and code points, and the excess bytes up to and with each."""

    def __init__(self, data: np.ndarray):
        high = np.flatnonzero(data >= 0x80)
        first = np.flatnonzero((data[high] & 0xC0) != 0x80)
        leads = high[first]
        # of the bytes from a first one to the next all but one are excess
        ends = np.append(first[1:], len(high))[: len(first)]
        self.at_byte, self.excess = leads, ends - np.arange(1, len(first) + 1)
        self.at_char = leads - np.concatenate([[0], self.excess[:-1]]) if len(leads) else leads
        self.n_bytes = len(data)
        self.n_chars = len(data) - (int(self.excess[-1]) if len(leads) else 0)

    def byte(self, char: int) -> int:
        """Where the code point begins."""
        k = int(np.searchsorted(self.at_char, char, "left"))
        return char + (int(self.excess[k - 1]) if k else 0)

    def char(self, byte: int) -> int:
        """Code points that begin before the byte; within a character, that character is one of them."""
        k = int(np.searchsorted(self.at_byte, byte, "left"))
        if not k:
            return byte
        before = int(self.excess[k - 2]) if k > 1 else 0
        lead, own = int(self.at_byte[k - 1]), int(self.excess[k - 1]) - before
        return lead - before + 1 if byte <= lead + own else byte - before - own


def token_starts(data: np.ndarray) -> np.ndarray:
    """Bytes at which ``[A-Za-z]+|[^A-Za-z]`` begins to match: a run of letters is one token, any other character is one."""
    letter = _LETTER[data]
    starts = (data & 0xC0) != 0x80
    starts[1:] &= ~(letter[1:] & letter[:-1])
    return np.flatnonzero(starts)


def cut(data: np.ndarray, index: Exceptions, first: int, second: int, unit: str) -> tuple[int, list[int]]:
    """The number of units, and the bytes at which the two cuts (draws, taken modulo it plus one) fall, in order.

    A cut in bytes falls before the character that it would divide.
    """
    starts = token_starts(data) if unit == "tokens" else None
    n = len(starts) if starts is not None else index.n_chars if unit == "chars" else index.n_bytes
    places = sorted((first % (n + 1), second % (n + 1)))
    if starts is not None:
        return n, [int(starts[p]) if p < n else len(data) for p in places]
    if unit == "chars":
        return n, [index.byte(p) for p in places]
    chars = [index.char(p) for p in places]
    return n, [b if b <= p else index.byte(c - 1) for p, c, b in zip(places, chars, map(index.byte, chars), strict=True)]


def draws(doc_id: int | None) -> tuple[int, ...]:
    """Four numbers of 32 bits that depend on the id alone."""
    digest = hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[i : i + 8], 16) for i in range(0, 32, 8))


def infill(text: bytes, doc_id: int | None, unit: str = "tokens", rate: int = RATE, spm_rate: int = SPM_RATE):
    """n, form, characters of prefix and middle (None where plain), output."""
    data = np.frombuffer(text, np.uint8)
    index = Exceptions(data)
    h1, h2, h3, h4 = draws(doc_id)
    n, (a, b) = cut(data, index, h1, h2, unit)
    if not text or _P in text or _S in text or _M in text or h3 % 100 >= rate:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    chars = index.char(a)
    if h4 % 100 < spm_rate:
        return n, "spm", chars, index.char(b) - chars, b"".join((_S, suffix, _P, prefix, _M, middle))
    return n, "psm", chars, index.char(b) - chars, b"".join((_P, prefix, _S, suffix, _M, middle))


OUT = (("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType()))


def transformed(docs: DataFrame, unit: str = "tokens", rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """docs' columns with n (units), form, prefix_chars, middle_chars and output in place of the text.

    unit: what cuts are counted in, tokens (runs of letters, or one other character), chars or bytes.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    keep = columns_without(docs, "text", *(name for name, _ in OUT))
    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col("doc_id").cast("bigint").alias("__infill_id"), F.col("text").alias("__infill_text"))
    shape = StructType([*(docs.schema[c] for c in keep), *(StructField(name, kind) for name, kind in OUT)])

    def run(batches):
        for batch in batches:
            found = [infill(text or b"", doc, unit, rate, spm_rate) for doc, text in zip(batch.column("__infill_id").to_pylist(), binary(batch, "__infill_text"), strict=True)]
            columns = list(zip(*found, strict=True)) if found else [()] * len(OUT)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            arrays[-1] = arrays[-1].view(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *arrays], names=[*keep, *(name for name, _ in OUT)])

    return rows.mapInArrow(run, shape)


def restored(output: str | Column, form: str | Column) -> Column:
    """The text that an output was made of. Markers stand in it but thrice, as texts with markers are plain."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    parts = F.split(output, "<[PSM]>", -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

QUERIES = {"op11_infill": op11_infill}
ORACLES = {"op11_infill": ORACLE}
