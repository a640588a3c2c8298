"""Blocks and image regions of a page: reading order, overlap, repeated lines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from docloom.functions.sequences import Sequence, ratio
from docloom.functions.text import ws_trim


def reading_order(blocks: str | Column) -> Column:
    """array<struct<text,y,x>>: texts of rows of 8 units from the top, then from the left, blank line between."""
    blocks = F.col(blocks) if isinstance(blocks, str) else blocks
    keyed = F.transform(blocks, lambda b, i: F.struct(F.bround(b["y"] / 8.0).alias("row"), b["x"].alias("x"), i.alias("i"), ws_trim(b["text"]).alias("t")))
    return F.array_join(F.transform(F.array_sort(F.filter(keyed, lambda k: k["t"] != "")), lambda k: k["t"]), "\n\n")


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]), F.lit(0.0))
    h = F.greatest(F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]), F.lit(0.0))
    both = area(a) + area(b) - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def merged_regions(regions: str | Column, most: float = 0.5) -> Column:
    """array<struct<x0,y0,x1,y1>>: the largest first, without those that overlap a kept one; in reading order."""
    regions = F.col(regions) if isinstance(regions, str) else regions
    ordered = F.array_sort(F.transform(regions, lambda b, i: F.struct((-area(b)).alias("a"), i.alias("i"), b.alias("b"))))
    start = F.filter(regions, lambda b: F.lit(False))
    kept = F.aggregate(ordered, start, lambda done, r: F.when(F.exists(done, lambda d: iou(d, r["b"]) >= most), done).otherwise(F.concat(done, F.array(r["b"]))))
    placed = F.array_sort(F.transform(kept, lambda b, i: F.struct(F.bround(b["y0"] / 8.0).alias("row"), b["x0"].alias("x"), i.alias("i"), b.alias("b"))))
    return F.transform(placed, lambda p: p["b"])


def block_text(lines: str | Column) -> Column:
    """array<array<string>> of spans: spans of a line joined, blank lines dropped."""
    lines = F.col(lines) if isinstance(lines, str) else lines
    return F.array_join(F.filter(F.transform(lines, lambda s: ws_trim(F.array_join(s, ""))), lambda x: x != ""), "\n")


def dedupe_lines(texts: str | Column) -> Column:
    """Without lines that equal, hold, are held by, or match at 0.9 an earlier one; one blank line in a row.

    A page's lines are compared in order, so a page is a row; ``Lines`` keeps that from being all with all.
    """

    @F.pandas_udf(StringType())
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(_distinct_lines)

    return run(texts)


#: A line goes if it matches an earlier one by this ratio.
ALIKE = 0.9
#: Places that characters, and substrings of GRAM characters, of a line are counted in.
BINS, GRAM, BITS = 64, 4, 13
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
#: Up to this length counts of characters are exact; longer lines are compared with all.
COUNTED = np.iinfo(np.uint16).max


class Lines:
    """Distinct lines so far; a new one is compared with those alone that it can equal, hold, be held by or resemble.

    * One line can hold another only if it has all of its characters: with the counts of
      characters of all lines in an array, common counts tell in one step of arrays.
    * A ratio of ALIKE asks for so many common characters, and lengths that allow them.
    * It asks for common substrings, too: if m of both lines' s characters each match, they match in
      s - 2m + 1 pieces at most, and a piece of p characters has p - 3 substrings of GRAM = 4. So
      7m is at most 3s + 3 and the common substrings, which marks of a line's substrings bound.
    """

    def __init__(self):
        self.lines: list[Sequence] = []
        self.marks: list[tuple[int, int] | None] = []
        self.longest = 0
        self.lengths = np.zeros(16, np.int32)
        self.counts = np.zeros((BINS, 16), np.uint16)  # by bin, so that sums over bins are sums of long rows

    def add(self, line: str) -> bool:
        """Whether the line is unlike all others; then it is one of them."""
        k, n, own = len(self.lines), len(line), _bins(line)
        if k and self._known(line, own):
            return False
        if k == len(self.lengths):
            self.lengths, self.counts = (np.concatenate([x, np.zeros_like(x)], axis=-1) for x in (self.lengths, self.counts))
        self.lengths[k], self.counts[:, k] = n, own
        self.longest = max(self.longest, n)
        self.lines.append(Sequence(line))
        self.marks.append(None)
        return True

    def _known(self, line: str, own: np.ndarray) -> bool:
        k, n = len(self.lines), len(line)
        lengths, has = self.lengths[:k], own.nonzero()[0]
        least = np.minimum(lengths, n)
        common = np.minimum(self.counts[has, :k], own[has, None]).sum(0, dtype=np.uint16)
        if n > COUNTED or self.longest > COUNTED:
            common = np.where(np.maximum(lengths, n) > COUNTED, least, common)
        for i in (common == least).nonzero()[0]:
            other = self.lines[i].text
            if other in line or line in other:
                return True
        near = (common >= (lengths + n) * (ALIKE / 2 - 1e-9)).nonzero()[0]
        if not len(near):
            return False
        new, (mark, again) = Sequence(line), _marks(line)
        for i in near:
            held = self.marks[i] = self.marks[i] or _marks(self.lines[i].text)
            shared, s = (mark & held[0]).bit_count() + min(again, held[1]), n + int(lengths[i])
            if 2.0 * ((shared + 3 * s + 3) // 7) / s >= ALIKE and _close(new, self.lines[i]):
                return True
        return False


def _codes(line: str) -> np.ndarray:
    return np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)


def _bins(line: str) -> np.ndarray:
    return np.minimum(np.bincount(_codes(line) % BINS, minlength=BINS), COUNTED).astype(np.uint16)


def _marks(line: str) -> tuple[int, int]:
    """A bit for each place that a substring of GRAM characters has, and how many substrings found theirs taken."""
    code = _codes(line)
    n = max(0, len(code) - GRAM + 1)
    at = np.zeros(n, np.uint32)
    for i, factor in enumerate(FACTORS):
        at += code[i : i + n] * np.uint32(factor)
    taken = np.zeros(1 << BITS, bool)
    taken[at >> np.uint32(32 - BITS)] = True
    mark = int.from_bytes(np.packbits(taken).tobytes(), "big")
    return mark, n - mark.bit_count()


def _distinct_lines(text: str | None) -> str:
    seen = Lines()
    out: list[str] = []
    for line in (text or "").splitlines():
        bare = "".join(line.split())
        if not bare:
            if out and out[-1]:
                out.append("")
        elif seen.add(bare):
            out.append(line.strip())
    return "\n".join(out).strip()


def _close(a: Sequence, b: Sequence) -> bool:
    return ratio(a, b, ALIKE) is not None


def image_coverage(boxes: str | Column, width: Column, height: Column) -> Column:
    """Share of a page that its images' boxes (x0, y0, x1, y1) take, from 0 to 1; 0 for a page without an area."""
    boxes = F.col(boxes) if isinstance(boxes, str) else boxes
    area = F.abs(width.cast("double") * height.cast("double"))
    images = F.aggregate(boxes, F.lit(0.0), lambda a, b: a + F.abs((b["x1"] - b["x0"]).cast("double") * (b["y1"] - b["y0"]).cast("double")))
    return F.when(area > 1e-6, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(images, F.lit(0.0)) / area))).otherwise(0.0)


def ocr_text(boxes: str | Column) -> Column:
    """Recognised boxes (text, y, x) as text in reading order, each line once."""
    return dedupe_lines(reading_order(boxes))
