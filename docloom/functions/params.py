"""Adaptive parameters of a search, as columns over the number of a document's chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import Config

#: Characters and image shares by which a page is taken as digital, scanned or mixed. Fixed values.
RICH, SPARSE, SCAN_COVER, EMPTY_COVER, FULL_IMAGE, REGION_LEAST = 80, 40, 0.35, 0.15, 0.85, 0.04


def clamp(c: Column, low, high) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def top_k(chunks: Column, asked: Column | None = None, candidates: Column | None = None, config: Config = Config()) -> Column:
    """How many results to give: as asked, else by the document's size; at most the candidates."""
    low = config.top_k_low
    high = max(low, config.top_k_high)
    by_size = (
        F.when(chunks <= 0, min(high, max(low, 3)))
        .when(chunks <= 12, low)
        .when(chunks <= 60, max(low, min(high, 3)))
        .when(chunks <= 200, max(low, min(high, 4)))
        .otherwise(high)
    )
    target = clamp(by_size if asked is None else F.coalesce(asked, by_size), low, high)
    if candidates is None:
        return target.cast("int")
    return F.when(candidates.isNull(), target).when(candidates <= 0, 0).otherwise(F.least(target, candidates)).cast("int")


def recall_k(chunks: Column, final_k: Column, asked: Column | None = None, config: Config = Config(), of_document: bool = True) -> Column:
    """How many candidates to fetch."""
    f, cap = F.greatest(final_k, F.lit(1)), config.recall_cap
    floor = F.greatest(3 * f, F.lit(8))
    free = F.least(F.lit(cap), F.greatest(floor, 5 * f))
    scoped = (
        F.when(chunks <= 0, free)
        .when(chunks <= floor, chunks)
        .otherwise(F.least(F.lit(cap), chunks, F.greatest(floor, F.ceil(chunks.cast("double") * F.lit(0.12)).cast("int"), 5 * f)))
    )
    own = scoped if of_document else free
    if asked is not None:
        own = F.when(asked.isNotNull(), F.greatest(f, F.least(F.lit(cap), asked))).otherwise(own)
    return own.cast("int")


def score_threshold(chunks: Column, base: Column, rerank: Column) -> Column:
    """Lower for a reranker to choose from, and for short documents."""
    t = F.when(rerank, F.least(base, F.lit(0.12))).otherwise(base)
    return F.when((chunks > 0) & (chunks <= 10), F.least(t, F.lit(0.05))).otherwise(t)


def score_from_distance(d: Column, space: str = "l2") -> Column:
    if space == "cosine":
        s = 1.0 - d
    elif space == "ip":
        s = F.abs(d)
    else:
        d = F.greatest(d, F.lit(0.0))
        s = 1.0 - d * d / 2.0
    return clamp(s, 0.0, 1.0)


def sigmoid(x: Column) -> Column:
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def needs_ocr(chars: Column, cover: Column) -> Column:
    c = clamp(cover, 0.0, 1.0)
    return F.when(chars >= RICH, False).when((chars == 0) & (c >= EMPTY_COVER), True).otherwise((chars < SPARSE) & (c >= SCAN_COVER))


def parse_strategy(chars: Column, cover: Column, regions: Column) -> Column:
    """full_ocr, hybrid or digital, by the page's characters, image share and image regions (their shares)."""
    largest = F.coalesce(F.array_max(regions), F.lit(0.0))
    part = F.exists(regions, lambda r: r < FULL_IMAGE)
    return (
        F.when((chars == 0) & (cover >= EMPTY_COVER), "full_ocr")
        .when((chars < SPARSE) & (cover >= SCAN_COVER), "full_ocr")
        .when((chars < SPARSE) & (largest >= FULL_IMAGE), "full_ocr")
        .when((chars >= RICH) & part, "hybrid")
        .when((chars > 0) & part & (largest >= REGION_LEAST), "hybrid")
        .when(chars > 0, "digital")
        .when(part, "hybrid")
        .otherwise("digital")
    )


def area_ratio(box: Column, page_area: Column) -> Column:
    """Share of a page that a box (x0, y0, x1, y1) covers."""
    w, h = box[2] - box[0], box[3] - box[1]
    return F.when((page_area <= 1e-6) | (F.size(box) < 4), 0.0).otherwise(clamp(F.abs(w * h) / page_area, 0.0, 1.0))


def progress(done: Column, total: Column, start: int, span: int) -> Column:
    """A stage's share of the overall progress, in whole percent."""
    return (start + F.floor(span * done / F.greatest(total, F.lit(1)))).cast("int")
