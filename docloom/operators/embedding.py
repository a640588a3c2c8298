"""Embedding as an Arrow UDF around an injected function; a hashing stand-in needs no model."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.config import EMBED_INSTRUCTION
from docloom.functions.text import query_for_embedding

DIMENSIONS = 64
#: Texts whose bigrams are counted in one step.
TOGETHER = 256

EmbedFn = Callable[[list[str]], np.ndarray]


def hashing_model(texts: list[str], size: int = DIMENSIONS) -> np.ndarray:
    """Counts of character bigrams by (31 * first + second) mod size, at unit length; zero for short texts."""
    out = np.zeros((len(texts), size))
    for a in range(0, len(texts), TOGETHER):
        some = texts[a : a + TOGETHER]
        code = np.frombuffer("".join(some).encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        row = np.repeat(np.arange(len(some)), [len(t) for t in some])
        within = row[:-1] == row[1:]
        at = (row[:-1] * size + (code[:-1] * 31 + code[1:]) % size)[within]
        out[a : a + len(some)] = np.bincount(at, minlength=len(some) * size).reshape(-1, size)
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embedder(make: Callable[[], EmbedFn] = lambda: hashing_model):
    """A column function text -> array<double>.

    make is called once for each stream of batches, so that a model is loaded once a task.
    Blank texts count as one blank, to keep texts and vectors aligned.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: pd.Series) -> pd.Series:
        model = make()
        return pd.Series(list(model([t if isinstance(t, str) and t.strip() else " " for t in batches])))

    return embed


def question_embedding(question: str | Column, embed: Callable[[Column], Column]) -> Column:
    """The vector that a question is searched by: of its text after the instruction."""
    return embed(query_for_embedding(question, EMBED_INSTRUCTION))
