"""Language ID: a byte convolutional network, trained in numpy, run over whole texts.

A window of 256 bytes goes through byte embeddings, filters of several widths, a maximum
over the window's positions and a softmax over the learned languages. A document's
probabilities are the means over its windows, each weighted by its bytes.

For a trained net, embedding and filter are folded into tables: what a pair of bytes at
some place of a filter adds is looked up, so that a batch of windows needs a few gathers
and sums instead of products.

The training sample is bounded: TRAIN_ROWS documents, stratified by language, of each a
span of SPAN_CHARS characters at a place that its hash gives. From a span four or more
windows at even distances are learned, and a short piece of 12 to 211 characters, so that
short texts are told apart as well. Every language of the sample is a class; with more
languages than TRAIN_ROWS the rarest are not in it. Prediction reads all bytes.

Cases: a null text, or one without a letter, is ``und`` with score 0. Null languages are
not learned from. Repeated rows are predicted each on its own. With nothing to learn from,
every text is ``und``. lang, source and doc_id are never inputs of a prediction.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, in_fold, table

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
EMBEDDING = 8
TRAIN_ROWS = 3000
SPAN_CHARS = 2048
EPOCHS = 6
UNKNOWN = "und"
FOLDS, HELD = 4, 2
BATCH_WINDOWS = 128

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text.decode("utf-8", "replace")))


class ByteNet:
    """classes; embedding (256, E); per width w filters (w, E, F) with bias (F,); softmax weights."""

    def __init__(self, classes: list[str], seed: int = 7):
        r = np.random.default_rng(seed)
        self.classes = classes
        self.p = {"emb": r.normal(0, 0.5, (256, EMBEDDING))}
        for w in WIDTHS:
            self.p[f"w{w}"] = r.normal(0, (w * EMBEDDING) ** -0.5, (w * EMBEDDING, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["out"] = r.normal(0, 0.1, (FILTERS * len(WIDTHS), len(classes)))
        self.p["bias"] = np.zeros(len(classes))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def train(self, windows: np.ndarray, labels: np.ndarray, epochs: int = EPOCHS, batch: int = 64, rate: float = 4e-3, seed: int = 11) -> None:
        """Adam on the cross-entropy; the gradient of a maximum goes to its position alone."""
        r, p = np.random.default_rng(seed), self.p
        m, v, t = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
        for _ in range(epochs):
            order = r.permutation(len(windows))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                x, y, n = windows[pick], labels[pick], len(pick)
                e = p["emb"][x]
                pooled, places, patches = [], [], []
                for w in WIDTHS:
                    patch = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, -1, w * EMBEDDING)
                    z = patch @ p[f"w{w}"]
                    best = z.argmax(1)
                    pooled.append(np.maximum(np.take_along_axis(z, best[:, None], 1)[:, 0] + p[f"b{w}"], 0))
                    places.append(best)
                    patches.append(patch)
                h = np.concatenate(pooled, 1)
                s = h @ p["out"] + p["bias"]
                q = np.exp(s - s.max(1, keepdims=True))
                q /= q.sum(1, keepdims=True)
                q[np.arange(n), y] -= 1
                q /= n
                g = {"out": h.T @ q, "bias": q.sum(0), "emb": np.zeros_like(p["emb"])}
                back = (q @ p["out"].T) * (h > 0)
                for k, w in enumerate(WIDTHS):
                    d = back[:, k * FILTERS : (k + 1) * FILTERS]
                    rows = patches[k][np.arange(n)[:, None], places[k]]
                    g[f"w{w}"] = np.einsum("nfe,nf->ef", rows, d)
                    g[f"b{w}"] = d.sum(0)
                    to = np.einsum("nf,ef->nfe", d, p[f"w{w}"]).reshape(n, FILTERS, w, EMBEDDING)
                    which = x[np.arange(n)[:, None, None], places[k][:, :, None] + np.arange(w)]
                    np.add.at(g["emb"], which.ravel(), to.reshape(-1, EMBEDDING))
                t += 1
                for key, grad in g.items():
                    m[key] = 0.9 * m[key] + 0.1 * grad
                    v[key] = 0.999 * v[key] + 0.001 * grad * grad
                    p[key] -= (rate * (m[key] / (1 - 0.9**t)) / (np.sqrt(v[key] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)

    def fold(self) -> list[list[np.ndarray]]:
        """Per width, for each pair of neighbouring places a table from a pair of bytes to its part of every filter."""
        out = []
        for w in WIDTHS:
            one = [self.p["emb"] @ self.p[f"w{w}"][j * EMBEDDING : (j + 1) * EMBEDDING] for j in range(w)]
            pairs = [(one[j][:, None] + one[j + 1][None, :]).reshape(65536, FILTERS) for j in range(0, w, 2)]
            pairs[0] = pairs[0] + self.p[f"b{w}"]
            out.append([np.ascontiguousarray(t, np.float32) for t in pairs])
        return out

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """(n, classes) for windows (n, WINDOW) of bytes."""
        n, pooled = len(windows), []
        pair = windows[:, :-1].astype(np.int32) * 256 + windows[:, 1:]
        for w, parts in zip(WIDTHS, tables, strict=True):
            last = WINDOW - w + 1
            z = parts[0].take(pair[:, :last].ravel(), 0)
            for j, part in enumerate(parts[1:], 1):
                z += part.take(pair[:, 2 * j : 2 * j + last].ravel(), 0)
            pooled.append(np.maximum(z.reshape(n, last, FILTERS).max(1), 0))
        s = np.concatenate(pooled, 1) @ self.p["out"] + self.p["bias"]
        q = np.exp(s - s.max(1, keepdims=True))
        return q / q.sum(1, keepdims=True)


def cut(text: bytes) -> np.ndarray:
    """The whole text as windows; the last is filled up with zeros."""
    n = -(-len(text) // WINDOW)
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS, span: int = SPAN_CHARS, folds: int = FOLDS, held: int = HELD) -> ByteNet | None:
    """Learns from at most rows documents outside the held-out fold; None if there are none."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~in_fold("doc_id", folds, held))
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return None
    # the smallest of uniform numbers times the language's count: about as many rows of each
    known = known.join(F.broadcast(docs.sparkSession.createDataFrame(list(counts.items()), "lang string, __weight bigint")), "lang")  # at most rows languages
    weight = F.col("__weight")
    uniform = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    start = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - span, F.lit(1))).cast("int") + 1
    most = (2 << 30) * rows // len(counts)  # leaves about twice the rows to be ordered, however many there are
    pick = known.where(uniform * weight < most).select("lang", F.substring(F.col("text"), start, F.lit(span)).alias("text"), (uniform * weight).alias("order"))
    sample = pick.orderBy("order", "text").limit(rows).collect()
    classes = sorted({r.lang for r in sample})
    windows, labels = [], []
    for k, r in enumerate(sample):
        text = r.text.encode()
        own = cut(text)
        windows += [own[:: max(1, len(own) // 4)], cut(text[: 12 + k % 200])[:1]]  # short texts are to be told apart as well
        labels += [classes.index(r.lang)] * (len(windows[-2]) + len(windows[-1]))
    net = ByteNet(classes)
    net.train(np.concatenate(windows), np.array(labels))
    return net


def classify(docs: DataFrame, net: ByteNet | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score."""

    def run(batches):
        tables = net.fold() if net else []
        for batch in batches:
            texts = binary(batch, "text")
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            todo = [i for i, t in enumerate(texts) if net and t and has_letter(t)]
            for group in _groups(todo, texts):
                own = [cut(texts[i]) for i in group]
                sizes = np.array([len(x) for x in own])
                every = np.concatenate(own)
                weight = np.concatenate([np.minimum(WINDOW, len(texts[i]) - WINDOW * np.arange(len(x))) for i, x in zip(group, own, strict=True)])
                q = np.concatenate([net.probabilities(every[a : a + BATCH_WINDOWS], tables) for a in range(0, len(every), BATCH_WINDOWS)])
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                mean = np.add.reduceat(q * weight[:, None], starts, 0) / np.add.reduceat(weight, starts)[:, None]
                for i, row in zip(group, mean, strict=True):
                    k = int(row.argmax())
                    names[i], scores[i] = net.classes[k], min(1.0, float(row[k]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    rows = docs.select(*keep, "text")
    shape = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string", "score double"])
    return rows.mapInArrow(run, shape)


def _groups(todo: list[int], texts: list[bytes], most: int = 4 << 20):
    """Batches of texts of about most bytes together."""
    group, size = [], 0
    for i in todo:
        group.append(i)
        size += len(texts[i])
        if size >= most:
            yield group
            group, size = [], 0
    if group:
        yield group


def accepted(docs: DataFrame, net: ByteNet | None, least: float = 0.5) -> DataFrame:
    """Documents with a language predicted at a score of least or more, with all their columns."""
    names = docs.columns
    found = classify(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text"), net, keep=("row",))
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("row.*")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = classify(docs, fit(docs))
    return found.select("doc_id", in_fold("doc_id", FOLDS, HELD).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language": op10_language}
ORACLES: dict[str, str] = {}
