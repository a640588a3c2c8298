"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes ratios.

A document's features are its distinct n-grams of code points (of 4, 6 and 8, A-Z
lower-cased, one blank before and after the text). An n-gram is known by a 64-bit hash, so
that no other n-gram of a text counts as one that was learned. A feature's value is its
naive Bayes log-count ratio r, the log of its share of toxic over its share of other
documents; logistic regression learns a weight for each. Scoring reads the whole text.

What is learned from is bounded: of either label at most TRAIN_ROWS rows of ``labels``
outside the held-out fold, by the smallest hash of the id; their texts are written once.
n-grams that MIN_TOXIC toxic documents have are candidates (about CANDIDATES at most, those of most
toxic documents first, by whole counts; of equally frequent ones that don't all fit, those of
smallest hash); these are counted in the other documents, and the FEATURES with the
highest r times toxic count whose r is over RATIO_FLOOR are features. Clean wording is no
evidence against a few toxic words, or long documents would outweigh them.

Cases: null and empty texts have no n-grams and so the score of the bias alone. A doc_id
labelled twice counts as toxic if one label says so; null labels and ids are not learned
from. Repeated rows are scored each on its own. With no rows of one label to learn from,
every score is 0. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary, hash_sample, in_fold, materialise, table

ORDERS = (4, 6, 8)
TRAIN_ROWS = 8000
MIN_TOXIC = 3
CANDIDATES = 1 << 20
FEATURES = 1 << 18
RATIO_FLOOR = 1.5
EPOCHS = 6
FOLDS, HELD = 5, 0
#: Code points hashed at a time; the arrays of a block stay in a core's cache.
BLOCK = 1 << 15
#: n-grams that a task holds before it adds them up.
HELD_GRAMS = 1 << 21
#: Places of the table that passes what can be a feature.
BITS = 22
GRAM = "gram bigint, n bigint"


def code_points(text: bytes | None) -> np.ndarray:
    """The text between two blanks, A-Z lower-cased."""
    line = b" " + (text or b"").lower() + b" "
    return np.frombuffer(line, np.uint8).astype(np.uint64) if line.isascii() else np.frombuffer(line.decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.uint64)


def grams(points: np.ndarray):
    """Order by order, the hash of the n-gram at each place; longer ones go on from shorter ones."""
    code, done = None, 0
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            return
        code = points[:n].copy() if code is None else code[:n]
        for j in range(max(1, done), order):
            code *= np.uint64(0x9E3779B97F4A7C15)
            code += points[j : n + j]
        done = order
        mixed = (code ^ np.uint64(order)) * np.uint64(0xBF58476D1CE4E5B9)
        yield mixed ^ (mixed >> np.uint64(32))


def every_gram(text: bytes | None) -> np.ndarray:
    """All distinct n-grams of a text."""
    points = code_points(text)
    found = [g[:BLOCK] for a in range(0, len(points), BLOCK) for g in grams(points[a : a + BLOCK + ORDERS[-1] - 1])]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


class Grams:
    """A set of n-grams, ascending, that texts are searched for."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.may = np.zeros(1 << BITS, bool)
        self.may[(keys >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def of(self, text: bytes | None) -> np.ndarray:
        """The numbers of the n-grams that the text has, ascending."""
        points, found = code_points(text), [np.zeros(0, np.int64)]
        for a in range(0, len(points) if len(self.keys) else 0, BLOCK):
            for g in grams(points[a : a + BLOCK + ORDERS[-1] - 1]):
                g = g[:BLOCK]
                g = g[self.may[(g >> np.uint64(64 - BITS)).astype(np.int64)]]
                at = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
                found.append(at[self.keys[at] == g])
        return np.unique(np.concatenate(found))


class Model:
    def __init__(self, keys: np.ndarray, ratios: np.ndarray, weights: np.ndarray, bias: float):
        self.grams, self.ratios, self.weights, self.bias = Grams(keys), ratios, weights, bias
        self.values = weights * ratios

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        z = np.array([self.values[self.grams.of(t)].sum() for t in texts], float) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def training_texts(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """doc_id, toxic (0 or 1) and text of the sample, a written table."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~in_fold("doc_id", folds, held))
    known = known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    of = [hash_sample(known.where(F.col("toxic") == k), totals.get(k, 0), rows, "doc_id") for k in (0, 1)]
    sample = docs.select("doc_id", "text").join(F.broadcast(of[0].unionByName(of[1])), "doc_id")  # at most 2 * rows ids
    return materialise(sample.select(F.col("doc_id").cast("bigint").alias("doc_id"), "toxic", "text"), "training-texts")


def _counted(texts: DataFrame, of) -> DataFrame:
    """gram and n, the number of texts that have it; ``of`` gives a text's n-grams as int64."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for text in binary(batch, "text"):
                held.append(of(text))
                size += len(held[-1])
                if size > HELD_GRAMS:
                    yield added(held)
                    held, size = [], 0
        if held:
            yield added(held)

    def added(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64))], names=["gram", "n"])

    return texts.select("text").mapInArrow(run, GRAM).groupBy("gram").agg(F.sum("n").alias("n"))


def _collected(df: DataFrame, *columns: str) -> list[np.ndarray]:
    """Columns of 8-byte numbers, packed by the tasks."""

    def packed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).to_numpy().tobytes()], pa.binary()) for c in columns], names=list(columns))

    rows = df.select(*columns).mapInArrow(packed, ", ".join(f"{c} binary" for c in columns)).collect()
    kinds = [np.float64 if t == "double" else np.int64 for _, t in df.select(*columns).dtypes]
    return [np.concatenate([np.zeros(0, k), *(np.frombuffer(r[c], k) for r in rows)]) for c, k in zip(columns, kinds, strict=True)]


def ratios(texts: DataFrame, candidates: int = CANDIDATES, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray] | None:
    """The features' n-grams, ascending, and their log-count ratios, one added to each count; None without texts of either label."""
    n = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None
    often = _counted(texts.where("toxic = 1"), lambda t: every_gram(t).view(np.int64)).where(F.col("n") >= MIN_TOXIC)
    often = materialise(often, "toxic-grams")
    keys, toxic = _collected(often.where(_most_frequent(often, candidates)), "gram", "n")
    order = np.argsort(keys.view(np.uint64))
    keys, toxic = keys.view(np.uint64)[order], toxic[order]
    known = Grams(keys)
    other = np.zeros(len(keys), np.int64)
    at, count = _collected(_counted(texts.where("toxic = 0"), known.of), "gram", "n")
    other[at] = count
    ratio = np.log((toxic + 1) / (n[1] + 2.0)) - np.log((other + 1) / (n[0] + 2.0))
    kept = np.flatnonzero(ratio > RATIO_FLOOR)
    kept = np.sort(kept[np.lexsort((kept, -(ratio * toxic)[kept]))[:features]])
    return keys[kept], ratio[kept]


def _most_frequent(counted: DataFrame, most: int) -> Column:
    """True of about ``most`` n-grams, the most frequent ones; a row a count goes to the driver.

    Of those with the count at which not all fit any longer a share stays, by a hash, so that
    very many n-grams of one count (of copies of one text) neither all stay nor all go.
    """
    room, least = most, 1 << 62
    for r in counted.groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():
        if r.c > room:
            draw = F.pmod(F.xxhash64("gram"), F.lit(1 << 30))
            return (F.col("n") >= least) | ((F.col("n") == r.n) & (draw < (room << 30) // r.c))
        room, least = room - r.c, r.n
    return F.lit(True)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, folds: int = FOLDS, held: int = HELD) -> Model | None:
    texts = training_texts(docs, labels, rows, folds, held)
    learned = ratios(texts)
    if learned is None:
        return None
    known = Grams(learned[0])

    def thin(batches):
        for batch in batches:
            found = [known.of(t).astype(np.int32).tobytes() for t in binary(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(found, pa.binary())], names=["doc_id", "toxic", "found"])

    # of at most 2 * rows documents the numbers of the features that they have
    rows_ = sorted(texts.mapInArrow(thin, "doc_id bigint, toxic int, found binary").collect(), key=lambda r: (r.doc_id, r.toxic, bytes(r.found)))
    weights, bias = train([np.frombuffer(r.found, np.int32) for r in rows_], np.array([r.toxic for r in rows_]), learned[1])
    return Model(*learned, weights, bias)


def train(found: list[np.ndarray], toxic: np.ndarray, ratio: np.ndarray, epochs: int = EPOCHS, rate: float = 0.05, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression by AdaGrad; toxic rows weigh more where they are few."""
    w, g, b, gb = np.zeros_like(ratio), np.full_like(ratio, 1e-8), 0.0, 1e-8
    heavy = max(1.0, 0.3 * (toxic == 0).sum() / max(1, (toxic > 0).sum()))
    r = np.random.default_rng(3)
    for _ in range(epochs):
        for i in r.permutation(len(found)):
            at, y = found[i], int(toxic[i] > 0)
            x = ratio[at]
            p = 1 / (1 + np.exp(-np.clip(w[at] @ x + b, -40, 40)))
            d = (p - y) * (heavy if y else 1)
            step = d * x + decay * w[at]
            g[at] += step * step
            w[at] -= rate * step / np.sqrt(g[at])
            gb += d * d
            b -= rate * d / gb**0.5
    return w, float(b)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score."""

    def run(batches):
        for batch in batches:
            scores = model.scores(binary(batch, "text")) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, score double")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", in_fold("doc_id", FOLDS, HELD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
