"""Toxicity by a classifier chain of linear models.

CATEGORIES are predicted one after another, and each link also reads the probabilities of the links
before it. In training these come from models that did not see the row (out-of-fold), so a link
learns from probabilities of the kind that it will read later; the models kept are refitted on all
training rows. Links, from the labels: ``in_prose`` (toxic, in a text of good quality), ``in_poor_text`` (toxic, in
a text of poor quality), and last ``toxic``, which reads both and gives the verdict.

Features are a text's distinct words (runs of letters and digits, A-Z lower-cased) and their first
4, 5 and 6 bytes, hashed; those that tell toxic from other rows are selected on the training rows,
and each model is an L2-regularised logistic regression on their presence.

Training takes at most TRAIN_ROWS labelled rows, chosen by a hash of their key, so its cost does not
grow; every document is scored, by its whole text, in one pass without a shuffle.

Defined results: a null or empty text has no features and gets the models' base probability;
without labelled rows of both kinds nothing is toxic (probabilities 0); rows of labels without a
document or with nulls are ignored; rows with one key count once, as toxic or good if any of them is;
repeated documents are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .store import ship

CATEGORIES = ("in_prose", "in_poor_text", "toxic")
TRAIN_ROWS = 4_000
FOLDS = 3
PREFIXES = (4, 5, 6)
SELECTED = 3_000
SPACE = 1 << 22

_LETTERS = np.zeros(256, dtype=bool)
_LETTERS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of each text: (text, feature) rows in order of the text."""
    found = W.scan(texts, lower=True, word_bytes=_LETTERS)
    owner = found.text_of_word()
    keys, owners = [found.hashes()], [owner]
    for n in PREFIXES:
        long = found.end - found.start > n
        keys.append(W.mix(W.span_hashes(found.data, found.start[long], found.start[long] + n) + W.U64(n)))
        owners.append(owner[long])
    both = np.unique(np.concatenate(owners).astype(np.uint64) << W.U64(32) | np.concatenate(keys) % W.U64(SPACE))
    return (both >> W.U64(32)).astype(np.int64), (both & W.U64(0xFFFFFFFF)).astype(np.int64)


@dataclass
class Chain:
    """Selected features (sorted) and, per category, weights, weights of earlier probabilities, bias."""

    selected: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: list[np.ndarray] = field(default_factory=list)
    earlier: list[np.ndarray] = field(default_factory=list)
    bias: list[float] = field(default_factory=list)
    threshold: float = 0.5

    def probabilities(self, row: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """(n, categories) for n texts with the given features."""
        out = np.zeros((n, len(CATEGORIES)))
        if not self.weights:
            return out
        at = np.minimum(np.searchsorted(self.selected, feature), len(self.selected) - 1)
        known = self.selected[at] == feature
        row, at = row[known], at[known]
        for c, w in enumerate(self.weights):
            out[:, c] = _sigmoid(np.bincount(row, w[at], n) + out[:, :c] @ self.earlier[c] + self.bias[c])
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _fit(row: np.ndarray, col: np.ndarray, extra: np.ndarray, y: np.ndarray, n_cols: int, steps: int = 250) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on sparse presence features and dense extras, by Adam on the whole gradient."""
    n = len(y)
    w = np.zeros(n_cols + extra.shape[1] + 1)
    w[-1] = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        p = _sigmoid(np.bincount(row, w[:n_cols][col], n) + extra @ w[n_cols:-1] + w[-1])
        e = (p - y) / n
        g = np.concatenate((np.bincount(col, e[row], n_cols), extra.T @ e, [e.sum()])) + np.append(1e-5 * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.99 ** t)) + 1e-9)
    return w[:n_cols], w[n_cols:-1], float(w[-1])


def train(rows: list[np.ndarray], toxic: np.ndarray, quality: np.ndarray) -> Chain:
    """Fit the chain on the features of each training row and its labels."""
    if not len(rows) or toxic.min() == toxic.max():
        return Chain()
    n = len(rows)
    row = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
    feature = np.concatenate(rows)
    values, col = np.unique(feature, return_inverse=True)
    hit = np.bincount(col, toxic[row], len(values))
    other = np.bincount(col, 1 - toxic[row], len(values))
    rate, base = (hit + 0.1) / (toxic.sum() + 0.2), (other + 0.1) / ((1 - toxic).sum() + 0.2)
    gain = hit * np.log(rate / base)  # words of toxic rows that others lack
    use = np.sort(np.argsort(-gain, kind="stable")[:SELECTED])
    use = use[(gain[use] > 0) & (hit[use] >= 3)]
    labels = np.stack([toxic * quality, toxic * (1 - quality), toxic]).astype(float)
    place = np.full(len(values), -1)
    place[use] = np.arange(len(use))
    keep = place[col] >= 0
    row, col = row[keep], place[col[keep]]
    chain, fold = Chain(values[use].astype(np.int64)), np.arange(n) % FOLDS
    probabilities = np.zeros((n, len(CATEGORIES)))  # out of fold
    for c, y in enumerate(labels):
        extra = probabilities[:, :c]
        for f in range(FOLDS):
            seen, held = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            spot = np.full(n, -1)
            spot[seen] = np.arange(len(seen))
            own = spot[row] >= 0
            w, e, b = _fit(spot[row[own]], col[own], extra[seen], y[seen], len(use))
            spot[:] = -1
            spot[held] = np.arange(len(held))
            own = spot[row] >= 0
            probabilities[held, c] = _sigmoid(np.bincount(spot[row[own]], w[col[own]], len(held)) + extra[held] @ e + b)
        w, e, b = _fit(row, col, extra, y, len(use))
        chain.weights.append(w)
        chain.earlier.append(e)
        chain.bias.append(b)
    chain.threshold = _threshold(probabilities[:, -1], labels[-1])
    return chain


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The probability above which out-of-fold predictions of the last category agree best with the
    labels, precision counting more than recall (largest F0.5; halfway down to the next lower row)."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    best = int(np.argmax(hits / (np.arange(1, len(y) + 1) + 0.25 * y.sum())))
    below = p[order[best + 1]] if best + 1 < len(y) else 0.0
    return float(np.sqrt(p[order[best]] * max(below, 1e-6)))


def training_rows(df: DataFrame, labels: DataFrame, key: str, text: str, limit: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Features and labels of at most ``limit`` labelled documents, those with the smallest hash of
    their key. The limit is taken on the labels, before any text is read."""
    usable = labels.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic"), F.col("quality").cast("int").alias("quality"))
    single = usable.dropna().groupBy("key").agg(F.max("toxic").alias("toxic"), F.max("quality").alias("quality"))
    chosen = (single.orderBy(F.xxhash64("key"), "key").limit(limit))
    texts = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    joined = texts.join(F.broadcast(chosen), "key").select("key", "toxic", "quality", "text")  # at most ``limit`` rows of three numbers
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("toxic", T.IntegerType()), T.StructField("quality", T.IntegerType()),
                           T.StructField("features", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                row, feature = features(part.column("text"))
                at = np.searchsorted(row, np.arange(part.num_rows + 1))
                packed = [feature[a:b].astype("<i4").tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([part.column("key").cast(pa.int64()), part.column("toxic"), part.column("quality"),
                                                  pa.array(packed, pa.binary())], schema.names)

    got = sorted({(r.key, r.toxic, r.quality, bytes(r.features)) for r in joined.mapInArrow(run, schema).collect()})
    return ([np.frombuffer(r[3], "<i4") for r in got], np.array([float(r[1] > 0) for r in got]),
            np.array([float(r[2] > 0) for r in got]))


def score(df: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a probability per category, and ``toxic`` (the last one reaches the chain's threshold,
    which is fitted on out-of-fold predictions)."""
    ship(df.sparkSession)
    source = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    names = [f"p_{c}" for c in CATEGORIES]
    schema = T.StructType([T.StructField(key, source.schema["key"].dataType), *(T.StructField(x, T.DoubleType()) for x in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.slices(batch, "text"):
                p = chain.probabilities(*features(part.column("text")), part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("key"), *(pa.array(x) for x in p.T)], schema.names)

    return source.mapInArrow(run, schema).withColumn("toxic", F.col("p_toxic") >= chain.threshold)


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = TRAIN_ROWS) -> DataFrame:
    """Train on the labelled rows of ``df`` and score all of them."""
    ship(df.sparkSession)
    return score(df, train(*training_rows(df, labels, key, text, limit)), key, text)
