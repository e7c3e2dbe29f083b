"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, remainder

#: Labelled rows that may be learnt from at most.
SAMPLE = 20_000
BINS = 64


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 128:
        return ord("x")
    if c.isupper():
        return ord("U")
    if c.islower():
        return ord("l")
    if c.isdigit():
        return ord("d")
    if c in " \t\n\r\x0b\x0c":
        return ord("s")
    return ord("p") if c in ".,;:'\"()-?!" else ord("y")


CLASSES = bytes(_class_of(b) for b in range(256))
NAMES = [
    "words", "word_length", "upper", "lower", "digits", "space", "punctuation", "symbols", "wide", "distinct", "repeats", "top_word",
    "shouts", "bars", "stacked", "full_stops", "lines", "distinct_lines", "upper_words", "short_words", "long_words", "commas",
]


def statistics(text: str | None) -> list[float]:
    """The figures of NAMES for a whole text; an empty text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    n, size = len(words), len(raw)
    kinds = raw.translate(CLASSES)
    low = raw.lower().split()
    counts = Counter(low)
    lines = raw.split(b"\n")
    lengths = list(map(len, words))
    return [
        np.log1p(n), (size - kinds.count(b"s")) / n,
        *(kinds.count(k) / size for k in (b"U", b"l", b"d", b"s", b"p", b"y", b"x")),
        len(counts) / n, sum(map(eq, low, islice(low, 1, None))) / n, max(counts.values()) / n,
        raw.count(b"!!") / n, raw.count(b" | ") / n, kinds.count(b"yyy") / n, raw.count(b".") / n,
        len(lines) / n, len(set(lines)) / len(lines), sum(map(bytes.isupper, words)) / n,
        sum(k <= 3 for k in lengths) / n, sum(k >= 14 for k in lengths) / n, raw.count(b",") / n,
    ]


@dataclass
class Trees:
    """Complete trees in flat arrays: (tree, inner node) and (tree, leaf)."""

    base: float
    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        """P(label 1) of the rows of x, all trees and rows at once, level by level."""
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        at, tree, row = np.zeros((len(x), trees), np.intp), np.arange(trees), np.arange(len(x))[:, None]
        first = 0
        while first < inner:
            node = first + at
            at = 2 * at + (x[row, self.feature[tree, node]] > self.edge[tree, node])
            first = 2 * first + 1
        return 1 / (1 + np.exp(-(self.base + self.leaf[tree, at].sum(1))))


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, ridge: float = 1.0, least: float = 2.0) -> Trees:
    """Trees for P(y = 1), fitted by second-order boosting on histograms of binned columns."""
    inner, leaves = 2**depth - 1, 2**depth
    if not len(y):
        return Trees(0.0, np.zeros((0, inner), int), np.zeros((0, inner)), np.zeros((0, leaves)))
    p = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(p / (1 - p)))
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.column_stack([np.searchsorted(e, c) for e, c in zip(edges, x.T)])  # bin b: edge b - 1 < value <= edge b
    feature, edge, leaf = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    total = np.full(len(y), base)
    for t in range(trees):
        q = 1 / (1 + np.exp(-total))
        g, h = q - y, np.maximum(q * (1 - q), 1e-9)
        at, first = np.zeros(len(y), np.intp), 0
        for level in range(depth):
            n = 2**level
            best, where, cut = np.zeros(n), np.zeros(n, int), np.full(n, BINS)
            for f, e in enumerate(edges):
                key = at * BINS + binned[:, f]
                gs, hs = (np.bincount(key, v, n * BINS).reshape(n, BINS) for v in (g, h))
                gl, hl = gs.cumsum(1), hs.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain[:, len(e) :] = 0
                b = gain.argmax(1)
                better = gain[np.arange(n), b] > best + 1e-12
                best[better], where[better], cut[better] = gain[np.arange(n), b][better], f, b[better]
            for k in range(n):
                if best[k] > 0:
                    feature[t, first + k], edge[t, first + k] = where[k], edges[where[k]][cut[k]]
            at = 2 * at + (binned[np.arange(len(y)), where[at]] > cut[at])
            first += n
        leaf[t] = -rate * np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + ridge)
        total += leaf[t][at]
    return Trees(base, feature, edge, leaf)


def _measure(batches):
    for batch in batches:
        x = [statistics(t) for t in batch["text"].to_pylist()]
        yield pa.RecordBatch.from_pydict({"x": x, "y": batch["y"].cast(pa.int32())}, pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most `sample` labelled rows; without any, every text scores 0.5."""
    rows = labelled_sample(docs, labels, "quality", 5, 0, sample).mapInArrow(_measure, "x array<double>, y int").collect()
    rows.sort(key=lambda r: (r.x, r.y))  # the same trees whatever the order of the tasks
    return boost(np.array([r.x for r in rows]).reshape(len(rows), len(NAMES)), np.array([float(r.y > 0) for r in rows]))


def score_udf(model: Trees):
    @F.arrow_udf("double")
    def quality(texts: pa.Array) -> pa.Array:
        x = np.array([statistics(t) for t in texts.to_pylist()]).reshape(len(texts), len(NAMES))
        return pa.array(np.concatenate([np.zeros(0), *(model.predict(x[i : i + 2048]) for i in range(0, len(x), 2048))]), pa.float64())

    return quality


def score(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs.

    score is P(label 1) from the statistics of the whole text; null and empty texts have
    zeros for statistics. Repeated rows each get a row; a null doc_id counts as empty text in the fold.
    """
    model = train(docs, labels)
    scored = docs.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score_udf(model)("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cut).cast("int"))


def good(docs: DataFrame, labels: DataFrame, cut: float = 0.3) -> DataFrame:
    """docs without the rows that score less than `cut`."""
    udf = score_udf(train(docs, labels))
    return docs.where(udf("text") >= cut)
