"""Quality classifier: a generalised additive model with pairwise interactions.

Features are binned by quantiles of the training rows.  Training boosts the log-loss in cycles: in turn each feature
gets one shallow tree (at most two cuts) over its bins, fitted to the current gradients and added to the feature's
lookup table.  Then the pairs of features with the largest gain of a two-way cut on the residuals are boosted in the
same way, with one cut along each axis.  The model is the intercept and lookup tables, so a score is a sum of bin
look-ups, done for a whole Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import measures

FEATURES = ("symbols", "digits", "upper", "pipes", "bangs", "repeats", "word_len", "line_len", "log_chars")
#: Most labelled rows that training takes, those with the least hash of id.  Scoring has no bound.
TRAIN_ROWS = 20_000


@dataclass(frozen=True)
class Gam:
    features: tuple
    cuts: tuple
    intercept: float
    tables: tuple
    pairs: tuple
    grids: tuple

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], "right") for j, c in enumerate(self.cuts)], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        out = np.full(len(x), self.intercept)
        for j, values in enumerate(self.tables):
            out += values[b[:, j]]
        for (i, j), grid in zip(self.pairs, self.grids):
            out += grid[b[:, i], b[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.raw(x)))


def _step(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best single cut of a run of bins; place 0 is no cut."""
    if len(g) < 2:
        return 0.0, 0
    lg, lh = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = lg**2 / (lh + 1) + (g.sum() - lg) ** 2 / (h.sum() - lh + 1) - g.sum() ** 2 / (h.sum() + 1)
    at = int(np.argmax(gain))
    return (float(gain[at]), at + 1) if gain[at] > 1e-12 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf value by bin of a tree with at most two cuts."""
    edges = [0, len(g)]
    for _ in range(2):
        gain, at = max((lambda c: (c[0], c[1] and a + c[1]))(_cut(g[a:b], h[a:b])) for a, b in zip(edges, edges[1:]))
        if not at:
            break
        edges = sorted({*edges, at})
    out = np.empty(len(g))
    for a, b in zip(edges, edges[1:]):
        out[a:b] = _step(g[a:b].sum(), h[a:b].sum())
    return out


def _grid_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best pair of cuts, one along each axis."""
    cg, ch = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (g, h))
    best, at = -1.0, (0, 0)
    r, c = g.shape
    quads = lambda m: (m[1:r, 1:c], m[1:r, c:] - m[1:r, 1:c], m[r:, 1:c] - m[1:r, 1:c], m[r, c] - m[1:r, c:] - m[r:, 1:c] + m[1:r, 1:c])
    if r < 2 or c < 2:
        return 0.0, np.zeros_like(g)
    gain = sum(a**2 / (b + 1) for a, b in zip(quads(cg), quads(ch))) - cg[r, c] ** 2 / (ch[r, c] + 1)
    k = int(np.argmax(gain))
    best, at = float(gain.flat[k]), (k // (c - 1) + 1, k % (c - 1) + 1)
    out = np.empty_like(g)
    for rows in (slice(0, at[0]), slice(at[0], r)):
        for cols in (slice(0, at[1]), slice(at[1], c)):
            out[rows, cols] = _step(g[rows, cols].sum(), h[rows, cols].sum())
    return best, out


def fit(x: np.ndarray, y: np.ndarray, features: tuple = FEATURES, n_bins: int = 32, rounds: int = 120, n_pairs: int = 4, pair_rounds: int = 40, rate: float = 0.15) -> Gam:
    """Train on rows ``x`` and 0/1 labels ``y``.  Without rows of both classes the model is the smoothed prior."""
    y = y.astype(float)
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    intercept = float(np.log(prior / (1 - prior)))
    cuts = tuple(np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) if len(x) else np.empty(0) for j in range(len(features)))
    model = Gam(tuple(features), cuts, intercept, tuple(np.zeros(len(c) + 1) for c in cuts), (), ())
    if not len(y) or y.min() == y.max():
        return model
    b, raw = model.bins(x), np.full(len(y), intercept)
    tables = [t.copy() for t in model.tables]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-raw))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, values in enumerate(tables):
            g, h = slopes()
            add = rate * _tree(np.bincount(b[:, j], g, len(values)), np.bincount(b[:, j], h, len(values)))
            values += add
            raw += add[b[:, j]]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(tables[i]), len(tables[j]))
        flat = b[:, i] * shape[1] + b[:, j]
        return flat, *(np.bincount(flat, m, shape[0] * shape[1]).reshape(shape) for m in (g, h))

    gains = sorted(((_grid_tree(*grid(i, j)[1:])[0], (i, j)) for i, j in combinations(range(len(features)), 2)), key=lambda r: (-r[0], r[1]))
    pairs = tuple(p for gain, p in gains[:n_pairs] if gain > 0)
    grids = [np.zeros((len(tables[i]), len(tables[j]))) for i, j in pairs]
    for _ in range(pair_rounds):
        for (i, j), values in zip(pairs, grids):
            flat, g, h = grid(i, j)
            add = rate * _grid_tree(g, h)[1]
            values += add
            raw += add.ravel()[flat]
    return Gam(tuple(features), cuts, intercept, tuple(tables), pairs, tuple(grids))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Gam:
    """Fit on at most ``train_rows`` labelled documents (least hash of id first); the rest of the tables isn't needed.

    Labels that are null or without a document don't count, and don't use up the sample.  Only their measures reach the
    driver.
    """
    some = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    some = some.join(docs.select("doc_id"), "doc_id", "left_semi")  # ids only
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(train_rows)
    known = measures(F.col("text"))
    # the sample is bounded by train_rows, so is what's broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("doc_id", "quality", *[known[f].alias(f) for f in FEATURES]).toPandas()
    rows = rows.sort_values(["doc_id", "quality", *FEATURES])
    return fit(rows[list(FEATURES)].to_numpy(float), (rows["quality"] > 0).to_numpy())


def classify(docs: DataFrame, model: Gam, threshold: float = 0.5) -> DataFrame:
    """``doc_id, score, keep`` for each row: probability of good quality, and whether it reaches ``threshold``.

    Null and empty texts are scored as texts of length 0, very long ones by their whole text; a score equal to the
    threshold keeps.  Repeated rows are scored each, ids may be null, an empty table gives no rows, extra columns are
    ignored.  Only the measures reach Python, texts don't.
    """
    known = measures(F.col("text"))
    narrow = docs.select("doc_id", *[known[f].alias(f) for f in FEATURES])

    # not a pandas UDF, which would queue the texts its arguments come from until their scores are back
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]], 1).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    scored = narrow.mapInArrow(run, f"doc_id {narrow.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("keep"))
