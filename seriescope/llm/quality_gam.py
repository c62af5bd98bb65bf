"""Quality classifier: a generalised additive model with pairwise interactions.

Features are ratios of a text (``textstats``), cut into bins by quantiles. Boosting goes round the features in a cycle: each
turn fits one shallow tree on one feature's bins to what the model still gets wrong, and adds a small share of it to that
feature's lookup table. Then the pairs of features whose best cross cut explains most of the rest are boosted likewise, with
tables over two bins. A score is a sum of table entries through a logistic curve, added up for a whole batch at once.

The model is fitted on a bounded sample of labelled rows (``MAX_LABELLED``, by hash of the id over the whole label table);
ids, labels, language and source are never inputs.

Defined cases: a null or empty text has the ratios of an empty text and is scored like any other; a null id is kept, and its
fold is that of the empty text; repeated rows are scored each, and an id that is repeated is learned from once; without labels of both classes the score is the share of good
labels (0.5 without any); an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_fold
from .quality_rules import MAX_LABELLED, labelled_sample
from .textstats import RATIOS, with_stats

FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3
BINS, ROUNDS, PAIRS, PAIR_ROUNDS, RATE, LEAVES = 32, 150, 6, 60, 0.1, 4


@dataclass
class Model:
    features: tuple[str, ...]
    edges: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], axis=1) if len(x) else np.empty((0, len(self.edges)), np.int64)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for k, table in enumerate(self.tables):
            total += table[b[:, k]]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int = LEAVES, ridge: float = 1.0) -> np.ndarray:
    """Value for each bin of the best tree with ``leaves`` leaves over ordered bins, grown best first."""
    cg, ch = np.concatenate([[0], np.cumsum(grad)]), np.concatenate([[0], np.cumsum(hess)])
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    parts = [(0, len(grad))]
    while len(parts) < leaves:
        best = (1e-9, None, 0)
        for p in parts:
            cuts = np.arange(p[0] + 1, p[1])
            if len(cuts):
                gain = worth(p[0], cuts) + worth(cuts, p[1]) - worth(*p)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (gain[k], p, int(cuts[k]))
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _cross(grad: np.ndarray, hess: np.ndarray, ridge: float = 1.0) -> tuple[float, np.ndarray]:
    """The best cut of a table of bins into four quadrants: what it explains, and the value of each cell."""
    cg = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def quadrants(c):
        inner = c[1:-1, 1:-1]
        top, left = c[1:-1, -1:], c[-1:, 1:-1]
        return np.stack([inner, top - inner, left - inner, c[-1, -1] - top - left + inner])

    g, h = quadrants(cg), quadrants(ch)
    worth = (g**2 / (h + ridge)).sum(0)
    if not worth.size:
        return 0.0, np.zeros_like(grad)
    i, j = np.unravel_index(int(np.argmax(worth)), worth.shape)
    values = (g / (h + ridge))[:, i, j]
    out = np.empty_like(grad)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = values
    return float(worth[i, j]), out


def train(x: np.ndarray, y: np.ndarray, features: tuple[str, ...] = RATIOS) -> Model:
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6))
        return Model(features, [np.empty(0)] * len(features), float(np.log(share / (1 - share))), [np.zeros(1)] * len(features))
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for k in range(x.shape[1])]
    model = Model(features, edges, float(np.log(y.mean() / (1 - y.mean()))), [np.zeros(len(e) + 1) for e in edges])
    b, total = model.bins(x), np.full(len(y), 0.0) + model.intercept
    prob = lambda: 1 / (1 + np.exp(-total))
    for _ in range(ROUNDS):
        for k, table in enumerate(model.tables):
            p = prob()
            step = RATE * _tree(np.bincount(b[:, k], y - p, len(table)), np.bincount(b[:, k], p * (1 - p), len(table)))
            table += step
            total += step[b[:, k]]

    def cells(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        p, shape = prob(), (len(model.tables[i]), len(model.tables[j]))
        flat = b[:, i] * shape[1] + b[:, j]
        return np.bincount(flat, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(flat, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    ranked = sorted(combinations(range(len(features)), 2), key=lambda ij: -_cross(*cells(*ij))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            step = RATE * _cross(*cells(i, j))[1]
            table += step
            total += step[b[:, i], b[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MAX_LABELLED) -> Model:
    """Learns from labelled rows outside the held-out fold; at most about ``most`` of them reach the driver."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    known = labelled_sample(slim, labels, most, where=doc_fold(F.col("_lid"), FOLDS) != HELD_OUT)
    stats = with_stats(known.select(F.struct("doc_id", "_label").alias("key"), "text"), "key")
    rows = sorted(tuple(r) for r in stats.select(F.col("doc_id")["doc_id"], F.col("doc_id")["_label"], *RATIOS).collect())
    x = np.array([r[2:] for r in rows], float).reshape(len(rows), len(RATIOS))
    return train(x, np.array([r[1] for r in rows], float))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(k + 1).to_numpy(zero_copy_only=False) for k in range(len(model.features))], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    stats = with_stats(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    return stats.select("doc_id", *[F.col(f).cast("double") for f in model.features]).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    out = scored(docs, model, id_col, text_col)
    return out.select("doc_id", (doc_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
