"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns a lookup table for each feature and then for some pairs of
features; a score is a sum of table entries, looked up by bins a batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgraph.llm.common import documents, even_sample, held_out, labels

#: Groups of ASCII characters of which each text's share is a feature.
_GROUPS = {
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": "abcdefghijklmnopqrstuvwxyz",
    "digits": "0123456789",
    "stars": "*",
    "money": "$%",
    "joints": "&|+=~^",
    "tags": "<>[]{}",
    "hashes": "#@_\\/",
    "calls": "!",
    "asks": "?",
    "stops": ".",
    "commas": ",;:",
    "quotes": "\"'()-",
    "spaces": " \t",
    "breaks": "\n\r",
}
FEATURES = (*_GROUPS, "letters_beyond", "log_bytes", "word_length", "distinct_words", "distinct_lines", "long_words", "entropy")
_GROUP_OF = np.full(256, len(_GROUPS), np.int64)
for _i, _g in enumerate(_GROUPS.values()):
    _GROUP_OF[np.frombuffer(_g.encode(), np.uint8)] = _i


def describe(text: str | None) -> np.ndarray:
    """FEATURES of a text; those of an empty one for null."""
    data = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(len(FEATURES))
    k = len(_GROUPS)
    out[k + 1] = np.log1p(len(data))
    if data:
        counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        out[: k + 1] = np.bincount(_GROUP_OF, counts, k + 1) / len(data)
        share = counts[counts > 0] / len(data)
        out[k + 6] = -(share * np.log2(share)).sum()
    parts = data.split()
    if parts:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        lines = [x for x in data.split(b"\n") if x.strip()]
        out[k + 2] = sizes.mean()
        out[k + 3] = len(set(parts)) / len(parts) ** 0.9
        out[k + 4] = len(set(lines)) / len(lines)
        out[k + 5] = (sizes > 12).mean()
    return out


@dataclass
class AdditiveModel:
    """Edges of bins by feature, tables of log-odds by feature and by pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 of rows of features."""
        odds = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            odds += table[np.searchsorted(edges, x[:, j], side="right")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="right") for pair in self.pairs for j in pair}
        for (i, j), table in self.pairs.items():
            odds += table[coarse[i], coarse[j]]
        return 1 / (1 + np.exp(-odds))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles between which values differ."""
    at = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], method="higher")
    return np.unique(at[at > x.min()])


def _tree(grad: np.ndarray, hess: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The step of each bin by a tree of a few leaves over bins in order, grown by the best cut."""
    g, h = np.concatenate([[0], grad.cumsum()]), np.concatenate([[0], hess.cumsum()])
    cuts = [0, len(grad)]

    def worth(a, b):
        return (g[b] - g[a]) ** 2 / (h[b] - h[a] + ridge)

    while len(cuts) <= leaves:
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                k = int(gain.argmax())
                best = max(best, (float(gain[k]), a + 1 + k), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.empty(len(grad))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + ridge)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """The step of each cell by one cut of either feature, and what it gains."""
    g = np.pad(grad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    h = np.pad(hess.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def four(s):
        inner, rows, columns, total = s[1:-1, 1:-1], s[1:-1, -1:], s[-1:, 1:-1], s[-1, -1]
        return np.stack([inner, rows - inner, columns - inner, total - rows - columns + inner])

    if min(grad.shape) < 2:
        return np.zeros(grad.shape), 0.0
    gs, hs = four(g), four(h)
    gain = (gs**2 / (hs + ridge)).sum(axis=0)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    steps = gs[:, i, j] / (hs[:, i, j] + ridge)
    out = np.empty(grad.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = steps
    return out, float(gain[i, j] - g[-1, -1] ** 2 / (h[-1, -1] + ridge))


def fit(
    x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, n_pairs: int = 6, bins: int = 32,
    coarse: int = 8, rate: float = 0.15, leaves: int = 3, ridge: float = 5.0,
) -> AdditiveModel:
    """Cyclic boosting: in each round every feature in turn gets one small tree's step.

    Pairs are those whose quadrants explain most of what the features alone leave.  Without rows
    of both labels the model knows the base rate only.
    """
    y = y.astype(float)
    rate_1 = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate_1 / (1 - rate_1))))
    n = x.shape[1]
    model.edges = [_edges(x[:, j], bins) if len(x) else np.empty(0) for j in range(n)]
    model.pair_edges = [_edges(x[:, j], coarse) if len(x) else np.empty(0) for j in range(n)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(np.unique(y)) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    odds = np.full(len(y), model.base)

    def slopes():
        p = 1 / (1 + np.exp(-odds))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j in range(n):
            size = len(model.tables[j])
            if size < 2:
                continue
            grad, hess = slopes()
            step = rate * _tree(np.bincount(at[j], grad, size), np.bincount(at[j], hess, size), leaves, ridge)
            model.tables[j] += step
            odds += step[at[j]]
    cells = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def sums(i, j, values):
        return np.bincount(cells[i] * sizes[j] + cells[j], values, sizes[i] * sizes[j]).reshape(sizes[i], sizes[j])

    grad, hess = slopes()
    gains = {(i, j): _quadrants(sums(i, j, grad), sums(i, j, hess), ridge)[1] for i in range(n) for j in range(i)}
    for pair in sorted(gains, key=gains.get, reverse=True)[:n_pairs]:
        model.pairs[pair] = np.zeros((sizes[pair[0]], sizes[pair[1]]))
    for _ in range(pair_rounds):
        for (i, j), table in model.pairs.items():
            grad, hess = slopes()
            step = rate * _quadrants(sums(i, j, grad), sums(i, j, hess), ridge)[0]
            table += step
            odds += step[cells[i], cells[j]]
    return model


def learn(docs: DataFrame, labelled: DataFrame, max_rows: int = 20_000, **parameters) -> AdditiveModel:
    """A model of ``quality`` from about *max_rows* labelled documents, an even sample by a hash of the id.

    Only the texts' features come to the driver: *max_rows* rows of a fixed number of figures.
    Labels other than 0 and 1, and such without a document, are left out.
    """
    sample = even_sample(labelled.where(F.col("quality").isin(0, 1)), "doc_id", max_rows).select("doc_id", "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [describe(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], ["quality", "x"])

    # The sample is bounded by max_rows, so it can go to every task instead of the texts to the labels.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select(F.col("quality").cast("int"), "text")
    found = rows.mapInArrow(run, "quality int, x array<double>").toArrow()
    y = np.array(found.column(0).to_pylist(), np.int64)
    x = np.array(found.column(1).to_pylist(), np.float64).reshape(len(y), len(FEATURES))
    # Rows come in no fixed order; sorted, the sums of each rerun agree to the last bit.
    order = np.lexsort([*x.T, y])
    return fit(x[order], y[order], **parameters)


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row; a null text is scored as an empty one.

    Each text is scored whole and by itself, so repeated rows score alike; a null ``doc_id`` stays
    null (and is not held out).  Other columns are not read.  An empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([describe(t) for t in batch.column(2).to_pylist()]).reshape(-1, len(FEATURES))
            scores = model.score(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    fold = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), fold.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def op6_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, labels(spark, sf_dir).where(~held_out(F.col("doc_id")))))
