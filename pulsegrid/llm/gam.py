"""Text quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the model is a bias, a lookup table for each feature and one for each of a few
pairs. Training goes round the features again and again and fits a shallow tree on the bins to what the others leave
(the gradient of the logistic loss); the pairs that promise most are then boosted the same way. A text is scored by
adding up its bins' entries.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.llm.common import without

#: The classifier is fitted on this many labelled rows at most, chosen by a hash of their id.
MAX_ROWS = 50_000
BINS, PAIR_BINS, PAIRS = 48, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 150, 60, 0.1, 2.0
FEATURES = (
    "log_words",
    "word_length",
    "distinct_words",
    "symbol_chars",
    "upper_chars",
    "digit_chars",
    "bar_chars",
    "exclamations",
    "closing_words",
    "repeated_lines",
    "words_a_line",
    "adjacent_repeats",
    "repeated_triples",
    "longest_word",
)
_SYMBOLS = np.frombuffer(b"#*$%&<>", np.uint8)


def features(text: str) -> list[float]:
    """The features of one text; all 0 for a text without words."""
    w = text.split()
    if not w:
        return [0.0] * len(FEATURES)
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n, size = len(w), max(1, len(text))
    lines = text.split("\n")
    return [
        float(np.log1p(n)),
        sum(map(len, w)) / n,
        len(set(w)) / n,
        float(raw[_SYMBOLS].sum()) / size,
        float(raw[65:91].sum()) / size,
        float(raw[48:58].sum()) / size,
        float(raw[124]) / size,
        float(raw[33]) / n,
        sum(x[-1] in ".!?" for x in w) / n,
        1 - len(set(lines)) / len(lines),
        n / len(lines),
        sum(map(operator.eq, w, w[1:])) / n,
        1 - len(set(zip(w, w[1:], w[2:], strict=False))) / max(1, n - 2) if n > 2 else 0.0,
        float(max(map(len, w))),
    ]


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows of a feature matrix: additions of table entries."""
        z = np.full(len(x), self.bias)
        for f, (cut, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], side="right")]
        for i, j, table in self.pairs:
            z += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Edges between bins: midpoints around quantiles, so that equal values share a bin."""
    values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
    return (values[1:] + values[:-1]) / 2


def _split(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The best cut of a run of bins: its gain, and the number of bins to the left (0: none)."""
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(a):
        return 0.0, 0
    gain = a**2 / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    at = int(gain.argmax())
    return (float(gain[at]), at + 1) if gain[at] > 1e-9 else (0.0, 0)


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of depth 2 over ordered bins, as the value of each bin."""
    out = np.zeros(len(g))
    _, root = _split(g, h)
    for low, high in [(0, root), (root, len(g))] if root else [(0, len(g))]:
        _, at = _split(g[low:high], h[low:high])
        for a, b in [(low, low + at), (low + at, high)] if at else [(low, high)]:
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cross of one cut in each of two features: its gain and the value of each cell."""
    a, b = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    quarters = []
    for s in (a, b):
        left, top, whole = s[:-1, -1:], s[-1:, :-1], s[-1, -1]
        x = s[:-1, :-1]
        quarters.append(np.stack([x, left - x, top - x, whole - left - top + x]))
    gains = (quarters[0] ** 2 / (quarters[1] + RIDGE)).sum(0)
    i, j = np.unravel_index(gains.argmax(), gains.shape)
    value = quarters[0][:, i, j] / (quarters[1][:, i, j] + RIDGE)
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = value
    return float(gains[i, j]), out


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting over the features, then over the pairs of the greatest gain."""
    n, k = x.shape
    share = (y.sum() + 0.5) / (n + 1.0)
    bias = float(np.log(share / (1 - share)))
    edges, pair_edges = [cuts(c, BINS) for c in x.T] if n else [np.zeros(0)] * k, [cuts(c, PAIR_BINS) for c in x.T] if n else [np.zeros(0)] * k
    tables, pairs = [np.zeros(len(e) + 1) for e in edges], []
    if not 0 < y.sum() < n:
        return Model(bias, edges, tables, pair_edges, pairs)
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T, strict=True)]
    z = np.full(n, bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(k):
            g, h = slopes()
            step = RATE * shallow_tree(np.bincount(bins[f], g, len(tables[f])), np.bincount(bins[f], h, len(tables[f])))
            tables[f] += step
            z += step[bins[f]]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(pair_edges, x.T, strict=True)]

    def grid(i: int, j: int, values: np.ndarray) -> np.ndarray:
        wide = len(pair_edges[j]) + 1
        return np.bincount(coarse[i] * wide + coarse[j], values, (len(pair_edges[i]) + 1) * wide).reshape(-1, wide)

    g, h = slopes()
    able = [(i, j) for i in range(k) for j in range(i) if len(pair_edges[i]) and len(pair_edges[j])]
    best = sorted(able, key=lambda p: -_cross(grid(*p, g), grid(*p, h))[0])[:PAIRS]
    found = {p: np.zeros((len(pair_edges[p[0]]) + 1, len(pair_edges[p[1]]) + 1)) for p in best}
    for _ in range(PAIR_ROUNDS):
        for p in best:
            g, h = slopes()
            step = RATE * _cross(grid(*p, g), grid(*p, h))[1]
            found[p] += step
            z += step[coarse[p[0]], coarse[p[1]]]
    return Model(bias, edges, tables, pair_edges, [(i, j, t) for (i, j), t in found.items()])


def with_features(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """`df` with its text replaced by the array of its features."""
    at, rest = df.columns.index(text_col), [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField(out_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [features(t.as_py() or "") for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(found, pa.list_(pa.float64()))], [*(f.name for f in rest), out_col])

    return df.mapInArrow(run, schema)


def fit(training: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model from (id, t, y) rows; at most `max_rows` of them, by a hash of the id, reach the driver as features."""
    chosen = with_features(training.select("id", "t", "y"), "t", "x").orderBy(F.xxhash64("id"), "id").limit(max_rows).select("x", "y").toPandas()
    x = np.stack(chosen["x"].to_list()) if len(chosen) else np.zeros((0, len(FEATURES)))
    return train(x, chosen["y"].to_numpy(float))


def judge_quality(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """`docs` without its text, with the probability of label 1.

    Null and empty texts have features of 0 and get the score that follows. Repeated rows are judged each; there is no
    shuffle. A column of the name of the score is replaced; an empty table gives none.
    """
    df = docs.select(*without(docs, score_col.lower()))
    at, rest = df.columns.index(text_col), [f for f in df.schema.fields if f.name != text_col]
    schema = T.StructType([*rest, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([features(t.as_py() or "") for t in b.column(at)]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.array(model.score(x))], [*(f.name for f in rest), score_col])

    return df.mapInArrow(run, schema)
