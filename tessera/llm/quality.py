"""Quality scores of naive-Bayes support vectors.

Features are indicators of n-grams: single words and pairs, as they are written; single shapes, pairs and triples of
shapes, where a word's shape tells its case, length class, edge characters and whether it repeats the word before or
comes earlier in the text; and for each kind of shape the tenth that its share of the text falls into. Each indicator is
scaled by its log-count ratio between the classes, rows are scaled to length one, and a linear hinge-loss model is
fitted to them by dual coordinate descent. A logistic curve, fitted on the fourth of the sample that the model hasn't
seen and moved to the share of label 1 among all rows learned from, makes scores of margins. A text without words,
empty or null, has the intercept for its margin.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from tessera.llm.supervised import BUCKETS, SAMPLE, Sample, log_odds, sample, scored, sigmoid
from tessera.llm.text import SAME, mix, terms

MIN_ROWS = 3
SMOOTH = 1.0
COST = 1.0
EPOCHS = 12

_UPPER = np.zeros(256, dtype=np.int64)
_UPPER[65:91] = 1
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def _shapes(data: np.ndarray, words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """A small number for the shape of each word."""
    space = _SPACE[data]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    upper = np.concatenate(([0], np.cumsum(_UPPER[data])))
    sign = np.concatenate(([0], np.cumsum(~(_LETTER | _DIGIT | _SPACE)[data])))
    digit = np.concatenate(([0], np.cumsum(_DIGIT[data])))
    length, ups = ends - starts, upper[ends] - upper[starts]
    signs = sign[ends] - sign[starts]
    first, last = data[starts], data[ends - 1]
    case = np.where(ups == 0, 0, np.where(2 * ups >= length - signs, 2, 1))
    size = np.searchsorted([1, 3, 8, 16, 32], length)
    tail = np.where(_LETTER[last], 0, np.where(_DIGIT[last], 1, np.where((last == 44) | (last == 46), 2, 3)))
    front = np.where(_LETTER[first], 0, np.where(_DIGIT[first], 1, 2))
    mostly = np.where(signs * 2 >= length, 2, np.where(signs >= 2, 1, 0))
    numeric = (digit[ends] - digit[starts]) * 2 >= length
    again = np.zeros(len(words), dtype=np.int64)
    again[1:] = (words[1:] == words[:-1]) & (row[1:] == row[:-1])
    _, place = np.unique(mix(words ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))), return_index=True)
    seen = np.ones(len(words), dtype=np.int64)
    seen[place] = 0
    out = again
    for value, kinds in ((seen, 2), (case, 3), (size, 6), (tail, 4), (front, 3), (mostly, 3), (numeric, 2)):
        out = out * kinds + value
    return out


def _joined(x: np.ndarray, row: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of n values within rows, and their rows."""
    stop = max(len(x) - n + 1, 0)
    total = np.full(stop, salt, np.uint64)
    for k in range(n):
        total = total * np.uint64(0x9E3779B97F4A7C15) + x[k : stop + k]
    inside = row[:stop] == row[n - 1 : stop + n - 1]
    return mix(total[inside]), row[:stop][inside]


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's n-grams of words and shapes and of its shares, and their rows."""
    n = len(at) - 1
    # Rows are set apart by a line feed, so that a word never reaches over the edge of a row.
    apart = np.full(len(data) + n, 10, np.uint8)
    apart[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(at))] = data
    at = at + np.arange(n + 1)
    ends, words = terms(apart, at, lower=SAME)
    count = np.diff(ends)
    row = np.repeat(np.arange(n), count)
    shape = _shapes(apart, words, row)
    out = [_joined(words, row, 1, 1), _joined(words, row, 2, 2)]
    out += [_joined(shape.astype(np.uint64), row, k, 2 + k) for k in (1, 2, 3)]
    parts = shape.copy()
    for k, kinds in enumerate((2, 3, 3, 4, 6, 3, 2, 2)):
        parts, value = np.divmod(parts, kinds)
        for v in range(1, kinds):
            share = np.bincount(row, value == v, n)[count > 0] / count[count > 0]
            h = np.ceil(share * 10).astype(np.uint64) + np.uint64(1000 * (10 * k + v) + 7)
            out.append((mix(h), np.flatnonzero(count > 0)))
    return np.concatenate([x for x, _ in out]), np.concatenate([r for _, r in out])


@dataclass
class Model:
    """scales: log-count ratios; weights: of the scaled indicators; slope and shift: from margins to log odds."""

    scales: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        x = self.scales[bucket]
        norm = np.sqrt(np.bincount(row, x * x, n))
        return np.bincount(row, x * self.weights[bucket], n) / np.where(norm > 0, norm, 1) + self.bias

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.slope * self.margins(row, bucket, n) + self.shift)


def descend(values: np.ndarray, buckets: np.ndarray, at: np.ndarray, y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and intercept of the least hinge loss with an L2 penalty, by dual coordinate descent; y is -1 or 1."""
    w, b, alpha = np.zeros(BUCKETS), 0.0, np.zeros(len(y))
    q = np.array([np.dot(values[s:e], values[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]) + 1
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            x, k = values[at[i] : at[i + 1]], buckets[at[i] : at[i + 1]]
            slack = y[i] * (np.dot(x, w[k]) + b) - 1
            new = min(max(alpha[i] - slack / q[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[k] += step * x
                b += step
                alpha[i] = new
    return w, b


def _curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve, by Newton's method with a small penalty on the slope; targets are smoothed."""
    pos, neg = int(labels.sum()), int((1 - labels).sum())
    target = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    theta = np.array([1.0, 0.0])
    x = np.stack((margins, np.ones(len(margins))), axis=1)
    for _ in range(50):
        p = sigmoid(x @ theta)
        grad = x.T @ (p - target) + np.array([1e-3 * theta[0], 0])
        hess = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag([1e-3, 1e-9])
        step = np.linalg.solve(hess, grad)
        theta -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


def fit(learned: Sample) -> Model:
    """The model of a sample; without both labels in it, every score is the share of label 1."""
    y, row, bucket = learned.labels, learned.rows, learned.buckets
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 1.0, log_odds(learned.prior))
    kept = np.arange(len(y)) % 4 != 3
    if len(np.unique(y[~kept])) < 2:
        kept = np.ones(len(y), dtype=bool)
    used = kept[row]
    one = np.bincount(bucket[used & (y[row] == 1)], minlength=BUCKETS)
    zero = np.bincount(bucket[used & (y[row] == 0)], minlength=BUCKETS)
    p, q = one + SMOOTH, zero + SMOOTH
    scales = np.log(p / p.sum()) - np.log(q / q.sum())
    scales[one + zero < MIN_ROWS] = 0
    x = scales[bucket]
    norm = np.sqrt(np.bincount(row, x * x, len(y)))
    x = x / np.where(norm > 0, norm, 1)[row]
    sign = np.where(y == 1, 1.0, -1.0)
    ends = np.concatenate(([0], np.cumsum(np.diff(learned.at)[kept])))
    w, b = descend(x[used], bucket[used], ends, sign[kept], np.full(int(kept.sum()), COST))
    margins = np.bincount(row, x * w[bucket], len(y)) + b
    other = ~kept if not kept.all() else kept
    slope, shift = _curve(margins[other], y[other])
    return Model(scales, w, b, slope, shift + log_odds(learned.prior) - log_odds(float(y.mean())))


def train(docs: DataFrame, labels: DataFrame, learned: Column, key: str = "doc_id", text: str = "text", label: str = "quality", limit: int = SAMPLE) -> Model:
    """The model of at most `limit` rows of each class among the labelled ones for which `learned` holds."""
    return fit(sample(docs, labels, key, text, label, learned, features, limit))


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each text; a column that has the score's name already is replaced. What is sent to executors has a fixed size, that of BUCKETS numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return scored(docs, text, features, lambda row, bucket, n: shared.value.scores(row, bucket, n), name)
