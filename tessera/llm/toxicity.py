"""Toxicity scores of a factorization machine over hashed terms.

A text's terms are its words, split at white space and ASCII punctuation and lower-cased in ASCII, and their prefixes
of four, six and eight bytes, which stand for stems. Each distinct term counts once, so a score doesn't depend on a text's
length. The machine has a weight and a short vector for each hashed term: the dot products of the vectors are the
weights of pairs of terms, which an additive model lacks. The sum over pairs is divided by the root of the number of terms, since a long
text has more pairs than a short one by the square of its length, most of them of words that say nothing. Weights start from
a part of the terms' log ratios of rows between the classes, less a standard error, so that rare telling terms count; vectors start from
small random values. The machine is fitted by AdaGrad on a bounded labelled sample and moved to the share of label 1
among all rows learned from. Terms in fewer than MIN_ROWS rows of the sample have no weight and aren't counted. The
settings were chosen by cross-validation among rows outside the held-out fold. A text without terms, empty or null, gets the score of the intercept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame

from tessera.llm.supervised import BUCKETS, SAMPLE, Sample, log_odds, sample, scored, sigmoid
from tessera.llm.text import PUNCTUATION, mix, terms

FACTORS = 6
EPOCHS = 14
BATCH = 100
MIN_ROWS = 10
STEP = 0.1
DECAY = 1e-4
BIAS_STEP = 0.3
VECTOR_STEP = 0.1
VECTOR_DECAY = 1e-4
#: The share of the log ratios that weights start from, and the deviation of the vectors' first values.
RATIO, START = 0.4, 0.05


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words and prefixes, and their rows."""
    ends, words, *stems = terms(data, at, gaps=PUNCTUATION, prefixes=(4, 6, 8))
    row = np.repeat(np.arange(len(at) - 1), np.diff(ends))
    out, rows = [words], [row]
    for h in stems:
        has = h != 0
        out.append(mix(h[has]))
        rows.append(row[has])
    return np.concatenate(out), np.concatenate(rows)


@dataclass
class Machine:
    """bias + sum of weights + sum over pairs of n terms of the dot products of their vectors, divided by the root of n."""

    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        known = self.weights[bucket] != 0
        row, bucket = row[known], bucket[known]
        out = np.bincount(row, self.weights[bucket], n) + self.bias
        if len(row):
            heads = np.flatnonzero(np.diff(row, prepend=-1))
            v = self.vectors[bucket]
            both = np.square(np.add.reduceat(v, heads, axis=0)) - np.add.reduceat(v * v, heads, axis=0)
            out[row[heads]] += 0.5 * both.sum(axis=1) / np.sqrt(np.diff(np.append(heads, len(row))))
        return out

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        return sigmoid(self.margins(row, bucket, n))


def ratios(term: np.ndarray, label: np.ndarray, m: int, ones: float, n: int) -> np.ndarray:
    """For each of m terms the log ratio of the shares of rows with it among those of label 1 and 0, a standard error nearer to
    zero; 0 where a class has no rows."""
    zeros = n - ones
    if not ones or not zeros:
        return np.zeros(m)
    one, zero = np.bincount(term[label == 1], minlength=m) + 1, np.bincount(term[label == 0], minlength=m) + zeros / ones
    ratio = np.log(one / (ones + 2)) - np.log(zero / (zeros + 2 * zeros / ones))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - np.sqrt(1 / one + 1 / zero), 0)


def fit(learned: Sample, factors: int = FACTORS, epochs: int = EPOCHS) -> Machine:
    """A machine for the sample; the order of rows and the first vectors come from a fixed seed."""
    n, rng = len(learned.labels), np.random.default_rng(7)
    kept, place = np.unique(learned.buckets, return_inverse=True)
    often = np.bincount(place, minlength=len(kept)) >= MIN_ROWS
    number = np.cumsum(often) - 1
    use = often[place]
    row, term = learned.rows[use], number[place[use]]
    at = np.searchsorted(row, np.arange(n + 1))
    m = int(often.sum())
    y = learned.labels.astype(np.float32)
    first = (RATIO * ratios(term, y[row], m, float(y.sum()), n)).astype(np.float32)
    w, v, b = first.copy(), rng.normal(0, START, (m, factors)).astype(np.float32), log_odds(float(y.mean())) if n else 0.0
    gw, gv, gb = np.full(m, 1e-2, np.float32), np.full((m, factors), 1e-2, np.float32), 1e-2
    for _ in range(epochs if n else 0):
        order = rng.permutation(n)
        for lo in range(0, n, BATCH):
            pick = order[lo : lo + BATCH]
            x = np.zeros((len(pick), m), np.float32)
            for i, r in enumerate(pick):
                x[i, term[at[r] : at[r + 1]]] = 1
            s = x @ v
            share = (1 / np.sqrt(np.maximum(at[pick + 1] - at[pick], 1))).astype(np.float32)
            margin = b + x @ w + 0.5 * share * (np.square(s).sum(1) - (x @ (v * v)).sum(1))
            g = ((sigmoid(margin) - y[pick]) / len(pick)).astype(np.float32)
            pull = g * share
            dw = x.T @ g + DECAY * (w - first)
            dv = x.T @ (pull[:, None] * s) - (x.T @ pull)[:, None] * v + VECTOR_DECAY * v
            gw += dw * dw
            gv += dv * dv
            gb += float(g.sum()) ** 2
            w -= STEP * dw / np.sqrt(gw)
            v -= VECTOR_STEP * dv / np.sqrt(gv)
            b -= BIAS_STEP * float(g.sum()) / gb**0.5
    if n:
        b += log_odds(learned.prior) - log_odds(float(y.mean()))
    weights, vectors = np.zeros(BUCKETS, np.float32), np.zeros((BUCKETS, factors), np.float32)
    weights[kept[often]] = np.where(w == 0, np.float32(1e-12), w)
    vectors[kept[often]] = v
    return Machine(b, weights, vectors)


def train(docs: DataFrame, labels: DataFrame, learned: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE) -> Machine:
    """The machine of at most `limit` rows of each class among the labelled ones for which `learned` holds."""
    return fit(sample(docs, labels, key, text, label, learned, features, limit))


def score(docs: DataFrame, machine: Machine, text: str = "text", name: str = "score") -> DataFrame:
    """docs with a score from 0 to 1 of each text; a column that has the score's name already is replaced. What is sent to executors has a fixed size, that of BUCKETS vectors."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return scored(docs, text, features, lambda row, bucket, n: shared.value.scores(row, bucket, n), name)
