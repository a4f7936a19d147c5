"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import labelled_sample, scored, table

#: Labelled documents that the model is fitted on, at most, and lines of a training chain; longer texts are several chains.
FIT_ROWS, FIT_LINES = 2000, 64
MODULUS, HELD, THRESHOLD = 5, 0, 0.3

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_KINDS = (_UPPER, _LOWER, _DIGITS, b" ", b"!?", b"|", b"#$%&*@^~=+<>\\", b".,;:", b"'\"()-[]{}/_`")
OWN = 8 + len(_KINDS)


def line_features(line: str, before: str | None) -> list[float]:
    """Numbers about one line, the line before being known."""
    data = line.encode()
    n = len(data) or 1
    words = line.split()
    count = len(words) or 1
    found = [
        math.log1p(len(data)),
        len(words) / n * 5,
        len(set(words)) / count,
        sum(map(operator.eq, words, words[1:])) / count,
        sum(map(str.isupper, words)) / count,
        sum(map(str.isalpha, words)) / count,
        float(line[-1:] in (".", "!", "?", '"')),
        float(before == line),
    ]
    found += [(len(data) - len(data.translate(None, kind))) / n for kind in _KINDS]
    return found


def chain_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line that isn't blank, its neighbours' included, and the lengths of these lines."""
    lines = [x for x in text.split("\n") if x.strip()]
    own = np.array([line_features(x, lines[i - 1] if i else None) for i, x in enumerate(lines)], np.float64).reshape(-1, OWN)
    none = np.zeros((min(1, len(lines)), OWN))
    before, after = np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none])
    edge = np.zeros((len(lines), 2))
    edge[:1, 0] = edge[-1:, 1] = 1
    return np.concatenate([own, before, after, edge], axis=1), np.array([len(x) for x in lines], np.float64)



def forward_backward(odds: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains of equal length: marginals of label 1 (chains x lines), and of label pairs summed over the chains.

    `odds`: score of label 1 less that of label 0, per line; `change`: scores of label pairs.
    """
    chains, lines = odds.shape
    unary = np.stack([np.zeros_like(odds), odds], axis=2)
    a, b = np.empty((chains, lines, 2)), np.zeros((chains, lines, 2))
    a[:, 0] = unary[:, 0]
    for t in range(1, lines):
        a[:, t] = unary[:, t] + np.logaddexp(a[:, t - 1, :1] + change[0], a[:, t - 1, 1:] + change[1])
        a[:, t] -= a[:, t].max(1, keepdims=True)
    for t in range(lines - 2, -1, -1):
        ahead = unary[:, t + 1] + b[:, t + 1]
        b[:, t] = np.logaddexp(change[:, 0] + ahead[:, :1], change[:, 1] + ahead[:, 1:])
        b[:, t] -= b[:, t].max(1, keepdims=True)
    both = a + b
    marginals = 1 / (1 + np.exp(np.clip(both[..., 0] - both[..., 1], -50, 50)))
    pairs = a[:, :-1, :, None] + change + (unary + b)[:, 1:, None, :]
    pairs = np.exp(pairs - pairs.max((2, 3), keepdims=True))
    pairs /= pairs.sum((2, 3), keepdims=True)
    return marginals, pairs.sum((0, 1))


class Model(NamedTuple):
    """Weights of standardised features, bias, scores of label pairs, and the scale of the document score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    change: np.ndarray
    slope: float
    shift: float

    def share(self, text: str) -> float:
        """Share of the text's length in good lines, by their marginals; one half without lines."""
        values, lengths = chain_features(text)
        if not len(values):
            return 0.5
        odds = (values - self.mean) / self.spread @ self.weights + self.bias
        marginals, _ = forward_backward(odds[None], self.change)
        return float(marginals[0] @ lengths / lengths.sum())

    def scores(self, texts: Iterable[str]) -> list[float]:
        found = []
        for text in texts:
            z = self.slope * (self.share(text) - 0.5) + self.shift
            found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return found


def _adam(gradient, start: np.ndarray, rounds: int, rate: float) -> np.ndarray:
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for t in range(1, rounds + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return x


def fit(rows: list[tuple[str, int]], rounds: int = 80, ridge: float = 1e-3) -> Model:
    """Maximum-likelihood field with every line of a document labelled like the document, then the scale of the score.

    Without both labels among the rows every score is one half.
    """
    width = 3 * OWN + 2
    if len({label for _, label in rows}) < 2:
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, np.zeros((2, 2)), 0.0, 0.0)
    chains, labels = [], []
    for text, label in rows:
        values, _ = chain_features(text)
        for start in range(0, len(values), FIT_LINES):
            chains.append(values[start : start + FIT_LINES])
            labels.append(label)
    every = np.concatenate(chains)
    mean, spread = every.mean(0), every.std(0) + 1e-6
    groups = {}
    for values, label in zip(chains, labels):
        groups.setdefault(len(values), []).append(((values - mean) / spread, label))
    groups = [(np.stack([v for v, _ in g]), np.array([y for _, y in g], float)) for g in groups.values()]
    total = len(every)

    def gradient(x):
        w, bias, change = x[:width], x[width], x[width + 1 :].reshape(2, 2)
        g = np.zeros_like(x)
        for values, y in groups:
            p, pairs = forward_backward(values @ w + bias, change)
            off = p - y[:, None]
            g[:width] += np.einsum("cl,clf->f", off, values)
            g[width] += off.sum()
            steps = values.shape[1] - 1
            seen = np.array([[(1 - y).sum() * steps, 0], [0, y.sum() * steps]])
            g[width + 1 :] += (pairs - seen).ravel()
        return g / total + ridge * x

    x = _adam(gradient, np.zeros(width + 5), rounds, 0.05)
    raw = Model(mean, spread, x[:width], float(x[width]), x[width + 1 :].reshape(2, 2), 1.0, 0.0)
    share = np.array([raw.share(t) for t, _ in rows]) - 0.5
    y = np.array([label for _, label in rows], float)

    def scale(v):
        p = 1 / (1 + np.exp(-np.clip(v[0] * share + v[1], -30, 30)))
        return np.array([((p - y) * share).mean(), (p - y).mean()]) + 1e-4 * v

    slope, shift = _adam(scale, np.zeros(2), 400, 0.1)
    return raw._replace(slope=float(slope), shift=float(shift))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Model from a bounded sample of the labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "quality", MODULUS, HELD, rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row of `docs`; more means better.

    Only the text counts, whole; null, empty and blank texts get the score of an even share. Rows are independent, so
    ties and repeats don't matter; a null doc_id folds as an empty text; other columns are ignored; no rows give no
    rows.
    """
    return scored(docs, model.scores, MODULUS, HELD, THRESHOLD)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
