"""Toxicity by logistic regression over hashed word n-grams, trained by FTRL-proximal."""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from inkwell.llm.common import labelled_sample, scored, table

#: Labelled documents that the model is fitted on, at most.
FIT_ROWS = 6000
MODULUS, HELD, THRESHOLD = 3, 1, 0.7
SPACE_BITS = 20
STEM = 4
#: Words whose hashes a worker keeps, at most, and the letters of such a word.
KEPT, KEPT_CHARS = 400_000, 64

_WORDS = re.compile(r"[^\W_]+")
_MASK = np.uint64((1 << SPACE_BITS) - 1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_known: dict[str, int] = {}


def _codes(word: str) -> int:
    """Hash of a word and, above it, of its stem."""
    code = zlib.crc32(word.encode()) | zlib.crc32(b"^" + word[:STEM].encode()) << 32
    if len(word) <= KEPT_CHARS:
        if len(_known) >= KEPT:
            _known.clear()
        _known[word] = code
    return code


def features(text: str) -> np.ndarray:
    """Hashed features of a text, repeats included: words, their stems, pairs of words, and pairs that skip a word."""
    words = _WORDS.findall(text.lower())
    if not words:
        return np.zeros(0, np.int64)
    codes = np.array([_known.get(w) or _codes(w) for w in words], np.uint64)
    own, stems = codes & np.uint64(0xFFFFFFFF), codes >> np.uint64(32)
    high = np.uint64(64 - SPACE_BITS)
    with np.errstate(over="ignore"):
        pair = ((own[:-1] * _ODD[0]) ^ (own[1:] * _ODD[1])) * _ODD[2] >> high
        skip = ((own[:-2] * _ODD[1]) ^ (own[2:] * _ODD[2])) * _ODD[0] >> high
        single = own * _ODD[0] >> high
        stem = stems * _ODD[1] >> high
    return np.concatenate([single, stem, pair, skip]).astype(np.int64)


class Model(NamedTuple):
    """Weights that are not zero, and the bias."""

    places: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, texts: Iterable[str]) -> list[float]:
        dense = np.zeros(1 << SPACE_BITS, np.float32)
        dense[self.places] = self.weights
        found = []
        for text in texts:
            here = features(text)
            here = np.unique(here[dense[here] != 0])
            z = self.bias + float(dense[here].sum(dtype=np.float64))
            found.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return found


def fit(rows: list[tuple[str, int]], epochs: int = 5, rate: float = 2.0, smooth: float = 1.0, noise: float = 0.8, toxic_weight: float = 3.0) -> Model:
    """FTRL-proximal over the documents one by one, each feature of a text counting once.

    Each weight has a learning rate of its own, from the sum of its squared gradients, and stays exactly zero until
    its summed gradient passes the L1 penalty. The penalty follows the chance sum that a feature without meaning
    gathers: `noise` times the standard deviation of the label count. Toxic rows, being few, weigh more. Without rows every score is one half.
    """
    share = sum(label for _, label in rows) / max(1, len(rows))
    l1 = noise * math.sqrt(len(rows) * share * (1 - share))
    size = 1 << SPACE_BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    sparse = [np.append(np.unique(features(t)), size) for t, _ in rows]
    penalty = np.full(size + 1, l1)
    penalty[size] = 0.0  # the bias is free

    def weights(at):
        zs, ns = z[at], n[at]
        raw = -(zs - np.sign(zs) * penalty[at]) / ((smooth + np.sqrt(ns)) / rate)
        return np.where(np.abs(zs) <= penalty[at], 0.0, raw)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            at = sparse[i]
            w = weights(at)
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(w.sum())))))
            g = (p - rows[i][1]) * (toxic_weight if rows[i][1] else 1.0)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / rate
            z[at] += g - sigma * w
            n[at] += g * g
    final = weights(np.arange(size + 1))
    places = np.flatnonzero(final[:size])
    return Model(places.astype(np.int64), final[places].astype(np.float32), float(final[size]))


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Model from a bounded sample of the labelled documents outside the held-out fold."""
    return fit(labelled_sample(docs, labels, "toxic", MODULUS, HELD, rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`(doc_id, held_out, score, predicted)` of every row of `docs`; more means more toxic.

    Only the text counts, whole; null and empty texts get the bias alone. Rows are independent, so ties and repeats
    don't matter; a null doc_id folds as an empty text; other columns are ignored; no rows give no rows.
    """
    return scored(docs, model.scores, MODULUS, HELD, THRESHOLD)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
