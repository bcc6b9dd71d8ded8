"""Quality classifier with supervised subword embeddings.

Every hashed feature (word, character 3- and 4-gram inside a word with its edges, and the difference of two neighbouring words'
hashes, which is one feature for any immediate repeat) has a learned vector. A document is the mean of its vectors; a linear
layer with softmax output sits on top, and all of it is trained by stochastic gradient descent in numpy. Mean and output layer
are linear, so each feature adds one number to the log odds; scoring sums these over the whole text.

Defined results: null or empty texts get the score of no features (the bias alone); equal texts score equal; without labelled rows
of both classes every score is the share of ones (0.5 without rows). Other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossierspark.llm.rows import passes, with_columns

BITS, DIM = 18, 16
SHIFT = np.uint32(32 - BITS)
_M1, _M2 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = (h ^ np.uint32(kind * 0x27D4EB2F & 0xFFFFFFFF)) * _M2
    return ((h ^ (h >> np.uint32(15))) * _M1) >> SHIFT


def features(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Arrays of feature buckets and of the text each belongs to."""
    stream = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "replace"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) + 1
    white = (stream == 32) | ((stream >= 9) & (stream <= 13))
    c = np.where(white, np.uint32(32), stream)
    owner = lambda at: np.searchsorted(ends, at, "right")
    buckets, owners = [], []
    two = c[:-1] * _M1 + c[1:]
    for kind, n in ((1, 3), (2, 4)):
        inner = ~white[1:-1] if n == 3 else ~(white[1:-2] | white[2:-1])
        at = np.flatnonzero(inner)
        h = two[at] * _M1 + c[at + 2] if n == 3 else two[at] * _M2 + two[at + 2]
        buckets.append(_bucket(h, kind))
        owners.append(owner(at + 1))
    starts = np.flatnonzero(~white[1:] & white[:-1]) + 1
    if len(starts):
        stops = np.flatnonzero(white[1:] & ~white[:-1]) + 1
        word_of = np.cumsum(np.diff(white.astype(np.int8), prepend=1) == -1) - 1
        place = (np.arange(len(c)) - starts[np.maximum(word_of, 0)]).astype(np.uint32)
        each = (c * _M2 ^ (c >> np.uint32(7))) * (place * np.uint32(2) + np.uint32(1)) * _M1
        each[white] = 0
        words = np.add.reduceat(each, starts, dtype=np.uint32) + (stops - starts).astype(np.uint32)
        mine = owner(starts)
        buckets.append(_bucket(words, 3))
        owners.append(mine)
        same = mine[1:] == mine[:-1]
        buckets.append(_bucket(words[1:] - words[:-1], 4)[same])
        owners.append(mine[1:][same])
    return buckets, owners


@dataclass
class SubwordModel:
    log_odds: np.ndarray
    bias: float

    def logits(self, texts: list[str]) -> np.ndarray:
        total, count = np.zeros(len(texts)), np.zeros(len(texts))
        for b, o in zip(*features(texts)):
            total += np.bincount(o, self.log_odds[b], len(texts))[:len(texts)]
            count += np.bincount(o, minlength=len(texts))[:len(texts)]
        return total / np.maximum(count, 1) + self.bias

    def score(self, texts: list[str]) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def fit(samples: list[tuple[str, int]], epochs: int = 6, rate: float = 20.0, seed: int = 7) -> SubwordModel:
    """A model from (text, 0 or 1) pairs."""
    labels = np.array([y for _, y in samples])
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or labels.min() == labels.max():
        return SubwordModel(np.zeros(1 << BITS, np.float32), {0.0: -500.0, 1.0: 500.0}.get(share, 0.0))
    rng = np.random.default_rng(seed)
    e = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    w, b = np.zeros((2, DIM), np.float32), np.log(np.array([1 - share, share], np.float32))
    bags = []
    for text, _ in samples:
        flat = np.concatenate(features([text])[0])
        at, n = np.unique(flat, return_counts=True)
        bags.append((at.astype(np.int32), (n / max(1, len(flat))).astype(np.float32)))
    total, done = epochs * len(samples), 0
    for _ in range(epochs):
        for i in rng.permutation(len(samples)):
            lr = np.float32(rate * (1 - done / total))
            done += 1
            at, weight = bags[i]
            if not len(at):
                continue
            rows = e[at]
            mean = weight @ rows
            z = w @ mean + b
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            grad = p @ w
            w -= lr * np.float32(0.05) * np.outer(p, mean)
            b -= lr * np.float32(0.002) * p
            e[at] = rows - lr * weight[:, None] * grad
    return SubwordModel((e @ (w[1] - w[0])).astype(np.float32), float(b[1] - b[0]))


def score(docs: DataFrame, model: SubwordModel, text: str = "text", threshold: float = 0.3, drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score (probability of label 1) and predicted (1 from ``threshold`` on)."""
    def make():
        def fn(column):
            texts = [t or "" for t in column.to_pylist()]
            parts = [model.score(texts[a:b]) for a, b in passes(texts, 1_000_000)]
            s = np.concatenate([*parts, np.empty(0)])
            return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
        return fn

    return with_columns(docs, [text], "score double, predicted int", make, drop)
