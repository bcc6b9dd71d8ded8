"""Toxicity by a support vector machine with a gap-weighted subsequence kernel and Nystroem landmarks.

Kernel: two words are compared by their common subsequences of three characters (edge marks included), weighted
``DECAY`` per skipped character up to a span of ``SPAN``, and normalised. ``i-d-i-o-t`` and ``idxiot`` stay close to the plain word.
Landmarks are the most telling words of toxic sentences and frequent words of the others; a word's kernel values with them,
whitened by the landmark kernel matrix, are its features, and a squared-hinge SVM is fitted on sentences in numpy. A sentence is
seen through its strongest word; which sentence of a toxic document is the toxic one is settled in rounds (multiple-instance
learning). Since the kernel's feature map is finite, the fitted machine is exactly one weight per subsequence, so scoring
needs no kernel values. A document's score is the calibrated value of its strongest word.

Defined results: null or empty texts, and texts without letters, get the score of an empty text; equal texts score equal; with no
labelled rows or one class only every score is the share of toxic rows (0 without rows). Words of any length are scored in
overlapping windows. Other columns pass through.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from dossierspark.llm.rows import with_columns

DECAY, SPAN, WINDOW, STEP = 0.5, 6, 24, 12
CODES = 1 << 18
SENTENCE = re.compile(r"[.!?\n]+")
SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][\s._*-]+){3,}[^\W\d_](?![^\W_])")
CACHED = 300_000
#: Kernel value below which a word may join the landmarks.
UNLIKE = 0.6


def units(text: str) -> set[str]:
    """Distinct letter strings to score: words without their other characters, and runs of single letters joined."""
    low = text.lower()
    found = set()
    for w in set(low.split()):
        if not w.isalpha():
            w = "".join(filter(str.isalpha, w))
        if w:
            found.add(w)
    for m in SPACED.finditer(low):
        found.add("".join(filter(str.isalpha, m[0])))
    return found


def _windows(words: list[str]) -> tuple[list[str], np.ndarray]:
    parts, owner = [], []
    for i, w in enumerate(words):
        for s in range(0, max(1, len(w) - WINDOW + STEP), STEP):
            parts.append(w[s:s + WINDOW])
            owner.append(i)
    return parts, np.array(owner, np.int64)


def _grams(parts: list[str]):
    """Per group of equally long strings: places, keys (subsequence code and gap count), and norms."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    gap_weight = (DECAY ** np.arange(4)).astype(np.float32)
    for n in np.unique(lengths):
        every = np.flatnonzero(lengths == n)
        for lo in range(0, len(every), 20_000):
            at = every[lo:lo + 20_000]
            c = np.frombuffer("".join(parts[i] for i in at).encode("utf-32-le", "replace"), np.uint32).reshape(len(at), n).astype(np.int32)
            c = np.where((c >= 97) & (c <= 122), c - 96, 27 + c % 34)
            edge = np.ones((len(at), 1), np.int32)
            c = np.hstack([62 * edge, c, 63 * edge]).astype(np.int32)
            m = n + 2
            keys = np.stack([c[:, i] << 14 | c[:, j] << 8 | c[:, k] << 2 | (k - i - 2)
                             for i in range(m) for k in range(i + 2, min(m, i + SPAN)) for j in range(i + 1, k)], axis=1)
            keys.sort(axis=1)
            weight = gap_weight[keys & 3]
            code = keys >> 2
            new = np.ones(code.shape, bool)
            new[:, 1:] = code[:, 1:] != code[:, :-1]
            sums = np.add.reduceat(weight.ravel(), np.flatnonzero(new.ravel()))
            norm = np.sqrt(np.add.reduceat(sums * sums, np.concatenate([[0], np.cumsum(new.sum(1))[:-1]])))
            yield at, code, weight, norm


def gap_kernel(a: str, b: str) -> float:
    """The normalised kernel of two short strings."""
    maps = []
    for w in (a, b):
        (_, code, weight, norm), = _grams([w])
        sums = Counter()
        for k, x in zip(code[0].tolist(), weight[0].tolist()):
            sums[k] += x / float(norm[0])
        maps.append(sums)
    return sum(x * maps[1][k] for k, x in maps[0].items())


@dataclass
class StringSvm:
    weights: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0
    empty: float = -2.0
    landmarks: list[str] = field(default_factory=list)

    def words(self, words: list[str]) -> np.ndarray:
        """SVM value of each letter string, the largest of its windows."""
        out = np.full(len(words), -np.inf)
        if words:
            parts, owner = _windows(words)
            value = np.empty(len(parts))
            for at, code, weight, norm in _grams(parts):
                value[at] = (self.weights[code] * weight).sum(1) / norm + self.bias
            np.maximum.at(out, owner, value)
        return out

    def score(self, value):
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * value + self.shift, -500, 500)))


def _dense(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Normalised feature maps as columns over the codes in use, and these codes."""
    groups = list(_grams(words))
    used = np.unique(np.concatenate([code.ravel() for _, code, _, _ in groups]))
    out = np.zeros((len(used), len(words)), np.float32)
    for at, code, weight, norm in groups:
        for r, i in enumerate(at):
            np.add.at(out[:, i], np.searchsorted(used, code[r]), weight[r] / norm[r])
    return out, used


def _landmark_features(words: list[str], table: np.ndarray, place: np.ndarray) -> np.ndarray:
    out = np.zeros((len(words), table.shape[1]), np.float32)
    parts, owner = _windows(words)
    first = np.concatenate([[True], owner[1:] != owner[:-1]])
    for at, code, weight, norm in _grams(parts):
        part = np.zeros((len(at), table.shape[1]), np.float32)
        for t in range(code.shape[1]):
            part += weight[:, t:t + 1] * table[place[code[:, t]]]
        lead = first[at]
        out[owner[at[lead]]] = part[lead] / norm[lead, None]
    return out


def _squared_hinge(x: np.ndarray, y: np.ndarray, w8: np.ndarray, cost: float, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton steps on the rows inside the margin, until these stay the same."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    ridge = np.eye(x1.shape[1]) / (2 * cost)
    ridge[-1, -1] = 1e-6
    active, w = np.ones(len(y), bool), np.zeros(x1.shape[1])
    for _ in range(rounds):
        weighted = x1[active] * w8[active, None]
        w = 0.5 * w + 0.5 * np.linalg.solve(ridge + weighted.T @ x1[active], weighted.T @ y[active]) if w.any() else np.linalg.solve(
            ridge + weighted.T @ x1[active], weighted.T @ y[active])
        now = y * (x1 @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def fit(samples: list[tuple[str, int]], landmarks: int = 64, rounds: int = 6, hard: int = 4_000, cost: float = 3.0,
        telling: float = 4.0) -> StringSvm:
    """A machine from (text, 0 or 1) pairs; ``landmarks`` of each class, ``hard`` negative sentences per round.

    A word that lifts the share of toxic documents by ``telling`` standard deviations and never stands in a clean one marks its sentences as toxic.
    """
    labels = np.array([y for _, y in samples])
    model = StringSvm(np.zeros(CODES, np.float32))
    if not len(labels) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.0
        model.shift = -500.0 if rate == 0 else 500.0
        return model
    place: dict[str, int] = {}
    sentences: list[tuple[int, np.ndarray]] = []
    for d, (text, _) in enumerate(samples):
        for s in SENTENCE.split(text):
            if u := units(s):
                sentences.append((d, np.fromiter((place.setdefault(w, len(place)) for w in sorted(u)), np.int64, len(u))))
    words = list(place)
    of_doc: list[list[np.ndarray]] = [[] for _ in samples]
    for d, s in sentences:
        of_doc[d].append(s)
    docs = [np.unique(np.concatenate(x)) if x else np.empty(0, np.int64) for x in of_doc]
    pos, neg = (np.bincount(np.concatenate([np.empty(0, np.int64), *[d for d, y in zip(docs, labels) if y == c]]), minlength=len(words)) for c in (1, 0))
    rate = labels.mean()
    value = (pos - rate * (pos + neg)) / np.sqrt(rate * (1 - rate) * (pos + neg) + 1.0)

    witness = Counter(words[d[value[d].argmax()]] for d, y in zip(docs, labels) if y == 1 and len(d))
    ranked = [w for w, _ in witness.most_common()] + [words[i] for i in np.argsort(-value, kind="stable")[:landmarks * 6]]
    common = [words[i] for i in np.argsort(-neg, kind="stable")[:landmarks]]
    offered = list(dict.fromkeys(w[:WINDOW] for w in dict.fromkeys([*ranked[:landmarks * 8], *common])))
    maps = _dense(offered)
    alike = maps[0].T @ maps[0]
    chosen, n_toxic = [], len(offered) - len(set(common) - set(ranked[:landmarks * 8]))
    for i in range(n_toxic):
        if len(chosen) < landmarks and all(alike[i, j] < UNLIKE for j in chosen):
            chosen.append(i)
    chosen = [offered[i] for i in [*chosen, *range(n_toxic, len(offered))]]
    dense, used = _dense(chosen)
    where = np.zeros(CODES, np.int64)
    where[used] = np.arange(1, len(used) + 1)
    table = np.vstack([np.zeros((1, len(chosen)), np.float32), dense])
    kernel = table.T.astype(np.float64) @ table
    own, basis = np.linalg.eigh(kernel)
    keep = own > 1e-6 * own[-1]
    root = basis[:, keep] / np.sqrt(own[keep])

    sure = {int(i): int(pos[i]) for i in np.flatnonzero((value >= telling) & (neg == 0))}
    # Clean words to hold down: the frequent ones, and the strongest of clean sentences of every round so far.
    against = dict.fromkeys(int(i) for i in np.argsort(-neg, kind="stable")[:hard // 2] if neg[i])
    for _ in range(rounds):
        toxic = Counter(sure)
        for d in np.flatnonzero(labels == 1):
            if of_doc[d]:
                told = max(of_doc[d], key=lambda s: value[s].max())
                toxic[int(told[value[told].argmax()])] += 1
        clean = Counter(int(s[value[s].argmax()]) for d, s in sentences if labels[d] == 0)
        against.update(dict.fromkeys(sorted(clean, key=lambda i: (-value[i], i))[:hard]))
        rows = [(i, 1, n) for i, n in toxic.items() if neg[i] <= n] + [(i, -1, min(neg[i], 20)) for i in against]
        y = np.array([r[1] for r in rows], np.float64)
        w8 = np.sqrt(np.array([r[2] for r in rows], np.float64))
        if not (y > 0).any() or not (y < 0).any():
            break
        for c in (1, -1):
            w8[y == c] *= 500.0 / w8[y == c].sum()
        z = _landmark_features([words[i] for i, _, _ in rows], table, where) @ root.astype(np.float32)
        w, model.bias = _squared_hinge(z, y, w8, cost)
        model.weights = np.zeros(CODES, np.float32)
        model.weights[used] = table[1:] @ (root @ w)
        value = model.words(words)
    model.landmarks = chosen
    top = np.array([value[d].max() if len(d) else model.empty for d in docs])
    model.empty = float(min(model.empty, top.min()))
    # Calibration with smoothed targets, by Newton steps.
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * top + b, -50, 50)))
        g = np.array([((p - target) * top).sum() + 1e-3 * a, (p - target).sum()])
        q = p * (1 - p)
        h = np.array([[(q * top * top).sum() + 1e-3, (q * top).sum()], [(q * top).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    model.slope, model.shift = float(max(a, 0.1)), float(b)
    return model


def score(docs: DataFrame, model: StringSvm, text: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with score and predicted (1 from 0.5 on)."""
    def make():
        known: dict[str, float] = {}

        def fn(column):
            value = np.full(len(column), model.empty)
            found = []
            fresh: set[str] = set()

            def settle():
                new = sorted(fresh)
                known.update(zip(new, model.words(new).tolist()))
                fresh.clear()
                for i, u in found:
                    value[i] = max(map(known.__getitem__, u))
                found.clear()
                if len(known) > CACHED:
                    known.clear()

            for i in range(len(column)):
                u = units(column[i].as_py() or "")
                if u:
                    found.append((i, u))
                    fresh.update(u.difference(known))
                    if len(fresh) > 50_000:
                        settle()
            settle()
            s = model.score(value)
            return [pa.array(s), pa.array((s >= 0.5).astype(np.int32))]
        return fn

    return with_columns(docs, [text], "score double, predicted int", make, drop)
