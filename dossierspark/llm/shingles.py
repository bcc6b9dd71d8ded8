"""Word shingles as 64-bit hashes, computed in numpy batches. Two different shingles share a hash with odds of 2^-64."""

from __future__ import annotations

import re

import numpy as np
import xxhash

CACHED_WORDS = 100_000
LETTERS = re.compile(r"[^\W_]+")


class WordHashes(dict):
    """Hash of a word, kept for as many words as the cache holds."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(words: list[bytes], known: WordHashes, size: int = 5) -> np.ndarray:
    """Sorted distinct int64 hashes of all runs of ``size`` words; fewer words are one run, no words none."""
    return runs_set(words, known, [min(size, len(words))])


def runs_set(words: list[bytes], known: WordHashes, widths: list[int]) -> np.ndarray:
    """Sorted distinct int64 hashes of all runs of words of each of the ``widths``; runs of different widths have different hashes."""
    n, parts = len(words), [np.empty(0, np.int64)]
    a = np.fromiter(map(known.__getitem__, words), np.uint64, n)
    for width in widths:
        if 0 < width <= n:
            h = a[:n - width + 1] + np.uint64(width)
            for k in range(1, width):
                h = _mixed(h) + a[k:n - width + 1 + k]
            parts.append(_mixed(h).view(np.int64))
    return np.unique(np.concatenate(parts))


def plain_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, with A-Z lower-cased."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def letter_words(text: str | None) -> list[bytes]:
    """Runs of letters and digits in lower case; punctuation does not count."""
    return " ".join(LETTERS.findall(text.lower())).encode("utf-8", "replace").split() if text else []
