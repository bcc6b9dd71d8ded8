"""The few vectorised Python functions Catalyst has no expression for."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda v: None if v is None else unicodedata.normalize("NFKC", v))


def common_length(x: str, y: str) -> int:
    """Length of the longest common subsequence, a bit for each character of one text: no ratio matches more characters, in either order."""
    ends, least = 0, min(len(x), len(y))
    while ends < least and x[ends] == y[ends]:
        ends += 1
    x, y, least, tail = x[ends:], y[ends:], least - ends, 0
    while tail < least and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    x, y = x[:len(x) - tail], y[:len(y) - tail]
    if not x or not y:
        return ends + tail
    places: dict[str, int] = {}
    for i, c in enumerate(x):
        places[c] = places.get(c, 0) | 1 << i
    full = left = (1 << len(x)) - 1
    for c in y:
        met = left & places.get(c, 0)
        left = ((left + met) | (left - met)) & full
    return ends + tail + len(x) - left.bit_count()


def _ratios(x: str, y: str, threshold: float, both: bool) -> list[float | None]:
    """The ratio of (x, y) and, with ``both``, of (y, x), each where it reaches the threshold; bounds that hold for either come first."""
    x, y = x or "", y or ""
    orders = [(x, y), (y, x)] if both else [(x, y)]
    total = len(x) + len(y)
    if total and (2.0 * min(len(x), len(y)) / total < threshold or 2.0 * common_length(x, y) / total < threshold):
        return [None] * len(orders)
    values = [SequenceMatcher(None, *order).ratio() for order in orders]
    return [v if v >= threshold else None for v in values]


def ratio_at_least(threshold: float):
    """The ratio where it reaches the threshold, null elsewhere. Pairs should pass ``count_bound`` before."""
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_ratios(x, y, threshold, False)[0] for x, y in zip(a, b)], dtype="float64")

    return F.pandas_udf(run, T.DoubleType())


def ratios_at_least(threshold: float):
    """(forward, backward): the ratio of (a, b) and of (b, a), which may differ, each where it reaches the threshold."""
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_ratios(x, y, threshold, True) for x, y in zip(a, b)], columns=["forward", "backward"], dtype="float64")

    return F.pandas_udf(run, "forward double, backward double")


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def char_counts(s: pd.Series) -> pd.Series:
    """How many characters of a text fall in each of 32 classes; classes by code point, so close letters are told apart."""
    return s.map(lambda t: np.bincount(np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) % 32, minlength=32).astype(np.int32))


def count_bound(counts_a, counts_b, length_a, length_b):
    """Upper bound of the ratio from ``char_counts``: characters of a class match those of the same class at most."""
    shared = F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    return F.when(length_a + length_b == 0, F.lit(1.0)).otherwise(2.0 * shared / (length_a + length_b))


def ratio_bound(a, b):
    """Upper bound of the ratio from the lengths alone, so hopeless pairs skip the Python call."""
    la, lb = F.length(a), F.length(b)
    return F.when(la + lb == 0, F.lit(1.0)).otherwise(2.0 * F.least(la, lb) / (la + lb))
