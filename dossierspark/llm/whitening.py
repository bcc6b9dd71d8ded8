"""Embedding whitening by spectrum slicing.

Every vector entry c becomes the integer floor(256 c). The fit list is each distinct integer vector once; its size n, its sums S per
dimension and its covariance V (centred before multiplying, divisor n) are summed by Spark. V has the size of a vector squared,
whatever the number of rows, so its leading eigenvectors are found on the driver:

1. *Inertia.* V - s I = L D L' with Bunch-Parlett pivots. By Sylvester's law D has as many positive pivots as V has eigenvalues above s.
2. *Slices.* Bisection by these counts narrows a bracket until it holds the k-th largest eigenvalue alone, or is as narrow as rounding.
3. *Rayleigh quotient iteration* inside the bracket converges cubically; it is kept orthogonal to the components before it.
4. *Certificate.* Counts just below and above the found value must say that it is number k; otherwise the bracket is narrowed further.

Eigenvalues that rounding cannot tell apart share a bracket; any orthonormal basis of their space is right, and the iteration gives one.
Eigenvalues of no more than rounding over zero have no component, since nothing can be divided by their root.

Defined results: rows whose vector is null or holds null or non-finite entries go, as do empty vectors and those of a length other than the
most frequent one (the smaller at a tie); entries beyond 2^63 / 256 count as the largest integers. Repeated rows give equal rows each;
other columns pass through, but columns named like a new one are replaced. ``deviation`` is null where it does not fit a long. Fewer
dimensions or components of V than asked for give fewer rows; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossierspark.llm.rows import quoted, with_columns
from dossierspark.session import durable

EPS = float(np.finfo(float).eps)
PIVOT = (1 + 17 ** 0.5) / 8
OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


@dataclass
class Whitener:
    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([float(Fraction(s, self.n)) for s in self.sums])


def inertia(a: np.ndarray) -> tuple[int, int]:
    """(positive, zero) eigenvalues of a symmetric matrix, from the pivots of its L D L' factors."""
    a = np.array(a, float)
    positive = 0
    while len(a):
        diagonal = np.abs(np.diag(a))
        off = np.abs(np.triu(a, 1))
        p = int(diagonal.argmax())
        r, s = divmod(int(off.argmax()), len(a))
        if max(diagonal[p], off[r, s]) == 0:
            return positive, len(a)
        if diagonal[p] >= PIVOT * off[r, s]:
            taken = [p]
            positive += a[p, p] > 0
        else:  # a pivot of two rows with a negative determinant: one eigenvalue of either sign
            taken = [r, s]
            positive += 1
        rest = np.setdiff1d(np.arange(len(a)), taken)
        low = a[np.ix_(rest, taken)]
        a = a[np.ix_(rest, rest)] - low @ np.linalg.solve(a[np.ix_(taken, taken)], low.T)
        a = (a + a.T) / 2
    return int(positive), 0


def above(v: np.ndarray, shift: float) -> int:
    """Eigenvalues of ``v`` larger than ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[0]


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding, falling, and their unit eigenvectors as columns."""
    d = len(v)
    scale = float(np.abs(v).sum(1).max(initial=0.0))
    fine = 4 * d * EPS * scale
    values, vectors = np.empty(0), np.empty((d, 0))
    for k in range(1, min(most, d) + 1):
        if scale == 0 or above(v, fine) < k:
            break
        value, vector = _slice(v, k, fine, scale, values, vectors)
        values, vectors = np.append(values, value), np.column_stack([vectors, vector])
    return values, vectors


def _slice(v: np.ndarray, k: int, fine: float, scale: float, values: np.ndarray, vectors: np.ndarray) -> tuple[float, np.ndarray]:
    low, high = fine, scale * (1 + 8 * EPS) + fine  # count(low) >= k > count(high)
    n_low, n_high = above(v, low), 0
    if len(values):
        high = min(high, float(values[-1]) + fine)
        n_high = above(v, high)
    while True:
        while not (n_low == k and n_high == k - 1) and high - low > fine:
            middle = (low + high) / 2
            count = above(v, middle)
            if count >= k:
                low, n_low = middle, count
            else:
                high, n_high = middle, count
        value, vector = _iterate(v, (low + high) / 2, vectors, fine)
        certain = above(v, value - fine) >= k > above(v, value + fine)
        if certain and low - fine <= value <= high + fine:
            return value, vector
        if high - low <= fine:
            raise ArithmeticError(f"eigenvalue {k} is not certified")
        middle = (low + high) / 2
        if (count := above(v, middle)) >= k:
            low, n_low = middle, count
        else:
            high, n_high = middle, count


def _iterate(v: np.ndarray, shift: float, before: np.ndarray, fine: float, rounds: int = 60) -> tuple[float, np.ndarray]:
    """Rayleigh quotient iteration from ``shift``, orthogonal to the columns of ``before``; the largest entry of the vector is positive."""
    d = len(v)
    apart = lambda x: x - before @ (before.T @ x)
    x = apart(apart(np.cos(1.0 + np.arange(d) * 0.7)))
    x /= np.linalg.norm(x)
    value, best = shift, (np.inf, shift, x)
    for _ in range(rounds):
        try:
            y = np.linalg.solve(v - value * np.eye(d), x)
        except np.linalg.LinAlgError:
            y = np.linalg.solve(v - (value + fine) * np.eye(d), x)
        y = apart(apart(y / np.linalg.norm(y)))
        x = y / np.linalg.norm(y)
        after = float(x @ v @ x)
        residual = float(np.linalg.norm(apart(v @ x) - after * x))
        if residual < best[0]:
            best = residual, after, x
        elif best[0] <= fine:
            break
        value = after
    _, value, x = best
    return value, x * np.sign(x[np.abs(x).argmax()])


def _integers(column: pa.Array, size: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, size)


def _clean(df: DataFrame, vec: str) -> DataFrame:
    """Rows with a usable vector, and its integers as ``_x``."""
    entry = lambda c: c.cast("double")
    bad = lambda c: c.isNull() | F.isnan(entry(c)) | (F.abs(entry(c)) == float("inf"))
    return df.filter(quoted(vec).isNotNull() & (F.size(quoted(vec)) > 0) & ~F.exists(quoted(vec), bad)).withColumn(
        "_x", F.transform(quoted(vec), lambda c: F.floor(entry(c) * 256)))


def _partial(x: DataFrame, size: int, schema: str, of) -> DataFrame:
    """What each task sums over its vectors, as rows of numpy columns from ``of(list of integer blocks)``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches):
        columns = of(_integers(b.column(0), size) for b in batches if b.num_rows)
        if columns:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    return x.select("_x").mapInArrow(run, schema)


def fit(df: DataFrame, vec: str = "embedding", components: int = 4) -> Whitener | None:
    """The whitening of the distinct integer vectors; None without any."""
    clean = _clean(df, vec)
    sizes = clean.groupBy(F.size("_x").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if sizes is None:
        return None
    size = sizes["size"]
    fit_list = durable(clean.filter(F.size("_x") == size).select("_x").distinct())

    def sums(blocks):
        """Sums of the high and the low 32 bits, so that no task overflows; dimension -1 counts rows."""
        high, low, rows = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        for x in blocks:
            high, low, rows = high + (x >> 32).sum(0), low + (x & 0xFFFFFFFF).sum(0), rows + len(x)
        return [np.arange(-1, size), np.append(rows, high), np.append(0, low)]

    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)")).alias(c)
    rows = _partial(fit_list, size, "dim long, high long, low long", sums).groupBy("dim").agg(wide("high"), wide("low")).collect()
    total = {r["dim"]: (int(r["high"]) << 32) + int(r["low"]) if r["dim"] >= 0 else int(r["high"]) for r in rows}
    model = Whitener(total[-1], [total[i] for i in range(size)], np.empty((size, 0)), np.empty(0), 0.0)
    mean = model.mean

    def products(blocks):
        v = np.zeros((size, size))
        for x in blocks:
            c = x - mean
            v += c.T @ c
        at = np.triu_indices(size)
        return [at[0].astype(np.int64), at[1].astype(np.int64), v[at]]

    upper = _partial(fit_list, size, "i long, j long, v double", products).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    v = np.zeros((size, size))
    for r in upper:
        v[r["i"], r["j"]] = v[r["j"], r["i"]] = r["v"] / model.n
    model.trace = float(np.trace(v))
    model.values, model.vectors = leading(v, components)
    model.identity_error = _identity_error(fit_list, model, size)
    return model


def _identity_error(fit_list: DataFrame, model: Whitener, size: int) -> float:
    """Largest entry of the covariance of the whitened fit list minus the identity, from the whitened values themselves."""
    k = len(model.values)
    if not k:
        return 0.0
    mean, root, vectors = model.mean, np.sqrt(model.values), model.vectors

    def run(batches):
        for b in batches:
            w = (_integers(b.column(0), size) - mean) @ vectors / root
            yield pa.RecordBatch.from_arrays([pa.array(w[:, i]) for i in range(k)], names=[f"w{i}" for i in range(k)])

    w = fit_list.select("_x").mapInArrow(run, ", ".join(f"w{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    # Spark merges centred partial products, so these are centred before multiplying as well.
    row = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exact; None beyond a long."""
    rough = ((float(n) * x - np.array(sums, float)) ** 2).sum(1)
    fits = (rough < 2.0 ** 62) & (np.abs(x).max(1, initial=0) < 2 ** 31) & (max(map(abs, sums), default=0) < 2 ** 62) & (n < 2 ** 31)
    small = np.where(fits[:, None], x, 0)
    with np.errstate(over="ignore"):
        out = ((small * n - np.array([s if abs(s) < 2 ** 62 else 0 for s in sums], np.int64)) ** 2).sum(1).tolist()
    for i in np.flatnonzero(~fits):
        exact = sum((n * int(a) - s) ** 2 for a, s in zip(x[i], sums))
        out[i] = exact if exact < 2 ** 63 else None
    return out


def whiten(df: DataFrame, model: Whitener | None, vec: str = "embedding", drop: tuple[str, ...] = ()) -> DataFrame:
    """A row of ``df`` and component each, with n, deviation, whitened, explained and identity_error."""
    model = model or Whitener(0, [], np.empty((0, 0)), np.empty(0), 0.0)
    size, k = len(model.sums), len(model.values)
    clean = _clean(df, vec).filter(F.size("_x") == size)

    def make():
        mean, root, vectors = model.mean, np.sqrt(model.values), model.vectors

        def fn(column):
            x = _integers(column, size)
            w = (x - mean) @ vectors / root
            offsets = pa.array(np.arange(0, (len(x) + 1) * k, k, dtype=np.int32)) if k else pa.array(np.zeros(len(x) + 1, np.int32))
            return [pa.array(deviations(x, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))]
        return fn

    keep = [c for c in df.columns if c.casefold() not in {f.split()[0] for f in OUT.split(", ")}]
    rows = with_columns(clean.select(*[quoted(c) for c in keep], "_x"), ["_x"], "_deviation long, _whitened array<double>", make, ("_x", *drop))
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]) if k else F.array().cast("array<double>")
    kept = [quoted(c) for c in rows.columns if c not in ("_deviation", "_whitened")]
    out = rows.select(*kept, "_deviation", F.posexplode("_whitened").alias("_at", "_value"))
    return out.select(*kept, (F.col("_at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("_deviation").alias("deviation"),
                      F.col("_value").alias("whitened"), F.get(shares, F.col("_at")).alias("explained"),
                      F.lit(model.identity_error).alias("identity_error"))
