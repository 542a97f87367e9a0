"""Whitening of embeddings by spectrum slicing.

Vectors become whole numbers, so sums and the Gram matrix of the distinct
vectors are exact in any order of tasks. Entries are centred before they are
multiplied: by the floor of the mean in the tasks, by its fraction on the
result. Spark does the passes over the vectors; only the d x d covariance
reaches the driver.

There the spectrum is sliced. The number of negative pivots of LDL^T of the
covariance less s times the identity is the number of eigenvalues below s, so
bisection on such counts isolates the leading eigenvalues. From an isolating
interval, Rayleigh quotient iteration converges cubically. A component's number
is certified by the counts just above and below its eigenvalue; if an iteration
leaves its interval, the interval is halved and it starts anew. Eigenvalues that
counts can't part are a cluster: any orthonormal basis of their space serves,
and each of its vectors is kept orthogonal to those found before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored

SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this, times SCALE, count as not finite: whole numbers and their sums of squares stay exact.
LARGEST = 1 << 45
#: Vectors that a step of a task works on.
STEP = 4096


@dataclass
class Whitening:
    """What all rows share. ``vectors`` has a component in each column, ``values`` falls."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / max(self.n, 1) for s in self.sums])


def whole_numbers(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``vec_id, x``: rows with a usable vector, as long ``floor(SCALE * c) + SHIFT``.

    Vectors that are null, empty or hold a null, non-finite or far too large
    entry are left out, and so are those of another length than most vectors
    have (of two lengths as frequent, the longer one counts). Repeated rows stay.
    """
    usable = lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < LARGEST)  # noqa: E731  false for nan and infinity
    rows = embeddings.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(vector).alias("v"))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0)).where(F.forall("v", lambda c: F.coalesce(usable(c), F.lit(False))))
    lengths = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    rows = rows.where(F.size("v") == (most["size"] if most else 0))
    entry = lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT
    return rows.select("vec_id", F.transform("v", entry).alias("x"))


def fit(numbers: DataFrame, components: int = 16) -> Whitening:
    """Components of the distinct vectors of ``numbers`` (as from ``whole_numbers``).

    Fewer come back if fewer eigenvalues are above rounding (a constant or linearly
    dependent entry, few distinct vectors); none for an empty table.
    """
    distinct = stored(numbers.select("x").distinct(), "distinct")
    parts = distinct.mapInArrow(_sums, "i int, n bigint, s string")
    told = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not told:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    n, sums = told[0]["n"], [int(r["s"]) for r in told]
    base = np.array([s // n for s in sums], np.int64)
    gram = _gram(distinct, lambda x: x - base, len(sums))
    rest = np.array([(s - int(b) * n) / n for s, b in zip(sums, base, strict=True)])
    covariance = gram / n - np.outer(rest, rest)
    trace = float(np.trace(covariance))
    values, vectors = leading(covariance, components)
    found = Whitening(n, sums, vectors, values, trace)
    if len(values):
        white = _whitener(found)
        cov = _gram(distinct, white, len(values), exact=False) / n
        found.identity_error = float(np.abs(cov - np.eye(len(values))).max())
    return found


def _whitener(model: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    base = np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([(s - int(b) * model.n) / model.n for s, b in zip(model.sums, base, strict=True)])
    into = model.vectors / np.sqrt(model.values)
    return lambda x: (x - base - rest) @ into


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sum of each entry over one task's vectors."""
    n, total = 0, None
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
        for k in range(0, len(x), STEP):
            step = x[k : k + STEP].sum(axis=0).astype(object)
            total = step if total is None else total + step
        n += len(x)
    if total is not None:
        made = [pa.array(range(len(total)), pa.int32()), pa.array([n] * len(total), pa.int64()), pa.array([str(v) for v in total], pa.string())]
        yield pa.record_batch(made, ["i", "n", "s"])


def _gram(distinct: DataFrame, centred: Callable[[np.ndarray], np.ndarray], size: int, exact: bool = True) -> np.ndarray:
    """Sum of ``y y^T`` over ``y = centred(x)``. Whole numbers are summed without rounding.

    Each task sends one number for each pair of entries, and Spark adds them up; the driver gets d x d numbers.
    """
    kind = "decimal(38,0)" if exact else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size), object if exact else np.float64)
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)
            for k in range(0, len(x), STEP):
                y = centred(x[k : k + STEP])
                if exact and float(np.abs(y).max(initial=0)) ** 2 * STEP >= 2**53:
                    total += y.astype(object).T @ y.astype(object)
                elif exact:
                    total += (y.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64).astype(object)
                else:
                    total += y.T @ y
        i, j = np.triu_indices(size)
        values = total[i, j]
        if not exact:
            made = pa.array(values, pa.float64())
        else:
            made = pa.array([str(v) for v in values], pa.string())
        yield pa.record_batch([pa.array(i, pa.int32()), pa.array(j, pa.int32()), made], ["i", "j", "v"])

    parts = distinct.mapInArrow(run, f"i int, j int, v {'string' if exact else 'double'}")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast(kind)).alias("v"))
    out = np.zeros((size, size))
    for r in total.collect():
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = float(r["v"])
    return out


def below(matrix: np.ndarray, shift: float) -> int:
    """Number of eigenvalues under ``shift``: the negative pivots of LDL^T of ``matrix - shift * I``.

    Symmetric pivoting with blocks of one or two rows keeps the factors bounded. A
    pivot that is zero to working precision counts as positive.
    """
    a = matrix - shift * np.eye(len(matrix))
    tiny = np.finfo(float).eps * max(np.abs(a).max(initial=0.0), np.finfo(float).tiny)
    alpha, negative = (1 + np.sqrt(17)) / 8, 0
    while len(a):
        size = np.abs(a)
        diagonal = size.diagonal()
        p = int(diagonal.argmax())
        r, s = divmod(int(size.argmax()), len(a))
        if diagonal[p] >= alpha * size[r, s]:
            pivot, rows = a[p, p], [p]
            if abs(pivot) <= tiny:
                break
            negative += pivot < 0
            middle = np.array([[1 / pivot]])
        else:
            rows = [r, s]
            block = a[np.ix_(rows, rows)]
            negative += 1  # the block is indefinite: one eigenvalue of either sign
            middle = np.linalg.inv(block)
        rest = np.delete(np.arange(len(a)), rows)
        side = a[np.ix_(rest, rows)]
        a = a[np.ix_(rest, rest)] - side @ middle @ side.T
        a = (a + a.T) / 2
    return negative


def leading(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues above rounding, falling, and their unit vectors as columns."""
    d = len(matrix)
    radius = np.abs(matrix).sum(axis=1).max(initial=0.0)
    if not d or not radius or not np.isfinite(radius):
        return np.zeros(0), np.zeros((d, 0))
    noise = d * np.finfo(float).eps * radius
    counts: dict[float, int] = {}

    def above(shift: float) -> int:
        """How many eigenvalues are at least ``shift``."""
        if shift not in counts:
            counts[shift] = d - below(matrix, shift)
        return counts[shift]

    ceiling, floor = radius + noise, noise
    wanted = min(most, above(floor))
    values: list[float] = []
    vectors = np.zeros((d, 0))
    start = np.random.default_rng(1).standard_normal(d)
    while len(values) < wanted:
        k = len(values) + 1
        # isolate the k-th: lo has k at least above it, hi fewer
        lo = max((s for s, c in counts.items() if c >= k), default=floor)
        hi = min((s for s, c in counts.items() if c < k and s > lo), default=ceiling)
        found = None
        while found is None:
            alone = above(lo) == k and (hi == ceiling and k == 1 or above(hi) == k - 1)
            if alone or hi - lo <= 4 * noise:
                found = _iterate(matrix, lo, hi, vectors, start, noise)
            if found is None:
                mid = (lo + hi) / 2
                if not lo < mid < hi:
                    found = _iterate(matrix, lo, hi, vectors, start, noise, last=True)
                elif above(mid) >= k:
                    lo = mid
                else:
                    hi = mid
        value, vector = found
        values.append(value)
        vectors = np.column_stack([vectors, vector])
    order = np.argsort(-np.array(values), kind="stable")
    for k, value in enumerate(np.array(values)[order], 1):
        if above(value + 4 * noise) >= k or above(value - 4 * noise) < k:
            raise ArithmeticError(f"component {k} is not eigenvalue {k}: {value}")
    return np.array(values)[order], vectors[:, order]


def _iterate(
    matrix: np.ndarray, lo: float, hi: float, known: np.ndarray, start: np.ndarray, noise: float, last: bool = False
) -> tuple[float, np.ndarray] | None:
    """Rayleigh quotient iteration from the middle of ``lo, hi``; None if it leaves the interval.

    Two steps of inverse iteration turn the start towards the interval first. All steps stay
    orthogonal to the vectors known so far, so an iteration can't find one of them again.
    """
    eye = np.eye(len(matrix))

    def solved(shift: float, v: np.ndarray) -> np.ndarray:
        try:
            out = np.linalg.solve(matrix - shift * eye, v)
        except np.linalg.LinAlgError:
            out = np.linalg.solve(matrix - (shift + noise) * eye, v)
        for _ in range(2):
            out = out - known @ (known.T @ out)
        return out / np.linalg.norm(out)

    v = start - known @ (known.T @ start)
    for _ in range(2):
        v = solved((lo + hi) / 2, v)
    best = None
    for _ in range(12):
        value = float(v @ matrix @ v)
        error = float(np.linalg.norm(matrix @ v - value * v))
        if not last and not lo - 2 * noise <= value <= hi + 2 * noise:
            return None
        if best is None or error < best[0]:
            best = (error, value, v)
        elif error <= 4 * noise:
            break
        if error <= noise / 8:
            break
        v = solved(value, v)
    return best[1:] if last or best[0] <= 16 * noise else None


def whiten(numbers: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error`` for every row of ``numbers`` and component.

    ``deviation`` is the exact sum over the entries of ``(n * x - sum)^2``, null where it
    is beyond a long. A model without components gives no rows.
    """
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    k = len(model.values)
    if not k:
        return numbers.sparkSession.createDataFrame([], schema)
    white, shares = _whitener(model), model.values / model.trace
    size, n, sums, error = len(model.sums), model.n, model.sums, model.identity_error

    def deviations(x: np.ndarray) -> list[int | None]:
        rough = float(np.abs(n * x.astype(float) - np.array(sums, float)).max(initial=0)) + 1
        if rough < 2**31 and size * rough * rough < 2**62 and max(map(abs, sums)) < 2**62:
            away = n * x - np.array(sums, np.int64)
            return (away * away).sum(axis=1).tolist()
        exact = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
        return [v if v < 2**63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = batch.column("x").flatten().to_numpy().reshape(-1, size)
            for at in range(0, len(whole), STEP):
                x = whole[at : at + STEP]
                m = len(x)
                ids = batch.column("vec_id").slice(at, m).take(pa.array(np.repeat(np.arange(m), k)))
                away = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                yield pa.record_batch(
                    [
                        ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), away,
                        pa.array(white(x).ravel()), pa.array(np.tile(shares, m)), pa.array(np.full(m * k, error)),
                    ],
                    columns,
                )

    return numbers.mapInArrow(run, schema)
