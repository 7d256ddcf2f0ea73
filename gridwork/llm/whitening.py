"""Operator 11: embedding whitening, with the leading eigenvectors found by spectrum slicing.

Each component c becomes the whole number x = floor(SCALE * c). The covariance
is taken over the distinct x vectors (each once, divisor n), centred before it
is multiplied: one vector of sums and one matrix of products per task leave
the scan, and Spark adds them up. What reaches the driver is the covariance
matrix (dimensions x dimensions, checked against MAX_DIMENSIONS).

The leading eigenvalues are isolated there by counting: the number of positive
blocks of an LDL' factorisation of V - s I (Bunch-Kaufman pivots) is the number
of eigenvalues above s (Sylvester). Bisection ends when an interval holds the
k-th one alone - or, where several are equal, when it is as narrow as the
matrix' rounding. Rayleigh quotient iteration then converges cubically from the
interval; a quotient that leaves it is refused and the interval halved. In the
end the counts just below and above each value found certify its number.

Rows are whitened in a last pass over all of them, without a shuffle.

Defined results: vectors that are null, or hold a null or non-finite
component, take no part. Vectors of each length are a fit of their own
(at most MAX_LENGTHS). Components whose eigenvalue is not above
LEAST_SHARE of the trace carry nothing that could be scaled and are left out,
so fewer than the wanted components come if the vectors have a lower rank, and
none from one distinct vector or from vectors without components. Of equal
eigenvalues any orthonormal vectors serve; a vector's sign is such that its
largest entry (the first of equal ones) is positive. Repeated rows and
null ids are returned as they come; a deviation beyond a long is null. Empty
tables give an empty result. Other columns are dropped.
"""

from __future__ import annotations

import decimal
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import exact, fits_long, floored, largest, matrices

SCALE = 256
COMPONENTS = 4
#: The covariance matrix goes to the driver, one for each length of vectors.
MAX_DIMENSIONS, MAX_LENGTHS = 4096, 16
#: Eigenvalues up to this share of the trace count as none.
LEAST_SHARE = 1e-10
#: Rounding of an eigenvalue, as a share of the matrix' norm.
ROUNDING = 1e-13
#: Columns of the result.
SCHEMA = ("vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
          "identity_error double")


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """How many eigenvalues of a symmetric matrix are negative, zero and positive: the signs of the
    blocks of its LDL' factorisation with Bunch-Kaufman pivots."""
    a, at, size = matrix.astype(float), 0, len(matrix)
    negative = zero = 0
    bound = (1 + 17 ** 0.5) / 8
    while at < size:
        below = np.abs(a[at + 1:, at])
        most, own, block = below.max(initial=0.0), abs(a[at, at]), 1
        if own < bound * most:
            other = at + 1 + int(below.argmax())
            row = np.abs(a[other, at:])
            row[other - at] = 0
            if own * row.max() < bound * most ** 2:
                block = 1 if abs(a[other, other]) >= bound * row.max() else 2
                swap = [at + block - 1, other]
                a[swap] = a[swap[::-1]]
                a[:, swap] = a[:, swap[::-1]]
        if block == 1:
            pivot = a[at, at]
            negative, zero = negative + (pivot < 0), zero + (pivot == 0)
            if pivot:
                rest = a[at + 1:, at]
                a[at + 1:, at + 1:] -= np.outer(rest / pivot, rest)
        else:  # such a block has one eigenvalue of either sign
            negative += 1
            rest = a[at + 2:, at:at + 2]
            a[at + 2:, at + 2:] -= np.linalg.solve(a[at:at + 2, at:at + 2], rest.T).T @ rest.T
        at += block
    return negative, zero, size - negative - zero


def above(matrix: np.ndarray, shift: float) -> int:
    """How many eigenvalues are larger than ``shift``."""
    return inertia(matrix - shift * np.eye(len(matrix)))[2]


def _against(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    """The vector without its share in those found (twice, against rounding), at unit length."""
    for _ in range(2):
        for q in found:
            vector = vector - (q @ vector) * q
    return vector / max(np.linalg.norm(vector), 1e-300)


def _solved(matrix: np.ndarray, shift: float, vector: np.ndarray, norm: float) -> np.ndarray:
    """A solution of (matrix - shift I) y = vector; an exactly singular matrix is shifted by its rounding."""
    eye = np.eye(len(matrix))
    for nudge in (0.0, 1e-16, 1e-15, 1e-14):
        try:
            y = np.linalg.solve(matrix - (shift + nudge * norm) * eye, vector)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(y).all():
            return y
    return vector


def _iterated(matrix: np.ndarray, low: float, high: float, found: list[np.ndarray], norm: float) -> tuple[float, np.ndarray] | None:
    """Eigenvalue and vector by Rayleigh quotient iteration from the middle of an interval; None if the quotient leaves it."""
    vector = _against(np.random.default_rng(len(found)).standard_normal(len(matrix)), found)
    shift, best, slack = (low + high) / 2, None, ROUNDING * norm
    for step in range(60):
        vector = _against(_solved(matrix, shift, vector, norm), found)
        quotient = float(vector @ matrix @ vector)
        away = np.linalg.norm(_against_span(matrix @ vector - quotient * vector, found))
        if best is None or away < best[0]:
            best = (away, quotient, vector)
        elif step > 3 and best[0] <= 100 * slack:
            break  # no nearer: rounding is reached
        if step >= 2:  # the first steps keep the interval's middle
            shift = quotient
    away, quotient, vector = best
    inside = low - slack <= quotient <= high + slack
    return (quotient, vector) if inside and away <= 100 * slack else None


def _against_span(vector: np.ndarray, found: list[np.ndarray]) -> np.ndarray:
    for q in found:
        vector = vector - (q @ vector) * q
    return vector


def leading(matrix: np.ndarray, wanted: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues above ``least`` (at most ``wanted``, falling) and their unit vectors, as columns."""
    values: list[float] = []
    vectors: list[np.ndarray] = []
    norm = float(np.abs(matrix).sum(axis=1).max()) if matrix.size else 0.0
    counts = {norm * 1.01: 0, least: above(matrix, least) if norm else 0}
    slack = ROUNDING * norm * 100
    for k in range(1, min(wanted, counts[least]) + 1):
        while True:
            low = max(s for s, c in counts.items() if c >= k)
            high = min(s for s, c in counts.items() if c < k)
            alone = counts[low] == k and counts[high] == k - 1
            hit = _iterated(matrix, low, high, vectors, norm) if alone or high - low <= slack else None
            if hit or high - low <= ROUNDING * norm:
                break
            counts[(low + high) / 2] = above(matrix, (low + high) / 2)
        # the counts on either side certify the number
        if not hit or not above(matrix, hit[0] + slack) < k <= above(matrix, hit[0] - slack):
            raise ArithmeticError(f"eigenvalue {k} could not be certified")
        sign = np.sign(hit[1][np.abs(hit[1]).argmax()])
        values.append(hit[0])
        vectors.append(hit[1] * sign)
    return np.array(values), np.array(vectors).T.reshape(len(matrix), len(values))


@dataclass
class Fit:
    """What whitens the vectors of one length."""
    n: int
    sums: list[int]
    axes: np.ndarray      # dimensions x components, divided by the square root of the eigenvalue
    explained: np.ndarray
    error: float = 0.0

    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums], float)

    def whitened(self, matrix: np.ndarray) -> np.ndarray:
        return (matrix - self.mean()) @ self.axes

    def deviations(self, matrix: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row; None beyond a long."""
        most = self.n * largest(matrix) + max(map(abs, self.sums), default=0)
        apart = exact(matrix, most * most * max(len(self.sums), 1)) * self.n
        apart = apart - np.array(self.sums, apart.dtype)
        return [int(v) if fits_long(int(v)) else None for v in (apart * apart).sum(axis=1)]


def _per_task(products):
    """A mapInArrow function: the sum of what ``products(length, matrix)`` gives for each length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for size, _, matrix in matrices(batch.column("x")):
                if (own := products(size, matrix)) is not None:
                    sums[size] = sums[size] + own if size in sums else own
        for size, own in sums.items():
            for i, row in enumerate(own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([size], pa.int32()), pa.array([i], pa.int32()), pa.array([row.tolist()], pa.list_(pa.float64()))],
                    ["size", "i", "row"])
    return run


def _summed(fit_list: DataFrame, products) -> dict[int, np.ndarray]:
    """The sum over all rows of what ``products`` gives, by length."""
    parts = fit_list.mapInArrow(_per_task(products), "size int, i int, row array<double>")
    cells = (parts.select("size", "i", F.posexplode("row").alias("j", "v")).groupBy("size", "i", "j")
             .agg(F.sum("v").alias("v")).toPandas())
    found = {}
    for size, own in cells.groupby("size"):
        found[int(size)] = np.zeros((int(own["i"].max()) + 1, int(own["j"].max()) + 1))
        found[int(size)][own["i"], own["j"]] = own["v"]
    return found


def fit(vectors: DataFrame, components: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each length of vectors(x)."""
    distinct = stage(vectors.select("x").distinct())
    per_size = distinct.groupBy(F.size("x").alias("size")).agg(F.count("*").alias("n")).limit(MAX_LENGTHS + 1).collect()
    counts = {r["size"]: r["n"] for r in per_size}
    if len(counts) > MAX_LENGTHS or max(counts, default=0) > MAX_DIMENSIONS:
        raise ValueError(f"vectors of more than {MAX_LENGTHS} lengths, or longer than {MAX_DIMENSIONS}")
    # sums of longs don't fit a long in general
    totals = (distinct.select(F.size("x").alias("size"), F.posexplode("x").alias("d", "v"))
              .groupBy("size", "d").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s")).collect())
    sums = {size: [0] * size for size in counts}
    for r in totals:
        sums[r["size"]][r["d"]] = int(r["s"].to_integral_value(decimal.ROUND_HALF_EVEN))
    fits = {size: Fit(n, sums[size], np.zeros((size, 0)), np.zeros(0)) for size, n in counts.items()}
    spark = vectors.sparkSession
    sent = spark.sparkContext.broadcast({size: f.mean() for size, f in fits.items()})

    def products(size: int, matrix: np.ndarray) -> np.ndarray | None:
        centred = matrix - sent.value[size]
        return centred.T @ centred if size else None

    for size, product in _summed(distinct, products).items():
        own = fits[size]
        covariance = (product + product.T) / (2 * own.n)
        trace = float(np.trace(covariance))
        values, axes = leading(covariance, components, LEAST_SHARE * trace)
        own.axes, own.explained = axes / np.sqrt(values), values / trace if trace else values
    found = spark.sparkContext.broadcast(fits)

    def moments(size: int, matrix: np.ndarray) -> np.ndarray | None:
        """The products of the whitened values, and their sums as a last row."""
        own = found.value[size].whitened(matrix)
        return np.vstack([own.T @ own, own.sum(axis=0)]) if own.shape[1] else None

    for size, moment in _summed(distinct, moments).items():
        mean = moment[-1] / fits[size].n
        fits[size].error = float(np.abs(moment[:-1] / fits[size].n - np.outer(mean, mean) - np.eye(len(mean))).max())
    return fits


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of vectors(vec_id, embedding)."""
    rows = floored(vectors, SCALE, "vec_id")
    sent = vectors.sparkSession.sparkContext.broadcast(fit(rows, components))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, at, matrix in matrices(batch.column("x")):
                own, k = sent.value[size], len(sent.value[size].explained)
                ids = batch.column("vec_id").take(pa.array(np.repeat(at, k)))
                deviations = pa.array(own.deviations(matrix), pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k)))
                yield pa.RecordBatch.from_arrays([
                    ids.cast(pa.int64()), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, own.n, np.int64)), deviations,
                    pa.array(own.whitened(matrix).ravel()), pa.array(np.tile(own.explained, len(at))),
                    pa.array(np.full(len(at) * k, own.error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, SCHEMA)
