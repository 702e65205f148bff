"""Operator 11, whitening of embeddings by FEAST contour integration.

1. Entries become integers (``quantised``); sums over all vectors are exact. A second pass sums the products of what is
   centred already, which gives the covariance.
2. Inertia counts of shifted covariances (the signs of the pivots of V - shift) place the eigenvalues in intervals of
   a few each, with ends in gaps between eigenvalues.
3. Each interval is a task of its own: quadrature of complex shifted solves on a circle around the interval filters a random
   subspace to that of the interval's eigenvectors, Rayleigh-Ritz extracts them, and this repeats until as many pairs as the
   inertia count says are inside of the interval with a residual of rounding size. Fewer is an error, never a loss.
4. Vectors are projected and scaled; a last pass measures the covariance of the result.

The driver holds matrices of width x width numbers (``MOST_WIDTH``), whatever the number of vectors.

Defined results: vectors that are null, empty or hold null or non-finite entries are dropped, as are those whose width is not
the table's, which is the most frequent one (of several, the largest). Repeated rows and rows without an id count and are
returned like others. Beyond 2 ** 62, 64 times an entry counts as that. A deviation beyond 38 digits is null. Directions
without variance (an eigenvalue below ``NOTHING`` of the trace, among them all of a single vector) can't be scaled to variance
one and have no component. An empty table gives an empty result. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches
from .vectors import by_width, id_vector

SCALE, SHIFT, LIMIT = 64, 1_000_000, 2.0**62
COMPONENTS = 32
#: The covariance of so wide vectors takes 134 MB.
MOST_WIDTH = 4096
#: Eigenvalues of an interval, about; nodes of the quadrature on a half circle; rounds of filtering.
PER_INTERVAL, NODES, ROUNDS = 8, 8, 40
#: Share of the trace below which an eigenvalue is rounding; residual of a pair, as a share of the largest eigenvalue.
NOTHING, RESIDUAL = 1e-10, 1e-13
#: Relative width to which eigenvalues are placed; least share of a circle's radius that is free of eigenvalues on both sides.
NARROW, CLEAR = 1e-8, 0.08


@dataclass(frozen=True)
class Whitening:
    """n vectors with the exact sums; rows of ``components`` are unit eigenvectors by falling ``eigenvalues``."""

    n: int
    sums: tuple[int, ...]
    trace: float
    eigenvalues: np.ndarray
    components: np.ndarray
    identity_error: float | None = None

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.trace if len(self.eigenvalues) else self.eigenvalues


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(SCALE * vectors), -LIMIT, LIMIT).astype(np.int64) + SHIFT


def total(x: np.ndarray) -> list[int]:
    """Exact sums of the columns."""
    safe = not len(x) or int(np.abs(x).max()) * len(x) < 2**62
    return [int(v) for v in x.sum(axis=0, dtype=np.int64 if safe else object)]


def centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: of Python integers where 64 bits might not do."""
    safe = not len(x) or (int(np.abs(x).max()) + 1) * n < 2**61
    return x * n - np.array(sums, np.int64) if safe else x.astype(object) * n - np.array(sums, object)


def sum_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, n, sums) of the vectors of a task by their width."""
    found: dict[int, tuple[int, list[int]]] = {}
    for batch in batches:
        for width, places, vectors in by_width(batch.column(0)):
            n, sums = found.get(width, (0, [0] * width))
            found[width] = n + len(places), [a + b for a, b in zip(sums, total(quantised(vectors)), strict=True)]
    for width, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([n], pa.int64()), pa.array([list(map(Decimal, sums))], pa.list_(pa.decimal128(38, 0)))], ["width", "n", "sums"])


def product_rows(matrices: Iterable[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """(i, products of column i with each column) of all rows of a task."""
    products = np.zeros((width, width))
    for m in matrices:
        products += m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(list(products), pa.list_(pa.float64()))], ["i", "products"])


def summed(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of all tasks' (i, products) as a matrix."""
    cells = rows.select("i", F.posexplode("products").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((width, width))
    for r in cells.toLocalIterator():
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def positive(a: np.ndarray) -> int:
    """The number of positive eigenvalues: the inertia of a leading block and of its Schur complement add up."""
    n = len(a)
    if n == 1:
        if abs(a[0, 0]) == 0:
            raise np.linalg.LinAlgError("singular pivot")
        return int(a[0, 0] > 0)
    h = n // 2
    return positive(a[:h, :h]) + positive(a[h:, h:] - a[h:, :h] @ np.linalg.solve(a[:h, :h], a[:h, h:]))


def above(v: np.ndarray, shift: float) -> int:
    """The number of eigenvalues above ``shift``, which moves by rounding size if it meets one of a block."""
    while True:
        try:
            return positive(v - shift * np.eye(len(v)))
        except np.linalg.LinAlgError:
            shift += 1e-14 * max(abs(shift), np.abs(v).max())


class Spectrum:
    """Where the eigenvalues of ``v`` lie between ``low`` and ``high``, by inertia counts that are kept."""

    def __init__(self, v: np.ndarray, low: float, high: float) -> None:
        self.v, self.low = v, low
        self.counts = {low: above(v, low), high: 0}
        self.rank = self.counts[low]
        self.places: dict[int, tuple[float, float]] = {}

    def place(self, k: int) -> tuple[float, float]:
        """A narrow interval that holds the k-th largest eigenvalue (from 1)."""
        if k > self.rank:
            return 0.0, self.low
        if k not in self.places:
            low = max(s for s, c in self.counts.items() if c >= k)
            high = min(s for s, c in self.counts.items() if c < k)
            while high > low * (1 + NARROW):
                mid = float(np.sqrt(low * high))
                self.counts[mid] = above(self.v, mid)
                low, high = (mid, high) if self.counts[mid] >= k else (low, mid)
            self.places[k] = low, high
        return self.places[k]

    def gap(self, k: int) -> float:
        """The distance of the k-th and the next eigenvalue, 0 if the difference is lost in the search."""
        near = self.place(k)[0] - self.place(k + 1)[1]
        return near if near > 10 * NARROW * self.place(k)[1] else 0.0

    def around(self, first: int, last: int) -> list[tuple[float, float, int]]:
        """Circles (low, high, eigenvalues inside) around the eigenvalues first to last. Where what is outside comes close to a
        wide circle, it is cut at its largest gap."""
        high, low = self.place(first)[1], self.place(last)[0]
        margin = min(self.gap(last) or low / 4, self.gap(first - 1) if first > 1 else high) / 2
        cuts = [k for k in range(first, last) if self.gap(k)]
        if cuts and margin < CLEAR * ((high - low) / 2 + margin):
            k = max(cuts, key=self.gap)
            return [*self.around(first, k), *self.around(k + 1, last)]
        if above(self.v, low - margin) - above(self.v, high + margin) != last - first + 1:
            raise ArithmeticError(f"the inertia of the shifted covariance does not count {last - first + 1} eigenvalues between {low - margin} and {high + margin}")
        return [(low - margin, high + margin, last - first + 1)]


def intervals(v: np.ndarray, wanted: int) -> list[tuple[float, float, int]]:
    """Circles (low, high, eigenvalues inside) around the ``wanted`` largest eigenvalues and, where no gap follows, more.
    Eigenvalues that are rounding are left out."""
    trace = float(np.trace(v))
    if not trace > 0:
        return []
    spectrum, out, last = Spectrum(v, NOTHING * trace, float(np.abs(v).sum(axis=1).max()) * (1 + 1e-9)), [], 0
    wanted = min(wanted, spectrum.rank)
    while last < wanted:
        first, k = last + 1, min(last + PER_INTERVAL, wanted)
        last = max((x for x in range(max(first, k - 2), min(k + 2, wanted) + 1)), key=spectrum.gap) if k < wanted else k
        while last < spectrum.rank and not spectrum.gap(last):  # equal ones stay together
            last += 1
        out += spectrum.around(first, last)
    return out


def feast(v: np.ndarray, low: float, high: float, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``number`` eigenvalues between low and high, falling, and their vectors as rows."""
    d = len(v)
    size = min(d, max(number + 8, -(-3 * number // 2)))
    nodes, weights = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * (np.pi / 2) * (1 - nodes))
    middle, radius = (low + high) / 2, (high - low) / 2
    basis = np.random.default_rng([d, number]).standard_normal((d, size))
    scale = np.abs(v).sum(axis=1).max()
    for _ in range(ROUNDS):
        filtered = np.zeros((d, size))
        for z, w in zip(turn, weights, strict=True):
            filtered += w / 2 * (radius * z * np.linalg.solve((middle + radius * z) * np.eye(d) - v, basis)).real
        q = np.linalg.qr(filtered)[0]
        ritz, inner = np.linalg.eigh(q.T @ v @ q)
        basis = q @ inner
        residual = np.linalg.norm(v @ basis - basis * ritz, axis=0)
        found = np.flatnonzero((ritz > low) & (ritz < high) & (residual <= RESIDUAL * scale))
        if len(found) == number:
            return ritz[found][::-1], basis[:, found].T[::-1]
    raise ArithmeticError(f"{len(found)} of {number} eigenvalues between {low} and {high} were found")


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of all vectors of (vec_id, embedding)."""
    spark = rows.sparkSession
    small_batches(spark)
    vectors = id_vector(rows).select("embedding")
    sums = vectors.mapInArrow(sum_rows, "width int, n long, sums array<decimal(38,0)>")
    place = F.posexplode("sums").alias("place", "sum")
    of_width = sums.groupBy("width").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("width")).first()
    if of_width is None:
        return Whitening(0, (), 0.0, np.zeros(0), np.zeros((0, 0)))
    width, n = of_width["width"], of_width["n"]
    if width > MOST_WIDTH:
        raise ValueError(f"vectors of {width} entries; the covariance is held whole for at most {MOST_WIDTH}")
    by_place = sums.where(F.col("width") == width).select(place).groupBy("place").agg(F.sum("sum").alias("sum")).collect()
    of_all = tuple(int(r["sum"]) for r in sorted(by_place, key=lambda r: r["place"]))
    model = Whitening(n, of_all, 0.0, np.zeros(0), np.zeros((0, width)))

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from product_rows((y.astype(np.float64) / n for b in batches for _, y in deviations(b.column(0), model)), width)

    v = summed(vectors.mapInArrow(products, "i int, products array<double>"), width) / n
    cut = intervals(v, min(components, width))

    def pairs(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low, high, number in zip(f["low"], f["high"], f["number"], strict=True):
                values, found = feast(v, low, high, number)
                yield pd.DataFrame({"value": values, "vector": list(found)})

    if not cut:
        return replace(model, trace=float(np.trace(v)))
    tasks = spark.createDataFrame(cut, "low double, high double, number int").repartition(len(cut), "low")
    found = sorted(tasks.mapInPandas(pairs, "value double, vector array<double>").collect(), key=lambda r: -r["value"])
    if len(found) != sum(c for _, _, c in cut):
        raise ArithmeticError("eigenvalues are missing")
    found = found[:components]
    vectors_of = np.array([r["vector"] for r in found])
    signs = np.sign(vectors_of[np.arange(len(found)), np.abs(vectors_of).argmax(axis=1)])
    model = replace(model, trace=float(np.trace(v)), eigenvalues=np.array([r["value"] for r in found]), components=vectors_of * signs[:, None])
    return replace(model, identity_error=identity_error(vectors, model))


def deviations(column: pa.Array, model: Whitening) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, n * x - sums) of the vectors of the model's width."""
    for width, places, vectors in by_width(column):
        if width == len(model.sums):
            yield places, centred(quantised(vectors), model.n, model.sums)


def projected(y: np.ndarray, model: Whitening) -> np.ndarray:
    return (y.astype(np.float64) / model.n) @ model.components.T / np.sqrt(model.eigenvalues)


def identity_error(vectors: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of all whitened vectors minus the identity."""
    k = len(model.eigenvalues)

    def products(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with_one = (np.hstack([projected(y, model), np.ones((len(y), 1))]) for b in batches for _, y in deviations(b.column(0), model))
        yield from product_rows(with_one, k + 1)

    m = summed(vectors.mapInArrow(products, "i int, products array<double>"), k + 1) / model.n
    mean = m[:k, k]  # of rounding size, as the vectors are centred
    return float(np.abs(m[:k, :k] - np.outer(mean, mean) - np.eye(k)).max())


def squares(y: np.ndarray) -> list[Decimal | None]:
    """Exact sums of squares of the rows; null beyond 38 digits."""
    if y.dtype != object and (not len(y) or int(np.abs(y).max()) ** 2 * y.shape[1] < 2**62):
        return [Decimal(v) for v in (y * y).sum(axis=1).tolist()]
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return [Decimal(v) if v < 10**38 else None for v in exact]


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation decimal(38,0), whitened array<double> (by component), one row per vector of the fitted width."""

    def scores(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for places, y in deviations(b.column(1), model):
                columns = [b.column(0).take(pa.array(places)), pa.array(squares(y), pa.decimal128(38, 0)), pa.array(list(projected(y, model)), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "deviation", "whitened"])

    return id_vector(rows).mapInArrow(scores, "vec_id long, deviation decimal(38,0), whitened array<double>")
