"""Whitening of vectors from a compensated covariance.

Three passes over the vectors, none of which shuffles a row: sums, centred outer
products, and the result. All sums are double-double, a high and a low part:

* Sums. Two-sum (an error-free transformation) adds halves of a block pairwise.
* Outer products. A centred block is split, column by column, into slices of so
  few bits that a matrix product of two slices is exact; the slices' products
  are added by two-sum (Ozaki, Ogita, Oishi and Rump, 2012). The mean is a high
  and a low part too, and what centring rounds off is a slice of its own.
* Tasks put out a row for each band of the matrix; high and low parts are merged
  in a tree, `FAN` tasks at a time, each in the order of the tasks.

The driver gets one matrix, as large as the square of the vectors' length, and
solves it by reduction to tridiagonal form and divide and conquer (LAPACK's
symmetric driver of that name, through numpy). Components are numbered from 1 by
falling eigenvalue; the entry of greatest size is positive.

Rows whose vector is null or holds null or non-finite entries are left out. A
vector shorter than the longest is filled up with `fill`. Null ids are kept;
repeated rows count each. Eigenvalues not above the rounding error of the
greatest are components without variance: their `whitened` is null and they are
no part of the identity error, as is everything where a single vector or equal
ones are given. Ties of eigenvalues fall as the solver puts them. Extra columns
are ignored; an empty table, or one of empty vectors, gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block; tasks merged at a time; rows of the matrix in a band.
BLOCK, FAN, BAND = 1024, 32, 64
_PART = "band int, part long, n long, data binary"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum, its rounding error), exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-double arrays."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def column_sums(x: np.ndarray, low: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums of a block's columns, halves added pairwise."""
    part = (x, np.zeros_like(x) if low is None else low)
    while len(part[0]) > 1:
        half = len(part[0]) // 2
        rest = tuple(p[2 * half :] for p in part)
        part = add(tuple(p[:half] for p in part), tuple(p[half : 2 * half] for p in part))
        if len(rest[0]):
            part = tuple(np.concatenate([p, r]) for p, r in zip(part, rest, strict=True))
    return (part[0][0], part[1][0]) if len(part[0]) else (np.zeros(x.shape[1]), np.zeros(x.shape[1]))


def slices(x: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Parts of x + low whose sum it is, to 2**-80 or so of a column's greatest entry, each with few enough bits that products of two of a block are exact."""
    bits = (53 - math.ceil(math.log2(max(len(x), 2)))) // 2
    out, rest = [], x
    for k in range(4):
        top = np.abs(rest).max(axis=0)
        if not top.any():
            break
        unit = np.where(top > 0, 2.0 ** (np.ceil(np.log2(np.where(top > 0, top, 1))) + 53 - bits), 0.0)
        part = (rest + unit) - unit
        out.append(part)
        rest = rest - part
        if k == 1:  # the rounding errors of centring are below here
            rest = rest + low
    return out


def outer_products(x: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sum over rows of the outer products of x + low with itself."""
    parts = slices(x, low)
    total = (np.zeros((x.shape[1],) * 2),) * 2
    for i in reversed(range(len(parts))):  # small ones first
        for j in reversed(range(len(parts))):
            total = add(total, (parts[i].T @ parts[j], np.zeros_like(total[0])))
    return total


def matrix_of(column: pa.Array, dims: int, fill: float) -> tuple[np.ndarray, np.ndarray]:
    """(the vectors without null or non-finite entries as rows, which rows these are)."""
    lists = column.cast(pa.large_list(pa.float64()))
    values = lists.flatten()
    length = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    good = ~(pc.is_null(values).to_numpy(zero_copy_only=False)) & np.isfinite(pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(length)), length)
    kept = lists.is_valid().to_numpy(zero_copy_only=False) & (np.bincount(row[~good], minlength=len(length)) == 0)
    out = np.full((len(length), dims), fill)
    place = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    inner = place < dims  # only rows that are left out are longer
    out[row[inner], place[inner]] = pc.fill_null(values, 0.0).to_numpy(zero_copy_only=False)[inner]
    return out[kept], np.flatnonzero(kept)


@dataclass
class Moments:
    """Number of vectors, and sums and summed products, high and low parts."""

    n: int
    sums: tuple[np.ndarray, np.ndarray]
    products: tuple[np.ndarray, np.ndarray] | None

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        high = self.sums[0] / self.n
        # what is left over after taking n times that away, by exact integer fractions of the doubles
        low = np.array([float(_fraction(s) + _fraction(t) - self.n * _fraction(h)) / self.n for s, t, h in zip(*self.sums, high, strict=True)])
        return two_sum(high, low)

    def exact_sums(self) -> list[int]:
        """The sums of whole numbers."""
        return [int(a) + int(b) for a, b in zip(*self.sums, strict=True)]


def _fraction(x: float):
    from fractions import Fraction

    return Fraction(float(x))


def moments(vectors: DataFrame, column: str, dims: int, mean: tuple[np.ndarray, np.ndarray] | None, fill: float = 0.0) -> Moments:
    """Over all vectors of `column`: sums, or with `mean` sums and products of what is left of it."""
    rows = dims + 1 if mean is not None else 1  # the sums are the first row

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, (np.zeros((rows, dims)),) * 2
        for batch in batches:
            whole, _ = matrix_of(batch[column], dims, fill)
            for lo in range(0, len(whole), BLOCK):
                x = whole[lo : lo + BLOCK]
                n += len(x)
                if mean is None:
                    found = tuple(s[None] for s in column_sums(x))
                else:
                    high, low = two_sum(x, -mean[0])
                    low = low - mean[1]
                    high, low = two_sum(high, low)
                    found = tuple(np.concatenate([s[None], p]) for s, p in zip(column_sums(high, low), outer_products(high, low), strict=True))
                total = add(total, found)
        bands = range(0, rows, BAND)
        data = [b"".join(p[b : b + BAND].tobytes() for p in total) for b in bands]
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([b // BAND for b in bands], pa.int32()), pa.array([part] * len(data), pa.int64()), pa.array([n] * len(data), pa.int64()), pa.array(data, pa.binary())], ["band", "part", "n", "data"])

    def merged(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = None
        for data in table["data"].to_pylist():
            both = np.frombuffer(data).reshape(2, -1)
            total = add(total, (both[0], both[1])) if total else (both[0], both[1])
        return pa.table({"band": table["band"][:1], "part": pa.array([table["part"][0].as_py() // FAN], pa.int64()), "n": pa.array([pc.sum(table["n"]).as_py()], pa.int64()), "data": pa.array([b"".join(x.tobytes() for x in total)], pa.binary())})

    source = vectors.select(F.col(column))
    found, tasks = source.mapInArrow(work, _PART), source.rdd.getNumPartitions()
    while tasks > 1:
        found, tasks = found.groupBy("band", F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merged, _PART), math.ceil(tasks / FAN)
    bands = found.toArrow().sort_by("band")
    if not bands.num_rows:
        return Moments(0, (np.zeros(dims),) * 2, None)
    both = [np.frombuffer(data).reshape(2, -1, dims) for data in bands["data"].to_pylist()]
    high, low = (np.concatenate([x[k] for x in both]) for k in (0, 1))
    return Moments(bands["n"][0].as_py(), (high[0], low[0]), (high[1:], low[1:]) if mean is not None else None)


def covariance(found: Moments) -> np.ndarray:
    """Products over n, less those of what the mean was off by."""
    off = (found.sums[0] + found.sums[1]) / found.n
    v = found.products[0] / found.n + found.products[1] / found.n - np.outer(off, off)
    return (v + v.T) / 2


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, share of the trace) of the greatest `most`; those without variance have eigenvalue 0."""
    value, vector = np.linalg.eigh(v)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    value = np.where(value > len(v) * np.finfo(float).eps * max(value[0], 0.0), value, 0.0)
    top = np.abs(vector).argmax(axis=0)
    vector = vector * np.sign(vector[top, np.arange(vector.shape[1])])
    trace = float(np.trace(v))
    return value, vector, value / trace if trace > 0 else value


@dataclass
class Whitening:
    n: int
    sums: list[int] | None
    mean: tuple[np.ndarray, np.ndarray]
    value: np.ndarray
    vector: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; nan where a component has no variance."""
        centred = (x - self.mean[0]) - self.mean[1]
        scale = np.sqrt(np.where(self.value > 0, self.value, np.nan))
        return centred @ (self.vector / scale)


def fit(vectors: DataFrame, column: str = "vector", most: int = 8, fill: float = 0.0, whole: bool = False) -> Whitening | None:
    """The whitening of all vectors of `column` (array<double>), or none without any. whole: entries are whole numbers, whose exact sums are wanted."""
    finite = F.forall(column, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    dims = vectors.where(finite).agg(F.max(F.size(column))).first()[0] or 0
    if dims < 1:
        return None
    first = moments(vectors, column, dims, None, fill)
    if not first.n:
        return None
    mean = first.mean()
    value, vector, explained = components(covariance(moments(vectors, column, dims, mean, fill)), most)
    model = Whitening(first.n, first.exact_sums() if whole else None, mean, value, vector, explained)
    kept = np.flatnonzero(value > 0)
    if len(kept):
        given = vectors.sparkSession.sparkContext.broadcast(model)  # a few vectors

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, _ = matrix_of(batch[column], dims, fill)
                w = given.value.project(x)[:, kept]
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * len(kept)), pa.array(w.ravel()))], ["w"])

        zero = (np.zeros(len(kept)),) * 2
        seen = moments(vectors.select(column).mapInArrow(work, "w array<double>"), "w", len(kept), zero)
        model.identity_error = float(np.abs(covariance(seen) - np.eye(len(kept))).max())
    return model


def deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum of the squares of n * x - sums, exactly; none where it exceeds a long."""
    most = max(abs(n * float(np.abs(x).max(initial=0))), max((abs(s) for s in sums), default=0))
    if 4 * len(sums) * most**2 < 2.0**62:
        d = n * x.astype(np.int64) - np.array(sums, np.int64)
        return (d * d).sum(axis=1).tolist()
    exact = [sum((n * int(a) - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [d if d < 1 << 63 else None for d in exact]


def whitening(vectors: DataFrame, column: str = "vector", most: int = 8, fill: float = 0.0, whole: bool = False) -> DataFrame:
    """vec_id, component, n, deviation (whole numbers only), whitened, explained, identity_error: a row for each vector and component."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    model = fit(vectors, column, most, fill, whole)
    if model is None:
        return spark.createDataFrame([], schema)
    given, names = spark.sparkContext.broadcast(model), [x.split()[0] for x in schema.split(", ")]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        k = len(m.value)
        for batch in batches:
            x, rows = matrix_of(batch[column], len(m.mean[0]), fill)
            count = len(rows)
            far = deviation(x, m.n, m.sums) if m.sums else [None] * count
            w = m.project(x).ravel()
            repeated = np.repeat(np.arange(count), k)
            yield pa.RecordBatch.from_arrays(
                [
                    batch["vec_id"].take(pa.array(rows[repeated])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), count)), pa.array(np.full(count * k, m.n, np.int64)),
                    pa.array(far, pa.int64()).take(pa.array(repeated)), pa.array(w, pa.float64(), mask=np.isnan(w)), pa.array(np.tile(m.explained, count)), pa.array(np.full(count * k, m.identity_error)),
                ],
                names,
            )

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column)).mapInArrow(work, schema)


def quantised(column: Column, per_unit: int = 1024, shift: int = 100_000) -> Column:
    """Entries as whole numbers floor(per_unit * c) + shift, held to 2**52; null and non-finite entries stay."""
    one = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), c).otherwise(F.greatest(F.lit(-(2.0**52)), F.least(F.lit(2.0**52), F.floor(F.least(F.greatest(c, F.lit(-(2.0**43))), F.lit(2.0**43)) * per_unit).cast("double") + shift)))
    return F.transform(column.cast("array<double>"), one)
