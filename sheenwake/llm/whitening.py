"""Embedding whitening by a polarisation covariance (operator 12).

Entries are whole numbers x. For a whole number m next to its mean, the centred y = x - m has small values, and
the sums of y, of y * y for every dimension and of (y + z) * (y + z) for every pair of dimensions are exact.
Var(x) = (n * sum(y * y) - sum(y) ** 2) / n ** 2, exactly, and likewise for the sum of two dimensions, so

    Cov(x, w) = (Var(x + w) - Var(x) - Var(w)) / 2

comes out of whole numbers and is rounded once. Tasks send one row of sums for each pair and Spark adds them up;
the driver holds numbers by dimension and pair only, never vectors, and takes the eigenvectors.
"""
from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Eigenvalues below this share of the largest are rounding errors of a dependent direction.
LEAST_SHARE = 1e-12
#: Entries beyond this have no whole number of their own as a double.
LARGEST = 2.0**53
ROWS = 4096


def usable(vector_col: str) -> Column:
    """Whether a vector is there and all its entries are numbers that SCALE times fit a whole number."""
    v = F.col(vector_col).cast("array<double>")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * SCALE < LARGEST))
    return v.isNotNull() & (F.size(v) > 0) & fits


def whole_numbers(batch: pa.Array) -> np.ndarray:
    """x of every entry; all vectors of ``batch`` have one length."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * SCALE).astype(np.int64) + OFFSET).reshape(len(batch), -1)


def _squares(y: np.ndarray) -> np.ndarray:
    """Sums over rows of y * y for every dimension and, after these, of (y + z) ** 2 for every pair; exact."""
    n, d = y.shape
    most = int(np.abs(y).max(initial=0))
    if n * (2 * most) ** 2 >= 2**63:
        y = y.astype(object)  # Python's numbers have no limit
    out = [(y * y).sum(axis=0)]
    for i in range(d - 1):
        z = y[:, i + 1:] + y[:, i:i + 1]
        out.append((z * z).sum(axis=0))
    return np.concatenate(out)


def _by_rows(batches, get):
    """``get(numbers)`` of slices of the batches, added up."""
    total = None
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            new = get(whole_numbers(batch.column(0).slice(k, ROWS))).astype(object)
            total = new if total is None else total + new
    return total


def _decimals(values) -> pa.Array:
    return pa.array([int(v) if abs(v) < 10**38 else None for v in values], pa.decimal128(38, 0))


@dataclass
class Whitener:
    """Fitted numbers: n, sums by dimension, eigenvalues falling, components as columns."""

    n: int = 0
    sums: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.empty(0))
    components: np.ndarray = field(default_factory=lambda: np.empty((0, 0)))
    trace: float = 0.0
    #: Largest absolute entry of the covariance of the whitened values minus the identity, measured on all rows.
    identity_error: float | None = None

    @property
    def dimensions(self) -> int:
        return len(self.sums)


def _sums(vectors: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their sums by dimension, for the commonest length (of equal ones the longer)."""
    def run(batches):
        found: dict[int, list] = {}
        for batch in batches:
            sizes = np.diff(batch.column(0).offsets.to_numpy())
            for d in np.unique(sizes).tolist():
                rows = batch.column(0).filter(pa.array(sizes == d))
                for k in range(0, len(rows), ROWS):
                    x = whole_numbers(rows.slice(k, ROWS))
                    held = found.setdefault(d, [0, np.zeros(d, object)])
                    held[0] += len(x)
                    held[1] += (x.astype(object) if np.abs(x).max() >= 2**50 else x).sum(axis=0).astype(object)
        for d, (n, s) in found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), _decimals(s)],
                ["d", "i", "n", "s"])

    each = vectors.mapInArrow(run, "d int, i int, n bigint, s decimal(38,0)").groupBy("d", "i").agg(
        F.sum("n").alias("n"), F.sum("s").cast("decimal(38,0)").alias("s"))
    widest = each.where("i = 0").orderBy(F.desc("n"), F.desc("d")).first()
    if widest is None:
        return 0, []
    found = sorted((r["i"], int(r["s"])) for r in each.where(F.col("d") == widest["d"]).collect())
    return widest["n"], [s for _, s in found]


def _vectors(df: DataFrame, vector_col: str) -> DataFrame:
    return df.where(usable(vector_col)).select(F.col(vector_col).cast("array<double>").alias("v"))


def covariance(vectors: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the whole numbers of ``vectors`` (one column, all of one length), each entry rounded once."""
    d = len(sums)
    centre = np.array([s // n for s in sums], np.int64)

    def run(batches):
        total = _by_rows(batches, lambda x: _squares(x - centre))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), _decimals(total)], ["k", "q"])

    q = [0] * (d * (d + 1) // 2)
    added = vectors.mapInArrow(run, "k int, q decimal(38,0)").groupBy("k").agg(F.sum("q").cast("decimal(38,0)").alias("q"))
    for r in added.collect():
        q[r["k"]] = int(r["q"])
    rest = [s - n * int(m) for s, m in zip(sums, centre)]
    var = [n * q[i] - rest[i] ** 2 for i in range(d)]  # n * n times the variance
    out, k = np.empty((d, d)), d
    for i in range(d):
        out[i, i] = Fraction(var[i], n * n)
        for j in range(i + 1, d):
            both = n * q[k] - (rest[i] + rest[j]) ** 2
            out[i, j] = out[j, i] = Fraction(both - var[i] - var[j], 2 * n * n)
            k += 1
    return out


def fit(df: DataFrame, vector_col: str = "embedding", components: int = COMPONENTS) -> Whitener:
    """Fitted on every usable vector of the commonest length.

    Vectors that are null, empty, hold a null, NaN or infinite entry or one of 2**47 or more are not usable.
    Repeated rows count each. A direction without variance has no component. Without vectors, or where all are
    alike, there are none.
    """
    vectors = _vectors(df, vector_col)
    n, sums = _sums(vectors)
    if not n:
        return Whitener()
    vectors = vectors.where(F.size("v") == len(sums))
    cov = covariance(vectors, n, sums)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values.max(), 0.0) * LEAST_SHARE] if values.max() > 0 else order[:0]
    model = Whitener(n, sums, values[order], columns[:, order], float(np.trace(cov)))
    if len(order):
        model.identity_error = _identity_error(vectors, model)
    return model


def _projector(model: Whitener):
    """Whitened rows of whole numbers: x - S / n along each component, over its deviation."""
    n, centre = model.n, np.array([s // model.n for s in model.sums], np.int64)
    rest = np.array([s - n * int(m) for s, m in zip(model.sums, centre)], np.float64) / n
    matrix = model.components / np.sqrt(model.values)
    return lambda x: ((x - centre) - rest) @ matrix


def _identity_error(vectors: DataFrame, model: Whitener) -> float:
    """By polarisation again, of the whitened values: their means first, then squares of centred values and sums of two."""
    project, m = _projector(model), len(model.values)

    def added(get, size: int) -> np.ndarray:
        def run(batches):
            total = _by_rows(batches, get)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total.astype(float))], ["k", "q"])

        rows = vectors.mapInArrow(run, "k int, q double").groupBy("k").agg(F.sum("q").alias("q")).collect()
        out = np.zeros(size)
        for r in rows:
            out[r["k"]] = r["q"]
        return out / model.n

    mean = added(lambda x: project(x).sum(axis=0), m)

    def squares(x):
        w = project(x) - mean
        return np.concatenate([(w * w).sum(axis=0)] + [((w[:, i + 1:] + w[:, i:i + 1]) ** 2).sum(axis=0) for i in range(m - 1)])

    q = added(squares, m * (m + 1) // 2)
    worst, k = float(np.abs(q[:m] - 1).max()), m
    for i in range(m):
        for j in range(i + 1, m):
            worst, k = max(worst, abs(q[k] - q[i] - q[j]) / 2), k + 1
    return worst


def whiten(df: DataFrame, model: Whitener, vector_col: str = "embedding") -> DataFrame:
    """The rows of ``df`` that the model was fitted on, with whitened (array of double) and deviation.

    deviation, decimal(38,0), is the sum over dimensions of (n * x - S) ** 2, exact, null beyond 38 digits. Columns of these names are
    replaced, all others are kept as they are.
    """
    rows = df.where(usable(vector_col) & (F.size(vector_col) == model.dimensions))
    n, project = model.n, _projector(model) if model.n else None
    sums, size = model.sums, len(model.values)
    out_type = "struct<w:array<double>,s:decimal(38,0)>"

    @F.arrow_udf(out_type)
    def run(vectors: pa.Array) -> pa.Array:
        x = whole_numbers(vectors)
        centre = np.array([s // n for s in sums], np.int64)
        rest = [s - n * int(m) for s, m in zip(sums, centre)]
        y = x - centre
        large = int(np.abs(y).max(initial=0)) * max(n, 1) * max(1, y.shape[1]) >= 2**62 or int(np.abs(y).max(initial=0)) >= 2**28
        y_ = y.astype(object) if large else y
        # sum((n * y - r) ** 2), taken apart so that the products stay small
        squares, mixed = (y_ * y_).sum(axis=1), (y_ * np.array(rest, object if large else np.int64)).sum(axis=1)
        plain = sum(r * r for r in rest)
        deviation = [n * n * int(a) - 2 * n * int(b) + plain for a, b in zip(squares, mixed)]
        white = project(x)
        ends = pa.array(np.arange(len(x) + 1) * size, pa.int32())
        return pa.StructArray.from_arrays(
            [pa.ListArray.from_arrays(ends, pa.array(white.reshape(-1))), _decimals(deviation)], ["w", "s"])

    if not n:
        empty = rows.where(F.lit(False))
        return empty.withColumns({"whitened": F.lit(None).cast("array<double>"), "deviation": F.lit(None).cast("decimal(38,0)")})
    made = f"_{uuid.uuid4().hex}"
    return (rows.withColumn(made, run(F.col(vector_col).cast("array<double>")))
            .withColumns({"whitened": F.col(f"{made}.w"), "deviation": F.col(f"{made}.s")}).drop(made))
