"""Whitening of vectors: principal components with unit variance.

Entries become integers, so counts and sums are exact.  One pass sums them, a
second the centred products; both leave one row per dimension, however many
vectors there are.  The scatter is factored by a pivoted Cholesky decomposition,
and one-sided Jacobi rotations make the columns of the triangular factor
orthogonal: their squared norms are the eigenvalues, the normalised columns the
components.  A third pass measures the covariance of the whitened vectors, a
fourth whitens.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.sources.sinks import publish

LARGEST = 1 << 40  # integers beyond are taken as this
SAFE = 1 << 62


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with ``sums`` per dimension; a component a column, eigenvalues falling."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    scale: int
    shift: int

    @property
    def map(self) -> np.ndarray:
        """Centred vectors times this are white."""
        return self.components / np.sqrt(self.values)


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Factor f with f f' = a, rows in the order of a; columns end where the rest is rounding."""
    d = len(a)
    rest, f = a.astype(float).copy(), np.zeros((d, d))
    left = np.ones(d, bool)
    least = d * np.finfo(float).eps * max(rest.diagonal().max(initial=0.0), 0.0)
    for k in range(d):
        diagonal = np.where(left, rest.diagonal(), -np.inf)
        p = int(diagonal.argmax())
        if diagonal[p] <= least:
            return f[:, :k]
        column = np.where(left, rest[:, p], 0.0) / np.sqrt(rest[p, p])
        f[:, k] = column
        left[p] = False
        rest -= np.outer(column, column)
    return f


def jacobi(f: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns of f rotated until they are orthogonal, longest first; disjoint pairs turn together."""
    g = f.copy()
    n = g.shape[1]
    order = np.arange(n + n % 2)  # a pair with the number n rests
    tiny = np.finfo(float).eps * np.sqrt(max(len(g), 1))
    for _ in range(sweeps):
        turned = False
        for _ in range(max(len(order) - 1, 0)):
            i, j = order[:len(order) // 2], order[::-1][:len(order) // 2]
            both = (i < n) & (j < n)
            i, j = i[both], j[both]
            x, y = g[:, i], g[:, j]
            a, b, c = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            turn = np.abs(c) > tiny * np.sqrt(a * b)
            if turn.any():
                turned = True
                x, y, a, b, c = x[:, turn], y[:, turn], a[turn], b[turn], c[turn]
                z = (b - a) / (2 * c)
                t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
                cos = 1 / np.hypot(1.0, t)
                g[:, i[turn]], g[:, j[turn]] = cos * (x - t * y), cos * (t * x + y)
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])  # round robin
        if not turned:
            break
    return g[:, np.argsort(-(g * g).sum(0), kind="stable")]


def _integers(column: pa.Array, d: int | None, scale: int, shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Integers of the usable vectors of length d (of all, flat, without d), their lengths, and which rows they are."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    ends = np.cumsum(size)
    good = (size > 0) & (bad[ends] == bad[ends - size])
    if d is not None:
        good &= size == d
    kept = flat[np.repeat(good, size)]
    x = np.clip(np.floor(scale * kept), -LARGEST, LARGEST).astype(np.int64) + shift
    return (x.reshape(-1, d) if d is not None else x), size[good], np.nonzero(good)[0]


def _centred(x: np.ndarray, n: int, sums: tuple[int, ...]) -> np.ndarray:
    """n * x - sums, exact: machine integers where they hold it."""
    most = int(np.abs(x).max(initial=0))
    if n * most + max(map(abs, sums), default=0) < SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _lengths(scale: int, shift: int):
    """Arrow pass vector -> (d, i, n, s): vectors and sums of each length and dimension."""
    schema = pa.schema([("d", pa.int32()), ("i", pa.int32()), ("n", pa.int64()), ("s", pa.decimal128(38, 0))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        total: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            flat, size, _ = _integers(b.column(0), None, scale, shift)
            of = np.repeat(size, size)
            for d in np.unique(size).tolist():
                x = flat[of == d].reshape(-1, d)
                n, s = total.get(d, (0, np.zeros(d, object)))
                total[d] = (n + len(x), s + x.sum(0))  # a batch of less than 2^22 rows cannot overflow
        for d, (n, s) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)), pa.array(np.full(d, n)),
                                              pa.array([Decimal(int(v)) for v in s], pa.decimal128(38, 0))], schema=schema)

    return run


def _products(model: Whitening, d: int, white: bool):
    """Arrow pass vector -> (i, row): rows of the sum of outer products of centred (or whitened) vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            x, _, _ = _integers(b.column(0), d, model.scale, model.shift)
            z = _centred(x, model.n, model.sums).astype(float) / model.n
            if white:
                z = z @ model.map
            total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array([r.astype("<f8").tobytes() for r in total], pa.binary())], names=["i", "row"])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow pass (i, row): rows of one dimension added."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for i, r in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            v = np.frombuffer(r.as_py(), "<f8")
            total[i] = total[i] + v if i in total else v
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["i", "row"])


def _matrix(vectors: DataFrame, model: Whitening, d: int, white: bool) -> np.ndarray:
    """Sum of outer products over all vectors: one row per dimension reaches the driver."""
    parts = vectors.mapInArrow(_products(model, d, white), "i int, row binary")
    rows = parts.repartition("i").mapInArrow(_add, "i int, row binary").collect()
    size = len(model.values) if white else d
    out = np.zeros((size, size))
    for r in rows:
        out[r.i] += np.frombuffer(bytes(r.row), "<f8")
    return out


def fit(vectors: DataFrame, *, vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> Whitening | None:
    """Components of floor(scale * c) + shift over all usable vectors; none if there are none.

    Vectors that are null or empty, or hold null or non-finite entries, are left
    out; of several lengths the most frequent one is fitted, the longest of
    equals.  Integers are limited to 2^40.  Components beyond the numerical rank
    of the covariance have no variance to scale and are left out: one vector,
    or copies of one, have no component.
    """
    column = vectors.select(F.col(vector).alias("v"))
    sums = publish(column.mapInArrow(_lengths(scale, shift), "d int, i int, n long, s decimal(38,0)").groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")), "vector-sums")
    best = sums.where("i = 0").orderBy(F.desc("n"), F.desc("d")).select("d", "n").first()
    if best is None:
        return None
    d, n = best
    total = tuple(int(r.s) for r in sums.where(F.col("d") == d).orderBy("i").collect())  # one row per dimension
    plain = Whitening(n, total, np.zeros((d, 0)), np.zeros(0), 0.0, scale, shift)
    scatter = _matrix(column, plain, d, False)
    columns = jacobi(pivoted_cholesky(scatter))
    values = (columns * columns).sum(0)
    kept = min(components, int((values > d * np.finfo(float).eps * values.max(initial=0)).sum()))
    return Whitening(n, total, columns[:, :kept] / np.sqrt(values[:kept]), values[:kept] / n, float(scatter.trace() / n), scale, shift)


def identity_error(vectors: DataFrame, model: Whitening, *, vector: str = "embedding") -> float:
    """Largest entry, by size, of the whitened covariance minus the identity.

    The sum of n * x - sums is exactly zero, so whitened vectors are centred.
    """
    found = _matrix(vectors.select(F.col(vector).alias("v")), model, len(model.sums), True) / model.n
    return float(np.abs(found - np.eye(len(found))).max(initial=0.0))


def whiten(vectors: DataFrame, model: Whitening | None, *, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, n, deviation, whitened): one row per usable vector, its components in an array.

    ``deviation`` is the sum of (n * x - sums)^2, exact.  Null and repeated ids
    keep their rows.  Without a model there are no rows.
    """
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("deviation", pa.decimal128(38, 0)), ("whitened", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        d, k = len(model.sums), len(model.values)
        for b in batches:
            x, _, rows = _integers(b.column(1), d, model.scale, model.shift)
            z = _centred(x, model.n, model.sums)
            white = (z.astype(float) / model.n) @ model.map
            most = int(np.abs(z).max(initial=0))
            exact = z if d * most * most < SAFE else z.astype(object)
            deviation = (exact * exact).sum(1).tolist()
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), model.n)), pa.array([Decimal(v) for v in deviation], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * k), pa.array(white.ravel()))], schema=schema)

    source = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("v"))
    if model is None:
        source, run = source.limit(0), lambda batches: iter(())
    out = source.mapInArrow(run, "id long, n long, deviation decimal(38,0), whitened array<double>")
    return out.withColumnRenamed("id", id)


def whiten_long(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", components: int = 32) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row per usable vector and component.

    Fitted on the same vectors.  ``deviation`` is null where a long does not hold it.
    """
    model = fit(vectors, vector=vector, components=components)
    share = [] if model is None else (model.values / model.trace).tolist()
    error = identity_error(vectors, model, vector=vector) if share else 0.0
    out = whiten(vectors, model, id=id, vector=vector).select(id, "n", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    explained = F.element_at(F.array(*map(F.lit, share)) if share else F.array(F.lit(0.0)), F.col("k") + 1)
    return out.select(id, (F.col("k") + 1).alias("component"), "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened",
                      explained.alias("explained"), F.lit(error).alias("identity_error"))
