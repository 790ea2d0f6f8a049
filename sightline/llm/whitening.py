"""Operator 11: whitening of embeddings. Spark sums the centred scatter, the driver diagonalises it by cyclic Jacobi rotations, and the sorted whitening matrix goes to all tasks."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import Scratch, by_value

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Whole numbers end here, so that sums of their halves stay whole.
MOST = 1 << 62
#: Components that the digest reports.
COMPONENTS = 16
#: Components whose eigenvalue is at most this share of the trace have no spread: they can't be told from rounding.
RANK = 1e-13
#: Rows turned at a time.
ROWS = 4096
SWEEPS = 40


@dataclass
class Whitening:
    """What whitens vectors x: n vectors were fitted, `total` has their exact sums; components are rows of `basis`, by falling eigenvalue."""

    n: int = 0
    total: list[int] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))
    basis: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    trace: float = 0.0

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as its whole part and what remains of the sum."""
        pairs = [divmod(s, self.n) for s in self.total]
        return np.array([p[0] for p in pairs], np.int64), np.array([p[1] for p in pairs], np.int64)

    def matrix(self, components: int | None = None) -> np.ndarray:
        """Columns that take a centred vector to its whitened entries; a component without spread gives NaN."""
        some = self.values[:components]
        spread = np.where(some > RANK * self.trace, some, np.nan)
        return self.basis[:components].T / np.sqrt(spread)


def jacobi(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (rows) of a symmetric matrix.

    Cyclic sweeps in tournament order: the rotations of a round touch different rows and columns, so a round is a few array
    operations. A rotation is left out only if its entry is below rounding next to both its diagonal entries, which keeps small eigenvalues accurate to the last digits.
    """
    a = np.array(matrix, np.float64)
    d = len(a)
    v, eps = np.eye(d), np.finfo(float).eps
    ring = np.arange(d + d % 2)
    for _ in range(SWEEPS):
        turned = False
        for _ in range(max(len(ring) - 1, 0)):
            half = len(ring) // 2
            p, q = np.minimum(ring[:half], ring[: half - 1 : -1]), np.maximum(ring[:half], ring[: half - 1 : -1])
            ring = np.concatenate((ring[:1], np.roll(ring[1:], 1)))
            p, q = p[q < d], q[q < d]
            app, aqq, apq = a[p, p], a[q, q], a[p, q]
            some = np.abs(apq) > eps * np.sqrt(np.abs(app)) * np.sqrt(np.abs(aqq))
            p, q, app, aqq, apq = p[some], q[some], app[some], aqq[some], apq[some]
            if not len(p):
                continue
            turned = True
            with np.errstate(over="ignore"):
                theta = (aqq - app) / (2 * apq)
                t = np.where(theta < 0, -1.0, 1.0) / (np.abs(theta) + np.hypot(theta, 1))
            c = 1 / np.hypot(t, 1)
            s = t * c
            rows = a[p], a[q]
            a[p], a[q] = c[:, None] * rows[0] - s[:, None] * rows[1], s[:, None] * rows[0] + c[:, None] * rows[1]
            cols = a[:, p], a[:, q]
            a[:, p], a[:, q] = c * cols[0] - s * cols[1], s * cols[0] + c * cols[1]
            turns = v[p], v[q]
            v[p], v[q] = c[:, None] * turns[0] - s[:, None] * turns[1], s[:, None] * turns[0] + c[:, None] * turns[1]
            a[p, p], a[q, q], a[p, q], a[q, p] = app - t * apq, aqq + t * apq, 0.0, 0.0
        if not turned:
            break
    else:
        if np.abs(a - np.diag(np.diag(a))).max() > 1e-13 * max(np.trace(a), 0.0):
            raise RuntimeError("off-diagonal entries didn't vanish")
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], v[order]


def _whole(column: pa.Array, dim: int | None = None):
    """For each length of vector, or for one alone, the rows that have it and their whole numbers; vectors that are null or empty, or hold null or non-finite entries, have no row."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()].to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for d in np.unique(lengths[there & (lengths > 0)]) if dim is None else [dim]:
        rows = np.flatnonzero(there & (lengths == d))
        for lo in range(0, len(rows), ROWS):
            part = rows[lo : lo + ROWS]
            c = flat[starts[part][:, None] + np.arange(d)]
            fine = np.isfinite(c).all(axis=1)
            with np.errstate(over="ignore"):
                x = np.minimum(np.clip(np.floor(c[fine] * SCALE), -MOST, MOST).astype(np.int64), MOST - OFFSET) + OFFSET
            yield part[fine], x


def _pack(x: np.ndarray) -> list[bytes]:
    """Each vector as bytes that no other one has: two bytes an entry where they are near OFFSET, else eight."""
    near = (np.abs(x - OFFSET) < 1 << 15).all(axis=1)
    return [(r - OFFSET).astype("<i2").tobytes() if small else r.astype("<i8").tobytes() for r, small in zip(x, near, strict=True)]


def _unpack(keys: pa.Array, dim: int):
    """The vectors of packed keys, ROWS or fewer at a time."""
    for lo in range(0, len(keys), ROWS):
        some = keys.slice(lo, ROWS).to_pylist()
        for kind in ("<i2", "<i8"):
            own = [k for k in some if len(k) == dim * int(kind[2])]
            if own:
                x = np.frombuffer(b"".join(own), kind).reshape(-1, dim).astype(np.int64)
                yield x + OFFSET if kind == "<i2" else x


def _keys(batches):
    for batch in batches:
        for _, x in _whole(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array(_pack(x), pa.binary())], ["dim", "key"])


def _sums(dim: int):
    """Sums of a task's vectors by dimension, split in upper and lower 32 bits so that none leaves a long."""

    def run(batches):
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            for x in _unpack(batch.column(0), dim):
                high, low, n = high + (x >> 32).sum(axis=0), low + (x & 0xFFFFFFFF).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dim, n, np.int64))], ["i", "high", "low", "n"])

    return run


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    return (x - whole) - rest / n


def _scatter(dim: int, model: Whitening, turn: np.ndarray | None):
    """Upper triangle of the sum of centred vectors times themselves over a task's vectors; turn is applied to each first."""
    whole, rest = model.centre()
    n = model.n

    def run(batches):
        width = dim if turn is None else turn.shape[1]
        out, some = np.zeros((width, width)), False
        for batch in batches:
            for x in _unpack(batch.column(0), dim):
                c = _centred(x, whole, rest, n)
                c = c if turn is None else c @ turn
                out, some = out + c.T @ c, True
        if some:
            i, j = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(out[i, j])], ["i", "j", "v"])

    return run


def _covariance(fitted: DataFrame, dim: int, model: Whitening, turn: np.ndarray | None = None) -> np.ndarray:
    """Summed by cell: each task sends a triangle, and one triangle comes to the driver, whatever the number of rows."""
    width = dim if turn is None else turn.shape[1]
    cells = fitted.mapInArrow(_scatter(dim, model, turn), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toArrow()  # width * (width + 1) / 2 rows
    out = np.zeros((width, width))
    i, j, v = (cells.column(c).to_numpy() for c in ("i", "j", "v"))
    out[i, j] = out[j, i] = v / model.n
    return out


def _fit_list(vectors: DataFrame, column: str, scratch: Scratch) -> tuple[DataFrame, int]:
    """Each distinct whole vector of the commonest length (of equally common ones the longest) once, and that length; 0 without any. Repeats are dropped in each task before they are shuffled."""
    keys = vectors.select(F.col(column).cast("array<double>").alias("v")).mapInArrow(_keys, "dim int, key binary").distinct()
    fitted = scratch.keep(keys, "fit")
    best = fitted.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    return (fitted.where(F.col("dim") == best.dim).select("key"), best.dim) if best else (fitted.select("key"), 0)


def _fit(fitted: DataFrame, dim: int) -> Whitening:
    if not dim:
        return Whitening()
    sums = fitted.mapInArrow(_sums(dim), "i int, high long, low long, n long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).orderBy("i").collect()  # a row for each dimension
    model = Whitening(sums[0].n, [(r.high << 32) + r.low for r in sums])
    model.values, model.basis = jacobi(_covariance(fitted, dim, model))
    model.values = np.maximum(model.values, 0.0)
    model.trace = float(model.values.sum())
    return model


def fit(vectors: DataFrame, column: str = "embedding") -> Whitening:
    """The whitening of x = floor(SCALE * c) + OFFSET over the distinct x vectors of a column of numbers.

    Vectors that are null or empty, that hold null or non-finite entries, or whose
    length isn't the commonest one take no part; x stays within a long. The driver holds a few matrices of the vectors' length squared, nothing that grows with the rows.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    model = _fit(*_fit_list(vectors, column, scratch))
    scratch.clear()
    return model


def _apply(model: Whitening, at: int, name: str):
    whole, rest = model.centre()
    n, turn = model.n, model.matrix()

    def run(batches):
        for batch in batches:
            out: list = [None] * batch.num_rows
            for rows, x in _whole(batch.column(at), len(whole)):
                z = _centred(x, whole, rest, n) @ turn
                for r, vector in zip(rows, z, strict=True):
                    out[r] = vector
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return run


def whiten(vectors: DataFrame, model: Whitening, column: str = "embedding", name: str = "whitened") -> DataFrame:
    """Adds the whitened vector (array<double>, components by falling eigenvalue; NaN where one has no spread); null for vectors that fit() leaves out. All rows and other columns stay."""
    if not model.n:
        return vectors.withColumn(name, F.lit(None).cast("array<double>"))
    taken = vectors.withColumn(column, F.col(column).cast("array<double>"))
    return taken.mapInArrow(_apply(model, vectors.columns.index(column), name), taken.withColumn(name, F.lit(None).cast("array<double>")).schema)


def _digest(model: Whitening, error: float, components: int):
    whole, rest = model.centre()
    n, turn = model.n, model.matrix(components)
    k = turn.shape[1]
    explained = model.values[:k] / model.trace if model.trace else np.zeros(k)

    def deviations(x: np.ndarray) -> list[int | None]:
        t = x - whole
        if float(np.abs(t).max(initial=0)) * n < 2.0**62 and (float(np.abs(t).max(initial=0)) + 1) ** 2 * float(n) ** 2 * t.shape[1] < 2.0**62:
            return ((n * t - rest) ** 2).sum(axis=1).tolist()
        exact = [sum((n * int(b) - int(r)) ** 2 for b, r in zip(row, rest, strict=True)) for row in t]
        return [e if e < 1 << 63 else None for e in exact]

    def run(batches):
        for batch in batches:
            for rows, x in _whole(batch.column(1), len(whole)):
                z = _centred(x, whole, rest, n) @ turn
                m = len(rows)
                ids = batch.column(0).take(pa.array(np.repeat(rows, k)))
                dev = pa.array(deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(m), k)))
                flat = z.ravel()
                cols = [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), dev, pa.array(flat, mask=np.isnan(flat)), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return run


def whitened_components(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each row of (vec_id, embedding) and component up to `components`: vec_id, component, n, deviation, whitened, explained, identity_error.

    The fit is that of fit(); rows that it leaves out have none here. deviation is the exact sum of (n * x - S)^2 over the dimensions, null
    where it leaves a long. A component without spread (all, if one vector is fitted) has whitened null and takes no part in identity_error, the largest entry by which the covariance of
    the whitened fit list differs from the identity. Repeated rows, also without vec_id, give rows each. An empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted, dim = _fit_list(vectors, "embedding", scratch)
    if not dim:
        return vectors.sparkSession.createDataFrame([], schema)
    model = _fit(fitted, dim)
    turn = model.matrix(components)
    turn = turn[:, ~np.isnan(turn).any(axis=0)]
    error = float(np.abs(_covariance(fitted, dim, model, turn) - np.eye(turn.shape[1])).max()) if turn.shape[1] else 0.0
    scratch.clear()
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_digest(model, error, components), schema)


by_value(__name__)
