"""Embedding whitening by incremental eigendecomposition.

A task keeps a spectrum (count, mean, eigenpairs of the scatter around the mean). Each block of its
vectors is brought to as many rows as there are dimensions by an orthogonal transform, which keeps
its scatter, and these rows and the shift of the mean are applied as rank-one updates: the secular
equation gives the new eigenvalues, entries that do not move are deflated. Spectra of tasks combine
in the same way, eigenpair by eigenpair, some at a time until one is left. Rayleigh-Ritz steps over
the distributed vectors, in the leading subspace and what its residuals add, then refine the leading
components to double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stored

#: Whole numbers that a double holds exactly; scaled entries beyond are set to this bound.
EXACT = 1 << 53
#: Residual of an eigenpair, relative to the largest eigenvalue, below which refinement ends, and the most steps it takes.
RESIDUAL, STEPS = 1e-13, 12
#: Spectra that one group combines.
FAN_IN = 32
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z^2 / (d - x)) = 0 for ascending distinct ``d`` and ``z`` without zeros.

    Root j lies between d[j] and d[j + 1], the last one at most |z|^2 above. It comes as (pole, offset),
    the nearer pole's index and the distance from it, so that differences to poles keep their digits.
    """
    n = len(d)
    gap = np.append(np.diff(d), z @ z)
    delta = d[None, :] - d[:, None]  # [root, pole]: pole relative to the root's left pole
    middle = 1 + (z**2 / (delta - gap[:, None] / 2)).sum(1)
    right = (middle < 0) & (np.arange(n) < n - 1)
    pole = np.arange(n) + right
    delta = d[None, :] - d[pole][:, None]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, gap / 2)
    high[-1], low[-1] = (gap[-1], gap[-1] / 2) if middle[-1] < 0 else (gap[-1] / 2, 0.0)
    x = (low + high) / 2
    left, beyond = np.arange(n)[:, None] >= np.arange(n), d + gap - d[pole]
    for _ in range(100):
        inv = 1 / (delta - x[:, None])
        term = z**2 * inv
        f = 1 + term.sum(1)
        low, high = np.where(f < 0, x, low), np.where(f < 0, high, x)
        far = np.abs(f) > _EPS * n * (1 + np.abs(term).sum(1))
        if not far.any():
            break
        # the zero of c + s / (pole - x) + t / (next pole - x) with the slopes of both sides
        slope = term * inv
        down, up = (slope * left).sum(1), (slope * ~left).sum(1)
        a1, a2 = d - d[pole] - x, beyond - x
        c = f - a1 * down - a2 * up
        a = (a1 + a2) * f - a1 * a2 * (down + up)
        b = a1 * a2 * f
        with np.errstate(all="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = x + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            halve = np.where(np.sign(low) * np.sign(high) > 0, np.sign(high) * np.sqrt(np.abs(low)) * np.sqrt(np.abs(high)), (low + high) / 2)
        x = np.where(far, np.where(np.isfinite(step) & (step > low) & (step < high), step, halve), x)
    return pole, x


def rank_one(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs (ascending values, vectors in columns) of vectors @ diag(values) @ vectors.T + v v^T."""
    z = vectors.T @ v
    size = z @ z
    if size == 0:
        return values, vectors
    values, vectors = values.copy(), vectors.copy()
    tol = 8 * _EPS * max(np.abs(values).max(), size)
    live = np.abs(z) * np.sqrt(size) > tol  # the others do not move
    z = np.where(live, z, 0.0)
    at = np.flatnonzero(live)
    for a, b in zip(at, at[1:], strict=False):  # equal values: turn one of the two out of the update
        if values[b] - values[a] <= tol:
            r = np.hypot(z[a], z[b])
            c, s = z[b] / r, z[a] / r
            vectors[:, a], vectors[:, b] = c * vectors[:, a] - s * vectors[:, b], s * vectors[:, a] + c * vectors[:, b]
            z[a], z[b] = 0.0, r
            values[b] = max(values[a], values[b])
            live[a] = False
    at = np.flatnonzero(live)
    if not len(at):
        return values, vectors
    d, y = values[at], z[at]
    pole, x = secular_roots(d, y)
    # [pole, root]; the z that has exactly these roots keeps the vectors orthogonal
    apart = (d[:, None] - d[pole][None, :]) - x[None, :]
    apart[apart == 0] = -_EPS * max(size, 1e-300)
    off = d[:, None] - d[None, :]
    np.fill_diagonal(off, 1.0)
    ratio = np.abs(apart) / np.abs(off)
    exact = np.sign(y) * np.sqrt(np.exp(np.log(ratio).sum(1)))
    turn = exact[:, None] / apart
    turn /= np.sqrt((turn**2).sum(0))
    values[at] = d[pole] + x
    vectors[:, at] = vectors[:, at] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, mean and eigenpairs of the scatter of some vectors around their mean, with their exact sums."""

    n: int
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    sums: np.ndarray

    @classmethod
    def empty(cls, dims: int) -> Spectrum:
        return cls(0, np.zeros(dims), np.zeros(dims), np.eye(dims), np.zeros(dims, np.int64))

    def _add(self, n: int, mean: np.ndarray, rows: np.ndarray) -> None:
        """Apply ``n`` more vectors with this mean, whose scatter is that of ``rows`` around zero."""
        if n == 0:
            return
        shift = np.sqrt(self.n * n / (self.n + n)) * (mean - self.mean)
        for v in (*rows, shift):
            self.values, self.vectors = rank_one(self.values, self.vectors, v)
        self.values = np.maximum(self.values, 0)
        self.mean = self.mean + (mean - self.mean) * (n / (self.n + n))
        self.n += n

    def update(self, x: np.ndarray) -> None:
        """Apply a block of whole-number vectors."""
        self.sums = self.sums + x.sum(0)
        base = x[0].astype(float)
        y = (x - x[0]).astype(float)
        mean = y.mean(0)
        y = y - mean
        self._add(len(x), base + mean, np.linalg.qr(y, "r") if len(y) > y.shape[1] else y)

    def combine(self, other: Spectrum) -> None:
        """Apply all eigenpairs of another spectrum."""
        self.sums = self.sums + other.sums
        self._add(other.n, other.mean, (other.vectors * np.sqrt(other.values)).T)


_SPECTRUM = "n long, mean array<double>, `values` array<double>, vectors array<double>, sums array<long>"


def _record(s: Spectrum, **more: int) -> pa.RecordBatch:
    cols = {k: pa.array([v], pa.int64()) for k, v in (*more.items(), ("n", s.n))}
    cols |= {k: pa.array([getattr(s, k).ravel().tolist()], pa.list_(pa.float64())) for k in ("mean", "values", "vectors")}
    return pa.RecordBatch.from_pydict(cols | {"sums": pa.array([s.sums.tolist()], pa.list_(pa.int64()))})


def _spectrum(row: dict) -> Spectrum:
    d = len(row["mean"])
    return Spectrum(row["n"], np.array(row["mean"]), np.array(row["values"]), np.array(row["vectors"]).reshape(d, d), np.array(row["sums"], np.int64))


def _rows(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def spectra(vectors: DataFrame, dims: int, block: int | None = None) -> Spectrum:
    """The spectrum of all rows of ``vectors`` (x: array<long> of ``dims`` entries); one small row reaches the driver."""
    block = block or 64 * dims

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        s = Spectrum.empty(dims)
        for batch in batches:
            x = _rows(batch, "x", dims)
            for low in range(0, len(x), block):
                s.update(x[low : low + block])
        if s.n:
            yield _record(s, part=TaskContext.get().partitionId())

    def merge(key: tuple, some: pa.Table) -> pa.Table:
        s = Spectrum.empty(dims)
        for row in sorted(some.to_pylist(), key=lambda r: r["part"]):
            s.combine(_spectrum(row))
        return pa.Table.from_batches([_record(s, part=key[0].as_py())])

    parts = vectors.select("x").rdd.getNumPartitions()
    found = vectors.select("x").mapInArrow(start, f"part long, {_SPECTRUM}")
    while True:
        found = stored(found, "spectra")
        if parts <= FAN_IN:
            break
        found = found.groupBy(F.expr(f"part DIV {FAN_IN}").alias("grp")).applyInArrow(merge, f"part long, {_SPECTRUM}")
        parts = -(-parts // FAN_IN)
    s = Spectrum.empty(dims)
    for row in found.orderBy("part").collect():  # FAN_IN rows at most
        s.combine(_spectrum(row.asDict()))
    return s


def _projected(vectors: DataFrame, dims: int, shift: tuple[np.ndarray, np.ndarray], basis: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Sum of (x - m)^T (x - m) @ basis, or of the outer products of (x - m) @ basis where ``right`` is given its column scales."""
    whole, part = shift

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            y = (_rows(batch, "x", dims) - whole).astype(float) - part
            p = y @ basis
            got = y.T @ p if right is None else (p * right).T @ (p * right)
            total = got if total is None else total + got
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = vectors.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dims if right is None else basis.shape[1], basis.shape[1]))
    for r in rows:  # as many as the matrix has entries
        out[r.i, r.j] = r.v
    return out


@dataclass
class Whitening:
    """A fitted transform: leading eigenpairs of the covariance, largest first, and the exact centre sums / n."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    @property
    def shift(self) -> tuple[np.ndarray, np.ndarray]:
        """The centre as whole part and fraction."""
        whole = [s // self.n for s in self.sums] if self.n else [0 for _ in self.sums]
        part = [(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)] if self.n else [0.0 for _ in self.sums]
        return np.array(whole, np.int64), np.array(part)


def fit(vectors: DataFrame, dims: int, components: int = 16, guard: int = 16) -> Whitening:
    """Fit on the rows of ``vectors`` (x: array<long>), which are read again in each step: pass a stored table.

    A component whose variance is nothing beside the largest one's is left out.
    """
    s = spectra(vectors, dims)
    if s.n == 0:
        return Whitening(0, [0] * dims, np.zeros(0), np.zeros((dims, 0)), 0.0, 0.0)
    found = Whitening(s.n, [int(v) for v in s.sums], np.zeros(0), np.zeros((dims, 0)), float(s.values.sum() / s.n), 0.0)
    keep, k = min(components + guard, dims), min(components, dims)
    basis = np.linalg.qr(s.vectors[:, ::-1][:, :keep])[0]
    values, ritz = s.values[::-1][:k] / s.n, basis[:, :k]
    for _ in range(STEPS):
        image = _projected(vectors, dims, found.shift, basis, None) / s.n
        small = basis.T @ image
        e, u = np.linalg.eigh((small + small.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        ritz, moved = basis @ u, image @ u
        values = e[:k]
        rest = moved - ritz * e
        if e[0] <= 0 or np.linalg.norm(rest[:, :k], axis=0).max() <= RESIDUAL * e[0] or keep == dims:
            break
        # the leading vectors and what the residuals add span the next subspace
        basis = np.linalg.qr(np.concatenate([ritz[:, :keep], rest[:, :k]], 1))[0][:, : min(dims, keep + k)]
    live = values > max(values[0], 0) * 1e-12 if len(values) else np.zeros(0, bool)
    found.values, found.vectors = values[live], ritz[:, :k][:, live]
    if len(found.values):
        cov = _projected(vectors, dims, found.shift, found.vectors, 1 / np.sqrt(found.values)) / s.n
        found.error = float(np.abs(cov - np.eye(len(cov))).max())
    return found


def scaled(vector: Column) -> Column:
    """Entries as whole numbers floor(64 c) + 1000000; beyond +-2^53 they stay at that bound."""
    one = lambda c: F.floor(F.greatest(F.least(c.cast("double") * 64, F.lit(float(EXACT))), F.lit(float(-EXACT)))) + F.lit(1000000).cast("long")
    return F.transform(vector, one)


def whiten(df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every sound vector and component.

    Vectors that are null, or hold null or non-finite entries, or have another number of entries than
    most have (of equally many the larger) are dropped. Repeated vectors count once in the fit and have
    rows each. Components without variance (constant or single vectors) are left out, so such a table
    gives no rows, as an empty one does. Further columns are ignored. A deviation beyond a long is an
    error. Signs are such that a component's largest entry is positive.
    """
    ok = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    sound = df.select(df[id_col].alias("vec_id"), df[vector_col].alias("v")).where(F.col("v").isNotNull() & F.forall("v", ok))
    sizes = sound.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dims = sizes.d if sizes else 0
    rows = sound.where(F.size("v") == dims).select("vec_id", scaled(F.col("v")).alias("x"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if not dims:
        return df.sparkSession.createDataFrame([], schema)
    distinct = stored(rows.select("x").distinct(), "vectors")
    model = fit(distinct, dims, components)
    discard(distinct)
    k, n, sums = len(model.values), model.n, np.array(model.sums, object)
    whole, part = model.shift
    sign = np.sign(model.vectors[np.abs(model.vectors).argmax(0), np.arange(k)]) if k else np.ones(0)
    project = model.vectors * sign / np.sqrt(model.values)
    explained, error = (model.values / model.trace).tolist() if k else [], model.error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _rows(batch, "x", dims)
            if not len(x):
                continue
            # n x - sums = n (x - whole) - (sums - n whole), and both terms are small
            rest = np.array([int(v) for v in sums - n * whole.astype(object)], np.int64)
            y = x - whole
            most = (int(np.abs(y).max()) + 1) * n
            if most * most * dims < 1 << 63:
                deviation = ((y * n - rest) ** 2).sum(1)
            else:
                deviation = np.array([sum(v * v for v in r) for r in (y.astype(object) * n - rest.astype(object)).tolist()], object)
                if any(v >= 1 << 63 for v in deviation):
                    raise OverflowError("a deviation does not fit a long")
            white = (y - part) @ project
            arrays = [
                batch.column(0).take(pa.array(np.repeat(np.arange(len(x)), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(x) * k, n)), pa.array(np.repeat(deviation.astype(np.int64), k)), pa.array(white.ravel()),
                pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(run, schema)
