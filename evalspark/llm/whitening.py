"""Embedding whitening by a Jacobi-Davidson eigensolver over distributed products.

The covariance is never formed: a job adds up Z'(ZU) over blocks of centred
vectors, for a few columns U at a time. Around these products the driver
works with matrices as tall as a vector is long: Rayleigh-Ritz in a search
subspace, locking of pairs whose residual has reached double precision, and
for the others the correction equation

    (I - QQ')(V - e I)(I - QQ') t = -r,   Q: locked and current vectors,

solved by MINRES. All pairs advance together, so an inner step is one job.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import materialise

COMPONENTS = 4
SCALE = 256              # entries become floor(SCALE * c)
BLOCK_ROWS = 2048        # vectors of a product's block
TASKS = 2048             # partial products that reach the driver, at most
GUARD = 4                # search directions beyond the wanted ones at start and restart
WIDEST = 40              # columns of the search subspace before a restart
INNER = 12               # MINRES steps of a correction
OUTER = 100
EPS = float(np.finfo(float).eps)

Product = Callable[[np.ndarray], np.ndarray]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _blocks(fit: DataFrame, dim: int) -> DataFrame:
    """Written table (x binary): blocks of BLOCK_ROWS vectors as 64-bit integers."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), dim).astype("<i8")
            parts = [x[a:a + BLOCK_ROWS].tobytes() for a in range(0, len(x), BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary())], ["x"])

    return materialise(fit.select("x").mapInArrow(run, "x binary")).coalesce(TASKS)


def _partials(blocks: DataFrame, dim: int, add: Callable[[np.ndarray], np.ndarray]) -> list[np.ndarray]:
    """One array of 64-bit items per task: the sum of ``add(x)`` over its blocks, in the order of the tasks.

    No more than TASKS arrays of the size of a few vectors reach the driver.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column("x"):
                part = add(np.frombuffer(raw.as_buffer(), "<i8").reshape(-1, dim))
                part = part.astype(np.longdouble) if part.dtype == float else part
                total = part if total is None else total + part
        if total is not None:
            out = total.astype(float) if total.dtype == np.longdouble else total
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())],
                                             ["task", "v"])

    got = blocks.mapInArrow(run, "task int, v binary").toArrow().sort_by("task")
    return [np.frombuffer(v.as_buffer(), np.int64) for v in got.column("v")]


def _added(parts: list[np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    return np.sum([p.view(float).astype(np.longdouble) for p in parts], axis=0).astype(float).reshape(shape)


def exact_sums(blocks: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of vectors and their sums per dimension, as whole numbers of any size."""
    def add(x: np.ndarray) -> np.ndarray:   # the halves of 64-bit numbers don't overflow below 2^31 vectors a task
        return np.concatenate([[len(x)], (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)])

    parts = _partials(blocks, dim, add)
    total = [sum(int(p[i]) for p in parts) for i in range(1 + 2 * dim)]
    return total[0], [(high << 32) + low for high, low in zip(total[1:1 + dim], total[1 + dim:])]


def _orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """Columns of ``t`` made orthonormal to each other and to ``against``; what vanishes is left out."""
    kept: list[np.ndarray] = []
    for v in t.T:
        size = np.linalg.norm(v)
        if not size > 0:
            continue
        v = v / size
        for _ in range(3):
            for basis in (*against, np.array(kept).T if kept else np.zeros((len(v), 0))):
                v = v - basis @ (basis.T @ v)
            left = np.linalg.norm(v)
            if left < 1e-10:
                break
            v = v / left
        else:
            kept.append(v)
    return np.array(kept).T if kept else np.zeros((len(t), 0))


def minres(apply: Product, right: np.ndarray, stop: np.ndarray, steps: int = INNER) -> np.ndarray:
    """Minimum residual solutions of symmetric systems, a column each, solved side by side.

    ``apply`` gives the operators' products with their columns; a column is
    done when its residual falls under ``stop``.
    """
    beta = np.linalg.norm(right, axis=0)
    safe = np.where(beta > 0, beta, 1)
    v, v_old = right / safe, np.zeros_like(right)
    w, w_old, x = np.zeros_like(right), np.zeros_like(right), np.zeros_like(right)
    eta, cos, cos_old = beta.copy(), np.ones_like(beta), np.ones_like(beta)
    sin, sin_old, live = np.zeros_like(beta), np.zeros_like(beta), beta > 0
    beta = np.zeros_like(beta)
    for _ in range(steps):
        live = live & (np.abs(eta) > stop)
        if not live.any():
            break
        av = apply(v)
        alpha = (v * av).sum(axis=0)
        new = av - alpha * v - beta * v_old
        size = np.linalg.norm(new, axis=0)
        delta = cos * alpha - cos_old * sin * beta
        rho = np.sqrt(delta * delta + size * size)
        rho = np.where(rho > 0, rho, 1)
        second, third = sin * alpha + cos_old * cos * beta, sin_old * beta
        cos_old, cos, sin_old, sin = cos, delta / rho, sin, size / rho
        w_old, w = w, (v - third * w_old - second * w) / rho
        x = np.where(live, x + cos * eta * w, x)
        eta = np.where(live, -sin * eta, eta)
        v_old, v, beta = v, new / np.where(size > 0, size, 1), size
        live &= size > 0
    return x


def eigenpairs(product: Product, dim: int, wanted: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, unit vectors as columns, residual norms) of the largest pairs of a symmetric operator, by falling value.

    Pairs are locked in order, each when its residual is at most
    max(64, dim) * eps times the largest value. A pair that doesn't get
    there within OUTER rounds is an error. Pairs that aren't told from the
    operator's null space at that precision aren't returned.
    """
    k = min(wanted, dim)
    basis = _orthonormal(np.random.default_rng(seed).normal(size=(dim, min(dim, k + GUARD))))
    image = product(basis)
    locked, values, norms = np.zeros((dim, 0)), [], []
    for _ in range(OUTER):
        small = basis.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        top = max([*values, *np.abs(theta[:1])], default=0.0)
        enough = max(64, dim) * EPS * top
        u, vu = basis @ s, image @ s
        r = vu - u * theta
        r -= locked @ (locked.T @ r)
        size = np.linalg.norm(r, axis=0)
        done = 0
        while done < min(k - len(values), len(theta)) and size[done] <= enough:
            done += 1
        for i in range(done):
            if theta[i] <= 2 * enough:
                return np.array(values), locked, np.array(norms)
            values.append(float(theta[i]))
            norms.append(float(size[i]))
            locked = np.column_stack([locked, u[:, i] / np.linalg.norm(u[:, i])])
        left = k - len(values)
        if not left or done == len(theta):
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order], np.array(norms)[order]
        keep = u.shape[1] if u.shape[1] + left <= WIDEST else done + left + GUARD
        basis, image = u[:, done:keep], vu[:, done:keep]
        now = slice(done, done + left)
        near, want, off = theta[now], u[:, now], r[:, now]
        known = np.column_stack([locked, want])

        def project(t: np.ndarray) -> np.ndarray:
            return t - known @ (known.T @ t)

        need = np.where(size[now] > enough, size[now], np.inf)     # pairs that wait for an earlier one stay as they are
        accuracy = np.maximum(enough / 4, 1e-3 * size[now])
        t = minres(lambda v: project(product(v) - v * near), -project(off), np.where(np.isinf(need), np.inf, accuracy))
        fresh = _orthonormal(np.column_stack([t, off]), locked, basis)[:, :left]
        if not fresh.shape[1]:      # the subspace is all there is
            fresh = _orthonormal(np.random.default_rng(seed + len(values)).normal(size=(dim, left)), locked, basis)[:, :left]
        if fresh.shape[1]:
            basis, image = np.column_stack([basis, fresh]), np.column_stack([image, product(fresh)])
    raise RuntimeError(f"{k - len(values)} of {k} eigenpairs didn't reach double precision in {OUTER} rounds")


@dataclass(frozen=True)
class Model:
    """n vectors with sums S, the covariance's leading pairs, and how far the whitened covariance is from the identity."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def quantised(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): whole numbers floor(SCALE * c) of the vectors that aren't null and hold finite entries only."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return (vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter(F.col("v").isNotNull() & ~bad & (F.size("v") > 0))
            .select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x")))


def fit(rows: DataFrame, dim: int, components: int = COMPONENTS) -> Model:
    """The model of the distinct vectors ``x`` (of length ``dim``) of ``rows``."""
    blocks = _blocks(rows.select("x").distinct(), dim)
    n, sums = exact_sums(blocks, dim)
    mean = np.array([s / n for s in sums])
    trace = float(_added(_partials(blocks, dim, lambda x: np.array([np.square(x - mean).sum()])), (1,))[0]) / n

    def product(u: np.ndarray) -> np.ndarray:
        def add(x: np.ndarray) -> np.ndarray:
            z = x - mean
            return z.T @ (z @ u)

        return _added(_partials(blocks, dim, add), u.shape) / n

    values, vectors, residuals = eigenpairs(product, dim, components) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)), np.zeros(0))
    flip = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(values))]) if len(values) else np.ones(0)
    vectors = vectors * flip
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ vectors / np.sqrt(values)
        return np.vstack([w.sum(axis=0), w.T @ w])

    error = 0.0
    if k:
        m = _added(_partials(blocks, dim, moments), (k + 1, k)) / n
        error = float(np.abs(m[1:] - np.outer(m[0], m[0]) - np.eye(k)).max())
    return Model(n, sums, values, vectors, residuals, trace, error)


def _deviation(x: np.ndarray, n: int, sums: list[int], mean: np.ndarray) -> pa.Array:
    """Sum of (n*x - S)^2 per row, exact; null beyond 64 bits.

    Arithmetic modulo 2^64 is exact for results under 2^63; a floating
    estimate tells which are, and whole numbers of any size decide at the edge.
    """
    s = np.array([v % (1 << 64) for v in sums], np.uint64)
    off = x.view(np.uint64) * np.uint64(n % (1 << 64)) - s
    out = (off * off).sum(axis=1, dtype=np.uint64).view(np.int64).copy()
    about = np.square((x - mean) * float(n)).sum(axis=1) / 2.0 ** 63
    over = about > 1 + 1e-6
    for i in np.flatnonzero(~over & (about > 1 - 1e-6)):
        true = sum((n * int(a) - b) ** 2 for a, b in zip(x[i], sums))
        over[i] = true >= 1 << 63
    return pa.array(out, mask=over)


def project(rows: DataFrame, model: Model, dim: int) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): one row per vector and component."""
    k, mean = len(model.values), model.mean
    n, sums = model.n, model.sums
    turn = model.vectors / np.sqrt(model.values)
    share = model.values / model.trace if k else model.values
    error = model.identity_error

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(a, BLOCK_ROWS)
                x = np.ascontiguousarray(_matrix(batch.column("x"), dim))
                m = len(x)
                row = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id").take(row), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)),
                     _deviation(x, n, sums, mean).take(row), pa.array(((x - mean) @ turn).reshape(-1)), pa.array(np.tile(share, m)),
                     pa.array(np.full(m * k, error))],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(
        run, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of every usable row of ``vectors`` (vec_id, embedding), a row per component.

    Rows whose vector is null, empty, or holds a null or non-finite entry are
    left out. Entries c become floor(256 c) (beyond 64 bits: the nearest long). Mean and
    covariance are those of the distinct vectors, each once. Vectors of
    different length are different spaces: each length is fitted by itself.
    Components are numbered from 1 by falling eigenvalue; a component whose
    eigenvalue isn't told from 0 in double precision can't be whitened and
    has no rows (equal vectors only: none). The sign of a component makes its
    largest entry positive. deviation is null where the sum passes 64 bits.
    Repeated rows are returned as often as they come; other columns aren't read.
    """
    rows = materialise(quantised(vectors))
    dims = sorted(r["dim"] for r in rows.select(F.size("x").alias("dim")).distinct().collect())
    out = rows.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    for i, dim in enumerate(dims):
        own = rows.filter(F.size("x") == dim)
        part = project(own, fit(own, dim, components), dim)
        out = part if i == 0 else out.union(part)
    return out
