"""Whitening of embeddings by the leading eigenvectors of their covariance, found by block Jacobi-Davidson.

The covariance is never formed. Blocks of vectors stay on the executors; a
pass over them centres each block and returns its share of covariance x
directions, which Spark adds up. The driver holds as many directions as the
subspace has, nothing else:

* Rayleigh-Ritz on the subspace gives Ritz pairs and their residuals;
* pairs whose residuals are at double precision are locked, from the largest
  eigenvalue on, and the subspace is kept orthogonal to them;
* for the others the projected correction equation
  ``(I - XX')(V - theta I)(I - XX') t = -r`` is solved roughly by a few steps
  of MINRES, all columns in the same passes, and the subspace grows by the
  corrections; it is cut back to the best Ritz vectors where it gets too large.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finite, joined, limbs, written

#: Vectors of a block at most.
BLOCK = 1 << 13
#: Directions that carry a smaller part of all variance than this count as none.
NOTHING = 1e-11


@dataclass
class Whitening:
    """``whole + part`` is the mean; columns of ``vectors`` are components by falling ``values``."""

    n: int
    sums: list[int]
    whole: np.ndarray
    part: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int = 0


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Approximate solutions of ``A x = b``, column by column in common passes; ``apply(w)`` is A w, A symmetric and another for each column."""
    x, zero = np.zeros_like(b), np.zeros(b.shape[1])
    beta = np.linalg.norm(b, axis=0)
    v, before = b / np.where(beta > 0, beta, 1.0), np.zeros_like(b)
    eta, c, c0, s, s0 = beta.copy(), zero + 1.0, zero + 1.0, zero.copy(), zero.copy()
    w, w0 = np.zeros_like(b), np.zeros_like(b)
    live, back = beta > 0, zero.copy()
    for _ in range(steps):
        p = apply(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - back * before
        ahead = np.linalg.norm(p, axis=0)
        r1, r2, r3 = c * alpha - c0 * s * back, s * alpha + c0 * c * back, s0 * back
        r0 = np.hypot(r1, ahead)
        live &= r0 > 1e-14 * (np.abs(alpha) + back + ahead)
        safe = np.where(live, r0, 1.0)
        c0, s0, c, s = c, s, r1 / safe, ahead / safe
        w, w0 = np.where(live, (v - r3 * w0 - r2 * w) / safe, 0.0), w
        x += np.where(live, c * eta, 0.0) * w
        eta = -s * eta
        live &= ahead > 1e-14 * np.abs(alpha)
        if not live.any():
            break
        before, v, back = v, p / np.where(ahead > 0, ahead, 1.0), ahead
    return x


def _orthonormal(new: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """What the columns add to the spans of ``against``; directions that are in them already are left out."""
    new = new / np.maximum(np.linalg.norm(new, axis=0), 1e-300)
    for _ in range(2):
        for q in against:
            new = new - q @ (q.T @ new)
        u, s, _ = np.linalg.svd(new, full_matrices=False)
        new = u[:, s > 1e-10 * max(1e-300, s.max(initial=0.0))] if s.max(initial=0.0) > 1e-13 else u[:, :0]
    return new


def _refined(q: np.ndarray, aq: np.ndarray, theta: np.ndarray, need: int, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of Ritz vectors with one value, which rounding mixes at will, those combinations first that have the smallest residuals."""
    at = 0
    while at < need:
        end = at + 1
        while end < len(theta) and theta[at] - theta[end] < near:
            end += 1
        if end - at > 1:
            own = slice(at, end)
            _, _, w = np.linalg.svd(aq[:, own] - q[:, own] * theta[own].mean(), full_matrices=False)
            q[:, own], aq[:, own] = q[:, own] @ w[::-1].T, aq[:, own] @ w[::-1].T
            theta[own] = (q[:, own] * aq[:, own]).sum(axis=0)
        at = end
    return q, aq, theta


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, want: int, inner: int = 4, guard: int = 8, most: int = 0, outer: int = 200, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric operator, falling, and unit eigenvectors as columns.

    ``product(w)`` multiplies a block of columns. Stops when every residual is
    below ``eps * max(64, dim)`` times the largest eigenvalue, and fails if
    that takes more than ``outer`` rounds.
    """
    want = min(want, dim)
    most = min(dim, most or max(3 * want, want + 4 * guard))
    q = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, want + guard))))
    aq = product(q)
    locked, values, fresh, over = np.zeros((dim, 0)), np.zeros(0), False, 0
    for _ in range(outer):
        h = q.T @ aq
        theta, u = np.linalg.eigh((h + h.T) / 2)
        theta, u = theta[::-1].copy(), u[:, ::-1]
        q, aq = q @ u, aq @ u
        need = want - len(values)
        q, aq, theta = _refined(q, aq, theta, need, np.finfo(float).eps * max(64, dim) * max(np.abs(values).max(initial=0.0), np.abs(theta).max(initial=0.0)))
        r = aq[:, :need] - q[:, :need] * theta[:need]
        r -= locked @ (locked.T @ r)
        top = max(np.abs(values).max(initial=0.0), np.abs(theta).max(initial=0.0))
        bad = np.linalg.norm(r, axis=0) > np.finfo(float).eps * max(64, dim) * top
        good = need if not bad.any() else int(bad.argmax())
        values, locked = np.r_[values, theta[:good]], np.c_[locked, q[:, :good]]
        q, aq, theta, r, need = q[:, good:], aq[:, good:], theta[good:], r[:, good:], need - good
        near = np.finfo(float).eps * max(64, dim) * top
        late = int((theta > np.sort(values)[::-1][want - over - 1] + near).sum()) if not need else 0
        if not need and not late:  # what is locked once more together, in order
            h = locked.T @ product(locked)
            values, u = np.linalg.eigh((h + h.T) / 2)
            return values[::-1][: want - over], (locked @ u)[:, ::-1][:, : want - over]
        if late:  # a larger eigenvalue that came up late is locked, too
            want, over = want + late, over + late
            continue
        fresh = not fresh and np.linalg.norm(r, axis=0).max() < 1e-11 * top
        if fresh:  # near the end what was carried along is replaced by products, so that its rounding does not stay
            q = _orthonormal(q, locked)
            aq = product(q)
            continue
        if q.shape[1] >= most and locked.shape[1] + q.shape[1] < dim:
            keep = min(q.shape[1], need + guard)
            q, aq = q[:, :keep], aq[:, :keep]
        if locked.shape[1] + q.shape[1] >= dim:
            t = np.zeros((dim, 0))
        else:
            x, shift = np.c_[locked, q[:, :need]], theta[:need]

            def projected(w, x=x, shift=shift):
                w = w - x @ (x.T @ w)
                p = product(w) - w * shift
                return p - x @ (x.T @ p)

            start = -(r - x @ (x.T @ r))
            t = _orthonormal(minres(projected, start, inner), locked, q)
            if not t.shape[1]:  # nothing new from the corrections: the residuals themselves, or chance
                t = _orthonormal(np.c_[start, np.random.default_rng(seed + 1).standard_normal((dim, 1))], locked, q)
            t = t[:, : max(1, min(t.shape[1], most - q.shape[1]))]
        if t.shape[1]:
            q, aq = np.c_[q, t], np.c_[aq, product(t)]
        else:  # the whole space is there: products afresh
            q = _orthonormal(q, locked)
            aq = product(q)
    raise ArithmeticError(f"residuals of {need} eigenpairs are not at double precision after {outer} rounds")


def _blocks(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                own = batch.slice(at, BLOCK)
                x = np.asarray(own.column(1).flatten(), np.int64).reshape(-1, dim)
                yield pa.RecordBatch.from_arrays([pa.array([own.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype("<i8").tobytes()])], ["ids", "x"])

    return run


def _integers(batch: pa.RecordBatch, i: int, dim: int) -> np.ndarray:
    return np.frombuffer(batch.column(1)[i].as_py(), "<i8").reshape(-1, dim)


def _sums(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1, dim + 1), object)
        for batch in batches:
            for i in range(batch.num_rows):
                x = _integers(batch, i, dim)
                kind = np.int64 if np.abs(x).max(initial=0) < 1 << 48 else object
                total[0, 0] += len(x)
                total[0, 1:] += x.sum(axis=0, dtype=kind).astype(object)
        yield limbs(total, "row")

    return run


def _products(dim: int, whole: np.ndarray, part: np.ndarray, w: np.ndarray):
    """Rows (col, parts): sums of y y'w by column of w, and, after the last, of y squared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((w.shape[1] + 1, dim))
        for batch in batches:
            for i in range(batch.num_rows):
                y = (_integers(batch, i, dim) - whole) - part
                total[:-1] += (y @ w).T @ y
                total[-1] += (y * y).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["col", "parts"])

    return run


def _added(parts: DataFrame, rows: int, width: int) -> np.ndarray:
    out = np.zeros((rows, width))
    for r in parts.select("col", F.posexplode("parts").alias("at", "part")).groupBy("col", "at").agg(F.sum("part").alias("part")).collect():
        out[r["col"], r["at"]] = r["part"]
    return out


def integer_blocks(vectors: DataFrame, scale: int = 64, offset: int = 1_000_000) -> tuple[DataFrame, int]:
    """Blocks ``ids, x`` of ``floor(scale * c) + offset``, written, and the vectors' length (0 without vectors)."""
    c = F.transform("embedding", lambda v: v.cast("double") * float(scale))
    fine = F.col("embedding").isNotNull() & finite("embedding")
    own = vectors.filter(fine).select(F.col("vec_id").cast("long").alias("vec_id"), c.alias("c")).filter(F.forall("c", lambda v: F.abs(v) < float(2**62)) & (F.size("c") > 0))
    common = own.groupBy(F.size("c").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim = common["dim"] if common else 0
    rows = own.filter(F.size("c") == dim).select("vec_id", F.transform("c", lambda v: F.floor(v) + F.lit(offset)).alias("x"))
    return written(rows.mapInArrow(_blocks(dim), "ids array<long>, x binary"), "whitening-blocks"), dim


def fit(blocks: DataFrame, dim: int, components: int = 32, inner: int = 4) -> Whitening:
    """The mean and the leading components of all vectors in ``blocks``; components without variance are left out."""
    n, *sums = joined(blocks.mapInArrow(_sums(dim), "row int, limb int, parts array<long>"), "row", 1, dim + 1)[0]
    whole = [(2 * s + n) // (2 * n) if n else 0 for s in sums]
    part = np.array([(s - n * m) / max(1, n) for s, m in zip(sums, whole, strict=True)])
    out = Whitening(n, sums, np.array(whole, np.int64), part, np.zeros(0), np.zeros((dim, 0)), 0.0)
    if not n:
        return out

    def product(w: np.ndarray) -> np.ndarray:
        found = _added(blocks.mapInArrow(_products(dim, out.whole, out.part, w), "col int, parts array<double>"), w.shape[1] + 1, dim) / n
        out.trace, out.passes = float(found[-1].sum()), out.passes + 1
        return found[:-1].T

    values, own = leading_pairs(product, dim, components, inner)
    real = values > NOTHING * out.trace
    out.values, out.vectors = values[real], own[:, real]
    return out


def transform(blocks: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id, deviation, whitened``: squared distance from the mean, times n squared (NULL beyond 64 bits), and an array of components."""
    n, dim, whole, part = model.n, len(model.sums), model.whole, model.part
    over = [s - n * int(m) for s, m in zip(model.sums, whole, strict=True)]
    w = model.vectors / np.sqrt(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                d = _integers(batch, i, dim) - whole
                most = n * int(np.abs(d).max(initial=0)) + max(map(abs, over))
                kind = np.int64 if most * most * dim < 1 << 63 else object
                far = ((d.astype(kind) * n - np.array(over, kind)) ** 2).sum(axis=1)
                z = (d - part) @ w
                far = far if kind is np.int64 else [v if v < 1 << 63 else None for v in far.tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0)[i].values, pa.array(far, pa.int64()), pa.array(list(z), pa.list_(pa.float64()))], ["vec_id", "deviation", "whitened"])

    return blocks.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")


def _gram(k: int, mean: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 if mean is None else k, k))
        for batch in batches:
            z = np.asarray(batch.column(0).flatten(), float).reshape(-1, k)
            total += z.sum(axis=0) if mean is None else (z - mean).T @ (z - mean)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["col", "parts"])

    return run


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """Largest absolute entry of the covariance of ``whitened`` minus the identity."""
    schema, z = "col int, parts array<double>", rows.select("whitened")
    mean = _added(z.mapInArrow(_gram(k, None), schema), 1, k)[0] / n
    return float(np.abs(_added(z.mapInArrow(_gram(k, mean), schema), k, k) / n - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = 32, inner: int = 4) -> DataFrame:
    """``vec_id, component, n, deviation, whitened, explained, identity_error``: one row for each vector and component.

    Needs ``vec_id, embedding``; other columns are not looked at. Vectors that
    are NULL or empty, hold NULL, NaN or infinite entries, or entries of which
    64 times are beyond 2^62, take no part, nor do those of another length than
    most have (the shorter one if two are as frequent). Rows without an id
    stay, with a NULL id; repeated rows count as often as they occur. Entries
    c become ``floor(64 * c) + 1000000``. Components are numbered from 1 by
    falling eigenvalue; there are fewer where fewer directions vary, and no
    rows where none does. ``deviation`` is NULL where it does not fit 64 bits.
    """
    blocks, dim = integer_blocks(vectors)
    model = fit(blocks, dim, components, inner) if dim else None
    if model is None or not len(model.values):
        return blocks.selectExpr("explode(ids) AS vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error").filter("false")
    rows = written(transform(blocks, model), "whitened")
    error = identity_error(rows, model.n, len(model.values))
    part = F.element_at(F.array(*(F.lit(float(e / model.trace)) for e in model.values)), F.col("component"))
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return each.select("vec_id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", part.alias("explained"), F.lit(error).alias("identity_error"))
