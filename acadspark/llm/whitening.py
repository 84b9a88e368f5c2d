"""Whitening of embeddings: distributed centred covariance, a small dense eigenproblem, and a broadcast projection."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acadspark.llm.common import discard, staged

COMPONENTS = 16
SCALE = 64
SHIFT = 1_000_000
LARGEST = 1 << 53  # larger steps are clipped: doubles hold no finer ones there
LOW = 26  # sums are kept as high parts and LOW low bits, so that no sum of longs overflows
EPS = np.finfo(float).eps


# --- symmetric eigenproblem of one small matrix ----------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder reduction of a symmetric matrix: diagonal, side diagonal, and the unit vectors of the reflections."""
    a = a.copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        size = np.linalg.norm(v)
        if np.linalg.norm(v[1:]) == 0:
            mirrors.append(np.zeros_like(v))
            continue
        v[0] += np.copysign(size, v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        p -= (p @ v) * v
        rest -= 2 * (np.outer(v, p) + np.outer(p, v))
        a[k + 1:, k] -= 2 * (v @ a[k + 1:, k]) * v
        a[k, k + 1:] = a[k + 1:, k]
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def count_below(d: np.ndarray, e: np.ndarray, x: np.ndarray, tiny: float) -> np.ndarray:
    """Sturm count: eigenvalues of the tridiagonal matrix that are smaller than each entry of ``x``."""
    q = d[0] - x
    below = (q < 0).astype(np.int64)
    for i in range(1, len(d)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = d[i] - x - e[i - 1] ** 2 / q
        below += q < 0
    return below


def leading_values(d: np.ndarray, e: np.ndarray, count: int) -> np.ndarray:
    """The ``count`` largest eigenvalues, falling, by bisection on Sturm counts."""
    side = np.concatenate([[0], np.abs(e), [0]])
    reach = side[:-1] + side[1:]
    low, high = np.full(count, (d - reach).min()), np.full(count, (d + reach).max())
    norm = max(abs(low[0]), abs(high[0]), np.finfo(float).tiny)
    low, high = low - norm * 4 * EPS, high + norm * 4 * EPS
    rank = len(d) - np.arange(count)  # so many eigenvalues are not above the one that is looked for
    for _ in range(120):
        mid = (low + high) / 2
        enough = count_below(d, e, mid, norm * EPS * EPS) >= rank
        high, low = np.where(enough, mid, high), np.where(enough, low, mid)
        if np.all(high - low <= 2 * EPS * np.maximum(np.abs(low), np.abs(high)) + norm * EPS * EPS):
            break
    return (low + high) / 2


def shifted_solver(d: np.ndarray, e: np.ndarray, x: float, tiny: float):
    """Solver of (T - x) y = b for a tridiagonal T: elimination with row exchanges, vanishing pivots set to ``tiny``."""
    n = len(d)
    u0, u1, u2 = d - x, np.append(e, 0.0), np.zeros(n)
    steps = []
    for i in range(n - 1):
        below = e[i]
        swap = abs(u0[i]) < abs(below)
        if swap:
            factor = u0[i] / below
            u0[i], u1[i], u2[i], old = below, u0[i + 1], u1[i + 1], u1[i]
            u0[i + 1] = old - factor * u1[i]
            u1[i + 1] = -factor * u2[i]
        else:
            u0[i] = u0[i] if abs(u0[i]) > tiny else tiny
            factor = below / u0[i]
            u0[i + 1] -= factor * u1[i]
        steps.append((swap, factor))
    u0[-1] = u0[-1] if abs(u0[-1]) > tiny else tiny

    def solve(b: np.ndarray) -> np.ndarray:
        y = b.copy()
        for i, (swap, factor) in enumerate(steps):
            if swap:
                y[i], y[i + 1] = y[i + 1], y[i]
            y[i + 1] -= factor * y[i]
        for i in range(n - 1, -1, -1):
            if i + 1 < n:
                y[i] -= u1[i] * y[i + 1]
            if i + 2 < n:
                y[i] -= u2[i] * y[i + 2]
            y[i] /= u0[i]
            if (top := np.abs(y[i])) > 1e100:  # lengths are free
                y /= top
        return y / np.linalg.norm(y)

    return solve


def leading_components(v: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``count`` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    Vectors of eigenvalues that lie close together (or are equal) are made orthogonal within their cluster after every
    step of the inverse iteration; any basis of such a cluster is right.
    """
    n = len(v)
    if n == 1:
        return v[0, :1].copy(), np.ones((1, 1))
    scale = np.abs(v).max()
    if scale == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    whole, v = v, v / scale
    d, e, mirrors = tridiagonal(v)
    values = leading_values(d, e, count)
    norm = max(np.abs(d).max() + 2 * np.abs(e).max(initial=0), np.finfo(float).tiny)
    random = np.random.default_rng(11)
    found = np.zeros((n, count))
    first = 0
    for k in range(count):
        if k and values[k - 1] - values[k] > 1e-3 * norm:
            first = k
        near = values[k] - (k - first) * 2 * EPS * norm  # equal values get shifts of their own
        solve = shifted_solver(d, e, near, EPS * norm)
        y = random.standard_normal(n)
        for _ in range(6):
            y = solve(y)
            for _ in range(2):
                y -= found[:, first:k] @ (found[:, first:k].T @ y)
            if (size := np.linalg.norm(y)) < 1e-8:
                y = random.standard_normal(n)
                continue
            y /= size
        found[:, k] = y
    for j in range(len(mirrors) - 1, -1, -1):
        part = found[j + 1:]
        part -= 2 * np.outer(mirrors[j], mirrors[j] @ part)
    for k in range(count):  # all found vectors, as clusters may touch
        for _ in range(2):
            found[:, k] -= found[:, :k] @ (found[:, :k].T @ found[:, k])
            found[:, k] /= np.linalg.norm(found[:, k])
    values = np.einsum("ik,ij,jk->k", found, whole, found)
    order = np.argsort(-values, kind="stable")
    return values[order], found[:, order]


# --- tables ----------------------------------------------------------------------------------------------------------


def _lists(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values, offsets and validity of an Arrow list column; null entries become NaN."""
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).astype(float)
    size = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    return values, np.concatenate([[0], np.cumsum(size)]), np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)


def _steps(it):
    for batch in it:
        values, offsets, there = _lists(batch.column("embedding"))
        bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
        keep = there & (bad[offsets[1:]] == bad[offsets[:-1]])
        with np.errstate(invalid="ignore"):
            whole = np.clip(np.floor(values * SCALE), -LARGEST, LARGEST)
        step = np.where(np.isfinite(whole), whole, 0).astype("<i8")
        raw = step.tobytes()
        at = np.flatnonzero(keep)
        packed = [raw[8 * offsets[i]: 8 * offsets[i + 1]] for i in at]
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(at)), pa.array(packed, pa.binary())], names=["vec_id", "steps"])


def quantised(vectors: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, steps) of the usable rows, and the dimension. ``steps``: floor(64 c) as packed longs; 1,000,000 is left out,
    as every result is the same for shifted vectors. Vectors of another length than the most frequent one (the longer of
    equally frequent ones) have no place in a covariance and are left out; so are empty ones."""
    kind = dict(vectors.dtypes)["vec_id"]
    rows = staged(vectors.select("vec_id", "embedding").mapInArrow(_steps, f"vec_id {kind}, steps binary"), "steps")
    sizes = rows.groupBy(F.octet_length("steps").alias("size")).agg(F.count(F.lit(1)).alias("n")).filter("size > 0")
    most = sizes.orderBy(F.desc("n"), F.desc("size")).limit(1).collect()
    size = most[0]["size"] if most else 0
    return rows.filter(F.octet_length("steps") == size), size // 8


def _matrix(batch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("steps").to_pylist()), "<i8").reshape(-1, d)


def fitted_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums per dimension, combined in tasks and by Spark; d + 1 rows reach the driver."""

    def run(it):
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in it:
            y = _matrix(batch, d)
            n += len(y)
            high += (y >> LOW).sum(axis=0)
            low += (y & ((1 << LOW) - 1)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([0, *high]), pa.array([n, *low])], names=["i", "high", "low"])

    parts = fit.mapInArrow(run, "i int, high long, low long").groupBy("i").agg(F.sum("high").alias("high"), F.sum("low").alias("low")).collect()
    total = {r["i"]: (r["high"] << LOW) + r["low"] for r in parts}
    return total.get(-1, 0), [total.get(i, 0) for i in range(d)]


def centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """n y - S, exactly, and y - S / n. Longs where no entry can overflow, else Python integers."""
    top = n * int(max(y.max(initial=0), -y.min(initial=0))) + max(map(abs, sums), default=0)
    kind = np.int64 if top * top * max(1, y.shape[1]) < 1 << 62 else object
    moved = y.astype(kind) * n - np.array(sums, kind)
    return moved, (moved / n).astype(float)


def covariance(fit: DataFrame, d: int, n: int, size: int, of) -> np.ndarray:
    """Covariance, divisor n, of ``of(y)`` (``size`` columns) over the fit list, centred before multiplying.

    Two passes: the mean, then products of what is left. A task adds up its share; Spark adds the tasks' entries, of which
    size * size reach the driver. Where ``of`` is centred already, the measured mean takes away what rounding left.
    """

    def means(it):
        total = np.zeros(size)
        for batch in it:
            total += of(_matrix(batch, d)).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["i", "s"])

    mean = np.zeros(size)
    for r in fit.mapInArrow(means, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        mean[r["i"]] = r["s"] / n

    def products(it):
        total = np.zeros((size, size))
        for batch in it:
            z = of(_matrix(batch, d)) - mean
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.ravel())], names=["i", "s"])

    out = np.zeros(size * size)
    for r in fit.mapInArrow(products, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect():
        out[r["i"]] = r["s"] / n
    out = out.reshape(size, size)
    return (out + out.T) / 2


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Whitened coordinates of ``vectors`` (vec_id, embedding) on the leading principal components.

    Returns (vec_id, component, n, deviation, whitened, eigenvalue, explained, identity_error) for each usable row and
    component from 1 up to ``components``; rows of null vectors or with null or non-finite entries are left out, as are
    vectors of another length than most. The fit list holds every distinct vector of steps floor(64 c) once, whatever its
    number of copies. Null and repeated vec_id are kept as they are, other columns are not read. Components whose
    eigenvalue is zero up to rounding do not exist: fewer are returned (none for one distinct vector, none for an empty
    table). A deviation beyond 63 bits is null. Steps beyond 2^53 are clipped there.

    Only sums of d and d * d entries reach the driver, which solves the d by d eigenproblem; the projection (d times
    ``components`` doubles) goes to every task. Staged tables are written while the plan is built.
    """
    kind = dict(vectors.dtypes)["vec_id"]
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, eigenvalue double, explained double, identity_error double"
    rows, d = quantised(vectors)
    empty = vectors.sparkSession.createDataFrame([], schema)
    if d == 0:
        return empty
    fit = staged(rows.select("steps").distinct(), "fit")
    n, sums = fitted_sums(fit, d)
    v = covariance(fit, d, n, d, lambda y: centred(y, n, sums)[1])
    values, vectors_ = leading_components(v, min(components, d))
    trace = float(np.trace(v))
    real = int(np.sum(values > 8 * d * EPS * max(trace, 0)))
    if trace <= 0 or real == 0:
        return empty
    values = values[:real]
    weights = vectors_[:, :real] / np.sqrt(values)
    spread = covariance(fit, d, n, real, lambda y: centred(y, n, sums)[1] @ weights)
    error = float(np.abs(spread - np.eye(real)).max())
    explained = values / trace

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            moved, z = centred(_matrix(batch, d), n, sums)
            square = (moved * moved).sum(axis=1)
            if square.dtype == object:
                square = np.array([x if x < 1 << 63 else None for x in square], object)
            m = len(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), real))), pa.array(np.tile(np.arange(1, real + 1, dtype=np.int32), m)),
                 pa.array(np.full(m * real, n)), pa.array(np.repeat(square, real), pa.int64()), pa.array((z @ weights).ravel()),
                 pa.array(np.tile(values, m)), pa.array(np.tile(explained, m)), pa.array(np.full(m * real, error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "eigenvalue", "explained", "identity_error"])

    out = rows.mapInArrow(run, schema)
    discard(fit)
    return out


def whitening_report(vectors: DataFrame) -> DataFrame:
    """The rows of ``whiten`` on 16 components."""
    return whiten(vectors)
