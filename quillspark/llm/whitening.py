"""Embedding whitening: distributed covariance, tridiagonal form, bisection, inverse iteration."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.common import stored
from quillspark.llm.vectors import usable, width_of

#: A number in whole 64ths, moved so that usual ones are positive.
STEPS, SHIFT = 64, 1_000_000
#: From here on a double has no 64ths left, so such entries are no numbers that could be told apart.
LIMIT = float(2**46)
#: Components with less variance than this part of the largest are rounding errors of it and can't be scaled to one.
LEAST = 1e-11
ROWS = 4096


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal, side diagonal and Householder vectors of a symmetric matrix."""
    m, mirrors = v.astype(float).copy(), []
    for k in range(len(m) - 2):
        u = m[k + 1 :, k].copy()
        size = np.abs(u).max()
        if size > 0:
            length = size * np.linalg.norm(u / size)
            head = -np.copysign(length, u[0])
            u[0] -= head
            u /= np.abs(u).max()
            u /= np.linalg.norm(u)
            rest = m[k + 1 :, k + 1 :]
            p = rest @ u
            p -= (u @ p) * u
            rest -= 2 * (np.outer(u, p) + np.outer(p, u))
            m[k + 1 :, k], m[k + 1, k] = 0, head
        mirrors.append(u)
    return m.diagonal().copy(), m.diagonal(-1).copy(), mirrors


def counts_below(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of `at`, how many eigenvalues of a tridiagonal matrix are below it: the negative ones in a Sturm sequence."""
    squares = b * b
    tiny = np.finfo(float).tiny * max(1.0, squares.max(initial=0.0))
    q = a[0] - at
    found = (q < 0).astype(int)
    for i in range(1, len(a)):
        q = np.where(np.abs(q) < tiny, -tiny, q)
        q = a[i] - at - squares[i - 1] / q
        found += q < 0
    return found


def leading_eigenvalues(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """The k largest, falling, each halved in until two neighbouring doubles are left or nearly so."""
    sides = np.r_[0, np.abs(b)] + np.r_[np.abs(b), 0]
    place = len(a) - 1 - np.arange(k)  # from below
    low, high = np.full(k, (a - sides).min()), np.full(k, (a + sides).max())
    size = max(abs(low[0]), abs(high[0]))
    low, high = low - 1e-12 * size - 1e-300, high + 1e-12 * size + 1e-300
    for _ in range(200):
        mid = low + (high - low) / 2
        above = counts_below(a, b, mid) <= place
        low, high = np.where(above, mid, low), np.where(above, high, mid)
        if (high - low <= 2 * np.finfo(float).eps * np.maximum(np.abs(low), np.abs(high))).all() or (high - low <= 1e-22 * size).all():
            break
    return low + (high - low) / 2


def _solve(a: np.ndarray, b: np.ndarray, x: float, z: np.ndarray) -> np.ndarray:
    """(T - x) y = z by elimination with row exchanges; a pivot of zero counts as a rounding error."""
    n = len(a)
    d, up, up2, y = (a - x).tolist(), b.tolist() + [0.0], [0.0] * n, z.tolist()
    low = b.tolist()
    tiny = np.finfo(float).eps * (np.abs(a).max() + np.abs(b).max(initial=0.0) + 1e-290)
    for i in range(n - 1):
        if abs(d[i]) >= abs(low[i]):
            if abs(d[i]) < tiny:
                d[i] = tiny
            f = low[i] / d[i]
            d[i + 1] -= f * up[i]
            y[i + 1] -= f * y[i]
        else:
            f = d[i] / low[i]
            d[i], d[i + 1], old = low[i], up[i] - f * d[i + 1], d[i + 1]
            up[i] = old
            if i + 1 < n - 1:
                up2[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            y[i], y[i + 1] = y[i + 1], y[i] - f * y[i + 1]
    if abs(d[-1]) < tiny:
        d[-1] = tiny
    for i in range(n - 1, -1, -1):
        y[i] = (y[i] - (up[i] * y[i + 1] if i + 1 < n else 0.0) - (up2[i] * y[i + 2] if i + 2 < n else 0.0)) / d[i]
    return np.array(y)


def eigenvectors(a: np.ndarray, b: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors of falling eigenvalues as columns, by inverse iteration; in clusters each is made orthogonal to those before."""
    rng = np.random.default_rng(0)
    norm = np.abs(a).max() + 2 * np.abs(b).max(initial=0.0)
    out, begun = np.zeros((len(a), len(values))), 0
    for j, x in enumerate(values):
        if j and values[j - 1] - x > 1e-3 * norm:
            begun = j
        z = rng.normal(size=len(a))
        # equal eigenvalues are moved apart a little, so that each solution has a direction of its own
        x = min(x, values[j - 1] - 10 * np.finfo(float).eps * norm) if j > begun else x
        for step in range(8):
            z = _solve(a, b, x, z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, begun:j] @ (out[:, begun:j].T @ z)
            z /= np.linalg.norm(z)
            around = a * z + np.r_[b * z[1:], 0] + np.r_[0, b * z[:-1]] - x * z
            if step and np.linalg.norm(around) <= 4 * np.finfo(float).eps * norm * np.sqrt(len(a)):
                break
        out[:, j] = z
    return out


def components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k leading eigenvalues of a covariance, falling, and their unit eigenvectors as columns; the largest entry of each is positive. Those without variance are left out."""
    size = np.abs(v).max(initial=0.0)
    if not size > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    a, b, mirrors = tridiagonal(v / size)
    values = leading_eigenvalues(a, b, min(k, len(v)))
    values = values[values > LEAST * values[0]]
    z = eigenvectors(a, b, values)
    for i in range(len(mirrors) - 1, -1, -1):
        if mirrors[i].any():
            z[i + 1 :] -= 2 * np.outer(mirrors[i], mirrors[i] @ z[i + 1 :])
    z /= np.linalg.norm(z, axis=0)
    z *= np.sign(z[np.abs(z).argmax(axis=0), np.arange(z.shape[1])])
    return values * size, z


def whole_steps(values: np.ndarray) -> np.ndarray:
    """x of the entries c: 64 c rounded down, plus a million."""
    return np.floor(values * STEPS).astype(np.int64) + SHIFT


def exact_products(y: np.ndarray) -> list[list[int]]:
    """y.T @ y of whole numbers, exactly: by doubles in runs of rows whose sums stay below 2**53, else by Python's integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    most = int(np.abs(y).max(initial=0)) ** 2
    if most and most >= 2**53:
        wide = y.astype(object)
        return (total + wide.T @ wide).tolist()
    run = min(len(y), 2**53 // max(most, 1), 1 << 20) or 1
    for at in range(0, len(y), run):
        part = y[at : at + run].astype(float)
        total = total + (part.T @ part).astype(np.int64).astype(object)
    return total.tolist()


def deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int | None]:
    """Exact sums of (n y - rest)**2 by row; null beyond a long."""
    most = n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, rest), default=0)
    kind = np.int64 if most**2 * max(y.shape[1], 1) < 2**63 else object
    found = ((y.astype(kind) * n - np.array(rest, kind)) ** 2).sum(axis=1).tolist()
    return [x if x < 2**63 else None for x in found]


def _summed(rows: DataFrame, partial, shape: str) -> dict:
    """What tasks give as (i, j, s), summed up by (i, j): as many rows a task as a matrix has entries, whatever its input."""
    found = rows.mapInArrow(partial, f"i int, j int, s {shape}").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r.i, r.j): r.s for r in found}


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 32) -> DataFrame:
    """Per vector and component: id_col, component, n, deviation, whitened, explained, identity_error.

    Entries c become x = floor(64 c) + 1000000. Three passes over the vectors: sums; products of x less its mean rounded to a
    whole number, which are whole and so summed exactly in any order, and then corrected by the rounding; projection. Tasks send
    a row per entry of a matrix, never vectors. The matrix, whose size is that of the vectors' length alone, is brought to
    tridiagonal form by Householder mirrors on the driver; leading eigenvalues are found by bisection on Sturm counts, components by
    inverse iteration with reorthogonalisation in clusters; they and the mean go to the tasks. identity_error is measured on what is
    returned.

    Defined cases: vectors that are null or hold null or non-finite entries are dropped, and so are those with an entry of 2**46 or
    more, where a double has no 64ths, and those of another length than most have; fewer than k components are returned where vectors
    are shorter or have no variance left (below 1e-11 of the largest); equal vectors all count; a deviation beyond a long is null; null
    and repeated ids are kept as they are; an empty table gives an empty result; other columns are ignored.
    """
    v = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{vector_col}`").alias("_v"))
    width, id_type = width_of(v, F.col("_v")), v.schema["_id"].dataType

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(width, object)
        for batch in batches:
            x = whole_steps(usable(batch.column("_v"), width, LIMIT)[1])
            n, total = n + len(x), total + np.array([int(s) for s in x.astype(object).sum(axis=0)] if np.abs(x).max(initial=0) > 2**40 else x.sum(axis=0).tolist() or [0] * width, object)
        yield _entries([(-1, -1, n)] + [(i, i, int(s)) for i, s in enumerate(total)])

    moments = _summed(v.select("_v"), sums, "decimal(38,0)")
    n = int(moments.pop((-1, -1), 0) or 0)
    s = [int(moments.get((i, i), 0)) for i in range(width)]
    mean = [(2 * x + n) // (2 * n) if n else 0 for x in s]  # rounded
    rest = [x - n * m for x, m in zip(s, mean, strict=True)]
    base = np.array(mean, np.int64)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width), object)
        for batch in batches:
            x = usable(batch.column("_v"), width, LIMIT)[1]
            for at in range(0, len(x), ROWS):
                total = total + np.array(exact_products(whole_steps(x[at : at + ROWS]) - base), object)
        yield _entries([(i, j, int(total[i, j])) for i in range(width) for j in range(i, width)])

    values, vectors, trace = np.zeros(0), np.zeros((width, 0)), 0.0
    if n:
        around = _summed(v.select("_v"), products, "decimal(38,0)")
        cov = np.zeros((width, width))
        for (i, j), p in around.items():  # whole numbers up to the division
            cov[i, j] = cov[j, i] = float(Decimal(n * int(p) - rest[i] * rest[j]) / (n * n))
        values, vectors = components(cov, k)
        trace = float(np.trace(cov))
    offset, scale = np.array(rest, float) / max(n, 1), np.sqrt(values)
    found = len(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits, x = usable(batch.column("_v"), width, LIMIT)
            y = whole_steps(x) - base
            w = ((y - offset) @ vectors / scale).ravel()
            yield pa.RecordBatch.from_arrays([batch.column("_id").filter(pa.array(fits)), pa.array(deviations(y, n, rest), pa.int64()), pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * found, w)], names=["_id", "deviation", "w"])

    kinds = T.StructType([T.StructField("_id", id_type), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    made = v.where(F.lit(found > 0)).mapInArrow(project, kinds)
    out = stored(made)

    middle = out.agg(*[F.avg(F.col("w")[i]) for i in range(found)]).first() if found else ()
    centre = np.array([m or 0.0 for m in middle])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((found, found))
        for batch in batches:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(-1, found) - centre
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(found), found), pa.int32()), pa.array(np.tile(np.arange(found), found), pa.int32()), pa.array(total.ravel())], names=["i", "j", "s"])

    error = 0.0
    if found:
        error = max(abs(x / n - (i == j)) for (i, j), x in _summed(out.select("w"), spread, "double").items())
    shares = F.array(*[F.lit(float(e / trace)) for e in values]) if found else F.array().cast("array<double>")
    return out.select(F.col("_id").alias(id_col), "deviation", F.posexplode("w").alias("_c", "whitened")).select(
        id_col, (F.col("_c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("_c")).alias("explained"), F.lit(float(error)).alias("identity_error")
    )


def _entries(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    i, j, s = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(x) for x in s], pa.decimal128(38, 0))], names=["i", "j", "s"])
