"""Embedding whitening with a bidiagonal qd solver.

The covariance is never formed. Tasks reduce their centred rows by blockwise QR to one triangle each; the triangles' rows are dealt
to fewer tasks and reduced again, until one triangle R of dimension x dimension is left, which is all that the driver gets. Householder
reflections bring R to bidiagonal form B; dqds (the shifted differential quotient-difference transform) finds B's singular values to
high relative accuracy; twisted factorisations of B'B give each singular vector, and the reflections carry it back. A
component's eigenvalue is the squared singular value over n.

Entries are first made whole numbers, ``floor(scale * entry) + offset``, so sums and squared deviations are exact and do not depend
on the order of additions. Rows are centred with the exact mean before they are multiplied; the whitened vectors' covariance is merged
from the tasks' own means and centred products.

Defined results: a null vector, one without entries, or one with a null or non-finite entry is dropped, and so is one whose length
is not that of most vectors (ties: the longer one), as it has no place in their covariance; equal rows each count and are
returned; a null key is one more key; an entry whose whole number leaves +-2^62 counts as that bound; a deviation beyond 64 bits
is null; a component with eigenvalue 0 (below rounding) has whitened null and is left out of the identity error, which is null
if no component is left; an empty table gives an empty result. Only key and vector are read. Memory: a few
matrices of dimension x dimension in a task and on the driver, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentlens.llm.common import materialize, read_table

#: Fixed values of the whole-number form.
SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
#: Cells of a block of rows that is reduced at a time; triangles reduced by one task of the next round.
BLOCK_CELLS, FAN_IN = 1 << 19, 16
EPS = float(np.finfo(float).eps)
_BOUND = float(1 << 62)


# --- rows ---------------------------------------------------------------------------------------

def whole_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of all entries, the rows' bounds in them, and which rows are usable."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets).astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0]).to_numpy(zero_copy_only=False).astype(np.float64)
    offsets = offsets - offsets[0]
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    sizes = np.diff(offsets)
    usable = (sizes > 0) & (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore"):
        scaled = np.clip(np.floor(SCALE * np.where(np.isfinite(values), values, 0.0)), -_BOUND, _BOUND)
    return scaled.astype(np.int64) + OFFSET, offsets, usable


def rows_of_length(column: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The usable rows of one length as a matrix, and their places."""
    values, offsets, usable = whole_rows(column)
    places = np.flatnonzero(usable & (np.diff(offsets) == length))
    return values[offsets[places][:, None] + np.arange(length)], places


def exact_sum(matrix: np.ndarray) -> list[int]:
    """Column sums without overflow."""
    most = int(np.abs(matrix).max(initial=0))
    return (matrix if most * max(len(matrix), 1) < 1 << 62 else matrix.astype(object)).sum(axis=0).tolist()


@dataclass
class Means:
    """Number of rows and exact sums of the fit list."""

    n: int
    sums: list[int]

    @property
    def length(self) -> int:
        return len(self.sums)

    def deviations(self, matrix: np.ndarray) -> np.ndarray:
        """``n * x - S``, exactly."""
        largest = max(self.n * int(np.abs(matrix).max(initial=0)), max(map(abs, self.sums)))
        if largest < 1 << 62:
            return matrix * np.int64(self.n) - np.array(self.sums, dtype=np.int64)
        return matrix.astype(object) * self.n - np.array(self.sums, dtype=object)

    def centred(self, deviations: np.ndarray) -> np.ndarray:
        return deviations.astype(np.float64) / self.n


def squared(deviations: np.ndarray) -> list[int | None]:
    """Exact sums of squares of the rows; null beyond 64 bits."""
    most = int(np.abs(deviations).max(initial=0))
    if most * most * max(deviations.shape[1], 1) < 1 << 63:
        return (deviations.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (deviations.astype(object) ** 2).sum(axis=1).tolist()]


# --- blockwise QR -------------------------------------------------------------------------------

class Triangle:
    """Rows taken in blocks, held as the triangle of their QR factorisation."""

    def __init__(self, length: int, cells: int):
        self.length, self.rows = length, max(cells // length, length)
        self.held, self.waiting = [np.zeros((0, length))], 0

    def take(self, rows: np.ndarray) -> None:
        for at in range(0, len(rows), self.rows):
            part = rows[at: at + self.rows]
            self.held.append(part)
            self.waiting += len(part)
            if self.waiting >= self.rows:
                self.reduce()

    def reduce(self) -> np.ndarray:
        stacked = np.vstack(self.held)
        triangle = np.linalg.qr(stacked, mode="r") if len(stacked) > self.length else stacked
        self.held, self.waiting = [triangle], 0
        return triangle


def _row_batch(triangle: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(np.ascontiguousarray(triangle).ravel())
    offsets = pa.array(np.arange(len(triangle) + 1, dtype=np.int32) * triangle.shape[1])
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, flat)], names=["r"])


def _first_triangles(means: Means, cells: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = Triangle(means.length, cells)
        for batch in batches:
            triangle.take(means.centred(means.deviations(rows_of_length(batch.column("v"), means.length)[0])))
        yield _row_batch(triangle.reduce())
    return reduce


def _next_triangles(length: int, cells: int):
    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        triangle = Triangle(length, cells)
        for batch in batches:
            triangle.take(batch.column("r").flatten().to_numpy(zero_copy_only=False).reshape(-1, length))
        yield _row_batch(triangle.reduce())
    return reduce


def triangle_of(given: DataFrame, means: Means, cells: int = BLOCK_CELLS, fan_in: int = FAN_IN) -> np.ndarray:
    """R of all centred rows (column ``v``): dimension x dimension numbers, whatever the number of rows."""
    rows = materialize(given.mapInArrow(_first_triangles(means, cells), "r array<double>"))
    held = rows.count()
    while held > means.length:
        tasks = -(-held // (means.length * fan_in))
        rows = materialize(rows.repartition(tasks).mapInArrow(_next_triangles(means.length, cells), "r array<double>"))
        held = rows.count()
    found = np.array([r["r"] for r in rows.collect()], dtype=float).reshape(-1, means.length)
    square = np.zeros((means.length, means.length))
    square[: len(found)] = found
    return square


# --- the bidiagonal solver ----------------------------------------------------------------------

def _reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """v, beta with (I - beta v v') x on the first axis."""
    size = np.abs(x).max(initial=0.0)
    if size == 0 or not np.any(x[1:]):
        return np.zeros_like(x), 0.0
    v = x / size
    v[0] += np.copysign(np.linalg.norm(v), v[0] if v[0] else 1.0)
    return v, 2.0 / float(v @ v)


def bidiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal a, superdiagonal b and V with ``matrix = U B V'``."""
    m = matrix.copy()
    n = len(m)
    right = np.eye(n)
    for k in range(n):
        v, beta = _reflector(m[k:, k])
        m[k:, k:] -= beta * np.outer(v, v @ m[k:, k:])
        if k + 2 < n:
            v, beta = _reflector(m[k, k + 1:])
            m[k:, k + 1:] -= beta * np.outer(m[k:, k + 1:] @ v, v)
            right[:, k + 1:] -= beta * np.outer(right[:, k + 1:] @ v, v)
    return np.diag(m).copy(), np.diag(m, 1).copy(), right


def _dqds_step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float], float, int] | None:
    """One shifted transform, or the smallest d and its place if the shift was above the smallest eigenvalue."""
    n, qq, ee = len(q), [], []
    d = q[0] - tau
    least, where = d, 0
    for k in range(n - 1):
        s = d + e[k]
        if s > 0:
            t = q[k + 1] / s
            ee.append(e[k] * t)
            d = d * t - tau
        elif tau == 0:
            ee.append(0.0)
            d = q[k + 1]
        else:
            return qq, ee, min(least, d), k
        qq.append(s)
        if d < least:
            least, where = d, k + 1
    qq.append(d)
    return qq, ee, least, where


def qd_eigenvalues(q: np.ndarray, e: np.ndarray) -> list[float]:
    """Eigenvalues of the tridiagonal B'B with qd array (q, e) = (a^2, b^2), by dqds."""
    tiny = (100 * EPS) ** 2
    found, segments = [], [(list(map(float, q)), list(map(float, e)), 0.0)]
    while segments:
        q, e, sigma = segments.pop()
        for _ in range(60 * len(q) + 60):
            while len(q) > 1 and e[-1] <= tiny * (sigma + q[-1]):
                found.append(q.pop() + sigma)
                e.pop()
            if len(q) == 1:
                found.append(q[0] + sigma)
                break
            cut = next((k for k in range(len(e) - 1) if e[k] <= tiny * min(q[k], q[k + 1]) or e[k] < 1e-300), None)
            if cut is not None:
                segments += [(q[: cut + 1], e[:cut], sigma), (q[cut + 1:], e[cut + 1:], sigma)]
                break
            if q[0] * 1.5 < q[-1]:  # graded the wrong way round
                q, e = q[::-1], e[::-1]
            # the smaller eigenvalue of the last 2 x 2 part is above the smallest one, but near it at the end
            high, low, off = q[-2] + (e[-2] if len(e) > 1 else 0.0), q[-1] + e[-1], q[-2] * e[-1]
            half = (high - low) / 2
            root = abs(half) + np.hypot(half, np.sqrt(off))
            tau = max(0.0, min(low - off / root if half > 0 and root else min(high, low) - np.sqrt(off), q[-1]))
            for attempt in range(4):
                tau = tau if attempt < 3 else 0.0
                qq, ee, least, where = _dqds_step(q, e, tau)
                if least >= 0 or tau == 0:
                    break
                tau = tau + least if where == len(q) - 1 and tau + least > 0 else tau / 4
            q, e, sigma = [max(x, 0.0) for x in qq], ee, sigma + tau
        else:
            raise ArithmeticError("dqds did not converge")
    return sorted(found, reverse=True)


def twisted_vector(a: np.ndarray, b: np.ndarray, value: float) -> np.ndarray:
    """The eigenvector of B'B = L D L' at ``value``: both factorisations meet where they miss it least."""
    n = len(a)
    d, low = a * a, b / a[:-1]
    dl = d[:-1] * low
    dll = dl * low
    tiny = np.finfo(float).tiny
    s, p, plus, minus = np.empty(n), np.empty(n), np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for k in range(n - 1):
        top = d[k] + s[k]
        plus[k] = dl[k] / (top if top else tiny)
        s[k + 1] = plus[k] * low[k] * s[k] - value
    p[-1] = d[-1] - value
    for k in range(n - 2, -1, -1):
        under = dll[k] + p[k + 1]
        t = d[k] / (under if under else tiny)
        minus[k] = low[k] * t
        p[k] = p[k + 1] * t - value
    gamma = s + p + value
    gamma[~np.isfinite(gamma)] = np.inf
    z = np.zeros(n)
    k = int(np.argmin(np.abs(gamma)))
    z[k] = 1.0
    for i in range(k - 1, -1, -1):
        z[i] = -plus[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] = -minus[i] * z[i]
    size = np.linalg.norm(z)
    return z / size if np.isfinite(size) and size else np.eye(n)[k]


def _orthogonal(z: np.ndarray, near: list[np.ndarray], t: np.ndarray, value: float) -> np.ndarray:
    """``z`` without its parts along eigenvectors of almost equal values; a lost one is found by inverse iteration."""
    for other in near * 2:
        z = z - (z @ other) * other
    if np.linalg.norm(z) < 1e-2:
        z = np.random.default_rng(len(near)).standard_normal(len(z))
        shifted = t - value * (1 + 4 * EPS) * np.eye(len(z)) - np.finfo(float).tiny * np.eye(len(z))
        for _ in range(3):
            for other in near * 2:
                z = z - (z @ other) * other
            z = np.linalg.lstsq(shifted, z / np.linalg.norm(z), rcond=None)[0]
        for other in near * 2:
            z = z - (z @ other) * other
    return z / np.linalg.norm(z)


def solve(triangle: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of a square matrix (falling) and their right singular vectors as columns."""
    scale = np.abs(triangle).max(initial=0.0)
    n = len(triangle)
    count = min(components, n)
    if scale == 0:
        return np.zeros(count), np.eye(n)[:, :count]
    a, b, right = bidiagonal(triangle / scale)
    size = max(np.abs(a).max(), np.abs(b).max(initial=0.0))
    # a diagonal entry lost to rounding may be taken for the rounding itself
    a = np.where(np.abs(a) < EPS * size, EPS * size, a)
    cuts = [0, *[k + 1 for k in range(n - 1) if abs(b[k]) <= EPS * min(abs(a[k]) + abs(a[k + 1]), size)], n]
    pairs = []
    for at, to in zip(cuts, cuts[1:]):
        values = qd_eigenvalues(a[at:to] ** 2, b[at: to - 1] ** 2)
        pairs += [(value, at, to) for value in values]
    pairs.sort(key=lambda pair: -pair[0])
    vectors: list[np.ndarray] = []
    for value, at, to in pairs[:count]:
        own_a, own_b = a[at:to], b[at: to - 1]
        z = twisted_vector(own_a, own_b, value) if to - at > 1 else np.ones(1)
        near = [v[at:to] for v, (other, start, _) in zip(vectors, pairs) if start == at and abs(other - value) <= 1e-3 * value]
        if near:
            form = np.diag(own_a) + np.diag(own_b, 1)
            z = _orthogonal(z, near, form.T @ form, value)
        vectors.append(np.concatenate((np.zeros(at), z, np.zeros(n - to))))
    full = right @ np.array(vectors).T
    full /= np.linalg.norm(full, axis=0)
    full *= np.where(np.take_along_axis(full, np.abs(full).argmax(axis=0)[None], axis=0)[0] < 0, -1.0, 1.0)
    return np.array([value for value, _, _ in pairs[:count]]) * scale * scale, full


# --- the operator -------------------------------------------------------------------------------

def fit_means(given: DataFrame) -> Means | None:
    """Rows and exact sums of the vectors that most vectors have the length of."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            values, offsets, usable = whole_rows(batch.column("v"))
            sizes = np.diff(offsets)
            for length in np.unique(sizes[usable]).tolist():
                matrix = values[offsets[:-1][usable & (sizes == length)][:, None] + np.arange(length)]
                n, total = held.get(length, (0, [0] * length))
                held[length] = n + len(matrix), [x + y for x, y in zip(total, exact_sum(matrix))]
        rows = [(length, dim, n, str(x)) for length, (n, total) in held.items() for dim, x in enumerate(total)]
        columns = list(zip(*rows)) or [()] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())],
            names=["length", "dim", "n", "total"])

    totals = materialize(given.mapInArrow(sums, "length int, dim int, n long, total string").groupBy("length", "dim").agg(
        F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")))
    usual = totals.where("dim = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if usual is None:
        return None
    # one row for each dimension
    rows = totals.where(F.col("length") == usual["length"]).orderBy("dim").collect()
    return Means(usual["n"], [int(r["total"]) for r in rows])


def identity_error(given: DataFrame, means: Means, directions: np.ndarray) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over all rows."""
    k = directions.shape[1]
    if not k:
        return None

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            matrix = rows_of_length(batch.column("v"), means.length)[0]
            if not len(matrix):
                continue
            white = means.centred(means.deviations(matrix)) @ directions
            own = white.mean(axis=0)
            apart, total = own - mean, n + len(white)
            products += (white - own).T @ (white - own) + np.outer(apart, apart) * (n * len(white) / total)
            mean, n = mean + apart * (len(white) / total), total
        i, j = np.divmod(np.arange(k * k), k)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (np.full(k * k, n), i, j, mean[i], mean[j], products.ravel())], names=["n", "i", "j", "mi", "mj", "product"])

    parts = materialize(given.mapInArrow(moments, "n long, i long, j long, mi double, mj double, product double"))
    centre = {r["i"]: r["m"] for r in parts.where("i = j").groupBy("i").agg((F.sum(F.col("n") * F.col("mi")) / means.n).alias("m")).collect()}
    at = F.create_map(*[F.lit(x) for pair in centre.items() for x in pair])
    moved = F.col("product") + F.col("n") * (F.col("mi") - at[F.col("i")]) * (F.col("mj") - at[F.col("j")])
    entries = parts.groupBy("i", "j").agg((F.sum(moved) / means.n).alias("c"))
    return entries.agg(F.max(F.abs(F.col("c") - (F.col("i") == F.col("j")).cast("double"))).alias("most")).first()["most"]


def whiten(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS,
    cells: int = BLOCK_CELLS, fan_in: int = FAN_IN,
) -> DataFrame:
    """Rows of key, ``component``, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    kind = vectors.schema[key].dataType.simpleString()
    schema = f"_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    given = vectors.select(F.col(key).alias("_id"), F.col(vector).cast("array<double>").alias("v"))
    means = fit_means(given.select("v"))
    if means is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", key)
    triangle = triangle_of(given.select("v"), means, cells, fan_in)
    squares, axes = solve(triangle, components)
    total = float((triangle ** 2).sum())
    # a singular value below the rounding of the triangle is 0
    real = squares > (len(triangle) * EPS) ** 2 * max(float(squares[0]), np.finfo(float).tiny) if len(squares) else np.zeros(0, dtype=bool)
    sizes = np.sqrt(squares[real] / means.n)
    directions = axes[:, real] / sizes
    error = identity_error(given.select("v"), means, directions)
    explained = [float(x) / total if total else None for x in squares]
    columns = np.where(real, np.cumsum(real) - 1, -1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(columns)
        for batch in batches:
            matrix, places = rows_of_length(batch.column("v"), means.length)
            if not len(places):
                continue
            apart = means.deviations(matrix)
            white = means.centred(apart) @ directions
            out = np.full((len(places), k), np.nan)
            out[:, real] = white[:, columns[real]]
            yield pa.RecordBatch.from_arrays([
                batch.column("_id").take(pa.array(np.repeat(places, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(places))),
                pa.array(np.full(len(places) * k, means.n)), pa.array([x for x in squared(apart) for _ in range(k)], pa.int64()),
                pa.array(out.ravel(), from_pandas=True), pa.array(explained * len(places), pa.float64()),
                pa.array([error] * (len(places) * k), pa.float64()),
            ], names=["_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return given.mapInArrow(project, schema).withColumnRenamed("_id", key)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
