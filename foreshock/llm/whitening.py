"""Whitening of embeddings: a covariance summed over tasks, its leading eigenvectors, and a projection sent to every task.

Entries are taken to whole numbers (``SCALE`` steps a unit, ``SHIFT`` added), so sums by dimension are exact and the same on any cluster. Rows are
centred by the exact mean before they are multiplied; each task adds up one matrix, and the matrices are added row by row. The matrix, which
has the size of the dimensions squared whatever the number of rows, is reduced to a tridiagonal one by Householder reflections; Sturm counts bisect
its leading eigenvalues; inverse iteration gives their vectors, orthogonalised again within clusters of close values;
the reflections carry them back. The covariance of the result is summed by means and centred products that tasks merge.

Defined results: a vector that is null, or holds null, NaN, infinity or an entry beyond ``LARGEST`` steps, is dropped, and so is an empty one and
one whose length is not the commonest (of equally common lengths the larger holds). Rows are taken as they come, whatever their ids, null ids
included. Components whose eigenvalue is nothing but rounding (``TINY`` of the trace for each dimension) have no whitened value and are left out, so equal
vectors only, or one vector, give no rows. ``deviation`` is null where it exceeds a long. Empty tables give empty results; other columns play
no part. Rows of more than ``MOST`` dimensions are an error, since the matrix is held by one process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCALE, SHIFT = 64.0, 1_000_000
LARGEST = 1 << 40
#: Most dimensions: a matrix of 128 MB.
MOST = 4096
TINY = 1e-14
#: Rows multiplied at once.
_SLICE = 4096


# ---- vectors ---------------------------------------------------------------------------------------------


def whole(vectors: pa.Array, dim: int | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which vectors are kept, and their entries as whole numbers, one array of rows for each run of equal lengths."""
    vectors = vectors.cast(pa.large_list(pa.float64()))
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False), np.int64)
    flat = pc.list_flatten(vectors)
    values = np.floor(SCALE * flat.to_numpy(zero_copy_only=False))  # null is NaN here
    good = np.isfinite(values) & (np.abs(np.where(np.isfinite(values), values, 0)) < LARGEST)
    ends = np.cumsum(sizes)
    bad = np.concatenate([[0], np.cumsum(~good)])
    keep = (sizes > 0) & (bad[ends] == bad[ends - sizes])
    keep &= sizes == dim if dim is not None else True
    rows = np.flatnonzero(keep)
    out = []
    for run in np.split(rows, np.flatnonzero(np.diff(sizes[rows])) + 1) if len(rows) else []:
        at = (ends - sizes)[run][:, None] + np.arange(sizes[run[0]])
        out.append(values[at].astype(np.int64) + SHIFT)
    return rows, out


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of vectors and sums by dimension, for each length."""
    total: dict[int, list] = {}
    for batch in batches:
        for x in whole(batch.column("vector"))[1]:
            held = total.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64)])
            held[0] += len(x)
            held[1] += x.sum(axis=0)
    for dim, (n, s) in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([dim] * dim, pa.int32()), pa.array(range(dim), pa.int32()), pa.array([n] * dim, pa.int64()), pa.array(s)], ["dim", "i", "n", "s"]
        )


def fit_sums(vectors: DataFrame) -> tuple[int, int, np.ndarray]:
    """Number of kept vectors, their length and the exact sums by dimension. ``dim`` numbers come to the driver."""
    parts = vectors.mapInArrow(_sums, "dim INT, i INT, n BIGINT, s BIGINT")
    sums = parts.groupBy("dim", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    first = sums.groupBy("dim").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if first is None:
        return 0, 0, np.zeros(0, np.int64)
    if first["dim"] > MOST:
        raise ValueError(f"vectors of {first['dim']} dimensions; at most {MOST}")
    rows = sums.where(F.col("dim") == first["dim"]).orderBy("i").collect()
    return first["n"], first["dim"], np.array([r["s"] for r in rows], np.int64)


def _product_rows(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(len(m)), pa.int32()), pa.array(list(m), pa.list_(pa.float64()))], ["i", "row"])


def _covariances(dim: int, mean: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_ = np.zeros((dim, dim)), False
        for batch in batches:
            for x in whole(batch.column("vector"), dim)[1]:
                for at in range(0, len(x), _SLICE):
                    centred = x[at : at + _SLICE] - mean
                    total += centred.T @ centred
                    any_ = True
        if any_:
            yield _product_rows(total)

    return run


def _add_rows(key: tuple, rows: pa.Table) -> pa.Table:
    total = np.sum(np.stack(rows.column("row").to_numpy()), axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "row": pa.array([total], pa.list_(pa.float64()))})


def covariance(vectors: DataFrame, n: int, dim: int, s: np.ndarray) -> np.ndarray:
    """Covariance of the kept vectors, divisor ``n``. A matrix of ``dim`` rows comes to the driver."""
    parts = vectors.mapInArrow(_covariances(dim, s / n), "i INT, row ARRAY<DOUBLE>")
    rows = parts.groupBy("i").applyInArrow(_add_rows, "i INT, row ARRAY<DOUBLE>").orderBy("i").collect()
    return np.array([r["row"] for r in rows]) / n


# ---- eigenvectors ----------------------------------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Diagonal and off-diagonal of a symmetric matrix after Householder reflections, and the reflections."""
    a, d = np.array(a, float), len(a)
    reflections = []
    for k in range(d - 2):
        v = a[k + 1 :, k].copy()
        scale = np.abs(v).max()
        if scale > 0:
            v /= scale
            v[0] += np.copysign(np.linalg.norm(v), v[0])
            v /= np.linalg.norm(v)
            block = a[k + 1 :, k + 1 :]
            p = block @ v
            q = p - (v @ p) * v
            block -= 2 * (np.outer(v, q) + np.outer(q, v))
            column = a[k + 1 :, k].copy()
            a[k + 1 :, k] = a[k, k + 1 :] = column - 2 * (v @ column) * v
        else:
            v = np.zeros(d - k - 1)
        reflections.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), reflections


def carry_back(z: np.ndarray, reflections: list[np.ndarray]) -> np.ndarray:
    """Vectors (columns) of the tridiagonal matrix as vectors of the one it was made from."""
    z, d = z.copy(), len(z)
    for k in range(len(reflections) - 1, -1, -1):
        v = reflections[k]
        z[k + 1 :] -= 2 * np.outer(v, v @ z[k + 1 :])
    return z


def sturm_counts(diag: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Number of eigenvalues below each value of ``at``."""
    least = np.finfo(float).tiny / np.finfo(float).eps
    q = np.full(len(at), 1.0)
    count = np.zeros(len(at), np.int64)
    squares = np.concatenate([[0.0], off**2])
    for d, b in zip(diag, squares):
        q = d - at - b / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(diag: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues, falling, bisected all at once until no number lies between the bounds."""
    d = len(diag)
    radius = np.concatenate([[0.0], np.abs(off)]) + np.concatenate([np.abs(off), [0.0]])
    edge = np.abs(diag).max() + radius.max()
    pad = 4 * d * np.finfo(float).eps * edge
    low, high = np.full(k, (diag - radius).min() - pad), np.full(k, (diag + radius).max() + pad)
    wanted = d - 1 - np.arange(k)  # eigenvalues below the one looked for
    while True:
        mid = low + (high - low) / 2
        done = (mid <= low) | (mid >= high) | (high - low <= np.finfo(float).eps * np.maximum(np.abs(mid), np.finfo(float).eps * edge))
        if done.all():
            return mid
        above = sturm_counts(diag, off, mid) <= wanted
        low, high = np.where(above & ~done, mid, low), np.where(~above & ~done, mid, high)


def _solve(diag: np.ndarray, off: np.ndarray, shift: float, b: np.ndarray, least: float) -> np.ndarray:
    """``(T - shift) x = b`` by elimination with row exchanges; pivots are no smaller than ``least``."""
    n = len(diag)
    main, up, upper = (diag - shift).tolist(), [*off.tolist(), 0.0], [0.0] * n
    x = b.tolist()
    for i in range(n - 1):
        below = float(off[i])
        if abs(main[i]) >= abs(below):
            if abs(main[i]) < least:
                main[i] = least
            f = below / main[i]
            main[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = main[i] / below
            main[i], old = below, up[i]
            up[i], main[i + 1] = main[i + 1], old - f * main[i + 1]
            upper[i], up[i + 1] = up[i + 1], -f * up[i + 1]
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    if abs(main[-1]) < least:
        main[-1] = least
    for i in range(n - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0.0) - (upper[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = rest / main[i]
    return np.array(x)


def inverse_iteration(diag: np.ndarray, off: np.ndarray, values: np.ndarray, steps: int = 5) -> np.ndarray:
    """Unit eigenvectors (columns) for falling ``values``. Those whose values lie close together are kept orthogonal to one another."""
    d = len(diag)
    norm = max(np.abs(diag).max() + (2 * np.abs(off).max() if len(off) else 0.0), np.finfo(float).tiny)
    least, close = np.finfo(float).eps * norm, 1e-3 * norm
    rng = np.random.default_rng(7)
    out, start = np.zeros((d, len(values))), 0
    for j, value in enumerate(values):
        if j and values[j - 1] - value > close:
            start = j
        shift = value if j == start else min(value, shift - 4 * least)  # equal values apart, or all give one vector
        z = rng.standard_normal(d)
        for _ in range(steps):
            z = _solve(diag, off, shift, z / np.abs(z).max(), least)
            z /= np.abs(z).max()
            for _ in range(2):
                z -= out[:, start:j] @ (out[:, start:j].T @ z)
            z /= np.linalg.norm(z)
        out[:, j] = z
    return out


def leading_components(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as columns."""
    scale = np.abs(v).max()
    if not len(v) or not scale > 0:
        return np.zeros(0), np.zeros((len(v), 0))
    diag, off, reflections = tridiagonal(v / scale)
    values = leading_values(diag, off, min(k, len(v)))
    return values * scale, carry_back(inverse_iteration(diag, off, values), reflections)


# ---- projection ------------------------------------------------------------------------------------------


def _whiten(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    return (x - mean) @ projection


def _moments(dim: int, mean: np.ndarray, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Number, mean and centred products of a task's whitened vectors."""
        projection = sent.value
        k = projection.shape[1]
        n, middle, products = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in whole(batch.column("vector"), dim)[1]:
                for at in range(0, len(x), _SLICE):
                    w = _whiten(x[at : at + _SLICE], mean, projection)
                    n, middle, products = merged((n, middle, products), (len(w), w.mean(axis=0), _centred(w)))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([n], pa.int64()), pa.array([middle], pa.list_(pa.float64())), pa.array([products.ravel()], pa.list_(pa.float64()))],
                ["n", "middle", "products"],
            )

    return run


def _centred(w: np.ndarray) -> np.ndarray:
    c = w - w.mean(axis=0)
    return c.T @ c


def merged(a: tuple, b: tuple) -> tuple:
    """Number, mean and centred products of two sets of rows together."""
    n = a[0] + b[0]
    step = b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def _merge_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for row in batch.to_pylist():
            k = len(row["middle"])
            part = (row["n"], np.array(row["middle"]), np.array(row["products"]).reshape(k, k))
            total = merged(total, part) if total else part
    if total:
        yield pa.RecordBatch.from_arrays(
            [pa.array([total[0]], pa.int64()), pa.array([total[1]], pa.list_(pa.float64())), pa.array([total[2].ravel()], pa.list_(pa.float64()))],
            ["n", "middle", "products"],
        )


_PARTS = "n BIGINT, middle ARRAY<DOUBLE>, products ARRAY<DOUBLE>"


def identity_error(vectors: DataFrame, dim: int, mean: np.ndarray, sent) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity. One small matrix a task is merged in two rounds."""
    parts = vectors.mapInArrow(_moments(dim, mean, sent), _PARTS)
    spread = max(1, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    last = parts.repartition(spread).mapInArrow(_merge_all, _PARTS).repartition(1).mapInArrow(_merge_all, _PARTS).first()
    k = len(last["middle"])
    return float(np.abs(np.array(last["products"]).reshape(k, k) / last["n"] - np.eye(k)).max())


def deviations(x: np.ndarray, n: int, s: np.ndarray) -> pa.Array:
    """Exact sums of ``(n * x - s) ** 2`` by row; null beyond a long."""
    bound = float(np.abs(x).max(initial=0)) * n + float(np.abs(s).max(initial=0))
    if bound < 2.0**62:
        v = n * x - s
        if len(s) * float(np.abs(v).max(initial=0)) ** 2 < 2.0**62:
            return pa.array((v * v).sum(axis=1))
    v = n * x.astype(object) - s.astype(object)
    return pa.array([t if t < 1 << 63 else None for t in (v * v).sum(axis=1)], pa.int64())


def _rows(n: int, dim: int, s: np.ndarray, sent, explained: np.ndarray, error: float):
    k, mean = len(explained), s / n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, parts = whole(batch.column("vector"), dim)
            at = 0
            for x in (part[i : i + _SLICE] for part in parts for i in range(0, len(part), _SLICE)):
                m = len(x)
                ids = batch.column("vec_id").take(pa.array(np.repeat(rows[at : at + m], k)))
                number = np.tile(np.arange(1, k + 1, dtype=np.int32), m)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, pa.array(number), pa.array(np.full(m * k, n)), deviations(x, n, s).take(pa.array(np.repeat(np.arange(m), k))),
                        pa.array(_whiten(x, mean, sent.value).ravel()), pa.array(explained[number - 1]), pa.array(np.full(m * k, error)),
                    ],
                    ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )
                at += m

    return run


WHITENED = "vec_id BIGINT, component INT, n BIGINT, deviation BIGINT, whitened DOUBLE, explained DOUBLE, identity_error DOUBLE"


def whitened(rows: DataFrame, components: int = 32, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row for each kept vector and each leading component, up to ``components``: ``vec_id, component, n, deviation,
    whitened, explained, identity_error``."""
    spark = rows.sparkSession
    vectors = rows.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    vectors = vectors.where(F.col("vector").isNotNull())
    n, dim, s = fit_sums(vectors)
    v = covariance(vectors, n, dim, s) if n else np.zeros((0, 0))
    values, columns = leading_components(v, components) if n else (np.zeros(0), v)
    real = values > TINY * dim * (np.trace(v) if n else 0.0)
    values, columns = values[real], columns[:, real]
    if not len(values):
        return spark.createDataFrame([], WHITENED)
    sent = spark.sparkContext.broadcast(columns / np.sqrt(values))
    error = identity_error(vectors, dim, s / n, sent)
    return vectors.mapInArrow(_rows(n, dim, s, sent, values / np.trace(v), error), WHITENED)


def op13_whitened_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
