"""Whitening of embeddings by QDWH spectral divide and conquer.

Entries become x = floor(256 c). Sums and covariance are taken over the distinct x vectors (the fit list), in one pass each:
tasks add up their rows, and the d (d + 1) / 2 sums of the covariance are added by key, so what reaches the driver depends on
the dimension alone. There the eigenvectors are found without an eigensolver: the polar factor U of the covariance minus the
mean of its diagonal, by QR-based dynamically weighted Halley steps, gives the projector (U + I) / 2 on the eigenvalues above
that mean; orthonormal bases of its range and of the complement split the covariance into two smaller ones, and each is
split again until single eigenvectors are left. Branches below the first components are not followed. The d x 4 matrix of the
scaled components is broadcast, and every row is projected where it lies.

Edge cases: rows with a null vector, or one with null or non-finite entries, are dropped, as are vectors of another length than
the commonest one. Ids may be null, of any type, and repeat: every row that is left gives its own rows. A component whose
eigenvalue is below RANK times the largest is not returned, so a table of one distinct vector gives no rows, and neither does
an empty one. Entries beyond a long saturate; a deviation that a long cannot hold is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solargrid.llm import vectors as V
from solargrid.llm.storage import stored

COMPONENTS = 4
#: Eigenvalues below this share of the largest are taken as zero.
RANK = 1e-10
LONG = 1 << 63


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by dynamically weighted Halley steps."""
    k = len(a)
    x = a / np.linalg.norm(a)
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))
    except np.linalg.LinAlgError:
        low = 0.0
    low = min(max(low, 1e-16), 1.0)
    for _ in range(20):
        if abs(1 - low) < 1e-15:
            break
        sq = low * low
        root = np.sqrt(1 + np.cbrt(4 * (1 - sq) / sq**2))
        p = root + np.sqrt(max(8 - 4 * (root**2 - 1) + 8 * (2 - sq) / (sq * root), 0)) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        basis, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, np.eye(k)]))
        x = (q / r) * x + (p - q / r) / np.sqrt(r) * basis[:k] @ basis[k:].T
        x = (x + x.T) / 2
        low = min(low * (p + q * sq) / (1 + r * sq), 1.0)
    # One Newton-Schulz step takes off what rounding has left.
    return 1.5 * x - 0.5 * x @ x @ x


def halves(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthonormal bases of the subspaces of the eigenvalues above and below a shift near the mean of the diagonal."""
    k = len(v)
    mean, spread = np.trace(v) / k, np.linalg.norm(v - np.trace(v) / k * np.eye(k)) / np.sqrt(k)
    random = np.random.default_rng(0)
    for step in (0.0, 0.01, -0.01, 0.03, -0.03, 0.1, -0.1, 0.3, -0.3):  # an eigenvalue at the shift belongs to neither side
        u = polar(v - (mean + step * spread) * np.eye(k))
        p = (u + np.eye(k)) / 2
        rank = int(round(np.trace(p)))
        if 0 < rank < k and np.linalg.norm(p @ p - p) < 1e-9 * k:
            above, _ = np.linalg.qr(p @ random.standard_normal((k, rank)))
            above, _ = np.linalg.qr(p @ above)
            return above, np.linalg.qr(above, mode="complete")[0][:, rank:]
    raise ArithmeticError("no shift splits the spectrum")


def leading(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    size = np.linalg.norm(v)

    def split(a: np.ndarray, basis: np.ndarray, want: int) -> list[np.ndarray]:
        k = len(a)
        if k == 1 or np.linalg.norm(a - np.trace(a) / k * np.eye(k)) <= 1e-15 * k * size:
            return list(basis.T)
        above, below = halves(a)
        out = []
        for part in (above, below):
            if len(out) < want:
                inner = part.T @ a @ part
                out += split((inner + inner.T) / 2, basis @ part, want - len(out))
        return out

    q = np.array(split(v, np.eye(len(v)), most)).T
    q, _ = np.linalg.qr(q)
    q *= np.where(q[np.abs(q).argmax(axis=0), np.arange(q.shape[1])] < 0, -1.0, 1.0)
    e = np.einsum("ij,ij->j", q, v @ q)
    order = np.argsort(-e, kind="stable")[:most]
    return e[order], q[:, order]


def fit_list(rows: DataFrame, vec_col: str, d: int) -> DataFrame:
    """The distinct vectors, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([V.packed(V.matrix(b.column(0), d)[1])], ["x"])

    return rows.select(vec_col).mapInArrow(run, "x binary").groupBy("x").count()


def totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """How many distinct vectors there are, and their exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [0] * (d + 1)
        for b in batches:
            x = V.unpacked(b.column(0), d)
            big = len(x) and max(int(x.max()), -int(x.min())) * len(x) >= LONG
            each = x.astype(object).sum(axis=0) if big else x.sum(axis=0)
            sums = [s + int(t) for s, t in zip(sums, [*each, len(x)], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1)), pa.array([str(s) for s in sums])], ["cell", "s"])

    got = fit.select("x").mapInArrow(run, "cell long, s string").groupBy("cell").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["cell"]: int(r["s"]) for r in got}
    return found.get(d, 0), [found.get(k, 0) for k in range(d)]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n, from whole numbers where these fit."""
    if len(x) and max(int(x.max()), -int(x.min())) * n + max(map(abs, sums)) >= LONG:
        return ((x.astype(object) * n - np.array(sums, dtype=object)) / n).astype(np.float64)
    return (x * n - np.array(sums, dtype=np.int64)) / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Exact sums of (n x - S)^2 over the dimensions; null beyond a long."""
    top = (max(int(x.max()), -int(x.min())) * n + max(map(abs, sums))) if len(x) else 0
    if top * top * x.shape[1] < LONG:
        y = x * n - np.array(sums, dtype=np.int64)
        return pa.array((y * y).sum(axis=1))
    y = x.astype(object) * n - np.array(sums, dtype=object)
    return pa.array([int(s) if s < LONG else None for s in (y * y).sum(axis=1)], pa.int64())


def mean_products(fit: DataFrame, d: int, n: int, sums: list[int], weights: np.ndarray | None = None) -> np.ndarray:
    """Covariance of the fit list, or of its projections on the columns of weights; centred before multiplying."""
    k = d if weights is None else weights.shape[1]
    row, col = np.triu_indices(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((k, k))
        for b in batches:
            y = centred(V.unpacked(b.column(0), d), n, sums)
            y = y if weights is None else y @ weights
            both += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(row * k + col), pa.array(both[row, col])], ["cell", "s"])

    got = fit.select("x").mapInArrow(run, "cell long, s double").groupBy("cell").agg(F.sum("s").alias("s")).toArrow()
    out = np.zeros(k * k)
    out[got["cell"].to_numpy()] = got["s"].to_numpy() / n
    out = out.reshape(k, k)
    return np.triu(out) + np.triu(out, 1).T


def whiten(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """id_col, component, n, deviation, whitened, explained and identity_error: a row for each row and component."""
    kind = rows.schema[id_col].dataType.simpleString()
    names = ["q_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    schema = f"q_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    d = V.dimension(rows, vec_col)
    fit = stored(fit_list(rows, vec_col, d), "whitening-fit") if d else None
    n, sums = totals(fit, d) if d else (0, [])
    e, q = np.zeros(0), np.zeros((d, 0))
    if n > 1:
        v = mean_products(fit, d, n, sums)
        e, q = leading(v, min(most, d))
        kept = e > RANK * max(e[0], 0)
        e, q = e[kept], q[:, kept]
    if not len(e):
        return rows.sparkSession.createDataFrame([], schema).withColumnRenamed("q_id", id_col)
    weights, share = q / np.sqrt(e), e / np.trace(v)
    error = float(np.abs(mean_products(fit, d, n, sums, weights) - np.eye(len(e))).max())
    k = len(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = V.matrix(b.column(1), d)
            each = np.repeat(np.arange(len(at)), k)
            white = (centred(x, n, sums) @ weights).ravel()
            ids, far = b.column(0).take(pa.array(at[each])), deviations(x, n, sums).take(pa.array(each))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))), pa.array(np.full(len(each), n)), far, pa.array(white), pa.array(np.tile(share, len(at))), pa.array(np.full(len(each), error))], names)

    return rows.select(F.col(id_col).alias("q_id"), F.col(vec_col).alias("q_vec")).mapInArrow(run, schema).withColumnRenamed("q_id", id_col)
