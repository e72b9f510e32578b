"""Whitening of embeddings by spectral divide and conquer on their covariance.

Entries become integers (``floor(scale * c) + offset``), so counts, sums and
the covariance of the whole table are exact: every task centres its rows on
the rounded mean before it multiplies them, and what rounding left out is taken
off the totals, in integers. The covariance, a square of the vectors' length,
is split in the driver: the polar factor of the covariance less a shift
(QDWH iteration) gives the projector on the eigenvectors above the shift, bases
of its range and of its null space make two smaller problems, and so on down to
single components. The components are broadcast with the tasks that whiten.

Rows drop out if their vector is null, empty, or holds a null, NaN or infinite
entry, or one so large (2**56) that no long holds its integer. Vectors of
another length than the most frequent one (the longer of two as frequent) drop
out as well. Ties in eigenvalues give any orthonormal basis of their space.
Components whose eigenvalue is no more than rounding of the largest cannot be
scaled to one and are left out, so equal vectors, a single one and an empty
table give no rows. Repeated rows and null ids stay rows of their own.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seepage.session import settle, spread

SCALE, OFFSET = 64.0, 1_000_000
LARGEST = float(2**56)
EPS = np.finfo(float).eps


def _shift_weights(low: float) -> tuple[float, float, float]:
    """Weights (a, b, c) of a dynamically weighted Halley step for singular values of ``low`` to 1."""
    square = low * low
    gamma = np.cbrt(4 * (1 - square) / (square * square))
    root = np.sqrt(1 + gamma)
    a = root + np.sqrt(8 - 4 * gamma + 8 * (2 - square) / (square * root)) / 2
    b = (a - 1) ** 2 / 4
    return a, b, a + b - 1


def polar_factor(a: np.ndarray, most: int = 60) -> np.ndarray:
    """The orthogonal factor of a symmetric matrix by QDWH: its matrix sign if no eigenvalue is zero."""
    n = len(a)
    size = np.sqrt(np.abs(a).sum(0).max() * np.abs(a).sum(1).max())
    x, eye = a / size, np.eye(n)
    r = np.linalg.qr(x, mode="r")
    pivots = np.abs(np.diag(r))
    # A lower bound of the least singular value; a poor one costs steps only.
    if pivots.min() > n * EPS:
        low = 1 / (np.abs(np.linalg.inv(r)).sum(0).max() * np.sqrt(n))
    else:
        low = EPS / n
    low = float(min(1.0, max(low, EPS / n)))
    for _ in range(most):
        wa, wb, wc = _shift_weights(low) if low < 1 else (3.0, 1.0, 3.0)
        last = x
        if wc > 100:  # by QR, which is stable for badly conditioned steps
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            x = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            x = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * x.T @ x, x.T).T
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * low * low) / (1 + wc * low * low))
        if abs(1 - low) < 10 * EPS and np.linalg.norm(x - last) < np.cbrt(EPS):
            break
    return x


def _halves(a: np.ndarray, scale: float, rng) -> np.ndarray | None:
    """An orthogonal matrix and where it splits ``a`` into two invariant parts, or None if ``a`` is a multiple of one."""
    n, mean = len(a), np.trace(a) / len(a)
    spread_of = np.sqrt(max(0.0, np.sum((a - mean * np.eye(n)) ** 2) / n))
    if spread_of <= n * EPS * scale:
        return None
    # The median of the diagonal halves most problems; the mean lies between the ends of any spectrum.
    shifts = [np.median(np.diag(a)), mean, *(mean + f * spread_of for f in (0.07, -0.07, 0.21, -0.21, 0.4, -0.4, 0.8, -0.8))]
    best, least = None, np.inf
    for shift in shifts:
        shifted = a - shift * np.eye(n)
        if not np.abs(shifted).max() > 0:
            continue
        above = (polar_factor(shifted) + np.eye(n)) / 2
        k = int(round(np.trace(above)))
        if not 0 < k < n:
            continue
        basis = np.hstack([above @ rng.standard_normal((n, k)), (np.eye(n) - above) @ rng.standard_normal((n, n - k))])
        q, _ = np.linalg.qr(basis)
        rest = np.abs(q[:, k:].T @ a @ q[:, :k]).max()
        if rest < least:
            best, least = (q, k), rest
        if rest <= 8 * n * EPS * scale:
            break
    return best


def eigenpairs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues of a symmetric matrix and their unit eigenvectors as columns."""
    rng = np.random.default_rng(11)
    scale = float(np.abs(a).sum(0).max())

    def solve(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(part)
        found = _halves(part, scale, rng) if n > 1 else None
        if found is None:
            return np.diag(part).copy(), np.eye(n)
        q, k = found
        sides = []
        for own in (q[:, :k], q[:, k:]):
            small = own.T @ part @ own
            values, vectors = solve((small + small.T) / 2)
            sides.append((values, own @ vectors))
        return np.concatenate([v for v, _ in sides]), np.hstack([w for _, w in sides])

    _, vectors = solve((a + a.T) / 2)
    vectors, _ = np.linalg.qr(vectors)  # what rounding took from their right angles over the levels
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Whitening:
    """What the fit list tells: its size, sums, eigenvalues and components, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> list[list[int]] | np.ndarray:
        """n * x - S, exact; of longs where they suffice."""
        means = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, means)]
        y = x - means
        most = int(np.abs(y).max(initial=0))
        if (most + 1) * self.n < 2**53:
            return y * self.n - np.array(rest, np.int64)
        return y.astype(object) * self.n - np.array(rest, object)


def vectors_of(rows: DataFrame, id_col: str, vector_col: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x): the integers of the vectors that can be fitted, of the most frequent length."""
    taken = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    taken = taken.where(F.coalesce((F.size("v") > 0) & fine, F.lit(False)))
    length = taken.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long") + F.lit(offset).cast("long"))
    return taken.where(F.size("v") == (length.d if length else 0)).select("vec_id", x.alias("x"))


def _matrix(column: pa.ListArray, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _totals(rows: DataFrame, make, kind: str) -> dict[tuple[int, int], object]:
    """Sums over all tasks of the small matrices that ``make`` yields batch by batch, by place; the count is at (-1, -1)."""
    def run(batches):
        total, count = None, 0
        for batch in batches:
            if batch.num_rows:
                part = make(batch)
                total = part if total is None else total + part
                count += batch.num_rows
        if total is not None:
            i, j = (a.ravel() for a in np.indices(total.shape))
            values = total.ravel().tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(j, -1), pa.int32()),
                 pa.array([str(v) if kind != "double" else v for v in [*values, count]])], ["i", "j", "part"])

    parts = rows.mapInArrow(run, f"i int, j int, part {'double' if kind == 'double' else 'string'}")
    sums = parts.groupBy("i", "j").agg(F.sum(F.col("part").cast(kind)).alias("total"))
    return {(r.i, r.j): r.total for r in sums.collect()}  # as many as the square of the vectors' length


def fit(vectors: DataFrame) -> Whitening | None:
    """Components of the (vec_id, x) rows; None if there are none."""
    def columns(batch):
        x = _matrix(batch.column("x"), np.int64)
        fits = int(np.abs(x).max()) * len(x) < 2**62
        return (x if fits else x.astype(object)).sum(0, keepdims=True).astype(object)

    sums = _totals(vectors.select("x"), columns, "decimal(38,0)")
    if not sums:
        return None
    n, d = int(sums.pop((-1, -1))), len(sums)
    sums = [int(sums[0, j]) for j in range(d)]
    middle = np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)

    def products(batch):
        y = _matrix(batch.column("x"), np.int64) - middle
        if int(np.abs(y).max()) ** 2 * len(y) < 2**53:  # exact in doubles
            return np.rint(y.T.astype(float) @ y.astype(float)).astype(np.int64).astype(object)
        y = y.astype(object)
        return y.T @ y

    found = _totals(vectors.select("x"), products, "decimal(38,0)")
    rest = [s - n * int(m) for s, m in zip(sums, middle)]
    cov = np.array([[(int(found[i, j]) * n - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    values, components = eigenpairs(cov) if np.abs(cov).max() > 0 else (np.zeros(d), np.eye(d))
    kept = values > 4 * d * EPS * max(values[0], 0)
    return Whitening(n, sums, values[kept], components[:, kept], float(np.trace(cov)))


def transform(vectors: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(vec_id, deviation, whitened): each row's squared distance to the sums and its first whitened components."""
    scaled = model.vectors[:, :components] / np.sqrt(model.values[:components])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            apart = model.deviations(_matrix(batch.column("x"), np.int64))
            if apart.dtype == object or int(np.abs(apart).max(initial=0)) ** 2 * apart.shape[1] >= 2**63:
                squares = [sum(int(v) ** 2 for v in row) for row in apart]
                squares = [s if s < 2**63 else None for s in squares]
            else:
                squares = np.einsum("ij,ij->i", apart, apart)
            white = (apart / model.n).astype(float) @ scaled
            flat = pa.array(white.ravel())
            ends = pa.array(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(squares, pa.int64()), pa.ListArray.from_arrays(ends, flat)],
                ["vec_id", "deviation", "whitened"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, whitened array<double>")


def identity_error(white: DataFrame) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity, over all rows, centred first."""
    sums = _totals(white.select("whitened"), lambda b: _matrix(b.column("whitened"), float).sum(0, keepdims=True), "double")
    n, k = sums.pop((-1, -1)), len(sums)
    means = np.array([sums[0, j] for j in range(k)]) / n

    def products(batch):
        y = _matrix(batch.column("whitened"), float) - means
        return y.T @ y

    found = _totals(white.select("whitened"), products, "double")
    cov = np.array([[found[i, j] for j in range(k)] for i in range(k)]) / n
    return float(np.abs(cov - np.eye(k)).max())


def whiten(rows: DataFrame, components: int = 32, *, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """One row per vector and component, with how much the component explains and how well whitening worked.

    A squared distance beyond a long is null.
    """
    vectors = vectors_of(spread(rows.select(id_col, vector_col)), id_col, vector_col, scale, offset)
    model = fit(vectors)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.values):
        return rows.sparkSession.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    white = settle(transform(vectors, model, components), "whitened")
    shares = F.array(*[F.lit(float(v) / model.trace) for v in model.values[:components]])
    return white.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(identity_error(white)).alias("identity_error"))
