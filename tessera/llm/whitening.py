"""Whitening of embeddings by the leading eigenvectors of their covariance, found by a block Jacobi-Davidson method.

The covariance is never formed. A product with it is one pass over the vectors: each task centres its rows, multiplies, and sums; the sums
meet by a grouping, and the driver holds blocks of a few dozen vectors as long as one embedding. Corrections come from projected
equations that a few steps of MINRES solve, all columns of a block in the same passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, cut

COMPONENTS = 16
#: Steps of MINRES for one correction, vectors that the search space holds at most, over the wanted ones, and rounds before giving up.
INNER, SPACE, ROUNDS = 4, 4, 300
#: A residual of this share of the largest eigenvalue is rounding.
ROUNDING = 64 * np.finfo(float).eps

Apply = Callable[[np.ndarray], np.ndarray]


# ---- Jacobi-Davidson ------------------------------------------------------------------------------

def orthonormal(v: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns of v add to those of `against`; columns that add nothing go."""
    v = v / np.maximum(np.linalg.norm(v, axis=0), np.finfo(float).tiny)
    for _ in range(2):
        v = v - against @ (against.T @ v)
    left, size, _ = np.linalg.svd(v, full_matrices=False)
    left = left[:, size > 1e-10]
    for _ in range(2):
        left = np.linalg.qr(left - against @ (against.T @ left))[0]
    return left


def minres(apply: Apply, b: np.ndarray, steps: int) -> np.ndarray:
    """After some steps, x with the least residual of apply(x) = b, for each column of b on its own; apply is symmetric."""
    x, beta = np.zeros_like(b), np.linalg.norm(b, axis=0)
    v_old, v = np.zeros_like(b), b / np.where(beta > 0, beta, 1)
    d_old, d = np.zeros_like(b), np.zeros_like(b)
    c_old, s_old, c, s = np.ones(len(beta)), np.zeros(len(beta)), np.ones(len(beta)), np.zeros(len(beta))
    rest, link = beta.copy(), np.zeros(len(beta))
    for _ in range(steps):
        w = apply(v)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - link * v_old
        following = np.linalg.norm(w, axis=0)
        far, near, own = s_old * link, c * c_old * link + s * alpha, c * alpha - s * c_old * link
        length = np.hypot(own, following)
        live = length > 1e-300
        c_old, s_old = c, s
        c, s = np.where(live, own / np.where(live, length, 1), 1.0), np.where(live, following / np.where(live, length, 1), 0.0)
        d_old, d = d, np.where(live, (v - far * d_old - near * d) / np.where(live, length, 1), 0)
        x = x + c * rest * d
        rest = -s * rest
        v_old, v, link = v, w / np.where(following > 1e-300, following, 1), following
    return x


def jacobi_davidson(apply: Apply, size: int, wanted: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit eigenvectors, of the symmetric operator of this size.

    Each round takes the Ritz pairs of the search space, locks leading ones whose residual is rounding, and widens the space by the
    corrections of the others. A locked vector is projected out from then on. The space restarts from its best vectors when it is full."""
    wanted = min(wanted, size)
    width, most = min(size, wanted + 4), min(size, max(SPACE * wanted, wanted + 8))
    values, locked, largest = [], np.zeros((size, 0)), 0.0
    space = orthonormal(np.random.default_rng(seed).standard_normal((size, width)), locked)
    image = apply(space)
    for _ in range(ROUNDS):
        small = space.T @ image
        theta, turn = np.linalg.eigh((small + small.T) / 2)
        theta, turn = theta[::-1], turn[:, ::-1]
        space, image = space @ turn, image @ turn
        largest = max(largest, float(theta[0]), 0.0) if len(theta) else largest
        rest = image - space * theta
        rest -= locked @ (locked.T @ rest)
        error = np.linalg.norm(rest, axis=0)
        whole = locked.shape[1] + space.shape[1] == size
        done = 0
        while done < len(theta) and locked.shape[1] + done < wanted and error[done] <= ROUNDING * max(largest, np.finfo(float).tiny):
            done += 1
        values += theta[:done].tolist()
        locked = np.hstack([locked, space[:, :done]])
        if len(values) == wanted:
            order = np.argsort(values)[::-1]
            return np.array(values)[order], locked[:, order]
        space, image, theta, rest = space[:, done:], image[:, done:], theta[done:], rest[:, done:]
        open_ = min(wanted - len(values), space.shape[1])
        if whole:  # nothing can be added: the basis is worked out anew, without what rotations have rounded
            space = orthonormal(space, locked)
            image = apply(space)
            continue
        near = np.hstack([locked, space[:, :open_]])
        shift = theta[:open_]
        project = lambda z, q=near: z - q @ (q.T @ z)
        step = minres(lambda z, t=shift, p=project: p(apply(p(z)) - t * p(z)), -project(rest[:, :open_]), INNER)
        if space.shape[1] + open_ > most - locked.shape[1] and most < size:
            space, image = space[:, : width + open_ // 2], image[:, : width + open_ // 2]
        more = orthonormal(project(step), np.hstack([locked, space]))
        if not more.shape[1]:
            more = orthonormal(np.random.default_rng(seed + 1).standard_normal((size, open_)), np.hstack([locked, space]))
        more = more[:, : size - locked.shape[1] - space.shape[1]]
        space, image = np.hstack([space, more]), np.hstack([image, apply(more)])
    raise RuntimeError(f"{wanted - len(values)} eigenvectors have not come to double precision in {ROUNDS} rounds")


# ---- passes over the vectors ----------------------------------------------------------------------

def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a column of equally long arrays of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centred(x: np.ndarray, n: int, total: np.ndarray) -> np.ndarray:
    """x - S/n with the difference taken in whole numbers."""
    return (n * x - total) / n


def totals(fit: DataFrame, kernel: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: str = "double") -> np.ndarray:
    """The sum of kernel(rows) over all rows of fit(x): one array for each task, summed by their entries."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(matrix(batch.column(0)))
                out = part if out is None else out + part
        if out is not None:
            flat = np.ascontiguousarray(out).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "v"])

    out = np.zeros(int(np.prod(shape)), np.int64 if kind == "long" else float)
    for r in fit.select("x").mapInArrow(work, f"i int, v {kind}").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r.i] = r.v
    return out.reshape(shape)


def whole_vectors(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x) of the rows whose vector has finite entries only; x counts 64ths, from a million on."""
    sound = F.col(vector).isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(sound).select(F.col(key), F.transform(vector, lambda e: F.floor(e.cast("double") * 64).cast("long") + 1_000_000).alias("x"))


def whitened(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each sound row and component.

    Rows whose vector is null, empty, holds null, NaN or infinity, or has another length than most (the longest at a tie) are left out.
    Repeated vectors are fitted once and whitened in each row; a null key is a key. Fewer components come where the vectors span fewer
    dimensions: those without spread cannot be whitened, so one distinct vector, or none, gives no row. Other columns are not read.
    Sums that leave 64 bits raise an error."""
    spark = vectors.sparkSession
    with Scratch(spark) as scratch:
        rows = whole_vectors(vectors, key, vector)
        lengths = rows.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
        size = lengths.d if lengths else 0
        rows = rows.where(F.size("x") == size)
        fit = scratch.keep(rows.select("x").distinct())
        n = fit.count()
        empty = spark.createDataFrame([], rows.select(key).schema).selectExpr(f"`{key}`", "int(0) component", "0L n", "0L deviation", "0D whitened", "0D explained", "0D identity_error")
        if n < 2 or not size:
            return empty
        total = totals(fit, lambda x: x.sum(axis=0), (size,), "long")
        middle = lambda x: centred(x, n, total)

        def covariance(z: np.ndarray) -> np.ndarray:
            def part(x: np.ndarray) -> np.ndarray:
                c = middle(x)
                return c.T @ (c @ z)
            return totals(fit, part, z.shape) / n

        trace = float(totals(fit, lambda x: np.square(middle(x)).sum(keepdims=True).reshape(1), (1,))[0]) / n
        values, basis = jacobi_davidson(covariance, size, components)
        spread = values > size * np.finfo(float).eps * max(values[0], 0.0)
        values, basis = values[spread], basis[:, spread]
        if not len(values):
            return empty
        scale = basis / np.sqrt(values)
        mean = totals(fit, lambda x: (middle(x) @ scale).sum(axis=0), (len(values),)) / n

        def square(x: np.ndarray) -> np.ndarray:
            w = middle(x) @ scale - mean
            return w.T @ w

        error = float(np.abs(totals(fit, square, (len(values),) * 2) / n - np.eye(len(values))).max())

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = matrix(batch.column(1))
                apart = n * x - total
                if np.square(apart.astype(float)).sum(axis=1).max() > 9e18:
                    raise OverflowError("a sum of squares does not fit 64 bits")
                w = (apart / n) @ scale
                at = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.square(apart).sum(axis=1)), pa.ListArray.from_arrays(at, pa.array(w.reshape(-1)))], names=["k", "deviation", "w"])

        share: Column = F.array(*[F.lit(float(v / trace)) for v in values])
        kind = rows.schema[key].dataType.simpleString()
        out = rows.select(F.col(key).alias("k"), "x").mapInArrow(work, f"k {kind}, deviation long, w array<double>").select(F.col("k").alias(key), "deviation", F.posexplode("w").alias("c", "whitened"))
        return cut(out.select(key, (F.col("c") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.get(share, F.col("c")).alias("explained"), F.lit(error).alias("identity_error")))
