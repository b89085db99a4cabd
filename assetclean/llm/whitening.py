"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers, x = floor(1024 c) + 100000, so sums and deviations are
exact. The centred rows C (x - S/n) are never gathered: each step is one sweep
over them that forms the product u = C w row by row and sums the product
C'u; the overlaps of u with all u before follow from it. The u are not stored, as
each is C times a known vector. With alpha and beta the lengths of the two
products after full reorthogonalisation (twice, on both sides), the small
bidiagonal matrix B of alphas and betas has C V = U B; its singular values and
right vectors give the deviations and components.

The steps go on until no change is left to see: the wanted vectors have
residuals of rounding size and the variance outside V is too small to hide
another one; after as many steps as dimensions both hold. Where a product
vanishes (low rank, equal deviations) a fresh direction starts.

Defined results: a vector that is null or has a null or non-finite entry goes;
so does one whose length is not the most frequent one (the longer at a tie), or
with an entry of 2^52 or more, which has no such integer. Components are those
with a deviation above rounding size, so fewer than asked for where the data
have lower rank, and no rows come from one vector or equal ones. A deviation
beyond 64 bits is null in its long column. Null or repeated ids are kept as
they are; only the named columns are read; an empty table gives no rows.

Bounds: a sweep sends one vector a task, summed by a second stage of as many
tasks as the square root; the driver holds matrices of dimension x steps, and
a task one Arrow batch.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, table

COMPONENTS = 8
SCALE = 1024
SHIFT = 100_000
LARGEST = 2.0**52
LOW_BITS = 31
#: entries of a batch that are turned into floats at once
AT_ONCE = 1 << 20
EPS = float(np.finfo(float).eps)


def integer_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, x: array of longs) of the vectors that remain."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    good = F.forall("v", lambda c: c.isNotNull() & (F.abs(c) < LARGEST))  # NaN is above all numbers
    x = rows.select(F.col(key).alias("key"), v.alias("v")).filter(F.col("v").isNotNull()).filter(F.coalesce(good, F.lit(False)))
    x = cut(x.select("key", F.transform("v", lambda c: F.floor(F.lit(float(SCALE)) * c) + SHIFT).alias("x")), "integers")
    width = x.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return x.filter(F.size("x") == (width["d"] if width else 0))


def matrices(batch: pa.RecordBatch, column: int, d: int) -> Iterator[np.ndarray]:
    """The vectors of a batch as matrices of at most AT_ONCE entries."""
    flat = batch.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
    step = max(1, AT_ONCE // d)
    for at in range(0, len(flat), step):
        yield flat[at : at + step]


def summed(rows: DataFrame, of_task, kind: str, tasks: int) -> np.ndarray:
    """Sum over all tasks of the vector that ``of_task`` makes of its batches
    (``kind`` = long or double), by way of ``tasks`` partial sums."""
    dtype = {"long": np.int64, "double": np.float64}[kind]

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = of_task(batches)
        if v is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.from_numpy_dtype(dtype)))], ["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for v in b.column(0):
                v = v.values.to_numpy(zero_copy_only=False)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.from_numpy_dtype(dtype)))], ["v"])

    schema = f"v array<{kind}>"
    out = rows.mapInArrow(first, schema).repartition(tasks).mapInArrow(again, schema).collect()
    return sum((np.array(r["v"], dtype) for r in out), np.zeros(1, dtype))


class Centred:
    """Centred rows as an operator: the vectors, their number and sums."""

    def __init__(self, x: DataFrame):
        self.x = x
        first = x.select(F.size("x").alias("d")).first()
        self.d = d = first["d"] if first else 0
        self.tasks = tasks = max(1, math.isqrt(len(x.inputFiles())))

        def sums(batches):
            n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
            for b in batches:
                for m in matrices(b, 0, d):
                    n, high, low = n + len(m), high + (m >> LOW_BITS).sum(axis=0), low + (m & ((1 << LOW_BITS) - 1)).sum(axis=0)
            return np.concatenate(([n], high, low)) if n else None

        v = summed(x.select("x"), sums, "long", tasks) if d else np.zeros(1, np.int64)
        self.n = n = int(v[0])
        self.sums = [(int(h) << LOW_BITS) + int(low) for h, low in zip(v[1 : 1 + d], v[1 + d :], strict=True)] if n else []
        # the mean as a whole part and a rest, so that centring loses nothing
        self.whole = np.array([s // n for s in self.sums], np.int64)
        self.rest = np.array([s % n / n for s in self.sums])

    def rows_of(self):
        whole, rest = self.whole, self.rest
        return lambda m: (m - whole).astype(float) - rest

    def sweep(self, w: np.ndarray) -> tuple[np.ndarray, float, float]:
        """For u = C w: C'u, its squared length, and the squared size of C."""
        d, centred = self.d, self.rows_of()

        def part(batches):
            out = None
            for b in batches:
                for m in matrices(b, 0, d):
                    c = centred(m)
                    u = c @ w
                    v = np.concatenate((u @ c, [u @ u, np.vdot(c, c)]))
                    out = v if out is None else out + v
            return out

        v = summed(self.x.select("x"), part, "double", self.tasks)
        return v[:d], float(v[d]), float(v[d + 1])


def bidiagonalise(c: Centred, wanted: int = COMPONENTS, seed: int = 20240501) -> tuple[np.ndarray, np.ndarray, float]:
    """(components as columns, their singular values, squared size of C)."""
    d, rng = c.d, np.random.default_rng(seed)
    V, W, Z = np.zeros((d, 0)), np.zeros((d, 0)), np.zeros((d, 0))  # u_j = C W_j, Z_j = C'u_j
    alphas: list[float] = []
    betas: list[float] = []
    size = 0.0

    def against(v: np.ndarray) -> np.ndarray:
        for _ in range(2):
            v = v - V @ (V.T @ v)
        return v

    def fresh() -> np.ndarray:
        v = against(rng.standard_normal(d))
        return v / np.linalg.norm(v)

    v = fresh()
    while True:
        V = np.column_stack((V, v))
        w = v - W @ (Z.T @ v)  # C v without its parts along the u before
        for _ in range(3):
            t, uu, size = c.sweep(w)
            overlap = W.T @ t  # with every u before, as these are C W
            w, t = w - W @ overlap, t - Z @ overlap
            uu -= float(overlap @ overlap)
            if np.linalg.norm(overlap) <= 1e-8 * math.sqrt(max(uu, 0.0)):
                break
        least = 8 * d * EPS * math.sqrt(size)
        alpha = math.sqrt(max(uu, 0.0))
        if alpha > least:
            w, t = w / alpha, t / alpha
        else:  # C v lies among the u before
            alpha, w, t = 0.0, np.zeros(d), np.zeros(d)
        W, Z = np.column_stack((W, w)), np.column_stack((Z, t))
        alphas.append(alpha)
        v = against(t - alpha * V[:, -1])
        beta = float(np.linalg.norm(v))
        k = len(alphas)
        if k == d or k >= wanted and k % wanted == 0:
            p, s, q = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            left = size - float(np.sum(np.square(alphas)) + np.sum(np.square(betas)))  # variance outside V
            last = min(wanted, k)
            if k == d or np.all(beta * np.abs(p[-1, :last]) <= EPS * s[0]) and left < 0.999 * s[last - 1] ** 2:
                last = int(np.sum(s[:last] > least))
                return V @ q[:last].T, s[:last], size
        if beta > least:
            v = v / beta
        else:
            beta, v = 0.0, fresh()
        betas.append(beta)


def projected(c: Centred, components: np.ndarray, deviations: np.ndarray) -> DataFrame:
    """(key, deviation, y: array of whitened coordinates) of every vector."""
    n, d, sums, centred = c.n, c.d, c.sums, c.rows_of()
    whole = c.whole
    schema = c.x.select("key").schema.add("deviation", "long").add("y", T.ArrayType(T.DoubleType()))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = np.array(sums, object)
        for b in batches:
            dev, y = [], []
            for m in matrices(b, 1, d):
                y.extend(((centred(m) @ components) / deviations).tolist())
                most = (int(np.abs(m - whole).max()) + 1) * n  # |n x - S| is below it
                if most * most * d < 1 << 63:
                    z = n * (m - whole) - (exact - n * whole.astype(object)).astype(np.int64)
                    dev.extend(np.square(z).sum(axis=1).tolist())
                else:
                    z = m.astype(object) * n - exact
                    dev.extend(v if v < 1 << 63 else None for v in (z * z).sum(axis=1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dev, pa.int64()), pa.array(y, pa.list_(pa.float64()))], ["key", "deviation", "y"])

    return cut(c.x.select("key", "x").mapInArrow(part, schema), "whitened")


def identity_error(rows: DataFrame, n: int, k: int, tasks: int) -> float:
    """Largest absolute entry of the covariance of ``y`` minus the identity."""

    def means(batches):
        parts = [m.sum(axis=0) for b in batches for m in matrices(b, 0, k)]
        return sum(parts) if parts else None

    mean = summed(rows.select("y"), means, "double", tasks) / n

    def products(batches):
        parts = [((m - mean).T @ (m - mean)).ravel() for b in batches for m in matrices(b, 0, k)]
        return sum(parts) if parts else None

    return float(np.abs(summed(rows.select("y"), products, "double", tasks).reshape(k, k) / n - np.eye(k)).max())


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", wanted: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for
    each remaining vector and component."""
    c = Centred(integer_vectors(rows, key, vector))
    components, s, size = bidiagonalise(c, wanted) if c.n else (None, [], 0.0)
    if not len(s):
        none = c.x.select("key", F.lit(1).alias("component"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("deviation"), *[F.lit(0.0).alias(a) for a in ("whitened", "explained", "identity_error")])
        return none.filter(F.lit(False))
    y = projected(c, components, s / math.sqrt(c.n))
    error = identity_error(y, c.n, len(s), c.tasks)
    shares = F.array(*[F.lit(float(v * v / size)) for v in s])
    each = y.select("key", "deviation", F.posexplode(F.arrays_zip("y", shares.alias("share"))).alias("i", "v"))
    return each.select("key", (F.col("i") + 1).cast("int").alias("component"), F.lit(c.n).cast("long").alias("n"), "deviation", F.col("v.y").alias("whitened"), F.col("v.share").alias("explained"), F.lit(error).alias("identity_error"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumnRenamed("key", "vec_id")
