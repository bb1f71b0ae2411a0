"""Whitening of embeddings by incremental eigendecomposition.

A task keeps the spectrum (count, mean, eigenvalues, eigenvectors) of the scatter
of its rows about their mean. New rows enter as rank-one updates: adding
``rho z z'`` to a diagonal matrix moves each eigenvalue to a root of the secular
equation ``1 + rho sum(z_i^2 / (d_i - x)) = 0`` between it and the next one;
directions with no weight in z, or that share their eigenvalue with another, are
deflated first (turned so that all their weight lies in one). A block of rows
enters by the rows of its triangular factor, whose rank-one terms sum to the
block's centred scatter, and by one more update for the move of the mean; so a task
makes at most ``dim + 1`` updates for ``BLOCK_ROWS`` rows. Two spectra combine by
one update for each eigenvector of the other and one for the distance of the
means; tasks' spectra are combined as a tree, ``FAN_IN`` at a time.

The combined eigenvectors are a basis near the components. The refinement projects
all centred rows on it once more, sums their products over the tasks
(Rayleigh-Ritz), and the eigenvectors of that small, almost diagonal matrix turn
the basis into the components, accurate to double precision.

Defined cases: a vector that is null, holds null or non-finite entries, or is
shorter than the longest vector takes no part; entries are bounded to 2**52
after scaling; directions whose eigenvalue is at most ``FLAT`` of the largest have
no whitening and are left out, so equal rows or one row alone give no rows; a repeated
row counts as often as it occurs and comes out as often; a null key is kept;
a deviation beyond 64 bits is null; empty table -> no rows; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from georisk.llm.common import table, written
from georisk.llm.topk import usable

SCALE, SHIFT, LARGEST = 1024, 100_000, float(1 << 52)
BLOCK_ROWS = 8192
FAN_IN = 16
#: Shares of the largest eigenvalue: below it weights and gaps are deflated, below it a direction is flat.
DEFLATE = 1e-15
FLAT = 1e-12


def scaled(vector: str) -> Column:
    """Entries as whole numbers: floor(1024 * entry) + 100000."""
    return F.transform(F.col(vector), lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * F.lit(float(SCALE)), F.lit(-LARGEST)), F.lit(LARGEST))) + F.lit(SHIFT))


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """The roots of the secular equation as (index of the pole they are measured from, distance).

    ``d`` rises strictly, no z is 0, rho > 0: root i lies between d_i and d_i+1, the
    last one below d_n + rho z'z. Each is measured from the nearer pole, so its distances
    to the poles around it keep all their digits; it is found by bisection.
    """
    n, w = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    middle = d + gap / 2

    def value(pole, x):
        return 1 + (w / ((d[None, :] - d[pole][:, None]) - x[:, None])).sum(axis=1)

    index = np.arange(n)
    with np.errstate(divide="ignore", invalid="ignore"):
        right = value(index, middle - d) < 0  # the root lies in the right half
        right[-1] = False
        pole = np.where(right, index + 1, index).clip(max=n - 1)
        low = np.where(right, -gap / 2, 0.0)
        high = np.where(right, 0.0, gap / 2)
        high[-1] = gap[-1]
        for _ in range(80):
            x = (low + high) / 2
            rising = value(pole, x) < 0  # f rises from -inf to +inf between poles
            low, high = np.where(rising, x, low), np.where(rising, high, x)
    x = (low + high) / 2
    return pole, np.where(x == 0, np.where(pole > index, low, high), x)


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum of ``vectors diag(values) vectors' + direction direction'``; values rise."""
    z = vectors.T @ direction
    norm = float(np.sqrt(z @ z))
    if not norm:
        return values, vectors
    rho, z = norm * norm, z / norm
    least = DEFLATE * max(abs(values[-1]), rho)
    keep = np.abs(z) * rho > least  # the others keep eigenvalue and eigenvector
    vectors = vectors.copy()
    at = np.flatnonzero(keep)
    for i, j in zip(at[:-1], at[1:]):  # equal eigenvalues: turn the pair so that all weight is in the second
        if values[j] - values[i] <= least:
            r = math.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            vectors[:, [i, j]] = np.stack([c * vectors[:, i] - s * vectors[:, j], s * vectors[:, i] + c * vectors[:, j]], axis=1)
            z[i], z[j], keep[i] = 0.0, r, False
    at = np.flatnonzero(keep)
    if len(at):
        d = values[at]
        pole, x = secular_roots(d, z[at], rho)
        apart = (d[:, None] - d[pole][None, :]) - x[None, :]  # d_i - root_j, with all its digits
        # The weights for which these roots are exact (Loewner), so that eigenvectors are orthogonal.
        poles = np.abs(d[:, None] - d[None, :])
        np.fill_diagonal(poles, 1.0)
        logs = np.log(np.abs(apart)).sum(axis=1) - np.log(poles).sum(axis=1)
        exact = np.copysign(np.sqrt(np.exp(logs)), z[at])
        turn = exact[:, None] / apart
        turn /= np.sqrt((turn * turn).sum(axis=0))
        vectors[:, at] = vectors[:, at] @ turn
        values = values.copy()
        values[at] = d[pole] + x
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


class Spectrum:
    """Count, sums of the whole entries, and the spectrum of the scatter about the mean."""

    def __init__(self, dim: int):
        self.n, self.sums = 0, np.zeros(dim, np.int64)
        self.mean, self.values, self.vectors = np.zeros(dim), np.zeros(dim), np.eye(dim)

    def _moved(self, n: int, mean: np.ndarray) -> None:
        """The update for rows joined by ``n`` others with another mean."""
        total = self.n + n
        apart = mean - self.mean
        if self.n and n:
            self.values, self.vectors = rank_one(self.values, self.vectors, apart * math.sqrt(self.n * n / total))
        self.mean, self.n = self.mean + apart * (n / total), total

    def add(self, rows: np.ndarray) -> None:
        """A block of rows of whole numbers."""
        mean = rows.mean(axis=0)
        centred = rows - mean
        for r in np.linalg.qr(centred, mode="r") if len(rows) > 1 else ():
            self.values, self.vectors = rank_one(self.values, self.vectors, r)
        self.sums += rows.sum(axis=0)
        self._moved(len(rows), mean)

    def combine(self, other: Spectrum) -> None:
        for value, vector in zip(other.values, other.vectors.T):
            if value > 0:
                self.values, self.vectors = rank_one(self.values, self.vectors, vector * math.sqrt(value))
        self.sums += other.sums
        self._moved(other.n, other.mean)

    SCHEMA = "n bigint, sums array<bigint>, mean array<double>, spectrum array<double>, vectors array<double>"

    def row(self) -> list[list]:
        return [[self.n], [self.sums.tolist()], [self.mean.tolist()], [self.values.tolist()], [self.vectors.ravel().tolist()]]

    @classmethod
    def of(cls, n, sums, mean, spectrum, vectors) -> Spectrum:
        out = cls(len(sums))
        out.n, out.sums, out.mean = n, np.array(sums, np.int64), np.array(mean)
        out.values, out.vectors = np.array(spectrum), np.array(vectors).reshape(len(sums), len(sums))
        return out


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy().reshape(-1, dim)


def _tree(parts: DataFrame, merge, schema: str, name: str) -> DataFrame:
    """One row from one row per task, ``FAN_IN`` at a time; parts carry ``task``."""
    parts = written(parts, name)
    left = (parts.agg(F.max("task")).first()[0] or 0) + 1
    while True:
        left = -(-left // FAN_IN)
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN_IN).cast("int")).groupBy("task").applyInArrow(
            merge, f"task int, {schema}")
        if left == 1:
            return parts.drop("task")


def spectrum(rows: DataFrame, dim: int) -> Spectrum | None:
    """The combined spectrum of ``rows`` (x: arrays of ``dim`` whole numbers); None without rows."""
    def partial(batches):
        out, task = Spectrum(dim), TaskContext.get().partitionId()
        for b in batches:
            x = _matrix(b.column(0), dim)
            for at in range(0, len(x), BLOCK_ROWS):
                out.add(x[at: at + BLOCK_ROWS])
        if out.n:
            yield pa.RecordBatch.from_pydict(dict(zip(names, [pa.array(c, t) for c, t in zip([[task], *out.row()], types)])))

    def merge(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        rows.sort(key=lambda r: (r["n"], r["sums"]))
        out = Spectrum(dim)
        for r in rows:
            r = {k: v for k, v in r.items() if k != "task"}
            part = Spectrum.of(**r)
            if out.n:
                out.combine(part)
            else:
                out = part
        return pa.Table.from_pydict(dict(zip(names, [pa.array(c, t) for c, t in zip([[group["task"][0].as_py()], *out.row()], types)])))

    names = ["task", "n", "sums", "mean", "spectrum", "vectors"]
    types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.float64())] * 3]
    parts = rows.select("x").mapInArrow(partial, f"task int, {Spectrum.SCHEMA}")
    found = _tree(parts, merge, Spectrum.SCHEMA, "whiten-spectra").collect()  # one row
    return Spectrum.of(**found[0].asDict()) if found else None


def refine(rows: DataFrame, found: Spectrum) -> tuple[np.ndarray, np.ndarray]:
    """Rayleigh-Ritz over all rows: (values, vectors) of their covariance, values falling."""
    dim, mean, basis = len(found.sums), found.sums / found.n, np.linalg.qr(found.vectors)[0]
    shipped = rows.sparkSession.sparkContext.broadcast((mean, basis))
    names, types = ["task", "products"], [pa.int32(), pa.list_(pa.float64())]

    def packed(task, products):
        return pa.Table.from_pydict({"task": pa.array([task], types[0]), "products": pa.array([products.ravel().tolist()], types[1])})

    def partial(batches):
        mean, basis = shipped.value
        products, task = np.zeros((dim, dim)), TaskContext.get().partitionId()
        for b in batches:
            x = _matrix(b.column(0), dim)
            for at in range(0, len(x), BLOCK_ROWS):
                y = (x[at: at + BLOCK_ROWS] - mean) @ basis
                products += y.T @ y
        yield from packed(task, products).to_batches()

    def merge(group: pa.Table) -> pa.Table:
        sums = np.array(sorted(group["products"].to_pylist())).sum(axis=0)
        return packed(group["task"][0].as_py(), sums)

    parts = rows.select("x").mapInArrow(partial, "task int, products array<double>")
    total = np.array(_tree(parts, merge, "products array<double>", "whiten-products").first()["products"]).reshape(dim, dim)
    values, turn = np.linalg.eigh((total + total.T) / (2 * found.n))
    vectors = basis @ turn
    return values[::-1], (vectors / np.sqrt((vectors * vectors).sum(axis=0)))[:, ::-1]


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = 8) -> DataFrame:
    """(key, n, deviation, whitened, explained, identity_error) of every usable row: ``whitened`` and
    ``explained`` are arrays over the components, at most ``components`` of them."""
    good = df.where(usable(vector) & (F.size(vector) > 0)).select(F.col(f"`{key}`").alias("key"), scaled(vector).alias("x"))
    dim = good.agg(F.max(F.size("x"))).first()[0] or 0
    rows = written(good.where(F.size("x") == dim), "whiten-rows")
    found = spectrum(rows, dim) if dim else None
    values, vectors = refine(rows, found) if found else (np.zeros(0), np.zeros((0, 0)))
    k = int((values[:components] > FLAT * max(values[0], 0)).sum()) if len(values) and values[0] > 0 else 0
    if not k:
        schema = "n bigint, deviation bigint, whitened array<double>, explained array<double>, identity_error double"
        return rows.where("false").select(F.col("key").alias(key), *[F.lit(None).cast(c.split(" ")[1]).alias(c.split(" ")[0])
                                                                      for c in schema.split(", ")])
    n, sums, explained = found.n, found.sums, (values[:k] / values.sum()).tolist()
    shipped = df.sparkSession.sparkContext.broadcast((sums, sums / n, vectors[:, :k] / np.sqrt(values[:k])))

    def run(batches):
        sums, mean, turn = shipped.value
        for b in batches:
            x = _matrix(b.column(1), dim)
            white = (x - mean) @ turn
            apart = n * x - sums
            fits = (apart.astype(float) ** 2).sum(axis=1) < 2.0**62
            close = pa.array((apart * apart).sum(axis=1), mask=~fits)
            if not fits.all():  # exact for these few, null where beyond 64 bits
                exact = [sum(v * v for v in map(int, r)) for r in apart[~fits]]
                whole = close.to_pylist()
                for i, v in zip(np.flatnonzero(~fits), exact):
                    whole[i] = v if v < 1 << 63 else None
                close = pa.array(whole, pa.int64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * k, pa.int32()), pa.array(white.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), close, lists], names=["key", "deviation", "whitened"])

    white = written(rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, deviation bigint, whitened array<double>"),
                    "whiten-whitened")
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    off = white.agg(*[F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(off[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return white.select(F.col("key").alias(key), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                        F.array(*map(F.lit, explained)).alias("explained"), F.lit(float(error)).alias("identity_error"))


def op12_whitening(spark, sf_dir):
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), "n", "deviation",
                       F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
