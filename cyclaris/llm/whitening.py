"""Whitening of embeddings by their leading principal components, found by a matrix-free block Lanczos method.

Entries become whole numbers x = floor(256 * entry), so counts, sums and deviations are exact. The model is fitted on each
distinct x vector once. The covariance matrix is never formed: a pass over the fit list gives (X - mean)' (X - mean) v for a
block v of a few vectors, as one small sum for each task, added up by a second stage and on the driver. The driver holds
vectors of the embedding's dimension only: the block, and a basis of at most STEPS blocks.

Each new block is orthogonalised twice against the whole basis. Where it breaks down (directions without anything new), random
directions outside the basis take their place, until the basis spans the whole space, which is exact. Ritz pairs are accepted
by their true residuals, found in a pass of their own; else the iteration starts anew from the best ones. The trace comes from
the summed deviations, so the explained shares need no further eigenvalue.

Defined cases: rows whose vector is null or empty, or holds null or non-finite entries, are dropped, and so are rows of another
length than that of most distinct vectors (ties: the longer); entries beyond the range of a long count as its nearest
end; repeated rows and vectors get equal results; components without variance (all of them if there is one vector only) have no
rows; of equal eigenvalues any orthonormal vectors stand; null ids are carried; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

COMPONENTS, SCALE = 4, 256
#: Vectors of a block beyond the components asked for, blocks of a basis, starts, and residual relative to the largest eigenvalue.
EXTRA, STEPS, STARTS, TOLERANCE = 4, 24, 20, 1e-13
#: A block's direction counts as broken down when this share of it, or less, is new.
BREAKDOWN = 1e-11


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """rows that have a vector of finite entries, with x: their entries as whole numbers."""
    v = F.col(f"`{vector}`")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(math.inf)))
    # try_: an entry may be beyond a long's range, and is then its nearest end
    end = F.lit((1 << 63) - 1)

    def whole(c: Column) -> Column:
        y = F.floor(F.lit(float(SCALE)) * c.cast("double"))
        big = F.lit(float(SCALE)) * c.cast("double")
        return F.when(big >= F.lit(2.0**63), end).when(big < F.lit(-(2.0**63)), -end - 1).otherwise(y)

    return rows.where((F.size(v) > 0) & F.coalesce(fine, F.lit(False))).withColumn("x", F.transform(v, whole))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a column of lists of longs."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Of each row, the sum of (n * x - sums)^2, exactly; Python's whole numbers where longs could run over."""
    far = max(abs(int(x.min())), abs(int(x.max())), 1) * n + max(map(abs, sums))
    if far * far * x.shape[1] < 1 << 63:
        d = n * x - np.array(sums, np.int64)
        return (d * d).sum(axis=1)
    d = n * x.astype(object) - np.array(sums, object)
    return (d * d).sum(axis=1)


def _summed(rows: DataFrame, each: Callable[[np.ndarray], np.ndarray], dim: int, size: int) -> np.ndarray:
    """The sum over all rows of what each(matrix of a batch) gives: an array of `size` doubles.

    A task gives one row, a second stage adds up about the square root as many, and the driver the rest.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += each(_matrix(b.column(0), dim)).ravel()
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += b.column(0).flatten().to_numpy().reshape(-1, size).sum(axis=0)
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = rows.select("x").mapInArrow(add, "v array<double>")
    groups = max(1, math.isqrt(rows.rdd.getNumPartitions()))
    if groups > 1:
        parts = parts.repartition(groups).mapInArrow(again, "v array<double>")
    return np.sum([r[0] for r in parts.collect()], axis=0)


@dataclass
class Whitening:
    """n distinct vectors with the sums of their entries; unit eigenvectors (columns) of their covariance, falling eigenvalues
    and the residuals of these, the trace, and the largest error of the whitened covariance against the identity."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    trace: float
    identity_error: float
    passes: int

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def _orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Unit columns orthogonal to the basis and to each other that hold what is new in block; where a column brings nothing new,
    a random one stands in. Fewer columns if the space has no more."""
    dim, out = len(block), basis
    for column in block.T:
        if out.shape[1] >= dim:
            break
        for _ in range(8):
            size = np.linalg.norm(column)
            v = column / size if size > 0 else column
            v = v - out @ (out.T @ v)
            left = np.linalg.norm(v)
            if size > 0 and left > BREAKDOWN:
                v = v / left
                v = v - out @ (out.T @ v)
                out = np.column_stack((out, v / np.linalg.norm(v)))
                break
            column = rng.standard_normal(dim)
    return out[:, basis.shape[1] :]


def lanczos(
    apply: Callable[[np.ndarray], np.ndarray], dim: int, k: int = COMPONENTS, extra: int = EXTRA, steps: int = STEPS,
    starts: int = STARTS, tolerance: float = TOLERANCE, seed: int = 42,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues of a symmetric operator, their unit vectors (columns), true residuals, and the passes taken.

    apply(block) gives the operator's product with a block of columns.
    """
    rng, passes, k = np.random.default_rng(seed), 0, min(k, dim)
    block = rng.standard_normal((dim, min(dim, k + extra)))
    for start in range(starts):
        basis, images = np.zeros((dim, 0)), np.zeros((dim, 0))
        block = _orthonormal(block, basis, rng)
        for _ in range(steps):
            image = apply(block)
            passes += 1
            basis, images = np.column_stack((basis, block)), np.column_stack((images, image))
            small = basis.T @ images
            values, turned = np.linalg.eigh((small + small.T) / 2)
            values, turned = values[::-1], turned[:, ::-1]
            scale = max(abs(values[0]), np.finfo(float).tiny)
            ritz = basis @ turned
            estimate = np.linalg.norm(images @ turned[:, :k] - ritz[:, :k] * values[:k], axis=0)
            if (estimate <= tolerance * scale).all() or basis.shape[1] >= dim:
                break
            block = _orthonormal(image, basis, rng)
        best = np.linalg.qr(ritz[:, : min(dim, k + extra)])[0]
        image = apply(best)  # the images of the basis have met rounding on their way; these are new
        passes += 1
        small = best.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        values, vectors = values[::-1][:k], (best @ turned)[:, ::-1][:, :k]
        residuals = np.linalg.norm((image @ turned)[:, ::-1][:, :k] - vectors * values, axis=0)
        if (residuals <= 10 * tolerance * max(abs(values[0]), np.finfo(float).tiny)).all():
            return values, vectors, residuals, passes
        block = best
    raise ArithmeticError(f"eigenvectors haven't converged: residuals {residuals} of eigenvalues {values}")


def fit(rows: DataFrame, k: int = COMPONENTS) -> Whitening | None:
    """The model of quantised rows (column x), or None if there are none."""
    distinct = written(rows.select("x").distinct(), "fit-list")
    # A row for each length that vectors have.
    lengths = [tuple(r) for r in distinct.groupBy(F.size("x")).count().collect()]
    if not lengths:
        return None
    dim, n = max(lengths, key=lambda r: (r[1], r[0]))
    distinct = distinct.where(F.size("x") == dim)
    exact = distinct.select(F.posexplode("x").alias("i", "e")).groupBy("i").agg(F.sum(F.col("e").cast("decimal(38,0)")).alias("s"))
    sums = [int(r["s"]) for r in exact.orderBy("i").collect()]  # one for each dimension
    mean = np.array([s / n for s in sums])

    def deviations(x: np.ndarray) -> np.ndarray:
        return np.array([math.fsum(float(d) for d in _exact(x, n, sums))])

    trace = float(_summed(distinct, deviations, dim, 1)[0]) / n**3

    def apply(block: np.ndarray) -> np.ndarray:
        def product(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return centred.T @ (centred @ block)

        return _summed(distinct, product, dim, block.size).reshape(block.shape) / n

    values, vectors, residuals, passes = lanczos(apply, dim, k)
    some = values > dim * np.finfo(float).eps * max(trace, 0)
    values, vectors, residuals = values[some], vectors[:, some], residuals[some]
    model = Whitening(n, sums, vectors, values, residuals, trace, 0.0, passes)
    if len(values):
        directions = vectors / np.sqrt(values)
        middle = _summed(distinct, lambda x: ((x - mean) @ directions).sum(axis=0), dim, len(values)) / n

        def squares(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ directions - middle
            return w.T @ w

        covariance = _summed(distinct, squares, dim, len(values) ** 2).reshape(len(values), -1) / n
        model.identity_error = float(np.abs(covariance - np.eye(len(values))).max())
    return model


def whitened(rows: DataFrame, model: Whitening, key: str = "vec_id") -> DataFrame:
    """key, deviation (exact, decimal) and whitened (an array, a number for each component) of each quantised row."""
    n, sums, mean = model.n, model.sums, model.mean
    directions = model.vectors / np.sqrt(model.values)
    dim = len(sums)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import decimal

        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1), dim)
                w = (x - mean) @ directions
                far = [decimal.Decimal(int(d)) for d in _exact(x, n, sums)]
                far = pa.array([d if d.adjusted() < 38 else None for d in far], pa.decimal128(38, 0))
                offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * directions.shape[1])
                yield pa.record_batch([b.column(0), far, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], [key, "deviation", "whitened"])

    kind = rows.select(key).schema[key].dataType.simpleString()
    fitting = rows.where(F.size("x") == dim).select(key, "x")
    return fitting.mapInArrow(project, f"`{key}` {kind}, deviation decimal(38,0), whitened array<double>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long's range is null; `whitened` has it as a decimal."""
    rows = quantised(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"))
    model = fit(rows)
    if model is None or not len(model.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    made = whitened(rows, model)
    explained = F.array(*(F.lit(float(e / model.trace)) for e in model.values))
    long = made.select("vec_id", F.col("deviation").try_cast("long").alias("deviation"), F.posexplode("whitened").alias("i", "whitened"))
    return long.select(
        "vec_id", (F.col("i") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        explained[F.col("i")].alias("explained"), F.lit(model.identity_error).alias("identity_error"),
    )
