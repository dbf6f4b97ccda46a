"""Whitening of embeddings by their leading principal components.

The components are found by block Lanczos without ever forming the covariance: each step is one pass
over the vectors, in which every task centres its rows X, multiplies them, and adds up its part of
X'X Q for the block Q; the parts (dimension x block numbers) are summed in a shuffle.  New blocks are
orthogonalised against the whole basis, twice.  Directions that vanish (breakdown: the space found so
far is invariant) are replaced by random ones orthogonal to it, so that no component is missed.  It ends
when the residuals |Vu - eu| of the wanted components are at rounding level, or don't fall any more
just above it, or when the basis spans the space.

Entries are taken as whole numbers x = floor(scale * entry), so that sums and deviations are exact.
The mean and the covariance (divisor n) are over the distinct vectors, the fit list.  A row's deviation
is the sum over dimensions of (n*x - S)^2; over n^2 it is the squared distance from the mean, and its
sum over the fit list gives the trace, against which a component's explained share is stated.

What the driver holds is bounded by the dimension, not by the rows: sums of each dimension and a basis
of at most dimension x dimension doubles.

Defined results: rows whose vector is null or empty, or holds a null, NaN or infinite entry, are left
out, and so are vectors of another dimension than most rows have (of equally frequent dimensions the
largest counts); rows of one id, null ids too, are separate rows; components without variance (relative
to the first) are not reported, so that equal vectors, a single one or an empty table give no rows;
components of equal variance are any orthonormal basis of theirs; input columns named deviation or
whitened are replaced.  A deviation beyond 38 digits is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _common as C

SCALE, COMPONENTS, SEED = 256, 4, 13
#: Residuals relative to the first eigenvalue: of rounding, and below which a standstill ends the search.
ROUNDING, STILL = 2e-15, 1e-11
#: Variance under this share of the first component's is rounding.
NO_VARIANCE = 1e-12

OUT = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])


class Model(NamedTuple):
    """n distinct vectors, their sums, and of each component its variance, direction and share."""

    n: int
    sums: list[int]
    variance: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float
    passes: int


def whole(column: str, scale: int = SCALE) -> Column:
    """A vector as whole numbers; null if it is null or empty or an entry is null or not finite."""
    c = F.col(f"`{column}`").cast("array<double>")
    bad = F.exists(c, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))
    return F.when(c.isNotNull() & (F.size(c) > 0) & ~bad, F.transform(c, lambda e: F.floor(e * scale).cast("long")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _summed(vectors: DataFrame, cells: int, of: Callable[[np.ndarray], np.ndarray], kind: T.DataType) -> list:
    """Sum over all rows of ``of`` (a matrix to ``cells`` numbers): a task adds up its own, a shuffle the rest."""
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("value", kind)])
    exact = isinstance(kind, T.DecimalType)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in parts:
            if b.num_rows:
                own = of(_matrix(b["x"]))
                total = own if total is None else total + own
        if total is not None:
            values = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0)) if exact else pa.array(total.astype(np.float64))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells, dtype=np.int32)), values], schema.names)

    rows = vectors.mapInArrow(run, schema).groupBy("cell").agg(F.sum("value").cast(kind).alias("value")).collect()
    found = {r.cell: r.value for r in rows}
    return [found[i] for i in range(cells)]


def _exact_sums(x: np.ndarray) -> np.ndarray:
    safe = np.abs(x.astype(float)).max() * len(x) < 2**62
    return np.append((x if safe else x.astype(object)).sum(0).astype(object), len(x))


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact: in 64 bits where they do, else in Python's whole numbers."""
    widest = np.abs(x.astype(float)).max() * n + max(map(abs, sums))
    if widest**2 * x.shape[1] < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1)
    return ((n * x.astype(object) - np.array(sums, object)) ** 2).sum(1)


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, int]:
    """Largest k eigenvalues and eigenvectors of a symmetric d x d matrix known by its products; and the steps."""
    k, dice = min(k, d), np.random.default_rng(seed)
    block = np.linalg.qr(dice.standard_normal((d, k)))[0]
    basis, products = np.zeros((d, 0)), np.zeros((d, 0))
    best, idle, steps = np.inf, 0, 0
    while True:
        steps += 1
        product = times(block)
        basis, products = np.hstack((basis, block)), np.hstack((products, product))
        small = basis.T @ products
        values, y = np.linalg.eigh((small + small.T) / 2)
        values, y = values[::-1][:k], y[:, ::-1][:, :k]
        vectors = basis @ y
        residual = np.linalg.norm(products @ y - vectors * values, axis=0).max()
        scale = max(abs(values[0]), np.finfo(float).tiny)
        idle = 0 if residual < best / 2 else idle + 1
        best = min(best, residual)
        if basis.shape[1] == d or residual <= ROUNDING * scale or (idle >= 2 and best <= STILL * scale):
            return values, np.linalg.qr(vectors)[0], steps
        block = _next_block(basis, product, min(k, d - basis.shape[1]), dice)


def _next_block(basis: np.ndarray, product: np.ndarray, width: int, dice: np.random.Generator) -> np.ndarray:
    """``width`` orthonormal directions orthogonal to the basis, from ``product`` as far as it has any."""
    out = np.zeros((len(basis), 0))
    size = max(np.linalg.norm(product, axis=0).max(), np.finfo(float).tiny)
    candidates = list((product / size).T)
    while out.shape[1] < width:
        v = candidates.pop(0) if candidates else dice.standard_normal(len(basis))
        before = np.linalg.norm(v)
        all_ = np.hstack((basis, out))
        for _ in range(2):
            v = v - all_ @ (all_.T @ v)
        left = np.linalg.norm(v)
        if left > 1e-10 * max(before, 1e-3):  # else a breakdown: this direction adds nothing
            v = v / left
            v = v - all_ @ (all_.T @ v)
            out = np.hstack((out, (v / np.linalg.norm(v))[:, None]))
    return out


def _usable(rows: DataFrame, column: str, scale: int, name: str) -> DataFrame:
    """``rows`` with their whole vector as ``name``, of usable vectors of the commonest dimension only."""
    rows = rows.withColumn(name, whole(column, scale)).where(F.col(name).isNotNull())
    sizes = rows.groupBy(F.size(name).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = sizes.orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size(name) == (common.d if common else 0))


def fit(vectors: DataFrame, k: int = COMPONENTS) -> Model | None:
    """The model of distinct whole vectors ``x`` of one dimension; None if there are none."""
    first = vectors.select(F.size("x").alias("d")).first()
    if first is None:
        return None
    d = first.d
    *sums, n = map(int, _summed(vectors, d + 1, _exact_sums, T.DecimalType(38, 0)))
    mean = np.array([s / n for s in sums])
    spread = _summed(vectors, 1, lambda x: np.array([float(sum(int(v) for v in _deviations(x, n, sums))) / n / n]), T.DoubleType())
    trace = spread[0] / n

    def times(block: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            centred = x - mean
            return (centred.T @ (centred @ block)).ravel()

        return np.array(_summed(vectors, block.size, part, T.DoubleType())).reshape(block.shape) / n

    if trace == 0:
        return Model(n, sums, np.zeros(0), np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    variance, directions, passes = lanczos(times, d, k)
    real = variance > NO_VARIANCE * variance[0]
    variance, directions = variance[real], directions[:, real]
    m, factor = len(variance), directions / np.sqrt(variance)

    def moments(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ factor
        return np.append((w.T @ w).ravel(), w.sum(0))

    found = np.array(_summed(vectors, m * m + m, moments, T.DoubleType())) / n
    centre = found[m * m :]
    error = np.abs(found[: m * m].reshape(m, m) - np.outer(centre, centre) - np.eye(m)).max()
    return Model(n, sums, variance, directions, variance / trace, float(error), passes)


def whiten(rows: DataFrame, column: str = "embedding", k: int = COMPONENTS, scale: int = SCALE) -> tuple[DataFrame, Model | None]:
    """``rows`` without the vector, with deviation (a whole number) and whitened (k numbers at most); and the model."""
    keep = [c for c in rows.columns if c != column and c.lower() not in {f.name for f in OUT}]
    source = rows.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{column}`").alias("v"))
    usable = _usable(source, "v", scale, "x").drop("v")
    vectors = C.materialise(usable.select("x").distinct(), "vectors")
    model = fit(vectors, k)
    C.discard(vectors)
    schema = T.StructType([T.StructField(c, rows.schema[c].dataType) for c in keep] + list(OUT.fields))
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, variance, directions, *_ = shared.value
        mean, factor = np.array([s / n for s in sums]), directions / np.sqrt(variance)
        for b in parts:
            if not b.num_rows:
                continue
            x = _matrix(b["x"])
            w = (x - mean) @ factor
            exact = [Decimal(int(v)) if abs(int(v)) < 10**38 else None for v in _deviations(x, n, sums)]
            listed = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(exact, pa.decimal128(38, 0)), listed], schema.names)

    given = usable.select(*[f"k{i}" for i in range(len(keep))], "x")
    return (given if model else given.where(F.lit(False))).mapInArrow(run, schema), model


def query(spark, sf_dir: str) -> DataFrame:
    found, model = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    shares = F.array(*[F.lit(float(x)) for x in (model.explained if model else ())]).cast("array<double>")
    each = found.select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        "vec_id",
        (F.col("i") + 1).cast("int").alias("component"),
        F.lit(model.n if model else 0).cast("long").alias("n"),
        F.col("deviation").try_cast("long").alias("deviation"),
        "whitened",
        F.get(shares, F.col("i")).alias("explained"),
        F.lit(model.identity_error if model else 0.0).alias("identity_error"),
    )
