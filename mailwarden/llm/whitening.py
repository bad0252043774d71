"""Embedding whitening from a covariance weighted by multiplicity.

Entries become long numbers ``x = floor(256 c)``. Identical x-vectors are grouped first, so the fit, the projection and
the exact deviation are computed once per distinct vector; rows meet them again by the digest of their x-vector.

1. (digest, x, copies): one aggregation, combined map-side, so copies of a vector cost one row per task; written once.
2. Exact weighted sums per dimension, then the weighted covariance: each task centres its blocks, multiplies them (GEMM)
   and returns one matrix of the vectors' dimension; Spark adds these. The driver sees d sums and d x d products, which
   the dimension bounds, never a row.
3. Eigenvectors of that matrix on the driver; every distinct vector is projected once, the results are written.
4. Narrow rows (id, digest) join the results. Both sides are plain exchanges, so AQE splits the digest of a vector that
   holds a third of all rows.

Defined cases: a row whose vector is null or holds a null, NaN or infinite entry has no result. Vectors shorter than the
longest one are filled up with zeros. Entries beyond a long saturate. Repeated rows and ids each get their rows. A
component without variance (eigenvalue at rounding error) has a null ``whitened``; with no variance at all ``explained``
and ``identity_error`` are null. A deviation beyond a long is null. An empty table, or one without a valid vector, gives
no rows. Extra columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from mailwarden.llm.common import written

#: Largest magnitude that a sum of longs may reach in 64 bits.
LONG = 2 ** 63 - 1
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


class Model(NamedTuple):
    """Fitted on the distinct vectors: total weight, sums per dimension, eigenvalues (falling), unit eigenvectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def valid(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(
        F.col(vector), lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))


def _numbers(vector: str, d: int, scale: float) -> Column:
    x = F.transform(F.col(vector), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(0).cast("long"))
    return F.concat(x, F.array_repeat(F.lit(0).cast("long"), d - F.size(vector)))


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of (key, x, w) with x as a matrix of longs and w as a vector."""
    for batch in batches:
        if batch.num_rows:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, d)
            yield batch, x, batch.column(2).to_numpy(zero_copy_only=False)


def _exact(x: np.ndarray, bound: int) -> np.ndarray:
    """Longs where ``bound`` fits in them, else Python integers: the same values."""
    return x if bound <= LONG else x.astype(object)


def _weighted_sums(distinct: DataFrame, d: int) -> tuple[int, list[int]]:
    """Total weight and the exact weighted sum per dimension (position -1 holds the weight)."""
    def add(batches):
        total, sums = 0, [0] * d
        for _, x, w in _blocks(batches, d):
            weight = int(w.sum())
            top = max(abs(int(x.min())), abs(int(x.max())))
            part = (_exact(x, top * weight) * w[:, None]).sum(axis=0)
            total, sums = total + weight, [a + int(b) for a, b in zip(sums, part)]
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(-1, d), pa.int32()), pa.array([Decimal(v) for v in [total, *sums]], pa.decimal128(38, 0))], names=["i", "s"])

    rows = distinct.select("key", "x", "w").mapInArrow(add, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s"))
    found = {r["i"]: int(r["s"]) for r in rows.collect()}          # one row per dimension
    return found.get(-1, 0), [found.get(i, 0) for i in range(d)]


def _covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Weighted covariance with divisor n, centred before multiplying."""
    d = len(sums)
    mean = np.array([s / n for s in sums])
    upper = np.triu_indices(d)

    def multiply(batches):
        total = np.zeros((d, d))
        for _, x, w in _blocks(batches, d):
            centred = x.astype(float) - mean
            total += centred.T @ (centred * w[:, None])
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], names=["i", "j", "v"])

    rows = distinct.select("key", "x", "w").mapInArrow(multiply, "i int, j int, v double")
    out = np.zeros((d, d))
    for r in rows.groupBy("i", "j").agg(F.sum("v").alias("v")).collect():      # d (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def fit(distinct: DataFrame, d: int) -> Model | None:
    """Weighted mean and covariance of a table (key, x, w) and the eigenvectors of the latter."""
    n, sums = _weighted_sums(distinct, d)
    if not n:
        return None
    v = _covariance(distinct, n, sums)
    values, vectors = np.linalg.eigh(v)
    return Model(n, sums, values[::-1], vectors[:, ::-1], float(np.trace(v)))


def _deviation(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over the dimensions of (n x - S)^2, exact; None where it is beyond a long."""
    top = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    whole = _exact(x, len(sums) * top * top)
    apart = whole * n - np.array(sums, dtype=whole.dtype)
    return [int(v) if v <= LONG else None for v in (apart * apart).sum(axis=1)]


def _projected(distinct: DataFrame, model: Model, k: int) -> DataFrame:
    """(key, deviation, z): every distinct vector projected once; z has a null for a component without variance."""
    d = len(model.sums)
    mean = np.array([s / model.n for s in model.sums])
    least = d * np.finfo(float).eps * max(float(model.values[0]), 0.0)
    live = model.values[:k] > least
    scale = np.sqrt(np.where(live, model.values[:k], 1.0))
    basis = model.vectors[:, :k]
    kinds = pa.schema([("key", pa.string()), ("deviation", pa.int64()), ("z", pa.list_(pa.float64()))])

    def project(batches):
        for batch, x, _ in _blocks(batches, d):
            z = (x.astype(float) - mean) @ basis / scale
            rows = [[float(v) if a else None for v, a in zip(r, live)] for r in z]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.string()), pa.array(_deviation(x, model.n, model.sums), pa.int64()), pa.array(rows, kinds.field("z").type)], schema=kinds)

    return distinct.select("key", "x", "w").mapInArrow(project, "key string, deviation long, z array<double>")


def identity_error(projected: DataFrame, weights: DataFrame | None, live: list[int]) -> float | None:
    """Largest absolute entry of the whitened covariance minus the identity, over the fit list."""
    if not live:
        return None
    rows = projected.withColumn("w", F.lit(1).cast("long")) if weights is None else projected.join(weights, "key")
    w = F.col("w").cast("double")
    z = {i: F.col("z")[i] for i in live}
    first = rows.agg(F.sum(w).alias("n"), *[F.sum(w * z[i]).alias(f"m{i}") for i in live]).first()
    gap = {i: z[i] - F.lit(first[f"m{i}"] / first["n"]) for i in live}
    pairs = [(i, j) for i in live for j in live if i <= j]
    second = rows.agg(*[F.sum(w * gap[i] * gap[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(second[f"c{i}_{j}"] / first["n"] - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, components: int = 4,
           weights: str = "one") -> DataFrame:
    """Whitened coordinates of every valid row on the first principal components.

    ``weights`` says what a distinct vector counts in the fit: "one", or its "counts" of rows. Returns ``key`` and the
    columns of ``SCHEMA``, one row per valid row and component.
    """
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("vec_id"), F.col(vector).alias("_v")).filter(valid("_v"))
    d = rows.agg(F.max(F.size("_v"))).first()[0] or 0
    k = min(components, d)
    if not k:
        return spark.createDataFrame([], SCHEMA).withColumnRenamed("vec_id", key)
    numbered = rows.select("vec_id", _numbers("_v", d, scale).alias("x")).withColumn("key", F.sha2(F.array_join("x", ","), 256))
    counted = numbered.groupBy("key", "x").agg(F.count(F.lit(1)).alias("copies"))
    w = F.col("copies") if weights == "counts" else F.lit(1).cast("long")
    distinct = written(counted.select("key", "x", w.alias("w")), "whitening_distinct")
    model = fit(distinct, d)
    projected = written(_projected(distinct, model, k), "whitening_projected")
    live = [i for i in range(k) if model.values[i] > d * np.finfo(float).eps * max(float(model.values[0]), 0.0)]
    error = identity_error(projected, distinct.select("key", "w") if weights == "counts" else None, live)
    share = [max(float(v), 0.0) / model.trace if model.trace > 0 else None for v in model.values[:k]]
    joined = numbered.select("vec_id", "key").join(projected, "key")
    out = joined.select("vec_id", "deviation", F.posexplode("z").alias("_i", "whitened"))
    return out.select(
        F.col("vec_id").alias(key), (F.col("_i") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.array(*[F.lit(s).cast("double") for s in share])[F.col("_i")].alias("explained"), F.lit(error).cast("double").alias("identity_error"))
