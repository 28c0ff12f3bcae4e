"""Whitening of embeddings by a covariance over distinct integer vectors, weighted by multiplicity.

Each entry c becomes the integer ``x = floor(256 c)``. Identical x vectors are grouped once
by a partial aggregation, so a vector held by a third of all rows costs one row per task
before the shuffle. The fit list holds each distinct vector with weight one (or, with
``weighted=True``, with its number of copies). Its per-dimension sums S are exact integer
sums; the centred vectors ``n x - S`` are multiplied block by block inside the tasks (one
d x d partial product per partition, a weighted GEMM in numpy) and the partials are summed
by a grouped aggregation of d * d cells. Only that d x d matrix reaches the driver, whose
size is fixed by the dimension, not by the rows. Each distinct vector is whitened once by
JVM expressions and joined back to its rows; vectors with many copies go through a
broadcast of a table whose size is counted first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize

SCALE = 256
COMPONENTS = 4
# A distinct vector with more copies than this is joined back by broadcast, not by shuffle.
HOT_ROWS = 100_000
# The largest table of such vectors that may be broadcast.
BROADCAST_BYTES = 64 << 20
# |256 c| at or above this has no exact long floor; such rows are dropped like non-finite ones.
LIMIT = float(2**53)


def integer_vectors(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` with ``x = floor(scale * c)`` as longs, for every usable row.

    Dropped: null vectors, vectors with a null, NaN or infinite entry, entries whose scaled
    value is beyond 2**53, and vectors whose length differs from the table's most common
    length (ties: the longer). Empty vectors of that length stay. Repeated rows stay, each
    as its own row. Only ``vec_id`` and ``embedding`` are read, so other columns of any name
    do not matter. An empty table gives an empty result.
    """
    vec = F.col("embedding")
    usable = vec.isNotNull() & F.forall(
        vec, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < LIMIT)
    )
    rows = embeddings.select(F.col("vec_id"), vec.alias("embedding")).where(usable)
    rows = rows.select(
        "vec_id",
        F.transform("embedding", lambda c: F.floor(c.cast("double") * scale).cast("bigint")).alias("x"),
    )
    lengths = rows.groupBy(F.size("x").alias("d")).count()
    common = lengths.orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return rows
    return rows.where(F.size("x") == common["d"])


def distinct_vectors(xs: DataFrame) -> DataFrame:
    """``(x, copies)``: each distinct vector once, by a grouping that combines map-side."""
    return xs.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact per-dimension sums S of the fit list."""
    n = fit.agg(F.sum("w").cast("decimal(38,0)")).first()[0]
    exploded = fit.select("w", F.posexplode("x").alias("i", "v"))
    sums = dict(
        exploded.groupBy("i").agg(F.sum(F.col("w").cast("decimal(38,0)") * F.col("v")).alias("s")).collect()
    )
    return int(n or 0), [int(sums.get(i, 0)) for i in range(dim)]


def _centred_products(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The matrix of sum over the fit list of w (n x - S)(n x - S)^T, by partials per task."""
    dim = len(sums)
    total = np.asarray(sums, dtype=np.float64)

    def partial(batches):
        acc = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows == 0:
                continue
            values = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            block = values.reshape(batch.num_rows, dim) * float(n) - total
            w = batch.column("w").to_numpy(zero_copy_only=False).astype(np.float64)
            acc += block.T @ (block * w[:, None])
        rows = np.repeat(np.arange(dim), dim)
        cols = np.tile(np.arange(dim), dim)
        yield pa.RecordBatch.from_pydict(
            {"i": rows.astype(np.int32), "j": cols.astype(np.int32), "v": acc.ravel()}
        )

    parts = fit.select("x", "w").mapInArrow(partial, "i int, j int, v double")
    cells = parts.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    out = np.zeros((dim, dim))
    for row in cells:
        out[row["i"], row["j"]] = row["v"]
    return out


def _eigen(cov: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest eigenvalues above rounding and their unit vectors, largest first.

    Each vector's entry of largest magnitude (the first, on ties) is made positive, so the
    sign is the same on every run.
    """
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    floor = 1e-12 * max(float(np.trace(cov)), 0.0)
    keep = [i for i in range(len(values)) if values[i] > floor][:k]
    values, vectors = values[keep], vectors[:, keep]
    for c in range(vectors.shape[1]):
        if vectors[int(np.argmax(np.abs(vectors[:, c]))), c] < 0:
            vectors[:, c] = -vectors[:, c]
    return values, vectors


def _dot_centred(x: Column, mean: list[float], axis: list[float]) -> Column:
    """sum over i of (x_i - mean_i) * axis_i, in double, in the JVM."""
    m = F.array(*[F.lit(float(v)) for v in mean])
    a = F.array(*[F.lit(float(v)) for v in axis])
    terms = F.zip_with(
        F.zip_with(x, m, lambda xi, mi: xi.cast("double") - mi), a, lambda ci, ai: ci * ai
    )
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)


def join_back(rows: DataFrame, table: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` joined to ``table`` on ``key``; ``table`` has one row per key and its copies.

    Keys with more than HOT_ROWS copies are joined by broadcast, since a shuffle would put
    all their rows into one task. There are at most (rows / HOT_ROWS) of them; their table
    is broadcast only when its counted rows times its row width fit BROADCAST_BYTES, and
    otherwise everything takes the shuffle join with adaptive skew splitting.
    """
    hot = table.where(F.col(copies) > HOT_ROWS)
    n_hot = hot.count()
    width = 8 * (len(table.columns) + 64)
    if n_hot == 0 or n_hot * width > BROADCAST_BYTES:
        return rows.join(table, key)
    hot_rows = rows.join(F.broadcast(hot), key)
    cold_rows = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(
        table.where(F.col(copies) <= HOT_ROWS), key
    )
    return hot_rows.unionByName(cold_rows)


RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double"
)


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weighted: bool = False) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    One row per usable row (see ``integer_vectors``) and component 1..``components``.
    Components are unit eigenvectors of the covariance V of the fit list (divisor n, centred
    before multiplying), by falling eigenvalue e; ``whitened`` is (x - S/n) projected on the
    component over sqrt(e), ``explained`` is e / trace(V), ``deviation`` is the exact sum of
    (n x - S)^2, and ``identity_error`` the largest entry of |cov(whitened) - I| over the fit
    list. Components whose eigenvalue is zero (up to rounding) are left out, so a table with
    fewer than two distinct vectors gives no rows; so does an empty one. Repeated rows get
    the same values, each under its own ``vec_id``.
    """
    spark = embeddings.sparkSession
    xs = integer_vectors(embeddings)
    table = materialize(distinct_vectors(xs))
    fit = table.select("x", (F.col("copies") if weighted else F.lit(1).cast("bigint")).alias("w"))
    first = table.select(F.size("x").alias("d")).first()
    if first is None:
        return spark.createDataFrame([], RESULT)
    dim = first["d"]
    n, sums = _sums(fit, dim)
    if n < 2 or dim == 0:
        return spark.createDataFrame([], RESULT)
    cov = _centred_products(fit, n, sums) / float(n) ** 3
    values, vectors = _eigen(cov, components)
    if len(values) == 0:
        return spark.createDataFrame([], RESULT)
    trace = float(np.trace(cov))
    mean = [s / n for s in sums]
    whitened = F.array(
        *[_dot_centred(F.col("x"), mean, vectors[:, k].tolist()) / math.sqrt(values[k]) for k in range(len(values))]
    )
    s_lit = F.array(*[F.lit(s).cast("decimal(38,0)") for s in sums])
    deviation = F.aggregate(
        F.zip_with("x", s_lit, lambda xi, si: F.lit(n).cast("decimal(38,0)") * xi - si),
        F.lit(0).cast("decimal(38,0)"),
        lambda acc, t: acc + t * t,
    )
    scored = table.select(
        "x", "copies", (F.col("copies") if weighted else F.lit(1)).alias("w"),
        deviation.cast("bigint").alias("deviation"), whitened.alias("whitened"),
    )
    identity_error = _identity_error(scored, n, len(values))
    explained = F.array(*[F.lit(float(e) / trace) for e in values])
    joined = join_back(xs, scored.drop("w"), "x", "copies")
    return joined.select(
        F.col("vec_id").cast("bigint").alias("vec_id"),
        F.lit(n).cast("bigint").alias("n"),
        "deviation",
        F.posexplode(F.arrays_zip("whitened", explained.alias("explained"))).alias("k", "c"),
    ).select(
        "vec_id",
        (F.col("k") + 1).cast("int").alias("component"),
        "n",
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(identity_error).alias("identity_error"),
    )


def _identity_error(scored: DataFrame, n: int, k: int) -> float:
    """max |C - I| for C the covariance of the whitened values over the fit list (two passes)."""
    w = F.col("w").cast("double")
    means = scored.agg(*[F.sum(w * F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    mu = [means[f"m{i}"] / n for i in range(k)]
    centred = [F.col("whitened")[i] - F.lit(mu[i]) for i in range(k)]
    cells = [(i, j) for i in range(k) for j in range(i, k)]
    got = scored.agg(*[F.sum(w * centred[i] * centred[j]).alias(f"c{i}_{j}") for i, j in cells]).first()
    return max(abs(got[f"c{i}_{j}"] / n - (1.0 if i == j else 0.0)) for i, j in cells)
