"""Distances, summaries of clusters, one-hot columns and principal components.
``density`` clusters partitions of any size; ``dbscan`` is for rows that fit one task."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import join_groups, quantiles

MIN_VALID = 5


def nan_euclidean(u: Column, v: Column, min_valid: int = MIN_VALID) -> Column:
    """Root mean square over the dimensions finite in both; infinite under min_valid."""
    ok = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    pairs = F.filter(F.zip_with(u.cast("array<double>"), v.cast("array<double>"), lambda a, b: F.when(ok(a) & ok(b), (a - b) * (a - b))), lambda x: x.isNotNull())
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(pairs) < min_valid, F.lit(float("inf"))).otherwise(F.sqrt(F.try_divide(total, F.size(pairs))))


def distance_block(x: np.ndarray, y: np.ndarray, min_valid: int = MIN_VALID) -> np.ndarray:
    """nan_euclidean of all rows of x against all rows of y."""
    a, b = np.isfinite(x), np.isfinite(y)
    if a.all() and b.all():
        if x.shape[1] < max(min_valid, 1):
            return np.full((len(x), len(y)), np.inf)
        out = x @ y.T
        out *= -2
        out += (x**2).sum(axis=1)[:, None]
        out += (y**2).sum(axis=1)[None, :]
        np.maximum(out, 0, out=out)
        out /= x.shape[1]
        return np.sqrt(out, out=out)
    xs, ys = np.where(a, x, 0.0), np.where(b, y, 0.0)
    af, bf = a.astype(np.float64), b.astype(np.float64)
    n = af @ bf.T
    square = (xs**2) @ bf.T + af @ (ys**2).T - 2 * (xs @ ys.T)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt(np.maximum(square, 0) / n)
    return np.where(n < min_valid, np.inf, out)


def dbscan(x: np.ndarray, eps: float, min_samples: int, block: int = 1024) -> np.ndarray:
    """Labels in scan order, -1 for noise; a point is its own neighbour. Neighbours are
    found block by block, so memory grows with the neighbours and not with all pairs."""
    n = len(x)
    near: list[np.ndarray] = []
    for at in range(0, n, block):
        d = distance_block(x[at : at + block], x)
        d[np.arange(len(d)), np.arange(at, at + len(d))] = 0.0
        near += [np.flatnonzero(row <= eps) for row in d]
    core = np.array([len(k) >= min_samples for k in near], bool)
    labels, cluster = np.full(n, -1), 0
    for i in range(n):
        if labels[i] != -1 or not core[i]:
            continue
        labels[i], todo = cluster, [i]
        while todo:
            for k in near[todo.pop()]:
                if labels[k] == -1:
                    labels[k] = cluster
                    if core[k]:
                        todo.append(k)
        cluster += 1
    return labels


def sweep_totals(found: DataFrame) -> DataFrame:
    out = found.groupBy("eps", "min_samples").agg(F.sum("points").alias("points"), F.sum("clusters").alias("clusters"), F.sum("noise").alias("noise"))
    return out.withColumn("noise_pct", F.try_divide(100.0 * F.col("noise"), F.col("points")))


def describe(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """count, mean, std, min, quartiles, 90 and 95 percent points, max."""
    v = F.col(value)
    shares = {f"p{round(100 * p)}": p for p in (0.25, 0.5, 0.75, 0.9, 0.95)}
    row = df.groupBy(*by).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    out = join_groups(row, quantiles(df, value, shares, by), by, "left")
    return out.select(*by, "count", "mean", "std", "min", *shares, "max")


def cluster_counts(df: DataFrame, partition: Sequence[str]) -> DataFrame:
    return df.groupBy(*partition, "cluster").agg(F.count(F.lit(1)).alias("count"))


def cluster_noise(df: DataFrame, partition: Sequence[str]) -> DataFrame:
    out = df.groupBy(*partition).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("cluster") == -1).alias("noise_count"))
    return out.withColumn("noise_pct", F.try_divide(100.0 * F.col("noise_count"), F.col("total")))


def cluster_means(df: DataFrame, partition: Sequence[str], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*partition, "cluster").agg(*[F.avg(c).alias(c) for c in columns])


def cluster_distribution(df: DataFrame, partition: Sequence[str], column: str) -> DataFrame:
    n = df.groupBy(*partition, "cluster", column).agg(F.count(F.lit(1)).alias("count"))
    return n.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(*partition, "cluster")))


def one_hot(df: DataFrame, columns: Sequence[str], labels: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """A 0/1 column per label; null counts as MISSING. Labels that aren't given are the
    distinct ones, which become column names."""
    out = df
    for c in columns:
        text = F.coalesce(F.col(c).cast("string"), F.lit("MISSING"))
        found = (labels or {}).get(c) or [r[0] for r in df.select(text.alias("x")).distinct().orderBy("x").collect()]
        out = out.withColumns({f"{c}_{x}": (text == x).cast("byte") for x in found})
    return out.drop(*columns)


def pca(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """Adds pc1..pck: centred projections on the first components, from one pass of
    sums and cross products."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c").fit(rows).transform(rows)
    out = PCA(k=k, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("_a", vector_to_array("_p"))
    return out.withColumns({f"pc{i + 1}": F.col("_a")[i] for i in range(k)}).drop("_v", "_c", "_p", "_a")


def robust_axes(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    rows = [quantiles(df, c, {f"{c}_low": low, f"{c}_high": high}) for c in columns]
    return reduce(lambda a, b: a.crossJoin(b), rows)  # one row each
