"""Outliers by Mahalanobis distance on principal components."""

from __future__ import annotations

import numpy as np
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed, spread
from .columns import col
from .encode import scale
from .matrix import gram


def robust_moments(x: np.ndarray, seed: int = 0, starts: int = 30, steps: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the half of the rows with the least determinant (FAST-MCD concentration steps)."""
    rng, n, p = np.random.default_rng(seed), *x.shape
    h = min(n, (n + p + 1) // 2)
    best = None
    for _ in range(starts):
        own = x[rng.choice(n, min(n, p + 1), replace=False)]
        last = None
        for _ in range(steps):
            mean, cov = own.mean(0), np.atleast_2d(np.cov(own.T, bias=True))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.pinv(cov), x - mean)
            keep = np.argsort(d, kind="stable")[:h]
            own = x[keep]
            det = np.linalg.det(np.atleast_2d(np.cov(own.T, bias=True)))
            if last is not None and abs(last - det) < 1e-12:
                break
            last = det
        if best is None or det < best[0]:
            best = (det, own.mean(0), np.atleast_2d(np.cov(own.T, bias=True)))
    return best[1], best[2]


def squared_distance(names: list[str], mean: np.ndarray, cov: np.ndarray) -> Column:
    inv = np.linalg.pinv(cov)
    return sum(((F.col(a) - float(mean[i])) * (F.col(b) - float(mean[j])) * float(inv[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)), F.lit(0.0))


def moments(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all rows, from one aggregation."""
    g = gram(df.withColumn("one", F.lit(1.0)), [*names, "one"])
    mean = g[:-1, -1] / (g[-1, -1] or 1.0)
    return mean, g[:-1, :-1] / (g[-1, -1] or 1.0) - np.outer(mean, mean)


def kth_least(df: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The ``k``-th least (from 1) of a column of finite numbers, exactly: rows are counted in bins, then in bins of the bin that holds it, until that holds one value."""
    lo, hi = df.agg(F.min(column), F.max(column)).first()
    while lo < hi:
        width = (hi - lo) / bins
        own = df.filter(F.col(column).between(lo, hi))
        at = F.floor((F.col(column) - F.lit(lo)) / F.lit(width)) if width > 0 else (F.col(column) > lo).cast("long")
        for _, n, lo, hi in sorted(own.groupBy(at.alias("at")).agg(F.count("*"), F.min(column), F.max(column)).collect()):
            if k <= n:
                break
            k -= n
    return lo


def concentrated(df: DataFrame, names: list[str], mean: np.ndarray, cov: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Concentration steps over all rows until the determinant stays: moments of the half of the rows nearest by the last moments."""
    n, p, last = df.count(), len(names), None
    if not n:
        return mean, cov
    half = min(n, (n + p + 1) // 2)
    for _ in range(steps):
        far = df.withColumn("d", squared_distance(names, mean, cov))
        limit = kth_least(far, "d", half)
        mean, cov = moments(far.filter(F.col("d") <= limit), names)
        det = float(np.linalg.det(np.atleast_2d(cov)))
        if last is not None and abs(last - det) <= 1e-12 * max(1.0, abs(last)):
            break
        last = det
    return mean, cov


def mahalanobis_outliers(df: DataFrame, features: list[str], id_col: str, components: int = 2, threshold: float | None = 2.0, robust: bool = True, sample: int = 5000, seed: int = 0) -> DataFrame:
    """(id, distance, outlier): squared distance on ``components`` of z-scaled features.

    A row is an outlier at ``threshold`` standard deviations from the mean distance or
    more, to either side; no threshold gives null flags. The robust mean and covariance
    are those of the half of all rows with the least determinant: only the starts come from
    ``sample`` rows by hash of the id, each concentration step takes the distance quantile
    and the moments below it over all rows.
    """
    own = scale(df.select(col(id_col).alias("id"), *[col(c).cast("double").alias(c) for c in features]).dropna(), features, "zscore")
    vectors = VectorAssembler(inputCols=features, outputCol="v").transform(own)
    model = PCA(k=components, inputCol="v", outputCol="pc").fit(vectors)
    pcs = model.transform(vectors).select("id", vector_to_array("pc").alias("pc")).select("id", *[F.col("pc")[k].alias(f"c{k}") for k in range(components)])
    names = [f"c{k}" for k in range(components)]
    if robust:
        pcs = checkpointed(spread(pcs))  # read once a step
        rows = np.array([tuple(r)[1:] for r in pcs.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).collect()], float)
        mean, cov = concentrated(pcs, names, *robust_moments(rows, seed))
    else:
        mean, cov = moments(pcs, names)
    scored = pcs.select("id", squared_distance(names, mean, cov).alias("distance"))
    if not threshold:
        return scored.withColumn("outlier", F.lit(None).cast("boolean"))
    m = scored.agg(F.avg("distance"), F.stddev_pop("distance")).first()
    lo, hi = ((m[0] or 0.0) - threshold * (m[1] or 0.0), (m[0] or 0.0) + threshold * (m[1] or 0.0))
    return scored.withColumn("outlier", (F.col("distance") >= hi) | (F.col("distance") <= lo))
