"""Balanced samples and stratified folds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col, quoted

SLICE = 100_000


def ranked(df: DataFrame, group: list[str], id_col: str, seed: int = 0) -> DataFrame:
    """``__rank`` from 1 within each group, in an order shuffled by a hash of the id.

    A group is cut into slices by the leading bits of the hash; slices are numbered on
    their own and shifted by the sizes of those before, so no task orders a whole group.
    """
    hashed = df.withColumn("__h", F.xxhash64(col(id_col), F.lit(seed)))
    n = max(1, -(-hashed.count() // SLICE))
    sliced = hashed.withColumn("__s", F.floor((F.shiftrightunsigned("__h", 1) / F.lit(float(1 << 63))) * n).cast("int"))
    keys = ", ".join(map(quoted, group))
    sizes = sliced.groupBy(*map(col, group), "__s").agg(F.count("*").alias("__n"))
    named = {c: f"__k{i}" for i, c in enumerate(group)}
    before = sizes.withColumn("__b", F.expr(f"sum(__n) OVER (PARTITION BY {keys} ORDER BY __s)") - F.col("__n")).drop("__n").withColumnsRenamed(named | {"__s": "__t"})
    local = sliced.withColumn("__r", F.expr(f"row_number() OVER (PARTITION BY {keys}, __s ORDER BY __h, {quoted(id_col)})"))
    cond = [col(c).eqNullSafe(F.col(k)) for c, k in named.items()] + [F.col("__s") == F.col("__t")]
    return local.join(before, cond, "inner").select(*map(col, df.columns), (F.col("__r") + F.col("__b")).alias("__rank"))


def balanced_sample(df: DataFrame, group: str, id_col: str, n: int | None = None, frac: float | None = None, seed: int = 0) -> DataFrame:
    """``n`` rows of each group, or ``frac`` of the smallest group's size; with replacement where a group is smaller.

    Deterministic given the seed; drawn again, rows repeat.
    """
    if n is None and frac is None:
        raise TypeError("give n or frac")
    sizes = df.groupBy(col(group).alias("__g")).agg(F.count("*").alias("__size"))
    if n is None:
        n = math.floor((sizes.agg(F.min("__size")).first()[0] or 0) * frac)
    elif n != int(n):
        raise ValueError("n must be whole")
    n = int(n)
    rows = ranked(df, [group], id_col, seed)
    sized = rows.join(sizes, col(group).eqNullSafe(F.col("__g")))
    plenty = sized.filter((F.col("__size") >= n) & (F.col("__rank") <= n))
    few = sizes.filter(F.col("__size") < n).select("__g", "__size", F.explode(F.sequence(F.lit(1), F.lit(max(n, 1)))).alias("__i"))
    draws = few.select("__g", (F.pmod(F.xxhash64(F.lit(seed), "__i", "__g"), F.col("__size")) + 1).alias("__pick"))
    again = draws.join(rows, F.col("__g").eqNullSafe(col(group)) & (F.col("__pick") == F.col("__rank")))
    return plenty.select(*map(col, df.columns)).unionByName(again.select(*map(col, df.columns)))


def stratified_folds(df: DataFrame, label: str, id_col: str, k: int = 5, seed: int = 0, fold_col: str = "fold") -> DataFrame:
    """``fold`` from 0 to k - 1; each label's rows are spread evenly over folds."""
    return ranked(df, [label], id_col, seed).withColumn(fold_col, F.pmod(F.col("__rank") - 1, F.lit(k)).cast("int")).drop("__rank")
