"""Duplicates, repeated elements within rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col


def drop_unordered_duplicates(df: DataFrame, subset: list[str] | None = None, order_by: list[str] | None = None) -> DataFrame:
    """One row per set-like key: values of ``subset`` as sorted strings. ``order_by`` says which row is first.

    The key is an array, so ("ab", "c") and ("a", "bc") differ. With ``order_by`` the
    least row by those columns stays, found by a combining aggregate.
    """
    names = subset or df.columns
    key = F.array_sort(F.array(*[F.coalesce(col(c).cast("string"), F.lit("\0")) for c in names]))
    keyed = df.withColumn("__key", key)
    if not order_by:
        return keyed.dropDuplicates(["__key"]).drop("__key")
    row = F.struct(*[col(c) for c in df.columns])
    best = keyed.groupBy("__key").agg(F.min_by(row, F.struct(*map(col, order_by))).alias("__row"))
    return best.select("__row.*")


def drop_duplicate_rows(df: DataFrame, column: str, ignore_order: bool = False) -> DataFrame:
    """Distinct arrays, in value order; ``ignore_order`` treats permutations as equal."""
    own = F.array_sort(col(column)) if ignore_order else col(column)
    return df.select(own.alias(column)).distinct().orderBy(column)


def counts_per_row(a: Column) -> Column:
    """For each element its number of occurrences, at its first place; 0 elsewhere."""
    return F.transform(a, lambda x, i: F.when(F.array_position(a, x) - 1 == i, F.size(F.filter(a, lambda y: y.eqNullSafe(x)))).otherwise(0))


def all_distinct(a: Column) -> Column:
    """Whether an array repeats no element."""
    return F.size(F.array_distinct(a)) == F.size(a)
