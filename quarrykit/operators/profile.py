"""Missingness, value counts, histograms and other profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .columns import col, one_pass, quoted


def _nulls(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("__n"), *[(F.count(F.lit(1)) - F.count(col(c))).alias(c) for c in df.columns])


def missingness(df: DataFrame) -> DataFrame:
    """(column, n_null) for the columns with nulls."""
    return _nulls(df).unpivot(["__n"], [quoted(c) for c in df.columns], "column", "n_null").filter("n_null > 0").select("column", "n_null")


def missingness_pct(df: DataFrame) -> DataFrame:
    """(column, pct) for all columns; null for an empty frame."""
    long = _nulls(df).unpivot(["__n"], [quoted(c) for c in df.columns], "column", "n_null")
    return long.select("column", F.try_divide(F.lit(100.0) * F.col("n_null"), F.col("__n")).alias("pct"))


def missingness_patterns(df: DataFrame) -> DataFrame:
    """Rows per pattern of nulls: ``<column>`` booleans and n."""
    return df.groupBy(*[col(c).isNull().alias(c) for c in df.columns]).agg(F.count("*").alias("n"))


def missingness_cells(df: DataFrame, id_col: str) -> DataFrame:
    """(id, column, is_null) for every cell."""
    rest = [c for c in df.columns if c != id_col]
    return df.select(col(id_col), *[col(c).isNull().alias(c) for c in rest]).unpivot([quoted(id_col)], [quoted(c) for c in rest], "column", "is_null")


def value_counts(df: DataFrame, columns: list[str] | None = None, normalize: bool = False) -> DataFrame:
    """Distinct rows with their count (or share), commonest first; values keep their types."""
    names = columns or df.columns
    counts = df.groupBy(*map(col, names)).agg(F.count("*").alias("count"))
    if normalize:
        total = df.agg(F.count("*").alias("__n"))
        counts = counts.crossJoin(F.broadcast(total)).select(*map(col, names), (F.col("count") / F.col("__n")).alias("share"))  # one row
        return counts.orderBy(F.desc("share"), *map(col, names))
    return counts.orderBy(F.desc("count"), *map(col, names))


def partition_counts(df: DataFrame) -> DataFrame:
    """(partition, n), empty partitions included."""
    n = df.rdd.getNumPartitions()
    got = df.groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(got, "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))


def histogram(df: DataFrame, column: str, bins: int = 25, by: str | None = None) -> DataFrame:
    """(by, bin, lo, hi, n): counts in equal-width bins over the column's whole range; nulls are left out."""
    m = one_pass(df, [column], {"a": lambda c: F.min(col(c)).cast("double"), "b": lambda c: F.max(col(c)).cast("double")})[column]
    lo, hi = (0.0, 0.0) if m["a"] is None else (m["a"], m["b"])
    width = (hi - lo) / bins or 1.0
    b = F.least(F.floor((col(column) - F.lit(lo)) / F.lit(width)).cast("int"), F.lit(bins - 1)).alias("bin")
    keys = [b] + ([col(by).alias("by")] if by else [])
    out = df.filter(col(column).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))
    return out.select(*(["by"] if by else []), "bin", (F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"), (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "n")


def _exact_quartiles(counts: DataFrame) -> DataFrame:
    """(by, q1, median, q3) of a checkpointed frame (by, x, c) of distinct values and their counts.

    Values are range-partitioned; running totals inside a range are shifted by those of the ranges before, per group.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = checkpointed(counts.repartitionByRange(parts, "by", "x").withColumn("p", F.spark_partition_id()))  # read twice
    totals = placed.groupBy("by", "p").agg(F.sum("c").alias("t"))
    before = totals.select("by", "p", (F.expr("sum(t) OVER (PARTITION BY by ORDER BY p)") - F.col("t")).alias("b"), F.expr("sum(t) OVER (PARTITION BY by)").alias("n"))
    own = F.col("by").eqNullSafe(F.col("g")) & (F.col("p") == F.col("q"))
    run = placed.withColumn("u", F.expr("sum(c) OVER (PARTITION BY p, by ORDER BY x)")).join(before.select(F.col("by").alias("g"), F.col("p").alias("q"), "b", "n"), own)
    end, start = F.col("b") + F.col("u"), F.col("b") + F.col("u") - F.col("c")
    at = lambda k: F.max(F.when((start <= k) & (k < end), F.col("x")))
    out = []
    for name, share in (("q1", 0.25), ("median", 0.5), ("q3", 0.75)):
        place = (F.col("n") - 1) * F.lit(share)
        out += [at(F.floor(place)).alias(f"{name}_lo"), at(F.ceil(place)).alias(f"{name}_hi"), F.max(place).alias(f"{name}_at")]
    q = run.groupBy("by").agg(*out)
    lo, hi, w = ((lambda n, e=e: F.col(f"{n}_{e}")) for e in ("lo", "hi", "at"))
    return q.select("by", *[F.when(lo(n) == hi(n), lo(n)).otherwise((F.ceil(w(n)) - w(n)) * lo(n) + (w(n) - F.floor(w(n))) * hi(n)).alias(n) for n in ("q1", "median", "q3")])


def box_stats(df: DataFrame, column: str, by: str | None = None, exact: bool = True) -> DataFrame:
    """(by, n, q1, median, q3, low, high, outliers): whiskers at the furthest values within 1.5 interquartile ranges.

    Everything comes from counts by value, which no task holds as a whole.
    """
    own = df.filter(col(column).isNotNull()).select((col(by) if by else F.lit(0)).alias("by"), col(column).cast("double").alias("x"))
    counts = checkpointed(own.groupBy("by", "x").agg(F.count("*").alias("c")))  # read twice
    if exact:
        q = _exact_quartiles(counts)
    else:
        q = own.groupBy("by").agg(F.percentile_approx("x", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
        q = q.select("by", *[F.col("q")[k].alias(n) for k, n in enumerate(("q1", "median", "q3"))])
    joined = counts.join(q, "by")
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    out = joined.groupBy("by", "q1", "median", "q3").agg(F.sum("c").alias("n"), F.min(F.when(inside, F.col("x"))).alias("low"), F.max(F.when(inside, F.col("x"))).alias("high"), F.coalesce(F.sum(F.when(~inside, F.col("c"))), F.lit(0)).alias("outliers"))
    return out if by else out.drop("by")


def log_odds(df: DataFrame, column: str, label: str) -> DataFrame:
    """(value, n0, n1, log_odds) per value of a column and a 0/1 label: ln(1 + n1/n0), null where n0 is 0."""
    return log_odds_all(df.select(col(column).cast("string").alias("value"), col(label).alias("label")), "label", ["value"]).drop("column")


def log_odds_all(df: DataFrame, label: str, columns: list[str] | None = None) -> DataFrame:
    """:func:`log_odds` of every other column in one aggregation: (column, value, n0, n1, log_odds)."""
    names = columns or [c for c in df.columns if c != label]
    long = df.select(col(label).alias("__y"), *[col(c).cast("string").alias(c) for c in names]).unpivot(["__y"], [quoted(c) for c in names], "column", "value")
    got = long.groupBy("column", "value").agg(F.count_if(F.col("__y") == 0).alias("n0"), F.count_if(F.col("__y") == 1).alias("n1"))
    return got.withColumn("log_odds", F.ln(1 + F.try_divide(F.col("n1"), F.col("n0"))))


def interaction_means(df: DataFrame, column: str, value: str, by: str) -> DataFrame:
    """Mean of ``value`` by (column, by)."""
    return df.groupBy(col(column), col(by)).agg(F.avg(col(value)).alias("mean"))


def pair_density(df: DataFrame, x: str, y: str, bins: int = 25, by: str | None = None) -> DataFrame:
    """Counts over a grid of two columns (by group): the data of a scatter plot at any size."""
    m = one_pass(df, [x, y], {"a": lambda c: F.min(col(c)).cast("double"), "b": lambda c: F.max(col(c)).cast("double")})

    def cell(c: str) -> Column:
        lo, hi = m[c]["a"] or 0.0, m[c]["b"] or 0.0
        return F.least(F.floor((col(c) - F.lit(lo)) / F.lit((hi - lo) / bins or 1.0)).cast("int"), F.lit(bins - 1))

    keys = [cell(x).alias("x_bin"), cell(y).alias("y_bin")] + ([col(by).alias("by")] if by else [])
    return df.filter(col(x).isNotNull() & col(y).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"))


def scatter_sample(df: DataFrame, id_col: str, columns: list[str], n: int, seed: int = 0) -> DataFrame:
    """A deterministic sample of ``n`` rows for drawing (a sampling operator: the limit is its purpose)."""
    return df.orderBy(F.xxhash64(col(id_col), F.lit(seed)), col(id_col)).limit(n).select(col(id_col), *map(col, columns))

