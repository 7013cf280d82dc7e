"""Correlation: pairwise-complete Pearson and Spearman, selection, nullity."""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.lineage import checkpointed
from .columns import CHUNK, col, na_indicators


#: Distinct values whose ranks are broadcast (16 bytes each); ranks of more are joined by shuffle.
SENT = 200_000


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson over rows where both are known; null where either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0)))


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, (T.NumericType, T.BooleanType))]


def _plain(df: DataFrame, names: list[str]) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[(col(c).cast("int") if kinds[c] == "boolean" else col(c)).cast("double").alias(c) for c in names])


def average_ranks(df: DataFrame, column: str, to: str) -> DataFrame:
    """Adds average ranks of a column (ties share their mean rank); nulls get null.

    Ranks come from counts per distinct value, so ties cost one row; running totals are
    taken inside value ranges and shifted by the totals of the ranges before.
    """
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("__v")).agg(F.count("*").alias("__c"))
    parts = counts.sparkSession.conf.get("spark.sql.shuffle.partitions")
    placed = checkpointed(counts.repartitionByRange(int(parts), "__v").withColumn("__p", F.spark_partition_id()))  # read twice
    totals = placed.groupBy("__p").agg(F.sum("__c").alias("__t"))
    before = totals.withColumn("__b", F.expr("sum(__t) OVER (ORDER BY __p)") - F.col("__t")).drop("__t")  # one row a partition
    run = placed.withColumn("__u", F.expr("sum(__c) OVER (PARTITION BY __p ORDER BY __v)"))
    ranks = run.join(before, "__p").select("__v", (F.col("__u") + F.col("__b") - (F.col("__c") - 1) / 2.0).alias(to))
    if placed.count() <= SENT:
        ranks = F.broadcast(ranks)
    return df.join(ranks, col(column) == F.col("__v"), "left").drop("__v")


def pair_correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> float | None:
    """One pair, on rows where both are known."""
    own = _plain(df, [*dict.fromkeys([x, y])])
    if method == "pearson":
        return own.agg(safe_corr(col(x), col(y))).first()[0]
    both = own.filter(col(x).isNotNull() & col(y).isNotNull())
    both = average_ranks(average_ranks(both, x, "__rx"), y, "__ry")
    return both.agg(safe_corr(F.col("__rx"), F.col("__ry"))).first()[0]


def _rank_correlations(ranked: DataFrame, names: list[str], pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float | None]:
    """Pearson of complete rank columns ``__r <name>`` from plain sums: every column of ranks has the mean (n + 1) / 2, so nothing cancels."""
    if not pairs:
        return {}
    n = ranked.count()
    at = lambda c: col(f"__r {c}") - F.lit((n + 1) / 2)
    sums: dict[tuple[str, str], float] = {}
    for k in range(0, len(pairs), CHUNK):
        part = pairs[k : k + CHUNK]
        row = ranked.agg(*[F.sum(at(a) * at(b)).alias(f"v{i}") for i, (a, b) in enumerate(part)]).first()
        sums |= {p: row[i] or 0.0 for i, p in enumerate(part)}
    norm = lambda a, b: math.sqrt(sums[a, a]) * math.sqrt(sums[b, b])
    return {(a, b): sums[a, b] / norm(a, b) if norm(a, b) else None for a, b in pairs}


def correlation_matrix(df: DataFrame, columns: list[str] | None = None, method: str = "pearson") -> DataFrame:
    """(col1, col2, value) for all ordered pairs, the diagonal 1 (null for a constant).

    Pearson needs one aggregation. Spearman on complete columns ranks each column once;
    columns with nulls are ranked pair by pair, on the rows that know both.
    """
    names = columns or numeric_columns(df)
    own = _plain(df, names)
    pairs = [(a, a) for a in names] + list(combinations(names, 2))
    values: dict[tuple[str, str], float | None] = {}
    if method == "spearman":
        missing = own.agg(*[F.count_if(col(c).isNull()).alias(c) for c in names]).first() if names else {}
        whole = [c for c in names if not missing[c]]
        for c in whole:
            own = average_ranks(own, c, f"__r {c}")
        for a, b in pairs:
            if a not in whole or b not in whole:
                values[a, b] = pair_correlation(df, a, b, "spearman") if a != b else pair_correlation(df, a, a)
        values |= _rank_correlations(own, whole, [p for p in pairs if p not in values])
        pairs = []
    elif method != "pearson":
        raise ValueError("method is pearson or spearman")
    for k in range(0, len(pairs), CHUNK):
        part = pairs[k : k + CHUNK]
        row = own.agg(*[safe_corr(col(a), col(b)).alias(f"v{i}") for i, (a, b) in enumerate(part)]).first()
        values |= {p: row[i] for i, p in enumerate(part)}
    rows = [(a, b, v) for (a, b), v in values.items()] + [(b, a, v) for (a, b), v in values.items() if a != b]
    return df.sparkSession.createDataFrame(rows, "col1 string, col2 string, value double")


def correlations_to(df: DataFrame, target: str, columns: list[str] | None = None, threshold: float | None = None) -> DataFrame:
    """(column, pearson, spearman) of each column against ``target``; with a threshold only |rho| at or above it, below 1."""
    names = [c for c in (columns or numeric_columns(df)) if c != target]
    own = _plain(df, [*names, target])
    row = own.agg(*[safe_corr(col(c), col(target)).alias(f"v{k}") for k, c in enumerate(names)]).first() if names else ()
    rows = [(c, row[k], pair_correlation(df, c, target, "spearman")) for k, c in enumerate(names)]
    out = df.sparkSession.createDataFrame(rows, "column string, pearson double, spearman double")
    return out if threshold is None else out.filter((F.abs("spearman") >= threshold) & (F.abs("spearman") < 1))


def select_uncorrelated(df: DataFrame, threshold: float = 0.5, columns: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(reduced frame, report): left to right, each surviving column removes others with |Spearman| over the threshold."""
    names = columns or numeric_columns(df)
    m = {(r.col1, r.col2): r.value for r in correlation_matrix(df, names, "spearman").collect()}
    gone, rows = set(), []
    for a in names:
        if a in gone:
            continue
        for b in names:
            if b != a and b not in gone and (m[a, b] is not None) and abs(m[a, b]) > threshold:
                gone.add(b)
                rows.append((a, b, m[a, b]))
    report = df.sparkSession.createDataFrame(rows, "selected string, correlated string, strength double")
    return df.select(*[col(c) for c in df.columns if c not in gone]), report


def nullity_correlation(df: DataFrame, method: str = "spearman", fill: float = -1.0, columns: list[str] | None = None) -> DataFrame:
    """(col1, col2, value): columns and null flags against null flags, strongest first, each pair once, none against its own flag."""
    names = columns or numeric_columns(df)
    flagged = na_indicators(df.select(*map(col, names)))
    flags = [c for c in flagged.columns if c not in names]
    whole = flagged.fillna(fill, names)
    m = correlation_matrix(whole, [*names, *flags], method)
    chosen = m.filter(F.col("col2").isin(flags) & (F.col("col1") != F.col("col2")) & (F.concat(F.col("col1"), F.lit("_NA")) != F.col("col2")) & F.col("value").isNotNull())
    once = chosen.filter(~F.col("col1").isin(flags) | (F.col("col1") < F.col("col2")))
    return once.orderBy(F.desc(F.abs("value")), "col1", "col2")
