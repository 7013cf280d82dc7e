"""Running totals over a global order without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed
from .columns import col, quoted


def running_totals(df: DataFrame, order: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds ``sums`` (column -> name): totals up to and including each row, in the order of a column without ties.

    Rows are range-partitioned, summed inside their range, and shifted by the totals of
    the ranges before, of which there is one row each.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = col(order).desc() if descending else col(order).asc()
    way = "DESC" if descending else "ASC"
    placed = checkpointed(df.repartitionByRange(parts, key).withColumn("__p", F.spark_partition_id()))  # read twice
    totals = placed.groupBy("__p").agg(*[F.sum(col(c)).alias(f"__t{k}") for k, c in enumerate(sums)])
    before = totals.select("__p", *[(F.expr(f"sum(__t{k}) OVER (ORDER BY __p)") - F.col(f"__t{k}")).alias(f"__b{k}") for k in range(len(sums))])
    out = placed.join(before, "__p")
    for k, (c, to) in enumerate(sums.items()):
        out = out.withColumn(to, F.expr(f"sum({quoted(c)}) OVER (PARTITION BY __p ORDER BY {quoted(order)} {way})") + F.col(f"__b{k}"))
    return out.drop("__p", *[f"__b{k}" for k in range(len(sums))])
