"""Matrices as coordinate frames (i, j, v), row sets as arrays, combinatorics."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import col


def _side(n: Column) -> Column:
    """Least k with k (k + 1) / 2 >= n."""
    return F.ceil((F.sqrt(8.0 * n + 1) - 1) / 2).cast("int")


def upper_matrix(df: DataFrame, column: str) -> DataFrame:
    """(i, j, v): an array poured row by row into the upper triangle of the least square that holds it, zeros elsewhere."""
    own = df.select(col(column).alias("a"), _side(F.size(col(column)).cast("double")).alias("k"))
    cells = own.select("a", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("i")).select("*", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    at = F.expr("i * k - i * (i - 1) div 2 + j - i").cast("int")
    return cells.select("i", "j", F.when(F.col("j") >= F.col("i"), F.coalesce(F.get("a", at), F.lit(0))).otherwise(F.lit(0)).alias("v"))


def symmetrize(m: DataFrame) -> DataFrame:
    """a + a' - diagonal of a coordinate frame; absent cells are zero."""
    both = m.select("i", "j", "v").unionByName(m.filter("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), "v"))
    return both.groupBy("i", "j").agg(F.sum("v").alias("v"))


def symmetric_matrix(df: DataFrame, column: str) -> DataFrame:
    return symmetrize(upper_matrix(df, column))


def _numbered(df: DataFrame, id_col: str, blocks: int | None, rows_a_block: int) -> tuple[DataFrame, int, Column]:
    """``df`` with its block ``__k`` by hash of the id, the number of blocks, and an expression with a row for every block."""
    if blocks is None:
        blocks = max(4, -(-df.count() // rows_a_block))
    return df.withColumn("__k", F.pmod(F.xxhash64(col(id_col)), F.lit(blocks)).cast("int")), blocks, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def _tasks(df: DataFrame) -> int:
    """Shuffle partitions by number: adaptive execution would gather pairs of blocks by their bytes, which are few beside their rows."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_blocks(df: DataFrame, id_col: str, blocks: int | None, fn, rows_a_block: int = 2000) -> DataFrame:
    """Every ordered pair of rows as ``fn(a, b)``, a frame of columns suffixed _a and _b, by equi-joins of block pairs.

    For results that have a row per pair by definition. Each of ``blocks``^2 block pairs is a
    join key of its own, so work spreads evenly and no side is broadcast. Without a number
    of blocks there are as many as give each about ``rows_a_block`` rows. The right side
    comes as one array a block, spread out in the task that joins it.
    """
    own, blocks, every = _numbered(df, id_col, blocks, rows_a_block)
    a = own.select(*[col(c).alias(f"{c}_a") for c in df.columns], F.col("__k").alias("__p"), every.alias("__q")).repartition(_tasks(df), "__p", "__q")
    b = own.groupBy(F.col("__k").alias("__q")).agg(F.collect_list(F.struct(*[col(c).alias(f"{c}_b") for c in df.columns])).alias("__b")).select("__q", "__b", every.alias("__p"))
    return fn(a.join(b.hint("shuffle_hash"), ["__p", "__q"]).select(*[col(f"{c}_a") for c in df.columns], F.inline("__b")))


def pairwise_difference(df: DataFrame, id_col: str, value: str, blocks: int | None = None) -> DataFrame:
    """(i, j, v) with v = value of j - value of i."""
    own = df.select(col(id_col).alias("id"), col(value).alias("x"))
    return in_blocks(own, "id", blocks, lambda p: p.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), (F.col("x_b") - F.col("x_a")).alias("v")))


def hamming_pairs(df: DataFrame, id_col: str, column: str, blocks: int | None = None) -> DataFrame:
    """(i, j, v): at how many positions two equally long arrays differ."""
    own = df.select(col(id_col).alias("id"), col(column).alias("x"))
    d = F.size(F.filter(F.zip_with("x_a", "x_b", lambda p, q: ~p.eqNullSafe(q)), lambda x: x)).cast("bigint")
    return in_blocks(own, "id", blocks, lambda p: p.select(F.col("id_a").alias("i"), F.col("id_b").alias("j"), d.alias("v")))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda a, v: a + v)


def _cosines(a: pa.Table, b: pa.Table) -> pa.Table:
    """(i, j, v) of two blocks of (id, x, n); rows of unequal length, or without a norm, have null."""
    if not (a.num_rows and b.num_rows):  # an empty side comes without columns
        ids = (a if a.num_rows else b)["id"].slice(0, 0)
        return pa.table({"i": ids, "j": ids, "v": pa.array([], pa.float64())})

    def side(t: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        x, n = t["x"].combine_chunks(), t["n"].combine_chunks()
        long = np.where(n.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(x), -1).to_numpy(), -1)
        by = {}
        for k in np.unique(long[long > 0]).tolist():
            at = np.flatnonzero(long == k)
            by[k] = at, x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(at), k)
        return t["id"].combine_chunks(), n.to_numpy(zero_copy_only=False).astype(float), long, by

    (ids_a, n_a, _, by_a), (ids_b, n_b, _, by_b) = side(a), side(b)
    v, none = np.zeros((len(ids_a), len(ids_b))), np.ones((len(ids_a), len(ids_b)), bool)
    for k in by_a.keys() & by_b.keys():
        (p, x), (q, y) = by_a[k], by_b[k]
        at, norm = np.ix_(p, q), np.outer(n_a[p], n_b[q])
        none[at] = norm == 0
        v[at] = x @ y.T / np.where(norm == 0, 1.0, norm)
    i, j = (pa.array(g.ravel()) for g in np.indices(v.shape))
    return pa.table({"i": ids_a.take(i), "j": ids_b.take(j), "v": pa.array(v.ravel(), mask=none.ravel())})


def cosine_rows(df: DataFrame, id_col: str, column: str, blocks: int | None = None) -> DataFrame:
    """(i, j, v): cosine of every two rows' vectors; null with a zero vector.

    A row per pair by definition: block pairs of about 1,000 rows a side, each one matrix product.
    """
    kind = df.select(col(id_col)).schema[0].dataType.simpleString()
    own = df.select(col(id_col).alias("id"), col(column).cast("array<double>").alias("x"), F.sqrt(dot(col(column), col(column))).alias("n"))
    own, blocks, every = _numbered(own, "id", blocks, 1000)
    # columns are renamed on either side: those that a cogroup's sides share by origin, Spark prunes from one of them
    a, b = (own.select(*[F.col(c).alias(c) for c in ("id", "x", "n")], F.col("__k").alias(k), every.alias(o)).repartition(_tasks(df), "__p", "__q").groupBy("__p", "__q") for k, o in (("__p", "__q"), ("__q", "__p")))
    return a.cogroup(b).applyInArrow(_cosines, f"i {kind}, j {kind}, v double")


def cosine_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, v): cosine of every two columns, from one aggregation."""
    from itertools import combinations_with_replacement

    pairs = list(combinations_with_replacement(columns, 2))
    row = df.agg(*[F.sum(col(a).cast("double") * col(b).cast("double")).alias(f"v{k}") for k, (a, b) in enumerate(pairs)]).first()
    g = dict(zip(pairs, row))
    out = []
    for (a, b), v in g.items():
        n = math.sqrt((g[a, a] or 0.0) * (g[b, b] or 0.0))
        c = v / n if n else None
        out += [(a, b, c)] + ([(b, a, c)] if a != b else [])
    return df.sparkSession.createDataFrame(out, "i string, j string, v double")


def gram(df: DataFrame, columns: list[str], weight: str | None = None) -> np.ndarray:
    """X'X of few columns in one aggregation."""
    w = col(weight) if weight else F.lit(1.0)
    n = len(columns)
    row = df.agg(*[F.sum(col(columns[i]).cast("double") * col(columns[j]).cast("double") * w).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]).first()
    out, k = np.zeros((n, n)), 0
    for i in range(n):
        for j in range(i, n):
            out[i, j] = out[j, i] = row[k] or 0.0
            k += 1
    return out


def is_positive_definite(m: DataFrame, most: int = 2000) -> bool:
    """Whether a coordinate frame is symmetric and has a Cholesky factor; sides over ``most`` are refused."""
    rows = m.select("i", "j", "v").limit(most * most + 1).collect()
    keys = sorted({r.i for r in rows} | {r.j for r in rows})
    if len(keys) > most:
        raise ValueError(f"side over {most}")
    at = {k: n for n, k in enumerate(keys)}
    a = np.zeros((len(keys), len(keys)))
    for r in rows:
        a[at[r.i], at[r.j]] = r.v
    if not np.allclose(a, a.T):
        return False
    try:
        np.linalg.cholesky(a)
    except np.linalg.LinAlgError:
        return False
    return True


def product(frames: list[DataFrame]) -> DataFrame:
    """All tuples of one value (first column) of each frame, as columns x0, x1, ...: the result is the Cartesian product itself."""
    named = [f.select(col(f.columns[0]).alias(f"x{k}")) for k, f in enumerate(frames)]
    return reduce(lambda a, b: a.crossJoin(b), named)


def permutations(frames: list[DataFrame]) -> DataFrame:
    """:func:`product` without tuples that repeat a value."""
    p = product(frames)
    return p.filter(F.size(F.array_distinct(F.array(*p.columns))) == len(p.columns))


def combinations_with_replacement(frames: list[DataFrame], ignore_order: bool = False) -> DataFrame:
    """Distinct tuples of :func:`product`; ``ignore_order`` keeps one order of each."""
    p = product(frames)
    if ignore_order:
        s = F.array_sort(F.array(*p.columns))
        p = p.select(*[s[k].alias(c) for k, c in enumerate(p.columns)])
    return p.distinct()


def combinations(frames: list[DataFrame], ignore_order: bool = False) -> DataFrame:
    """Distinct tuples without repeats; ``ignore_order`` keeps one order of each."""
    p = combinations_with_replacement(frames, ignore_order)
    return p.filter(F.size(F.array_distinct(F.array(*p.columns))) == len(p.columns))


def to_ultrametric(d: DataFrame) -> DataFrame:
    """One pass d_ij = min(d_ij, min over k of max(d_ik, d_jk)) over a symmetric coordinate frame; the diagonal becomes 1."""
    a = d.select("i", F.col("j").alias("k"), F.col("v").alias("p"))
    b = d.select(F.col("i").alias("j"), F.col("j").alias("k"), F.col("v").alias("q"))
    via = a.join(b, "k").groupBy("i", "j").agg(F.min(F.greatest("p", "q")).alias("w"))
    out = d.join(via, ["i", "j"], "left").select("i", "j", F.least("v", F.coalesce("w", "v")).alias("v"))
    return out.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(1.0)).otherwise(F.col("v")).alias("v"))


def dense(spark: SparkSession, a: np.ndarray) -> DataFrame:
    """A small array as a coordinate frame."""
    return spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(a)], "i bigint, j bigint, v double")
