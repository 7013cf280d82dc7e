"""Wide to long and back, lists to rows and columns, indicators."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, quoted


def melt(df: DataFrame, ids: list[str], values: list[str], var_name: str = "variable", value_name: str = "value", as_string: bool = False) -> DataFrame:
    """Wide to long, nulls kept. Columns of different types need ``as_string``."""
    if as_string:
        df = df.select(*map(col, ids), *[col(c).cast("string").alias(c) for c in values])
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in values], var_name, value_name)


def list_to_columns(df: DataFrame, column: str, most: int = 1000) -> DataFrame:
    """One column per list position, named ``column_0`` on; shorter lists give null."""
    width = df.agg(F.max(F.size(col(column)))).first()[0] or 0
    if width > most:
        raise ValueError(f"lists of {width} items; at most {most} columns")
    return df.select("*", *[F.get(col(column), F.lit(k)).alias(f"{column}_{k}") for k in range(max(width, 0))])


def explode_parallel_outer(df: DataFrame, columns: list[str], fill=None) -> DataFrame:
    """Several lists exploded in step; a row without items survives once; gaps take ``fill``."""
    zipped = F.arrays_zip(*[F.coalesce(col(c), F.array().cast(df.schema[c].dataType)).alias(c) for c in columns])
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*map(col, rest), F.explode_outer(zipped).alias("__z"))
    return out.select(*map(col, rest), *[(F.col("__z").getField(c) if fill is None else F.coalesce(F.col("__z").getField(c), F.lit(fill))).alias(c) for c in columns])


def explode_parallel(df: DataFrame, *columns: str) -> DataFrame:
    """Lists exploded in step into ``element1..N`` beside the original columns; the first list drives the length; empty ones vanish."""
    first, *rest = columns
    out = df.select("*", F.posexplode(F.col(first)).alias("__pos", "element1"))
    return out.select(*df.columns, "element1", *[F.get(F.col(c), F.col("__pos")).alias(f"element{k}") for k, c in enumerate(rest, 2)])


def levels(df: DataFrame, column: str, most: int = 1000) -> list:
    """Sorted distinct non-null values, refused beyond ``most``."""
    got = [r[0] for r in df.select(col(column)).distinct().filter(col(column).isNotNull()).limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has over {most} values")
    return sorted(got)


def multi_hot(df: DataFrame, id_col: str, column: str, items: list | None = None, most: int = 1000) -> DataFrame:
    """Counts per distinct item of a list column, one column per item; empty lists vanish."""
    long = df.select(col(id_col), F.explode(col(column)).alias("__item"))
    items = levels(long, "__item", most) if items is None else items
    return long.groupBy(quoted(id_col)).pivot("__item", items).count().fillna(0, [str(i) for i in items])


def one_hot(df: DataFrame, column: str, prefix: str | None = None, null_flag: bool = False, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """(frame with 0/1 columns, their names), one per distinct value in sorted order."""
    prefix = column if prefix is None else prefix
    values = levels(df, column, most)
    flags = [(f"{prefix}_{v}", col(column).eqNullSafe(F.lit(v)).cast("int")) for v in values]
    if null_flag:
        flags.append((f"{prefix}_null", col(column).isNull().cast("int")))
    return df.select("*", *[e.alias(n) for n, e in flags]), [n for n, _ in flags]


class _OneHot(Params):
    columns = Param(Params._dummy(), "columns", "columns to encode", TypeConverters.toListString)
    dropFirst = Param(Params._dummy(), "dropFirst", "leave the first level out", TypeConverters.toBoolean)
    pairs = Param(Params._dummy(), "pairs", "column and level, in turn", TypeConverters.toListString)


class LevelEncoder(Estimator, _OneHot, DefaultParamsReadable, DefaultParamsWritable):
    """0/1 columns ``<col>_<level>`` for columns with over two levels; unseen and null values are all zeros."""

    @keyword_only
    def __init__(self, *, columns: list[str] = [], dropFirst: bool = False):  # noqa: B006
        super().__init__()
        self._setDefault(columns=[], dropFirst=False, pairs=[])
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LevelEncoderModel":
        pairs: list[str] = []
        for c in self.getOrDefault("columns"):
            own = levels(df.select(col(c).cast("string").alias(c)), c)
            if len(own) > 2:
                for v in own[int(self.getOrDefault("dropFirst")) :]:
                    pairs += [c, v]
        return LevelEncoderModel(pairs=pairs)


class LevelEncoderModel(Model, _OneHot, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, pairs: list[str] = []):  # noqa: B006
        super().__init__()
        self._setDefault(columns=[], dropFirst=False, pairs=[])
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = self.getOrDefault("pairs")
        flags: dict[str, list[Column]] = {}
        for c, v in zip(p[::2], p[1::2]):
            flags.setdefault(c, []).append(F.coalesce(col(c).cast("string") == v, F.lit(False)).cast("int").alias(f"{c}_{v}"))
        out: list[Column] = []
        for c in df.columns:
            out += flags.get(c, [col(c)])
        return df.select(*out)
