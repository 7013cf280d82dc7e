"""Column management, types and missing-value flags."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Aggregates per pass, so that generated code stays below the JVM's method limits.
CHUNK = 200


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def _fixed(d: T.DataType) -> bool:
    return isinstance(d, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType))


def one_pass(df: DataFrame, columns: Iterable[str], measures: dict[str, Callable[[str], Column]]) -> dict[str, dict]:
    """Every measure of every column in one aggregation (per CHUNK expressions); only one row reaches the driver."""
    jobs = [(c, m, fn(c)) for c in columns for m, fn in measures.items()]
    out: dict[str, dict] = {}
    for k in range(0, len(jobs), CHUNK):
        part = jobs[k : k + CHUNK]
        row = df.agg(*[e.alias(f"v{i}") for i, (_, _, e) in enumerate(part)]).first()
        for i, (c, m, _) in enumerate(part):
            out.setdefault(c, {})[m] = row[i]
    return out


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A Python function over Arrow batches, every row once."""
    return df.mapInPandas(lambda parts: map(fn, parts), schema)


def map_columns(df: DataFrame, fn: Callable[[Column], Column], columns: list[str] | None = None) -> DataFrame:
    """One expression over many columns, in a single projection."""
    chosen = set(columns if columns is not None else df.columns)
    return df.select(*[fn(col(c)).alias(c) if c in chosen else col(c) for c in df.columns])


WIDTHS = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4, "bigint": 8, "double": 8, "timestamp": 8, "timestamp_ntz": 8}


def memory_usage(df: DataFrame) -> DataFrame:
    """(dtype, n_cols, bytes): bytes of the values by type, strings by their UTF-8 length."""
    kinds = dict(df.dtypes)
    sized = one_pass(df, df.columns, {"b": lambda c: F.sum(F.octet_length(col(c))) if kinds[c] == "string" else F.count(F.lit(1)) * WIDTHS.get(kinds[c], 16)})
    total: dict[str, list[int]] = {}
    for c, k in kinds.items():
        n = total.setdefault(k, [0, 0])
        n[0] += 1
        n[1] += int(sized[c]["b"] or 0)
    return df.sparkSession.createDataFrame([(k, n, b) for k, (n, b) in sorted(total.items())], "dtype string, n_cols int, bytes bigint")


_INTS = [("tinyint", 1 << 7), ("smallint", 1 << 15), ("int", 1 << 31)]


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, n, nulls, distinct, min, max) of each atomic column.

    Each column is counted by value, so that no task sorts or holds rows of all columns; only one row a column reaches the driver.
    """
    kinds, spark = dict(df.dtypes), df.sparkSession
    rows = []
    for c in (f.name for f in df.schema if _fixed(f.dataType)):
        counts = df.groupBy(col(c).alias("v")).agg(F.count(F.lit(1)).alias("k"))
        m = counts.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)), F.count("v"), F.min("v").cast("string"), F.max("v").cast("string")).first()
        rows.append((c, kinds[c], *m))
    return spark.createDataFrame(rows, "column string, dtype string, n bigint, nulls bigint, distinct bigint, min string, max string")


def narrow_types(df: DataFrame, categorical: list[str] | None = None, ratio: float = 0.5, floats: bool = False, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(narrowed frame, report): integers to the smallest signed type that holds them.

    ``floats`` turns doubles into floats (lossy, hence opt-in). The report names string
    columns whose distinct values, null counting as one, are under ``ratio`` of the
    non-null values as ``categorical``; all-null columns stay as they are.
    """
    if categorical is not None and not isinstance(categorical, (list, tuple)):
        raise ValueError("categorical takes a list of column names")
    ints = [f.name for f in df.schema if isinstance(f.dataType, T.IntegralType)]
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    distinct = F.count_distinct if exact else F.approx_count_distinct
    spans = one_pass(df, ints, {"lo": lambda c: F.min(col(c)), "hi": lambda c: F.max(col(c))})
    words = one_pass(df, texts, {"n": lambda c: F.count(F.lit(1)), "k": lambda c: F.count(col(c)), "d": lambda c: distinct(col(c))})
    to: dict[str, str] = {}
    for c, s in spans.items():
        if s["lo"] is not None:
            to[c] = next((k for k, top in _INTS if -top <= s["lo"] and s["hi"] < top), "bigint")
    if floats:
        to |= {f.name: "float" for f in df.schema if isinstance(f.dataType, T.DoubleType)}
    chosen = {c: "categorical" for c, w in words.items() if w["k"] and (w["d"] + (w["k"] < w["n"])) / w["k"] < ratio} | dict.fromkeys(categorical or [], "categorical")
    kinds = dict(df.dtypes)
    report = df.sparkSession.createDataFrame([(c, kinds[c], chosen.get(c, to.get(c, kinds[c]))) for c in df.columns], "column string, dtype string, proposal string")
    return df.select(*[col(c).cast(to[c]).alias(c) if c in to else col(c) for c in df.columns]), report


def filter_columns(df: DataFrame, drop: Iterable[str] = (), keep: Iterable[str] = ()) -> DataFrame:
    """Drop first, ``keep`` wins on overlap; then only ``keep`` if any of them exist. Unknown names are ignored."""
    keep, drop = set(keep), set(drop)
    left = [c for c in df.columns if c not in drop or c in keep]
    chosen = [c for c in left if c in keep]
    return df.select(*map(col, chosen or left))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without columns of a single non-null value (nulls ignored); all-null columns stay."""
    own = [f.name for f in df.schema if _fixed(f.dataType)]
    got = one_pass(df, own, {"same": lambda c: F.min(col(c)) == F.max(col(c))})
    return df.select(*[col(c) for c in df.columns if not got.get(c, {}).get("same")])


def reorder_columns(df: DataFrame, source: int, target: int) -> DataFrame:
    """Take the column at ``source`` out and put it at ``target`` of the shortened list."""
    names = df.columns
    names.insert(target, names.pop(source))
    return df.select(*map(col, names))


def insert_column(df: DataFrame, name: str, value: Column, after: str | None = None, before: str | None = None) -> DataFrame:
    """Add a column beside another; ``after`` beats ``before``; an existing name, or no anchor, means plain assignment."""
    anchor = after or before
    if name in df.columns or anchor is None:
        return df.withColumn(name, value)
    names = df.columns
    at = names.index(anchor) + (after is not None)
    return df.select(*map(col, names[:at]), value.alias(name), *map(col, names[at:]))


def na_indicators(df: DataFrame, suffix: str = "_NA") -> DataFrame:
    """A boolean flag right after each column that holds a null."""
    got = one_pass(df, df.columns, {"k": lambda c: F.count(F.lit(1)) - F.count(col(c))})
    out = []
    for c in df.columns:
        out.append(col(c))
        if got[c]["k"]:
            out.append(col(c).isNull().alias(c + suffix))
    return df.select(*out)


class _Select(Params):
    columns = Param(Params._dummy(), "columns", "columns to choose from", TypeConverters.toListString)
    invert = Param(Params._dummy(), "invert", "keep the others", TypeConverters.toBoolean)


class ColumnSelector(Estimator, _Select, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps chosen (``invert``: the other) columns that are neither all-null nor constant; null counts as a value."""

    @keyword_only
    def __init__(self, *, columns: list[str] = [], invert: bool = False):  # noqa: B006
        super().__init__()
        self._setDefault(columns=[], invert=False)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ColumnSelectorModel":
        got = one_pass(df, df.columns, {"n": lambda c: F.count(F.lit(1)), "k": lambda c: F.count(col(c)), "same": lambda c: F.min(col(c)) == F.max(col(c))})
        bad = {c for c, m in got.items() if not m["k"] or (m["same"] and m["k"] == m["n"])}
        own = set(self.getOrDefault("columns"))
        keep = [c for c in df.columns if c not in bad and (c in own) != self.getOrDefault("invert")]
        return ColumnSelectorModel(columns=keep)


class ColumnSelectorModel(Model, _Select, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, columns: list[str] = []):  # noqa: B006
        super().__init__()
        self._setDefault(columns=[], invert=False)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        keep = set(self.getOrDefault("columns"))
        return df.select(*[col(c) for c in df.columns if c in keep])


def years_since(born: Column, as_of: Column | None = None, rounded: bool = True) -> Column:
    """Years of 365.2425 days from a date to ``as_of`` (default now); null gives -1; rounded half to even."""
    at = F.current_timestamp() if as_of is None else as_of
    years = (F.unix_seconds(at.cast("timestamp")) - F.unix_seconds(born.cast("timestamp"))) / F.lit(31556952.0)
    return F.coalesce(F.bround(years).cast("int"), F.lit(-1)) if rounded else F.coalesce(years, F.lit(-1.0))


SLOTS = {"hourly": "hour", "daily": "day", "weekly": "week", "monthly": "month", "quarterly": "quarter", "yearly": "year"}


def time_slot(ts: Column, interval: str = "daily") -> Column:
    """Start of the period that holds a timestamp; weeks start on Monday."""
    if interval not in SLOTS:
        raise ValueError(f"interval must be one of {sorted(SLOTS)}")
    return F.date_trunc(SLOTS[interval], ts)
