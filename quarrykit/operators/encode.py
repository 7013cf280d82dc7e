"""Label codes, scaling, frequent categories, rare-category indexing."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col, one_pass
from .reshape import levels


def encode_labels(df: DataFrame, label: str, most: int = 10_000) -> DataFrame:
    """Sorted distinct labels to 0..n-1; absent columns pass through; null stays null."""
    return LabelCoder(labelCol=label, most=most).fit(df).transform(df)


class _Label(Params):
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    labels = Param(Params._dummy(), "labels", "labels in order", TypeConverters.toListString)
    most = Param(Params._dummy(), "most", "most labels", TypeConverters.toInt)


class LabelCoder(Estimator, _Label, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, labelCol: str = "label", most: int = 10_000):
        super().__init__()
        self._setDefault(labelCol="label", labels=[], most=10_000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "LabelCoderModel":
        c = self.getOrDefault("labelCol")
        own = [str(v) for v in levels(df, c, self.getOrDefault("most"))] if c in df.columns else []
        return LabelCoderModel(labelCol=c, labels=own)


class LabelCoderModel(Model, _Label, DefaultParamsReadable, DefaultParamsWritable):
    """Raises on a label it has not seen."""

    @keyword_only
    def __init__(self, *, labelCol: str = "label", labels: list[str] = []):  # noqa: B006
        super().__init__()
        self._setDefault(labelCol="label", labels=[], most=10_000)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        c, own = self.getOrDefault("labelCol"), self.getOrDefault("labels")
        if c not in df.columns:
            return df
        known = F.create_map(*[x for k, v in enumerate(own) for x in (F.lit(v), F.lit(k))]) if own else F.create_map().cast("map<string,int>")
        code = F.try_element_at(known, col(c).cast("string"))
        checked = F.when(col(c).isNotNull() & code.isNull(), F.raise_error(F.concat(F.lit("unseen label "), col(c).cast("string"))).cast("int")).otherwise(code)
        return df.withColumn(c, checked)


def scale(df: DataFrame, columns: list[str], method: str = "minmax") -> DataFrame:
    """``minmax`` or ``zscore`` (population deviation); constant columns become 0, nulls stay."""
    if method == "minmax":
        m = one_pass(df, columns, {"a": lambda c: F.min(col(c)).cast("double"), "b": lambda c: (F.max(col(c)) - F.min(col(c))).cast("double")})
    elif method == "zscore":
        m = one_pass(df, columns, {"a": lambda c: F.avg(col(c)), "b": lambda c: F.stddev_pop(col(c))})
    else:
        raise ValueError("method is minmax or zscore")

    def scaled(c: str) -> Column:
        a, b = m[c]["a"], m[c]["b"]
        return F.when(col(c).isNotNull(), (col(c) - F.lit(a)) / F.lit(b) if b else F.lit(0.0))

    return df.select(*[scaled(c).alias(c) if c in m else col(c) for c in df.columns])


def keep_top_categories(df: DataFrame, column: str, k: int = 1, drop_null: bool = False, other: str = "Other") -> DataFrame:
    """The ``k`` commonest values stay (ties: lesser value first, null counts unless dropped), others become ``other``.

    A column of one value stays as it is. The k values are a bounded list in the plan.
    """
    counts = df.groupBy(col(column).alias("v")).count()
    if drop_null:
        counts = counts.filter("v IS NOT NULL")
    top = counts.orderBy(F.desc("count"), F.asc_nulls_first("v")).limit(max(k, 2)).collect()
    if len(top) < 2:
        return df
    kept = [r.v for r in top[:k]]
    stays = col(column).isin([v for v in kept if v is not None])
    if None in kept:
        stays = col(column).isNull() | F.coalesce(stays, F.lit(False))
    elif drop_null:
        stays = col(column).isNull() | stays
    return df.withColumn(column, F.when(F.coalesce(stays, F.lit(False)), col(column).cast("string")).otherwise(F.lit(other)))


class _Rare(Params):
    inputCols = Param(Params._dummy(), "inputCols", "inputs", TypeConverters.toListString)
    outputCols = Param(Params._dummy(), "outputCols", "outputs", TypeConverters.toListString)
    threshold = Param(Params._dummy(), "threshold", "share that a value must exceed to stay", TypeConverters.toFloat)
    groupText = Param(Params._dummy(), "groupText", "name of the rest", TypeConverters.toString)
    returnIndexed = Param(Params._dummy(), "returnIndexed", "codes rather than texts", TypeConverters.toBoolean)
    dropInputCols = Param(Params._dummy(), "dropInputCols", "drop the inputs", TypeConverters.toBoolean)
    handleInvalid = Param(Params._dummy(), "handleInvalid", "skip, keep or error", TypeConverters.toString)
    kept = Param(Params._dummy(), "kept", "input, number kept, number seen, labels... in turn", TypeConverters.toList)

    def _defaults(self) -> None:
        self._setDefault(inputCols=[], outputCols=[], threshold=0.01, groupText="other", returnIndexed=True, dropInputCols=False, handleInvalid="skip", kept=[])


class RareCategoryIndexer(Estimator, _Rare, DefaultParamsReadable, DefaultParamsWritable):
    """Indexes strings by descending count (ties: lesser first), values with a share of ``threshold`` or less grouped.

    One aggregation serves all columns. ``handleInvalid``: rows with null or unseen
    values are skipped, kept in the group of the rest, or an error.
    """

    @keyword_only
    def __init__(self, *, inputCols: list[str] = [], outputCols: list[str] = [], threshold: float = 0.01, groupText: str = "other", returnIndexed: bool = True, dropInputCols: bool = False, handleInvalid: str = "skip"):  # noqa: B006
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "RareCategoryIndexerModel":
        names = self.getOrDefault("inputCols")
        pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("c"), col(n).cast("string").alias("v")) for k, n in enumerate(names)])).alias("p")
        counts = df.select(pairs).groupBy("p.c", "p.v").count()
        totals = {r[0]: r[1] for r in counts.groupBy("c").agg(F.sum("count")).collect()}
        limit = self.getOrDefault("threshold")
        need = F.element_at(F.create_map(*[x for k in range(len(names)) for x in (F.lit(k), F.lit(limit * totals.get(k, 0)))]), F.col("c"))
        seen = {r[0]: r[1] for r in counts.filter("v IS NOT NULL").groupBy("c").count().collect()}
        big = counts.filter("v IS NOT NULL").filter(F.col("count") > need).collect()  # fewer than 1 / threshold values a column
        kept = []
        for k, n in enumerate(names):
            own = sorted(((-r["count"], r["v"]) for r in big if r["c"] == k))
            kept.append([n, str(seen.get(k, 0)), *[v for _, v in own]])
        model = RareCategoryIndexerModel(kept=kept)
        for p in ("inputCols", "outputCols", "groupText", "returnIndexed", "dropInputCols", "handleInvalid", "threshold"):
            model._set(**{p: self.getOrDefault(p)})
        return model


class RareCategoryIndexerModel(Model, _Rare, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(self, *, kept: list = []):  # noqa: B006
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        group, how = self.getOrDefault("groupText"), self.getOrDefault("handleInvalid")
        out = df
        for (name, seen, *own), to in zip(self.getOrDefault("kept"), self.getOrDefault("outputCols")):
            labels = own + ([group] if len(own) < int(seen) or how == "keep" else [])
            table = F.create_map(*[x for k, v in enumerate(own) for x in (F.lit(v), F.lit(float(k)))]) if own else F.create_map().cast("map<string,double>")
            found = F.try_element_at(table, col(name).cast("string"))
            code = F.coalesce(found, F.lit(float(len(own)))) if len(labels) > len(own) else found
            if how == "skip":
                out = out.filter(col(name).isNotNull())
                if len(labels) == len(own):
                    out = out.filter(found.isNotNull())
            elif how == "error":
                code = F.when(col(name).isNull(), F.raise_error(F.lit(f"null in {name}")).cast("double")).otherwise(code)
            if self.getOrDefault("returnIndexed"):
                out = out.withColumn(to, code).withMetadata(to, {"ml_attr": {"vals": labels, "type": "nominal", "name": to}})
            else:
                out = out.withColumn(to, F.element_at(F.array(*map(F.lit, labels)), (code + 1).cast("int")))
        return out.drop(*self.getOrDefault("inputCols")) if self.getOrDefault("dropInputCols") else out
