"""Character-bigram Markov model that tells words from gibberish."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.columns import col

ACCEPTED = "abcdefghijklmnopqrstuvwxyz "


class _Params(Params):
    inputCol = Param(Params._dummy(), "inputCol", "text", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "probability", TypeConverters.toString)
    accepted = Param(Params._dummy(), "accepted", "characters that count", TypeConverters.toString)
    smoothing = Param(Params._dummy(), "smoothing", "added to each count", TypeConverters.toFloat)
    logs = Param(Params._dummy(), "logs", "log probabilities, row by row", TypeConverters.toListFloat)

    def _defaults(self) -> None:
        self._setDefault(inputCol="text", outputCol="probability", accepted=ACCEPTED, smoothing=10.0, logs=[])


def accepted_text(text: Column, accepted: str) -> Column:
    own = "".join("\\" + c if c in "\\]^-[" else c for c in accepted)
    return F.regexp_replace(F.lower(text), f"[^{own}]", "")


def codes(text: Column, accepted: str) -> Column:
    """Places (from 0) in ``accepted`` of a text's accepted characters, one pass over the text."""
    clean = accepted_text(text, accepted)
    return F.when(clean == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(clean, ""), lambda c: F.instr(F.lit(accepted), c) - 1))


def transitions(found: Column, width: int) -> Column:
    """Each pair of neighbours of an array of codes as one number, first * width + second; the array is an argument, never inside the lambda."""
    n = F.greatest(F.size(found) - 1, F.lit(0))
    return F.zip_with(F.slice(found, 1, n), F.slice(found, 2, n), lambda a, b: a * width + b)


class GibberishDetector(Estimator, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """Learns log transition probabilities between accepted characters from counts plus smoothing."""

    @keyword_only
    def __init__(self, *, inputCol: str = "text", outputCol: str = "probability", accepted: str = ACCEPTED, smoothing: float = 10.0):
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "GibberishModel":
        from math import log

        own = self.getOrDefault("accepted")
        k = self.getOrDefault("smoothing")
        counts = df.select(codes(col(self.getOrDefault("inputCol")), own).alias("c")).select(F.explode(transitions(F.col("c"), len(own))).alias("b")).groupBy("b").count().collect()  # at most len(accepted)^2 rows
        seen = {r[0]: r[1] for r in counts}
        logs: list[float] = []
        for a in range(len(own)):
            row = [seen.get(a * len(own) + b, 0) + k for b in range(len(own))]
            logs += [log(x / sum(row)) for x in row]
        model = GibberishModel(logs=logs)
        for p in ("inputCol", "outputCol", "accepted", "smoothing"):
            model._set(**{p: self.getOrDefault(p)})
        return model


class GibberishModel(Model, _Params, DefaultParamsReadable, DefaultParamsWritable):
    """exp of the mean log probability over a text's transitions; 1 where there is none."""

    @keyword_only
    def __init__(self, *, logs: list[float] = []):  # noqa: B006
        super().__init__()
        self._defaults()
        self._set(**self._input_kwargs)

    def probability(self, found: Column) -> Column:
        """From a column of :func:`codes`."""
        own, logs = self.getOrDefault("accepted"), self.getOrDefault("logs")
        table = F.array(*map(F.lit, logs))
        values = F.transform(transitions(found, len(own)), lambda b: F.get(table, b))
        total = F.aggregate(values, F.lit(0.0), lambda s, x: s + x)
        return F.exp(F.coalesce(F.try_divide(total, F.size(values)), F.lit(0.0)))

    def _transform(self, df: DataFrame) -> DataFrame:
        name = "codes"
        while name in df.columns:
            name += "_"
        own = df.withColumn(name, codes(col(self.getOrDefault("inputCol")), self.getOrDefault("accepted")))
        return own.withColumn(self.getOrDefault("outputCol"), self.probability(F.col(name))).drop(name)

    def predict(self, df: DataFrame, threshold: float, to: str = "gibberish") -> DataFrame:
        """1 where the probability is below the threshold."""
        out = self.transform(df)
        return out.withColumn(to, (F.col(self.getOrDefault("outputCol")) < threshold).cast("int"))
