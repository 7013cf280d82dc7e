"""Cross-validated models: metrics registry, training, testing, scoring, persistence."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.columns import col
from ..operators.profile import histogram
from ..operators.sampling import stratified_folds
from ..operators.scoring import binary_report, regression_report
from ..plans.lineage import spread


def metric(name: str | Callable | None = None):
    """Mark a method (self, predictions) as a metric, under ``name`` or its own name."""

    def mark(fn):
        fn._metric = name if isinstance(name, str) else fn.__name__
        return fn

    return mark(name) if callable(name) else mark


class ResidualPipeline(Transformer):
    """Up to two stages: the second is a callable (result of the first, original frame) -> frame."""

    def __init__(self, first: Transformer, second: Callable[[DataFrame, DataFrame], DataFrame] | None = None):
        super().__init__()
        self.first, self.second = first, second

    def _transform(self, df: DataFrame) -> DataFrame:
        out = self.first.transform(df)
        return self.second(out, df) if self.second else out


class CVModel:
    """Features -> indexers -> vector -> cross-validated estimator.

    Each class has metrics of its own, collected from its bases. ``features`` returns
    (binary, numeric, categorical) names; the default reads them from the schema.
    """

    metrics: dict[str, Callable] = {}

    def __init_subclass__(cls, **kw):
        super().__init_subclass__(**kw)
        cls.metrics = {f._metric: f for base in reversed(cls.__mro__) for f in vars(base).values() if callable(f) and hasattr(f, "_metric")}

    def __init__(self, estimator, evaluator, grid: dict[str, list] | None = None, label: str = "label"):
        if not hasattr(estimator, "fit") or not hasattr(evaluator, "evaluate"):
            raise TypeError("an estimator and an evaluator are needed")
        self.estimator, self.evaluator, self.label = estimator, evaluator, label
        self.grid = self.param_grid(grid or {})
        self.best_params: dict = {}
        self.model: PipelineModel | None = None

    def param_grid(self, grid: dict[str, list]):
        b = ParamGridBuilder()
        for name, values in grid.items():
            b = b.addGrid(self.estimator.getParam(name), values)
        return b.build()

    def features(self, df: DataFrame) -> tuple[list[str], list[str], list[str]]:
        rest = [f for f in df.schema if f.name not in (self.label, "fold")]
        return ([f.name for f in rest if isinstance(f.dataType, T.BooleanType)], [f.name for f in rest if isinstance(f.dataType, T.NumericType)], [f.name for f in rest if isinstance(f.dataType, T.StringType)])

    def train(self, df: DataFrame, folds: int = 10, parallelism: int = 4, seed: int = 0, fold_col: str | None = None):
        """Fit; returns the CrossValidatorModel. The assembled frame is cached, in partitions of bounded length, while folds run."""
        df = spread(df)
        binary, numeric, categorical = self.features(df)
        named = df.withColumnRenamed(self.label, "label")
        for c in binary:
            named = named.withColumn(c, col(c).cast("int"))
        indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_idx", handleInvalid="keep") for c in categorical]
        assembler = VectorAssembler(inputCols=[*binary, *numeric, *[f"{c}_idx" for c in categorical]], outputCol="features", handleInvalid="skip")
        prepared = Pipeline(stages=[*indexers, assembler]).fit(named)
        data = prepared.transform(named).select("features", "label", *([fold_col] if fold_col else [])).cache()
        cv = CrossValidator(estimator=self.estimator, estimatorParamMaps=self.grid, evaluator=self.evaluator, numFolds=folds, parallelism=parallelism, seed=seed, **({"foldCol": fold_col} if fold_col else {}))
        fitted = cv.fit(data)
        data.unpersist()
        pick = max if self.evaluator.isLargerBetter() else min
        at = fitted.avgMetrics.index(pick(fitted.avgMetrics))
        self.best_params = {p.name: v for p, v in self.grid[at].items()}
        self.model = PipelineModel(stages=[*prepared.stages, fitted.bestModel])
        return fitted

    def _named(self, df: DataFrame) -> DataFrame:
        out = df.withColumnRenamed(self.label, "label") if self.label in df.columns else df
        for f in out.schema:
            if isinstance(f.dataType, T.BooleanType):
                out = out.withColumn(f.name, col(f.name).cast("int"))
        return out

    def score(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self._named(df))

    def test(self, df: DataFrame) -> tuple[DataFrame, dict]:
        """(predictions, every metric and the best parameters)."""
        p = self.score(spread(df)).cache()
        out = {name: fn(self, p) for name, fn in self.metrics.items()}
        out[self.evaluator.getMetricName() if hasattr(self.evaluator, "getMetricName") else "score"] = self.evaluator.evaluate(p)
        p.unpersist()
        return p, out | {"best_params": self.best_params}

    def train_final(self, df: DataFrame) -> PipelineModel:
        """Refit the estimator with the best parameters after the stages already fitted."""
        stages = self.model.stages[:-1]
        data = PipelineModel(stages=stages).transform(self._named(df))
        own = self.estimator.copy({self.estimator.getParam(k): v for k, v in self.best_params.items()})
        self.model = PipelineModel(stages=[*stages, own.fit(data)])
        return self.model

    def save(self, path: str) -> None:
        """The pipeline and its best parameters, both through the cluster's file system."""
        self.model.write().overwrite().save(f"{path}/model")
        self._spark().createDataFrame([(json.dumps(self.best_params),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    def load(self, path: str) -> "CVModel":
        self.model = PipelineModel.load(f"{path}/model")
        self.best_params = json.loads(self._spark().read.text(f"{path}/metadata").first()[0])
        return self

    @staticmethod
    def _spark():
        from pyspark.sql import SparkSession

        return SparkSession.active()

    def feature_importances(self) -> list[tuple[str, float]]:
        """(feature, importance), heaviest first."""
        names = next(s for s in self.model.stages if isinstance(s, VectorAssembler)).getInputCols()
        return sorted(zip(names, map(float, self.model.stages[-1].featureImportances.toArray())), key=lambda x: (-x[1], x[0]))

    def importance_frame(self, k: int | None = None) -> DataFrame:
        """(feature, importance, spread over trees), heaviest first, the first ``k`` of them if given."""
        import numpy as np

        trees = np.array([t.featureImportances.toArray() for t in self.model.stages[-1].trees])
        spread = dict(zip(next(s for s in self.model.stages if isinstance(s, VectorAssembler)).getInputCols(), trees.std(0)))
        rows = [(n, v, float(spread[n])) for n, v in self.feature_importances()]
        return self._spark().createDataFrame(rows[:k], "feature string, importance double, spread double")


class BinaryClassCV(CVModel):
    def __init__(self, estimator, evaluator=None, grid=None, label: str = "label"):
        super().__init__(estimator, evaluator or BinaryClassificationEvaluator(), grid, label)

    @metric
    def report(self, p: DataFrame) -> dict:
        return binary_report(p).first().asDict()

    @metric("F1(1)")
    def f1(self, p: DataFrame) -> float:
        return MulticlassClassificationEvaluator(metricName="f1").evaluate(p)

    @metric
    def auroc(self, p: DataFrame) -> float:
        return BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(p)


class RegressionCV(CVModel):
    def __init__(self, estimator, evaluator=None, grid=None, label: str = "label"):
        super().__init__(estimator, evaluator or RegressionEvaluator(metricName="mae"), grid, label)

    @metric
    def report(self, p: DataFrame) -> dict:
        return regression_report(p, "label", "prediction").first().asDict()

    def residual_histogram(self, p: DataFrame, bins: int = 25) -> DataFrame:
        return histogram(p.withColumn("residual", F.col("label") - F.col("prediction")), "residual", bins)


class RandomForestBinary(BinaryClassCV):
    """Random forest; by default 36 points of depth, trees and least rows a leaf."""

    def __init__(self, grid: dict[str, list] | None = None, label: str = "label", seed: int = 0):
        super().__init__(RandomForestClassifier(seed=seed), None, grid or {"maxDepth": [5, 10, 20], "numTrees": list(range(20, 51, 10)), "minInstancesPerNode": [1, 2, 3]}, label)


class BoostedRegressor(RegressionCV):
    """Gradient-boosted trees with absolute loss; step, rounds, row and feature shares as the grid."""

    def __init__(self, grid: dict[str, list] | None = None, label: str = "label", seed: int = 0):
        default = {"stepSize": [0.05, 0.1, 0.2], "maxIter": [50, 100, 150], "maxDepth": [3, 5, 7], "subsamplingRate": [0.7, 1.0], "featureSubsetStrategy": ["0.6", "0.8", "1.0"]}
        super().__init__(GBTRegressor(lossType="absolute", seed=seed), None, grid or default, label)


def cross_validate(df: DataFrame, estimator, evaluators: dict[str, object], label: str, id_col: str, k: int = 5, seed: int = 0) -> DataFrame:
    """(metric, split, mean, std, min, max) over stratified folds; ``df`` has features and label."""
    folded = stratified_folds(df, label, id_col, k, seed).cache()
    rows = []
    for fold in range(k):
        parts = {"train": folded.filter(F.col("fold") != fold), "test": folded.filter(F.col("fold") == fold)}
        model = estimator.fit(parts["train"])
        for split, part in parts.items():
            p = model.transform(part)
            rows += [(name, split, fold, float(e.evaluate(p))) for name, e in evaluators.items()]
    folded.unpersist()
    values = df.sparkSession.createDataFrame(rows, "metric string, split string, fold int, value double")
    return values.groupBy("metric", "split").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))


def estimator_name(model) -> str:
    return type(model).__name__
