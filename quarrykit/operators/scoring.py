"""Ranking, probability and classification scores."""

from __future__ import annotations

from pyspark.ml.evaluation import Evaluator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col


def average_precision(truth: Column, predicted: Column, k: int = 10) -> Column:
    """Average precision at k: the list is cut to k, a hit counts once, divided by min(|truth|, k); empty truth gives null."""
    cut = F.slice(predicted, 1, k)
    places = F.transform(cut, lambda x, i: F.when(F.array_contains(truth, x) & (F.array_position(cut, x) == i + 1), i + 1))
    hits = F.filter(places, lambda x: x.isNotNull())
    total = F.aggregate(F.transform(hits, lambda x, i: (i + 1) / x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.nullif(F.least(F.size(truth), F.lit(k)), F.lit(0)))


def mean_average_precision(df: DataFrame, truth: str, predicted: str, k: int = 10) -> DataFrame:
    return df.agg(F.avg(average_precision(col(truth), col(predicted), k)).alias("map"))


def brier(df: DataFrame, label: str, probabilities: str) -> DataFrame:
    """Mean over rows of the squared distance between class probabilities (array by class index) and the label."""
    own = F.aggregate(F.transform(col(probabilities), lambda p, i: F.pow(p - (i == col(label)).cast("double"), F.lit(2.0))), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg(own).alias("brier"))


def binary_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """tp, tn, fp, fn, accuracy, recall, precision in one aggregation; -1 where undefined."""
    y, p = col(label) == 1, col(prediction) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.expr(a), F.expr(b)), F.lit(-1.0))
    return counts.select("*", ratio("tp + tn", "tp + tn + fp + fn").alias("accuracy"), ratio("tp", "tp + fn").alias("recall"), ratio("tp", "tp + fp").alias("precision"))


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(col(label).alias("label"), col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def multiclass_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, n, precision, recall, f1) per label, from the confusion counts."""
    c = confusion(df, label, prediction)
    rows = c.groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("hit"))
    cols = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("said"))
    both = rows.join(cols, "label", "left")
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.try_divide("hit", "n")
    return both.select("label", "n", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def roc_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, tp, fp) cumulative from the highest score down; one row per distinct score."""
    from .ordered import running_totals

    counts = df.groupBy(col(score).alias("score")).agg(F.count_if(col(label) == 1).alias("p"), F.count_if(col(label) == 0).alias("q"))
    return running_totals(counts, "score", {"p": "tp", "q": "fp"}, descending=True).select("score", "p", "q", "tp", "fp")


def roc_curves(df: DataFrame, label: str, score: str, fold: str, points: int = 100, most_folds: int = 100) -> DataFrame:
    """(fold, fpr, tpr): each fold's ROC curve read at ``points`` even false positive rates, and their mean as fold null.

    Between its points a curve runs straight; where it rises at one rate the highest point
    counts. The mean curve begins at 0 and ends at 1. Folds without both classes have no
    curve. Folds are few: each is ordered on its own, without a single-task window.
    """
    names = [r[0] for r in df.select(col(fold)).filter(col(fold).isNotNull()).distinct().limit(most_folds + 1).collect()]
    if len(names) > most_folds:
        raise ValueError(f"over {most_folds} folds")
    kind = df.schema[fold].dataType.simpleString()
    last = points - 1
    out = df.sparkSession.createDataFrame([], f"fold {kind}, k int, tpr double")
    for name in sorted(names):
        pts = roc_points(df.filter(col(fold) == F.lit(name)), label, score)
        all_ = pts.agg(F.sum("p").alias("np"), F.sum("q").alias("nq"))  # one row
        seg = pts.crossJoin(F.broadcast(all_)).filter("np > 0 AND nq > 0").select(
            ((F.col("fp") - F.col("q")) / F.col("nq")).alias("x0"), (F.col("fp") / F.col("nq")).alias("x1"), ((F.col("tp") - F.col("p")) / F.col("np")).alias("y0"), (F.col("tp") / F.col("np")).alias("y1")
        )
        grid = F.sequence(F.ceil(F.col("x0") * last - 1e-9).cast("int"), F.floor(F.col("x1") * last + 1e-9).cast("int"))
        # a segment may hold no grid point: sequences never run backwards here
        some = seg.filter(F.ceil(F.col("x0") * last - 1e-9) <= F.floor(F.col("x1") * last + 1e-9)).select("*", F.explode(grid).alias("k"))
        y = F.when(F.col("x1") == F.col("x0"), F.col("y1")).otherwise(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("k") / F.lit(last) - F.col("x0")) / (F.col("x1") - F.col("x0")))
        out = out.unionByName(some.groupBy("k").agg(F.max(y).alias("tpr")).select(F.lit(name).cast(kind).alias("fold"), "k", "tpr"))
    own = out.select("fold", "k", (F.col("k") / F.lit(last)).alias("fpr"), "tpr")
    mean = own.groupBy("k").agg(F.avg("tpr").alias("tpr")).select(F.lit(None).cast(kind).alias("fold"), (F.col("k") / F.lit(last)).alias("fpr"), F.when(F.col("k") == 0, 0.0).when(F.col("k") == last, 1.0).otherwise(F.col("tpr")).alias("tpr"))
    return own.drop("k").unionByName(mean)


def roc_auc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve by trapezoids; null when a class is absent."""
    pts = roc_points(df, label, score)
    area = F.sum(F.col("q") * (F.col("tp") - F.col("p") / 2.0))
    return pts.agg(F.try_divide(area, F.nullif(F.sum("p") * F.sum("q"), F.lit(0)).cast("double")).alias("auc"))


def regression_report(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mse, rmse, mae and r2 in one aggregation."""
    y, e = col(label).cast("double"), col(label).cast("double") - col(prediction).cast("double")
    mse = F.avg(e * e)
    return df.agg(mse.alias("mse"), F.sqrt(mse).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.try_divide(mse, F.nullif(F.var_pop(y), F.lit(0.0)))).alias("r2"))


def _logit_terms(p: Column, y: Column) -> dict[str, Column]:
    return {"n": F.count(F.lit(1)), "py": F.sum(p * y), "p": F.sum(p), "pp": F.sum(p * p), "pi": F.avg(y)}


def tjur_r2(df: DataFrame, label: str, p: str, positive=1, negative=0) -> DataFrame:
    """Mean probability over positives less that over negatives."""
    return df.agg((F.avg(F.when(col(label) == positive, col(p))) - F.avg(F.when(col(label) == negative, col(p)))).alias("tjur_r2"))


def pearson_r(df: DataFrame, label: str, p: str, squared: bool = False) -> DataFrame:
    """Correlation of label and probability about the base rate, or its square."""
    t = df.agg(*[e.alias(k) for k, e in _logit_terms(col(p), col(label).cast("double")).items()])
    spread = F.expr("n * pi * (1 - pi) * (pp - 2 * pi * p + n * pi * pi)")
    r = F.try_divide(F.expr("py - n * pi * pi"), F.nullif(F.sqrt(spread), F.lit(0.0)))
    return t.select((r * r if squared else r).alias("pearson_r2" if squared else "pearson_r"))


def sum_of_squares_r2(df: DataFrame, label: str, p: str) -> DataFrame:
    t = df.agg(*[e.alias(k) for k, e in _logit_terms(col(p), col(label).cast("double")).items()])
    return t.select(F.try_divide(F.expr("2 * py - pp - n * pi * pi"), F.nullif(F.expr("n * pi * (1 - pi)"), F.lit(0.0))).alias("ss_r2"))


def multiclass_metric(df: DataFrame, label: str, prediction: str, name: str, **args) -> float:
    """One figure by name: accuracy, precision/recall/fMeasure/truePositiveRate/falsePositiveRate of a ``label``, or a weighted one.

    Weighted figures weigh the labels' own by their number of rows; ``beta`` (1) enters the
    F measures. Figures that can't be told are 0.
    """
    rows = confusion(df, label, prediction).collect()  # at most labels^2 rows
    n = sum(r.n for r in rows)
    real, said, hit = ({} for _ in range(3))
    for r in rows:
        real[r.label] = real.get(r.label, 0) + r.n
        said[r.prediction] = said.get(r.prediction, 0) + r.n
        if r.label == r.prediction:
            hit[r.label] = r.n
    beta = args.get("beta", 1.0)
    div = lambda a, b: a / b if b else 0.0

    def f(c) -> float:
        p, r = div(hit.get(c, 0), said.get(c, 0)), div(hit.get(c, 0), real.get(c, 0))
        return div((1 + beta * beta) * p * r, beta * beta * p + r)

    own = {
        "precision": lambda c: div(hit.get(c, 0), said.get(c, 0)), "recall": lambda c: div(hit.get(c, 0), real.get(c, 0)), "truePositiveRate": lambda c: div(hit.get(c, 0), real.get(c, 0)),
        "falsePositiveRate": lambda c: div(said.get(c, 0) - hit.get(c, 0), n - real.get(c, 0)), "fMeasure": f,
    }
    if name == "accuracy":
        return div(sum(hit.values()), n)
    if name in own:
        return float(own[name](args["of"]))
    plain = {"weighted" + k[0].upper() + k[1:]: fn for k, fn in own.items()}
    if name not in plain:
        raise ValueError(f"no metric {name}")
    return float(div(sum(plain[name](c) * k for c, k in real.items()), n))


class MulticlassEvaluator(Evaluator):
    """:func:`multiclass_metric` as an evaluator."""

    def __init__(self, metricName: str, predictionCol: str = "prediction", labelCol: str = "label", **args):
        super().__init__()
        self.name, self.prediction, self.label, self.args = metricName, predictionCol, labelCol, args

    def _evaluate(self, dataset: DataFrame) -> float:
        return multiclass_metric(dataset, self.label, self.prediction, self.name, **self.args)

    def isLargerBetter(self) -> bool:
        return "false" not in self.name.lower()


class FrameEvaluator(Evaluator):
    """An evaluator over a function that returns a one-row, one-column frame."""

    def __init__(self, fn, larger: bool, **args):
        super().__init__()
        self.fn, self.larger, self.args = fn, larger, args

    def _evaluate(self, dataset: DataFrame) -> float:
        return float(self.fn(dataset, **self.args).first()[0])

    def isLargerBetter(self) -> bool:
        return self.larger


SCORERS = {
    "mapk": lambda **a: FrameEvaluator(mean_average_precision, True, **a),
    "apk": lambda **a: FrameEvaluator(mean_average_precision, True, **a),
    "brier": lambda **a: FrameEvaluator(brier, False, **a),
    "auc": lambda **a: FrameEvaluator(roc_auc, True, **a),
}
