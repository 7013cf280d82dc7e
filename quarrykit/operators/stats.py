"""Regression tables, diagnostics and their plot data."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import col
from .matrix import gram
from .ordered import running_totals
from .scoring import pearson_r, sum_of_squares_r2, tjur_r2

LEVELS = (0.1, 0.05, 0.01, 0.001)


def assemble(df: DataFrame, features: list[str], label: str) -> DataFrame:
    own = df.select(*[col(c).cast("double").alias(c) for c in features], col(label).cast("double").alias("label")).dropna()
    return VectorAssembler(inputCols=features, outputCol="features").transform(own)


def fit_linear(df: DataFrame, features: list[str], label: str, intercept: bool = False):
    """(fitted model, table): ordinary least squares with coefficient, standard error, t and p per term."""
    data = assemble(df, features, label)
    model = LinearRegression(solver="normal", fitIntercept=intercept).fit(data)
    s = model.summary
    names = features + (["(intercept)"] if intercept else [])
    values = [*model.coefficients.tolist(), *([model.intercept] if intercept else [])]
    rows = [(n, float(v), float(e), float(t), float(p)) for n, v, e, t, p in zip(names, values, s.coefficientStandardErrors, s.tValues, s.pValues)]
    return model, df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p double")


def fit_logit(df: DataFrame, features: list[str], label: str, intercept: bool = True):
    data = assemble(df, features, label)
    return GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=intercept).fit(data), data


def stars(p: float, levels=LEVELS) -> str:
    if any(not 0 <= x <= 1 for x in levels) or any(b >= a for a, b in zip(levels, levels[1:])):
        raise ValueError("levels must lie in 0..1 and strictly decrease")
    return "*" * sum(p < x for x in levels)


def coefficient_table(df: DataFrame, features: list[str], label: str, family: str = "ols", levels=LEVELS, confidence: float = 0.95) -> DataFrame:
    """Coefficients with errors, p, stars and bounds; for ``logit`` odds ratio and average marginal effect too."""
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    if family == "ols":
        _, table = fit_linear(df, features, label, True)
        rows = [(*r, stars(r.p, levels), r.coefficient - z * r.std_error, r.coefficient + z * r.std_error, None, None) for r in table.collect()]
    elif family == "logit":
        model, data = fit_logit(df, features, label)
        s = model.summary
        p = F.col("prediction")
        slope = model.transform(data).agg(F.avg(p * (1 - p))).first()[0]
        names, values = [*features, "(intercept)"], [*model.coefficients.tolist(), model.intercept]
        rows = [
            (n, float(v), float(e), float(t), float(q), stars(q, levels), v - z * e, v + z * e, math.exp(v), None if n == "(intercept)" else v * slope)
            for n, v, e, t, q in zip(names, values, s.coefficientStandardErrors, s.tValues, s.pValues)
        ]
    else:
        raise ValueError("family is ols or logit")
    return df.sparkSession.createDataFrame(rows, "term string, coefficient double, std_error double, t double, p double, stars string, low double, high double, odds double, marginal_effect double")


def logit_summary(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(measure, value): McFadden, Tjur, Pearson and sum-of-squares pseudo-R2."""
    model, data = fit_logit(df, features, label)
    s = model.summary
    scored = model.transform(data).select("label", F.col("prediction").alias("p")).cache()
    rows = [("mcfadden", 1 - s.deviance / s.nullDeviance)]
    rows += [(n, fn(scored, "label", "p").first()[0]) for n, fn in (("tjur", tjur_r2), ("pearson", pearson_r), ("sum_of_squares", sum_of_squares_r2))]
    scored.unpersist()
    return df.sparkSession.createDataFrame(rows, "measure string, value double")


def to_latex(table: DataFrame, caption: str = "", most: int = 1000) -> str:
    """A LaTeX table of a small frame; over ``most`` rows are refused, never cut."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")
    lines = [" & ".join(map(cell, r)) + r" \\" for r in [table.columns, *rows]]
    return "\n".join([r"\begin{table}", r"\begin{tabular}{" + "l" * len(table.columns) + "}", lines[0], r"\hline", *lines[1:], r"\end{tabular}", *([rf"\caption{{{caption}}}"] if caption else []), r"\end{table}"])


def diagnostics(df: DataFrame, features: list[str], label: str, id_col: str, intercept: bool = True) -> DataFrame:
    """Per row: fitted, residual, leverage, studentized residual, its root, Cook's distance.

    X'X comes from one aggregation and is inverted on the driver (side: number of
    features); everything else is a projection.
    """
    one = df.select(col(id_col).alias("id"), *[col(c).cast("double").alias(c) for c in features], col(label).cast("double").alias("__y"), F.lit(1.0).alias("__1")).dropna()
    xs = [*features, *(["__1"] if intercept else [])]
    g = gram(one, [*xs, "__y"])
    k = len(xs)
    inverse = np.linalg.pinv(g[:k, :k])
    beta = inverse @ g[:k, k]
    n = one.count()
    fitted = sum((col(c) * float(b) for c, b in zip(xs, beta)), F.lit(0.0))
    leverage = sum((col(a) * col(b) * float(inverse[i, j]) for i, a in enumerate(xs) for j, b in enumerate(xs)), F.lit(0.0))
    sse = max(g[k, k] - float(beta @ g[:k, k]), 0.0)
    mse = sse / max(n - k, 1)
    out = one.select("id", fitted.alias("fitted"), (F.col("__y") - fitted).alias("residual"), leverage.alias("leverage"))
    spread = F.nullif(F.sqrt(F.lit(mse) * F.greatest(1 - F.col("leverage"), F.lit(0.0))), F.lit(0.0))
    out = out.withColumn("studentized", F.try_divide("residual", spread))
    return out.withColumn("scale", F.sqrt(F.abs("studentized"))).withColumn("cooks", F.try_divide(F.pow("studentized", F.lit(2.0)) * F.col("leverage"), F.lit(float(k)) * F.nullif(1 - F.col("leverage"), F.lit(0.0))))


def deviance_residual(y: Column, p: Column) -> Column:
    """Signed deviance residual of a 0/1 label."""
    return F.when(y == 1, F.sqrt(-2 * F.ln(p))).otherwise(-F.sqrt(-2 * F.ln(1 - p)))


def most_extreme(df: DataFrame, column: str, n: int = 3) -> DataFrame:
    """The ``n`` rows of largest absolute value: the points to annotate (a top-k report)."""
    return df.orderBy(F.desc(F.abs(col(column)))).limit(n)


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution (Acklam's rational approximation, relative error about 1e-9)."""
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def poly(cs, x: Column) -> Column:
        out = F.lit(cs[0])
        for v in cs[1:]:
            out = out * x + F.lit(v)
        return out

    q = p - 0.5
    tail = F.sqrt(-2 * F.ln(F.least(p, 1 - p)))
    edge = poly(c, tail) / poly(d, tail)
    return F.when(p < 0.02425, edge).when(p > 1 - 0.02425, -edge).otherwise(q * poly(a, q * q) / poly(b, q * q))


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """(value, n, theoretical): one row per distinct value against the normal quantile of its mid-rank."""
    counts = df.filter(col(column).isNotNull()).groupBy(col(column).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    run = running_totals(counts, "value", {"n": "upto"})
    return run.select("value", "n", normal_quantile((F.col("upto") - F.col("n") / 2.0) / F.lit(float(max(total, 1)))).alias("theoretical"))
