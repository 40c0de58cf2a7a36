"""Scaling and regression fits, each from one pass of sums."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def isoflop_fit(runs: DataFrame, by: str = "flops_budget") -> DataFrame:
    """Best model size per compute budget.

    A parabola of val_bpb over log10(params) gives the optimum when it opens upwards, else the
    best run is taken. Tokens and ratio at the optimum are interpolated between the
    neighbouring runs. The fit is done around the mean, where the sums are well conditioned.
    """
    x = F.log10("num_scaling_params")
    pts = runs.select(by, x.alias("x"), F.col("val_bpb").alias("y"), "num_scaling_params",
                      F.col("tokens_trained").cast("double").alias("tokens"),
                      F.col("param_data_ratio").cast("double").alias("ratio"))
    means = pts.groupBy(by).agg(F.avg("x").alias("xm"))
    u = F.col("x") - F.col("xm")
    sums = pts.join(means, by).groupBy(by, "xm").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in (2, 3, 4)],
        *[F.sum(F.pow(u, F.lit(k)) * F.col("y")).alias(f"y{k}") for k in (0, 1, 2)],
        F.min_by(F.struct("num_scaling_params", "tokens", "ratio", "y"), F.struct("y", "num_scaling_params")).alias("raw"),
    )
    s2, s3, s4, y0, y1, y2, n = (F.col(c) for c in ("s2", "s3", "s4", "y0", "y1", "y2", "n"))
    a = F.try_divide(y2 - s2 * y0 / n - F.try_divide(s3 * y1, s2), s4 - s2 * s2 / n - F.try_divide(s3 * s3, s2))
    fit = sums.withColumn("a", a).withColumn("b", F.try_divide(y1 - s3 * F.col("a"), s2)).withColumn(
        "c", (y0 - s2 * F.col("a")) / n
    ).withColumn("um", F.when(F.col("a") > 0, -F.col("b") / (2 * F.col("a")))).select(
        by, "raw", "a", (F.col("xm") + F.col("um")).alias("x0"),
        (F.col("a") * F.col("um") * F.col("um") + F.col("b") * F.col("um") + F.col("c")).alias("bpb"),
    )
    point = F.struct("x", "tokens", "ratio")
    near = pts.join(fit.select(by, "x0"), by).groupBy(by).agg(
        F.max(F.when(F.col("x") <= F.col("x0"), point)).alias("lo"),
        F.min(F.when(F.col("x") >= F.col("x0"), point)).alias("hi"),
    )

    def between(name: str) -> Column:
        lo, hi = F.col(f"lo.{name}"), F.col(f"hi.{name}")
        part = F.try_divide(F.col("x0") - F.col("lo.x"), F.col("hi.x") - F.col("lo.x"))
        return F.coalesce(lo + F.coalesce(part, F.lit(0.0)) * (hi - lo), lo, hi)

    fitted = F.col("x0").isNotNull()
    return fit.join(near, by).select(
        by, fitted.alias("fitted"),
        F.when(fitted, F.pow(F.lit(10.0), F.col("x0"))).otherwise(F.col("raw.num_scaling_params").cast("double")).alias("params"),
        F.when(fitted, between("tokens")).otherwise(F.col("raw.tokens")).alias("tokens"),
        F.when(fitted, between("ratio")).otherwise(F.col("raw.ratio")).alias("ratio"),
        F.when(fitted, F.col("bpb")).otherwise(F.col("raw.y")).alias("bpb"),
    )


def powerlaw_fit(optima: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of log10(y) over log10(x)."""
    return optima.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(F.log10(y), F.log10(x)).alias("slope"),
        F.regr_intercept(F.log10(y), F.log10(x)).alias("intercept"),
        F.regr_r2(F.log10(y), F.log10(x)).alias("r2"),
    ).filter("n >= 2")


def best_per_group(runs: DataFrame, by: Sequence[str], value: str = "val_bpb", tie: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest value per group; ties go to the smallest ``tie`` columns."""
    others = [c for c in runs.columns if c not in by]
    best = runs.groupBy(*by).agg(F.min_by(F.struct(*others), F.struct(value, *tie)).alias("r"))
    return best.select(*by, "r.*")


def fit_linear(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"),
    )


def fit_ridge(df: DataFrame, features: Sequence[str], y: str, alpha: float = 0.1) -> dict:
    """Ridge regression with an unpenalized intercept, and its R squared.

    The Gram matrix is summed in one pass; only its (d + 1)^2 numbers reach the driver.
    """
    cols = [F.lit(1.0), *[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    d = len(cols)
    cells = [F.sum(cols[i] * cols[j]) for i in range(d) for j in range(i, d)]
    flat = list(df.agg(*cells).first())
    gram = np.zeros((d, d))
    it = iter(flat)
    for i in range(d):
        for j in range(i, d):
            gram[i, j] = gram[j, i] = next(it)
    xx, xy, yy = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    penalty = alpha * np.eye(d - 1)
    penalty[0, 0] = 0.0
    w = np.linalg.solve(xx + penalty, xy)
    residual = yy - 2 * w @ xy + w @ xx @ w
    total = yy - xy[0] ** 2 / xx[0, 0]
    return {
        "features": list(features), "intercept": float(w[0]), "weights": [float(v) for v in w[1:]],
        "r2": float(1 - residual / total),
    }


def predict(df: DataFrame, model: dict, name: str = "predicted") -> DataFrame:
    out = F.lit(model["intercept"])
    for f, w in zip(model["features"], model["weights"]):
        out = out + F.lit(w) * F.col(f)
    return df.withColumn(name, out)


def mean_of_models(df: DataFrame, names: Sequence[str], name: str = "estimate") -> DataFrame:
    total = F.lit(0.0)
    for n in names:
        total = total + F.col(n)
    return df.withColumn(name, total / len(names))


def improvement_pct(new: Column, old: Column) -> Column:
    return F.lit(100.0) * (new - old) / old
