"""A one-feature ridge score in closed form, and batch scoring with saved pipelines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ridge_parameters(training: DataFrame, feature: str, label: str, alpha: float = 1.0) -> DataFrame:
    """One row (mean_x, mean_y, weight): standardising by population deviation and penalising with ``alpha`` equals
    shrinking the least-squares slope by n / (n + alpha)."""
    return training.agg(
        F.avg(feature).alias("mean_x"), F.avg(label).alias("mean_y"),
        (F.regr_slope(F.col(label), F.col(feature)) * F.count(F.lit(1)) / (F.count(F.lit(1)) + F.lit(alpha))).alias("weight"),
    )


def ridge_score(rows: DataFrame, parameters: DataFrame, feature: str) -> Column:
    """Prediction as a column; the three parameters enter as scalar subqueries."""
    mean_x, mean_y, weight = (parameters.select(c).scalar() for c in ("mean_x", "mean_y", "weight"))
    return mean_y + weight * (F.col(feature) - mean_x)


def ridge_pipeline(features: Sequence[str], label: str, alpha: float, rows: int, label_deviation: float):
    """The same model for several features. Spark scales the penalty by rows and label deviation, hence the mapping."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(stages=[
        VectorAssembler(inputCols=list(features), outputCol="__features"),
        LinearRegression(
            featuresCol="__features", labelCol=label, predictionCol="prediction", elasticNetParam=0.0,
            regParam=alpha / rows * label_deviation, standardization=True, solver="normal",
        ),
    ])


def largest_error(rows: DataFrame, predicted: str, expected: str, tolerance: float) -> DataFrame:
    error = F.max(F.abs(F.col(predicted) - F.col(expected)))
    return rows.agg(error.alias("largest_error"), (error <= F.lit(tolerance)).alias("within_tolerance"))
