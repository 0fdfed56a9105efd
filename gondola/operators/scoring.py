"""The metric, folds, and summaries of scores."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.columns import clip0, log1p, mean_of, ratio
from gondola.sources.files import resolve_date


def weighted_rmsle(actual: Column, predicted: Column, weight: Column) -> Column:
    """The weighted root mean squared logarithmic error, as an aggregate; rows without a forecast or value do not count."""
    error = log1p(clip0(predicted)) - log1p(clip0(actual))
    return F.sqrt(ratio(F.sum(weight * error * error), F.sum(F.when(error.isNotNull(), weight))))


def rolling_folds(train_end: dt.date, horizon: int = 16, step: int = 28, folds: int = 4) -> list[tuple[str, dt.date, dt.date]]:
    """(name, first and last day) of the folds, the oldest first; the latest ends with the training data."""
    if min(horizon, step, folds) < 1:
        raise ValueError("horizon, step and folds must be positive")
    first = train_end - dt.timedelta(horizon - 1)
    starts = [first - dt.timedelta(k * step) for k in reversed(range(folds))]
    return [(f"fold_{i}", s, s + dt.timedelta(horizon - 1)) for i, s in enumerate(starts, 1)]


def fold_table(spark: SparkSession, folds: list[tuple[str, dt.date, dt.date]]) -> DataFrame:
    return spark.createDataFrame(folds, "fold string, valid_start date, valid_end date")


def score_by(rows: DataFrame, *keys: str) -> DataFrame:
    """The metric and the means, by keys, of rows with actual, prediction and weight."""
    return rows.groupBy(*keys).agg(
        weighted_rmsle(F.col("actual"), F.col("prediction"), F.col("weight")).alias("weighted_rmsle"),
        mean_of(F.col("prediction")).alias("mean_prediction"),
        mean_of(F.col("actual")).alias("mean_actual"),
    )


def score_each(rows: DataFrame, predictors: dict[str, str]) -> DataFrame:
    """(model, weighted_rmsle) of several forecasts of the same rows (name: column), in one aggregate."""
    scores = [weighted_rmsle(F.col("actual"), F.col(c), F.col("weight")).alias(f"_{i}") for i, c in enumerate(predictors.values())]
    pairs = F.array(*[F.struct(F.lit(n).alias("model"), F.col(f"_{i}").alias("weighted_rmsle")) for i, n in enumerate(predictors)])
    return rows.agg(*scores).select(F.inline(pairs))


def valid_start_of(value: str | None, train_end: dt.date, horizon: int = 16, step: int = 28, folds: int = 4) -> dt.date:
    """The day that a setting names, or the first day of the latest fold."""
    return resolve_date(value, rolling_folds(train_end, horizon, step, folds)[-1][1])


def summarise(scores: DataFrame, *keys: str, value: str = "weighted_rmsle") -> DataFrame:
    """Mean, sample deviation (null for one fold), least and greatest score."""
    return scores.groupBy(*keys).agg(F.avg(value).alias("mean_score"), F.stddev_samp(value).alias("std_score"), F.min(value).alias("min_score"), F.max(value).alias("max_score"))
