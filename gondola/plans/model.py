"""The model seam: a feature frame in, one numeric column out, with Spark's own gradient-boosted trees."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import clip0, item_weight, known_code, log1p
from gondola.operators.scoring import weighted_rmsle
from gondola.plans.frames import CODES, FEATURES


def fit_trees(rows: DataFrame, features: Iterable[str] = FEATURES, validation: str | DataFrame | None = None, **params) -> PipelineModel:
    """Trees for ln(1 + target) with the items' weights.

    ``validation``: rows for early stopping, as a boolean column of rows or a frame of their own. A null code among the
    features ends the fit.
    """
    names = list(features)
    if isinstance(validation, DataFrame):
        used = dict.fromkeys([*names, "target", "perishable"])
        rows = rows.select(*used, F.lit(False).alias("_held")).unionByName(validation.select(*used, F.lit(True).alias("_held")))
        validation = "_held"
    ready = rows.withColumns({"_label": log1p(F.col("target")), "_weight": item_weight(F.col("perishable"))} | {c: known_code(c) for c in names if c in CODES})
    settings = {"maxIter": 20, "maxDepth": 5, "stepSize": 0.1, "seed": 42} | params
    trees = GBTRegressor(featuresCol="_features", labelCol="_label", weightCol="_weight", predictionCol="_log", **settings)
    if validation:
        trees = trees.setValidationIndicatorCol(validation)
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), trees]).fit(ready)


def predict(model: PipelineModel, rows: DataFrame, name: str = "model_prediction") -> DataFrame:
    """rows with the model's forecast, back on the scale of sales and at least 0; keys stay with their rows."""
    return model.transform(rows).withColumn(name, clip0(F.exp("_log") - 1.0)).drop("_features", "_log")


def importances(model: PipelineModel, features: Iterable[str] = FEATURES) -> list[tuple[str, float]]:
    """(feature, share of the gain), the greatest first."""
    return sorted(zip(features, map(float, model.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


#: What a trial draws for the trees, and (as ranges) for the blend that follows them.
TREE_CHOICES = {"maxDepth": (3, 4, 5, 6), "stepSize": (0.03, 0.05, 0.1, 0.2), "maxIter": (5, 10, 20), "subsamplingRate": (0.7, 0.85, 1.0), "maxBins": (32, 64, 128), "minInstancesPerNode": (1, 5, 20), "minInfoGain": (0.0, 0.001, 0.01)}
BLEND_RANGES = {"history_scale": (1.5, 6.0), "least_weight": (0.85, 1.0), "unseen_weight": (0.0, 1.0)}


def trial_settings(trials: int, seed: int = 42, choices: dict | None = None) -> list[tuple[dict, dict]]:
    """(settings of the trees, of the blend) of each trial; a seed gives the same list anywhere."""
    draw, choices = random.Random(seed), TREE_CHOICES if choices is None else choices
    return [({n: draw.choice(x) for n, x in choices.items()}, {n: draw.uniform(*x) for n, x in BLEND_RANGES.items()}) for _ in range(trials)]


def random_search(
    fit: DataFrame, valid: DataFrame, finish: Callable[[DataFrame, dict], DataFrame], features: Iterable[str] = FEATURES,
    trials: int = 8, seed: int = 42, evaluation: DataFrame | None = None, choices: dict | None = None,
) -> tuple[tuple[dict, dict], list[dict]]:
    """The best (settings of the trees, of the blend) of a seeded random search, and all trials with their scores.

    ``finish`` (rows with model_prediction, settings of the blend) adds final_prediction, which the metric over valid
    scores. evaluation: rows whose error ends the boosting early; valid by default. The frames are kept for the trials;
    a trial without a score (no row of valid has a target) counts as the worst.
    """
    names, done = list(features), []
    fit, valid = fit.persist(), valid.persist()
    try:
        for trees, blend in trial_settings(trials, seed, choices):
            fitted = fit_trees(fit, names, valid if evaluation is None else evaluation, **trees)
            scored = finish(predict(fitted, valid), blend)
            score = scored.agg(weighted_rmsle(F.col("target"), F.col("final_prediction"), item_weight(F.col("perishable")))).first()[0]
            done.append({"trees": trees, "blend": blend, "rounds": fitted.stages[-1].getNumTrees, "score": float("inf") if score is None else float(score)})
    finally:
        fit.unpersist()
        valid.unpersist()
    best = min(done, key=lambda x: x["score"])
    return (best["trees"], best["blend"]), done
