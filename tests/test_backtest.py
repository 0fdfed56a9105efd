"""Tuning, the hold-out of three predictors, routing with and without a model, vocabularies."""

import datetime as dt
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from gondola import queries as q
from gondola.operators import routing, scoring
from gondola.plans import backtest, frames, model
from gondola.sources.retail import load

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
SETTINGS = backtest.Settings(q.TRAIN_END, q.TEST_START, q.TEST_END, (112,), folds=1, most_fit=150, trees={"maxIter": 2, "maxDepth": 2})


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, DATA)


def test_trials_follow_their_seed_and_ranges():
    made = model.trial_settings(20, 7)
    assert made == model.trial_settings(20, 7) != model.trial_settings(20, 8)
    for trees, blend in made:
        assert all(v in model.TREE_CHOICES[n] for n, v in trees.items()) and len(trees) == 7
        assert all(low <= blend[n] <= high for n, (low, high) in model.BLEND_RANGES.items()) and len(blend) == 3


def test_tuning_takes_the_best_trial(tables):
    few = {"maxDepth": (2, 3), "maxIter": (2, 3)}
    s, trials = backtest.tuned(tables, backtest.replace(SETTINGS, trials=2), choices=few)
    best = min(trials, key=lambda x: x["score"])
    assert len(trials) == 2 and all(0 < t["score"] < 10 and 1 <= t["rounds"] <= t["trees"]["maxIter"] for t in trials)
    assert s.trees == best["trees"] and s.history_scale == best["blend"]["history_scale"] and s.unseen_weight == best["blend"]["unseen_weight"]


def test_holdout_scores_three_predictors_on_the_same_rows(spark, tables):
    made = backtest.holdout_experiment(tables, SETTINGS)
    assert made["valid_start"] == q.VALID_START and len(made["scores"]) == 3 and abs(sum(made["importance"].values()) - 1) < 1e-6
    assert made["rows"].count() == tables.rows_between(q.VALID_START, q.VALID_END).count()
    wanted = {r["baseline"]: r["weighted_rmsle"] for r in q.queries()["baseline_scores"](spark, DATA).collect()}
    for name, score in wanted.items():
        assert made["scores"][name] == pytest.approx(score, abs=1e-6)
    assert made["daily"].agg(F.sum("actual")).first()[0] == made["rows"].agg(F.sum("actual")).first()[0]


def test_series_forecasts_with_and_without_a_model(tables):
    eligible, horizon, _ = frames.series_final(tables, q.TRAIN_END, q.TEST_START, q.TEST_END, q.LOOKBACK, q.ENCODER, q.LEAST_POINTS)
    assert horizon.count() == tables.test.count() == horizon.select("id").distinct().count()
    alone = backtest.series_forecast(eligible, horizon)
    assert alone.filter("used_fallback = 0 or final_prediction is null").isEmpty()
    nine = lambda fit, rows: rows.select(*frames.KEYS, F.lit(9.0).alias("model_prediction"))
    both = backtest.series_forecast(eligible, horizon, nine)
    assert both.count() == horizon.count()
    assert both.filter("used_fallback = 1 - is_tft_eligible").count() == both.count()
    assert both.filter("is_tft_eligible = 1 and final_prediction <> 9").isEmpty()
    assert backtest.series_forecast(eligible.limit(0), horizon, nine).filter("used_fallback = 0").isEmpty()


def test_vocabulary_is_shared_and_has_the_missing_category(spark):
    one = spark.createDataFrame([(1, "a"), (None, "b")], "x int, y string")
    two = spark.createDataFrame([(2, None), (1, "b")], "x int, y string")
    found = {tuple(r) for r in routing.vocabulary((one, two), ("x", "y")).collect()}
    assert found == {("x", "0"), ("x", "1"), ("x", "2"), ("y", "0"), ("y", "a"), ("y", "b")}
    assert {tuple(r) for r in routing.vocabulary((one.limit(0),), ("x", "y")).collect()} == {("x", "0"), ("y", "0")}
    assert [tuple(r) for r in routing.as_categories(two, ("x", "y")).collect()] == [("2", "0"), ("1", "b")]
    with pytest.raises(ValueError):
        routing.vocabulary((), ("x",))


def test_null_codes_are_refused(tables):
    fit, _ = frames.panel_fold(tables, q.VALID_START, q.LOOKBACK, most_fit=100)
    with pytest.raises(PySparkException, match="family_code is null"):
        model.fit_trees(fit.withColumn("family_code", F.lit(None).cast("int")), maxIter=1, maxDepth=1)


def test_the_latest_fold_is_the_default():
    assert scoring.valid_start_of(None, q.TRAIN_END) == scoring.valid_start_of("none", q.TRAIN_END) == q.VALID_START
    assert scoring.valid_start_of("2001-02-03", q.TRAIN_END) == dt.date(2001, 2, 3)
