"""Properties of feature frames and of the model seam, over the smallest test tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from gondola import queries as q
from gondola.plans import frames, model
from gondola.sources.retail import Retail, load

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def tables(spark):
    return load(spark, DATA)


def test_panel_is_complete_and_has_one_source_a_row(tables):
    horizon = frames.panel_fold(tables, q.VALID_START, q.LOOKBACK)[1].cache()
    assert horizon.count() == 16 * tables.universe.count() == horizon.select(*q.FRAME_KEYS).distinct().count()
    assert horizon.filter("fallback_source is null or fallback_prediction is null or fallback_prediction < 0").isEmpty()


def test_features_do_not_see_the_future(spark, tables):
    """Sales on and after the cutoff, changed, leave every feature of the horizon as it was."""
    late = F.col("date") >= F.lit(q.VALID_START)
    changed = Retail(tables.train.withColumn("unit_sales", F.when(late, F.col("unit_sales") * 7 + 1).otherwise(F.col("unit_sales"))), tables.test, tables.stores, tables.items, tables.transactions, tables.oil, tables.holidays)
    one, two = (frames.panel_fold(t, q.VALID_START, q.LOOKBACK)[1].select(*q.FRAME_KEYS, *frames.FEATURES, "fallback_prediction") for t in (tables, changed))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_partitions_do_not_matter(spark, tables):
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "1")
        one = sorted(map(repr, q.queries()["hierarchical_baseline"](spark, DATA).collect()))
        spark.conf.set(name, "7")
        assert sorted(map(repr, q.queries()["hierarchical_baseline"](spark, DATA).collect())) == one
    finally:
        spark.conf.set(name, before)


def test_filters_and_columns_reach_the_scan(tables):
    plan = frames.baselines(tables, q.VALID_START)[1]._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan and "l_shipdate" in plan and "GreaterThanOrEqual(l_shipdate" in plan


def test_trees_fit_and_keep_rows(tables):
    fit, horizon = frames.panel_fold(tables, q.VALID_START, q.LOOKBACK, most_fit=200, zeros=50)
    fit = fit.withColumn("held", F.col("date") >= F.lit(q.VALID_START - dt.timedelta(14)))
    fitted = model.fit_trees(fit, validation="held", maxIter=2, maxDepth=2)
    out = model.predict(fitted, horizon)
    assert out.count() == horizon.count() and out.filter("model_prediction < 0 or model_prediction is null").isEmpty()
    assert abs(sum(x for _, x in model.importances(fitted)) - 1) < 1e-6


def test_back_test_and_forecast_end_to_end(spark, tables, tmp_path):
    from gondola.plans.backtest import Settings, run
    from gondola.sources import files

    s = Settings(q.TRAIN_END, q.TEST_START, q.TEST_END, (112,), folds=2, most_fit=150, zeros=30, least_weight=0.85, trees={"maxIter": 1, "maxDepth": 2})
    made = run(tables, s, str(tmp_path))
    assert made["cross_validation"]["best_lookback"] == 112 and len(made["cross_validation"]["scores"]) == 2
    submission = files.read_submission(spark, f"{tmp_path}/submission")
    assert submission.count() == tables.test.count() == made["forecast"]["rows"]
    assert submission.filter("unit_sales is null or unit_sales < 0").isEmpty() and submission.select("id").distinct().count() == submission.count()
    with pytest.raises(ValueError):
        Settings(q.TEST_END, q.TEST_START, q.TEST_END)
