"""Named queries of the panel engine over the mapped test tables.

Sums of sales are exact (whole numbers), so means are not rounded; logarithms, roots, deviations and correlations are
rounded to 6 decimals, as engines differ in their last bits.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.columns import add_calendar, item_weight, mean_of, ratio
from gondola.operators import aggregates, eda, external, fallback, panel, routing, scoring
from gondola.plans import frames, model
from gondola.sources.retail import TEST_END, TRAIN_END, load_kept

DAY = dt.timedelta(1)
TEST_START = TRAIN_END + DAY
VALID_START, VALID_END = TRAIN_END - 15 * DAY, TRAIN_END
LOOKBACK = 112
FIT_START, FIT_END = VALID_START - LOOKBACK * DAY, VALID_START - DAY
FRAME_KEYS = ("date", "store_nbr", "item_nbr")
ROUNDED = ("siw_count_log", "si_all_count_log", "item_all_count_log", "family_store_all_count_log", "history_strength", "target_log")
LOCALES = ("Local", "National", "Other", "Regional")
LOOKBACKS = (112, 224)

FOUND: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable) -> Callable:
    """Register f(tables) under its name."""
    FOUND[f.__name__] = lambda spark, sf_dir: f(load_kept(spark, sf_dir))
    return f


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def shown(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, those of ROUNDED rounded."""
    return df.select(*[F.round(c, 6).alias(c) if c in ROUNDED else F.col(c) for c in columns])


# -- exploratory roll-ups ---------------------------------------------------------------------------------------------


@query
def eda_overview(t):
    return eda.overview(t.train)


@query
def eda_daily_sales(t):
    return eda.daily_sales(t.train)


@query
def eda_family_sales(t):
    return eda.family_sales(t)


@query
def eda_store_sales(t):
    return eda.store_sales(t)


@query
def eda_promotion_summary(t):
    return eda.promotion_summary(t.train)


@query
def top_families(t):
    return eda.family_sales(t).orderBy(F.desc("unit_sales"), "family").limit(12).select("family", "unit_sales", (F.col("unit_sales") / 1_000_000).alias("unit_sales_mn"))


@query
def top_stores(t):
    return eda.store_sales(t).orderBy(F.desc("unit_sales"), "store_nbr").limit(10).select("store_nbr", "city", "state", "type", "cluster", "unit_sales", "sales_share")


@query
def missing_share(t):
    named = [("stores", t.stores, None), ("items", t.items, None), ("transactions", t.transactions, "date"), ("oil", t.oil, "date"), ("holidays_events", t.holidays, "date"), ("test", t.test.drop("id"), "date")]
    out = None
    for part in named:
        table = eda.missing_share(*part)
        out = table if out is None else out.union(table)
    return rounded(out, "missing_share")


@query
def test_coverage(t):
    return eda.test_coverage(t.train, t.test)


@query
def rolling_28d(t):
    return eda.rolling_mean(eda.daily_sales(t.train), "unit_sales").select("date", "unit_sales", "rolling_28d")


def external_daily(t) -> DataFrame:
    span = t.train.agg(F.min("date"), F.max("date")).first()
    return eda.external_frame(t, span[0] or TRAIN_END, span[1] or TRAIN_END)


@query
def daily_external_frame(t):
    return external_daily(t).select("date", "unit_sales", "records", "rolling_28d", "weekday", "month", "is_payday", "transactions", "dcoilwtico")


@query
def weekday_profile(t):
    return eda.profile(eda.daily_sales(t.train).withColumn("weekday", F.date_format("date", "EEEE")), "weekday")


@query
def payday_profile(t):
    daily = eda.daily_sales(t.train).withColumn("bucket", F.when(eda.payday(F.col("date")), "15th or month-end").otherwise("regular day"))
    return eda.profile(daily, "bucket")


@query
def driver_correlation(t):
    return rounded(eda.correlations(external_daily(t), "unit_sales", "transactions", "dcoilwtico"), "correlation")


@query
def zscore_daily(t):
    return rounded(eda.z_scores(external_daily(t), "unit_sales", "dcoilwtico"), "z_unit_sales", "z_dcoilwtico")


@query
def holiday_pivot(t):
    return eda.holiday_pivot(t.holidays, LOCALES)


@query
def transferred_holidays(t):
    return t.holidays.filter("transferred").orderBy("date", "type", "locale_name").limit(10)


@query
def store_type_counts(t):
    return t.stores.groupBy("type").agg(F.count(F.lit(1)).alias("stores"))


@query
def family_item_counts(t):
    return t.items.groupBy("family").agg(F.count(F.lit(1)).alias("item_count")).orderBy(F.desc("item_count"), "family").limit(12)


@query
def perishable_share(t):
    return t.items.agg(ratio(F.sum(1 - F.col("perishable")), F.count(F.lit(1))).alias("non_perishable"), ratio(F.sum("perishable"), F.count(F.lit(1))).alias("perishable"))


# -- calendar, dimensions, external drivers ---------------------------------------------------------------------------


@query
def calendar_features(t):
    return add_calendar(t.train.select("date").distinct())


@query
def metadata_codes(t):
    store = t.store_meta.select(F.lit("store").alias("entity"), F.col("store_nbr").alias("key"), "store_code", "city_code", "state_code", "type_code", F.lit(None).cast("int").alias("item_code"), F.lit(None).cast("int").alias("family_code"))
    none = [F.lit(None).cast("int").alias(c) for c in ("store_code", "city_code", "state_code", "type_code")]
    return store.union(t.item_meta.select(F.lit("item").alias("entity"), F.col("item_nbr").alias("key"), *none, "item_code", "family_code"))


@query
def dim_enrich(t):
    rows = external.with_dims(t.rows_between(FIT_START, VALID_END), t).withColumn("weight", item_weight(F.col("perishable")))
    return rows.select(*FRAME_KEYS, "target", "onpromotion", "family", "weight", *frames.CODES)


@query
def transactions_join(t):
    return external.with_transactions(t.rows_between(VALID_START, VALID_END), t).select(*FRAME_KEYS, "target", "transactions")


@query
def oil_dense(t):
    return external.dense_oil(t.oil, dt.date(2001, 6, 10), VALID_END)


@query
def oil_join(t):
    return t.rows_between(VALID_START, VALID_END).join(external.dense_oil(t.oil, VALID_START, VALID_END), "date", "left").select(*FRAME_KEYS, "target", "dcoilwtico")


@query
def holiday_flags(t):
    return external.holiday_flags(t.stores, t.holidays, dt.date(2001, 2, 1), TEST_END)


# -- panels and samples -----------------------------------------------------------------------------------------------


@query
def pair_universe(t):
    return t.universe


@query
def dense_panel(t):
    return panel.dense_panel(t.universe, VALID_START, VALID_END)


@query
def zero_filled_panel(t):
    return panel.zero_filled(t.universe, t.rows_between(VALID_START, VALID_END), VALID_START, VALID_END)


@query
def implicit_zeros(t):
    return panel.implicit_zeros(t.universe, t.rows_between(VALID_START - 28 * DAY, FIT_END), VALID_START - 28 * DAY, FIT_END)


@query
def zero_row_sample(t):
    return panel.zero_sample(t.universe, t.rows_between(FIT_START, FIT_END), VALID_START - 28 * DAY, FIT_END, 200)


@query
def recent_biased_sample(t):
    return panel.recent_biased_sample(t.rows_between(FIT_START, FIT_END), 1500)


@query
def train_plus_zero_rows(t):
    fit = t.rows_between(FIT_START, FIT_END)
    return fit.unionByName(panel.zero_sample(t.universe, fit, VALID_START - 28 * DAY, FIT_END, 200))


@query
def pair_universe_semi(t):
    return t.rows_between(FIT_START, VALID_END).join(t.universe, ["store_nbr", "item_nbr"], "left_semi")


# -- lookup baselines and fallback ------------------------------------------------------------------------------------

BASELINE = ("date", "store_nbr", "item_nbr", "family", "weekday", "onpromotion", "actual", "weight")


def long_tables(tables: list) -> DataFrame:
    """Lookup tables one under the other, with the keys of each as text."""
    out = None
    for level, table in tables:
        key = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in level.keys])
        part = table.select(F.lit(level.source).alias("source"), key.alias("key"), "sum", "count", ratio(F.col("sum"), F.col("known")).alias("mean"))
        out = part if out is None else out.union(part)
    return out


@query
def baseline_lookup_tables(t):
    recent, hierarchical, _, _ = frames.baseline_tables(frames.baseline_rows(t, VALID_START, LOOKBACK)[0], VALID_START)
    return long_tables(recent[:2] + hierarchical)


@query
def baseline_valid_frame(t):
    return frames.baseline_rows(t, VALID_START, LOOKBACK)[1].select(*BASELINE)


@query
def recent_mean_baseline(t):
    return frames.baselines(t, VALID_START)[0].select(*BASELINE, "prediction", "source")


@query
def hierarchical_baseline(t):
    return frames.baselines(t, VALID_START)[1].select(*BASELINE, "prediction", "source")


@query
def baseline_scores(t):
    recent, hierarchical = frames.baselines(t, VALID_START)
    both = recent.withColumn("baseline", F.lit("recent_mean_28d")).unionByName(hierarchical.withColumn("baseline", F.lit("hierarchical_weekday_promo")))
    return rounded(scoring.score_by(both, "baseline"), "weighted_rmsle", "mean_prediction", "mean_actual")


@query
def weighted_rmsle(t):
    rows = frames.baselines(t, VALID_START)[1]
    return rounded(rows.agg(scoring.weighted_rmsle(F.col("actual"), F.col("prediction"), F.col("weight")).alias("weighted_rmsle")), "weighted_rmsle")


@query
def baseline_daily_compare(t):
    recent, hierarchical = frames.baselines(t, VALID_START)
    left = hierarchical.groupBy("date").agg(F.sum("actual").alias("actual"), F.sum("prediction").alias("hierarchical_prediction"))
    return rounded(left.join(recent.groupBy("date").agg(F.sum("prediction").alias("recent_mean_prediction")), "date", "left"), "hierarchical_prediction", "recent_mean_prediction")


@query
def fallback_source_mix(t):
    counted = frames.baselines(t, VALID_START)[1].groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("source", ratio(F.col("n"), F.sum("n").over(eda.everything())).alias("row_share"))


def fit_with_dims(t) -> DataFrame:
    return add_calendar(t.rows_between(FIT_START, FIT_END)).join(t.item_meta, "item_nbr", "left")


@query
def fallback_tables(t):
    return long_tables(fallback.lookup_tables(fallback.grain_of(fit_with_dims(t)), fallback.FALLBACK))


@query
def hierarchical_fallback(t):
    valid = add_calendar(t.rows_between(VALID_START, VALID_END)).join(t.item_meta, "item_nbr", "left")
    return fallback.fallback(valid, fallback.grain_of(fit_with_dims(t))).select(*FRAME_KEYS, "target", "fallback_prediction", "fallback_source")


# -- statistics and feature frames ------------------------------------------------------------------------------------


def latest(t) -> DataFrame:
    return frames.history(t, FIT_START, FIT_END, VALID_START)


@query
def prior_aggregates(t):
    out = None
    for keys, table in aggregates.prior_tables(latest(t)).items():
        mean, log = [c for c in table.columns if c not in keys]
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        part = table.select(F.lit(mean.removesuffix("_mean")).alias("table_name"), key.alias("key"), F.col(mean).alias("mean"), F.round(log, 6).alias("count_log"))
        out = part if out is None else out.union(part)
    return out


@query
def recent_window_stats(t):
    out = None
    for keys, table in aggregates.recent_tables(latest(t)):
        key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        for name in [c for c in table.columns if c not in keys]:
            part = table.select(F.lit(name).alias("statistic"), key.alias("key"), F.round(name, 6).alias("value") if name in ROUNDED else F.col(name).alias("value"))
            out = part if out is None else out.union(part)
    return out.filter("value is not null")


@query
def feature_matrix(t):
    return shown(frames.observed_fold(t, VALID_START, LOOKBACK), *FRAME_KEYS, "part", "target", *frames.FEATURES)


@query
def fold_features_observed(t):
    _, start, _ = scoring.rolling_folds(TRAIN_END)[2]
    return shown(frames.observed_fold(t, start, LOOKBACK, True).filter("part = 'valid'"), *FRAME_KEYS, "target", *frames.FEATURES, "transactions")


@query
def fold_features_panel(t):
    _, horizon = frames.panel_fold(t, VALID_START, LOOKBACK)
    return shown(horizon, *FRAME_KEYS, "target", *frames.FEATURES, "fallback_prediction", "fallback_source", "unseen_item_flag")


@query
def derived_features(t):
    return shown(frames.panel_fold(t, VALID_START, LOOKBACK)[1], *FRAME_KEYS, *frames.DERIVED)


@query
def sampled_fit_features(t):
    fit, _ = frames.panel_fold(t, VALID_START, LOOKBACK, most_fit=1500, zeros=200)
    return shown(fit, *FRAME_KEYS, "target", *frames.FEATURES)


@query
def test_features(t):
    out = frames.final_frames(t, TRAIN_END, TEST_START, TEST_END, LOOKBACK)[1]
    return shown(out, "id", *FRAME_KEYS, *frames.FEATURES, *frames.DERIVED, "fallback_prediction", "fallback_source", "unseen_item_flag")


@query
def legacy_feature_frame(t):
    return shown(frames.legacy_fold(t, VALID_START, LOOKBACK), *FRAME_KEYS, "part", "target", *frames.LEGACY)


# -- folds, scores, routing -------------------------------------------------------------------------------------------

SERIES_FLAGS = ("history_points", "is_tft_eligible", "unseen_item_flag", "sampled_out_flag")
LEAST_POINTS, ENCODER, MOST_SERIES = 3, 56, 40


def series_fold(t, most_series=None):
    return frames.series_fold(t, VALID_START, LOOKBACK, ENCODER, LEAST_POINTS, most_series)


@query
def tft_fold_frame(t):
    horizon = series_fold(t)[1]
    return shown(horizon, *FRAME_KEYS, "target", "target_log", "time_idx", "series_id", *frames.CODES, *frames.KNOWN, "dcoilwtico", *external.FLAGS, "fallback_prediction", "fallback_source", *SERIES_FLAGS)


@query
def tft_fit_frame(t):
    return shown(series_fold(t)[0], *FRAME_KEYS, "target", "target_log", "time_idx", "series_id")


@query
def series_index(t):
    return routing.series_index(t.rows_between(FIT_START, VALID_END), FIT_START).select(*FRAME_KEYS, "time_idx", "series_id")


@query
def series_eligibility(t):
    return series_fold(t)[2]


@query
def series_sample(t):
    """Eligibility where a model takes at most MOST_SERIES series, which are drawn."""
    return series_fold(t, MOST_SERIES)[2]


@query
def eligibility_summary(t):
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return series_fold(t)[2].agg(
        F.count(F.lit(1)).alias("total_pairs"), count(F.col("is_tft_eligible") == 1).alias("eligible_pairs"), count(F.col("is_tft_eligible") == 0).alias("fallback_pairs"),
        count(F.col("unseen_item_flag") == 1).alias("unseen_item_pairs"), count(F.col("enough_history_flag") == 0).alias("insufficient_history_pairs"),
        count(F.col("sampled_out_flag") == 1).alias("sampled_out_pairs"),
    )


def routed(t) -> DataFrame:
    """The horizon of the sequence model with the mean of the last 28 days standing in for it: 0 for an eligible
    series without one, as a model's missing output becomes 0, and nothing for other series."""
    horizon = series_fold(t)[1]
    recent = aggregates.sums(t.rows_between(VALID_START - 28 * DAY, FIT_END), ["store_nbr", "item_nbr"]).select("store_nbr", "item_nbr", (F.col("sum") / F.col("known")).alias("_mean"))
    model_column = F.when(F.col("is_tft_eligible") == 1, F.coalesce("_mean", F.lit(0.0)))
    return routing.route(horizon.join(recent, ["store_nbr", "item_nbr"], "left").withColumn("tft_raw_prediction", model_column), "tft_raw_prediction")


@query
def routed_prediction(t):
    return routed(t).select(*FRAME_KEYS, "tft_raw_prediction", "fallback_prediction", "fallback_source", "final_prediction", "used_fallback")


@query
def routing_shares(t):
    return routed(t).groupBy("date").agg(*[mean_of(F.col(c)).alias(n) for c, n in (("used_fallback", "fallback_share"), ("is_tft_eligible", "eligible_share"), ("unseen_item_flag", "unseen_item_share"))])


@query
def daily_validation(t):
    totals = [F.round(F.coalesce(F.sum(c), F.lit(0.0)), 6).alias(c) for c in ("target", "final_prediction", "fallback_prediction", "tft_raw_prediction")]
    return routed(t).groupBy("date").agg(*totals)


@query
def blended_prediction(t):
    horizon = frames.panel_fold(t, VALID_START, LOOKBACK)[1]
    weight = routing.blend_weight(F.col("item_all_count_log"), 3.0, 0.85, 0.2)
    out = horizon.withColumn("model_weight", weight).withColumn("blended", routing.blend(F.col("si_recent28"), F.col("fallback_prediction"), F.col("model_weight")))
    return rounded(out, "model_weight", "blended").select(*FRAME_KEYS, "model_weight", "blended")


@query
def unseen_summary(t):
    out = frames.final_frames(t, TRAIN_END, TEST_START, TEST_END, LOOKBACK)[1]
    return rounded(out.groupBy("unseen_item_flag").agg(F.count(F.lit(1)).alias("rows"), mean_of(F.col("fallback_prediction")).alias("mean_prediction")), "mean_prediction")


def series_test(t):
    return frames.series_final(t, TRAIN_END, TEST_START, TEST_END, LOOKBACK, ENCODER, LEAST_POINTS)


@query
def tft_test_frame(t):
    """The test rows as a sequence model takes them."""
    horizon = series_test(t)[1]
    return shown(horizon, "id", *FRAME_KEYS, "target_log", "time_idx", "series_id", *frames.CODES, *frames.KNOWN, "dcoilwtico", *external.FLAGS, "fallback_prediction", "fallback_source", *SERIES_FLAGS)


@query
def fallback_only_forecast(t):
    """The test rows' forecasts where there is no model."""
    return routing.route(series_test(t)[1], None).select("id", *FRAME_KEYS, "fallback_source", "final_prediction", "used_fallback")


@query
def category_vocabulary(t):
    fit, horizon, _ = series_fold(t)
    return routing.vocabulary((fit, horizon), frames.CATEGORIES)


HOLDOUT = {"recent_mean_28d": "recent_mean_prediction", "hierarchical_weekday_promo": "hierarchical_prediction", "feature_model": "model_prediction"}


def holdout(t) -> DataFrame:
    """The hold-out with one feature, the mean of a pair's weekday, standing in for a fitted model."""
    return frames.holdout_rows(t, VALID_START, LOOKBACK, lambda fit, valid: valid.withColumn("model_prediction", F.col("siw_mean")))


@query
def holdout_scores(t):
    return rounded(scoring.score_each(holdout(t), HOLDOUT), "weighted_rmsle")


@query
def holdout_daily(t):
    return holdout(t).groupBy("date").agg(F.sum("actual").alias("actual"), *[F.round(F.sum(c), 6).alias(c) for c in HOLDOUT.values()])


@query
def unpivot_horizon(t):
    horizon = series_fold(t)[1].filter("is_tft_eligible = 1")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("time_idx", "fallback_prediction"))), lambda x: x["fallback_prediction"])
    matrix = horizon.groupBy("series_id").agg(F.min("time_idx").alias("first_idx"), steps.alias("steps"))  # 16 steps a series
    return routing.unpivot_horizon(matrix, "steps", "first_idx", "prediction")


@query
def rolling_folds(t):
    return scoring.fold_table(t.train.sparkSession, scoring.rolling_folds(TRAIN_END))


def settings(t) -> DataFrame:
    rows = [(f, n, s - n * DAY, s, e) for f, s, e in scoring.rolling_folds(TRAIN_END) for n in LOOKBACKS]
    return t.train.sparkSession.createDataFrame(rows, "fold string, lookback int, fit_start date, valid_start date, valid_end date")


@query
def cv_scores(t):
    return rounded(frames.fold_scores(t, settings(t)), "weighted_rmsle", "mean_actual")


@query
def cv_summary(t):
    return rounded(scoring.summarise(frames.fold_scores(t, settings(t)), "lookback"), "mean_score", "std_score", "min_score", "max_score")


@query
def submission_consistency(t):
    predictions = frames.final_frames(t, TRAIN_END, TEST_START, TEST_END, LOOKBACK)[1].select("id", F.col("fallback_prediction").alias("final_prediction"), "unseen_item_flag")
    submission = predictions.select("id", F.col("final_prediction").alias("unit_sales"))
    both = submission.groupBy("id").agg(F.count(F.lit(1)).alias("s"), F.sum("unit_sales").alias("us")).join(predictions.groupBy("id").agg(F.count(F.lit(1)).alias("p"), F.sum("final_prediction").alias("fp")), "id", "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return both.agg(
        n("s").alias("submission_rows"), n("p").alias("prediction_rows"), (n("s") == n("p")).alias("same_row_count"), n(F.col("s") - 1).alias("submission_duplicate_ids"),
        n(F.col("p") - 1).alias("prediction_duplicate_ids"), n((F.col("s").isNull() | F.col("p").isNull()).cast("int")).alias("id_set_mismatch_count"),
        F.round(ratio(F.sum("us"), n("s")), 6).alias("mean_unit_sales_submission"), F.round(ratio(F.sum("fp"), n("p")), 6).alias("mean_final_prediction"),
    )


@query
def gbt_forecast(t):
    """Boosted trees on the panel fold, fitted on 20,000 drawn rows and 2,000 zero rows; fitted trees have no SQL."""
    fit, horizon = frames.panel_fold(t, VALID_START, LOOKBACK, most_fit=20_000, zeros=2_000)
    fitted = model.fit_trees(fit, maxIter=5, maxDepth=4)
    return model.predict(fitted, horizon).select(*FRAME_KEYS, "target", "fallback_prediction", "model_prediction")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    from gondola.oracle import ORACLES

    return dict(ORACLES)
