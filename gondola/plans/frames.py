"""Feature frames of folds and of the test horizon."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import add_calendar, item_weight, mean_of, promo_flag
from gondola.operators.aggregates import STATS, derived, history_grain, key_counts, part_of, prior_tables, recent_tables, sums, with_stats
from gondola.operators.external import FLAGS, dense_oil, with_common
from gondola.operators.fallback import HIERARCHICAL, RECENT, cascade, fallback, grain_of, lookup_tables, overall_of, roll_up
from gondola.operators.panel import rank_within, recent_biased_sample, zero_filled, zero_sample
from gondola.operators.routing import SERIES, eligible_series, history_needed, series_index
from gondola.operators.scoring import weighted_rmsle
from gondola.sources.files import cut_lineage
from gondola.sources.retail import Retail

DAY = dt.timedelta(1)
HORIZON = 16

CODES = ("store_code", "item_code", "family_code", "class", "perishable", "city_code", "state_code", "type_code", "cluster")
KNOWN = ("onpromotion", "weekday", "day", "month", "weekofyear", "is_month_end", "is_payday")
#: The features of the boosted models, without the ten derived ones.
FEATURES = (*CODES, *KNOWN, "dcoilwtico", *FLAGS, *STATS)
DERIVED = (
    "is_weekend", "promo_family_gap", "promo_store_gap", "recent_trend_28_56", "recent_ratio_28_56", "item_vs_family_ratio",
    "family_store_vs_store_ratio", "item_recent_delta", "store_recent_delta", "history_strength",
)
LEGACY_STATS = ("si_recent28", "siw_mean", "fsw_mean", "fw_mean", "item_mean", "store_mean")
LEGACY = (*CODES, *KNOWN, "transactions", "dcoilwtico", *FLAGS, *LEGACY_STATS)
#: What a sequence model takes as categories.
CATEGORIES = (*CODES, *KNOWN, *FLAGS)
KEYS = ("date", "store_nbr", "item_nbr")


def with_grain_columns(rows: DataFrame, tables: Retail) -> DataFrame:
    """rows with what the grain of statistics needs besides their keys."""
    return add_calendar(rows).join(tables.item_meta, "item_nbr", "left")


def history(tables: Retail, fit_start: dt.date, fit_end: dt.date, cutoff: dt.date) -> DataFrame:
    """The grain of a fold's statistics, computed once: it is as large as the pairs, not the facts, and 23 tables are
    rolled up from it."""
    return cut_lineage(history_grain(with_grain_columns(tables.clean, tables), fit_start, fit_end, cutoff))


def observed_fold(tables: Retail, valid_start: dt.date, lookback: int, transactions: bool = False) -> DataFrame:
    """Observed rows of a fold with all features, told apart by ``part`` ('fit', 'valid'). Transactions are
    filled with the median of the fit part."""
    fit_start, valid_end = valid_start - lookback * DAY, valid_start + (HORIZON - 1) * DAY
    rows = with_common(tables.rows_between(fit_start, valid_end), tables, fit_start, valid_end, transactions)
    rows = rows.withColumn("part", F.when(F.col("date") < F.lit(valid_start), "fit").otherwise("valid"))
    fit = rows.filter("part = 'fit'")
    grain = history(tables, fit_start, valid_start - DAY, valid_start)
    return with_stats(rows, recent_tables(grain), prior_tables(grain), key_counts(grain), fit, ("transactions",) if transactions else ())


def panel_fold(
    tables: Retail, valid_start: dt.date, lookback: int, most_fit: int | None = None, zeros: int = 0, zero_days: int = 28
) -> tuple[DataFrame, DataFrame]:
    """The fit and the horizon part of a fold over the full panel.

    Statistics come from all fit rows, the fit part may then be a sample, with drawn implicit zeros added. Each part
    is joined with features over its own days. The horizon has every pair on every
    day, the fallback forecast and the flag of items never sold.
    """
    fit_start, valid_end, last = valid_start - lookback * DAY, valid_start + (HORIZON - 1) * DAY, valid_start - DAY
    observed = tables.rows_between(fit_start, last)
    panel = zero_filled(tables.universe, tables.rows_between(valid_start, valid_end), valid_start, valid_end)
    horizon = with_common(panel, tables, valid_start, valid_end)
    grain = history(tables, fit_start, last, valid_start)
    recent, prior, counts = recent_tables(grain), prior_tables(grain), key_counts(grain)
    stats = lambda rows: derived(with_stats(rows, recent, prior, counts))
    fit = stats(with_common(recent_biased_sample(observed, most_fit), tables, fit_start, last))
    if zeros > 0:
        start = max(fit_start, valid_start - zero_days * DAY)
        drawn = zero_sample(tables.universe, observed, start, last, zeros)
        fit = fit.unionByName(stats(with_common(drawn, tables, start, last)))
    return fit, fallback(stats(horizon), part_of(grain)).withColumn("unseen_item_flag", (F.col("item_all_count_log") == 0).cast("int"))


def final_frames(
    tables: Retail, train_end: dt.date, test_start: dt.date, test_end: dt.date, lookback: int, most_fit: int | None = None, zeros: int = 0, zero_days: int = 28
) -> tuple[DataFrame, DataFrame]:
    """The fit part up to train_end, and the test rows with all features, the fallback forecast and the flag of items
    never sold.

    The fit window is [train_end - lookback, train_end], a day more than in folds, and so is that of the zeros
    [train_end - zero_days + 1, train_end]; history ends before test_start.
    """
    fit_start = train_end - lookback * DAY
    observed = tables.rows_between(fit_start, train_end)
    grain = history(tables, fit_start, train_end, test_start)
    recent, prior, counts = recent_tables(grain), prior_tables(grain), key_counts(grain)
    stats = lambda rows, start, end: derived(with_stats(with_common(rows, tables, start, end), recent, prior, counts))
    fit = stats(recent_biased_sample(observed, most_fit), fit_start, train_end)
    if zeros > 0:
        start = max(fit_start, train_end - (zero_days - 1) * DAY)
        fit = fit.unionByName(stats(zero_sample(tables.universe, observed, start, train_end, zeros), start, train_end))
    rows = tables.test.select("id", *KEYS, F.coalesce(F.col("onpromotion").cast("int"), F.lit(0)).alias("onpromotion"))
    test = fallback(stats(rows, test_start, test_end), part_of(grain))
    return fit, test.withColumn("unseen_item_flag", (F.col("item_all_count_log") == 0).cast("int"))


def series_rows(rows: DataFrame, tables: Retail, start: dt.date, end: dt.date, fit_start: dt.date) -> DataFrame:
    """rows of the days start to end with exogenous features, target_log, time_idx counted from fit_start, and series_id;
    gaps are 0."""
    out = with_common(rows.fillna({"target": 0.0, "onpromotion": 0}), tables, start, end)
    out = out.fillna(0.0, ["dcoilwtico"])  # dense: a price on every day or on none
    return series_index(out.fillna(0, list(CODES)).withColumn("target_log", F.log(F.col("target") + 1.0)), fit_start)


def with_eligibility(fit: DataFrame, horizon: DataFrame, seen: DataFrame, least: int, most_series: int | None, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fit rows of eligible series, the horizon with fallback and flags, series with their flags)."""
    series = eligible_series(fit, horizon, seen, least, most_series, seed)
    horizon = fallback(horizon, grain_of(fit)).join(series.drop("enough_history_flag"), SERIES, "left")
    return fit.join(series.filter("is_tft_eligible = 1"), ["store_nbr", "item_nbr"], "left_semi"), horizon, series


def series_fold(
    tables: Retail, valid_start: dt.date, lookback: int, encoder: int = 56, least_points: int = 28, most_series: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fit rows of eligible series, the horizon panel, series with their flags) for a sequence model.

    Only pairs of the test universe take part, also in the fallback's tables; only exogenous features are attached.
    """
    fit_start, valid_end, last = valid_start - lookback * DAY, valid_start + (HORIZON - 1) * DAY, valid_start - DAY
    observed = tables.rows_between(fit_start, valid_end).join(tables.universe, ["store_nbr", "item_nbr"], "left_semi")
    fit = series_rows(observed.filter(F.col("date") < F.lit(valid_start)), tables, fit_start, last, fit_start)
    panel = zero_filled(tables.universe, observed.filter(F.col("date") >= F.lit(valid_start)), valid_start, valid_end)
    horizon = series_rows(panel, tables, valid_start, valid_end, fit_start)
    seen = tables.clean.filter(F.col("date") < F.lit(valid_start))
    return with_eligibility(fit, horizon, seen, history_needed(least_points, encoder), most_series, seed)


def series_final(
    tables: Retail, train_end: dt.date, test_start: dt.date, test_end: dt.date, lookback: int, encoder: int = 56, least_points: int = 28, most_series: int | None = None, seed: int = 42
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The same as series_fold for the test rows, which keep their id and have target 0.

    The fit window is [train_end - lookback, train_end], a day more than in folds; items count as seen before test_start.
    """
    fit_start = train_end - lookback * DAY
    observed = tables.rows_between(fit_start, train_end).join(tables.universe, ["store_nbr", "item_nbr"], "left_semi")
    fit = series_rows(observed, tables, fit_start, train_end, fit_start)
    rows = tables.test.select("id", *KEYS, promo_flag(F.col("onpromotion")).alias("onpromotion"), F.lit(0.0).alias("target"))
    test = series_rows(rows, tables, test_start, test_end, fit_start)
    seen = tables.clean.filter(F.col("date") < F.lit(test_start))
    return with_eligibility(fit, test, seen, history_needed(least_points, encoder), most_series, seed)


def legacy_fold(tables: Retail, valid_start: dt.date, lookback: int) -> DataFrame:
    """Observed rows with the older, smaller feature set, from the start of the fit window on.

    Codes of stores and items number those that occur in these rows; the recent window ends at valid_start;
    transactions are filled with the median of their whole table, oil with that of its dense series.
    """
    fit_start, valid_end = valid_start - lookback * DAY, valid_start + (HORIZON - 1) * DAY
    observed = tables.rows_between(fit_start, valid_end)
    span = observed.agg(F.min("date"), F.max("date")).first()
    start, end = span[0] or fit_start, span[1] or valid_end
    rows = with_common(observed, tables, start, end, True).drop("store_code", "item_code")
    for key, code in (("store_nbr", "store_code"), ("item_nbr", "item_code")):
        rows = rows.join(observed.select(key).distinct().withColumn(code, (rank_within(key) - 1).cast("int")), key, "left")
    rows = rows.withColumn("part", F.when(F.col("date") < F.lit(valid_start), "fit").otherwise("valid"))
    fit = rows.filter("part = 'fit'")
    grain = fit.groupBy("store_nbr", "item_nbr", "family_code", "weekday").agg(
        F.sum("target").alias("sum"), F.count(F.lit(1)).alias("count"), F.count("target").alias("known"),
        *[f(F.when(F.col("date") >= F.lit(valid_start - 28 * DAY), F.col("target"))).alias(n) for f, n in ((F.sum, "sum28"), (F.count, "known28"))],
    )
    mean = lambda keys, name: roll_up(grain, keys).select(*keys, (F.col("sum") / F.col("known")).alias(name))
    recent = grain.groupBy("store_nbr", "item_nbr").agg((F.sum("sum28") / F.nullif(F.sum("known28"), F.lit(0))).alias("si_recent28"))
    for keys, table in (
        (["store_nbr", "item_nbr"], recent),
        (["store_nbr", "item_nbr", "weekday"], mean(["store_nbr", "item_nbr", "weekday"], "siw_mean")),
        (["family_code", "store_nbr", "weekday"], mean(["family_code", "store_nbr", "weekday"], "fsw_mean")),
        (["family_code", "weekday"], mean(["family_code", "weekday"], "fw_mean")),
        (["item_nbr"], mean(["item_nbr"], "item_mean")),
        (["store_nbr"], mean(["store_nbr"], "store_mean")),
    ):
        rows = rows.join(table, keys, "left")
    fills = tables.transactions.agg(F.median("transactions").alias("_t")).crossJoin(dense_oil(tables.oil, start, end).agg(F.median("dcoilwtico").alias("_o")))
    rows = rows.crossJoin(F.broadcast(fills))
    return rows.withColumns({"transactions": F.coalesce(F.col("transactions").cast("double"), "_t"), "dcoilwtico": F.coalesce("dcoilwtico", "_o")}).fillna(0.0, list(LEGACY_STATS)).drop("_t", "_o")


# -- lookup baselines -------------------------------------------------------------------------------------------------


def baseline_rows(tables: Retail, valid_start: dt.date, lookback: int) -> tuple[DataFrame, DataFrame]:
    """(fit rows, observed horizon rows with actual and weight) of the lookup baselines."""
    rows = add_calendar(tables.rows_between(valid_start - lookback * DAY, valid_start + (HORIZON - 1) * DAY)).join(tables.item_meta, "item_nbr", "left")
    valid = rows.filter(F.col("date") >= F.lit(valid_start)).withColumn("weight", item_weight(F.col("perishable"))).withColumnRenamed("target", "actual")
    return rows.filter(F.col("date") < F.lit(valid_start)), valid


def baseline_tables(fit: DataFrame, valid_start: dt.date) -> tuple[list, list, DataFrame, dict[str, int]]:
    """(tables of the recent-mean baseline, of the hierarchical baseline, the overall sum and count, values of the keys)."""
    grain = grain_of(fit)
    recent = sums(fit.filter(F.col("date") >= F.lit(valid_start - 28 * DAY)), ["store_nbr", "item_nbr"])
    weekday = lookup_tables(grain, RECENT[2:])
    return lookup_tables(recent, RECENT[:2]) + weekday, lookup_tables(grain, HIERARCHICAL), overall_of(weekday[0][1]), key_counts(grain)


def baselines(tables: Retail, valid_start: dt.date, lookback: int = 112) -> tuple[DataFrame, DataFrame]:
    """The horizon with the forecasts (prediction, source) of the recent-mean and of the hierarchical baseline."""
    fit, valid = baseline_rows(tables, valid_start, lookback)
    recent, hierarchical, overall, counts = baseline_tables(fit, valid_start)
    return cascade(valid, recent, overall, counts, "prediction", "source"), cascade(valid, hierarchical, overall, counts, "prediction", "source")


def holdout_rows(tables: Retail, valid_start: dt.date, lookback: int, forecast: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """The observed horizon with the forecasts of three predictors: both lookup baselines, and model_prediction, which
    ``forecast`` (fit rows, horizon rows, both with all features) adds to the horizon."""
    rows = observed_fold(tables, valid_start, lookback)
    recent, hierarchical, overall, counts = baseline_tables(baseline_rows(tables, valid_start, lookback)[0], valid_start)
    out = forecast(rows.filter("part = 'fit'"), rows.filter("part = 'valid'"))
    out = out.withColumnRenamed("target", "actual").withColumn("weight", item_weight(F.col("perishable")))
    out = cascade(out, recent, overall, counts, "recent_mean_prediction", "recent_mean_source")
    return cascade(out, hierarchical, overall, counts, "hierarchical_prediction", "hierarchical_source")


def fold_scores(tables: Retail, settings: DataFrame) -> DataFrame:
    """The fallback's score in every fold and lookback of settings (fold, lookback, fit_start, valid_start, valid_end).

    All of them are one job: facts meet the settings' dates in a broadcast range join (settings are a few driver-made
    rows), and fold and lookback are keys of every aggregate and lookup.
    """
    rows = add_calendar(tables.clean).join(tables.item_meta, "item_nbr", "left")
    few = F.broadcast(settings)
    fit = rows.join(few, (F.col("date") >= F.col("fit_start")) & (F.col("date") < F.col("valid_start")))
    valid = rows.join(few, (F.col("date") >= F.col("valid_start")) & (F.col("date") <= F.col("valid_end")))
    scored = fallback(valid, grain_of(fit, "fold", "lookback"), "fold", "lookback").withColumn("weight", item_weight(F.col("perishable")))
    return scored.groupBy("fold", "lookback").agg(
        F.count(F.lit(1)).alias("rows"),
        weighted_rmsle(F.col("target"), F.col("fallback_prediction"), F.col("weight")).alias("weighted_rmsle"),
        mean_of(F.col("target")).alias("mean_actual"),
    )
