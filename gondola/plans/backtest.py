"""End to end: rolling back-tests of the model, the final forecast, and the command line."""

from __future__ import annotations

import argparse
import datetime as dt
from collections import defaultdict
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.columns import item_weight
from gondola.operators.routing import blend, blend_weight, route
from gondola.operators.panel import recent_biased_sample
from gondola.operators.scoring import rolling_folds, score_each, summarise, valid_start_of, weighted_rmsle
from gondola.plans import frames, model
from gondola.sources import files
from gondola.sources.retail import Retail, load, read_csv_tables


@dataclass(frozen=True)
class Settings:
    """What a run depends on; out-of-range values are refused."""

    train_end: dt.date
    test_start: dt.date
    test_end: dt.date
    lookbacks: tuple[int, ...] = (112, 224)
    folds: int = 4
    step: int = 28
    most_fit: int | None = None
    zeros: int = 0
    history_scale: float = 3.0
    least_weight: float = 1.0
    unseen_weight: float = 1.0
    trees: dict = field(default_factory=dict)
    trials: int = 0
    valid_start: str | None = None

    def __post_init__(self) -> None:
        if not self.train_end < self.test_start <= self.test_end:
            raise ValueError("the test days must follow the training days")
        if min((*self.lookbacks, self.folds, self.step), default=0) < 1 or not self.lookbacks:
            raise ValueError("lookbacks, folds and step must be positive")


def blended(rows: DataFrame, history_scale: float, least_weight: float, unseen_weight: float) -> DataFrame:
    """rows with the weight of their model's forecast, and its blend with the fallback's."""
    out = rows.withColumn("model_weight", blend_weight(F.col("item_all_count_log"), history_scale, least_weight, unseen_weight))
    return out.withColumn("final_prediction", blend(F.col("model_prediction"), F.col("fallback_prediction"), F.col("model_weight")))


def with_forecasts(fitted, rows: DataFrame, s: Settings) -> DataFrame:
    """rows with the model's forecast and its blend with the fallback's."""
    return blended(model.predict(fitted, rows), s.history_scale, s.least_weight, s.unseen_weight)


def tuned(tables: Retail, s: Settings, seed: int = 42, choices: dict | None = None) -> tuple[Settings, list[dict]]:
    """The settings with the best trees and blend of ``s.trials`` trials, and the trials.

    They are scored on the fold that s.valid_start begins (the latest by default), with the longest lookback; the
    whole horizon is scored, and its rows also end the boosting early.
    """
    start = valid_start_of(s.valid_start, s.train_end, frames.HORIZON, s.step, s.folds)
    fit, horizon = frames.panel_fold(tables, start, max(s.lookbacks), s.most_fit, s.zeros)
    features = (*frames.FEATURES, *frames.DERIVED)
    (trees, mix), trials = model.random_search(fit, horizon, lambda rows, x: blended(rows, **x), features, s.trials, seed, choices=choices)
    return replace(s, trees=s.trees | trees, **mix), trials


def holdout_experiment(tables: Retail, s: Settings) -> dict:
    """Scores, daily totals and importances of both lookup baselines and the model on the observed rows of one fold."""
    start, fitted = valid_start_of(s.valid_start, s.train_end, frames.HORIZON, s.step, s.folds), []

    def forecast(fit: DataFrame, valid: DataFrame) -> DataFrame:
        fitted.append(model.fit_trees(recent_biased_sample(fit, s.most_fit), **s.trees))
        return model.predict(fitted[0], valid)

    names = {"recent_mean_28d": "recent_mean_prediction", "hierarchical_weekday_promo": "hierarchical_prediction", "feature_model": "model_prediction"}
    rows = files.cut_lineage(frames.holdout_rows(tables, start, max(s.lookbacks), forecast))
    daily = rows.groupBy("date").agg(*[F.sum(c).alias(c) for c in ("actual", *names.values())])
    scores = {r["model"]: r["weighted_rmsle"] for r in score_each(rows, names).collect()}  # three rows
    return {"valid_start": start, "scores": scores, "daily": daily, "rows": rows, "importance": dict(model.importances(fitted[0]))}


def series_forecast(eligible: DataFrame, horizon: DataFrame, forecaster: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """The routed forecasts of a horizon (see frames.series_fold, series_final).

    forecaster: (rows of eligible series, their horizon) -> store, item, date and model_prediction, one row each.
    Without one, or without an eligible series, the fallback serves alone.
    """
    if forecaster is None or eligible.isEmpty():
        return route(horizon, None)
    made = forecaster(eligible, horizon.filter("is_tft_eligible = 1")).select(*frames.KEYS, "model_prediction")
    return route(horizon.join(made, list(frames.KEYS), "left"), "model_prediction")


def fold_experiment(tables: Retail, fold: str, valid_start: dt.date, lookback: int, s: Settings) -> tuple[dict, DataFrame]:
    """The scores of the blend, the model and the fallback on one fold's full panel, and its forecasts."""
    fit, horizon = frames.panel_fold(tables, valid_start, lookback, s.most_fit, s.zeros)
    fitted = model.fit_trees(fit, (*frames.FEATURES, *frames.DERIVED), **s.trees)
    scored = with_forecasts(fitted, horizon, s)
    names = {"weighted_rmsle": "final_prediction", "model_rmsle": "model_prediction", "fallback_rmsle": "fallback_prediction"}
    made = scored.agg(*[weighted_rmsle(F.col("target"), F.col(c), item_weight(F.col("perishable"))).alias(n) for n, c in names.items()]).first()
    row = {"fold": fold, "lookback": lookback, "valid_start": valid_start} | {n: made[n] for n in names}
    return row | {"importance": dict(model.importances(fitted, (*frames.FEATURES, *frames.DERIVED)))}, scored


def cross_validate(tables: Retail, s: Settings) -> dict:
    """Scores of all folds and lookbacks, their summary, the best lookback, and mean importances.

    Folds run one after the other, as each fits a model; the work of each is Spark's.
    """
    rows = [fold_experiment(tables, name, start, n, s)[0] for n in s.lookbacks for name, start, _ in rolling_folds(s.train_end, frames.HORIZON, s.step, s.folds)]
    gains: dict[str, float] = defaultdict(float)
    for r in rows:
        for name, gain in r.pop("importance").items():
            gains[name] += gain / len(rows)
    table = tables.train.sparkSession.createDataFrame(rows, "fold string, lookback int, valid_start date, weighted_rmsle double, model_rmsle double, fallback_rmsle double")
    summary = [r.asDict() for r in summarise(table, "lookback").orderBy(F.expr("mean_score is null"), "mean_score", "lookback").collect()]  # one row a lookback
    return {"scores": rows, "summary": summary, "best_lookback": summary[0]["lookback"], "importance": dict(sorted(gains.items(), key=lambda x: -x[1]))}


def final_forecast(tables: Retail, lookback: int, s: Settings) -> DataFrame:
    """The test rows with the forecasts of a model fitted up to the last training day."""
    fit, test = frames.final_frames(tables, s.train_end, s.test_start, s.test_end, lookback, s.most_fit, s.zeros)
    return with_forecasts(model.fit_trees(fit, (*frames.FEATURES, *frames.DERIVED), **s.trees), test, s)


def run(tables: Retail, s: Settings, out: str) -> dict:
    """Tune if trials are set, back-test, fit with the best lookback, and write submission, forecasts and summary into the
    folder ``out``."""
    spark, trials = tables.train.sparkSession, []
    if s.trials:
        s, trials = tuned(tables, s)
    tested = cross_validate(tables, s)
    forecasts = files.cut_lineage(final_forecast(tables, tested["best_lookback"], s))
    files.write_submission(forecasts, f"{out}/submission")
    forecasts.select("id", *frames.KEYS, "model_prediction", "fallback_prediction", "fallback_source", "final_prediction", "unseen_item_flag").write.mode("overwrite").parquet(f"{out}/forecasts")
    forecasts.groupBy("date").agg(F.sum("final_prediction").alias("final_prediction"), F.sum("fallback_prediction").alias("fallback_prediction")).write.mode("overwrite").csv(f"{out}/daily", header=True)
    totals = forecasts.agg(F.count(F.lit(1)).alias("rows"), F.avg("final_prediction").alias("mean_prediction"), F.sum("unseen_item_flag").alias("unseen_rows")).first().asDict()
    summary = {"settings": asdict(s), "trials": trials, "cross_validation": tested, "forecast": totals}
    files.write_summary(spark, summary, f"{out}/summary")
    return summary


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Back-test the model and forecast the test days.")
    parser.add_argument("data", help="folder with the original CSV files, or with --mapped of the TPC-H-like parquet")
    parser.add_argument("out")
    parser.add_argument("--mapped", action="store_true")
    for name in ("train-end", "test-start", "test-end"):
        parser.add_argument(f"--{name}", type=dt.date.fromisoformat, required=True)
    parser.add_argument("--lookbacks", type=int, nargs="+", default=[112, 224])
    parser.add_argument("--folds", type=int, default=4)
    parser.add_argument("--most-fit", type=int)
    parser.add_argument("--zeros", type=int, default=0)
    parser.add_argument("--trials", type=int, default=0, help="trials of the random search for trees and blend")
    parser.add_argument("--valid-start", type=files.parse_optional, help="first day of the fold that trials are scored on; the latest by default")
    a = parser.parse_args(args)
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if not a.mapped and (missing := files.missing_inputs(spark, a.data)):
        raise SystemExit(f"missing: {', '.join(missing)}")
    tables = load(spark, a.data, a.train_end, a.test_end) if a.mapped else read_csv_tables(spark, a.data)
    run(tables, Settings(a.train_end, a.test_start, a.test_end, tuple(a.lookbacks), a.folds, most_fit=a.most_fit, zeros=a.zeros, trials=a.trials, valid_start=a.valid_start), a.out)


if __name__ == "__main__":
    main()
