"""Small cases, worked out by hand, of the operators."""

import datetime as dt
import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gondola.functions.columns import add_calendar, clip0, item_weight
from gondola.operators import aggregates, eda, external, fallback, panel, routing, scoring
from gondola.sources import files
from gondola.sources.retail import Retail

D = dt.date
CELL = "date date, store_nbr int, item_nbr int, target double, onpromotion int"


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(-2.0,), (0.0,), (3.0,), (None,)], "x double")
    assert [r[0] for r in df.select(clip0(F.col("x"))).collect()] == [0.0, 0.0, 3.0, None]


def test_weighted_rmsle(spark):
    df = spark.createDataFrame([(0.0, 0.0, 1.0), (3.0, 7.0, 1.25)], "y double, p double, w double")
    got = df.agg(scoring.weighted_rmsle(F.col("y"), F.col("p"), F.col("w"))).first()[0]
    assert got == pytest.approx(math.sqrt(1.25 * (math.log(8) - math.log(4)) ** 2 / 2.25))
    assert df.agg(scoring.weighted_rmsle(F.col("y"), F.col("y"), F.col("w"))).first()[0] == 0
    assert df.limit(0).agg(scoring.weighted_rmsle(F.col("y"), F.col("p"), F.col("w"))).first()[0] is None


def test_calendar(spark):
    df = spark.createDataFrame([(D(2016, 2, 29),), (D(2017, 1, 1),), (D(2017, 3, 15),)], "date date")
    got = rows(add_calendar(df).select("date", "weekday", "weekofyear", "is_month_end", "is_payday"))
    assert [r[1:] for r in got] == [(0, 9, 1, 1), (6, 52, 0, 0), (2, 11, 0, 1)]


def test_oil_is_cut_before_it_is_filled(spark):
    oil = spark.createDataFrame([(D(2020, 1, 1), 1.0), (D(2020, 1, 4), 4.0), (D(2020, 1, 6), 6.0), (D(2020, 1, 6), 9.0)], "date date, dcoilwtico double")
    assert [r[1] for r in rows(external.dense_oil(oil, D(2020, 1, 2), D(2020, 1, 7)))] == [4, 4, 4, 4, 6, 6]
    assert [r[1] for r in rows(external.dense_oil(oil, D(2020, 2, 1), D(2020, 2, 2)))] == [None, None]


def test_rolling_mean_counts_rows(spark):
    days = [(D(2020, 1, 1) + dt.timedelta(2 * i), None if i == 1 else float(i)) for i in range(10)]
    got = [r[2] for r in rows(eda.rolling_mean(spark.createDataFrame(days, "date date, unit_sales double"), "unit_sales"))]
    assert got[:7] == [None] * 7 and got[7] == sum([0, 2, 3, 4, 5, 6, 7]) / 7


STORES = [(1, "Quito", "P", "A", 1), (2, "Cuenca", "Q", "B", 1)]
STORE_SCHEMA = "store_nbr int, city string, state string, type string, cluster int"
HOLIDAY = "date date, type string, locale string, locale_name string, transferred boolean"


@pytest.mark.parametrize(
    ("holidays", "wanted"),
    [
        ([(D(2020, 1, 1), "Holiday", "National", "X", True), (D(2020, 1, 2), "Transfer", "National", "X", False)], {(2, 1): (1, 0), (2, 2): (1, 0)}),
        ([(D(2020, 1, 1), "Event", "National", "X", False), (D(2020, 1, 1), "Holiday", "Local", "Quito", False)], {(1, 1): (1, 1), (1, 2): (0, 1)}),
        ([(D(2020, 1, 1), "Holiday", "Other", "Cuenca", False)], {(1, 2): (1, 0)}),
        ([(D(2020, 1, 1), "Holiday", "Regional", "P", None)], {(1, 1): (1, 0)}),
        ([(D(2020, 5, 1), "Holiday", "National", "X", False)], {}),
    ],
)
def test_holidays(spark, holidays, wanted):
    got = external.holiday_flags(spark.createDataFrame(STORES, STORE_SCHEMA), spark.createDataFrame(holidays, HOLIDAY), D(2020, 1, 1), D(2020, 1, 2))
    assert got.count() == 4
    assert {(r["date"].day, r["store_nbr"]): (r["is_holiday"], r["is_event"]) for r in got.collect() if r["is_holiday"] or r["is_event"]} == wanted


def test_codes_follow_names_and_null_is_minus_one(spark):
    stores = spark.createDataFrame([(5, "b", "s", "t", 1), (3, "a", "s", "t", 1), (9, None, "s", "t", 1), (1, "B", "s", "t", 1), (2, "É", "s", "t", 1)], STORE_SCHEMA)
    tables = Retail(None, None, stores, None, None, None, None)
    got = {r["store_nbr"]: (r["city_code"], r["store_code"]) for r in tables.store_meta.collect()}
    assert got == {5: (2, 3), 3: (1, 2), 9: (-1, 4), 1: (0, 0), 2: (3, 1)}


FIT = "store_nbr int, item_nbr int, family_code int, class int, weekday int, onpromotion int, target double"


def forecast(spark, fit, row):
    frame = spark.createDataFrame([row], "store_nbr int, item_nbr int, family_code int, class int, weekday int, onpromotion int")
    return tuple(fallback.fallback(frame, fallback.grain_of(spark.createDataFrame(fit, FIT))).select("fallback_prediction", "fallback_source").first())


def test_fallback_takes_the_first_level_with_enough_rows(spark):
    fit = [(1, 1, 1, 1, 0, 1, 9.0), (1, 1, 1, 1, 0, 0, 3.0)]
    assert forecast(spark, fit, (1, 1, 1, 1, 0, 1)) == (6.0, "store_item_weekday")
    assert forecast(spark, [*fit, fit[0]], (1, 1, 1, 1, 0, 1)) == (9.0, "store_item_weekday_promo")


def test_fallback_low_levels(spark):
    other = [(2, 2, 2, 1, 0, 0, 4.0)] * 10
    assert forecast(spark, other, (1, 1, 1, 1, 0, 0)) == (4.0, "class_weekday")
    assert forecast(spark, [(1, 2, 2, 2, 0, 0, 4.0)] * 10, (1, 1, 1, 1, 0, 0)) == (4.0, "store_weekday")
    assert forecast(spark, [(2, 2, 2, 2, 0, 0, 5.0)], (1, 1, 1, 1, 0, 0)) == (5.0, "weekday")
    assert forecast(spark, [(2, 2, 2, 2, 3, 0, 7.0)], (1, 1, 1, 1, 0, 0)) == (7.0, "global_mean")
    assert forecast(spark, [], (1, 1, 1, 1, 0, 0)) == (None, "global_mean")


def test_class_levels_come_after_family_and_store(spark):
    fit = [(1, 2, 2, 1, 0, 1, 8.0)] * 5
    assert forecast(spark, fit, (1, 1, 1, 1, 0, 1)) == (8.0, "class_store_weekday_promo")
    assert forecast(spark, fit, (1, 1, 1, 1, 0, 0)) == (8.0, "class_store_weekday")


OBSERVED = [(D(2020, 1, 1), 1, 1, 5.0, 1), (D(2020, 1, 2), 1, 1, 6.0, 0), (D(2020, 1, 2), 1, 2, 2.0, 0), (D(2020, 1, 3), 1, 2, 1.0, 0)]


def test_panel_and_its_zeros(spark):
    pairs = spark.createDataFrame([(1, 1), (1, 2)], "store_nbr int, item_nbr int")
    seen = spark.createDataFrame(OBSERVED, CELL)
    zeros = panel.implicit_zeros(pairs, seen, D(2020, 1, 1), D(2020, 1, 3))
    assert rows(zeros) == [(D(2020, 1, 1), 1, 2, 0.0, 0), (D(2020, 1, 3), 1, 1, 0.0, 0)]
    assert rows(panel.zero_filled(pairs, seen, D(2020, 1, 1), D(2020, 1, 3))) == sorted([*OBSERVED, *rows(zeros)])
    assert panel.zero_sample(pairs, seen, D(2020, 1, 1), D(2020, 1, 3), 1).count() == 1
    assert panel.zero_sample(pairs, seen, D(2020, 1, 3), D(2020, 1, 1), 5).count() == 0


def test_recent_rows_come_first_in_a_sample(spark):
    days = [(D(2020, 1, 1) + dt.timedelta(i), 1, 1, 1.0, 0) for i in range(60)]
    df = spark.createDataFrame(days, CELL)
    recent = {d[0] for d in days[-28:]}
    few, many = (panel.recent_biased_sample(df, n).collect() for n in (10, 40))
    assert len(few) == 10 and {r["date"] for r in few} <= recent
    assert len(many) == 40 and recent <= {r["date"] for r in many}
    assert panel.recent_biased_sample(df, 100).count() == 60 and panel.recent_biased_sample(df, None).count() == 60
    assert rows(panel.recent_biased_sample(df.repartition(7), 40)) == sorted(map(tuple, many))


def test_eligibility(spark):
    fit = spark.createDataFrame([(1, 1, 11)] * 27 + [(1, 2, 12)] * 28 + [(1, 4, 14)] * 30, "store_nbr int, item_nbr int, series_id long")
    horizon = spark.createDataFrame([(1, 1, 11), (1, 2, 12), (1, 3, 13), (1, 4, 14)], "store_nbr int, item_nbr int, series_id long")
    seen = spark.createDataFrame([(1,), (2,), (4,)], "item_nbr int")
    got = {r["item_nbr"]: r for r in routing.eligible_series(fit, horizon, seen, 28).collect()}
    assert [got[i]["enough_history_flag"] for i in (1, 2, 3, 4)] == [0, 1, 0, 1]
    assert [got[i]["is_tft_eligible"] for i in (1, 2, 3, 4)] == [0, 1, 0, 1]
    assert got[3]["unseen_item_flag"] == 1 and got[3]["history_points"] == 0
    one = routing.eligible_series(fit, horizon, seen, 28, most_series=1).agg(F.sum("is_tft_eligible"), F.sum("sampled_out_flag")).first()
    assert tuple(one) == (1, 1)
    assert routing.history_needed(3, 56) == 7 and routing.history_needed(0, 0) == 1


def test_routing(spark):
    df = spark.createDataFrame([(1, None, 2.0), (1, 0.0, 2.0), (0, 5.0, 2.0), (1, -1.0, 2.0)], "is_tft_eligible int, m double, fallback_prediction double")
    assert [(r["final_prediction"], r["used_fallback"]) for r in routing.route(df, "m").collect()] == [(2.0, 1), (0.0, 0), (2.0, 1), (0.0, 0)]


def test_blending(spark):
    df = spark.createDataFrame([(0.0,), (1.5,), (6.0,)], "c double")
    got = [r[0] for r in df.select(routing.blend_weight(F.col("c"), 3.0, 0.85, 0.2)).collect()]
    assert got == pytest.approx([0.2, 0.925, 1.0])


def test_folds():
    got = scoring.rolling_folds(D(2017, 8, 15))
    assert [f[1] for f in got] == [D(2017, 5, 8), D(2017, 6, 5), D(2017, 7, 3), D(2017, 7, 31)] and got[0][0] == "fold_1"
    with pytest.raises(ValueError):
        scoring.rolling_folds(D(2017, 8, 15), folds=0)


def test_one_score_has_no_deviation(spark):
    df = spark.createDataFrame([(112, 0.5)], "lookback int, weighted_rmsle double")
    assert tuple(scoring.summarise(df, "lookback").first()) == (112, 0.5, None, 0.5, 0.5)


def test_series_id_and_unpivot(spark):
    df = spark.createDataFrame([(D(2020, 1, 3), 3, 105574)], "date date, store_nbr int, item_nbr int")
    assert tuple(routing.series_index(df, D(2020, 1, 1)).select("time_idx", "series_id").first()) == (2, 30105574)
    wide = spark.createDataFrame([(7, 5, [1.0, 2.0])], "series_id int, first int, steps array<double>")
    assert rows(routing.unpivot_horizon(wide, "steps", "first", "p")) == [(7, 5, 1.0), (7, 6, 2.0)]


def test_nulls_count_as_rows_but_not_in_means(spark):
    df = spark.createDataFrame([(1, None), (1, 4.0), (None, 9.0)], "k int, target double")
    assert rows(aggregates.finish(aggregates.sums(df, ["k"]), ["k"])) == [(1, 4.0, 2)]


def test_both_promotion_flags_are_there(spark):
    df = spark.createDataFrame([(1, 4.0), (None, 9.0)], "onpromotion int, unit_sales double")
    got = {r["onpromotion"]: r for r in eda.promotion_summary(df).collect()}
    assert got[0]["records"] == 0 and got[0]["avg_unit_sales_per_record"] is None and got[1]["record_share_known"] == 1.0


def test_weights(spark):
    df = spark.createDataFrame([(1,), (0,), (None,)], "p int")
    assert [r[0] for r in df.select(item_weight(F.col("p"))).collect()] == [1.25, 1.0, 1.0]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(1, 3), st.integers(1, 3), st.integers(0, 2), st.integers(0, 1), st.integers(0, 9)), min_size=1, max_size=40))
def test_roll_up_equals_direct_grouping(spark, cells):
    df = spark.createDataFrame([(s, i, i % 2, i % 3, w, p, float(t)) for s, i, w, p, t in cells], FIT)
    for level, table in fallback.lookup_tables(fallback.grain_of(df), fallback.FALLBACK):
        direct = df.groupBy(*level.keys).agg(F.sum("target").alias("sum"), F.count(F.lit(1)).alias("count"))
        assert rows(table.select(*level.keys, "sum", "count")) == rows(direct)


def test_files(spark, tmp_path):
    (tmp_path / "train.csv").write_text("x" * 2_000_000)
    (tmp_path / "test.csv").write_text("x")
    assert [r["file"] for r in files.dataset_catalog(spark, str(tmp_path)).collect()] == ["train.csv", "test.csv"]
    assert files.missing_inputs(spark, str(tmp_path), ("train", "oil")) == ["oil.csv"]
    out = spark.createDataFrame([(2, 1.5), (1, 0.0)], "id long, final_prediction double")
    files.write_submission(out, str(tmp_path / "sub"))
    assert rows(files.read_submission(spark, str(tmp_path / "sub"))) == [(1, 0.0), (2, 1.5)]
    files.write_summary(spark, {"a": 1}, str(tmp_path / "summary"))
    assert spark.read.text(str(tmp_path / "summary")).first()[0] == '{"a": 1}'
    calls = []
    build = lambda: calls.append(1) or out
    for _ in range(2):
        assert files.cached(spark, str(tmp_path), "t", build, rows=5).count() == 2
    files.cached(spark, str(tmp_path), "t", build, rows=6)
    assert len(calls) == 2 and files.digest(a=1) != files.digest(a=2)
    assert files.parse_optional("None") is None and files.resolve_date("2020-01-02", D(2000, 1, 1)) == D(2020, 1, 2)
