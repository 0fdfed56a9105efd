"""The original CSV files from reading to a forecast, bounded broadcasts, samples, and the cache."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gondola import queries as q
from gondola.operators import aggregates, panel
from gondola.plans import backtest, frames
from gondola.sources import files
from gondola.sources.retail import load, load_kept, read_csv_tables

DATA = "/root/testdata/sf0.001"


def write_csv(df, path):
    """One file with a header, as the original files are."""
    import csv

    with open(path, "w", newline="") as f:
        out = csv.writer(f)
        out.writerow(df.columns)
        for r in df.collect():
            out.writerow(["" if x is None else x for x in r])


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("csv")
    t = load(spark, DATA)
    flag = F.when(F.col("onpromotion") == 1, "True").when(F.col("onpromotion") == 0, "False").alias("onpromotion")
    write_csv(t.train.select(F.monotonically_increasing_id().alias("id"), "date", "store_nbr", "item_nbr", "unit_sales", flag), out / "train.csv")
    write_csv(t.test.select("id", "date", "store_nbr", "item_nbr", flag), out / "test.csv")
    write_csv(t.stores.select("store_nbr", "city", "state", "type", "cluster"), out / "stores.csv")
    write_csv(t.items.select("item_nbr", "family", "class", "perishable"), out / "items.csv")
    write_csv(t.transactions.select("date", "store_nbr", "transactions"), out / "transactions.csv")
    write_csv(t.oil.select("date", "dcoilwtico"), out / "oil.csv")
    write_csv(t.holidays.select("date", "type", "locale", "locale_name", F.lit("x").alias("description"), "transferred"), out / "holidays_events.csv")
    return str(out)


def test_csv_tables_equal_the_mapped_ones(spark, folder):
    assert files.missing_inputs(spark, folder) == []
    read, mapped = read_csv_tables(spark, folder), load(spark, DATA)
    for name in ("clean", "stores", "items", "transactions", "oil"):
        one, two = getattr(read, name), getattr(mapped, name)
        assert sorted(map(repr, one.select(sorted(one.columns)).collect())) == sorted(map(repr, two.select(sorted(one.columns)).collect()))
    assert read.universe.exceptAll(mapped.universe).isEmpty()


def test_command_line_from_csv_files(spark, folder, tmp_path):
    backtest.main([folder, str(tmp_path), "--train-end", str(q.TRAIN_END), "--test-start", str(q.TEST_START), "--test-end", str(q.TRAIN_END + dt.timedelta(16)), "--lookbacks", "112", "--folds", "1", "--most-fit", "120"])
    assert files.read_submission(spark, f"{tmp_path}/submission").count() == read_csv_tables(spark, folder).test.count()
    with pytest.raises(SystemExit, match="train.csv"):
        backtest.main([str(tmp_path), str(tmp_path), "--train-end", "2001-01-01", "--test-start", "2001-01-02", "--test-end", "2001-01-03"])


def test_kept_tables_are_written_once_and_follow_their_inputs(spark, tmp_path):
    import os
    import shutil

    for name in os.listdir(DATA):
        shutil.copytree(f"{DATA}/{name}", tmp_path / name) if os.path.isdir(f"{DATA}/{name}") else shutil.copy(f"{DATA}/{name}", tmp_path / name)
    one = load_kept(spark, str(tmp_path)).sales
    assert one.inputFiles() == load_kept(spark, str(tmp_path)).sales.inputFiles()
    os.utime(tmp_path / "lineitem.parquet", (1, 1))
    two = load_kept(spark, str(tmp_path)).sales
    assert set(two.inputFiles()).isdisjoint(one.inputFiles())
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        files.checkpoint_folder(Session())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lookups_shuffle_the_rows_once(spark):
    """Tables by dimensions are broadcast, those by store and item are one join; the facts are scanned for rows and grain only."""
    t = load_kept(spark, DATA)
    for df in (q.queries()["hierarchical_fallback"](spark, DATA), frames.panel_fold(t, q.VALID_START, q.LOOKBACK)[1]):
        plan = plan_of(df)
        assert plan.count("SortMergeJoin") <= 6 and plan.count("BroadcastHashJoin") >= 8


def test_tables_beyond_the_bound_are_not_broadcast(spark, monkeypatch):
    t = load_kept(spark, DATA)
    small = sorted(map(repr, q.queries()["fold_features_panel"](spark, DATA).collect()))
    monkeypatch.setattr(aggregates, "MOST_BROADCAST", 0)
    assert sorted(map(repr, q.queries()["fold_features_panel"](spark, DATA).collect())) == small
    counts = aggregates.key_counts(frames.history(t, q.FIT_START, q.FIT_END, q.VALID_START))
    assert counts["weekday"] == 7 and counts["onpromotion"] <= 2


@pytest.mark.parametrize("n", [0, 1, 7, 100, 500, 501, 10_000])
def test_first_rows_are_those_of_a_global_order(spark, n):
    rows = spark.createDataFrame([(i % 40, i % 7, i) for i in range(500)] + [(1, 1, 1)], "a int, b int, c int")
    key = panel.draw_key(3, "a", "b")
    wanted = sorted(map(tuple, rows.orderBy(key, "a", "b", "c").limit(n).collect()))
    assert sorted(map(tuple, panel.first_rows(rows, n, key, "a", "b", "c").collect())) == wanted
