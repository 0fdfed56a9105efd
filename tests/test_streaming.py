import datetime as dt

import pytest

from gondola.operators.aggregates import sums
from gondola.streaming import incremental


def test_running_sums_equal_the_batch(spark, tmp_path):
    rows = [(dt.date(2020, 1, 1 + i % 5), i % 3, 1, float(i - 2), 0) for i in range(20)]
    df = spark.createDataFrame(rows, incremental.SALES)
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.running_sums(incremental.arriving_sales(spark, str(tmp_path / "in"), files_at_once=1), ["store_nbr"])
    with pytest.raises(FileNotFoundError):
        incremental.read_running(spark, str(tmp_path / "out"))
    query = incremental.write_running(stream, str(tmp_path / "state"), str(tmp_path / "out"))
    query.awaitTermination()
    assert query.exception() is None and (tmp_path / "out" / "batch=3" / "_SUCCESS").exists()
    batch = sums(df.selectExpr("store_nbr", "greatest(unit_sales, 0D) as target"), ["store_nbr"])
    assert sorted(map(tuple, incremental.read_running(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))
    windowed = incremental.running_sums(incremental.arriving_sales(spark, str(tmp_path / "in")), ["store_nbr"], window="2 days")
    assert windowed.isStreaming and windowed.columns[0] == "window"


def test_a_later_run_goes_on_from_the_checkpoint(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for run in range(2):
        spark.createDataFrame([(dt.date(2020, 1, 1), 1, 1, 2.0, None)], incremental.SALES).coalesce(1).write.mode("append").parquet(folder)
        stream = incremental.running_sums(incremental.arriving_sales(spark, folder), ["store_nbr"])
        incremental.write_running(stream, str(tmp_path / "state"), out).awaitTermination()
        assert [tuple(r) for r in incremental.read_running(spark, out).collect()] == [(1, 2.0 * (run + 1), run + 1, run + 1)]
    (tmp_path / "out" / "batch=9").mkdir()  # a batch that did not get to its end
    assert incremental.read_running(spark, out).count() == 1
