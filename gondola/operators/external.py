"""Joins with dimensions and external drivers: dates, holidays, oil, transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.columns import add_calendar
from gondola.sources.retail import Retail

#: A flag and the holiday types that set it.
FLAGS = {
    "is_holiday": ("Holiday", "Transfer"),
    "is_event": ("Event",),
    "is_additional": ("Additional",),
    "is_bridge": ("Bridge",),
    "is_work_day": ("Work Day",),
}


def date_range(spark, start: dt.date, end: dt.date) -> DataFrame:
    """One row per day from start to end, both included."""
    return spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))).alias("date"))


def dense_oil(oil: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """A price for every day from start to end: the last one in that span, else the next one in it.

    The span is cut first, so a gap at its start is filled from the future, never from before. Of several rows of
    a day the lowest price counts.
    """
    cut = oil.filter(F.col("date").between(F.lit(start), F.lit(end))).groupBy("date").agg(F.min("dcoilwtico").alias("price"))
    days = date_range(oil.sparkSession, start, end).join(cut, "date", "left")
    ordered = Window.orderBy("date")  # one row per day
    before = F.last("price", True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("price", True).over(ordered.rowsBetween(0, Window.unboundedFollowing))
    return days.select("date", F.coalesce(before, after).alias("dcoilwtico"))


def holiday_flags(stores: DataFrame, holidays: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Flags for every day and store. Transferred holidays do not count; a holiday holds for the nation, for the
    stores of a state (Regional) or else of a city."""
    counted = holidays.filter(F.col("date").between(F.lit(start), F.lit(end)) & ~F.coalesce((F.col("type") == "Holiday") & F.col("transferred"), F.lit(False)))
    flagged = counted.select("date", "locale", "locale_name", *[F.col("type").isin(*types).cast("int").alias(f) for f, types in FLAGS.items()])
    spot = stores.select("store_nbr", "city", "state")
    regional = flagged.filter("locale = 'Regional'").join(spot, F.col("locale_name") == F.col("state"))
    local = flagged.filter("locale not in ('National', 'Regional')").join(spot, F.col("locale_name") == F.col("city"))
    national = flagged.filter("locale = 'National'").crossJoin(F.broadcast(spot))  # both are dimensions: a few days times the stores
    names = ["date", "store_nbr", *FLAGS]
    found = national.select(names).union(regional.select(names)).union(local.select(names)).groupBy("date", "store_nbr").agg(*[F.max(f).alias(f) for f in FLAGS])
    grid = date_range(stores.sparkSession, start, end).crossJoin(stores.select("store_nbr").distinct())
    return grid.join(found, ["date", "store_nbr"], "left").select("date", "store_nbr", *[F.coalesce(f, F.lit(0)).alias(f) for f in FLAGS])


def with_dims(rows: DataFrame, tables: Retail) -> DataFrame:
    """rows with the items' and stores' attributes and codes."""
    return rows.join(tables.item_meta, "item_nbr", "left").join(tables.store_meta, "store_nbr", "left")


def with_transactions(rows: DataFrame, tables: Retail) -> DataFrame:
    return rows.join(tables.transactions, ["date", "store_nbr"], "left")


def with_common(rows: DataFrame, tables: Retail, start: dt.date, end: dt.date, transactions: bool = False) -> DataFrame:
    """rows with calendar, dimensions, oil price (dense from start to end) and holiday flags, and transactions if asked."""
    out = with_dims(add_calendar(rows), tables)
    out = out.join(dense_oil(tables.oil, start, end), "date", "left")
    out = out.join(holiday_flags(tables.stores, tables.holidays, start, end), ["date", "store_nbr"], "left")
    out = out.withColumns({f: F.coalesce(f, F.lit(0)) for f in FLAGS})
    return with_transactions(out, tables) if transactions else out
