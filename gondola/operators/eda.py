"""Exploratory roll-ups."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.columns import mean_of, payday, ratio
from gondola.operators.external import dense_oil
from gondola.sources.retail import Retail

def everything():
    """A window of all rows; used over aggregated rows only."""
    return Window.partitionBy()


def share(condition: Column) -> Column:
    """The share of rows for which condition holds; null counts as not."""
    return F.sum(F.coalesce(condition.cast("int"), F.lit(0))) / F.count(F.lit(1))


def overview(train: DataFrame) -> DataFrame:
    """One row of counts, dates and rates."""
    return train.agg(
        F.count(F.lit(1)).alias("rows"), F.min("date").alias("date_min"), F.max("date").alias("date_max"), F.countDistinct("date").alias("n_days"),
        F.countDistinct("store_nbr").alias("unique_stores"), F.countDistinct("item_nbr").alias("unique_items"),
        share(F.col("onpromotion").isNull()).alias("missing_onpromotion_rate"), share(F.col("unit_sales") < 0).alias("negative_sales_rate"),
        share(F.col("unit_sales") > 0).alias("positive_sales_rate"), F.sum("unit_sales").alias("total_unit_sales"),
    )


def daily_sales(train: DataFrame) -> DataFrame:
    """Per day: sales, records, promotions, returns, and their ratios."""
    flag = F.col("onpromotion").cast("int")
    out = train.groupBy("date").agg(
        F.sum("unit_sales").alias("unit_sales"), F.count(F.lit(1)).alias("records"), F.sum(F.coalesce(flag, F.lit(0))).cast("long").alias("promotion_true_records"),
        F.count(flag).alias("promotion_known_records"), F.sum((F.col("unit_sales") < 0).cast("int")).cast("long").alias("negative_sales_records"),
    )
    return out.withColumns({"avg_unit_sales_per_record": ratio(F.col("unit_sales"), F.col("records")), "promotion_share_known": ratio(F.col("promotion_true_records"), F.col("promotion_known_records"))})


def group_sales(rows: DataFrame, key: str) -> DataFrame:
    """Per value of key: sales, records, mean and share of all sales."""
    out = rows.groupBy(key).agg(F.sum("unit_sales").alias("unit_sales"), F.count(F.lit(1)).alias("records"))
    return out.withColumns({"avg_unit_sales_per_record": ratio(F.col("unit_sales"), F.col("records")), "sales_share": ratio(F.col("unit_sales"), F.sum("unit_sales").over(everything()))})


def family_sales(tables: Retail) -> DataFrame:
    """By family; items without one are left out."""
    return group_sales(tables.train.join(tables.items.select("item_nbr", "family"), "item_nbr").filter("family is not null"), "family")


def store_sales(tables: Retail) -> DataFrame:
    return group_sales(tables.train, "store_nbr").join(tables.stores, "store_nbr", "left")


def promotion_summary(train: DataFrame) -> DataFrame:
    """Both flags, whether or not they occur; rows with an unknown flag are left out."""
    found = train.filter("onpromotion is not null").groupBy(F.col("onpromotion").cast("int").alias("onpromotion")).agg(F.count(F.lit(1)).alias("records"), F.sum("unit_sales").alias("unit_sales"))
    flags = train.sparkSession.range(2).select(F.col("id").cast("int").alias("onpromotion"))
    out = flags.join(found, "onpromotion", "left").fillna({"records": 0, "unit_sales": 0.0})
    return out.withColumns({"record_share_known": ratio(F.col("records"), F.sum("records").over(everything())), "avg_unit_sales_per_record": ratio(F.col("unit_sales"), F.col("records"))})


def rolling_mean(daily: DataFrame, value: str, rows: int = 28, least: int = 7) -> DataFrame:
    """daily with the mean of the last ``rows`` rows (days that occur), where they hold ``least`` values."""
    frame = Window.orderBy("date").rowsBetween(1 - rows, 0)  # one row per day
    return daily.withColumn(f"rolling_{rows}d", F.when(F.count(value).over(frame) >= least, F.sum(value).over(frame) / F.count(value).over(frame)))


def external_frame(tables: Retail, start: dt.date, end: dt.date) -> DataFrame:
    """Daily sales with the rolling mean, names of day and month, payday, transactions, and the dense oil price from start to end."""
    daily = rolling_mean(daily_sales(tables.train), "unit_sales")
    daily = daily.withColumns({"weekday": F.date_format("date", "EEEE"), "month": F.date_format("date", "MMM"), "is_payday": payday(F.col("date"))})
    totals = tables.transactions.groupBy("date").agg(F.sum("transactions").alias("transactions"))
    return daily.join(totals, "date", "left").join(dense_oil(tables.oil, start, end), "date", "left")


def z_scores(daily: DataFrame, *columns: str) -> DataFrame:
    """Each column less its mean, over its sample deviation, of the rows without a null in any of them."""
    whole = daily.dropna(subset=list(columns))
    return whole.select("date", *[((F.col(c) - F.avg(c).over(everything())) / F.stddev_samp(c).over(everything())).alias(f"z_{c}") for c in columns])


def correlations(daily: DataFrame, *columns: str) -> DataFrame:
    """Pearson's correlation of each pair of columns, over the rows that have both."""
    made = daily.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a in columns for b in columns])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}|{b}").alias("correlation")) for a in columns for b in columns])
    return made.select(F.inline(cells))


def profile(daily: DataFrame, key: str, value: str = "unit_sales") -> DataFrame:
    return daily.groupBy(key).agg(mean_of(F.col(value)).alias(value))


def holiday_pivot(holidays: DataFrame, locales: tuple[str, ...]) -> DataFrame:
    return holidays.groupBy("type").pivot("locale", list(locales)).agg(F.count(F.lit(1))).fillna(0)


def missing_share(name: str, table: DataFrame, date_col: str | None) -> DataFrame:
    """Rows, columns, first and last date, and the mean over columns of the share of nulls."""
    n = F.count(F.lit(1))
    nulls = [(n - F.count(F.col(c))) / n for c in table.columns]
    total = nulls[0]
    for x in nulls[1:]:
        total = total + x
    date = (lambda f: f(date_col)) if date_col else (lambda f: F.lit(None).cast("date"))
    return table.agg(n.alias("rows"), date(F.min).alias("date_min"), date(F.max).alias("date_max"), (total / len(nulls)).alias("missing_share")).select(
        F.lit(name).alias("table_name"), "rows", F.lit(len(nulls)).alias("cols"), "date_min", "date_max", "missing_share"
    )


def test_coverage(train: DataFrame, test: DataFrame) -> DataFrame:
    """Rows, dates and entities of the test rows, and how many entities training rows lack."""
    new = lambda c, name: test.select(c).distinct().join(train.select(c).distinct(), c, "left_anti").agg(F.count(F.lit(1)).alias(name))
    base = test.agg(F.count(F.lit(1)).alias("test_rows"), F.min("date").alias("test_start"), F.max("date").alias("test_end"), F.countDistinct("item_nbr").alias("test_unique_items"), F.countDistinct("store_nbr").alias("test_unique_stores"))
    return base.crossJoin(new("item_nbr", "new_items_in_test")).crossJoin(new("store_nbr", "new_stores_in_test"))  # one row each
