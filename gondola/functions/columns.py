"""Expressions that several operators use. All are built-in functions, so they stay inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip0(x: Column) -> Column:
    """Negative values as 0; null stays null (greatest() would give 0)."""
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def log1p(x: Column) -> Column:
    """ln(1 + x)."""
    return F.log(F.lit(1.0) + x)


def promo_flag(x: Column) -> Column:
    """The promotion flag as 0 or 1; unknown counts as 0."""
    return F.coalesce(x.cast("int"), F.lit(0))


def item_weight(perishable: Column) -> Column:
    """The metric's weight: 1.25 for perishable items, 1 for others."""
    return F.when(perishable == 1, F.lit(1.25)).otherwise(F.lit(1.0))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.when(b != 0, b)


def mean_of(x: Column) -> Column:
    """The mean of non-null values as sum / count, which rounds the same in every engine if the sum is exact."""
    return ratio(F.sum(x), F.count(x))


def known_code(name: str) -> Column:
    """A code column that must not be null: a row without one ends the query, naming the column."""
    return F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} is null"))).otherwise(F.col(name))


def month_end(d: Column) -> Column:
    return d == F.last_day(d)


def payday(d: Column) -> Column:
    """The 15th and the last day of a month."""
    return (F.dayofmonth(d) == 15) | month_end(d)


CALENDAR = ("weekday", "day", "month", "weekofyear", "is_month_end", "is_payday")


def add_calendar(df: DataFrame, date_col: str = "date") -> DataFrame:
    """df with weekday (Monday 0), day, month, ISO week, and month-end and payday flags, all int."""
    d = F.col(date_col)
    return df.withColumns(
        {
            "weekday": F.weekday(d),
            "day": F.dayofmonth(d),
            "month": F.month(d),
            "weekofyear": F.weekofyear(d),
            "is_month_end": month_end(d).cast("int"),
            "is_payday": payday(d).cast("int"),
        }
    )
