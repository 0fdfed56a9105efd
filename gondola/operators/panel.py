"""Panels: every pair on every day, zeros that the facts leave out, and reproducible samples."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.operators.external import date_range

KEYS = ["date", "store_nbr", "item_nbr"]


def dense_panel(pairs: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Every pair on every day from start to end; the days, a bounded list, are multiplied onto the pairs."""
    days = F.sequence(F.lit(start), F.lit(end), F.expr("interval 1 day"))
    return pairs.select(F.explode(days).alias("date"), "store_nbr", "item_nbr")


def zero_filled(pairs: DataFrame, observed: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The panel with what was observed, and target and promotion 0 elsewhere."""
    return dense_panel(pairs, start, end).join(observed.select(*KEYS, "target", "onpromotion"), KEYS, "left").fillna({"target": 0.0, "onpromotion": 0})


def implicit_zeros(pairs: DataFrame, observed: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """The cells of the panel without an observed row, with target and promotion 0."""
    empty = dense_panel(pairs, start, end).join(observed.select(KEYS), KEYS, "left_anti")
    return empty.select(*KEYS, F.lit(0.0).alias("target"), F.lit(0).alias("onpromotion"))


def draw_key(seed: int, *columns: str) -> Column:
    """A pseudo-random order that any engine gives alike."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


#: Hexadecimal digits of the drawing key that rows are counted by.
COUNTED = 4


def first_rows(rows: DataFrame, n: int, key: Column, *columns: str) -> DataFrame:
    """The n first rows in the order of key (a digest as text, spread evenly) and columns; all if there are fewer.

    Rows are counted by the first digits of the key, 16 ** COUNTED values or twice as many. What lies before the value in
    which the n-th row is stays, and only the few rows of that value are put in order, so no task sees them all.
    """
    if n <= 0:
        return rows.limit(0)
    keyed = rows.withColumns({"_key": key, "_bin": F.substring(key, 1, COUNTED + 1)})
    left, border = n, None
    for r in keyed.groupBy("_bin").count().orderBy("_bin").collect():
        if r["count"] >= left:
            border = r["_bin"]
            break
        left -= r["count"]
    if border is None:
        return rows
    before = keyed.filter(F.col("_bin") < border)
    return before.unionByName(keyed.filter(F.col("_bin") == border).orderBy("_key", *columns).limit(left)).drop("_key", "_bin")


def draw(rows: DataFrame, n: int, seed: int, *columns: str) -> DataFrame:
    """n rows in the order of draw_key (all if there are fewer)."""
    return first_rows(rows, n, draw_key(seed, *columns), *columns)


def recent_biased_sample(rows: DataFrame, most: int | None, recent_days: int = 28, seed: int = 42) -> DataFrame:
    """At most ``most`` rows: those of the last ``recent_days`` days first, the rest drawn from the older ones.

    One sort key serves all cases: recent rows come first, then the drawing order; with fewer rows than ``most``
    all stay, with more recent rows than ``most`` only they are drawn from.
    """
    if most is None:
        return rows
    last = rows.agg(F.max("date")).first()[0]
    older = F.when(F.datediff(F.lit(last), "date") <= recent_days - 1, "0").otherwise("1")
    return first_rows(rows, most, F.concat(older, draw_key(seed, *KEYS)), *KEYS)


def zero_sample(pairs: DataFrame, observed: DataFrame, start: dt.date, end: dt.date, n: int, seed: int = 42) -> DataFrame:
    """n of the implicit zeros, or all if there are fewer; none if n or the span is empty."""
    zeros = implicit_zeros(pairs, observed, start, max(start, end))
    return draw(zeros if end >= start else zeros.limit(0), max(n, 0), seed, *KEYS)


def rank_within(*order: str) -> Column:
    return F.row_number().over(Window.orderBy(*order))
