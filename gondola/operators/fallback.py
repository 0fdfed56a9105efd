"""Prioritised lookups: the first level whose group is large enough gives the forecast."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import clip0
from gondola.operators.aggregates import GRAIN, key_counts, lookup, roll_up, sums
from gondola.sources.files import cut_lineage


@dataclass(frozen=True)
class Level:
    """A lookup by keys that is accepted from ``least`` rows on."""

    source: str
    keys: tuple[str, ...]
    least: int


#: The levels, in order, of the model's fallback and of the hierarchical baseline.
FALLBACK = (
    Level("store_item_weekday_promo", ("store_nbr", "item_nbr", "weekday", "onpromotion"), 2),
    Level("store_item_weekday", ("store_nbr", "item_nbr", "weekday"), 2),
    Level("family_store_weekday_promo", ("family_code", "store_nbr", "weekday", "onpromotion"), 5),
    Level("family_store_weekday", ("family_code", "store_nbr", "weekday"), 5),
    Level("class_store_weekday_promo", ("class", "store_nbr", "weekday", "onpromotion"), 5),
    Level("class_store_weekday", ("class", "store_nbr", "weekday"), 5),
    Level("family_weekday_promo", ("family_code", "weekday", "onpromotion"), 10),
    Level("family_weekday", ("family_code", "weekday"), 10),
    Level("class_weekday", ("class", "weekday"), 10),
    Level("store_weekday", ("store_nbr", "weekday"), 10),
    Level("weekday", ("weekday",), 1),
)
HIERARCHICAL = tuple(x for x in FALLBACK if not x.source.startswith(("class", "store_weekday")))
RECENT = (
    Level("store_item_recent28", ("store_nbr", "item_nbr"), 2),
    Level("item_recent28", ("item_nbr",), 5),
    Level("weekday", ("weekday",), 1),
)
GLOBAL = "global_mean"


def grain_of(fit: DataFrame, *by: str) -> DataFrame:
    """The one aggregate, computed once, from which all levels are rolled up; ``by``: more keys, such as the fold."""
    return cut_lineage(sums(fit, [*by, *GRAIN]))


def lookup_tables(grain: DataFrame, levels: tuple[Level, ...], *by: str) -> list[tuple[Level, DataFrame]]:
    return [(level, roll_up(grain, [*by, *level.keys])) for level in levels]


def cascade(rows: DataFrame, tables: list[tuple[Level, DataFrame]], overall: DataFrame, counts: dict[str, int], prediction: str, source: str, *by: str) -> DataFrame:
    """rows with the mean of the first level that has enough rows, at least 0, and that level's name.

    The levels are looked up together (see lookup; counts: of the keys' values), and one coalesce picks; ``overall``
    (sum and count, one row for each value of ``by``) serves where no level does.
    """
    found, means, names = [], [], []
    for i, (level, table) in enumerate(tables):
        right = table.select(*by, *level.keys, F.when((F.col("count") >= level.least) & (F.col("known") > 0), F.col("sum") / F.col("known")).alias(f"_m{i}"))
        found.append(((*by, *level.keys), right))
        means.append(F.col(f"_m{i}"))
        names.append(F.when(F.col(f"_m{i}").isNotNull(), F.lit(level.source)))
    out = lookup(rows, found, counts, *by)
    mean = overall.select(*by, (F.col("sum") / F.when(F.col("count") > 0, F.col("count"))).alias("_all"))
    out = out.join(F.broadcast(mean), list(by), "left") if by else out.crossJoin(F.broadcast(mean))  # one row
    return out.withColumns({prediction: clip0(F.coalesce(*means, "_all")), source: F.coalesce(*names, F.lit(GLOBAL))}).drop("_all", *[f"_m{i}" for i in range(len(tables))])


def overall_of(table: DataFrame, count: str = "count", *by: str) -> DataFrame:
    """The sum and count of a lookup table, one row for each value of ``by``."""
    return table.groupBy(*by).agg(F.sum("sum").alias("sum"), F.sum(count).alias("count"))


def fallback(rows: DataFrame, grain: DataFrame, *by: str) -> DataFrame:
    """rows (weekday, onpromotion, family_code, class) with fallback_prediction and fallback_source, from a grain of the
    fit rows (see grain_of)."""
    return cascade(rows, lookup_tables(grain, FALLBACK, *by), overall_of(grain, "known", *by), key_counts(grain), "fallback_prediction", "fallback_source", *by)
