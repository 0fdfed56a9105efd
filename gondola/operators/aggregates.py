"""Aggregates over recent windows and over all history, rolled up from one fine grain.

Sums and counts are associative, so each family of tables scans the facts once: the finest grain is aggregated
and, being far smaller than the facts, reused for the coarser tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import log1p, ratio


def sums(rows: DataFrame, keys: list[str], target: str = "target") -> DataFrame:
    """Per key: sum of target, rows, and rows with a target. Rows with a null key belong to no group."""
    return rows.dropna(subset=keys).groupBy(*keys).agg(F.sum(target).alias("sum"), F.count(F.lit(1)).alias("count"), F.count(target).alias("known"))


def roll_up(table: DataFrame, keys: list[str]) -> DataFrame:
    """The sums of a coarser grain."""
    return table.groupBy(*keys).agg(F.sum("sum").alias("sum"), F.sum("count").alias("count"), F.sum("known").alias("known"))


def finish(table: DataFrame, keys: Iterable[str], mean: str = "mean", count: str | None = "count") -> DataFrame:
    """Keys with the mean of known targets and the number of rows."""
    return table.select(*keys, ratio(F.col("sum"), F.col("known")).alias(mean), *([F.col("count").alias(count)] if count else []))


#: Rows of a table that is broadcast, at most.
MOST_BROADCAST = 1_000_000


def key_counts(grain: DataFrame) -> dict[str, int]:
    """How many values each key column of a grain has: bounds on the rows of all tables rolled up from it, from one job."""
    keys = [c for c in grain.columns if c in (*GRAIN, "fold", "lookback")]
    made = grain.agg(*[F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in keys]).first()
    return {c: max(made[c], 1) for c in keys}


def bounded(table: DataFrame, keys: Iterable[str], counts: dict[str, int]) -> DataFrame:
    """table, to be broadcast if its keys cannot have more than MOST_BROADCAST combinations."""
    rows = 1
    for k in keys:
        rows *= counts.get(k, MOST_BROADCAST + 1)
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


PAIR = ("store_nbr", "item_nbr")


def lookup(rows: DataFrame, tables: list[tuple[tuple[str, ...], DataFrame]], counts: dict[str, int], *by: str) -> DataFrame:
    """rows with the value columns of tables (keys, keys and values), null where a table has no match.

    All tables by store and item become one row a pair, with a map for each that has more keys, so the rows are shuffled
    once for all of them; tables by dimensions only are broadcast (see bounded).
    """
    pairs = [(keys, t) for keys, t in tables if {*PAIR} <= {*keys}]
    out, unpack = rows, {}
    if pairs:
        wide, own = None, [*by, *PAIR]
        for i, (keys, table) in enumerate(pairs):
            rest, values = [k for k in keys if k not in own], [c for c in table.columns if c not in keys]
            if rest:
                entry = F.struct(F.struct(*rest).alias("key"), F.struct(*values).alias("value"))
                table = table.groupBy(*own).agg(F.map_from_entries(F.collect_list(entry)).alias(f"_p{i}"))  # a pair's weekdays and promotions
                asked = F.struct(*[F.col(k).cast(dict(pairs[i][1].dtypes)[k]).alias(k) for k in rest])
                whole: Column = F.when(F.concat(*[F.col(k).cast("string") for k in rest]).isNotNull(), F.try_element_at(f"_p{i}", asked))
                unpack |= {v: whole[v] for v in values}
            wide = table if wide is None else wide.join(table, own, "full")
        out = out.join(bounded(wide, own, counts), own, "left")
        out = out.withColumns(unpack).drop(*[f"_p{i}" for i in range(len(pairs))]) if unpack else out
    for keys, table in tables:
        if not {*PAIR} <= {*keys}:
            out = out.join(bounded(table, keys, counts), list(keys), "left")
    return out


#: The finest grain: family and class are functions of the item.
GRAIN = ["store_nbr", "item_nbr", "family_code", "class", "weekday", "onpromotion"]


def history_grain(rows: DataFrame, fit_start: dt.date, fit_end: dt.date, cutoff: dt.date) -> DataFrame:
    """One aggregate, of one scan, from which all statistics of a fold are rolled up.

    rows: cleaned training rows with the columns of GRAIN. By GRAIN: sum, rows and known targets of all rows before
    cutoff (``*_all``), of those in the fit window, and of its last 28 and 56 days, which end with its greatest date.
    """
    in_fit = F.col("date").between(F.lit(fit_start), F.lit(fit_end))
    before = rows.filter(F.col("date") < F.lit(cutoff))
    last = before.filter(in_fit).agg(F.max("date").alias("_last"))
    parts = {"_all": F.lit(True), "": in_fit, "28": in_fit & (F.datediff("_last", "date") <= 27), "56": in_fit & (F.datediff("_last", "date") <= 55)}
    measures = []
    for name, where in parts.items():
        target = F.when(where, F.col("target"))
        measures += [F.sum(target).alias(f"sum{name}"), F.count(F.when(where, F.lit(1))).alias(f"count{name}"), F.count(target).alias(f"known{name}")]
    return before.crossJoin(F.broadcast(last)).groupBy(*GRAIN).agg(*measures)  # last is one row


def part_of(grain: DataFrame, name: str = "") -> DataFrame:
    """The groups of one part of a history grain, with sum, count and known."""
    return grain.filter(F.col(f"count{name}") > 0).select(*GRAIN, *[F.col(f"{m}{name}").alias(m) for m in ("sum", "count", "known")])


def prior_tables(grain: DataFrame) -> dict[tuple[str, ...], DataFrame]:
    """Mean and log count of all history, by pair, item, store, family, and family and store."""
    names = {
        ("store_nbr", "item_nbr"): "si_all",
        ("item_nbr",): "item_all",
        ("store_nbr",): "store_all",
        ("family_code",): "family_all",
        ("family_code", "store_nbr"): "family_store_all",
    }
    history = part_of(grain, "_all")
    return {k: finish(roll_up(history.dropna(subset=list(k)), list(k)), k, f"{n}_mean", "n").withColumn(f"{n}_count_log", log1p(F.col("n"))).drop("n") for k, n in names.items()}


def recent_tables(grain: DataFrame) -> list[tuple[tuple[str, ...], DataFrame]]:
    """Means over the fit window, and over its last 28 and 56 days."""
    fit = part_of(grain)
    mean = lambda keys, name, rows=fit: finish(roll_up(rows, list(keys)), keys, name, None)
    pair = ("store_nbr", "item_nbr")
    siw = finish(roll_up(fit, [*pair, "weekday"]), (*pair, "weekday"), "siw_mean", "n").withColumn("siw_count_log", log1p(F.col("n"))).drop("n")
    return [
        (pair, mean(pair, "si_recent28", part_of(grain, "28"))),
        (pair, mean(pair, "si_recent56", part_of(grain, "56"))),
        ((*pair, "weekday"), siw),
        (("family_code", "store_nbr", "weekday"), mean(("family_code", "store_nbr", "weekday"), "fsw_mean")),
        (("family_code", "weekday"), mean(("family_code", "weekday"), "fw_mean")),
        (("item_nbr",), mean(("item_nbr",), "item_recent_mean")),
        (("store_nbr",), mean(("store_nbr",), "store_recent_mean")),
    ]


#: Statistics that are 0 where a row has no match.
STATS = (
    "si_recent28", "si_recent56", "siw_mean", "siw_count_log", "fsw_mean", "fw_mean", "item_recent_mean", "store_recent_mean",
    "si_all_mean", "si_all_count_log", "item_all_mean", "item_all_count_log", "store_all_mean", "family_all_mean",
    "family_store_all_mean", "family_store_all_count_log",
)


def with_stats(rows: DataFrame, recent: list, prior: dict, counts: dict[str, int], fill_from: DataFrame | None = None, fills: tuple[str, ...] = ()) -> DataFrame:
    """rows with the recent and prior statistics, 0 where there are none.

    The columns ``fills`` are filled with their exact medians over ``fill_from``, or 0 if that has none. The oil price
    needs no median: a dense series has a price on every day, or on none, and then it is 0.
    """
    out = lookup(rows, [*recent, *prior.items()], counts).fillna(0.0, [*STATS, "dcoilwtico"])
    if not fills:
        return out
    medians = fill_from.agg(*[F.coalesce(F.median(c), F.lit(0.0)).alias(f"_{c}") for c in fills])
    out = out.crossJoin(F.broadcast(medians))  # one row
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), f"_{c}") for c in fills}).drop(*[f"_{c}" for c in fills])


def derived(rows: DataFrame) -> DataFrame:
    """Ten columns of plain arithmetic on the statistics."""
    c = F.col
    return rows.withColumns(
        {
            "is_weekend": c("weekday").isin(5, 6).cast("int"),
            "promo_family_gap": c("fsw_mean") - c("fw_mean"),
            "promo_store_gap": c("family_store_all_mean") - c("store_all_mean"),
            "recent_trend_28_56": c("si_recent28") - c("si_recent56"),
            "recent_ratio_28_56": c("si_recent28") / (c("si_recent56") + 1.0),
            "item_vs_family_ratio": c("item_all_mean") / (c("family_all_mean") + 1.0),
            "family_store_vs_store_ratio": c("family_store_all_mean") / (c("store_all_mean") + 1.0),
            "item_recent_delta": c("item_recent_mean") - c("item_all_mean"),
            "store_recent_delta": c("store_recent_mean") - c("store_all_mean"),
            "history_strength": c("si_all_count_log") + c("item_all_count_log") + c("family_store_all_count_log"),
        }
    )
