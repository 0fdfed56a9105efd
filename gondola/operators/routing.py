"""Which series a model may forecast, and how its forecasts and the fallback's become one."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.columns import clip0
from gondola.sources.files import cut_lineage
from gondola.operators.panel import draw

SERIES = ["store_nbr", "item_nbr", "series_id"]


def series_index(rows: DataFrame, start: dt.date) -> DataFrame:
    """rows with time_idx, the days since start, and series_id, which packs store and item."""
    packed = F.col("store_nbr").cast("long") * 10_000_000 + F.col("item_nbr").cast("long")
    return rows.withColumns({"time_idx": F.datediff("date", F.lit(start)), "series_id": packed})


def history_needed(least_points: int, encoder: int) -> int:
    """Days of history that a series needs: the setting, but not under a week of a long encoder, and one at least."""
    return max(least_points, min(encoder, 7), 1)


def eligible_series(fit: DataFrame, horizon: DataFrame, seen_items: DataFrame, least: int, most_series: int | None = None, seed: int = 42) -> DataFrame:
    """The horizon's series with history_points, flags, and whether the model takes them.

    A series needs ``least`` rows in fit and an item among seen_items. Of more than ``most_series`` such series as many
    are drawn (a reproducible order); the others are marked sampled_out_flag.
    """
    history = fit.groupBy(*SERIES).agg(F.count(F.lit(1)).cast("int").alias("history_points"))
    seen = seen_items.select("item_nbr").distinct().withColumn("_seen", F.lit(1))
    flagged = (
        horizon.select(SERIES).distinct().join(history, SERIES, "left").join(seen, "item_nbr", "left")
        .select(*SERIES, F.coalesce("history_points", F.lit(0)).alias("history_points"), F.col("_seen").isNull().cast("int").alias("unseen_item_flag"))
        .withColumn("enough_history_flag", (F.col("history_points") >= max(least, 1)).cast("int"))
    )
    fit_for = (F.col("enough_history_flag") == 1) & (F.col("unseen_item_flag") == 0)
    if not most_series:
        return flagged.withColumns({"is_tft_eligible": fit_for.cast("int"), "sampled_out_flag": F.lit(0)})
    flagged = cut_lineage(flagged)
    drawn = draw(flagged.filter(fit_for).select("series_id"), most_series, seed, "series_id").withColumn("_in", F.lit(1))
    out = flagged.join(drawn, "series_id", "left").withColumns({"is_tft_eligible": F.coalesce("_in", F.lit(0)), "sampled_out_flag": (fit_for & F.col("_in").isNull()).cast("int")})
    return out.drop("_in").select(*SERIES, "history_points", "unseen_item_flag", "enough_history_flag", "is_tft_eligible", "sampled_out_flag")


def route(rows: DataFrame, model: str | None, fallback: str = "fallback_prediction") -> DataFrame:
    """rows with final_prediction: the model's where the series is eligible and it has one, else the fallback's; and used_fallback.

    Without a model every row takes the fallback.
    """
    raw = F.lit(None).cast("double") if model is None else F.col(model)
    use = (F.col("is_tft_eligible") == 1) & raw.isNotNull()
    return rows.withColumns({"final_prediction": clip0(F.when(use, raw).otherwise(F.col(fallback))), "used_fallback": (~use).cast("int")})


#: What stands for a missing category.
NO_CATEGORY = "0"


def as_categories(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """rows with columns as text, null as NO_CATEGORY."""
    return rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NO_CATEGORY)) for c in columns})


def vocabulary(parts: Iterable[DataFrame], columns: Iterable[str]) -> DataFrame:
    """(column_name, value): the categories that occur in any of the parts, and NO_CATEGORY, so that all parts share them.

    All columns are met in one pass over each part; values are made distinct before they are shuffled.
    """
    names, out = list(columns), None
    for part in parts:
        pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in names])
        found = as_categories(part.select(*names), names).select(F.inline(pairs)).distinct()
        out = found if out is None else out.union(found)
    if out is None:
        raise ValueError("a vocabulary needs at least one part")
    fill = out.sparkSession.createDataFrame([(c, NO_CATEGORY) for c in names], "column_name string, value string")
    return out.union(fill).distinct()


def blend_weight(count_log: Column, scale: float, least: float, unseen: float) -> Column:
    """The model's weight: from ``least`` without history to 1 at ``scale``; ``unseen`` for items never sold."""
    share = count_log / max(scale, 1e-3)
    share = F.when(share < 0, 0.0).when(share > 1, 1.0).otherwise(share)
    return F.when(count_log <= 0, F.lit(float(unseen))).otherwise(F.lit(float(least)) + F.lit(1.0 - least) * share)


def blend(model: Column, fallback: Column, weight: Column) -> Column:
    return clip0(weight * model + (1.0 - weight) * fallback)


def unpivot_horizon(rows: DataFrame, array: str, start: str, value: str) -> DataFrame:
    """A row per step of an array of forecasts: its time_idx is that of the first step plus its place."""
    rest = [c for c in rows.columns if c not in (array, start)]
    return rows.select(*rest, F.col(start), F.posexplode(array).alias("_step", value)).select(*rest, (F.col(start) + F.col("_step")).cast("int").alias("time_idx"), value)
