"""SQL for the named queries, in the dialect of DuckDB, over the same parquet tables.

NAMED holds subqueries by name; ``sql()`` puts those that a statement mentions, directly or not, in front of it.

Levels, thresholds, windows, folds and flags are written out here and not taken from the engine, so that a wrong one there
shows. Only lists of columns, and the holidays of the mapped tables, are shared.
"""

from __future__ import annotations

import datetime as dt
import re
from typing import NamedTuple

from gondola.operators.aggregates import STATS
from gondola.plans.frames import CATEGORIES, CODES, DERIVED, FEATURES, KNOWN, LEGACY, LEGACY_STATS
from gondola.queries import BASELINE, HOLDOUT, ROUNDED, SERIES_FLAGS
from gondola.sources.retail import HOLIDAYS


class Step(NamedTuple):
    """A level of a prioritised lookup: its name, its keys and the rows that it needs."""

    source: str
    keys: list[str]
    least: int


#: The levels of the model's fallback and of the two baselines.
FALLBACK = [
    Step("store_item_weekday_promo", ["store_nbr", "item_nbr", "weekday", "onpromotion"], 2),
    Step("store_item_weekday", ["store_nbr", "item_nbr", "weekday"], 2),
    Step("family_store_weekday_promo", ["family_code", "store_nbr", "weekday", "onpromotion"], 5),
    Step("family_store_weekday", ["family_code", "store_nbr", "weekday"], 5),
    Step("class_store_weekday_promo", ["class", "store_nbr", "weekday", "onpromotion"], 5),
    Step("class_store_weekday", ["class", "store_nbr", "weekday"], 5),
    Step("family_weekday_promo", ["family_code", "weekday", "onpromotion"], 10),
    Step("family_weekday", ["family_code", "weekday"], 10),
    Step("class_weekday", ["class", "weekday"], 10),
    Step("store_weekday", ["store_nbr", "weekday"], 10),
    Step("weekday", ["weekday"], 1),
]
HIERARCHICAL = [
    Step("store_item_weekday_promo", ["store_nbr", "item_nbr", "weekday", "onpromotion"], 2),
    Step("store_item_weekday", ["store_nbr", "item_nbr", "weekday"], 2),
    Step("family_store_weekday_promo", ["family_code", "store_nbr", "weekday", "onpromotion"], 5),
    Step("family_store_weekday", ["family_code", "store_nbr", "weekday"], 5),
    Step("family_weekday_promo", ["family_code", "weekday", "onpromotion"], 10),
    Step("family_weekday", ["family_code", "weekday"], 10),
    Step("weekday", ["weekday"], 1),
]
RECENT = [
    Step("store_item_recent28", ["store_nbr", "item_nbr"], 2),
    Step("item_recent28", ["item_nbr"], 5),
    Step("weekday", ["weekday"], 1),
]
#: The kinds of holidays behind each flag.
FLAGS = {
    "is_holiday": ("Holiday", "Transfer"),
    "is_event": ("Event",),
    "is_additional": ("Additional",),
    "is_bridge": ("Bridge",),
    "is_work_day": ("Work Day",),
}
LOCALES = ("Local", "National", "Other", "Regional")
#: Days of the mapped tables: training ends, the test's 16 days, the hold-out and the 112 days before it.
TRAIN_END = dt.date(2001, 7, 15)
TEST_START, TEST_END = dt.date(2001, 7, 16), dt.date(2001, 7, 31)
VALID_START, VALID_END = dt.date(2001, 6, 30), dt.date(2001, 7, 15)
FIT_START, FIT_END = dt.date(2001, 3, 10), dt.date(2001, 6, 29)
LOOKBACK, LOOKBACKS = 112, (112, 224)
FOLDS = [
    ("fold_1", dt.date(2001, 4, 7), dt.date(2001, 4, 22)),
    ("fold_2", dt.date(2001, 5, 5), dt.date(2001, 5, 20)),
    ("fold_3", dt.date(2001, 6, 2), dt.date(2001, 6, 17)),
    ("fold_4", dt.date(2001, 6, 30), dt.date(2001, 7, 15)),
]
#: Days of history that a series needs, and the series that series_sample draws.
HISTORY_NEEDED, MOST_SERIES = 7, 40

DAY = dt.timedelta(1)
KEYS = "date, store_nbr, item_nbr"
d = "DATE '{}'".format
lit = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else f"'{x}'"

NAMED: dict[str, str] = {
    "sales": """SELECT date, store_nbr, item_nbr, sum(q) AS unit_sales, CASE WHEN date >= DATE '1996-01-01' THEN max(p) END AS onpromotion
        FROM (SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_nationkey AS INTEGER) AS store_nbr, CAST(substr(p_brand, 7) AS INTEGER) AS item_nbr,
                CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN -l_quantity ELSE l_quantity END AS q, CAST(l_discount >= 0.08 AS INTEGER) AS p
              FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey) GROUP BY date, store_nbr, item_nbr""",
    "train": f"SELECT * FROM sales WHERE date <= {d(TRAIN_END)}",
    "test": f"SELECT row_number() OVER (ORDER BY date, store_nbr, item_nbr) AS id, {KEYS}, onpromotion FROM sales WHERE date > {d(TRAIN_END)} AND date <= {d(TEST_END)}",
    "stores": """SELECT CAST(n_nationkey AS INTEGER) AS store_nbr, n_name AS city, r_name AS state, substr('ABCDE', CAST(n_nationkey % 5 + 1 AS INTEGER), 1) AS type,
        CAST(n_nationkey % 7 AS INTEGER) AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "items": """SELECT item_nbr, 'FAM_' || (item_nbr % 5) AS family, CAST(item_nbr % 7 AS INTEGER) AS class, CAST(item_nbr % 4 = 0 AS INTEGER) AS perishable
        FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS item_nbr FROM part)""",
    "transactions": """SELECT CAST(o_orderdate AS DATE) AS date, CAST(c_nationkey AS INTEGER) AS store_nbr, count(*) AS transactions
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2""",
    "oil": """SELECT date, CASE WHEN day(date) % 10 <> 0 THEN price END AS dcoilwtico FROM (SELECT CAST(o_orderdate AS DATE) AS date,
        CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) / 1000 AS price FROM orders WHERE isodow(o_orderdate) < 6 GROUP BY 1)""",
    "holidays": "SELECT CAST(c0 AS DATE) AS date, c1 AS type, c2 AS locale, c3 AS locale_name, c4 AS transferred FROM (VALUES "
    + ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in HOLIDAYS) + ") AS v(c0, c1, c2, c3, c4)",
    "clean": f"SELECT {KEYS}, CASE WHEN unit_sales < 0 THEN 0 ELSE unit_sales END AS target, coalesce(onpromotion, 0) AS onpromotion FROM train",
    "universe": "SELECT DISTINCT store_nbr, item_nbr FROM test",
    "item_meta": """SELECT item_nbr, class, perishable, family, CAST(dense_rank() OVER (ORDER BY family) - 1 AS INTEGER) AS family_code,
        CAST(row_number() OVER (ORDER BY item_nbr) - 1 AS INTEGER) AS item_code FROM items""",
    "store_meta": """SELECT store_nbr, cluster, CAST(dense_rank() OVER (ORDER BY city) - 1 AS INTEGER) AS city_code, CAST(dense_rank() OVER (ORDER BY state) - 1 AS INTEGER) AS state_code,
        CAST(dense_rank() OVER (ORDER BY type) - 1 AS INTEGER) AS type_code, CAST(row_number() OVER (ORDER BY store_nbr) - 1 AS INTEGER) AS store_code FROM stores""",
    "daily": """SELECT date, sum(unit_sales) AS unit_sales, count(*) AS records, CAST(sum(coalesce(onpromotion, 0)) AS BIGINT) AS promotion_true_records, count(onpromotion) AS promotion_known_records,
        CAST(sum(CAST(unit_sales < 0 AS INTEGER)) AS BIGINT) AS negative_sales_records, sum(unit_sales) / count(*) AS avg_unit_sales_per_record,
        sum(coalesce(onpromotion, 0)) / nullif(count(onpromotion), 0) AS promotion_share_known FROM train GROUP BY date""",
    "family_totals": "SELECT family, sum(unit_sales) AS unit_sales, count(*) AS records FROM train JOIN items USING (item_nbr) GROUP BY family",
    "store_totals": "SELECT store_nbr, sum(unit_sales) AS unit_sales, count(*) AS records FROM train GROUP BY store_nbr",
}


def sql(statement: str) -> str:
    """The statement behind the subqueries that it needs."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in NAMED:
            if name not in used and re.search(rf"(?<![\w.'\"]){name}\b(?!\s*\()", text):
                used.append(name)
                need(NAMED[name])

    need(statement)
    order = [n for n in NAMED if n in used]
    return ("WITH " + ",\n".join(f"{n} AS ({NAMED[n]})" for n in order) + "\n" if order else "") + statement


CALENDAR = """CAST(isodow(date) - 1 AS INTEGER) AS weekday, CAST(day(date) AS INTEGER) AS day, CAST(month(date) AS INTEGER) AS month, CAST(weekofyear(date) AS INTEGER) AS weekofyear,
    CAST(date = last_day(date) AS INTEGER) AS is_month_end, CAST(day(date) = 15 OR date = last_day(date) AS INTEGER) AS is_payday"""
days = lambda a, b: f"(SELECT CAST(unnest(generate_series({d(a)}, {d(b)}, INTERVAL 1 DAY)) AS DATE) AS date)"
between = lambda a, b: f"(SELECT * FROM clean WHERE date BETWEEN {d(a)} AND {d(b)})"
panel = lambda a, b: f"(SELECT date, store_nbr, item_nbr FROM {days(a, b)}, universe)"
zero_filled = lambda a, b, observed="clean": f"(SELECT p.date, p.store_nbr, p.item_nbr, coalesce(o.target, 0) AS target, coalesce(o.onpromotion, 0) AS onpromotion FROM {panel(a, b)} p LEFT JOIN {observed} o USING ({KEYS}))"
zeros = lambda a, b: f"(SELECT {KEYS}, CAST(0 AS DOUBLE) AS target, CAST(0 AS INTEGER) AS onpromotion FROM {panel(a, b)} ANTI JOIN clean USING ({KEYS}))"
draw = lambda seed, *columns: f"md5(concat_ws('|', '{seed}', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + "))"
drawn_zeros = lambda a, b, n: f"(SELECT * FROM {zeros(a, b)} ORDER BY {draw(42, 'date', 'store_nbr', 'item_nbr')}, {KEYS} LIMIT {n})"


def oil(a: dt.date, b: dt.date) -> str:
    return f"""(SELECT date, coalesce(last_value(price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dcoilwtico
        FROM (SELECT g.date, min(o.dcoilwtico) AS price FROM {days(a, b)} g LEFT JOIN oil o USING (date) GROUP BY g.date))"""


def flags(a: dt.date, b: dt.date) -> str:
    cases = ", ".join(f"max(CAST(h.type IN ({', '.join(map(repr, types))}) AS INTEGER)) AS {f}" for f, types in FLAGS.items())
    return f"""(SELECT g.date, s.store_nbr, {', '.join(f'coalesce(f.{x}, 0) AS {x}' for x in FLAGS)} FROM {days(a, b)} g CROSS JOIN stores s LEFT JOIN
        (SELECT h.date, s.store_nbr, {cases} FROM holidays h JOIN stores s ON h.locale = 'National' OR (h.locale = 'Regional' AND h.locale_name = s.state)
            OR (h.locale NOT IN ('National', 'Regional') AND h.locale_name = s.city)
         WHERE NOT (h.type = 'Holiday' AND h.transferred) GROUP BY h.date, s.store_nbr) f ON f.date = g.date AND f.store_nbr = s.store_nbr)"""


def common(rows: str, a: dt.date, b: dt.date, transactions: bool = False) -> str:
    more = ", x.transactions" if transactions else ""
    join = "LEFT JOIN transactions x USING (date, store_nbr)" if transactions else ""
    return f"""(SELECT r.*, m.class, m.perishable, m.family, m.family_code, m.item_code,
        s.cluster, s.city_code, s.state_code, s.type_code, s.store_code, o.dcoilwtico, {', '.join(f'h.{x}' for x in FLAGS)}{more}
        FROM (SELECT *, {CALENDAR} FROM {rows}) r LEFT JOIN item_meta m USING (item_nbr) LEFT JOIN store_meta s USING (store_nbr)
        LEFT JOIN {oil(a, b)} o USING (date) LEFT JOIN {flags(a, b)} h USING (date, store_nbr) {join})"""


PRIOR = {"si_all": "store_nbr, item_nbr", "item_all": "item_nbr", "store_all": "store_nbr", "family_all": "family_code", "family_store_all": "family_code, store_nbr"}


def prior(name: str, cutoff: dt.date) -> str:
    return f"(SELECT {PRIOR[name]}, sum(target) / count(target) AS {name}_mean, ln(1.0 + count(*)) AS {name}_count_log FROM clean JOIN item_meta USING (item_nbr) WHERE date < {d(cutoff)} GROUP BY {PRIOR[name]})"


def recent(fit: str) -> dict[str, tuple[str, str]]:
    """keys and subquery of each statistic over fit, of which the windows end with its last day."""
    mean = "sum(target) / count(target)"
    within = lambda n: f"(SELECT * FROM {fit} WHERE date >= (SELECT max(date) FROM {fit}) - {n - 1})"
    table = lambda rows, keys, value: (keys, f"(SELECT {keys}, {value} FROM {rows} GROUP BY {keys})")
    pair = "store_nbr, item_nbr"
    return {
        "si_recent28": table(within(28), pair, f"{mean} AS si_recent28"),
        "si_recent56": table(within(56), pair, f"{mean} AS si_recent56"),
        "siw": table(fit, f"{pair}, weekday", f"{mean} AS siw_mean, ln(1.0 + count(*)) AS siw_count_log"),
        "fsw": table(fit, "family_code, store_nbr, weekday", f"{mean} AS fsw_mean"),
        "fw": table(fit, "family_code, weekday", f"{mean} AS fw_mean"),
        "item_recent": table(fit, "item_nbr", f"{mean} AS item_recent_mean"),
        "store_recent": table(fit, "store_nbr", f"{mean} AS store_recent_mean"),
    }


def stats(rows: str, fit: str, cutoff: dt.date, fill_from: str | None = None, fills: tuple[str, ...] = ("dcoilwtico",)) -> str:
    source = fill_from or rows
    joins = " ".join(f"LEFT JOIN {t} USING ({k})" for k, t in recent(fit).values()) + " " + " ".join(f"LEFT JOIN {prior(n, cutoff)} USING ({k})" for n, k in PRIOR.items())
    filled = [f"coalesce(CAST({c} AS DOUBLE), coalesce((SELECT median({c}) FROM {source}), 0)) AS {c}" for c in fills] + [f"coalesce({c}, 0) AS {c}" for c in STATS]
    return f"(SELECT * REPLACE ({', '.join(filled)}) FROM {rows} {joins})"


def derive(rows: str) -> str:
    return f"""(SELECT *, CAST(weekday IN (5, 6) AS INTEGER) AS is_weekend, fsw_mean - fw_mean AS promo_family_gap, family_store_all_mean - store_all_mean AS promo_store_gap,
        si_recent28 - si_recent56 AS recent_trend_28_56, si_recent28 / (si_recent56 + 1.0) AS recent_ratio_28_56, item_all_mean / (family_all_mean + 1.0) AS item_vs_family_ratio,
        family_store_all_mean / (store_all_mean + 1.0) AS family_store_vs_store_ratio, item_recent_mean - item_all_mean AS item_recent_delta,
        store_recent_mean - store_all_mean AS store_recent_delta, si_all_count_log + item_all_count_log + family_store_all_count_log AS history_strength FROM {rows})"""


def cascade(rows: str, fit: str, levels: tuple, overall: str, prediction: str, source: str, recent_fit: str = "", by: tuple[str, ...] = ()) -> str:
    joins, means, names = "", [], []
    for i, level in enumerate(levels):
        keys = ", ".join((*by, *level.keys))
        table = recent_fit if recent_fit and "recent" in level.source else fit
        joins += f" LEFT JOIN (SELECT {keys}, CASE WHEN count(*) >= {level.least} THEN sum(target) / nullif(count(target), 0) END AS m{i} FROM {table} GROUP BY {keys}) USING ({keys})"
        means.append(f"m{i}")
        names.append(f"CASE WHEN m{i} IS NOT NULL THEN '{level.source}' END")
    best = f"coalesce({', '.join(means)}, {overall})"
    return f"(SELECT * EXCLUDE ({', '.join(means)}), CASE WHEN {best} < 0 THEN 0 ELSE {best} END AS {prediction}, coalesce({', '.join(names)}, 'global_mean') AS {source} FROM {rows}{joins})"


def fallback(rows: str, fit: str) -> str:
    return cascade(rows, fit, FALLBACK, f"(SELECT sum(target) / count(target) FROM {fit})", "fallback_prediction", "fallback_source")


def long_table(level, table: str, target: str = "target") -> str:
    key = " || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in level.keys)
    return f"SELECT '{level.source}' AS source, {key} AS key, sum({target}) AS sum, count(*) AS count, sum({target}) / count({target}) AS mean FROM {table} GROUP BY {', '.join(level.keys)}"


def shown(rows: str, *columns: str, where: str = "") -> str:
    return f"SELECT {', '.join(f'round({c}, 6) AS {c}' if c in ROUNDED else c for c in columns)} FROM {rows} {where}"


def rounded(statement: str, *columns: str) -> str:
    return f"SELECT * REPLACE ({', '.join(f'round({c}, 6) AS {c}' for c in columns)}) FROM ({statement})"


WEIGHT = "CASE WHEN perishable = 1 THEN 1.25 ELSE 1.0 END"
NO_NEGATIVE = "ln(1.0 + CASE WHEN {0} < 0 THEN 0 ELSE {0} END)".format


def rmsle(actual: str, predicted: str, weight: str) -> str:
    e = f"({NO_NEGATIVE(predicted)} - {NO_NEGATIVE(actual)})"
    return f"sqrt(sum({weight} * {e} * {e}) / sum(CASE WHEN {e} IS NOT NULL THEN {weight} END))"


def index(start: dt.date) -> str:
    return f"ln(1.0 + target) AS target_log, CAST(date - {d(start)} AS INTEGER) AS time_idx, CAST(store_nbr AS BIGINT) * 10000000 + item_nbr AS series_id"


FINAL_START = TRAIN_END - LOOKBACK * DAY
FEATURE_KEYS = ("date", "store_nbr", "item_nbr")
NAMED |= {
    "b_rows": f"SELECT r.*, {CALENDAR}, m.family, m.family_code, m.class, m.perishable, CAST({WEIGHT} AS DOUBLE) AS weight FROM {between(FIT_START, VALID_END)} r LEFT JOIN item_meta m USING (item_nbr)",
    "b_fit": f"SELECT * FROM b_rows WHERE date < {d(VALID_START)}",
    "b_recent": f"SELECT * FROM b_fit WHERE date >= {d(VALID_START - 28 * DAY)}",
    "b_valid": f"SELECT * EXCLUDE (target), target AS actual FROM b_rows WHERE date >= {d(VALID_START)}",
    "b_hier": "SELECT * FROM " + cascade("b_valid", "b_fit", HIERARCHICAL, "(SELECT sum(target) / count(*) FROM b_fit)", "prediction", "source"),
    "b_mean": "SELECT * FROM " + cascade("b_valid", "b_fit", RECENT, "(SELECT sum(target) / count(*) FROM b_fit)", "prediction", "source", "b_recent"),
    "v_common": "SELECT * FROM " + common(between(FIT_START, VALID_END), FIT_START, VALID_END),
    "v_fit": f"SELECT * FROM v_common WHERE date < {d(VALID_START)}",
    "p_fit": "SELECT * FROM " + common(between(FIT_START, FIT_END), FIT_START, FIT_END),
    "p_panel": "SELECT * FROM " + common(zero_filled(VALID_START, VALID_END), VALID_START, VALID_END),
    "p_stats": "SELECT * FROM " + derive(stats("p_panel", "p_fit", VALID_START)),
    "p_horizon": "SELECT *, CAST(item_all_count_log = 0 AS INTEGER) AS unseen_item_flag FROM " + fallback("p_stats", "p_fit"),
    "x_fit": "SELECT * FROM " + common(between(TRAIN_END - LOOKBACK * DAY, TRAIN_END), TRAIN_END - LOOKBACK * DAY, TRAIN_END),
    "x_rows": f"SELECT id, {KEYS}, coalesce(onpromotion, 0) AS onpromotion FROM test",
    "x_common": "SELECT * FROM " + common("x_rows", TEST_START, TEST_END),
    "x_stats": "SELECT * FROM " + derive(stats("x_common", "x_fit", TEST_START)),
    "x_frame": "SELECT *, CAST(item_all_count_log = 0 AS INTEGER) AS unseen_item_flag FROM " + fallback("x_stats", "x_fit"),
    "s_seen": f"SELECT {KEYS}, target, onpromotion FROM {between(FIT_START, VALID_END)} SEMI JOIN universe USING (store_nbr, item_nbr)",
    "s_fit": f"SELECT *, ln(1.0 + target) AS target_log, CAST(date - {d(FIT_START)} AS INTEGER) AS time_idx, CAST(store_nbr AS BIGINT) * 10000000 + item_nbr AS series_id FROM "
    + common(f"(SELECT * FROM s_seen WHERE date < {d(VALID_START)})", FIT_START, FIT_END),
    "s_panel": f"SELECT *, ln(1.0 + target) AS target_log, CAST(date - {d(FIT_START)} AS INTEGER) AS time_idx, CAST(store_nbr AS BIGINT) * 10000000 + item_nbr AS series_id FROM "
    + common(zero_filled(VALID_START, VALID_END, "s_seen"), VALID_START, VALID_END),
    "s_flags": f"""SELECT p.store_nbr, p.item_nbr, p.series_id, CAST(coalesce(h.n, 0) AS INTEGER) AS history_points, CAST(i.item_nbr IS NULL AS INTEGER) AS unseen_item_flag,
        CAST(coalesce(h.n, 0) >= {HISTORY_NEEDED} AS INTEGER) AS enough_history_flag
        FROM (SELECT DISTINCT store_nbr, item_nbr, series_id FROM s_panel) p LEFT JOIN (SELECT series_id, count(*) AS n FROM s_fit GROUP BY series_id) h USING (series_id)
        LEFT JOIN (SELECT DISTINCT item_nbr FROM clean WHERE date < {d(VALID_START)}) i USING (item_nbr)""",
    "s_series": "SELECT *, CAST(enough_history_flag = 1 AND unseen_item_flag = 0 AS INTEGER) AS is_tft_eligible, CAST(0 AS INTEGER) AS sampled_out_flag FROM s_flags",
    "s_drawn": f"""SELECT * EXCLUDE (good, place), CAST(good AND place <= {MOST_SERIES} AS INTEGER) AS is_tft_eligible, CAST(good AND place > {MOST_SERIES} AS INTEGER) AS sampled_out_flag
        FROM (SELECT *, row_number() OVER (PARTITION BY good ORDER BY {draw(42, 'series_id')}, series_id) AS place FROM (SELECT *, enough_history_flag = 1 AND unseen_item_flag = 0 AS good FROM s_flags))""",
    "s_horizon": "SELECT h.*, s.history_points, s.is_tft_eligible, s.unseen_item_flag, s.sampled_out_flag FROM " + fallback("s_panel", "s_fit") + " h LEFT JOIN s_series s USING (store_nbr, item_nbr, series_id)",
    "s_model": f"""SELECT h.*, CASE WHEN h.is_tft_eligible = 1 THEN coalesce(m.mean, 0) END AS tft_raw_prediction FROM s_horizon h
        LEFT JOIN (SELECT store_nbr, item_nbr, sum(target) / count(target) AS mean FROM {between(VALID_START - 28 * DAY, FIT_END)} GROUP BY store_nbr, item_nbr) m USING (store_nbr, item_nbr)""",
    "y_fit": f"SELECT *, {index(FINAL_START)} FROM " + common(f"(SELECT * FROM {between(FINAL_START, TRAIN_END)} SEMI JOIN universe USING (store_nbr, item_nbr))", FINAL_START, TRAIN_END),
    "y_test": f"SELECT *, {index(FINAL_START)} FROM " + common("(SELECT *, CAST(0 AS DOUBLE) AS target FROM x_rows)", TEST_START, TEST_END),
    "y_flags": f"""SELECT p.store_nbr, p.item_nbr, CAST(coalesce(h.n, 0) AS INTEGER) AS history_points, CAST(i.item_nbr IS NULL AS INTEGER) AS unseen_item_flag
        FROM universe p LEFT JOIN (SELECT store_nbr, item_nbr, count(*) AS n FROM y_fit GROUP BY ALL) h USING (store_nbr, item_nbr)
        LEFT JOIN (SELECT DISTINCT item_nbr FROM clean WHERE date < {d(TEST_START)}) i USING (item_nbr)""",
    "y_horizon": f"""SELECT h.*, f.history_points, f.unseen_item_flag, CAST(f.history_points >= {HISTORY_NEEDED} AND f.unseen_item_flag = 0 AS INTEGER) AS is_tft_eligible, CAST(0 AS INTEGER) AS sampled_out_flag
        FROM {fallback('y_test', 'y_fit')} h LEFT JOIN y_flags f USING (store_nbr, item_nbr)""",
    "h_rows": f"""SELECT v.date, v.target AS actual, v.siw_mean AS model_prediction, CAST({WEIGHT} AS DOUBLE) AS weight, a.prediction AS recent_mean_prediction, b.prediction AS hierarchical_prediction
        FROM {stats('v_common', 'v_fit', VALID_START, 'v_fit')} v JOIN b_mean a USING ({KEYS}) JOIN b_hier b USING ({KEYS})""".replace(WEIGHT, WEIGHT.replace("perishable", "v.perishable")),
    "s_routed": """SELECT *, CASE WHEN y < 0 THEN 0 ELSE y END AS final_prediction, CAST(NOT use_model AS INTEGER) AS used_fallback FROM (SELECT *, is_tft_eligible = 1 AND tft_raw_prediction IS NOT NULL AS use_model,
        CASE WHEN is_tft_eligible = 1 AND tft_raw_prediction IS NOT NULL THEN tft_raw_prediction ELSE fallback_prediction END AS y FROM s_model)""",
}

EXTERNAL = f"""SELECT y.date, y.unit_sales, y.records, CASE WHEN count(unit_sales) OVER w >= 7 THEN sum(unit_sales) OVER w / count(unit_sales) OVER w END AS rolling_28d, dayname(y.date) AS weekday,
    substr(monthname(y.date), 1, 3) AS month, day(y.date) = 15 OR y.date = last_day(y.date) AS is_payday, CAST(x.transactions AS BIGINT) AS transactions, o.dcoilwtico
    FROM daily y LEFT JOIN (SELECT date, sum(transactions) AS transactions FROM transactions GROUP BY date) x USING (date)
    LEFT JOIN (SELECT date, coalesce(last_value(price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dcoilwtico FROM (SELECT g.date, min(dcoilwtico) AS price
        FROM (SELECT CAST(unnest(generate_series((SELECT min(date) FROM train), (SELECT max(date) FROM train), INTERVAL 1 DAY)) AS DATE) AS date) g LEFT JOIN oil USING (date) GROUP BY g.date)) o USING (date)
    WINDOW w AS (ORDER BY y.date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)"""
NAMED["external"] = EXTERNAL


def missing(name: str, table: str, columns: list[str], dated: bool) -> str:
    dates = "min(date) AS date_min, max(date) AS date_max" if dated else "CAST(NULL AS DATE) AS date_min, CAST(NULL AS DATE) AS date_max"
    nulls = " + ".join(f"(count(*) - count({c})) / count(*)" for c in columns)
    return f"SELECT '{name}' AS table_name, count(*) AS rows, CAST({len(columns)} AS INTEGER) AS cols, {dates}, round(({nulls}) / {len(columns)}, 6) AS missing_share FROM {table}"


NAMED["settings"] = "SELECT fold, CAST(lookback AS INTEGER) AS lookback, CAST(a AS DATE) AS fit_start, CAST(b AS DATE) AS valid_start, CAST(c AS DATE) AS valid_end FROM (VALUES " + ", ".join(f"('{f}', {n}, '{s - n * DAY}', '{s}', '{e}')" for f, s, e in FOLDS for n in LOOKBACKS) + ") AS v(fold, lookback, a, b, c)"
NAMED["c_rows"] = f"SELECT r.*, {CALENDAR}, m.family_code, m.class, m.perishable FROM clean r LEFT JOIN item_meta m USING (item_nbr)"
NAMED["c_fit"] = "SELECT r.*, s.fold, s.lookback FROM c_rows r JOIN settings s ON r.date >= s.fit_start AND r.date < s.valid_start"
NAMED["c_valid"] = "SELECT r.*, s.fold, s.lookback FROM c_rows r JOIN settings s ON r.date BETWEEN s.valid_start AND s.valid_end"
NAMED["c_all"] = "SELECT fold, lookback, sum(target) / count(target) AS overall FROM c_fit GROUP BY fold, lookback"
NAMED["cv"] = f"SELECT fold, lookback, count(*) AS rows, {rmsle('target', 'fallback_prediction', WEIGHT)} AS weighted_rmsle, sum(target) / count(target) AS mean_actual FROM " + cascade(
    "(SELECT v.*, a.overall FROM c_valid v LEFT JOIN c_all a USING (fold, lookback))", "c_fit", FALLBACK, "overall", "fallback_prediction", "fallback_source", by=("fold", "lookback")
) + " GROUP BY fold, lookback"

LATE = FOLDS[2][1]
LATE_ROWS = common(between(LATE - LOOKBACK * DAY, LATE + 15 * DAY), LATE - LOOKBACK * DAY, LATE + 15 * DAY, True)
NAMED["l_common"] = f"SELECT * FROM {LATE_ROWS}"
NAMED["l_fit"] = f"SELECT * FROM l_common WHERE date < {d(LATE)}"

NAMED["g_rows"] = f"SELECT r.*, {CALENDAR} FROM {between(FIT_START, VALID_END)} r"
span = "(SELECT {}(date) FROM g_rows)".format
NAMED["g_oil"] = f"""SELECT date, coalesce(last_value(price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(price IGNORE NULLS) OVER (ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS dcoilwtico FROM (SELECT g.date, min(dcoilwtico) AS price
    FROM (SELECT CAST(unnest(generate_series({span('min')}, {span('max')}, INTERVAL 1 DAY)) AS DATE) AS date) g LEFT JOIN oil USING (date) GROUP BY g.date)"""
NAMED["g_all"] = f"""SELECT r.*, CASE WHEN r.date < {d(VALID_START)} THEN 'fit' ELSE 'valid' END AS part, m.class, m.perishable, m.family_code, s.cluster, s.city_code, s.state_code, s.type_code,
    CAST(dense_rank() OVER (ORDER BY r.store_nbr) - 1 AS INTEGER) AS store_code, CAST(dense_rank() OVER (ORDER BY r.item_nbr) - 1 AS INTEGER) AS item_code,
    coalesce(CAST(x.transactions AS DOUBLE), (SELECT median(transactions) FROM transactions)) AS transactions, coalesce(o.dcoilwtico, (SELECT median(dcoilwtico) FROM g_oil)) AS dcoilwtico,
    {', '.join(f'h.{x}' for x in FLAGS)} FROM g_rows r LEFT JOIN item_meta m USING (item_nbr) LEFT JOIN store_meta s USING (store_nbr) LEFT JOIN transactions x USING (date, store_nbr)
    LEFT JOIN g_oil o USING (date) LEFT JOIN {flags(FIT_START, VALID_END)} h USING (date, store_nbr)"""
NAMED["g_fit"] = "SELECT * FROM g_all WHERE part = 'fit'"
LEGACY_TABLES = [
    ("store_nbr, item_nbr", f"(SELECT * FROM g_fit WHERE date >= {d(VALID_START - 28 * DAY)})", "si_recent28"), ("store_nbr, item_nbr, weekday", "g_fit", "siw_mean"),
    ("family_code, store_nbr, weekday", "g_fit", "fsw_mean"), ("family_code, weekday", "g_fit", "fw_mean"), ("item_nbr", "g_fit", "item_mean"), ("store_nbr", "g_fit", "store_mean"),
]
LEGACY_JOINS = " ".join(f"LEFT JOIN (SELECT {k}, sum(target) / count(target) AS {n} FROM {t} GROUP BY {k}) USING ({k})" for k, t, n in LEGACY_TABLES)

EDA_SHARES = "unit_sales / records AS avg_unit_sales_per_record, unit_sales / sum(unit_sales) OVER () AS sales_share"
FIT_TABLE = f"(SELECT r.*, {CALENDAR}, m.family_code, m.class FROM {between(FIT_START, FIT_END)} r LEFT JOIN item_meta m USING (item_nbr))"
NAMED["f_fit"] = f"SELECT * FROM {FIT_TABLE}"
RECENT_LONG = " UNION ALL ".join(
    f"SELECT '{value}' AS statistic, {key} AS key, {f'round({value}, 6)' if value in ROUNDED else value} AS value FROM {table}"
    for (keys, table), values in zip(recent("f_fit").values(), (["si_recent28"], ["si_recent56"], ["siw_mean", "siw_count_log"], ["fsw_mean"], ["fw_mean"], ["item_recent_mean"], ["store_recent_mean"]), strict=True)
    for key in [" || '|' || ".join(f"CAST({k} AS VARCHAR)" for k in keys.split(", "))]
    for value in values
)
PIPE = " || '|' || "
PRIOR_LONG = " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, {PIPE.join(f'CAST({k} AS VARCHAR)' for k in keys.split(', '))} AS key, {n}_mean AS mean, round({n}_count_log, 6) AS count_log FROM {prior(n, VALID_START)}" for n, keys in PRIOR.items()
)
SAMPLE_ORDER = f"date >= (SELECT max(date) FROM {{0}}) - 27 DESC, {draw(42, 'date', 'store_nbr', 'item_nbr')}, {KEYS}"
FIT_ROWS = between(FIT_START, FIT_END)
NAMED["z_common"] = "SELECT * FROM " + common(drawn_zeros(VALID_START - 28 * DAY, FIT_END, 200), VALID_START - 28 * DAY, FIT_END)
NAMED["z_fit"] = f"SELECT * FROM p_fit ORDER BY {SAMPLE_ORDER.format('p_fit')} LIMIT 1500"
CORRELATED = ("unit_sales", "transactions", "dcoilwtico")

ORACLES: dict[str, str] = {
    name: sql(statement)
    for name, statement in {
        "eda_overview": """SELECT count(*) AS rows, min(date) AS date_min, max(date) AS date_max, count(DISTINCT date) AS n_days, count(DISTINCT store_nbr) AS unique_stores, count(DISTINCT item_nbr) AS unique_items,
            sum(CAST(onpromotion IS NULL AS INTEGER)) / count(*) AS missing_onpromotion_rate, sum(CAST(unit_sales < 0 AS INTEGER)) / count(*) AS negative_sales_rate,
            sum(CAST(unit_sales > 0 AS INTEGER)) / count(*) AS positive_sales_rate, sum(unit_sales) AS total_unit_sales FROM train""",
        "eda_daily_sales": "SELECT * FROM daily",
        "eda_family_sales": f"SELECT *, {EDA_SHARES} FROM family_totals",
        "eda_store_sales": f"SELECT * FROM (SELECT *, {EDA_SHARES} FROM store_totals) LEFT JOIN stores USING (store_nbr)",
        "eda_promotion_summary": """SELECT onpromotion, records, unit_sales, records / nullif(sum(records) OVER (), 0) AS record_share_known, unit_sales / nullif(records, 0) AS avg_unit_sales_per_record
            FROM (SELECT f.onpromotion, count(t.onpromotion) AS records, coalesce(sum(t.unit_sales), 0) AS unit_sales FROM (VALUES (CAST(0 AS INTEGER)), (CAST(1 AS INTEGER))) AS f(onpromotion) LEFT JOIN train t USING (onpromotion) GROUP BY f.onpromotion)""",
        "top_families": "SELECT family, unit_sales, unit_sales / 1000000 AS unit_sales_mn FROM family_totals ORDER BY unit_sales DESC, family LIMIT 12",
        "top_stores": f"SELECT store_nbr, city, state, type, cluster, unit_sales, sales_share FROM (SELECT *, {EDA_SHARES} FROM store_totals) LEFT JOIN stores USING (store_nbr) ORDER BY unit_sales DESC, store_nbr LIMIT 10",
        "missing_share": " UNION ALL ".join([
            missing("stores", "stores", ["store_nbr", "city", "state", "type", "cluster"], False), missing("items", "items", ["item_nbr", "family", "class", "perishable"], False),
            missing("transactions", "transactions", ["date", "store_nbr", "transactions"], True), missing("oil", "oil", ["date", "dcoilwtico"], True),
            missing("holidays_events", "holidays", ["date", "type", "locale", "locale_name", "transferred"], True), missing("test", "test", ["date", "store_nbr", "item_nbr", "onpromotion"], True),
        ]),
        "test_coverage": """SELECT count(*) AS test_rows, min(date) AS test_start, max(date) AS test_end, count(DISTINCT item_nbr) AS test_unique_items, count(DISTINCT store_nbr) AS test_unique_stores,
            (SELECT count(*) FROM (SELECT item_nbr FROM test EXCEPT SELECT item_nbr FROM train)) AS new_items_in_test, (SELECT count(*) FROM (SELECT store_nbr FROM test EXCEPT SELECT store_nbr FROM train)) AS new_stores_in_test FROM test""",
        "rolling_28d": "SELECT date, unit_sales, rolling_28d FROM external",
        "daily_external_frame": "SELECT * FROM external",
        "weekday_profile": "SELECT dayname(date) AS weekday, sum(unit_sales) / count(*) AS unit_sales FROM daily GROUP BY 1",
        "payday_profile": "SELECT CASE WHEN day(date) = 15 OR date = last_day(date) THEN '15th or month-end' ELSE 'regular day' END AS bucket, sum(unit_sales) / count(*) AS unit_sales FROM daily GROUP BY 1",
        "driver_correlation": " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS correlation FROM external" for a in CORRELATED for b in CORRELATED),
        "zscore_daily": """SELECT date, round((unit_sales - avg(unit_sales) OVER ()) / stddev_samp(unit_sales) OVER (), 6) AS z_unit_sales, round((dcoilwtico - avg(dcoilwtico) OVER ()) / stddev_samp(dcoilwtico) OVER (), 6) AS z_dcoilwtico
            FROM external WHERE unit_sales IS NOT NULL AND dcoilwtico IS NOT NULL""",
        "holiday_pivot": "SELECT type, " + ", ".join(f'count(*) FILTER (locale = \'{x}\') AS "{x}"' for x in LOCALES) + " FROM holidays GROUP BY type",
        "transferred_holidays": "SELECT * FROM holidays WHERE transferred ORDER BY date, type, locale_name LIMIT 10",
        "store_type_counts": "SELECT type, count(*) AS stores FROM stores GROUP BY type",
        "family_item_counts": "SELECT family, count(*) AS item_count FROM items GROUP BY family ORDER BY item_count DESC, family LIMIT 12",
        "perishable_share": "SELECT sum(1 - perishable) / count(*) AS non_perishable, sum(perishable) / count(*) AS perishable FROM items",
        "calendar_features": f"SELECT date, {CALENDAR} FROM (SELECT DISTINCT date FROM train)",
        "metadata_codes": """SELECT 'store' AS entity, store_nbr AS key, store_code, city_code, state_code, type_code, CAST(NULL AS INTEGER) AS item_code, CAST(NULL AS INTEGER) AS family_code FROM store_meta
            UNION ALL SELECT 'item', item_nbr, NULL, NULL, NULL, NULL, item_code, family_code FROM item_meta""",
        "dim_enrich": f"SELECT {KEYS}, target, onpromotion, family, CAST({WEIGHT} AS DOUBLE) AS weight, {', '.join(CODES)} FROM {between(FIT_START, VALID_END)} LEFT JOIN item_meta USING (item_nbr) LEFT JOIN store_meta USING (store_nbr)",
        "transactions_join": f"SELECT {KEYS}, target, transactions FROM {between(VALID_START, VALID_END)} LEFT JOIN transactions USING (date, store_nbr)",
        "oil_dense": f"SELECT * FROM {oil(dt.date(2001, 6, 10), VALID_END)}",
        "oil_join": f"SELECT {KEYS}, target, dcoilwtico FROM {between(VALID_START, VALID_END)} LEFT JOIN {oil(VALID_START, VALID_END)} USING (date)",
        "holiday_flags": f"SELECT * FROM {flags(dt.date(2001, 2, 1), TEST_END)}",
        "pair_universe": "SELECT * FROM universe",
        "dense_panel": f"SELECT * FROM {panel(VALID_START, VALID_END)}",
        "zero_filled_panel": f"SELECT * FROM {zero_filled(VALID_START, VALID_END)}",
        "implicit_zeros": f"SELECT * FROM {zeros(VALID_START - 28 * DAY, FIT_END)}",
        "zero_row_sample": f"SELECT * FROM {drawn_zeros(VALID_START - 28 * DAY, FIT_END, 200)}",
        "recent_biased_sample": f"SELECT * FROM {FIT_ROWS} ORDER BY {SAMPLE_ORDER.format(FIT_ROWS)} LIMIT 1500",
        "train_plus_zero_rows": f"SELECT * FROM {FIT_ROWS} UNION ALL SELECT * FROM {drawn_zeros(VALID_START - 28 * DAY, FIT_END, 200)}",
        "pair_universe_semi": f"SELECT * FROM {between(FIT_START, VALID_END)} SEMI JOIN universe USING (store_nbr, item_nbr)",
        "baseline_lookup_tables": " UNION ALL ".join([*(long_table(x, "b_recent") for x in RECENT[:2]), *(long_table(x, "b_fit") for x in HIERARCHICAL)]),
        "baseline_valid_frame": f"SELECT {', '.join(BASELINE)} FROM b_valid",
        "recent_mean_baseline": f"SELECT {', '.join(BASELINE)}, prediction, source FROM b_mean",
        "hierarchical_baseline": f"SELECT {', '.join(BASELINE)}, prediction, source FROM b_hier",
        "baseline_scores": rounded(" UNION ALL ".join(f"SELECT '{n}' AS baseline, {rmsle('actual', 'prediction', 'weight')} AS weighted_rmsle, sum(prediction) / count(prediction) AS mean_prediction, sum(actual) / count(actual) AS mean_actual FROM {t}" for n, t in (("recent_mean_28d", "b_mean"), ("hierarchical_weekday_promo", "b_hier"))), "weighted_rmsle", "mean_prediction", "mean_actual"),
        "weighted_rmsle": f"SELECT round({rmsle('actual', 'prediction', 'weight')}, 6) AS weighted_rmsle FROM b_hier",
        "baseline_daily_compare": "SELECT date, actual, round(hierarchical_prediction, 6) AS hierarchical_prediction, round(recent_mean_prediction, 6) AS recent_mean_prediction FROM (SELECT date, sum(actual) AS actual, sum(prediction) AS hierarchical_prediction FROM b_hier GROUP BY date) LEFT JOIN (SELECT date, sum(prediction) AS recent_mean_prediction FROM b_mean GROUP BY date) USING (date)",
        "fallback_source_mix": "SELECT source, count(*) / sum(count(*)) OVER () AS row_share FROM b_hier GROUP BY source",
        "fallback_tables": " UNION ALL ".join(long_table(x, "f_fit") for x in FALLBACK),
        "hierarchical_fallback": f"SELECT {KEYS}, target, fallback_prediction, fallback_source FROM " + fallback(f"(SELECT * FROM b_rows WHERE date >= {d(VALID_START)})", "f_fit"),
        "prior_aggregates": PRIOR_LONG,
        "recent_window_stats": f"SELECT * FROM ({RECENT_LONG}) WHERE value IS NOT NULL",
        "feature_matrix": shown(f"(SELECT *, CASE WHEN date < {d(VALID_START)} THEN 'fit' ELSE 'valid' END AS part FROM {stats('v_common', 'v_fit', VALID_START, 'v_fit')})", *FEATURE_KEYS, "part", "target", *FEATURES),
        "fold_features_observed": shown(stats("l_common", "l_fit", LATE, "l_fit", ("dcoilwtico", "transactions")), *FEATURE_KEYS, "target", *FEATURES, "transactions", where=f"WHERE date >= {d(LATE)}"),
        "fold_features_panel": shown("p_horizon", *FEATURE_KEYS, "target", *FEATURES, "fallback_prediction", "fallback_source", "unseen_item_flag"),
        "derived_features": shown("p_horizon", *FEATURE_KEYS, *DERIVED),
        "sampled_fit_features": shown(stats("z_fit", "p_fit", VALID_START), *FEATURE_KEYS, "target", *FEATURES) + " UNION ALL " + shown(stats("z_common", "p_fit", VALID_START), *FEATURE_KEYS, "target", *FEATURES),
        "test_features": shown("x_frame", "id", *FEATURE_KEYS, *FEATURES, *DERIVED, "fallback_prediction", "fallback_source", "unseen_item_flag"),
        "legacy_feature_frame": shown(f"(SELECT * REPLACE ({', '.join(f'coalesce({c}, 0) AS {c}' for c in LEGACY_STATS)}) FROM g_all {LEGACY_JOINS})", *FEATURE_KEYS, "part", "target", *LEGACY),
        "tft_fold_frame": shown("s_horizon", *FEATURE_KEYS, "target", "target_log", "time_idx", "series_id", *CODES, *KNOWN, "dcoilwtico", *FLAGS, "fallback_prediction", "fallback_source", *SERIES_FLAGS),
        "tft_fit_frame": shown("(SELECT * FROM s_fit SEMI JOIN (SELECT * FROM s_series WHERE is_tft_eligible = 1) USING (store_nbr, item_nbr))", *FEATURE_KEYS, "target", "target_log", "time_idx", "series_id"),
        "series_index": f"SELECT {KEYS}, CAST(date - {d(FIT_START)} AS INTEGER) AS time_idx, CAST(store_nbr AS BIGINT) * 10000000 + item_nbr AS series_id FROM {between(FIT_START, VALID_END)}",
        "series_eligibility": "SELECT * FROM s_series",
        "series_sample": "SELECT * FROM s_drawn",
        "eligibility_summary": """SELECT count(*) AS total_pairs, count(*) FILTER (is_tft_eligible = 1) AS eligible_pairs, count(*) FILTER (is_tft_eligible = 0) AS fallback_pairs, count(*) FILTER (unseen_item_flag = 1) AS unseen_item_pairs,
            count(*) FILTER (enough_history_flag = 0) AS insufficient_history_pairs, count(*) FILTER (sampled_out_flag = 1) AS sampled_out_pairs FROM s_series""",
        "routed_prediction": f"SELECT {KEYS}, tft_raw_prediction, fallback_prediction, fallback_source, final_prediction, used_fallback FROM s_routed",
        "routing_shares": "SELECT date, sum(used_fallback) / count(*) AS fallback_share, sum(is_tft_eligible) / count(*) AS eligible_share, sum(unseen_item_flag) / count(*) AS unseen_item_share FROM s_routed GROUP BY date",
        "daily_validation": "SELECT date, " + ", ".join(f"round(coalesce(sum({c}), 0), 6) AS {c}" for c in ("target", "final_prediction", "fallback_prediction", "tft_raw_prediction")) + " FROM s_routed GROUP BY date",
        "blended_prediction": f"""SELECT {KEYS}, round(w, 6) AS model_weight, round(CASE WHEN y < 0 THEN 0 ELSE y END, 6) AS blended FROM (SELECT *, w * si_recent28 + (1.0 - w) * fallback_prediction AS y FROM (SELECT *,
            CASE WHEN item_all_count_log <= 0 THEN 0.2 ELSE 0.85 + CAST(0.15 AS DOUBLE) * CASE WHEN item_all_count_log / 3.0 > 1 THEN 1.0 ELSE item_all_count_log / 3.0 END END AS w FROM p_horizon))""",
        "unseen_summary": "SELECT unseen_item_flag, count(*) AS rows, round(sum(fallback_prediction) / count(fallback_prediction), 6) AS mean_prediction FROM x_frame GROUP BY unseen_item_flag",
        "tft_test_frame": shown("y_horizon", "id", *FEATURE_KEYS, "target_log", "time_idx", "series_id", *CODES, *KNOWN, "dcoilwtico", *FLAGS, "fallback_prediction", "fallback_source", *SERIES_FLAGS),
        "fallback_only_forecast": f"SELECT id, {KEYS}, fallback_source, fallback_prediction AS final_prediction, CAST(1 AS INTEGER) AS used_fallback FROM y_horizon",
        "category_vocabulary": " UNION ".join(
            f"SELECT '{c}' AS column_name, coalesce(CAST({c} AS VARCHAR), '0') AS value FROM {rows}"
            for c in CATEGORIES for rows in ("(SELECT * FROM s_fit SEMI JOIN (SELECT * FROM s_series WHERE is_tft_eligible = 1) USING (store_nbr, item_nbr))", "s_panel")
        ) + " UNION " + " UNION ".join(f"SELECT '{c}', '0'" for c in CATEGORIES),
        "holdout_scores": " UNION ALL ".join(f"SELECT '{n}' AS model, round({rmsle('actual', c, 'weight')}, 6) AS weighted_rmsle FROM h_rows" for n, c in HOLDOUT.items()),
        "holdout_daily": "SELECT date, sum(actual) AS actual, " + ", ".join(f"round(sum({c}), 6) AS {c}" for c in HOLDOUT.values()) + " FROM h_rows GROUP BY date",
        "unpivot_horizon": "SELECT series_id, time_idx, fallback_prediction AS prediction FROM s_horizon WHERE is_tft_eligible = 1",
        "rolling_folds": "SELECT DISTINCT fold, valid_start, valid_end FROM settings",
        "cv_scores": rounded("SELECT * FROM cv", "weighted_rmsle", "mean_actual"),
        "cv_summary": "SELECT lookback, round(avg(weighted_rmsle), 6) AS mean_score, round(stddev_samp(weighted_rmsle), 6) AS std_score, round(min(weighted_rmsle), 6) AS min_score, round(max(weighted_rmsle), 6) AS max_score FROM cv GROUP BY lookback",
        "submission_consistency": """SELECT count(*) AS submission_rows, count(*) AS prediction_rows, true AS same_row_count, count(*) - count(DISTINCT id) AS submission_duplicate_ids, count(*) - count(DISTINCT id) AS prediction_duplicate_ids,
            CAST(0 AS BIGINT) AS id_set_mismatch_count, round(sum(fallback_prediction) / count(*), 6) AS mean_unit_sales_submission, round(sum(fallback_prediction) / count(*), 6) AS mean_final_prediction FROM x_frame""",
    }.items()
}
