"""The retail tables: typed readers of the original files, and the same tables mapped from a TPC-H-like schema."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.functions.columns import clip0, promo_flag
from gondola.sources.files import cached, checkpoint_folder, stamp

TRAIN_END = dt.date(2001, 7, 15)
TEST_END = dt.date(2001, 7, 31)

#: The holidays of the mapped tables.
HOLIDAYS = [
    ("2001-02-01", "Holiday", "National", "Nation", False),
    ("2001-03-14", "Holiday", "National", "Nation", True),
    ("2001-03-16", "Transfer", "National", "Nation", False),
    ("2001-04-13", "Holiday", "Regional", "ASIA", False),
    ("2001-04-20", "Holiday", "Local", "NATION_3", False),
    ("2001-05-01", "Event", "National", "Nation", False),
    ("2001-05-01", "Holiday", "Local", "NATION_7", False),
    ("2001-05-11", "Bridge", "National", "Nation", False),
    ("2001-05-19", "Work Day", "National", "Nation", False),
    ("2001-06-30", "Additional", "Regional", "EUROPE", False),
    ("2001-07-03", "Holiday", "Local", "NATION_12", False),
    ("2001-07-10", "Event", "Other", "NATION_5", True),
    ("2001-07-24", "Holiday", "National", "Nation", False),
]

#: Schemas of the original files.
TRAIN_SCHEMA = "id long, date date, store_nbr int, item_nbr int, unit_sales double, onpromotion boolean"
TEST_SCHEMA = "id long, date date, store_nbr int, item_nbr int, onpromotion boolean"
SCHEMAS = {
    "train": TRAIN_SCHEMA,
    "test": TEST_SCHEMA,
    "stores": "store_nbr int, city string, state string, type string, cluster int",
    "items": "item_nbr int, family string, class int, perishable int",
    "transactions": "date date, store_nbr int, transactions long",
    "oil": "date date, dcoilwtico double",
    "holidays_events": "date date, type string, locale string, locale_name string, description string, transferred boolean",
}


@dataclass(frozen=True)
class Retail:
    """The tables. Facts stay lazy; dimensions are what joins may broadcast when the optimizer finds them small."""

    sales: DataFrame
    test_rows: DataFrame
    stores: DataFrame
    items: DataFrame
    transactions: DataFrame
    oil: DataFrame
    holidays: DataFrame

    @property
    def train(self) -> DataFrame:
        return self.sales

    @property
    def test(self) -> DataFrame:
        return self.test_rows

    @cached_property
    def clean(self) -> DataFrame:
        """Training rows with target (sales, negative as 0) and the promotion flag as 0 or 1."""
        return self.train.select("date", "store_nbr", "item_nbr", clip0(F.col("unit_sales")).alias("target"), promo_flag(F.col("onpromotion")).alias("onpromotion"))

    def rows_between(self, start: dt.date, end: dt.date) -> DataFrame:
        """Cleaned training rows from start to end, both included; the bounds reach the scan."""
        return self.clean.filter(F.col("date").between(F.lit(start), F.lit(end)))

    @cached_property
    def item_meta(self) -> DataFrame:
        """Per item: class, perishable, and codes: family in the order of names, the item itself in key order."""
        rank = Window.orderBy("family")
        return self.items.select(
            "item_nbr", "class", "perishable", "family",
            F.when(F.col("family").isNull(), -1).otherwise(F.dense_rank().over(rank) - F.max(F.when(F.col("family").isNull(), 1).otherwise(0)).over(Window.partitionBy()) - 1).cast("int").alias("family_code"),
            (F.row_number().over(Window.orderBy("item_nbr")) - 1).cast("int").alias("item_code"),
        )

    @cached_property
    def store_meta(self) -> DataFrame:
        """Per store: cluster, and codes of city, state, type (in the order of names) and of the store (in key order)."""

        def code(column: str):
            nulls = F.max(F.when(F.col(column).isNull(), 1).otherwise(0)).over(Window.partitionBy())
            return F.when(F.col(column).isNull(), -1).otherwise(F.dense_rank().over(Window.orderBy(column)) - nulls - 1).cast("int")

        return self.stores.select(
            "store_nbr", "cluster", code("city").alias("city_code"), code("state").alias("state_code"), code("type").alias("type_code"),
            (F.row_number().over(Window.orderBy("store_nbr")) - 1).cast("int").alias("store_code"),
        )

    @cached_property
    def universe(self) -> DataFrame:
        """The pairs of store and item to be forecast."""
        return self.test.select("store_nbr", "item_nbr").distinct()


def read_csv_tables(spark: SparkSession, folder: str) -> Retail:
    """The original files, with fixed schemas (nothing is inferred, only used columns are read)."""
    read = lambda name: spark.read.schema(SCHEMAS[name]).csv(f"{folder}/{name}.csv", header=True)
    return Retail(read("train").drop("id"), read("test"), read("stores"), read("items"), read("transactions"), read("oil"), read("holidays_events").drop("description"))


def load_kept(spark: SparkSession, sf_dir: str, train_end: dt.date = TRAIN_END, test_end: dt.date = TEST_END) -> Retail:
    """The same as load(), with what it maps from facts written once a session, in the order of dates, into the shared
    checkpoint folder: every query then reads the few columns and days that it needs. Inputs that change are mapped anew."""
    folder = f"{checkpoint_folder(spark)}/tables"
    inputs = ("lineitem", "part", "supplier", "orders", "customer", "nation", "region")
    params = {"source": sf_dir, "inputs": [stamp(spark, f"{sf_dir}/{n}.parquet") for n in inputs], "train_end": train_end, "test_end": test_end}
    lazy = load(spark, sf_dir, train_end, test_end)
    by_date = lambda df: df.repartitionByRange("date", "store_nbr").sortWithinPartitions("date")
    keep = lambda name, build: cached(spark, folder, name, build, **params)
    return Retail(
        keep("sales", lambda: by_date(lazy.sales)), keep("test", lambda: lazy.test_rows.coalesce(1)), lazy.stores, keep("items", lambda: lazy.items.coalesce(1)),
        keep("transactions", lambda: by_date(lazy.transactions)), keep("oil", lambda: lazy.oil.coalesce(1)), lazy.holidays,
    )


def load(spark: SparkSession, sf_dir: str, train_end: dt.date = TRAIN_END, test_end: dt.date = TEST_END) -> Retail:
    """The retail tables over TPC-H-like parquet: supplier nations as stores, brands as items, shipments as sales."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    returned = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    day = F.col("l_shipdate").cast("date")
    lines = (
        read("lineitem")
        .join(read("part").select("p_partkey", F.expr("cast(substr(p_brand, 7) as int)").alias("item_nbr")), F.col("l_partkey") == F.col("p_partkey"))
        .join(read("supplier").select("s_suppkey", F.col("s_nationkey").cast("int").alias("store_nbr")), F.col("l_suppkey") == F.col("s_suppkey"))
    )
    sales = (
        lines.groupBy(day.alias("date"), "store_nbr", "item_nbr")
        .agg(F.sum(F.when(returned, -F.col("l_quantity")).otherwise(F.col("l_quantity"))).alias("unit_sales"), F.max((F.col("l_discount") >= 0.08).cast("int")).alias("promo"))
        .select("date", "store_nbr", "item_nbr", "unit_sales", F.when(F.col("date") >= F.lit(dt.date(1996, 1, 1)), F.col("promo")).alias("onpromotion"))
    )
    future = sales.filter((F.col("date") > F.lit(train_end)) & (F.col("date") <= F.lit(test_end)))
    test = future.select(
        F.row_number().over(Window.orderBy("date", "store_nbr", "item_nbr")).cast("long").alias("id"), "date", "store_nbr", "item_nbr", "onpromotion"
    )  # one fortnight; its numbering needs one order
    stores = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("int").alias("store_nbr"),
        F.col("n_name").alias("city"),
        F.col("r_name").alias("state"),
        F.substring(F.lit("ABCDE"), (F.col("n_nationkey") % 5 + 1).cast("int"), F.lit(1)).alias("type"),
        (F.col("n_nationkey") % 7).cast("int").alias("cluster"),
    )
    number = F.expr("cast(substr(p_brand, 7) as int)")
    items = read("part").select(number.alias("item_nbr")).distinct().select(
        "item_nbr",
        F.concat(F.lit("FAM_"), (F.col("item_nbr") % 5).cast("string")).alias("family"),
        (F.col("item_nbr") % 7).cast("int").alias("class"),
        (F.col("item_nbr") % 4 == 0).cast("int").alias("perishable"),
    )
    orders = read("orders").withColumn("date", F.col("o_orderdate").cast("date"))
    transactions = (
        orders.join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("date", F.col("c_nationkey").cast("int").alias("store_nbr")).agg(F.count(F.lit(1)).alias("transactions"))
    )
    oil = (
        orders.filter(F.weekday("date") < 5).groupBy("date")
        .agg((F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1)) / 1000).alias("price"))
        .select("date", F.when(F.dayofmonth("date") % 10 != 0, F.col("price")).alias("dcoilwtico"))
    )
    holidays = spark.createDataFrame([(dt.date.fromisoformat(d), *rest) for d, *rest in HOLIDAYS], "date date, type string, locale string, locale_name string, transferred boolean")
    return Retail(sales.filter(F.col("date") <= F.lit(train_end)), test, stores, items, transactions, oil, holidays)
