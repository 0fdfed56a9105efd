"""Sums and counts kept up to date as files of sales arrive: the incremental form of operators.aggregates.sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gondola.functions.columns import clip0

SALES = "date date, store_nbr int, item_nbr int, unit_sales double, onpromotion int"


def arriving_sales(spark: SparkSession, folder: str, schema: str = SALES, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def running_sums(sales: DataFrame, keys: list[str], late: str = "7 days", window: str | None = None) -> DataFrame:
    """Sum of target, rows and known targets by keys; with ``window``, by event-time windows too, which close once
    no row can be later than ``late``, so that the state stays bounded."""
    rows = sales.withColumn("target", clip0(F.col("unit_sales")))
    groups: list = list(keys)
    if window:
        rows = rows.withColumn("_at", F.col("date").cast("timestamp")).withWatermark("_at", late)
        groups = [F.window("_at", window).alias("window"), *groups]
    return rows.groupBy(*groups).agg(F.sum("target").alias("sum"), F.count(F.lit(1)).alias("count"), F.count("target").alias("known"))


def write_running(sums: DataFrame, checkpoint: str, folder: str) -> StreamingQuery:
    """Run what is there now; each micro-batch writes all sums as Parquet into a folder of its own (see read_running).

    The executors write, so the driver holds no rows. A batch that is run again after a failure overwrites its own folder;
    the checkpoint lets a later run go on from it.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return sums.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_running(spark: SparkSession, folder: str) -> DataFrame:
    """The sums after the last micro-batch that was written to its end.

    Raises FileNotFoundError if there is none yet.
    """
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    done = system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(root, "batch=*/_SUCCESS"))
    batches = [file.getPath().getParent() for file in done or ()]
    if not batches:
        raise FileNotFoundError(f"no batch has been written to {folder}")
    return spark.read.parquet(max(batches, key=lambda path: int(path.getName().split("=")[1])).toString())
