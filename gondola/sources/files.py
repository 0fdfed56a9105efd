"""Files: catalogue of inputs, sinks for forecasts and summaries, and a cache keyed by all parameters."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("train", "test", "stores", "items", "transactions", "oil", "holidays_events")


def dataset_catalog(spark: SparkSession, folder: str, pattern: str = "*.csv", chunked_mb: float = 500.0) -> DataFrame:
    """File name, size in MB (2 decimals) and reading strategy of the files in a folder, the largest first.

    The listing is Spark's, so the folder may be in any store; contents are not read.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "length")
    size = F.round(F.col("length") / (1024.0 * 1024.0), 2)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file"), size.alias("size_mb"), F.when(size >= chunked_mb, "chunked").otherwise("full").alias("strategy")
    ).orderBy(F.desc("size_mb"), "file")


def missing_inputs(spark: SparkSession, folder: str, required: tuple[str, ...] = REQUIRED) -> list[str]:
    """Names of required inputs that a folder lacks."""
    there = {r[0] for r in dataset_catalog(spark, folder).select("file").collect()}
    return [f"{n}.csv" for n in required if f"{n}.csv" not in there]


def write_submission(predictions: DataFrame, path: str, value: str = "final_prediction") -> None:
    """id and unit_sales as gzipped CSV with a header; ids travel with the rows, so order does not matter."""
    predictions.select("id", F.col(value).alias("unit_sales")).write.mode("overwrite").option("compression", "gzip").csv(path, header=True)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id long, unit_sales double").csv(path, header=True)


def write_summary(spark: SparkSession, summary: dict, path: str) -> None:
    """A run's summary as one JSON line."""
    spark.createDataFrame([(json.dumps(summary, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def digest(**params: object) -> str:
    """Ten hex digits of all parameters, so that no two settings share a cache entry."""
    return hashlib.md5(json.dumps(params, sort_keys=True, default=str).encode()).hexdigest()[:10]


def cached(spark: SparkSession, folder: str, name: str, build: Callable[[], DataFrame], **params: object) -> DataFrame:
    """What build() gives, kept as Parquet under its name and parameters; an unfinished write is never read."""
    path = f"{folder}/{name}-{digest(**params)}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data, which the session names in ``spark.checkpoint.dir``.

    Only in local mode (tests) may none be named; a folder of this machine serves then.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gondola-checkpoint-"))
    return context.getCheckpointDir()


def stamp(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of the files at a path, so that a cache is not read after its input has changed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in system.listStatus(hadoop))


def cut_lineage(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared checkpoint folder (see checkpoint_folder)."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def parse_optional(value: str | None) -> str | None:
    """A setting's text, or None for an empty one, 'none' or 'null'."""
    return None if value is None or value.strip().lower() in ("", "none", "null") else value


def resolve_date(value: str | None, default: dt.date) -> dt.date:
    return dt.date.fromisoformat(parse_optional(value)) if parse_optional(value) else default
