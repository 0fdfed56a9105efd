"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gondola.sources.files import cut_lineage  # noqa: F401  the operators take it from here

#: Rows, and bytes of text, taken from an Arrow batch at a time, so that Python objects of few long texts live at once.
SLICE_ROWS, SLICE_BYTES = 256, 1 << 21

#: Applications whose executors have been sent this package.
SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that they need no copy of their own."""
    context = spark.sparkContext
    if context.applicationId not in SHIPPED:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="gondola-ship-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        context.addPyFile(str(archive))
        SHIPPED.add(context.applicationId)


def map_batches(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow, with this package at hand on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


#: Rows of a small intermediate table that one file of a checkpoint takes at least.
FILE_ROWS = 50_000


def gathered(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most ``rows`` narrow rows, in no more partitions than the cores and these rows call for.

    It is meant for tables that are checkpointed again and again, as each partition is a file there, for which an
    executor may have to start a process. Partitions are only joined, so the rows are not shuffled once more.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))


def as_bytes(column: str) -> Column:
    """A text column as its UTF-8 bytes, which saves Python from decoding them."""
    return F.col(column).cast("string").cast("binary")


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most SLICE_ROWS rows and SLICE_BYTES of text, or of one row that is longer."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = min(start + SLICE_ROWS, max(start + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right"))), batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


def map_slices(df: DataFrame, make: Callable[[dict[str, list]], dict[str, object]], schema: str) -> DataFrame:
    """Map df by ``make``, which turns the columns of a few rows (Python lists) into the columns of schema.

    The rows out may be more or fewer than the rows in. Nothing is kept between slices, so memory is bounded by
    a slice and a lost task can be run again anywhere.
    """
    out = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                made = make({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type) for f in out], schema=out)

    return map_batches(df, run, schema)


def keep_rows(df: DataFrame, text_col: str, keep: Callable[[list[bytes | None]], object]) -> DataFrame:
    """The rows of df, all columns as they are, for whose texts (UTF-8 bytes) ``keep`` gives true values; no shuffle."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield part.filter(pa.array(keep(part.column(at).cast(pa.binary()).to_pylist()), pa.bool_()))

    return map_batches(df, run, df.schema)


class Memo(dict):
    """What a function of single words gave (bytes), kept by a Python worker for its next rows; ``most`` words at most.

    Words that come when it is full are worked out again for each slice, so a bound on memory changes no result.
    """

    def __init__(self, work: Callable[[list[bytes]], list[bytes]], most: int = 400_000):
        super().__init__()
        self.work, self.most = work, most

    def join(self, lists: list[list[bytes]]) -> list[bytes]:
        """For each list of words, what they give, joined."""
        found = [list(map(self.get, words)) for words in lists]
        gaps = [[i for i, x in enumerate(values) if x is None] for values in found]
        new = list({words[i] for words, own in zip(lists, gaps, strict=True) for i in own})
        if new:
            known = dict(zip(new, self.work(new), strict=True))
            for words, values, own in zip(lists, found, gaps, strict=True):
                for i in own:
                    values[i] = known[words[i]]
            if len(self) + len(known) <= self.most:
                self.update(known)
        return [b"".join(values) for values in found]


#: The one memo that a Python worker holds, by the name that it was made for.
MEMOS: dict[tuple, Memo] = {}


def memo(name: tuple, make: Callable[[], Callable[[list[bytes]], list[bytes]]]) -> Memo:
    """The worker's memo of this name (a kind, and a vocabulary or model); it replaces any other, so memory stays bounded."""
    if name not in MEMOS:
        MEMOS.clear()
        MEMOS[name] = Memo(make())
    return MEMOS[name]


def hash_share(rows: int, most: int, *columns: str) -> Column:
    """A filter that keeps about ``most`` of ``rows`` rows, chosen by a hash of columns, or all if there are no more."""
    if rows <= most:
        return F.lit(True)
    return F.pmod(F.xxhash64(F.lit("share"), *columns), F.lit(1_000_000)) < int(1_000_000 * most / rows)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    """The Arrow schema of a Spark DDL schema."""
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def numbered(
    df: DataFrame, group: str, order: list[str], rows_of: dict[int, int], out: str, cell_rows: int = 512
) -> DataFrame:
    """df with ``out``: a number from 0, gapless within each value of ``group``, whose rows are spread over tasks.

    rows_of: rows of each group, of which there are few (shards, length classes). A group of n rows is dealt into
    cells of about ``cell_rows`` rows, or the root of n if that is more, by a hash of ``order``; rows are numbered
    within a cell, and the cells' running counts are added, so no task holds a whole group. ``order`` should name columns that tell rows apart; rows
    that agree in all of them may swap numbers.
    """
    cells = F.lit(1)
    large = {g: -(-n // max(cell_rows, int(n**0.5))) for g, n in rows_of.items() if n > cell_rows}
    if large:
        cells = F.coalesce(
            F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in large.items() for x in kv]), F.col(group).cast("long")),
            F.lit(1).cast("long"),
        )
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), cells))
    within = Window.partitionBy(group, "_cell").orderBy(*order)
    counts = dealt.groupBy(group, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (
        dealt.withColumn("_at", F.row_number().over(within) - 1)
        .join(offsets, [group, "_cell"])
        .withColumn(out, (F.col("_at") + F.col("_before")).cast("long"))
        .drop("_cell", "_at", "_before")
    )
