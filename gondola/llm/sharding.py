"""Sharding: minimax contiguous partition of ordered atomic groups."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import cut_lineage, numbered

#: Bytes that a document takes besides its text.
OVERHEAD = 16


def minimax_cuts(sizes: list[int], parts: int) -> list[int]:
    """Starts of at most ``parts`` contiguous runs of ``sizes`` whose largest sum is the smallest possible.

    The smallest feasible capacity is found by binary search; a capacity is feasible if filling parts greedily
    needs no more than ``parts`` of them. Returns the index at which each run begins; no sizes give no runs.
    """
    if not sizes or parts < 1:
        return []
    ends = list(accumulate(sizes))

    def fill(capacity: int) -> list[int] | None:
        starts, at, taken = [], 0, 0
        while at < len(ends):
            if len(starts) == parts:
                return None
            starts.append(at)
            at = bisect_right(ends, taken + capacity, lo=at)
            taken = ends[at - 1]
        return starts

    low, high = max(max(sizes), -(-ends[-1] // parts)), ends[-1]
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if fill(middle) is not None else (middle + 1, high)
    return level(ends, parts, low)


def level(ends: list[int], parts: int, capacity: int) -> list[int]:
    """Starts of runs of at most ``capacity`` whose sums are near equal; ends: running sums of the sizes.

    Each run ends as near to an even share of what is left as the capacity allows, here and for the runs behind it.
    """
    n, needed = len(ends), [len(ends)]  # needed[k]: where the last k runs can begin at the earliest
    while needed[-1] > 0 and len(needed) <= parts:
        needed.append(bisect_left(ends, ends[needed[-1] - 1] - capacity))
        if ends[needed[-1] - 1 if needed[-1] else 0] < ends[needed[-2] - 1] - capacity and needed[-1] < needed[-2]:
            needed[-1] += 1
    starts, at, taken = [], 0, 0
    for left in range(parts, 0, -1):
        if at >= n:
            break
        starts.append(at)
        most = bisect_right(ends, taken + capacity, lo=at)
        least = max(at + 1, needed[left - 1] if left - 1 < len(needed) else 0)
        share = taken + (ends[-1] - taken) / left
        end = bisect_left(ends, share, lo=at) + 1
        if end - 1 > at and share - ends[end - 2] < ends[min(end, n) - 1] - share:
            end -= 1
        at = min(max(end, least), most)
        taken = ends[at - 1]
    return starts


def plan_shards(cells: list[tuple[int, int]], shards: int) -> tuple[dict[int, int], list[tuple[int, int]]]:
    """Shards for the ordered cells (cell, size): cells with a shard of their own, and (first cell, shard) of the rest.

    A cell that is larger than the mean of what is left could only raise the capacity of every other shard, so
    it gets a shard of its own, and the other shards share the rest evenly. There are fewer such cells than shards.
    """
    alone: dict[int, int] = {}
    rest = list(cells)
    while rest and len(alone) < shards - 1:
        left = shards - len(alone)
        mean = sum(s for _, s in rest) / left
        cell, size = max(rest, key=lambda x: (x[1], -x[0]))
        if size <= mean:
            break
        alone[cell] = len(alone)
        rest.remove((cell, size))
    starts = minimax_cuts([s for _, s in rest], shards - len(alone))
    return alone, [(rest[at][0], len(alone) + i) for i, at in enumerate(starts)]


def shard_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, cells: int | None = None
) -> DataFrame:
    """Each document's shard, so that shards hold nearly equal bytes and equal texts stay together.

    Documents are hashed by text into ``cells`` ordered cells (131,072, or 2,048 for each shard if that is more); a cell is an atomic group, as all copies of a text
    are in one. The cells' sizes, at most ``cells`` rows whatever the input, are all that the driver sees: it
    cuts their sequence by ``minimax_cuts``. A cell beyond an even share (a text whose copies fill more) gets a
    shard of its own.

    Returns one row per input row: ``id_col`` as it is, size (UTF-8 bytes and 16), text_crc32, law ('bytes'),
    shard, slot (gapless from 0 in the shard), grown_shard (null, as the law is not 'key').

    A null text counts as no bytes; null ids and repeated rows are kept, each with a slot of its own; an empty
    table gives no rows. Other columns are not read, so their names cannot clash.
    """
    body = F.col(text_col).cast("string")
    cells = cells or max(1 << 17, 2048 * shards)
    thin = cut_lineage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(body), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
            F.coalesce(F.crc32(body.cast("binary")), F.lit(0).cast("long")).alias("text_crc32"),
            F.pmod(F.xxhash64(F.coalesce(body, F.lit(""))), F.lit(cells)).cast("long").alias("_group"),
        )
    )
    found = thin.groupBy("_group").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort()
    alone, runs = plan_shards([(r[0], r[1]) for r in found], shards)
    firsts = [first for first, _ in runs]
    rows_of = dict.fromkeys(range(shards), 0)
    for group, _, n in found:
        rows_of[alone[group] if group in alone else runs[bisect_right(firsts, group) - 1][1]] += n

    shard = F.lit(len(alone)) if runs else F.lit(0)
    for first in firsts[1:]:
        shard = shard + (F.col("_group") >= F.lit(first)).cast("int")
    for group, own in alone.items():
        shard = F.when(F.col("_group") == F.lit(group), F.lit(own)).otherwise(shard)
    dealt = thin.withColumn("shard", shard.cast("int")).drop("_group")
    return numbered(dealt, "shard", ["doc_id", "text_crc32", "size"], rows_of, "slot").select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
