"""SimHash near-duplicates: fingerprints, bit-sliced comparison and components."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import arrow_schema, as_bytes, cut_lineage, gathered, map_batches, map_slices

BITS = 64
SEED = 42
#: Members of a bucket that one task compares with each other; a larger bucket is dealt out in pairs of chunks.
CHUNK = 4096
#: Parts into which the rows of one fingerprint are spread.
SALTS = 16
#: Probes times 64-lane words that are compared at once.
LANES_AT_ONCE = 1 << 18
#: Bit planes between two looks for words that can be abandoned.
LOOK_EVERY = 8


# -- fingerprints ------------------------------------------------------------------------------------------------


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of ``counts`` hashes, the 64 bits that are set in over half of them; an empty run gives 0.

    Eight masked shifts put every eighth bit into a byte of its own, so a word sums eight bits at once; runs are
    cut into segments of 255 hashes, the most that a byte can count.
    """
    out = np.zeros(len(counts), np.uint64)
    own = np.flatnonzero(counts)
    if not len(own):
        return out
    c = counts[own].astype(np.int64)
    segments = -(-c // 255)
    first = np.cumsum(segments) - segments
    within = np.arange(segments.sum()) - np.repeat(first, segments)
    starts = np.repeat(np.cumsum(c) - c, segments) + 255 * within
    for shift in range(8):
        spread = (hashes >> np.uint64(shift)) & np.uint64(0x0101010101010101)
        bytes_ = np.add.reduceat(spread, starts).view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(bytes_, first, axis=0)
        for byte in range(8):
            out[own] |= (2 * ones[:, byte] > c).astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def fingerprint_texts(texts: list[bytes | None], width: int) -> np.ndarray:
    """The fingerprints of texts: majority bits of the XXH64 of their word shingles."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        words = text.lower().split() if text else []
        if len(words) > width:
            rows = [digest(b" ".join(x), SEED) for x in zip(*[words[i:] for i in range(width)])]
        else:
            rows = [digest(b" ".join(words), SEED)] if words else []
        hashes += rows
        counts.append(len(rows))
    return majority(np.array(hashes, np.uint64), np.array(counts, np.int64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id (long) and fp (the 64 bits as a long) of each row; a text that is null or without words has fp 0."""

    def make(rows: dict[str, list]) -> dict[str, object]:
        return {"doc_id": rows["doc_id"], "fp": fingerprint_texts(rows["text"], width).view(np.int64)}

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, "doc_id long, fp long")


# -- bit-sliced comparison ---------------------------------------------------------------------------------------


def slice_planes(members: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints, one word or a row of words each: [words, planes], lane k of a word is member 64 * word + k."""
    rows = members.reshape(len(members), -1)
    words, bits = -(-len(rows) // 64), BITS * rows.shape[1]
    lanes = np.zeros((words * 64, rows.shape[1]), np.uint64)
    lanes[: len(rows)] = rows
    unpacked = np.unpackbits(lanes.view(np.uint8).reshape(words, 64, bits // 8), axis=2, bitorder="little")
    packed = np.packbits(unpacked.transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(packed).view(np.uint64).reshape(words, bits)


def match_lanes(probes: np.ndarray, word_of: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """For each pair (probe fingerprint, word of planes), the lanes within ``radius`` differing bits.

    Each plane's differences go into vertical counters by carry-save addition, with the overflow kept, so that 64
    distances advance together. Pairs of which every lane has passed the radius are abandoned.
    """
    bits = planes.shape[1]
    if not 0 <= radius < bits:
        raise ValueError("radius must be 0 or more, and less than the bits of a fingerprint")
    found = np.zeros(len(probes), np.uint64)
    alive = np.arange(len(probes))
    p, w = probes.reshape(len(probes), -1), word_of
    counters = [np.zeros(len(probes), np.uint64) for _ in range((radius + 1).bit_length())]
    over = np.zeros(len(probes), np.uint64)
    for plane in range(bits):
        carry = planes[w, plane] ^ (np.uint64(0) - ((p[:, plane // BITS] >> np.uint64(plane % BITS)) & np.uint64(1)))
        for i, counter in enumerate(counters):
            counters[i], carry = counter ^ carry, counter & carry
        over |= carry
        if plane % LOOK_EVERY == LOOK_EVERY - 1 and plane >= radius:
            near = ~(over | beyond(counters, radius))
            if plane == bits - 1:
                found[alive] = near
                break
            keep = np.flatnonzero(near)
            if len(keep) < 0.8 * len(alive):
                alive, p, w, over = alive[keep], p[keep], w[keep], over[keep]
                counters = [x[keep] for x in counters]
                if not len(alive):
                    break
    return found


def beyond(counters: list[np.ndarray], radius: int) -> np.ndarray:
    """Lanes whose counter (bit planes, the lowest first) holds more than ``radius``."""
    more, equal = np.zeros_like(counters[0]), np.full_like(counters[0], ~np.uint64(0))
    for bit in range(len(counters) - 1, -1, -1):
        if radius >> bit & 1:
            equal = equal & counters[bit]
        else:
            more |= equal & counters[bit]
            equal = equal & ~counters[bit]
    return more


def set_lanes(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, lane) of the bits that are set in masks."""
    bits = np.unpackbits(masks.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.nonzero(bits)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while (further := label[label]).tolist() != label.tolist():
            label = further
        if (before == label).all():
            break
        keep = label[a] != label[b]
        a, b = a[keep], b[keep]
    return label


def near_small(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect what is near within each of many buckets of up to 64 members, one after another in fps."""
    if not len(fps):
        return np.zeros(0, int), np.zeros(0, int)
    fps = fps.reshape(len(fps), -1)
    starts = np.cumsum(sizes) - sizes
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    lanes = np.zeros((len(sizes) * 64, fps.shape[1]), np.uint64)
    lanes[bucket * 64 + np.arange(len(fps)) - starts[bucket]] = fps
    planes = slice_planes(lanes)
    masks = np.concatenate([match_lanes(fps[i : i + LANES_AT_ONCE], bucket[i : i + LANES_AT_ONCE], planes, radius) for i in range(0, len(fps), LANES_AT_ONCE)])
    place = (np.arange(len(fps)) - starts[bucket]).astype(np.uint64)
    masks &= (np.uint64(1) << place) - np.uint64(1)  # earlier lanes only, which also leaves padding out
    has = np.flatnonzero(masks)
    row, lane = set_lanes(masks[has])
    label = roots(len(fps), has[row], starts[bucket[has[row]]] + lane)
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return moved, label[moved]


def near_masks(rows: np.ndarray, planes: np.ndarray, radius: int) -> np.ndarray:
    """[rows, words]: the lanes of all planes that are near each row."""
    words = len(planes)
    return match_lanes(np.repeat(rows, words, axis=0), np.tile(np.arange(words), len(rows)), planes, radius).reshape(-1, words)


def near_large(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links that connect what is near within ``left``, or across ``left`` and ``right`` (which comes behind it);
    at most one for each member.

    A search from one member at a time takes each reached lane out of the masks at once, so that a dense group
    costs a link per member, not per pair.
    """
    both = left if right is None else np.concatenate([left, right])
    both = both.reshape(len(both), -1)
    n, planes = len(both), slice_planes(both)
    words = len(planes)
    rows = max(1, LANES_AT_ONCE // words)
    side = np.zeros(words * 64, bool)
    side[: len(left)] = True
    packed = lambda flags: np.packbits(flags, bitorder="little").view(np.uint64)
    lefts, rights = packed(side), packed(np.arange(words * 64) < n)
    rights = rights if right is None else rights & ~lefts
    masks = np.empty((n, words), np.uint64)
    for at in range(0, n, rows):
        own = both[at : at + rows]
        across = rights if right is None else np.where((np.arange(at, at + len(own)) < len(left))[:, None], rights, lefts)
        masks[at : at + rows] = near_masks(own, planes, radius) & across
    waiting = packed(np.arange(words * 64) < n)
    a, b = [], []
    one = np.uint64(1)
    for start in np.flatnonzero(np.bitwise_count(masks).sum(axis=1) > (right is None)):
        if not waiting[start // 64] >> np.uint64(start % 64) & one:
            continue
        waiting[start // 64] &= ~(one << np.uint64(start % 64))
        front = np.array([start])
        while len(front):
            reached = np.bitwise_or.reduce(masks[front], axis=0) & waiting
            waiting &= ~reached
            row, lane = set_lanes(reached)
            front = row * 64 + lane
            a.append(front)
            b.append(np.full(len(front), start))
    if not a:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(a), np.concatenate(b)


def link_small(fps: np.ndarray, sizes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """near_small, as fingerprints."""
    a, b = near_small(fps, sizes, radius)
    return fps[a], fps[b]


def link_large(left: np.ndarray, right: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """near_large, as fingerprints."""
    a, b = near_large(left, right, radius)
    both = left if right is None else np.concatenate([left, right])
    return both[a], both[b]


# -- candidates and components -----------------------------------------------------------------------------------


def blocks_for(n: int, radius: int) -> int:
    """Into how many blocks fingerprints are cut, so that a bucket of chance holds few of n.

    Two fingerprints within the radius agree in all but ``radius`` blocks, whatever their number; more blocks
    give more but finer keys. Every choice finds every pair.
    """
    for blocks in range(radius + 1, radius + 4):
        if n >> (BITS * (blocks - radius) // blocks) <= 64:
            return blocks
    return radius + 4


def bucket_keys(fp: Column, radius: int, blocks: int) -> Column:
    """The keys under which a fingerprint meets all others within the radius."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, kept in enumerate(combinations(range(blocks), blocks - radius)):
        value = F.lit(0).cast("long")
        for i in kept:
            wide = edges[i + 1] - edges[i]
            value = F.shiftleft(value, wide).bitwiseOR(F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << wide) - 1)))
        keys.append(F.struct(F.lit(number).alias("kind"), value.alias("value")))
    return F.explode(F.array(*keys))


LINKS = "a long, b long, kind int, value long, members int"


def link_buckets(keyed: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within buckets; members of buckets over CHUNK come back as rows with a alone, for link_chunks."""
    out = arrow_schema(keyed.sparkSession, LINKS)

    def work(kind: np.ndarray, value: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (kind[1:] != kind[:-1]) | (value[1:] != value[:-1])]) if len(fp) else np.zeros(0, int)
        sizes = np.diff(np.r_[starts, len(fp)])
        small = sizes <= 64
        a, b = link_small(fp[np.repeat(small & (sizes > 1), sizes)], sizes[small & (sizes > 1)], radius)
        links, later = [(a, b)], []
        for at, size in zip(starts[~small], sizes[~small], strict=True):
            if size <= CHUNK:
                links.append(link_large(fp[at : at + size], None, radius))
            else:
                later.append(np.arange(at, at + size))
        a, b = (np.concatenate(x).view(np.int64) for x in zip(*links, strict=True))
        at = np.concatenate(later) if later else np.zeros(0, int)
        members = np.repeat([len(x) for x in later], [len(x) for x in later]).astype(np.int32)
        none = pa.nulls(len(a), pa.int32())
        columns = [
            pa.array(np.r_[a, fp[at].view(np.int64)]),
            pa.concat_arrays([pa.array(b), pa.nulls(len(at), pa.int64())]),
            pa.concat_arrays([none, pa.array(kind[at].astype(np.int32))]),
            pa.concat_arrays([none.cast(pa.int64()), pa.array(value[at])]),
            pa.concat_arrays([none, pa.array(members)]),
        ]
        return pa.RecordBatch.from_arrays(columns, schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            part = [batch.column(i).to_numpy() for i in range(3)]
            if not len(part[0]):
                continue
            if held and (held[-1][0][-1], held[-1][1][-1]) == (part[0][-1], part[1][-1]):
                held.append(part)  # still the same bucket
                continue
            start = int(np.flatnonzero((part[0] != part[0][-1]) | (part[1] != part[1][-1]))[-1] + 1) if (part[0][0], part[1][0]) != (part[0][-1], part[1][-1]) else 0
            held.append([x[:start] for x in part])
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield work(whole[0], whole[1], whole[2].view(np.uint64))
            held = [[x[start:] for x in part]]
        if held:
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            yield work(whole[0], whole[1], whole[2].view(np.uint64))

    dealt = keyed.repartition("kind", "value").sortWithinPartitions("kind", "value")
    return map_batches(dealt.select("kind", "value", "fp"), run, LINKS)


def link_chunks(hot: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) within buckets too large for one task, found by every pair of chunks of each bucket."""
    chunks = F.ceil(F.col("members") / F.lit(CHUNK / 2)).cast("int")
    own = F.pmod(F.xxhash64("a"), chunks).cast("int")
    met = hot.select("kind", "value", F.col("a").alias("fp"), own.alias("own"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("other"))
    met = met.select("kind", "value", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def pair(table: pa.Table) -> pa.Table:
        fp, first = table.column("fp").to_numpy().view(np.uint64), table.column("own").to_numpy() == table.column("i").to_numpy()
        a, b = link_large(fp, None, radius) if first.all() else link_large(fp[first], fp[~first], radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return met.groupBy("kind", "value", "i", "j").applyInArrow(pair, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and label, the smallest node that it reaches, of every node of the links (a, b).

    In each round a node takes the smallest label among its neighbours, and then its label's label; every round
    is cut off from the last by a checkpoint.
    """
    both = cut_lineage(links.select("a", "b").union(links.select("b", "a")).distinct())
    most = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = cut_lineage(gathered(labels, most))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("low"))
        taken = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        hop = labels.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        moved = cut_lineage(gathered(taken.join(hop, "label").select("node", "was", F.least("label", "hop").alias("label")), most))
        labels = moved.select("node", "label")
        if moved.filter("was <> label").isEmpty():
            return labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4
) -> DataFrame:
    """Each row's fingerprint and component of near-duplicates.

    Rows whose fingerprints differ in up to ``radius`` bits (0 to 6) are linked, and component_id is the smallest
    id that is reachable, the own one included. Equal fingerprints are merged first, so copies cost a row each and
    no pairs. Distinct fingerprints meet in buckets of equal bit blocks (by the pigeonhole principle none within
    the radius is missed) and are compared there bit-sliced; a bucket gives links that connect what it links, at
    most one for each member.

    Returns one row per input row: doc_id, fp (long), component_id. A null text counts as empty, and texts
    without words (fp 0) are linked like any others. Null ids are kept; they are nobody's smallest id, so a
    component with null ids only has a null component_id. Repeated rows come back each. An empty table gives no
    rows. Columns besides the two are not read.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    distinct = cut_lineage(gathered(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), rows.count()))
    keys = bucket_keys(F.col("fp"), radius, blocks_for(distinct.count(), radius))
    keyed = distinct.select("fp", keys.alias("key")).select("key.kind", "key.value", "fp")
    found = cut_lineage(link_buckets(keyed, radius))
    links = found.filter("kind is null").select("a", "b")
    hot = found.filter("kind is not null")
    if not hot.isEmpty():
        links = links.union(link_chunks(hot, radius))
    labels = components(links)
    grouped = labels.join(distinct.select(F.col("fp").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("least"))
    of_node = labels.join(grouped, "label").select(F.col("node").alias("fp"), "least")
    # a fingerprint of one row without links needs no look-up; the rows of the others are spread over salts
    shared = distinct.join(of_node, "fp", "left").filter("n > 1 or least is not null")
    shared = shared.select("fp", F.coalesce("least", "rep").alias("component_id"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return salted.join(shared, ["fp", "salt"], "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


# -- near copies by the similarity of shingle sets -----------------------------------------------------------------

#: Bands and minima in a band: at a similarity of 0.8 a pair shares no band with a chance of 3 in 100,000.
BANDS, BAND_ROWS = 20, 4
#: Odd multipliers, each of which puts all 64-bit hashes into another order.
ORDERS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Words of the wide SimHash of a set: 256 bits tell a similarity of 0.8 (39 to 48 bits differ) from one of 0.3 (89).
WORDS = 4
FP = [f"f{i}" for i in range(WORDS)]
#: Shingles of the sets that one task compares with each other, about; larger components are dealt out in chunks.
CHUNK_SHINGLES = 2_000_000
#: Members of a large component that every chunk of it is compared with first.
PIVOTS = 64
MIXER = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct XXH64 of each text's word shingles; a text of fewer words is one shingle."""
    digest, out = xxhash.xxh64_intdigest, []
    for text in texts:
        words = text.lower().split() if text else []
        if len(words) > width:
            rows = {digest(b" ".join(x), SEED) for x in zip(*[words[i:] for i in range(width)])}
        else:
            rows = {digest(b" ".join(words), SEED)} if words else ()
        out.append(np.sort(np.fromiter(rows, np.uint64, len(rows))))
    return out


def wide_fingerprints(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[sets, WORDS]: the majority bits of the hashes, and of what a mixer makes of them, of sets one after another."""
    out = np.empty((len(counts), WORDS), np.uint64)
    for i in range(WORDS):
        out[:, i] = majority(hashes, counts)
        hashes = (hashes ^ (hashes >> np.uint64(30))) * MIXER
        hashes = hashes ^ (hashes >> np.uint64(27))
    return out


def band_keys(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[sets, BANDS]: a hash of each band's minima, of sets (none empty) that stand one after another in hashes."""
    starts = np.cumsum(counts) - counts
    keys = np.zeros((len(counts), BANDS), np.uint64)
    for i, order in enumerate(ORDERS):
        band = keys[:, i // BAND_ROWS]
        low = np.minimum.reduceat(hashes * order, starts)
        band[:] = (band ^ low) * MIXER
        band ^= band >> np.uint64(29)
    return keys


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """Of each row doc_id, text_key (a hash of the text), node (of its shingle set), FP (SimHash of that set), size and band keys."""

    def make(rows: dict[str, list]) -> dict[str, object]:
        sets = shingle_sets(rows["text"], width)
        counts = np.array([len(x) for x in sets], np.int64)
        hashes = np.concatenate(sets)
        own = np.flatnonzero(counts)
        keys = iter(band_keys(hashes, counts[own]).view(np.int64) if len(own) else ())
        node = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
        bands = [next(keys) if c else [] for c in counts.tolist()]
        fps = wide_fingerprints(hashes, counts).view(np.int64)
        made = {"doc_id": rows["doc_id"], "text_key": rows["text_key"], "node": node.view(np.int64), "size": counts, "bands": bands}
        return made | {f: np.ascontiguousarray(fps[:, i]) for i, f in enumerate(FP)}

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(text_col).alias("text_key"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, f"doc_id long, text_key long, node long, size long, bands array<long>, {', '.join(f'{f} long' for f in FP)}")


#: What tells rows apart but for repeated ones; unnamed: whether the id is null. Rows without an id come last.
ROW_KEY = ["unnamed", "id", "text_key"]


def row_key(id_col: str) -> tuple[Column, Column]:
    named = F.col(f"`{id_col}`").cast("long")
    return named.isNull().alias("unnamed"), F.coalesce(named, F.lit(0)).alias("id")


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.col(text_col).cast("string"))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int, most: int | None = None) -> Iterator[tuple[list[pa.RecordBatch], bool]]:
    """Runs of rows that agree in the first ``keys`` columns, of batches sorted by these, and whether a run is whole.

    With ``most``, a run of more rows comes in parts, each but the first behind the run's first row, none of them whole.
    """
    held: list[pa.RecordBatch] = []
    last, rows, whole = None, 0, True
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy() for i in range(keys)]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        for start, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
            key = tuple(c[start] for c in columns)
            if held and key != last:
                yield held, whole
                held, rows, whole = [], 0, True
            elif most and rows > most:
                yield held, False
                held, rows, whole = [held[0].slice(0, 1)], 1, False
            held.append(batch.slice(start, end - start))
            last, rows = key, rows + end - start
    if held:
        yield held, whole


def candidate_links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) that connect, within each bucket of a band, the sets whose wide SimHash is within the radius.

    Members of a bucket of over CHUNK are linked without a comparison; their component is told apart when it is
    compared by the sets themselves.
    """
    out = arrow_schema(distinct.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

        def meet_small() -> pa.RecordBatch:
            node, fps = np.concatenate([n for n, _ in small]), np.concatenate([f for _, f in small])
            a, b = near_small(fps, np.array([len(n) for n, _ in small]), radius)
            small.clear()
            return links(node[a], node[b])

        for group, whole in sorted_groups(batches, 2, CHUNK):
            n = sum(b.num_rows for b in group)
            if n < 2:
                continue
            node = np.concatenate([b.column(2).to_numpy() for b in group])
            if n > CHUNK or not whole:
                yield links(node[1:], np.full(n - 1, node[0]))
                continue
            fps = np.stack([np.concatenate([b.column(3 + i).to_numpy() for b in group]).view(np.uint64) for i in range(WORDS)], axis=1)
            if n > 64:
                a, b = near_large(fps, None, radius)
                yield links(node[a], node[b])
                continue
            small.append((node, fps))
            waiting += n
            if waiting >= 1 << 15:
                yield meet_small()
                waiting = 0
        if small:
            yield meet_small()

    keyed = distinct.select(F.posexplode("bands").alias("band", "value"), "node", *FP)
    dealt = keyed.repartition("band", "value").sortWithinPartitions("band", "value", "node")
    links = map_batches(dealt, run, "a long, b long").distinct()
    # a set is linked with the smallest of its buckets, which may be another in each band: it keeps the smallest of
    # these, which takes over the links to the others, and many sets share them
    low = F.min("b").over(Window.partitionBy("a"))
    pairs = F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))))
    return links.withColumn("low", low).select(pairs.alias("pair")).select("pair.*").filter("a <> b").distinct()


def similar_groups(sets: list[np.ndarray], fp: np.ndarray, radius: int, least: float, label: np.ndarray | None = None, left: np.ndarray | None = None) -> np.ndarray:
    """The first member that each set reaches over pairs whose exact Jaccard similarity is at least ``least``.

    The bit-sliced comparison of the wide SimHash proposes pairs. A set is compared with those that its group does not
    hold yet, so copies of one text cost a comparison each. ``label``: groups known before; ``left``: the members
    of which one must be in every pair (all, if None).
    """
    n = len(sets)
    size = np.array([len(x) for x in sets])
    label = np.arange(n) if label is None else np.unique(label, return_inverse=True)[1]
    label = np.unique(label, return_index=True)[1][label]  # a group's first member
    asking = np.arange(n) if left is None else np.flatnonzero(left)
    planes = slice_planes(fp)
    step = max(1, LANES_AT_ONCE // max(len(planes), 1))
    for at in range(0, len(asking), step):
        own = asking[at : at + step]
        for i, mask in zip(own.tolist(), near_masks(fp[own], planes, radius), strict=True):
            word, lane = set_lanes(mask)
            open_ = word * 64 + lane
            open_ = open_[open_ < (i if left is None else n)]
            open_ = open_[(label[open_] != label[i]) & (np.minimum(size[open_], size[i]) >= least * np.maximum(size[open_], size[i]))]
            if len(open_) > 1:
                open_ = open_[np.argsort(np.bitwise_count(fp[open_] ^ fp[i]).sum(axis=1), kind="stable")]
            while len(open_):
                j, open_ = open_[0], open_[1:]
                both = common(sets[i], sets[j])
                if both >= least * (size[i] + size[j] - both) - 1e-9:
                    low, high = sorted((label[i], label[j]))
                    label[label == high] = low
                    open_ = open_[label[open_] != label[i]]
    return label


def common(a: np.ndarray, b: np.ndarray) -> int:
    """How many numbers two sorted sets share."""
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) if len(a) else 0


def compared(rows: DataFrame, keys: list[str], width: int, radius: int, least: float) -> DataFrame:
    """Links (a, b) that connect what is similar within each group of rows (keys, node, known, asks, text).

    known: a group that the node is known to be in; asks: whether the node is on the left of pairs.
    """
    out = arrow_schema(rows.sparkSession, "a long, b long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, _ in sorted_groups(batches, len(keys)):
            node, known, asks, sets, fps = [], [], [], [], []
            for batch in group:
                for at in range(0, batch.num_rows, 64):
                    part = batch.slice(at, 64)
                    node.append(part.column("node").to_numpy())
                    known.append(part.column("known").to_numpy())
                    asks.append(part.column("asks").to_numpy(zero_copy_only=False))
                    new = shingle_sets(part.column("text").to_pylist(), width)
                    sets += new
                    fps.append(wide_fingerprints(np.concatenate(new), np.array([len(x) for x in new], np.int64)))
            node, known, asks = np.concatenate(node), np.concatenate(known), np.concatenate(asks)
            label = similar_groups(sets, np.concatenate(fps), radius, least, known, None if asks.all() else asks)
            moved = node[label] != node
            yield pa.RecordBatch.from_arrays([pa.array(node[moved]), pa.array(node[label[moved]])], schema=out)

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "node").select(*keys, "node", "known", "asks", "text")
    return map_batches(dealt, run, "a long, b long")


def verified_links(members: DataFrame, texts: DataFrame, width: int, radius: int, least: float) -> DataFrame:
    """Links (a, b) that connect the similar sets of each component of candidates.

    members: label, node, size and ROW_KEY; texts: ROW_KEY and text. A component of over CHUNK_SHINGLES is
    dealt into chunks. Each chunk is compared within itself and with PIVOTS members that all of them meet; then those
    that are not in the component's largest group so far are compared with all others, chunk by chunk. So a dense
    group costs about as many comparisons as members, no pair of different groups is left out, and no task holds
    more than two chunks.
    """
    weights = members.groupBy("label").agg(F.ceil(F.sum("size") / F.lit(CHUNK_SHINGLES)).cast("int").alias("chunks"))
    dealt = members.join(weights, "label").withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = cut_lineage(dealt.select("label", "node", "size", *ROW_KEY, "chunks", "chunk"))

    def with_texts(rows: DataFrame) -> DataFrame:
        return rows.join(texts, ROW_KEY).dropDuplicates(ROW_KEY)  # a row that is repeated

    large = dealt.filter("chunks > 1")
    if large.isEmpty():
        single = with_texts(dealt).select("label", "node", F.col("node").alias("known"), F.lit(True).alias("asks"), "text")
        return compared(single, ["label"], width, radius, least)
    whole = cut_lineage(with_texts(dealt))
    place = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("node"), "node"))
    pivots = large.select("label", "node", place.alias("place")).filter(F.col("place") <= PIVOTS).select("label", "node")
    pivots = whole.join(pivots, ["label", "node"], "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    pivots = pivots.filter("other <> chunk").withColumn("chunk", F.col("other")).drop("other")
    first = whole.unionByName(pivots).select("label", "chunk", "node", F.col("node").alias("known"), F.lit(True).alias("asks"), "text")
    links = cut_lineage(compared(first, ["label", "chunk"], width, radius, least))

    so_far = large.select("label", "node", "size").join(components(links).withColumnRenamed("label", "known"), "node", "left").withColumn("known", F.coalesce("known", "node"))
    most = so_far.groupBy("label", "known").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max(F.struct("n", "known")).alias("most")).select("label", F.col("most.known").alias("most"))
    state = so_far.join(most, "label").select("label", "node", "size", "known", (F.col("known") != F.col("most")).alias("rest"))
    rest = state.filter("rest").groupBy("label").agg(F.ceil(F.sum("size") / F.lit(CHUNK_SHINGLES)).cast("int").alias("parts"))
    state = cut_lineage(state.join(rest, "label").drop("size"))
    if state.isEmpty():
        return links
    met = whole.join(state, ["label", "node"]).select("label", "node", "known", "rest", "chunk", "chunks", "parts", "text")
    asks = met.filter("rest").withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    others = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    columns = ["label", "part", "chunk", "node", "known"]
    second = asks.select(*columns, F.lit(True).alias("asks"), "text").unionByName(others.select(*columns, F.lit(False).alias("asks"), "text"))
    return links.union(compared(second, ["label", "part", "chunk"], width, radius, least))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, radius: int = 76, least: float = 0.8) -> DataFrame:
    """docs with one row of each component of near-duplicates, all columns as they are.

    Two texts are linked where the Jaccard similarity of their sets of ``width``-word shingles is ``least`` or more.
    Equal sets are merged first; sets that share a band of minima meet, and the bit-sliced comparison of their wide
    SimHash (``radius`` of its 256 bits) proposes pairs, of which the exact similarity of their shingles decides.
    Texts without words are one component.

    The row that stays is that of the smallest id; a null id comes after all others. Of several rows with that id the one
    whose text has the smallest hash stays, and of equal rows one (by a hash of the whole row), so the result does not
    depend on partitions. The texts are shuffled once, by id, and those of candidates once more. An empty table gives
    no rows; other columns may have any name.
    """
    thin = cut_lineage(sketches(docs, id_col, text_col, width))
    rep = F.min(F.struct(*row_key("doc_id"), "text_key"))
    rows = thin.count()
    distinct = cut_lineage(gathered(thin.groupBy("node").agg(rep.alias("rep"), *[F.any_value(c).alias(c) for c in ("size", "bands", *FP)]), rows))
    labels = components(candidate_links(distinct, radius))
    members = labels.join(distinct.select("node", "size", "rep.*"), "node")
    texts = docs.select(*row_key(id_col), text_key(text_col).alias("text_key"), as_bytes(text_col).alias("text"))
    groups = components(verified_links(members, texts, width, radius, least))
    chosen = distinct.select("node", "rep").join(groups, "node", "left").groupBy(F.coalesce("label", "node").alias("group")).agg(F.min("rep").alias("rep"))
    # the columns of docs travel as one, so that no name can clash
    kinds = dict(docs.dtypes)
    hashed = [F.col(f"`{c}`") for c in docs.columns if "map<" not in kinds[c] and "variant" not in kinds[c]]
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key(id_col), text_key(text_col).alias("text_key"), F.xxhash64(*hashed).alias("turn"))
    kept = packed.join(cut_lineage(gathered(chosen.select("rep.*"), rows)), ROW_KEY, "left_semi")
    first = F.row_number().over(Window.partitionBy(*ROW_KEY).orderBy("turn"))
    return kept.withColumn("first", first).filter("first = 1").select("row.*")
