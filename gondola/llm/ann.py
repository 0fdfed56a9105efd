"""Approximate nearest neighbours: a forest of random-projection trees, and exact reranking."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import arrow_schema, cut_lineage, hash_share, map_batches

#: Directions that the splits of all trees are drawn from, so that a tree's size does not depend on the vectors'.
DIRECTIONS = 512
#: Rows of the sample that a leaf holds at least.
LEAST_SAMPLED = 8
#: Bytes of the sample that trees are grown on, of a block of queries with their leaves, and of a slab of vectors.
SAMPLE_BYTES, BLOCK_BYTES, SLAB_BYTES = 1 << 26, 1 << 25, 1 << 23
#: Queries whose true neighbours are found by brute force to learn the number of probes.
TRIED = 200


@dataclass
class Forest:
    """Trees whose splits compare a vector's product with a direction to an offset.

    Nodes of all trees are numbered together; children: [nodes, 2], below 0 for leaf -1 - child. A root below 0 is a
    tree of one leaf.
    """

    directions: np.ndarray
    chosen: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    roots: np.ndarray
    leaves: int

    def project(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.directions.T

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: [vectors, trees]; leaves are numbered across the trees."""
        out = np.empty((len(vectors), len(self.roots)), np.int32)
        for first in range(0, len(vectors), 2048):
            products = self.project(vectors[first : first + 2048])
            at = np.tile(self.roots, (len(products), 1))
            row, tree = np.nonzero(at >= 0)
            while len(row):
                node = at[row, tree]
                side = products[row, self.chosen[node]] > self.offsets[node]
                at[row, tree] = node = self.children[node, side.astype(np.int8)]
                row, tree = row[node >= 0], tree[node >= 0]
            out[first : first + len(at)] = -1 - at
        return out

    def searcher(self) -> Callable[[np.ndarray, int], list[int]]:
        """A function that gives the leaves which a vector's shared queue reaches first, from its products.

        An entry's key is the sum of the squared margins of the splits at which its path leaves the vector's side, which
        estimates the squared distance to the far cell. Margins are worked out along the paths that are taken only.
        """
        chosen, offsets, left, right = self.chosen.tolist(), self.offsets.tolist(), self.children[:, 0].tolist(), self.children[:, 1].tolist()
        roots = self.roots.tolist()
        push, pop = heapq.heappush, heapq.heappop

        def search(products: np.ndarray, probes: int) -> list[int]:
            along = products.tolist()
            queue = [(0.0, root) for root in roots]
            out: list[int] = []
            while queue and len(out) < probes:
                key, node = pop(queue)
                while node >= 0:
                    margin = along[chosen[node]] - offsets[node]
                    if margin > 0:
                        push(queue, (key + margin * margin, left[node]))
                        node = right[node]
                    else:
                        push(queue, (key + margin * margin, right[node]))
                        node = left[node]
                out.append(-1 - node)
            return out

        return search

    def search(self, vector: np.ndarray, probes: int) -> list[int]:
        """The ``probes`` leaves of all trees that a shared queue reaches first."""
        return self.searcher()(self.project(vector[None])[0], probes)

    def leaf_keys(self, products: np.ndarray) -> np.ndarray:
        """The key of every leaf for one vector; children always have greater numbers than their node."""
        margins = products[self.chosen] - self.offsets
        keys, out = np.zeros(len(margins)), np.zeros(self.leaves)
        nodes = self.roots[self.roots >= 0]
        while len(nodes):
            below = []
            for side in (0, 1):
                child = self.children[nodes, side]
                key = keys[nodes] + np.where((margins[nodes] > 0) == bool(side), 0, margins[nodes] ** 2)
                inner = child >= 0
                keys[child[inner]] = key[inner]
                out[-1 - child[~inner]] = key[~inner]
                below.append(child[inner])
            nodes = np.concatenate(below)
        return out


def grow(sample: np.ndarray, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Grow trees on a sample, level by level: each node splits its rows at the median of their products with a random
    direction; directions are differences of two rows each."""
    rng = np.random.default_rng(seed)
    n = len(sample)
    pairs = sample[rng.integers(0, max(n, 1), (2, DIRECTIONS))] if n else np.zeros((2, 1, sample.shape[1]))
    directions = pairs[0] - pairs[1]
    lengths = np.linalg.norm(directions, axis=1)
    directions = directions[lengths > 1e-9] / lengths[lengths > 1e-9, None]
    products = (sample @ directions.T).astype(np.float32)
    chosen, offsets, children, roots = [], [], [], []
    nodes = leaves = 0

    def leaf() -> int:
        nonlocal leaves
        leaves += 1
        return -leaves

    for _ in range(trees):
        if n <= leaf_rows or not len(directions):
            roots.append(leaf())
            continue
        roots.append(nodes)
        rows, sizes = np.arange(n), np.array([n])  # the rows of a level's nodes, one node after another
        while len(sizes):
            pick = rng.integers(0, len(directions), len(sizes))
            of = np.repeat(np.arange(len(sizes)), sizes)
            along = products[rows, pick[of]]
            order = np.lexsort((along, of))
            rows, along = rows[order], along[order]
            starts = np.cumsum(sizes) - sizes
            middle = starts + (sizes - 1) // 2
            cut = along[middle]
            right = along > cut[of]
            first = nodes + len(sizes)
            own = np.empty((len(sizes), 2), np.int64)
            counts = np.stack([sizes - np.bincount(of[right], minlength=len(sizes)), np.bincount(of[right], minlength=len(sizes))], axis=1)
            # products that are equal leave one side empty: the other then is a leaf, as is a side of few rows
            goes_on = (counts > leaf_rows) & (counts.min(axis=1, keepdims=True) > 0)
            for i, side in zip(*np.nonzero(~goes_on), strict=True):
                own[i, side] = leaf()
            own[goes_on] = first + np.arange(goes_on.sum())
            chosen.append(pick)
            offsets.append(cut)
            children.append(own)
            nodes = first
            keep = goes_on[of, right.astype(int)]
            rows = rows[keep]  # a node's rows are ordered by their products, so its left side comes before its right
            sizes = counts[goes_on]
    none = np.zeros(0, np.int64)
    return Forest(directions, np.concatenate([none, *chosen]), np.concatenate([np.zeros(0), *offsets]).astype(float), np.concatenate([np.zeros((0, 2), np.int64), *children]), np.array(roots), leaves)


def usable(column: str) -> Column:
    """Whether a vector takes part: not null, finite everywhere, and not zero."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(~F.exists(column, bad) & F.exists(column, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """Vectors in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def distinct_rows(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each distinct row, the distinct row of each row)."""
    keys = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
    _, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return first, of.ravel()


class Slab:
    """Vectors that a task searches together: distinct ones, each with its k + 1 smallest ids, in their leaves."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        first, of = distinct_rows(vectors)
        order = np.lexsort((ids, of))
        ids, of = ids[order], of[order]
        new = np.r_[True, (ids[1:] != ids[:-1]) | (of[1:] != of[:-1])]
        ids, of = ids[new], of[new]
        starts = np.searchsorted(of, np.arange(len(first)))
        few = np.arange(len(of)) - starts[of] <= k
        self.ids, of = ids[few], of[few]
        self.starts = np.searchsorted(of, np.arange(len(first) + 1))
        self.vectors = vectors[first]
        self.single = self.vectors.astype(np.float32)
        self.slack = 4 * vectors.shape[1] * 2.0**-24 * float(np.sqrt((self.vectors**2).sum(axis=1).max()))
        self.k = k

    def set_leaves(self, leaves: np.ndarray, number: int) -> None:
        flat = leaves.ravel()
        self.members = (np.argsort(flat, kind="stable") // leaves.shape[1]).astype(np.int32)
        self.leaf_starts = np.r_[0, np.cumsum(np.bincount(flat, minlength=number))]
        self.seen = np.zeros(len(self.vectors), bool)

    def rows_in(self, leaves: np.ndarray) -> np.ndarray:
        """The rows that lie in any of the leaves."""
        start, size = self.leaf_starts[leaves], self.leaf_starts[leaves + 1] - self.leaf_starts[leaves]
        start, size = start[size > 0], size[size > 0]
        self.seen[:] = False
        if len(size):
            self.seen[self.members[np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())]] = True
        return np.flatnonzero(self.seen)

    def best(self, query: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, scores, rows) of the k + 1 best distinct ids among rows: scores falling, ties to smaller ids.

        Single precision leaves out rows that are too far for its errors to matter; the rest are scored in double.
        """
        if len(rows) > 2 * self.k + 2:
            near = self.single[rows] @ query.astype(np.float32)
            cut = np.partition(near, len(near) - self.k - 1)[len(near) - self.k - 1]
            rows = rows[near >= cut - 2 * self.slack * float(np.linalg.norm(query))]
        scores = self.vectors[rows] @ query
        counts = self.starts[rows + 1] - self.starts[rows]
        at = np.repeat(self.starts[rows] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        ids, scores, rows = self.ids[at], np.repeat(scores, counts), np.repeat(rows, counts)
        order = np.lexsort((ids, -scores))
        _, first = np.unique(ids[order], return_index=True)
        order = order[np.sort(first)[: self.k + 1]]
        return ids[order], scores[order], rows[order]


def slabs(batches: Iterator[pa.RecordBatch], size: int, k: int) -> Iterator[Slab]:
    """The rows (id, v) of batches, in slabs of SLAB_BYTES."""
    ids, vectors, rows = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 8192):
            part = batch.slice(at, 8192)
            ids.append(part.column("id").to_numpy())
            vectors.append(matrix(part.column("v"), size))
            rows += part.num_rows
            if rows * size * 8 >= SLAB_BYTES:
                yield Slab(np.concatenate(ids), np.concatenate(vectors), k)
                ids, vectors, rows = [], [], 0
    if rows:
        yield Slab(np.concatenate(ids), np.concatenate(vectors), k)


def true_neighbours(index: DataFrame, queries: np.ndarray, size: int, k: int) -> pa.Table:
    """The k + 1 nearest of a few queries among all rows, by brute force in blocks: q, id, score, v."""
    kind = dict(index.dtypes)["v"]
    schema = f"q int, id long, score double, v {kind}"
    out = arrow_schema(index.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, size, k):
            every = np.arange(len(slab.vectors))
            for q, query in enumerate(queries):
                ids, scores, rows = slab.best(query, every)
                flat = slab.vectors[rows].ravel()
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * size), pa.array(flat).cast(out.field("v").type.value_type))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q, np.int32)), pa.array(ids), pa.array(scores), lists.cast(out.field("v").type)], schema=out)

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    return map_batches(index, run, schema).withColumn("place", place).filter(F.col("place") <= k + 1).orderBy("q", "place").toArrow()


def probes_for(forest: Forest, index: DataFrame, asked: DataFrame, lift: Callable[[np.ndarray, bool], np.ndarray], size: int, k: int, least_recall: float) -> int:
    """The fewest probes that reach ``least_recall`` of the true neighbours of TRIED queries, found by brute force over index.

    A neighbour is reached by the first of its leaves, one in each tree, that a query's queue gives.
    """
    tried = asked.orderBy(F.xxhash64("v"), "id").limit(TRIED).toArrow()
    if not tried.num_rows:
        return len(forest.roots)
    own, vectors = tried.column("id").to_numpy(), matrix(tried.column("v").combine_chunks(), size)
    best = true_neighbours(index, vectors, size, k)
    asking, ids = best.column("q").to_numpy(), best.column("id").to_numpy()
    leaves = forest.leaves_of(lift(matrix(best.column("v").combine_chunks(), size), False))
    needed: list[int] = []
    for i, products in enumerate(forest.project(lift(vectors, True))):
        rows = np.flatnonzero((asking == i) & (ids != own[i]))[:k]
        keys = forest.leaf_keys(products)
        needed += (np.searchsorted(np.sort(keys), keys[leaves[rows]].min(axis=1), side="right")).tolist() if len(rows) else []
    if not needed:
        return len(forest.roots)
    return max(len(forest.roots), sorted(needed)[int(np.ceil(least_recall * len(needed))) - 1])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    trees: int = 24,
    leaf_rows: int = 64,
    probes: int | None = None,
    most_sample: int = 32_768,
    seed: int = 7,
    least_recall: float = 0.92,
) -> DataFrame:
    """The k vectors of largest inner product, of those that a forest of random-projection trees finds.

    The trees are grown on about ``most_sample`` vectors (chosen by a hash of id and vector, SAMPLE_BYTES at most);
    every row is then put into its leaf in each tree. Leaves hold about ``leaf_rows`` rows, and more where that would
    leave under LEAST_SAMPLED rows of the sample in one. A query takes ``probes`` leaves from all trees by one
    priority queue; if none are given, as many as give ``least_recall`` on TRIED of the queries, whose true neighbours
    among all rows are found by brute force. The rows in these leaves, and no others, are scored by their exact inner
    products, in double precision on the original vectors. For directions the trees see vectors scaled to unit
    length, which keeps the order of inner products where lengths are equal; where they differ, one more component
    that makes all lengths equal is added to the candidates (0 for queries), which reduces the largest inner
    product to the nearest direction.

    Vectors never move: each task puts its own rows into leaves, slab by slab, and meets the queries, which come in
    blocks of BLOCK_BYTES with the leaves that they take; a slab gives each query's k + 1 best. Equal vectors of a slab
    are scored once, with their k + 1 smallest ids, and equal queries of a block once, so a hot vector costs no pairs.

    Returns query_id, rank (from 1), vec_id, score, with a query's own id left out; fewer than k rows where fewer
    candidates were found. Vectors that are null, zero, or hold a null or a non-finite component take no part, nor do
    those of another length than most, nor null ids. Repeated rows (equal id and vector) count once; an id with
    several vectors is one candidate for each of them. Empty tables give no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" == dict(queries.dtypes)[vector_col] else "array<double>"
    read = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(kind).alias("v")).filter(F.col("id").isNotNull() & usable("v"))
    squared = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    found_sizes = read(vectors).groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.max(squared).alias("longest"), F.min(squared).alias("shortest")).orderBy(F.desc("n"), "size").first()
    if found_sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n, longest, shortest = found_sizes
    even = longest - shortest <= 1e-3 * longest
    scale = float(np.sqrt(longest))
    index = read(vectors).filter(F.size("v") == size)
    asked = read(queries).filter(F.size("v") == size)

    def lift(v: np.ndarray, query: bool) -> np.ndarray:
        v = v / scale  # before squares are taken, which could overflow
        length = np.sqrt((v**2).sum(axis=1))
        if query or even:
            v = v / np.maximum(length, 1e-300)[:, None]
            return np.c_[v, np.zeros(len(v))]
        return np.c_[v, np.sqrt(np.maximum(1 - length**2, 0))]

    most = max(1, min(most_sample, SAMPLE_BYTES // (8 * (size + 1))))
    sample = index.filter(hash_share(n, most, "id", "v")).select("v").toArrow()
    grown = matrix(sample.column("v").combine_chunks(), size) if sample.num_rows else np.zeros((0, size))
    grown = grown[np.sort(distinct_rows(grown)[0])] if len(grown) else grown
    grown = lift(grown[np.lexsort(grown.T)] if len(grown) else grown, False)
    forest = grow(grown, trees, max(LEAST_SAMPLED, round(leaf_rows * len(grown) / max(n, 1))), seed)
    if probes is None:
        probes = probes_for(forest, index, asked, lift, size, k, least_recall)
    shared = spark.sparkContext.broadcast(forest)

    taken_schema = "id long, leaves array<int>, v " + kind
    taken_arrow = arrow_schema(spark, taken_schema)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = shared.value.searcher()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                products = shared.value.project(lift(matrix(part.column("v"), size), True))
                chosen = [np.array(search(x, probes), np.int32) for x in products]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(chosen, taken_arrow.field("leaves").type), part.column("v").cast(taken_arrow.field("v").type)], schema=taken_arrow)

    total = asked.count()
    blocks = max(1, -(-total * (8 * size + 4 * min(probes, forest.leaves) + 16) // BLOCK_BYTES))
    results = []
    for block in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block) if blocks > 1 else asked
        found = search_block(index, map_batches(own, take, taken_schema).toArrow(), shared, lift, size, k)
        results.append(cut_lineage(found) if blocks > 1 else found)  # a block's queries need not be kept
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_block(index: DataFrame, taken: pa.Table, shared, lift: Callable[[np.ndarray, bool], np.ndarray], size: int, k: int) -> DataFrame:
    """query_id, vec_id and score of what a block of queries (id, leaves, v) finds, the own id left out."""
    spark = index.sparkSession
    if not taken.num_rows:
        return spark.createDataFrame([], "query_id long, vec_id long, score double")
    asking = matrix(taken.column("v").combine_chunks(), size)
    first, of = distinct_rows(asking)
    lists = taken.column("leaves").combine_chunks().take(pa.array(first))
    ends, flat = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())], lists.flatten().to_numpy()
    block = spark.sparkContext.broadcast((asking[first], ends, flat))
    out = arrow_schema(spark, "q int, vec_id long, score double")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, (queries, ends, leaves) = shared.value, block.value
        for slab in slabs(batches, size, k):
            slab.set_leaves(forest.leaves_of(lift(slab.vectors, False)), forest.leaves)
            parts = []
            for q, query in enumerate(queries):
                rows = slab.rows_in(leaves[ends[q] : ends[q + 1]])
                if len(rows):
                    ids, scores, _ = slab.best(query, rows)
                    parts.append((np.full(len(ids), q, np.int32), ids, scores))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], schema=out)

    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    best = map_batches(index, meet, "q int, vec_id long, score double").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    best = best.withColumn("place", place).filter(F.col("place") <= k + 1)
    owners = spark.createDataFrame(pa.table({"q": pa.array(of.astype(np.int32)), "query_id": taken.column("id")}), "q int, query_id long")
    # the block bounds its owners
    return best.join(F.broadcast(owners), "q").filter("vec_id <> query_id").select("query_id", "vec_id", "score")
