"""Approximate nearest neighbours against brute force."""

import numpy as np
import pytest

from gondola.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)


def brute(vectors, queries, k):
    out = {}
    for q, v in queries:
        scores = [(-float(np.dot(np.float64(np.float32(v)), np.float64(np.float32(w)))), i) for i, w in vectors if i != q]
        out[q] = [i for _, i in sorted(scores)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["vec_id"])
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("lengths", ["equal", "unequal"])
def test_recall(spark, lengths):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 24))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if lengths == "unequal":
        v *= rng.uniform(0.5, 2, (3000, 1))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = rows[::100]
    got = found(ann.nearest(frame(spark, rows), frame(spark, queries), k=10))
    wanted = brute(rows, queries, 10)
    assert np.mean([len(set(got[q]) & set(wanted[q])) / 10 for q in wanted]) >= 0.9


def test_hot_vector_ties_and_own_id(spark):
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [0.0, 1.0]), (101, [0.5, 0.5])]
    got = found(ann.nearest(frame(spark, rows), frame(spark, rows[:2] + rows[-1:]), k=5))
    assert got[0] == [1, 2, 3, 4, 5] and got[1] == [0, 2, 3, 4, 5] and got[101] == [0, 1, 2, 3, 4]


def test_unusable_vectors_repeats_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    got = ann.nearest(frame(spark, rows), frame(spark, rows), k=5)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect()) == [(1, 1, 2, 0.0), (2, 1, 1, 0.0)]


def test_empty(spark):
    none = frame(spark, []).limit(0)
    assert ann.nearest(none, none).collect() == []
    assert ann.nearest(frame(spark, [(1, [1.0])]), none).collect() == []


def test_forest_search_reaches_every_leaf():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 8))
    forest = ann.grow(v, 3, 10, 1)
    leaves = forest.leaves_of(v)
    assert sorted(forest.search(v[0], 10**6)) == list(range(forest.leaves))
    assert forest.search(v[0], 3)[0] in leaves[0] and set(leaves[0]) <= set(forest.search(v[0], 3))
    assert np.bincount(leaves[:, 0]).max() <= 10


def test_recall_holds_where_leaves_are_many(spark):
    rng = np.random.default_rng(8)
    v = rng.normal(size=(20_000, 32)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    queries = rows[::200]
    got = found(ann.nearest(frame(spark, rows), frame(spark, queries), k=10, leaf_rows=16))
    scores = v[::200].astype(float) @ v.astype(float).T
    scores[np.arange(100), np.arange(0, 20_000, 200)] = -2
    wanted = np.argsort(-scores, axis=1)[:, :10]
    assert np.mean([len(set(got[i * 200]) & set(wanted[i].tolist())) / 10 for i in range(100)]) >= 0.9


def clustered(n, seed=5, clusters=150, size=32):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, size))
    v = centres[rng.integers(0, clusters, n)] + 0.35 * rng.normal(size=(n, size))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize("n", [4000, 40_000])
def test_few_vectors_are_seen_where_vectors_have_structure(n):
    """At two sizes ten times apart, the probes that reach 0.92 of the neighbours hold a tenth of the rows at most."""
    v = clustered(n)
    lifted = np.c_[v, np.zeros(n)]
    forest = ann.grow(lifted[:32_768], 24, 64, 7)
    leaves, asked = forest.leaves_of(lifted), np.arange(0, n, n // 100)
    needed, truth = [], []
    for q in asked:
        near = np.argsort(-(v @ v[q]))[1:21]
        truth.append(near)
        turn = np.empty(forest.leaves, int)
        order = forest.search(lifted[q], forest.leaves)
        turn[order] = np.arange(len(order))
        needed.append(turn[leaves[near]].min(axis=1) + 1)
    probes = int(np.quantile(np.concatenate(needed), 0.92))
    seen = [np.isin(leaves, forest.search(lifted[q], probes)).any(axis=1) for q in asked]
    assert np.mean(seen) <= 0.1
    assert np.mean([s[near].mean() for s, near in zip(seen, truth, strict=True)]) >= 0.9


def test_recall_of_clustered_vectors(spark):
    v = clustered(4000).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = found(ann.nearest(frame(spark, rows), frame(spark, rows[::40]), k=20))
    wanted = brute(rows, rows[::40], 20)
    assert np.mean([len(set(got[q]) & set(wanted[q])) / 20 for q in wanted]) >= 0.9


def test_leaf_keys_order_as_the_queue_does():
    v = np.random.default_rng(2).normal(size=(400, 6))
    forest = ann.grow(v, 3, 10, 1)
    keys = forest.leaf_keys(forest.project(v[:1])[0])
    order = forest.search(v[0], forest.leaves)
    assert (np.diff(keys[order]) >= -1e-12).all() and set(order) == set(range(forest.leaves))


def test_queries_in_blocks_and_huge_components(spark, monkeypatch):
    v = np.random.default_rng(4).normal(size=(300, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    whole = found(ann.nearest(frame(spark, rows), frame(spark, rows[::3]), k=5))
    monkeypatch.setattr(ann, "BLOCK_BYTES", 4000)
    assert found(ann.nearest(frame(spark, rows), frame(spark, rows[::3]), k=5)) == whole
    big = spark.createDataFrame([(i, [1e200 * float(y) for y in x]) for i, x in enumerate(v[:50])], "vec_id long, embedding array<double>")
    assert ann.nearest(big, big, k=5).count() == 250


def test_hot_query_vector_with_many_ids(spark):
    rows = [(i, [1.0, 0.5]) for i in range(500)] + [(1000 + i, [float(i), 1.0]) for i in range(20)]
    got = found(ann.nearest(frame(spark, rows), frame(spark, rows), k=5))
    assert len(got) == 520 and all(len(x) == 5 and q not in x for q, x in got.items()) and got[0] == [1019, 1018, 1017, 1016, 1015]
