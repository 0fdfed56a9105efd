"""SimHash against definitions and brute force."""

import re

import numpy as np
import pytest
import xxhash

from gondola.llm import common, simhash

SCHEMA = "doc_id long, text string, fp int"  # fp: a name that the operator uses itself


def plain_fingerprint(text, width=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    out = {}
    for i, x in enumerate(ids):
        out.setdefault(root(i), []).append(x)
    return {x: min(group) for group in out.values() for x in group}


def test_fingerprints():
    long = " ".join(f"w{i % 700}" for i in range(1500))
    texts = ["A b\tc d e", "one two", "", None, "   \n", "ÄÖ x y z w", "x " * 300, long]
    got = simhash.fingerprint_texts([None if t is None else t.encode() for t in texts], 4)
    assert [int(x) for x in got] == [plain_fingerprint(t) for t in texts]


@pytest.mark.parametrize("radius", [0, 3, 4, 6])
def test_bit_sliced_distances(radius):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 3, dtype=np.uint64)
    members = np.array([base[i % 3] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False))) for i in range(150)])
    planes = simhash.slice_planes(members)
    for word in range(len(planes)):
        got = simhash.match_lanes(members, np.full(len(members), word), planes, radius)
        for i, mask in enumerate(got.tolist()):
            lanes = [j for j in range(64) if mask >> j & 1 and 64 * word + j < len(members)]
            assert lanes == [j for j in range(64) if 64 * word + j < len(members) and (int(members[i]) ^ int(members[64 * word + j])).bit_count() <= radius]


def near_family(n, seed):
    """Random fingerprints with chains of neighbours."""
    rng = np.random.default_rng(seed)
    out = [int(x) for x in rng.integers(0, 2**63, n // 2)]
    while len(out) < n:
        out.append(out[rng.integers(len(out))] ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 8), replace=False)))
    return sorted(set(out))


@pytest.mark.parametrize("chunk", [4096, 64])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, chunk):
    fps = near_family(400, 5)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    from pyspark.sql import functions as F

    for blocks in (5, 7):
        keyed = df.select("fp", simhash.bucket_keys(F.col("fp"), 4, blocks).alias("key")).select("key.kind", "key.value", "fp")
        found = simhash.link_buckets(keyed, 4)
        links = found.filter("kind is null").select("a", "b")
        labels = {r["node"]: r["label"] for r in simhash.components(links).collect()}
        wanted = brute_components(signed, fps, 4)
        assert {x: labels.get(x, x) for x in signed} == wanted


def test_large_buckets_are_met_in_pairs_of_chunks(spark, monkeypatch):
    fps = np.array(near_family(900, 9), np.uint64)
    signed = fps.view(np.int64).tolist()
    rows = [(x, None, 0, 0, len(signed)) for x in signed]
    monkeypatch.setattr(simhash, "CHUNK", 256)
    links = simhash.link_chunks(spark.createDataFrame(rows, simhash.LINKS), 4)
    labels = {r["node"]: r["label"] for r in simhash.components(links).collect()}
    assert {x: labels.get(x, x) for x in signed} == brute_components(signed, [int(x) for x in fps], 4)


def test_link_large_gives_a_link_a_member_at_most():
    centre = np.uint64(12345)
    dense = np.unique(np.array([centre ^ np.uint64((1 << i) | (1 << j)) for i in range(60) for j in range(i)], np.uint64))
    a, b = simhash.link_large(dense, None, 4)
    assert len(a) == len(dense) - 1 and len(set(b.tolist())) == 1
    a, b = simhash.link_large(dense[:500], dense[500:], 4)
    assert len(a) < len(dense)


def test_components_of_documents(spark):
    body = " ".join(f"word{i}" for i in range(200))
    rows = [(7, body, 1), (3, body, 2), (9, body + " tail", 3), (5, "something else entirely here now", 4), (4, None, 5), (6, "", 6), (8, " \n", 7), (None, body, 8), (None, "lonely text with no id at all", 9), (5, "something else entirely here now", 4)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert of == {7: 3, 3: 3, 9: 3, 5: 5, 4: 4, 6: 4, 8: 4}
    assert sorted(str(r["component_id"]) for r in got if r["doc_id"] is None) == ["3", "None"]
    kept = simhash.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r["doc_id"]), r["fp"]) for r in kept) == [("3", 2), ("4", 5), ("5", 4), ("None", 9)]


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == [] and simhash.deduplicate(none).collect() == []


def jaccard(a, b, width=5):
    one, two = ({tuple(x.split()[i : i + width]) for i in range(len(x.split()) - width + 1)} for x in (a, b))
    return len(one & two) / len(one | two)


def test_edited_copies_are_found_by_five_word_similarity(spark):
    rng = np.random.default_rng(4)
    rows, wanted, similarities = [], {}, []
    for base in range(0, 3000, 100):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
        rows.append((base, " ".join(words), 0))
        for copy in range(1, 7):
            edited = list(words)
            for at in rng.choice(400, 2 * copy - 1, replace=False):
                edited[at] = f"edit{rng.integers(10**6)}"
            rows.append((base + copy, " ".join(edited), 0))
    texts = {i: t for i, t, _ in rows}
    parent = {i: i for i in texts}
    for base in range(0, 3000, 100):
        family = [base + i for i in range(7)]
        changed = True
        while changed:
            changed = False
            for a in family:
                for b in family:
                    if a < b and parent[a] != parent[b] and jaccard(texts[a], texts[b]) >= 0.8:
                        low, high = sorted((parent[a], parent[b]))
                        parent |= {x: low for x in family if parent[x] == high}
                        changed = True
        similarities += [jaccard(texts[base], texts[base + i]) for i in range(1, 7)]
    wanted = {i for i in texts if parent[i] == i}
    assert sum(0.8 <= x <= 0.95 for x in similarities) > 60 and sum(x < 0.8 for x in similarities) > 20
    df = spark.createDataFrame(rows, SCHEMA)
    assert {r["doc_id"] for r in simhash.deduplicate(df).collect()} == wanted


def test_rows_are_kept_not_ids(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(60)) for x in "ab")
    schema = "doc_id long, text string, _fp int, _kept string, _alone int, row int, id string, unnamed int, label int"
    rows = [(1, a, 1, "x", 1, 1, "i", 0, 0), (5, a, 2, "y", 2, 2, "i", 0, 0), (5, b, 3, "z", 3, 3, "i", 0, 0), (None, b, 4, "w", 4, 4, "i", 0, 0), (None, b + " " + a, 5, "v", 5, 5, "i", 0, 0), (5, b, 3, "z", 3, 3, "i", 0, 0), (5, b, 6, "z", 3, 3, "i", 0, 0)]
    outs = []
    for parts in (1, 7):
        got = simhash.deduplicate(spark.createDataFrame(rows, schema).repartition(parts))
        assert got.columns == [c.split()[0] for c in schema.split(", ")]
        outs.append(sorted(map(repr, got.collect())))
    assert outs[0] == outs[1] and len(outs[0]) == 3
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == sorted([("1", a), ("5", b), ("None", b + " " + a)])


def edited_family(n, seed, words=120, edits=4):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 10**6, words)]
    out = []
    for _ in range(n):
        own = list(base)
        for at in rng.choice(words, rng.integers(0, edits), replace=False):
            own[at] = f"e{rng.integers(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_large_components_are_compared_in_chunks(spark, monkeypatch, small):
    """Families around a shared passage, so that all of them are candidates; the result equals an exact search."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{t} {passage}" for seed in range(6) for t in edited_family(25, seed, edits=9)]
    texts += [" ".join(f"n{x}" for x in rng.integers(0, 10**6, 60)) + " " + passage for _ in range(60)]
    if small:
        monkeypatch.setattr(simhash, "CHUNK_SHINGLES", 3000)
        monkeypatch.setattr(simhash, "CHUNK", 16)
        monkeypatch.setattr(simhash, "PIVOTS", 3)
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = simhash.deduplicate(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))


def test_runs_come_in_parts():
    import pyarrow as pa

    batches = [pa.record_batch({"k": [1, 1, 1], "v": [0, 1, 2]}), pa.record_batch({"k": [1, 1, 2], "v": [3, 4, 5]})]
    got = [([x for b in g for x in b.column("v").to_pylist()], whole) for g, whole in simhash.sorted_groups(iter(batches), 1, 2)]
    assert got == [([0, 1, 2], False), ([0, 3, 4], False), ([5], True)]
    assert [len(g) for g, whole in simhash.sorted_groups(iter(batches), 1) if whole] == [2, 1]


@pytest.mark.parametrize("radius", [0, 4, 30, 76])
def test_wide_bit_sliced_distances(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, (3, 4), dtype=np.uint64)
    members = np.array([base[i % 3] ^ np.packbits(rng.random(256) < 0.15 * (i % 4), bitorder="little").view(np.uint64) for i in range(100)])
    planes = simhash.slice_planes(members)
    got = simhash.near_masks(members, planes, radius)
    distance = np.bitwise_count(members[:, None] ^ members[None]).sum(axis=2)
    for i in range(100):
        word, lane = simhash.set_lanes(got[i])
        lanes = word * 64 + lane
        assert set(lanes[lanes < 100].tolist()) == set(np.flatnonzero(distance[i] <= radius).tolist())


@pytest.mark.parametrize("rows", [0, 90])
def test_small_tables_are_kept_in_few_files(spark, monkeypatch, rows):
    cores = spark.sparkContext.defaultParallelism
    monkeypatch.setattr(common, "FILE_ROWS", 10)
    df = spark.range(rows).repartition(40)
    for most, files in ((rows, max(cores, rows // 10)), (0, cores), (1000, 40)):
        kept = common.gathered(df, most)
        assert kept.rdd.getNumPartitions() <= files
        assert sorted(r.id for r in kept.collect()) == list(range(rows))
