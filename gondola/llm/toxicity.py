"""Toxicity: a factorization machine over hashed terms."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import as_bytes, cut_lineage, hash_share, keep_rows, map_slices, memo

#: Terms are hashed to so many bits.
HASH_BITS = 22
LETTERS = re.compile(r"[^\W\d_]+")
#: Besides words, their beginnings of these lengths are terms, so inflected forms share one.
PREFIXES = (4, 5, 6)


def terms_of(word: str) -> set[int]:
    """Hashed terms of what stands between white space: its letter runs and their beginnings, in lower case."""
    out = set()
    for run in LETTERS.findall(word.lower()):
        for term in (run, *(f"{run[:n]}*" for n in PREFIXES if len(run) > n)):
            out.add(xxhash.xxh64_intdigest(term.encode("utf-8", "replace")) & ((1 << HASH_BITS) - 1))
    return out


@dataclass
class FactorizationMachine:
    """A logistic score: a bias, a weight per term, and the product of two terms' factors for each pair.

    terms: the sorted hashes of the terms that count; every other term has weight and factors 0.
    """

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    @property
    def name(self) -> str:
        """A digest of the contents."""
        parts = (self.terms, np.array([self.bias]), self.weights, self.factors)
        return hashlib.blake2b(b"".join(x.tobytes() for x in parts), digest_size=16).hexdigest()

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        """Scores of rows of distinct term numbers. Pairs cost no more than terms: sum(f)^2 - sum(f^2), halved."""
        z = np.full(len(rows), self.bias)
        for i, own in enumerate(rows):
            if len(own):
                f = self.factors[own]
                z[i] += self.weights[own].sum() + 0.5 * (f.sum(axis=0) ** 2 - (f * f).sum(axis=0)).sum()
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = 8, steps: int = 4000, seed: int = 7) -> FactorizationMachine:
    """Fit by about ``steps`` steps of Adam on mini-batches of the logistic loss; rows hold distinct term numbers."""
    rng = np.random.default_rng(seed)
    rate = np.clip(labels.mean() if len(labels) else 0.0, 1e-3, 1 - 1e-3)
    theta = {"b": np.array([np.log(rate / (1 - rate))]), "w": np.zeros(len(terms)), "v": rng.normal(0, 0.02, (len(terms), factors))}
    first, second = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    step, n = 0, len(rows)
    sizes = np.array([len(r) for r in rows])
    starts = np.cumsum(sizes) - sizes
    flat = np.concatenate(rows) if n else np.zeros(0, np.int64)
    for _ in range(-(-steps // -(-n // 256)) if len(terms) and n else 0):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            batch = order[at : at + 256]
            own = np.repeat(np.arange(len(batch)), sizes[batch])
            within = np.arange(len(own)) - np.repeat(np.cumsum(sizes[batch]) - sizes[batch], sizes[batch])
            t = flat[np.repeat(starts[batch], sizes[batch]) + within]
            f = theta["v"][t]
            total, square = np.zeros((len(batch), factors)), np.zeros((len(batch), factors))
            np.add.at(total, own, f)
            np.add.at(square, own, f * f)
            z = theta["b"][0] + np.bincount(own, weights=theta["w"][t], minlength=len(batch)) + 0.5 * (total**2 - square).sum(axis=1)
            slope = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels[batch]) / len(batch)
            grad = {"b": np.array([slope.sum()]), "w": np.bincount(t, weights=slope[own], minlength=len(terms)) + 1e-5 * theta["w"], "v": 1e-4 * theta["v"]}
            np.add.at(grad["v"], t, slope[own, None] * (total[own] - f))
            step += 1
            for k, g in grad.items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                theta[k] -= 0.03 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(terms, float(theta["b"][0]), theta["w"], theta["v"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_docs: int = 16_000,
    least_docs: int = 3,
    least_z: float = 4.0,
) -> FactorizationMachine:
    """Fit on the texts of ``docs`` that ``labels`` (id_col and label_col, 0 or 1) marks.

    About ``most_docs`` labelled ids are read, chosen by a hash of the id, which also bounds what is broadcast; an id
    with both labels counts as 1. Of copies, and of texts that share the least or the greatest of their shingle
    hashes, the one of the smallest id counts, so that a passage copied many times does not pass for a sign of its label.
    The terms that count are those in ``least_docs`` texts at least that differ by ``least_z`` deviations from what the
    labels' share lets expect. The model does not depend on partitions. Null ids, labels and texts teach nothing;
    without any rows the model gives every text the same score, below 0.5.
    """
    marks = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id is not null and label in (0, 1)").groupBy("id").agg(F.max("label").alias("label"))
    chosen_marks = marks.filter(hash_share(marks.count(), most_docs, "id"))
    sample = docs.select(F.col(id_col).cast("string").alias("id"), as_bytes(text_col).alias("text")).filter("text is not null").join(F.broadcast(chosen_marks), "id")

    def make(part: dict[str, list]) -> dict[str, object]:
        sets, least, other = [], [], []
        for text in part["text"]:
            words = text.split() if text else []
            sets.append(sorted(set().union(*map(terms_of, {w.decode("utf-8", "replace") for w in words}))))
            shingles = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4])) for i in range(max(1, len(words) - 3))]
            least.append(min(shingles) >> 1)
            other.append(max(shingles) >> 1)
        return {"id": part["id"], "label": part["label"], "terms": sets, "least": least, "other": other}

    found = map_slices(sample, make, "id string, label int, terms array<int>, least long, other long")
    for key, rest in (("least", "other"), ("other", "least")):
        # two steps, so that a hot passage is cut down before its rows meet
        first = F.min(F.struct("id", rest, "terms")).alias("first")
        found = found.groupBy(key, "label").agg(first).select(key, "label", "first.*")
    texts = cut_lineage(found)
    n, positive = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not n:
        return FactorizationMachine(np.zeros(0, np.int64), -4.0, np.zeros(0), np.zeros((0, 1)))
    share = positive / n
    expected = F.col("docs") * share
    z = (F.col("hits") - expected) / F.sqrt(expected * (1 - share) + 1e-9)
    stats = texts.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("label").alias("hits"))
    chosen = stats.filter(F.col("docs") >= least_docs).withColumn("z", F.abs(z)).filter(F.col("z") >= least_z)
    terms = np.array(sorted(r["term"] for r in chosen.collect()), np.int64)

    def keep(part: dict[str, list]) -> dict[str, object]:
        own = [np.searchsorted(terms, np.intersect1d(np.array(t, np.int64), terms)) for t in part["terms"]]
        return {"label": part["label"], "terms": own}

    found = map_slices(texts.select("label", "terms"), keep, "label int, terms array<int>").collect()
    found.sort(key=lambda r: (r[0], r[1]))
    return train(terms, [np.array(r[1], np.int64) for r in found], np.array([r[0] for r in found], float))


def scorer(docs: DataFrame, model: FactorizationMachine) -> Callable[[list[bytes | None]], np.ndarray]:
    """What gives the scores of texts on the executors."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = model.name

    def work(words: list[bytes]) -> list[bytes]:
        machine, out = shared.value, []
        for w in words:
            t = np.fromiter(terms_of(w.decode("utf-8", "replace")), np.int64)
            at = np.searchsorted(machine.terms, t)
            hit = at < len(machine.terms)
            hit[hit] = machine.terms[at[hit]] == t[hit]
            out.append(at[hit].astype(np.int32).tobytes())
        return out

    def scores(texts: list[bytes | None]) -> np.ndarray:
        store = memo(("toxic terms", name), lambda: work)
        found = store.join([t.split() if t else [] for t in texts])
        return shared.value.score([np.unique(np.frombuffer(x, np.int32)) for x in found])

    return scores


def score(docs: DataFrame, model: FactorizationMachine, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Toxicity of each whole text: doc_id, score (0 to 1) and predicted (1 if the score is ``threshold`` or more).

    One row per input row. A null or empty text has no terms and gets the score of the bias alone; null ids and
    repeated rows are kept; an empty table gives no rows. Columns besides the two are not read.
    """
    scores = scorer(docs, model)

    def make(rows: dict[str, list]) -> dict[str, object]:
        got = scores(rows["text"])
        return {"doc_id": rows["doc_id"], "score": got, "predicted": (got >= threshold).astype(np.int32)}

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores ``threshold`` or more; all columns pass through, null texts stay."""
    scores = scorer(docs, model)
    return keep_rows(docs, text_col, lambda texts: scores(texts) < threshold)
