"""Language identification by character language models with interpolated Kneser-Ney smoothing."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import as_bytes, hash_share, keep_rows, map_slices, memo

ORDER = 5
UNKNOWN = "und"
START, END = 1, 2
#: What training splits texts by, too: number signs such as \u00bd or \u2167 are no letters.
LETTERS = regex.compile(r"\p{L}+")
#: Characters that an unseen one is one of.
ALPHABET = 4096
#: Bits a character by which short texts may take more: this over the root of their characters, as the mean of few
#: characters strays further.
SHORT = 10.0
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the n-grams that end at each character, [positions, ORDER + 1]; their contexts' hashes; each position's word).

    A word stands between ORDER - 1 start marks and an end mark, which is predicted too. Row k of the hashes is
    the k-gram's; its context is the k - 1 characters before.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + ORDER
    chars = np.full(sizes.sum(), START, np.uint64)
    ends = np.cumsum(sizes)
    inner = np.ones(len(chars), bool)
    first = ends - sizes
    for i in range(ORDER - 1):
        inner[first + i] = False
    at = np.flatnonzero(inner)
    chars[at] = np.frombuffer("".join([w + chr(END) for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    mixed = (chars + np.uint64(1)) * MIX
    mixed ^= mixed >> np.uint64(29)
    whole, context = np.zeros((ORDER + 1, len(at)), np.uint64), np.zeros((ORDER + 1, len(at)), np.uint64)
    power = np.uint64(1)
    powers = np.cumprod(np.full(ORDER, STEP))
    for k in range(1, ORDER + 1):
        whole[k] = whole[k - 1] + mixed[at - (k - 1)] * power
        if k > 1:
            context[k] = context[k - 1] + mixed[at - (k - 1)] * power
        power = powers[k - 1]
    return whole, context, np.repeat(np.arange(len(words)), sizes - (ORDER - 1))


def counted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, sums of weights, and a place of each key."""
    distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
    return distinct, np.bincount(of, weights=weights, minlength=len(distinct)), first


@dataclass
class LanguageModels:
    """Models of languages: per order sorted n-gram hashes with discounted probabilities [n-grams, languages], and sorted context hashes with the weights of the lower order."""

    languages: list[str]
    grams: list[tuple[np.ndarray, np.ndarray]]
    contexts: list[tuple[np.ndarray, np.ndarray]]
    sharpness: float = 1.0
    most_bits: np.ndarray | None = None

    @property
    def name(self) -> str:
        """A digest of the contents."""
        h = hashlib.blake2b("\0".join(self.languages).encode(), digest_size=16)
        for keys, values in self.grams + self.contexts:
            h.update(keys.tobytes() + values.tobytes())
        return h.hexdigest()

    def bits(self, words: list[str]) -> np.ndarray:
        """Bits of each word in each language, its end included: [words, languages]."""
        out = np.zeros((len(words), len(self.languages)))
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            whole, context, word = grams(part)
            p = np.full((whole.shape[1], len(self.languages)), 1 / ALPHABET)
            for k in range(1, ORDER + 1):
                p *= look_up(*self.contexts[k], context[k], 1.0)
                p += look_up(*self.grams[k], whole[k], 0.0)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            out[at : at + len(part)] = np.add.reduceat(-np.log2(p), starts, axis=0)
        return out


def look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    got = values[at].astype(np.float64)
    got[keys[at] != wanted] = missing
    return got


def train(counts: dict[str, Counter[str]]) -> LanguageModels:
    """Models from each language's word counts.

    The highest order uses counts, lower orders the numbers of distinct characters that precede an n-gram; each
    order's discount is n1 / (n1 + 2 n2), and what it takes goes to the next lower order.
    """
    languages = sorted(counts)
    discounted: list[list] = [[] for _ in range(ORDER + 1)]
    weights: list[list] = [[] for _ in range(ORDER + 1)]
    for number, language in enumerate(languages):
        words = sorted(counts[language])
        whole, context, word = grams(words)
        weight = np.array([counts[language][w] for w in words], float)[word]
        place = np.arange(len(word))
        for k in range(ORDER, 0, -1):
            keys, n, first = counted(whole[k][place], weight)
            place = place[first]
            once, twice = (n == 1).sum(), (n == 2).sum()
            discount = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1
            contexts, total, _ = counted(context[k][place], n)
            of = np.searchsorted(contexts, context[k][place])
            kinds = np.bincount(of, minlength=len(contexts))
            discounted[k].append((keys, np.maximum(n - discount, 0) / total[of], number))
            weights[k].append((contexts, np.minimum(1.0, discount * kinds / total), number))
            weight = np.ones(len(place))  # below, each distinct n-gram counts once for its suffix
    merge = lambda parts, missing: merged(parts, len(languages), missing)
    return LanguageModels(languages, [merge(x, 0.0) for x in discounted], [merge(x, 1.0) for x in weights])


def merged(parts: list, languages: int, missing: float) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of all languages, and their values by language."""
    keys = np.unique(np.concatenate([k for k, _, _ in parts])) if parts else np.zeros(0, np.uint64)
    values = np.full((len(keys), languages), missing, np.float32)
    for own, value, number in parts:
        values[np.searchsorted(keys, own), number] = value
    return keys, values


def calibrate(models: LanguageModels, rows: list[tuple[str, list[float]]], deviations: float, slack: float = 1.5) -> None:
    """Set the sharpness of scores and the most bits a character that a language's text may take: ``deviations`` above
    the mean of its texts, and ``slack`` times that mean at least, so that texts with names, numbers or a foreign
    passage pass. A language of which no such text is at hand rejects nothing.

    rows: (true language, bits a character in each language) of texts that the models have not seen.
    """
    known = [(models.languages.index(lang), np.array(bits)) for lang, bits in rows if lang in models.languages and len(bits)]
    models.most_bits = np.full(len(models.languages), np.inf)
    if not known:
        return
    truth, bits = np.array([t for t, _ in known]), np.stack([b for _, b in known])

    def loss(sharpness: float) -> float:
        z = -bits * sharpness
        z -= z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]))

    models.sharpness = min((2.0 ** (i / 2) for i in range(-2, 15)), key=loss)
    for i in range(len(models.languages)):
        own = bits[truth == i, i]
        own = own[np.argmin(bits[truth == i], axis=1) == i]
        if len(own):
            models.most_bits[i] = max(own.mean() + deviations * own.std(), slack * own.mean())


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    most_docs: int = 1000,
    deviations: float = 6.0,
) -> LanguageModels:
    """Fit models on ``labelled`` rows: about ``most_docs`` of each language, chosen by a hash of id and text.

    That bound also bounds the words that reach the driver. A fifth of the rows is kept from the models to
    calibrate scores and rejection. Rows without a language or without letters teach nothing; without any rows
    there are no languages, and every prediction is 'und'.
    """
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang is not null and text is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & hash_share(n, most_docs, "id", "text"))
    tuning = F.pmod(F.xxhash64(F.lit("tuning"), "id", "text"), F.lit(5)) == 0
    sample = rows.filter(chosen)
    words = sample.filter(~tuning).select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word"))
    counts: dict[str, Counter[str]] = {}
    found = words.filter("word <> ''").groupBy("lang", "word").count().toArrow()
    for part in found.to_batches():
        for lang, word, n in zip(*(c.to_pylist() for c in part.columns), strict=True):
            counts.setdefault(lang, Counter())[word] = n
    models = train(counts)
    if models.languages:
        held = measure(sample.filter(tuning), models, "id", "text", "lang").select("lang", "bits").collect()
        calibrate(models, [(r[0], r[1]) for r in held], deviations)
    return models


def measurer(docs: DataFrame, models: LanguageModels) -> Callable[[list[bytes | None]], list]:
    """What gives, on the executors, the bits a character of texts in each language (none for a text without letters)
    and their characters."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    name, n = models.name, len(models.languages)

    def work(words: list[bytes]) -> list[bytes]:
        runs = [LETTERS.findall(w.decode("utf-8", "replace").lower()) for w in words]
        flat = [x for r in runs for x in r]
        own = np.repeat(np.arange(len(words)), [len(r) for r in runs])
        values = np.zeros((len(words), n + 1), np.float32)
        if flat:
            np.add.at(values[:, :n], own, shared.value.bits(flat))
            np.add.at(values[:, n], own, [len(x) + 1 for x in flat])
        return [x.tobytes() for x in values]

    def bits(texts: list[bytes | None]) -> list:
        store = memo(("languages", name), lambda: work)
        out = []
        for values in store.join([t.split() if t else [] for t in texts]):
            total = np.frombuffer(values, np.float32).reshape(-1, n + 1).sum(axis=0, dtype=float)
            out.append((total[:n] / total[n] if total[n] else [], int(total[n])))
        return out

    return bits


def measure(docs: DataFrame, models: LanguageModels, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Bits a character of each whole text in each language (empty: no letters), its characters, and the columns ``more``."""
    measured = measurer(docs, models)

    def make(rows: dict[str, list]) -> dict[str, object]:
        got = measured(rows["_text"])
        return {k: v for k, v in rows.items() if k != "_text"} | {"bits": [b for b, _ in got], "chars": [n for _, n in got]}

    kinds = dict(docs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (id_col, *more))
    return map_slices(docs.select(id_col, *more, as_bytes(text_col).alias("_text")), make, f"{schema}, bits array<double>, chars long")


def drop_foreign(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """docs without the rows that predict() would mark rejected; all columns pass through."""
    measured = measurer(docs, models)
    most = models.most_bits

    def keep(texts: list[bytes | None]) -> list[bool]:
        return [len(b) > 0 and (most is None or b[i := int(np.argmin(b))] <= most[i] + SHORT / n**0.5) for b, n in measured(texts)]

    return keep_rows(docs, text_col, keep)


def predict(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The language of each whole text.

    lang_pred: the language whose model takes fewest bits a character, ties to the earlier name; 'und' if the text
    is null or has no letter, or there are no models. score: the calibrated share of that language, 0 for 'und'.
    bits: what it takes. rejected: 'und', or more bits than texts of the language take (see calibrate; short
    texts may take more), as text of a language outside the models does.

    Returns one row per input row: doc_id, lang_pred, score, bits, rejected. Null ids and repeated rows are kept;
    an empty table gives no rows. No other column is read.
    """
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = measure(thin, models, "doc_id", "text")
    names = F.array(*[F.lit(x) for x in models.languages]) if models.languages else F.array().cast("array<string>")
    bounds = [float(x) for x in (models.most_bits if models.most_bits is not None else np.full(len(models.languages), np.inf))]
    most: Column = F.array(*[F.lit(x) for x in bounds]) if bounds else F.array().cast("array<double>")
    low = F.array_min("bits")
    best = F.array_position("bits", low)
    weight = F.aggregate("bits", F.lit(0.0), lambda a, b: a + F.exp((F.col("low") - b) * models.sharpness))
    known = F.coalesce(F.size("bits") > 0, F.lit(False))
    at = lambda array: F.try_element_at(array, F.col("best").cast("int"))
    return (
        found.withColumn("low", low)
        .withColumn("best", F.when(known, best))
        .select(
            "doc_id",
            F.when(known, at(names)).otherwise(UNKNOWN).alias("lang_pred"),
            F.when(known, 1 / weight).otherwise(0.0).alias("score"),
            F.col("low").alias("bits"),
            F.when(known, F.col("low") > at(most) + SHORT / F.sqrt("chars")).otherwise(True).alias("rejected"),
        )
    )
