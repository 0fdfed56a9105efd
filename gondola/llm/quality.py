"""Quality rules: how much of a text lies inside repeated n-grams and lines."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import as_bytes, map_slices

SYMBOLS = b"#*$%&|<>"
#: Largest share of a text's word characters inside repeated n-grams of each length, and inside repeated lines.
MOST_REPEATED = {5: 0.40, 7: 0.35, 10: 0.30}
MOST_IN_LINES = 0.40

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def scramble(ids: np.ndarray) -> np.ndarray:
    """64-bit hashes of small integers (the finaliser of splitmix64)."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more."""
    order = np.argsort(keys, kind="stable")
    equal = np.r_[False, keys[order][1:] == keys[order][:-1]]
    out = np.zeros(len(keys), bool)
    out[order] = equal | np.r_[equal[1:], False]
    return out


def spread(hit: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie inside a window of n words whose start is in hit."""
    step = np.zeros(total + 1, np.int32)
    step[hit] += 1
    step[hit + n] -= 1
    return np.cumsum(step[:-1]) > 0


def measure(texts: list[bytes | None], lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The figures of texts, all of them at once. Words of different texts get different codes, so windows of one text never equal another's."""
    words_of = [t.split() if t else [] for t in texts]
    counts = np.array([len(w) for w in words_of], np.int64)
    total = int(counts.sum())
    codes, sizes, base = [], [], 0
    for text, words in zip(texts, words_of, strict=True):
        code: defaultdict[bytes, int] = defaultdict()
        code.default_factory = lambda c=code, b=base: b + len(c)
        codes.append(np.fromiter(map(code.__getitem__, words), np.int64, len(words)))
        sizes.append(np.fromiter(map(len, words if not text or text.isascii() else [w.decode("utf-8", "replace") for w in words]), np.int64, len(words)))
        base += len(code)
    code, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (codes, sizes))
    text_of = np.repeat(np.arange(len(texts)), counts)
    per_text = lambda x: np.bincount(text_of, weights=x, minlength=len(texts)).astype(np.int64)
    windows = lambda n: np.flatnonzero(text_of[: total - n + 1] == text_of[n - 1 :]) if total >= n else np.zeros(0, np.int64)

    out = {"n_words": counts, "word_chars": per_text(size)}
    at = windows(3)
    _, pair = np.unique(code[at] * base + code[at + 1], return_inverse=True)
    out["n_repeat_words"] = per_text(spread(at[repeated(pair * base + code[at + 2])], 3, total))

    own, rolling = scramble(code), np.zeros(total, np.uint64)
    for n in range(1, max(lengths) + 1):
        rolling = (rolling[: total - n + 1] * MULTIPLIER + own[n - 1 :]) if total >= n else rolling[:0]
        if n in lengths:
            at = windows(n)
            out[f"in_{n}_grams"] = per_text(size * spread(at[repeated(rolling[at])], n, total))

    symbols, lines, line_chars = [], [], []
    for text in texts:
        text = text or b""
        symbols.append(len(text) - len(text.translate(None, SYMBOLS)))
        n = chars = 0
        split = text.split(b"\n")
        if len(set(split)) < len(split):
            seen = set()
            for line in split:
                if line in seen and line.split():
                    n += 1
                    chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
                seen.add(line)
        lines.append(n)
        line_chars.append(chars)
    return out | {"n_symbols": np.array(symbols), "n_dup_lines": np.array(lines), "in_lines": np.array(line_chars)}


def quality(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_repeated: dict[int, float] | None = None,
    most_in_lines: float = MOST_IN_LINES,
    least_words: int = 50,
    most_repeat_percent: int = 50,
) -> DataFrame:
    """Repetition figures of each whole text, and whether it is kept.

    Counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (words in repeated windows of three, exact).
    share_N: the share of the word characters that lie inside n-grams of N words that occur twice or more in the
    text, found by rolling hashes; share_lines: the share inside lines equal to an earlier one. base_failed: fewer
    than ``least_words`` words, or over ``most_repeat_percent`` percent of them in repeated windows. kept: the base
    has not failed and no share is over its bound.

    Returns one row per input row. A null or empty text has no words and fails the base; null ids and repeated
    rows are kept; an empty table gives no rows. Columns besides the two are not read.
    """
    bounds = MOST_REPEATED if most_repeated is None else most_repeated
    lengths = tuple(sorted(bounds))

    def make(rows: dict[str, list]) -> dict[str, object]:
        got = measure(rows["text"], lengths)
        share = lambda x: x / np.maximum(got["word_chars"], 1)
        shares = {f"share_{n}": share(got[f"in_{n}_grams"]) for n in lengths} | {"share_lines": share(got["in_lines"])}
        failed = (got["n_words"] < least_words) | (100 * got["n_repeat_words"] > most_repeat_percent * got["n_words"])
        over = (shares["share_lines"] > most_in_lines) | np.any([shares[f"share_{n}"] > bounds[n] for n in lengths], axis=0)
        return got | shares | {"doc_id": rows["doc_id"], "base_failed": failed, "kept": ~(failed | over)}

    shares = ", ".join(f"share_{n} double" for n in (*lengths, "lines"))
    counts = ", ".join(f"{n} long" for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))
    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, f"doc_id long, {counts}, base_failed boolean, kept boolean, {shares}")
