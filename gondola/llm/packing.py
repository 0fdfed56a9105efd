"""Packing: token sequences filled by cutting-stock column generation."""

from __future__ import annotations

import logging
import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.llm.common import arrow_schema, as_bytes, cut_lineage, map_batches, map_slices, memo, numbered

END_ID = 2
#: Share of all tokens that rounding lengths up to classes may add before classes are made finer.
MOST_ROUNDING = 0.03


# -- the cutting-stock problem ------------------------------------------------------------------------------------


def best_pattern(worth: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within room of the greatest worth (unbounded knapsack, by dynamic programming)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(sizes)
    ordered, price = sizes[order], worth[order]
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(ordered, c, side="right")
        if k:
            got = best[c - ordered[:k]] + price[:k]
            i = int(np.argmax(got))
            if got[i] > best[c] + 1e-12:
                best[c], pick[c] = got[i], order[i]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= sizes[pick[c]]
    return best[room], pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, room: int, most_rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns and how often each is used in the linear program: fewest bins that cover the demand of each size.

    A revised simplex over the patterns: its basis starts with bins of one size each, its prices go to the
    knapsack, and the pattern worth more than a bin enters. Every basis is feasible, so a bound on the rounds
    costs bins at most.
    """
    # plain sums instead of matrix products: these matrices are too small for threads, which would fight Spark's
    times = lambda matrix, vector: (matrix * vector).sum(axis=1)
    patterns = np.diag(room // sizes).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns))
    used = times(inverse, demand)
    least, since = used.sum(), 0
    for round_ in range(most_rounds):
        worth, pattern = best_pattern(np.maximum(inverse.sum(axis=0), 0), sizes, room)
        enters = times(inverse, pattern)
        able = np.flatnonzero(enters > 1e-9)
        if not worth > 1 + 1e-9 or not len(able) or since > 300:  # optimal, or only turning around
            break
        out = able[np.argmin(used[able] / enters[able])]
        patterns[:, out] = pattern
        row = inverse[out] / enters[out]
        inverse -= np.outer(enters, row)
        inverse[out] = row
        if round_ % 100 == 99:  # a step of Newton's takes rounding errors out of the inverse
            inverse = 2 * inverse - np.einsum("ij,jk->ik", inverse, np.einsum("ij,jk->ik", patterns.astype(float), inverse))
        used = np.maximum(times(inverse, demand), 0)
        least, since = (used.sum(), 0) if used.sum() < least - 1e-9 else (least, since + 1)
    else:
        logging.getLogger(__name__).warning("column generation was ended after %d rounds; it may use more bins than needed", most_rounds)
    return patterns.T, used


def grain_for(lengths: dict[int, int], coarsest: int) -> int:
    """The coarsest class width, of ``coarsest`` halved over and over, at which rounding adds MOST_ROUNDING at most, or 1."""
    total, grain = sum(s * n for s, n in lengths.items()), coarsest
    while grain > 1 and sum((-s % grain) * n for s, n in lengths.items()) > MOST_ROUNDING * total:
        grain //= 2
    return grain


def plan_bins(counts: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """(size: pieces in a bin, bins) so that ``counts`` pieces of each size are all placed, with few bins.

    The linear program's patterns are rounded down; what is left over, less than a bin for each pattern, is
    placed by first fit, largest first. The work depends on the number of sizes, not on that of pieces.
    """
    left = {s: n for s, n in counts.items() if n}
    if not left:
        return []
    sizes = np.array(sorted(left))
    patterns, used = column_generation(sizes, np.array([left[s] for s in sizes], float), room)
    plan: list[tuple[dict[int, int], int]] = []
    for pattern, times in zip(patterns, used, strict=True):
        need = {int(s): int(a) for s, a in zip(sizes, pattern, strict=True) if a}
        bins = min([int(times + 1e-9), *(left[s] // a for s, a in need.items())]) if need else 0
        if bins:
            plan.append((need, bins))
            for s, a in need.items():
                left[s] -= a * bins
    while any(left.values()):
        need, space = {}, room
        for s in sorted(left, reverse=True):
            if take := min(left[s], space // s):
                need[s] = take
                space -= take * s
        bins = min(left[s] // a for s, a in need.items())
        plan.append((need, bins))
        for s, a in need.items():
            left[s] -= a * bins
    return plan


# -- tokens ---------------------------------------------------------------------------------------------------------


#: A run of Latin-1 letters and at most one mark: what the vocabulary's normaliser and splitter do to it is known.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,]?)\Z")
#: The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: b for b in PRINTABLE} | {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(PRINTABLE)))}


class WordCoder:
    """Ids (little-endian 32-bit) of words between white space, which the vocabulary never joins across.

    Plain words go straight to the merges, their letters in lower case, which spares normalising and splitting;
    all others go through the whole tokenizer. Both give the same ids.
    """

    def __init__(self, path: str, most_runs: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.runs: dict[str, bytes] = {}
        self.most_runs = most_runs

    def run(self, letters: str) -> bytes:
        found = self.runs.get(letters)
        if found is None:
            mapped = letters.encode().decode("latin-1").translate(BYTE_CHARS)
            found = array("I", [t.id for t in self.merge(mapped)]).tobytes()
            if len(self.runs) < self.most_runs:
                self.runs[letters] = found
        return found

    def __call__(self, words: list[bytes]) -> list[bytes]:
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [PLAIN.match(t) for t in texts]
        rest = [t for t, m in zip(texts, plain, strict=True) if not m]
        coded = iter(self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))
        out = []
        for m in plain:
            if m:
                out.append(self.run(m[1].lower()) + self.run(m[2]) if m[2] else self.run(m[1].lower()))
            else:
                out.append(array("I", next(coded).ids).tobytes())
        return out


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, seq_len: int, end_id: int, with_ids: bool) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of seq_len and a rest."""
    end = np.array([end_id], "<u4").tobytes()

    def make(rows: dict[str, list]) -> dict[str, object]:
        store = memo(("tokens", tokenizer), lambda: WordCoder(tokenizer))
        coded = store.join([t.split() if t else [] for t in rows["text"]])
        out: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids)}
        for doc_id, ids in zip(rows["doc_id"], coded, strict=True):
            ids += end
            for at in range(0, len(ids), 4 * seq_len):
                piece = ids[at : at + 4 * seq_len]
                for n, v in (("doc_id", doc_id), ("start", at // 4), ("length", len(piece) // 4), ("ids_crc32", zlib.crc32(piece)), ("doc_tokens", len(ids) // 4)):
                    out[n].append(v)
                if with_ids:
                    out["ids"].append(np.frombuffer(piece, "<i4"))
        return out

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


# -- the operator -----------------------------------------------------------------------------------------------------


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    seq_len: int = 4096,
    grain: int = 16,
    end_id: int = END_ID,
    with_ids: bool = False,
) -> DataFrame:
    """Pack all documents' token ids into sequences of at most seq_len with little padding.

    Ids are those of the vocabulary file ``tokenizer`` (of the tokenizers library) without special tokens, and
    then end_id. A document longer than seq_len is cut into full pieces and a rest. The lengths' histogram (seq_len
    rows at most, whatever the input) is all that the driver sees: it solves the cutting-stock problem over classes of
    ``grain`` tokens, or of fewer where texts are so short that rounding would waste room (see grain_for), and pieces,
    ranked within their class, are dealt to the patterns' places.

    Returns one row per piece: doc_id, start, length, ids_crc32 (of the piece's little-endian 32-bit ids),
    doc_tokens, sequence_id, offset, and with_ids also ids. A null text counts as empty: such a document is the
    id end_id alone. Null ids and repeated rows are kept, each packed by itself; an empty table gives no rows.
    Columns besides the two are not read.
    """
    pieces = cut_lineage(token_pieces(docs, tokenizer, id_col, text_col, seq_len, end_id, with_ids))
    lengths = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    grain = grain_for(lengths, grain)
    room, counts = seq_len // grain, dict[int, int]()
    for length, n in lengths.items():
        counts[-(-length // grain)] = counts.get(-(-length // grain), 0) + n
    pieces = pieces.withColumn("_class", F.ceil(F.col("length") / grain).cast("int"))

    # places of a class, in order of rank: bins from `first`, `each` in every one, from rank `rank`
    places: dict[int, list[tuple[int, int, int]]] = {}
    ranks, first = dict.fromkeys(counts, 0), 0
    for need, bins in plan_bins(counts, room):
        for size, each in need.items():
            places.setdefault(size, []).append((ranks[size], first, each))
            ranks[size] += bins * each
        first += bins
    tables = {size: np.array(rows, np.int64).T for size, rows in places.items()}

    ranked = numbered(pieces, "_class", ["doc_id", "start", "ids_crc32"], counts, "_rank")
    schema = ", ".join(f"{n} {t}" for n, t in ranked.dtypes if n not in ("_class", "_rank")) + ", sequence_id long"
    out = arrow_schema(docs.sparkSession, schema)

    def place(batches):
        for batch in batches:
            size, rank = batch.column("_class").to_numpy(), batch.column("_rank").to_numpy()
            sequence = np.zeros(len(size), np.int64)
            for s in np.unique(size):
                own = np.flatnonzero(size == s)
                starts, firsts, each = tables[int(s)]
                i = np.searchsorted(starts, rank[own], side="right") - 1
                sequence[own] = firsts[i] + (rank[own] - starts[i]) // each[i]
            yield pa.RecordBatch.from_arrays([pa.array(sequence) if n == "sequence_id" else batch.column(n) for n in out.names], schema=out)

    within = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start", "ids_crc32")
    before = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, -1))
    return map_batches(ranked, place, schema).withColumn("offset", F.coalesce(before, F.lit(0)).cast("long"))
