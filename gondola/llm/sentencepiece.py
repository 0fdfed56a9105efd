"""SentencePiece encoding by a batched Viterbi search, and decoding."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.llm.common import as_bytes, map_slices, memo

SPACE = "▁"
BASE = np.uint64(0x100000001B3)
#: Chunks: spaces and what follows up to the next space or newline. No piece goes across their borders.
CHUNKS = re.compile(rb" *[^ \n]+|\n| +")
#: Longest word that is searched together with others of its length; longer ones are searched one by one.
TOGETHER = 48
UNKNOWN_PENALTY = 10.0
#: Ends of pieces of a long word whose pairs are looked at together.
ENDS_AT_ONCE = 100_000


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of variable length, and where it ends."""
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if data[at - 1] < 128:
            return value, at


def fields(data: bytes) -> dict[int, object]:
    """The last value of each field of an encoded message: bytes or a number."""
    out: dict[int, object] = {}
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        if key & 7 == 0:
            out[key >> 3], at = varint(data, at)
        elif key & 7 == 2:
            size, at = varint(data, at)
            out[key >> 3], at = data[at : at + size], at + size
        else:
            size = {1: 8, 5: 4}[key & 7]
            out[key >> 3], at = data[at : at + size], at + size
    return out


#: Where a model file holds the settings of its trainer, there its type, and the type of byte-pair models.
TRAINER, MODEL_TYPE, BYTE_PAIR = 2, 3, 2


class Pieces:
    """The pieces of a model file: sorted hashes with ids and scores, and what each id decodes to.

    A unigram model's encoding is the segmentation whose scores have the greatest sum. A byte-pair model's scores only
    rank its merges; its encoding is the one segmentation in which the merges leave every two neighbouring pieces
    as they are, so there the search runs over pairs of neighbours that are stable in this sense.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            self.byte_pair = fields(fields(f.read()).get(TRAINER, b"")).get(MODEL_TYPE, 1) == BYTE_PAIR
        size = model.get_piece_size()
        text = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(SPACE in text[i].lstrip(SPACE) or "\n" in text[i] or " " in text[i] for i in plain):
            raise ValueError("a piece holds white space behind a letter; chunks would cut it")
        byte_ids = [i for i in range(size) if model.is_byte(i)]
        if len(byte_ids) != 256:
            raise ValueError("the model has no byte pieces, so not every text could be encoded")
        self.byte_id = np.array(byte_ids, np.uint32)
        self.longest = max(len(text[i]) for i in plain)
        self.power = np.r_[np.uint64(1), np.cumprod(np.full(2 * self.longest, BASE))]
        hashes = np.zeros(len(plain), np.uint64)
        lengths = np.array([len(text[i]) for i in plain])
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            chars = np.frombuffer("".join([text[plain[j]] for j in own.tolist()]).encode("utf-32-le"), "<u4").astype(np.uint64).reshape(-1, length)
            hashes[own] = poly(chars)[:, -1]
        order = np.argsort(hashes)
        self.keys = hashes[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.ids = np.array(plain, np.int64)[order]
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        self.unknown = self.scores.min() - UNKNOWN_PENALTY
        self.bytes_of = [b"" if model.is_control(i) or model.is_unknown(i) else text[i].replace(SPACE, " ").encode() for i in range(size)]
        for value, i in enumerate(byte_ids):
            self.bytes_of[i] = bytes([value])
        if self.byte_pair:
            self.learn_merges(text, plain, hashes, [model.get_score(i) for i in plain])

    def learn_merges(self, text: list[str], plain: list[int], hashes: np.ndarray, scores: list[float]) -> None:
        """For each piece when its last merge is made (rank; -1: a single character), and of which two pieces.

        A piece that its own merges do not lead to is never part of an encoding, so it is left out of the search.
        """
        places = {s: r for r, s in enumerate(sorted(set(scores), reverse=True))}
        self.rank_of = {text[i]: places[s] for i, s in zip(plain, scores, strict=True)}
        self.id_of = {text[i]: i for i in plain}
        self.text = text
        n = len(text)
        self.rank, self.left, self.right, self.length, self.hash = np.full(n, -1), np.arange(n), np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.uint64)
        self.length[plain], self.hash[plain] = [len(text[i]) for i in plain], hashes
        if not {c for i in plain for c in text[i]} <= set(self.id_of):
            raise ValueError("a character of a piece is no piece")
        self.place = np.array([self.rank_of.get(t, n) for t in text])
        self.reached, self.mixed = np.ones(n, bool), np.zeros(n, bool)
        by_length: dict[int, list[int]] = {}
        for i in plain:
            by_length.setdefault(len(text[i]), []).append(i)
        shared = {r for r, times in Counter(self.rank_of[text[i]] for i in plain if len(text[i]) > 1).items() if times > 1}
        for length in sorted(by_length.keys() - {1}):
            # the last merge is the split whose parts no better merge crosses
            splits = [(i, self.id_of.get(text[i][:k], -1), self.id_of.get(text[i][k:], -1)) for i in by_length[length] for k in range(1, length)]
            i, left, right = np.array([x for x in splits if x[1] >= 0 <= x[2]], np.int64).reshape(-1, 3).T
            own = (self.place[i] > np.maximum(self.rank[left], self.rank[right])) & ~self.mixed[left] & ~self.mixed[right]
            i, left, right = i[own], left[own], right[own]
            own = self.stable(left, right, self.place[i])
            self.left[i[own]], self.right[i[own]], self.rank[i[own]] = left[own], right[own], self.place[i[own]]
            for j in by_length[length]:
                if self.rank[j] < 0 or self.rank[j] in shared:
                    # the rank does not tell when the parts were made, as in runs of spaces, which share one: tried out
                    self.mixed[j], self.reached[j] = True, len(self.merged(text[j])) == 1

    def merged(self, text: str) -> list[str]:
        """What the merges make of a text, the best rank first and then the leftmost."""
        parts, none = list(text), len(self.text)
        while len(parts) > 1:
            ranks = [self.rank_of.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
            if (best := min(ranks)) == none:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Id (-1: none) and score (-inf: none) of substrings, by their hashes."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        hit = self.keys[at] == hashes
        return np.where(hit, self.ids[at], -1), np.where(hit, self.scores[at], -np.inf)

    def stable(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether the merges (of a rank below ``limit``) leave a and b, side by side, as they are.

        Merges are undone from the last on: of a its right part stays at the border, of b its left part. A merge across
        the border would have come first if it ranks before the one undone; on a tie the one further left comes first.
        """
        out = np.ones(len(a), bool)
        mixed = self.mixed[a] | self.mixed[b]
        for i in np.flatnonzero(mixed):
            out[i] = self.merged(self.text[a[i]] + self.text[b[i]]) == [self.text[a[i]], self.text[b[i]]]
        alive = np.flatnonzero(~mixed)
        a, b = a[alive], b[alive]
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit[alive]
        while len(alive):
            joined, _ = self.probe(self.hash[a] * self.power[self.length[b]] + self.hash[b])
            crossed = (joined >= 0) & (self.place[joined] < limit)
            out[alive[crossed]] = False
            go = ~crossed & ((self.rank[a] >= 0) | (self.rank[b] >= 0))
            alive, a, b = alive[go], a[go], b[go]
            first = self.rank[a] > self.rank[b]
            limit = np.where(first, self.rank[a], self.rank[b] + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
        return out

    def search(self, chars: np.ndarray) -> np.ndarray:
        """Best pieces of words of one length, [words, characters]: at each end of a piece its id, elsewhere -2; -1: an unknown character."""
        n, length = chars.shape
        prefix = np.concatenate([np.zeros((n, 1), np.uint64), poly(chars)], axis=1)
        best, back, piece = np.zeros((n, length + 1)), np.zeros((n, length + 1), np.int64), np.full((n, length + 1), -2)
        for end in range(1, length + 1):
            top = np.full(n, -np.inf)
            found = [self.probe(prefix[:, end] - prefix[:, end - size] * self.power[size]) for size in range(1, min(self.longest, end) + 1)]
            if self.byte_pair:
                self.advance(np.stack([ids for ids, _ in found]), end, back, piece)
                continue
            for size in range(len(found), 0, -1):
                ids, scores = found[size - 1]
                if size == 1:
                    scores = np.where(ids < 0, self.unknown, scores)
                got = best[:, end - size] + scores
                better = got > top
                top = np.where(better, got, top)
                back[:, end] = np.where(better, size, back[:, end])
                piece[:, end] = np.where(better, ids, piece[:, end])
            best[:, end] = top
        return self.walk(back, piece)

    def advance(self, ids: np.ndarray, end: int, back: np.ndarray, piece: np.ndarray) -> None:
        """One step of the search over stable pairs: of the pieces that end here the one that is stable behind the last
        piece of the text before it. ids: [sizes, words]."""
        size, word = np.nonzero(ids >= 0)
        number = ids[size, word]
        use = self.reached[number]
        size, word, number = size[use], word[use], number[use]
        before = piece[word, end - size - 1]
        # nothing, or an unknown character, stands before: no merge can cross
        good = before < 0
        pairs = np.flatnonzero(~good)
        keys, of = np.unique(before[pairs] << 32 | number[pairs], return_inverse=True)
        good[pairs] = self.stable(keys >> 32, keys & 0xFFFFFFFF)[of]
        taken = np.zeros(ids.shape[1], np.int64)
        np.maximum.at(taken, word[good], (size[good] + 1) << 32 | number[good])
        back[:, end] = np.where(taken > 0, taken >> 32, 1)
        piece[:, end] = np.where(taken > 0, taken & 0xFFFFFFFF, -1)

    def sound_pairs(self, begin: np.ndarray, sizes: np.ndarray, numbers: np.ndarray, low: int, high: int) -> set[int]:
        """The stable pairs (first << 32 | second) of neighbours of which the second ends from low on and before high."""
        second = np.arange(begin[low], begin[high])
        border = np.repeat(np.arange(low, high), np.diff(begin[low : high + 1])) - sizes[second]
        counts = begin[border + 1] - begin[border]
        first = np.repeat(begin[border] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        keys = np.unique(numbers[first] << 32 | np.repeat(numbers[second], counts))
        return set(keys[self.stable(keys >> 32, keys & 0xFFFFFFFF)].tolist())

    def search_long(self, chars: np.ndarray) -> np.ndarray:
        """The same for one long word: the probes are vectorised over it, the maxima are taken in a loop."""
        length = len(chars)
        prefix = np.r_[np.uint64(0), poly(chars)]
        ends, sizes, numbers, values = [], [], [], []
        for size in range(1, min(self.longest, length) + 1):
            ids, scores = self.probe(prefix[size:] - prefix[:-size] * self.power[size])
            at = np.flatnonzero((ids >= 0) & (self.reached[ids] if self.byte_pair else True))
            for out, part in ((ends, at + size), (sizes, np.full(len(at), size)), (numbers, ids[at]), (values, scores[at])):
                out.append(part)
        end, size = np.concatenate(ends), np.concatenate(sizes)
        order = np.lexsort((-size, end))
        begin, size_of, number_of = np.searchsorted(end[order], np.arange(length + 2)), size[order], np.concatenate(numbers)[order]
        starts, size, number, value = begin.tolist(), size_of.tolist(), number_of.tolist(), np.concatenate(values)[order].tolist()
        best, back, piece = [0.0] * (length + 1), [0] * (length + 1), [-2] * (length + 1)
        sound: set[int] = set()
        for at in range(1, length + 1):
            if self.byte_pair and at % ENDS_AT_ONCE == 1:
                sound = self.sound_pairs(begin, size_of, number_of, at, min(at + ENDS_AT_ONCE, length + 1))
            step, own, top = 1, -1, -np.inf
            for i in range(starts[at], starts[at + 1]):
                if self.byte_pair:
                    before = piece[at - size[i]]
                    if before < 0 or before << 32 | number[i] in sound:
                        step, own = size[i], number[i]
                        break
                elif (got := best[at - size[i]] + value[i]) > top:
                    step, own, top = size[i], number[i], got
            if not self.byte_pair:
                if (starts[at] == starts[at + 1] or size[starts[at + 1] - 1] != 1) and (got := best[at - 1] + self.unknown) > top:
                    step, own, top = 1, -1, got
                best[at] = top
            back[at], piece[at] = step, own
        out, at = np.full((1, length), -2), length
        while at:
            out[0, at - 1] = piece[at]
            at -= back[at]
        return out

    @staticmethod
    def walk(back: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Follow the backpointers of all words together."""
        out = np.full_like(piece, -2)
        words, at = np.arange(len(back)), np.full(len(back), back.shape[1] - 1)
        while len(words):
            out[words, at] = piece[words, at]
            at = at - back[words, at]
            words, at = words[at > 0], at[at > 0]
        return out[:, 1:]

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (little-endian 32-bit) of chunks."""
        texts = [c.decode("utf-8", "replace").replace(" ", SPACE) for c in chunks]
        lengths, out = np.array([len(t) for t in texts]), [b""] * len(texts)
        for length in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == length)
            block = 1 if length > TOGETHER else max(1, 1_000_000 // length)
            for i in range(0, len(own), block):
                part = own[i : i + block].tolist()
                chars = np.frombuffer("".join([texts[j] for j in part]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(len(part), length)
                found = self.search(chars) if length <= TOGETHER else self.search_long(chars[0])
                unknown = (found == -1).any(axis=1)
                counts = (found != -2).sum(axis=1)
                ids = found[found != -2].astype("<u4").tobytes()
                ends = (4 * np.cumsum(counts)).tolist()
                for j, end, count, odd, row in zip(part, ends, counts.tolist(), unknown.tolist(), found, strict=True):
                    out[j] = self.spell(texts[j], row) if odd else ids[end - 4 * count : end]
        return out

    def spell(self, text: str, row: np.ndarray) -> bytes:
        """Ids of a chunk with unknown characters, which become their bytes."""
        parts = []
        for at in np.flatnonzero(row != -2).tolist():
            parts.append([row[at]] if row[at] >= 0 else self.byte_id[list(text[at].encode("utf-8", "replace"))])
        return np.concatenate(parts).astype("<u4").tobytes()


def poly(chars: np.ndarray) -> np.ndarray:
    """Polynomial hashes, modulo 2**64, of all prefixes along the last axis."""
    rows = chars.reshape(-1, chars.shape[-1])
    out = np.empty_like(rows)
    state = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        state = state * BASE + (rows[:, i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        out[:, i] = state
    return out.reshape(chars.shape)


@cache
def load_pieces(path: str) -> Pieces:
    return Pieces(path)


def split_chunks(text: bytes | None) -> list[bytes]:
    """The chunks of a text, behind the space that SentencePiece puts before a text; none of an empty one."""
    return CHUNKS.findall(b" " + text.replace(SPACE.encode(), b" ")) if text else []


def encode_texts(path: str, texts: list[bytes | None]) -> list[bytes]:
    """Each text's ids as little-endian 32-bit numbers."""
    store = memo(("pieces", path), lambda: load_pieces(path).encode_chunks)
    return store.join([split_chunks(t) for t in texts])


def decode_ids(path: str, ids: np.ndarray) -> bytes:
    """The text of ids, without the space before it."""
    return b"".join(map(load_pieces(path).bytes_of.__getitem__, ids.tolist()))[1:]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of each whole text, in the pieces of the model file.

    The ids are those of the model itself. With a unigram model the segmentation is the one whose pieces' scores have
    the greatest sum (on a tie the longer last piece); with a byte-pair model it is the one that its merges leave (see
    Pieces). A character outside the vocabulary becomes the pieces of its bytes.

    A null or empty text has no ids; null doc ids and repeated rows are kept; an empty table gives no rows.
    Columns besides the two are not read.
    """

    def make(rows: dict[str, list]) -> dict[str, object]:
        return {"doc_id": rows["doc_id"], "ids": [np.frombuffer(x, "<i4") for x in encode_texts(model, rows["text"])]}

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, "doc_id long, ids array<int>")


def decode(coded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of each row's ids; null or no ids give an empty text, bytes that are not UTF-8 are replaced."""

    def make(rows: dict[str, list]) -> dict[str, object]:
        return {"doc_id": rows["doc_id"], "text": [decode_ids(model, np.array(x or [], np.int64)).decode("utf-8", "replace") for x in rows["ids"]]}

    thin = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return map_slices(thin, make, "doc_id long, text string")


def digest(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_crc32, and whether the ids decode to the text, of each whole text; cases as in encode."""

    def make(rows: dict[str, list]) -> dict[str, object]:
        coded = encode_texts(model, rows["text"])
        same = [decode_ids(model, np.frombuffer(c, "<u4")) == (t or b"").replace(SPACE.encode(), b" ") for c, t in zip(coded, rows["text"], strict=True)]
        return {"doc_id": rows["doc_id"], "n_tokens": [len(c) // 4 for c in coded], "ids_crc32": [zlib.crc32(c) for c in coded], "round_trip": same}

    thin = docs.select(F.col(id_col).cast("long").alias("doc_id"), as_bytes(text_col).alias("text"))
    return map_slices(thin, make, "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean")
