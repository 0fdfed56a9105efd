"""PII, quality, sharding, packing and SentencePiece against plain definitions."""

import collections
import os
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gondola.llm import packing, pii, quality, sentencepiece, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, _cell int"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")

ODD = [None, "", " \n\t", "x", "a b c d e " * 40, "é" * 5000, "ﬁ Ａ 漢字 😀 \x00 \x85 \xa0", "<|endoftext|> don't a.b,c"]


def documents(spark, texts, ids=None):
    ids = ids or list(range(len(texts)))
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, 2) for i, t in zip(ids, texts, strict=True)], SCHEMA)


# -- PII


def test_checksums():
    assert pii.luhn("4539578763621486") and not pii.luhn("4539578763621487")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


BASE = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda g, n: True),
    ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda g, n: all(int(x) <= 255 for x in g.split("."))),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda g, n: 16 <= len(n) <= 19 and pii.luhn(n)),
    ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda g, n: 8 <= len(n) <= 15),
]


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p, ok in BASE for m in p.finditer(text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "@", "x.y", "@d.e", "1.2.3.4", "300.1.1.1", ".5", "4539578763621486", "4539 5787 6362 1486", "-", " ", "+1 (017) 555-7713", "+", "é", "0", "12", "a", "\n", "%"]), max_size=14))
def test_base_spans_equal_the_patterns(parts):
    text = "".join(parts)
    assert [s[:3] for s in pii.find_spans(text, 0.6) if s[0] in pii.BASE_KINDS] == base_spans(text)


def test_context_decides_on_weak_kinds():
    kinds = lambda t: [s[0] for s in pii.find_spans(t, 0.6)]
    assert kinds("social security 123-45-6789") == ["national_id"] and kinds("part 123-45-6789") == []
    assert kinds("pay to GB82 WEST 1234 5698 7654 32 NOW") == ["iban"] and kinds("GB83 WEST 1234 5698 7654 32") == []


def test_long_runs_are_linear():
    for run in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "@" * 100_000, "AB12 " * 20_000):
        pii.find_spans(run, 0.6)


def test_account_numbers_take_linear_time():
    import time

    took = []
    for times in (500, 2000):
        start = time.perf_counter()
        assert pii.find_spans(("AB12 " * 20 + "A" * 40 + " ") * times, 0.6) == []
        took.append(time.perf_counter() - start)
    assert took[1] < 0.5 + 8 * took[0]
    start = time.perf_counter()
    assert pii.find_spans(("AB12" + "A" * 40 + " ") * 20_000, 0.6) == []
    assert time.perf_counter() - start < 10
    kinds = lambda t: [s[:3] for s in pii.find_spans(t, 0.6)]
    assert kinds("AB12 CD34 GB82WEST12345698765432.") == [("iban", 10, 32)] and kinds("GB82WEST12345698765432x") == []


def test_pii_frames(spark):
    texts = [*ODD, "mail a@b.cd or +1 (017) 555-7713", "mail a@b.cd or +1 (017) 555-7713"]
    got = pii.find_pii(documents(spark, texts, [None, *range(1, len(texts))])).collect()
    assert len(got) == len(texts) and sum(len(r["spans"]) for r in got) == 4
    masked = pii.mask_pii(documents(spark, texts)).collect()
    assert masked[-1]["text"] == "mail [EMAIL] or [PHONE]" and masked[-1]["n_chars"] == 23
    assert masked[0]["text"] is None and masked[1]["text"] == "" and masked[-1]["size"] == 1
    assert pii.find_pii(documents(spark, [])).collect() == [] == pii.mask_pii(documents(spark, [])).collect()


# -- quality


def plain_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        lines += line in seen and bool(re.search("[^\x20\x09-\x0d]", line))
        seen.add(line)

    def covered(n):
        windows = collections.Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        inside = set()
        for i in range(len(words) - n + 1):
            if windows[tuple(words[i : i + n])] > 1:
                inside |= set(range(i, i + n))
        return inside

    chars = sum(map(len, words))
    shares = {n: sum(len(words[i]) for i in covered(n)) / max(chars, 1) for n in (5, 7, 10)}
    return (len(words), chars, len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered(3))), shares


def test_quality_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    words = ["a", "bb", "ccc", "é", "#x", "d|", "e"]
    texts = [*ODD, *(" ".join(rng.choice(words, rng.integers(1, 120))) for _ in range(40)), *("\n".join(rng.choice(["a b", "", " ", "c d e"], 12)) for _ in range(10))]
    got = quality.quality(documents(spark, texts, [None, *range(1, len(texts))])).collect()
    for text, r in zip(texts, sorted(got, key=lambda r: r["doc_id"] or 0), strict=True):
        figures, shares = plain_quality(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == figures
        assert all(r[f"share_{n}"] == pytest.approx(x) for n, x in shares.items())
        assert r["base_failed"] == (figures[0] < 50 or 100 * figures[4] > 50 * figures[0])
        assert r["kept"] == (not r["base_failed"] and all(shares[n] <= m for n, m in quality.MOST_REPEATED.items()) and r["share_lines"] <= 0.4)
    assert quality.quality(documents(spark, [])).collect() == []


def test_clean_text_is_kept_and_copied_text_is_not(spark):
    clean = " ".join(f"word{i}" for i in range(200))
    got = quality.quality(documents(spark, [clean, "\n".join([clean[:400]] * 5), clean + " " + clean[:150]])).collect()
    assert [r["kept"] for r in sorted(got, key=lambda r: r["doc_id"])] == [True, False, True]


# -- sharding


def least_capacity(sizes, parts):
    for capacity in range(max(sizes), sum(sizes) + 1):
        used, room = 1, capacity
        for s in sizes:
            if s > room:
                used, room = used + 1, capacity
            room -= s
        if used <= parts:
            return capacity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=30), st.integers(1, 8))
def test_cuts_are_minimax(sizes, parts):
    starts = sharding.minimax_cuts(sizes, parts)
    ends = [*starts[1:], len(sizes)]
    assert starts[0] == 0 and len(starts) <= parts and starts == sorted(set(starts))
    assert max(sum(sizes[a:b]) for a, b in zip(starts, ends, strict=True)) == least_capacity(sizes, parts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=40), st.integers(1, 8))
def test_level_cuts_use_the_parts_there_are(sizes, parts):
    starts = sharding.minimax_cuts(sizes, parts)
    assert len(starts) == min(parts, len(sizes)) or max(sizes) >= sum(sizes) / parts


def test_the_last_run_is_not_left_small():
    starts = sharding.minimax_cuts([7] * 1000 + [9] * 500, 40)
    sums = [sum(([7] * 1000 + [9] * 500)[a:b]) for a, b in zip(starts, [*starts[1:], 1500], strict=True)]
    assert len(sums) == 40 and max(sums) - min(sums) <= 9


def test_shards(spark):
    texts = [*ODD, *(f"text {i} " * (i % 7) for i in range(400)), *["hot " * 30] * 200]
    got = sharding.shard_documents(documents(spark, texts, [None, *range(1, len(texts))]), shards=6).collect()
    assert len(got) == len(texts)
    slots, of = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        text = texts[r["doc_id"] or 0]
        assert r["size"] == len((text or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((text or "").encode())
        slots[r["shard"]].append(r["slot"])
        of[text or ""].add(r["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(6))
    assert all(len(s) == 1 for s in of.values())
    sizes = collections.Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    rest = sorted(sizes.values())[:-2]
    assert max(rest) < 1.1 * min(rest)  # the hot and the longest text have a shard each, the others share the rest
    assert sharding.shard_documents(documents(spark, []), shards=6).collect() == []


# -- packing


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 60), max_size=12))
def test_bins_hold_every_piece(counts):
    plan = packing.plan_bins(counts, 32)
    placed = collections.Counter()
    for need, bins in plan:
        assert bins > 0 and sum(s * a for s, a in need.items()) <= 32
        for s, a in need.items():
            placed[s] += a * bins
    assert placed == collections.Counter({s: n for s, n in counts.items() if n})


def test_column_generation_beats_first_fit():
    counts = {12: 300, 11: 300, 9: 300, 16: 100, 5: 200}
    bins = sum(n for _, n in packing.plan_bins(counts, 32))
    left, fit = [s for s, n in sorted(counts.items(), reverse=True) for _ in range(n)], []
    for s in left:
        for i, room in enumerate(fit):
            if s <= room:
                fit[i] -= s
                break
        else:
            fit.append(32 - s)
    assert -(-sum(s * n for s, n in counts.items()) // 32) <= bins <= len(fit)


def test_short_texts_are_packed_finely(spark):
    assert packing.grain_for({20: 1000, 3: 500}, 16) == 4 and packing.grain_for({3: 1}, 16) == 1 and packing.grain_for({800: 100}, 16) == 16 and packing.grain_for({}, 16) == 16
    got = packing.pack(documents(spark, [f"word{i} a" for i in range(900)]), BPE, seq_len=512).collect()
    assert sum(r["length"] for r in got) > 0.95 * 512 * (1 + max(r["sequence_id"] for r in got)) - 512


def test_packed_pieces_are_the_tokenizers_ids(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    texts = [*ODD, "The Plain Words, of a text. Straße ÀÉÎ ÷ × ÿ 12a x's don't İ ΣΑΣ", *(f"word{i} and more, " * (i * 7) for i in range(1, 60)), "long text " * 6000, "x", "x"]
    ids = [None, *range(1, len(texts) - 1), len(texts) - 2]
    got = packing.pack(documents(spark, texts, ids), BPE, seq_len=512, grain=8, with_ids=True).collect()
    whole = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]
    pieces = collections.defaultdict(collections.Counter)
    sequences = collections.defaultdict(list)
    for r in got:
        own = whole[r["doc_id"] or 0]
        part = own[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] > 0 and r["doc_tokens"] == len(own)
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"] and r["ids"] == part.tolist()
        pieces[r["doc_id"]][r["start"]] += 1
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, n in collections.Counter(ids).items():
        assert pieces[i] == {s: n for s in range(0, len(whole[i or 0]), 512)}
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 512
    assert sum(map(len, whole)) / (512 * len(sequences)) > 0.9
    assert packing.pack(documents(spark, []), BPE).collect() == []


# -- SentencePiece


@pytest.fixture(scope="module")
def unigram(tmp_path_factory):
    """The library's own search over the same pieces, and its model's file. Some pieces of score -1e9 would cost its single-precision sums all
    smaller differences, so they get a score that is merely the lowest."""
    sp = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    model = proto.ModelProto()
    model.ParseFromString(open(PIECES, "rb").read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40000.0)
    path = str(tmp_path_factory.mktemp("unigram") / "pieces.model")
    with open(path, "wb") as f:
        f.write(model.SerializeToString())
    return sp.SentencePieceProcessor(model_file=path), path


def brute_best(pieces, text):
    table = dict(zip(pieces.keys.tolist(), pieces.scores.tolist(), strict=True))
    best = [0.0]
    for end in range(1, len(text) + 1):
        options = []
        for start in range(max(0, end - pieces.longest), end):
            h = int(sentencepiece.poly(np.array([ord(c) for c in text[start:end]], np.uint64))[-1])
            score = table.get(h, pieces.unknown if end - start == 1 else None)
            if score is not None:
                options.append(best[start] + score)
        best.append(max(options))
    return best[-1]


def test_search_equals_the_library_and_brute_force(unigram):
    texts = ["Hello  world é x", " a", "  ", "a" * 300, "漢字kana かな 12", "hest enestion herest", "the quick brown fox, jumped! 100%", "ﬁ Ａ😀"]
    library, path = unigram
    got = sentencepiece.encode_texts(path, [t.encode() for t in texts])
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
    pieces = sentencepiece.load_pieces(path)
    assert not pieces.byte_pair
    score = dict(zip(pieces.ids.tolist(), pieces.scores.tolist(), strict=True))
    for word in ("▁herestingly", "▁thwhatble", "xx▁y"):
        chars = np.array([[ord(c) for c in word]], np.uint64)
        for found in (pieces.search(chars)[0], pieces.search_long(chars[0])[0]):
            assert sum(score[i] for i in found[found >= 0].tolist()) == pytest.approx(brute_best(pieces, word))


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=PIECES)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdeh  inrst\n▁.,'AÉé漢😀0", max_size=80)))
def test_ids_are_the_models_own(library, text):
    data = text.encode("utf-8", "replace")
    assert np.frombuffer(sentencepiece.encode_texts(PIECES, [data])[0], "<u4").tolist() == library.encode(data.decode())


def test_ids_of_documents_are_the_models_own(library):
    texts = ["The quick brown fox", "international understanding of communication", *ODD[1:], " " * 50 + "a" + " " * 17, "herestingly " * 400, "na" * 3000, "\n\n  x\n"]
    table = pytest.importorskip("pyarrow.parquet").read_table("/root/testdata/sf0.001/documents.parquet") if os.path.isdir("/root/testdata/sf0.001") else None
    texts += [t for t in table.column("text").to_pylist() if t] if table else []
    for text, ids in zip(texts, sentencepiece.encode_texts(PIECES, [t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)


def test_long_words_take_the_same_pieces(library):
    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("etaoinshr▁dlu漢é"), n)) for n in (49, 333, 5000)] + ["y" * 20_000]
    for word, ids in zip(words, sentencepiece.encode_texts(PIECES, [w.encode() for w in words]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(word)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_round_trip(text):
    data = text.encode("utf-8", "replace")
    ids = np.frombuffer(sentencepiece.encode_texts(PIECES, [data])[0], "<u4")
    assert sentencepiece.decode_ids(PIECES, ids) == data.replace("▁".encode(), b" ")


def test_sentencepiece_frames(spark):
    texts = [*ODD, "two  spaces\n\nand lines ", "word " * 5000, "y" * 3000]
    docs = documents(spark, texts, [None, *range(1, len(texts))])
    coded = sentencepiece.encode(docs, PIECES)
    back = sorted(sentencepiece.decode(coded, PIECES).collect(), key=lambda r: r["doc_id"] or 0)
    assert [r["text"] for r in back] == [t or "" for t in texts]
    digest = sorted(sentencepiece.digest(docs, PIECES).collect(), key=lambda r: r["doc_id"] or 0)
    lengths = sorted(coded.selectExpr("coalesce(doc_id, 0) as i", "size(ids) as n").collect())
    assert [r["n_tokens"] for r in digest] == [r["n"] for r in lengths] and all(r["round_trip"] for r in digest)
    assert sentencepiece.digest(documents(spark, []), PIECES).collect() == []


def test_quality_equals_its_sql(spark):
    import duckdb
    import pyarrow as pa

    from gondola.llm.queries import oracle_sql

    rng = np.random.default_rng(6)
    texts = [*ODD, *("\n".join(" ".join(rng.choice(["a", "bb", "é#", "d"], rng.integers(0, 9))) for _ in range(rng.integers(1, 20))) for _ in range(30))]
    documents_table = pa.table({"doc_id": list(range(len(texts))), "text": pa.array([t.replace("\x00", "") if t else t for t in texts])})
    con = duckdb.connect()
    con.register("documents", documents_table)
    wanted = sorted(con.execute(oracle_sql()["op4_quality"]).to_arrow_table().to_pylist(), key=lambda r: r["doc_id"])
    made = quality.quality(spark.createDataFrame(documents_table.to_pylist(), "doc_id long, text string")).toArrow().to_pylist()
    assert sorted(made, key=lambda r: r["doc_id"]) == [{k: r[k] for k in made[0]} for r in wanted]
