"""Language models, toxicity, extraction and the pipeline: held-out accuracy, brute force and odd inputs."""

import collections
import math
import random

import numpy as np
import pytest

from gondola.llm import extraction, langid, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bits int, score double"


def documents(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), 1, 0.5) for i, t, lang in rows], SCHEMA)


SYLLABLES = {"aa": "ba be bo la le lo ma me", "bb": "tri tro kra kro pfa schi ung", "cc": "io ia eu ue ae oi ui"}


def text_of(lang, rng, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang].split()) for _ in range(rng.randint(1, 4))) for _ in range(n))


# -- language id


def plain_kneser_ney(counts, word, order=langid.ORDER):
    """Bits of a word, from definitions with strings and dictionaries."""
    pad = chr(langid.START) * (order - 1)
    grams = [collections.Counter() for _ in range(order + 1)]
    for w, n in counts.items():
        s = pad + w + chr(langid.END)
        for i in range(order - 1, len(s)):
            grams[order][s[i - order + 1 : i + 1]] += n
    for k in range(order - 1, 0, -1):
        for g in grams[k + 1]:
            grams[k][g[1:]] += 1

    def discount(k):
        once, twice = (sum(1 for v in grams[k].values() if v == x) for x in (1, 2))
        return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.1

    def p(k, context, c):
        if k == 0:
            return 1 / langid.ALPHABET
        context = context[len(context) - (k - 1) :]
        total = sum(v for g, v in grams[k].items() if g[:-1] == context)
        lower = p(k - 1, context[1:], c)
        if not total:
            return lower
        kinds = sum(1 for g in grams[k] if g[:-1] == context)
        return max(grams[k][context + c] - discount(k), 0) / total + min(1, discount(k) * kinds / total) * lower

    s = pad + word + chr(langid.END)
    return -sum(math.log2(p(order, s[i - order + 1 : i], s[i])) for i in range(order - 1, len(s)))


def test_models_equal_definitions():
    counts = {"aa": collections.Counter("banana bandana nab ban ban an".split()), "bb": collections.Counter("tri trio ox ox".split())}
    models = langid.train(counts)
    words = ["ban", "band", "tri", "xyz", "é", "nabana"]
    got = models.bits(words)
    for i, lang in enumerate(models.languages):
        for w, row in zip(words, got, strict=True):
            assert row[i] == pytest.approx(plain_kneser_ney(counts[lang], w), rel=1e-4)


def test_probabilities_sum_to_one():
    models = langid.train({"aa": collections.Counter("banana bandana nab ban ban an".split())})
    _, values = models.grams[1]
    assert values.sum() + models.contexts[1][1][0][0] == pytest.approx(1, rel=1e-5)


def test_language_id(spark):
    rng = random.Random(5)
    rows = [(i, text_of(lang, rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    models = langid.fit(documents(spark, rows), most_docs=100)
    odd = [(1000, None, None), (1001, "", "aa"), (1002, "123 --- 99", None), (None, text_of("aa", rng), None), (1003, "zzqx wvwv " * 30, None), (1004, text_of("bb", rng, 5000), None), (1005, "LA LE Bama", None)]
    fresh = [(2000 + i, text_of(lang, rng), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 10)]
    got = {r["doc_id"]: r for r in langid.predict(documents(spark, odd + fresh + fresh[:1]), models).collect()}
    assert all(got[i]["lang_pred"] == lang and 0.9 < got[i]["score"] <= 1 and not got[i]["rejected"] for i, _, lang in fresh)
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["rejected"] for i in (1000, 1001, 1002))
    assert got[None]["lang_pred"] == "aa" and got[1004]["lang_pred"] == "bb" and got[1003]["rejected"] and got[1005]["lang_pred"] == "aa"
    kept = langid.drop_foreign(documents(spark, odd + fresh), models).collect()
    assert {r["doc_id"] for r in kept} == {None, 1004, 1005, *(i for i, _, _ in fresh)} and kept[0]["bits"] == 1


def test_language_id_without_rows(spark):
    none = documents(spark, [])
    models = langid.fit(none)
    assert models.languages == []
    assert [tuple(r)[:3] for r in langid.predict(documents(spark, [(1, "abc", None)]), models).collect()] == [(1, "und", 0.0)]
    assert langid.predict(none, models).collect() == [] == langid.drop_foreign(none, models).collect()


# -- toxicity


def test_pairs_matter_where_single_terms_do_not():
    """Two insults are harmless alone and toxic with a group's name; additive weights cannot tell."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(1200):
        a, b = rng.integers(0, 2, 2)
        own = [0] * a + [1] * b + list(rng.choice(np.arange(2, 12), 3, replace=False))
        rows.append(np.array(sorted(own), np.int64))
        labels.append(float(a ^ b ^ 1))
    model = toxicity.train(np.arange(12), rows, np.array(labels))
    assert ((model.score(rows) > 0.5) == np.array(labels)).mean() > 0.95


def test_score_equals_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.arange(6), 0.3, rng.normal(size=6), rng.normal(size=(6, 3)))
    z = 0.3 + m.weights[[1, 2, 5]].sum() + sum(m.factors[i] @ m.factors[j] for i, j in ((1, 2), (1, 5), (2, 5)))
    assert m.score([np.array([1, 2, 5]), np.array([], int)]) == pytest.approx([1 / (1 + math.exp(-z)), 1 / (1 + math.exp(-0.3))])


def toxic_rows(rng, n, first=0):
    rows, labels = [], []
    for i in range(first, first + n):
        bad = i % 4 == 0
        words = text_of("aa", rng, 40).split()
        if bad:
            for w in rng.sample(["vile", "SCUM!", "loweichen", "loweiung", "loweitum"], 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), None))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity(spark):
    rng = random.Random(3)
    rows, labels = toxic_rows(rng, 400)
    labels += [(5000, 1, 1), (None, 1, 1), (7, 1, None)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    fresh, truth = toxic_rows(rng, 80, 1000)
    odd = [(1, None, None), (2, "", None), (None, "you vile scum", None), (3, "loweineu vile", None), (4, "ok " * 20_000, None)]
    got = {r["doc_id"]: r for r in toxicity.score(documents(spark, fresh + odd + fresh[:1]), model).collect()}
    assert all(got[i]["predicted"] == bad for i, _, bad in truth)
    assert [got[i]["predicted"] for i in (1, 2, None, 3, 4)] == [0, 0, 1, 1, 0] and all(0 <= r["score"] <= 1 for r in got.values())
    kept = toxicity.drop_toxic(documents(spark, fresh + odd), model).collect()
    assert {r["doc_id"] for r in kept} == {i for i, _, bad in truth if not bad} | {1, 2, 4}


def test_copies_teach_nothing_about_their_words(spark):
    rng = random.Random(4)
    rows, labels = toxic_rows(rng, 200)
    copied = text_of("bb", rng, 60)
    rows += [(9000 + i, copied + f" end{i % 3}", None) for i in range(60)]
    labels += [(9000 + i, 1, 1) for i in range(60)]
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert toxicity.score(documents(spark, [(1, text_of("bb", rng, 60), None)]), model).first()["predicted"] == 0


def test_toxicity_without_rows(spark):
    none = documents(spark, [])
    for rows in ([], [(1, "some words", None)]):
        model = toxicity.fit(documents(spark, rows), spark.createDataFrame([(1, 1, 0)][: len(rows)], "doc_id long, quality int, toxic int"))
        assert toxicity.score(documents(spark, [(1, "vile", None)]), model).first()["predicted"] == 0
        assert toxicity.score(none, model).collect() == [] == toxicity.drop_toxic(none, model).collect()


# -- extraction


def test_best_run_equals_brute_force():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.randint(-4, 4) for _ in range(rng.randint(0, 9))]
        start, end = extraction.best_run(scores)
        best = max([0, *(sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1))])
        assert sum(scores[start:end]) == best and (start < end) == (best > 0)


def test_labelled_pages_are_extracted():
    weights = extraction.learn(extraction.labelled_pages(seed=1))
    right = total = 0
    for page, article in extraction.labelled_pages(120, seed=2):
        got = set(extraction.main_text(page, weights).split("\n"))
        right += got == article
        total += 1
    assert right / total > 0.95
    assert all(v < 0 for v in weights.tags.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><header><a href=/>Home</a></header>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies here</div><div class="ad">Buy this thing now</div>
<article><h1>A &amp; B</h1><p>First   <b>bold</b>\n text &lt;tag&gt; 5 &gt; 3&nbsp;ok.<p>Short.</p><div class='ad'>Inline advert</div>
<!-- hidden <p>comment</p> --><script>if (a<b) x("<p>no</p>")</script><style>p{}</style><form><label>Name</label><input></form>
<ul><li>Point one<li>Point two</ul><aside>See also</aside><p>Of.</p></article>
<section class="comments"><p>Nice article, thanks a lot for it!</p></section><aside id=sidebar>Popular posts</aside><p>Stray words past it</p><footer>&copy; Site</footer>"""


def test_one_page():
    got = extraction.main_text(PAGE, extraction.default_weights())
    assert got == "A & B\nFirst bold text <tag> 5 > 3 ok.\nShort.\nPoint one\nPoint two\nOf."


def test_names_of_layouts_do_not_hide_the_article():
    weights = extraction.default_weights()
    for page in ('<div class="layout has-sidebar"><article><p>one two three</p></article><div class="sidebar">x y z</div></div>', '<div class="menu page"><main><p>one two three</p></main><p>x y z</p></div>', '<div id="content"><p>one two three</p><div class="comments"><p>x y z</p></div></div>'):
        assert extraction.main_text(page, weights) == "one two three"


def test_odd_pages(spark):
    pages = [None, "", "<", "plain words without any tag at all", "<article>", "<p>" * 5000, "<nav>only menu</nav>", "<article>" + "<p>word word</p>" * 5000, '<a title="a>b" href=x>l</a><article>x &#x41;&bogus; y</article', "<script>never closed <p>x</p>"]
    rows = [(None if i == 3 else i, None if i == 4 else "u", p, "t", 3) for i, p in enumerate(pages)]
    got = extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")).collect()
    of = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert [of[i] for i in (0, 1, 5, 6)] == ["", "", "", ""] and of[None] == "plain words without any tag at all" and of[9] == ""
    assert of[7] == "\n".join(["word word"] * 5000) and of[8].startswith("x A&bogus; y")
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


# -- pipeline


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows, labels = toxic_rows(rng, 240)
    clean = [r for r in rows if r[0] % 4]
    rows += [(10_000, clean[0][1], None), (10_001, clean[0][1] + " tail", None), (10_002, "123 456", None), (10_003, None, None), (10_004, "", None), clean[1]]
    rows += [(10_005, text_of("aa", rng, 60) + " mail me@home.example now", None), (None, text_of("aa", rng, 70), None)]
    languages = {i: "aa" for i, _, _ in rows[:240]}
    docs = spark.createDataFrame([(i, t, languages.get(i), "s", len(t or "")) for i, t, _ in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    at, counts, frames = docs, {}, {}
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, at, str(tmp_path))
        if name != "packing":
            assert made.columns == docs.columns
        made.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        counts[name], frames[name] = at.count(), at
    assert counts["toxicity"] == len(rows) - 60
    assert counts["language id"] == counts["toxicity"] - 3
    assert counts["near duplicates"] == counts["language id"] - 3  # two copies and a repeated row
    kept = {r["doc_id"]: r["text"] for r in frames["personal data"].collect()}
    assert set(kept) == {i for i, _, _ in clean} | {10_005, None} and "[EMAIL]" in kept[10_005]
    whole = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((str(r["doc_id"]), r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(frames["packing"])


def test_pipeline_of_nothing(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("between", ["<svg-icon></svg-icon>", "<select-box>b</select-box>", "<svg viewBox='0 0 1 1' class=\"a>b\"/>", "<math/>", "<svg><path d='x'/>no</svg>", "<svg title=\"a/>b\">no</svg>"])
def test_pages_go_on_after_custom_and_empty_raw_elements(between):
    texts = [b.text for b in extraction.blocks_of(f"<p>a</p>{between}<p>rest</p>")[0]]
    assert texts[0] == "a" and texts[-1] == "rest" and "no" not in texts


BODY = "<p>one two three four five six seven</p><p>eight nine ten eleven twelve thirteen</p>"
WANTED = "one two three four five six seven\neight nine ten eleven twelve thirteen"
LAYOUTS = {
    f'<article><h1>t u v</h1>{BODY}<div class="advert no-print">buy it now</div><p>more text here</p></article>': f"t u v\n{WANTED}\nmore text here",
    f'<article><h1>t u v</h1>{BODY}<p class="ad">buy it now</p><p>more text here</p></article>': f"t u v\n{WANTED}\nmore text here",
    f'<nav><a href=/>x</a></nav><div class="article-header"><h1>Head line here</h1></div><div class="article-body">{BODY}</div><footer>f</footer>': f"Head line here\n{WANTED}",
    f'<div class="social-history-post">{BODY}</div>': WANTED,
    f'<nav>m n</nav><div class="social-history-post"><h1>Big title</h1>{BODY}</div><footer>x y z</footer>': f"Big title\n{WANTED}",
    f"<div><h1>t u v</h1>{BODY}</div><div>Copyright 2020 all rights reserved</div>": f"t u v\n{WANTED}",
    f'<div class="content-sidebar-wrap"><article><h1>a b</h1>{BODY}</article><div id="sidebar">p q r</div></div>': f"a b\n{WANTED}",
    f'<table><tr><td class="menu"><a href=/a>a b</a></td><td><h1>t u</h1>{BODY}</td></tr></table><div id="footer">foot words</div>': f"t u\n{WANTED}",
    f'<div id="main"><h1>t u</h1>{BODY}</div><div id="comments"><h2>Comments</h2>' + "<div class=comment><p>I think this is a very good text</p></div>" * 20 + "</div>": f"t u\n{WANTED}",
    f"<center><font><h1>t u</h1>{BODY}</font></center><hr><a href=/>back</a>": f"t u\n{WANTED}",
    f"<article>{BODY}<p>All rights reserved.</p></article>": f"{WANTED}\nAll rights reserved.",
}


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts_that_no_labelled_page_has(page):
    assert extraction.main_text(page, extraction.default_weights()) == LAYOUTS[page]


def test_extraction_equals_brute_force():
    weights = extraction.default_weights()
    for page, _ in extraction.labelled_pages(25, seed=9):
        blocks, seen = extraction.blocks_of(page)
        each = [weights.each(b, seen) for b in blocks]
        score = [0 if e < 0 and b.landmark else max(-20, e * b.words) + sum(weights.tags.get(t, weights.other_tag) for t in b.tags) for b, e in zip(blocks, each, strict=True)]
        _, _, start, end = max((sum(score[i:j]), -i, i, j) for i in range(len(blocks) + 1) for j in range(i, len(blocks) + 1))
        wanted = [b.text for b, e in zip(blocks[start:end], each[start:end], strict=True) if e >= 0]
        assert extraction.main_text(page, weights) == "\n".join(wanted)


@pytest.mark.parametrize("part", ["<a ", '<a "', "</p>", "<svg>", "<!--", "<p>a<b>", "<div class='ad x'>y", "<ul><li>x", '<a ">" ', "<", "<h1>a<main>"])
def test_broken_markup_takes_linear_time(part):
    import time

    weights, took = extraction.default_weights(), []
    for size in (100_000, 400_000):
        start = time.perf_counter()
        extraction.main_text(part * (size // len(part)) + "</p>", weights)
        took.append(time.perf_counter() - start)
    assert took[1] < 0.5 + 10 * took[0]


def test_number_signs_are_no_letters(spark):
    rng = random.Random(7)
    models = langid.fit(documents(spark, [(i, text_of(lang, rng), lang) for i, lang in enumerate(["aa", "bb"] * 20)]))
    got = langid.predict(documents(spark, [(1, "\u00bd \u00b2 \u2167", None), (2, "\u2460 ba la", None)]), models).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == [(1, "und"), (2, "aa")]


def test_toxicity_model_does_not_depend_on_partitions(spark):
    rng = random.Random(6)
    rows, labels = toxic_rows(rng, 200)
    rows += [(5000 + i, rows[i % 40][1] + (" vile" if i % 2 else ""), None) for i in range(120)]
    labels += [(5000 + i, 1, i % 2) for i in range(120)]
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    models = [toxicity.fit(documents(spark, rows).repartition(n), marks.repartition(n)) for n in (1, 7)]
    assert models[0].name == models[1].name


def test_very_long_texts_and_pages(spark):
    page = "<article>" + "<p>word word</p>" * 70_000 + "</article>"
    got = extraction.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).collect()
    assert got[0]["n_chars"] == 10 * 70_000 - 1
    rng = random.Random(3)
    rows, labels = toxic_rows(rng, 60)
    model = toxicity.fit(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    long = documents(spark, [(i, "plain words " * 90_000, None) for i in range(12)])
    assert [r["predicted"] for r in toxicity.score(long, model).collect()] == [0] * 12


def test_slices_hold_few_bytes():
    import pyarrow as pa

    from gondola.llm import common

    batch = pa.record_batch({"id": list(range(300)), "text": ["x" * 1_000_000] * 5 + ["y"] * 294 + [None]})
    sizes = [part.num_rows for part in common.slices(batch)]
    assert sum(sizes) == 300 and sizes[:3] == [2, 2, 256] and max(sizes) <= common.SLICE_ROWS
    assert list(common.slices(batch.slice(0, 0))) == []
