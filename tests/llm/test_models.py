"""Operators with fitted models: quality, language, main text, URLs."""

import html
import random

import numpy as np
import pytest

from helixspark.llm import html_text, langid, quality, urls

CLEAN = "The house by the river was old and quiet, and nobody had lived there since the winter. "


def made_docs(n=240):
    g = random.Random(4)
    words = "the old house river stone garden light winter road small green bird water hand".split()
    rows = []
    for k in range(n):
        text = " ".join(g.choice(words) for _ in range(g.randint(20, 120)))
        bad = k % 3 == 0
        if bad:
            text = text.upper().replace(" ", "!! ") if k % 2 else " ".join(w + "***" for w in text.split())
        rows.append((k, text, int(not bad)))
    return rows


@pytest.fixture(scope="module")
def net():
    rows = made_docs()
    return quality.fit([t for _, t, _ in rows[:160]], [y for *_, y in rows[:160]], epochs=12)


def test_quality_held_out(net):
    rows = made_docs()[160:]
    raw = [t.encode() for _, t, _ in rows]
    scores = net.scores(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.mean((scores >= 0.3) == [y for *_, y in rows]) > 0.97


def test_quality_reads_the_whole_text(net):
    """A text's score depends on its end, and batches don't matter."""
    long = CLEAN * 400
    alone = [net.scores(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t)]))[0] for t in (long, long + "BUY!! NOW!! " * 2000)]
    assert alone[0] > alone[1]
    both = [t.encode() for t in (long, "", CLEAN)]
    got = net.scores(np.frombuffer(b"".join(both), np.uint8), np.cumsum([0, *map(len, both)]))
    assert got[0] == pytest.approx(alone[0], abs=1e-5) and len(got) == 3


def test_chunks_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 480, 481, 5000):
        data = np.arange(n, dtype=np.int64).astype(np.uint8)
        chunks, first = quality.cut_chunks(data, np.array([0, n]))
        assert len(first) == 1 and (len(chunks) - 1) * quality.STEP + quality.CHUNK >= n
        starts, ends, _ = quality.chunk_places(np.array([0, n]))
        covered = {i for a in starts.tolist() for i in range(a, min(n, a + quality.CHUNK))}
        assert covered == set(range(n)) and (ends == n).all() and (n < quality.CHUNK or (chunks[-1] == data[-quality.CHUNK :]).all())


def test_quality_edges(spark, net):
    df = spark.createDataFrame([(1, None, 9.0), (1, None, 9.0), (2, "", 9.0), (3, "x" * 200_000, 9.0), (None, CLEAN, 9.0)], "doc_id long, text string, SCORE double")
    out = quality.score_quality(df, net)
    assert sorted(out.columns) == ["doc_id", "predicted", "score", "text"]
    rows = out.collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id == 1}) == 1
    assert quality.score_quality(df.limit(0), net).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.learn(df, labels) is None
    assert {r.score for r in quality.score_quality(df, None).collect()} == {0.5}


def test_quality_learns_from_its_fold_only(spark):
    docs = spark.createDataFrame([(k, t) for k, t, _ in made_docs(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, _, y in made_docs(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    held = {r.doc_id for r in labels.where("crc32(cast(doc_id as string)) % 5 = 0").collect()}
    flipped = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality")
    assert held
    a, b = quality.learn(docs, labels), quality.learn(docs, flipped)
    assert np.array_equal(a.filters, b.filters)


# Language ----------------------------------------------------------------------------------------------------------

TEXTS = {"aa": "the house and the river are old ", "bb": "das haus und der fluss sind alt ", "cc": "la maison et la rivière sont vieilles "}


@pytest.fixture(scope="module")
def model():
    return langid.fit({k: [v * 5] * 5 for k, v in TEXTS.items()}, langid.load_pieces(langid.default_vocabulary()))


def brute(model, word):
    """The sum over all segmentations, one by one."""
    s = "▁" + word

    def over(i):
        if i == len(s):
            return np.ones(len(model.langs))
        total = np.zeros(len(model.langs))
        for j in range(i + 1, len(s) + 1):
            p = model.probs.get(s[i:j])
            if p is not None:
                total += np.array(p) * over(j)
            elif j == i + 1:
                total += langid.UNSEEN * over(j)
        return total

    return np.log(over(0))


def test_forward_sums_all_segmentations(model):
    words = ["the", "haus", "rivière", "zzz", "ñq", "house"]
    assert np.allclose(model.words(words), [brute(model, w) for w in words])


def test_long_words_do_not_underflow(model):
    got = model.words(["the" * 3000])
    assert np.isfinite(got).all() and got.max() < -1000


def test_language_and_edges(spark, model):
    rows = [(k, t, "x") for k, t in enumerate([*TEXTS.values(), None, "", "12 34 !!", "THE HOUSE", "the river " * 20_000])]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string, Score string")
    got = langid.identify_language(df, model).collect()
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert len(got) == 9 and [by[k][0] for k in range(8)] == ["aa", "bb", "cc", "und", "und", "und", "aa", "aa"]
    assert all(0 <= s <= 1 for _, s in by.values()) and by[3][1] == 0
    assert langid.identify_language(df.limit(0), model).count() == 0
    nothing = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in langid.identify_language(df, nothing).collect()} == {"und"}


def test_language_cache_is_bounded(model, monkeypatch):
    memory = langid.WordMemory(model)
    monkeypatch.setattr(langid, "CACHE_WORDS", 3)
    a = langid.identify(memory, ["the house and", "das haus und"])
    assert a == langid.identify(langid.WordMemory(model), ["the house and", "das haus und"])


# Main text -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labeller():
    return html_text.fit()


def test_labels_of_new_layouts(labeller):
    g, wrong, total = np.random.default_rng(77), 0, 0
    for _ in range(120):
        page, labels = html_text.training_page(g)
        found = html_text.blocks(page)
        assert len(found) == len(labels)
        x, mask = html_text.padded([html_text.features(found)])
        wrong += int(((labeller.scores(x, mask)[:, 0] >= 0.5) != labels).sum())
        total += len(labels)
    assert wrong / total < 0.03


def test_gradients_match_differences():
    net, g = html_text.BiLstm(3), np.random.default_rng(3)
    x = g.normal(size=(4, 2, html_text.PATH_DIMS + html_text.WORD_DIMS + html_text.EXTRA)).astype("f4")
    mask = np.array([[1, 1], [1, 1], [1, 1], [0, 1]], bool)
    want = g.integers(0, 2, (4, 2)).astype("f4")
    net.p = {k: v.astype("f8") for k, v in net.p.items()}

    def loss():
        s = net.scores(x, mask)
        return float(-(np.where(want > 0, np.log(s), np.log(1 - s)) * mask).sum() / mask.sum())

    grads = net.gradients(x, mask, want)
    for name in ("whf", "whb", "bbf", "out"):
        at = tuple(0 for _ in net.p[name].shape)
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        down = loss()
        net.p[name][at] = was
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-3)


PAGE = """<html><head><title>T</title><script>x='</p>'</script></head><body><nav class=menu><a href=/>Home</a></nav>
<article><h1>A &amp; B</h1><p>One  <b>two</b><br>three &eacute;.<p>Four five six seven.</article><footer>&copy; all</footer>"""


def test_extract_and_edges(spark, labeller):
    pages = [(1, PAGE), (2, None), (3, ""), (4, "no tags at all, just a sentence."), (5, "<p" * 50_000), (6, "<!-- never closed <p>x"), (7, "<article>" + "<p>Some words here.</p>" * 5000 + "</article>")]
    df = spark.createDataFrame(pages + pages[:1], "page_id long, html string").selectExpr("*", "1 as TEXT", "2 as n_chars")
    got = {r.page_id: r for r in html_text.main_text(df, labeller).collect()}
    assert got[1].text == "A & B\nOne two three é.\nFour five six seven." and got[1].n_chars == len(got[1].text)
    assert got[2].text == got[3].text == got[6].text == "" and got[2].n_chars == 0
    assert got[7].text.count("\n") == 4999
    assert html_text.main_text(df.limit(0), labeller).count() == 0


def test_blocks_decode_once():
    assert [b[0] for b in html_text.blocks("<p>&amp;lt;b&gt; a\u00a0b</p>")] == [" ".join(html.unescape("&amp;lt;b&gt; a\u00a0b").split())]


# URLs ------------------------------------------------------------------------------------------------------------------


def test_urls(spark):
    rows = {
        "https://WWW.Example.com/en/1?x=/de/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "https://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
        "http://a.net/es/x#y": ("a.net", "/es/x", "net/es/", "block"),
        "http://a.net/fr/": ("a.net", "/fr/", "net/fr/", "block"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://x.com": ("x.com", "", None, None),
        "no scheme": ("", "", None, "allow"),
        "a://b://c": ("b:", "//c", None, None),
        "s://h?q=/": ("h", "", None, None),
    }
    df = spark.createDataFrame([(k, u) for k, u in enumerate([*rows, None])], "page_id long, url string").selectExpr("*", "1 as HOST", "'x' as verdict")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for k, (host, path, rule, verdict) in enumerate(rows.values()):
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, rule)
        assert verdict is None or got[k].verdict == verdict
    assert (got[9].host, got[9].path, got[9].rule, got[9].verdict) == ("", "", None, "allow")
    assert urls.judge(df.limit(0)).count() == 0


def test_url_model_held_out():
    rows = urls.training_urls(seed=91)[:400]
    w = urls.default_model()
    said = [(w[f].sum() / np.sqrt(len(f)) + w[-1] >= 0) == bool(y) for h, p, y in rows if len(f := urls.grams(h, p))]
    assert np.mean(said) > 0.95


def test_numerals_are_no_letters_and_all_pieces_are_kept(model):
    memory = langid.WordMemory(model)
    langs, scores = langid.identify(memory, ["½ ² Ⅷ ①", "", None, "½the house and", "12_34"])
    assert langs[:3] == ["und"] * 3 and langs[3] != "und" and langs[4] == "und" and scores[:3] == [0.0] * 3
    assert langid.letter_runs("½the²House Ⅷ, ab_cd") == ["the", "house", "ab", "cd"]
    assert set(langid.load_pieces(langid.default_vocabulary())) <= set(model.probs)


def test_words_of_any_length_count_in_the_fit(model):
    """Expected pieces of a long word add up to its letters, as they do for a short one."""
    from collections import Counter

    for word in ("house", "house" * 30, "qz" * 900):
        got = langid.expected_pieces(model, 0, Counter({word: 1}))
        letters = sum(len(p) * n for p, n in got.items())
        assert all(np.isfinite(list(got.values()))) and letters <= len(word) + 1.001
        if word.startswith("house"):
            assert letters > 0.9 * len(word)


def test_markup_in_values_and_inline_elements():
    cases = {
        '<p>Hello <a title="a<b>c">there</a> you</p>': ["Hello there you"],
        "<p>one <math><mi>x</mi> + 1</math> two</p>": ["one x + 1 two"],
        "<p>one <noscript>no script</noscript> <object>thing</object> two</p>": ["one no script thing two"],
        "<p>one <script>var a='<p>';</script>two</p>": ["one two"],
        "<p>1 < 2 and don't <b x='>'>stop</b></p>": ["1 < 2 and don't stop"],
    }
    for page, want in cases.items():
        assert [b[0] for b in html_text.blocks(page)] == want, page


def test_deep_paths_keep_all_names():
    inner = '<footer class="colophon">' + "<div><font>" * 300 + "<p>deep text</p>"
    found = html_text.blocks(inner + "</div>" * 10)
    want = {html_text.slot(n, html_text.PATH_DIMS) for n in ("footer", ".colophon", "div", "p")}
    assert [b[0] for b in found] == ["deep text"] and set(found[0][1]) == want


def test_a_long_text_is_scored_in_bounded_memory(net):
    import tracemalloc

    data = np.frombuffer((CLEAN * 60_000).encode(), np.uint8)
    tracemalloc.start()
    net.scores(data, np.array([0, len(data)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(data) > 5e6 and peak < 8 * len(data)
