import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import SF, WORD, lower

from lapse.llm import html, lm, queries

PAGE = "page_id long, url string, html string"
SITE = """<!DOCTYPE html><html><head><title>{t}</title><style>p{{color:red}}</style><script>var a="</p><p>no</p>";</script></head>
<body class="page menu-open"><header><a href="/">Logo</a></header><div id="cookie-notice">We use cookies</div>
<nav><ul><li>Home</li><li>News</li></ul></nav><div class="sidebar"><p>Popular: {n}</p></div>{body}
<section class="comments"><p>reader {n} says hi</p></section><form><input value=x><label>Mail</label></form>
<footer>&copy; site {n}</footer></body></html>"""


def texts(spark, pages):
    df = spark.createDataFrame(pages, PAGE).repartition(2)
    return {r["page_id"]: r["text"] for r in html.extract(df).collect()}


def test_article_without_its_surroundings(spark):
    body = "<article><h1>Title {0}</h1><p>One &amp; two&nbsp;{0}\n  three<br>four</p><div class='ad'>buy</div><p>Same words</article>"
    pages = [(i, f"http://a.example/{i}", SITE.format(t="T", n=i, body=body.format(i))) for i in range(5)]
    got = texts(spark, pages)
    assert got == {i: f"Title {i} One & two {i} three four Same words" for i in range(5)}


def test_pages_without_a_marked_article_use_the_template(spark):
    body = "<div id=box><div class=story><p>Long story number {0} about things {0}</p><p>It goes on {0} and on {0}</p></div></div><div><span>Read more</span></div>"
    pages = [(i, f"https://user@B.example:80/{i}", SITE.format(t="T", n=i, body=body.format(i))) for i in range(6)]
    got = texts(spark, pages)
    assert got == {i: f"Long story number {i} about things {i} It goes on {i} and on {i}" for i in range(6)}


def test_container_keeps_headings_lists_tables_and_inline_text(spark):
    body = """<div id=box><div class=story><h1>Title {0}</h1><p>Some <b>bold {0}</b> and <a href=x>linked {0}</a> text {0}</p><h2>Part {0}</h2>
<ul><li>one {0}</li><li>two {0}</li></ul><blockquote>quote {0}</blockquote><table><tr><td>cell {0}</td></tr></table></div></div>
<div><span>Views {0}</span></div><div><span>Read more</span></div>"""
    pages = [(i, f"https://c.example/{i}", SITE.format(t="T", n=i, body=body.format(i))) for i in range(6)]
    got = texts(spark, pages)
    assert got == {i: f"Title {i} Some bold {i} and linked {i} text {i} Part {i} one {i} two {i} quote {i} cell {i}" for i in range(6)}


@pytest.mark.parametrize("page,text", [
    (None, ""), ("", ""), ("   ", ""), ("plain text", "plain text"), ("<article>a < b && c &lt;d&gt; &#233;", "a < b && c <d> é"),
    ("<article><p>x<b>y</b>z<p>w</article>", "xyz w"), ("<main>in</main>out", "in"), ("<article>a<!-- no -->b</article>", "ab"),
    ("<article>a<script>var x='<p>'</article>", "a"), ("<p>a</i></div>b", "a b"), ("<article hidden>no</article><p>yes</p>", "yes"),
    ("<article><p title=\"a>b\">t</p><form>f<p>g</form><nav>n</nav>u</article>", "t u"),
    ("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>", "deep"),
    ("<article>" + "w " * 50000 + "</article>", " ".join(["w"] * 50000)),
])
def test_single_pages(spark, page, text):
    assert html.main_text(page or "", {}, {}) == text


@pytest.mark.parametrize("page,text", [
    ("<article><p><a href='/hidden-valley'>a</a> <b data-hidden='false'>b</b> <a href='/post?id=login'>c</a></p></article>", "a b c"),
    ("<article><p data-class='ad' title='class=ad hidden'>a</p><p HIDDEN>b</p><p class = 'ad'>c</p><p id=login>d</p></article>", "a"),
    ("<div class='layout has-sidebar'><article>a</article><div class=sidebar>b</div></div>", "a"),
    ("<div class='no-header'><article>a</article></div>", "a"), ("<div id=header-wrap><div class=promo><article>a</article></div></div>b", "a"),
    ("<div class='header widget'><p>most of the text</p><p class=ad>ad</p></div><p>end</p>", "most of the text end"),
    ("<article>a<div class=comments><article>b long comment</article></div></article>", "a"),
    ("<article>a</article><div class=comments><article class=comment>b long comment</article></div>", "a"),
    ("<div class='popup'><p>x</p></div><p>the text</p>", "the text"),
])
def test_attributes_and_wrappers(page, text):
    assert html.main_text(page, {}, {}) == text


def test_html_edge_tables(spark):
    same = (7, None, "<article>x</article>")
    df = spark.createDataFrame([same, same, (8, None, None)], PAGE).withColumn("host", __import__("pyspark").sql.functions.lit(1))
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html.extract(df).collect())
    assert got == [(7, "x", 1), (7, "x", 1), (8, "", 0)]
    assert html.extract(spark.createDataFrame([], PAGE)).count() == 0


def test_html_query(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op3_html_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        page = pages[r["page_id"]]["html"]
        assert r["url"] == pages[r["page_id"]]["url"] and r["n_chars"] == len(r["text"])
        inner = page.split("<article>", 1)[1].split("</article>", 1)[0]
        assert r["text"] == " ".join(__import__("html").unescape(__import__("re").sub(r"<[a-z/][^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", inner)).split())


# ---- language model

DOCS = "doc_id long, text string"


def brute_base(docs):
    words = lambda t: WORD.findall(lower(t or ""))
    held = lambda d: zlib.crc32(str(d).encode() if d is not None else b"null") % 7 == 2
    c, ends = collections.Counter(), 0
    for d, t in docs:
        if not held(d):
            c.update(words(t))
            ends += 1
    n, v = sum(c.values()) + ends, len(c) + (ends > 0)
    out = []
    for d, t in docs:
        w = words(t)
        s = sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        out.append((d, held(d), len(w) + 1, sum(c[x] > 0 for x in w) + (ends > 0), n, s))
    return sorted(out, key=str)


@pytest.mark.parametrize("top", [0, 3, 1 << 17])
def test_base_score(spark, top, monkeypatch):
    monkeypatch.setattr(lm, "TOP_WORDS", top)
    docs = [(i, " ".join(f"W{(i * j) % 17}" for j in range(i % 30))) for i in range(120)] + [
        (500, None), (501, ""), (502, "á Á \t b\n"), (503, "a b"), (503, "a b"), (503, "other"), (None, "x y")]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    got = lm.score_documents(d, share=1.0, rounds=1).collect()
    base = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got), key=str)
    want = brute_base(docs)
    assert [b[:5] for b in base] == [w[:5] for w in want]
    assert [b[5] for b in base] == pytest.approx([w[5] for w in want], rel=1e-9)
    assert all(r["score"] < 0 for r in got)


def test_lm_query_and_training(spark):
    got = queries.op5_lm_scores(spark, SF).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_base([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert got["base_score"].sum() == pytest.approx(sum(w[5] for w in want), rel=1e-9)
    train = docs.where(~lm.held_out())
    counts = lm.stage(lm.corpus_counts(train, 6), "test-counts")
    raw = lm.log10_probabilities(docs, lm.fit(train, counts, rounds=0)).select("doc_id", "score").toPandas().set_index("doc_id")
    held = got.index[got["held_out"]]
    assert got.loc[held, "score"].sum() > raw.loc[held, "score"].sum()           # what training adds on new text
    # words in their order are likelier than shuffled ones
    mixed = docs.selectExpr("doc_id", "array_join(array_sort(split(text, ' ')), ' ') AS text")
    mixed = lm.log10_probabilities(mixed, lm.fit(train, counts, rounds=0)).toPandas().set_index("doc_id")
    assert raw.loc[held, "score"].sum() > mixed.loc[held, "score"].sum()


def _toy():
    r = np.random.default_rng(1)
    text = pa.array([" ".join(r.choice(["the", "cat", "sat", "on", "mat"], 40)) for _ in range(30)])
    data, off = lm.wh.utf8(text)
    sub = lm._Subwords.of(lm.TOKENIZER)
    ids, bounds, _, _ = sub.stream(data, off)
    p1, p2 = lm._before(ids, bounds, sub.end)
    pairs = np.unique(p1 * 65536 + ids, return_counts=True)
    triples = np.unique((p2 * 65536 + p1) * 65536 + ids, return_counts=True)
    return lm._tables(pairs, triples, sub.end, lm.TOKENIZER, 3), ids, bounds


def test_probabilities_are_normalized_and_causal():
    m, ids, bounds = _toy()
    base = lm._log_probs(m, ids, bounds)
    at = bounds[0] + 37
    changed = ids.copy()
    changed[at] = 5
    lp = lm._log_probs(m, changed, bounds)
    assert np.allclose(lp[:at], base[:at]) and not np.allclose(lp[at:], base[at:])      # nothing before it sees it
    x, real, to = lm._window_ids(ids[:bounds[1]], bounds[:2], m.end)
    z, _ = lm._forward(m, x, real)
    p_class = np.exp(lm._log_softmax(z)).sum(-1)
    assert np.allclose(p_class, 1, atol=1e-5) and sorted(to[to >= 0].tolist()) == list(range(bounds[1]))
    every = np.arange(m.end + 1)
    for k in (0, 5, 30):
        p2, p1 = (np.full_like(every, ids[k + j]) for j in (0, 1))
        inside, counted = m.by_counts(p2, p1, every)
        inside = np.bincount(m.cls, inside, lm.CLASSES)
        assert np.allclose(inside[np.bincount(m.cls, minlength=lm.CLASSES) > 0], 1, atol=1e-5)
        assert counted.sum() == pytest.approx(1, abs=1e-5)


def test_gradient_and_learning():
    m, ids, bounds = _toy()
    before = lm._log_probs(m, ids, bounds).sum()
    state = {}
    for _ in range(10):
        lm._learn(m, ids, bounds, state)
    assert lm._log_probs(m, ids, bounds).sum() > before
    one = np.array([0, bounds[1]])
    whole = lm._log_probs(m, ids, bounds)[:bounds[1]]
    assert np.allclose(lm._log_probs(m, ids[:bounds[1]], one), whole, atol=1e-5)


def test_scores_use_all_counts_and_all_rows_train(spark, monkeypatch):
    r = np.random.default_rng(7)
    docs = [(i, " ".join(f"w{x}" for x in r.integers(0, 400, 60))) for i in range(80)] + [(90, ""), (91, None)]
    d = spark.createDataFrame(docs, DOCS).repartition(3)
    counts = lm.stage(lm.corpus_counts(d, 7), "test-counts")
    model = lm.fit(d, counts, rounds=0)
    got = {x["doc_id"]: x["score"] for x in lm.log10_probabilities(d, model).collect()}
    text = pa.array([t for _, t in docs])
    data, off = lm.wh.utf8(text)
    sub = lm._Subwords.of(lm.TOKENIZER)
    ids, bounds, _, _ = sub.stream(lm.wh.LOWER[data], off)
    p1, p2 = lm._before(ids, bounds, sub.end)
    pairs, triples = (np.unique(x, return_counts=True) for x in (p1 * 65536 + ids, (p2 * 65536 + p1) * 65536 + ids))
    m = lm._tables(pairs, triples, sub.end, lm.TOKENIZER, 5)
    assert (m.pairs.get(lm._pair_key(p1, ids)) > 0).all() and (m.triples.get(lm._triple_key(p2, p1, ids))[0] > 0).all()
    want = np.add.reduceat(lm._log_probs(m, ids, bounds), bounds[:-1])
    assert [got[i] for i, _ in docs] == pytest.approx(want.tolist(), rel=1e-4)
    seen = []
    monkeypatch.setattr(lm, "_averaged", lambda model, texts, path: seen.append(texts.count()) or model)
    lm.fit(d, counts)
    assert seen and all(n == len(docs) for n in seen)


def test_lm_empty_table(spark):
    assert lm.score_documents(spark.createDataFrame([], DOCS)).count() == 0


def articles(hosts=10, pages=12):
    """Pages that mark their article, in which an unlisted block is on all pages of the host."""
    rows = []
    for h in range(hosts):
        for p in range(pages):
            own = "".join(f"<p>Host {h} page {p} tells its story {k} here.</p>" for k in range(3))
            rows.append((h * 100 + p, f"http://h{h}.example/{p}",
                         f"<html><body><nav>Menu {h}</nav><article><h1>Title {h} {p}</h1><p class='zz'>Host {h} stands for <b>good</b> writing.</p>{own}"
                         "</article><footer>foot</footer></body></html>"))
    return rows


def test_the_template_decides_inside_marked_articles(spark):
    rows = articles()
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    want = {i: " ".join([f"Title {i // 100} {i % 100}"] + [f"Host {i // 100} page {i % 100} tells its story {k} here." for k in range(3)])
            for i, _, _ in rows}
    assert got == want
    # without a template (no token has that support) the block stays
    off = {r["page_id"]: r["text"] for r in html.extract(df, support=1.1).collect()}
    assert all("stands for good writing." in off[i] for i in off)


def test_a_host_of_copies_keeps_its_articles(spark):
    page = "<html><body><article><h1>One</h1><p>The same text.</p><p>On all pages.</p>{}</article></body></html>"
    rows = [(i, f"http://h/{i}", page.format("" if i % 2 else f"<p>own {i}</p>")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "One The same text. On all pages." + ("" if i % 2 else f" own {i}") for i in range(12)}


def test_names_do_not_drop_article_text():
    parts = ['<p class="share-price">The price rose.</p>', '<section class="discussion"><p>We discuss it.</p></section>',
             '<section class="related-work"><p>Others did it.</p></section>', '<div id="cookies-recipe">Bake them.</div>',
             '<table class="overlay-data"><tr><td>7</td></tr></table>', "<math><mi>x</mi></math>"]
    gone = ['<div class="ad">Buy.</div>', '<div class="comments"><p>First!</p></div>', "<aside>More.</aside>", "<form>Send</form>"]
    page = "<html><body><article><h1>T</h1>" + "".join(a + b for a, b in zip(parts, gone + ["", ""])) + "</article></body></html>"
    assert html.main_text(page, {}, {}) == "T The price rose. We discuss it. Others did it. Bake them. 7 x"


def test_equivalence_classes_against_brute_force(spark):
    """Occurrence vectors of all tokens of a host, compared as vectors."""
    rows = [r for r in articles(3, 11)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in html.templates(df).collect():
        pages = [html._tokens(h) for _, u, h in rows if u.split("/")[2] == r["host"]]
        vector = {t: tuple(p.count(t) for p in pages) for p in pages for t in p}
        frequent = {t for t, v in vector.items() if sum(x > 0 for x in v) >= 0.6 * len(pages)}
        assert set(r["tokens"]) == frequent
        by_class, by_vector = {}, {}
        for t, c in zip(r["tokens"], r["classes"]):
            by_class.setdefault(c, set()).add(t)
            by_vector.setdefault(vector[t], set()).add(t)
        assert sorted(map(sorted, by_class.values())) == sorted(map(sorted, by_vector.values()))
        assert {t for t, e in zip(r["tokens"], r["every"]) if e} == {t for t in frequent if all(vector[t])}
