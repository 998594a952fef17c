"""Operators over embeddings and pages, the connected components, and the pipeline."""

import random
import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow.parquet as pq
import pytest
from cases import COLUMNS, components, documents, prose

from florile.llm import common, embedding_dedup, html_extract, line_dedup, near_dedup

VECTORS = "vec_id long, embedding array<float>, label int, n long, filter long, unit string, member long, key string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, y, 1, 2, "u", 3, "k") for i, v, y in rows], VECTORS).repartition(3)


@pytest.mark.parametrize("block", [embedding_dedup.BLOCK, 8])
def test_embeddings(spark, monkeypatch, block):
    """Clusters of near vectors, equal ones among them, against all pairs; also dealt into small blocks."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(64)
        for k in range(1 if c < 6 else 15):
            v = centre + (0.08 + 0.02 * (k % 5)) * rng.standard_normal(64)
            rows.append((len(rows), [float(x) for x in np.float32(v)], c % 2))
    rows += [(len(rows) + i, rows[40][1], y) for i, y in enumerate((rows[40][2], rows[40][2], 1 - rows[40][2], None))]
    n = len(rows)
    odd = [None, [], [0.0] * 64, [1.0, None] + [0.0] * 62, [float("nan")] * 64, [float("inf")] + [0.0] * 63, rows[40][1][:32]]
    rows += [(n + i, v, rows[40][2]) for i, v in enumerate(odd)]
    valid = [(i, np.array(v, float), y) for i, v, y in rows[: n] if y is not None]
    links, pairs = Counter(), []
    for a, (i, v, y) in enumerate(valid):
        for j, w, z in valid[:a]:
            if y == z and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.98:
                links[i] += 1
                links[j] += 1
                pairs.append((i, j))
    part = components([i for i, _, _ in rows], pairs)
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(vectors(spark, rows)).collect()}
    assert len(pairs) > 100 and set(got) == set(part)
    for i in part:
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (links[i], part[i], part[i] == i), i


@pytest.mark.parametrize("dims", [64, 128])
@pytest.mark.parametrize("words", [16, 256, 4096])
def test_pairs_at_the_threshold_share_a_direction(dims, words):
    """Recall of the filters for pairs whose cosine is exactly the threshold, with codebooks of small and large tables."""
    rng = np.random.default_rng(5)
    a = rng.standard_normal((300, dims))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((300, dims))
    b -= (a * b).sum(1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    t = embedding_dedup.THRESHOLD
    b = t * a + (1 - t * t) ** 0.5 * b
    shared = [len(np.intersect1d(x, y)) > 0 for x, y in zip(embedding_dedup.decode(a, words), embedding_dedup.decode(b, words))]
    assert np.mean(shared) >= 0.97


def test_embeddings_empty(spark):
    assert embedding_dedup.near_vectors(vectors(spark, [])).count() == 0
    r = embedding_dedup.near_vectors(vectors(spark, [(None, [1.0, 2.0], 1), (3, [1.0, 2.0], 1), (3, [1.0, 2.0], 1)])).collect()
    assert sorted((x["vec_id"] or 0, x["n_links"], x["kept"]) for x in r) == [(0, 0, True), (3, 1, True), (3, 1, True)]


def test_components(spark):
    rng = random.Random(3)
    pairs = [(i, i + 1) for i in range(1000, 1060)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(5, 5)]
    want = components({x for p in pairs if p[0] != p[1] for x in p}, [p for p in pairs if p[0] != p[1]])
    got = common.components(spark.createDataFrame(pairs, "a long, b long"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(want) and dict(rows) == want
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Pages

PAGE = """<!DOCTYPE html><html><head><title>Title &amp; more</title><style>p{{}}</style></head><body>
<header><a href="/">Home</a><p>The name of the site and the rest of it for all of the readers of it.</p></header>
<nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-banner">We use cookies to make the site of the best kind for you and for all of us here.</div>
{main}
<aside><p>The other things that you may like are of the same kind as this and that of the week.</p></aside>
<section id="comments"><p>The reader says that this is of the best that was in the world for him and the other.</p></section>
<form><label>Name</label><input><textarea>the text of a form</textarea></form>
<script>var x = "<p>not text</p>";</script><footer>&copy; the site</footer></body></html>"""
BODY = "<h1>The  title</h1><p>The text of the page is this and it is of a good length, so that it is <b>taken</b> as text.<p>Short&nbsp;one.<div class='ad'>Buy the best of the world at the shop of the town, now and for ever.</div><ul><li>an item of the list</ul><!-- the <p>comment -->"


@pytest.mark.parametrize(
    "page, text",
    [
        (None, ""),
        ("", ""),
        (PAGE.format(main=f"<article>{BODY}</article>"), "The title\nThe text of the page is this and it is of a good length, so that it is taken as text.\nShort one.\nan item of the list"),
        (PAGE.format(main=f"<main>{BODY}</main>"), "The title\nThe text of the page is this and it is of a good length, so that it is taken as text.\nShort one.\nan item of the list"),
        (PAGE.format(main=f"<div>{BODY}</div>"), "The title\nThe text of the page is this and it is of a good length, so that it is taken as text.\nShort one.\nan item of the list"),
        ("<article><p>a &lt;b&gt; &#233;<br>c", "a <b> é c"),
        ("plain text", "plain text"),
        ("<p>" * 2000 + "deep", "deep"),
        ('<article><p title="a hidden gem">One</p><p hidden>no</p><p aria-hidden="true">no</p><p style="display: none">no</p></article>', "One"),
        ('<article><p>The text of it is this.</p><section id="related-work"><p>The work of others is of use.</p></section><p class="side-note">A note of the side.</p></article>', "The text of it is this.\nThe work of others is of use.\nA note of the side."),
        ('<article><p>A short one.</p><ul><li><a href="/a">One link</a></li><li><a href="/b">Two links</a></li></ul></article>', "A short one."),
        ('<div class="site sidebar-right"><article class="post comments-open"><p>A short one.</p></article></div>', "A short one."),
        ('<article><p>A short one.</p><div class="comment-list"><p>A reader says that this is the best of all of it.</p></div></article><div id="comments"><article class="comment"><p>The other reader says so too, and that is that.</p></article></div>', "A short one."),
        ("<nav>меню</nav><div><p>" + "Довольно длинный абзац на другом языке. " * 8 + "</p></div>", ("Довольно длинный абзац на другом языке. " * 8).strip()),
        ("<article><p title='a > b'>x</p><p title=\"unclosed>y</p></article>", "x\ny"),
        ('<article><p data-x="' + "a>" * 9000 + '">One</p><p ' + "".join(f'a{k}="v>" ' for k in range(500)) + 'title="a > b">two</p></article>', "One\ntwo"),
        ("<article><p title=it's>it's</p><p \"x>here</p><p title = 'a > b'>there</p></article>", "it's\nhere\nthere"),
        ("<article><p>One</p><!--><p>two</p><!-- <p> --><![CDATA[<p>x</p>]]><?x <p>?>three</article><!-- open", "One\ntwo\n?>three"),
        ("<article><p>a < b and <3 of <b", "a < b and <3 of <b"),
    ],
)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


@pytest.mark.parametrize("end", ["deep", "deep>", "'deep\">"])
@pytest.mark.parametrize("piece", ["<div>", "<b>", "<p><b>", "<li>", '<a "', '<a ">', "</x>", "<div><p>", '<a x=">" ', '<a x="', "<a x='\"", "<a ", "<a x=' y=\">", "<!--", "<![CDATA[", "<!", "<script>", "</", '<p class="a', "&amp", "<a x=\"'\" y='>' <b"])
def test_deep_markup(piece, end):
    """Deep and broken markup takes time in proportion to its length."""

    def took(n):
        page = piece * (n // len(piece)) + end
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    assert min(took(400_000) for _ in range(2)) < 3 * max(took(200_000), 0.2)


@pytest.mark.parametrize("piece", ['<a "', '<a x=">" ', "<a x='\"", '<p class="a', "<a x=' y=\">"])
def test_megabytes_of_broken_tags(piece):
    def took(n):
        page = piece * (n // len(piece)) + "'"
        began = time.process_time()
        html_extract.main_text(page)
        return time.process_time() - began

    assert took(2_000_000) < 3 * max(took(1_000_000), 0.2)


class Plain(HTMLParser):
    """The text of the article, by the parser of the standard library and a list of what the pages' furniture is called."""

    BLOCKS = {"p", "div", "li", "ul", "h1", "h2", "h3", "article", "section", "aside", "form", "nav", "blockquote", "td", "tr", "table"}
    OUT = {"nav", "aside", "footer", "form", "script", "style", "header", "title"}
    NAMES = {"ad", "ads", "advert", "cookie", "notice", "comments", "comment", "sidebar", "share", "related", "newsletter"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack, self.blocks, self.part = [], [], ""

    def cut(self):
        self.blocks.append(" ".join(self.part.split()))
        self.part = ""

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
            while tag != "b" and self.stack and self.stack[-1][0] in ("p", "b"):
                self.stack.pop()
        if tag == "br":
            self.part += " "
        elif tag not in ("meta", "img", "link", "input", "hr"):
            names = set(re.split(r"[\s_-]+", " ".join(v or "" for k, v in attrs if k in ("class", "id"))))
            self.stack.append((tag, tag in self.OUT or bool(names & self.NAMES)))

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        if any(t == tag for t, _ in self.stack):
            while self.stack.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if any(t == "article" for t, _ in self.stack) and not any(out for _, out in self.stack):
            self.part += data


def test_pages_of_the_table():
    """Every page of a table against a second implementation."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"]).column(0).to_pylist()
    for page in pages:
        other = Plain()
        other.feed(page or "")
        other.close()
        other.cut()
        assert html_extract.main_text(page) == "\n".join(filter(None, other.blocks))
    assert len(pages) > 100


def test_pages(spark):
    rows = [(1, "u", None, "t", 3), (2, None, "<article>é😀</article>", None, 4), (2, None, "<article>é😀</article>", None, 4), (None, "v", "<p>" + "the word " * 30_000, "", 5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    out = html_extract.extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"] or 0), r["n_chars"]) for r in out.collect()) == [(0, 269_999), (1, 0), (2, 2), (2, 2)]
    assert html_extract.extract(df.limit(0)).count() == 0


# Pipeline


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    rows = [(i, prose(rng, 80)) for i in range(120)]
    rows += [(200 + i, " ".join(w.upper() + "!!" for w in prose(rng, 80).split())) for i in range(60)]
    rows += [(300, rows[5][1] + " added"), (301, None), (302, ""), (303, rows[7][1] + "\nmail jo@example.org"), (None, "a text without an id, of a few words")]
    docs = documents(spark, rows)
    spark.createDataFrame([(i, int(i < 200)) for i, _ in rows if i is not None and i < 300], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"{k}"))
        docs = spark.read.parquet(str(tmp_path / f"{k}"))
        if name != "packing":
            assert docs.columns == COLUMNS
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert not any(200 <= (i or 0) < 260 for i in seen["quality"]) and set(range(120)) <= set(seen["quality"])
    assert seen["line_dedup"][303]["text"] == "mail jo@example.org"
    assert 300 not in seen["near_dedup"] and 5 in seen["near_dedup"]
    assert seen["pii"][303]["text"] == "mail [EMAIL]"
    assert set(seen["packing"]) == set(seen["pii"])
    assert sorted(corpus_pipeline.run(spark, str(tmp_path)).columns) == sorted(docs.columns)
    empty = documents(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert line_dedup.MIN_CHARS == 10 and near_dedup.THRESHOLD == 0.8
