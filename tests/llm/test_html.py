import itertools
import math
import re
import time

import pytest

from weftline.llm import html_extract as hx


@pytest.fixture(scope="module")
def model(spark):
    return hx.default_model(spark)


def test_marginals_equal_enumeration(model):
    page = hx.Page("<html><body><nav><a href=/x>Menu</a></nav><article><h1>Title</h1><p>Some text.<div class=ad>Buy now.</div></article></body></html>")
    n, weight = len(page.up), {}
    odds = [max(-30, min(30, sum(model.odds.get(f, 0) for f in fs))) for fs in page.features]
    for labels in itertools.product((0, 1), repeat=n):
        w = math.exp(model.prior * labels[0] + sum(o for o, y in zip(odds, labels) if y))
        for c in range(1, n):
            w *= model.step[page.text[c] is not None][labels[page.up[c]]][labels[c]]
        weight[labels] = w
    for c, got in enumerate(hx.marginals(page, model)):
        want = math.log(sum(w for y, w in weight.items() if y[c]) / sum(w for y, w in weight.items() if not y[c]))
        assert got == pytest.approx(want, abs=1e-6)


def test_held_out_accuracy(model):
    right = total = 0
    for html, text in hx.labelled_pages(300, seed=99):
        page = hx.Page(html)
        lines = set(text.split("\n"))
        for t, x in zip(page.text, hx.marginals(page, model)):
            if t is not None:
                total += 1
                right += (x > 0) == (t in lines)
    assert right / total > 0.95, right / total


def test_given_pages(spark, model):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.text for r in hx.extract(rows, model).collect()}
    wrong = []
    for r in rows.collect():
        main = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [" ".join(hx.entities.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", main)]
        if got[r.page_id] != "\n".join(b for b in blocks if b):
            wrong.append(r.page_id)
    assert not wrong, (len(wrong), wrong[:5])


def test_odd_pages(spark, model):
    rows = [(1, None), (2, ""), (3, "<article><p>One &amp;lt; two&nbsp;&nbsp;three\n four<p>five</article>"), (3, "<script>x</script"), (4, "<head><title>t"), (5, "<body><article><p>" + "word. " * 20000 + "</article>")]
    got = [(r.page_id, r.text) for r in hx.extract(spark.createDataFrame([(*r, "x") for r in rows], "page_id bigint, html string, text string"), model).collect()]
    assert got[:5] == [(1, ""), (2, ""), (3, "One &lt; two three four\nfive"), (3, ""), (4, "t")]
    assert got[5][1] == ("word. " * 20000).strip()
    assert hx.extract(spark.createDataFrame([], "page_id bigint, html string"), model).count() == 0


@pytest.mark.parametrize("part", ["<a ", "<a '", "<", "<div>", "<!", "<video>", "<a ='>' ", "</p><p>", "<li><div>", "<b x=\"", "<!--", "&#", "<title>", "<svg></svg", "<head>", "<script ", "<td><li><dt><option>"])
def test_parsing_is_linear(part):
    def seconds(n):
        t = time.process_time()
        hx.Page(part * n + "</p></body>" * 10)
        return time.process_time() - t

    n = 1_000_000 // len(part)
    assert seconds(n) < max(4, 25 * seconds(n // 10)), part


def test_nothing_is_swallowed(model):
    tell = lambda body: hx.main_text(f"<html><head><title>x</title></head><body><article><h1>Title of it</h1>{body}<p>Words after it, and some more of them.</p></article></body></html>", model).split("\n")[1:]
    after = ["Words after it, and some more of them."]
    for odd in ("<video>", "<video src=a>", "<svg>", "<select>", "<object data=x>", "<iframe src=x>", "<textarea>", "<noscript>", "<template>", "<canvas/>", "<title>"):
        assert tell(odd) == after, odd
    assert tell("<p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> here.</p>") == ["Energy is E=m here.", *after]
    assert tell("<p>One <svg><text>no</text></svg>two <script>var a = '<p>';</script>three.</p>") == ["One two three.", *after]
    assert tell("<video>Your browser cannot <p>play it.</p></video>") == after
    assert tell("<p>For a < b and b > c it holds.</p>") == ["For a < b and b > c it holds.", *after]
    assert tell("<p title=don't>It's so.</p>") == ["It's so.", *after]
    assert tell('<p title="a > b">So it is there.</p>') == ["So it is there.", *after]
    assert hx.main_text("<head><body><article><p>Some words that are here to be read.</p></article>", model) == "Some words that are here to be read."


def test_fit_on_given_labels(spark):
    """Pages of one site whose main text only the labels tell: what is in .a is text, what is in .b is not."""
    pages = [(f"<body><div class=b><p>{w} one two three.</p></div><div class=a><p>{w} four five.</p><p>{w} six.</p></div></body>", f"{w} four five.\n{w} six.") for w in ("Ape", "Bee", "Cat", "Dog", "Eel") for _ in range(8)]
    rows = spark.createDataFrame(pages, "html string, text string").repartition(3)
    own = hx.fit(rows)
    assert hx.main_text("<body><div class=b><p>Fox one two three.</p></div><div class=a><p>Fox four five.</p></div></body>", own) == "Fox four five."
    got = hx.extract(spark.createDataFrame(list(enumerate(h for h, _ in pages)), "page_id bigint, html string"), own).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == [t for _, t in pages]
