import itertools
import random

import numpy as np
import pytest

from factloom.llm.html_extract import Forest, Vocabulary, extract, html_text, standard_model, trained
from factloom.llm.html_tree import labelled_page, parse

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Menu one</a></li><li><a href='/b'>two</a></li></ul></nav><!-- <p>no</p> -->"
    '<div class="ad">Buy this now.</div><div class="cookie-notice"><p>We use cookies.</p></div>'
    "<article><h1>Head &amp; tail</h1><p><b>First <i>pa</i>rt\n  of&nbsp;it<br><p>Second &lt;b&gt; &eacute;</p>"
    '<form><input name="q"><label>Search</label></form></article>'
    '<aside class="sidebar"><p>Related things to read about.</p></aside>'
    '<section id="comments"><h3>Comments</h3><div class="comment"><p>I liked this a lot, thanks.</p></div></section>'
    "<footer>&copy; someone</footer></body></html>"
)


def test_main_text():
    assert extract([PAGE], standard_model()) == ["Head & tail First part of it Second <b> é"]


def test_held_out_pages():
    rng, model = random.Random(99), standard_model()
    trees = [parse(labelled_page(rng)) for _ in range(200)]
    wrong = total = 0
    for tree, content in zip(trees, model.content(trees), strict=True):
        label = np.array([int(m or 1) for m in tree.marks])
        wrong += int(((content >= 0.5) != label).sum())
        total += len(label)
    assert wrong / total < 0.02  # wrappers without text of their own among them


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(1)
    trees = [parse("<div><p>a</p><ul><li>b<li>c</ul></div><p>d</p>"), parse("<section><h1>x</h1></section>"), parse("")]
    forest = Forest(trees, Vocabulary())
    unary, edge = rng.normal(size=len(forest.parent)), rng.normal(size=(20, 2, 2))
    marginal, both = forest.beliefs(unary, edge)
    for a, b in zip(forest.first[:-1], forest.first[1:], strict=True):
        total, one, pairs = 0.0, np.zeros((b - a, 2)), np.zeros((b - a, 2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            score = sum(unary[a + i] * x for i, x in enumerate(labels))
            score += sum(edge[forest.kind[a + i], labels[forest.parent[a + i] - a], x] for i, x in enumerate(labels) if forest.parent[a + i] >= 0)
            weight = np.exp(score)
            total += weight
            for i, x in enumerate(labels):
                one[i, x] += weight
                if forest.parent[a + i] >= 0:
                    pairs[i, labels[forest.parent[a + i] - a], x] += weight
        assert np.allclose(marginal[a:b], one / total)
        assert np.allclose(both[a + 1 : b], pairs[1:] / total)


def test_training_raises_accuracy():
    rng = random.Random(5)
    pages = [labelled_page(rng) for _ in range(40)]
    model = trained(pages, rounds=60)
    trees = [parse(p) for p in pages]
    good = [((c >= 0.5) == np.array([int(m or 1) for m in t.marks])).mean() for t, c in zip(trees, model.content(trees), strict=True)]
    assert np.mean(good) > 0.97


def article(body):
    words = "The council met on Monday to talk about the new bridge over the river and its cost."
    return f"<html><body><nav><a href='/'>Home</a></nav><article><h1>News</h1><p>{words}</p>{body}<p>{words}</p></article><footer>Imprint</footer></body></html>", f"News {words} ", f" {words}"


@pytest.mark.parametrize("body,want", [
    ("<p>" + "İ" * 40 + " Istanbul grows every year by many people.</p><script>var y</script><p>So the city builds.</p>", "İ" * 40 + " Istanbul grows every year by many people. So the city builds."),
    ("<p>one comes first of all</p><datalist><option>a<option>b</datalist><p>two comes after it</p>", "one comes first of all two comes after it"),
    ("<p>one comes first of all</p><button>Press <p>two comes after it</p>", "one comes first of all two comes after it"),
    ("<p>one comes <button type=x>not <b>this</b></button>first of all</p><select><option>x</option><option>y</select><p>two comes after it</p>", "one comes first of all two comes after it"),
    ("<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold from here on.</p>", "Let x=2 hold from here on."),
    ("<p title=it's>a quote that never closes</p><p>and more text here</p>", "a quote that never closes and more text here"),
    ("<p>a < b and b > c for all of them</p>", "a < b and b > c for all of them"),
    ("<p data-x='>'>a mark in a quoted value</p>", "a mark in a quoted value"),
])
def test_nothing_of_the_article_is_lost(body, want):
    page, before, after = article(body)
    assert extract([page], standard_model()) == [before + want + after]


@pytest.mark.parametrize("page", [
    'i<n; j = "a" ' * 80_000, "<div>" * 20_000 + "</i></ul>" * 20_000, "<li><ul>" + "<div>" * 5_000 + "<li></li>" * 20_000, "<i>" * 20_000 + "<b>" * 20_000 + "</i>" * 20_000,
    '<a x="" ' * 100_000 + ">", '<a x=" >' * 80_000, "<button>x" * 60_000, "<option>x" * 60_000, "<!--" * 100_000, "<a<a" * 200_000, "<p a='>" * 100_000,
])
def test_broken_markup_is_read_in_linear_time(page):
    import time

    began = time.process_time()
    parse(page)
    assert time.process_time() - began < 3


def test_extraction_by_brute_force():
    """The text of a page is that of the elements whose marginal, summed over all labellings, reaches a half."""
    model = standard_model()
    for page in ("<nav><a>x</a></nav><article><p>Some longer text of an article, in one part.</p></article>", "<div class=ad>Buy</div><p>Words and words and words.</p><footer>c</footer>", "<ul><li><a>m</a><li><a>n</a></ul><p>t</p>"):
        tree = parse(page)
        forest = Forest([tree], model.vocabulary)
        unary, n = forest.unary(model.weights), len(tree.tags)
        one, total = np.zeros(n), 0.0
        for labels in itertools.product((0, 1), repeat=n):
            weight = np.exp(sum(u * x for u, x in zip(unary, labels, strict=True)) + sum(model.edge[forest.kind[i], labels[tree.parents[i]], labels[i]] for i in range(1, n)))
            one, total = one + weight * np.array(labels), total + weight
        want = " ".join(text for element, text in tree.blocks if one[element] / total >= 0.5)
        assert extract([page], model) == [want]


@pytest.mark.parametrize("page", ["", "plain text", "<", "<p", "<p>a<div>b</p>c</div>", "</div></p>x", "<a><b><p>q", "<script>never ends", "<table><tr><td>1<td>2<tr><td>3</table>", "<!-- open", "<p>" * 3000 + "deep", "a" * 200_000])
def test_broken_pages(page):
    extract([page], standard_model())


def test_table(spark):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (None, None, None, "c"), (2, "v", "", "c"), (3, "w", "just words", "c")]
    got = html_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == 5 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == extract([PAGE], standard_model()) * 2
    assert [r.text for r in got if r.page_id is None] == [""]
    assert html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
