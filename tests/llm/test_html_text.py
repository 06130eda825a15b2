import html
import random
import re

import numpy as np
import pytest

from tablewake.llm.boosting import boost
from tablewake.llm.dom import features, in_order, parse
from tablewake.llm.html_text import add_main_text, decode, extract, fit, labelled, made_up_page, train
from tablewake.llm.queries import QUERIES

SCHEMA = "page_id long, url string, html string, text string, n_chars string"


def shape(node):
    return node.text if node.tag == "#text" else (node.tag, [shape(c) for c in node.children])


def test_trees_of_untidy_pages():
    assert shape(parse("<p>a <b>b<br><p>c&amp;d &am; <i>e</i>\n f</p>g")) == ("body", [("p", ["a b"]), ("p", ["c&d &am; e f"]), "g"])
    assert shape(parse("<head><title>x<body><script>var a='</p>'</script><ul><li>a<li>b<ul><li>c</ul></ul></div>z")) == (
        "body", [("ul", [("li", ["a"]), ("li", ["b", ("ul", [("li", ["c"])])])]), "z"]
    )
    assert shape(parse("<div>a<div>b</div>c<!-- no --></div>")) == ("body", [("div", ["a", ("div", ["b"]), "c"])])
    assert shape(parse("<table><tr><td>a<td>b<tr><td>c</table><style>p{}")) == (
        "body", [("table", [("tr", [("td", ["a"]), ("td", ["b"])]), ("tr", [("td", ["c"])])])]
    )
    # A head left open ends with what cannot stand in it.
    article = ("body", [("article", [("p", ["a"])])])
    for end in ("", "</title>", "</title><script>var p</script><link href=x><noscript><img></noscript><style>p{}</style>"):
        assert shape(parse(f"<head>{end and '<title>x <b>y</b>'}{end}<article><p>a")) == article
    assert shape(parse("<head><meta charset=x><head><title>x <title> y</title>\n</head><article><p>a")) == article
    assert shape(parse("<html><head><title>x</title> a <p>b")) == ("body", ["a", ("p", ["b"])])
    assert shape(parse("<head><noscript><p>x</p></noscript><svg/><p>a</p><svg><title>x</title></svg>")) == ("body", [("p", ["a"])])
    # A slash closes svg and math, and nothing else.
    assert shape(parse("<p>a<svg class='i'/>b<svg><path/><svg/></svg>c</p><p>d<math/>e</p><div/>f")) == (
        "body", [("p", ["abc"]), ("p", ["de"]), ("div", ["f"])]
    )
    assert shape(parse("<p>So <math><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mi>n</mi></mfrac></mrow></math> holds.")) == ("body", [("p", ["So x=1n holds."])])
    for odd in (None, "", "   ", "<", "<p", "</p>", "&nbsp;"):
        assert shape(parse(odd)) == ("body", []) or odd in ("<", "<p")


def test_boosted_trees_learn_a_combination():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    model = boost(x[:2000], y[:2000])
    assert ((model.logits(x[2000:]) > 0) == y[2000:]).mean() > 0.95


def plain_decode(nodes, logits):
    """The likeliest of all choices without contradiction."""
    from itertools import product

    best = None
    for choice in product([True, False], repeat=len(nodes) - 1):
        kept = [True, *choice]
        by = {id(n): k for n, k in zip(nodes, kept)}
        if any(k and n.parent is not None and not by[id(n.parent)] for n, k in zip(nodes, kept)):
            continue
        total = sum(-np.logaddexp(0, -z if k else z) for z, k in list(zip(logits, kept))[1:])
        if best is None or total > best[0]:
            best = (total, kept)
    return best[1]


def test_decoding_is_the_best_choice_without_contradiction():
    rng = np.random.default_rng(2)
    page = "<div><p>a</p><p>b</p><div><p>c</p></div></div><div>d</div>"
    nodes = in_order(parse(page))
    for _ in range(60):
        logits = rng.normal(size=len(nodes)) * 2
        assert decode(nodes, logits) == plain_decode(nodes, logits)


@pytest.fixture(scope="module")
def pages(spark, small):
    return [r.html for r in spark.read.parquet(f"{small}/pages.parquet").select("html").collect()]


@pytest.fixture(scope="module")
def trees(pages):
    return train(pages[:25], made=300)


def article(page):
    inner = page[page.index("<article>") + 9 : page.index("</article>")]
    blocks = [re.sub(r"</?b>", "", b).replace("<br>", " ") for b in re.split(r"</?(?:h1|p)>", inner)]
    return "\n\n".join(" ".join(html.unescape(b).split()) for b in blocks if b.strip())


def test_articles_of_pages_not_learned_from(pages, trees):
    assert extract(pages[25:], trees) == [article(p) for p in pages[25:]]


def test_other_pages_than_the_given_ones(trees):
    rng = random.Random(77)
    hit = miss = wrong = 0
    for _ in range(150):
        nodes = labelled(parse(made_up_page(rng, ["Plain words, none of them seen before.", "A b c"])))
        for node, kept in zip(nodes, decode(nodes, trees.logits(features(nodes)))):
            n = len(node.text)
            hit, miss, wrong = hit + n * (kept and node.label), miss + n * (not kept and node.label), wrong + n * (kept and not node.label)
    assert hit / (hit + miss) > 0.95 and hit / (hit + wrong) > 0.95


def test_columns_nulls_and_empty_table(spark, pages):
    rows = [(i, "u", p, "clash", "clash") for i, p in enumerate(pages[:12])] + [(90, None, None, "c", "c"), (None, "u", "", "c", "c"), (0, "u", pages[0], "c", "c")]
    rows.append((91, "u", "<article>" + "<p>long text &amp; more</p>" * 30_000, "c", "c"))
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit(df, sample=10, made=120)
    found = add_main_text(df, model)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id in (90, None)] == ["", ""]
    assert max(r.n_chars for r in got) == 30_000 * 18 - 2
    assert add_main_text(df.where("false"), model).count() == 0


def test_no_pages_to_learn_from(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert add_main_text(empty, fit(empty, made=50)).count() == 0


def test_query(spark, small):
    rows = QUERIES["op3_html_extraction"](spark, small).collect()
    source = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    assert all(r.text == article(source[r.page_id]) for r in rows) and len(rows) == len(source)
