"""Main text of web pages by boosted trees over block-tree features (operator 3)."""

from __future__ import annotations

import pickle
import random
import re
from collections.abc import Iterator
from html import escape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from tablewake.llm.arrow import add_columns
from tablewake.llm.boosting import Trees, boost
from tablewake.llm.dom import GROUPS, Node, features, in_order, parse

#: Pages that are learned from, pages that are made up from their paragraphs, and characters of a page in the sample.
SAMPLE_PAGES = 300
MADE_PAGES = 500
PAGES_AT_ONCE = 200
_BLOCK_TAG = re.compile(r"<(p|h1|h2|ul|li|blockquote|div|table)>")
_FILLER = ["One two three, four five six seven eight.", "Some more words follow here, and then some others.", "Short line", "The end of it. It was long and plain, with a clause or two; nothing else."]


def made_up_page(rng: random.Random, paragraphs: list[str]) -> str:
    """A page around an article, its blocks marked with what they are (``data-truth``: main, not)."""
    words = {name: words.split() for name, words in GROUPS.items()}
    say = lambda: escape(rng.choice(paragraphs))
    short = lambda: " ".join(say().split()[: rng.randrange(1, 7)])
    link = lambda: f'<a href="/{rng.random()}">{short()}</a>'
    listed = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(rng.randrange(2, 12))) + "</ul>"

    def name(kind: str) -> str:
        word = rng.choice(words[kind]) + rng.choice(["", "", "-1", "-box", "-wrap", "_inner"])
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(["", "x ", "c-"])}{word}"'

    def other(kind: str) -> str:
        text = {
            "menu": listed, "header": lambda: short() + rng.choice(["", listed()]), "footer": lambda: f"&copy; {say()}",
            "sidebar": lambda: rng.choice([listed(), f"<h3>{short()}</h3><p>{say()}</p>"]), "related": listed,
            "notice": lambda: f"<p>{say()}</p><button>{short()}</button>", "advert": lambda: rng.choice([say(), f"<p>{say()}</p>"]),
            "form": lambda: f"<label>{short()}</label><input><button>{short()}</button><p>{short()}</p>",
            "comment": lambda: f"<h3>{short()}</h3>" + "".join(f"<div><b>{short()}</b><p>{say()}</p></div>" for _ in range(rng.randrange(1, 6))),
        }[kind]()
        tags = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form"}
        plain = kind in tags and rng.random() < 0.5
        tag = tags[kind] if plain else rng.choice(["div", "div", "section"])
        return f'<{tag}{"" if plain and rng.random() < 0.7 else name(kind)} data-truth="not">{text}</{tag}>'

    def block() -> str:
        p = "".join(f"<p>{say()}" + rng.choice(["</p>", "</p>", "<br>", ""]) for _ in range(rng.randrange(1, 5)))
        return rng.choice([p, p, p, f"<h2>{short()}</h2>{p}", f"<ul><li>{say()}</li><li>{short()}</li></ul>", f"<blockquote>{say()}</blockquote>", f"<div>{p}</div>", f"<p>{short()} {link()} {say()}</p>", f"<table><tr><td>{short()}</td><td>{say()}</td></tr></table>"])

    inside = [block() for _ in range(rng.choice((0, 1, 2, 3, 8)))]
    bare = rng.random() < 0.15
    for kind in [] if bare else rng.sample(["notice", "advert", "form", "comment", "related"], rng.choice((0, 0, 1, 2))):
        inside.insert(rng.randrange(len(inside) + 1), other(kind))
    title = f"<h1>{short()}</h1>"
    title = f"<header>{title}</header>" if rng.random() < 0.15 else title
    tag = rng.choice(["article", "article", "main", "div", "section"])
    named = name("content") if rng.random() < (0.85 if tag in ("div", "section") else 0.3) else ""
    main = f'<{tag}{named} data-truth="main">{title}{"".join(inside)}</{tag}>'
    if bare:
        main = _BLOCK_TAG.sub(r'<\1 data-truth="main">', title + "".join(inside))
    for _ in range(rng.randrange(3)):
        main = f'<div class="{rng.choice(["wrap", "row", "col-8", "page", "container"])}">{main}</div>'
    top = [other(k) for k in rng.sample(["menu", "header", "notice", "advert", "sidebar"], rng.randrange(4))]
    end = [other(k) for k in rng.sample(["footer", "comment", "related", "sidebar", "advert", "form"], rng.randrange(4))]
    return "".join(["<html><body>", *top, main, *end, "</body></html>"])


def labelled(root: Node) -> list[Node]:
    """Nodes in order, ``label`` 1 on the main part and what stands around it, 0 elsewhere.

    Made-up pages are marked; real ones count if they have an article or main element.
    """
    nodes = in_order(root)
    for node in nodes:
        main = node.marks == "main" or not node.marks and node.tag in ("article", "main")
        above = node.parent.label if node.parent is not None else 0
        node.label = 0 if node.marks == "not" else 1 if main or above else 0
    for node in reversed(nodes):
        if node.label and node.parent is not None:
            node.parent.label = max(node.parent.label, node.label)
    return nodes


def train(pages: list[str], made: int = MADE_PAGES, seed: int = 11) -> Trees:
    """Trees from pages that show their article, and from pages made up of their paragraphs."""
    rng = random.Random(seed)
    roots = [parse(p) for p in pages]
    texts = [n.text for r in roots for n in in_order(r) if n.tag == "#text" and n.parent.tag == "p"] or _FILLER
    shown = [r for r in roots if any(n.tag in ("article", "main") for n in in_order(r))]
    x, y = [], []
    for root in shown + [parse(made_up_page(rng, texts)) for _ in range(made)]:
        nodes = labelled(root)
        if len(nodes) > 1:
            x.append(features(nodes)[1:])
            y.append(np.array([n.label for n in nodes[1:]], np.float64))
    return boost(np.concatenate(x), np.concatenate(y))


def decode(nodes: list[Node], logits: np.ndarray) -> list[bool]:
    """Which nodes to keep: the likeliest choice in which no kept node stands in a dropped one.

    A node is worth its log-probability of being kept plus the best of its children, or that of being dropped with
    all below. The root is always kept.
    """
    keep = -np.logaddexp(0, -logits)
    drop = -np.logaddexp(0, logits)
    index = {id(node): k for k, node in enumerate(nodes)}
    best, gone = keep.copy(), drop.copy()
    for k in range(len(nodes) - 1, 0, -1):
        p = index[id(nodes[k].parent)]
        gone[p] += gone[k]
        best[p] += max(best[k], gone[k])
    kept = [True] * len(nodes)
    for k in range(1, len(nodes)):
        kept[k] = kept[index[id(nodes[k].parent)]] and bool(best[k] >= gone[k])
    return kept


def extract(pages: list[str | None], trees: Trees) -> list[str]:
    """The main text of each page: the lines of its kept blocks, in page order, two line feeds between."""
    parsed = [in_order(parse(p)) for p in pages]
    if not parsed:
        return []
    logits = trees.logits(np.concatenate([features(nodes) for nodes in parsed]))
    out, at = [], 0
    for nodes in parsed:
        kept = decode(nodes, logits[at : at + len(nodes)])
        at += len(nodes)
        out.append("\n\n".join(node.text for node, k in zip(nodes, kept) if k and node.text))
    return out


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, made: int = MADE_PAGES) -> Trees:
    """Trees learned in one task from at most ``sample`` pages, in the order of a hash of their ids."""
    picked = pages.where("html is not null").select("page_id").distinct()
    picked = picked.orderBy(F.xxhash64(F.col("page_id").cast("string"), F.lit("sample")), "page_id").limit(sample)
    found = pages.join(F.broadcast(picked), "page_id").dropDuplicates(["page_id"]).select("page_id", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        model = pickle.dumps(train([html for _, html in seen], made))
        yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])

    learned = found.coalesce(1).mapInArrow(run, "model binary").first()
    return pickle.loads(learned[0]) if learned else train([], made)


def add_main_text(pages: DataFrame, trees: Trees) -> DataFrame:
    """``pages`` without ``html``, with ``text`` and ``n_chars`` (its code points).

    Blocks are classified by trees over their depth, subtree text density, link share, siblings and attribute words, and
    decoded so that no kept block stands in a dropped one. White space inside a block is one space; empty
    blocks are left out. Null and empty pages have an empty text. Repeated rows are kept; columns named like
    the added ones are replaced; an empty table stays empty.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def work(html: pa.Array) -> list[pa.Array]:
        texts: list[str] = []
        for low in range(0, len(html), PAGES_AT_ONCE):
            texts += extract(html.slice(low, PAGES_AT_ONCE).to_pylist(), shared.value)
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    added = [StructField("text", StringType()), StructField("n_chars", LongType())]
    return add_columns(pages, ["html"], added, work).drop("html")
