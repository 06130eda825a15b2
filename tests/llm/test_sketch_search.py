import random
import re
from collections import Counter

import pytest

from tablewake.llm import sketch_search as S

SCHEMA = "doc_id long, text string, score string, item_id long, rank long"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain_ranked(docs, items, top):
    """Scores of all pairs, then the best of each item."""
    found = [Counter(plain_terms(t)) for _, t in docs]
    n, terms = sum(bool(f) for f in found), sum(f.total() for f in found)
    df = Counter(t for f in found for t in f)
    out = []
    for item, text in dict.fromkeys(items):
        scored = []
        for (doc, _), f in zip(docs, found):
            total = 0
            for t in plain_terms(text):
                if t in f:
                    m = 100 - 25 + (25 * f.total() * n) // terms
                    total += S.term_weight(n, df[t]) * ((1_000_000_000 * f[t]) // (1000 * f[t] + 12 * m))
            if total > 0:
                scored.append((-total, doc is None, doc or 0, doc))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, top, partitions=3):
    frame = spark.createDataFrame([(d, t, "c", 7, 1) for d, t in docs], SCHEMA).repartition(partitions)
    asked = spark.createDataFrame([(i, t, 5, "c") for i, t in items], "item_id long, text string, doc_id long, query string")
    return sorted(map(tuple, S.ranked(frame, asked, top).collect()), key=str)


def test_terms_of_odd_texts():
    for text in ("", None, "Ab-c 1_2\x00x\x7fé É ÀZ 日本 İ K q", "".join(map(chr, range(0x250))), "🎉a🎉", "\x85x"):
        assert [t.decode() for t in S.terms(text)] == plain_terms(text)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_ranks_are_those_of_all_pairs(spark, seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(S, "ROUND_ITEMS", (2000, 3, 5)[seed])
    words = [f"w{i}" for i in range(40)] + ["É", "日本", "A1"]
    text = lambda n: " ".join(rng.choices(words, weights=range(len(words), 0, -1), k=rng.randrange(n)))
    docs = [(i, text(30)) for i in range(150)] + [(None, "w0 w1"), (None, None), (3, "w5"), (900, ""), (901, "--"), (902, "w1 " * 20_000)]
    docs += [(1000 + i, "W0 w0 w39") for i in range(12)]
    items = [(i, text(12)) for i in range(8)] + [(50, None), (51, ""), (52, "unknown"), (None, "w0 w0 w3"), (1, "w7"), (1, "w7"), (60, "w39 w0")]
    assert run(spark, docs, items, 5) == plain_ranked(docs, items, 5)


def test_narrow_sketches_only_cost_more(spark, small):
    """Bounds hold with coordinates that many terms share, and wide sketches leave out most documents."""
    texts = [r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    items = S.Items(*zip(*[(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]))
    found = [Counter(S.terms(t)) for t in texts]
    df = Counter(items.number[t] for f in found for t in f if t in items.number)
    size = sum(bool(f) for f in found), sum(f.total() for f in found)
    results, shares = [], []
    for width in (1, 64, S.WIDTH):
        searcher = S.Searcher(items, df, *size, top=5, width=width)
        for low in range(0, len(texts), 64):
            searcher.add(list(range(low, low + 64))[: len(texts[low : low + 64])], texts[low : low + 64])
        results.append(searcher.found)
        shares.append(searcher.rescored / searcher.seen)
    assert results[0] == results[1] == results[2]
    assert shares[0] >= shares[1] >= shares[2]


def test_the_sketch_bounds_every_score():
    rng = random.Random(5)
    texts = [" ".join(f"t{rng.randrange(60)}" for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    items = S.Items(["q"], ["t1 t2 t2 t3 t40"])
    seen = []

    class Watched(S.Searcher):
        def _descend(self, q, bound, *rest):
            seen.append(bound.copy())
            super()._descend(q, bound, *rest)

    searcher = Watched(items, {}, 60, 1200, top=60, width=8)
    searcher.add(list(range(60)), texts)
    scores = {doc: -s for s, _, doc in searcher.found[0]}
    assert len(seen) == 1 and all(seen[0][d] >= s for d, s in scores.items())


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")], 5) == []
    assert run(spark, [(1, "a")], [], 5) == []
    assert run(spark, [(1, "-"), (2, None)], [(1, "a")], 5) == []


def test_string_ids(spark):
    docs = spark.createDataFrame([("b", "x y"), ("a", "x y")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "x")], "item_id string, text string")
    assert [(r.item_id, r.rank, r.doc_id) for r in S.ranked(docs, items).orderBy("rank").collect()] == [("q", 1, "a"), ("q", 2, "b")]
