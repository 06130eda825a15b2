import random

import pytest

from tablewake.llm import components


def plain(links):
    root = {n: n for pair in links for n in pair}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


@pytest.mark.parametrize("rows", [250_000, 10])
def test_same_as_union_find(spark, monkeypatch, rows):
    monkeypatch.setattr(components, "ROWS", rows)
    rng = random.Random(rows)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    star = [(2000, 2000 + i) for i in range(1, 40)]
    sparse = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(50)]
    links = chain + star + sparse + chain[:3]
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    want = plain([(a, b) for a, b in links if a != b])
    assert {r.node: r.root for r in found} == want
    assert len(found) == len(want)


def test_no_links(spark):
    assert components.connected_components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0
