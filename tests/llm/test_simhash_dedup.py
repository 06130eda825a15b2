import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tablewake.llm.simhash_dedup import POSITION_SETS, fingerprint, fingerprint_links, simhash_groups

SCHEMA = "doc_id long, text string, fp string"


def plain_fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_components(pairs, nodes):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_every_three_positions_lie_outside_some_set():
    from itertools import combinations

    for away in combinations(range(8), 3):
        assert any(not set(away) & set(at) for at in POSITION_SETS)


@pytest.mark.parametrize("bucket", [1024, 2])
def test_links_are_all_pairs_within_three_bits(spark, bucket):
    rng = random.Random(5)
    fps = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        for _ in range(12):
            fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), bucket=bucket)
    got = sorted(map(tuple, found.collect()))
    mask = (1 << 64) - 1
    want = sorted((a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3)
    assert got == want and want


def test_radius_beyond_the_guarantee_is_refused(spark):
    with pytest.raises(ValueError):
        fingerprint_links(spark.createDataFrame([(1,)], "fp long"), max_bits=4)


def test_groups_with_nulls_ties_and_clashing_names(spark):
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "déjà", "Été"]
    base = [" ".join(rng.choices(words, k=n)) for n in (1, 2, 3, 40, 400)]
    texts = [None, "", " \n\t", *base, *base, base[4] + " extra", base[4].upper(), "x" * 300_000, "w " * 50_000]
    rows = [(100 - i, t, "clash") for i, t in enumerate(texts)] + [(None, "", "c"), (100, None, "c")]
    got = simhash_groups(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    prints = {t: plain_fingerprint(t) for _, t, _ in rows}
    assert all(fingerprint(t) % (1 << 64) == f for t, f in prints.items())
    pairs = [(a, b) for a in prints.values() for b in prints.values() if (a ^ b).bit_count() <= 3]
    root = plain_components(pairs, set(prints.values()))
    least = {}
    for i, t, _ in rows:
        if i is not None:
            r = root[prints[t]]
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{prints[t]:016x}", least[root[prints[t]]]) for i, t, _ in rows)
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == want


def test_empty_table(spark):
    assert simhash_groups(spark.createDataFrame([], SCHEMA)).count() == 0


def test_hash_is_the_one_of_spark(spark):
    text = "the quick bröwn"
    value = spark.range(1).select(F.xxhash64(F.lit(text))).first()[0]
    assert fingerprint(text) == value
