import random
from collections import Counter

from pyspark.sql import functions as F

from tablewake.llm.decontaminate import contamination, fingerprints, hamming_pairs, with_shingles

DOCS = "doc_id long, text string, item_id string, n int, content string"
ITEMS = "item_id long, text string, key string"
WORDS = [a + b for a in ("ka", "lo", "mé", "ru", "ti") for b in ("n", "st", "x", "pel", "do")]


def plain_shingles(words):
    k = min(5, len(words))
    return Counter(" ".join(words[i : i + k]) for i in range(len(words) - k + 1))


def plain_words(text):
    return "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()


def plain_matches(docs, items, threshold=0.8):
    found = {}
    for d, text in docs:
        words = plain_words(text)
        for i, item in items:
            want = plain_words(item)
            if not want:
                continue
            k, b = min(5, len(want)), plain_shingles(want)
            for s in range(len(words)):
                window = words[s : s + len(want)]
                if len(window) < k:
                    break
                a = plain_shingles(window) if k == 5 or len(window) == k else Counter()
                shared = sum((a & b).values())
                sim = shared / (sum(a.values()) + sum(b.values()) - shared)
                if sim >= threshold:
                    best, n = found.get((d, i), ((0, 0), 0))
                    found[d, i] = (max(best, (sim, -s)), n + 1)
    return {k: (round(v[0][0], 9), -v[0][1], v[1]) for k, v in found.items()}


def test_same_as_comparing_all_windows(spark):
    rng = random.Random(7)
    items = [" ".join(rng.choices(WORDS, k=n)) for n in (3, 5, 6, 15, 15, 30, 59)]
    items += ["Ti ka. " * 8, items[3]]
    docs = [None, "", "...", "x" * 100_000]
    for item in items:
        words = item.split()
        around = [rng.choices(WORDS, k=rng.randrange(40)) for _ in range(2)]
        docs.append(" ".join(around[0] + words + around[1]))
        docs.append(", ".join(around[0] + [w.upper() for w in words]))
        edited = words.copy()
        edited[rng.randrange(len(words))] = "other"
        docs.append("\n".join(around[0] + edited + around[1]))
        docs.append(" ".join(around[0] + words[: len(words) * 9 // 10]))
        docs.append(" ".join(words[: len(words) // 2] + ["new"] + words[len(words) // 2 :] + around[1]))
    docs += [docs[4], " ".join(rng.choices(WORDS, k=3000))]
    rows = list(enumerate(docs)) + [(0, docs[4])]
    found = contamination(
        spark.createDataFrame([(d, t, "clash", 1, "c") for d, t in rows], DOCS),
        spark.createDataFrame([(i, t, "clash") for i, t in enumerate(items)] + [(90, None, ""), (91, "", "")], ITEMS),
    ).collect()
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_windows) for r in found}
    assert got == plain_matches(rows, list(enumerate(items)))
    assert len(got) == len(found) > 20


def test_blocks_find_all_fingerprints_within_the_radius(spark):
    rng = random.Random(4)
    item_fps = [rng.getrandbits(64) for _ in range(20)]
    fps = [f ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(40))) for f in item_fps for _ in range(20)]
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    windows = spark.createDataFrame([(1, str(k), signed(f)) for k, f in enumerate(fps)], "n int, content string, fp long")
    items = spark.createDataFrame([(1, str(k), signed(f)) for k, f in enumerate(item_fps)], windows.schema)
    for radius in (0, 7, 15, 23):
        found = [tuple(r) for r in hamming_pairs(windows, items, radius).select("content", "item", "bits").collect()]
        want = [
            (str(a), str(b), (f ^ g).bit_count())
            for a, f in enumerate(fps)
            for b, g in enumerate(item_fps)
            if (f ^ g).bit_count() <= radius
        ]
        assert sorted(found) == sorted(want)


def test_fingerprint_takes_the_majority_of_shingle_hashes(spark):
    text = "a b c d e f a b c d e f g"
    words = text.split()
    shingles = [" ".join(words[i : i + 5]) for i in range(len(words) - 4)]
    hashes = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    df = spark.createDataFrame([(13, text)], "n int, content string")
    assert fingerprints(with_shingles(df, [5])).first().fp % (1 << 64) == want


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "ka lo mé ru ti", "")], ITEMS)
    some = spark.createDataFrame([(1, "ka lo mé ru ti", "", 1, "")], DOCS)
    assert contamination(docs, one).count() == 0
    assert contamination(some, items).count() == 0
    assert contamination(some, one).count() == 1
