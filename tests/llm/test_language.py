import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tablewake.llm.language import Profiles, add_language, learn, ngrams, profile
from tablewake.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, score string, lang_pred string"
WORDS = {"aa": ["the", "and", "thing", "other"], "bb": ["über", "und", "nicht", "schön"], "cc": ["año", "que", "los", "niño"]}


def plain_ngrams(text):
    found = Counter()
    word = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    for w in word:
        marked = f"\0{w}\0"
        for n in (1, 2, 3):
            for i in range(len(marked) - n + 1):
                g = marked[i : i + n]
                if g.strip("\0"):
                    found[g] += 1
    return found


def name(key):
    codes = [int(key) >> s & 0x1FFFFF for s in (42, 21, 0)]
    return "".join(chr(c) for c in codes if c != 0x1FFFFF)


def text(rng, lang, n):
    return " ".join(rng.choices(WORDS[lang], k=n)).capitalize()


def test_ngrams_are_those_of_the_words():
    for t in [None, "", "12 !", "a", "Été, l'année 2020!", "x  y\n\nz", "日本 🎉 b", "ab" * 50_000]:
        keys, counts = ngrams(t)
        # A blank between two words stands for the end of one and the start of the next.
        assert dict(zip(map(name, keys), counts)) == dict(plain_ngrams(t))


def test_distance_counts_places():
    ranked = {lang: profile(" ".join(words), 10).tolist() for lang, words in WORDS.items()}
    profiles = Profiles(ranked, 10)
    rng = random.Random(1)
    for lang in WORDS:
        t = text(rng, lang, 9)
        own = profile(t, 10).tolist()
        away = {
            other: sum(abs(i - keys.index(k)) if k in keys else 10 for i, k in enumerate(own)) for other, keys in ranked.items()
        }
        best = min(sorted(away), key=away.get)
        found = profiles.predict(t)
        assert found[0] == best == lang
        assert np.isclose(found[1], 1 - away[best] / (10 * len(own)))


def test_learns_only_from_what_it_may(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang, 20), lang, "c", "c") for i, lang in enumerate(list(WORDS) * 20)]
    rows += [(1000 + i, text(rng, "aa", 20), "wrong", "c", "c") for i in range(20)]
    rows += [(2000, "the thing", None, "c", "c"), (2001, None, "aa", "c", "c"), (None, "the", "aa", "c", "c"), (0, rows[0][1], "aa", "c", "c")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("name", F.lit("clash"))
    profiles = learn(docs, F.col("doc_id") < 1000, rows=10)
    assert profiles.names == sorted(WORDS)
    found = add_language(docs, profiles)
    assert found.columns == ["doc_id", "text", "lang", "name", "lang_pred", "score"]
    got = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in found.collect()}
    assert all(got[i, t][0] == lang for i, t, lang, _, _ in rows if lang in WORDS and t and i is not None)
    assert got[2001, None] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in got.values())
    assert add_language(docs.where("false"), profiles).count() == 0


def test_no_profiles(spark):
    docs = spark.createDataFrame([(1, "the", "aa", "", ""), (2, " 12", "aa", "", "")], SCHEMA)
    profiles = learn(docs, F.lit(False))
    assert [r.lang_pred for r in add_language(docs, profiles).collect()] == ["und", "und"]


def test_held_out_accuracy(spark, small):
    folder = small.replace("0.001", "0.01")
    found = QUERIES["op5_language_id"](spark, folder).join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id")
    rows = found.where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.95
