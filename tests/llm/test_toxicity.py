import random

import numpy as np
from pyspark.sql import functions as F

from tablewake.llm import toxicity
from tablewake.llm.queries import QUERIES
from tablewake.llm.toxicity import Model, add_toxicity, fit, subwords, train

SCHEMA = "doc_id long, text string, score string, predicted string, toxic string"
CLEAN = ["tion", "the", "ander", "reat", "stone", "hand", "oner", "thing", "ble", "sher"]
RUDE = ["stupid", "moron", "worthless", "clown"]


def texts(n, seed):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = ["".join(rng.choices(CLEAN, k=2)) for _ in range(rng.choice((4, 30, 300)))]
        toxic = i % 3 == 0
        for _ in range(2 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(RUDE))
        out.append((i, " ".join(words), int(toxic)))
    return out


def plain_score(model, text):
    """One token and one window at a time."""
    words = (text or "").lower().split()
    bags = [words[i : i + model.window] for i in range(max(1, len(words) - model.window + 1))]
    logits = []
    for bag in bags:
        grams = [g for w in bag for g in subwords([w])[0]]
        logits.append(sum(float(model.weights[g]) for g in grams) / max(1, len(grams)) + model.bias)
    pull = [np.exp(model.sharp * (z - max(logits))) for z in logits]
    z = sum(p * x for p, x in zip(pull, logits)) / sum(pull)
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def test_learns_rude_words_and_their_misspellings():
    seen = texts(300, 1)
    model = train([t for _, t, _ in seen], [y for _, _, y in seen])
    new = texts(300, 2)
    predicted = model.score([t for _, t, _ in new]) >= 0.7
    truth = np.array([y for _, _, y in new]) == 1
    assert predicted[truth].mean() > 0.97 and predicted[~truth].mean() < 0.02
    assert (model.score(["the stupidd onerhand", "a WORTHLES, moronn"]) > 0.7).all()
    odd = [None, "", "  ", "!!! ...", "x" * 200_000, "the stupid", "moron", "Stupid! " * 5000, *[t for _, t, _ in new[:30]]]
    assert np.allclose(model.score(odd), [plain_score(model, t) for t in odd])
    assert len(set(model.score([None, "", "...!"]))) == 1


def test_memo_may_run_over(monkeypatch):
    monkeypatch.setattr(toxicity, "MEMO_TOKENS", 5)
    monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", 50)
    model = Model(np.linspace(-1, 1, toxicity.BUCKETS), 0.1)
    some = [t for _, t, _ in texts(30, 3)]
    assert np.allclose(model.score(some), [plain_score(model, t) for t in some])


def test_subwords_in_parts_are_the_same(monkeypatch):
    rng = random.Random(12)
    some = ["".join(rng.choices("abcé日.,!", k=rng.randrange(12))) for _ in range(500)] + ["x" * 3000, "", "..."]
    whole = subwords(some)
    monkeypatch.setattr(toxicity, "SUBWORD_CHARS", 40)
    parts = subwords(some)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts)) and len(parts[1]) == len(some)
    assert [len(x) for x in subwords([])] == [0, 0]


def test_one_label_or_none():
    assert (train(["a b"], [0]).score(["a", None]) < 0.5).all()
    assert (train([], []).score(["a"]) == 0.5).all()


def test_sample_has_no_unlabelled_and_no_more_than_its_bounds(spark):
    docs = spark.createDataFrame([(i, t, "", "", "9") for i, t, _ in texts(60, 4)] + [(None, "x", "", "", ""), (3, None, "", "", "")], SCHEMA)
    labels = spark.createDataFrame(
        [(i, i % 2, i % 3 == 0) for i in range(40)] + [(1, 0, None), (99, 0, True)], "doc_id long, quality int, toxic boolean"
    ).withColumn("toxic", F.col("toxic").cast("int"))
    found = toxicity.labelled_sample(docs, labels, 5, 10_000_000).collect()
    assert sorted(r.toxic for r in found) == [0] * 5 + [1] * 5
    few = toxicity.labelled_sample(docs, labels, 40, 500).groupBy("toxic").agg(F.sum(F.length("text")).alias("n"))
    assert all(r.n <= 500 for r in few.collect())


def test_a_long_text_leaves_the_others_in_the_sample(spark):
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample"))
    ids = [r.doc_id for r in spark.range(40).select(F.col("id").alias("doc_id")).orderBy(order).collect()]
    rng = random.Random(6)
    rows = []
    for k, i in enumerate(ids):
        words = ["".join(rng.choices(CLEAN, k=2)) for _ in range(30)] + ["stupid moron"] * (k % 2)
        # The first of the toxic ones, and one further on.
        rows.append((i, " ".join(words) if k not in (1, 21) else "Stupid moron! " * 220_000, "", "", ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 0, k % 2) for k, i in enumerate(ids)], "doc_id long, quality int, toxic int")
    half = toxicity.SAMPLE_CHARS // 2
    assert max(len(r[1]) for r in rows) > half
    found = {r.doc_id: r for r in toxicity.labelled_sample(docs, labels, 100, half).collect()}
    assert sorted(found) == sorted(ids)
    assert all(found[i].text == t for i, t, *_ in rows if len(t) < 10_000)
    assert sum(len(r.text) for r in found.values() if r.toxic) <= half
    model = fit(docs, labels, steps=40)
    assert model.weights.any() and model.score(["you stupid moron"])[0] > 0.7 > model.score([rows[0][1]])[0]


def test_pieces_of_a_long_text_are_spread_over_it(spark):
    df = spark.createDataFrame([("".join(chr(0x4E00 + i) for i in range(1000)),), ("short",), (None,)], "text string")
    long, short, none = [r[0] for r in df.select(toxicity.spread(F.col("text"), 100)).collect()]
    pieces = long.split(" ")
    assert len(long) <= 100 and len(pieces) == toxicity.PIECES and (short, none) == ("short", None)
    starts = [ord(p[0]) - 0x4E00 for p in pieces]
    assert starts[0] == 0 and ord(pieces[-1][-1]) - 0x4E00 == 999 and max(np.diff(starts)) - min(np.diff(starts)) <= 1


def test_labels_of_other_documents_take_no_room(spark):
    docs = spark.createDataFrame([(i, "a b", "", "", "") for i in range(0, 400, 20)] + [(1, None, "", "", "")], SCHEMA)
    labels = spark.createDataFrame([(i, 0, i // 20 % 2) for i in range(400)], "doc_id long, quality int, toxic int")
    found = toxicity.labelled_sample(docs, labels, 10, 10_000).collect()
    assert sorted(r.toxic for r in found) == [0] * 10 + [1] * 10


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a", "", "", "")], SCHEMA)
    model = fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert [(r.score, r.predicted) for r in add_toxicity(docs, model).collect()] == [(0.5, 0)]


def test_columns_and_empty_table(spark):
    rows = [(i, t, "clash", "clash", "x") for i, t, _ in texts(20, 5)] + [(None, None, "c", "c", "x"), (0, "", "c", "c", "x")]
    labels = spark.createDataFrame([(i, 0, int(i % 3 == 0)) for i in range(20)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit(docs, labels, steps=20)
    found = add_toxicity(docs, model)
    assert found.columns == ["doc_id", "text", "toxic", "score", "predicted"]
    assert found.count() == len(rows)
    assert add_toxicity(docs.where("false"), model).count() == 0


def test_held_out_accuracy(spark, small):
    folder = small.replace("0.001", "0.01")
    found = QUERIES["op2_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id")
    rows = found.where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) > 0.9
