import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tablewake.llm import fill_in_middle as M

SCHEMA = "doc_id long, text string, output string, form string, n long, h0 long"


def plain(doc, text, rate=100, suffix_first=50, seed="7"):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(mark in text for mark in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc, n, "plain", None, None, text)
    if h[3] % 100 < suffix_first:
        return (doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    rng = random.Random(4)
    out = ["", None, "\n", "\n\n\n", "one", "a\n", "\na", "é\n日本\n🎉", "x<P>y\nz", "<S>", "a<M>", "<P\n>", "<\nP>", "a<\nb<S\n", "\r\n\x85 x\ny"]
    out += ["".join(rng.choices("ab<PSM>\n\n é🎉", k=rng.randrange(60))) for _ in range(400)]
    return out + ["line of a long text\n" * 50_000, "z" * 400_000]


@pytest.mark.parametrize("rate,suffix_first,step", [(100, 50, 1 << 24), (60, 10, 64)])
def test_every_text_as_by_definition(spark, rate, suffix_first, step, monkeypatch):
    monkeypatch.setattr(M, "STEP_BYTES", step)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "a\nb\nc"), (None, None), (3, "again\nand\nagain"), (3, "again\nand\nagain")]
    docs = spark.createDataFrame([(i, t, "c", "c", 1, 2) for i, t in rows], SCHEMA).repartition(3)
    made = M.fill_in_middle(docs, rate=rate, suffix_first=suffix_first)
    found = made.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    want = sorted((plain(i, t, rate, suffix_first) for i, t in rows), key=str)
    assert sorted((tuple(r)[:6] for r in found), key=str) == want
    back = sorted(((r.doc_id, r.back) for r in found), key=str)
    assert back == sorted(((i, t or "") for i, t in rows), key=str)


def test_all_forms_occur_and_seeds_differ(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\nd\n").alias("text"))
    forms = {r.form for r in M.fill_in_middle(docs, rate=50).collect()}
    assert forms == {"plain", "psm", "spm"}
    one, other = (M.fill_in_middle(docs, seed=s).select("output").distinct().count() for s in ("7", "8"))
    assert one > 10 and other > 10


def test_empty_table(spark):
    assert M.fill_in_middle(spark.createDataFrame([], SCHEMA)).count() == 0
