import random

import numpy as np
import public_tokenizers as public
from tokenizers import Tokenizer

from tablewake.llm.token_counts import attribute, section_tokens

FILE = public.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, section string, start string"


def plain(spans, sections):
    out = []
    for a, b in spans:
        common = [max(0, min(b, e) - max(a, s)) for s, e in sections]
        best = max(range(len(common)), key=lambda k: (common[k], -k)) if common and max(common) else -1
        out.append((best, (common[best] if best >= 0 else 0) < b - a))
    return out


def test_most_characters_decide():
    rng = random.Random(1)
    for _ in range(300):
        cuts = sorted(rng.sample(range(60), rng.randrange(0, 12) * 2))
        sections = list(zip(cuts[::2], cuts[1::2]))
        if sections and rng.random() < 0.3:
            sections.insert(1, (sections[0][1], sections[0][1]))
        edges = sorted({0, 60, *rng.sample(range(60), 15)})
        spans = list(zip(edges, edges[1:])) + [(5, 5), (5, 6), (5, 6)]
        spans.sort()
        s, e = (np.array([x[k] for x in sections], np.int64) for k in (0, 1))
        of, crossing = attribute(*(np.array([x[k] for x in spans]) for k in (0, 1)), s, e)
        assert list(zip(of, crossing)) == [(k, bool(c)) for k, c in plain(spans, sections)]


def test_counts_of_lines_add_up(spark, small):
    tokenizer = Tokenizer.from_file(FILE)
    tokenizer.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").limit(40).collect()]
    texts += ["", "\n", "a\n\n\nb", " x\n  y é\n日本🎉\n", "one", "w " * 40_000, None]
    docs = [(i, t, "clash", "c") for i, t in enumerate(texts)] + [(None, "a\nb", "c", "c"), (0, "q", "c", "c")]
    found = {}
    for r in section_tokens(spark.createDataFrame(docs, SCHEMA), FILE).collect():
        found.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    for i, t, _, _ in docs:
        lines, at, sections = (t or "").split("\n"), 0, []
        for line in lines:
            sections.append((at, at + len(line)))
            at += len(line) + 1
        spans = tokenizer.encode(t or "", add_special_tokens=False).offsets
        want = plain(spans, sections)
        rows = found[i, len(spans)]
        assert {r.section: (r.start, r.end, r.n_tokens, r.n_crossing) for r in rows if r.section >= 0} == {
            k: (*s, sum(w[0] == k for w in want), sum(w == (k, True) for w in want)) for k, s in enumerate(sections)
        }
        assert sum(r.n_tokens for r in rows) == len(spans)
    assert section_tokens(spark.createDataFrame([], SCHEMA), FILE).count() == 0


def test_tokens_across_given_sections(spark):
    cut = lambda text: (np.array([0, 3], np.int64), np.array([3, len(text)], np.int64))
    rows = section_tokens(spark.createDataFrame([(1, "the quick", "", "")], SCHEMA), FILE, cut).collect()
    assert sum(r.n_tokens for r in rows) == 2
