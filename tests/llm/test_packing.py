import random
import zlib

import numpy as np
import public_tokenizers as public
import pytest
from tokenizers import Tokenizer

from tablewake.llm.bpe import IdEncoder, Memo, SpanEncoder, added_tokens
from tablewake.llm.packing import NEARLY_FULL, Packer, pack

RANKS, FILE = public.path("byte_bpe_50k.tiktoken"), public.path("byte_bpe_50k.json")
ADDED = added_tokens(FILE)
SCHEMA = "doc_id long, text string, sequence_id string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def span_tokenizer():
    made = Tokenizer.from_file(FILE)
    made.encode_special_tokens = True
    return made


ODD = ["", " ", "a  b\tc \n x\n\n y'll  \n", "<|endoftext|> hi", "x <|endoftext|> y", "<|endoftext|><|endoftext|>.", "<|endoftext",  "x .y ,, z... a_.b $.5 3.14,", "é́ 日本語 🎉x", "\n.\n", "word " * 3000]


@pytest.fixture(scope="module")
def texts(spark, small):
    return ODD + [r.text for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()]


def test_ids_are_those_of_the_vocabulary_file(texts, tokenizer):
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    bpe = IdEncoder(RANKS, public.PATTERN, tuple(ADDED.items()))
    assert [list(bpe.encode(t)) for t in texts] == want


def test_random_signs_and_spaces(tokenizer):
    rng, bpe = random.Random(3), IdEncoder(RANKS, public.PATTERN, tuple(ADDED.items()))
    some = ["".join(rng.choices([*"ab é1.,_-'s \n\t 日!", "<|endoftext|>"], k=rng.randrange(30))) for _ in range(3000)]
    assert [list(bpe.encode(t)) for t in some] == [e.ids for e in tokenizer.encode_batch(some, add_special_tokens=False)]


def test_spans_are_those_of_the_vocabulary_file(texts, span_tokenizer):
    found = SpanEncoder(FILE).encode(texts)
    for (ids, starts, ends), e in zip(found, span_tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert list(ids) == e.ids
        assert list(zip(starts, ends)) == e.offsets


def test_memo_beyond_its_room():
    memo = Memo(lambda some: [p.upper() for p in some], room=3)
    for wanted in ({"a", "b"}, {"b", "c", "d"}, {"a", "x" * 100}):
        known = memo.look_up(wanted)
        assert all(known[p] == p.upper() for p in wanted)
    assert len(memo.kept) <= 3


def test_looking_up_a_known_piece_is_no_call():
    memo = Memo(lambda some: [p.upper() for p in some])
    memo.look_up({"a"})
    assert type(memo.look_up({"a", "b"})) is dict


def plain_best(levels, size, window):
    """The level that leaves the least sum of squares, by trying each."""
    best = None
    for h in range(window - size, -1, -1):
        if h and not levels[h]:
            continue
        after = levels.copy()
        if h:
            after[h] -= 1
        if h + size < window:
            after[h + size] += 1
        total = sum(n * n for n in after[1:])
        if best is None or total < best[0]:
            best = (total, h)
    return best[1]


def test_level_is_the_one_with_the_least_squares():
    rng, packer = random.Random(2), Packer(24, 10_000)
    for i in range(800):
        size = rng.randrange(1, 24)
        want = plain_best([int(n) for n in packer.level], size, 24)
        assert packer._best(size) == want
        packer.place((i, 0, np.zeros(size, "<u4")))
        assert all(packer.level[h] == len(packer.at[h]) for h in range(1, 24))


@pytest.mark.parametrize("open_windows", [2048, 3])
def test_every_token_once_and_little_padding(spark, texts, tokenizer, open_windows):
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, None, "c"), (5_000, None, "c"), (5_001, texts[3], None)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    found = pack(docs, RANKS, public.PATTERN, open_windows=open_windows, added=ADDED).collect()
    windows, pieces = {}, {}
    for r in found:
        windows.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for window in windows.values():
        at = 0
        for r in sorted(window, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    padded = [w for w in windows.values() if sum(r.length for r in w) < NEARLY_FULL * 2048]
    assert len(padded) <= 2
    for i, t, _ in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], SCHEMA), RANKS, public.PATTERN).count() == 0
