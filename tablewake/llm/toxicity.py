"""Toxicity by subword-bag embeddings averaged into a linear softmax (operator 2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from tablewake.llm.arrow import add_columns

BUCKETS = 1 << 18
DIM = 8
SUBWORDS = (3, 4, 5)
WINDOW = 3
STEPS = 80
#: Pooling over the windows of a text goes from their mean towards their maximum.
SHARP = (1.0, 12.0)
THRESHOLD = 0.7
#: The sample that is learned from: rows of each label, and characters in all.
SAMPLE_ROWS = 2_500
SAMPLE_CHARS = 5_000_000
#: A text's largest share of its label's characters, and the pieces a longer one is learned from.
TEXT_SHARE = 20
PIECES = 8
MEMO_TOKENS = 150_000
CHARS_AT_ONCE = 1_000_000
#: Characters of tokens that are cut into subwords at a time.
SUBWORD_CHARS = 200_000
#: Subwords whose sums are taken at a time.
SUBWORDS_AT_ONCE = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EDGE = " \t\r\n.,;:!?…\"'()[]{}<>«»„“”‘’%&$#*+-=/\\|~^`_"


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def subwords(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all character n-grams of each token and of the token as a whole, laid end to end; their numbers.

    Signs at a token's edges are left out; a token of mere signs has no subword. Tokens are worked on some at a time, a long
    one alone, which bounds the arrays in between.
    """
    parts, at = [], 0
    ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)))
    while at < len(some) or not parts:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SUBWORD_CHARS, "right")))
        parts.append(_subwords(some[at:upto]))
        at = upto
    return np.concatenate([grams for grams, _ in parts]), np.concatenate([counts for _, counts in parts])


def _subwords(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = [t.strip(_EDGE) for t in some]
    lengths = np.array([len(w) + 2 if w else 0 for w in words], np.int64)
    codes = np.frombuffer("".join([f"<{w}>" for w in words if w]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(codes))
    hashes, owners = [], []
    rolling = codes * _MIX
    for n in range(2, max(SUBWORDS) + 1):
        rolling = (rolling[:-1] + codes[n - 1 :]) * _MIX if len(rolling) else rolling
        if n in SUBWORDS:
            whole = at[: len(rolling)] + n <= ends[: len(rolling)]
            hashes.append(rolling[whole] + np.uint64(n))
            owners.append(owner[: len(rolling)][whole])
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    place = (at - np.repeat(first, lengths[lengths > 0])).astype(np.uint64) * _MIX
    place ^= place >> np.uint64(29)
    hashes.append(np.add.reduceat((place * _MIX) * (codes + np.uint64(1)), first) if len(first) else codes)
    owners.append(owner[first])
    owned = np.concatenate(owners)
    order = np.argsort(owned, kind="stable")
    mixed = np.concatenate(hashes)[order] * _MIX
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int32), np.bincount(owned, minlength=len(words))


class Windows:
    """The runs of ``window`` tokens of several texts laid end to end; a shorter text has one run, an empty one too."""

    def __init__(self, lengths: np.ndarray, window: int) -> None:
        number = np.maximum(1, lengths - window + 1)
        self.first = np.cumsum(number) - number
        self.of_text = np.repeat(np.arange(len(lengths)), number)
        start = np.cumsum(lengths) - lengths
        self.low = np.arange(number.sum()) + (start - self.first)[self.of_text]
        self.high = np.minimum(self.low + window, (start + lengths)[self.of_text])

    def sum(self, values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[self.high] - total[self.low]

    def pool(self, logits: np.ndarray, sharp: float) -> tuple[np.ndarray, np.ndarray]:
        """A logit for each text, and how much of it each window has."""
        pull = np.exp(sharp * (logits - np.maximum.reduceat(logits, self.first)[self.of_text]))
        pull /= np.add.reduceat(pull, self.first)[self.of_text]
        return np.add.reduceat(pull * logits, self.first), pull


def _probability(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))


class Model:
    """What the softmax makes of each subword's vector, and its bias: all that scoring needs."""

    def __init__(self, weights: np.ndarray, bias: float, window: int = WINDOW, sharp: float = SHARP[1]) -> None:
        self.weights, self.bias, self.window, self.sharp = weights.astype(np.float32), float(bias), window, sharp
        self.memo: dict[str, int] = {}
        self.sums, self.counts = np.zeros(0), np.zeros(0, np.int64)

    def __reduce__(self):
        return Model, (self.weights, self.bias, self.window, self.sharp)

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each whole text is toxic: the softmax over its windows' average embeddings, pooled."""
        out, some, size = [], [], 0
        for text in texts:
            some.append(text)
            size += len(text or "")
            if size > CHARS_AT_ONCE:
                out.append(self._score(some))
                some, size = [], 0
        if some:
            out.append(self._score(some))
        return np.concatenate(out) if out else np.zeros(0)

    def _score(self, texts: list[str | None]) -> np.ndarray:
        found = [tokens(t) for t in texts]
        if len(self.memo) > MEMO_TOKENS:
            self.memo, self.sums, self.counts = {}, np.zeros(0), np.zeros(0, np.int64)
        new = [t for t in set().union(*found) if t not in self.memo]
        if new:
            grams, counts = subwords(new)
            owner = np.repeat(np.arange(len(new)), counts)
            self.sums = np.concatenate([self.sums, np.bincount(owner, self.weights[grams], len(new))])
            self.counts = np.concatenate([self.counts, counts])
            self.memo.update(zip(new, range(len(self.memo), len(self.memo) + len(new))))
        lengths = np.array([len(f) for f in found], np.int64)
        flat = [t for f in found for t in f]
        at = np.fromiter(map(self.memo.__getitem__, flat), np.int64, len(flat))
        windows = Windows(lengths, self.window)
        logits = windows.sum(self.sums[at]) / np.maximum(windows.sum(self.counts[at]), 1) + self.bias
        return _probability(windows.pool(logits, self.sharp)[0])


def _summed(at: np.ndarray, values, size: int) -> np.ndarray:
    """Sums of ``values`` (of a slice) by place, some at a time, since counting copies all that it counts."""
    out = np.zeros(size)
    for low in range(0, len(at), SUBWORDS_AT_ONCE):
        some = slice(low, low + SUBWORDS_AT_ONCE)
        out += np.bincount(at[some], values(some), size)
    return out


def train(texts: list[str], labels: list[int], steps: int = STEPS, window: int = WINDOW, seed: int = 7) -> Model:
    """Subword vectors and the softmax over them, trained jointly by full-batch Adam.

    A window's embedding is the average of the vectors of all subwords in it. A text's logit is the
    average of its windows' logits, each weighing by how toxic it looks; the pooling sharpens as training
    goes on, so a few words decide about a long text. With one softmax over averages, the gradient of a subword's
    vector is its share of the errors times the softmax's weights, so errors are summed as plain
    numbers from windows to tokens to subwords, by counting.
    """
    positive = sum(labels)
    prior = float(np.log((positive + 0.5) / (len(labels) - positive + 0.5)))
    if not 0 < positive < len(labels):
        return Model(np.zeros(BUCKETS), prior, window)
    vocabulary: dict[str, int] = {}
    found = [[vocabulary.setdefault(t, len(vocabulary)) for t in tokens(text)] for text in texts]
    windows = Windows(np.array([len(f) for f in found], np.int64), window)
    at = np.fromiter((t for f in found for t in f), np.int32)
    flat, per_token = subwords(list(vocabulary))
    token_of = np.repeat(np.arange(len(per_token), dtype=np.int32), per_token)
    sizes = np.maximum(windows.sum(per_token[at]), 1)

    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.02, (BUCKETS, DIM)).astype(np.float32)
    softmax = rng.normal(0, 1.0, DIM).astype(np.float32)
    state = [softmax, vectors, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in state]
    truth = np.array(labels, np.float64)
    share = np.where(truth == 1, 0.5 / positive, 0.5 / (len(labels) - positive))
    for step in range(steps):
        softmax, vectors, bias = state
        sharp = SHARP[0] + (SHARP[1] - SHARP[0]) * min(1.0, step / (0.7 * steps))
        pulled = vectors @ softmax
        value = _summed(token_of, lambda some: pulled[flat[some]], len(per_token))
        logits = windows.sum(value[at]) / sizes + bias[0]
        pooled, pull = windows.pool(logits, sharp)
        error = (_probability(pooled) - truth) * share
        each = error[windows.of_text] * pull / sizes
        # A token's part is the sum over the windows that hold it.
        ends = np.bincount(windows.low, each, len(at) + 1) - np.bincount(windows.high, each, len(at) + 1)
        of_token = np.bincount(at, np.cumsum(ends)[:-1], len(per_token))
        part = _summed(flat, lambda some: of_token[token_of[some]], BUCKETS).astype(np.float32)
        slopes = [vectors.T @ part, part[:, None] * softmax[None, :], np.array([error.sum()], np.float32)]
        for k, (p, g, (m, v)) in enumerate(zip(state, slopes, moments)):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            rate = 0.05 * np.sqrt(1 - 0.99 ** (step + 1)) / (1 - 0.9 ** (step + 1))
            state[k] = p - rate * m / (np.sqrt(v) + 1e-7)
    softmax, vectors, bias = state
    return Model(vectors @ softmax, bias[0], window)


def spread(text: Column, chars: int) -> Column:
    """``text``; of one longer than ``chars``, pieces that lie evenly from its start to its end, ``chars`` in all at most."""
    size = max(1, (chars - PIECES + 1) // PIECES)
    step = (F.length(text) - size) / (PIECES - 1)
    pieces = [text.substr((F.round(step * k) + 1).cast("int"), F.lit(size)) for k in range(PIECES)]
    return F.when(F.length(text) > chars, F.concat_ws(" ", *pieces)).otherwise(text)


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, chars: int) -> DataFrame:
    """Texts and labels to learn from: at most ``rows`` of each label in the order of a hash of the id, and at
    most ``chars`` characters of each.

    Only labels of ``docs`` with a text count. No text takes more than its share of the characters, so a
    long one, which is learned from in pieces, leaves room for the others. Other columns of ``docs`` are ignored.
    """
    docs = docs.select("doc_id", "text")
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.join(docs.where("text is not null").select("doc_id").distinct(), "doc_id")
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit("sample")), "doc_id"]
    picked = None
    for label in (0, 1):
        some = known.where(F.col("toxic") == label).orderBy(*order).limit(rows)
        picked = some if picked is None else picked.unionByName(some)
    found = docs.join(F.broadcast(picked), "doc_id").where("text is not null")
    found = found.withColumn("text", spread(F.col("text"), chars // TEXT_SHARE)).dropDuplicates(["doc_id"])
    running = Window.partitionBy("toxic").orderBy(*order)
    so_far = F.sum(F.length("text")).over(running)
    return found.withColumn("so_far", so_far).where(F.col("so_far") <= chars).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS, steps: int = STEPS) -> Model:
    """A model from the labelled rows of ``docs``; it is trained in one task, on a sample of bounded size."""
    sample = labelled_sample(docs, labels, rows, chars // 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted(row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        model = train([t for _, t, _ in seen], [y for _, _, y in seen], steps)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"]
        )

    learned = sample.coalesce(1).mapInArrow(run, "weights binary, bias double").first()
    return Model(np.frombuffer(learned[0], np.float32), learned[1]) if learned else train([], [])


def add_toxicity(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is at least ``threshold``) of each whole text.

    Only the text enters the score. Null and empty texts, and texts without a word, get the score of no
    evidence: the bias alone. Columns named like the added ones are replaced; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        scorer = shared.value
        scores = scorer.score(texts.to_pylist())
        return [pa.array(scores), pa.array((scores >= threshold).astype(np.int32))]

    return add_columns(docs, ["text"], [StructField("score", DoubleType()), StructField("predicted", IntegerType())], work)
