"""Byte-level BPE ids of whole texts; for spans, with a bounded memo of the pieces that texts share."""

from __future__ import annotations

import base64
import json
import re
from itertools import accumulate, chain, pairwise

import numpy as np

#: No token of the vocabulary's splitting pattern holds a space or line feed after any other character, nor a full
#: stop or comma after a letter or digit. So a text may be cut there. Other white space stays inside its piece.
_PIECES = re.compile(r"[ \n]*[^ \n.,]+|[.,][^ \n]*|[ \n]+")
#: Texts where such a cut could part what the pattern keeps together: other white space, and a full stop or comma
#: after a space or a sign. They are encoded whole.
_UNSAFE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85\u180e\u200b\ufeff]|(?:[^\w.,]|_)[.,]")
MEMO_PIECES = 400_000
LONG_PIECE = 64


def pieces(text: str) -> list[str]:
    """A text cut where no token can reach across."""
    return [text] if _UNSAFE.search(text) else _PIECES.findall(text)


class Memo:
    """Packed tokens of pieces; at most ``room`` short ones are kept, the rest are encoded whenever they occur."""

    def __init__(self, encode, room: int = MEMO_PIECES) -> None:
        self.encode, self.kept, self.room = encode, {}, room

    def look_up(self, wanted: set[str]) -> dict[str, bytes]:
        missing = [p for p in wanted if p not in self.kept]
        if not missing:
            return self.kept
        made = dict(zip(missing, self.encode(missing)))
        # A plain table of what is wanted: texts repeat their pieces, and looking one up must cost no call.
        known = {p: self.kept[p] for p in wanted if p in self.kept} | made
        if len(self.kept) + len(made) <= self.room:
            self.kept.update((p, ids) for p, ids in made.items() if len(p) <= LONG_PIECE)
        return known


def added_tokens(path: str) -> dict[str, int]:
    """The strings that a `tokenizers` vocabulary file takes out of a text before anything else, with their ids."""
    with open(path, encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class IdEncoder:
    """Ids of a byte-level BPE given as ranks, the same ids that `tokenizers` gives for the vocabulary file.

    ``added``: the items of the file's `added_tokens`. Texts are encoded whole, and nothing is kept from text to text.
    """

    def __init__(self, ranks_path: str, pattern: str, added: tuple[tuple[str, int], ...] = ()) -> None:
        import tiktoken

        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.bpe = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(added))

    def encode(self, text: str) -> np.ndarray:
        """The text's ids as unsigned 32-bit numbers."""
        return self.bpe.encode_to_numpy(text, allowed_special="all", disallowed_special=()).astype("<u4", copy=False)


class SpanEncoder:
    """Ids of a `tokenizers` vocabulary file with the characters that each token covers.

    Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def packed(some: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch(some, add_special_tokens=False)
            # One array for all pieces, cut as bytes: an array for each costs more than its tokens.
            ids = [e.ids for e in found]
            flat = np.empty((sum(map(len, ids)), 3), "<u4")
            flat[:, 0] = np.fromiter(chain.from_iterable(ids), "<u4", len(flat))
            offsets = chain.from_iterable(chain.from_iterable(e.offsets for e in found))
            flat[:, 1:] = np.fromiter(offsets, "<u4", 2 * len(flat)).reshape(-1, 2)
            whole = flat.tobytes()
            ends = [0, *accumulate(flat.itemsize * 3 * len(i) for i in ids)]
            return [whole[low:high] for low, high in pairwise(ends)]

        self.memo = Memo(packed, MEMO_PIECES // 2)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids, first characters and ends of the tokens of each text."""
        cut = [pieces(t) for t in texts]
        known = self.memo.look_up(set().union(*cut))
        out = []
        for some in cut:
            found = [known[p] for p in some]
            flat = np.frombuffer(b"".join(found), "<u4").reshape(-1, 3).astype(np.int64)
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            tokens = np.fromiter(map(len, found), np.int64, len(some)) // 12
            base = np.repeat(np.cumsum(lengths) - lengths, tokens)
            out.append((flat[:, 0], base + flat[:, 1], base + flat[:, 2]))
        return out


_ENCODERS: dict[tuple, object] = {}


def encoder(kind: type, *args):
    """A worker's encoder, kept from task to task."""
    if (kind, args) not in _ENCODERS:
        _ENCODERS[kind, args] = kind(*args)
    return _ENCODERS[kind, args]
