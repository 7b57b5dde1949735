"""Byte-level BPE over whole texts with a bounded table of pieces already encoded.

The pre-tokenizer never joins a space and the character before it, unless white space stands on both sides. So a text
without such runs is the sequence of its pieces cut before each space, and a piece always has the same ids. A task keeps
the ids of the pieces it has met and asks the library for the others only; any other text goes to the library whole.
"""
from __future__ import annotations

import hashlib
import os
import re

import numpy as np

#: Pieces a task remembers before it starts anew; bounds the memory of a Python worker.
PIECES = 800_000
#: A space next to other white space: the pieces of such a text depend on each other.
RUN = re.compile(r"\s | \s")

_loaded: dict[tuple[str, int], "PieceEncoder"] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def version(path: str) -> str:
    """Digest of the tokenizer's file and of the library that reads it."""
    import tokenizers

    digest = hashlib.sha256(f"tokenizers {tokenizers.__version__}\n".encode())
    with open(path, "rb") as f:
        digest.update(f.read())
    return digest.hexdigest()


#: Characters of new pieces in one call of the library, whose fixed cost a call is many pieces' worth.
JOINED = 50_000


class PieceEncoder:
    """Ids of texts as the tokenizers library gives them, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, limit: int = PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.limit = Tokenizer.from_file(path), limit
        self.first: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        # A space stands at the start of a piece only, so a token that begins with one begins a piece.
        space = self.library.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that follow a space each."""
        out: list[bytes] = []
        at = 0
        while at < len(pieces):
            size, end = 0, at
            while end < len(pieces) and (size < JOINED or end == at):
                size += len(pieces[end]) + 1
                end += 1
            ids = np.frombuffer(self.whole([" " + " ".join(pieces[at:end])])[0], "<u4")
            cuts = np.flatnonzero(self.opens[ids])
            assert len(cuts) == end - at, "a piece without its own first token"
            raw, ends = ids.tobytes(), [*(cuts[1:] * 4).tolist(), len(ids) * 4]
            out += [raw[a:b] for a, b in zip((cuts * 4).tolist(), ends)]
            at = end
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if RUN.search(t) else t.split(" ") for t in texts]
        heads = {c[0] for c in cut if c} - self.first.keys()
        tails = set().union(*(c[1:] for c in cut if c)) - self.spaced.keys()
        if len(self.first) + len(self.spaced) + len(heads) + len(tails) > self.limit:
            self.first, self.spaced = {}, {}
            heads, tails = {c[0] for c in cut if c}, set().union(*(c[1:] for c in cut if c))
        heads, tails = list(heads), list(tails)
        self.first.update(zip(heads, self.whole(heads)))
        # An empty piece is the space at the end of a text.
        empty = [""] if "" in tails else []
        tails = [t for t in tails if t]
        self.spaced.update(zip([*tails, *empty], [*self.pieces(tails), *self.whole([" "] * len(empty))]))
        out, get = [], self.spaced.__getitem__
        for text, pieces in zip(texts, cut):
            if pieces is None:
                out += self.whole([text])
            else:
                out.append(self.first[pieces[0]] + b"".join(map(get, pieces[1:])))
        return out


def encoder(path: str) -> PieceEncoder:
    """One per worker process and file."""
    key = (path, PIECES)
    if key not in _loaded:
        _loaded[key] = PieceEncoder(path)
    return _loaded[key]
