"""Token ids of whole texts by the tokenizers library, with what was met before remembered.

A byte-level BPE vocabulary splits a text by a fixed pattern and merges inside each piece. Under that pattern a
piece always begins at a space that a non-space follows, so texts may be cut there: equal chunks have
equal ids, and only chunks not seen yet reach the library. Texts that hold the content of an added token, such as
an end-of-text mark, go to the library whole, as it gives such content an id of its own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"
#: Chunks, and pieces of chunks, that a worker remembers in each of two generations: some 250 MB in all.
REMEMBERED = 600_000

#: Up to here all versions of the character tables agree on letters and digits.
SETTLED = "ɐ"

_CUT = re.compile(r" (?=\S)")


def _letters_of_bytes() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in plain]
    return {b: b if b in plain else 256 + rest.index(b) for b in range(256)}


class _Memory(dict):
    """Remembers what found() gives: up to REMEMBERED new entries, and those before them that are asked for again."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.old = self.copy()
            self.clear()
        ids = self.old.get(key)
        if ids is None:
            ids = self.found(key)
        self[key] = ids
        return ids


class _Pieces(_Memory):
    """Ids of a piece of the pattern, as bytes."""

    def __init__(self, model, kind: str):
        super().__init__()
        self.model, self.kind, self.letters = model, kind, _letters_of_bytes()

    def found(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            letters = piece.replace(" ", "Ġ")
        else:
            letters = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.model.tokenize(letters)]).tobytes()


class _Uneven(Exception):
    """Cut at every space, a text has a chunk that is empty or begins with white space."""


class _Chunks(_Memory):
    """Ids of a chunk and the space before it, as bytes. A word, and a word before a mark, need no pattern."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder

    def found(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Uneven
        if not chunk.isascii() and max(chunk) >= SETTLED:
            return self.encoder.whole(" " + chunk)
        if chunk.isalpha():
            return self.encoder.pieces.found(" " + chunk)
        first, line, rest = chunk.partition("\n")  # between two letters or marks a line feed is a piece of its own
        if line and rest and not first[-1].isspace() and not rest[0].isspace():
            return self[first] + self.encoder.pieces[line] + self.encoder.chunk(rest)
        if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha():
            return self[chunk[:-1]] + self.encoder.pieces[chunk[-1]]
        return self.encoder.chunk(" " + chunk)


class Encoder:
    """Texts to ids, little-endian and of 2 bytes each where the vocabulary allows, else 4."""

    def __init__(self, vocabulary: str = VOCABULARY):
        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary) if "/" not in vocabulary else vocabulary)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 65536 else "<u4")
        self.cuts = "ByteLevel" in type(self.tokenizer.pre_tokenizer).__name__ and self.tokenizer.normalizer is None and not self.tokenizer.pre_tokenizer.add_prefix_space
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = _Pieces(self.tokenizer.model, "H" if self.dtype.itemsize == 2 else "I")
        self.chunks = _Chunks(self)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) >= SETTLED:
            return self.whole(chunk)
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(chunk)))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text; none for null and empty texts."""
        if not text:
            return b""
        if not self.cuts or any(a in text for a in self.added):
            return self.whole(text)
        first, *rest = text.split(" ")
        try:
            return (self.chunk(first) if first else b"") + b"".join(map(self.chunks.__getitem__, rest))
        except _Uneven:
            first, *rest = _CUT.split(text)
            return (self.chunk(first) if first else b"") + b"".join(map(self.chunks.__getitem__, rest))

    def encoded(self, texts: Sequence[str | None], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts, each with the id end after it, one text after the other; and where each text's end."""
        last = np.array([end], self.dtype).tobytes()
        found = [self.encode(t) + last for t in texts]
        return np.frombuffer(b"".join(found), self.dtype), np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) // self.dtype.itemsize)


@lru_cache(2)
def encoder(vocabulary: str = VOCABULARY) -> Encoder:
    """One for each Python worker."""
    return Encoder(vocabulary)
