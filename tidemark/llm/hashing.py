"""64-bit hashes of byte strings and words, for arrays at a time. All arithmetic is modulo 2 ** 64."""

from __future__ import annotations

import numpy as np

U = np.uint64
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def spread(n: int, seed: int) -> np.ndarray:
    """n odd numbers, by a counter and a mixer."""
    x = (np.arange(1, n + 1, dtype=U) + U(seed)) * U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return (x ^ (x >> U(31))) | U(1)


BYTE, STEP = spread(256, 11), spread(16, 900)
_BASE = int(spread(1, 500)[0])
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray, k: int = 0) -> np.ndarray:
    """One of several good mixers of 64 bits."""
    x = (x ^ (x >> U(32))) * STEP[k]
    x = (x ^ (x >> U(29))) * STEP[k + 1]
    return x ^ (x >> U(32))


def six_bytes(x: np.ndarray) -> bytes:
    """The low 48 bits of each number: low halves first, then the rest."""
    return (x & U(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> U(32)).astype("<u2").tobytes()


def from_six(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, "<u4", n).astype(U) | np.frombuffer(data, "<u2", n, 4 * n).astype(U) << U(32)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of an odd number and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, U), np.full(n, x, U)])) for x in (_BASE, pow(_BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data))
    return np.concatenate([np.zeros(1, U), np.cumsum(BYTE[data] * up[: len(data)])])


def spans(sums: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Hash of each byte range, from prefix_sums of the bytes."""
    return mixed((sums[stops] - sums[begins]) * powers(len(sums))[1][begins] + (stops - begins).astype(U))


def hashed_words(texts: list[str | None], gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all words of texts, with A-Z in lower case: hash, number of the text, first byte and end in that text.

    Words are runs of bytes that gap (256 booleans, true for space) leaves.
    """
    raw = [t.encode() if isinstance(t, str) else b"" for t in texts]
    data = LOWER[np.frombuffer(b" ".join(raw) + b" ", np.uint8)]
    text_ends = np.cumsum([len(r) + 1 for r in raw])
    space = gap[data]
    inside = np.concatenate([[False], ~space])
    begins, stops = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(space & inside[:-1])
    text = np.searchsorted(text_ends, begins, side="right")
    offset = np.concatenate([[0], text_ends[:-1]])[text]
    return spans(prefix_sums(data), begins, stops), text, begins - offset, stops - offset
