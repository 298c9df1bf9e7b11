"""Vectorised hashing of the words of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are hashed at once.
CHUNK = 1 << 20

_U = np.uint64
LOWER = np.arange(256, dtype="u1")
LOWER[65:91] += 32
#: Word bytes of two kinds: all but the ASCII blanks; letters, with every byte of a non-ASCII character as one.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype="u8") * _U(0x9E3779B97F4A7C15))
BASE, INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


class Powers:
    """Powers of the hash's base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, "u8")

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK + 1024)
            self.up = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, BASE, "u8"))])
            self.down = np.concatenate([[_U(1)], np.cumprod(np.full(size - 1, INVERSE, "u8"))])
        return self.up, self.down


POWERS = Powers()


def _hash(text: bytes, word: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word: its polynomial from prefix sums, modulo 2^64, A-Z as a-z.

    With ``prefixes``, the words' first so many bytes are hashed too, where a word is longer; all hashes are in text order.
    """
    raw = np.frombuffer(text, "u1")
    inside = np.zeros(len(raw) + 2, "i1")
    inside[1:-1] = word[raw]
    edge = np.diff(inside)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.empty(0, "u8"), start
    up, down = POWERS.get(len(raw) + 1)
    total = np.zeros(len(raw) + 1, "u8")
    np.cumsum(BYTE_VALUES[LOWER[raw]] * up[: len(raw)], out=total[1:])
    whole = mix((total[end] - total[start]) * down[start])
    if not prefixes:
        return whole, start
    hashes, starts = [whole], [start]
    for n in prefixes:
        own = start[end - start > n]
        hashes.append(mix((total[own + n] - total[own]) * down[own] + _U(n)))
        starts.append(own)
    at = np.concatenate(starts)
    order = np.argsort(at, kind="stable")
    return np.concatenate(hashes)[order], at[order]


def word_hashes(text: bytes, word: np.ndarray, prefixes: tuple[int, ...] = ()) -> np.ndarray:
    """The hashes of a text's words in order; a long text is hashed in parts that end between words."""
    if len(text) <= CHUNK:
        return _hash(text, word, prefixes)[0]
    out, at, raw = [], 0, np.frombuffer(text, "u1")
    while at < len(text):
        to = min(at + CHUNK, len(text))
        while to < len(text):  # cut at the last byte between words, or further on within a giant word
            gaps = np.flatnonzero(~word[raw[at:to]])
            if len(gaps) and gaps[-1]:
                to = at + int(gaps[-1])
                break
            to = min(to + CHUNK, len(text))
        out.append(_hash(text[at:to], word, prefixes)[0])
        at = to
    return np.concatenate(out)


def words_by_text(texts: list[bytes], word: np.ndarray, prefixes: tuple[int, ...] = ()) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yields (first text, hashes, ends) for runs of texts: text first+i has the hashes up to ends[i], from ends[i-1]."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) < CHUNK):
            size += len(texts[j]) + 1
            j += 1
        if j == i + 1:
            h = word_hashes(texts[i], word, prefixes)
            yield i, h, np.array([len(h)])
        else:
            h, start = _hash(b" ".join(texts[i:j]), word, prefixes)
            ends = np.cumsum([len(t) + 1 for t in texts[i:j]])
            yield i, h, np.searchsorted(start, ends)
        i = j
