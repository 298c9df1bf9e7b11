"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

The vocabulary file's path is a parameter. A text is cut at special tokens, then into words by the byte-level pattern. In each
word, a segment tree holds the merge rank of every pair of neighbours; its root is the lowest rank, the leftmost where ranks
tie. Merging that pair changes three leaves, each in logarithmic time, until the root holds no mergeable pair. The words of a lot of
texts that were not met before are merged together, a tree for each in one array; long ones one by one.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import python_ready

#: Fixed value: the byte-level pattern of this vocabulary's family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The bytes that a worker's memory of words and their ids may take; then it is emptied. Each word counts its own size and what
#: the two objects and their place in the dictionary take.
MEMO_SIZE = 192 << 20
MEMO_ENTRY = 200
#: Longer words aren't remembered and are merged one by one.
MEMO_BYTES = 64
#: So many words are looked up at once, and so many trees are in one array.
LOT = 1 << 16
TREES = 1 << 12
NONE = 1 << 62


def byte_chars() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [out[b] for b in range(256)]


def vocabulary(path: str) -> tuple[dict, list[bytes], dict[str, int]]:
    """The ``tokenizers`` JSON of a byte-level BPE; the bytes of each id; the special tokens and their ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab: dict[str, int] = spec["model"]["vocab"]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    back = {c: b for b, c in enumerate(byte_chars())}
    out = [b""] * (1 + max([*vocab.values(), *special.values()]))
    for token, i in vocab.items():
        out[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    for token, i in special.items():
        out[i] = token.encode()
    return spec, out, special


class Bpe:
    """Encodes and decodes by a byte-level BPE without normaliser."""

    def __init__(self, path: str) -> None:
        spec, self.bytes_of, self.special = vocabulary(path)
        vocab: dict[str, int] = spec["model"]["vocab"]
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        # (left id, right id) -> rank, and rank -> merged id; a key of one int hashes faster than a tuple
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a] << 32 | vocab[b]] = rank
            self.merged.append(vocab[a + b])
        self.words = regex.compile(PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # the same ranks by sorted key, the last one beyond all, and of two bytes; ``edge`` is the id of what is no token
        self.edge = len(self.bytes_of)
        keys = np.array([(k >> 32) * (self.edge + 1) + (k & 0xFFFFFFFF) for k in self.ranks], "i8")
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo("i8").max)
        self.key_ranks = np.append(np.array(list(self.ranks.values()), "i8")[order], NONE)
        self.merged_ids = np.array(self.merged, "i8")
        self.first_ids = np.array(self.first, "i8")
        self.byte_ranks = self.rank_of(self.first_ids[:, None], self.first_ids[None, :])
        # No word holds a special token, as texts are cut at them, so both are looked up in one dictionary.
        self.fixed = {token: struct.pack("<I", i) for token, i in self.special.items()}
        self.memo: dict[str, bytes] = dict(self.fixed)
        self.held = 0

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The merge ranks of pairs of ids, ``NONE`` where there is none."""
        key = a * (self.edge + 1) + b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.key_ranks[at], NONE)

    def merge(self, word: bytes) -> list[int]:
        """The ids of one word."""
        first = self.first
        ids = [first[b] for b in word]
        n = len(ids) - 1  # leaves: the pair that starts at each place but the last
        if n < 1:
            return ids
        get, merged = self.ranks.get, self.merged
        shift = n.bit_length()
        mask = (1 << shift) - 1
        # A leaf is rank and place in one int, so the lesser of two is the lower rank, the left one of equal ranks.
        tree = [NONE] * (2 * n)
        for i in range(n):
            if (rank := get(ids[i] << 32 | ids[i + 1])) is not None:
                tree[n + i] = rank << shift | i
        for i in range(n - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after = list(range(1, n + 2))
        before = list(range(-1, n))
        while (root := tree[1]) != NONE:
            i = root & mask
            j = after[i]
            k = after[i] = after[j]
            ids[i] = merged[root >> shift]
            ids[j] = -1
            changed = [(i, NONE)] if j >= n else [(j, NONE), (i, NONE)]
            if k <= n:
                before[k] = i
                if (rank := get(ids[i] << 32 | ids[k])) is not None:
                    changed[-1] = (i, rank << shift | i)
            if (h := before[i]) >= 0:
                rank = get(ids[h] << 32 | ids[i])
                changed.append((h, NONE if rank is None else rank << shift | h))
            for leaf, value in changed:
                p = n + leaf
                while p and tree[p] != value:
                    tree[p] = value
                    p >>= 1
                    if p:
                        a, b = tree[2 * p], tree[2 * p + 1]
                        value = a if a < b else b
        return [i for i in ids if i >= 0]

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The packed ids of each word, as :meth:`merge` has them. Words of like length share an array of trees."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], "i8")
        order = np.argsort(sizes, kind="stable")
        order = order[np.searchsorted(sizes[order], 1) :]  # without empty words
        while len(order):
            shift = max(1, int(sizes[order[0]]).bit_length())
            like = order[: min(TREES, int(np.searchsorted(sizes[order], 1 << shift)))]
            order = order[len(like) :]
            ids, ends = self._merge_like([words[i] for i in like.tolist()], sizes[like], shift)
            start = 0
            for i, end in zip(like.tolist(), ends.tolist(), strict=True):
                out[i] = ids[start:end]
                start = end
        return out

    def _merge_like(self, words: list[bytes], sizes: np.ndarray, shift: int) -> tuple[bytes, np.ndarray]:
        """The packed ids of words of 1 to 2^shift - 1 bytes, and where each word's ids end.

        Place 0 of each word is its edge, before the first byte and after the last. A leaf is rank and place, as in ``merge``.
        """
        width, n = 1 << shift, len(words)
        place = np.arange(width)
        inside = (place > 0) & (place <= sizes[:, None])
        ids = np.full((n, width), self.edge, "i8")
        raw = np.zeros((n, width), "u1")
        raw[inside] = np.frombuffer(b"".join(words), "u1")
        ids[inside] = self.first_ids[raw[inside]]
        after = np.where(place < sizes[:, None], place + 1, 0)
        before = np.tile(place - 1, (n, 1))
        tree = np.full((n, 2 * width), NONE, "i8")
        rank = self.byte_ranks[raw[:, 1:-1], raw[:, 2:]]
        tree[:, width + 1 : -1] = np.where((place[1:-1] < sizes[:, None]) & (rank != NONE), rank << shift | place[1:-1], NONE)
        for level in range(shift - 1, -1, -1):
            low = 1 << level
            np.minimum(tree[:, 2 * low : 4 * low : 2], tree[:, 2 * low + 1 : 4 * low : 2], out=tree[:, low : 2 * low])
        shape, live = ids.shape, np.arange(n)
        ids, after, before, tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()
        while len(live := live[(root := tree[live * 2 * width + 1]) != NONE]):
            root = root[root != NONE]
            row, top = live * width, live * 2 * width
            i = root & (width - 1)
            j = after[row + i]
            k = after[row + j]
            h = before[row + i]
            new = self.merged_ids[root >> shift]
            ids[row + i], ids[row + j] = new, -1
            after[row + i], before[row + k] = k, i
            left, right = self.rank_of(ids[row + h], new), self.rank_of(new, ids[row + k])
            node = top + width + np.stack([h, i, j])
            tree[node[0]] = np.where(left == NONE, NONE, left << shift | h)
            tree[node[1]] = np.where(right == NONE, NONE, right << shift | i)
            tree[node[2]] = NONE
            node -= top
            for _ in range(shift):
                node >>= 1
                child = top + 2 * node
                tree[top + node] = np.minimum(tree[child], tree[child + 1])
        ids = ids.reshape(shape)
        there = inside & (ids >= 0)
        return ids[there].astype("<u4").tobytes(), 4 * np.cumsum(there.sum(1))

    def _words(self, text: str) -> list[str]:
        """The words and special tokens of a text."""
        if not (self.cut and self.cut.search(text)):
            return self.words.findall(text)
        out = []
        for i, part in enumerate(self.cut.split(text)):
            out += [part] if i % 2 else self.words.findall(part)
        return out

    def _look_up(self, lot: list[list[str]]) -> list[bytes]:
        """The packed ids of each list of words."""
        memo = self.memo
        new = [w for w in set(chain.from_iterable(lot)) if w not in memo]
        raw = [w.encode() for w in new]
        long = [i for i, w in enumerate(raw) if len(w) > MEMO_BYTES]
        ids = self.merge_all([w if len(w) <= MEMO_BYTES else b"" for w in raw])
        for i in long:
            ids[i] = np.array(self.merge(raw[i]), "<u4").tobytes()
        memo.update(zip(new, ids, strict=True))
        out = [b"".join(map(memo.__getitem__, words)) for words in lot]
        for i in long:
            del memo[new[i]]
            new[i], ids[i] = "", b""
        self.held += MEMO_ENTRY * len(new) + 4 * sum(map(len, new)) + sum(map(len, ids))
        if self.held > MEMO_SIZE:
            self.memo, self.held = dict(self.fixed), 0
        return out

    def encode_all(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Texts are read in lots, larger ones in parts."""
        lot: list[list[str]] = []
        held = 0
        for text in texts:
            words = self._words(text)
            if held + len(words) > LOT:
                yield from [np.frombuffer(ids, "<u4") for ids in self._look_up(lot)]
                lot, held = [], 0
            if len(words) > LOT:
                yield np.frombuffer(b"".join([self._look_up([words[at : at + LOT]])[0] for at in range(0, len(words), LOT)]), "<u4")
            else:
                lot.append(words)
                held += len(words)
        yield from [np.frombuffer(ids, "<u4") for ids in self._look_up(lot)]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, as :meth:`encode_all` has them."""
        return next(self.encode_all([text]))

    def decode(self, ids: Iterable[int]) -> str:
        """Special tokens stay; bytes that are no UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in (ids.tolist() if isinstance(ids, np.ndarray) else ids)]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Bpe:
    """A worker's encoder, with the words that it remembers from one task to the next."""
    return Bpe(path)


def encode_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id and ``ids`` array<int>. Null text counts as empty and has no ids."""
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            ids = [x.astype("i4") for x in bpe.encode_all(t.as_py() or "" for t in b.column(1))]
            ends = np.cumsum([0, *map(len, ids)]).astype("i4")
            flat = np.concatenate(ids) if ids else np.empty(0, "i4")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, pa.int32()))], [id_col, "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode_tokens(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``tokens``: id and ``text``. Null ids decode to the empty text."""
    python_ready(tokens.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], [id_col, "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_tokens, ids_sha256, decoded_sha256.

    Encodes and decodes in one pass, so that neither ids nor texts leave the task. Null text counts as empty; ids may be null
    or repeat; texts of any length are encoded whole; other columns are ignored; an empty table gives an empty result.
    """
    python_ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for ids in bpe.encode_all(t.as_py() or "" for t in b.column(1)):
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(ids.tobytes()).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
