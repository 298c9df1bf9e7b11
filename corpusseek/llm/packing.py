"""Best-fit packing of token sequences by exact complements.

Documents are tokenised where they are read; longer ones are cut. What matters for packing is only how many pieces there
are of each length, at most ``size`` numbers, so the driver plans on those counts alone: for the longest piece left, the gap
is looked up among single lengths and the sums of pairs and triples that are still available; a combination that fills the
gap exactly is consumed as often as its counts allow. Where there is none, the best fitting piece or sum goes in and the rest
of the gap is looked up again. A plan has few patterns, whatever the number of documents, as each use of a pattern
uses up a length. Pieces then find their places by their rank among pieces of the same length: the rank is the place in the
piece's own task plus the counts of the tasks before, so no length, however common, meets in one task.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PATTERN, Bpe, vocabulary
from .common import python_ready, write_shared

SIZE = 1024
#: Base counts (one row a task and length, of about 200 bytes) are broadcast up to 16 MB, and joined by shuffle beyond.
BROADCAST_ROWS = (16 << 20) // 200
SHIFT = 42  # of a length, above a rank


class Sums:
    """Which sums single available lengths and pairs of them make, kept up as lengths run out."""

    def __init__(self, counts: np.ndarray, balanced: bool = False, sums: bool = True) -> None:
        self.step = -1 if balanced else 1
        self.most = 3 if sums else 1
        self.left = counts.copy()
        self.size = len(counts) - 1
        self.there = self.left > 0
        here = np.flatnonzero(self.there)
        #: number of pairs (a <= b) of available lengths by their sum
        self.pairs = np.zeros(2 * self.size + 2, "i8")
        for a in here:
            self.pairs[a + here[here >= a]] += 1

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if self.left[length] == 0:
            here = np.flatnonzero(self.there)
            self.pairs[length + here] -= 1
            self.there[length] = False

    def fits(self, lengths: list[int], used: Counter) -> bool:
        need = Counter(lengths)
        return all(self.left[x] >= used[x] + n for x, n in need.items())

    def pair(self, gap: int, used: Counter) -> list[int] | None:
        """The available pair of this sum, that with the longest member first, or last if ``balanced``."""
        a = np.arange(gap - 1, (gap - 1) // 2, -1)[:: self.step]
        for x in a[self.there[a] & self.there[gap - a]].tolist():
            if self.fits([x, gap - x], used):
                return [x, gap - x]
        return None

    def exact(self, gap: int, used: Counter) -> list[int] | None:
        """One, two or three available lengths that sum up to ``gap``."""
        if self.fits([gap], used):
            return [gap]
        if gap >= 2 and self.pairs[gap] and (two := self.pair(gap, used)):
            return two
        if gap >= 3:
            a = np.arange(gap - 2, (gap - 1) // 3, -1)[:: self.step]
            for x in a[self.there[a] & (self.pairs[gap - a] > 0)].tolist():
                if self.fits([x], used) and (two := self.pair(gap - x, used + Counter([x]))):
                    return [x, *two]
        return None

    def best_fit(self, gap: int, used: Counter) -> list[int]:
        """Available lengths that leave the least of ``gap``: the longest single one, or with ``sums`` one to three."""
        if self.most == 3:
            return next((found for total in range(gap, 0, -1) if (found := self.exact(total, used))), [])
        return self.exact(gap, used) or next(([x] for x in np.flatnonzero(self.there[: gap + 1])[::-1].tolist() if self.left[x] > used[x]), [])


def plan_with(sums: Sums) -> list[tuple[int, list[int]]]:
    out = []
    for longest in range(sums.size, 0, -1):
        while sums.left[longest] > 0:
            lengths, gap = [longest], sums.size - longest
            while gap and (rest := sums.best_fit(gap, Counter(lengths))):
                lengths += rest
                gap -= sum(rest)
            used = Counter(lengths)
            times = min(int(sums.left[x]) // n for x, n in used.items())
            for x, n in used.items():
                sums.take(x, times * n)
            out.append((times, lengths))
    return out


def plan(counts: np.ndarray) -> list[tuple[int, list[int]]]:
    """``counts[n]`` pieces of length n, n up to the sequence size; returns (number of sequences, lengths in each).

    The order in which sums are tried and the residual's rule each have two forms; the plan with the fewest sequences counts.
    """
    counts = counts.astype("i8")
    plans = [plan_with(Sums(counts, balanced, sums)) for balanced in (False, True) for sums in (False, True)]
    return min(plans, key=lambda p: sum(times for times, _ in p))


def places(patterns: list[tuple[int, list[int]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Look-up arrays: sorted keys (length, first rank) and, for each, (first rank, copies in a sequence, first sequence, offset)."""
    rows, rank, first = [], Counter(), 0
    for times, lengths in patterns:
        at = 0
        for x, n in Counter(lengths).items():
            rows.append((x, rank[x], n, first, at))
            rank[x] += times * n
            at += x * n
        first += times
    rows.sort()
    table = np.array(rows, "i8").reshape(-1, 5)
    return (table[:, 0] << SHIFT) + table[:, 1], table[:, 1:]


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens; the first takes what is left over by whole ones."""
    head = n % size or min(n, size)
    return [(0, head)] + [(s, size) for s in range(head, n, size)] if n else []


@lru_cache(maxsize=2)
def own_encoder(path: str) -> Bpe:
    return Bpe(path)


@lru_cache(maxsize=2)
def fast_encoder(path: str) -> Callable[[str], np.ndarray]:
    """A compiled encoder with the ids of ``tokenizers`` for a byte-level BPE file. Where it panics, on extreme texts, our own
    encoder takes over; it is built only then."""
    import tiktoken

    _, tokens, special = vocabulary(path)
    fixed = set(special.values())
    enc = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks={b: i for i, b in enumerate(tokens) if b and i not in fixed}, special_tokens=special)

    def encode(text: str) -> np.ndarray:
        try:
            return enc.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
        except BaseException as e:
            if type(e).__name__ != "PanicException":  # of the compiled code, which isn't an Exception and can't be imported
                raise
            return own_encoder(path).encode(text)

    return encode


def token_pieces(docs: DataFrame, path: str, size: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """The pieces of all documents, with ``part`` (the task) and ``nth`` (place among the task's pieces of this length)."""
    python_ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "piece", "start", "length", "ids_crc32", "part", "nth", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen, part = fast_encoder(path), Counter(), TaskContext.get().partitionId()
        for b in batches:
            own, cols = [], [[] for _ in names[1:]]
            for i, t in enumerate(b.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.array([end_id], "<u4"))
                for k, (start, n) in enumerate(cut(len(ids), size)):
                    raw = ids[start : start + n]
                    own.append(i)
                    for c, v in zip(cols, [k, start, n, zlib.crc32(raw.tobytes()), part, seen[n], raw.astype("i4")], strict=False):
                        c.append(v)
                    seen[n] += 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(own, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=False)]], names)

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long" + ", ids array<int>" * with_ids)


def pack(docs: DataFrame, path: str, size: int = SIZE, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if ``with_ids``.

    A document is its token ids, then ``end_id``. One longer than ``size`` is cut into pieces of ``size``; the first piece is
    the shorter one, if any. Null or empty text is the end id alone. Ids may be null or repeat: each row of ``docs`` is a
    document of its own. Other columns are ignored. An empty table gives an empty result. Equal lengths take places in order
    of their tasks and rows; sequences have no gaps.
    """
    pieces = write_shared(token_pieces(docs, path, size, end_id, id_col, text_col, with_ids), "pack-pieces")
    counts = write_shared(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), "pack-counts")
    total = np.zeros(size + 1, "i8")
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        total[r["length"]] = r["n"]
    keys, table = places(plan(total), size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            first, copies, sequence, offset = table[np.searchsorted(keys, (length << SHIFT) + rank, "right") - 1].T
            nth = rank - first
            out = {n: b.column(n) for n in names} | {"sequence_id": pa.array(sequence + nth // copies), "offset": pa.array(offset + nth % copies * length)}
            yield pa.RecordBatch.from_pydict(out)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    small = counts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    ranked = pieces.join(F.broadcast(base) if small else base, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("base"))
    names = [id_col, "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids + ", sequence_id long, offset long"
    return ranked.select(*names, "rank").mapInArrow(place, schema)
