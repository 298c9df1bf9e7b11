"""Exact deduplication over an extendible-hash index in shared files (DataFrame functions only).

1. Every text gets a 64-bit hash of its normalised form. The distinct hashes, with their counts, fill the directory: it starts
   with as many slots as full buckets would need; while a bucket has more hashes than ``capacity``, it splits on its next
   leading bit, and the directory doubles when that bit is beyond its depth. All of that is counting on small tables of the
   shared folder; a directory of up to 2^16 slots becomes a constant of the plan, a larger one is joined with.
2. Texts go by directory slot to the owner task of their bucket, a contiguous range of the hash. The owner groups what
   arrived by hash and bytes: equal hashes with unequal bytes are links of one chain (``chain`` is the place in it). It decides
   which id stays and how many there are, and writes its range as files of the index.
3. Texts of hashes that more than 1 in ``HOT_KEYS`` rows share are combined by bytes before that, so that a group with a third of
   all rows costs its owner one row for each task before; there are at most ``HOT_KEYS`` such hashes, so they can be broadcast.
4. Documents probe the index by bucket, hash and digest. Only ids and hashes are shuffled then, and Spark splits the
   partition of a hot group.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, free_name, own, quoted, text_or_empty, without, write_shared

#: Distinct hashes of a bucket.
CAPACITY = 2_000
#: Buckets split no further than this many bits below those that would just be full. One that is still overfull then, which even
#: hashes rule out, stays so; no row is lost to that.
SPLITS = 6
MAX_DEPTH = 48
#: Up to this depth the directory is a constant in the plan (at most 65,536 ints); beyond, it is a table to join with.
INLINE_DEPTH = 16
#: A hash is hot with more than 1 in HOT_KEYS of all rows, and with HOT_ROWS rows at least.
HOT_KEYS = 100_000
HOT_ROWS = 1_000


def slot_of(h: str | Column, depth: int) -> Column:
    """The ``depth`` leading bits of a hash, as a directory slot."""
    h = F.col(h) if isinstance(h, str) else h
    return F.lit(0).cast("long") if depth == 0 else F.shiftrightunsigned(h, 64 - depth)


def grow_directory(hashes: DataFrame, n: int, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """The directory (slot, bucket) of the ``n`` distinct hashes in column ``h``, and its depth. A bucket's number is its first
    slot. No bucket has more than ``capacity`` hashes, but for those that ``SPLITS`` more bits couldn't part."""
    spark = hashes.sparkSession
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(max(1, n) / capacity))))
    fine = min(MAX_DEPTH, depth + SPLITS) if n > capacity else 0
    open_ = write_shared(hashes.groupBy(slot_of("h", fine).alias("fine")).agg(F.count("*").alias("n")), "exact-counts", min(n, 1 << fine))
    closed: list[tuple[int, DataFrame]] = []
    while True:
        prefix = F.shiftrightunsigned("fine", fine - depth)
        full = open_.groupBy(prefix.alias("prefix")).agg(F.sum("n").alias("n")).where(F.col("n") > capacity).select("prefix")
        full = write_shared(full, "exact-full", min(n, 1 << depth))
        splits = depth < fine and full.limit(1).count() > 0
        fits = open_.join(full, prefix == full["prefix"], "left_anti") if splits else open_
        closed.append((depth, fits.select(prefix.alias("prefix")).distinct()))
        if not splits:
            break
        open_ = open_.join(full, prefix == full["prefix"], "left_semi")
        depth += 1
    slots = None
    for d, found in closed:  # a bucket of local depth d has all slots that begin with its bits
        first = F.shiftleft("prefix", depth - d)
        part = found.select(first.alias("bucket"), F.explode(F.sequence(first, first + F.lit((1 << (depth - d)) - 1))).alias("slot"))
        slots = part if slots is None else slots.union(part)
    return (slots if slots is not None else spark.createDataFrame([(0, 0)], "bucket long, slot long")).select("slot", "bucket"), depth


def with_bucket(df: DataFrame, directory: DataFrame, depth: int) -> DataFrame:
    """Adds ``bucket`` by one look-up in the directory."""
    if depth == 0:
        return df.withColumn("bucket", F.lit(0).cast("long"))
    if depth <= INLINE_DEPTH:
        bucket = {r["slot"]: r["bucket"] for r in directory.collect()}  # at most 2^INLINE_DEPTH rows
        known = [bucket.get(i, i) for i in range(1 << depth)]  # slots that no hash has
        slots = F.array(*[F.lit(i) for i in known]) if depth <= 6 else F.from_json(F.lit(str(known)), "array<int>")
        return df.withColumn("bucket", F.element_at(slots, slot_of("h", depth).cast("int") + 1).cast("long"))
    return df.withColumn("slot", slot_of("h", depth)).join(directory, "slot").drop("slot")


def hashed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = ascii_lower(text_or_empty(F.col(quoted(text_col))))
    return docs.select(F.col(quoted(id_col)).alias("id"), norm.alias("norm")).select("id", F.xxhash64("norm").alias("h"), "norm")


def texts_for_owners(docs: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """(h, norm, id, n): a row for each document, or, of hot hashes, one for each text."""
    hot = hashes.where(F.col("n") > max(HOT_ROWS, rows // HOT_KEYS)).select("h")
    if not hot.limit(1).count():
        return docs.select("h", "norm", "id", F.lit(1).cast("long").alias("n"))
    many = docs.join(F.broadcast(hot), "h", "left_semi").groupBy("h", "norm").agg(F.max("id").alias("id"), F.count("*").alias("n"))
    return docs.join(F.broadcast(hot), "h", "left_anti").select("h", "norm", "id", F.lit(1).cast("long").alias("n")).union(many)


class Index:
    """The index files (bucket, h, chain, text_sha256, keep_id, group_size) and their directory."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> None:
        keyed = hashed(docs, id_col, text_col)
        hashes = write_shared(keyed.groupBy("h").agg(F.count("*").alias("n")), "exact-hashes")
        size = hashes.agg(F.sum("n").alias("rows"), F.count("*").alias("hashes")).first()
        self.directory, self.depth = grow_directory(hashes, size["hashes"], capacity)
        sent = with_bucket(texts_for_owners(keyed, hashes, size["rows"] or 0), self.directory, self.depth).repartition("bucket")
        groups = sent.groupBy("bucket", "h", "norm").agg(F.max("id").alias("keep_id"), F.sum("n").alias("group_size"))
        entries = groups.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
        chain = F.row_number().over(Window.partitionBy("bucket", "h").orderBy("text_sha256")) - 1
        self.entries = write_shared(entries.withColumn("chain", chain), "exact-index")

    def probe(self, keys: DataFrame) -> DataFrame:
        """Rows with h and text_sha256 get bucket, chain, keep_id and group_size."""
        return with_bucket(keys, self.directory, self.depth).join(self.entries, ["bucket", "h", "text_sha256"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256, bucket, chain.

    Texts are equal when identical after lower-casing A-Z only. Null text counts as empty, so null and empty texts form
    one group. The largest id of a group stays; a null id never does, unless all ids of its group are null, when all rows
    of the group carry a null ``keep_id`` and are kept. Rows repeated with one id share the decision and each count in
    ``group_size``. Very long texts are compared whole. Other columns of ``docs`` are ignored, so their names can't clash.
    An empty table gives an empty result.
    """
    keys = hashed(docs, id_col, text_col).select("id", "h", F.sha2("norm", 256).alias("text_sha256"))
    found = Index(docs, id_col, text_col, capacity).probe(keys)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "bucket", "chain")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest id.

    Where ids are null or repeat, they don't tell rows apart; then rows are matched by their text, and of rows repeated with
    the id that stays one is kept.
    """
    id_ = F.col(quoted(id_col))
    vague = docs.groupBy(id_.alias("id")).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col("id").isNull())
    if not vague.limit(1).count():
        judged = exact_dedup(docs, id_col, text_col, capacity)
        return without(docs, judged.where(~F.col("kept")).select(F.col(quoted(id_col)).alias("id")), id_col)
    entries = Index(docs, id_col, text_col, capacity).entries
    norm = ascii_lower(text_or_empty(F.col(quoted(text_col))))
    h, sha, keep = (free_name(docs, c) for c in ("h", "sha", "keep"))
    keyed = docs.select(*own(docs), F.xxhash64(norm).alias(h), F.sha2(norm, 256).alias(sha))
    found = keyed.join(entries.select(F.col("h").alias(h), F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep)), [h, sha])
    return found.where(id_.eqNullSafe(F.col(keep))).dropDuplicates([h, sha]).select(own(docs))
