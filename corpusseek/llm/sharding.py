"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, set by an offset and a step from hashes of its
name. Shards take turns, each claiming the first free slot of its permutation, until the table is full: shares differ by one
slot at most, and adding or removing a shard moves few slots. The table has a fixed size whatever the data, so it goes to all
tasks as a constant, and a key is placed by one look-up without a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime of about 1,000 slots a shard for 64 shards.
TABLE_SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: tuple[str, ...] | list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot → index of its shard."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table's size has to be a prime, and no less than the number of shards")
    order = []
    for name in shards:
        d = hashlib.sha256(name.encode()).digest()
        order.append([int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1])
    out, left = [-1] * size, size
    while left:
        for i, turn in enumerate(order):
            while out[turn[0]] >= 0:
                turn[0] = (turn[0] + turn[1]) % size
            out[turn[0]] = i
            left -= 1
            if not left:
                break
    return out


def key_slot(key: Column, size: int) -> Column:
    """60 bits of the key's SHA-256 modulo the table's size; a null key goes where the empty one goes."""
    digest = F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256)
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % size).cast("int")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (an int index into ``shards``), replacing columns of these names.

    Rows with equal keys go to one shard; null keys count as empty text. No row is moved.
    """
    lookup = F.from_json(F.lit(str(fill_table(shards, size))), "array<int>")
    return df.withColumn("slot", key_slot(F.col(key), size)).withColumn("shard", F.element_at(lookup, F.col("slot") + 1))


def write_shards(df: DataFrame, path: str, key: str = "doc_id", shards: tuple[str, ...] | list[str] = SHARDS, size: int = TABLE_SIZE, files: int = 8) -> None:
    """Writes one folder per shard under ``path``, each in about ``files`` files; a hot key's rows are spread over them."""
    placed = assign_shards(df, key, shards, size).drop("slot")
    spread = placed.repartition(len(shards) * files, "shard", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files)))
    spread.write.partitionBy("shard").parquet(path)
