"""Line deduplication (DataFrame functions only): explode normalised lines, hash them, count distinct documents per hash,
drop lines over the threshold and reassemble the rest by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, text_or_empty, write_shared

#: Up to so many frequent keys (16 bytes each) are broadcast; beyond, both sides are shuffled by hash.
BROADCAST_KEYS = 200_000


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def key_hashes(key: Column) -> list[Column]:
    """Two 64-bit hashes, 128 bits together: a collision among 10^12 lines is out of reach."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")]


def frequent_keys(docs: DataFrame, text_col: str, min_docs: int, min_chars: int) -> DataFrame:
    """Hashes of the keys found in at least ``min_docs`` rows, and their counts; each row counts a key once."""
    keys = F.array_distinct(F.transform(F.split(text_or_empty(text_col), "\n", -1), line_key))
    each = docs.select(F.explode(keys).alias("key")).where(F.char_length("key") >= min_chars)
    counted = each.groupBy(*key_hashes(F.col("key"))).agg(F.count("*").alias("n_docs"))
    return counted.where(F.col("n_docs") >= min_docs)


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """One row per row of ``docs``: id, n_lines, n_dropped, kept_text.

    A line's key is the line without leading and trailing blanks (U+0020, U+0009 to U+000D), A-Z lower-cased. Keys of at
    least ``min_chars`` code points in at least ``min_docs`` rows lose all their lines; with ``min_chars=0`` blank lines
    count too. Null or empty text is one empty line. Each row of ``docs`` is a document, also when ids are null or repeat.
    A document that loses every line keeps the empty text. Other columns are ignored. An empty table gives an empty result.
    """
    frequent = write_shared(frequent_keys(docs, text_col, min_docs, min_chars).select("h1", "h2"), "line-keys")
    small = frequent.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
    # The row number is one of the scan's: a recomputed task gives the same.
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.split(text_or_empty(text_col), "\n", -1).alias("all"))
    lines = rows.select("row", "id", F.size("all").alias("n_lines"), F.posexplode("all").alias("pos", "line"))
    keyed = lines.select("*", line_key(F.col("line")).alias("key")).select("row", "id", "n_lines", "pos", "line", *key_hashes(F.col("key")), (F.char_length("key") >= min_chars).alias("long"))
    marked = keyed.join(F.broadcast(frequent.withColumn("hit", F.lit(True))) if small else frequent.withColumn("hit", F.lit(True)), ["h1", "h2"], "left")
    # A dropped line goes on as null at its place, so that a document that loses all lines is still there.
    out = marked.select("row", "id", "n_lines", "pos", F.when(F.col("hit") & F.col("long"), None).otherwise(F.col("line")).alias("line"))
    back = out.groupBy("row").agg(F.first("id").alias("id"), F.first("n_lines").alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("parts"))
    kept = F.transform(F.filter("parts", lambda p: p["line"].isNotNull()), lambda p: p["line"])
    return back.select(F.col("id").alias(id_col), F.col("n_lines").cast("long").alias("n_lines"), kept.alias("kept")).select(id_col, "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
