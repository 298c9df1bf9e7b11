"""MinHash near-deduplication: one-permutation hashing with optimal densification, banded buckets and star-shaped candidates.

1. A text's set is its distinct word shingles, hashed to 64 bits. Texts with equal sets are one class; only the class's least
   id goes on, so a group of exact copies costs one row, however large.
2. The hash range is cut into bins; a signature is the least shingle of each bin. An empty bin borrows from a bin drawn by
   hashes of its own number and the attempt, until one that isn't empty comes up.
3. Classes that agree in all rows of a band share a bucket. In each bucket, the least class is the centre of a star; only
   its edges are candidates, and each is confirmed on the full sets.
4. No link is lost to that: classes joined by candidate edges are a cluster. Where confirmed links leave a cluster in several
   components, its members are compared with the cluster's least class, the pivot, by the symmetric difference D of the sets.
   Two sets are as similar as asked just when their D differ in few elements, so only members of different components go on
   that share an element among the rarest of their D and could still be close enough from its position on (a prefix filter).
   Near-copies differ from their pivot in elements of their own, so that even a large group gives few pairs.
5. Components come from stars over the confirmed links.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, drop_shared, python_ready, quoted, without, write_shared
from .components import components
from .textops import NOT_BLANK, mix, words_by_text

WORDS = 5
BANDS = 50
#: The chance that a pair right at the threshold shares no bucket is this at most.
MISS = 1e-6
#: Rows of a file whose rows hold texts or whole sets.
TEXTS_PER_FILE = 20_000

_U = np.uint64


def rows_per_band(percent: int, bands: int = BANDS, miss: float = MISS) -> int:
    """The most rows that keep the chance of a miss, (1 - s^rows)^bands at similarity s, within ``miss``."""
    r = 1
    while r < 32 and (1 - (percent / 100) ** (r + 1)) ** bands <= miss:
        r += 1
    return r


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text. Fewer words than a shingle has make one; no words make none."""
    out: list[np.ndarray] = []
    weights = mix(np.arange(1, words + 1, dtype="u8")) | _U(1)
    for _, h, ends in words_by_text(texts, NOT_BLANK):
        if len(h) >= words:
            rolled = sum((h[i : len(h) - words + 1 + i] * weights[i] for i in range(words)), np.zeros(len(h) - words + 1, "u8"))
            rolled = mix(rolled)
        start = 0
        for end in ends.tolist():
            n = end - start
            if n >= words:
                out.append(np.unique(rolled[start : end - words + 1]))
            elif n:
                out.append(mix((h[start:end] * weights[:n]).sum(dtype="u8", keepdims=True) + mix(np.full(1, n, "u8"))))
            else:
                out.append(np.empty(0, "u8"))
            start = end
    return out


def signatures(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values for each non-empty set."""
    sig = np.zeros((len(sets), bins), "u8")
    there = np.zeros((len(sets), bins), bool)
    for i, s in enumerate(sets):
        at = ((s >> _U(32)) * _U(bins) >> _U(32)).astype("i8")  # grows with s, so the first of a bin is its least
        first = np.flatnonzero(np.diff(at, prepend=-1))
        sig[i, at[first]] = s[first]
        there[i, at[first]] = True
    row, col = np.nonzero(~there)
    attempt = 0
    while len(row):
        attempt += 1
        draw = (mix(col.astype("u8") * _U(0x9E3779B97F4A7C15) + _U(attempt)) % _U(bins)).astype("i8")
        found = there[row, draw]
        sig[row[found], col[found]] = sig[row[found], draw[found]]
        row, col = row[~found], col[~found]
    return sig


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(set, band) → bucket key, as signed 64-bit numbers."""
    sig = signatures(sets, bands * rows).reshape(len(sets), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype="u8")), (len(sets), bands))
    for r in range(rows):
        key = mix(key * _U(0xD6E8FEB86659FD93) + sig[:, :, r])
    return key.astype("u8").view("i8")


def sketches(docs: DataFrame, percent: int, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, f1, f2, keys): size and 128-bit fingerprint of the set, and its bucket keys."""
    rows = rows_per_band(percent)
    # A set this small shares no more than s/(s+1) with any other set, which is below the threshold.
    alone = int(percent / (100 - percent) - 1e-9) if percent < 100 else 1 << 60

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()], words)
            prints = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), "i8") for s in sets]).reshape(-1, 2)
            big = [i for i, s in enumerate(sets) if len(s) > alone]
            counts = np.zeros(len(sets) + 1, "i4")
            parts = []
            for at in range(0, len(big), 64):  # 64 signatures at a time
                parts.append(band_keys([sets[i] for i in big[at : at + 64]], BANDS, rows).ravel())
            counts[1:][big] = BANDS
            keys = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype="i4")), pa.array(np.concatenate(parts) if parts else np.empty(0, "i8")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints[:, 0]), pa.array(prints[:, 1]), keys], ["id", "n", "f1", "f2", "keys"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("id"), quoted(text_col)).mapInArrow(run, "id long, n long, f1 long, f2 long, keys array<long>")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """Of the pairs (a, b), those whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, "u8"))
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            ta, tb = batch.column("ta").cast(pa.binary()), batch.column("tb").cast(pa.binary())
            good = []
            for i in range(len(a)):
                if last[0] != a[i]:
                    last = (a[i], shingle_sets([ta[i].as_py() or b""], words)[0])
                x, y = last[1], shingle_sets([tb[i].as_py() or b""], words)[0]
                both = np.concatenate([x, y])
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                if 100 * shared >= percent * (len(both) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in good], pa.int64()), pa.array([b[i] for i in good], pa.int64())], ["a", "b"])

    first = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    second = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(second, "b").join(first, "a").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def star_edges(rows: DataFrame, most: int) -> DataFrame:
    """(a, b), ``most`` at most, from the least node of each bucket to its others. ``rows`` has key, node and n. Edges between sets whose sizes
    alone rule a link out stay, as they hold clusters together."""
    least = rows.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select("key", "a")
    least = write_shared(least, "near-centres", most)  # so that Spark can split the join for a hot bucket
    edges = write_shared(rows.join(least, "key").where("a <> node").select("a", F.col("node").alias("b")).distinct(), "near-stars", most)
    drop_shared(least)
    return edges


def differences(members: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """(cluster, node, label, n, d, linked, elements): each member's difference from its pivot, the node ``cluster``, its size,
    and whether the two are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, np.ndarray] = (None, np.empty(0, "u8"))
        for batch in batches:
            pivot = batch.column("cluster").to_pylist()
            tp, tn = batch.column("tp").cast(pa.binary()), batch.column("tn").cast(pa.binary())
            n, d, linked, found = [], [], [], []
            for i, p in enumerate(pivot):
                if last[0] != p:
                    last = (p, shingle_sets([tp[i].as_py()], words)[0])
                own = shingle_sets([tn[i].as_py()], words)[0]
                diff = np.setxor1d(last[1], own, assume_unique=True)
                n.append(len(own))
                d.append(len(diff))
                linked.append((100 + percent) * len(diff) <= (100 - percent) * (len(own) + len(last[1])))
                found.append(diff.view("i8"))
            ends = np.cumsum([0, *d]).astype("i4")
            elements = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.empty(0, "i8")))
            cols = [batch.column("cluster"), batch.column("node"), batch.column("label"), pa.array(n, pa.int64()), pa.array(d, pa.int64()), pa.array(linked, pa.bool_()), elements]
            yield pa.RecordBatch.from_arrays(cols, ["cluster", "node", "label", "n", "d", "linked", "elements"])

    whole = members.join(texts.withColumnRenamed("text", "tn"), "node").join(texts.select(F.col("node").alias("cluster"), F.col("text").alias("tp")), "cluster")
    return whole.select("cluster", "node", "label", "tp", "tn").mapInArrow(run, "cluster long, node long, label long, n long, d long, linked boolean, elements array<long>")


def close_pairs(diffs: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of a cluster's members in different components whose differences may be close enough.

    Sets of sizes n and m are linked just when they differ in (100 - percent) / (100 + percent) * (n + m) elements at most, and
    so do their D. Of two such D that share an element at all (else both are linked to the pivot), the first shared one in
    order of rarity is among so many of either, and enough elements are left from its position on.
    """
    most = lambda x: f"((100 - {percent}) * ({x}) div (100 + {percent}))"
    each = diffs.select("cluster", "node", "n", "d", F.explode("elements").alias("e"))
    common = each.groupBy("cluster", "e").agg(F.count("*").alias("df")).where("df > 1")
    shared = each.join(common, ["cluster", "e"])
    own = Window.partitionBy("cluster", "node")
    # Elements that no other member has come first, whatever they are.
    placed = shared.withColumn("pos", F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "e")) - 1)
    prefix = placed.where(f"pos <= {most(f'n + n * 100 div {percent}')}").join(labels, "node").select("cluster", "e", "node", "component", "n", "d", "pos")
    x = prefix.toDF("cluster", "e", "a", "ca", "na", "da", "pa")
    y = prefix.toDF("cluster", "e", "b", "cb", "nb", "db", "pb")
    limit = most("na + nb")
    near = x.join(y, ["cluster", "e"]).where(f"a < b AND ca <> cb AND 100 * least(na, nb) >= {percent} * greatest(na, nb) AND abs(da - db) <= {limit} AND da + db - 2 * least(da - pa, db - pb) <= {limit}")
    return near.select("a", "b").distinct()


def merged(named: DataFrame, edges: DataFrame) -> DataFrame:
    """``named`` (node, label, ...) after joining the labels at the ends of ``edges`` (a, b); as many as those are few."""
    up = components(edges).toDF("label", "up")
    return named.join(up, "label", "left").withColumn("label", F.coalesce("up", "label")).drop("up").select(named.columns)


def label_edges(links: DataFrame, named: DataFrame) -> DataFrame:
    """Links between nodes as edges between their labels."""
    labels = named.select("node", "label")
    both = links.join(labels.toDF("a", "la"), "a").join(labels.toDF("b", "lb"), "b")
    return both.where("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()


def labelled(rows: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame | None:
    """(node, cluster, label) of the nodes that share a bucket: the label is the least node reachable by links. None where no two
    nodes share one. What is written for a step goes when its last reader is done."""
    most = rows.count()
    edges = star_edges(rows, most)
    if not edges.limit(1).count():
        return None
    clusters = components(edges)
    sizes = write_shared(rows.select("node", "n").distinct(), "near-sizes", most)
    links = write_shared(confirm(fitting(edges, sizes, percent), texts, percent, words), "near-links", most)
    linked = components(links)
    found = clusters.withColumnRenamed("component", "cluster").join(linked, "node", "left").select("node", "cluster", F.coalesce("component", "node").alias("label"))
    named = write_shared(found, "near-labels", most)
    for t in (edges, clusters, sizes, links, linked):
        drop_shared(t)
    mixed = named.groupBy("cluster").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("cluster")
    mixed = write_shared(mixed, "near-mixed", most)
    diffs = write_shared(differences(named.join(mixed, "cluster"), texts, percent, words), "near-differences", most, TEXTS_PER_FILE)
    drop_shared(mixed)
    if not diffs.limit(1).count():
        return named
    pivots = diffs.where("linked AND node <> cluster").select(F.col("cluster").alias("a"), F.col("node").alias("b"))
    first, named = named, write_shared(merged(named, label_edges(pivots, named)), "near-labels", most)
    known = diffs.select("node").join(named, "node").select("node", F.col("label").alias("component"))
    pairs = write_shared(close_pairs(diffs, known, percent), "near-pairs")
    more = write_shared(confirm(pairs, texts, percent, words), "near-links")
    second, named = named, write_shared(merged(named, label_edges(more, named)), "near-labels", most)
    for t in (first, second, diffs, pairs, more):
        drop_shared(t)
    return named


def fitting(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes alone don't rule a link out."""
    both = pairs.join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    return both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)").select("a", "b")


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are runs of anything but U+0020 and U+0009 to U+000D, A-Z lower-cased. Two texts are linked when
    100 * |intersection| >= ``percent`` * |union| of their shingle sets. ``component_id`` is the least id reachable by links,
    the row's own included; ``kept`` marks the row with that id. Null or empty texts, and texts without words, have an empty
    set, link with nothing and are kept. Rows that share an id are one
    node, linked as any of them is. A null id takes no part in links: its row has its
    copies' component, if any copy has an id, else a null component, and is kept only then. Ids have to be integers. Other
    columns are ignored. An empty table gives an empty result.
    """
    python_ready(docs.sparkSession)
    drawn = write_shared(sketches(docs, percent, words, id_col, text_col), "near-sketches")
    n = drawn.count()
    classes = drawn.where("n > 0").groupBy("f1", "f2").agg(F.min("id").alias("node"), F.min_by("keys", "id").alias("keys"), F.max("n").alias("n"))
    classes = write_shared(classes.where("node IS NOT NULL"), "near-classes", n, TEXTS_PER_FILE)
    rows = classes.select(F.explode("keys").alias("key"), "node", "n")
    many = write_shared(rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("key"), "near-buckets", BANDS * n)
    members = write_shared(rows.join(many, "key"), "near-members", BANDS * n)
    nodes = write_shared(members.select("node").distinct(), "near-nodes", n)
    small = nodes.count() <= BROADCAST_IDS
    whole = docs.select(F.col(quoted(id_col)).cast("long").alias("node"), F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("text"))
    texts = write_shared(whole.join(F.broadcast(nodes) if small else nodes, "node", "left_semi"), "near-texts", n, TEXTS_PER_FILE)
    labels = labelled(members, texts, percent, words)
    for t in (many, members, nodes, texts):
        drop_shared(t)
    out = drawn.select("id", "n", "f1", "f2").join(classes.select("f1", "f2", "node"), ["f1", "f2"], "left")
    if labels is not None:
        out = out.join(labels.select("node", "label"), "node", "left").withColumn("node", F.coalesce("label", "node"))
    component = F.coalesce("node", "id")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, percent: int = 80, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the least id. Rows with a null id stay, and so do
    all rows of an id that stays."""
    judged = near_duplicates(docs, percent, words, id_col, text_col)
    return without(docs, judged.where(~F.col("kept") & F.col(quoted(id_col)).isNotNull()).select(F.col(quoted(id_col)).alias("id")).distinct(), id_col)
