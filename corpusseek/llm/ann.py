"""Approximate nearest neighbours by stable projections and a kd-tree, with a chi-square stopping test.

A Gaussian projection to ``DIMS`` dimensions is 2-stable: the squared projected distance of two vectors over their squared
distance follows a chi-square law with ``DIMS`` degrees of freedom. A kd-tree over the projected vectors cuts them into cells; its
splits are fitted on a sample of ``SAMPLE`` rows, about, chosen by a hash of their ids, and every row is put into its cell. A
query goes through the tree twice:

1. In its ``FIRST_CELLS`` nearest cells, the ``FIRST_ROWS`` nearest projections are verified by the true distance. The k-th best of
   all of them is a bound that holds in every cell.
2. Cells whose bounding box the stopping test rules out aren't visited. In the others, projected neighbours are verified one step
   after the other, nearest first, until a vector as near as the bound (or as the k-th found here, if that is nearer) would
   have shown up by now with probability ``SURE``.

A cell's rows are written once and meet its queries in one sorted partition, the rows first: a task holds the rows of one cell and
one Arrow batch of queries, however many there are. Copies of one vector are searched once, as queries, and as candidates
their k+1 least ids go on, which is all that can be among the k nearest of any other id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import python_ready, quoted, write_shared

DIMS = 24
SURE = 0.9
#: Rows of a cell, at about, and most cells of the tree. From ``MAX_CELLS * BLOCK_ROWS`` rows on, a cell is cut into blocks by a hash.
CELL_ROWS = 2_048
MAX_CELLS = 8_192
BLOCK_ROWS = 65_536
#: Rows that the splits are fitted on.
SAMPLE = 65_536
FIRST_CELLS = 4
FIRST_ROWS = 64
#: Vectors that are verified at once.
STEP = 64
SEED = 20_117


def chi_square_quantile(p: float, dims: int = DIMS) -> float:
    """By bisection; ``dims`` is even, for which the distribution is a finite sum."""
    cdf = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return hi


def project(vectors: np.ndarray) -> np.ndarray:
    return (vectors.astype("f8") @ np.random.default_rng(SEED).standard_normal((vectors.shape[1], DIMS))).astype("f4")


class KdTree:
    """Median splits on the widest dimension, down to ``cells`` cells. Node i has the children ``kids[i]``, or is cell ``cell[i]``."""

    def __init__(self, points: np.ndarray, cells: int) -> None:
        self.dim, self.cut, self.kids, self.cell = [-1], [0.0], [(-1, -1)], [0]
        open_, n = [(0, points)], 1
        while open_ and n < cells:
            open_.sort(key=lambda x: -len(x[1]))  # the fullest cells split first
            after = []
            for at, own in open_:
                wide = int(np.argmax(np.ptp(own, 0))) if len(own) else 0
                cut = float(np.median(own[:, wide])) if len(own) else 0.0
                left = own[:, wide] <= cut if len(own) else np.empty(0, bool)
                if n >= cells or left.all():
                    continue
                self.dim[at], self.cut[at] = wide, cut
                self.kids[at] = (len(self.dim), len(self.dim) + 1)
                for part in (own[left], own[~left]):
                    after.append((len(self.dim), part))
                    self.dim.append(-1)
                    self.cut.append(0.0)
                    self.kids.append((-1, -1))
                    self.cell.append(0)
                n += 1
            open_ = after
        leaves = [i for i, d in enumerate(self.dim) if d < 0]
        for c, i in enumerate(leaves):
            self.cell[i] = c
        self.cells = len(leaves)

    def place(self, points: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(points), "i4")
        todo = [(0, np.arange(len(points)))]
        while todo:
            at, rows = todo.pop()
            if self.dim[at] < 0:
                out[rows] = self.cell[at]
                continue
            left = points[rows, self.dim[at]] <= self.cut[at]
            todo += [(self.kids[at][0], rows[left]), (self.kids[at][1], rows[~left])]
        return out


class Cell:
    """The rows of one cell, ready for queries."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray) -> None:
        self.ids, self.vectors, self.points = ids, vectors, points.astype("f8")
        self.square = (self.points**2).sum(1)

    def search(self, query: np.ndarray, point: np.ndarray, k: int, bound: float, limit: float) -> tuple[np.ndarray, np.ndarray, int]:
        """(distances, ids) of the k nearest found, by distance, then id, and the number of vectors verified. With an infinite
        ``limit``, the ``FIRST_ROWS`` nearest projections are verified and no others."""
        q, p = query.astype("f8"), point.astype("f8")
        own = float(p @ p)
        near = np.maximum(0.0, self.square - 2 * (self.points @ p) + own)
        slack = 1e-5 * (own + 1e-9)  # rounding of the projections
        if math.isinf(limit):
            rows = np.argpartition(near, FIRST_ROWS - 1)[:FIRST_ROWS] if len(near) > FIRST_ROWS else np.arange(len(near))
        else:
            rows = np.flatnonzero(near <= limit * bound**2 + slack) if math.isfinite(bound) else np.arange(len(near))
            rows = rows[np.argsort(near[rows], kind="stable")]
        best_d, best_id, n = np.empty(0), np.empty(0, "i8"), 0
        while n < len(rows):
            if len(best_d) == k and near[rows[n]] > limit * min(bound, best_d[-1]) ** 2 + slack:
                break
            now = rows[n : n + STEP]
            n += len(now)
            gap = self.vectors[now].astype("f8") - q
            d = np.concatenate([best_d, np.sqrt((gap * gap).sum(1))])
            i = np.concatenate([best_id, self.ids[now]])
            top = np.lexsort((i, d))[:k]
            best_d, best_id = d[top], i[top]
        return best_d, best_id, n


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors) for each length."""
    size = column.value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, _matrix(column.take(pa.array(rows)))


def projections(rows: DataFrame) -> DataFrame:
    """(point) of each row's vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, v in _by_length(b.column("vector")):
                yield pa.RecordBatch.from_arrays([_lists(project(v))], ["point"])

    return rows.select("vector").mapInArrow(run, "point array<float>")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype="i4") * x.shape[1]), pa.array(x.ravel()))


def placed(rows: DataFrame, tree: KdTree) -> DataFrame:
    """``rows`` (id, vector) with dim, cell and point."""
    sent = rows.sparkSession.sparkContext.broadcast(tree)  # bounded by MAX_CELLS
    kind = rows.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for own, v in _by_length(b.column("vector")):
                part, p = b.take(pa.array(own)), project(v)
                cols = [part.column("id"), part.column("vector"), pa.array(np.full(len(own), v.shape[1], "i4")), pa.array(sent.value.place(p)), _lists(p)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "vector", "dim", "cell", "point"])

    return rows.select("id", "vector").mapInArrow(run, f"id long, vector {kind}, dim int, cell int, point array<float>")


def boxes_of(points: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """dimension → (cells, least and greatest corner of each cell's points); at most ``MAX_CELLS`` rows for each dimension."""
    corners = [f(F.col("point")[i]).alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(DIMS)]
    found: dict[int, list] = {}
    for r in points.groupBy("dim", "cell").agg(*corners).collect():
        found.setdefault(r["dim"], []).append(r[1:])
    out = {}
    for dim, rows in found.items():
        x = np.array(sorted(rows), "f8")
        out[dim] = (x[:, 0].astype("i4"), x[:, 1 : 1 + DIMS], x[:, 1 + DIMS :])
    return out


def routed(queries: DataFrame, boxes: dict, limit: float | None) -> DataFrame:
    """(query, vector, dim, cell, point, bound) for each cell that a query visits: the nearest few if ``limit`` is None, else those
    whose box the stopping test doesn't rule out."""
    sent = queries.sparkSession.sparkContext.broadcast(boxes)
    kind = queries.schema["vector"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims, points, bounds = b.column("dim").to_pylist(), _matrix(b.column("point")), b.column("bound").to_numpy()
            for i, p in enumerate(points.astype("f8")):
                cells, lo, hi = sent.value[dims[i]]
                gap = (np.maximum(0, np.maximum(lo - p, p - hi)) ** 2).sum(1)
                if limit is None:
                    middle = ((0.5 * (lo + hi) - p) ** 2).sum(1)
                    visit = cells[np.lexsort((middle, gap))[:FIRST_CELLS]]
                else:
                    visit = cells[gap <= limit * bounds[i] ** 2 + 1e-5 * (float(p @ p) + 1e-9)]
                row = b.slice(i, 1).take(pa.array(np.zeros(len(visit), "i4")))
                yield pa.RecordBatch.from_arrays([*[row.column(c) for c in ("id", "vector", "dim")], pa.array(visit), row.column("point"), row.column("bound")], ["id", "vector", "dim", "cell", "point", "bound"])

    return queries.select("id", "vector", "dim", "point", "bound").mapInArrow(run, f"id long, vector {kind}, dim int, cell int, point array<float>, bound double")


def searched(points: DataFrame, queries: DataFrame, blocks: int, k: int, limit: float) -> DataFrame:
    """(query, id, score, verified) of the k nearest that each visited cell has; ``verified`` repeats the cell's count."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    left = points.select("dim", "cell", block.alias("block"), F.lit(0).alias("kind"), "id", "vector", "point", F.lit(0.0).alias("bound"))
    right = queries.select("dim", "cell", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "vector", "point", "bound")
    both = left.union(right).repartition("dim", "cell", "block").sortWithinPartitions("dim", "cell", "block", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, cell = None, [], None
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("dim", "cell", "block", "kind")], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), len(keys)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                part, now = b.slice(start, end - start), tuple(keys[start, :3]) if start < len(keys) else key
                if start == end:
                    continue
                if now != key:
                    key, held, cell = now, [], None
                ids, vectors, p = part.column("id").to_numpy(), _matrix(part.column("vector")), _matrix(part.column("point"))
                if keys[start, 3] == 0:
                    held.append((ids, vectors, p))
                elif held or cell:
                    if cell is None:
                        cell, held = Cell(*[np.concatenate(x) for x in zip(*held, strict=True)]), []
                    found = [cell.search(q, x, k, bound, limit) for q, x, bound in zip(vectors, p, part.column("bound").to_numpy(), strict=True)]
                    size = [len(d) for d, _, _ in found]
                    cols = [np.repeat(ids, size), np.concatenate([i for _, i, _ in found]), np.concatenate([d for d, _, _ in found]), np.repeat(np.array([n for _, _, n in found], "i8"), size)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query", "id", "score", "verified"])

    return both.mapInArrow(run, "query long, id long, score double, verified long")


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zero (nor empty)."""
    inf = F.lit(float("inf"))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def fitted_tree(rows: DataFrame, n: int, cell_rows: int) -> KdTree:
    cells = max(1, min(MAX_CELLS, math.ceil(n / cell_rows)))
    share = min(1 << 20, math.ceil((1 << 20) * SAMPLE / max(1, n)))
    sample = rows.where(F.pmod(F.xxhash64(F.lit(SEED), "id"), F.lit(1 << 20)) < share).limit(2 * SAMPLE)  # the hash gives half of that
    points = [r["point"] for r in projections(sample).collect()] if cells > 1 else []
    return KdTree(np.array(sorted(points), "f4").reshape(-1, DIMS), cells)


def neighbours_by_class(points: DataFrame, classes: DataFrame, k: int, n: int, cell_rows: int) -> DataFrame:
    """(query, id, score, verified): what both visits found for each of ``classes`` (id, vector) among ``points``; a pair that both found
    is there twice."""
    tree = fitted_tree(points, n, cell_rows)
    points = write_shared(placed(points, tree), "ann-points")
    classes = write_shared(placed(classes, tree), "ann-queries")
    boxes, blocks = boxes_of(points), max(1, math.ceil(n / (MAX_CELLS * BLOCK_ROWS)))
    classes = classes.where(F.col("dim").isin(list(boxes))) if boxes else classes.limit(0)
    first = write_shared(searched(points, routed(classes.withColumn("bound", F.lit(math.inf)), boxes, None), blocks, k, math.inf), "ann-first")
    kth = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    bounds = first.select("query", "score", kth.alias("rank")).where(F.col("rank") <= k).groupBy("query").agg(F.max("score").alias("score"), F.count("*").alias("n"))
    bounds = write_shared(bounds.select(F.col("query").alias("id"), F.when(F.col("n") == k, F.col("score")).otherwise(math.inf).alias("bound")), "ann-bounds")
    limit = chi_square_quantile(SURE)
    known = classes.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", F.lit(math.inf)))
    return first.union(searched(points, routed(known, boxes, limit), blocks, k, limit))


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", cell_rows: int = CELL_ROWS) -> DataFrame:
    """For each id of ``vectors`` where ``is_query`` holds, its ``k`` nearest others found, of at least 9 in 10 on average:
    query_id, rank (from 1), vec_id, score (the Euclidean distance in double precision).

    Candidates are all ids but the query's own. Ties go to the smaller id. Vectors that are null, zero or
    empty, or hold null or non-finite components, take no part, nor do rows with a null id; vectors of different lengths
    don't meet. A query with fewer candidates gets all of them, one without any no row. Rows repeated with one id are one
    candidate and one query, with the least of their usable vectors in array order. Other columns are ignored.
    """
    python_ready(vectors.sparkSession)
    fine = vectors.where(F.col(quoted(id_col)).isNotNull() & usable(F.col(quoted(vector_col))))
    rows = fine.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(vector_col)).alias("vector"), is_query.alias("q"))
    rows = rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("q").alias("q")).withColumn("h", F.xxhash64("vector"))
    rows = write_shared(rows, "ann-rows")
    copies = F.row_number().over(Window.partitionBy("h", "vector").orderBy("id"))
    points = write_shared(rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("id", "vector"), "ann-candidates")
    asked = rows.where("q")
    classes = write_shared(asked.groupBy("h", "vector").agg(F.min("id").alias("id")), "ann-classes")
    found = neighbours_by_class(points, classes.select("id", "vector"), k + 1, points.count(), cell_rows)
    rank = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    found = write_shared(found.groupBy("query", "id").agg(F.min("score").alias("score")).withColumn("rank", rank).where(F.col("rank") <= k + 1).select("query", "id", "score"), "ann-found")
    queries = asked.select("h", "vector", F.col("id").alias("query_id")).join(classes.withColumnRenamed("id", "query"), ["h", "vector"]).select("query_id", "query")
    each = queries.join(found, "query").where("id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "id"))
    return each.select("query_id", rank.alias("rank"), F.col("id").alias("vec_id"), "score").where(F.col("rank") <= k)
