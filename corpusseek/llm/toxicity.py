"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(w0 + sum of w over a text's terms + sum of <v_i, v_j> over its pairs of terms): the pairs catch what additive
weights miss, such as an insult next to the mention of a group. A text's terms are its distinct words (runs of letters, A-Z
lower-cased) and their leading bytes, so that unseen words built on a known stem count too, hashed into 2^18 buckets, from
the whole text.

The model is fitted on the driver on at most ``TRAIN_DOCS`` labelled documents and ``TRAIN_BYTES`` of their terms, those with the
smallest hash of their id; it has a fixed size (about 5 MB), so it can be broadcast whatever the data. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import python_ready, quoted, write_shared
from .textops import LETTERS, words_by_text

BITS = 18
RANK = 4
#: Lengths in bytes of the stems that are terms beside the whole words.
PREFIXES = (4, 6)
#: The bound of the training sample, in labelled rows.
TRAIN_DOCS = 15_000
#: And in bytes of their hashed terms, four each.
TRAIN_BYTES = 64 << 20
#: Terms in fewer documents of the sample get no weight.
MIN_DOCS = 3
#: Terms whose count among toxic texts is so many standard deviations from what chance gives are fitted first. All others join
#: them afterwards, on the errors that are left and under a stronger decay: a term may tell only beside another, but hundreds of
#: neutral ones in each text would otherwise learn the sample by heart.
MIN_DEVIATION = 3.5
EPOCHS = 40
SHRINK = 0.03
#: Steps over all terms from which on a larger sample is passed over less often.
STEPS = 600


def terms(texts: list[bytes]) -> list[np.ndarray]:
    """The distinct hashed terms of each text, sorted."""
    out: list[np.ndarray] = []
    for _, h, ends in words_by_text(texts, LETTERS, PREFIXES):
        count = np.diff(ends, prepend=0)
        key = np.unique(np.repeat(np.arange(len(ends), dtype="u8"), count) << np.uint64(32) | h >> np.uint64(64 - BITS))
        cuts = np.searchsorted(key, np.arange(1, len(ends), dtype="u8") << np.uint64(32))
        out += [(k & np.uint64(0xFFFFFFFF)).astype("i4") for k in np.split(key, cuts)]
    return out


@dataclass
class Model:
    bias: float
    weights: np.ndarray  # 2^BITS
    factors: np.ndarray  # 2^BITS x RANK

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        """A text without terms gets the bias alone."""
        out = np.full(len(docs), self.bias, "f8")
        for i, d in enumerate(docs):
            if len(d):
                v = self.factors[d].astype("f8")
                s = v.sum(0)
                out[i] += self.weights[d].sum(dtype="f8") + 0.5 * float(s @ s - (v * v).sum())
        return 1 / (1 + np.exp(-np.clip(out, -40, 40)))


@dataclass
class Batch:
    """Rows of the sample, and the rows of each of their terms: a byte a pair, as the driver has little room."""

    labels: np.ndarray
    value: np.ndarray
    of: np.ndarray  # rows, term after term
    own: np.ndarray  # the distinct terms
    heads: np.ndarray  # where each begins in ``of``


def batches_of(docs: list[np.ndarray], labels: np.ndarray, value: np.ndarray, rows: np.ndarray, size: int) -> list[Batch]:
    out = []
    for at in range(0, len(rows), size):
        now = rows[at : at + size]
        count = np.array([len(docs[i]) for i in now])
        flat = np.concatenate([docs[i] for i in now])
        if not len(flat):
            continue
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        heads = np.flatnonzero(np.diff(flat, prepend=-1)).astype("i4")
        of = np.repeat(np.arange(len(now), dtype="u1" if size <= 256 else "i4"), count)
        out.append(Batch(labels[now], value[now], of[order], flat[heads], heads))
    return out


def descend(batches: list[Batch], state: dict[str, np.ndarray], pull: np.ndarray, epochs: int, rate: float, rng: np.random.Generator) -> None:
    """AdaGrad over the batches, in another order in each epoch, with steps that shrink to nothing at the end. ``state`` has bias b, weights w, factors v and their squared steps."""
    w, v, gw, gv = (state[k] for k in ("w", "v", "gw", "gv"))
    whole = rate
    for epoch in range(epochs):
        for done, i in enumerate(rng.permutation(len(batches))):
            x, rate = batches[i], whole * (1 - (epoch + done / len(batches)) / epochs)
            n, own = len(x.labels), x.own
            times = np.diff(x.heads, append=len(x.of))
            z = np.zeros(n, "f4")
            linear = w[own]
            mine, sums = [], []
            for vk in v:  # a factor at a time: sums over runs of a flat array are much faster than over rows of a matrix
                vi = np.repeat(vk[own], times)
                total = np.bincount(x.of, vi, n).astype("f4")
                linear -= 0.5 * vk[own] * vk[own]
                z += 0.5 * total * total
                mine.append(vi)
                sums.append(total)
            z += np.bincount(x.of, np.repeat(linear, times), n).astype("f4")
            err = ((1 / (1 + np.exp(-np.clip(z + state["b"], -40, 40))) - x.labels) * x.value / n).astype("f4")
            e, decay = err[x.of], pull[own]
            step = np.add.reduceat(e, x.heads) + decay * w[own]
            gw[own] += step**2
            w[own] -= rate * step / np.sqrt(gw[own])
            for vk, gk, vi, total in zip(v, gv, mine, sums, strict=True):
                step = np.add.reduceat((err * total)[x.of] - e * vi, x.heads) + decay * vk[own]
                gk[own] += step**2
                vk[own] -= rate * step / np.sqrt(gk[own])
            step = float(err.sum())
            state["gb"] += step**2
            state["b"] -= rate * step / np.sqrt(state["gb"])


def fit(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.1, decay: float = 1e-4, shrink: float = SHRINK, balance: float = 1.0, seed: int = 7, batch: int = 256, rank: int = RANK, steps: int = STEPS) -> Model:
    """Log loss by AdaGrad on small batches; ``balance`` 1 gives both classes equal total weight, 0 each row. ``epochs`` pass over
    the terms that tell alone; then as many, or at least ``steps`` steps, over all, with ``shrink`` as the others' decay. Without a row of each class, the model
    knows only the labels' mean. ``rank`` 0 is a linear model."""
    size = 1 << BITS
    share = float(labels.mean()) if len(labels) else 0.0
    model = Model(float(np.log((share + 1e-3) / (1 - share + 1e-3))), np.zeros(size, "f4"), np.zeros((size, rank), "f4"))
    if not 0 < share < 1:
        return model
    rng = np.random.default_rng(seed)
    count, toxic = np.zeros(size, "i4"), np.zeros(size, "i4")
    for d, y in zip(docs, labels, strict=True):  # a document's terms are distinct
        count[d] += 1
        toxic[d] += y == 1
    used = np.flatnonzero(count >= MIN_DOCS)
    count, toxic = count[used], toxic[used]
    alone = np.abs(toxic - share * count) >= MIN_DEVIATION * np.sqrt(share * (1 - share) * count)
    place = np.full(size, -1, "i4")
    place[used] = np.arange(len(used), dtype="i4")
    docs = [p[p >= 0] for p in (place[d] for d in docs)]
    value = (1 - balance) + balance * np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    state = {"w": np.zeros(len(used), "f4"), "v": rng.normal(0, 0.02, (rank, len(used))).astype("f4"), "gw": np.full(len(used), 1e-2, "f4"), "gv": np.full((rank, len(used)), 1e-2, "f4"), "b": 0.0, "gb": 1e-2}
    rows = rng.permutation(len(docs))
    descend(batches_of([d[alone[d]] for d in docs], labels, value, rows, batch), state, np.full(len(used), decay, "f4"), epochs, rate, rng)
    every = batches_of(docs, labels, value, rows, batch)
    del docs
    descend(every, state, np.where(alone, decay, shrink).astype("f4"), min(epochs, 1 + steps // max(1, len(every))), rate, rng)
    model.bias, model.weights[used], model.factors[used] = float(state["b"]), state["w"], state["v"].T
    return model


def remainder(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; 0 means held out."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, bound: int, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(label, terms) of at most ``bound`` labelled documents that aren't held out, with at most ``most_bytes`` of terms. Of several
    labels of one id the largest counts, and of several rows the one with the least terms; null ids and labels are left out."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (remainder(F.col(id_col)) != 0))
    chosen = known.groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("id"), "id").limit(bound)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = terms([t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([f.tobytes() for f in found], pa.binary())], ["id", "label", "terms"])

    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "label", "text").mapInArrow(run, f"id {kind}, label int, terms binary")
    one = write_shared(found.groupBy("id", "label").agg(F.min("terms").alias("terms")).withColumn("place", F.xxhash64("id")), "toxic-sample", bound)
    total, last = 0, None  # at most ``bound`` sizes
    for r in one.select("place", F.octet_length("terms").alias("n")).orderBy("place", "id").toLocalIterator():
        total += r["n"]
        if total > most_bytes:
            last = r["place"]
            break
    return (one if last is None else one.where(F.col("place") < last)).select("label", "terms")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", bound: int = TRAIN_DOCS) -> Model:
    python_ready(docs.sparkSession)
    rows = list(labelled_sample(docs, labels, id_col, text_col, label_col, bound).toLocalIterator())  # a file at a time in the JVM
    rows.sort(key=lambda r: (zlib.crc32(r["terms"]), r["label"]))  # the same model however the rows arrive
    sample, known = [np.frombuffer(r["terms"], "i4") for r in rows], np.array([r["label"] for r in rows], "f8")
    del rows
    held = [sample]
    del sample
    return fit(held.pop(), known)  # fit() alone holds the sample, and lets go of it


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, score_col: str = "score") -> DataFrame:
    """One row per row of ``docs``: id (or all columns, if ``keep``) and ``score_col`` from 0 to 1, which replaces a column of this
    name. Null text counts as empty; empty texts get the model's bias. Ids may be null or repeat."""
    spark = docs.sparkSession
    python_ready(spark)
    sent = spark.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c != score_col] if keep else [id_col]
    read = cols if text_col in cols else [*cols, text_col]  # a text goes to Python once
    at = read.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(at).cast(pa.binary()).to_pylist()]
            scores = sent.value.scores(terms(texts))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(scores)], names)

    names = [f"c{i}" for i in range(len(cols) + 1)]  # mapInArrow takes no names with dots
    schema = StructType([StructField(n, docs.schema[c].dataType) for n, c in zip(names, cols, strict=False)] + [StructField(names[-1], DoubleType())])
    return docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(read)]).mapInArrow(run, schema).toDF(*cols, score_col)
