"""The pipeline against a brute-force version, stage by stage."""

from __future__ import annotations

import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
pytest.importorskip("public_tokenizers")

import corpus_pipeline as cp  # noqa: E402
from corpusseek.llm import secret_scan as ss  # noqa: E402
from corpusseek.llm import toxicity as tx  # noqa: E402

from .test_learned import brute_near  # noqa: E402
from .test_native import lower  # noqa: E402
from .test_tokens import check_packing, ids_of  # noqa: E402


def test_stages(spark, sf_dir):
    assert [n for n, _ in cp.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}

    model = tx.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scores = dict(zip(rows, model.scores(tx.terms([t.encode() for t in rows.values()])), strict=True))
    rows = {i: t for i, t in rows.items() if scores[i] < cp.TOXIC}
    last = {}
    for i in sorted(rows):
        last[lower(rows[i])] = i
    rows = {i: t for i, t in rows.items() if last[lower(t)] == i}
    rows = {i: rows[i] for i, _, c in brute_near(sorted(rows.items()), cp.NEAR) if c == i}
    near = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    guess = ss.GuessCost(ss.ranked_words(near, cp.tokenizer_path()))
    rows = {i: ss.redact(t, ss.all_spans(t, guess)) for i, t in rows.items()}

    for _, stage in cp.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), docs.schema)
        assert docs.columns == columns
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == rows
    assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    n = check_packing(cp.STAGES[-1][1](spark, docs, sf_dir).collect(), {i: ids_of(t) for i, t in rows.items()}, 1024, 2)
    assert n == len({r["sequence_id"] for r in cp.run(spark, sf_dir).collect()})


def test_odd_documents(spark, tmp_path):
    """Nulls, empty texts and repeated rows pass through every stage."""
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "a b c", None, None, None), (3, "a b c", None, None, None), (None, "null id", "en", "s", 7), (5, "x " * 30_000, "en", "s", 60_000)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {2, 3, None, 5}
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0
