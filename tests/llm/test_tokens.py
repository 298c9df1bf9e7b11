"""BPE, packing and sharding."""

from __future__ import annotations

import hashlib
import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
public_tokenizers = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from corpusseek.llm import bpe as bp  # noqa: E402
from corpusseek.llm import packing as pk  # noqa: E402
from corpusseek.llm import sharding as sh  # noqa: E402
from corpusseek.llm.bpe import Bpe, decode_tokens, encode_tokens, round_trip  # noqa: E402

PATH = public_tokenizers.path("byte_bpe_50k.json")
OWN, THEIRS = Bpe(PATH), tokenizers.Tokenizer.from_file(PATH)
ROWS = [(1, "Hello world"), (2, None), (3, ""), (4, " \n\n x  "), (None, "naïve <|endoftext|> 日本語"), (4, "a" * 9000), (5, " " * 3000 + "x"), (6, "it's 12,345 o'clock")]


def ids_of(text):
    return THEIRS.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["the", " ", "  ", "\n", "'s", "İ", "é", "<|endoftext|>", "<|end", "123", "\x1c", "\u2028", "word", "🙂", "aaaa", "\x00"]), max_size=12))
def test_bpe_like_the_library(parts):
    text = "".join(parts)
    ids = OWN.encode(text).tolist()
    assert ids == ids_of(text)
    assert OWN.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_bpe_any_text(text):
    assert OWN.encode(text).tolist() == ids_of(text)
    assert pk.fast_encoder(PATH)(text).tolist() == ids_of(text)


def test_bpe_every_character():
    for at in range(0, 0x110000, 4096):
        text = "".join(f"a{chr(c)} {chr(c)}{chr(c)}b " for c in range(at, at + 4096) if not 0xD800 <= c < 0xE000)
        if text:
            assert OWN.encode(text).tolist() == ids_of(text), hex(at)
            assert pk.fast_encoder(PATH)(text).tolist() == ids_of(text), hex(at)


def test_bpe_merges_new_words_together(monkeypatch):
    """Words of up to ``MEMO_BYTES`` aren't merged one by one; only longer ones are, and a worker builds one encoder."""
    own, alone = Bpe(PATH), []
    one_by_one = own.merge
    monkeypatch.setattr(own, "merge", lambda w: alone.append(w) or one_by_one(w))
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeinrstlothéß日"), n)) for n in rng.integers(1, 21, 3000)] + ["a" * n for n in range(1, 70)]
    text = " ".join(words)
    assert own.encode(text).tolist() == ids_of(text)
    assert {len(w) for w in alone} == {65, 66, 67, 68, 69, 70}
    assert bp.encoder(PATH) is bp.encoder(PATH)


@pytest.mark.parametrize(("lot", "trees", "memo"), [(1, 1, 0), (7, 3, 500), (50, 4096, 1 << 20)])
def test_bpe_in_lots(monkeypatch, lot, trees, memo):
    """Whatever is looked up at once and remembered, the ids are the same: texts smaller and larger than a lot, with special tokens."""
    monkeypatch.setattr(bp, "LOT", lot)
    monkeypatch.setattr(bp, "TREES", trees)
    monkeypatch.setattr(bp, "MEMO_SIZE", memo)
    texts = [t or "" for _, t in ROWS] + ["", "the <|endoftext|><|endoftext|> end", "one two, three! " * 20, "b" * 64 + " " + "c" * 65, ""] * 2
    own = Bpe(PATH)
    assert [x.tolist() for x in own.encode_all(texts)] == [ids_of(t) for t in texts]
    assert list(own.encode_all([])) == []


def test_bpe_decodes_broken_bytes():
    ids = OWN.encode("é").tolist() + [OWN.first[0xE9]]
    assert OWN.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_bpe_operators(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in ROWS], "doc_id long, text string, ids string")
    got = Counter(tuple(r) for r in round_trip(df, PATH).collect())
    want = Counter()
    for i, t in ROWS:
        ids = np.array(ids_of(t), "<u4")
        want[(i, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    assert got == want
    tokens = encode_tokens(df, PATH)
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in tokens.collect()) == Counter((i, tuple(ids_of(t))) for i, t in ROWS)
    assert Counter(tuple(r) for r in decode_tokens(tokens, PATH).collect()) == Counter((i, t or "") for i, t in ROWS)
    assert round_trip(df.limit(0), PATH).count() == 0


def check_packing(rows, ids, size, end_id):
    """Every document whole, every sequence gapless and within its size."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, pieces in docs.items():
        full, at = ids[i] + [end_id], 0
        for k, r in enumerate(sorted(pieces, key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (k == 0 or r["length"] == size)
            assert r["ids_crc32"] == zlib.crc32(np.array(full[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(full) and len(pieces) == -(-len(full) // size)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return len(sequences)


@pytest.mark.parametrize("small", [True, False])
def test_packing(spark, monkeypatch, small):
    monkeypatch.setattr(pk, "BROADCAST_ROWS", 10**6 if small else 0)
    texts = {i: ("word " * (i * 7 % 40)) or None for i in range(150)} | {200: "x y " * 700, 201: ""}
    df = spark.createDataFrame([(i, t, 0) for i, t in texts.items()], "doc_id long, text string, piece int").repartition(5)
    rows = pk.pack(df, PATH, size=64, with_ids=True).collect()
    ids = {i: ids_of(t) for i, t in texts.items()}
    n = check_packing(rows, ids, 64, 2)
    total = sum(len(x) + 1 for x in ids.values())
    assert -(-total // 64) <= n <= -(-total // 64) + 2
    assert all(len(r["ids"]) == r["length"] for r in rows)


def test_packing_odd_rows(spark):
    df = spark.createDataFrame([(None, "a"), (None, None), (1, "b"), (1, "b")], "doc_id long, text string")
    rows = pk.pack(df, PATH).collect()
    assert Counter(r["doc_id"] for r in rows) == {None: 2, 1: 2} and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4
    assert pk.pack(df.limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_plan_uses_every_piece(lengths):
    counts = np.bincount(lengths, minlength=33)
    plan = pk.plan(counts)
    used = Counter()
    for times, parts in plan:
        assert times > 0 and sum(parts) <= 32
        used.update({x: n * times for x, n in Counter(parts).items()})
    assert used == Counter(lengths)
    keys, table = pk.places(plan, 32)
    seen = set()
    for x, n in Counter(lengths).items():
        for rank in range(n):
            first, copies, seq, off = table[np.searchsorted(keys, (x << pk.SHIFT) + rank, "right") - 1]
            seen |= {(seq + (rank - first) // copies, off + (rank - first) % copies * x + k) for k in range(x)}
    assert len(seen) == sum(lengths)


def test_plan_finds_exact_complements():
    assert sum(t for t, _ in pk.plan(np.bincount([600] * 5 + [400] * 5 + [24] * 5, minlength=1025))) == 5
    assert sum(t for t, _ in pk.plan(np.bincount([700] * 9 + [324] * 4 + [200] * 5 + [124] * 5, minlength=1025))) == 9


def test_cut():
    assert pk.cut(10, 4) == [(0, 2), (2, 4), (6, 4)] and pk.cut(8, 4) == [(0, 4), (4, 4)] and pk.cut(3, 4) == [(0, 3)] and pk.cut(0, 4) == []


def test_sharding_table():
    shards = [f"s{i}" for i in range(7)]
    table = sh.fill_table(shards, 1009)
    shares = Counter(table)
    assert set(table) == set(range(7)) and max(shares.values()) - min(shares.values()) <= 1
    after = sh.fill_table(shards[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, after, strict=True) if a != 6)
    assert moved < 0.25 * 1009  # keys of the shards that stay mostly stay
    for bad in ([], ["a", "a"]):
        with pytest.raises(ValueError):
            sh.fill_table(bad, 1009)
    with pytest.raises(ValueError):
        sh.fill_table(["a"], 1000)


def test_sharding_places_by_preference():
    """Brute force: the turns as they are described."""
    shards, size = ["a", "b", "c"], 13
    prefs = []
    for s in shards:
        d = hashlib.sha256(s.encode()).digest()
        offset, step = int.from_bytes(d[:8], "little") % size, int.from_bytes(d[8:16], "little") % (size - 1) + 1
        prefs.append([(offset + step * j) % size for j in range(size)])
    want: dict[int, int] = {}
    while len(want) < size:
        for i, p in enumerate(prefs):
            if len(want) < size:
                want[next(x for x in p if x not in want)] = i
    assert sh.fill_table(shards, size) == [want[i] for i in range(size)]


def test_sharding(spark, tmp_path):
    df = spark.createDataFrame([(i, "t", 9) for i in range(500)] + [(None, "t", 9), (None, "u", 9), (3, "v", 9)], "doc_id long, text string, slot int")
    out = sh.assign_shards(df, shards=["a", "b", "c"], size=101)
    rows = out.collect()
    table = sh.fill_table(["a", "b", "c"], 101)
    for r in rows:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        slot = int(hashlib.sha256(key.encode()).hexdigest()[:15], 16) % 101
        assert (r["slot"], r["shard"]) == (slot, table[slot])
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    sh.write_shards(df.drop("slot"), str(tmp_path / "out"), shards=["a", "b", "c"], size=101, files=2)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)
    assert sh.assign_shards(df.limit(0)).count() == 0
