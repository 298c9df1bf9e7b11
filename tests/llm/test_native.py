"""Exact and line deduplication, URL filters: against brute force, with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusseek.llm import exact_dedup as ed
from corpusseek.llm import line_dedup as ld
from corpusseek.llm import url_filter as uf

PYTHON = ("Python", "Pandas", "Arrow")
TEXTS = [None, "", "abc", "ABC", "aBc", "Äb", "äb", "ÄB", "İ", "x\ny", "X\nY", "a" * 5000, "A" * 5000]


def lower(t: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def doc_rows(spark, rows):
    """With columns that clash with those of the operators."""
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, kept int, h string")


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[lower(t)].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in groups[lower(t)] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(groups[lower(t)]), i == keep, hashlib.sha256(lower(t).encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("capacity", "inline"), [(2, 16), (2, 1), (1000, 16)])
def test_exact_dedup(spark, monkeypatch, capacity, inline):
    monkeypatch.setattr(ed, "INLINE_DEPTH", inline)
    rng = random.Random(capacity)
    rows = [(i, rng.choice(TEXTS)) for i in range(60)] + [(100 + i, f"unique {i}") for i in range(40)]
    rows += [(None, "abc"), (None, None), (None, "only null"), (5, "abc"), (5, "abc"), (7, "unique 3")]
    out = ed.exact_dedup(doc_rows(spark, rows), capacity=capacity)
    got = Counter(tuple(r) for r in out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())
    assert got == brute_exact(rows)
    assert not any(p in plan_of(out) for p in PYTHON)


def test_exact_dedup_empty(spark):
    assert ed.exact_dedup(doc_rows(spark, [])).count() == 0
    assert ed.drop_copies(doc_rows(spark, [])).count() == 0


def test_directory_splits(spark):
    hashes = spark.range(3000).select(F.xxhash64("id").alias("h"))
    directory, depth = ed.grow_directory(hashes, 3000, 100)
    rows = directory.collect()
    assert len({r["slot"] for r in rows}) == len(rows) <= 1 << depth  # every slot belongs to one bucket
    counts = [r["count"] for r in ed.with_bucket(hashes, directory, depth).groupBy("bucket").count().collect()]
    assert sum(counts) == 3000 and max(counts) <= 100 and len(counts) > 30 and len({r["bucket"] for r in rows}) == len(counts)
    assert len(rows) > len(counts)  # some buckets have several slots


def test_owners_decide(spark, monkeypatch):
    """Texts with equal hashes meet in one chain, where bytes part them; hot ones arrive combined."""
    monkeypatch.setattr(ed.F, "xxhash64", lambda *c: F.shiftleft(F.length(c[0]).cast("long"), 58))
    monkeypatch.setattr(ed, "HOT_ROWS", 5)
    rows = [(i, "same") for i in range(20)] + [(20 + i, f"tx{i:02d}") for i in range(10)] + [(40, "SAME"), (41, "long text"), (42, None)]
    out = ed.exact_dedup(doc_rows(spark, rows), capacity=1)
    got = out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert Counter(tuple(r) for r in got.collect()) == brute_exact(rows)
    chains = out.where("length(text_sha256) > 0").groupBy("bucket").agg(F.countDistinct("chain").alias("n")).collect()
    assert sorted(r["n"] for r in chains) == [1, 1, 11]


@pytest.mark.parametrize("extra", [[], [(None, "abc"), (None, "zzz"), (None, "zzz"), (3, "other"), (3, "third"), (1, "abc")]])
def test_drop_copies(spark, extra):
    rows = [(1, "abc"), (2, "ABC"), (3, "def"), (4, None), (5, "")] + extra
    got = ed.drop_copies(doc_rows(spark, rows))
    assert got.columns == ["doc_id", "text", "kept", "h"]
    texts = [lower(r["text"]) for r in got.collect()]
    assert sorted(texts) == sorted({lower(t) for _, t in rows})
    keep = {lower(t): max([i for i, u in rows if lower(u) == lower(t) and i is not None], default=None) for _, t in rows}
    assert all(r["doc_id"] == keep[lower(r["text"])] for r in got.collect())


def brute_lines(rows, least, chars):
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    seen = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")})
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < chars or seen[key(x)] < least]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize(("least", "chars"), [(2, 1), (3, 1), (2, 0), (1, 1)])
def test_line_dedup(spark, least, chars):
    rng = random.Random(least)
    pool = ["", " ", "a line", "A LINE\t", "\x0bÄ line", "ä line", "z\r", "other", "\u00a0nbsp"]
    rows = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(20)]
    rows += [(None, "a line\nx"), (None, None), (3, "a line"), (3, "a line"), (50, ""), (51, "one\n" * 3000)]
    out = ld.line_dedup(doc_rows(spark, rows), min_docs=least, min_chars=chars)
    assert Counter(tuple(r) for r in out.collect()) == brute_lines(rows, least, chars)
    assert not any(p in plan_of(out) for p in PYTHON)


def test_line_dedup_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(ld, "BROADCAST_KEYS", 0)
    rows = [(i, "same\nown %d" % i) for i in range(5)]
    assert Counter(tuple(r) for r in ld.line_dedup(doc_rows(spark, rows), min_docs=3).collect()) == brute_lines(rows, 3, 1)


def test_line_dedup_empty(spark):
    assert ld.line_dedup(doc_rows(spark, [])).count() == 0


RULES = [uf.Rule("net/", "block"), uf.Rule("example.net/en/", "allow"), uf.Rule("example.com/de/", "block"), uf.Rule("org/fr/", "allow"), uf.Rule("a-b.org/x", "block")]
URLS = [
    None, "", "no scheme", "http://net/", "http://a.net", "http://a.net/", "https://EXAMPLE.net/en/1", "http://xexample.net/en/", "http://m.example.com/de/7?x=/de/",
    "http://example.com/DE/", "http://b.org/fr/#a", "http://b.org/frx/", "http://a-b.org/xyz", "http://aab.org/x", "http://a-b.org:80/x", "x://y://example.net/en/",
    "http://example.net?/en/", "http://example.net/en", "://net/", "http://a.net/\u00e9",
]


def brute_url(url, rules):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = rest
    for c in "/?#":
        host = host.partition(c)[0]
    path = rest[len(host) :]
    for c in "?#":
        path = path.partition(c)[0]
    host = lower(host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best.text if best else None, best.verdict if best else "allow"


@pytest.mark.parametrize("chunk", [1, 20_000])
def test_url_filter(spark, monkeypatch, chunk):
    monkeypatch.setattr(uf, "RULES_PER_INDEX", chunk)
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(None, "http://a.net/", "c"), (3, "http://net/", "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    out = uf.url_filter(df, RULES)
    assert Counter(tuple(r) for r in out.collect()) == Counter((i, *brute_url(u, RULES)) for i, u, _ in rows)
    assert not any(p in plan_of(out) for p in PYTHON)
    assert uf.url_filter(df.limit(0), RULES).count() == 0
    assert uf.url_filter(df, []).where("verdict <> 'allow'").count() == 0


def test_rarest_token(spark):
    df = spark.createDataFrame([(["example", "com"],), (["com", "de"],), (["com"],)], "tokens array<string>")
    assert uf.rarest_tokens(df, [uf.Rule("example.com/de/", "block")]) == {uf.Rule("example.com/de/", "block"): "de"}
    assert uf.Rule("example.com/de", "block").tokens == ["com", "example"]  # a prefix may end within a token
