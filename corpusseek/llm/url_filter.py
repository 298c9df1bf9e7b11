"""URL filtering by an index of pattern rules (DataFrame functions only).

Each rule is filed under its rarest literal token, counted over the URLs at hand. A URL's tokens fetch candidate rules by
one look-up each, and only candidates run their regular expressions. The index is a constant of buckets in the plan, so the
URLs are not shuffled: the only shuffle is that of the token counts, at most one row for each token of the rules and task.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, text_or_empty

#: So many rules go into one index; more are split over several, each looked up in turn.
RULES_PER_INDEX = 20_000
TOKEN = "[A-Za-z0-9]+"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host, then a path prefix that starts with ``/``; ``verdict`` is allow or block."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0].lower()

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]

    @property
    def pattern(self) -> str:
        """Over host and path together; a host has no slash, so the path begins at the first one."""
        literal = lambda s: "".join(c if c.isalnum() and c.isascii() else f"[{c}]" if c not in "^\\[]&" else "\\" + c for c in s)
        return f"(?s)^(?:[^/]*[.])?{literal(self.host)}{literal(self.path)}"

    @property
    def tokens(self) -> list[str]:
        """Whole tokens only: a path prefix may end inside a token of the URL, so its last one doesn't count."""
        whole = self.host + self.path
        return sorted({m[0] for m in re.finditer(TOKEN, whole) if m.end() < len(whole)})


def split_url(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or
    the end. Null, or without ``://``: both empty."""
    u = text_or_empty(url)
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.char_length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rarest_tokens(tokens: DataFrame, rules: list[Rule]) -> dict[Rule, str]:
    """``tokens`` has an array column ``tokens``. The counts that come to the driver are of the rules' own tokens only."""
    own = sorted({t for r in rules for t in r.tokens})
    each = tokens.select(F.explode("tokens").alias("token")).where(F.col("token").isin(own))
    counts = {r["token"]: r["n"] for r in each.groupBy("token").agg(F.count("*").alias("n")).collect()}
    return {r: min(r.tokens, key=lambda t: (counts.get(t, 0), t)) for r in rules if r.tokens}


def bucket_of(token: str, buckets: int) -> int:
    return zlib.crc32(token.encode()) % buckets


def index_column(by_token: dict[Rule, str], buckets: int) -> Column:
    """An array of buckets, each an array of (token, text, verdict, pattern): a constant of the plan."""
    rows: list[list[dict[str, str]]] = [[] for _ in range(buckets)]
    for r, t in by_token.items():
        rows[bucket_of(t, buckets)].append({"token": t, "text": r.text, "verdict": r.verdict, "pattern": r.pattern})
    return F.from_json(F.lit(json.dumps(rows)), "array<array<struct<token:string,text:string,verdict:string,pattern:string>>>")


def url_filter(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per row of ``pages``: id, host, path, rule, verdict.

    A rule fits its host and all its subdomains if the URL's path starts with the rule's. The longest fitting rule wins; of
    equally long ones the last in text order, and block before allow for one text. Where none fits, ``rule`` is null and the
    verdict is ``default``. Null URLs and those without ``://`` have empty host and path, which no rule fits. Ids may repeat
    or be null. Other columns are ignored. No rules, or an empty table, are fine.
    """
    host, path = split_url(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    tokens = parts.select("*", F.array_distinct(F.regexp_extract_all(F.concat("host", "path"), F.lit(f"({TOKEN})"), 1)).alias("tokens"))
    rarest = rarest_tokens(tokens, rules) if rules else {}
    bare = [r for r in rules if not r.tokens]  # nothing to file them under: every URL tries them
    kinds = "struct<size:int,text:string,verdict:string>"
    best = F.lit(None).cast(kinds)

    def top(candidates: Column) -> Column:
        """The longest of the candidates whose expressions match."""
        fits = F.filter(candidates, lambda r: F.regexp_like(F.concat("host", "path"), r["pattern"]))
        return F.array_max(F.transform(fits, lambda r: F.struct(F.char_length(r["text"]).alias("size"), r["text"].alias("text"), r["verdict"].alias("verdict"))))

    filed = list(rarest.items())
    for i in range(0, len(filed), RULES_PER_INDEX):
        part = dict(filed[i : i + RULES_PER_INDEX])
        buckets = max(1, 2 * len(part))
        index = index_column(part, buckets)
        fetched = F.flatten(F.transform("tokens", lambda t: F.filter(F.element_at(index, F.pmod(F.crc32(t.cast("binary")), F.lit(buckets)).cast("int") + 1), lambda r: r["token"] == t)))
        best = F.greatest(best, top(fetched))
    if bare:
        best = F.greatest(best, top(index_column({r: "" for r in bare}, 1)[0]))
    judged = tokens.select("*", best.alias("best"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.text").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
