"""Secret scans: fixed patterns, and a guess-cost model for values in a credential's context.

A value that stands after a credential's name is cut into words, dates, repeats, keyboard walks and brute-force spans by
dynamic programming, so that the cost to guess it is least. Values that cost ``MIN_LOG_GUESSES`` or more are secrets.

Words are ranked, and a word costs the logarithm of its rank. The list is made of common parts of passwords, of the corpus' own
words by the number of documents that hold them, and of a public tokenizer's whole words, if its file is given.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import vocabulary
from .common import drop_shared, python_ready, quoted, text_or_empty, write_shared

# The base patterns, shortest lengths and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
MIN_ASSIGN = 12
KINDS = ("assign", "access", "hex", "guess")

#: Names whose values are judged by their guess cost.
CONTEXT_NAMES = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "auth", "credential", "credentials", "access_key", "private_key")
CONTEXT = re.compile(r"""(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|auth|credentials?|access_key|private_key)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:"([^"\s]{6,})"|'([^'\s]{6,})'|([^\s"',;<>()]{6,}))""", re.A | re.I)
#: log10 of the guesses from which a value counts as a secret.
MIN_LOG_GUESSES = 10.0

#: The words of the model when none are given: common parts of passwords and of placeholders.
WORDS = (
    "password passwd pass admin root user login guest welcome default changeme secret token example sample test demo "
    "dragon monkey master shadow summer winter spring autumn sunshine princess football baseball letmein qwerty iloveyou "
    "love hello world house apple orange banana company service server client account public private string value none "
    "null true false undefined required optional your here enter name key api auth the and for with from this that"
).split()
#: Words of the corpus that the model knows at most, with 24 letters at most, and in how many documents one has to be.
CORPUS_WORDS = 50_000
CORPUS_DOCS = 5
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba", "0987654321")
LEET = str.maketrans("013457@$!", "oieastasi")
DATE = re.compile(r"(?:19|20)\d\d[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:3[01]|[12]\d|0?[1-9])|(?:3[01]|[12]\d|0?[1-9])[-/._]?(?:1[0-2]|0?[1-9])[-/._]?(?:19|20)\d\d|(?:19|20)\d\d")
DATE_COST = math.log10(365 * 120)
YEAR_COST = math.log10(120)
#: Each further part of a cut makes the guess harder: its kind and length have to be found too.
PART_COST = 1.0
#: Signs that join words, as in names and placeholders.
JOINERS = "-_./:"


def _neighbours() -> set[str]:
    """Pairs of keys next to each other in a row, and the keys straight below (keyboard rows only), both ways."""
    out = {r[i : i + 2] for r in ROWS for i in range(len(r) - 1)}
    for a, b in zip(ROWS[:3], ROWS[1:4], strict=True):
        out |= {a[i] + b[i] for i in range(len(b))}
    return out | {p[::-1] for p in out}


NEXT = _neighbours()


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS, least_docs: int = CORPUS_DOCS) -> list[str]:
    """The corpus' words of 3 to 24 letters, lower-cased, by falling number of rows that hold them: at most ``most``, each in at least
    ``least_docs`` rows. Whole texts of all rows are counted; the counts are combined before the shuffle.

    Words go to the driver by classes of about equal counts (steps of 2^(1/8), some 500 of them), the commonest first, as long as
    a class fits as a whole. So no more than ``most`` words ever travel."""
    words = F.array_distinct(F.split(F.lower(text_or_empty(F.col(quoted(text_col)))), r"[^\p{L}]+"))
    each = docs.select(F.explode(words).alias("word")).where(F.char_length("word").between(3, 24))
    counted = write_shared(each.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs), "secret-words")
    kind = F.floor(F.log2("n") * 8)
    total, lowest = 0, None
    for r in sorted(counted.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += r["n"]
        if total > most:
            break
        lowest = r["kind"]
    found = counted.where(kind >= lowest).collect() if lowest is not None else []
    drop_shared(counted)
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def tokenizer_words(path: str) -> list[str]:
    """The whole words of a byte-level BPE's file, in the order of their ids, which is by frequency at about."""
    _, tokens, _ = vocabulary(path)
    found = (t[1:].decode("utf-8", "ignore") for t in tokens if t[:1] == b" " and len(t) > 3)
    return [w for w in found if w.isalpha()]


def ranked_words(docs: DataFrame, path: str | None = None, text_col: str = "text") -> list[str]:
    """All words of the model, the commonest first; at most some 100,000, whatever the data."""
    more = tokenizer_words(path) if path else []
    return list(dict.fromkeys([*WORDS, *corpus_words(docs, text_col), *(w.lower() for w in more)]))


class GuessCost:
    """log10 of the least number of guesses over all cuts of a value."""

    def __init__(self, words: list[str] | tuple[str, ...] = tuple(WORDS)) -> None:
        self.rank = {w.lower(): math.log10(i + 2) for i, w in reversed(list(enumerate(words)))}
        self.longest = max(map(len, self.rank), default=0)  # bounds the words tried at each place

    @staticmethod
    def per_char(c: str) -> float:
        """log10 of how many characters of its kind there are."""
        return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)

    def matches(self, value: str) -> dict[int, list[tuple[int, float]]]:
        """end → (start, cost) of words, dates, repeats and walks."""
        out: dict[int, list[tuple[int, float]]] = {}
        low = value.lower()
        plain = low.translate(LEET)
        put = lambda i, j, cost: out.setdefault(j, []).append((i, cost))
        n = len(value)
        for i in range(n if self.longest else 0):
            for j in range(i + 3, min(n, i + self.longest) + 1):
                for text, extra in ((low, 0.0), (plain, 0.5)):
                    if (r := self.rank.get(text[i:j])) is not None:
                        cost = r + extra + (0 if value[i:j] == low[i:j] else 0.5)
                        put(i, j, cost)
                        if j < n and value[j] in JOINERS:  # the joiner shows where the word ends
                            put(i, j + 1, max(0.0, cost - 0.5 * PART_COST))
                        break
        for i in range(n):
            if m := DATE.match(value, i):
                put(i, m.end(), DATE_COST if m.end() - i > 4 else YEAR_COST)
        i = 0
        while i < n:  # the longest runs of one character, and walks
            j = i + 1
            while j < n and low[j] == low[i]:
                j += 1
            for k in (j,) if j - i >= 3 else ():
                put(i, k, self.per_char(value[i]) + math.log10(k - i))
            i = j
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and low[j - 1 : j + 1] in NEXT:
                j += 1
            if j - i >= 3:
                put(i, j, math.log10(47) + 0.5 * (j - i - 1))
            i = max(j - 1, i + 1)
        for m in re.finditer(r"(.{2,12}?)\1+", value, re.S):  # a unit again and again
            unit = m[1]
            put(m.start(), m.end(), sum(map(self.per_char, unit)) + math.log10(len(m[0]) // len(unit)))
        return out

    def cost(self, value: str) -> float:
        """Linear in the value's length: parts of the last kind are at most a word long, or whole runs."""
        ends = self.matches(value)
        inf = math.inf
        whole, brute = [0.0] + [inf] * len(value), [inf] * (len(value) + 1)  # least cost up to here, in any way or with an open brute-force span
        for j in range(1, len(value) + 1):
            c = self.per_char(value[j - 1])
            brute[j] = min(brute[j - 1], whole[j - 1] + (PART_COST if j > 1 else 0)) + c
            whole[j] = min([brute[j], *(whole[i] + cost + (PART_COST if i else 0) for i, cost in ends.get(j, ()))])
        return whole[-1]


def _hits(pattern: re.Pattern, names: tuple[str, ...], text: str, low: str) -> Iterator[re.Match]:
    """``pattern.finditer`` for patterns that begin with one of ``names`` in either case: found by plain search in ``low``, the
    lower-cased text, if that has the text's length, and so its places."""
    if len(low) != len(text):
        yield from pattern.finditer(text)
        return
    starts: set[int] = set()
    for n in names:
        at = low.find(n)
        while at >= 0:
            starts.add(at)
            at = low.find(n, at + 1)
    last = 0
    for at in sorted(starts):
        if at >= last and (m := pattern.match(text, at)):
            yield m
            last = max(m.end(), at + 1)


Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind, as (kind, start, end) in code points, by start, then kind."""
    low = text.lower()
    out = [("assign", *m.span()) for m in _hits(ASSIGN, ASSIGN_NAMES, text, low) if m.end(2) - m.start(2) >= MIN_ASSIGN]
    out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def guess_spans(text: str, model: GuessCost, least: float = MIN_LOG_GUESSES) -> list[Span]:
    """The values in a credential's context that cost ``least`` or more."""
    out = []
    for m in _hits(CONTEXT, CONTEXT_NAMES, text, text.lower()):
        k = m.lastindex
        if model.cost(m[k]) >= least:
            out.append(("guess", *m.span(k)))
    return out


def all_spans(text: str, model: GuessCost, least: float = MIN_LOG_GUESSES) -> list[Span]:
    return sorted(base_spans(text) + guess_spans(text, model, least), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """``text`` with each run of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | tuple[str, ...] = tuple(WORDS), least: float = MIN_LOG_GUESSES) -> DataFrame:
    """One row per row of ``docs``: id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    Whole texts are scanned, in one pass without a shuffle. Null text counts as empty and has no spans. Ids may be null or
    repeat. Other columns are ignored. An empty table gives an empty result.
    """
    python_ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(list(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GuessCost(sent.value)
        for b in batches:
            found = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                more = guess_spans(text, model, least)
                kinds = [k for k, _, _ in base + more]
                spans = sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
                found.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            cols = list(zip(*found, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(quoted(id_col), quoted(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, n_guess long, base_sha256 string, spans string")


def redact_secrets(docs: DataFrame, text_col: str = "text", words: list[str] | tuple[str, ...] = tuple(WORDS), least: float = MIN_LOG_GUESSES, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all columns stay, and so do null texts."""
    python_ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(list(words))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = GuessCost(sent.value)
        for b in batches:
            new = [t if t is None else redact(t, all_spans(t, model, least), mark) for t in b.column(at).to_pylist()]
            cols = list(b.columns)
            cols[at] = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # mapInArrow takes no names with dots
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
