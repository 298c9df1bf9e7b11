"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import round_trip
from .common import UPPER, table
from .exact_dedup import exact_dedup
from .line_dedup import line_dedup
from .minhash import near_duplicates
from .packing import pack
from .secret_scan import ranked_words, scan_secrets
from .sharding import SHARDS, TABLE_SIZE, assign_shards, fill_table
from .toxicity import remainder, score_toxicity, train
from .url_filter import Rule, url_filter

URL_RULES = [Rule("net/", "block"), Rule("example.net/en/", "allow"), Rule("example.com/de/", "block"), Rule("org/fr/", "allow")]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "slot", "shard")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_secrets(docs, words=ranked_words(docs, tokenizer_path()))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_packing, op3_sharding, op4_bpe, op5_secret_scan, op6_toxicity, op7_ann, op8_minhash, op9_url_filter, op10_line_dedup]
    return {f.__name__: f for f in own}


def _lower(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{UPPER.lower()}')"


def oracle_sql() -> dict[str, str]:
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    slots = "".join(f"{i:02x}" for i in fill_table(SHARDS, TABLE_SIZE))
    url_rules = ", ".join(f"('{r.text}', '{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    return {
        "op1_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {_lower("coalesce(text, '')")} AS norm FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
                   sha256(norm) AS text_sha256
            FROM n WINDOW g AS (PARTITION BY norm)""",
        "op3_sharding": f"""
            WITH s AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot FROM documents),
                 t AS (SELECT '{slots}' AS hex)
            SELECT doc_id, slot, CAST('0x' || substr(hex, slot * 2 + 1, 2) AS INTEGER) AS shard FROM s, t""",
        "op8_minhash": f"""
            WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array({_lower("coalesce(text, '')")}, '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
                 s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                                           WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
                 n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
                 p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
                 e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 85 * (nx.n + ny.n - k)),
                 l AS (SELECT x AS a, y AS b FROM e UNION ALL SELECT y, x FROM e),
                 r AS (SELECT doc_id, doc_id AS reach FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reach = l.a)
            SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(reach) AS component_id, r.doc_id = min(reach) AS kept
            FROM r LEFT JOIN n USING (doc_id) GROUP BY r.doc_id""",
        "op9_url_filter": f"""
            WITH rules(rule, verdict, h, p) AS (VALUES {url_rules}),
                 u AS (SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
                 w AS (SELECT page_id, {_lower("regexp_extract(rest, '^([^/?#]*)', 1)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
                 f AS (SELECT w.*, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC) AS k
                       FROM w LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
            SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE k = 1""",
        "op10_line_dedup": f"""
            WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                              generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
                 k AS (SELECT *, {_lower(f"trim(line, {blanks})")} AS key FROM l),
                 d AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
            SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (d.key IS NOT NULL) AS BIGINT) AS n_dropped,
                   sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (d.key IS NULL), '')) AS kept_sha256
            FROM k LEFT JOIN d USING (key) GROUP BY doc_id""",
    }
