"""Thin queries that apply the text operators to whole tables and return the contract's digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination, is_contaminated
from .jaccard import grouped
from .mixing import mix_report
from .pii import pii_report
from .quality import base_failed, judge, kept
from .secrets import secret_report
from .shared import table
from .substrings import span_report


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, report = contamination(docs, table(spark, sf_dir, "benchmark"))
    r = F.col(report)
    return out.select(
        "doc_id",
        *[r[c].alias(c) for c in ("n_words", "n_hit", "n_items", "items_sha256")],
        is_contaminated(report).alias("contaminated"),
    )


OP1_SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
doc AS (
  SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 12))) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
place AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM place p JOIN win ON win.n = p.n AND win.s = p.s),
words AS (
  SELECT doc_id, count(*) AS n_hit FROM (
    SELECT DISTINCT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""



def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])


def _either(word: str) -> str:
    """A pattern for a word in either case of its ASCII letters only."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "(" + "|".join(map(_either, ("password", "passwd", "secret", "token", "api_?key"))) + r""")["\']?\x20*[:=]\x20*["\']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS = (
    ("assign", _ASSIGN.replace("\\'", "''"), True),
    ("access", "AKIA[A-Z0-9]{16,}", False),
    ("hex", "[0-9a-f]{24,}", False),
    ("pem", "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", False),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", False),
    ("slack", "xox[abprs]-[A-Za-z0-9-]{10,}", False),
    ("github", "gh[pousr]_[A-Za-z0-9]{36,}", False),
    ("google", "AIza[A-Za-z0-9_-]{35}", False),
)
_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, {i} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS m, string_split_regex(t, '{p}') AS s, "
    + (f"list_transform(regexp_extract_all(t, '{p}', 2), lambda x : length(x) >= 6)" if long else f"list_transform(regexp_extract_all(t, '{p}'), lambda x : true)")
    + " AS ok FROM d"
    for i, (kind, p, long) in enumerate(_SECRETS)
)
#: A match starts after all pieces and matches before it.
OP3_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({_FOUND}),
placed AS (
  SELECT doc_id, rank, kind, length(m[i]) AS size, ok[i] AS ok,
         list_sum(list_transform(s[1:i], lambda x : length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x : length(x))), 0) AS a
  FROM (SELECT *, unnest(generate_series(1, len(m))) AS i FROM found WHERE len(m) > 0)),
said AS (SELECT doc_id, rank, kind, CAST(a AS BIGINT) AS a, kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + size AS BIGINT) AS say FROM placed WHERE ok),
g AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(say, ',' ORDER BY a, rank) FILTER (rank < 3) AS base, string_agg(say, ',' ORDER BY a, rank) AS spans FROM said GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)
"""

OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i : i + least(5, len(w)) - 1], ' ')) AS x
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) LEFT JOIN n USING (doc_id)
"""


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op2_pii_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, name, rules = judge(docs, table(spark, sf_dir, "labels"))
    s = F.col(name)
    return out.select(
        "doc_id",
        *[s[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(name).alias("base_failed"),
        kept(name, rules).alias("kept"),
        rules.rejected_by(name).alias("rule"),
    )


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_report(table(spark, sf_dir, "documents"))


QUERIES = {
    "op6_suffix_array_dedup": op6_suffix_array_dedup,
    "op2_pii_extraction": op2_pii_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op1_benchmark_decontamination": op1_benchmark_decontamination,
    "op3_secret_scan": op3_secret_scan,
    "op7_source_mixing": op7_source_mixing,
}
ORACLES = {"op1_benchmark_decontamination": OP1_SQL, "op3_secret_scan": OP3_SQL, "op8_ngram_jaccard_join": OP8_SQL}
