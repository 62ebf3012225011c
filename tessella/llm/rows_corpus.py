"""Thin queries over the words, the rows and the vectors of whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merkle import digest_of, fold, manifest, siblings
from .pivots import neighbours
from .shared import table
from .spelling import runs, variants, without

#: A run loses a letter where this divides its checksum; a row is tampered with where that does.
MISSPELT = 199
TAMPERED = 7


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "documents").select("doc_id", "text"))
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    found = found.withColumn("h", F.crc32(said.cast("binary")))
    place = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.pmod("h", F.lit(MISSPELT)) == 0, without(F.col("run"), place)).otherwise(F.col("run"))
    counts = found.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return variants(counts).select("word", "form", "root", "n", "n_near", "form_n")


def _crc32(byte_list: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a list of byte values."""
    step = "list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, z : xor(a >> 1, (a & 1) * 3988292384))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte_list}), lambda c, b : {step}), 4294967295)"


_BYTES = "flatten(list_transform(string_split(said, ''), lambda x : CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(x) - 64 AS BIGINT)] END))"
OP11_SQL = rf"""
WITH RECURSIVE run AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (
  SELECT run, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS said, count(*) AS k FROM run WHERE length(run) >= 6 GROUP BY ALL),
sum AS (SELECT run, k, {_crc32(_BYTES)} AS h FROM each),
word AS (
  SELECT CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(k) AS n FROM sum GROUP BY 1),
w AS (SELECT word, n FROM word WHERE n >= 5 AND length(word) >= 6),
gone AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS g FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM w)),
near AS (
  SELECT a.word, b.word AS other, b.n AS m FROM gone a JOIN gone b ON a.g = b.g AND a.i = b.i AND a.word <> b.word
  UNION SELECT gone.word, w.word, w.n FROM gone JOIN w ON w.word = g
  UNION SELECT w.word, gone.word, gone.n FROM gone JOIN w ON w.word = g),
best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM near GROUP BY word),
form AS (
  SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN other END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
  FROM w LEFT JOIN best USING (word)),
path AS (
  SELECT word, form AS at FROM form WHERE form IS NOT NULL
  UNION ALL SELECT p.word, f.form FROM path p JOIN form f ON f.word = p.at WHERE f.form IS NOT NULL),
root AS (SELECT p.word, p.at AS root FROM path p JOIN form f ON f.word = p.at WHERE f.form IS NULL)
SELECT word, form, coalesce(root, word) AS root, CAST(n AS BIGINT) AS n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM form LEFT JOIN root USING (word)
"""


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    c = {x: F.col(x) for x in docs.columns}
    leaf = digest_of(*c.values())
    hit = F.coalesce(F.pmod(F.crc32(c["doc_id"].cast("string").cast("binary")), F.lit(TAMPERED)) == 0, F.lit(False)) & c["n_chars"].isNotNull()
    changed = digest_of(*{**c, "n_chars": c["n_chars"].cast("long") + 1}.values())
    rows = docs.select("doc_id", "lang", leaf.alias("digest"), F.when(hit, changed).alias("changed"))
    out = manifest(rows, "doc_id", "lang", "digest", carry=("changed",))
    out = out.withColumn("folded_root", fold(F.coalesce("changed", "leaf"), F.col("proof")))
    proof = F.sha2(siblings(F.col("proof")), 256)
    return out.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _field(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE strlen(CAST({column} AS VARCHAR)) || ':' || CAST({column} AS VARCHAR) END"


def _leaf(size: str) -> str:
    return "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", size, "text"))) + ")"


def _tree(name: str, start: str) -> str:
    """Levels of the trees over (g, pos, d): (l, g, pos, d, cnt), cnt: nodes of the level."""
    return f"""{name} AS (
  SELECT 0 AS l, g, pos, d, count(*) OVER (PARTITION BY g) AS cnt FROM {start}
  UNION ALL
  SELECT l + 1, g, pos, d, count(*) OVER (PARTITION BY l, g) FROM (
    SELECT l, g, pos // 2 AS pos, sha256(string_agg(d, '' ORDER BY {name}.pos)) AS d FROM {name} WHERE cnt > 1 GROUP BY l, g, {name}.pos // 2))"""


_DIGITS = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x : CAST(unicode(x) AS BIGINT))"
OP12_SQL = f"""
WITH RECURSIVE row AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, {_leaf("n_chars")} AS d,
         CASE WHEN {_crc32(_DIGITS)} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf("(n_chars + 1)")} END AS changed
  FROM documents),
leaf AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, d) - 1 AS pos FROM row),
{_tree("tree", "leaf")},
subroot AS (SELECT g, d, row_number() OVER (ORDER BY g) - 1 AS pos FROM tree WHERE cnt = 1),
top AS (SELECT '' AS g, pos, d FROM subroot),
{_tree("crown", "top")},
up AS (
  SELECT r.doc_id, r.g, r.pos AS leaf_at, r.d AS leaf, t.l, r.pos >> t.l AS pos FROM leaf r JOIN tree t ON t.g = r.g AND t.pos = r.pos >> t.l AND t.cnt > 1
  UNION ALL
  SELECT r.doc_id, r.g, r.pos, r.d, 1000 + c.l, s.pos >> c.l FROM leaf r JOIN subroot s USING (g) JOIN crown c ON c.pos = s.pos >> c.l AND c.cnt > 1),
entry AS (
  SELECT up.*, coalesce(t.d, c.d) AS sibling FROM up
  LEFT JOIN tree t ON up.l < 1000 AND t.l = up.l AND t.g = up.g AND t.pos = xor(up.pos, 1)
  LEFT JOIN crown c ON up.l >= 1000 AND c.l = up.l - 1000 AND c.pos = xor(up.pos, 1)),
proof AS (
  SELECT g, leaf_at, string_agg(sibling, '' ORDER BY l) AS said,
         list(CASE WHEN sibling IS NULL THEN '-' WHEN pos % 2 = 1 THEN 'L' || sibling ELSE 'R' || sibling END ORDER BY l) AS path
  FROM entry GROUP BY g, leaf_at),
folded AS (
  SELECT r.doc_id, r.g, r.d AS leaf, coalesce(said, '') AS said,
         list_reduce(list_prepend(coalesce(changed, r.d), coalesce(path, [])), lambda x, s : sha256(CASE WHEN s[1] = 'L' THEN s[2:] || x WHEN s[1] = 'R' THEN x || s[2:] ELSE x END)) AS folded_root
  FROM leaf r LEFT JOIN proof p ON p.g = r.g AND p.leaf_at = r.pos)
SELECT doc_id, leaf, s.d AS subroot, c.d AS root, sha256(said) AS proof_sha256, folded_root, folded_root = c.d AS verified
FROM folded JOIN subroot s USING (g), (SELECT d FROM crown WHERE cnt = 1) c
"""


def op13_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return neighbours(rows, rows.where("vec_id % 20 = 0"))


QUERIES = {"op11_spelling_variants": op11_spelling_variants, "op12_merkle_manifest": op12_merkle_manifest, "op13_permutation_index": op13_permutation_index}
ORACLES = {"op11_spelling_variants": OP11_SQL, "op12_merkle_manifest": OP12_SQL}
