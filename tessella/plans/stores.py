"""Queries that go through a store, and uncertain values from events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..operators.tables import shared_folder
from ..sources import apparatus, releases, sqlite
from ..streaming import batches
from .base import query, table


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_totalprice >= 150000 AND o_orderstatus IN ('F', 'O')")
def sqlite_round_trip(spark, sf_dir):
    """All orders are written to SQLite files; both filters are answered by SQLite when they are read."""
    path = f"{shared_folder(spark)}/orders-{uuid.uuid4().hex}"
    sqlite.write(table(spark, sf_dir, "orders"), path, index=["o_totalprice"])
    kept = sqlite.read(spark, path).where((F.col("o_totalprice") >= 150000) & F.col("o_orderstatus").isin("F", "O"))
    return kept.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY source")
def micro_batches(spark, sf_dir):
    """Documents as a stream in batches of 50 files at most, each written under its number; then counted."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), f"{shared_folder(spark)}/batches-{uuid.uuid4().hex}"
    found = batches.files(spark, f"{sf_dir}/documents*.parquet", docs.schema, 50)  # a pattern, as a stream takes no single file
    batches.run(found, batches.folder_writer(f"{path}/out"), f"{path}/progress")
    return spark.read.schema(docs.schema).parquet(f"{path}/out").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("""WITH p AS (SELECT doc_id, source, CAST(floor((row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) / 1000) AS BIGINT) AS chunk, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS words FROM documents)
  SELECT substr(word, 1, 1) AS letter, source, chunk, count(DISTINCT word) AS words, count(*) AS places, CAST(min(doc_id) AS BIGINT) AS first FROM (SELECT doc_id, source, chunk, unnest(words) AS word FROM p) GROUP BY ALL""")
def static_release(spark, sf_dir):
    """Documents published in chunks with an index of their words by letter, read back from the release."""
    path = f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    releases.publish(path, releases.collection(d, "source", "doc_id", text.latin_words(F.col("text"))))
    w = releases.read(spark, path, "words")
    return w.groupBy("letter", "source", "chunk").agg(F.count("*").alias("words"), F.sum(F.size("places")).alias("places"), F.min(F.col("places")[0]).alias("first"))


_APPARATUS = """a AS (SELECT o_orderkey, o_orderkey % 4 AS style, o_custkey % 30 + 1 AS v, o_orderkey // 4 % 3 AS more, CAST(o_custkey % 500 + 1 AS VARCHAR) AS hand, o_orderpriority AS said FROM orders)"""


@query(f"""WITH {_APPARATUS}, u AS (SELECT *, unnest(CASE WHEN style < 2 THEN range(v, v + more + 1) WHEN style = 3 THEN [v] ELSE [NULL] END) AS verse FROM a)
  SELECT o_orderkey, CAST(verse AS INT) AS verse, CASE WHEN style = 3 THEN 'C' END AS rating, CASE WHEN style = 3 THEN 'λογος' END AS lemma,
    CASE style WHEN 3 THEN said || '/om' WHEN 2 THEN NULL ELSE '/' || said || '/om' END AS readings,
    CASE style WHEN 3 THEN '02 ' || hand || ' 05 it' WHEN 2 THEN NULL ELSE '02 ' || hand || ' 03 05 P46' END AS witnesses, style = 2 AS damaged FROM u""")
def apparatus_entries(spark, sf_dir):
    """Orders written as lines of both dialects, a quarter of them with their range turned round."""
    c = F.col
    style, v = c("o_orderkey") % 4, c("o_custkey") % 30 + 1
    o = table(spark, sf_dir, "orders").withColumn("hand", c("o_custkey") % 500 + 1)
    last = F.when(style == 2, v - 1).otherwise(v + F.floor(c("o_orderkey") / 4) % 3)
    by_verse = F.concat(v, F.lit("-"), last, F.lit(" ¦ txt A "), c("hand"), F.lit(" : "), c("o_orderpriority"), F.lit(" B (D*) : om 𝔓46"))
    rated = F.concat(F.lit("2:"), v, F.lit(" {C} λογος "), c("o_orderpriority"), F.lit(" A "), c("hand"), F.lit("; om D it"))
    found = apparatus.entries(o.where(style < 3).withColumn("t", by_verse), "t", "verse", ["o_orderkey"]).unionByName(apparatus.entries(o.where(style == 3).withColumn("t", rated), "t", "rated", ["o_orderkey"]))
    numbers = F.flatten(F.transform("readings", lambda r: r["witnesses"]["number"]))
    texts = F.array_join(F.transform("readings", lambda r: r["text"]), "/")
    return found.select("o_orderkey", "verse", "rating", "lemma", texts.alias("readings"), F.array_join(numbers, " ").alias("witnesses"), c("error").isNotNull().alias("damaged"))
