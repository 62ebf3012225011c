"""Thin queries that apply the page operators to the whole pages table and return the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .htmltext import extract
from .shared import table
from .urlrules import judged
from .warc import round_trip


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


OP4_SQL = r"""
WITH p AS (
  SELECT page_id, url, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to, url
FROM p LEFT JOIN f USING (d)
"""


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col(text).alias("text"), F.length(text).cast("long").alias("n_chars"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, names = judged(table(spark, sf_dir, "pages").select("page_id", "url"))
    return out.select("page_id", *[F.col(c).alias(n) for n, c in names.items()])


QUERIES = {"op4_warc_archive": op4_warc_archive, "op9_html_extraction": op9_html_extraction, "op10_url_filter": op10_url_filter}
ORACLES = {"op4_warc_archive": OP4_SQL}
