"""Writers: partitioned files, bulk files for search and graph stores, several formats from one read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sets import keep_last


def parquet(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Partitioned files; rows of a partition value are spread over as many tasks as adaptive rebalancing finds right."""
    out = df.hint("rebalance", *by) if by else df
    (out.write.mode("overwrite").partitionBy(*by) if by else out.write.mode("overwrite")).parquet(path)


def json_by(df: DataFrame, path: str, by: list[str], compress: bool = True) -> None:
    df.hint("rebalance", *by).write.mode("overwrite").partitionBy(*by).option("compression", "gzip" if compress else "none").json(path)


def numbered_chunks(df: DataFrame, group: list[str], order: list[str], size: int) -> DataFrame:
    """Rows with a chunk number from 1 within their group."""
    return df.withColumn("chunk", (F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1) / size) + 1).cast("long"))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_last(both, key, [F.desc("_new")]).drop("_new")


def search_bulk(df: DataFrame, path: str, index: str, key: str) -> None:
    """Bulk files of a search store: an action line, then the document, as text."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    df.select(F.concat_ws("\n", action, F.to_json(F.struct(*df.columns))).alias("value")).write.mode("overwrite").text(path)


def graph_tables(verses: DataFrame, references: DataFrame, annotations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, label) and edges (src, dst, kind) of a corpus: one edge for each annotation of a topic."""
    label = lambda df, c, name: df.select(F.col(c).alias("id"), F.lit(name).alias("label")).distinct()
    vertices = label(verses, "verse_id", "verse").unionByName(label(verses, "book", "book")).unionByName(label(annotations, "topic", "topic"))
    edges = (
        verses.select(F.col("book").alias("src"), F.col("verse_id").alias("dst"), F.lit("CONTAINS").alias("kind"))
        .unionByName(references.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.lit("REFERENCES").alias("kind")))
        .unionByName(annotations.select(F.col("verse_id").alias("src"), F.col("topic").alias("dst"), F.lit("ABOUT").alias("kind")))
    )
    return vertices, edges.distinct()


def to_many(df: DataFrame, writers: dict[str, Callable[[DataFrame], None]]) -> dict[str, str]:
    """Runs all writers over one persisted read; an error names its writer and ends the rest."""
    kept = df.persist(StorageLevel.DISK_ONLY)
    done = {}
    try:
        for name, write in writers.items():
            try:
                write(kept)
            except Exception as e:
                raise RuntimeError(f"writer {name} failed") from e
            done[name] = "ok"
    finally:
        kept.unpersist()
    return done


def review_batch(df: DataFrame, path: str, size: int, group: list[str], order: list[str]) -> None:
    """Numbered batches of at most ``size`` rows for human review, as JSON files by batch, each row with empty answers."""
    out = numbered_chunks(df, group, order, size).withColumn("answer", F.lit(None).cast("string")).withColumn("comment", F.lit(None).cast("string"))
    out.write.mode("overwrite").partitionBy("chunk").option("ignoreNullFields", "false").json(path)


def alignment_json(links: DataFrame, path: str, by: str = "version") -> DataFrame:
    """Links (version, verse, source, target, confidence) as JSON by version, one object a verse; returns a report by version."""
    verses = links.groupBy(by, "verse").agg(F.array_sort(F.collect_list(F.struct("source", "target", "confidence"))).alias("links"))
    verses.hint("rebalance", by).write.mode("overwrite").partitionBy(by).json(path)
    bad = F.col("source").isNull() | F.col("target").isNull() | ~F.col("confidence").between(0, 1)
    return links.groupBy(by).agg(F.count_distinct("verse").alias("verses"), F.count("*").alias("links"), F.avg("confidence").alias("confidence"), F.count_if(F.coalesce(bad, F.lit(True))).alias("invalid"))
