"""Releases of a static collection: several folders of files that become visible together, or not at all.

``publish`` writes its tables below a folder with a name of its own and then adds one line
to the manifest. Readers follow the last line, so a release that fails leaves what they
see as it was, and old releases can be read by number. The manifest grows by one file a
release; two releases at the same time must not be made (the later line wins).
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.tables import written

MANIFEST = "number long, folder string, tables array<struct<name: string, columns: array<struct<name: string, type: string>>, by: array<string>>>, published timestamp"
#: Rows of one file of a group, and documents of one row of a word.
CHUNK = 1000


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).json(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def current(spark: SparkSession, path: str, number: int | None = None):
    """The manifest's last line, or that of a number; None before the first release."""
    lines = _manifest(spark, path)
    if lines is None:
        return None
    return (lines if number is None else lines.where(F.col("number") == number)).orderBy(F.desc("number"), F.desc("published")).first()


def publish(path: str, tables: dict[str, tuple[DataFrame, list[str]]], compression: str = "gzip") -> int:
    """Writes {name: (rows, columns that make its folders)} as JSON lines, compressed; the number of the release. Empty tables are kept.

    Rows are written where they are: a task makes a file for each folder it has rows of, so the caller
    keeps the rows of a folder together.
    """
    spark = next(iter(tables.values()))[0].sparkSession
    last = current(spark, path)
    number, folder = (last.number + 1 if last else 1), f"releases/{uuid.uuid4().hex}"
    for name, (rows, by) in tables.items():
        rows.write.partitionBy(*by).option("ignoreNullFields", "false").option("compression", compression).json(f"{path}/{folder}/{name}")
    described = [(name, [(f.name, f.dataType.simpleString()) for f in rows.schema], by) for name, (rows, by) in tables.items()]
    line = spark.createDataFrame([(number, folder, described)], MANIFEST.rsplit(",", 1)[0]).withColumn("published", F.current_timestamp())
    line.coalesce(1).write.mode("append").json(f"{path}/manifest")
    return number


def read(spark: SparkSession, path: str, name: str, number: int | None = None) -> DataFrame:
    """A table of the last release, or of the one with ``number``."""
    line = current(spark, path, number)
    found = [t for t in line.tables if t.name == name] if line else []
    if not found:
        raise ValueError(f"no release of {name} in {path}")
    columns = found[0].columns
    rows = spark.read.schema(", ".join(f"`{c.name}` {c.type}" for c in columns)).json(f"{path}/{line.folder}/{name}")
    return rows.select(*[f"`{c.name}`" for c in columns])


def collection(rows: DataFrame, group: str, order: str, words) -> dict[str, tuple[DataFrame, list[str]]]:
    """Tables of a static collection: ``rows`` in chunks by group, the ``index`` of chunks, ``words`` by first letter.

    Chunks are stretches of a group's ``order``, CHUNK rows each or fewer; order holds integers, unique
    in a group (equal ones share a chunk). ``rows`` has no columns chunk, word or letter, and is read once for each table and twice to number
    it, so what is costly to make is stored by the caller. Rows are numbered by stretches of the whole order and sums over these, so a
    large group is not one task's. Only group and order are shuffled for this: texts find their chunk in the list of where chunks
    start, a thousandth of the rows as long, and stay where they are. A word's documents stand in pieces that hold the same chunk of
    the same group, so no row grows with the corpus.
    """
    width = _width(rows, order)
    starts = written(_starts(rows, group, order, width), "starts")
    here = F.col("_s").eqNullSafe(F.col("_t")) & F.col(group).eqNullSafe(F.col("_g")) & (F.col(order).isNull() | (F.col(order) >= F.col("_from")) & (F.col("_to").isNull() | (F.col(order) < F.col("_to"))))
    placed = rows.withColumn("_s", _stretch(order, width)).join(starts, here).select(*[F.col(f"`{c}`") for c in rows.columns], "chunk").sortWithinPartitions(group, "chunk", order)
    index = placed.groupBy(group, "chunk").agg(F.count("*").alias("rows"), F.min(order).alias("first"), F.max(order).alias("last"))
    found = placed.select(group, "chunk", order, F.explode(F.array_distinct(words)).alias("word")).where("word <> ''")
    pieces = found.repartitionByRange("word", group, "chunk").groupBy("word", group, "chunk").agg(F.array_sort(F.collect_list(order)).alias("places"))
    pieces = pieces.select(F.lower(F.substring("word", 1, 1)).alias("letter"), "word", group, "chunk", "places")
    return {"rows": (placed, [group]), "index": (index, []), "words": (pieces, ["letter"])}


def _width(rows: DataFrame, order: str) -> int:
    """Of a stretch: some 50,000 rows, where order has no gaps."""
    return rows.agg(F.greatest(F.lit(1), F.ceil((F.max(order) - F.min(order) + 1) / F.greatest(F.lit(1), F.ceil(F.count("*") / 50000))))).first()[0]


def _stretch(order: str, width: int) -> Column:
    return F.floor(F.col(order) / F.lit(width))


def _starts(rows: DataFrame, group: str, order: str, width: int) -> DataFrame:
    """(_g, _t, chunk, _from, _to): where chunks start in each stretch of a group, and the next one there; of rows without an order the last chunk only."""
    chunk = F.floor((F.col("_n") - 1) / CHUNK).cast("long")
    cells = _numbered(rows.select(group, order), group, order, width).groupBy(F.col(group).alias("_g"), _stretch(order, width).alias("_t"), chunk.alias("chunk")).agg(F.min(order).alias("_from"))
    following = Window.partitionBy("_g", "_t").orderBy("chunk")
    cells = cells.withColumn("_to", F.lead("_from").over(following)).withColumn("_next", F.lead("chunk").over(following))
    return cells.where("_t IS NOT NULL OR _next IS NULL").drop("_next")


def _numbered(rows: DataFrame, group: str, order: str, width: int | None = None) -> DataFrame:
    """``_n`` from 1 within each group: a place within its stretch of the order, and the sums of the stretches before."""
    cut = rows.withColumn("_s", _stretch(order, width or _width(rows, order)))
    sizes = cut.groupBy(group, "_s").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(group).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    sums = sizes.select(F.col(group).alias("_g"), F.col("_s").alias("_t"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy(group, "_s").orderBy(order))
    placed = cut.withColumn("_r", own).join(sums, F.col(group).eqNullSafe(F.col("_g")) & F.col("_s").eqNullSafe(F.col("_t")))
    return placed.withColumn("_n", F.col("_r") + F.col("_b")).drop("_r", "_b", "_s", "_g", "_t")
