"""Bounded micro-batches: each is written under its number, counted while it is written, and reported when it is done.

How much a batch holds is bounded where the stream is read (``maxFilesPerTrigger``,
``maxBytesPerTrigger``). Spark keeps each batch's number and content in the checkpoint
folder: after a failure the batch in question comes again with the same number and the
same rows, later ones follow. ``folder_writer`` replaces the folder of that number, so
nothing is written twice; other writers must treat a number they know alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str, schema, per_batch: int = 1000, fmt: str = "parquet") -> DataFrame:
    """A stream over a folder's files, ``per_batch`` files in a batch at most."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(fmt).load(path)


def folder_writer(path: str) -> Callable[[DataFrame, int], None]:
    """Writes each batch to ``path/batch=N`` as Parquet, in place of what stands there."""

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, measures: dict[str, Column] | None = None, report: Callable[[dict], None] | None = None) -> list[dict]:
    """Handles all that the stream offers now; a report {batch, rows, total_rows, and the ``measures``} for each batch.

    ``write`` must write the rows it is given, once; the measures are taken on the way.
    ``report`` is called after each batch; totals count from this call. Errors of either end the run.
    """
    done: list[dict] = []

    def one(rows: DataFrame, number: int) -> None:
        seen = Observation(f"batch {number}")
        write(rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[m.alias(n) for n, m in (measures or {}).items()]), number)
        got = {"batch": number, **seen.get}
        got["total_rows"] = got["rows"] + (done[-1]["total_rows"] if done else 0)
        done.append(got)
        if report:
            report(got)

    q = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return done
