"""How far the ranges of a group agree: the mean share of overlap over all pairs of its rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Different ranges of a chunk, on average: two chunks meet as one matrix of about a million cells.
CHUNK = 1024


@F.pandas_udf(DoubleType())
def _shares(left: pd.Series, right: pd.Series, same: pd.Series) -> pd.Series:
    """Sum of the overlap shares over the pairs of two chunks, each given as [lows, highs, counts]."""

    def one(x, y, own) -> float:
        (a, b, n), (c, d, m) = (tuple(np.asarray(v, dtype=float) for v in side) for side in (x, y))
        both = np.minimum(b[:, None], d) - np.maximum(a[:, None], c)
        span = np.maximum(b[:, None], d) - np.minimum(a[:, None], c)
        share = np.divide(both, span, out=np.zeros_like(both), where=both > 0) * (n[:, None] * m)
        if not own:
            return float(share.sum())
        return float(np.triu(share, 1).sum() + ((b > a) * n * (n - 1) / 2).sum())

    return pd.Series([one(*v) for v in zip(left, right, same, strict=True)], dtype=float)


def interval_consensus(df: DataFrame, key: str, low: str, high: str) -> DataFrame:
    """(key, n, consensus): mean over all pairs of a group's rows of overlap over joint span; 1 for one row, 0 for pairs
    that don't overlap or only touch, equal points among them.

    Equal ranges are counted first. A group's different ranges are dealt to chunks by their hash, and chunks meet in
    pairs, so neither a task nor a row holds a group, and no pair of rows is ever made: work grows with the square of
    a group's different ranges, data with that square over CHUNK. Rows without a range (null, not a number, low above
    high) take no part; a null key is a group.
    """
    good = df.where(~F.isnan(low) & ~F.isnan(high) & (F.col(low) <= F.col(high)))
    ranges = good.groupBy(F.col(key).alias("_k"), F.col(low).cast("double").alias("_l"), F.col(high).cast("double").alias("_h")).agg(F.count("*").alias("_n"))
    sizes = ranges.groupBy("_k").agg(F.ceil(F.count("*") / CHUNK).alias("cells"), F.sum("_n").alias("n"))
    dealt = ranges.join(sizes.withColumnRenamed("_k", "_g"), F.col("_k").eqNullSafe(F.col("_g"))).withColumn("cell", F.pmod(F.xxhash64("_l", "_h"), F.col("cells")))
    chunks = dealt.groupBy("_k", "cell", "cells").agg(F.sort_array(F.collect_list(F.struct("_l", "_h", "_n"))).alias("r"))
    field = lambda f: F.transform("r", lambda x: x[f].cast("double"))
    chunks = chunks.select("_k", "cell", "cells", F.array(field("_l"), field("_h"), field("_n")).alias("r"))
    left = chunks.select(F.col("_k").alias("_g"), F.col("cell").alias("first"), F.col("r").alias("x"), F.explode(F.sequence("cell", F.col("cells") - 1)).alias("second"))
    met = left.join(chunks, F.col("_g").eqNullSafe(F.col("_k")) & (F.col("second") == F.col("cell")))
    sums = met.select("_k", _shares("x", "r", F.col("first") == F.col("cell")).alias("s")).groupBy("_k").agg(F.sum("s").alias("s"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    score = F.when(F.col("n") == 1, F.lit(1.0)).otherwise(F.col("s") / pairs)
    return sizes.withColumnRenamed("_k", "_g").join(sums, F.col("_g").eqNullSafe(F.col("_k"))).select(F.col("_g").alias(key), "n", score.alias("consensus"))
