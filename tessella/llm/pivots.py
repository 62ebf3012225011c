"""Nearest neighbours by inner product with a permutation index.

A bounded sample of vectors are the pivots. Each vector is represented by the order of its
nearest pivots and posted, with the place of the pivot in that order, in the pivots' inverted
files. A query reads the files of its own nearest pivots only, adds up the footrule distance of
its order to those it meets there (a pivot that isn't among a vector's nearest ones stands at
the end of its order), and the vectors of least distance are ranked again by exact inner products.

Rows are dealt by id to shards of some thousand vectors, each with files of its own; queries
go to all shards in blocks, so a task holds one shard and one block whatever the size of
the table, and a pivot near to a third of all vectors has a file in every shard. Equal
vectors of a shard are one entry with its smallest ids. Inner products of vectors of different
norms are made distances by one more coordinate that gives all vectors the largest norm.

Defined cases: rows whose id is null, or whose vector is null, empty, zero or holds null or
non-finite components take no part; neither do vectors that have another length than most (ties:
the larger length); of rows that share an id the least vector counts; a query without any
candidate has no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pivots, and the rows that are looked at for them.
PIVOTS = 1024
SAMPLE = 4096
#: Pivots that a vector is posted under, and that a query reads.
POSTED = 256
READ = 64
#: Share of a shard that is ranked again, and the least number over all shards.
SHARE = 0.1
LEAST = 1000
#: Vectors of a shard, queries of a block, and the bytes that either may have.
SHARD_ROWS = 8192
BLOCK_ROWS = 4096
MOST_BYTES = 64 << 20
#: Tasks of the search at most; several pairs of shard and block then share one, one after the other.
MOST_TASKS = 20_000


def usable(vector: Column) -> Column:
    """True for vectors that can take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.size(vector) > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


class Index:
    """The inverted files of one shard. ``pivots`` has the further coordinate as its last column."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, norm2: float, k: int) -> None:
        order = np.lexsort((*vectors.T[::-1], ids))
        ids, vectors = ids[order], vectors[order]
        fresh = np.concatenate([[True], ids[1:] != ids[:-1]]) if len(ids) else np.zeros(0, bool)
        ids, vectors = ids[fresh], vectors[fresh]
        self.vectors, entry = np.unique(vectors, axis=0, return_inverse=True)
        entry = entry.ravel()
        by = np.lexsort((ids, entry))
        starts = np.searchsorted(entry[by], np.arange(len(self.vectors)))
        place = np.arange(len(by)) - starts[entry[by]]
        #: Of equal vectors k + 1 ids are enough for a query's k, its own left out.
        by = by[place <= k]
        self.ids, self.entry = ids[by], entry[by]
        self.start = np.searchsorted(self.entry, np.arange(len(self.vectors) + 1))
        self.pivots, self.k = pivots, k
        self.posted = min(POSTED, len(pivots))
        rest = np.sqrt(np.maximum(0.0, norm2 - np.einsum("ij,ij->i", self.vectors, self.vectors)))
        near = nearest(np.column_stack([self.vectors, rest]) @ pivots.T, self.posted)
        flat = np.argsort(near.ravel(), kind="stable")
        self.file = (flat // self.posted).astype(np.int64)
        self.rank = (flat % self.posted).astype(np.int64)
        self.file_start = np.searchsorted(near.ravel()[flat], np.arange(len(pivots) + 1))

    def nearer(self, order: np.ndarray) -> np.ndarray:
        """For each entry how much less its footrule distance to ``order`` is than that of one not met in any file."""
        lots = [slice(self.file_start[p], self.file_start[p + 1]) for p in order]
        at = np.repeat(np.arange(len(order)), [s.stop - s.start for s in lots])
        rank = np.concatenate([self.rank[s] for s in lots])
        gain = (self.posted - at) - np.abs(at - rank)
        return np.bincount(np.concatenate([self.file[s] for s in lots]), gain, len(self.vectors))

    def search(self, own: int, query: np.ndarray, order: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the k nearest found, its own id left out."""
        n = len(self.vectors)
        take = max(least, int(np.ceil(SHARE * n)), 2 * self.k + 1)
        found = np.arange(n) if take >= n else np.argpartition(-self.nearer(order), take)[:take]
        score = exact(self.vectors[found], query)
        # Entries beyond the k + 1 best scores, ties included, can't hold one of the k nearest ids.
        if len(found) > self.k + 1:
            stays = score >= np.partition(score, -self.k - 1)[-self.k - 1]
            found, score = found[stays], score[stays]
        sizes = self.start[found + 1] - self.start[found]
        at = np.repeat(self.start[found], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids, score = self.ids[at], np.repeat(score, sizes)
        other = ids != own
        ids, score = ids[other], score[other]
        best = np.lexsort((ids, -score))[: self.k]
        return ids[best], score[best]


def nearest(likeness: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k largest values of each row, largest first, ties by column."""
    return np.argsort(-likeness, axis=1, kind="stable")[:, :k]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed from the first component to the last: equal vectors have equal scores."""
    return np.cumsum(vectors * query, axis=1)[:, -1]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def neighbours(base: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query the k nearest rows of ``base`` with another id, nearest first, ties to the smaller id."""
    rows = base.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    asked = queries.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    schema = "query_id long, rank int, vec_id long, score double"
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(norm2).alias("norm2")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return base.sparkSession.createDataFrame([], schema)
    dim, n, most = sizes["dim"], sizes["n"], sizes["norm2"]
    rows, asked = rows.where(F.size("v") == dim), asked.where(F.size("v") == dim)
    asked = asked.groupBy("id").agg(F.min("v").alias("v"))
    # The filter leaves about two samples, so that no task sends the driver more than it can keep.
    few = rows.where(F.pmod(F.xxhash64("id", F.lit(2)), F.lit(max(1, n // (2 * SAMPLE)))) == 0).groupBy("id").agg(F.min("v").alias("v"))
    sample = [r["v"] for r in few.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    pivots = np.array(list(dict.fromkeys(map(tuple, sample)))[:PIVOTS])
    pivots = np.column_stack([pivots, np.sqrt(np.maximum(0.0, most - np.einsum("ij,ij->i", pivots, pivots)))])

    room = max(1, MOST_BYTES // (8 * dim))
    n_shards = -(-n // min(SHARD_ROWS, room))
    n_blocks = -(-asked.count() // min(BLOCK_ROWS, room)) or 1
    # Both sides' numbers have one type: an int and a long of equal value are dealt to different tasks.
    shard = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(n_shards)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    block = asked.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(n_blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    share = LEAST / n

    def search(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(own) and len(asked):
            index = Index(own["id"].to_numpy(), _matrix(own["v"]), pivots, most, k)
            vectors = _matrix(asked["v"])
            orders = nearest(vectors @ pivots[:, :-1].T, min(READ, len(pivots)))
            least = int(np.ceil(share * len(own)))
            for query, v, order in zip(asked["id"].to_numpy(), vectors, orders, strict=True):
                ids, score = index.search(query, v, order, least)
                found.append((np.full(len(ids), query), ids, score))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    tasks = min(n_shards * n_blocks, MOST_TASKS)
    shard, block = (x.repartition(tasks, "shard", "block") for x in (shard, block))
    near = shard.groupBy("shard", "block").cogroup(block.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def recall(found: DataFrame, base: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20) -> float:
    """Share of the true neighbours that ``found`` has; every query is compared with every row, block by block, so this is for queries that fit in memory."""
    ids, matrix = zip(*[(r[0], r[1]) for r in queries.select(key, F.col(vector).cast("array<double>")).where(usable(F.col(vector))).collect()], strict=True)
    ids, matrix = np.array(ids), np.array(matrix)

    def scored(batches):
        for batch in batches:
            own, rows = batch.column(0).to_numpy(), _matrix(batch.column(1).to_pandas())
            score = rows @ matrix.T
            for j, query in enumerate(ids):
                best = np.argsort(-np.where(own == query, -np.inf, score[:, j]), kind="stable")[: k + 1]
                best = best[own[best] != query]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), query)), pa.array(own[best]), pa.array(score[best, j])], ["query_id", "vec_id", "score"])

    near = base.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long"), F.col(vector).cast("array<double>")).mapInArrow(scored, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    truth = near.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "vec_id", F.round("score", 9).alias("true_score"))
    hit = truth.join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    row = hit.agg(F.count("*").alias("n"), F.count("hit").alias("hits")).first()
    return row["hits"] / row["n"] if row["n"] else 1.0
