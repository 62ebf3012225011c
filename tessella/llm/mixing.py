"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Documents are cut into blocks of at most BLOCK_WORDS words. A source's quota is
its target in words: whole passes over its blocks, then the first blocks of a
seeded permutation, the last one in part, so that the quota is met to the word.
A binary tree splits the sources' piece counts among the output shards: each
node draws how many pieces of each source its left half gets (multivariate
hypergeometric), each leaf is one shard with exact quotas. A source's pieces,
numbered in permuted order, go to the leaves in disjoint ranges and are shuffled
inside their shard. What the mix takes of a document is the sum of its pieces in
the shards.

The permutation is a hash order. It is cut into buckets of about BUCKET_BLOCKS
blocks, and the buckets into groups of GROUP_BUCKETS, so numbering never gathers a
source in one task; what is ordered whole is one row for each group. The tree is
grown in rounds of FAN leaves a node, each node in a task of its own; its rows are
(shard, source) quotas above 0, at most one for each piece. The driver holds one
row for each source.

Defined results: a document's size is its number of words; null text has 0;
sources are ordered by code point with null last; empty sources and empty tables
take nothing; repeated rows are documents of their own; reruns agree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
BLOCK_WORDS = 512
BUCKET_BLOCKS = 512
SHARD_PIECES = 4096
#: Buckets of one group, and shards that one node of the tree splits into at once.
GROUP_BUCKETS = 4096
FAN = 256
#: Pieces up to which numpy draws; beyond, its own distribution is inverted here.
NUMPY_PIECES = 10**9


def n_words(text: Column) -> Column:
    """Runs of characters other than white space; null: 0."""
    parts = F.size(F.split(F.trim(F.regexp_replace(text, SPACE, " ")), " "))
    return F.when(text.isNull() | ~text.rlike(r"[^\x20\x09-\x0D]"), 0).otherwise(parts).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = WEIGHTS, most: float = MOST_REPEATS) -> dict[str | None, float]:
    """Words for each source: shares by weight, at most ``most`` times its size, the excess shared again."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    rest, open_, out = float(sum(sizes.values())), list(order), {}
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            rest -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _hypergeometric(good: int, bad: int, n: int, rng: np.random.Generator) -> int:
    """How many of ``n`` pieces drawn from ``good`` and ``bad`` ones are good, for any sizes.

    The odds of neighbouring values are products of four ratios; going out from the
    most likely value they are added up until they vanish in double precision, and
    one draw inverts the sum.
    """
    least, most = max(0, n - bad), min(good, n)
    mode = min(max((n + 1) * (good + 1) // (good + bad + 2), least), most)
    step = int(40 + 12 * math.sqrt(n * (good / (good + bad)) * (bad / (good + bad)) * ((good + bad - n) / max(1, good + bad - 1))))
    low, high = max(least, mode - step), min(most, mode + step)
    up = np.arange(mode, high, dtype=np.float64)
    down = np.arange(mode, low, -1, dtype=np.float64)
    rise = np.log(good - up) + np.log(n - up) - np.log(up + 1) - np.log(bad - n + up + 1)
    fall = np.log(down) + np.log(bad - n + down) - np.log(good - down + 1) - np.log(n - down + 1)
    odds = np.exp(np.concatenate([np.cumsum(fall)[::-1], [0.0], np.cumsum(rise)]))
    total = np.cumsum(odds)
    return low + int(min(np.searchsorted(total, rng.random() * total[-1], "right"), len(total) - 1))


def _draw(counts: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Multivariate hypergeometric: ``n`` of the pieces, by source."""
    out, left, rest = np.zeros_like(counts), n, int(counts.sum())
    for i, c in enumerate(map(int, counts)):
        rest -= c
        if not left:
            break
        if left == c + rest:
            k = c
        elif c + rest < NUMPY_PIECES:
            k = int(rng.hypergeometric(c, rest, left))
        else:
            k = _hypergeometric(c, rest, left, rng) if c and rest else left * (c > 0)
        out[i] = k
        left -= k
    return out


def split(counts: np.ndarray, shards: int, rng: np.random.Generator) -> np.ndarray:
    """Quotas by shard (rows) and source (columns): columns add up to ``counts``, rows differ by one at most."""
    if shards <= 1:
        return counts[None, :].copy()
    total, left = int(counts.sum()), shards // 2
    take = _draw(counts, total * left // shards, rng)
    return np.concatenate([split(take, left, rng), split(counts - take, shards - left, rng)])


def _grow(counts: DataFrame, shards: int, seed: int, fan: int = FAN) -> DataFrame:
    """(shard, source, quota): the leaves of the splitting tree over ``counts`` (source, n), quotas of 0 left out.

    Each round splits every node into up to ``fan`` parts of equal width; the draws
    of a node depend on the seed and the node alone.
    """
    width, levels = shards, []
    while width > 1:
        levels.append(width)
        width = -(-width // fan)
    nodes = counts.select(F.lit(0).cast("long").alias("first"), F.lit(shards).cast("long").alias("shards"), "source", F.col("n").alias("quota"))
    for _ in levels:

        def part(pdf: pd.DataFrame) -> pd.DataFrame:
            first, n = int(pdf["first"].iloc[0]), int(pdf["shards"].iloc[0])
            if n <= 1:
                return pdf
            names = pdf["source"].where(pdf["source"].notna(), None)
            order = sorted(range(len(pdf)), key=lambda i: (names.iloc[i] is None, names.iloc[i] or ""))
            rng, out = np.random.default_rng([seed, first, n]), []
            step = -(-n // fan)

            def down(quota: np.ndarray, at: int, size: int) -> None:
                if size <= step:
                    some = np.flatnonzero(quota)
                    out.append(pd.DataFrame({"first": at, "shards": size, "source": [names.iloc[order[i]] for i in some], "quota": quota[some]}))
                    return
                left = max(step, size // 2 // step * step)
                take = _draw(quota, int(quota.sum()) * left // size, rng)
                down(take, at, left)
                down(quota - take, at + left, size - left)

            down(pdf["quota"].to_numpy()[order].astype(np.int64), first, n)
            return pd.concat(out)

        nodes = nodes.groupBy("first", "shards").applyInPandas(part, "first long, shards long, source string, quota long")
    return nodes.select(F.col("first").alias("shard"), "source", "quota")


def _before(rows: DataFrame, key: list[str], order: str, sums: list[str], group: int = GROUP_BUCKETS) -> DataFrame:
    """``rows`` with, for each of ``sums``, its sum over the rows of smaller ``order`` (column name + 0); two levels of ``group`` numbers each."""
    part = rows.withColumn("g_", F.floor(F.col(order) / group))
    whole = part.groupBy(*key, "g_").agg(*[F.sum(c).alias(f"{c}g_") for c in sums])
    over = Window.partitionBy(*key).orderBy("g_").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*[F.col(k).alias(f"{k}w_") for k in key], F.col("g_").alias("gw_"), *[F.coalesce(F.sum(f"{c}g_").over(over), F.lit(0)).alias(f"{c}g_") for c in sums])
    same = F.col("g_") == F.col("gw_")
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"{k}w_"))
    inside = Window.partitionBy(*key, "g_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = part.join(whole, same)
    for c in sums:
        out = out.withColumn(f"{c}0", F.col(f"{c}g_") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.select(*rows.columns, *[f"{c}0" for c in sums])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, seed: int = 0, block_words: int = BLOCK_WORDS, shard_pieces: int = SHARD_PIECES) -> tuple[DataFrame, DataFrame]:
    """(sized, pieces). sized: one row for each document, with its source's size and target.

    pieces: one row for each stretch of a document that the mix takes: doc_id,
    source, copy (tells repeated rows apart), size, block, pass, words, shard.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"))
    same = Window.partitionBy("doc_id", "source", "size").orderBy("size")
    sized = stored(sized.withColumn("copy", F.row_number().over(same)), "sizes")
    blocks_of = F.ceil(F.col("size") / block_words)
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.sum(blocks_of).alias("blocks")).collect()
    sizes = {r["source"]: r["size"] for r in rows}
    target = targets(sizes, weights)
    plan = []
    for r in rows:
        quota = round(target[r["source"]])
        size = max(1, r["size"])
        plan.append((r["source"], r["size"], target[r["source"]], quota // size, quota % size, r["blocks"], max(1, -(-r["blocks"] // BUCKET_BLOCKS))))
    plan_df = spark.createDataFrame(plan, "source string, source_size long, target double, passes long, rest long, blocks long, buckets long")
    plan_df = plan_df.coalesce(1)
    sized = sized.join(plan_df, sized["source"].eqNullSafe(plan_df["source"]), "left").drop(plan_df["source"])

    h = F.xxhash64(F.lit(seed), F.coalesce("source", F.lit("\0")), "doc_id", "copy", "block")
    blocks = (
        sized.where("size > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), blocks_of.cast("long") - 1)))
        .withColumn("in_block", F.least(F.lit(block_words), F.col("size") - F.col("block") * block_words))
        .withColumn("h", F.shiftrightunsigned(h, 33))
        .withColumn("bucket", F.expr("shiftright(h * buckets, 31)"))
    )
    by_bucket = blocks.groupBy("source", "bucket").agg(F.sum("in_block").alias("w"), F.count("*").alias("n"))
    offsets = _before(by_bucket, ["source"], "bucket", ["w", "n"]).select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), "w0", "n0")
    inside = Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "copy", "size", "block")
    ranked = blocks.withColumn("w1", F.sum("in_block").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("in_block")).withColumn("n1", F.row_number().over(inside) - 1)
    ranked = ranked.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")))
    ranked = ranked.withColumn("rank", F.col("n0") + F.col("n1")).withColumn("last", F.least(F.greatest(F.col("rest") - F.col("w0") - F.col("w1"), F.lit(0)), F.col("in_block")))
    pieces = (
        ranked.withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("passes"))))
        .withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("in_block")).otherwise(F.col("last")))
        .where("words > 0")
        .withColumn("number", F.col("pass") * F.col("blocks") + F.col("rank"))
        .select("doc_id", "source", "copy", "size", "block", "pass", "words", "number", "h")
    )
    pieces = stored(pieces, "pieces")
    counts = stored(pieces.groupBy("source").agg(F.count("*").alias("n")), "counts")
    shards = max(1, -(-(counts.agg(F.sum("n")).first()[0] or 0) // shard_pieces))
    quotas = _before(stored(_grow(counts, shards, seed), "quotas"), ["source"], "shard", ["quota"])
    # a source's pieces lie in the shards one after the other: each quota stands for a range of numbers
    numbers = F.explode(F.sequence(F.col("quota0"), F.col("quota0") + F.col("quota") - 1))
    dealt = quotas.select(F.col("source").alias("q_source"), F.col("shard"), numbers.alias("q_place"))
    same = F.col("source").eqNullSafe(F.col("q_source")) & (F.col("number") == F.col("q_place"))
    return sized, pieces.join(dealt.hint("merge"), same).drop("q_source", "q_place")


def shuffled(pieces: DataFrame, seed: int = 0) -> DataFrame:
    """Pieces in their shards, with a place in each shard's own permutation."""
    w = Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "source", "number"), "source", "number")
    return pieces.withColumn("place", F.row_number().over(w))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """For each document: size, its source's size and target, the words that the shards hold of it, and its first place in them."""
    sized, pieces = mix(docs, **kw)
    mixture = stored(shuffled(pieces, kw.get("seed", 0)).select("doc_id", "source", "copy", "size", "words", "shard", "place"), "mixture")
    taken = mixture.groupBy("doc_id", "source", "copy", "size").agg(F.sum("words").alias("taken"), F.min(F.struct("shard", "place")).alias("first"))
    s, t = sized.alias("s"), taken.alias("t")
    same = F.col("s.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("s.source").eqNullSafe(F.col("t.source")) & (F.col("s.copy") == F.col("t.copy")) & (F.col("s.size") == F.col("t.size"))
    columns = ["s.doc_id", "s.source", "s.size", "s.source_size", "s.target", F.coalesce("t.taken", F.lit(0)).cast("long").alias("taken")]
    return s.join(t, same, "left").select(*columns, F.col("t.first.shard").alias("first_shard"), F.col("t.first.place").cast("long").alias("first_place"))
