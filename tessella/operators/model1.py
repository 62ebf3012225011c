"""IBM model 1 in blocks of target words.

A block holds all places of its target words, each with the source words of its sentence pair, as sorted numbers, and makes its cells
(row, source, target) anew in each round, in memory; cells are never written. A word pair is in one block alone and counted there. Only the
totals of source words, and the pairs of a target word too common for one block, are shared: of these each block sends its part of the
count to the bucket of the pair and gets the sum back, in the same order. The total of a source word is such a pair, with a target of its
own. What a block keeps of a round is the sums it got, from which it finds its own pairs' probabilities again. Blocks stay where they were
dealt.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import cut
from .tables import written

#: Cells of a block; a target word with more than half of that is dealt to several.
CELLS = 4_000_000
ROW = "block int, bucket int, kind string, blob binary"


def _packed(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, *arrays)
    return zlib.compress(out.getvalue(), 1)


def _unpacked(blob: bytes) -> list[np.ndarray]:
    with np.load(io.BytesIO(zlib.decompress(blob))) as found:
        return [found[f"arr_{i}"] for i in range(len(found.files))]


def _rows(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["block", "bucket", "kind", "blob"])


def numbered(words: DataFrame) -> tuple[DataFrame, int]:
    """(word, number) of the distinct ``words``, numbered from 0 without gaps, and how many there are."""
    w = cut(words.distinct())
    place, at = F.monotonically_increasing_id(), F.spark_partition_id()
    counts = {r["p"]: r["n"] for r in w.groupBy(at.alias("p")).agg(F.count("*").alias("n")).collect()}
    before, first = 0, []
    for p in sorted(counts):
        first += [F.lit(p), F.lit(before)]
        before += counts[p]
    if not before:
        return w.withColumn("number", F.lit(0).cast("long")), 0
    start = F.try_element_at(F.create_map(*first), at)
    return cut(w.withColumn("number", start.cast("long") + F.pmod(place, F.lit(1 << 33)))), before


def _mixed(number: np.ndarray, parts: int) -> np.ndarray:
    return (((number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its length."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


def _dealt(pdf: pd.DataFrame, hot: np.ndarray, times: np.ndarray, blocks: int):
    """(block, its target words of these rows, with the sources of their rows), packed. A target of ``hot`` is dealt to so many blocks by its row."""
    flat = lambda c: np.concatenate([np.asarray(v, np.int32) for v in pdf[c]])
    a, an, b, bn = (flat(c) for c in ("a", "an", "b", "bn"))
    sizes, targets = (np.array([len(v) for v in pdf[c]]) for c in ("a", "b"))
    starts, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(pdf)), targets)
    block = _mixed(b, blocks)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, b), len(hot) - 1)
        among = np.where(hot[at] == b, times[at], 1)
        block = (block + pdf["_id"].to_numpy()[row] % among) % blocks
    order = np.lexsort((b, row, block))
    for part in np.split(order, np.flatnonzero(np.diff(block[order])) + 1):
        rows, n = np.unique(row[part], return_counts=True)
        own = _ranges(starts[rows], sizes[rows])
        yield int(block[part[0]]), _packed(a[own], an[own], np.cumsum(sizes[rows]), b[part], bn[part], np.cumsum(n))


def _joined(blobs) -> bytes:
    """Packed parts of a block as one."""
    parts = [_unpacked(x) for x in blobs]
    out = [np.concatenate([p[i] for p in parts]) for i in range(6)]
    for i in (2, 5):
        before = np.cumsum([0] + [p[i][-1] for p in parts[:-1]])
        out[i] = np.concatenate([p[i] + n for p, n in zip(parts, before, strict=True)])
    return _packed(*out)


class Block:
    """The cells of a block: ``keys`` are pairs and, last of each source, its total; ``pair`` and ``place`` lead from a cell to its key and
    target position, ``of`` to the keys of a bucket that other blocks may have too."""

    def __init__(self, blob: bytes, size: int, buckets: int, hot: np.ndarray):
        a, an, a_ends, b, bn, b_ends = _unpacked(blob)
        a, an, b, bn = a.astype(np.int64), an.astype(float), b.astype(np.int64), bn.astype(float)
        cells, place, ns, at, bt = [], [], [], 0, 0
        for ae, be in zip(a_ends.tolist(), b_ends.tolist(), strict=True):
            n, m = ae - at, be - bt
            cells.append((a[at:ae, None] * size + b[None, bt:be]).ravel())
            place.append(np.tile(np.arange(bt, be, dtype=np.int32), n))
            ns.append(np.repeat(an[at:ae], m))
            at, bt = ae, be
        pairs, pair = np.unique(np.concatenate(cells), return_inverse=True)
        totals = np.unique(a) * size + (size - 1)
        self.keys = np.concatenate([pairs, totals])
        order = np.argsort(self.keys, kind="stable")
        new = np.empty(len(order), np.int32)
        new[order] = np.arange(len(order), dtype=np.int32)
        self.keys, self.pair = self.keys[order], new[pair]
        self.place, self.ns, self.nt = np.concatenate(place), np.concatenate(ns), bn
        self.total = self.keys % size == size - 1
        self.source = np.cumsum(self.total) - self.total
        maybe = np.flatnonzero(self.total | np.isin(self.keys % size, hot))
        bucket = _mixed(self.keys[maybe], buckets)
        self.order = maybe[np.argsort(bucket, kind="stable")]
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])

    def of(self, bucket: int) -> np.ndarray:
        return self.order[self.ends[bucket] : self.ends[bucket + 1]]

    def sums(self, prob: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, prob[self.pair] * self.ns, minlength=len(self.nt))

    def counts(self, prob: np.ndarray, sums: np.ndarray) -> np.ndarray:
        share = np.divide(self.nt, sums, out=np.zeros(len(sums)), where=sums > 0)
        c = np.bincount(self.pair, prob[self.pair] * self.ns * share[self.place], minlength=len(self.keys))
        c[self.total] = np.bincount(self.source, c)
        return c


def _state(pdf: pd.DataFrame, size: int, words: int, buckets: int, hot: np.ndarray):
    """The block, its marks (0 own, 1 shared, 2 shared and given out here), what it kept, its probabilities, and by how much they moved."""
    by = {kind: part.sort_values("bucket") for kind, part in pdf.groupby("kind")}
    block = Block(by["data"]["blob"].iloc[0], size, buckets, hot)
    marks = np.zeros(len(block.keys), np.uint8)
    for bucket, blob in zip(by["mark"]["bucket"], by["mark"]["blob"], strict=True):
        marks[block.of(bucket)] = _unpacked(blob)[0]
    shared = block.order[marks[block.order] > 0]
    prob, before, kept = np.full(len(block.keys), 1.0 / words), None, []
    if "kept" in by:
        *kept, old = _unpacked(by["kept"]["blob"].iloc[0])
        kept.append(np.concatenate([_unpacked(b)[0] for b in by["sum"]["blob"]]) if len(shared) else np.zeros(0))
        for given in kept:
            before, c = prob, block.counts(prob, block.sums(prob))
            c[shared] = given
            prob = np.divide(c, c[block.total][block.source], out=np.zeros(len(c)), where=c > 0)
        if len(old):
            before = before.copy()
            before[shared] = old
    moved = None if before is None else float(np.abs(prob - before)[~block.total].max())
    return block, marks, shared, kept, prob, moved


def _stay(rows: DataFrame, parts: int) -> DataFrame:
    """``rows`` dealt by their block, cut: what comes to a block is sent there, the block itself no more. An adaptive plan would forget how they are dealt."""
    conf = rows.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(rows.repartition(parts, "block"))
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def expectation_maximisation(rows: DataFrame, rounds: int, tolerance: float, cells: int | None = None) -> DataFrame:
    """(s, t, prob) after ``rounds`` from a uniform start over ``rows`` (a, b), lists of words; ends early once no probability moves by ``tolerance``."""
    cells = cells or CELLS
    counted = lambda c, w: F.explode(c).alias(w)
    rows = cut(rows.withColumn("_id", F.monotonically_increasing_id()))
    a, b = rows.select("_id", counted("a", "word"), F.lit(0).alias("side")), rows.select("_id", counted("b", "word"), F.lit(1).alias("side"))
    tokens = written(a.unionByName(b).where("word IS NOT NULL").groupBy("_id", "side", "word").agg(F.count("*").alias("n")), "tokens")
    dictionary, size = numbered(tokens.select("word"))
    size += 1  # the last number is the target of totals
    words = tokens.where("side = 1").select("word").distinct().count() or 1
    side = lambda i: F.sort_array(F.collect_list(F.when(F.col("side") == i, F.struct(F.col("number").cast("int").alias("number"), F.col("n").cast("int").alias("n")))))
    pairs = tokens.join(dictionary, "word").groupBy("_id").agg(side(0).alias("a"), side(1).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    pairs = written(pairs.select("_id", F.col("a.number").alias("a"), F.col("a.n").alias("an"), F.col("b.number").alias("b"), F.col("b.n").alias("bn")), "pairs")
    whole = pairs.agg(F.sum(F.size("a").cast("long") * F.size("b"))).first()[0] or 0
    blocks = int(max(1, -(-whole // cells)))
    buckets = -(-blocks // 4)
    # target words too common for one block: two for each block at most
    most = max(1, cells // 2)
    common = pairs.select(F.size("a").alias("n"), F.explode("b").alias("t")).groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") > most)
    common = sorted((r["t"], min(blocks, -(-r["n"] // most))) for r in common.collect()) if blocks > 1 else []
    hot, times = (np.array([x[i] for x in common], np.int64) for i in (0, 1))

    def pieces(batches):
        for pdf in batches:
            # so many cells at a time, at least a row
            group = np.cumsum([len(a) * len(b) for a, b in zip(pdf["a"], pdf["b"], strict=True)]) // (8 * cells)
            for _, some in pdf.groupby(group):
                for block, blob in _dealt(some, hot, times, blocks):
                    yield _rows([(block, -1, "piece", blob)])

    def data(pdf: pd.DataFrame) -> pd.DataFrame:
        name, blob = pdf["block"].iloc[0], _joined(sorted(pdf["blob"]))
        block = Block(blob, size, buckets, hot)
        own = [(r, block.keys[block.of(r)]) for r in range(buckets)]
        return _rows([(name, -1, "data", blob)] + [(name, r, "keys", _packed(np.diff(k, prepend=0))) for r, k in own if len(k)])

    def places(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out, at = pdf.sort_values("block"), [], 0
        lists = [np.cumsum(_unpacked(x)[0]) for x in pdf["blob"]]
        _, first, where, times = np.unique(np.concatenate(lists), return_index=True, return_inverse=True, return_counts=True)
        shared = times > 1
        number = np.cumsum(shared) - 1
        for block, own in zip(pdf["block"], lists, strict=True):
            mine = where[at : at + len(own)]
            mark = shared[mine].astype(np.uint8) * (1 + (first[mine] == np.arange(at, at + len(own))))
            out.append((block, pdf["bucket"].iloc[0], "mark", _packed(mark.astype(np.uint8))))
            if mark.any():
                out.append((block, pdf["bucket"].iloc[0], "place", _packed(np.diff(number[mine[mark > 0]], prepend=0))))
            at += len(own)
        return _rows(out)

    def sent(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["block"].iloc[0]
        block, marks, shared, kept, prob, moved = _state(pdf, size, words, buckets, hot)
        c = block.counts(prob, block.sums(prob))
        old = prob[shared] if tolerance else np.zeros(0)
        out = [(name, -1, "kept", _packed(*kept, old)), (name, -1, "moved", _packed(np.array([np.inf if moved is None else moved])))]
        for r in range(buckets):
            mine = block.of(r)
            mine = mine[marks[mine] > 0]
            if len(mine):
                out.append((name, r, "part", _packed(c[mine])))
        return _rows(out)

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        at, part = pdf[pdf["kind"] == "place"], pdf[pdf["kind"] == "part"]
        at = [np.cumsum(_unpacked(x)[0]) for x in at["blob"]]
        total = np.bincount(np.concatenate(at), np.concatenate([_unpacked(x)[0] for x in part["blob"]]))
        return _rows([(block, bucket, "sum", _packed(total[x])) for block, bucket, x in zip(part["block"], part["bucket"], at, strict=True)])

    def given(pdf: pd.DataFrame) -> pd.DataFrame:
        block, marks, _, _, prob, _ = _state(pdf, size, words, buckets, hot)
        mine = (marks != 1) & ~block.total
        return pd.DataFrame({"_s": block.keys[mine] // size, "_t": block.keys[mine] % size, "prob": prob[mine]})

    # parts by number, as few bytes here mean much work
    by = lambda df, column, f, schema=ROW: df.repartition(blocks, column).groupBy(column).applyInPandas(f, schema)
    made = written(by(pairs.mapInPandas(pieces, ROW), "block", data), "blocks")
    spots = written(by(made.where("kind = 'keys'"), "bucket", places), "places")
    held = _stay(made.where("kind = 'data'").unionByName(spots.where("kind = 'mark'")), max(2, blocks))  # of a single part Spark makes no use
    now = None

    def beside(f, schema=ROW):
        """``f`` of each block with what came to it."""
        if now is None:
            return held.groupBy("block").applyInPandas(f, schema)
        return held.groupBy("block").cogroup(now.groupBy("block")).applyInPandas(lambda own, come: f(pd.concat([own, come], ignore_index=True)), schema)

    for i in range(rounds):
        parts = written(beside(sent), "parts")
        if tolerance and i:
            moved = max((float(_unpacked(r["blob"])[0][0]) for r in parts.where("kind = 'moved'").select("blob").toLocalIterator()), default=0.0)
            if moved < tolerance:
                break
        sums = by(spots.where("kind = 'place'").unionByName(parts.where("kind = 'part'")), "bucket", summed)  # on their way to the next round
        now = parts.where("kind = 'kept'").unionByName(sums)
    found = beside(given, "_s long, _t long, prob double")
    name = lambda c, w: dictionary.select(F.col("number").alias(c), F.col("word").alias(w))
    return found.join(name("_s", "s"), "_s").join(name("_t", "t"), "_t").select("s", "t", "prob")
