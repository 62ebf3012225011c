"""Benchmark decontamination with word suffix arrays.

Each shard (a bounded run of documents inside a partition) gets a suffix array
over its words; every suffix of every benchmark item is binary-searched in it,
which gives the suffix's longest verbatim match and all its places. A place
where a whole window matches marks the document's words as hit.

The array keeps only suffixes that can start a window: all words of the shortest
window that could start there occur in the benchmark. That drops no match of a
whole window and makes the array small. Nothing is shuffled: the benchmark is
read in blocks of at most BLOCK_BYTES of text, each block is broadcast and the
documents pass through one scan for each block, in one stage.

Defined results: null or word-less text has no words, no hits and is clean; an
item without words is skipped; the words of items with a null id are hit like
others, all such items count once in n_items and add nothing to items_sha256;
repeated items with equal text all count; an empty benchmark leaves every document clean; repeated document rows are judged
one by one; other columns pass through untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import fresh

WINDOW = 13
#: Text of the benchmark that one broadcast holds at most.
BLOCK_BYTES = 4 << 20
#: Text of the documents that one suffix array covers at most (a longer document has one of its own).
SHARD_BYTES = 16 << 20

#: Words are digits, letters a-z after lower-casing A-Z, and all bytes beyond ASCII.
_CLEAN = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("items", T.ArrayType(T.LongType())),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("longest_match", T.LongType()),
    ]
)


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_CLEAN).split() if text else []


class Block:
    """Benchmark items as word numbers, and all their suffixes."""

    def __init__(self, items: list[tuple[int, bytes]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        number = self.vocab.setdefault
        tokens, owner, left = [], [], []
        self.item_ids, spans = [], []
        for item_id, text in items:
            ws = words(text)
            if not ws:
                continue
            ids = [number(w, len(self.vocab) + 1) for w in ws]
            tokens += ids
            owner += [len(self.item_ids)] * len(ids)
            left += range(len(ids), 0, -1)
            spans += [len(ids)] * len(ids)
            self.item_ids.append(item_id)
        self.owner, self.left = np.array(owner, np.int64), np.array(left, np.int64)
        self.depth = int(self.left.max()) if len(self.left) else 0
        self.tokens = np.concatenate([np.array(tokens, np.int64), np.zeros(self.depth + 3, np.int64)])
        size = np.array(spans, np.int64)
        whole = np.minimum(size, window)  # words of a window that starts in this item
        self.starts = np.where((self.left >= whole) & ((size >= window) | (self.left == size)), whole, 0)
        self.shorts = sorted({int(n) for n in self.starts if 0 < n < window})
        self.short_firsts = {n: np.unique(self.tokens[: len(size)][self.starts == n]) for n in self.shorts}


def suffix_array(tokens: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """``at`` in the order of the words that follow each place, ``depth`` words deep.

    Groups of equal prefixes are refined two words at a time; resolved
    suffixes take no further part. ``tokens`` ends in depth + 3 zeros.
    """
    order = at[np.argsort(tokens[at], kind="stable")]
    first = tokens[order]
    group = np.zeros(len(order), np.int64)
    np.cumsum(first[1:] != first[:-1], out=group[1:])
    open_ = np.arange(len(order))
    for d in range(1, depth, 2):
        g = group[open_]
        twin = np.zeros(len(open_), bool)
        twin[1:] = g[1:] == g[:-1]
        twin[:-1] |= twin[1:]
        open_ = open_[twin]
        if not len(open_):
            break
        p, g = order[open_], group[open_]
        key = tokens[p + d] << 31 | tokens[p + d + 1]
        by = np.lexsort((key, g))
        order[open_] = p[by]
        key, g = key[by], g[by]
        new = np.zeros(len(g), bool)
        new[1:] = (g[1:] == g[:-1]) & (key[1:] != key[:-1])
        # a group's number is its first slot: unique and in order
        start = np.zeros(len(g), np.int64)
        head = np.concatenate([[True], (g[1:] != g[:-1]) | new[1:]])
        start[head] = open_[head]
        group[open_] = np.maximum.accumulate(start)
    return order


def _bound(tokens, sa, lo, hi, want, d, right):
    lo, hi = lo.copy(), hi.copy()
    while (active := lo < hi).any():
        mid = (lo + hi) >> 1
        seen = tokens[sa[np.where(active, mid, 0)] + d]
        up = active & ((seen <= want) if right else (seen < want))
        lo = np.where(up, mid + 1, lo)
        hi = np.where(active & ~up, mid, hi)
    return lo


def search(block: Block, tokens: np.ndarray, sa: np.ndarray):
    """For every benchmark suffix: its longest match, and the window's range in ``sa`` (empty: lo == hi)."""
    n = len(block.owner)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(sa), np.int64)
    longest, win = np.zeros(n, np.int64), np.zeros((2, n), np.int64)
    live = np.arange(n) if len(sa) else np.zeros(0, np.int64)
    for d in range(block.depth):
        live = live[block.left[live] > d]
        if not len(live):
            break
        want = block.tokens[live + d]
        a = _bound(tokens, sa, lo[live], hi[live], want, d, False)
        b = _bound(tokens, sa, a, hi[live], want, d, True)
        lo[live], hi[live] = a, b
        live = live[b > a]
        longest[live] = d + 1
        done = live[block.starts[live] == d + 1]
        win[0, done], win[1, done] = lo[done], hi[done]
    return longest, win


def _shard(block: Block, texts: list[bytes | None]):
    """For each text: number of words, hit spans as (start, length), items and the longest match."""
    split = [words(t) for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])  # a zero ends each document
    tokens = np.zeros(int(starts[-1]) + block.depth + 3, np.int64)
    get = block.vocab.get
    for s, ws in zip(starts, split, strict=False):
        tokens[s : s + len(ws)] = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
    del split
    places = np.arange(len(tokens))
    breaks = np.where(tokens == 0, places, len(tokens))
    run = np.minimum.accumulate(breaks[::-1])[::-1] - places  # known words in a row from here
    keep = run >= block.window
    for n in block.shorts:
        keep |= (run >= n) & np.isin(tokens, block.short_firsts[n])
    sa = suffix_array(tokens, np.flatnonzero(keep), block.depth)
    _, win = search(block, tokens, sa)
    spans, items = {}, {}
    best = np.zeros(len(texts), np.int64)
    found = np.flatnonzero(win[1] > win[0])
    if len(found):
        ranges, which = np.unique(np.stack([win[0, found], win[1, found], block.starts[found]]), axis=1, return_inverse=True)
        cover = np.zeros(len(tokens) + 1, np.int64)
        pairs = []
        for k, (a, b, size) in enumerate(ranges.T):
            p = sa[a:b]
            np.add.at(cover, p, 1)
            np.add.at(cover, p + size, -1)
            docs = np.unique(np.searchsorted(starts, p, "right") - 1)
            pairs.append(np.stack([docs, np.full(len(docs), k)]))
        hit = np.cumsum(cover[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]])))
        for a, b in edges.reshape(-1, 2):
            d = int(np.searchsorted(starts, a, "right") - 1)
            spans.setdefault(d, []).append((int(a - starts[d]), int(b - a)))
        members = [[] for _ in ranges.T]
        for f, k in zip(found, which.ravel(), strict=True):
            members[k].append(block.item_ids[block.owner[f]])
        for d, k in np.concatenate(pairs, axis=1).T:
            items.setdefault(int(d), set()).update(members[k])
        for d, s in spans.items():
            best[d] = max(n for _, n in s)
    return sizes, spans, items, best


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, n in sorted(spans):
        if out and a <= out[-1][0] + out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], a + n - out[-1][0]))
        else:
            out.append((a, n))
    return out


def _scan(bc, text: str, report: str):
    """mapInArrow function: adds or extends the report column for one block of the benchmark."""
    kind = pa.struct(
        [(f.name, pa.string() if f.name == "items_sha256" else pa.list_(pa.int64()) if f.name in ("items", "spans") else pa.int64()) for f in REPORT]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = bc.value
        for whole in batches:
            at, batch_text = 0, whole.column(text).cast(pa.large_binary())
            while at < len(whole):
                values, size = [], 0
                while at + len(values) < len(whole) and (not values or size < SHARD_BYTES):
                    v = batch_text[at + len(values)].as_py()
                    values.append(v)
                    size += len(v or b"")
                part = whole.slice(at, len(values))
                at += len(values)
                sizes, spans, items, best = _shard(block, values)
                before = part.column(report).to_pylist() if report in part.schema.names else [None] * len(values)
                rows = []
                for d, old in enumerate(before):
                    s, i, m = spans.get(d, []), items.get(d, set()), int(best[d])
                    if old:
                        s = _merged([*s, *zip(old["spans"][::2], old["spans"][1::2], strict=True)])
                        i, m = i | set(old["items"]), max(m, old["longest_match"])
                    ids = sorted(i, key=str)
                    rows.append(
                        {
                            "n_words": int(sizes[d]),
                            "n_hit": sum(n for _, n in s),
                            "n_items": len(ids),
                            "items_sha256": hashlib.sha256(",".join(str(x) for x in ids if x is not None).encode()).hexdigest(),
                            "items": ids,
                            "spans": [x for pair in s for x in pair],
                            "longest_match": m,
                        }
                    )
                columns = [part.column(n) for n in part.schema.names if n != report] + [pa.array(rows, kind)]
                names = [n for n in part.schema.names if n != report] + [report]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark's items in blocks of at most ``limit`` bytes of text, streamed partition by partition."""
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t IS NOT NULL").toLocalIterator():
        raw = row["t"].encode()
        if held and size + len(raw) > limit:
            yield held
            held, size = [], 0
        held.append((row["i"], raw))
        size += len(raw)
    yield held


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """``docs`` with a report column, and that column's name.

    The report holds n_words, n_hit, n_items, items_sha256, items, spans (flat
    list of word start and length of the hit stretches) and longest_match (words
    of the longest hit stretch).
    """
    spark = docs.sparkSession
    report = fresh(docs, "contamination")
    out = docs
    for items in blocks(benchmark, item_id, item_text, block_bytes):
        schema = T.StructType([f for f in docs.schema.fields] + [T.StructField(report, REPORT)])
        out = out.mapInArrow(_scan(spark.sparkContext.broadcast(Block(items, window)), text, report), schema)
    return out, report


def is_contaminated(report: str):
    """At least one hit word, and at least one word in twenty hit."""
    r = F.col(report)
    return (r["n_hit"] > 0) & (20 * r["n_hit"] >= r["n_words"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents that the benchmark doesn't contaminate, with their own columns."""
    out, report = contamination(docs, benchmark, **kw)
    return out.where(~is_contaminated(report)).select(*[F.col(f"`{c}`") for c in docs.columns])


def longest_matches(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """For every benchmark suffix with a match of at least a window: its longest match and where it is.

    One row for each (item, word offset) of the longest match over all shards,
    with the number of places and the smallest document holding it.
    """
    spark = docs.sparkSession
    parts = []
    for items in blocks(benchmark, item_id, item_text):
        bc = spark.sparkContext.broadcast(Block(items, window))

        def run(batches, bc=bc):
            block = bc.value
            whole = np.array([0, *np.flatnonzero(np.diff(block.owner) > 0) + 1], np.int64)
            for batch in batches:
                texts = batch.column("t").cast(pa.large_binary()).to_pylist()
                ids = batch.column("d").to_pylist()
                split = [words(t) for t in texts]
                starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in split])])
                tokens = np.zeros(int(starts[-1]) + block.depth + 3, np.int64)
                for s, ws in zip(starts, split, strict=False):
                    tokens[s : s + len(ws)] = [block.vocab.get(w, 0) for w in ws]
                sa = suffix_array(tokens, np.flatnonzero(tokens), block.depth)
                longest, _ = search(block, tokens, sa)
                rows = []
                for f in np.flatnonzero(longest >= np.where(block.starts > 0, block.starts, window)):
                    lo, hi = np.zeros(1, np.int64), np.full(1, len(sa), np.int64)
                    for d in range(int(longest[f])):
                        want = block.tokens[f + d : f + d + 1]
                        lo, hi = _bound(tokens, sa, lo, hi, want, d, False), _bound(tokens, sa, lo, hi, want, d, True)
                    docs_here = [ids[int(np.searchsorted(starts, p, "right") - 1)] for p in sa[lo[0] : hi[0]]]
                    first = min((x for x in docs_here if x is not None), default=None)
                    item = int(block.owner[f])
                    rows.append({"item_id": block.item_ids[item], "offset": int(f - whole[item]), "length": int(longest[f]), "places": len(docs_here), "doc_id": first})
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("item_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64()), ("places", pa.int64()), ("doc_id", pa.int64())]))

        parts.append(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, "item_id long, offset long, length long, places long, doc_id long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    top = Window.partitionBy("item_id", "offset")
    return (
        out.withColumn("top", F.max("length").over(top))
        .where("length = top")
        .groupBy("item_id", "offset", "length")
        .agg(F.sum("places").alias("places"), F.min("doc_id").alias("doc_id"))
    )
