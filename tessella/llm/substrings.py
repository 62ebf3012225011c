"""Removal of repeated byte strings with suffix arrays over content-dealt shards.

A byte goes if a SPAN-byte string that also starts earlier (smaller document, or
same document and earlier start) covers it.

Dealing. Every SPAN-byte string has an anchor: the leftmost GRAM-byte piece with
the least hash in it. Equal strings have equal anchors at equal places, so all
candidates for a match meet in the shard of their anchor, and no shard has to be
compared with every other. Neighbouring strings with one anchor form a site; a
site's context is the bytes of all its strings. Sites of equal contexts (a copied
passage, say) say nothing new beyond the first: they are repeats outright, known by
128 bits of hashes of the anchor and the context. Of the others, sites of anchors
with several contexts go on as bytes.

Suffix arrays. A shard is a run of such contexts of at most twice SHARD_BYTES. Its
suffixes get ranks by Larsson-Sadakane doubling in numpy: by 8 bytes, then by 16,
32, 64. They order the shard's strings; the common prefixes of neighbours (Kasai's
values, read off the rank levels instead of a loop over bytes) decide: neighbours
with SPAN bytes in common are one class, whose first member stays.

Merging. An anchor may span several shards: hot anchors (a line in a third of all
documents, say), found beforehand with a counting sketch of fixed size over all
documents, are dealt to several tasks by context, and a task cuts what is too much
for one shard. Each such shard hands on one string for each class, as bytes; sorted
runs of them are merged across shards by binary search. No step holds more of an
anchor than a shard.

Defined results: null text is empty; texts shorter than SPAN lose nothing; rows
that repeat both id and text are one document and get equal results; different texts
under one id, as all with a null id, which come last, follow their 64-bit hashes; other
columns don't matter.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merkle import numbered
from .shared import stored
from .shingles import _powers, mix

SPAN = 100
GRAM = 32
#: Gram places in a string.
PLACES = SPAN - GRAM + 1
#: Starts of strings that one numpy pass takes at most; longer texts are cut into segments that overlap.
PASS_STARTS = 2 << 20
#: Text whose sites are combined before they leave the task.
COMBINE_BYTES = 16 << 20
#: Bytes of contexts in one suffix array; a shard ends at the next anchor, or at twice as many bytes.
SHARD_BYTES = 2 << 20
SKETCH_BITS = 20
#: An anchor is hot, and dealt to several tasks, beyond this many sites in its sketch bucket, or four times the mean.
HOT_SITES = 4096

_POSITION = np.uint64((1 << 24) - 1)


def _segments(texts: list[bytes | None]) -> Iterator[tuple[int, int, bytes]]:
    """(text number, offset, bytes) of pieces that together hold each start of a string once."""
    for i, t in enumerate(texts):
        if t is None or len(t) < SPAN:
            continue
        for at in range(0, len(t) - SPAN + 1, PASS_STARTS):
            yield i, at, t if len(t) <= PASS_STARTS else t[at : at + PASS_STARTS + SPAN - 1]


def _sites_of(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Sites of one numpy pass: text number, first start, last start less first, anchor less first, anchor, context."""
    b = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
    n = len(b)
    size = 1 << max(12, int(n).bit_length())
    up, down = _powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    grams = mix((total[GRAM:] - total[:-GRAM]) * down[: n - GRAM + 1])
    least = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = PLACES - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    anchor_at = (least & _POSITION).astype(np.int64)
    sizes = np.array([len(p) for _, _, p in pieces])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    valid = np.zeros(len(anchor_at) + 1, np.int8)
    np.add.at(valid, begins, 1)
    np.add.at(valid, np.minimum(ends - SPAN + 1, len(anchor_at)), -1)
    p = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
    new = np.ones(len(p), bool)
    new[1:] = (anchor_at[p[1:]] != anchor_at[p[:-1]]) | (p[1:] != p[:-1] + 1)
    piece = np.searchsorted(ends, p, "right")
    new[1:] |= piece[1:] != piece[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(p)) - 1
    lo, hi = p[first], p[last]
    at = anchor_at[lo]
    shape = ((hi - lo) << 7 | (at - lo)).astype(np.uint64)
    context = mix((total[hi + SPAN] - total[lo]) * down[lo] + mix(shape + np.uint64(1)))
    which = piece[first]
    owner = np.array([i for i, _, _ in pieces])[which]
    offset = np.array([o for _, o, _ in pieces])[which] - begins[which]
    return owner, lo + offset, hi - lo, at - lo, mix(grams[at]), context  # least hashes are small: mixed again


def sites(texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
    """All sites of ``texts`` (see _sites_of)."""
    out, held, size = [], [], 0
    for piece in _segments(texts):
        if held and size + len(piece[2]) > PASS_STARTS:
            out.append(_sites_of(held))
            held, size = [], 0
        held.append(piece)
        size += len(piece[2])
    if held:
        out.append(_sites_of(held))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# A place packs 17 bits of the text's hash (tells texts under one id apart), 31 of the first start, 7 of the
# number of further starts, 7 of the anchor's distance, and the hot mark; the numbers sort as places do.
def _pack(part: np.ndarray, lo: np.ndarray, more: np.ndarray, far: np.ndarray, hot: np.ndarray) -> np.ndarray:
    return part << 46 | lo << 15 | more << 8 | far << 1 | hot


def _unpack(place: np.ndarray) -> tuple[np.ndarray, ...]:
    return place >> 46, place >> 15 & (1 << 31) - 1, place >> 8 & 127, place >> 1 & 127, place & 1


def _text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Ids, hash parts and texts in runs of about COMBINE_BYTES."""
    ids, parts, texts, size = [], [], [], 0
    for batch in batches:
        for at in range(0, len(batch), 512):
            cut = batch.slice(at, 512)
            ids.append(cut.column("d").to_numpy(zero_copy_only=False))
            parts.append(cut.column("part").to_numpy(zero_copy_only=False))
            new = cut.column("t").to_pylist()
            texts += new
            size += sum(len(t) for t in new)
            if size >= COMBINE_BYTES:
                yield np.concatenate(ids), np.concatenate(parts), texts
                ids, parts, texts, size = [], [], [], 0
    if texts:
        yield np.concatenate(ids), np.concatenate(parts), texts


def _bucket(anchor: np.ndarray) -> np.ndarray:
    return (anchor >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


_CHUNK = 1 << 14


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for _, _, texts in _text_runs(batches):
        counts += np.bincount(_bucket(sites(texts)[4]), minlength=len(counts))
    rows = counts.reshape(-1, _CHUNK)
    yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([r.astype(np.uint32).tobytes() for r in rows], pa.binary())], ["chunk", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(raw, np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["chunk", "counts"])


def salts(plain: DataFrame) -> np.ndarray:
    """For each sketch bucket, the number of shards its anchors are dealt to; 1 unless hot."""
    summed = plain.mapInArrow(_count, "chunk int, counts binary").repartition(16, "chunk").mapInArrow(_add_up, "chunk int, counts binary").collect()
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in summed:
        counts[r["chunk"] * _CHUNK : (r["chunk"] + 1) * _CHUNK] = np.frombuffer(r["counts"], np.int64)
    limit = max(HOT_SITES, 4 * int(counts.sum()) >> SKETCH_BITS)
    return np.maximum(1, -(-counts // limit)).astype(np.uint32)


_SITES = "anchor long, context long, d long, place long"
_MARKS = "kind int, anchor long, d long, place long"


def _batch(names: list[str], arrays: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)


def _different(*sorted_columns: np.ndarray) -> list[np.ndarray]:
    """The rows without repeats of the row before: rows that repeat id and text give equal sites."""
    new = np.zeros(len(sorted_columns[0]), bool)
    new[:1] = True
    for c in sorted_columns:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in sorted_columns]


def _emit_sites(salts_bc):
    """Sites of a task, combined by run; a repeat found in the run leaves as a mark (context 0, dealt by its id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = salts_bc.value
        for ids, parts, texts in _text_runs(batches):
            owner, lo, more, far, anchor, context = sites(texts)
            if not len(owner):
                continue
            n = shards[_bucket(anchor)]
            hot = n > 1
            anchor = np.where(hot, mix(anchor + (context >> np.uint64(20)) % n.astype(np.uint64)), anchor)
            context |= np.uint64(1)
            d, place = ids[owner], _pack(parts[owner], lo, more, far, hot.astype(np.int64))
            by = np.lexsort((place, d, context, anchor))
            anchor, context, d, place = _different(anchor[by], context[by], d[by], place[by])
            again = np.zeros(len(d), bool)
            again[1:] = (anchor[1:] == anchor[:-1]) & (context[1:] == context[:-1])
            anchor[again] = mix(d[again].astype(np.uint64))
            context[again] = 0
            yield _batch(["anchor", "context", "d", "place"], [anchor.view(np.int64), context.view(np.int64), d, place])

    return run


class _Marks:
    """Reads sites in the order of anchor, context, d, place, and holds one row of an anchor at most."""

    def __init__(self) -> None:
        self.last: list | None = None  # the row before
        self.heads = 0  # contexts of its anchor so far
        self.pending: list | None = None  # the only one's first site

    def read(self, anchor: np.ndarray, context: np.ndarray, d: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        rows = [anchor, context, d, place]
        if self.last is not None:
            rows = [np.concatenate([[x], r]) for x, r in zip(self.last, rows, strict=True)]
        rows = _different(*rows)  # rows that repeat id and text give equal sites
        anchor, context, d, place = rows
        old = int(self.last is not None)
        new_anchor, new_context = np.ones(len(d), bool), np.ones(len(d), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_context[1:] = new_anchor[1:] | (context[1:] != context[:-1])
        known = context == 0
        repeat, head = known | ~new_context, new_context & ~known
        repeat[:old] = head[:old] = False
        group = np.cumsum(new_anchor) - 1
        count = np.bincount(group, head, minlength=group[-1] + 1).astype(np.int64)
        grown = old and count[0] > 0
        count[0] += self.heads if old else 0
        several = count[group] > 1
        keep = repeat | (head & (several | (place & 1 > 0)))  # other contexts of a hot anchor are in other tasks
        out = [(~repeat[keep]).astype(np.int32), anchor[keep], d[keep], place[keep]]
        if grown and self.pending is not None:
            out = [np.concatenate([o, np.array([x], o.dtype)]) for o, x in zip(out, [1, *self.pending], strict=True)]
            self.pending = None
        if group[-1] or not old:  # another anchor is the last one now
            self.pending = None
        at_last = head & (group == group[-1]) & ~keep
        if at_last.any():
            i = int(np.argmax(at_last))
            self.pending = [anchor[i], d[i], place[i]]
        self.heads = int(count[-1])
        self.last = [r[-1] for r in rows]
        return _batch(["kind", "anchor", "d", "place"], out)


def _mark_sites(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor, context, d, place. Kind 0: a repeat; kind 1: first of its context, and its anchor has others or is hot."""
    marks = _Marks()
    for batch in batches:
        if len(batch):
            yield marks.read(*(batch.column(n).to_numpy(zero_copy_only=False) for n in ("anchor", "context", "d", "place")))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cuts the contexts of a document's sites out of its text."""
    for batch in batches:
        for at in range(0, len(batch), 128):
            cut = batch.slice(at, 128)
            anchors, ds, places, raws = [], [], [], []
            for d, text, found in zip(cut.column("d").to_pylist(), cut.column("t").to_pylist(), cut.column("found").to_pylist(), strict=True):
                for x in found:
                    lo, more = x["place"] >> 15 & (1 << 31) - 1, x["place"] >> 8 & 127
                    anchors.append(x["anchor"])
                    ds.append(d)
                    places.append(x["place"])
                    raws.append(text[lo : lo + more + SPAN])
            yield pa.RecordBatch.from_arrays([pa.array(anchors, pa.int64()), pa.array(ds, pa.int64()), pa.array(places, pa.int64()), pa.array(raws, pa.binary())], ["anchor", "d", "place", "raw"])


def _dense(keys: np.ndarray) -> np.ndarray:
    """The rank of each key among the different keys."""
    by = np.argsort(keys)
    seen = keys[by]
    rank = np.empty(len(keys), np.uint64)
    new = np.zeros(len(keys), np.uint64)
    new[1:] = seen[1:] != seen[:-1]
    rank[by] = np.cumsum(new)
    return rank


def rank_levels(b: np.ndarray) -> dict[int, np.ndarray]:
    """Larsson-Sadakane doubling: for each depth the ranks of all suffixes by that many bytes (zeros follow the end)."""
    n = len(b)
    padded = np.zeros(n + 8, np.uint64)
    padded[:n] = b
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    out, depth = {8: _dense(key)}, 8
    while depth < 64:
        far = np.zeros(n, np.uint64)
        far[: max(0, n - depth)] = out[depth][depth:] + np.uint64(1)
        out[2 * depth] = _dense(out[depth] << np.uint64(32) | far)
        depth *= 2
    return out


def common_prefix(b: np.ndarray, levels: dict[int, np.ndarray], p: np.ndarray, q: np.ndarray, most: int = SPAN) -> np.ndarray:
    """Bytes that the suffixes at ``p`` and ``q`` have in common, ``most`` at most: Kasai's values, from the rank levels."""
    n, got = len(b), np.zeros(len(p), np.int64)
    for depth in [64, *sorted(levels, reverse=True), 4, 2, 1]:
        a, c = p + got, q + got
        inside = (np.maximum(a, c) + depth <= n) & (got + depth <= most + 63)
        a, c = np.where(inside, a, 0), np.where(inside, c, 0)
        if depth in levels:
            same = levels[depth][a] == levels[depth][c]
        else:
            same = np.ones(len(p), bool)
            for j in range(depth):
                same &= b[np.minimum(a + j, n - 1)] == b[np.minimum(c + j, n - 1)]
        got += depth * (inside & same)
    return np.minimum(got, most)


_RESOLVED = "kind int, raw binary, d long, part long, lo long, hi long"
_NAMES = ["kind", "raw", "d", "part", "lo", "hi"]


def _resolved(kind: int, raws: list[bytes | None], d: np.ndarray, part: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(d), kind, np.int32)), pa.array(raws, pa.binary()), *map(pa.array, (d, part, lo, hi))], _NAMES)


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs of neighbouring starts within a row; both sorted."""
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    return first, np.append(first[1:], len(row)) - 1


def resolve(d: np.ndarray, place: np.ndarray, raws: list[bytes]) -> Iterator[pa.RecordBatch]:
    """One shard: repeats as runs of starts (kind 0), and one string for each class of an anchor that other shards have too (kind 1)."""
    _, once = np.unique(np.stack([d, place]), axis=1, return_index=True)
    d, place, raws = d[once], place[once], [raws[i] for i in once]
    part, lo, more, _, shared = _unpack(place)
    whole = b"".join(raws)
    b = np.frombuffer(whole, np.uint8)
    begin = np.cumsum([0] + [len(r) for r in raws])[:-1]
    levels = rank_levels(b)
    row = np.repeat(np.arange(len(d)), more + 1)
    step = np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
    p = begin[row] + step
    earlier = np.empty(len(d), np.int64)
    earlier[np.lexsort((place, d))] = np.arange(len(d))
    # the shard's strings in order: SPAN bytes are two overlapping ranks; equal ones by where they start
    key = levels[64][p] << np.uint64(32) | levels[64][p + SPAN - 64]
    by = np.lexsort((earlier[row], key))
    near = np.flatnonzero(levels[64][p[by[1:]]] == levels[64][p[by[:-1]]])
    same = near[common_prefix(b, levels, p[by[near]], p[by[near + 1]]) >= SPAN]
    later = np.zeros(len(p), bool)
    later[by[same + 1]] = True
    if later.any():
        r, s = row[later], step[later]
        a, z = _runs(r, s)
        yield _resolved(0, [None] * len(a), d[r[a]], part[r[a]], lo[r[a]] + s[a], lo[r[a]] + s[z])
    first = ~later & (shared[row] > 0)
    if first.any():
        q, r, s = p[first], row[first], step[first]
        start = lo[r] + s
        yield _resolved(1, [whole[i : i + SPAN] for i in q.tolist()], d[r], part[r], start, start)


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by anchor. Shards end between anchors, or inside one that is too large: it is in several shards then."""
    anchors, ds, places, raws, size = [], [], [], [], 0
    spans = None  # the anchor that the shard before was cut in

    def shard(cut: int | None) -> Iterator[pa.RecordBatch]:
        shared = [p | 1 if a in (cut, spans) else p for a, p in zip(anchors, places, strict=True)]
        return resolve(np.array(ds, np.int64), np.array(shared, np.int64), raws)

    for batch in batches:
        for anchor, d, place, raw in zip(*(batch.column(n).to_pylist() for n in ("anchor", "d", "place", "raw")), strict=True):
            inside = bool(anchors) and anchor == anchors[-1]
            if size >= 2 * SHARD_BYTES or (size >= SHARD_BYTES and not inside):
                cut = anchor if inside else None
                yield from shard(cut)
                spans = cut
                anchors, ds, places, raws, size = [], [], [], [], 0
            anchors.append(anchor)
            ds.append(d)
            places.append(place)
            raws.append(raw)
            size += len(raw)
    if raws:
        yield from shard(None)


#: A string of SPAN bytes as numbers that sort as its bytes do.
_ORDER = np.dtype([(f"f{i}", ">u4") for i in range(SPAN // 4)])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Class strings of several shards come sorted, equal ones by where they start. One that stood before is a repeat."""
    before = None
    for batch in batches:
        if not len(batch):
            continue
        raws = batch.column("raw").to_pylist()
        d, part, lo = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("d", "part", "lo"))
        run = np.frombuffer(b"".join(raws), _ORDER)
        # each string's first place in the sorted run
        again = np.searchsorted(run, run, "left") < np.arange(len(run))
        again |= np.array([r == before for r in raws])
        before = raws[-1]
        yield _resolved(0, [None] * int(again.sum()), d[again], part[again], lo[again], lo[again])


def _spans(starts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by strings at the given ranges of starts."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(starts):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], hi + SPAN))
        else:
            out.append((lo, hi + SPAN))
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, len(batch), 256):
            cut = batch.slice(at, 256)
            sizes, spans, digests = [], [], []
            for text, found in zip(cut.column("t").to_pylist(), cut.column("found").to_pylist(), strict=True):
                gone = _spans([(x["lo"], x["hi"]) for x in found]) if found else []
                digest, last = hashlib.sha256(), 0
                for a, z in gone:
                    digest.update(text[last:a])
                    last = z
                digest.update(text[last:])
                sizes.append(len(text))
                spans.append([{"start": a, "end": z} for a, z in gone])
                digests.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([cut.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(digests)], ["doc_id", "n_bytes", "spans", "kept_sha256"])


def _release(df: DataFrame) -> None:
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(plain, starts). plain: doc_id, d, part, t of each row; starts: (d, part, lo, hi), ranges of starts of repeats."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    d = F.coalesce(F.col(doc_id).cast("long"), F.lit((1 << 63) - 1))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), d.alias("d"), F.xxhash64(t).alias("h"), t.cast("binary").alias("t"))
    if docs.groupBy(d.alias("d")).count().where("count > 1").limit(1).count():
        # Different texts under one id: each takes the number of its place by id, then by hash.
        names = numbered(plain.select("d", "h").distinct(), ["d", "h"]).select(F.col("d").alias("d_"), F.col("h").alias("h_"), "at")
        plain = plain.join(names, (F.col("d") == F.col("d_")) & (F.col("h") == F.col("h_"))).select("doc_id", F.col("at").alias("d"), "h", "t")
    plain = plain.select("doc_id", "d", F.shiftrightunsigned("h", 47).alias("part"), "t")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bc = spark.sparkContext.broadcast(salts(plain.select("d", "part", "t")))
    found = plain.select("d", "part", "t").mapInArrow(_emit_sites(bc), _SITES)
    marks = stored(found.repartition(parts, "anchor").sortWithinPartitions("anchor", "context", "d", "place").mapInArrow(_mark_sites, _MARKS), "marks")
    _release(docs)
    part_of = F.shiftright("place", 46)
    open_ = marks.where("kind = 1").groupBy("d", part_of.alias("part")).agg(F.collect_list(F.struct("anchor", "place")).alias("found"))
    contexts = plain.join(open_, ["d", "part"]).select("d", "t", "found").mapInArrow(_contexts, "anchor long, d long, place long, raw binary")
    resolved = stored(contexts.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(_resolve, _RESOLVED), "resolved")
    _release(docs)
    several = resolved.where("kind = 1")
    merged = several.repartition(parts, "raw").sortWithinPartitions("raw", "d", "part", "lo").mapInArrow(_merge, _RESOLVED)
    lo = F.shiftright("place", 15).bitwiseAND(F.lit((1 << 31) - 1))
    whole = marks.where("kind = 0").select("d", part_of.alias("part"), lo.alias("lo"), (lo + F.shiftright("place", 8).bitwiseAND(F.lit(127))).alias("hi"))
    some = resolved.where("kind = 0").select("d", "part", "lo", "hi")
    return plain, whole.unionByName(some).unionByName(merged.select("d", "part", "lo", "hi"))


def deduplicated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte ranges) and kept_sha256 for each row."""
    plain, starts = repeated(docs, doc_id, text)
    per_doc = starts.groupBy("d", "part").agg(F.collect_list(F.struct("lo", "hi")).alias("found"))
    return plain.join(per_doc, ["d", "part"], "left").select("doc_id", "t", "found").mapInArrow(_apply, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")


def span_report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    out = deduplicated_spans(docs, doc_id, text)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select(F.col("doc_id").alias(doc_id), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
