"""N-gram Jaccard self-join with set-relation skipping; its answers are link components.

Index. Documents with equal shingle sets are one set. Shingles are ordered by a
frequency level, rare ones first, then by hash; the level comes from a counting
sketch of fixed size over all documents. Each set is listed under the shingles of
its prefix, with its size and the shingle's place: sets that reach the threshold
share at least SHARED prefix shingles. Lists are cut into blocks by size.

Skipping on answers: first each set is compared with one hub only, the smallest
key of the blocks that it shares most often. A set linked to its hub takes over
the hub's answer, its component; from then on only sets of different components
are looked at. Sets that share much with one hub are a family, whose members are
compared in chunks with those outside its commonest component.

Skipping on lists: what is left are lists that still hold several components and
families. Such a list is read by cells of one size block, which a set enters from
its own block and the one below, so that no other sizes ever meet. In a cell the
entries stand in the order of their places, in blocks with the least and largest
size and place: pairs of blocks that cannot reach the overlap are skipped whole,
the others are pruned by size, place, and the number of different bits of two
fixed bitmaps, a lower bound of the difference of two sets. Pairs that share
enough prefix shingles are compared. A cell of many sets is dealt by pairs of hash
groups, so no task holds more than two groups of CELL sets.

So a large group of near copies costs about one comparison each, never a row for
each pair, and no link between components is lost.

Comparisons stream texts sorted by hub (a hub's members are dealt in chunks), and
count common shingles exactly. All tables between steps are written to the shared
folder and removed when the result is stored. Joins of tables that grow with the
input are merge joins at every size.

Defined results: null or word-less text has an empty set, no links and its own
doc_id as component; repeated rows are linked to each other by their equal sets;
a null doc_id never names a component that has another member; other columns
don't matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, fresh, stored
from .shingles import mix, set_key, shingle_sets

#: Two sets are linked if PERCENT * union <= 100 * intersection.
PERCENT = 80
#: Different sets of that similarity share at least four shingles (sizes 4 and 5), so this many are asked for.
SHARED = 4
#: Counters of the sketch: 2^SKETCH_BITS, whatever the input. Levels are relative to their mean.
SKETCH_BITS = 22
SKETCH_CHUNK = 1 << 16
CHUNK = 256
#: A set belongs to its hub's family if it shares that part of its prefix with it.
FAMILY = 0.3

#: 64-bit words of a set's bitmap.
BITMAP = 8
#: Sets of one hash group of a cell, and entries of one block of it.
CELL = 8192
BLOCK = 128

_MEMBERS = "doc_id long, text_hash long, set_key long, size int, bits binary"
_POSTINGS = "token long, set_key long, size int, place int"


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.int64)
    for batch in batches:
        for at in range(0, len(batch), 2048):
            sets = shingle_sets(batch.column("t").slice(at, 2048).cast(pa.large_binary()).to_pylist())
            bucket, n = np.unique(_bucket(np.concatenate([np.zeros(0, np.uint64), *sets])), return_counts=True)
            counts[bucket] += n
    parts = counts.reshape(-1, SKETCH_CHUNK)
    packed = [zlib.compress(np.minimum(p, (1 << 32) - 1).astype(np.uint32).tobytes(), 1) for p in parts]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(packed, pa.binary())], ["chunk", "counts"])


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, raw in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            sums[chunk] = sums.get(chunk, 0) + np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in sums.values()], pa.binary())], ["chunk", "counts"])


def levels(docs: DataFrame, text: str) -> np.ndarray:
    """The frequency level of each sketch bucket, eight to an octave: 24 is the mean count. 2^SKETCH_BITS bytes."""
    rows = docs.select(F.col(text).alias("t")).mapInArrow(_count, "chunk int, counts binary")
    summed = rows.repartition(16, "chunk").mapInArrow(_add_up, "chunk int, counts binary").toLocalIterator()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in summed:
        out[r["chunk"] * SKETCH_CHUNK : (r["chunk"] + 1) * SKETCH_CHUNK] = np.frombuffer(zlib.decompress(r["counts"]), np.int64)
    mean = max(1.0, float(out.mean()))
    return np.clip(np.round(8 * np.log2(np.maximum(out, 1) / mean) + 24), 0, 63).astype(np.uint8)


def in_order(shingles: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The set's shingles as numbers that sort rare levels first: 6 bits of level, 58 of hash."""
    return np.sort((level[_bucket(shingles)].astype(np.uint64) << np.uint64(58)) | (mix(shingles) >> np.uint64(6)))


def prefix_size(n: int) -> int:
    return min(n, n - -(-PERCENT * n // 100) + SHARED)


def prefix_sql(n: str):
    return F.expr(f"least({n}, {n} - ceil({PERCENT} * {n} / 100.0) + {SHARED})")


def bitmap(shingles: np.ndarray) -> bytes:
    """The parity of the set's members on each of 64 * BITMAP bits: two bitmaps differ in no more bits than their sets in members."""
    counts = np.bincount((mix(shingles ^ np.uint64(BITMAP)) & np.uint64(64 * BITMAP - 1)).astype(np.int64), minlength=64 * BITMAP)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, len(whole), 2048):
            batch = whole.slice(at, 2048)
            sets = shingle_sets(batch.column("t").cast(pa.large_binary()).to_pylist())
            keys = [set_key(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("d"), batch.column("h"), pa.array(keys, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(map(bitmap, sets), pa.binary())],
                ["doc_id", "text_hash", "set_key", "size", "bits"],
            )


def _postings(level_bc):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level, done = level_bc.value, set()
        for batch in batches:
            for at in range(0, len(batch), 1024):
                tokens, keys, sizes, places = [], [], [], []
                for s in shingle_sets(batch.column("t").slice(at, 1024).cast(pa.large_binary()).to_pylist()):
                    if not len(s) or (key := set_key(s)) in done:
                        continue
                    done.add(key)
                    p = prefix_size(len(s))
                    tokens.append(in_order(s, level)[:p].view(np.int64))
                    keys.append(np.full(p, key, np.int64))
                    sizes.append(np.full(p, len(s), np.int32))
                    places.append(np.arange(p, dtype=np.int32))
                if tokens:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, keys, sizes, places)], ["token", "set_key", "size", "place"])

    return run


def needed(a: str, b: str) -> str:
    """SQL: the least overlap of linked sets of sizes a and b."""
    return f"ceil({PERCENT} * ({a} + {b}) / {100 + PERCENT}.0)"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by hub and chunk, the hub's own text first."""
    now, hub_set = None, None
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            hubs, chunks, roles, who = (part.column(n).to_pylist() for n in ("hub", "chunk", "role", "who"))
            sets = shingle_sets(part.column("t").cast(pa.large_binary()).to_pylist())
            left, right = [], []
            for hub, chunk, role, member, s in zip(hubs, chunks, roles, who, sets, strict=True):
                if role == 0:
                    now, hub_set = (hub, chunk), s
                    continue  # a text that repeats with its id comes twice and changes nothing
                if now != (hub, chunk):
                    raise RuntimeError(f"no text for hub {hub}")
                both = len(np.intersect1d(hub_set, s, assume_unique=True))
                if 100 * both >= PERCENT * (len(hub_set) + len(s) - both):
                    left.append(hub)
                    right.append(member)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def compare(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The linked ones of ``pairs`` (a, b); a is the hub. ``texts``: set_key, t."""
    sizes = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(sizes, "a").select(F.col("a").alias("hub"), F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / CHUNK)).alias("chunk"), F.col("b").alias("who"), F.lit(1).alias("role"))
    heads = dealt.select("hub", "chunk").distinct().select("hub", "chunk", F.col("hub").alias("who"), F.lit(0).alias("role"))
    rows = dealt.unionByName(heads).join(texts.withColumnRenamed("set_key", "who"), "who")
    parts = max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "hub", "chunk").sortWithinPartitions("hub", "chunk", "role").mapInArrow(_compare, "a long, b long")


def _compare_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by class and chunk, the chunk's members (role 0) first, then the sets to compare with all of them.

    A set gets one link to each other component that it reaches in the chunk.
    """
    now, keys, labels, flat, starts = None, [], [], [], None
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            sets = shingle_sets(part.column("t").cast(pa.large_binary()).to_pylist())
            rows = zip(*(part.column(n).to_pylist() for n in ("class", "chunk", "role", "who", "label")), sets, strict=True)
            left, right = [], []
            for family, chunk, role, key, label, s in rows:
                if now != (family, chunk):
                    now, keys, labels, flat = (family, chunk), [], [], []
                if role == 0:
                    keys.append(key)
                    labels.append(label)
                    flat.append(s)
                    starts = None
                    continue
                if not keys:
                    raise RuntimeError(f"no members of class {family}")
                if starts is None:
                    starts = np.cumsum([0] + [len(m) for m in flat])
                    whole, of = np.concatenate(flat), np.array(labels)
                place = np.minimum(np.searchsorted(s, whole), len(s) - 1)
                both = np.add.reduceat((s[place] == whole).astype(np.int64), starts[:-1])
                hit = np.flatnonzero((100 * both >= PERCENT * (len(s) + np.diff(starts) - both)) & (of != label))
                for i in hit[np.unique(of[hit], return_index=True)[1]]:
                    left.append(keys[i])
                    right.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])


def compare_classes(classes: DataFrame, wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the sets b of ``wanted`` (class, b, label) and the members a of ``classes`` (class, set_key, label).

    A class's texts are sent once, in chunks of about CHUNK members; the sets to compare are sent once to each chunk.
    """
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    asked = wanted.join(sizes, "class")
    heads = classes.join(asked.select("class", "chunks").distinct(), "class")
    heads = heads.select("class", F.pmod(F.xxhash64("set_key"), F.col("chunks")).alias("chunk"), F.lit(0).alias("role"), F.col("set_key").alias("who"), "label")
    filled = heads.select("class", "chunk").distinct()
    asks = asked.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).join(filled, ["class", "chunk"])
    asks = asks.select("class", "chunk", F.lit(1).alias("role"), F.col("b").alias("who"), "label")
    rows = heads.unionByName(asks).join(texts.withColumnRenamed("set_key", "who"), "who")
    parts = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(parts, "class", "chunk").sortWithinPartitions("class", "chunk", "role").mapInArrow(_compare_blocks, "a long, b long")


def _lacking(sa: np.ndarray, sb: np.ndarray) -> np.ndarray:
    """The most members in which linked sets of these sizes differ."""
    both = -(-PERCENT * (sa + sb) // (100 + PERCENT))
    return sa + sb - 2 * both


class _Cells:
    """Entries of list cells, sorted by cell and place, as arrays."""

    def __init__(self, rows: pa.Table) -> None:
        number = lambda n: rows.column(n).to_numpy()
        self.key, self.size, self.place = number("set_key"), number("size").astype(np.int64), number("place").astype(np.int64)
        self.label, self.family, self.visits, self.group = number("label"), number("class"), number("visits"), number("part")
        self.across = number("i") != number("j")
        self.bits = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint64).reshape(-1, BITMAP)
        new = np.ones(len(self.key), bool)
        names = [number(n) for n in _CELL]
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in names])
        self.starts = np.append(np.flatnonzero(new), len(self.key))

    def passing(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs (a, b) of entries that sizes, places and bitmaps leave open."""
        sa, sb, pa_, pb = self.size[a], self.size[b], self.place[a], self.place[b]
        ok = (self.label[a] != self.label[b]) & (self.family[a] != self.family[b]) & ~(self.visits[a] & self.visits[b])
        ok &= ~self.across[a] | (self.group[a] != self.group[b])
        ok &= 100 * np.minimum(sa, sb) >= PERCENT * np.maximum(sa, sb)
        most = _lacking(sa, sb)
        # common shingles: at most those before either place and those from either place on
        ok &= 2 * (np.minimum(pa_, pb) + np.minimum(sa - pa_, sb - pb)) >= sa + sb - most
        a, b, most = a[ok], b[ok], most[ok]
        ok = np.bitwise_count(self.bits[a] ^ self.bits[b]).sum(axis=1, dtype=np.int64) <= most
        return a[ok], b[ok]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        size = np.diff(self.starts)
        small = np.flatnonzero((size > 1) & (size <= BLOCK))
        if len(small):
            # entries of small cells meet by their distance in the cell
            left = np.concatenate([np.arange(self.starts[c], self.starts[c + 1]) for c in small])
            ends = np.repeat(self.starts[small + 1], size[small])
            for step in range(1, int(size[small].max())):
                inside = left + step < ends
                left, ends = left[inside], ends[inside]
                yield self.passing(left, left + step)
        for c in np.flatnonzero(size > BLOCK):
            yield from self._large(int(self.starts[c]), int(self.starts[c + 1]))

    def _large(self, at: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        heads = np.arange(at, end, BLOCK)
        least = lambda x: np.minimum.reduceat(x[at:end], heads - at)
        most = lambda x: np.maximum.reduceat(x[at:end], heads - at)
        lo, hi, last, rest = least(self.size), most(self.size), most(self.place), most(self.size - self.place)
        for i, h in enumerate(heads):
            reach = np.minimum(last[i], last[i:]) + np.minimum(rest[i], rest[i:])
            need = -(-PERCENT * (lo[i] + lo[i:]) // (100 + PERCENT))
            open_ = (reach >= need) & (100 * hi[i] >= PERCENT * lo[i:]) & (100 * hi[i:] >= PERCENT * lo[i])
            mine = np.arange(h, min(h + BLOCK, end))
            for j in i + np.flatnonzero(open_):
                other = np.arange(heads[j], min(heads[j] + BLOCK, end))
                a, b = np.repeat(mine, len(other)), np.tile(other, len(mine))
                if i == j:
                    a, b = a[a < b], b[a < b]
                yield self.passing(a, b)


_CELL = ["token", "block", "i", "j"]
_PAIRS = "a long, b long, sa int, sb int"
#: Entries of cells that are read at a time (a larger cell is read whole).
CELL_ROWS = 1 << 16


def _scan_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by cell and place; pairs of sets that the bounds leave open, once for each list that both stand in."""

    def read(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cells = _Cells(rows)
        for a, b in cells.pairs():
            if len(a):
                swap = cells.key[a] > cells.key[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                columns = [cells.key[a], cells.key[b], cells.size[a].astype(np.int32), cells.size[b].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["a", "b", "sa", "sb"])

    held: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        held.append(batch)
        count += len(batch)
        if count < CELL_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        last = np.zeros(len(rows), bool)
        for n in _CELL:
            x = rows.column(n).to_numpy()
            last |= x != x[-1]
        cut = int(len(rows) - np.argmax(last[::-1])) if last.any() else 0
        if cut:
            yield from read(rows.slice(0, cut))
        held, count = rows.slice(cut).to_batches(), 0
    if held:
        yield from read(pa.Table.from_batches(held))


def open_pairs(entries: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets of different labels and classes that the lists leave open.

    ``entries``: token, set_key, size, place, label, class, bits. A set enters the
    cell of its own size block, and as a visitor that of the next one; a cell of
    more than CELL entries is dealt by pairs of hash groups.
    """
    home = F.floor(F.log("size") / np.log(100 / PERCENT)).cast("int")
    rows = entries.withColumn("visits", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("block", home + F.col("visits").cast("int"))
    sizes = rows.groupBy("token", "block").agg(F.count("*").alias("n"), F.count_if(~F.col("visits")).alias("homes")).where("homes > 0 AND n > 1")
    rows = rows.join(sizes.select("token", "block", F.ceil(F.col("n") / CELL).cast("int").alias("parts")), ["token", "block"])
    rows = rows.withColumn("part", F.pmod(F.xxhash64("set_key"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select(*_CELL[:2], F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "place", "set_key", "size", "label", "class", "visits", "part", "bits")
    parts = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    found = rows.repartition(parts, *_CELL).sortWithinPartitions(*_CELL, "place", "set_key").mapInArrow(_scan_cells, _PAIRS)
    beyond = lambda n: f"({n} - least({n}, {n} - ceil({PERCENT} * {n} / 100.0) + {SHARED}))"
    common = found.groupBy("a", "b", "sa", "sb").agg(F.count("*").alias("n"))
    return common.where(f"n >= {SHARED} AND n + greatest({beyond('sa')}, {beyond('sb')}) >= {needed('sa', 'sb')}").select("a", "b")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(set_key, label): the smallest key reachable by ``links`` (a, b); labels spread, then jump, until none changes."""
    links = stored(links.distinct(), "links", scratch)
    both = links.union(links.select("b", "a")).toDF("src", "dst")
    labels = stored(both.groupBy(F.col("src").alias("set_key")).agg(F.least(F.min("dst"), F.first("src")).alias("label")), "labels", scratch)
    while True:
        near = both.join(labels, both["dst"] == labels["set_key"]).groupBy("src").agg(F.min("label").alias("near"))
        spread = labels.join(near, labels["set_key"] == near["src"]).select("set_key", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        spread = stored(spread, "spread", scratch)
        jump = spread.select(F.col("set_key").alias("at"), F.col("mid").alias("jumped"))
        after = spread.join(jump, spread["mid"] == jump["at"], "left").select("set_key", "old", F.least("mid", F.coalesce("jumped", "mid")).alias("label"))
        after = stored(after, "labels", scratch)
        labels = after.select("set_key", "label")
        if not after.where("old != label").head(1):
            return labels


def join(docs: DataFrame, scratch: Scratch, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(members, classes). members: doc_id, text_hash, set_key, size for each row; classes: set_key, label of linked sets."""
    spark = docs.sparkSession
    keep = lambda df, name: stored(df, name, scratch)
    plain = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"), F.col(text).alias("t"))
    level = spark.sparkContext.broadcast(levels(docs, text))
    members = keep(plain.mapInArrow(_members, _MEMBERS), "members")
    postings = plain.select("t").mapInArrow(_postings(level), _POSTINGS)
    listed = Window.partitionBy("token")
    rows = postings.withColumn("lo", F.min("set_key").over(listed)).withColumn("hi", F.max("set_key").over(listed)).where("lo != hi").drop("lo", "hi")
    rows = rows.withColumn("block", F.floor(F.log("size") / np.log(100 / PERCENT)).cast("int"))
    rows = keep(rows.withColumn("hub", F.min("set_key").over(Window.partitionBy("token", "block"))).drop("block"), "lists")

    def texts_of(keys: DataFrame) -> DataFrame:
        """(set_key, t): one text for each of the sets ``keys``."""
        holders = members.join(keys.hint("merge"), "set_key", "left_semi")
        reps = holders.groupBy("set_key").agg(F.min(F.struct("doc_id", "text_hash")).alias("r")).select("set_key", F.col("r.doc_id").alias("rd"), F.col("r.text_hash").alias("rh"))
        return keep(plain.join(reps.hint("merge"), plain["d"].eqNullSafe(reps["rd"]) & (plain["h"] == reps["rh"])).select("set_key", "t"), "texts")

    # each set's hub: only where they share much of the set's prefix; what this leaves out is found in the lists
    hubs = rows.where("hub != set_key").groupBy("hub", "set_key", "size").agg(F.count("*").alias("n")).where(F.col("n") >= FAMILY * prefix_sql("size"))
    first = hubs.groupBy("set_key").agg(F.max_by("hub", F.struct("n", -F.col("hub"))).alias("a"))
    first = keep(first.select("a", F.col("set_key").alias("b")), "pairs")
    texts = texts_of(first.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
    links = keep(compare(first, texts), "linked")
    label = components(links, scratch)

    # Families: sets that share much of their prefix with one hub, linked or not. All members are compared with those
    # outside the family's commonest component; the members' texts are sent once for each chunk of sets to compare.
    family = components(first, scratch).select("set_key", F.col("label").alias("class"))
    kin = keep(family.join(label, "set_key", "left").withColumn("label", F.coalesce("label", "set_key")), "families")
    main = kin.groupBy("class", "label").agg(F.count("*").alias("n")).groupBy("class").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    asks = kin.join(main, "class").where("label != main").select("class", F.col("set_key").alias("b"), "label")
    links = keep(links.union(compare_classes(kin, asks, texts)), "linked")

    # What is left: sets in one list that have different components and families.
    labelled = rows.drop("hub").join(kin.select("set_key", "class", "label"), "set_key", "left")
    labelled = labelled.withColumn("label", F.coalesce("label", "set_key")).withColumn("class", F.coalesce("class", "set_key"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("class").alias("lc"), F.max("class").alias("hc")).where("lo != hi AND lc != hc").select("token")
    bits = members.where("set_key IS NOT NULL").groupBy("set_key").agg(F.first("bits").alias("bits"))
    entries = keep(labelled.join(mixed.hint("merge"), "token", "left_semi").join(bits.hint("merge"), "set_key"), "mixed")
    known = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = keep(open_pairs(entries).join(known, ["a", "b"], "left_anti"), "pairs")
    if pairs.head(1):
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("set_key")).distinct())
        links = keep(links.union(compare(pairs, texts)), "linked")
    return members.drop("bits"), components(links, scratch)


def _keyed(docs: DataFrame, scratch: Scratch, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_hash, size, label): the label is a set key, one for each component; null without words."""
    members, label = join(docs, scratch, doc_id, text)
    return members.join(label, "set_key", "left").select("doc_id", "text_hash", "size", F.coalesce("label", "set_key").alias("label"))


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: doc_id, text_hash, n_shingles, component_id (the smallest doc_id reachable by links)."""
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs, scratch, doc_id, text)
    least = keyed.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    out = keyed.join(least, "label", "left")
    out = stored(out.select("doc_id", "text_hash", F.col("size").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "components")
    scratch.drop()
    return out


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group: the one with the smallest doc_id (null is the largest), then text hash; rows without words all stay."""
    scratch = Scratch(docs.sparkSession)
    found = _keyed(docs, scratch, doc_id, text).where("label IS NOT NULL")
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    gone = found.join(first, "label").where("NOT (doc_id <=> first.doc_id AND text_hash = first.text_hash)").select("doc_id", "text_hash", F.lit(0).alias("kind"))
    # rows that repeat an id and its text are copies too: of those that stay, one is chosen
    again = found.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_hash", F.lit(1).alias("kind"))
    key, order = fresh(docs, "hash_"), fresh(docs, "order_")
    gone_id, gone_hash = fresh(docs, "gone_id_"), fresh(docs, "gone_hash_")
    marks = gone.union(again).groupBy(F.col("doc_id").alias(gone_id), F.col("text_hash").alias(gone_hash)).agg(F.min("kind").alias("kind"))
    marks = stored(marks, "gone")
    scratch.drop()
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(gone_id)) & (F.col(key) == F.col(gone_hash))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = marked.join(marks.drop("kind").hint("merge"), same, "left_anti").select(*columns)
    twins = marked.join(marks.where("kind = 1").drop("kind").hint("merge"), same, "left_semi")
    twins = twins.withColumn(order, F.row_number().over(Window.partitionBy(f"`{doc_id}`", key).orderBy(key))).where(F.col(order) == 1)
    return once.unionByName(twins.select(*columns))
