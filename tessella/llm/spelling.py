"""Spelling variants: words that differ by one letter, grouped under the most frequent one.

Every word has a key for itself and for each of its single deletions: polynomial hashes of
what stands before and after the letter, from one sum over the code points of a batch. Keys are
dealt by their upper bits and sorted; only keys that meet another one go on. Their strings
are then joined and compared, so an equal hash alone links nothing. Words that lose the same
letter place and are equal otherwise differ by a replacement; a word that equals another's
deletion differs by an insertion.

A string with one place left open has at most as many words as the alphabet has letters, so a
group's answers (its size and its two most frequent words) come from one bounded list; the
words around a shorter one are joined to it alone. Nothing makes pairs within a group.

Defined cases: null and empty texts have no words, a null id counts as an empty one, words of
any length are keyed without being copied for each deletion, repeated rows count again, and an
empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, lower_ascii, stored

#: Letters of a word.
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_CHARS = 6
LEAST_COUNT = 5
#: A form is at least so many times as frequent as its variant.
RATIO = 5
#: Code points hashed at once, and bits of the key that deal it out.
CHUNK = 1 << 18
RADIX_BITS = 12
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def runs(docs: DataFrame, text: str = "text", least: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with one row for each letter run of at least ``least`` code points, A-Z lower-cased, as ``run``."""
    rows = docs.select(*[c for c in docs.columns if c != text], F.explode(F.split(F.col(text), f"[^{LETTERS}]+")).alias("run"))
    rows = rows.where(F.length("run") >= least)
    return rows.withColumn("run", F.when(F.col("run").rlike("[A-Z]"), lower_ascii(F.col("run"))).otherwise(F.col("run")))


def without(word: Column, place: Column) -> Column:
    """``word`` without its code point at ``place`` (from 0)."""
    return F.concat(F.substr(word, F.lit(1), place), F.substr(word, place + 2))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _mixed(x: np.ndarray) -> np.ndarray:
    """All bits of a hash depend on all others, so that its upper ones can deal it out."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the word, place or -1 for the whole word, key) of all words and their single deletions."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
    starts = np.cumsum(sizes) - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[word]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(points * _powers(int(sizes.max(initial=0)))[place])])
    whole = sums[starts + sizes] - sums[starts]
    before = sums[:-1] - sums[starts[word]]
    after = (whole[word] - (sums[1:] - sums[starts[word]])) * np.uint64(BASE_INVERSE)
    key = np.concatenate([whole, before + after])
    return np.concatenate([np.arange(len(words)), word]), np.concatenate([np.full(len(words), -1), place]).astype(np.int32), _mixed(key).view(np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, words = batch["id"].to_numpy(), batch["word"].to_pylist()
        ends = np.cumsum([len(w) for w in words])
        for lot in np.split(np.arange(len(words)), np.flatnonzero(np.diff(ends // CHUNK)) + 1):
            number, place, key = deletion_keys([words[i] for i in lot])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[lot][number]), pa.array(place)], ["key", "id", "place"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and place, those that meet: the same key and place twice, or a whole word and a deletion."""
    names, rest = ["key", "id", "place"], None

    def met(rows: list[np.ndarray]) -> pa.RecordBatch:
        key, _, place = rows
        same = (key[1:] == key[:-1]) & (place[1:] == place[:-1])
        twin = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        first = np.concatenate([[True], key[1:] != key[:-1]])
        group = np.cumsum(first) - 1
        heads = np.flatnonzero(first)
        alone = np.diff(np.concatenate([heads, [len(key)]])) == 1
        stays = twin | ((place[heads] == -1) & ~alone)[group]
        return pa.RecordBatch.from_arrays([pa.array(x[stays]) for x in rows], names)

    for batch in batches:
        rows = [batch[c].to_numpy() for c in names]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
        cut = np.searchsorted(rows[0], rows[0][-1]) if len(rows[0]) else 0
        if cut:
            yield met([x[:cut] for x in rows])
        rest = [x[cut:] for x in rows]
    if rest is not None and len(rest[0]):
        yield met(rest)


def nearness(words: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(word, n_near, best): of each word with near ones their number, and the most frequent as struct (minus, word).

    ``words`` is a stored table of different words (id, word, n).
    """
    schema = "key long, id long, place int"
    keys = words.select("id", "word").mapInArrow(_keyed, schema)
    radix = F.shiftrightunsigned("key", 64 - RADIX_BITS)
    met = keys.repartition(radix).sortWithinPartitions("key", "place").mapInArrow(_meeting, schema)
    met = stored(met.select("id", "place").join(words, "id"), "met", scratch)
    say = F.struct((-F.col("n")).alias("minus"), F.col("word").alias("word"))
    gone = met.where("place >= 0").select("word", "place", say.alias("say"), without(F.col("word"), F.col("place")).alias("gone"))
    open_ = gone.groupBy("gone", "place").agg(F.sort_array(F.collect_list("say")).alias("all")).where(F.size("all") > 1)
    replaced = open_.select((F.size("all") - 1).alias("k"), "all", F.posexplode("all").alias("i", "me")).select(
        F.col("me.word").alias("word"), "k", F.element_at("all", F.when(F.col("i") == 0, 2).otherwise(1)).alias("best")
    )
    # A run of one letter loses any of its letters to the same word: its first stands for all.
    first = (F.col("place") == 0) | (F.substr("word", F.col("place") + 1, F.lit(1)) != F.substr("word", F.greatest(F.col("place"), F.lit(1)), F.lit(1)))
    longer = gone.where(first).select("gone", F.col("say").alias("long"))
    shorter = met.where("place = -1").select(F.col("word").alias("gone"), say.alias("short"))
    edges = longer.join(shorter, "gone")
    inserted = edges.select(F.col("long.word").alias("word"), F.lit(1).alias("k"), F.col("short").alias("best")).unionByName(
        edges.select(F.col("short.word").alias("word"), F.lit(1).alias("k"), F.col("long").alias("best"))
    )
    return replaced.unionByName(inserted).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def followed(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(word, root) of links (word, root): each word's root is followed to the last by doubling."""
    links = stored(links, "links", scratch)
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        longer = stored(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "links", scratch)
        links = longer.select("word", "root")
        if not longer.where("moved").limit(1).count():
            return links


def variants(counts: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, ratio: int = RATIO, scratch: Scratch | None = None) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of the words of ``counts`` (word, n) that are long and frequent enough.

    A word's form is its near word of largest n (ties: the smallest by code points) if that n is
    at least ``ratio`` times the word's own; the root follows forms to the last.
    """
    enough = counts.where((F.length("word") >= least_chars) & (F.col("n") >= least_count))
    words = stored(enough.select("word", F.col("n").cast("long").alias("n")).withColumn("id", F.monotonically_increasing_id()), "words", scratch)
    found = words.select("word", "n").join(nearness(words, scratch), "word", "left")
    best_n = -F.col("best.minus")
    is_form = best_n >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, best_n).alias("form_n")
    )
    found = stored(found, "forms", scratch)
    roots = followed(found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), scratch)
    return found.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
