"""Spelling variants, Merkle manifests and the permutation index against plain versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import pivots, rows_corpus
from tessella.llm.merkle import digest_of, fold, manifest, siblings, traversal
from tessella.llm.pivots import neighbours, recall
from tessella.llm.spelling import deletion_keys, nearness, runs, variants

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(rows_corpus.ORACLES))
def test_matches_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.execute(rows_corpus.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = [tuple(r) for r in rows_corpus.QUERIES[name](spark, sf_dir).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) != []


# -- spelling --------------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, least_chars, least_count, ratio):
    words = {w: n for w, n in counts if len(w) >= least_chars and n >= least_count}
    out = {}
    for w, n in words.items():
        others = sorted((-m, v) for v, m in words.items() if near(w, v))
        form = others[0] if others and -others[0][0] >= ratio * n else None
        out[w] = [n, len(others), form and form[1], form and -form[0]]
    for w in out:
        root = w
        while out[root][2]:
            root = out[root][2]
        out[w].append(root)
    return {w: tuple(v) for w, v in out.items()}


def test_variants(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(3, 7))) for _ in range(260)}
    words |= {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1499, "aaaaaa", "aaaaa", "aaaaab"}
    counts = [(w, int(5 ** rng.uniform(0, 6))) for w in sorted(words)]
    df = spark.createDataFrame(counts, "word string, n long").repartition(3)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in variants(df, 4, 5, 2).collect()}
    want = plain_variants(counts, 4, 5, 2)
    assert got == want
    assert any(v[4] != v[2] for v in want.values() if v[2])  # some root is further than the form


def test_equal_hashes_alone_link_nothing(spark, monkeypatch):
    from tessella.llm import spelling

    def one_key(batches):
        import pyarrow as pa

        for batch in batches:
            number, place, key = spelling.deletion_keys(batch["word"].to_pylist())
            columns = [np.zeros_like(key), batch["id"].to_numpy()[number], place]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["key", "id", "place"])

    words = spark.createDataFrame([(i, w, 9) for i, w in enumerate(["abcdef", "abcdeg", "zzzzzz", "qqqqq", "abcde"])], "id long, word string, n long")
    monkeypatch.setattr(spelling, "_keyed", one_key)
    got = {r["word"]: r["n_near"] for r in nearness(words).collect()}
    assert got == {"abcdef": 2, "abcdeg": 2, "abcde": 2}


def test_keys_are_hashes_of_what_is_left():
    number, place, key = deletion_keys(["abab", "aab", "b", "éa", "ab"])
    left = [("abab", "aab", "b", "éa", "ab")[n] for n in number]
    left = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(left, place, strict=True)]
    by = {}
    for text, k in zip(left, key, strict=True):
        assert by.setdefault(text, k) == k
    assert len(set(by.values())) == len(by)


def test_spelling_edges(spark, docs):
    rows = [(1, None), (2, ""), (3, "Éclair ÉCLAIR éclair cafés×÷ 123 x"), (None, "éclair " * 3), (3, "Éclair ÉCLAIR éclair cafés×÷ 123 x")]
    got = [r["run"] for r in runs(docs(rows, extra=True).select("doc_id", "text", "w_")).collect()]
    assert sorted(got) == sorted(["Éclair", "Éclair", "éclair"] * 2 + ["cafés×÷"] * 2 + ["éclair"] * 3)
    assert variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_op11_by_hand(spark, tmp_path):
    docs = [(i, "letter letters Letter " * 40) for i in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {}
    for i, text in docs:
        for w in text.lower().split():
            h = zlib.crc32(f"{i}:{w}".encode())
            w = w if h % 199 else w[: h % len(w)] + w[h % len(w) + 1 :]
            want[w] = want.get(w, 0) + 1
    want = plain_variants(want.items(), 6, 5, 5)
    got = {r["word"]: (r["n"], r["n_near"], r["form"], r["form_n"], r["root"]) for r in rows_corpus.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == want


# -- manifest --------------------------------------------------------------------------------


def plain_tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 2])) for i in range(0, len(below), 2)])
    return levels


def plain_proof(levels, at):
    out = []
    for level in levels[:-1]:
        sibling = at ^ 1
        out.append("-" if sibling >= len(level) else ("L" if at & 1 else "R") + level[sibling])
        at >>= 1
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 31, 64, 100])
@pytest.mark.parametrize("step", [1, 2, 4])
def test_traversal(n, step):
    levels = plain_tree([sha(str(i)) for i in range(n)])
    assert list(traversal(levels[0], len(levels) - 1, step)) == [plain_proof(levels, i) for i in range(n)]


def test_desired_subtrees_are_whole_in_time(monkeypatch):
    from tessella.llm.merkle import Subtree

    late = []
    real = Subtree.whole
    monkeypatch.setattr(Subtree, "whole", lambda self: (late.append(self.grow()) if self.first else None, real(self))[1])
    assert len(list(traversal([sha(str(i)) for i in range(256)], 8, 2))) == 256
    assert late and not any(late)


@pytest.mark.parametrize("bits", [1, 2, 12])
def test_manifest(spark, docs, bits):
    rng = random.Random(bits)
    rows = [(i, f"text {i % 7}", rng.choice(["a", "b", "é"])) for i in rng.sample(range(1000), 75)]
    rows += [(5000, "same", "a")] * 3 + [(5000, "other", "a"), (None, None, "a"), (7, "", None), (8, "x" * 100_000, None)]
    df = docs(rows, extra=True).withColumn("lang", F.when(F.col("source") == "b", None).otherwise(F.col("source"))).repartition(5)
    leaf = digest_of(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    got = manifest(df.withColumn("leaf_", leaf), "doc_id", "lang", "leaf_", carry=("text",), bits=bits, step=2).withColumn("folded", fold(F.col("leaf"), F.col("proof"))).collect()

    def plain_leaf(r):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))

    trees = {}
    for r in df.collect():
        trees.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
    langs = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(trees[g])]) for g in langs}
    top = plain_tree([trees[g][-1][0] for g in langs])
    assert len(got) == len(rows) and {r["root"] for r in got} == {r["folded"] for r in got} == {top[-1][0]}
    for r in got:
        tree = trees[r["lang"]]
        assert tree[0][r["at"]] == r["leaf"] and r["subroot"] == tree[-1][0]
        assert r["proof"] == plain_proof(tree, r["at"]) + plain_proof(top, langs.index(r["lang"]))


def test_manifest_of_nothing_and_of_one(spark, docs):
    for rows in ([], [(1, "a")]):
        df = docs(rows).withColumn("leaf_", digest_of(F.col("doc_id")))
        got = manifest(df, "doc_id", "lang", "leaf_").select("*", siblings(F.col("proof")).alias("said")).collect()
        assert [(r["leaf"], r["subroot"], r["root"], r["proof"], r["said"]) for r in got] == [(sha("1:1"), sha("1:1"), sha("1:1"), [], "")] * len(rows)


def test_proofs_fail_for_other_rows(spark, docs):
    df = docs([(i, f"t{i}") for i in range(20)]).withColumn("leaf_", digest_of(F.col("doc_id"), F.col("text")))
    out = manifest(df, "doc_id", "lang", "leaf_")
    assert out.where(fold(F.sha2("leaf", 256), F.col("proof")) == F.col("root")).count() == 0


# -- neighbours ------------------------------------------------------------------------------


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string, shard string, block string, v string, id string")


def plain_neighbours(rows, queries, k):
    out = []
    for q, v in queries:
        score = sorted((-float(np.cumsum(np.multiply(v, x))[-1]), i) for i, x in rows if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(score[:k])]
    return out


def test_small_tables_are_searched_whole(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SHARD_ROWS", 50)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 4)
    rng = np.random.default_rng(1)
    good = [(i, (rng.normal(size=6) * rng.uniform(0.1, 30)).tolist()) for i in range(200)]
    same = rng.normal(size=6).tolist()
    good += [(i, same) for i in range(200, 300)] + [(400, same)]  # a third of all are equal
    bad = [(None, same), (500, None), (520, []), (540, [0.0] * 6), (560, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (580, [float("nan")] * 6), (600, [float("inf")] * 6), (620, [1.0, 2.0])]
    df = vectors(spark, [(i, v, *"abcde") for i, v in [*good, *bad, good[20], good[40]]])
    got = [tuple(r) for r in neighbours(df, df.where("vec_id % 20 = 0"), k=20).collect()]
    assert sorted(got) == sorted(plain_neighbours(good, [x for x in good if x[0] % 20 == 0], 20))


def test_neighbours_of_few(spark):
    df = vectors(spark, [(i, [1.0 + i, 2.0], *"abcde") for i in range(3)])
    got = [tuple(r)[:3] for r in neighbours(df, df).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1), (1, 1, 2), (1, 2, 0), (2, 1, 1), (2, 2, 0)]
    assert neighbours(df.limit(0), df).count() == neighbours(df, df.limit(0)).count() == neighbours(df.limit(1), df.limit(1)).count() == 0


@pytest.mark.parametrize("scale", [False, True])
def test_recall(spark, monkeypatch, scale):
    """Vectors without any clusters, the hardest case; only a tenth of each shard is ranked again."""
    monkeypatch.setattr(pivots, "LEAST", 0)
    rng = np.random.default_rng(2)
    matrix = rng.normal(size=(20_000, 64)) * (rng.uniform(0.5, 2, size=(20_000, 1)) if scale else 1)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(matrix.tolist())], "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 200 = 0")
    found = neighbours(df, asked)
    assert found.count() == 2000
    assert recall(found, df, asked) >= 0.9


def test_pairs_of_shards_and_blocks_meet_on_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(pivots, "SHARD_ROWS", 30)
    monkeypatch.setattr(pivots, "BLOCK_ROWS", 7)
    monkeypatch.setattr(pivots, "SHARE", 1.0)
    rng = np.random.default_rng(3)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(300, 5)).tolist())]
    df = vectors(spark, [(i, v, *"abcde") for i, v in rows])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = [tuple(r) for r in neighbours(df, df.where("vec_id % 6 = 0"), k=5).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted(got) == sorted(plain_neighbours(rows, rows[::6], 5))


def test_recall_on_the_given_vectors(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir.replace('0.001', '0.1')}/embeddings.parquet")
    assert recall(neighbours(df, df.where("vec_id % 20 = 0")), df, df.where("vec_id % 20 = 0")) >= 0.9
