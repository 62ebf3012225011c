"""The lexicon and span aligners and the map between vector spaces against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.operators import containment, crosslingual, spans
from tessella.plans import registry


def text_of(rng, letters, least, most):
    return "".join(rng.choice(letters) for _ in range(rng.randint(least, most)))


def test_contained_pairs(spark):
    rng = random.Random(3)
    parts = [text_of(rng, "abc", 0, 5) for _ in range(60)] + ["zzz", None]
    wholes = [text_of(rng, "abc", 0, 9) for _ in range(80)] + [None, "xyzzz"]
    got = containment.contained(spark.createDataFrame([(p,) for p in parts], "p string"), spark.createDataFrame([(w,) for w in wholes], "w string"), "p", "w")
    assert sorted(map(tuple, got.collect())) == sorted({(p, w) for p in parts if p and len(p) >= 3 for w in wholes if w and p in w})
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("how", [{"prefixes": "ab", "slack": 3}, {"slack": None, "heads": True}, {"slack": 1}])
def test_lemma_levels(spark, how):
    rng = random.Random(5)
    words = {text_of(rng, "abcs", 1, 7) for _ in range(150)}
    forms = {text_of(rng, "abcs", 1, 6) for _ in range(60)}
    clean = lambda w: w[:-1] if w.endswith("s") else w

    def plain(word):
        k, pre = clean(word), how.get("prefixes", "")
        tries = [(1, k), (2, word)] + ([(3, k[1:])] if len(k) > 1 and k[0] in pre else []) + ([(4, k[2:])] if len(k) > 2 and set(k[:2]) <= set(pre) else [])
        for level, x in tries:
            if x in forms:
                return x, level
        near = lambda f: (k in f or f in k) and (how["slack"] is None or abs(len(k) - len(f)) <= how["slack"]) or how.get("heads") and f[:3] == k[:3]
        loose = [f for f in forms if len(f) >= 3 and len(k) >= 3 and near(f)]
        return (min(loose), 5) if loose else None

    df = spark.createDataFrame([(w,) for w in [*words, None]], "word string"), spark.createDataFrame([(f,) for f in [*forms, None]], "form string")
    got = {r["word"]: (r["form"], r["level"]) for r in containment.lemma_levels(*df, F.regexp_replace("word", "s$", ""), **how).collect()}
    assert got == {w: p for w in words if (p := plain(w))}
    assert len({v[1] for v in got.values()}) >= 3


def test_lexicon_matches(spark):
    rng = random.Random(9)
    tokens, targets = [], []
    for key in range(6):
        tokens += [(key, i, [text_of(rng, "abC", 2, 6) for _ in range(rng.randint(0, 3))], rng.random() < 0.5, rng.random() < 0.2) for i in range(8)]
        targets += [(key, j, text_of(rng, "abc", 2, 6) + rng.choice(["", ".", "!"])) for j in range(10)]
    tokens.append((0, 99, None, True, False))
    want = set()
    for key, i, glosses, verb, marker in tokens:
        found = []
        for k, j, word in targets:
            said, best = word.lower().strip(".,!?;:"), (0.0, None)
            for g in glosses or []:
                low, long_ = g.lower(), len(g) >= 3 and len(said) >= 3
                sure = 0.9 if said == low else 0.8 if long_ and (low in said or said in low) else 0.7 if verb and long_ and said[:3] == low[:3] else 0.0
                best = max(best, (sure, g), key=lambda x: x[0])
            if k == key and best[0]:
                found.append((-best[0], j, best[1]))
        want |= {(key, i, j, -c, g) for c, j, g in sorted(found)[:2]}
        want |= {(key, i, -1, 1.0, None)} if marker else set()
    df = spark.createDataFrame(tokens, "key int, s_idx int, glosses array<string>, verb boolean, marker boolean"), spark.createDataFrame(targets, "key int, t_idx int, word string")
    got = containment.lexicon_matches(*df, ["key"]).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_unmatched_targets_stay_where_they_are(spark):
    rng = random.Random(4)
    tokens = spark.createDataFrame([(0, 0, ["abc"], True, False)], "key int, s_idx int, glosses array<string>, verb boolean, marker boolean")
    targets = spark.createDataFrame([(0, j, text_of(rng, "defgh", 12, 12)) for j in range(2000)] + [(0, 2000, "xabcx")], "key int, t_idx int, word string")
    store = spark._jsc.sc().statusStore()

    def moved():
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = moved()
        got = containment.lexicon_matches(tokens, targets, ["key"]).collect()
        spark._jsc.sc().listenerBus().waitUntilEmpty()
        assert [tuple(r) for r in got] == [(0, 0, 2000, 0.8, "abc")]
        assert moved() - before < 30000  # the 20003 triples of 2001 words once, to find the rarest
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


# -- spans -----------------------------------------------------------------------------------


def plain_spot(words, phrase):
    n = len(phrase)
    for i in range(len(words) - n + 1):
        if words[i : i + n] == phrase:
            return i, i + n
    at = []
    for i, w in enumerate(words):
        if len(at) < n and w == phrase[len(at)]:
            at.append(i)
    return (at[0], at[-1] + 1) if len(at) == n else None


def plain_choice(found):
    out, s_taken, t_taken = [], set(), set()
    for c in sorted(found, key=lambda c: (-c[4], c[0], c[2], c[1], c[3], c[5])):
        s, t = set(range(c[0], c[1])), set(range(c[2], c[3]))
        if (len(s & s_taken) < len(s) / 2 and len(t & t_taken) < len(t) / 2) or (c[4] > 0.8 and c[5] in ("construct", "expansion")):
            out.append(c)
            s_taken |= s
            t_taken |= t
    return out


def test_spans(spark):
    rng = random.Random(2)
    pairs = [(k, [rng.choice("abcd") for _ in range(rng.randint(0, 12))], [rng.choice("wxyz") for _ in range(rng.randint(0, 12))]) for k in range(30)]
    phrases = [(list("ab"), list("wx"), 0.6, "construct"), (list("c"), list("xyz"), 0.7, "expansion"), (list("d"), list("w"), 0.2, "statistical"), (list("bcd"), list("zz"), 0.5, "participle"), ([], list("w"), 0.9, "construct"), (list("a"), [], 0.9, "construct")]
    bonus = {"construct": 0.2, "participle": 0.2, "expansion": 0.2, "statistical": 0.1}
    want = {}
    for k, a, b in pairs:
        found = set()
        for s, t, base, method in phrases:
            spot = plain_spot(b, t) if s and t else None
            for i in range(len(a) - len(s) + 1):
                if spot and a[i : i + len(s)] == s:
                    n, m = len(s), spot[1] - spot[0]
                    sure = min(1.0, base + 0.1 * (min(n, m) / max(n, m)) + bonus[method] + (0.15 if n > 1 and m > 1 and method in ("construct", "expansion") else 0))
                    found.add((i, i + n, *spot, round(sure, 9), method))
        want[k] = sorted(c for c in plain_choice(found) if c[4] >= 0.3)
    df = spark.createDataFrame(pairs, "k int, a array<string>, b array<string>")
    ph = spark.createDataFrame(phrases, "source_words array<string>, target_words array<string>, base double, method string")
    got = spans.chosen(spans.scored(spans.phrase_candidates(df, ["k"], "a", "b", ph)), ["k"]).collect()
    assert {k: sorted(tuple(r)[1:] for r in got if r["k"] == k) for k, _, _ in pairs} == want
    assert sum(map(len, want.values())) > 20


# -- vector spaces ---------------------------------------------------------------------------


@pytest.mark.parametrize("n", [300, 12, 9])
def test_linear_map(spark, n):
    rng = np.random.default_rng(n)
    x, y = rng.normal(size=(n, 20)), rng.normal(size=(n, 7))
    rows = [(a, b) for a, b in zip(x.tolist(), y.tolist(), strict=True)] + [(None, [1.0] * 7), ([1.0] * 20, [None] * 7), ([1.0], [1.0])]
    w = crosslingual.linear_map(spark.createDataFrame(rows, "a array<double>, b array<double>").repartition(4), "a", "b")
    assert w is None if n < 10 else np.allclose(w, np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-6)


def test_top_similar(spark, monkeypatch):
    monkeypatch.setattr(crosslingual, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(6)
    t = rng.normal(size=(70, 5))
    t[10:20] = t[0]
    q = rng.normal(size=(40, 5))
    cos = np.round((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (t / np.linalg.norm(t, axis=1, keepdims=True)).T, 9)
    want = {(i, r + 1, int(j)) for i in range(40) for r, j in enumerate(np.lexsort((np.arange(70), -cos[i]))[:10])}
    dq = spark.createDataFrame([(i, v, 0) for i, v in enumerate(q.tolist())] + [(None, [1.0] * 5, 0), (77, None, 0), (78, [1.0], 0)], "id long, v array<double>, w int")
    dt = spark.createDataFrame([(i, v) for i, v in enumerate(t.tolist())], "id long, v array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "29")
    try:
        got = {tuple(r)[:3] for r in crosslingual.top_similar(dq, dt, "id", "v").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == want


def test_neighbours_across_spaces(spark, sf_dir):
    rows = {r["vec_id"]: (np.array(r["embedding"], float), r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    pairs = [i for i in rows if i % 2 == 0 and i + 1 in rows and rows[i][1] == rows[i + 1][1]]
    w = np.linalg.lstsq(np.array([rows[i][0] for i in pairs]), np.array([rows[i + 1][0] for i in pairs]), rcond=None)[0] if len(pairs) >= 10 else np.eye(64)
    odd = sorted(i for i in rows if i % 2)
    unit = lambda v: v / (np.linalg.norm(v) + 1e-10)
    want = {}
    for i in rows:
        if i % 20 == 0:
            want[i] = sorted((-round(float(unit(rows[i][0] @ w) @ unit(rows[j][0])), 6), j) for j in odd)[:10]
    got = registry.QUERIES["cross_lingual_neighbours"](spark, sf_dir).collect()
    assert {(r["vec_id"], r["rank"]): r["similarity"] for r in got} == pytest.approx({(i, r + 1): -s for i, x in want.items() for r, (s, _) in enumerate(x)}, abs=2e-5)
