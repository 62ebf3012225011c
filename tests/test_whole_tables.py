"""Registered queries read whole texts and whole tables: small tables against brute force."""

import collections
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessella.plans import registry


def turns_of(rng):
    """Pairs of turns with 15 to 40 words each."""
    side = lambda p: [f"{p}{'abcdefghijklmnop'[rng.randrange(16)]}" for _ in range(rng.randrange(15, 41))]
    return [(c, t, side("s"), side("t")) for c in range(4) for t in (0, 2)]


@pytest.fixture(scope="module")
def talk(spark, tmp_path_factory):
    pairs = turns_of(random.Random(11))
    rows = [(c, t, "user", " ".join(a)) for c, t, a, _ in pairs] + [(c, t + 1, "assistant", " ".join(b)) for c, t, _, b in pairs]
    folder = str(tmp_path_factory.mktemp("talk"))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, pairs


def em_by_hand(pairs, rounds):
    words = {w for _, _, _, b in pairs for w in b}
    prob = collections.defaultdict(lambda: 1 / len(words))
    for _ in range(rounds):
        count = collections.Counter()
        for _, _, a, b in pairs:
            for t in b:
                z = sum(prob[s, t] for s in ["NULL", *a])
                for s in ["NULL", *a]:
                    count[s, t] += prob[s, t] / z
        total = collections.Counter()
        for (s, _), c in count.items():
            total[s] += c
        prob = {(s, t): c / total[s] for (s, t), c in count.items()}
    return prob


def test_cooccurrence_counts_all_words(spark, talk):
    folder, pairs = talk
    both = collections.Counter(x for _, _, a, b in pairs for x in itertools.product(set(a), set(b)))
    left, right = (collections.Counter(w for p in pairs for w in set(p[i])) for i in (2, 3))
    want = {(s, t): (k, round(math.log(k * len(pairs) / (left[s] * right[t])), 5) + 0.0) for (s, t), k in both.items() if k >= 3}
    got = {(r["s"], r["t"]): (r["pairs"], round(r["pmi"], 5) + 0.0) for r in registry.QUERIES["pmi_cooccurrence"](spark, folder).collect()}
    assert got == want


def test_translation_table_and_links_use_all_words(spark, talk):
    folder, pairs = talk
    got = {(r["s"], r["t"]): r["prob"] for r in registry.QUERIES["ibm1_em"](spark, folder).collect()}
    assert got == pytest.approx({k: p for k, p in em_by_hand(pairs, 3).items() if p >= 0.01}, abs=2e-6)
    prob, want = em_by_hand(pairs, 2), set()
    for c, t, a, b in pairs:
        for j, w in enumerate(b):
            best = max(range(len(a) + 1), key=lambda i: (round(prob[(["NULL", *a])[i], w], 12), -i))
            if best and prob[a[best - 1], w] > 0.1:
                want.add((f"{c}:{t}", best - 1, j))
    assert {(r["key"], r["s_idx"], r["t_idx"]) for r in registry.QUERIES["ibm1_decode"](spark, folder).collect()} == want


def test_positions_and_assignment_use_all_words(spark, talk):
    folder, pairs = talk
    want, chosen = {}, set()
    for c, t, a, b in pairs:
        n, m, cells = len(a), len(b), []
        for i, j in itertools.product(range(n), range(m)):
            end = (i, j) in ((0, 0), (n - 1, m - 1))
            score = min(0.5, (1 - abs(i / (n - 1) - j / (m - 1))) * 0.5 * (1.2 if end else 1.0))
            want[c, t, i, j] = round(score, 5)
            cells.append((-score, i, j))
        used_s, used_t = set(), set()
        for _, i, j in sorted(cells):
            if i not in used_s and j not in used_t:
                used_s.add(i)
                used_t.add(j)
                chosen.add((f"{c}:{t}", i, j))
    got = {(r["c"], r["t"], r["s_idx"], r["t_idx"]): r["score"] for r in registry.QUERIES["position_scores"](spark, folder).collect()}
    assert got == pytest.approx(want, abs=2e-5)
    assert {(r["key"], r["s_idx"], r["t_idx"]) for r in registry.QUERIES["greedy_assignment"](spark, folder).collect()} == chosen


@pytest.fixture(scope="module")
def goods(spark, tmp_path_factory):
    """Line items of all quantities and taxes: a chain of 30 ids beyond 40, a longer but cheaper way, random edges."""
    rng = random.Random(5)
    rows = [(i, i + 1, 2, 0.05) for i in range(1, 31)] + [(1, 100, 2, 0.0), (100, 31, 2, 0.0), (41, 81, 3, 0.02), (81, 41, 1, 0.03), (5, 5, 1, 0.02)]
    rows += [(rng.randrange(1, 130), rng.randrange(1, 130), rng.randrange(1, 8), rng.randrange(11) / 100) for _ in range(120)]
    rows = [(*r, float(rng.randrange(1, 51)), rng.randrange(9) / 100) for r in rows]
    folder = str(tmp_path_factory.mktemp("goods"))
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linenumber int, l_discount double, l_quantity double, l_tax double").write.parquet(f"{folder}/lineitem.parquet")
    return folder, sorted({(s, d, ("causes", "before", "related_to")[n % 3], c * 10) for s, d, n, c, *_ in rows})


def test_graph_holds_all_edges(spark, goods):
    folder, edges = goods
    run = lambda name: {tuple(r) for r in registry.QUERIES[name](spark, folder).collect()}
    turned = {"before": "after"}
    assert run("bidirectional_edges") == {(s, d, k) for s, d, k, _ in edges} | {(d, s, turned.get(k, k)) for s, d, k, _ in edges}
    assert run("event_pattern") == {(s, d, f) for s, d, k, _ in edges for e, f, m, _ in edges if k == "causes" and m == "before" and d == e}
    causes = collections.defaultdict(float)
    for s, d, k, c in edges:
        if k == "causes":
            causes[d, s] = max(causes[d, s], c)
    assert run("direct_causes") == {(d, s, round(c, 6)) for (d, s), c in causes.items()}


def test_walks_use_all_edges(spark, goods):
    folder, edges = goods
    after = collections.defaultdict(set)
    for s, d, *_ in edges:
        after[s].add(d)
    paths, level = set(), [(i,) for i in range(10)]
    for _ in range(3):
        level = [(*p, d) for p in level for d in after[p[-1]] if d not in p]
        paths |= set(level)
    got = registry.QUERIES["recursive_paths"](spark, folder).collect()
    assert sorted((r["path"], r["length"]) for r in got) == sorted((">".join(map(str, p)), len(p) - 1) for p in paths)
    far, front = {1: 0}, {1}
    for n in range(1, 5):
        front = {d for s in front for d in after[s]} - set(far)
        far |= dict.fromkeys(front, n)
    assert {r["id"]: r["distance"] for r in registry.QUERIES["bfs_reach"](spark, folder).collect()} == far


def test_costs_are_least_over_paths_of_any_length(spark, goods):
    folder, edges = goods
    factor = {"causes": 0.8, "before": 1.0, "related_to": 1.5}
    cost, moved = {1: 0.0}, True
    while moved:
        moved = False
        for s, d, k, c in edges:
            new = cost.get(s, math.inf) + (1 - c) * factor[k]
            if new < cost.get(d, math.inf):
                cost[d], moved = new, True
    got = {r["id"]: r["cost"] for r in registry.QUERIES["shortest_paths"](spark, folder).collect()}
    assert got == pytest.approx(cost, abs=2e-6)


def test_ranks_cover_all_ids(spark, goods):
    folder, edges = goods
    weight, ids = collections.Counter((s, d) for s, d, *_ in edges), {i for e in edges for i in e[:2]}
    total = collections.Counter()
    for (s, _), w in weight.items():
        total[s] += w
    rank = dict.fromkeys(ids, 1 / len(ids))
    for _ in range(5):
        got = collections.Counter()
        for (s, d), w in weight.items():
            got[d] += rank[s] * w / total[s]
        lost = sum(r for i, r in rank.items() if i not in total)
        rank = {i: 0.15 / len(ids) + 0.85 * (got[i] + lost / len(ids)) for i in ids}
    assert {r["id"]: r["rank"] for r in registry.QUERIES["pagerank"](spark, folder).collect()} == pytest.approx(rank, abs=2e-8)


def test_long_chains_converge_and_negative_cycles_are_refused(spark):
    from tessella.operators import graph

    chain = spark.createDataFrame([(i, i + 1, 1.0) for i in range(25)], "src long, dst long, weight double")
    assert {r["id"]: r["cost"] for r in graph.shortest(chain, 0).collect()} == {i: float(i) for i in range(26)}
    with pytest.raises(ValueError, match="negative"):
        graph.shortest(spark.createDataFrame([(1, 2, -1.0), (2, 1, 0.5)], "src long, dst long, weight double"), 1)


def test_book_dimension_parses_each_text_once(spark, sf_dir, monkeypatch):
    """What is parsed are the different texts, not the line items."""
    from tessella.plans import derived

    parsed = []
    whole = derived.cut
    monkeypatch.setattr(derived, "cut", lambda df: parsed.append(whole(df)) or parsed[-1])
    got = registry.QUERIES["book_dimension"](spark, sf_dir)
    texts, items = parsed[0].count(), parsed[0].agg({"n": "sum"}).first()[0]
    assert texts < items == spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert "lineitem" not in got._jdf.queryExecution().executedPlan().toString()


def test_rare_words_leave_before_pairs_are_made(spark):
    """Two rows share a word on each side; what all rows hold once can't come to two rows."""
    from tessella.operators import align

    rows = [(["x", f"r{i}"], ["y", "y", f"q{i}"]) for i in range(2)] + [(["z"], []), (["z"], [])]
    pairs = spark.createDataFrame(rows, "a array<string>, b array<string>")
    columns = ["s", "t", "pairs", "s_rows", "t_rows", "n"]
    got = align.cooccurrence(pairs, "a", "b", 2).select(columns).collect()
    assert list(map(tuple, got)) == [("x", "y", 2, 2, 2, 2)]
    assert list(map(tuple, align.cooccurrence(pairs, "a", "b").where("pairs >= 2").select(columns).collect())) == list(map(tuple, got))


@pytest.mark.parametrize("tolerance", [0.0, 1e-9])
def test_translation_table_of_many_blocks_is_that_of_one(spark, talk, monkeypatch, tolerance):
    from tessella.operators import align, model1

    _, pairs = talk
    df = spark.createDataFrame([(a, b) for _, _, a, b in pairs] + [([], ["x"]), (["x"], [])], "a array<string>, b array<string>")
    monkeypatch.setattr(model1, "CELLS", max(40, sum((len(set(a)) + 1) * len(set(b)) for _, _, a, b in pairs) // 4))
    got = {(r["s"], r["t"]): r["prob"] for r in align.ibm1(df, "a", "b", rounds=3, tolerance=tolerance).collect()}
    assert got == pytest.approx(dict(em_by_hand([*pairs, (0, 0, [], ["x"])], 3)), abs=1e-12)


def test_translation_table_writes_no_cells(spark, tmp_path):
    """Two hundred sentence pairs of 100 by 100 own words are two million cells."""
    from tessella.operators import align, model1

    df = spark.range(200).selectExpr("transform(sequence(0, 99), x -> concat('s', id, '_', x)) AS a", "transform(sequence(0, 99), x -> concat('t', id, '_', x)) AS b")
    made = []
    held, model1.written = model1.written, lambda d, name, *more: made.append(held(d, name, *more)) or made[-1]
    cut, model1.cut = model1.cut, lambda d: made.append(cut(d)) or made[-1]
    try:
        table = align.ibm1(df, "a", "b", rounds=2, tolerance=0.0)
    finally:
        model1.written, model1.cut = held, cut
    assert table.count() == 200 * 101 * 100
    assert max(d.count() for d in made) <= 200 * 201  # tokens are the longest table


def test_edges_to_ends_wait_for_final_costs(spark, monkeypatch):
    from tessella.operators import graph

    e = spark.range(40).selectExpr("id AS src", "id + 1 AS dst", "1.0D AS weight").where("src < 4").union(spark.range(100, 140).selectExpr("id % 4 AS src", "id AS dst", "2.0D AS weight"))
    made, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda d: made.append(cut(d)) or made[-1])
    got = {r["id"]: r["cost"] for r in graph.shortest(e, 0).collect()}
    assert got == {**{i: float(i) for i in range(5)}, **{i: i % 4 + 2.0 for i in range(100, 140)}}
    assert all(d.count() <= 4 for d in made if "better" in d.columns)


def test_marks_go_without_python_for_most_texts(spark, monkeypatch):
    import unicodedata

    from tessella.functions import scripts

    texts = ["plain", "élan vital ǖ Ǘ", "ẹ́ q̣̇", "ἐν ἀρχῇ ἦν ᾧ", "בְּרֵאשִׁית שׁ", "한국 각 é", "̈́ Å Å 豈 \U0001d15e ß ø", "", None]
    texts += ["".join(c for c in map(chr, range(a, a + 0x400)) if not 0xD800 <= ord(c) < 0xE000) for a in range(0x80, 0x30000, 0x400)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["x"] for r in rows.select("i", scripts.without_marks(F.col("t")).alias("x")).orderBy("i").collect()]
    old = F.regexp_replace(scripts.nfd(F.col("t")), r"\p{M}+", "")
    assert got == [r["x"] for r in rows.select("i", old.alias("x")).orderBy("i").collect()]
    assert got[1] == "elan vital u U"
    seen = []
    monkeypatch.setattr(scripts, "nfd", lambda c: seen.append(c) or c)
    scripts.without_marks(F.col("t"))
    given = rows.select("t", seen[0].alias("g")).where("g IS NOT NULL").collect()
    assert given and all(any(0xAC00 <= ord(c) <= 0xD7A3 or unicodedata.combining(c) for c in r["t"]) for r in given)
    assert not {r["t"] for r in given} & {*texts[:5], *texts[6:9]}
    assert texts[5] in {r["t"] for r in given}


def test_greedy_keeps_its_order_among_equals():
    import random

    from tessella.operators import align

    found = {}
    held, align._assigned = align._assigned, lambda scores, key, score, choose, digits=None: found.setdefault("choose", choose)
    try:
        align.greedy(None, "k")
    finally:
        align._assigned = held
    r = random.Random(3)
    rows = [(s, t, r.choice([0.1, 0.5, 0.9])) for s in range(12) for t in range(30)]
    r.shuffle(rows)
    left, want = sorted(range(len(rows)), key=lambda i: (-rows[i][2], rows[i][0], rows[i][1])), []
    while left:
        want.append(left[0])
        left = [i for i in left if rows[i][0] != rows[want[-1]][0] and rows[i][1] != rows[want[-1]][1]]
    assert found["choose"](*map(list, zip(*rows, strict=True))) == want


def test_neighbours_hold_few_similarities_at_a_time(spark, monkeypatch):
    from tessella.operators import crosslingual

    held = crosslingual.HELD_ROWS
    assert held * crosslingual.BLOCK_ROWS * 8 <= 8 << 20
    v = spark.range(300).selectExpr("id", "array(cos(id), sin(id * 7), cos(id * 3)) AS v")
    got = [tuple(r) for r in crosslingual.top_similar(v, v, "id", "v", 3).orderBy("id", "rank").collect()]
    want = {r["id"]: r["v"] for r in v.collect()}
    unit = {k: [x / math.sqrt(sum(y * y for y in w)) for x in w] for k, w in want.items()}
    for k in (0, 127, 128, 299):
        best = sorted(unit, key=lambda o: (-round(sum(x * y for x, y in zip(unit[k], unit[o], strict=True)), 9), o))[:3]
        assert [g[2] for g in got if g[0] == k] == best


def test_line_items_are_dealt_once_for_canonical_order(spark, sf_dir):
    import duckdb

    got = registry.QUERIES["canonical_order"](spark, sf_dir)
    plan = got._jdf.queryExecution().optimizedPlan().toString(), got._jdf.queryExecution().executedPlan().toString()
    assert plan[0].count("RepartitionByExpression") == 1 and plan[1].count("Exchange hashpartitioning") == 1
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{sf_dir}/lineitem.parquet'")
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(registry.ORACLES["canonical_order"]).fetchall())


def test_verse_ids_end_where_their_text_does(spark):
    from tessella.functions import refs

    want = {"GEN 1:1a": ("GEN", 1, 1, "a"), "GEN 1:1B\n": ("GEN", 1, 1, "b"), "gen.1.2\r\n": ("GEN", 1, 2, None), "gen 1:1\n\n": None, "GEN;1;2;": None, "a;b;c;d": None, "Nothing 1:1": None, "GEN 99999999999:1": ("GEN", None, 1, None)}
    rows = spark.createDataFrame([(t,) for t in want], "t string").select("t", refs.parse_verse_id(F.col("t")).alias("r")).collect()
    assert {r["t"]: r["r"] and tuple(r["r"]) for r in rows} == want


def test_vectors_with_negative_ids_are_in_a_space(spark, tmp_path):
    rows = [(i, [float(math.cos(i * j)) for j in range(1, 4)], 0) for i in range(-41, 42)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.QUERIES["cross_lingual_neighbours"](spark, str(tmp_path)).collect()
    assert {r["vec_id"] for r in got} == {-40, -20, 0, 20, 40} and all(r["target"] % 2 for r in got)
    assert any(r["target"] < 0 for r in got)


def test_links_of_equal_keys_and_equal_probabilities(spark):
    from tessella.operators import align

    rows = [("k", ["x", "y"], ["p", "q"]), ("k", ["z"], ["q", "p", "r"]), ("k", ["z"], ["q", "p", "r"])]
    table = [("x", "p", 0.3), ("y", "p", 0.3 + 1e-15), ("z", "q", 0.5), ("y", "q", 0.2), ("z", "r", 0.1 + 1e-15), ("NULL", "p", 0.2)]
    p = spark.createDataFrame(rows, "key string, a array<string>, b array<string>")
    got = align.decode(p, "key", "a", "b", spark.createDataFrame(table, "s string, t string, prob double")).collect()
    assert sorted(map(tuple, got)) == [("k", 0, 0, 0.3), ("k", 0, 0, 0.5), ("k", 0, 0, 0.5), ("k", 1, 1, 0.2)]


def test_word_pairs_of_one_target_are_counted_in_one_block(spark, talk, monkeypatch):
    """Only totals of sources, and pairs of a word too common for a block, travel between blocks."""
    from tessella.operators import align, model1

    _, pairs = talk
    df = spark.createDataFrame([(a, b) for _, _, a, b in pairs] + [([f"s{i}", "many"], [f"t{i}", "common"]) for i in range(200)], "a array<string>, b array<string>")
    cells = sum((len(set(a)) + 1) * len(set(b)) for _, _, a, b in pairs) + 200 * 6
    monkeypatch.setattr(model1, "CELLS", cells // 8)
    made = []
    held = model1.written
    monkeypatch.setattr(model1, "written", lambda d, name, *more: made.append((name, held(d, name, *more))) or made[-1][1])
    got = {(r["s"], r["t"]): r["prob"] for r in align.ibm1(df, "a", "b", rounds=3, tolerance=0.0).collect()}
    assert got == pytest.approx(em_by_hand([*pairs, *[(0, 0, [f"s{i}", "many"], [f"t{i}", "common"]) for i in range(200)]], 3), abs=1e-12)
    size = len({s for s, _ in got} | {t for _, t in got}) + 1
    sent = next(d for name, d in made if name == "blocks").where("kind = 'keys'").collect()
    targets = {int(k) % size for r in sent for k in model1._unpacked(r["blob"])[0].cumsum()}
    weight = collections.Counter(t for _, _, a, b in pairs for t in set(b) for _ in range(len(set(a)) + 1)) + collections.Counter(common=600)
    assert size - 1 in targets and len(targets) == 1 + sum(w > cells // 8 // 2 for w in weight.values()) < len(weight) / 4
    assert len({r["block"] for r in sent}) > 4
