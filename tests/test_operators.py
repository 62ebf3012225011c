"""Operators on small tables."""

import difflib
import json
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessella.operators import align, filters, graph, joins, manuscripts, quality, search, sets, topics, versification
from tessella.operators.filters import FilterGroup, FilterRule, Preferences
from tessella.sources import readers, sinks
from tessella.streaming.windows import window_counts


def ids(df, c="id"):
    return sorted(r[c] for r in df.collect())


@pytest.fixture(scope="module")
def events(spark):
    rows = [(1, "exile", 586.0, ["war", "city"], "certain"), (2, None, None, None, None), (3, "return", 538.0, [], "possible"), (4, "temple", 516.0, ["city"], "probable")]
    return spark.createDataFrame(rows, "id int, name string, year double, tags array<string>, level string")


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        (FilterRule("name", "equals", "exile"), [1]),
        (FilterRule("name", "not_equals", "exile"), [2, 3, 4]),
        (FilterRule("name", "contains", "e"), [1, 3, 4]),
        (FilterRule("name", "not_contains", "x"), [2, 3, 4]),
        (FilterRule("name", "in", ["exile", "temple"]), [1, 4]),
        (FilterRule("name", "in", []), []),
        (FilterRule("name", "not_in", ["exile"]), [2, 3, 4]),
        (FilterRule("year", "greater_than", 538), [1]),
        (FilterRule("year", "less_than", "538"), [4]),
        (FilterRule("year", "between", (516, 538)), [3, 4]),
        (FilterRule("name", "greater_than", 1), []),
        (FilterRule("tags", "contains", "ci", is_list=True), [1, 4]),
        (FilterRule("tags", "not_contains", "ci", is_list=True), [2, 3]),
        (FilterRule("tags", "in", ["war"], is_list=True), [1]),
        (FilterRule("tags", "greater_than", 1, is_list=True), []),
        (FilterRule("name", "equals", "exile", enabled=False), [1, 2, 3, 4]),
    ],
)
def test_filter_rules(events, rule, want):
    assert ids(events.where(rule.column())) == want


def test_filter_groups_and_quick_filters(events):
    a, b = FilterRule("year", "less_than", 540), FilterRule("name", "equals", "temple")
    assert ids(events.where(FilterGroup([a, b]).column())) == [4]
    assert ids(events.where(FilterGroup([a, b], "OR").column())) == [3, 4]
    assert ids(events.where(FilterGroup([]).column())) == [1, 2, 3, 4]
    q = lambda t: ids(events.where(filters.quick(t, ("tags",), ("name",))))
    assert (q("tags:WAR"), q("not tags:war"), q("TEM"), q("")) == ([1], [2, 3, 4], [4], [1, 2, 3, 4])
    assert ids(events.where(filters.certainty_at_least("level", "probable"))) == [1, 4]
    assert ids(events.where(Preferences(excluded={"tags": ["war"]}, not_empty=["tags"]).column())) == [4]
    with pytest.raises(ValueError, match="unknown operator"):
        FilterRule("name", "like").column()
    assert [r["id"] for r in filters.keyword_search(events, F.col("name"), "tem ple exile", "id").collect()] == [4]


def test_postings_and_bm25(spark):
    d = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["b"]), (3, [])], "id int, w array<string>")
    p = search.postings(d, "id", F.col("w"))
    assert sorted(map(tuple, p.collect())) == [("a", 1, 2, 3), ("b", 1, 1, 3), ("b", 2, 1, 1)]
    assert [tuple(r) for r in search.inverted_index(p).orderBy("term").collect()] == [("a", [1]), ("b", [1, 2])]
    assert [r["doc_id"] for r in search.top(search.bm25(d, "id", F.col("w"), ["b"]), 5).collect()] == [2, 1]


def test_quotations(spark):
    q = spark.createDataFrame([(1, "In the beginning God made the heaven")], "q int, t string")
    t = spark.createDataFrame([(1, "In the beginning God created the heaven and the earth"), (2, "nothing of the kind in the text"), (3, "in the beginning " + "god " * 400)], "d int, t string")
    got = joins.quotations(q, t, "q", "d", "t", "t").collect()
    want = difflib.SequenceMatcher(None, "in the beginning god made the heaven", "in the beginning god created the heaven and the earth").ratio()
    assert [(r["text_id"], r["shared"], r["rank"]) for r in got] == [(1, 5, 1)] and got[0]["ratio"] == pytest.approx(want)


def test_interval_and_band_joins_make_each_pair_once(spark):
    a = spark.createDataFrame([(i, float(i * 3), float(i * 3 + i)) for i in range(40)], "a int, a0 double, a1 double")
    b = spark.createDataFrame([(i, float(i * 5), float(i * 5 + 7)) for i in range(30)], "b int, b0 double, b1 double")
    got = sorted((r["a"], r["b"]) for r in joins.interval_overlap(a, b, ("a0", "a1"), ("b0", "b1"), 4.0).collect())
    assert got == sorted((i, j) for i in range(40) for j in range(30) if i * 3 <= j * 5 + 7 and i * 4 >= j * 5)
    got = sorted((r["a"], r["b"]) for r in joins.band(a, b, "a0", "b0", 6.0).collect())
    assert got == sorted((i, j) for i in range(40) for j in range(30) if abs(3 * i - 5 * j) <= 6)


def test_graph(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.5), (1, 3, 2.0), (3, 1, 1.0), (3, 4, 1.0)], "src long, dst long, weight double")
    paths = {tuple(r["path"]) for r in graph.simple_paths(e, spark.range(1, 2), 4).collect()}
    assert paths == {(1, 2), (1, 3), (1, 2, 3), (1, 3, 4), (1, 2, 3, 4)}
    assert {r["id"]: r["distance"] for r in graph.bfs(e, spark.range(1, 2), 5).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}
    assert {r["id"]: r["cost"] for r in graph.shortest(e, 1).collect()} == {1: 0.0, 2: 0.5, 3: 1.0, 4: 2.0}
    assert sum(r["rank"] for r in graph.pagerank(e, 5).collect()) == pytest.approx(1.0)
    assert graph.valid_edges(e, spark.range(1, 4)).count() == 4
    assert graph.neighbours(e.withColumn("kind", F.lit("x"))).count() == 10


def test_alignment(spark):
    p = spark.createDataFrame([("1", ["the", "house"], ["das", "haus"]), ("2", ["the", "book"], ["das", "buch"]), ("3", ["a", "book"], ["ein", "buch"])], "key string, a array<string>, b array<string>")
    t = align.ibm1(p, "a", "b", rounds=30, tolerance=1e-6, with_null=False)
    best = {r["s"]: r["t"] for r in t.groupBy("s").agg(F.max_by("t", "prob").alias("t")).collect()}
    assert best == {"the": "das", "house": "haus", "book": "buch", "a": "ein"}
    sums = [r["x"] for r in t.groupBy("s").agg(F.sum("prob").alias("x")).collect()]
    assert sums == [pytest.approx(1.0)] * 4
    found = {(r["key"], r["s_idx"], r["t_idx"]) for r in align.decode(p, "key", "a", "b", t).collect()}
    assert found == {(k, i, i) for k in "123" for i in (0, 1)}
    s = spark.createDataFrame([("1", 0, 0, 0.9), ("1", 0, 1, 0.95), ("1", 1, 1, 0.9), ("1", 1, 0, 0.2)], "key string, s_idx int, t_idx int, score double")
    assert sorted((r["s_idx"], r["t_idx"]) for r in align.greedy(s, "key").collect()) == [(0, 1), (1, 0)]
    gold = spark.createDataFrame([("1", 0, 0), ("1", 1, 1)], "key string, s_idx int, t_idx int")
    r = align.evaluate(s.where("score > 0.5"), gold, ["key", "s_idx", "t_idx"]).first()
    assert (r["precision"], r["recall"]) == (pytest.approx(2 / 3), 1.0)
    tokens = spark.createDataFrame([("1", [("H1", "david"), ("H2", "moshe"), (None, "x")], [("H1", "he"), (None, "moshe"), (None, "q")])], "key string, src array<struct<strong:string,translit:string>>, tgt array<struct<strong:string,text:string>>")
    assert sorted((r["s_idx"], r["t_idx"], r["method"]) for r in align.token_passes(tokens, "key").collect()) == [(0, 0, "number"), (1, 1, "transliteration"), (2, 2, "position")]


def test_sets(spark):
    p = spark.createDataFrame([("a b", 9), ("a b c", 3), ("b c", 3), ("x y", 1)], "phrase string, n int")
    assert ids(sets.without_subphrases(p), "phrase") == ["a b c", "x y"]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert(old, new, ["k"]).collect())) == [(1, "a"), (2, "B"), (3, "C")]
    c = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 5), (3, 7)], "g int, m int")
    assert (ids(sets.common(c, "g", "m"), "m"), ids(sets.only_in(c, "g", "m"), "m")) == ([5], [6, 7])
    assert ids(sets.covering(c, "g", "m", spark.createDataFrame([(5,), (7,)], "m int")), "g") == [3]


def test_pairs_and_triples_by_one_exchange(spark):
    lists = [list("ababab"), ["a", "b"], ["a"], [], None, list("xyz")]
    found = sets.pairs_and_triples(spark.createDataFrame([(x,) for x in lists], "w array<string>"), "w", 1)
    counts = Counter(" ".join(x[i : i + n]) for x in lists if x for n in (2, 3) for i in range(len(x) - n + 1))
    assert {r.phrase: r.n for r in found.collect()} == counts
    assert {r.phrase for r in found.where("n >= 3").collect()} == {p for p, n in counts.items() if n >= 3}
    plan = found._jdf.queryExecution().executedPlan()
    found._jdf.queryExecution().toRdd().count()
    assert plan.toString().count("ReusedExchange") >= 1


def test_versification(spark):
    maps = spark.createDataFrame([("a", "b", "X.1.1", ["X.2.1"], "m", 1.0), ("b", "a", "X.2.1", ["X.1.2"], "m", 1.0), ("a", "b", "X.1.9", ["X.2.1"], "m", 0.5)], "from_sys string, to_sys string, src string, dst array<string>, kind string, confidence double")
    assert {(r["ref"], r["problem"]) for r in versification.conflicts(maps).collect()} == {("X.2.1", "several_sources")}
    assert {(r["src"], r["holds"]) for r in versification.round_trips(maps.where("src <> 'X.1.9'")).collect()} == {("X.1.1", False)}
    v = spark.createDataFrame([("X", 1, 5), ("X", 2, 6)], "book string, chapter int, verses int")
    assert versification.differences(v, v.where("chapter = 1")).count() == 1


def test_manuscripts(spark):
    w = lambda s, y, f: (s, "papyrus", f, y, 0.9, 0.9)
    units = spark.createDataFrame([("u", [("in the", [w("P1", 200, "alexandrian"), w("P2", 300, "western")]), ("in", [w("M1", 1200, "byzantine")]), ("on", [])])], "unit_id string, readings array<struct<text:string,witnesses:array<struct<siglum:string,kind:string,family:string,year:int,accuracy:double,completeness:double>>>>")
    assert manuscripts.preferred(units).first()["text"] == "in the"
    assert sum(r["share"] for r in manuscripts.reading_scores(units).collect()) == pytest.approx(1.0)
    assert manuscripts.reading_pairs(units).count() == 3
    assert manuscripts.weak_family(units).count() == 0


def test_quality_and_topics(spark):
    s = spark.createDataFrame([(float(i),) for i in range(100)] + [(None,)], "v double")
    assert quality.nearest_rank(s, "v", 0.95).first()["value"] == 95.0
    v = spark.createDataFrame([(i, [float(i % 2), 1.0 - i % 2], i % 2) for i in range(40)], "id int, vec array<double>, y int")
    c = topics.clusters(v, "vec", 2)
    assert c.groupBy("y").agg(F.count_distinct("cluster").alias("n")).where("n = 1").count() == 2
    model, data = topics.few_label_classifier(v, "vec", "y", folds=2)
    assert model.transform(data).where("predicted <> _y").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "h.xml").write_text('<osis><verse osisID="Gen.1.1"><w lemma="b/7225" morph="HR/Ncfsa" id="1">x</w><w lemma="1254 a" morph="HVqp3ms" id="2">y</w></verse></osis>')
    got = readers.osis_words(spark, str(tmp_path / "h.xml")).orderBy("pos").collect()
    assert [(r["verse_key"], r["strong"], r["text"]) for r in got] == [("Gen.1.1", "H7225", "x"), ("Gen.1.1", "H1254", "y")]
    book = {"chapters": [{"chapter": 1, "verses": [{"verse": 1, "text": "t"}]}]}
    (tmp_path / "t.json").write_text(json.dumps({"version": "v", "name": "n", "language": "en", "books": {"Genesis": book, "Unknown": book}}))
    assert [(r["book"], r["verse"], r["text"]) for r in readers.translation_json(spark, str(tmp_path / "t.json")).collect()] == [("GEN", 1, "t")]
    (tmp_path / "x.tsv").write_text("# comment\nGEN.1.1\tPSA.33.6;JHN.1.1;zzz\nGEN.1.2\n")
    assert readers.references_tsv(spark, str(tmp_path / "x.tsv")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"references": [{"source_verse": "a", "target_verse": "b", "confidence": 0.5}]}))
    assert readers.references_json(spark, str(tmp_path / "r.json")).first()["confidence"] == 0.5
    (tmp_path / "e.json").write_text(json.dumps({"id": "1", "name": "x", "relationships": [{"target": "2", "kind": "causes", "confidence": 0.9}]}))
    _, edges = readers.timeline_json(spark, str(tmp_path / "e.json"))
    assert [tuple(r) for r in edges.collect()] == [("1", "2", "causes", 0.9)]
    lines = spark.createDataFrame([("GEN.1.1 base] first reading P46 B pc | second M",)], "line string")
    assert [tuple(r) for r in readers.apparatus(lines).collect()] == [("GEN.1.1", "first reading", ["P46", "B"], "pc"), ("GEN.1.1", "second", ["M"], "")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id int, g string, t string")
    sinks.to_many(df, {"parquet": lambda d: sinks.parquet(d, str(tmp_path / "p"), ["g"]), "json": lambda d: sinks.json_by(d, str(tmp_path / "j"), ["g"]), "bulk": lambda d: sinks.search_bulk(d, str(tmp_path / "s"), "i", "id")})
    assert spark.read.parquet(str(tmp_path / "p")).count() == 3
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    bulk = [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()]
    assert len(bulk) == 6 and sum(bool(re.match(r'\{"index":', b)) for b in bulk) == 3

    def broken(_):
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="writer bad failed"):
        sinks.to_many(df, {"bad": broken})
    assert [r["chunk"] for r in sinks.numbered_chunks(df, ["g"], ["id"], 1).orderBy("id").collect()] == [1, 2, 1]


def test_stream_windows_match_batch(spark, sf_dir, tmp_path):
    table = spark.read.parquet(f"{sf_dir}/events.parquet")
    table = table.withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1)
    table.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = window_counts(stream, "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    key = lambda df: sorted((r["start"], r["event_type"], r["n"]) for r in df.collect())
    assert key(spark.table("windows")) == key(window_counts(table, "ts", "event_type"))


def test_descendants_know_no_limit_of_rows(spark):
    rows = [(0, None)] + [(i, (i - 1) // 2) for i in range(1, 40)]
    spark.createDataFrame(rows, "id long, parent long").createOrReplaceTempView("tree_of_forty")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "20")
    try:
        got = graph.descendants(spark, "tree_of_forty", "id", "parent", "root < 2").groupBy("root", "depth").count().collect()
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert sorted(map(tuple, got)) == [(0, 0, 1), (0, 1, 2), (0, 2, 4), (0, 3, 8), (0, 4, 16), (0, 5, 9), (1, 0, 1), (1, 1, 2), (1, 2, 4), (1, 3, 8), (1, 4, 9)]


def test_descendants_refuse_cycles(spark):
    spark.createDataFrame([(1, 2), (2, 1)], "id long, parent long").createOrReplaceTempView("tree_in_a_ring")
    with pytest.raises(ValueError, match="cycle"):
        graph.descendants(spark, "tree_in_a_ring", "id", "parent")


def test_two_step_pattern_is_not_made_distinct_again(spark):
    e = spark.createDataFrame([(1, 2, "x"), (1, 2, "x"), (2, 3, "y"), (2, 3, "y"), (2, 4, "y"), (5, 2, "x")], "src long, dst long, kind string")
    got = graph.two_step_pattern(e, F.col("kind") == "x", F.col("kind") == "y")
    assert sorted(map(tuple, got.collect())) == [(1, 2, 3), (1, 2, 4), (5, 2, 3), (5, 2, 4)]
    assert got._jdf.queryExecution().optimizedPlan().toString().startswith("Project")


def test_dealt_edges_stay_where_they_are(spark):
    e = graph.dealt(spark.range(100).selectExpr("id % 10 AS src", "id AS dst"), "src")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = graph.cut(spark.range(3)).join(e, F.col("id") == F.col("src"))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == 30 and plan.count("Exchange") == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_coherence_reads_the_texts_three_times_at_most(spark, tmp_path):
    spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "b"]), (3, ["a", "c"]), (4, [])], "d long, w array<string>").write.parquet(str(tmp_path / "texts"))
    tops = spark.createDataFrame([(0, "a"), (0, "b")], "c long, w string")
    presence = spark.read.parquet(str(tmp_path / "texts")).select("d", F.explode("w").alias("w"))
    got = topics.coherence(tops, presence, "c", "w", "d")
    assert got.first()["coherence"] == pytest.approx(0.0) and got.first()["pairs"] == 1
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_calibrated_counts_no_methods(spark):
    """Two names earn the bonus of any number of them, nulls are no names; one exchange, and no row or state for each method."""
    groups = {
        "one": [("statistical", 0.6), ("statistical", 0.5)],
        "two": [("statistical", 0.2), ("position", 0.3)],
        "all": [("lexicon", 0.1), ("semantic", 0.1), ("morphological", 0.0), ("other", 0.2), (None, 0.25)],
        "null": [(None, 0.7), ("semantic", 0.1)],
        "parts": [("morphological", 0.5), ("morphological", None)],
        "none": [("lexicon", None), ("position", None)],
        "little": [("position", 0.5)],
    }
    df = spark.createDataFrame([(k, m, s) for k, v in groups.items() for m, s in v], "g string, method string, score double")
    found = align.calibrated(df, ["g"], 0.55)
    assert {r.g: (r.raw, r.score) for r in found.collect()} == {"one": (0.6, 0.6), "two": (0.6, 0.6), "all": (pytest.approx(0.95), pytest.approx(0.95)), "null": (pytest.approx(0.85), pytest.approx(0.85)), "parts": (0.6, 0.6)}
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "distinct" not in plan and plan.count("HashAggregate") == 2
