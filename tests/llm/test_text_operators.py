"""Operators on documents against brute force, on small tables with awkward rows."""

import collections
import hashlib
import math
import random
import re

import pytest
from llm_cases import EDGE, words_of
from pyspark.sql import functions as F

from tessella.llm import decontaminate, jaccard, mixing, pii, quality, secrets, substrings
from tessella.llm.shared import table

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def real(spark, sf_dir):
    return [(r["doc_id"], r["text"], r["source"]) for r in table(spark, sf_dir, "documents").collect()]


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def contamination_by_hand(text, items):
    w = item_words(text)
    hit, ids = set(), set()
    for item_id, t in items:
        iw = item_words(t)
        n = min(13, len(iw))
        for a in range(len(iw) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == iw[a : a + n]:
                    hit |= set(range(i, i + n))
                    ids.add(str(item_id))
    digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    return len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block_bytes", [1 << 22, 60])
def test_decontamination(spark, docs, block_bytes):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, "Short One"), (3, None), (4, "..."), (5, passage), (11, "b " * 40), (12, "w3 w4 w5")]
    rows = [*EDGE, (20, "x " + passage.upper() + " y"), (21, "short, one!"), (22, " ".join(f"w{i}" for i in range(5, 18))), (23, "w4 " * 13), (24, "b " * 100)]
    rows += [(25, passage + " filler" * 1000), (26, "short ones"), (None, passage)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out, r = decontaminate.contamination(docs(rows, True), bench, block_bytes=block_bytes)
    got = [(x["text"], *(x[r][k] for k in ("n_words", "n_hit", "n_items", "items_sha256")), x["bad"]) for x in out.withColumn("bad", decontaminate.is_contaminated(r)).collect()]
    assert sorted(got, key=repr) == sorted(((t, *contamination_by_hand(t, items)) for _, t in rows), key=repr)


def test_decontamination_searches_items_with_null_ids(spark, docs):
    held = " ".join(f"v{i}" for i in range(20))
    bench = spark.createDataFrame([(None, held), (None, "short null item"), (7, held)], "item_id long, text string")
    out, r = decontaminate.contamination(docs([(1, held), (2, "short null item"), (3, "clean")]), bench, block_bytes=60)
    digest = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    got = {x["doc_id"]: (x[r]["n_hit"], x[r]["n_items"], x[r]["items_sha256"], x["bad"]) for x in out.withColumn("bad", decontaminate.is_contaminated(r)).collect()}
    assert got == {1: (20, 2, digest("7"), True), 2: (3, 1, digest(""), True), 3: (0, 0, digest(""), False)}
    assert [x["doc_id"] for x in decontaminate.decontaminate(docs([(1, held), (2, "short null item"), (3, "clean")]), bench).collect()] == [3]


def test_decontamination_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs(EDGE), bench).count() == len(EDGE)
    assert decontaminate.decontaminate(docs(EDGE).limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_longest_matches(spark, docs):
    bench = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(20)))], "item_id long, text string")
    found = decontaminate.longest_matches(docs([(1, "z " + " ".join(f"w{i}" for i in range(2, 18)) + " z"), (2, "w1")]), bench).collect()
    assert {(r["offset"], r["length"], r["places"], r["doc_id"]) for r in found} >= {(2, 16, 1, 1), (5, 13, 1, 1)}


def spans_by_hand(t):
    t = t or ""

    def luhn(s):
        return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(s)))) % 10 == 0

    digits = lambda m: re.sub(r"\D", "", m[0])
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m)) <= 15]


AWKWARD = [
    (30, "a@b.c_d@e.fg x@y @z.w a@b a.b@c..d e@f.g@h.i"),
    (31, "1.2.3.4.5.6.7.8 999.1.1.1 1.2.3 0001.002.3.255 1.2.3.256 1..2.3.4"),
    (32, "4111 1111 1111 1111 4111-1111-1111-1111 4111  1111 1111 1111 41111111111111111 4111111111111111 2"),
    (33, "+1 (222) 333-4444 +12 +1-2-3-4-5-6-7-8 +1((((((( +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 ++12345678"),
    (34, "5" * 3000 + " " + "1." * 3000 + " " + "a" * 3000 + "@" + "b." * 300 + "c"),
    (35, "x@y.z 1.1.1.1 " * 200),
]


def test_pii_base(spark, docs, real):
    rows = [*EDGE, *AWKWARD, *real]
    got = collections.Counter((r["doc_id"], r["base_sha256"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in pii.pii_report(docs(rows, True)).collect())
    want = collections.Counter()
    for r in rows:
        found = spans_by_hand(r[1])
        n = collections.Counter(k for k, _, _ in found)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        want[(r[0], digest, n["email"], n["ip"], n["card"], n["phone"])] += 1
    assert got == want


def test_pii_bootstrapping_finds_unseen_identifiers(spark, docs):
    seeds = [(i, f"please call me at number +1 (222) 333-{1000 + i} today") for i in range(20)]
    unseen = [(100, "you can call me at number 0049-12345 now"), (101, "an order of 12345678 parts")]
    got = {r["doc_id"]: r["spans"] for r in pii.pii_report(docs(seeds + unseen)).collect()}
    text = unseen[0][1]
    assert got[100] == f"context:{text.index('0049')}:{text.index(' now')}"
    assert got[101] == ""


#: Contexts of identifiers, half of them met by seeds, and contexts of numbers that name nobody.
ASKS = ["reach me on line {}", "my badge number is {} since", "account no. {} was closed", "(ref: {})", "signed, {}"]
PLAIN = ["an order of {} parts", "about {} people came", "the sum was {} in all", "in {} words"]


def planted(n):
    """Rows with seeds and unseen identifiers in equal contexts, and with plain numbers; (rows, {doc_id: value or None})."""
    rows, want = [], {}
    for i in range(n):
        ask = ASKS[i % len(ASKS)]
        rows.append((1_000_000 + i, "well then " + ask.format(f"+1 ({200 + i % 700}) 555-{1000 + i}") + " or so"))
        value = f"{i:04d}-{77_000 + i}" if i % 2 else f"K{i:03d}/{91_000 + i}"
        if i % 5 == 0:
            want[2_000_000 + i] = value
            rows.append((2_000_000 + i, "if need be " + ask.format(value) + " for it"))
        rows.append((3_000_000 + i, "there is " + PLAIN[i % len(PLAIN)].format(50_000 + i)))
        want[3_000_000 + i] = None
    return rows, want


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pii_patterns_find_planted_identifiers_among_real_texts(spark, docs, sf):
    rows, want = planted(150)
    real = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    whole = real.select("doc_id", "text").union(docs(rows).select("doc_id", "text"))
    texts = dict(rows)
    found = {r["doc_id"]: r["spans"] for r in pii.pii_report(whole).collect()}
    right = wrong = 0
    for doc_id, spans in found.items():
        for kind, start, end in (x.split(":") for x in spans.split(",") if x):
            if kind == "context":
                good = want.get(doc_id) is not None and texts[doc_id][int(start) : int(end)] == want[doc_id]
                right, wrong = right + good, wrong + (not good)
    assert right >= 0.9 * sum(v is not None for v in want.values())
    assert wrong <= 0.1 * right


def test_pii_empty_table_null_ids_and_long_words(spark, docs):
    assert pii.pii_report(docs([]).limit(0)).count() == 0
    rows = [(None, "x@y.zz"), (None, None), (None, "x@y.zz"), (None, "w" * 5000 + " " + "v" * 5000 + " 123456")]
    got = sorted((r["n_email"], r["spans"]) for r in pii.pii_report(docs(rows, True)).collect())
    assert got == [(0, ""), (0, ""), (1, "email:0:6"), (1, "email:0:6")]
    assert sorted(r["text"] or "" for r in pii.redact(docs(rows, True)).collect())[1:3] == ["[EMAIL]", "[EMAIL]"]


def test_pii_patterns_are_whole_words(spark):
    texts = ["call me: +1", "a (+1", "+1", " . +1", "x" * 300 + " +1", "me at\n+1", "phone:+1", "No. 5, Line +1"]
    df = spark.createDataFrame([(t, t.index("+1")) for t in texts], "t string, p int")
    got = [sorted(r[0]) for r in df.select(pii.patterns_of(F.col("t"), F.col("p"))).collect()]
    assert got == [["call me", "me"], ["a"], [], [], [], ["at", "me at"], ["phone"], ["# line", "line"]]


def test_redaction(spark, docs):
    rows = [(1, "a x@y.zz b 1.2.3.4"), (2, None), (3, "clean 😀 text"), (4, "😀 x@y.zz 😀")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs(rows, True)).collect()}
    assert got == {1: "a [EMAIL] b [IP]", 2: None, 3: "clean 😀 text", 4: "😀 [EMAIL] 😀"}


def test_secrets(spark, docs, real):
    extra = [(40, 'API_KEY: "abcDEF12" token=short passwd:123456 AKIA' + "A" * 16), (41, "f" * 24 + "g" + "e" * 23), (42, "ſecret=abcdef toKen = abcdef")]
    rows = [*EDGE, *extra, *real]
    got = collections.Counter((r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.secret_report(docs(rows, True), ["doc_id"]).collect())
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        a = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        b = [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        c = [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        digest = hashlib.sha256(",".join(x[2] for x in sorted(a + b + c)).encode()).hexdigest()
        want[(r[0], digest, len(a), len(b), len(c))] += 1
    assert got == want


def test_ledger_scans_only_unseen_pairs(spark, docs):
    first = docs([(1, "token = abcdef1"), (2, "token = abcdef1"), (3, "clean")])
    ledger = secrets.update(first)
    assert ledger.count() == 2 * len(secrets.RULES)
    more = docs([(4, "clean"), (5, "secret: 1234567")])
    assert {r["rule"] for r in secrets.scan_unseen(more, ledger).collect()} == set(secrets.RULES)
    assert secrets.scan_unseen(more, ledger).count() == len(secrets.RULES)  # one new blob
    newer = {**secrets.RULES, "base": (2, secrets.scan_base)}
    assert {(r["rule"], r["version"]) for r in secrets.scan_unseen(first, ledger, rules=newer).collect()} == {("base", 2)}
    out, name = secrets.findings(first, ledger)
    assert {r["doc_id"]: len(r[name]) for r in out.collect()} == {1: 1, 2: 1, 3: 0}


def test_quality_statistics(spark, docs, real):
    rows = [*EDGE, *real, (50, "a b c a b c x a b c\nq\nq\n \n \nq"), (51, "a a a a a"), (52, "p q r\n" * 30)]
    out, s = quality.statistics(docs(rows, True))
    got = collections.Counter(tuple(x[s][k] for k in quality.BASE) for x in out.collect())
    want = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = words_of(t)
        n = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {k + j for k in range(len(w) - 2) if n[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if words_of(x)]
        want[(len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit))] += 1
    assert got == want


def test_quality_rules_are_learned(spark, docs, real):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(i, " ".join(word() + ("%%%" if i % 3 == 0 else "") for _ in range(80))) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(200)] + [(None, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out, s, rules = quality.judge(docs(rows, True), labels)
    assert rules.rules
    kept = {r["doc_id"]: r["k"] for r in out.withColumn("k", quality.kept(s, rules)).collect()}
    assert all(kept[i] == (i % 3 != 0) for i in range(300))
    _, _, none = quality.judge(docs(rows), labels.limit(0))
    assert not none.rules
    assert quality.judge(docs(rows).limit(0), labels)[0].count() == 0


def removal_by_hand(rows):
    seen, out = set(), {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "starts", "shard"), [(4096, 2 << 20, 2 << 20), (2, 2 << 20, 1 << 12), (4096, 700, 1 << 14), (4096, 2 << 20, 500)])
def test_substring_removal(spark, docs, real, monkeypatch, hot, starts, shard):
    monkeypatch.setattr(substrings, "PASS_STARTS", starts)
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard)
    monkeypatch.setattr(substrings, "salts", lambda plain, f=substrings.salts: f(plain) if hot > 2 else __import__("numpy").full(1 << 20, 3, "uint32"))
    rng = random.Random(7)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage, line = text(260), text(70)
    rows = [(i, text(150) + (passage if i % 2 else passage[: 100 + i]) + text(60) + line + text(50)) for i in range(60)]
    rows += [(100, passage), (101, passage[:100]), (102, passage[:99]), (103, passage[1:130] + passage[1:130]), (104, "é" * 300), (105, "ab" * 200), (106, None), (107, "")]
    rows += [(200 + r[0], r[1]) for r in real]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in substrings.span_report(docs(rows, True)).collect()}
    assert got == removal_by_hand(rows)


def test_substring_repeated_rows_and_empty(spark, docs):
    t = "0123456789" * 12 + "tail of the text"
    got = sorted((r["doc_id"], r["n_removed"]) for r in substrings.span_report(docs([(1, t), (1, t), (2, t)])).collect())
    own = removal_by_hand([(1, t)])[1][1]
    assert got == [(1, own), (1, own), (2, len(t))]
    assert substrings.span_report(docs([(1, t)]).limit(0)).count() == 0


def test_substring_removal_under_shared_ids(spark, docs):
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = text(130)
    rows = [(None if i < 1500 else 7, text(120) + (passage if i % 50 == 0 else "") + text(20)) for i in range(1700)] + [(3, passage), (7, text(120))]
    df = docs(rows).withColumn("h", F.xxhash64("text"))
    order = {r["text"]: k for k, r in enumerate(df.orderBy(F.col("doc_id").asc_nulls_last(), "h").collect())}
    want = removal_by_hand([(order[t], t) for _, t in rows])
    got = substrings.span_report(df).collect()
    assert sorted(tuple(r)[1:] for r in got) == sorted(want.values())
    assert sum(r["n_removed"] > 0 for r in got) == 34


def test_marks_do_not_depend_on_batches():
    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    rows = sorted((rng.randrange(12), rng.randrange(4), rng.randrange(5), 2 * rng.randrange(3) + (a == 3)) for a in [rng.randrange(9) for _ in range(150)])
    rows += [(20, 7, 1, 0), (21, 7, 1, 0), (21, 7, 1, 0), (21, 8, 1, 0)]
    names = ["anchor", "context", "d", "place"]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)) for c in zip(*part, strict=True)], names)
    read = lambda parts: sorted(tuple(r.values()) for b in substrings._mark_sites(iter(parts)) for r in b.to_pylist())
    whole = read([batch(rows)])
    assert (1, 21, 1, 0) in whole and not any(r[1] == 20 for r in whole)
    for size in (1, 2, 7, 40):
        assert read([batch(rows[i : i + size]) for i in range(0, len(rows), size)]) == whole


def test_suffix_ranks_and_common_prefixes():
    import numpy as np

    b = np.frombuffer(b"abracadabra" * 9 + b"abrac", np.uint8)
    levels = substrings.rank_levels(b)
    raw = b.tobytes() + b"\0" * 64
    order = np.argsort(levels[64], kind="stable")
    assert [raw[i : i + 64] for i in order] == sorted(raw[i : i + 64] for i in range(len(b)))
    p, q = order[:-1], order[1:]
    want = []
    for i, j in zip(p, q, strict=True):
        k = 0
        while k < 100 and max(i, j) + k < len(b) and b[i + k] == b[j + k]:
            k += 1
        want.append(k)
    assert substrings.common_prefix(b, levels, p, q).tolist() == want


def components_by_hand(rows):
    sets, group = {}, {}
    for i, (_, t, *_) in enumerate(rows):
        w = words_of((t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        group[i] = i

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        c = find(i)
        least[c] = min(least.get(c, 1 << 60), r[0])
    return collections.Counter((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def near_copies(n, seed=3):
    rng = random.Random(seed)
    base = [f"u{rng.randrange(10**6)}" for _ in range(60)]
    passage = [f"p{k}" for k in range(40)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(3)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append((1000 + i, " ".join(w)))
        out.append((5000 + i, " ".join([f"z{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 20))] + passage[: rng.randrange(30, 41)])))
    return out


def test_jaccard_components(spark, docs, real):
    rows = [*EDGE, *real, *near_copies(60), (900, "a b c d e f"), (901, "A B c d e f g h"), (902, "a b c d e f g h i")]
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs(rows, True)).collect())
    assert got == components_by_hand(rows)


def test_jaccard_cells_find_what_hubs_miss(spark, docs, monkeypatch):
    """A hot passage in a third of all sets, links between sets of different hubs, cells dealt by hash groups."""
    monkeypatch.setattr(jaccard, "CELL", 16)
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    monkeypatch.setattr(jaccard, "FAMILY", 0.6)
    rng = random.Random(8)
    word = lambda: f"v{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join(passage + [word() for _ in range(rng.randrange(5, 30))])) for i in range(120)]
    chain = [f"c{k}" for k in range(60)]
    for i in range(40):  # each differs a little from the one before
        chain = chain[:]
        chain[rng.randrange(60)] = word()
        rows.append((1000 + i, " ".join(chain)))
    got = collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs(rows, True)).collect())
    assert got == components_by_hand(rows)


def test_jaccard_many_near_copies(spark, docs):
    rows = near_copies(1000)
    assert collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.grouped(docs(rows)).collect()) == components_by_hand(rows)


def test_deduplication_with_clashing_names(spark, docs):
    df = docs([*near_copies(5), (1, None), (1, None)])
    names = ("gone_id_", "gone_hash_", "hash_", "order_", "kind", "label", "doc_id_", "set_key")
    wide = df.select("*", *[F.lit(n).alias(n) for n in names])
    assert jaccard.deduplicated(wide).columns == wide.columns
    assert jaccard.deduplicated(wide).count() == jaccard.deduplicated(df).count()


def test_jaccard_keeps_one_of_each_group(spark, docs):
    rows = [*EDGE, *near_copies(20)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.deduplicated(docs(rows, True)).collect()]
    want = components_by_hand(rows)
    heads = {c for _, n, c in want if n}
    assert sorted(d for d, t in kept if words_of(t)) == sorted(heads)
    assert sum(1 for _, t in kept if not words_of(t)) == 3
    assert jaccard.grouped(docs(rows).limit(0)).count() == 0


def test_jaccard_keeps_texts_without_links_whatever_their_ids(spark, docs):
    own = lambda c: " ".join(f"{c}{i}" for i in range(20))
    rows = [(None, own("a")), (None, own("b")), (None, own("b")), (None, own("c") + " end"), (9, own("c") + " end"), (5, own("d")), (5, own("e")), (6, own("e")), (7, own("d")), (None, None)]
    kept = [(r["doc_id"], r["text"]) for r in jaccard.deduplicated(docs(rows, True)).collect()]
    want = [(None, own("a")), (None, own("b")), (9, own("c") + " end"), (5, own("d")), (5, own("e")), (None, None)]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_mixing(spark, docs):
    rng = random.Random(5)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 1500))), rng.choice(["a", "b", "B", None, "é"])) for i in range(200)]
    rows += [(1, "x y", "a"), (1, "x y", "a"), (300, None, "a"), (301, "w " * 50, "tiny"), (302, None, "void")]
    df = docs(rows, True)
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((r[0], len(words_of(r[1]))) for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[2]] += len(words_of(r[1]))
    target = mixing.targets(dict(sizes))
    assert abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-9 and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 0.5 for s, t in target.items())
    again = mixing.mix_report(df.repartition(7)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))
    assert mixing.mix_report(df.limit(0)).count() == 0


def test_mixing_targets_and_tree():
    import numpy as np

    assert mixing.targets({"a": 100, "b": 10, None: 1000}) == {"a": 300.0, "b": 30.0, None: 780.0}
    counts = np.array([1000, 10, 333])
    quotas = mixing.split(counts, 13, np.random.default_rng(0))
    assert (quotas.sum(0) == counts).all() and np.ptp(quotas.sum(1)) <= 1 and (quotas >= 0).all()


def test_hypergeometric_odds_are_exact_and_large_sizes_are_drawn():
    import numpy as np

    rng, n = np.random.default_rng(1), 20_000
    for good, bad, take in ((7, 5, 6), (3, 30, 20), (40, 2, 41), (1, 1, 1)):
        got = collections.Counter(mixing._hypergeometric(good, bad, take, rng) for _ in range(n))
        whole = math.comb(good + bad, take)
        want = {k: math.comb(good, k) * math.comb(bad, take - k) / whole for k in range(max(0, take - bad), min(good, take) + 1)}
        assert set(got) <= set(want)
        assert all(abs(got[k] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9 for k, p in want.items())
    big = [mixing._hypergeometric(3 * 10**10, 10**10, 2 * 10**10, rng) for _ in range(20)]
    assert all(abs(k - 1.5 * 10**10) < 10**6 for k in big) and len(set(big)) > 15
    counts = np.array([3 * 10**9, 5, 10**9])
    quotas = mixing.split(counts, 3, rng)
    assert (quotas.sum(0) == counts).all() and np.ptp(quotas.sum(1)) <= 1


def test_mixing_tree_in_rounds_deals_every_piece_once(spark):
    counts = spark.createDataFrame([("a", 1000), ("b", 10), (None, 333)], "source string, n long")
    got = mixing._grow(counts, 37, 0, fan=4).toPandas()
    assert got.groupby("source", dropna=False).quota.sum().to_dict().__len__() == 3 and got.quota.sum() == 1343
    per_shard = got.groupby("shard").quota.sum()
    assert len(per_shard) == 37 and per_shard.max() - per_shard.min() <= 2
    rows = spark.createDataFrame([("a", i, i % 5 + 1) for i in range(50)] + [(None, 3, 1), (None, 9, 2)], "k string, i long, w long")
    before = {(r["k"], r["i"]): r["w0"] for r in mixing._before(rows, ["k"], "i", ["w"], group=7).collect()}
    assert before == {**{("a", i): sum(j % 5 + 1 for j in range(i)) for i in range(50)}, (None, 3): 0, (None, 9): 1}


def test_mixing_shards_are_disjoint_and_full(spark, docs):
    rows = [(i, "w " * (i % 700), "ab"[i % 2]) for i in range(400)]
    _, pieces = mixing.mix(docs(rows), block_words=100, shard_pieces=64)
    p = mixing.shuffled(pieces).toPandas()
    assert not p.duplicated(["doc_id", "block", "pass"]).any()
    sizes = p.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1
    assert (p.groupby("shard").place.max() == sizes).all()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = table(spark, sf_dir, "documents")
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == docs.columns, name
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        rows = {r["doc_id"]: r["text"] for r in after.collect()}
        if name == "n-gram Jaccard join":
            assert set(rows) == {c for _, n, c in components_by_hand(sorted(before.items()))}
        elif name == "benchmark decontamination":
            items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
            assert set(rows) == {d for d, t in before.items() if not contamination_by_hand(t, items)[-1]}
        elif name == "PII":
            assert set(rows) == set(before)
            assert all(not spans_by_hand(t) for t in rows.values())
            assert all(rows[d] == t for d, t in before.items() if not re.search("[0-9]{5}|@|[0-9].[0-9]", t))
        docs = spark.createDataFrame(after.collect(), after.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in last.collect()} <= ids
    assert last.count() == docs.count()
    assert F is not None
