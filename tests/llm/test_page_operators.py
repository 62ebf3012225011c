"""Operators on pages against brute force and round trips, on small tables with awkward rows."""

import collections
import hashlib
import itertools
import time
import zlib
import random
import math

import pytest
from pyspark.sql import functions as F

from tessella.llm.shared import Scratch
from tessella.llm import htmltext, urlrules, warc
from tessella.llm.shared import table


@pytest.fixture(scope="module")
def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


def make(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("text", F.lit("clash"))


WARC_ROWS = [
    (1, "http://a/1", "x" * 100), (2, "http://a/2", "x" * 100), (3, None, "x" * 99), (4, "u", "x" * 99), (5, "u\r\nv%0A", None), (6, "é", "é" * 50), (7, "é", "é" * 50),
    (7, "é", "é" * 50), (None, "n", "x" * 100), (None, "n", "y" * 200), (8, "", "\r\n\r\n" * 60), (9, "big", "z" * 3_000_000),
]


def test_warc_round_trip(spark):
    got = collections.Counter(map(tuple, warc.round_trip(make(spark, WARC_ROWS)).collect()))
    first, want = {}, collections.Counter()
    for i, _, h in WARC_ROWS:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    for i, u, h in WARC_ROWS:
        raw = (h or "").encode()
        of = first.get(h)
        again = of is not None and i != of
        want[(i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", of if again else None, u)] += 1
    assert got == want


def test_warc_headers_are_right_for_other_readers(spark):
    rows = [(1, "http://a.com/x%20y", "x" * 200), (2, "http://b.com/", "x" * 200), (2, "http://b.com/", "x" * 200), (None, "http://c.com/a\nb%0A", "short"), (None, "u", "short")]
    folder, index = warc.write(make(spark, rows))
    heads = []
    for r in index.collect():
        with open(folder.removeprefix("file://") + "/" + r["file"], "rb") as f:
            f.seek(r["offset"])
            heads.append(zlib.decompress(f.read(r["length"]), 31).split(b"\r\n\r\n")[0].decode())
    field = lambda h, n: [x.split(": ", 1)[1] for x in h.split("\r\n") if x.startswith(n + ": ")]
    assert sorted(x for h in heads for x in field(h, "WARC-Target-URI")) == ["http://a.com/x%20y", "http://b.com/", "http://b.com/", "http://c.com/a%0Ab%0A", "u"]
    assert len({x for h in heads for x in field(h, "WARC-Record-ID")}) == 5
    assert [x for h in heads for x in field(h, "WARC-Refers-To-Target-URI")] == ["http://a.com/x%20y"] * 2


def test_warc_selected_reads(spark, pages, monkeypatch):
    monkeypatch.setattr(warc, "READ_BYTES", 5000)
    folder, index = warc.write(pages)
    assert index.count() == pages.count()
    some = index.where("page_id % 7 = 3")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in warc.read(folder, some).collect():
        assert r["page_id"] % 7 == 3
        assert r["payload"] is None or bytes(r["payload"]).decode() == html[r["page_id"]]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_damaged_record_is_refused():
    import zlib

    raw = warc.record(1, "u", b"payload", hashlib.sha256(b"other").hexdigest(), None, False)
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(raw)
    assert zlib.decompress(raw, 31).startswith(b"WARC/1.1\r\n")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p>";</script></head><body class="ad">
<header>Site</header><nav><ul><li>one<li>two</ul></nav><div class="cookie-notice">cookies</div>
<main><article><header><h1>A &amp; B&eacute;</h1></header><p>first <b>bold</b>
 line<br>more<p>second &lt;x&gt; <a href="#">link</a></p><div class="advert">buy</div><ul><li>i</li><li>j</li></ul>
<aside>side</aside><form>f<p>in form</p></form><p hidden>no</p><p style="display: none">no</p><section class="comments"><article><p>reader</p></article></section>
<p>split<span class="ad">x</span>word</p><table><tr><td>c1<td>c2</table><!-- c --><noscript>n</noscript>tail</article></main><footer>foot</footer></body></html>"""
TEXT = "A & Bé\nfirst bold line more\nsecond <x> link\ni\nj\nsplit\nword\nc1\nc2\ntail"


def test_html_extraction(spark):
    rows = [(1, "http://h/1", PAGE), (2, None, None), (3, "x", ""), (4, "y", "plain &nbsp; text"), (5, "z", "<p>no article<div>here"), (6, "z", "<article>open <p>never closed"), (1, "http://h/1", PAGE), (7, "w", "<article></article>")]
    out, name = htmltext.extract(make(spark, rows))
    got = sorted((r["page_id"], r[name]) for r in out.collect())
    assert got == [(1, TEXT), (1, TEXT), (2, ""), (3, ""), (4, "plain text"), (5, "no article\nhere"), (6, "open\nnever closed"), (7, "")]
    assert htmltext.extract(make(spark, rows).limit(0))[0].count() == 0


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<div class='content has-sidebar'><p>long own text</p><div class='sidebar'>side</div></div>", "long own text"),
        ("<div class='post no-comments'><article><p>own</p></article></div>", "own"),
        ("<div id='search-results'><article><p>own text</p></article></div><p>around the page</p>", "own text"),
        ("<div class='widget'><div class='social'><p>most of the text of this page</p></div></div><p>rest</p>", "most of the text of this page\nrest"),
        ("<article><div class='promo'><p>all that the article says</p></div></article>", "all that the article says"),
        ("<article><p>own</p><div class='comments'><p>longer than the article by far</p></div></article>", "own"),
        ("<article><p>own</p></article><div class='related'><article>teaser</article></div>", "own"),
        ("<nav class='menu'><article>in a menu</article></nav><p>own</p>", "own"),
    ],
)
def test_marked_wrappers_keep_the_article(html, want):
    assert "\n".join(b.text for b in htmltext.main_blocks(htmltext.parse(html))) == want


def test_style_tree_drops_what_all_pages_of_a_host_share(spark):
    body = lambda i: "<article>" + "".join(f"<p>own text {i} {j} of this page</p>" for j in range(5)) + "<div class='z1'>The same words everywhere</div></article>"
    rows = [(i, f"http://host.example/{i}", body(i)) for i in range(20)] + [(100, "http://other.example/1", body(7))]
    rows += [(200 + i, "http://copies.example/", body(1)) for i in range(20)]
    out, name = htmltext.extract(make(spark, rows))
    got = {r["page_id"]: r[name] for r in out.collect()}
    assert all("same words" not in got[i] and got[i].count("\n") == 4 for i in range(20))
    assert "same words" in got[100] and "same words" in got[200]


def shares(n, own, template, width=5):
    """``n`` pages with ``width`` paragraphs of their own and one shared block in a neutral element."""
    return ["<body>" + "".join(f"<p>{own} number {i} paragraph {j} with words of its own and more</p>" for j in range(width)) + template + "</body>" for i in range(n)]


def test_style_tree_tells_template_from_near_copies(spark):
    notice = "<div class='zz'><p>" + "We put this long line on all of our pages, whatever they say. " * 5 + "</p></div>"
    rows = [(i, "http://a.example/", h) for i, h in enumerate(shares(6, "a", notice, 8))]
    # near copies of one article, in which only a short line differs
    article = "".join(f"<p>The {w} paragraph of an article that many addresses show.</p>" for w in ("first", "second", "third"))
    rows += [(100 + i, "http://b.example/", f"<body>{article}<p>seen {i} times</p></body>") for i in range(30)]
    # the same path as article text
    rows += [(200 + i, "http://c.example/", h) for i, h in enumerate(shares(8, "c", "<p>Read our other pages too.</p>"))]
    out, name = htmltext.extract(make(spark, rows))
    got = {r["page_id"]: r[name] for r in out.collect()}
    assert all("all of our pages" not in got[i] and got[i].count("\n") == 7 for i in range(6))
    assert all(got[100 + i].count("\n") == 3 and got[100 + i].endswith(f"seen {i} times") for i in range(30))
    assert all("Read our" not in got[200 + i] and got[200 + i].count("\n") == 4 for i in range(8))


def test_small_hosts_back_off_to_all_hosts(spark):
    box = "<div class='zz-box'>Join the {} club now</div>"
    rows = [(100 * h + i, f"http://h{h}.example/{i}", page) for h in range(4) for i, page in enumerate(shares(5, f"h{h}", box.format(f"h{h}")))]
    rows += [(1000, "http://single.example/", shares(1, "single", box.format("single"))[0]), (1001, "http://single2.example/", "<body><div class='related-science'><p>prose of the page</p></div><p>and more</p></body>")]
    out, name = htmltext.extract(make(spark, rows))
    got = {r["page_id"]: r[name] for r in out.collect()}
    assert not any("club" in t for t in got.values())
    assert got[1000].count("\n") == 4 and got[1001] == "prose of the page\nand more"


def test_style_tree_importance_by_hand(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(12), rng.randrange(3), rng.randrange(2), rng.randrange(5)) for _ in range(400)]  # host, page, path, layout, content
    blocks = spark.createDataFrame(sorted({(h, p, c, page) for h, page, p, _, c in rows}), "host long, path long, content long, page long").drop("page")
    laid = sorted({(h, p, x, page) for h, page, p, x, _ in rows}) + sorted({(h, None, None, page) for h, page, *_ in rows})
    layouts = spark.createDataFrame(laid, "host long, path long, layout long, page long").drop("page")
    texts, paths, everywhere = htmltext.style_tree(blocks, layouts, Scratch(spark))
    m = {h: len({r[1] for r in rows if r[0] == h}) for h in {r[0] for r in rows}}
    want_texts, want_paths = {}, {}
    for h, p in {(r[0], r[2]) for r in rows}:
        shown = {c: len({r[1] for r in rows if r[0] == h and r[2] == p and r[4] == c}) for c in {r[4] for r in rows if r[0] == h and r[2] == p}}
        sizes = [len({r[1] for r in rows if r[0] == h and r[2] == p and r[3] == x}) for x in {r[3] for r in rows if r[0] == h and r[2] == p}]
        single = {c: 1 - math.log(k) / math.log(m[h]) for c, k in shown.items()}
        want_texts |= {(h, p, c): single[c] for c, k in shown.items() if k >= htmltext.LEAST_PAGES}
        entropy = -sum(k / sum(sizes) * math.log(k / sum(sizes)) for k in sizes) / math.log(m[h])
        want_paths[h, p] = 0.9 * sum(single.values()) / len(single) + 0.1 * entropy
    assert {(r["host"], r["path"], r["content"]): r["importance"] for r in texts.collect()} == pytest.approx(want_texts)
    assert {(r["host"], r["path"]): r["importance"] for r in paths.collect()} == pytest.approx(want_paths)
    assert {r["path"]: r["importance"] for r in everywhere.collect()} == pytest.approx({p: sum(want_paths[h, p] for h in m) / len(m) for p in range(3)})


def test_deep_and_long_pages_take_linear_time():
    start = time.process_time()
    deep = "".join(f"<div class='c{i % 3}'>" for i in range(30_000)) + "text" + "</p>" * 1000
    assert [b.text for b in htmltext.main_blocks(htmltext.parse(deep))] == ["text"]
    marked = "<div class='ad'>" * 30_000 + "text"
    assert [b.text for b in htmltext.main_blocks(htmltext.parse(marked))] == ["text"]
    assert time.process_time() - start < 20


URLS = [
    "http://example.com/en/1", "http://a.example.com/en/1", "http://www.example.com/en/", "http://x.www.example.com/en/q", "http://notexample.com/en/", "http://a.net/es/1", "http://NET/fr/",
    "http://net.org/fr/", "http://b.com", "http://b.com/", "http://b.com?x=/en/", "no scheme", None, "://", "http://", "a://b://c/d", "http://H.COM/P?q#f", "http://example.com/EN/", "http://x.net#/es/", "x://y.net/es/\nz",
]


def judged_by_hand(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] + [len(path)])]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_host_rules(spark, pages):
    urls = URLS + [r["url"] for r in pages.collect()]
    out, n = urlrules.judged(make(spark, [(i, u, "") for i, u in enumerate(urls)]).drop("text"))
    got = {r["page_id"]: (r[n["host"]], r[n["path"]], r[n["rule"]], r[n["verdict"]]) for r in out.collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = judged_by_hand(u)
        assert got[i][:3] == (host, path, rule), u
        assert got[i][3] == verdict if rule else got[i][3] in ("allow", "block")


def test_mined_rules_are_confident_and_applied(spark):
    rows = [(f"http://h{i}.net/{'es' if i % 2 else 'de'}/spam/{i}", "block" if i % 2 else "allow") for i in range(200)]
    labelled = spark.createDataFrame(rows, "url string, label string")
    rules = urlrules.mine(labelled, 200, "url", "label")
    assert [r["items"] for r in rules.collect()] == [["p:es"]]
    new = spark.createDataFrame([("http://q.org/es/1",), ("http://q.org/fr/1",), (None,)], "url string")
    assert [r[0] for r in urlrules.matched(new, rules, "url").collect()] == ["http://q.org/es/1"]


def test_rules_see_all_tokens_of_a_url(spark):
    rows = [(f"http://h.org/a/b/c/{'es' if i % 2 else 'de'}/{i}", "block" if i % 2 else "allow") for i in range(100)]
    rows += [(f"http://{'bad' if i % 2 else 'good'}.a.b.c.org/x?a=1&b=2&c=3&{'spam' if i % 4 < 2 else 'ham'}={i}", "block" if i % 4 == 1 else "allow") for i in range(100)]
    rules = urlrules.mine(spark.createDataFrame(rows, "url string, label string"), 200, "url", "label")
    found = {tuple(r["items"]) for r in rules.collect()}
    tokens = lambda u: {"s:http"} | {f"h{i}:{x}" for i, x in enumerate(u.split("/")[2].split(".")[::-1])} | {f"p:{w}" for w in u.split("?")[0].split("/")[3:] if not w.isdigit()} | {f"q:{q.split('=')[0]}" for q in u.split("?")[1:] for q in q.split("&")}
    sets, want = [(tokens(u), lab == "block") for u, lab in rows], set()
    for size in (1, 2, 3):
        for items in {c for t, bad in sets if bad for c in itertools.combinations(sorted(t), size)}:
            held = [bad for t, bad in sets if t.issuperset(items)]
            if sum(held) >= 10 and sum(held) / len(held) >= 0.95 and not any(set(w) < set(items) for w in want):
                want.add(items)
    assert found == want and ("p:es",) in want and any("h4:bad" in w for w in want)
    new = spark.createDataFrame([("http://h.org/a/b/c/es/1",), ("http://h.org/a/b/c/fr/1",)], "url string")
    assert [r[0] for r in urlrules.matched(new, rules, "url").collect()] == ["http://h.org/a/b/c/es/1"]


def test_rules_are_confirmed_on_urls_held_out(spark):
    rng = random.Random(2)
    rows = [(f"http://h{i % 9}.{'net' if i % 3 else 'org'}/{'spam' if i % 2 else 'news'}/{rng.randrange(10**6)}", "block" if i % 2 else "allow") for i in range(600)]
    rows += [(f"http://odd{i}.net/x/{i}", "block") for i in range(3)]
    df = spark.createDataFrame(rows, "url string, label string")
    got = urlrules.learned(df, "url", "label").collect()
    assert [r["items"] for r in got] == [["p:spam"]] and got[0]["fitted"] > 50 and got[0]["precision"] == 1.0
    # tokens of the last label alone are no rule, however sure
    tld = spark.createDataFrame([(f"http://h{i}.{'net' if i % 2 else 'com'}/{i}", "block" if i % 2 else "allow") for i in range(200)], "url string, label string")
    assert urlrules.learned(tld, "url", "label").count() == 0
    assert urlrules.learned(tld.limit(0), "url", "label").count() == 0


def test_url_filter_edges(spark):
    out, n = urlrules.judged(make(spark, [(1, None, ""), (2, "nothing", ""), (2, "nothing", "")]))
    assert sorted((r["page_id"], r[n["verdict"]]) for r in out.collect()) == [(1, "allow"), (2, "allow"), (2, "allow")]
    assert urlrules.judged(make(spark, [(1, "http://a.com/", "")]).limit(0))[0].count() == 0
