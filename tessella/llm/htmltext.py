"""Main text of web pages with a site style tree.

Every page is parsed once into blocks, each with the path of structural elements
(tag and class) that it hangs from. The pages of a host are merged into a style
tree: for each path the layouts of its children (presentation) and the texts
(content), with the number of different pages that show them. A text that k of m
different pages show has the importance 1 - log k / log m, one minus its entropy.
A path's importance is the mean of its texts' and, with weight 1 - CONTENT_WEIGHT,
the entropy of its layouts over log m. From each page go the texts of low
importance that LEAST_PAGES pages show at least, and the paths of low importance.
Hosts with fewer different pages back off to the tree over all hosts: there a path
goes if its last element has a class, and it is of low importance on the mean of
LEAST_HOSTS hosts at least.

Exact copies of a page count once. Near copies are no template: a page that the
tree would take more than MOST_LOSS of its text from keeps all of it, and a path's
mean counts each of its texts once.

What an element says of itself is evidence too. Elements that by their tag are
something else than the article (nav, footer, aside, form, script, hidden ones,
...) go, and where a page has an article (else a main) element, only its content
counts. A class, id or role made of noise words and words of structure only
(comments, cookie-notice, site-footer) says as much, unless the element holds an
article or main, or over half of the page's text, where the page has no text of an
article or main outside such elements. A name that only contains a noise word
(related-science) is weak evidence: such a block goes at a higher importance. Marks
after has-, no- or with- don't count.

Counts combine before they shuffle; no host's pages meet in one task. A path is a
64-bit number made of its parent's, so deep pages take linear time and memory.

Defined results: null html gives an empty text; a page without main content gives
an empty text; a null URL belongs to the empty host; repeated rows are extracted
alike; ties don't arise; unclosed or stray tags are tolerated.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Scratch, fresh, stored
from .urlrules import host

#: Different pages that must show a text, or make up a host, before it is judged by itself.
LEAST_PAGES = 4
#: Hosts that must tell of a path before others back off to it.
LEAST_HOSTS = 3
LEAST_IMPORTANCE = 0.25
#: What blocks with weak evidence against them must reach.
MARKED_IMPORTANCE = 0.6
CONTENT_WEIGHT = 0.9
MOST_LOSS = 0.5
#: Parts that a host's texts are dealt to.
SALTS = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
DROP = frozenset(
    "script style noscript template nav footer aside form button select textarea input iframe svg canvas object embed dialog menu head title".split()
)
#: Words in class, id or role that mark an element as something else than the article.
NOISE = frozenset(
    "ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion promotions nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer sidebar sidebars widget widgets cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social comment comments commentlist disqus respond replies reply related recommended recommendations pagination pager masthead toolbar search complementary contentinfo".split()
)
#: Words that say where something stands, not what it is.
STRUCTURE = frozenset(
    "site page post entry article main content section area container wrapper wrap inner outer box block list item items group row col column header head title body text "
    "link links button buttons bar top bottom left right center fixed sticky global primary secondary small large mobile desktop form field input icon icons logo image the of and".split()
)
#: Marks that say something of the layout and not of the element's own content.
QUALIFIED = re.compile(r"(?<![a-z0-9])(?:has|no|with)[-_]+[a-z0-9]+")
#: Open elements that a start tag ends.
_ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_SCOPE = frozenset("ul ol menu dl table select article section div body".split())


def says_noise(marks: str) -> tuple[bool, bool]:
    """Whether a name among class, id and role is made of noise and structure words only, and whether any holds a noise word."""
    strong = weak = False
    for name in QUALIFIED.sub(" ", marks).split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not w.isdigit()]
        if NOISE.intersection(words):
            weak = True
            strong |= all(w in NOISE or w in STRUCTURE for w in words)
    return strong, weak


class Element:
    """An open element."""

    __slots__ = ("tag", "path", "drop", "article", "main", "hard", "mark", "weak", "classed")

    def __init__(self, tag: str, path: int, drop: bool, article: bool, main: bool, hard: bool, mark: int, weak: bool, classed: bool) -> None:
        self.tag, self.path, self.drop, self.article, self.main = tag, path, drop, article, main
        #: Dropped whatever its names are; the nearest strongly marked element around (0: none); weakly marked around.
        self.hard, self.mark, self.weak, self.classed = hard, mark, weak, classed


_ROOT = Element("", 0, False, False, False, False, 0, False, False)


class Block:
    """A stretch of text between structural tags, and what its element says."""

    __slots__ = ("path", "text", "drop", "article", "main", "weak", "classed")

    def __init__(self, at: Element, text: str) -> None:
        self.path, self.text, self.drop, self.article, self.main, self.weak, self.classed = at.path, text, at.drop, at.article, at.main, at.weak, at.classed


class Blocks(HTMLParser):
    """Collects the blocks of a page, and the child tags of each path."""

    def __init__(self, spared: frozenset = frozenset()) -> None:
        super().__init__(convert_charrefs=True)
        self.spared, self.tags = spared, 0
        #: By the number of a strongly marked element's start tag: characters, whether it holds an article or main, the mark around.
        self.marked: dict[int, list] = {}
        self.chars = 0
        self.out: list[Block] = []
        self.layouts: dict[int, dict[str, None]] = {}
        self.stack: list[Element] = []
        self.open: Counter = Counter()
        self.buffer: list[str] = []
        self.has_article = self.has_main = False

    @property
    def top(self) -> Element:
        return self.stack[-1] if self.stack else _ROOT

    def flush(self) -> None:
        if not self.buffer:
            return
        text = " ".join("".join(self.buffer).split())
        self.buffer = []
        if text:
            at = self.top
            self.out.append(Block(at, text))
            if not at.hard:
                self.chars += len(text)
                if at.mark:
                    self.marked[at.mark][0] += len(text)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self.flush()
            if self.open["p"]:
                self._close("p")
            for t in _ENDS.get(tag, ()):
                self._close(t, _SCOPE)
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID:
            return
        values = {k: v or "" for k, v in attrs}
        at = self.top
        self.tags += 1
        hard = at.hard or tag in DROP or (tag == "header" and not (at.article or at.main))
        hard = hard or "hidden" in values or values.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", values.get("style", "")))
        leads = tag in ("article", "main") or values.get("role") == "main"
        if not hard and leads and at.mark:
            self.marked[at.mark][1] = True
        strong = weak = False
        if not hard and tag not in ("html", "body") and any(k in values for k in ("class", "id", "role")):
            strong, weak = says_noise(" ".join(values.get(k, "") for k in ("class", "id", "role")).lower())
        mark = at.mark
        if strong:
            self.marked[self.tags] = [0, leads, mark]
            mark = self.tags
        drop = at.drop or hard or (strong and self.tags not in self.spared)
        article, main = at.article, at.main
        if not drop:
            article, main = article or tag == "article", main or tag == "main" or values.get("role") == "main"
            self.has_article |= tag == "article"
            self.has_main |= main
        path, classed = at.path, at.classed
        if tag in BLOCK:
            self.layouts.setdefault(path, {})[tag] = None
            classed = bool(values.get("class"))
            path = xxhash.xxh64_intdigest(f"{path}/{tag}.{values.get('class', '')}".encode("utf-8", "surrogatepass")) >> 1
        elif drop and not at.drop:
            self.flush()  # an inline element is left out of the block around it
        self.stack.append(Element(tag, path, drop, article, main, hard, mark, at.weak or weak, classed))
        self.open[tag] += 1

    def _cut(self, size: int) -> None:
        for e in self.stack[size:]:
            self.open[e.tag] -= 1
        del self.stack[size:]

    def _close(self, tag: str, within: frozenset = frozenset()) -> None:
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                self.flush()
                self._cut(i)
                return
            if self.stack[i].tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.buffer.append(" ")
        if tag in VOID or not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i].tag == tag:
                if tag in BLOCK or (self.stack[i].drop and not (i and self.stack[i - 1].drop)):
                    self.flush()
                self._cut(i)
                return

    def handle_data(self, data: str) -> None:
        self.buffer.append(data)

    def end(self) -> None:
        """What marked elements hold counts for the marked ones around them."""
        self.close()
        self.flush()
        for k in sorted(self.marked, reverse=True):
            chars, holds, around = self.marked[k]
            if around:
                self.marked[around][0] += chars
                self.marked[around][1] |= holds


def parse(html: str) -> Blocks:
    p = _parsed(html, frozenset())
    if p.marked and not any((b.article or b.main) and not b.drop for b in p.out):
        spared = frozenset(k for k, (chars, holds, _) in p.marked.items() if chars and (holds or 2 * chars > p.chars))
        if spared:
            p = _parsed(html, spared)
    return p


def _parsed(html: str, spared: frozenset) -> Blocks:
    p = Blocks(spared)
    p.feed(html)
    p.end()
    return p


def main_blocks(p: Blocks) -> list[Block]:
    """The blocks of the article, else of main, else of the page, without dropped elements."""
    return [b for b in p.out if not b.drop and (b.article or not p.has_article) and (b.main or p.has_article or not p.has_main)]


_BLOCK = pa.struct([("path", pa.int64()), ("layout", pa.int64()), ("content", pa.int64()), ("weak", pa.bool_()), ("classed", pa.bool_())])
_SHAPES = T.ArrayType(
    T.StructType().add("path", "long").add("layout", "long").add("content", "long").add("weak", "boolean").add("classed", "boolean")
)


def _number(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _pages(html: str, names: dict[str, str]):
    """Columns in place of the html: the page's blocks as shapes and texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 128):
                batch = whole.slice(at, 128)
                shapes, texts = [], []
                for raw in batch.column(html):
                    p = parse(raw.as_py() or "")
                    blocks = main_blocks(p)
                    layout = {b.path: _number(",".join(p.layouts.get(b.path, ()))) for b in blocks}
                    shapes.append([{"path": b.path, "layout": layout[b.path], "content": _number(b.text), "weak": b.weak, "classed": b.classed} for b in blocks])
                    texts.append([b.text for b in blocks])
                kept = [n for n in batch.schema.names if n != html]
                new = [pa.array(shapes, pa.list_(_BLOCK)), pa.array(texts, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *new], [*kept, names["shapes"], names["texts"]])

    return run


def style_tree(blocks: DataFrame, layouts: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Importance by (host, path, content), by (host, path), and by path over all hosts.

    ``blocks``: host, path, content of different pages, each text of a path once a
    page; ``layouts``: host, path, layout, once a page, and for every page a row
    (host, null, null). Only hosts with LEAST_PAGES different pages tell anything.
    """
    keep = lambda df, name: stored(df, name, scratch)
    laid = layouts.groupBy("host", "path", "layout").agg(F.count("*").alias("k"))
    laid = keep(laid, "layouts")
    sizes = laid.where("path IS NULL").select("host", F.col("k").alias("m")).where(F.col("m") >= LEAST_PAGES)
    # a host may hold a third of all texts: its size is sent to each of its parts
    spread = sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    shown = blocks.groupBy("host", "path", "content").agg(F.count("*").alias("k")).withColumn("salt", F.pmod("content", F.lit(SALTS)).cast("int"))
    texts = keep(shown.join(spread, ["host", "salt"]).drop("salt").withColumn("importance", 1 - F.log("k") / F.log("m")), "texts")
    total = laid.where("path IS NOT NULL").groupBy("host", "path").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.log("k")).alias("klogk"))
    # a text counts once
    content = texts.groupBy("host", "path").agg(F.avg("importance").alias("content"), F.max("m").alias("m"), F.sum("k").alias("k"))
    layout = F.greatest((F.log("n") - F.col("klogk") / F.col("n")) / F.log("m"), F.lit(0.0))
    paths = content.join(total, ["host", "path"]).withColumn("importance", CONTENT_WEIGHT * F.col("content") + (1 - CONTENT_WEIGHT) * layout)
    paths = keep(paths.where(F.col("k") >= LEAST_PAGES).select("host", "path", "importance"), "paths")
    everywhere = paths.groupBy("path").agg(F.avg("importance").alias("importance"), F.count("*").alias("hosts")).where(F.col("hosts") >= LEAST_HOSTS)
    return texts.where(F.col("k") >= LEAST_PAGES), paths, everywhere


def _lost(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, lost): the places of the blocks that the tree removes, for pages that lose any; ``pages``: key, host (a number), shapes."""
    keep = lambda df, name: stored(df, name, scratch)
    pages = keep(pages.dropDuplicates(["key"]), "different")  # copies of a page are one
    once = lambda *names: F.array_distinct(F.transform("shapes", lambda x: F.struct(*[x[n].alias(n) for n in names])))
    blocks = pages.select("host", F.explode(once("path", "content")).alias("x")).select("host", "x.*")
    page = F.array(F.struct(F.lit(None).cast("long").alias("path"), F.lit(None).cast("long").alias("layout")))
    layouts = pages.select("host", F.explode(F.concat(page, once("path", "layout"))).alias("x")).select("host", "x.*")
    texts, paths, everywhere = style_tree(blocks, layouts, scratch)
    least = F.col("importance") < MARKED_IMPORTANCE
    low = F.col("importance") < F.when(F.col("weak"), MARKED_IMPORTANCE).otherwise(LEAST_IMPORTANCE)
    # few texts and paths are of low importance: their tables are written, so that joins with them know their size
    texts = keep(texts.where(least).select("host", "path", "content", "importance"), "low-texts")
    by_path = keep(paths.where(least), "low-paths")
    everywhere = keep(everywhere.where(least).select("path", "importance"), "low-everywhere")
    each = pages.select("key", "host", F.posexplode("shapes").alias("at", "x")).select("key", "host", "at", "x.*")
    found = each.join(texts, ["host", "path", "content"]).where(low).select("key", "at")
    found = found.union(each.join(by_path, ["host", "path"]).where(low).select("key", "at"))
    others = each.where("classed").join(everywhere, "path").where(low).join(paths.select("host", "path"), ["host", "path"], "left_anti")
    return stored(found.union(others.select("key", "at")).groupBy("key").agg(F.collect_set("at").alias("lost")), "lost")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, str]:
    """``pages`` with a column of the main text in place of the html, and its name."""
    scratch = Scratch(pages.sparkSession)
    taken = pages
    names = {}
    for n in ("shapes", "texts", "key", "host_"):
        names[n] = fresh(taken, n)
        taken = taken.withColumn(names[n], F.lit(None))
    own = [c for c in pages.columns if c != html]
    keyed = pages.withColumn(names["host_"], host(F.col(f"`{url}`"))).withColumn(names["key"], F.xxhash64(names["host_"], F.coalesce(F.col(f"`{html}`"), F.lit(""))))
    fields = [f for f in keyed.schema.fields if f.name != html]
    schema = T.StructType(fields).add(names["shapes"], _SHAPES).add(names["texts"], T.ArrayType(T.StringType()))
    parsed = stored(keyed.mapInArrow(_pages(html, names), schema), "pages")
    lost = _lost(parsed.select(F.col(names["key"]).alias("key"), F.xxhash64(names["host_"]).alias("host"), F.col(names["shapes"]).alias("shapes")), scratch)
    scratch.drop()
    name, gone = fresh(pages, "text"), fresh(taken, "lost")
    out = parsed.join(lost.select(F.col("key").alias(names["key"]), F.col("lost").alias(gone)), names["key"], "left")
    texts = F.col(names["texts"])
    left = F.filter(texts, lambda _, i: ~F.coalesce(F.array_contains(gone, i), F.lit(False)))
    chars = lambda a: F.length(F.array_join(a, ""))
    blocks = F.when(F.col(gone).isNull() | (chars(left) < (1 - MOST_LOSS) * chars(texts)), texts).otherwise(left)
    return out.select(*[F.col(f"`{c}`") for c in own], F.array_join(blocks, "\n").alias(name)), name
