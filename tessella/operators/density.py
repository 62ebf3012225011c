"""Density clusters of vectors: mutual reachability, spanning forest, condensed tree, stability.

Vectors are dealt to blocks by several random-projection trees whose thresholds come from a
bounded sample; near vectors share a block of some tree. Core distances are those to the
k-th nearest vector met in any block. Each block's minimum spanning tree over mutual
reachability is made in its task; the union of these trees holds a minimum spanning forest of
all pairs that share a block, which Boruvka rounds single out. With one block (tables up to
``block_rows`` different vectors) the result is that of all pairs.

The hierarchy is built bottom-up in levels: at each level the components below a threshold are
bounded groups, merged in tasks of their own, and then count as one node. Merges at an equal
weight are one merge of many, so the result doesn't depend on which spanning tree was found.
Of equal vectors one stands for all, with their number as its weight.

Defined cases: null ids, null or empty vectors and vectors with null or non-finite components
take no part, nor do vectors of another length than most (ties: the larger length); repeated
rows count again; an empty table has no rows. Weights below 1e-9 count as 1e-9.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

BLOCK_ROWS = 2048
TREES = 3
#: Vectors that thresholds are taken from, and the edges that one task merges.
SAMPLE = 1 << 15
MOST_EDGES = 500_000
#: Rows of a block whose distances to all of it a task holds.
ROWS_AT_ONCE = 128
FLOOR = 1e-9


# -- blocks ----------------------------------------------------------------------------------


def thresholds(sample: np.ndarray, directions: np.ndarray) -> list[np.ndarray]:
    """For each level of a tree the median projections of its nodes, by the sample."""
    node, levels = np.zeros(len(sample), np.int64), []
    for level, direction in enumerate(directions):
        along = sample @ direction
        cuts = np.zeros(1 << level)
        order = np.lexsort((along, node))
        bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
        for i in range(1 << level):
            own = along[order[bounds[i] : bounds[i + 1]]]
            cuts[i] = own[len(own) // 2] if len(own) else 0.0
        levels.append(cuts)
        node = 2 * node + (along >= cuts[node])
    return levels


def blocked(points: DataFrame, n: int, dim: int, block_rows: int, trees: int, seed: int = 0) -> DataFrame:
    """``points`` (id, copies, v) once for each tree, with ``block``; a block has ``block_rows`` rows or a little more."""
    depth = max(0, int(np.ceil(np.log2(max(1, n) / block_rows))))
    if not depth:
        return points.withColumn("block", F.lit(0).cast("long"))
    few = points.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (2 * SAMPLE)))) == 0).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    sample = np.array([r["v"] for r in few.select("v").collect()])
    rng = np.random.default_rng(seed)
    forest = [(d := rng.normal(size=(depth, dim)), thresholds(sample, d)) for _ in range(trees)]

    def route(batches):
        for pdf in batches:
            rows = np.array(pdf["v"].tolist())
            for t, (directions, levels) in enumerate(forest):
                node = np.zeros(len(rows), np.int64)
                for direction, cuts in zip(directions, levels, strict=True):
                    node = 2 * node + (rows @ direction >= cuts[node])
                yield pdf.assign(leaf=(t << depth) + node)

    leaves = written(points.mapInPandas(route, "id long, copies long, v array<double>, leaf long"), "leaves")
    # Leaves that the sample made too large are cut by hash; the other trees cut elsewhere.
    parts = leaves.groupBy("leaf").agg(F.ceil(F.count("*") / (1.5 * block_rows)).alias("parts"))
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts"))
    return leaves.join(parts, "leaf").select("id", "copies", "v", F.xxhash64("leaf", part).alias("block"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _apart(rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of pairs of rows, the same in every block."""
    return np.sqrt(((rows[a] - rows[b]) ** 2).sum(axis=1))


def nearest(rows: np.ndarray, take: int) -> np.ndarray:
    """Numbers of the ``take`` nearest other rows of each row; distances are held for ROWS_AT_ONCE rows at a time."""
    n, square = len(rows), (rows**2).sum(axis=1)
    out = np.zeros((n, take), np.int64)
    for at in range(0, n if take else 0, ROWS_AT_ONCE):
        some = slice(at, at + ROWS_AT_ONCE)
        apart = rows[some] @ rows.T
        apart *= -2
        apart += square
        apart += square[some, None]
        apart[np.arange(len(apart)), np.arange(at, at + len(apart))] = np.inf
        out[some] = np.argpartition(apart, take - 1, axis=1)[:, :take]
    return out


def core_distances(blocks: DataFrame, k: int) -> DataFrame:
    """(id, core): the distance to the k-th nearest other vector, copies counted; to the farthest met if there are fewer."""

    def near(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, ids, n = _matrix(pdf["v"]), pdf["id"].to_numpy(), len(pdf)
        take = min(k, n - 1)
        other = nearest(rows, take)
        a, b = np.repeat(np.arange(n), take), other.ravel()
        return pd.DataFrame({"id": ids[a], "other": ids[b], "apart": _apart(rows, a, b), "copies": pdf["copies"].to_numpy()[b]})

    met = blocks.groupBy("block").applyInPandas(near, "id long, other long, apart double, copies long")
    lists = met.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("apart", "other", "copies"))).alias("near"))
    points = blocks.select("id", "copies").distinct()
    start = F.struct((F.col("copies") - 1).alias("n"), F.when(F.col("copies") > k, 0.0).alias("d"))

    def further(a, x):
        n = a["n"] + x["copies"]
        return F.when(a["d"].isNotNull(), a).otherwise(F.struct(n.alias("n"), F.when(n >= k, x["apart"]).alias("d")))

    found = F.aggregate(F.coalesce("near", F.array().cast("array<struct<apart:double,other:bigint,copies:bigint>>")), start, further)
    return points.join(lists, "id", "left").select("id", "copies", F.coalesce(found["d"], F.array_max("near.apart"), F.lit(0.0)).alias("core"))


def block_trees(blocks: DataFrame, cores: DataFrame) -> DataFrame:
    """(a, b, w), a < b: the edges of each block's minimum spanning tree over mutual reachability."""

    def grow(pdf: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.merge(near, left_on="id", right_on="of")
        rows, ids, core, n = _matrix(pdf["v"]), pdf["id"].to_numpy(), pdf["core"].to_numpy(), len(pdf)
        square = (rows**2).sum(axis=1)
        reach, link, out = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
        at, edges = 0, []
        for _ in range(n - 1):
            out[at] = False
            apart = np.sqrt(np.maximum(0.0, square + square[at] - 2 * rows @ rows[at]))
            mutual = np.maximum(np.maximum(apart, core), core[at])
            nearer = out & (mutual < reach)
            reach[nearer], link[nearer] = mutual[nearer], at
            at = int(np.argmin(np.where(out, reach, np.inf)))
            edges.append((link[at], at))
        a, b = np.array(edges, np.int64).reshape(-1, 2).T
        w = np.maximum(np.maximum(_apart(rows, a, b), core[a]), core[b])
        return pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "w": np.maximum(w, FLOOR)})

    own = blocks.select(F.col("block").alias("its_block"), F.col("id").alias("of")).join(cores.select(F.col("id").alias("of"), "core"), "of")
    return blocks.groupBy("block").cogroup(own.groupBy("its_block")).applyInPandas(grow, "a long, b long, w double").distinct()


# -- spanning forest -------------------------------------------------------------------------


def _followed(links: DataFrame) -> DataFrame:
    """(c, p) with each p followed to the end."""
    while True:
        up = links.select(F.col("c").alias("p"), F.col("p").alias("q"))
        links = written(links.join(up, "p").select("c", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "links")
        if not links.where("moved").limit(1).count():
            return links.select("c", "p")


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Boruvka's rounds over edges (a, b, w): (the forest's edges, (id, c) with a component for every end).

    In each round every component takes its least edge, least by (w, a, b); components that
    are joined by these edges become one, so their number falls to half or less.
    """
    left = written(edges.where("a != b").select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "edges")
    labels = edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct().select("id", F.col("id").alias("c"))
    forest = left.select("a", "b", "w").limit(0)
    while left.limit(1).count():
        edge = F.struct("w", "a", "b")
        ends = left.select(F.col("ca").alias("c"), edge.alias("e"), F.col("cb").alias("p")).union(left.select("cb", edge, "ca"))
        best = written(ends.groupBy("c").agg(F.min(F.struct("e", "p")).alias("m")).select("c", "m.e", "m.p"), "best")
        forest = written(forest.union(best.select("e.a", "e.b", "e.w").distinct()), "forest")
        back = best.select(F.col("c").alias("p"), F.col("p").alias("q"))
        # Two components that take the same edge: the smaller one is the root.
        links = best.join(back, "p").select("c", F.when((F.col("q") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p"))
        roots = _followed(links)
        labels = written(labels.join(roots, "c", "left").select("id", F.coalesce("p", "c").alias("c")), "labels")
        for side in ("ca", "cb"):
            left = left.join(roots.withColumnRenamed("c", side), side).drop(side).withColumnRenamed("p", side)
        left = written(left.select("a", "b", "w", "ca", "cb").where("ca != cb"), "edges")
    return forest, labels


# -- hierarchy -------------------------------------------------------------------------------

STATE = "node long, size long, cluster string, mass double, below double"
RESULT = "kind string, node long, into long, size long, cluster string, parent string, mass double, below double, chosen boolean"


class Merger:
    """Merges nodes by edges of rising weight; ``close`` ends a cluster at the weight of the merge with others.

    A node has a size, and once it has ``least`` points a cluster with a mass (the sum over its
    points of 1/weight where they leave it) and the best stability found below it.
    """

    def __init__(self, least: int) -> None:
        self.least, self.state, self.closed = least, {}, []
        self.up, self.into, self.fell = {}, {}, {}  # merged into; loose nodes into loose ones; loose nodes into clusters

    def add(self, node: int, size: int, cluster: str | None, mass: float, below: float) -> None:
        self.state[node] = (size, cluster, mass, below)

    def root(self, node: int) -> int:
        """The node that ``node`` is merged into now; paths are halved."""
        up = self.up
        while node in up:
            if up[node] in up:
                up[node] = up[up[node]]
            node = up[node]
        return node

    def close(self, node: int, density: float, parent: str | None, eligible: bool = True) -> float:
        """Ends the node's cluster and gives the best stability of its subtree."""
        size, cluster, mass, below = self.state[node]
        stability = mass - density * size
        chosen = eligible and stability >= below
        self.closed.append((cluster, parent, chosen))
        return max(stability, below)

    def merge(self, nodes: set[int], weight: float) -> None:
        density = 1 / weight
        big = sorted(n for n in nodes if self.state[n][1] is not None)
        small = sorted(nodes.difference(big))
        size = sum(self.state[n][0] for n in nodes)
        loose = sum(self.state[n][0] for n in small)
        head = big[0] if len(big) == 1 else min(nodes)
        if len(big) == 1:
            _, cluster, mass, below = self.state[head]
            mass += density * loose
        elif big or size >= self.least:
            cluster = f"{head}@{weight.hex()}"
            below = sum((self.close(n, density, cluster) for n in big), 0.0)
            mass = density * size
        else:
            cluster, mass, below = None, 0.0, 0.0
        if cluster is not None:
            self.fell.update(dict.fromkeys(small, cluster))
        for n in nodes:
            if n != head:
                self.up[n] = head
                del self.state[n]
                if cluster is None:
                    self.into[n] = head
        self.state[head] = (size, cluster, mass, below)

    def run(self, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> None:
        order = np.argsort(w, kind="stable")
        a, b, w = a[order].tolist(), b[order].tolist(), w[order].tolist()
        at = 0
        while at < len(w):
            end = at
            groups: dict[int, set[int]] = {}
            while end < len(w) and w[end] == w[at]:
                x, y = self.root(a[end]), self.root(b[end])
                one, two = groups.get(x) or {x}, groups.get(y) or {y}
                if one is not two:
                    if len(one) < len(two):
                        one, two = two, one
                    one |= two
                    for n in two:
                        groups[n] = one
                groups[x] = groups[y] = one
                end += 1
            for group in {id(g): g for g in groups.values()}.values():
                if len(group) > 1 or self.state[next(iter(group))][1] is None:
                    self.merge(group, w[at])
            at = end


def _level(nodes: DataFrame, edges: DataFrame, labels: DataFrame | None, least: int) -> DataFrame:
    """RESULT rows of merging ``nodes`` by ``edges`` in each group of ``labels`` (one group without labels)."""

    def merge(own: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        m = Merger(least)
        given = own["node"].tolist()
        for node, size, cluster, mass, below in zip(given, own["size"], own["cluster"], own["mass"], own["below"], strict=True):
            m.add(node, int(size), None if pd.isna(cluster) else cluster, mass, below)
        loose = [n for n in given if m.state[n][1] is None]
        m.run(links["a"].to_numpy(), links["b"].to_numpy(), links["w"].to_numpy())
        rows = [("state", n, None, *s[:2], None, *s[2:], None) for n, s in m.state.items()]
        rows += [("closed", None, None, None, cluster, parent, None, None, chosen) for cluster, parent, chosen in m.closed]
        for n in loose:  # a loose node goes with those it was merged into until they fall
            path = [n]
            while path[-1] not in m.fell and path[-1] in m.into:
                path.append(m.into[path[-1]])
            m.into.update(dict.fromkeys(path[:-1], path[-1]))
            rows.append(("moved", n, m.root(n), None, m.fell.get(path[-1]), None, None, None, None))
        rows += [("moved", n, m.root(n), None, None, None, None, None, None) for n in set(given).difference(loose)]
        return pd.DataFrame(rows, columns=[x.split()[0] for x in RESULT.split(", ")]).astype({"node": "Int64", "into": "Int64", "size": "Int64"})

    if labels is None:
        nodes, edges = nodes.withColumn("c", F.lit(0)), edges.withColumn("its_c", F.lit(0))
    else:
        nodes = nodes.join(labels.withColumnRenamed("id", "node"), "node")
        edges = edges.join(labels.select(F.col("id").alias("a"), F.col("c").alias("its_c")), "a")
    return written(nodes.groupBy("c").cogroup(edges.groupBy("its_c")).applyInPandas(merge, RESULT), "level")


def _cut(edges: DataFrame, n: int, most: int) -> tuple[float, DataFrame]:
    """A weight, and the components below it: as many edges as leave each component at most ``most`` of them."""
    share = 0.5
    while True:
        weight = edges.approxQuantile("w", [share], 0.001)[0]
        below = edges.where(F.col("w") <= weight)
        _, labels = spanning_forest(below)
        largest = below.join(labels.withColumnRenamed("id", "a"), "a").groupBy("c").count().agg(F.max("count")).first()[0]
        if largest <= most or share * n <= most:
            return weight, labels
        share /= 2


def hierarchy(points: DataFrame, edges: DataFrame, least: int, most: int = MOST_EDGES) -> tuple[DataFrame, DataFrame]:
    """((id, cluster): where each point leaves the hierarchy, (cluster, parent, chosen)) of points (id, copies, core).

    ``chosen`` says that a cluster is more stable than the best of what is below it; a root
    that holds all points never is.
    """
    own = points.where(F.col("copies") >= least).select(F.col("id").alias("a"), F.col("id").alias("b"), F.greatest("core", F.lit(FLOOR)).alias("w"))
    edges = written(edges.unionByName(own), "edges")
    nodes = written(points.select(F.col("id").alias("node"), F.col("copies").alias("size"), F.lit(None).cast("string").alias("cluster"), F.lit(0.0).alias("mass"), F.lit(0.0).alias("below")), "nodes")
    where = points.select("id", F.col("id").alias("node"), F.lit(None).cast("string").alias("cluster"))
    closed = None
    while n := edges.count():
        if n <= most:
            now, labels = edges, None
            rest = edges.limit(0)
        else:
            weight, labels = _cut(edges, n, most)
            now, rest = edges.where(F.col("w") <= weight), edges.where(F.col("w") > weight)
        ends = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
        result = _level(nodes.join(ends, "node", "left_semi"), now, labels, least)
        moved = result.where("kind = 'moved'").select("node", "into", F.col("cluster").alias("fell"))
        state = result.where("kind = 'state'").select(nodes.columns)
        nodes = written(nodes.join(ends, "node", "left_anti").unionByName(state), "nodes")
        step = where.join(moved, "node", "left")
        open_ = F.col("cluster").isNull()
        where = written(step.select("id", F.when(open_, F.coalesce("into", "node")).otherwise(F.col("node")).alias("node"), F.when(open_, F.col("fell")).otherwise(F.col("cluster")).alias("cluster")), "where")
        found = result.where("kind = 'closed'").select("cluster", "parent", "chosen")
        closed = found if closed is None else closed.unionByName(found)
        for side in ("a", "b"):
            rest = rest.join(moved.select(F.col("node").alias(side), "into"), side, "left").withColumn(side, F.coalesce("into", side)).drop("into")
        edges = written(rest.select("a", "b", "w"), "edges")
    tops = nodes.where("cluster IS NOT NULL")
    several = tops.limit(2).count() > 1
    last = tops.select("cluster", F.lit(None).cast("string").alias("parent"), (F.lit(several) & (F.col("mass") >= F.col("below"))).alias("chosen"))
    return where.select("id", "cluster"), (last if closed is None else closed.unionByName(last))


def _selected(clusters: DataFrame) -> DataFrame:
    """(cluster, top): its outermost chosen ancestor or itself, by doubling."""
    t = written(clusters.select("cluster", F.col("parent").alias("up"), F.when(F.col("chosen"), F.col("cluster")).alias("top")), "tops")
    while t.where("up IS NOT NULL").limit(1).count():
        above = t.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        t = written(t.join(above, "up", "left").select("cluster", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")), "tops")
    return t.select("cluster", "top")


def density_clusters(vectors: DataFrame, key: str, vector: str, least: int = 10, block_rows: int = BLOCK_ROWS, trees: int = TREES, most: int = MOST_EDGES) -> DataFrame:
    """(key, topic, core): topic is the smallest key of the vector's cluster, null for noise.

    ``least`` is the smallest cluster and the neighbour that core distances go to.
    """
    v = F.transform(vector, lambda x: x.cast("double"))
    rows = vectors.select(F.col(key).cast("long").alias("id"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & ~F.coalesce(bad, F.lit(True)))
    rows = written(rows, "vectors")
    dim = rows.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dim is None:
        return rows.select(F.col("id").alias(key), F.lit(None).cast("long").alias("topic"), F.lit(0.0).alias("core"))
    rows = rows.where(F.size("v") == dim["dim"])
    points = written(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("copies")).select("id", "copies", "v"), "points")
    # Two vectors may share an id: each goes on under a number of its own.
    points = written(points.withColumn("name", F.col("id")).withColumn("id", F.monotonically_increasing_id()), "points")
    blocks = written(blocked(points.select("id", "copies", "v"), points.count(), dim["dim"], block_rows, trees), "blocks")
    cores = written(core_distances(blocks, least), "cores")
    edges = written(block_trees(blocks, cores), "trees")
    if edges.count() > most:
        edges, _ = spanning_forest(edges)
    where, clusters = hierarchy(cores, edges, least, most)
    labelled = where.join(_selected(clusters), "cluster", "left").select("id", "top")
    labelled = labelled.join(cores.select("id", "core"), "id").join(points.select("id", "name", "v"), "id")
    names = labelled.where("top IS NOT NULL").groupBy("top").agg(F.min("name").alias("topic"))
    found = labelled.join(names, "top", "left").select("v", "topic", "core")
    return rows.join(found, "v").select(F.col("id").alias(key), "topic", "core")
