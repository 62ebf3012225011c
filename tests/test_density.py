"""Density clusters against a plain version over all pairs."""

import itertools
import tracemalloc

import numpy as np
import pytest

from tessella.operators.density import density_clusters, nearest, spanning_forest


def plain_clusters(ids, rows, least):
    """The condensed tree from the top: at each weight a set falls apart into the components below it."""
    n = len(rows)
    apart = np.sqrt(((rows[:, None] - rows[None]) ** 2).sum(-1))
    core = np.sort(apart, axis=1)[:, min(least, n - 1)]
    reach = np.maximum(np.maximum(apart, np.maximum(core[:, None], core[None])), 1e-9)

    def parts(members, weight):
        left, out = set(members), []
        while left:
            stack, part = [left.pop()], []
            while stack:
                x = stack.pop()
                part.append(x)
                near = [y for y in left if reach[x, y] < weight]
                left.difference_update(near)
                stack += near
            out.append(part)
        return out

    def down(members, birth):
        """(best stability, chosen clusters, own stability) of the cluster born with ``members``."""
        mass, at = 0.0, list(members)
        for weight in sorted({reach[x, y] for x, y in itertools.combinations(members, 2)}, reverse=True):
            split = parts(at, weight)
            if len(split) == 1:
                continue
            big = [p for p in split if len(p) >= least and (len(p) > 1)]
            loose = sum(len(p) for p in split if p not in big)
            if len(big) == 1:
                mass += loose / weight
                at = big[0]
                continue
            mass += len(at) / weight
            below = [down(p, 1 / weight) for p in big]
            best = sum(b[0] for b in below)
            own = mass - birth * len(members)
            return (own, [members]) if own >= best else (best, [c for b in below for c in b[1]])
        raise AssertionError

    if n < least:
        return {}
    mass, at = 0.0, list(range(n))
    for weight in sorted(set(reach[np.triu_indices(n, 1)]), reverse=True):
        split = parts(at, weight)
        big = [p for p in split if len(p) >= least]
        if len(split) == 1 or len(big) == 1:
            at = big[0] if big else at
            continue
        chosen = [c for p in big for c in down(p, 1 / weight)[1]]
        return {ids[x]: min(ids[y] for y in c) for c in chosen for x in c}
    return {}


def cases():
    rng = np.random.default_rng(4)
    blobs = np.concatenate([rng.normal(c, s, size=(m, 2)) for c, s, m in (((0, 0), 0.3, 40), ((5, 0), 0.5, 30), ((5, 2.2), 0.4, 25), ((0, 6), 1.5, 15))] + [rng.uniform(-4, 9, size=(20, 2))])
    grid = rng.integers(0, 12, size=(90, 2)).astype(float)  # ties and copies everywhere
    copies = np.concatenate([np.repeat([[1.0, 1.0]], 40, axis=0), rng.normal(0, 1, size=(40, 2)), np.repeat([[2.5, 2.5]], 6, axis=0)])
    return {"blobs": blobs, "grid": grid, "copies": copies, "few": blobs[:3], "equal": np.repeat([[3.0, 3.0]], 20, axis=0)}


@pytest.mark.parametrize("most", [500_000, 60])
@pytest.mark.parametrize("name", list(cases()))
def test_equals_the_plain_version(spark, name, most):
    if most == 60 and name not in ("blobs", "copies"):
        pytest.skip("levels are tried on two of the cases")
    rows = cases()[name]
    ids = [3 * i + 1 for i in range(len(rows))]
    df = spark.createDataFrame(list(zip(ids, rows.tolist(), strict=True)), "vec long, e array<double>").repartition(3)
    got = {r["vec"]: r["topic"] for r in density_clusters(df, "vec", "e", 5, most=most).collect()}
    assert set(got) == set(ids)
    assert {k: t for k, t in got.items() if t is not None} == plain_clusters(ids, rows, 5)


def test_blocks_find_clusters_that_stand_apart(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 40
    rows = np.concatenate([rng.normal(c, 1, size=(150, 8)) for c in centres])
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows.tolist())], "vec long, e array<double>")
    got = {r["vec"]: r["topic"] for r in density_clusters(df, "vec", "e", 10, block_rows=200).collect()}
    for i in range(6):
        found = [got[x] for x in range(150 * i, 150 * (i + 1)) if got[x] is not None]
        assert len(set(found)) == 1 and len(found) > 100
    assert len({t for t in got.values() if t is not None}) == 6


def test_edges_of_the_input(spark):
    schema = "vec long, e array<double>, id long, v string"
    bad = [(None, [1.0, 1.0]), (1, None), (2, []), (3, [None, 1.0]), (4, [float("nan"), 0.0]), (5, [float("inf"), 0.0]), (6, [1.0])]
    assert density_clusters(spark.createDataFrame([(*r, 0, "") for r in bad[:6]], schema), "vec", "e").count() == 0
    good = [(7, [0.0, i / 10]) for i in range(6)] + [(8, [0.0, 0.1])] * 3
    got = [tuple(r) for r in density_clusters(spark.createDataFrame([(*r, 0, "") for r in bad + good], schema), "vec", "e", 3).collect()]
    assert sorted(r[0] for r in got) == [7] * 6 + [8] * 3


def test_spanning_forest(spark):
    rng = np.random.default_rng(1)
    edges = {(int(a), int(b)): float(rng.integers(1, 6)) for a, b in rng.integers(0, 60, size=(150, 2)) if a < b and (a < 40) == (b < 40)}
    forest, labels = spanning_forest(spark.createDataFrame([(*k, w) for k, w in edges.items()], "a long, b long, w double"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    want = []
    for w, a, b in sorted((w, a, b) for (a, b), w in edges.items()):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.append((a, b, w))
    assert sorted(tuple(r) for r in forest.collect()) == sorted(want)
    parts = {}
    for r in labels.collect():
        parts.setdefault(r["c"], set()).add(find(r["id"]))
    assert all(len(p) == 1 for p in parts.values()) and len(parts) == len({find(x) for x in root})


def test_nearest_holds_few_distances():
    rows = np.random.default_rng(2).normal(size=(1500, 4))
    tracemalloc.start()
    found = nearest(rows, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8e6  # all of them are 18 MB
    apart = ((rows[:, None] - rows[None]) ** 2).sum(-1)
    np.fill_diagonal(apart, np.inf)
    assert (np.sort(found) == np.sort(np.argsort(apart, axis=1)[:, :5])).all()
    assert nearest(rows[:1], 0).shape == (1, 0) and nearest(rows[:200], 199).shape == (200, 199)
