"""Quantiles against closed forms and sums, consensus against all pairs."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.functions import probability
from tessella.operators import consensus


def test_beta_quantiles(spark):
    rows = [(p, a, 1.0, p ** (1 / a)) for p in (0.0, 1e-9, 0.025, 0.5, 0.999, 1.0) for a in (0.3, 1.0, 7.0, 400.0)]
    rows += [(p, 1.0, b, -math.expm1(math.log1p(-p) / b)) for p in (0.025, 0.5, 0.975) for b in (0.3, 2.0, 90.0)]
    rows += [(0.5, s, s, 0.5) for s in (0.2, 1.0, 3.0, 5000.0)] + [(math.sin(x) ** 2, 0.5, 0.5, None) for x in ()]
    got = spark.createDataFrame(rows, "p double, a double, b double, x double").select("x", probability.beta_quantile("p", "a", "b").alias("q")).collect()
    assert all(r.q == pytest.approx(r.x, abs=1e-12) for r in got)
    # arcsine law, and the distribution summed up over a fine grid
    q = spark.range(1).select(*[probability.beta_quantile(F.lit(p), F.lit(a), F.lit(b)).alias(f"q{i}") for i, (p, a, b) in enumerate([(0.1, 0.5, 0.5), (0.2, 2.5, 6.0), (0.9, 30.0, 12.0)])]).first()
    assert q.q0 == pytest.approx(math.sin(0.1 * math.pi / 2) ** 2, abs=1e-12)
    for x, p, a, b in ((q.q1, 0.2, 2.5, 6.0), (q.q2, 0.9, 30.0, 12.0)):
        grid = (np.arange(400000) + 0.5) / 400000
        mass = grid ** (a - 1) * (1 - grid) ** (b - 1)
        assert mass[grid < x].sum() / mass.sum() == pytest.approx(p, abs=1e-5)
    bad = [(None, 1.0, 1.0), (0.5, None, 1.0), (0.5, 0.0, 1.0), (0.5, 1.0, -1.0), (1.5, 1.0, 1.0), (0.5, float("inf"), 1.0), (0.5, float("nan"), 1.0)]
    assert all(r.q is None for r in spark.createDataFrame(bad, "p double, a double, b double").select(probability.beta_quantile("p", "a", "b").alias("q")).collect())


def test_intervals_leave_equal_tails(spark):
    rows = [("uniform", 0.0, 10.0, None, None), ("normal", 5.0, 2.0, None, None), ("triangular", 0.0, 10.0, 10.0, None), ("beta", 10.0, 20.0, 2.0, 1.0), ("other", 1.0, 2.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "k string, a double, b double, c double, d double")
    got = {r.k: (r.i.low, r.i.high) for r in df.select("k", probability.interval(*[F.col(c) for c in "kabcd"], level=0.8).alias("i")).collect()}
    root = math.sqrt
    want = {"uniform": (1, 9), "normal": (5 - 2 * 1.2815515655, 5 + 2 * 1.2815515655), "triangular": (10 * root(0.1), 10 * root(0.9)), "beta": (10 + 10 * root(0.1), 10 + 10 * root(0.9))}
    assert got.pop("other") == (None, None)
    assert {k: v == pytest.approx(want[k]) for k, v in got.items()} == dict.fromkeys(want, True)


def by_pairs(ranges):
    total = 0.0
    for (a, b), (c, d) in itertools.combinations(ranges, 2):
        if min(b, d) > max(a, c):
            total += (min(b, d) - max(a, c)) / (max(b, d) - min(a, c))
    return total / math.comb(len(ranges), 2) if len(ranges) > 1 else 1.0


@pytest.mark.parametrize("chunk", [4, 1024])
def test_consensus_by_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(consensus, "CHUNK", chunk)
    rng = random.Random(9)
    make = lambda n: [(float(a), float(a + rng.choice((0, 1, 3, 30)))) for a in (rng.randrange(60) for _ in range(n))]
    groups = {"hot": make(300), "pair": make(2), "one": make(1), "points": [(1.0, 1.0)] * 3, None: make(20), "same": [(0.0, 2.0)] * 5}
    rows = [(k, lo, hi) for k, v in groups.items() for lo, hi in v] + [("hot", None, 1.0), ("hot", 3.0, 1.0), ("hot", float("nan"), 1.0), ("gone", 1.0, None)]
    df = spark.createDataFrame(rows, "g string, low double, high double").withColumn("n", F.lit("extra")).withColumn("cell", F.lit(1))
    got = {r.g: (r.n, r.consensus) for r in consensus.interval_consensus(df, "g", "low", "high").collect()}
    assert got == {k: (len(v), pytest.approx(by_pairs(v))) for k, v in groups.items()}


def test_consensus_of_nothing(spark):
    assert consensus.interval_consensus(spark.createDataFrame([], "g string, low double, high double"), "g", "low", "high").count() == 0
