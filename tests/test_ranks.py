"""Exact ranks and draws with replacement."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, ranks


@pytest.mark.parametrize("few", [50_000, 3])
def test_order_statistics_are_exact(spark, monkeypatch, few):
    monkeypatch.setattr(ranks, "FEW", few)
    r = random.Random(few)
    sets = [[], [5.0], [2.0] * 40, [r.gauss(0, 1) for _ in range(501)], [r.choice((0.0, 1.0, 1e-300, 1e300, -1e300)) for _ in range(300)], [2.0**k for k in range(-200, 200)], [math.inf, -math.inf, *[float(k % 17) for k in range(200)]]]
    for values in sets if few > 3 else sets[3:]:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(3)
        s, at = sorted(values), [0, 7, len(values) - 1, len(values)]
        assert ranks.order_statistics(df, F.col("v"), at) == [s[k] if 0 <= k < len(s) else None for k in at]
        got = ranks.quantiles(df, F.col("v"), [0.0, 0.5, 0.9, 1.0])
        if not s:
            assert got == [None] * 4
        elif all(map(math.isfinite, s)) and max(map(abs, s)) < 1e200:
            assert got == pytest.approx(np.quantile(s, [0.0, 0.5, 0.9, 1.0]).tolist(), abs=1e-12)


def test_nan_is_the_largest(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    got = ranks.order_statistics(df, F.col("v"), [0, 1, 2])
    assert got[:2] == [1.0, 3.0] and math.isnan(got[2])


@pytest.mark.parametrize("group", [4096, 5])
def test_multinomial(spark, monkeypatch, group):
    monkeypatch.setattr(blocks, "GROUP", group)
    n, draws = 60, 30_000
    weight = [0.0 if k % 10 == 0 else float(k % 4 + 1) for k in range(n)]
    df = spark.createDataFrame([(k * 3, weight[k]) for k in range(n)], "id long, w double")
    got = {r["id"]: r["n"] for r in blocks.multinomial(df.repartition(3), draws, 11).collect()}
    assert sum(got.values()) == draws and all(weight[i // 3] > 0 for i in got)
    share = draws / sum(weight)
    chi = sum((got.get(3 * k, 0) - w * share) ** 2 / (w * share) for k, w in enumerate(weight) if w)
    free = sum(w > 0 for w in weight) - 1
    assert free - 4 * math.sqrt(2 * free) < chi < free + 5 * math.sqrt(2 * free)
    again = {r["id"]: r["n"] for r in blocks.multinomial(df.orderBy(F.desc("id")).repartition(7), draws, 11).collect()}
    assert again == got
    other = {r["id"]: r["n"] for r in blocks.multinomial(df, draws, 12).collect()}
    assert other != got
    assert blocks.multinomial(df, 0, 1).count() == 0 and blocks.multinomial(df.limit(0), 5, 1).count() == 0


@pytest.mark.parametrize("stretches", [4096, 3])
def test_draws_by_stride(spark, monkeypatch, stretches):
    monkeypatch.setattr(blocks, "STRETCHES", stretches)
    weight = [0, 3, 1, 500, 0, 2, 7]
    df = spark.createDataFrame(list(enumerate(weight)), "id long, w long").repartition(3)
    upto, want = np.cumsum(weight), {}
    for i in range(200):
        k = int(np.searchsorted(upto, i * 7919 % upto[-1], side="right"))
        want[k] = want.get(k, 0) + 1
    assert {r["id"]: r["n"] for r in blocks.weighted_draws(df, 200, 7919).collect()} == want
    assert blocks.weighted_draws(df.where("w = 0"), 5, 1).count() == 0


def test_quantiles_of_groups(spark):
    r = random.Random(9)
    rows = [(k, r.choice(("a", "b", None, "c")), r.choice((None, 1.0, 2.0, r.random()))) for k in range(300)] + [(1000, "alone", 4.0), (1001, "none", None)]
    df = spark.createDataFrame(rows, "id long, g string, v double").repartition(5)
    for share in (0.0, 0.5, 0.9, 1.0):
        got = {x["g"]: x["q"] for x in ranks.grouped_quantile(df, "g", "v", "id", share, "q").collect()}
        held = {}
        for _, g, v in rows:
            if v is not None:
                held.setdefault(g, []).append(v)
        assert set(got) == set(held) and all(got[g] == pytest.approx(float(np.quantile(v, share)), abs=1e-12) for g, v in held.items())
