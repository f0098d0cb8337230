"""Distances and votes against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import silhouette


def test_envelope_equals_all_parabolas():
    r = np.random.default_rng(2)
    for n in (1, 2, 7, 60):
        for _ in range(50):
            g = np.where(r.random(n) < 0.4, np.inf, r.integers(0, 50, n) ** 2).astype(float)
            i = np.arange(n)
            want = (((i[:, None] - i[None]) ** 2) + g[None]).min(1)
            assert (silhouette.envelope(g) == want).all()


@pytest.fixture(scope="module")
def masks():
    r = random.Random(3)
    shape = {0: (9, 14, 0.1), 1: (30, 5, 0.03), 2: (6, 6, 0.0), 3: (1, 1, 1.0), 4: (5, 20, 1.0)}
    return {(k, u, v): r.random() < p for k, (w, h, p) in shape.items() for u in range(w) for v in range(h) if not (k == 0 and u == 4)}


def test_distances(spark, masks):
    df = spark.createDataFrame([(*k, x) for k, x in masks.items()], "view int, u int, v long, inside boolean").repartition(4)
    got = {(r["view"], r["u"], r["v"]): r["d2"] for r in silhouette.distances(df).collect()}
    want = {(k, u, v): min(((u - a) ** 2 + (v - b) ** 2 for (j, a, b), x in masks.items() if j == k and x), default=math.inf) for k, u, v in masks}
    assert got == want
    assert silhouette.distances(df.limit(0)).count() == 0


def test_vote(spark, masks):
    r = random.Random(5)
    views = [(k, *(1.0, 0.0, 0.0, 0.0, 0.8, -0.6, 0.0, 0.6, 0.8), 0.1 * k, 0.0, 3.0, 8.0, 7.0, w / 2, h / 2, float(w), float(h)) for k, (w, h) in {0: (9, 14), 1: (30, 5), 2: (6, 6)}.items()]
    names = "view int, " + ", ".join(f"{c} double" for c in [f"r{k}" for k in range(9)] + ["t0", "t1", "t2", "fx", "fy", "px", "py", "w", "h"])
    pts = [(k, r.uniform(-2, 2), r.uniform(-2, 2), r.uniform(-4, 2), r.choice((0.0, 0.05, 0.4))) for k in range(300)]
    p, v = spark.createDataFrame(pts, "id long, x double, y double, z double, size double"), spark.createDataFrame(views, names)
    m = spark.createDataFrame([(*k, x) for k, x in masks.items()], "view int, u int, v int, inside boolean")
    want = {}
    for i, x, y, z, size in pts:
        seen = out = 0
        for k, *q in views:
            a, b, c = (q[3 * n] * x + q[3 * n + 1] * y + q[3 * n + 2] * z + q[9 + n] for n in range(3))
            fx, fy, px, py, w, h = q[12:]
            if c <= size + 1e-6:
                continue
            s, t = a / c * fx + px, b / c * fy + py
            if not (0 <= s < w and 0 <= t < h):
                continue
            seen += 1
            at = (k, int(s), int(t))
            d = min((math.dist(at[1:], o[1:]) for o, inside in masks.items() if o[0] == k and inside), default=math.inf) if at in masks else 0.0
            out += d > max(fx, fy) * size / (c - size) * (1 + max(abs((s - px) / fx), abs((t - py) / fy))) + 0.5
        want[i] = (seen, out, not (out >= 2 and out >= 0.6 * max(seen, 1)))
    for most in (silhouette.VIEWS, 1):
        silhouette.VIEWS, old = most, silhouette.VIEWS
        try:
            got = {x["id"]: (x["observed"], x["outside"], x["keep"]) for x in silhouette.mask_vote(p, v, m, F.col("size"), 0.5, 2, 0.6).collect()}
        finally:
            silhouette.VIEWS = old
        assert got == want
    assert {k for _, _, k in want.values()} == {True, False}


@pytest.mark.parametrize(("w", "h", "most"), [(10, 7, 20), (10, 7, 10), (17, 5, 8), (5, 33, 4), (1, 40, 3), (64, 64, 1)])
def test_shrunk_takes_the_pixel_below_each_centre(spark, w, h, most):
    df = spark.createDataFrame([(1, u, v, u * 100 + v) for u in range(w) for v in range(h)], "view int, u int, v int, value int")
    got = {(r["u"], r["v"]): r["value"] for r in silhouette.shrunk(df, most).collect()}
    long = max(w, h)
    nw, nh = (w, h) if long <= most else (max(1, int((w * most + long / 2) // long)), max(1, int((h * most + long / 2) // long)))
    assert got == {(a, b): (2 * a + 1) * w // (2 * nw) * 100 + (2 * b + 1) * h // (2 * nh) for a in range(nw) for b in range(nh)}
