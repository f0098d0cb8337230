"""Neighbours of clustered, repeated and far-off places, against all distances."""

import numpy as np
import pytest

from tessera.operators import neighbours


def plain(p, ids, k, q=None, own=None):
    q, own = (p, ids) if q is None else (q, own)
    out = {}
    for x, i in zip(q, own, strict=True):
        d = x[None] - p
        d2 = (d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1]) + d[:, 2] * d[:, 2]
        order = np.lexsort((ids, d2))
        out[i] = [(int(ids[j]), float(d2[j])) for j in order if q is not p or ids[j] != i][:k]
    return out


def clustered(r, n):
    p = r.normal(0, 1, (n, 3))
    p[: n // 3] = 5 + r.normal(0, 1e-9, (n // 3, 3))  # a dense cell
    p[n // 3 : n // 2] = p[0]  # one place
    p[-1] = 1e9  # an outlier
    p[-20:-10] = p[-40:-30]  # pairs
    p[:, 2] = np.where(r.random(n) < 0.3, 0.0, p[:, 2])
    return p


def test_search_equals_all_distances():
    r = np.random.default_rng(1)
    p = clustered(r, 900)
    ids = r.permutation(10_000)[:900]
    rows, near, d2 = neighbours.search(p, ids, np.full(900, np.inf), p, ids, 4)
    got = {}
    for a, b, c in zip(rows, near, d2, strict=True):
        got.setdefault(int(ids[a]), []).append((int(b), float(c)))
    assert got == plain(p, ids, 4)


def test_trees_cut_where_places_are():
    r = np.random.default_rng(2)
    p = clustered(r, 3000)
    tree = neighbours.split(p, 50)
    at = tree.cells(p)
    for c in np.flatnonzero(np.bincount(at) > 50):  # only one and the same place fills a cell
        assert len(np.unique(p[at == c], axis=0)) == 1
    q, far = p[::7], np.full(len(p[::7]), 0.3)
    rows, cells = tree.meets(q, far)
    met = set(zip(rows.tolist(), cells.tolist(), strict=True))
    for i, x in enumerate(q):
        assert {(i, c) for c in at[(np.abs(p - x) <= 0.3).all(1)]} <= met


@pytest.mark.parametrize(("cell", "queries"), [(100, 60), (20_000, 50_000)])
def test_clusters_and_outliers(spark, monkeypatch, cell, queries):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "QUERIES", queries)
    r = np.random.default_rng(3)
    p = clustered(r, 1500)
    ids = r.permutation(10_000)[:1500]
    df = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(ids, p, strict=True)], "id long, x double, y double, z double").repartition(4)
    got = {}
    for x in neighbours.nearest(df, 3).orderBy("id", "rank").collect():
        got.setdefault(x["id"], []).append((x["nid"], x["d2"]))
    assert got == plain(p, ids, 3)
    q = np.concatenate([p[:50], r.normal(0, 3, (60, 3))])
    own = np.concatenate([ids[:50], 20_000 + np.arange(60)])
    asked = spark.createDataFrame([(int(i), *map(float, x)) for i, x in zip(own, q, strict=True)], "id long, x double, y double, z double")
    got = {}
    for x in neighbours.nearest(asked, 2, df).orderBy("id", "rank").collect():
        got.setdefault(x["id"], []).append((x["nid"], x["d2"]))
    assert got == plain(p, ids, 2, q, own)
