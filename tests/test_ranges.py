"""Incremental refreshes against full builds."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import levels, ranges
from tests.test_relocation import grown

SCHEMA = "id long, depth int, parent long, child_count int, size double"
OWN = "CASE WHEN child_count = 0 THEN -1e9 ELSE size END"


def rows_of(t):
    return [(i, n["depth"], n["parent"], len(n["kids"]), n["size"]) for i, n in t.items()]


def sized(r, t):
    for i, n in sorted(t.items()):
        n["size"] = 1.0 if n["parent"] < 0 else t[n["parent"]]["size"] * r.choice((0.4, 0.5, 0.7))
    return t


def full(spark, t):
    found = levels.subtree_ranges(spark.createDataFrame(rows_of(t), SCHEMA), 0.1, F.col("size"), F.expr(OWN)).where("root IS NOT NULL")
    return {(x["root"], x["id"], x["depth"], x["min_d"], x["max_d"]) for x in found.collect()}


def change(spark, t, ids, gone=()):
    rows = [(*row, False) for row in rows_of(t) if row[0] in ids] + [(i, 0, 0, 0, 0.0, True) for i in gone]
    return spark.createDataFrame(rows, SCHEMA + ", gone boolean")


@pytest.fixture
def built(spark, tmp_path):
    r = random.Random(4)
    t = sized(r, grown(r, 90))
    store = ranges.RangeStore(spark, f"file://{tmp_path}/store", 0.1, "size", OWN, buckets=64)
    store.build(spark.createDataFrame(rows_of(t), SCHEMA))
    return t, store, {root for root, *_ in full(spark, t)}


def below(t, roots):
    return sorted(i for i in t if any(i == k or is_above(t, k, i) for k in roots))


def is_above(t, a, i):
    while i >= 0:
        i = t[i]["parent"]
        if i == a:
            return True
    return False


def got(store):
    return {tuple(x) for x in store.read().collect()}


def test_build_equals_levels(spark, built):
    t, store, _ = built
    assert got(store) == full(spark, t)


def test_geometry_and_splits_touch_only_their_owners(spark, built):
    t, store, roots = built
    before = dict(store._tables()[0].state)
    leaf = max(below(t, roots), key=lambda i: (not t[i]["kids"], t[i]["depth"]))
    a, b = len(t), len(t) + 1
    t[leaf]["kids"] = [a, b]
    for k in (a, b):
        t[k] = dict(depth=t[leaf]["depth"] + 1, parent=leaf, kids=[], size=t[leaf]["size"] / 2)
    mover = next(i for i in below(t, roots) if t[i]["kids"] and i not in roots)
    t[mover]["size"] *= 0.8
    stats = store.refresh(change(spark, t, {leaf, a, b, mover}))
    assert got(store) == full(spark, t)
    assert 1 <= stats["dirty"] <= 2 and 0 < stats["rows_read"] < 0.8 * stats["rows"]
    after = store._tables()[0].state
    changed = {k for k in before.keys() | after.keys() if before.get(k) != after.get(k)}
    assert len(changed) <= 2  # every other bucket keeps its files
    # the new nodes have owners now
    t[b]["size"] *= 0.5
    assert store.refresh(change(spark, t, {b}))["dirty"] == 1
    assert got(store) == full(spark, t)


def test_nodes_go_and_chains_of_new_ones_come(spark, built):
    t, store, roots = built
    pair = next(i for i in below(t, roots) if t[i]["kids"] and all(not t[k]["kids"] for k in t[i]["kids"]))
    gone = t[pair]["kids"]
    t[pair]["kids"] = []
    for k in gone:
        del t[k]
    store.refresh(change(spark, t, {pair}, gone))
    assert got(store) == full(spark, t)
    top, new = pair, set()
    for step in range(3):
        kids = [1000 + 2 * step, 1001 + 2 * step]
        t[top]["kids"] = kids
        for k in kids:
            t[k] = dict(depth=t[top]["depth"] + 1, parent=top, kids=[], size=t[top]["size"] * 0.5)
        new |= {*kids, top}
        top = kids[1]
    store.refresh(change(spark, t, new))
    assert got(store) == full(spark, t)


def test_a_root_that_grows_falls_apart(spark, built):
    t, store, roots = built
    root = max(roots, key=lambda k: len(below(t, {k})))
    t[root]["size"] = 0.9
    store.refresh(change(spark, t, {root}))
    assert got(store) == full(spark, t)
    # its parts are subtrees of their own from now on, the old root lies above them
    kid = t[root]["kids"][0]
    t[kid]["size"] *= 0.9
    assert store.refresh(change(spark, t, {kid}))["dirty"] == 1
    assert got(store) == full(spark, t)
    with pytest.raises(ValueError, match="build anew"):
        store.refresh(change(spark, t, {root}))
    assert got(store) == full(spark, t)


def test_no_change_and_two_writers(spark, built):
    t, store, _ = built
    assert store.refresh(change(spark, t, set()))["dirty"] == 0
    assert got(store) == full(spark, t)
    with pytest.raises(RuntimeError, match="another writer"):
        store.pointers.commit(store.pointers.last(), "{}")
