"""Level sweeps, layouts, contraction and budgets against plain recursion."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import levels, tree
from tests.test_relocation import frame, grown


@pytest.fixture(scope="module")
def trees(spark):
    out = []
    for seed, splits in enumerate((0, 1, 7, 30, 60)):
        r = random.Random(seed)
        t = grown(r, splits)
        for i, n in sorted(t.items()):
            n["size"] = 1.0 if n["parent"] < 0 else t[n["parent"]]["size"] * r.choice((0.3, 0.5, 0.9))
            n["w"] = r.random()
        sizes = spark.createDataFrame([(i, n["size"], n["w"]) for i, n in t.items()], "id long, size double, w double")
        out.append((t, frame(spark, t).join(sizes, "id")))
    return out


def test_layouts(spark, trees):
    for t, df in trees:
        pre, place, first, count = {}, {0: 0}, {}, [1]

        def walk(i):
            pre[i] = len(pre)
            first[i] = count[0] if t[i]["kids"] else -1
            for k in t[i]["kids"]:
                place[k] = count[0]
                count[0] += 1
            for k in t[i]["kids"]:
                walk(k)

        walk(0)
        size = lambda i: 1 + sum(map(size, t[i]["kids"]))
        got = {r["id"]: r for r in levels.linearise(df).collect()}
        for i in t:
            r = got[i]
            later = [k for k in t[t[i]["parent"]]["kids"] if k > i] if i else []
            assert (r["preorder"], r["subtree"], r["place"], r["first_child"]) == (pre[i], size(i), place[i], first[i])
            assert r["next_sibling"] == (pre[min(later)] if later else 0)
    assert levels.linearise(trees[0][1].limit(0)).count() == 0


def test_forests_and_wide_nodes(spark):
    rows = [(0, -1, 0), (1, -1, 0)] + [(2 + k, k % 2, 1) for k in range(9)] + [(20, 5, 2)]
    got = {r["id"]: r["preorder"] for r in levels.linearise(spark.createDataFrame(rows, "id long, parent long, depth int")).collect()}
    first = [r["preorder"] for r in levels.linearise(spark.createDataFrame(rows[1:2] + rows[3:], "id long, parent long, depth int").where("parent <> 0")).collect()]
    assert sorted(first) == list(range(len(first)))
    assert got[0] == 0 and sorted(got[i] for i in (2, 4, 6, 8, 10)) == [1, 2, 3, 4, 5]


def plain_bottom(t, seen):
    """Lowest seen nodes; None if the cut is incomplete."""
    out, whole = set(), [True]

    def walk(i):
        below = [walk(k) for k in t[i]["kids"]]
        if below and any(below) and not all(below):
            whole[0] = False
        if below and all(below):
            return True
        if seen(i):
            out.add(i)
            return True
        return False

    walk(0)
    return out if whole[0] else None


def plain_collapse(t, bottom, marked):
    t = {i: dict(n, kids=list(n["kids"])) for i, n in t.items()}
    for b in bottom:
        if t[b]["kids"] and b not in marked:
            found = []

            def walk(i):
                if i in marked or not t[i]["kids"]:
                    found.append(i)
                else:
                    for k in t.pop(i)["kids"]:
                        walk(k)

            for k in t[b]["kids"]:
                walk(k)
            t[b]["kids"] = found
            for k in found:
                t[k]["parent"] = b
    return t


def shape(t):
    out, todo = {}, [(0, 0)]
    while todo:
        i, d = todo.pop()
        out[i] = (t[i]["parent"], d, len(t[i]["kids"]))
        todo += [(k, d + 1) for k in t[i]["kids"]]
    return out


def sized(t, limit):
    up = lambda i: math.inf if t[i]["parent"] < 0 else t[t[i]["parent"]]["size"]
    return lambda i: (t[i]["size"] < limit <= up(i)) or (not t[i]["kids"] and t[i]["size"] >= limit)


def test_bottom(spark, trees):
    for t, df in trees:
        joined = tree.with_parent(df, ["size"])
        for limit in (0.05, 0.4):
            cond = F.expr(f"(size < {limit}D AND (p_size IS NULL OR p_size >= {limit}D)) OR (child_count = 0 AND size >= {limit}D)")
            assert {r["id"] for r in levels.bottom(joined, cond).where("bottom").collect()} == plain_bottom(t, sized(t, limit))
    t, df = trees[3]
    torn = max(t, key=lambda i: t[i]["depth"])
    with pytest.raises(ValueError, match="incomplete"):
        levels.bottom(df, F.col("id") == torn)


def test_near_and_below(spark, trees):
    t, df = trees[4]
    marked = {i for i in t if i % 7 == 3}

    def near(i):
        while i >= 0 and i not in marked:
            i = t[i]["parent"]
        return i if i >= 0 else None

    got = {r["id"]: r["near"] for r in levels.nearest(df, F.col("id") % 7 == 3).collect()}
    assert got == {i: near(i) for i in t}
    assert {r["id"] for r in levels.below(df, F.col("id") % 7 == 3).collect()} == {i for i in t if near(i) is not None}
    assert {r["near"] for r in levels.nearest(df, F.lit(False)).collect()} == {None}


def test_contraction_and_growing_limits(spark, trees):
    seen = lambda limit: F.expr(f"(size < {limit!r}D AND (p_size IS NULL OR p_size >= {limit!r}D)) OR (child_count = 0 AND size >= {limit!r}D)")
    for t, df in trees[2:4]:
        now, marked, limit = t, set(), 0.03
        while limit <= 1:
            low = plain_bottom(now, sized(now, limit))
            now = plain_collapse(now, low, marked)
            marked |= low
            limit *= 3
        got = {r["id"]: ((r["parent"], r["depth"], r["child_count"]), r["marked"]) for r in levels.thinned(df.drop("dead", "o"), 0.03, 3.0, seen).collect()}
        assert got == {i: (x, i in marked) for i, x in shape(now).items()}
    with pytest.raises(ValueError, match="grow"):
        levels.thinned(trees[0][1], 0.1, 1.0, seen)


def plain_cut(t, m, hidden=()):
    out, todo = [], [0]
    while todo:
        i = todo.pop()
        if i in hidden:
            continue
        if t[i]["kids"] and m < t[i]["w"]:
            todo += t[i]["kids"]
        else:
            out.append(i)
    return out


def test_curve_and_budget_equal_a_loop_of_counts(spark, trees):
    for t, df in trees[3:]:
        hidden = {i for i in t if i % 11 == 5}
        spans = levels.intervals(df, F.col("id") % 11 != 5, F.col("w"))
        curve = levels.curve(spans).cache()
        grid = sorted({n["w"] for n in t.values()})
        points = [0.0, *grid, *[(a + b) / 2 for a, b in zip(grid, grid[1:], strict=False)], 2.0]
        assert levels.sizes_at(curve, points) == [len(plain_cut(t, m, hidden)) for m in points]
        for budget in (0, 2, len(t) // 5):
            m, n = 0.01, len(plain_cut(t, 0.01, hidden))
            if budget > 0 and n > budget:
                low = high = m
                for _ in range(20):
                    high *= 2
                    n = len(plain_cut(t, high, hidden))
                    if n <= budget:
                        break
                    low = high
                for _ in range(4):
                    mid = (low + high) / 2
                    if len(plain_cut(t, mid, hidden)) <= budget:
                        high, n = mid, len(plain_cut(t, mid, hidden))
                    else:
                        low = mid
                m = high
            assert levels.within_budget(curve, 0.01, budget) == (m, n)
        curve.unpersist()


def test_no_cut_fits(spark, trees):
    t, df = trees[3]
    curve = levels.curve(levels.intervals(df, F.lit(True), F.lit(1e30)))
    with pytest.raises(RuntimeError, match="coarsest"):
        levels.within_budget(curve, 1e-3, 2)


def test_entries_of_subtrees(spark):
    cut = spark.createDataFrame([(1, 0.5, 4.0), (2, float("-inf"), float("inf"))], "id long, lo double, hi double")
    ranges = spark.createDataFrame([(1, 10, -1e9, 2.0), (1, 11, 2.0, 6.0), (1, 12, 6.0, 1e12), (2, 20, -1.0, 1.0), (2, 21, 1.0, 5.0)], "root long, id long, min_d double, max_d double")
    distance = spark.createDataFrame([(1, 2.0), (2, 0.0)], "root long, d double")
    curve = levels.curve(levels.entries(cut, ranges, distance)).cache()
    plain = lambda m: sum((lo <= m < hi) and a < d * m < b for i, lo, hi in [(1, 0.5, 4.0), (2, -math.inf, math.inf)] for r, d in [(1, 2.0), (2, 0.0)] for q, a, b in [(1, -1e9, 2.0), (1, 2.0, 6.0), (1, 6.0, 1e12), (2, -1.0, 1.0), (2, 1.0, 5.0)] if i == r == q)
    points = [0.4, 0.5, 0.9, 1.0, 1.1, 2.9, 3.0, 3.1, 3.999, 4.0, 9.0]
    assert levels.sizes_at(curve, points) == [plain(m) for m in points]
