"""The full build against recursion over single points."""

import random

import numpy as np
import pytest

from tessera.operators import hierarchy


def plain(points, code=1):
    """code: (ids, height) by recursion."""
    if len(points) == 1:
        return {code: ([points[0][0]], 0)}
    at = np.array([p[2:5] for p in points])
    axis = int(np.argmax(at.max(0) - at.min(0)))
    points = sorted(points, key=lambda p: (p[2 + axis], p[0]))
    half = len(points) // 2
    out = plain(points[:half], 2 * code) | plain(points[half:], 2 * code + 1)
    out[code] = (out[2 * code][0] + out[2 * code + 1][0], max(out[2 * code][1], out[2 * code + 1][1]) + 1)
    return out


@pytest.fixture(scope="module")
def points():
    r = random.Random(8)
    place = lambda k: (0.5, 0.5, 0.5) if k % 9 == 0 else (r.random(), r.random(), 3 * r.random())
    return [(k, 0.1 + r.random(), *place(k), 0.02 + r.random() / 50, 0.001, 0.0, 0.03, 0.002, 0.01) for k in range(45)]


SCHEMA = "id long, " + ", ".join(f"{c} double" for c in hierarchy.POINT)


@pytest.mark.parametrize("leaf_rows", [6, 1000])
def test_build_equals_recursion(spark, points, leaf_rows):
    df = spark.createDataFrame(points, SCHEMA).repartition(3)
    merged = hierarchy.moments(hierarchy.merged(df, leaf_rows))
    aligned = hierarchy.align(hierarchy.shapes(merged)).collect()
    want = plain(points)
    got = {r["code"]: r for r in aligned}
    assert len(aligned) == len(got) == 2 * len(points) - 1 and set(got) == set(want)
    by_id = {p[0]: np.array(p[1:]) for p in points}
    rotation = {}
    for code in sorted(got):
        r, (ids, height) = got[code], want[code]
        w = np.array([by_id[i][0] for i in ids])
        at = np.array([by_id[i][1:4] for i in ids])
        cov = np.zeros((3, 3))
        mean = w @ at / w.sum()
        for i, x in zip(ids, at, strict=True):
            own = np.zeros((3, 3))
            own[np.triu_indices(3)] = by_id[i][4:]
            own = own + own.T - np.diag(np.diag(own))
            cov += by_id[i][0] / w.sum() * (own + np.outer(x - mean, x - mean))
        assert (r["n"], r["height"], r["point"]) == (len(ids), height, ids[0] if len(ids) == 1 else -1)
        assert np.allclose([r["x"], r["y"], r["z"]], mean)
        m = np.array([r[c] for c in hierarchy.ROTATION]).reshape(3, 3)
        s = np.array([r[c] for c in hierarchy.SCALES])
        assert np.allclose(m @ np.diag(s**2) @ m.T, cov, atol=1e-9) and np.isclose(np.linalg.det(m), 1)
        assert np.isclose(r["opacity"] * (s[0] * s[1] + s[0] * s[2] + s[1] * s[2]), w.sum())
        rotation[code] = m
        if code > 1:
            up = rotation[code >> 1]
            assert (m * up).sum() >= max(((m @ t) * up).sum() for t in hierarchy.TURNS) - 1e-6


def test_small_inputs(spark, points):
    one = spark.createDataFrame(points[:1], SCHEMA)
    assert [(r["code"], r["n"], r["point"]) for r in hierarchy.merged(one).collect()] == [(1, 1, 0)]
    none = hierarchy.merged(one.limit(0))
    assert hierarchy.align(hierarchy.shapes(hierarchy.moments(none))).count() == 0
    twice = spark.createDataFrame([points[0]] * 5, SCHEMA)
    assert hierarchy.merged(twice, 2).where("n = 1").count() == 5
    assert len(hierarchy.TURNS) == 24


def test_spheres_widen_the_boxes_that_are_split(spark):
    """Places alone are widest in x; with the spheres the box is widest in y."""
    rows = [(0, 1.0, 0.0, 0.0, 0.0, 0.1), (1, 1.0, 3.0, 1.0, 0.0, 0.1), (2, 1.0, 1.5, 2.0, 0.0, 2.0), (3, 1.0, 2.0, 0.5, 0.0, 0.1)]
    df = spark.createDataFrame([(*r[:5], *[0.0] * 6, r[5], 2.0 * r[0]) for r in rows], SCHEMA + ", r double, d double")
    for radius, left in (("r", {0, 3}), (None, {0, 2})):
        for leaf_rows in (1, 1000):
            nodes = hierarchy.merged(df, leaf_rows, radius, ("d",))
            assert {r["point"] for r in nodes.where("point >= 0").collect() if r["code"] >> 1 == 2} == left
    root = hierarchy.merged(df, 2, "r", ("d",)).where("code = 1").first()
    assert (root["d"], root["lo_x"], root["hi_x"], root["lo_y"], root["hi_y"]) == (3.0, -0.5, 3.5, -0.1, 4.0)


@pytest.mark.parametrize("leaf_rows", [1, 1000])
def test_covariances_do_not_cancel_far_from_the_origin(spark, leaf_rows):
    far = np.array([1e6, 2e6, 3e6])
    rows = [(k, 1.0, *map(float, far + s * np.array([0.01, 0.0, 0.0])), 1e-4, 0.0, 0.0, 1e-4, 0.0, 2e-4) for k, s in enumerate((-1, 1))]
    root = hierarchy.moments(hierarchy.merged(spark.createDataFrame(rows, SCHEMA), leaf_rows)).where("code = 1").first()
    assert np.allclose([root[c] for c in hierarchy.COVARIANCE], [2e-4, 0, 0, 1e-4, 0, 2e-4], rtol=1e-6, atol=1e-12)


def test_built_files_hold_the_tree(spark, points, tmp_path):
    from tessera.sources import hierarchies

    df = spark.createDataFrame([(*p, float(p[0])) for p in points], SCHEMA + ", d double")
    built = hierarchy.align(hierarchy.shapes(hierarchy.moments(hierarchy.merged(df, 10, also=("d",)))))
    rows = {r["code"]: r for r in hierarchy.quaternions(built).collect()}
    for r in rows.values():
        w, x, y, z = (r["q" + c] for c in "wxyz")
        m = np.array([r[c] for c in hierarchy.ROTATION]).reshape(3, 3)
        again = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
        assert w >= 0 and np.allclose(m, again, atol=1e-7)
    path = f"file://{tmp_path}/b.hier"
    assert hierarchies.write_static(*hierarchy.static_tables(built, ["d"]), path) == (89, 89)
    at = {r["id"]: r for r in hierarchies.read_static_points(spark, path).collect()}
    nodes = {r["id"]: r for r in hierarchies.read_static_nodes(spark, path).collect()}
    seen = []

    def walk(k, code):
        n, want = nodes[k], rows[code]
        seen.append(n["start"])
        p = at[n["start"]]
        assert np.allclose(p["xyz"], [want[a] for a in hierarchy.AXES], atol=1e-5) and np.isclose(p["sh"][0], want["d"], rtol=1e-5)
        assert np.allclose(np.exp(p["scale"]), [want[s] for s in hierarchy.SCALES], rtol=1e-4)
        assert (n["depth"], n["count_leafs"], n["count_merged"], n["count_children"]) == (want["height"], int(want["n"] == 1), int(want["n"] > 1), 2 * (want["n"] > 1))
        for side in range(n["count_children"]):
            assert nodes[n["start_children"] + side]["parent"] == k
            walk(n["start_children"] + side, 2 * code + side)

    walk(0, 1)
    assert seen == list(range(89))
