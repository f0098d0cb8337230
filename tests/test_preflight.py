"""One fault of each kind, fingerprints, projects; and the scalar pieces beside numpy."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import blocks, levels, stateful
from tessera.sources import preflight
from tests.test_relocation import frame, grown

CAMERAS = "camera_id int, model string, width long, height long, params array<double>"
IMAGES = "name string, camera_id int, qvec array<double>, tvec array<double>"
FILES = "name string, width long, height long"


def tables(spark):
    one, nan = [1.0, 0.0, 0.0, 0.0], float("nan")
    cameras = [(1, "PINHOLE", 640, 480, [5.0, 5.0, 1.0, 1.0]), (2, "OPENCV", 640, 480, [5.0]), (3, "PINHOLE", 0, 480, [5.0, 5.0, 1.0, 1.0]), (4, "PINHOLE", 640, 480, [5.0, nan, 1.0, 1.0]), (5, "PINHOLE", 640, 480, [5.0, -1.0, 0.0, 0.0]), (6, "SIMPLE_PINHOLE", 640, 480, [5.0, -1.0]), (7, None, 640, 480, None)]
    images = [("a.png", 1, one, one[:3]), ("b/../c.png", 1, one, one[:3]), ("../d.png", 1, one, one[:3]), ("e.png", 99, one, one[:3]), ("f.png", 1, [nan] * 4, one[:3]), ("g.png", 1, one, one[:3]), ("h.png", 1, one, one[:3]), ("i.png", 1, one, [1.0, None, 0.0]), ("j.png", 6, one, one[:3]), ("x/../../k.png", 1, one, one[:3]), ("/l.png", None, one, one[:3])]
    files = [(n, 1280, 960) for n, *_ in images if n != "g.png"]
    files = [(n, w, 959 if n == "h.png" else h) for n, w, h in files]
    masks = [("a.png", 1280, 960), ("j.png", 1279, 960)]
    return spark.createDataFrame(cameras, CAMERAS), spark.createDataFrame(images, IMAGES), spark.createDataFrame(files, FILES), spark.createDataFrame(masks, FILES)


def test_one_fault_of_each_kind(spark):
    c, i, f, m = tables(spark)
    got = {(r["kind"], r["image"], r["camera"]) for r in preflight.faults(c, i, f, m).collect()}
    want = {("model", None, 2), ("size", None, 3), ("parameter", None, 4), ("focal", None, 5), ("model", None, 7), ("parameter", None, 7)}
    want |= {("path", "../d.png", 1), ("path", "x/../../k.png", 1), ("path", "/l.png", None), ("dangling", "e.png", 99), ("dangling", "/l.png", None), ("pose", "f.png", 1), ("pose", "i.png", 1), ("missing", "g.png", 1), ("aspect", "h.png", 1), ("mask_size", "j.png", 6)}
    assert got == want
    assert ("mask_size", "j.png", 6) not in {tuple(r) for r in preflight.faults(c, i, f).collect()}
    assert {r["kind"] for r in preflight.faults(c.limit(0), i.limit(0), f).collect()} == {"no_cameras", "no_images"}


def test_training_bytes(spark):
    images = spark.createDataFrame([(f"{k}.png",) for k in range(5)], "name string")
    sizes = spark.createDataFrame([(f"{k}.png", 100 + k, 50, k == 2) for k in range(5)], "name string, width long, height long, masked boolean")
    w = [round((100 + k) / 2) for k in range(5)]  # to even at halves, as the sizes are
    r = preflight.training_bytes(images, sizes, 2, 3).first()
    assert r[:] == (5, 3, sum(w[k] * 25 * 16 + 1024 for k in (1, 2, 4)), sum(w[k] * 25 * (16 if k == 2 else 4) + 1024 for k in (1, 2, 4)))
    assert preflight.training_bytes(images, sizes, 2, 0).first()["training"] == 5


def test_fingerprints(spark):
    c, i, _, _ = tables(spark)
    a = preflight.fingerprint(c, i)
    assert a == preflight.fingerprint(c.repartition(3).orderBy(F.desc("camera_id")), i.select(*reversed(i.columns)).repartition(2))
    assert a != preflight.fingerprint(c.union(c.limit(1)), i) and a != preflight.fingerprint(i, c)
    assert a != preflight.fingerprint(c.withColumn("width", F.col("width") + (F.col("camera_id") == 2).cast("int")), i)


def test_settings_and_projects(spark, tmp_path):
    good = {"train": {"steps": 0, "halo": 8, "config": {"options": {"iterations": 10}}}}
    preflight.check_settings(good)
    for bad, match in (({"a": {"x": math.inf}}, "settings.a.x is not finite"), ({"tile_size": 0}, "tile_size is out"), ({"steps": -1}, "steps"), ({"halo": 4}, "halo"), ({"viewer_port": 65536}, "viewer_port"), ({"densify_max_leaf_fraction": 1.5}, "fraction")):
        with pytest.raises(ValueError, match=match):
            preflight.check_settings(bad)
    defaults = {"initial": {"preview": True, "viewer_port": 0}, "train": {"steps": 5}}
    project = {"version": 1, "settings": {"initial": {"viewer_port": 7}, "train": {}}, "steps": {"initial": {"status": "running"}, "train": {"status": "pending"}}}
    path = tmp_path / "p.json"

    def load(**change):
        path.write_text(json.dumps(project | change))
        return preflight.load_project(spark, f"file://{path}", defaults)

    got = load()
    assert got["settings"] == {"initial": {"preview": True, "viewer_port": 7}, "train": {"steps": 5}}
    assert got["steps"]["initial"]["status"] == "interrupted"
    for change, match in (({"version": 2}, "version"), ({"steps": {}}, "no step"), ({"steps": {"initial": {"status": "odd"}, "train": {"status": "pending"}}}, "no known state"), ({"settings": {"initial": {"viewer_port": -1}, "train": {}}}, "viewer_port")):
        with pytest.raises(ValueError, match=match):
            load(**change)


# -- scalar and table operators of this round ------------------------------------


def test_matrices_against_numpy(spark):
    r = np.random.default_rng(1)
    q, t, shift = r.normal(size=4), r.normal(size=3), r.normal(size=3)
    lit = lambda v: [X.num(float(a)) for a in v]
    entries = X.rotation(*[f"({a})" for a in lit(q)])
    scale, near, far, fx, fy, px, py = 1.7, 0.01, 100.0, 0.9, 0.7, 0.4, 0.55
    w, x, y, z = q / np.linalg.norm(q)
    rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    view = np.eye(4)
    view[:3, :3], view[:3, 3] = rot.T, t
    back = np.linalg.inv(view)
    back[:3, 3] = (back[:3, 3] + shift) * scale
    moved = np.linalg.inv(back)
    top, right = math.tan(fy / 2) * near, math.tan(fx / 2) * near
    b, u, le, ri = (1 - py) * 2 * -top, py * 2 * top, (1 - px) * 2 * -right, px * 2 * right
    clip = np.zeros((4, 4))
    clip[0, 0], clip[1, 1], clip[0, 2], clip[1, 2] = 2 * near / (ri - le), 2 * near / (u - b), (ri + le) / (ri - le), (u + b) / (u - b)
    clip[3, 2], clip[2, 2], clip[2, 3] = 1, far / (far - near), -(far * near) / (far - near)
    p = X.projection(*map(X.num, (near, far, fx, fy, px, py)))
    v = X.world_view(entries, lit(t))
    cols = v + X.recentred(entries, lit(t), lit(shift), X.num(scale)) + p + X.product(p, v) + X.transformed(p, tuple(lit((0.3, -0.2, 2.0))))
    got = np.array(spark.range(1).select(*[F.expr(f"double({c})").alias(f"c{k}") for k, c in enumerate(cols)]).first())
    assert np.allclose(got[:16].reshape(4, 4), view) and np.allclose(got[16:32].reshape(4, 4), moved)
    assert np.allclose(got[32:48].reshape(4, 4), clip) and np.allclose(got[48:64].reshape(4, 4), clip @ view)
    h = clip @ [0.3, -0.2, 2.0, 1.0]
    assert np.allclose(got[64:], h[:3] / (h[3] + 1e-7))


def test_harmonics_are_orthonormal(spark):
    """The 25 functions of degrees 0 to 4, summed over a product rule that is exact for them."""
    z, wz = np.polynomial.legendre.leggauss(8)
    phi = 2 * np.pi * np.arange(16) / 16
    s = np.sqrt(1 - z**2)
    pts = [(float(s[i] * np.cos(a)), float(s[i] * np.sin(a)), float(z[i]), float(wz[i] * 2 * np.pi / 16)) for i in range(8) for a in phi]
    df = spark.createDataFrame(pts, "x double, y double, z double, w double").coalesce(1)
    basis = np.array(df.select("w", *[F.expr(f"double({b})").alias(f"b{k}") for k, b in enumerate(X.sh_basis("x", "y", "z", 4))]).collect())
    gram = (basis[:, 1:] * basis[:, :1]).T @ basis[:, 1:]
    assert np.allclose(gram, np.eye(25), atol=1e-9)


def test_random_cut_by_levels(spark):
    import random

    for seed in range(3):
        r = random.Random(seed)
        t = grown(r, 40)
        cut, subset = {i for i in t if not t[i]["kids"]}, [i for i in t if not t[i]["kids"] and t[i]["o"] < 0.7]
        for depth in range(max(n["depth"] for n in t.values()), 0, -1):
            for i in [k for k in subset if t[k]["depth"] == depth]:
                a, b = t[t[i]["parent"]]["kids"]
                if i == a and {a, b} <= cut:
                    cut = (cut - {a, b}) | {t[i]["parent"]}
                    subset.append(t[i]["parent"])
        assert {x["id"] for x in levels.random_cut(frame(spark, t), F.col("o") < 0.7).collect()} == cut


def test_digest_of_bits(spark):
    df = spark.range(100).select("id", (F.col("id") / 7).alias("x"), F.col("id").cast("string").alias("s"))
    a = blocks.bit_digest(df).first()
    b = blocks.bit_digest(df.orderBy(F.desc("id")).repartition(5)).first()
    assert a[:3] == b[:3] and a["n"] == 100
    tiny = df.withColumn("x", F.when(F.col("id") == 50, F.lit(float(np.nextafter(50 / 7, 9)))).otherwise(F.col("x")))
    c = blocks.bit_digest(tiny).first()
    assert c["added"] != a["added"] and c["mixed"] != a["mixed"]
    assert blocks.bit_digest(df.limit(0)).first()[:3] == (0, "0", 0)


def test_schedules_go_on_where_they_stopped(spark):
    views = spark.createDataFrame([(k * 3,) for k in range(7)], "id long")
    rows = lambda *a: [tuple(r) for r in stateful.view_schedule(views, *a).orderBy("step").collect()]
    whole = rows(30, 5)
    assert [s for s, _, _ in whole] == list(range(30))
    for e in range(4):
        assert {v for _, x, v in whole if x == e} == {k * 3 for k in range(7)}
    assert rows(30, 5, 10) == whole[10:] and rows(30, 5, 30) == [] and rows(30, 6) != whole
    with pytest.raises(ValueError):
        stateful.view_schedule(views, 5, 1, 6)
