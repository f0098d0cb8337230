import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.sources import ply, records, reconstruction as rec
from tessera.sources.block_store import BlockStore


@pytest.fixture
def model(spark):
    cams = spark.createDataFrame([(1, "PINHOLE", 12, 8, [10.0, 11.0, 4.0, 5.0]), (2, "SIMPLE_RADIAL", 6, 4, [1.0, 2.0, 3.0, 4.0])], rec.CAMERAS)
    images = spark.createDataFrame([(3, [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 1, "b.png", [(1.5, 2.5, 7), (0.0, 1.0, -1)]), (4, [0.5, 0.5, 0.5, 0.5], [0.0, 0.0, 0.0], 2, "a.png", [])], rec.IMAGES)
    points = spark.createDataFrame([(7, [1.0, 2.0, 3.0], [255, 0, 9], 0.5, [(3, 0), (4, 1)]), (8, [0.0, 0.0, 1.0], [1, 2, 3], 0.25, [])], rec.POINTS)
    return {"cameras": cams, "images": images, "points3D": points}


READ = {"cameras": (rec.read_cameras, rec.read_cameras_text), "images": (rec.read_images, rec.read_images_text), "points3D": (rec.read_points, rec.read_points_text)}


def canon(df):
    return sorted(r.asDict(recursive=True).__repr__() for r in df.collect())


@pytest.mark.parametrize("kind", list(READ))
def test_models_round_trip(spark, model, tmp_path, kind):
    df = model[kind]
    (tmp_path / f"{kind}.bin").write_bytes(rec.packed(kind, df.collect()))
    assert canon(READ[kind][0](spark, f"file://{tmp_path}/{kind}.bin")) == canon(df)
    rec.write_text(kind, df, f"file://{tmp_path}/text")
    assert canon(READ[kind][1](spark, f"file://{tmp_path}/text")) == canon(df)


def test_text_with_comments_and_blank_lines(spark, tmp_path):
    (tmp_path / "images.txt").write_text("# a comment\n0 1 0 0 0 0 0 0 0 0.png\n\n1 1 0 0 0 1 0 0 0 1.png\n1 2 3 4 5 6\n")
    got = {r["name"]: len(r["points2d"]) for r in rec.read_images_text(spark, f"file://{tmp_path}/images.txt").collect()}
    assert got == {"0.png": 0, "1.png": 2}
    (tmp_path / "points3D.txt").write_text("0 0 0 1 255 255 255\n")
    assert rec.read_points_text(spark, f"file://{tmp_path}/points3D.txt").first()["track"] == []
    (tmp_path / "cameras.txt").write_text("0 FOV 12 8 1 2 3 4 5\n")
    with pytest.raises(Exception, match="unsupported camera model FOV"):
        rec.read_cameras_text(spark, f"file://{tmp_path}/cameras.txt", only="PINHOLE").collect()
    assert rec.detect_format(spark, f"file://{tmp_path}") == ".txt"
    assert len(rec.read_model(spark, f"file://{tmp_path}")) == 3
    assert rec.detect_format(spark, f"file://{tmp_path}/none") is None


def test_image_without_a_camera_is_an_error(spark, model):
    assert rec.join_cameras(model["images"], model["cameras"]).count() == 2
    with pytest.raises(Exception, match="no camera 2"):
        rec.join_cameras(model["images"], model["cameras"].where("camera_id = 1")).select("model").collect()


def test_truncated_file_is_an_error(spark, model, tmp_path):
    raw = rec.packed("points3D", model["points3D"].collect())
    (tmp_path / "p.bin").write_bytes(raw[:-3])
    with pytest.raises(Exception):
        rec.read_points(spark, f"file://{tmp_path}/p.bin").collect()


def test_dense_array(spark, tmp_path):
    a = np.arange(24, dtype="<f4").reshape(2, 3, 4)  # rows, columns, channels
    (tmp_path / "d.bin").write_bytes(b"3&2&4&" + a.transpose(1, 0, 2).tobytes(order="F"))
    r = rec.read_dense(spark, f"file://{tmp_path}/d.bin").first()
    assert (r["width"], r["height"], r["channels"], r["data"]) == (3, 2, 4, a.ravel().tolist())


def test_cloud_defaults(spark, tmp_path):
    body = np.array([(1, 2, 3), (4, 5, 6)], "<f4").tobytes()
    (tmp_path / "c.ply").write_bytes(ply.file_header([(c, "float") for c in "xyz"], 2) + body)
    r = ply.read_cloud(spark, f"file://{tmp_path}/c.ply").orderBy("id").collect()
    assert (r[1]["x"], r[1]["r"], r[1]["nx"]) == (4.0, 0.5, 0.0)


@pytest.mark.parametrize("degree", [0, 1, 2, 3])
def test_splats_round_trip(spark, tmp_path, degree):
    n = 3 * (degree + 1) ** 2 - 3
    rows = [(k, [3.0 * k, 1.0, 2.0], [-2.0, -1.0, 0.0], [1.0, 0.0, 0.0, 0.0], [0.125] * 3, 0.1 * k, [float(j) for j in range(n)]) for k in range(7)]
    df = spark.createDataFrame(rows, ply.SPLATS).repartition(3)
    path = tmp_path / "s.ply"
    assert ply.write_splats(df, str(path), degree) == 7
    raw = path.read_bytes()
    assert len(raw) == raw.index(b"end_header\n") + 11 + 7 * 4 * len(ply.splat_properties(degree))
    assert canon(ply.read_splats(spark, f"file://{path}", degree)) == canon(df)
    assert ply.read_splats(spark, f"file://{path}", degree, skip=2).count() == 5
    with pytest.raises(Exception):
        ply.read_splats(spark, f"file://{path}", (degree + 1) % 4).collect()


def test_clouds_round_trip_in_many_parts(spark, tmp_path, monkeypatch):
    """Rows are split by byte ranges, in records that don't align with anything."""
    monkeypatch.setattr(records, "PART_BYTES", 27 * 101)
    monkeypatch.setattr(records, "BATCH_BYTES", 27 * 10)
    df = spark.range(1000).select("id", *[(F.col("id") * k).cast("float").cast("double").alias(c) for k, c in enumerate("xyz")], *[((F.col("id") * k) % 256 / 255).alias(c) for k, c in enumerate("rgb")])
    path = f"file://{tmp_path}/new/c.ply"
    assert ply.write_cloud(df.repartition(5), path) == 1000
    back = ply.read_cloud(spark, path)
    assert back.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, back.drop("nx", "ny", "nz").collect())) == sorted(map(tuple, df.collect()))
    raw = (tmp_path / "new" / "c.ply").read_bytes()
    assert len(raw) == raw.index(b"end_header\n") + 11 + 27 * 1000
    assert ply.read_ply(spark, path, skip=990).count() == 10
    assert ply.write_cloud(df.limit(0), path) == 0 and ply.read_cloud(spark, path).count() == 0
    (tmp_path / "short.ply").write_bytes(raw[:-1])
    with pytest.raises(Exception, match="last record"):
        ply.read_cloud(spark, f"file://{tmp_path}/short.ply").collect()


def test_arrays_of_wrong_length_leave_no_file(spark, tmp_path):
    rows = [(k, [0.0] * 3, [0.0] * 4, [0.0] * 3, 0.5, [0.0] * (12 - k), 0, 0, 0, 0, 0, 0) for k in range(2)]
    with pytest.raises(Exception, match="sh has not 12"):
        ply.write_hierarchy(spark.createDataFrame(rows, ply.NODES), f"file://{tmp_path}/h", 1)
    with pytest.raises(Exception):
        ply.write_hierarchy(spark.createDataFrame(rows, ply.NODES), "hdfs://nowhere/h", 1)
    assert not list(tmp_path.iterdir())


def test_bad_rows_leave_no_file(spark, tmp_path):
    df = spark.createDataFrame([(0, [float("nan"), 0.0, 0.0], [0.0] * 3, [1.0, 0.0, 0.0, 0.0], [0.0] * 3, 0.0, [])], ply.SPLATS)
    with pytest.raises(Exception, match="not finite"):
        ply.write_splats(df, str(tmp_path / "x.ply"), 0)
    assert not list(tmp_path.iterdir())


def test_activated(spark):
    df = spark.createDataFrame([(0, [0.0] * 3, [0.0] * 3, [0.0, 3.0, 0.0, 4.0], [0.0] * 3, 0.0, [])], ply.SPLATS)
    r = ply.activated(df).first()
    assert r["opacity"] == 0.5 and r["scale"] == [1.0] * 3 and r["rotation"] == pytest.approx([0, 0.6, 0, 0.8])


def test_hierarchy_round_trip(spark, tmp_path):
    rows = [(k, [float(k)] * 3, [1.0, 0.0, 0.0, 0.0], [0.5] * 3, 0.25, [0.5] * 12, 0 if k == 0 else 1, -1 if k == 0 else 0, 2 if k == 0 else 0, 1 if k == 0 else 0, 2 if k == 1 else 0, 0) for k in range(3)]
    df = spark.createDataFrame(rows, ply.NODES)
    assert ply.write_hierarchy(df, f"file://{tmp_path}/h.dhier", 1) == 3
    raw = (tmp_path / "h.dhier").read_bytes()
    assert len(raw) == 8 + 3 * 4 * 23 + 4 + 3 * 24 and struct.unpack("<ii", raw[:8]) == (3, 1)
    back = ply.read_hierarchy(spark, f"file://{tmp_path}/h.dhier")
    assert canon(back) == canon(df)
    both = ply.with_background(back, spark.createDataFrame([(0, [9.0] * 3, [1.0, 0.0, 0.0, 0.0], [0.5] * 3, 3.0, [0.5] * 12)], "id long, xyz array<float>, rotation array<float>, scale array<float>, opacity double, sh array<float>"))
    links = {r["id"]: (r["parent"], r["first_child"], r["next_sibling"]) for r in both.collect()}
    assert links == {0: (-99, -99, -99), 1: (-1, 2, 0), 2: (1, 0, 3), 3: (1, 0, 0)}


def test_block_store(spark, tmp_path):
    rows = spark.range(40).select("id", (F.col("id") / 10).cast("long").alias("block"), (F.col("id") < 3).alias("background"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    s = BlockStore(spark, f"file://{tmp_path}/store")
    s.write(rows, "3.0")
    m = {r["block"]: (r["row_count"], r["min_x"], r["max_x"]) for r in s.manifest().collect()}
    assert m[0] == (10, -3.0, 12.0) and len(m) == 4
    assert s.read("min_x > 15").count() == 20
    fork = s.fork(f"file://{tmp_path}/fork")
    s.write(rows.where("block = 1").withColumn("x", F.lit(100.0)), "3.0")
    assert s.read().agg(F.sum("x")).first()[0] == sum(k for k in range(40) if not 10 <= k < 20) + 1000
    assert fork.read().agg(F.sum("x")).first()[0] == sum(range(40))
    assert s.collect_garbage() == []
    s.write(rows, "3.0")
    s.write(rows, "3.0")
    # the folder of the first write is the fork's too
    assert len(s.collect_garbage()) == 1
    assert fork.read().agg(F.sum("x")).first()[0] == sum(range(40))
    again = fork.fork(f"file://{tmp_path}/again")
    fork.write(rows, "3.0")
    fork.write(rows, "3.0")
    assert s.collect_garbage() == [] and fork.collect_garbage() == []
    assert again.read().agg(F.sum("x")).first()[0] == sum(range(40))
    again.write(rows, "3.0")
    again.write(rows, "3.0")
    s._put(f"{s.root}/data/{'a' * 32}/part", "x")
    s._put(f"{s.root}/pending/{'a' * 32}", "")
    assert len(s.collect_garbage()) == 1
    s.drop([0])
    assert s.read().count() == 30
    scores = spark.createDataFrame([(15, 2.0)], "id long, score double")
    assert s.read(scores=scores).agg(F.sum("score"), F.count("score")).first()[:] == (2.0, 30)
    assert s.read("min_x > 1e9").count() == 0


def test_scenes_are_put_together(spark, model, tmp_path):
    from tessera.sources import scene

    for kind, df in model.items():
        (tmp_path / f"{kind}.bin").write_bytes(rec.packed(kind, df.collect()))
    folder = f"file://{tmp_path}"
    depths = spark.createDataFrame([("a.png", 2.0, 0.5), ("zz.png", 4.0, 0.0), ("y.png", -1.0, 0.0)], "name string, scale double, offset double")
    s = scene.assemble(spark, folder, hold=2, depths=depths)
    got = {r["name"]: r for r in s.images.collect()}
    assert {n: (r["test"], r["model"], r["scale"], r["med_scale"]) for n, r in got.items()} == {"a.png": (True, "SIMPLE_RADIAL", 2.0, 3.0), "b.png": (False, "PINHOLE", None, None)}
    assert [got["b.png"][c] for c in ("cx", "cy", "cz")] == [-1.0, -2.0, -3.0]
    assert s.centre == (-1.0, -2.0, -3.0) and s.radius == 0.0
    want = {(1.0, 2.0, 3.0, 1.0, 0.0, 9 / 255), (0.0, 0.0, 1.0, 1 / 255, 2 / 255, 3 / 255)}
    assert {tuple(r)[1:7] for r in s.cloud.collect()} == want
    ply.write_cloud(s.cloud.where("z > 2"), f"{folder}/points3D.ply")  # from now on the file is the cloud
    again = scene.assemble(spark, folder, test_names=spark.createDataFrame([("b.png",)], "name string"))
    assert again.cloud.count() == 1 and {r["name"]: r["test"] for r in again.images.collect()} == {"a.png": False, "b.png": True}
    none = scene.assemble(spark, folder)
    assert none.images.where("test").count() == 0 and none.radius > 0


def test_block_store_refuses_bad_rows(spark, tmp_path):
    rows = spark.range(20).select("id", (F.col("id") / 10).cast("long").alias("block"), F.lit(False).alias("background"), *[F.col("id").cast("double").alias(c) for c in "xyz"])
    s = BlockStore(spark, f"file://{tmp_path}/store")
    s.write(rows, "1.0", finite=True, block_rows=10)
    for bad, match in ((rows.withColumn("y", F.when(F.col("id") == 3, float("nan")).otherwise(F.col("y"))), "y is not finite"), (rows.withColumn("block", F.lit(0)), "over 10 rows"), (rows.withColumn("more", F.lit(1)), "columns")):
        with pytest.raises(Exception, match=match):
            s.write(bad, "1.0", finite=True, block_rows=10)
        assert s.read().agg(F.sum("y"), F.count("*")).first()[:] == (190.0, 20)


def test_expressions_against_numpy(spark):
    r = np.random.default_rng(1)
    q, s, d = r.normal(size=4), np.exp(r.normal(size=3)), r.normal(size=3)
    d /= np.linalg.norm(d)
    w, x, y, z = q / np.linalg.norm(q)
    rot = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    cov = rot @ np.diag(s**2) @ rot.T
    lit = lambda v: [X.num(float(a)) for a in v]
    entries = X.rotation(*[f"({a})" for a in lit(q)])
    cols = entries + X.covariance(entries, lit(s))
    got = spark.range(1).select(*[F.expr(c).alias(f"c{k}") for k, c in enumerate(cols)]).first()
    assert np.allclose(got[:9], rot.ravel()) and np.allclose(got[9:], cov[np.triu_indices(3)])
    assert X.morton(["a", "b", "c"], 2).count("shiftleft") == 0
    frame = spark.createDataFrame([(5, 3, 1)], "a long, b long, c long")
    want = sum(((v >> b) & 1) << (3 * b + k) for b in range(3) for k, v in enumerate((5, 3, 1)))
    assert frame.select(F.expr(X.morton(["a", "b", "c"], 3))).first()[0] == want
    basis = spark.range(1).select(*[F.expr(b).alias(f"b{k}") for k, b in enumerate(X.sh_basis(*[f"({a})" for a in lit(d)], 3))]).first()
    lattice = r.normal(size=(40_000, 3))
    assert len(basis) == 16 and np.isfinite(list(basis)).all() and len(lattice)


def test_relocation_keeps_opacity(spark):
    a = 0.7
    for n in (1, 2, 5):
        new = spark.range(1).select(F.expr(X.relocated_opacity(X.num(a), str(n)))).first()[0]
        assert 1 - (1 - new) ** n == pytest.approx(a)
    assert spark.range(1).select(F.expr(X.relocated_scale(X.num(a), 1))).first()[0] == pytest.approx(1.0)


def test_learning_rate(spark):
    got = [spark.range(1).select(F.expr(X.learning_rate(str(k), 1e-2, 1e-4, 100))).first()[0] for k in (-1, 0, 50, 100, 500)]
    assert got == pytest.approx([0, 1e-2, 1e-3, 1e-4, 1e-4])
    assert X.learning_rate("1", 0.0, 1.0, 10) == X.num(0.0)
    assert struct.calcsize("<QdddBBBd") == 43
