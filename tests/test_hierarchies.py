import struct

import pytest
from pyspark.sql import functions as F

from tessera.sources import hierarchies as h
from tests.test_core import complete_tree
from tests.test_sources import canon


@pytest.mark.parametrize("half", [False, True])
def test_static_hierarchies_round_trip(spark, tmp_path, half):
    pts = spark.createDataFrame([(k, [1.5 * k, 0.0, 2.0], [1.0, 0.0, 0.0, 0.0], [0.5] * 3, 0.25, [0.125] * 48) for k in range(3)], h.STATIC_POINTS)
    nodes = spark.createDataFrame([(0, 1, -1, 0, 0, 1, 1, 2, [0.0] * 4, [1.0] * 4), (1, 0, 0, 1, 1, 0, -1, 0, [0.5] * 4, [2.0] * 4)], h.STATIC_NODES)
    path = f"file://{tmp_path}/h.hier"
    assert h.write_static(pts, nodes.repartition(2), path, half) == (3, 2)
    raw = (tmp_path / "h.hier").read_bytes()
    real = 2 if half else 4
    assert len(raw) == 4 + 3 * (12 + real * 56) + 4 + 2 * ((20 if half else 28) + real * 8)
    assert struct.unpack("<i", raw[:4])[0] == (-3 if half else 3) and struct.unpack("<3f", raw[16:28]) == (1.5, 0.0, 2.0)
    assert canon(h.read_static_points(spark, path)) == canon(pts)
    assert canon(h.read_static_nodes(spark, path)) == canon(nodes)


def test_graph_and_anchors(spark):
    t = complete_tree(spark, 2)
    assert [r["value"] for r in h.graph_lines(t, 1).collect()] == ["nodedef>name VARCHAR", "0", "1", "2", "edgedef>node1 VARCHAR,node2 VARCHAR", "1,0", "2,0"]
    assert {r["id"] for r in h.anchors(t, spark.createDataFrame([(1,)], "id long")).collect()} == {1, 3, 4}


def test_chunk_blend(spark):
    pts = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0), (2, 0.5, 0.0, 0.0)], "id long, x double, y double, z double")
    centres = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 0.0, 0.0)], "cam long, cx double, cy double, cz double")
    got = {r["id"]: r["weight"] for r in h.chunk_blend(pts, centres, 0).collect()}
    assert got == {0: 1.0, 2: pytest.approx(0.5)}


def test_checkpoints(spark, tmp_path):
    folder, contract = f"file://{tmp_path}/c", {"iterations": 10, "seed": 1}
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id long, x double")
    with pytest.raises(FileNotFoundError):
        h.load_checkpoint(spark, folder, contract, 5, ("iterations",), ["x"])
    h.save_checkpoint(rows, folder, contract)
    back, fresh = h.load_checkpoint(spark, folder, contract | {"iterations": 20}, 5, ("iterations",), ["x"])
    assert back.count() == 2 and fresh
    with pytest.raises(ValueError):
        h.load_checkpoint(spark, folder, contract | {"seed": 2}, 5, ("iterations",), ["x"])
    h.save_checkpoint(rows.withColumn("x", F.lit(float("nan"))), folder, contract)
    with pytest.raises(Exception, match="not finite"):
        h.load_checkpoint(spark, folder, contract, 5, (), ["x"])[0].collect()


def test_logs_and_pairs(spark, tmp_path):
    log = spark.range(10).select(F.col("id").alias("iteration"), F.lit(1.5).alias("ms"))
    h.write_profile(log, f"file://{tmp_path}/p", F.col("iteration") % 2 == 0)
    assert h.read_profile(spark, f"file://{tmp_path}/p", "iteration long, ms double", 4).count() == 3
    pairs = spark.createDataFrame([(2147483647 * 3 + 5, 7), (2147483647 + 2, 0)], "pair_id long, rows long")
    assert [tuple(r) for r in h.pair_edges(pairs).collect()] == [(3, 5, 7.0)]
    cams = spark.createDataFrame([("a", 1)], "name string, width int")
    assert h.camera_json(cams).first()["json"] == '{"name":"a","width":1}'
    light = spark.createDataFrame([("a", [float(k) for k in range(12)])], "name string, exposure array<double>")
    assert h.exposure_json(light).first()["json"] == '{"a":[[0.0,1.0,2.0,3.0],[4.0,5.0,6.0,7.0],[8.0,9.0,10.0,11.0]]}'
