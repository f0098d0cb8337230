"""Files written from the point and node carriers, and read back by byte ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans.carriers import NODES, POINTS, nodes, points
from tessera.plans.registry import query
from tessera.session import scratch, table
from tessera.sources import hierarchies, ply, reconstruction

_COLOUR = "least(greatest(d{k} + 5e-1, 0e0), 1e0)"


@query(f"WITH {POINTS} SELECT row_number() OVER (ORDER BY id) - 1 AS row, " + ", ".join(f"round({c}::FLOAT::DOUBLE, 6) AS {c}" for c in ("x", "y", "z")) + ", " + ", ".join(f"round(round({_COLOUR.format(k=k)} * 255) / 255, 6) AS {c}" for k, c in enumerate("rgb")) + " FROM pts")
def cloud_file(spark, sf_dir):
    """A point cloud written as one PLY file and read again."""
    path = scratch(spark, "cloud") + ".ply"
    ply.write_cloud(points(spark, sf_dir).select("id", *"xyz", *[F.expr(_COLOUR.format(k=k)).alias(c) for k, c in enumerate("rgb")]), path)
    return ply.read_cloud(spark, path).select(F.col("id").alias("row"), *[F.round(c, 6).alias(c) for c in "xyzrgb"])


@query(f"WITH {POINTS} SELECT row_number() OVER (ORDER BY id) - 1 AS row, round(x::FLOAT::DOUBLE, 6) AS x, round(s0::FLOAT::DOUBLE, 5) AS s0, round(qw::FLOAT::DOUBLE, 6) AS qw, round(op::FLOAT::DOUBLE, 5) AS op, round(d2::FLOAT::DOUBLE, 6) AS d2, round(e[23]::DOUBLE, 6) AS last FROM pts WHERE NOT background")
def splat_file(spark, sf_dir):
    """Splats of degree 1 written as one PLY file and read again, without the background."""
    path = scratch(spark, "splats") + ".ply"
    p = points(spark, sf_dir)
    group = lambda *c: F.array(*[F.col(n).cast("float") for n in c])
    rows = p.select("id", group(*"xyz").alias("xyz"), group("s0", "s1", "s2").alias("scale"), group("qw", "qx", "qy", "qz").alias("rotation"), group("d0", "d1", "d2").alias("dc"), F.col("op").cast("float").alias("opacity"), F.slice("e", 15, 9).cast("array<float>").alias("rest"), "background")
    ply.write_splats(rows, path, 1, ~F.col("background"))
    back = ply.read_splats(spark, path, 1)
    at = lambda c, k: F.get(c, F.lit(k)).cast("double")
    return back.select(F.col("id").alias("row"), F.round(at("xyz", 0), 6).alias("x"), F.round(at("scale", 0), 5).alias("s0"), F.round(at("rotation", 0), 6).alias("qw"), F.round(F.col("opacity").cast("double"), 5).alias("op"), F.round(at("dc", 2), 6).alias("d2"), F.round(at("rest", 8), 6).alias("last"))


def _node_rows(spark, sf_dir):
    n = nodes(spark, sf_dir)
    real = lambda *c: F.array(*[F.expr(x).cast("float") for x in c])
    return n.select("id", real("x", "y", "z").alias("xyz"), real("1", "0", "0", "0").alias("rotation"), real("size", "size", "size").alias("scale"), F.expr("weight / 2e3").cast("float").alias("opacity"), F.array_repeat(F.expr("id % 7").cast("float"), 12).alias("sh"), "depth", F.col("parent").cast("int").alias("parent"), "child_count", F.col("first_child").cast("int").alias("first_child"), F.col("next_sibling").cast("int").alias("next_sibling"), F.lit(-1).alias("aux"))


@query(f"WITH {NODES} SELECT id, depth, parent::INT AS parent, child_count, first_child::INT AS first_child, next_sibling::INT AS next_sibling, round(y::FLOAT::DOUBLE, 6) AS y, round((weight / 2e3)::FLOAT::DOUBLE, 6) AS opacity, (id % 7)::DOUBLE AS sh FROM nodes")
def hierarchy_file(spark, sf_dir):
    """A dynamic hierarchy written as one file of six sections and read again."""
    path = scratch(spark, "hierarchy")
    ply.write_hierarchy(_node_rows(spark, sf_dir), path, 1)
    real = lambda c: F.round(c.cast("double"), 6)
    return ply.read_hierarchy(spark, path).select("id", "depth", "parent", "child_count", "first_child", "next_sibling", real(F.get("xyz", F.lit(1))).alias("y"), real(F.col("opacity")).alias("opacity"), real(F.get("sh", F.lit(11))).alias("sh"))


@query(f"WITH {NODES} SELECT id, depth, parent::INT AS parent, child_count AS count_children, CASE WHEN child_count > 0 THEN first_child ELSE -1 END::INT AS start_children, round((x - size)::FLOAT::DOUBLE, 5) AS low, round((z + size)::FLOAT::DOUBLE, 5) AS high FROM nodes")
def static_hierarchy_file(spark, sf_dir):
    """A static hierarchy, points, nodes and boxes, written as one file; the nodes are read again."""
    path = scratch(spark, "static")
    n = nodes(spark, sf_dir)
    sh = F.concat(F.col("sh"), F.array_repeat(F.lit(0.0).cast("float"), hierarchies.SH - 12))
    pts = _node_rows(spark, sf_dir).select("id", "xyz", "rotation", "scale", "opacity", sh.alias("sh"))
    box = lambda s: F.array(*[F.expr(f"{c} {s} size").cast("float") for c in "xyz"], F.expr("2 * size").cast("float"))
    leaf = F.col("child_count") == 0
    rows = n.select("id", "depth", "parent", F.col("id").alias("start"), leaf.cast("int").alias("count_leafs"), (~leaf).cast("int").alias("count_merged"), F.when(leaf, -1).otherwise(F.col("first_child")).alias("start_children"), F.col("child_count").alias("count_children"), box("-").alias("box_min"), box("+").alias("box_max"))
    hierarchies.write_static(pts, rows, path)
    back = hierarchies.read_static_nodes(spark, path)
    return back.select("id", "depth", "parent", "count_children", "start_children", F.round(F.get("box_min", F.lit(0)).cast("double"), 5).alias("low"), F.round(F.get("box_max", F.lit(2)).cast("double"), 5).alias("high"))


@query("SELECT c_custkey::INT AS camera_id, 'PINHOLE' AS model, 640 + c_custkey % 700 AS width, 480 + c_custkey % 300 AS height, 5e2 + c_custkey % 90 AS fx, c_acctbal AS last FROM customer")
def cameras_text_file(spark, sf_dir):
    """Camera models written as text and read again."""
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.col("c_custkey").cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), F.expr("640 + c_custkey % 700").alias("width"), F.expr("480 + c_custkey % 300").alias("height"), F.array(F.expr("double(5e2 + c_custkey % 90)"), F.lit(5.5e2), F.lit(3.2e2), F.col("c_acctbal")).alias("params"))
    path = scratch(spark, "cameras-text")
    reconstruction.write_text("cameras", rows, path)
    back = reconstruction.read_cameras_text(spark, path, only="PINHOLE")
    return back.select("camera_id", "model", "width", "height", F.get("params", F.lit(0)).alias("fx"), F.get("params", F.lit(3)).alias("last"))


@query("SELECT p_partkey AS point3d_id, p_retailprice AS x, (p_size % 256)::INT AS red, p_size / 4e0 AS error, CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 100 ELSE -1 END::INT AS seen_by FROM part")
def points_text_file(spark, sf_dir):
    """Sparse points with tracks of up to two images, written as text and read again."""
    p = table(spark, sf_dir, "part")
    seen = F.struct((F.col("p_partkey") % 100).cast("int").alias("image_id"), F.lit(7).alias("point2d_idx"))
    rows = p.select(F.col("p_partkey").alias("point3d_id"), F.array("p_retailprice", F.lit(0.5), F.lit(-1.0)).alias("xyz"), F.array(F.col("p_size") % 256, F.lit(0), F.lit(255)).alias("rgb"), (F.col("p_size") / 4).alias("error"), F.slice(F.array(seen, seen), 1, (F.col("p_partkey") % 3).cast("int")).alias("track"))
    path = scratch(spark, "points-text")
    reconstruction.write_text("points3D", rows, path)
    back = reconstruction.read_points_text(spark, path)
    return back.select("point3d_id", F.get("xyz", F.lit(0)).alias("x"), F.get("rgb", F.lit(0)).alias("red"), "error", F.coalesce(F.get("track", F.lit(0))["image_id"], F.lit(-1)).alias("seen_by"))


@query("SELECT o_orderkey::INT AS image_id, o_totalprice AS tx, o_custkey::INT AS camera_id, 'i' || o_orderkey || '.png' AS name, CASE WHEN o_orderkey % 2 = 1 THEN o_orderkey ELSE -1 END AS point FROM orders")
def images_text_file(spark, sf_dir):
    """Image poses, each with a 2-D point or none, written as text and read again."""
    o = table(spark, sf_dir, "orders")
    spot = F.struct(F.lit(1.5).alias("x"), F.lit(2.5).alias("y"), F.col("o_orderkey").alias("point3d_id"))
    rows = o.select(F.col("o_orderkey").cast("int").alias("image_id"), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("qvec"), F.array("o_totalprice", F.lit(0.0), F.lit(2.0)).alias("tvec"), F.col("o_custkey").cast("int").alias("camera_id"), F.concat(F.lit("i"), F.col("o_orderkey").cast("string"), F.lit(".png")).alias("name"), F.slice(F.array(spot), 1, (F.col("o_orderkey") % 2).cast("int")).alias("points2d"))
    path = scratch(spark, "images-text")
    reconstruction.write_text("images", rows, path)
    back = reconstruction.read_images_text(spark, path)
    return back.select("image_id", F.get("tvec", F.lit(0)).alias("tx"), "camera_id", "name", F.coalesce(F.get("points2d", F.lit(0))["point3d_id"], F.lit(-1).cast("long")).alias("point"))
