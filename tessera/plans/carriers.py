"""How the test tables stand in for points, trees, step logs and image pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import table

_XYZ = {"x": 1, "y": 2, "z": 3}
_SCALE = {"s0": 4, "s1": 5, "s2": 6}
_QUAT = {"qw": 7, "qx": 8, "qy": 9, "qz": 10}
_DC = {"d0": 12, "d1": 13, "d2": 14}


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of embeddings as points; label 0 is the background."""
    e = lambda k: F.element_at("embedding", k).cast("double")
    plain = {n: e(k) for n, k in (_XYZ | _QUAT | _DC).items()}
    scale = {n: 4 * e(k) - 4 for n, k in _SCALE.items()}
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label", (F.col("label") == 0).alias("background"), *[c.alias(n) for n, c in (plain | scale).items()], (4 * e(11)).alias("op"), F.col("embedding").alias("e"))


POINTS = (
    "pts AS (SELECT vec_id AS id, label, label = 0 AS background, "
    + ", ".join(f"embedding[{k}]::DOUBLE AS {n}" for n, k in (_XYZ | _QUAT | _DC).items())
    + ", "
    + ", ".join(f"4 * embedding[{k}]::DOUBLE - 4 AS {n}" for n, k in _SCALE.items())
    + ", 4 * embedding[11]::DOUBLE AS op, embedding AS e FROM embeddings)"
)

#: A node's place and extent, from its id; the same text in both engines.
_PLACE = {"x": "((id * 37) % 101) / 1e2 - 5e-1", "y": "((id * 53) % 103) / 1e2 - 5e-1", "z": "((id * 71) % 107) / 1e2 + 1e0"}
_SIZE = "4e0 / power(2e0, depth) * (1e0 + (id % 7) / 1e2)"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of part as a binary tree: id, depth, parent, child_count, first_child, next_sibling, x, y, z, size, weight."""
    base = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("weight"))
    base = base.withColumns({"depth": (F.length(F.bin(F.col("id") + 1)) - 1).cast("int"), "parent": F.when(F.col("id") == 0, F.lit(-1)).otherwise(F.floor((F.col("id") - 1) / 2)).cast("long")})
    kids = base.where("parent >= 0").groupBy("parent").agg(F.count("*").cast("int").alias("child_count"), F.min("id").alias("first_child")).withColumnRenamed("parent", "_p")
    out = base.join(kids, base["id"] == kids["_p"], "left").drop("_p")
    out = out.withColumns({"child_count": F.coalesce("child_count", F.lit(0)), "first_child": F.coalesce("first_child", F.lit(0).cast("long"))})
    pair = base.where("parent >= 0").groupBy("parent").agg(F.max("id").alias("last")).withColumnRenamed("parent", "_p")
    out = out.join(pair, out["parent"] == pair["_p"], "left").drop("_p")
    out = out.withColumn("next_sibling", F.when(F.col("last") > F.col("id"), F.col("last")).otherwise(F.lit(0).cast("long"))).drop("last")
    return out.withColumns({n: F.expr(t) for n, t in (_PLACE | {"size": _SIZE}).items()})


NODES = (
    "n0 AS (SELECT p_partkey AS id, p_retailprice AS weight, (length(bin(p_partkey + 1)) - 1)::INT AS depth, "
    "CASE WHEN p_partkey = 0 THEN -1 ELSE floor((p_partkey - 1) / 2)::BIGINT END AS parent FROM part), "
    "nodes AS (SELECT a.id, a.weight, a.depth, a.parent, "
    "((SELECT count(*) FROM n0 b WHERE b.parent = a.id))::INT AS child_count, "
    "coalesce((SELECT min(b.id) FROM n0 b WHERE b.parent = a.id), 0) AS first_child, "
    "CASE WHEN a.id % 2 = 1 AND a.id + 1 IN (SELECT id FROM n0) THEN a.id + 1 ELSE 0 END AS next_sibling, "
    + ", ".join(f"{t} AS {n}" for n, t in _PLACE.items())
    + f", {_SIZE} AS size FROM n0 a)"
)


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of events as a step log: step (from 1), camera, kind, value."""
    from tessera.operators.blocks import dense_rank

    e = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("camera"), F.col("event_type").alias("kind"), "value")
    return dense_rank(e, ["ts", "event_id"], "_at").select((F.col("_at") + 1).alias("step"), "camera", "kind", "value", "event_id", "ts")


STEPS = "steps AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS step, user_id AS camera, event_type AS kind, value, event_id, ts FROM events)"

def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of part as the pixels of five square masks: view, u, v, inside."""
    side = max(1, math.isqrt(table(spark, sf_dir, "part").count() // 5))
    p = table(spark, sf_dir, "part").where(F.col("p_partkey") < 5 * side * side)
    return p.select(F.expr(f"p_partkey DIV {side * side}").alias("view"), (F.col("p_partkey") % side).alias("u"), F.expr(f"p_partkey DIV {side} % {side}").alias("v"), F.expr(_INSIDE).alias("inside"))


_INSIDE = "(p_partkey * 7919 + p_size * 31) % 61 = 0"
MASK = (
    "side AS (SELECT greatest(1, floor(sqrt(count(*) // 5)))::BIGINT AS n FROM part), "
    f"mask AS (SELECT p_partkey // (n * n) AS view, p_partkey % n AS u, p_partkey // n % n AS v, {_INSIDE} AS inside FROM part, side WHERE p_partkey < 5 * n * n)"
)


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cameras of CAMERAS two units back and turned, over the images of ``mask``."""
    side = math.isqrt(table(spark, sf_dir, "part").count() // 5)
    return cameras(spark).select(F.col("cam").alias("view"), *[F.expr(e).alias(n) for n, e in _VIEW.items()], *[F.lit(float(f * side)).alias(n) for n, f in _IMAGE.items()])


_VIEW = {"r0": "96e-2", "r1": "-28e-2", "r2": "0e0", "r3": "28e-2", "r4": "96e-2", "r5": "0e0", "r6": "0e0", "r7": "0e0", "r8": "1e0", "t0": "28e-2 * cy - 96e-2 * cx", "t1": "-28e-2 * cx - 96e-2 * cy", "t2": "2e0 - cz"}
_IMAGE = {"fx": 1.6, "fy": 1.5, "px": 0.5, "py": 0.45, "w": 1.0, "h": 1.0}

#: Five cameras: id and centre.
CAMERAS = ((0, 0.0, 0.0, -1.0), (1, 0.5, 0.2, 0.0), (2, -0.6, 0.1, 0.5), (3, 0.1, -0.7, 1.0), (4, 0.0, 0.9, 2.0))
CAMERAS_SQL = "cams(cam, cx, cy, cz) AS (VALUES " + ", ".join(f"({c}::BIGINT, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for c, x, y, z in CAMERAS) + ")"
VIEWS = "views AS (SELECT cam AS view, " + ", ".join(f"{e} AS {n}" for n, e in _VIEW.items()) + ", " + ", ".join(f"n * {f}::DOUBLE AS {c}" for c, f in _IMAGE.items()) + " FROM cams, side)"


def cameras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAMERAS, "cam long, cx double, cy double, cz double")


#: A clip matrix, row by row: focal factors 2.5 and 2.8, looking along +z from (0.05, -0.05, -0.6).
CLIP = ["2.5e0", "0e0", "0e0", "-1.25e-1", "0e0", "2.8e0", "0e0", "1.4e-1", "0e0", "0e0", "1.0e0", "5.8e-1", "0e0", "0e0", "1e0", "6e-1"]
