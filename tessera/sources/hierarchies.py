"""Static hierarchies, graph and anchor files, checkpoints and JSON logs."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import records
from tessera.sources.pointers import Pointers
from tessera.sources.records import Section

STATIC_POINTS = "id long, xyz array<float>, rotation array<float>, scale array<float>, opacity float, sh array<float>"
STATIC_NODES = "id long, depth int, parent int, start int, count_leafs int, count_merged int, start_children int, count_children int, box_min array<float>, box_max array<float>"
#: Coefficients of a row, and the order of the four short numbers of a compressed node.
SH = 48
SHORTS = ("depth", "count_children", "count_leafs", "count_merged")


LONGS = ("depth", "parent", "start", "count_leafs", "count_merged", "start_children", "count_children")


def _static(n: int, m: int, half: bool) -> tuple[list[Section], list[Section], int]:
    """Sections of the points and of the nodes, and where the number of nodes stands."""
    real, size = ("f2", 2) if half else ("f4", 4)
    points, at = [Section(4, (("xyz", "f4", 3),))], 4 + 12 * n
    for c, w in (("rotation", 4), ("scale", 3), ("opacity", 0), ("sh", SH)):
        points.append(Section(at, ((c, real, w),)))
        at += size * n * max(w, 1)
    ints = (*((c, "i4", 0) for c in ("parent", "start", "start_children")), *((c, "i2", 0) for c in SHORTS)) if half else tuple((c, "i4", 0) for c in LONGS)
    node = Section(at + 4, ints)
    boxes = Section(at + 4 + m * node.dtype.itemsize, (("box_min", real, 4), ("box_max", real, 4)))
    return points, [node, boxes], at


def _counts(path: str) -> tuple[int, int, bool]:
    """Points, nodes, and whether numbers are short: the count of points is negative then."""
    count = records.number(path, 0)
    half = count < 0
    return abs(count), records.number(path, _static(abs(count), 0, half)[2]), half


def read_static_points(spark: SparkSession, path: str) -> DataFrame:
    n, m, half = _counts(path)
    return records.read_records(spark, path, _static(n, m, half)[0], n)


def read_static_nodes(spark: SparkSession, path: str) -> DataFrame:
    n, m, half = _counts(path)
    rows = records.read_records(spark, path, _static(n, m, half)[1], m)
    return rows.select("id", *[F.col(c).cast("int").alias(c) for c in LONGS], "box_min", "box_max")


def write_static(points: DataFrame, nodes: DataFrame, path: str, half: bool = False) -> tuple[int, int]:
    """A static hierarchy of both tables, in the order of their ids; ``half``
    writes floats of two bytes and short node fields."""

    def layout(counts: list[int]) -> tuple[list[tuple[int, bytes]], list[list[Section]]]:
        n, m = counts
        a, b, at = _static(n, m, half)
        return [(0, np.array([-n if half else n], "<i4").tobytes()), (at, np.array([m], "<i4").tobytes())], [a, b]

    n, m = records.write_records(path, [points, nodes], layout)
    return n, m


def graph_lines(nodes: DataFrame, max_depth: int) -> DataFrame:
    """Lines of a graph file: the nodes down to a depth, then an edge from each
    to its parent (order, value); the edges are the tree's own."""
    kept = nodes.where(F.col("depth") <= max_depth)
    line = lambda k, v: (F.lit(k).alias("section"), v.alias("value"))
    heads = nodes.sparkSession.createDataFrame([(0, -1, "nodedef>name VARCHAR"), (2, -1, "edgedef>node1 VARCHAR,node2 VARCHAR")], "section int, id long, value string")
    rows = kept.select(*line(1, F.col("id").cast("string")), "id").select("section", "id", "value")
    edges = kept.where("parent >= 0").select(*line(3, F.concat_ws(",", F.col("id").cast("string"), F.col("parent").cast("string"))), "id").select("section", "id", "value")
    return heads.unionByName(rows).unionByName(edges).orderBy("section", "id").select("value")


def anchors(nodes: DataFrame, cut: DataFrame) -> DataFrame:
    """Ids of the nodes of a cut and of all below them."""
    from tessera.operators import tree

    marked = nodes.join(cut.select(F.col("id").alias("_cut")), F.col("id") == F.col("_cut"), "left")
    return tree.descend(marked, F.lit(True), {"inside": (F.col("_cut").isNotNull(), F.col("_cut").isNotNull() | F.col("up_inside"))}).where("inside").select("id")


def chunk_blend(points: DataFrame, centres: DataFrame, own: int) -> DataFrame:
    """Points of one chunk with a weight by the distances to its own and the
    nearest other centre; those of weight 0 are gone."""
    from tessera.operators.spatial import cross_fade

    w = cross_fade(points, centres, F.lit(own))
    return points.join(w.where("weight > 0").select("id", "weight"), "id")


def camera_json(cameras: DataFrame, key: str = "name") -> DataFrame:
    """One JSON document a row, in the order of columns."""
    return cameras.select(key, F.to_json(F.struct(*cameras.columns)).alias("json"))


def exposure_json(exposures: DataFrame, key: str = "name") -> DataFrame:
    """One JSON document an image: its three rows of four numbers, from an array of twelve, under its name."""
    matrix = F.transform(F.array(*[F.lit(k) for k in range(3)]), lambda k: F.slice("exposure", 4 * k + 1, 4))
    return exposures.select(key, F.to_json(F.create_map(F.col(key).cast("string"), matrix)).alias("json"))


def write_profile(steps: DataFrame, path: str, every: Column) -> None:
    """The sampled steps as JSON lines."""
    steps.where(every).write.mode("append").json(path)


def read_profile(spark: SparkSession, path: str, schema: str, warmup: int) -> DataFrame:
    return spark.read.schema(schema).json(path).where(F.col("iteration") >= warmup)


def save_checkpoint(rows: DataFrame, folder: str, contract: dict) -> None:
    """Rows under a new name, then the next pointer with the contract; the old rows stay until they are cleared."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    rows.write.parquet(f"{folder}/{name}")
    pointers = Pointers(spark, folder)
    pointers.commit(pointers.last() + 1, json.dumps({"rows": name, "contract": contract}, sort_keys=True))


def load_checkpoint(spark: SparkSession, folder: str, contract: dict, iteration: int, may_grow: tuple[str, ...], finite: list[str]) -> tuple[DataFrame, bool]:
    """The rows, and whether scores begin anew; another contract is an error,
    and so is, when it is read, a row with a value in ``finite`` that isn't."""
    from tessera.operators.stateful import contract_matches

    pointers = Pointers(spark, folder)
    last = pointers.last()
    if last < 0:
        raise FileNotFoundError(folder)
    state = json.loads(pointers.read(last))
    fine, fresh = contract_matches(state["contract"], contract, iteration, may_grow)
    if not fine:
        raise ValueError("the checkpoint was made under another contract")
    rows = spark.read.parquet(os.path.join(folder, state["rows"]))
    for c in finite:
        bad = F.isnan(c) | (F.abs(c) == float("inf"))
        rows = rows.withColumn(c, F.when(bad, F.raise_error(F.lit(f"{c} is not finite")).cast(rows.schema[c].dataType)).otherwise(F.col(c)))
    return rows, fresh


def read_pairs(spark: SparkSession, url: str, table: str = "two_view_geometries", **options: str) -> DataFrame:
    """Edges (src, dst, weight) of a matching database over JDBC; a pair's id is 2147483647 * src + dst."""
    rows = spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
    return pair_edges(rows)


def pair_edges(rows: DataFrame) -> DataFrame:
    top = F.lit(2147483647).cast("long")
    return rows.where(F.col("rows") > 0).select(F.floor(F.col("pair_id") / top).cast("long").alias("src"), (F.col("pair_id") % top).alias("dst"), F.col("rows").cast("double").alias("weight"))
