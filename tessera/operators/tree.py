"""Trees kept as tables: cuts, ranges, roll-ups, splits.

Nodes are rows (id, depth, parent, child_count, first_child, next_sibling, and
attributes). What a parent decides is one equality join; what a whole path
decides goes down level by level, a join each, and levels are few: a tree of n
nodes that is halved at each level has log2 n.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators import levels, relocation
from tessera.session import scratch, staged

#: Levels after which a loop's rows are written, to cut lineage.
LEVELS = 8
#: Deeper paths are an error, not a silent end.
DEEPEST = 10_000


def with_parent(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Each node with its parent's ``columns`` as p_<column> (null at roots)."""
    up = nodes.select(F.col("id").alias("_pid"), *[F.col(c).alias("p_" + c) for c in columns])
    return nodes.join(up, nodes["parent"] == up["_pid"], "left").drop("_pid")


def children(nodes: DataFrame) -> DataFrame:
    """id, first and second child of interior nodes, and whether the links agree with the parents."""
    a = nodes.select(F.col("id").alias("first"), F.col("parent").alias("fp"), F.col("next_sibling").alias("second"))
    b = nodes.select(F.col("id").alias("_second"), F.col("parent").alias("sp"))
    j = nodes.where("child_count > 0").select("id", "child_count", "first_child").join(a, F.col("first_child") == F.col("first"))
    j = j.join(b, F.col("second") == F.col("_second"), "left")
    fine = (F.col("fp") == F.col("id")) & ((F.col("child_count") == 1) | (F.coalesce(F.col("sp") == F.col("id"), F.lit(False)) & (F.col("first") != F.col("second"))))
    return j.select("id", "first", F.when(F.col("child_count") > 1, F.col("second")).alias("second"), fine.alias("valid"))


def audit(nodes: DataFrame) -> DataFrame:
    """Counts of nodes whose child count, depth or parent is wrong, and of those that a root reaches."""
    n = staged(nodes.select("id", "parent", "depth", "child_count"), "audited")
    up = n.select(F.col("id").alias("_pid"), F.col("depth").alias("p_depth")).hint("merge")
    kids = n.where("parent >= 0").groupBy("parent").agg(F.count("*").alias("n")).withColumnRenamed("parent", "_p").hint("merge")
    j = n.join(up, n["parent"] == up["_pid"], "left").join(kids, F.col("id") == F.col("_p"), "left")
    bad = j.agg(
        F.count("*").alias("nodes"),
        F.count_if(F.coalesce("n", F.lit(0)) != F.col("child_count")).alias("bad_child_count"),
        F.count_if((F.col("parent") >= 0) & ~F.col("depth").eqNullSafe(F.col("p_depth") + 1)).alias("bad_depth"),
        F.count_if((F.col("parent") >= 0) & F.col("p_depth").isNull()).alias("orphans"),
    )
    reached = rooted(n).agg(F.count("*").alias("reachable"))
    return bad.join(F.broadcast(reached)).select("nodes", "bad_child_count", "bad_depth", "orphans", "reachable")


def rooted(nodes: DataFrame) -> DataFrame:
    """The ids of nodes whose parents lead to a root, by pointer jumping: a round
    doubles what each row has seen of its path. Rows whose path ends elsewhere
    drop out; what a round no longer changes is on or below a cycle. No join is
    broadcast, so the driver gets a number a round."""
    t = staged(nodes.select("id", F.col("parent").alias("end"), (F.col("parent") < 0).alias("done")), "rooted")
    left, before = t.where("NOT done").count(), None
    for _ in range(relocation.ROUNDS):
        if left in (0, before):
            return t.where("done").select("id")
        onward = t.select(F.col("id").alias("_at"), F.col("end").alias("_end"), F.col("done").alias("_done")).hint("merge")
        moved = t.where("NOT done").join(onward, F.col("end") == F.col("_at")).select("id", F.col("_end").alias("end"), F.col("_done").alias("done"))
        t = staged(t.where("done").unionByName(moved), "rooted")
        left, before = t.where("NOT done").count(), left
    raise RuntimeError("ids that occur twice have a cycle in their links")


def descend(nodes: DataFrame, expands: Column, carry: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """Nodes reached from the roots while ``expands`` holds for all nodes above.

    ``carry`` maps a name to its value at a root and its value at a child, where
    the parent's is the column up_<name>. Each level is found and written once.
    """
    carry, spark = carry or {}, nodes.sparkSession
    nodes, path = staged(nodes, "nodes"), scratch(spark, "reached")
    level = nodes.where("parent < 0").withColumns({n: a for n, (a, _) in carry.items()})
    for k in range(DEEPEST):
        kind = level.schema
        level.write.parquet(f"{path}/reached_at={k}")
        level = spark.read.schema(kind).parquet(f"{path}/reached_at={k}")
        if not level.take(1):
            return spark.read.schema(StructType([*kind.fields, StructField("reached_at", IntegerType())])).parquet(path).drop("reached_at")
        up = level.where(expands).select(F.col("id").alias("_up"), *[F.col(n).alias("up_" + n) for n in carry])
        level = nodes.join(up, nodes["parent"] == up["_up"])
        level = level.withColumns({n: b for n, (_, b) in carry.items()}).select(*nodes.columns, *carry)
    raise RuntimeError(f"a path of over {DEEPEST} nodes: the links have a cycle")


def predicate_cut(nodes: DataFrame, visible: Column, refine: Column) -> DataFrame:
    """The cut: visible nodes reached through nodes that are visible and to be
    refined, that are leaves or not to be refined themselves."""
    reached = levels.down(levels.Levels(nodes), {}, visible & refine & (F.col("child_count") > 0))
    return reached.where(visible & ((F.col("child_count") == 0) | ~refine)).select(*nodes.columns)


def depth_cut(nodes: DataFrame, target: int) -> DataFrame:
    """Nodes of the target depth, and leaves above it."""
    return nodes.where((F.col("depth") == target) | ((F.col("depth") < target) & (F.col("child_count") == 0)))


def size_cut(nodes: DataFrame, target: Column) -> DataFrame:
    """Nodes below the target size whose parent is not, and leaves of the size or more."""
    j = with_parent(nodes, ["size"])
    small = (F.col("size") < target) & (F.col("p_size").isNull() | (F.col("p_size") >= target))
    return j.where(small | ((F.col("child_count") == 0) & (F.col("size") >= target)))


def roll_up(nodes: DataFrame, start: Column, combine, name: str) -> DataFrame:
    """A value for each node from its own and its children's, leaves first.

    ``combine`` gets the rows of a level joined with their parents' columns
    (p_<column>) and returns the aggregate over a parent's children.
    """
    found = levels.up(levels.Levels(nodes), {name: start}, {name: combine})
    return found.select(*nodes.columns, name)


def sibling_weights(nodes: DataFrame) -> DataFrame:
    w = Window.partitionBy("parent")
    return nodes.withColumn("share", F.when(F.col("parent") < 0, F.lit(1.0)).otherwise(F.try_divide(F.col("weight"), F.sum("weight").over(w))))


def subtree_ranges(nodes: DataFrame, root_volume: float, volume: Column, own_min: Column) -> DataFrame:
    """Rows (root, id, min_d, max_d) of the subtrees below the volume cut.

    The cut's nodes are roots; below them, from the far end inwards, a node's
    max is the min of its parent (1e12 at a root) and its min its own, never
    above its parent's.
    """
    found = levels.subtree_ranges(nodes, root_volume, volume, own_min)
    return found.where("root IS NOT NULL").select("root", "id", "depth", "min_d", "max_d")


def interval_cut(ranges: DataFrame, distances: DataFrame) -> DataFrame:
    """Entries of each subtree with min_d < d < max_d: an equality join on the root, a range test within."""
    return ranges.join(distances, "root").where((F.col("min_d") < F.col("d")) & (F.col("max_d") > F.col("d")))


def step_cut(nodes: DataFrame, cut: DataFrame, split: Column, collapse: Column) -> DataFrame:
    """The next cut: nodes to split give way to their children; nodes all of
    whose siblings collapse with them give way to their parent."""
    here = nodes.join(cut, "id", "left_semi")
    kids = nodes.select(F.col("id").alias("child"), F.col("parent").alias("_p"))
    down = here.where(split & (F.col("child_count") > 0))
    opened = down.select("id").join(kids, F.col("id") == F.col("_p")).select(F.col("child").alias("id"))
    rest = here.where(~(split & (F.col("child_count") > 0)))
    sizes = nodes.select(F.col("id").alias("_pp"), F.col("child_count").alias("_n"))
    up = rest.where(collapse & (F.col("parent") >= 0)).groupBy("parent").agg(F.count("*").alias("_m")).join(sizes, F.col("parent") == F.col("_pp")).where(F.col("_m") == F.col("_n")).select(F.col("parent").alias("_gone"))
    stay = rest.join(up, rest["parent"] == up["_gone"], "left_anti").select("id")
    return stay.unionByName(opened).unionByName(up.select(F.col("_gone").alias("id")))


def budgeted_target(nodes: DataFrame, targets: list[float], budget: int) -> DataFrame:
    """target and n of the finest of a list of size targets whose cut has at
    most ``budget`` rows; all are counted in one pass, and no row is cut off."""
    grid = nodes.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    j = with_parent(nodes, ["size"]).join(F.broadcast(grid))
    t = F.col("target")
    inside = ((F.col("size") < t) & (F.col("p_size").isNull() | (F.col("p_size") >= t))) | ((F.col("child_count") == 0) & (F.col("size") >= t))
    return j.where(inside).groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") <= budget).orderBy("target").limit(1)


def split_nodes(nodes: DataFrame, chosen: Column, first_id: int) -> DataFrame:
    """The new children of the chosen leaves, by id: ids from ``first_id`` in pairs."""
    from tessera.operators.blocks import dense_rank

    ranked = dense_rank(nodes.where(chosen & (F.col("child_count") == 0)).select("id", "depth"), ["id"], "k")
    kids = ranked.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    new = F.lit(first_id) + 2 * F.col("k") + F.col("side")
    return kids.select(new.alias("id"), F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"), F.when(F.col("side") == 0, new + 1).otherwise(F.lit(0).cast("long")).alias("next_sibling"))


def compact(nodes: DataFrame, keep: Column) -> DataFrame:
    """Kept rows under new, dense ids, with parents renamed (-1 if gone)."""
    from tessera.operators.blocks import dense_rank

    kept = dense_rank(nodes.where(keep).select("id", "parent"), ["id"], "new_id")
    names = kept.select(F.col("id").alias("_old"), F.col("new_id").alias("_parent"))
    return kept.join(names, kept["parent"] == names["_old"], "left").select("id", "new_id", F.coalesce("_parent", F.lit(-1).cast("long")).alias("new_parent"))


def relocate(nodes: DataFrame, dead: Column) -> DataFrame:
    """Where living nodes hang after dead leaves are gone: a node whose sibling
    is dead takes its parent's place (one level at a time, deepest first, is
    the same as the nearest ancestor that keeps two branches). Of two dead
    siblings the first one lives."""
    n = nodes.withColumn("_dead", dead & (F.col("child_count") == 0))
    w = Window.partitionBy("parent").orderBy("id")
    first = F.row_number().over(w) == 1
    n = n.withColumn("_dead", F.col("_dead") & ~(first & (F.min(F.col("_dead").cast("int")).over(Window.partitionBy("parent")) == 1)))
    lone = n.withColumn("_only", (F.count("*").over(Window.partitionBy("parent")) - F.sum(F.col("_dead").cast("int")).over(Window.partitionBy("parent")) == 1) & (F.col("parent") >= 0))
    return lone.where(~F.col("_dead")).select("id", "parent", F.col("_only").alias("promoted"))


def merge_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Trees of several chunks under one new root: ids get offsets, roots the root."""
    out, offset, base = None, 1, chunks[0].sparkSession
    for c in chunks:
        top = c.agg(F.max("id")).first()[0]
        part = c.select((F.col("id") + offset).alias("id"), F.when(F.col("parent") < 0, F.lit(0).cast("long")).otherwise(F.col("parent") + offset).alias("parent"), (F.col("depth") + 1).alias("depth"))
        out = part if out is None else out.unionByName(part)
        offset += (top if top is not None else -1) + 1
    return out.unionByName(base.createDataFrame([(0, -1, 0)], "id long, parent long, depth int"))


def kd_levels(points: DataFrame, levels: int, axes: tuple[str, ...] = ("x", "y", "z"), radius: Column | None = None) -> DataFrame:
    """points with cell, the number of their cell after ``levels`` median splits
    along the axis on which the box of the points' spheres is widest (ties to
    the first axis; ranks by coordinate and id)."""
    from tessera.operators.blocks import dense_rank

    r = F.col("radius")
    p = points.select("id", *axes, (F.lit(0.0) if radius is None else radius).alias("radius")).withColumn("cell", F.lit(1).cast("long"))
    for k in range(levels):
        wide = p.groupBy("cell").agg(F.count("*").alias("n"), *[F.round(F.max(F.col(a) + r) - F.min(F.col(a) - r), 9).alias("w_" + a) for a in axes])
        top = F.greatest(*[F.col("w_" + a) for a in axes])
        axis = F.coalesce(*[F.when(F.col("w_" + a) == top, F.lit(a)) for a in axes])
        j = p.join(wide.select("cell", "n", axis.alias("axis")), "cell")
        along = F.coalesce(*[F.when(F.col("axis") == a, F.col(a)) for a in axes])
        ranked = dense_rank(j.withColumn("_along", along), ["cell", "_along", "id"], "_place")
        j = ranked.join(ranked.groupBy("cell").agg(F.min("_place").alias("_first")), "cell").withColumn("r", F.col("_place") - F.col("_first") + 1)
        p = j.select("id", *axes, "radius", (2 * F.col("cell") + F.when(2 * F.col("r") > F.col("n"), 1).otherwise(0)).alias("cell"))
        if k % LEVELS == LEVELS - 1:
            p = staged(p, "kd")
    return p.drop("radius")
