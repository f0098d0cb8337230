"""Trees level by level: each level is read once and written once.

Nodes are written into a folder a depth. A sweep joins the rows of one depth
with those of the depth next to it alone, and writes what it finds, so a tree
costs its rows once whatever its height; no plan grows with the levels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators.blocks import running_sum
from tessera.operators.relocation import jump
from tessera.session import scratch, ship, staged


class Levels:
    """Nodes (id, parent, depth, and more) by depth; a root's parent is below 0."""

    def __init__(self, nodes: DataFrame) -> None:
        self.spark = nodes.sparkSession
        ship(self.spark)
        self.path = scratch(self.spark, "levels")
        # a depth with a third of all rows is written by all tasks that have some
        nodes.write.partitionBy("depth").parquet(self.path)
        self.schema = StructType([f for f in nodes.schema.fields if f.name != "depth"])
        self.full = StructType([*self.schema.fields, StructField("depth", IntegerType())])
        self.columns = self.schema.names
        self.depths = sorted(r[0] for r in self.all().select("depth").distinct().collect())  # a row a level

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.full).parquet(self.path)

    def at(self, depth: int) -> DataFrame:
        if depth not in self.depths:
            return self.all().limit(0).select(*self.columns)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")


class Found:
    """What a sweep has found, a folder a level."""

    def __init__(self, levels: Levels, name: str) -> None:
        self.spark, self.path, self.schema = levels.spark, scratch(levels.spark, name), None

    def add(self, depth: int, rows: DataFrame) -> DataFrame:
        self.schema = rows.schema
        rows.write.parquet(f"{self.path}/depth={depth}")
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/depth={depth}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("depth", IntegerType())])).parquet(self.path)


def down(levels: Levels, carry: dict[str, tuple[Column, Column]], expands: Column | None = None) -> DataFrame:
    """The nodes with a value for each name of ``carry``: its first expression
    at a root, its second below, where the parent's is up_<name>. Nodes below
    one for which ``expands`` doesn't hold are left out."""
    found, above = Found(levels, "down"), None
    roots = F.col("parent") < 0
    for d in levels.depths or [0]:
        level = levels.at(d)
        if above is None:
            level = level.where(roots).withColumns({n: a for n, (a, _) in carry.items()})
        else:
            up = (above if expands is None else above.where(expands)).select(F.col("id").alias("_up"), *[F.col(n).alias("up_" + n) for n in carry])
            j = level.join(up, F.col("parent") == F.col("_up"), "left").where(roots | F.col("_up").isNotNull())
            level = j.withColumns({n: F.when(roots, a).otherwise(b) for n, (a, b) in carry.items()})
        above = found.add(d, level.select(*levels.columns, *carry))
    return found.all()


def up(levels: Levels, start: dict[str, Column], combine: dict[str, Column], also: dict[str, Column] | None = None) -> DataFrame:
    """The nodes with a value for each name of ``start``: that at a leaf, and
    else the aggregate ``combine`` over the children's rows, which see their
    parent's columns as p_<column>. ``also`` are further values of interior
    nodes, from their own columns and these."""
    found, below = Found(levels, "up"), None
    for d in reversed(levels.depths or [0]):
        level = levels.at(d)
        if below is not None:
            over = level.select(*[F.col(c).alias("p_" + c) for c in levels.columns])
            sums = below.where("parent >= 0").join(over, F.col("parent") == F.col("p_id")).groupBy("p_id").agg(*[c.alias("_" + n) for n, c in combine.items()])
            level = level.join(sums, F.col("id") == F.col("p_id"), "left").withColumns({n: F.when(F.col("p_id").isNull(), s).otherwise(F.col("_" + n)) for n, s in start.items()})
            level = level.withColumns({n: F.when(F.col("p_id").isNull(), F.col(n)).otherwise(c) for n, c in (also or {}).items()})
        else:
            level = level.withColumns(start)
        below = found.add(d, level.select(*levels.columns, *start))
    return found.all()


def linearise(nodes: DataFrame) -> DataFrame:
    """Where each node stands when the tree is written out, children by id:

    * preorder, subtree (how many nodes it and all below it are), and
      next_sibling, the preorder of the next child of its parent or 0: the
      layout in which a node precedes all that is below it;
    * place and first_child: the layout that takes a block for all children of
      a node when it comes to the node; -1 for leaves.

    Sizes come bottom-up, offsets top-down; a place is a running sum in preorder.
    """
    levels = Levels(nodes.select("id", "parent", "depth"))
    one = F.lit(1).cast("long")
    sized = up(levels, {"subtree": one}, {"subtree": F.sum("subtree") + 1})
    family = Window.partitionBy("parent").orderBy("id")
    before = F.coalesce(F.sum("subtree").over(family.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sized = sized.withColumns({"_skip": before, "_nth": (F.row_number().over(family) - 1).cast("long"), "_last": F.lead("id").over(family).isNull()})
    placed = down(Levels(sized), {"preorder": (F.col("_skip"), F.col("up_preorder") + 1 + F.col("_skip"))})
    kids = placed.where("parent >= 0").groupBy(F.col("parent").alias("_p")).agg(F.count("*").alias("n_children"))
    placed = placed.join(kids, F.col("id") == F.col("_p"), "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).drop("_p")
    roots = placed.where("parent < 0").count()
    summed = staged(running_sum(placed, ["preorder"], "n_children", "_before"), "linear")
    first = F.when(F.col("n_children") > 0, F.lit(roots) + F.col("_before")).otherwise(F.lit(-1))
    j = summed.withColumn("first_child", first.cast("long"))
    over = j.select(F.col("id").alias("_p"), F.col("first_child").alias("_base"))
    j = j.join(over, F.col("parent") == F.col("_p"), "left")
    follows = F.when(F.col("_last") | (F.col("parent") < 0), F.lit(0)).otherwise(F.col("preorder") + F.col("subtree"))
    return j.select("id", "parent", "depth", "preorder", "subtree", follows.cast("long").alias("next_sibling"), F.coalesce(F.col("_base"), F.lit(0)).cast("long").alias("_at"), "_nth", "first_child").select("id", "parent", "depth", "preorder", "subtree", "next_sibling", (F.col("_at") + F.col("_nth")).alias("place"), "first_child")


def subtree_ranges(nodes: DataFrame, root_volume: float, volume: Column, own_min: Column) -> DataFrame:
    """The nodes with root, min_d and max_d: which subtree below the volume cut
    each is in (null above it). From the far end inwards, a node's max is the
    min of its parent (1e12 at a root) and its min its own, never above its
    parent's. One sweep down."""
    opened = (volume > root_volume) & (F.col("child_count") > 0)
    carry = {
        "root": (F.when(~opened, F.col("id")), F.coalesce(F.col("up_root"), F.when(~opened, F.col("id")))),
        "max_d": (F.when(~opened, F.lit(1e12)), F.when(F.col("up_root").isNotNull(), F.col("up_min_d")).when(~opened, F.lit(1e12))),
        "min_d": (F.when(~opened, own_min), F.when(F.col("up_root").isNotNull(), F.least(own_min, F.col("up_min_d"))).when(~opened, own_min)),
    }
    return down(Levels(nodes), carry)


# -- bottom cuts and contraction ------------------------------------------------


def bottom(nodes: DataFrame, seen: Column) -> DataFrame:
    """id and covered (whether the cut reaches all leaves below) and bottom
    (whether the node is in it) of every node, where the cut is the lowest
    nodes that are ``seen``. A node some of whose children are covered and some
    not is an error: the cut is incomplete."""
    levels = Levels(nodes.select("id", "parent", "depth", seen.alias("_seen")))
    level = up(
        levels,
        {"covered": F.col("_seen"), "_n": F.lit(0).cast("long"), "_all": F.lit(0).cast("long")},
        {"covered": F.bool_and("covered"), "_n": F.count_if("covered"), "_all": F.count("*")},
        {"covered": F.col("covered") | (F.col("_seen") & (F.col("_n") == 0))},
    )
    torn = level.where("_n > 0 AND _n < _all").select("id").take(1)
    if torn:
        raise ValueError(f"the cut is incomplete below node {torn[0][0]}")
    return level.select("id", "covered", (F.col("_seen") & (F.col("_n") == 0)).alias("bottom"))


def nearest(nodes: DataFrame, stop: Column) -> DataFrame:
    """id and near of every node: itself if ``stop`` holds, else the nearest node
    above it for which it does, or null."""
    t = staged(nodes.select("id", "parent", stop.alias("_stop")), "stops")
    # a node that stops links nowhere; a root that doesn't, to null
    links = t.where("NOT _stop").select("id", F.when(F.col("parent") >= 0, F.col("parent")).alias("to"), F.lit(0).alias("w"))
    return t.where("_stop").select("id", F.col("id").alias("near")).unionByName(jump(links).select("id", F.col("end").alias("near")))


def below(nodes: DataFrame, marked: Column) -> DataFrame:
    """Marked nodes and all that is below one."""
    return nodes.join(nearest(nodes, marked).where("near IS NOT NULL").select("id"), "id", "left_semi")


def collapse(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, parent, depth, child_count, bottom, marked, and more) without
    the unmarked interior nodes below each unmarked bottom node, down to the
    first marked nodes and leaves, which become its children. Depths and child
    counts are counted anew."""
    leaf = F.col("child_count") == 0
    t = staged(nodes.join(nearest(nodes, F.col("marked") | F.col("bottom") | leaf), "id"), "contract")
    opens = t.where("bottom AND NOT marked AND child_count > 0").select(F.col("id").alias("_top"))
    t = t.join(opens, F.col("near") == F.col("_top"), "left")
    t = staged(t.withColumn("_gone", F.col("_top").isNotNull() & (F.col("_top") != F.col("id"))), "contract")
    gone = t.where("_gone").select(F.col("id").alias("_p"), F.col("_top").alias("_to"))
    kept = t.where("NOT _gone").drop("_top", "_gone", "near").join(gone, F.col("parent") == F.col("_p"), "left")
    kept = staged(kept.withColumn("parent", F.coalesce("_to", "parent")).drop("_p", "_to"), "contract")
    link = F.when(F.col("parent") >= 0, F.col("parent"))
    depth = jump(kept.select("id", link.alias("to"), F.when(link.isNotNull(), 1).otherwise(0).alias("w"))).select("id", F.col("steps").alias("depth"))
    kids = kept.where("parent >= 0").groupBy(F.col("parent").alias("_p")).agg(F.count("*").cast("int").alias("child_count"))
    j = kept.drop("depth", "child_count").join(depth, "id").join(kids, F.col("id") == F.col("_p"), "left")
    return j.select(*[F.coalesce("child_count", F.lit(0)).alias(c) if c == "child_count" else F.col(c) for c in nodes.columns])


def thinned(nodes: DataFrame, limit: float, factor: float, seen) -> DataFrame:
    """The tree after all its cuts at limits limit, limit * factor, ... up to 1:
    each cut's bottom is marked, what is unmarked below it collapses. ``seen``
    maps a limit to the condition, on a node's columns and its parent's
    (p_size), that it is in that cut. At the end a last cut must be complete."""
    if factor <= 1:
        raise ValueError("the limit must grow")
    t = nodes.withColumn("marked", F.lit(False))
    while True:
        size = t.select(F.col("id").alias("_pid"), F.col("size").alias("p_size"))
        t = staged(t.join(size, F.col("parent") == F.col("_pid"), "left").drop("_pid"), "thin")
        cut = bottom(t, seen(limit)).select("id", "bottom")
        t = t.drop("p_size")
        if limit > 1:
            return t
        t = staged(t.join(cut, "id"), "thin")
        t = collapse(t).withColumn("marked", F.col("marked") | F.col("bottom")).drop("bottom")
        limit *= factor


def random_cut(nodes: DataFrame, drawn: Column) -> DataFrame:
    """The nodes of a random cut: from the leaves up, two siblings that are both
    in the cut give way to their parent if the first of them is a ``drawn`` leaf
    or came in like this itself. An only child stays."""
    first = F.col("next_sibling") > 0
    levels = Levels(nodes.select("id", "parent", "depth", "child_count", "next_sibling", (drawn & (F.col("child_count") == 0)).alias("_drawn")))
    # of a leaf: it is in the cut, and may be one that gives way; of an inner node both say that it took its children's place
    leaf = F.col("child_count") == 0
    took = F.bool_and("open") & F.bool_or(F.when(first, F.col("gives")).otherwise(F.lit(False))) & (F.count("*") == 2)
    found = up(levels, {"open": leaf, "gives": F.col("_drawn")}, {"open": took, "gives": took})
    above = found.where("open").select(F.col("id").alias("_p"))
    return found.where("open").join(above, F.col("parent") == F.col("_p"), "left_anti")


# -- cuts by a multiplier -------------------------------------------------------


def intervals(nodes: DataFrame, visible: Column, threshold: Column) -> DataFrame:
    """Rows (id, lo, hi): the multipliers m, lo <= m < hi, for which the node is in the
    cut. A node is opened while m is less than its ``threshold``; nodes that
    aren't visible, and all below them, are in no cut."""
    levels = Levels(nodes.select("id", "parent", "depth", "child_count", visible.alias("_visible"), threshold.cast("double").alias("_t")))
    least = F.least(F.col("up_hi"), F.col("up_t"))
    reached = down(levels, {"hi": (F.lit(float("inf")), least), "t": (F.col("_t"), F.col("_t"))}, F.col("_visible"))
    lo = F.when(F.col("child_count") == 0, F.lit(float("-inf"))).otherwise(F.col("_t"))
    return reached.where("_visible").select("id", lo.alias("lo"), "hi").where("lo < hi")


def entries(cut: DataFrame, ranges: DataFrame, distance: DataFrame) -> DataFrame:
    """Rows (id, root, lo, hi, open) of the subtrees' entries: multipliers for which the
    subtree's root is in ``cut`` and min_d < d * m < max_d, d being the
    ``distance`` (root, d). ``open`` says that lo itself isn't in."""
    j = ranges.join(cut.withColumnRenamed("id", "root"), "root").join(distance, "root")
    a, b = F.col("min_d") / F.col("d"), F.col("max_d") / F.col("d")
    far = F.when(F.col("d") > 0, a).when((F.col("min_d") < 0) & (F.col("max_d") > 0), F.lit(float("-inf")))
    near = F.when(F.col("d") > 0, b).when((F.col("min_d") < 0) & (F.col("max_d") > 0), F.lit(float("inf")))
    j = j.withColumns({"_a": far, "_b": near}).where("_a IS NOT NULL")
    inside = j.select("root", j["id"], F.greatest("lo", "_a").alias("lo"), F.least("hi", "_b").alias("hi"), (F.col("_a") >= F.col("lo")).alias("open"))
    return inside.where("lo < hi")


def curve(spans: DataFrame) -> DataFrame:
    """Rows (m, side, n): from multiplier m on (just above it if side is 1) n
    rows are in the cut. ``spans`` has lo, hi and, if some don't hold lo, open."""
    after = F.col("open").cast("int") if "open" in spans.columns else F.lit(0)
    starts = spans.select(F.col("lo").alias("m"), after.alias("side"), F.lit(1).alias("d"))
    ends = spans.select(F.col("hi").alias("m"), F.lit(0).alias("side"), F.lit(-1).alias("d"))
    events = starts.unionByName(ends).groupBy("m", "side").agg(F.sum("d").alias("d"))
    summed = running_sum(events, ["m", "side"], "d", "_before")
    return summed.select("m", "side", (F.col("_before") + F.col("d")).alias("n"))


def sizes_at(cut_curve: DataFrame, multipliers: list[float]) -> list[int]:
    """How many rows the cut has at each multiplier, in one pass over the curve."""
    key = F.struct("m", "side")
    asked = [F.max_by("n", F.when(F.col("m") < m, key).when((F.col("m") == m) & (F.col("side") == 0), key)).alias(f"n{k}") for k, m in enumerate(multipliers)]
    return [n or 0 for n in cut_curve.agg(*asked).first()]


def within_budget(cut_curve: DataFrame, start: float, budget: int, doublings: int = 20, halvings: int = 4) -> tuple[float, int]:
    """The multiplier, and its cut's rows, that fits ``budget``: ``start``
    if that does (or budget is 0 or less), else the first of its doublings, then
    refined by halving towards the last that didn't fit. Rows are never cut off."""
    grid = [start * 2.0**k for k in range(doublings + 1)]
    n = sizes_at(cut_curve, grid)
    fits = next((k for k in range(doublings + 1) if n[k] <= budget or budget <= 0), None)
    if fits is None:
        raise RuntimeError("even the coarsest cut has more rows than the budget")
    if fits == 0:
        return start, n[0]
    low, high, best = grid[fits - 1], grid[fits], n[fits]
    spans = [(low, high)]
    for k in range(halvings):  # all middles that halving may come to
        spans += [s for a, b in spans[2**k - 1 :] for s in ((a, (a + b) / 2), ((a + b) / 2, b))]
    middles = sorted({(a + b) / 2 for a, b in spans[: 2**halvings - 1]})
    count = dict(zip(middles, sizes_at(cut_curve, middles), strict=True))
    for _ in range(halvings):
        middle = (low + high) / 2
        if count[middle] <= budget:
            high, best = middle, count[middle]
        else:
            low = middle
    return high, best
