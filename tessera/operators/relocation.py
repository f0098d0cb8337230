"""Dead leaves of a tree moved below living ones.

A dead leaf's sibling takes their parent's place, and brings its children
along; the two rows that are free then (the dead one and the sibling's old one)
become the two children of a living leaf. Which rows stand where is decided by
joins on ids: chains of promotions are followed by pointer jumping, depths by
summing up the links on the way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import dense_rank
from tessera.session import staged

#: Doublings after which a chain of links must have ended: it has a cycle else.
ROUNDS = 64


def jump(links: DataFrame) -> DataFrame:
    """Rows (id, end, steps) from rows (id, to, w): where a chain of links ends
    (at an id that has no link; null there is an end too) and the sum of w on
    the way. A round doubles what each row has seen of its chain."""
    t = staged(links.select("id", F.col("to").alias("end"), F.col("w").alias("steps"), F.lit(False).alias("done")), "jump")
    for _ in range(ROUNDS):
        onward = t.select(F.col("id").alias("_at"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        j = t.where("NOT done").join(onward, F.col("end") == F.col("_at"), "left")
        moved = j.select("id", F.when(F.col("_at").isNull(), F.col("end")).otherwise(F.col("_end")).alias("end"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"), F.coalesce("_done", F.lit(True)).alias("done"))
        t = staged(t.where("done").unionByName(moved), "jump")
        if not t.where("NOT done").take(1):
            return t.drop("done")
    raise RuntimeError("the links have a cycle")


def sampling_key(weight: Column, seed: int, ident: str = "id") -> Column:
    """A key whose smallest rows are a sample without replacement in proportion
    to ``weight``: an exponential of that rate, drawn from the id and the seed."""
    u = (F.pmod(F.col(ident) * F.lit(48271) + F.lit(seed), F.lit(1000003)) + 1) / F.lit(1000004.0)
    return -F.ln(u) / weight


def chosen_pairs(nodes: DataFrame, dead: Column, order: Column) -> DataFrame:
    """Rows (dead, sibling, parent, target): dead leaves that move, and the
    living leaf below which each goes.

    Of two dead siblings the second is spared, and promoted like a living one.
    Targets are living leaves that are no sibling of a dead one, by ``order``,
    one each; dead leaves are served in the order of their ids, and those
    beyond the number of targets stay where they are.
    """
    n = nodes.where("parent >= 0").select("id", "parent", "child_count", (dead & (F.col("child_count") == 0)).alias("_dead"), order.alias("_order"))
    family = Window.partitionBy("parent")
    spared = (F.min(F.col("_dead").cast("int")).over(family) == 1) & (F.col("id") == F.max("id").over(family))
    n = n.withColumns({"_goes": F.col("_dead") & ~spared, "_kids": F.count("*").over(family)})
    n = staged(n.withColumn("_left", F.max(F.when(~F.col("_goes"), F.col("id"))).over(family)), "dying")
    going = n.where("_goes AND _kids = 2").select(F.col("id").alias("dead"), F.col("_left").alias("sibling"), "parent")
    living = n.where("child_count = 0 AND NOT _dead").join(going.select(F.col("sibling").alias("id")), "id", "left_anti")
    targets = dense_rank(living.select("id", "_order"), ["_order", "id"], "_k").select(F.col("id").alias("target"), "_k")
    return staged(dense_rank(going, ["dead"], "_k").join(targets, "_k").select("dead", "sibling", "parent", "target"), "relocated")


def relocate(nodes: DataFrame, dead: Column, order: Column) -> DataFrame:
    """Rows (id, parent, depth, child_count, first_child, next_sibling, source)
    of the tree after the dead leaves of ``chosen_pairs`` have moved; ``source``
    is the row whose attributes a row takes (its own id if they stay).

    A parent takes over what its promoted child holds, children included; where
    that child has itself taken over another one, the promotions form a chain,
    and the highest row gets what its lowest end holds. Rows that a chain leaves
    free copy their target and become its children. Siblings follow each other
    by id. Nodes have two children or none, as in the trees that are built here;
    a dead leaf without exactly one sibling stays.
    """
    pairs = chosen_pairs(nodes, dead, order)
    content = jump(pairs.select(F.col("parent").alias("id"), F.col("sibling").alias("to"), F.lit(0).alias("w"))).select("id", F.col("end").alias("source"))
    freed = pairs.select(F.col("dead").alias("id"), "target").unionByName(pairs.select(F.col("sibling").alias("id"), "target"))
    base = nodes.select("id", "parent").join(freed.select("id"), "id", "left_anti")
    kept = base.join(content, "id", "left").select("id", "parent", F.coalesce("source", F.col("id")).alias("source"))
    # a chain's content stands in its highest row, the one that no pair frees; children follow it there
    tops = content.join(freed.select("id"), "id", "left_anti").select(F.col("source").alias("_held"), F.col("id").alias("_stands"))
    placed = kept.join(tops, F.col("parent") == F.col("_held"), "left").select("id", F.coalesce("_stands", F.col("parent")).alias("parent"), "source")
    whole = staged(placed.unionByName(freed.select("id", F.col("target").alias("parent"), F.col("target").alias("source"))), "rehung")
    up = F.when(F.col("parent") >= 0, F.col("parent"))
    depth = jump(whole.select("id", up.alias("to"), F.when(up.isNotNull(), 1).otherwise(0).alias("w"))).select("id", F.col("steps").alias("depth"))
    family = Window.partitionBy("parent").orderBy("id")
    zero = F.lit(0).cast("long")
    linked = whole.join(depth, "id").withColumn("next_sibling", F.when(F.col("parent") >= 0, F.coalesce(F.lead("id").over(family), zero)).otherwise(zero))
    kids = whole.where("parent >= 0").groupBy(F.col("parent").alias("_p")).agg(F.count("*").cast("int").alias("child_count"), F.min("id").alias("first_child"))
    return linked.join(kids, F.col("id") == F.col("_p"), "left").select("id", "parent", "depth", F.coalesce("child_count", F.lit(0)).alias("child_count"), F.coalesce("first_child", zero).alias("first_child"), "next_sibling", "source")
