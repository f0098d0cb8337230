"""Tree operators over the node carrier."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import blocks, hierarchy, levels, ranges, relocation, tree
from tessera.plans.carriers import CAMERAS_SQL, NODES, POINTS, cameras, nodes, points
from tessera.plans.registry import query

_D = "sqrt(x*x + y*y + (z + 1e0)*(z + 1e0))"
_VIS = "(x + y + size > -7e-1)"
_FINE = "(size / " + _D + " > 5e-2)"


@query(f"WITH {NODES} SELECT id, depth FROM nodes WHERE child_count = 0")
def leaf_cut(spark, sf_dir):
    return nodes(spark, sf_dir).where("child_count = 0").select("id", "depth")


@query(f"WITH {NODES} SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM nodes WHERE child_count = 0 OR depth < 2")
def leaf_compaction(spark, sf_dir):
    kept = nodes(spark, sf_dir).where("child_count = 0 OR depth < 2").select("id")
    return blocks.dense_rank(kept, ["id"], "new_id")


@query(f"WITH {NODES} SELECT a.id, a.first_child AS first, CASE WHEN a.child_count > 1 THEN f.next_sibling END AS second, true AS valid FROM nodes a JOIN nodes f ON f.id = a.first_child WHERE a.child_count > 0")
def children_join(spark, sf_dir):
    return tree.children(nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT count(*) AS nodes, 0::BIGINT AS bad_child_count, 0::BIGINT AS bad_depth, 0::BIGINT AS orphans, count(*) AS reachable FROM nodes")
def tree_audit(spark, sf_dir):
    return tree.audit(nodes(spark, sf_dir))


@query(f"WITH {NODES} SELECT id FROM nodes WHERE depth = 5 OR (depth < 5 AND child_count = 0)")
def depth_cut(spark, sf_dir):
    return tree.depth_cut(nodes(spark, sf_dir), 5).select("id")


@query(f"WITH {NODES} SELECT n.id, round(n.size, 6) AS size FROM nodes n LEFT JOIN nodes p ON n.parent = p.id WHERE (n.size < 5e-2 AND (p.size IS NULL OR p.size >= 5e-2)) OR (n.child_count = 0 AND n.size >= 5e-2)")
def size_cut(spark, sf_dir):
    return tree.size_cut(nodes(spark, sf_dir), F.lit(0.05)).select("id", F.round("size", 6).alias("size"))


@query(f"WITH RECURSIVE {NODES}, t AS (SELECT * FROM nodes WHERE parent < 0 UNION ALL SELECT c.* FROM nodes c JOIN t ON c.parent = t.id WHERE {_VIS.replace('x', 't.x').replace('y +', 't.y +').replace('size', 't.size')} AND (t.size / sqrt(t.x*t.x + t.y*t.y + (t.z + 1e0)*(t.z + 1e0)) > 5e-2)) SELECT id FROM t WHERE {_VIS} AND (child_count = 0 OR NOT {_FINE})")
def predicate_cut(spark, sf_dir):
    return tree.predicate_cut(nodes(spark, sf_dir), F.expr(_VIS), F.expr(_FINE)).select("id")


_OWN = "CASE WHEN child_count = 0 THEN -1e9 ELSE size * 12e-1 END"
_RANGES = (
    f"WITH RECURSIVE {NODES}, upper AS (SELECT * FROM nodes WHERE parent < 0 UNION ALL SELECT c.* FROM nodes c JOIN upper u ON c.parent = u.id WHERE u.size > 5e-1 AND u.child_count > 0), "
    f"roots AS (SELECT * FROM upper WHERE NOT (size > 5e-1 AND child_count > 0)), "
    f"spt AS (SELECT id AS root, id, depth, child_count, {_OWN} AS min_d, 1e12 AS max_d FROM roots UNION ALL "
    f"SELECT s.root, c.id, c.depth, c.child_count, least({_OWN.replace('child_count', 'c.child_count').replace('size', 'c.size')}, s.min_d), s.min_d FROM nodes c JOIN spt s ON c.parent = s.id)"
)


def _ranges(spark, sf_dir):
    return tree.subtree_ranges(nodes(spark, sf_dir), 0.5, F.col("size"), F.expr(_OWN))


@query(f"{_RANGES} SELECT root, id, depth, round(min_d, 6) AS min_d, round(max_d, 6) AS max_d FROM spt")
def subtree_ranges(spark, sf_dir):
    return _ranges(spark, sf_dir).select("root", "id", "depth", F.round("min_d", 6).alias("min_d"), F.round("max_d", 6).alias("max_d"))


@query(f"{_RANGES} SELECT root, count(*) AS n, min(id) AS first FROM spt GROUP BY root HAVING count(*) > 3")
def spt_partition(spark, sf_dir):
    """Subtrees and their sizes; the small ones belong to the upper tree."""
    return _ranges(spark, sf_dir).groupBy("root").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 3")


@query(f"{_RANGES}, d AS (SELECT id AS root, (id % 9) / 2e1 + 1e-2 AS d FROM roots) SELECT s.root, s.id FROM spt s JOIN d USING (root) WHERE min_d < d AND max_d > d")
def interval_cut(spark, sf_dir):
    r = _ranges(spark, sf_dir)
    d = r.where("id = root").select("root", F.expr("(id % 9) / 2e1 + 1e-2").alias("d"))
    return tree.interval_cut(r, d).select("root", "id")


@query(f"{_RANGES} SELECT root, id, row_number() OVER (PARTITION BY root ORDER BY max_d DESC, id) - 1 AS pos FROM spt")
def spt_sort(spark, sf_dir):
    r = _ranges(spark, sf_dir).select("root", "id", (-F.col("max_d")).alias("less"))
    ranked = blocks.dense_rank(r, ["root", "less", "id"], "place")
    first = ranked.groupBy("root").agg(F.min("place").alias("first"))
    return ranked.join(first, "root").select("root", "id", (F.col("place") - F.col("first")).alias("pos"))


@query(f"{_RANGES}, dirty AS (SELECT DISTINCT root FROM spt JOIN n0 USING (id) WHERE n0.weight > 9.95e2) SELECT root, count(*) AS n FROM spt WHERE root IN (SELECT root FROM dirty) GROUP BY root")
def spt_refresh(spark, sf_dir):
    """The subtrees that own changed rows, which a refresh has to compute again."""
    r = _ranges(spark, sf_dir)
    changed = nodes(spark, sf_dir).where("weight > 9.95e2").select("id")
    dirty = r.join(changed, "id", "left_semi").select("root").distinct()
    return r.join(dirty, "root", "left_semi").groupBy("root").agg(F.count("*").alias("n"))


_SHRUNK = "CASE WHEN weight > 9.95e2 AND depth >= 4 THEN size * 5e-1 ELSE size END"


@query(_RANGES.replace("upper AS (", f"small AS (SELECT * REPLACE ({_SHRUNK} AS size) FROM nodes), upper AS (", 1).replace("SELECT * FROM nodes WHERE parent", "SELECT * FROM small WHERE parent").replace("FROM nodes c", "FROM small c") + " SELECT root, id, depth, round(min_d, 6) AS min_d, round(max_d, 6) AS max_d FROM spt")
def range_refresh(spark, sf_dir):
    """Ranges kept as a table, after a change of some nodes of which it computes the owners' subtrees alone."""
    from tessera.session import scratch

    n = nodes(spark, sf_dir)
    store = ranges.RangeStore(spark, scratch(spark, "range-store"), 0.5, "size", _OWN, buckets=32)
    store.build(n)
    changed = n.where("weight > 9.95e2 AND depth >= 4").withColumn("size", F.expr("size * 5e-1")).withColumn("gone", F.lit(False))
    store.refresh(changed)
    return store.read().select("root", "id", "depth", F.round("min_d", 6).alias("min_d"), F.round("max_d", 6).alias("max_d"))


_UNEVEN = "CASE WHEN child_count = 0 THEN -1e9 ELSE size * (5e-1 + (id % 5) * 5e-1) END"
_UNEVEN_CHILD = _UNEVEN.replace("child_count", "c.child_count").replace("size", "c.size").replace("(id", "(c.id")
_OWN_CHILD = _OWN.replace("child_count", "c.child_count").replace("size", "c.size")


@query(f"{_RANGES.replace(_OWN_CHILD, _UNEVEN_CHILD).replace(_OWN, _UNEVEN)}, q AS (SELECT root, id, depth, min_d, CASE WHEN min_d > max_d - 1e-9 AND max_d < 1e11 THEN max_d * 9e-1 ELSE min_d END AS fixed FROM spt) SELECT id, round(fixed, 6) AS min_d FROM q WHERE fixed <> min_d")
def stuck_revive(spark, sf_dir):
    """Nodes that no distance can show, as their own is not below their parent's, get a smaller min."""
    r = tree.subtree_ranges(nodes(spark, sf_dir), 0.5, F.col("size"), F.expr(_UNEVEN))
    fixed = F.when((F.col("min_d") > F.col("max_d") - 1e-9) & (F.col("max_d") < 1e11), F.col("max_d") * 0.9).otherwise(F.col("min_d"))
    return r.withColumn("fixed", fixed).where("fixed <> min_d").select("id", F.round("fixed", 6).alias("min_d"))


_FAULTY = {"child_count": "CASE WHEN id % 97 = 5 THEN child_count + 1 ELSE child_count END", "depth": "CASE WHEN id % 89 = 6 THEN depth + 3 ELSE depth END", "parent": "CASE WHEN id % 83 = 40 THEN 1000000007 ELSE parent END"}


@query(f"""WITH RECURSIVE {NODES}, f AS (SELECT id, {", ".join(f"{e} AS {c}" for c, e in _FAULTY.items())} FROM nodes), k AS (SELECT parent, count(*) AS n FROM f GROUP BY parent), r AS (SELECT id FROM f WHERE parent < 0 UNION ALL SELECT f.id FROM f JOIN r ON f.parent = r.id)
SELECT count(*) AS nodes, count(*) FILTER (WHERE coalesce(k.n, 0) <> f.child_count) AS bad_child_count, count(*) FILTER (WHERE f.parent >= 0 AND p.depth IS DISTINCT FROM f.depth - 1) AS bad_depth,
count(*) FILTER (WHERE f.parent >= 0 AND p.id IS NULL) AS orphans, (SELECT count(*) FROM r) AS reachable FROM f LEFT JOIN k ON k.parent = f.id LEFT JOIN f p ON p.id = f.parent""")
def tree_faults(spark, sf_dir):
    """The audit of a tree with wrong counts, depths and links in it."""
    return tree.audit(nodes(spark, sf_dir).select("id", "next_sibling", "first_child", *[F.expr(e).cast("long" if c == "parent" else "int").alias(c) for c, e in _FAULTY.items()]))


_DRAWN = "(id * 48271 % 1000003) / 1000003e0 < 9e-1"


@query(f"""WITH RECURSIVE {NODES}, firsts AS (SELECT p.id, p.parent, p.child_count = 0 OR (p.child_count = 2 AND (f.child_count > 0 OR {_DRAWN.replace("id *", "f.id *")})) AS fine FROM nodes p LEFT JOIN nodes f ON p.child_count > 0 AND f.id = p.first_child),
up AS (SELECT id, parent, fine FROM firsts UNION ALL SELECT p.id, p.parent, u.fine FROM up u JOIN firsts p ON u.parent = p.id), o AS (SELECT id, bool_and(fine) AS open FROM up GROUP BY id)
SELECT n.id, n.depth FROM nodes n JOIN o USING (id) LEFT JOIN o p ON p.id = n.parent WHERE o.open AND NOT coalesce(p.open, false)""")
def random_level_cut(spark, sf_dir):
    """All leaves, of which a drawn share gives way with its siblings to the parents, level by level up."""
    return levels.random_cut(nodes(spark, sf_dir), F.expr(_DRAWN)).select("id", "depth")


@query(f"WITH {NODES} SELECT id, round(CASE WHEN parent < 0 THEN 1 ELSE weight / sum(weight) OVER (PARTITION BY parent) END, 6) AS share FROM nodes")
def sibling_weights(spark, sf_dir):
    return tree.sibling_weights(nodes(spark, sf_dir)).select("id", F.round("share", 6).alias("share"))


@query(f"WITH {NODES} SELECT n.id, round({X.interpolation('n.size', 'p.size', '1e-1')}, 6) AS weight FROM nodes n JOIN nodes p ON n.parent = p.id")
def interp_weights(spark, sf_dir):
    j = tree.with_parent(nodes(spark, sf_dir), ["size"]).where("parent >= 0")
    return j.select("id", F.expr(f"round({X.interpolation('size', 'p_size', '1e-1')}, 6)").alias("weight"))


@query(f"WITH {NODES} SELECT n.depth, round(avg(n.size / p.size), 6) AS mean, round(stddev_samp(n.size / p.size), 6) AS sd, count(*) AS n FROM nodes n JOIN nodes p ON n.parent = p.id GROUP BY n.depth")
def size_ratio_stats(spark, sf_dir):
    j = tree.with_parent(nodes(spark, sf_dir), ["size"]).where("parent >= 0").withColumn("r", F.col("size") / F.col("p_size"))
    return j.groupBy("depth").agg(F.round(F.avg("r"), 6).alias("mean"), F.round(F.stddev_samp("r"), 6).alias("sd"), F.count("*").alias("n"))


_MEMBERS = f"WITH RECURSIVE {NODES}, up AS (SELECT id AS leaf, id, parent, x, y, z, size FROM nodes UNION ALL SELECT u.leaf, p.id, p.parent, p.x, p.y, p.z, p.size FROM up u JOIN nodes p ON u.parent = p.id)"


@query(f"{_MEMBERS} SELECT id, count(*) AS members, sum(leaf)::BIGINT AS id_sum FROM up GROUP BY id")
def subtree_rollup(spark, sf_dir):
    """Members and their id sum below each node, leaves first, level by level."""
    n = nodes(spark, sf_dir).select("id", "depth", "parent")
    out = tree.roll_up(n, F.struct(F.lit(1).cast("long").alias("n"), F.col("id").alias("s")), F.struct((F.sum("_agg.n") + 1).alias("n"), (F.sum("_agg.s") + F.max("p_id")).alias("s")), "_agg")
    return out.select("id", F.col("_agg.n").alias("members"), F.col("_agg.s").alias("id_sum"))


@query(f"""WITH RECURSIVE {NODES}, up AS (SELECT id, parent, x, y, z, size AS r FROM nodes UNION ALL SELECT p.id, p.parent, p.x, p.y, p.z, u.r + sqrt(power(u.x - p.x, 2) + power(u.y - p.y, 2) + power(u.z - p.z, 2)) FROM up u JOIN nodes p ON u.parent = p.id)
SELECT id, round(max(r), 6) AS radius FROM up GROUP BY id""")
def bounds_rollup(spark, sf_dir):
    """The radius around each node that holds the spheres of all below it."""
    n = nodes(spark, sf_dir).select("id", "depth", "parent", "x", "y", "z", "size")
    far = F.sqrt((F.col("x") - F.col("p_x")) ** 2 + (F.col("y") - F.col("p_y")) ** 2 + (F.col("z") - F.col("p_z")) ** 2)
    out = tree.roll_up(n, F.col("size"), F.greatest(F.max(F.col("radius") + far), F.max("p_size")), "radius")
    return out.select("id", F.round("radius", 6).alias("radius"))


@query(f"WITH {NODES} SELECT p.id, round(avg(c.x), 6) AS x, round(avg(c.y), 6) AS y, round(avg(c.z), 6) AS z, round(sum(c.size), 12) AS size FROM nodes p JOIN nodes c ON c.parent = p.id GROUP BY p.id")
def average_merge(spark, sf_dir):
    n = nodes(spark, sf_dir).where("parent >= 0")
    return n.groupBy(F.col("parent").alias("id")).agg(*[F.round(F.avg(c), 6).alias(c) for c in "xyz"], F.round(F.sum("size"), 12).alias("size"))


@query(f"""WITH {NODES}, m AS (SELECT parent AS id, sum(weight) AS w, sum(weight * x) / sum(weight) AS mx, sum(weight * y) / sum(weight) AS my, sum(weight * z) / sum(weight) AS mz FROM nodes WHERE parent >= 0 GROUP BY parent)
SELECT m.id, round(mx, 6) AS x, round(my, 6) AS y, round(mz, 6) AS z, round(sum(c.weight / w * (c.size * c.size + (c.x - mx) * (c.x - mx))), 6) AS cxx, round(sum(c.weight / w * (c.x - mx) * (c.y - my)), 6) AS cxy FROM m JOIN nodes c ON c.parent = m.id GROUP BY m.id, mx, my, mz""")
def gaussian_merge(spark, sf_dir):
    """Weighted means of siblings, and covariances around them."""
    w = Window.partitionBy("parent")
    mean = {"m" + c: F.sum(F.col("weight") * F.col(c)).over(w) / F.sum("weight").over(w) for c in "xyz"}
    n = nodes(spark, sf_dir).where("parent >= 0").withColumns(mean).withColumns({"cx": F.expr("x - mx"), "cy": F.expr("y - my")})
    share = lambda e: F.sum(F.expr(f"weight * ({e})")) / F.sum("weight")
    g = n.groupBy(F.col("parent").alias("id")).agg(*[F.max("m" + c).alias(c) for c in "xyz"], share("size * size + cx * cx").alias("cxx"), share("cx * cy").alias("cxy"))
    return g.select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "z", "cxx", "cxy")])


@query(f"WITH {NODES}, {CAMERAS_SQL}, s AS (SELECT n.id, n.child_count, n.size / sqrt(power(n.x - cx, 2) + power(n.y - cy, 2) + power(n.z - cz, 2) + 1e-12) AS a, p.size / sqrt(power(p.x - cx, 2) + power(p.y - cy, 2) + power(p.z - cz, 2) + 1e-12) AS b FROM cams, nodes n LEFT JOIN nodes p ON n.parent = p.id) SELECT id, bool_or((a < 8e-2 AND (b IS NULL OR b >= 8e-2)) OR (child_count = 0 AND a >= 8e-2)) AS seen FROM s GROUP BY id")
def visibility_any(spark, sf_dir):
    j = tree.with_parent(nodes(spark, sf_dir), ["x", "y", "z", "size"]).join(F.broadcast(cameras(spark)))
    far = lambda p: F.expr(f"{p}size / sqrt(power({p}x - cx, 2) + power({p}y - cy, 2) + power({p}z - cz, 2) + 1e-12)")
    a, b = far(""), far("p_")
    seen = ((a < 0.08) & (b.isNull() | (b >= 0.08))) | ((F.col("child_count") == 0) & (a >= 0.08))
    return j.groupBy("id").agg(F.bool_or(seen).alias("seen"))


_STEP_SQL = f"""WITH {NODES}, cut AS (SELECT * FROM nodes WHERE depth = 5 OR (depth < 5 AND child_count = 0)), h AS (SELECT *, size > 125e-3 AND child_count > 0 AS split, weight < 9.8e2 AS shut FROM cut),
up AS (SELECT h.parent AS id FROM h JOIN nodes p ON h.parent = p.id WHERE NOT split AND shut GROUP BY h.parent, p.child_count HAVING count(*) = p.child_count)
SELECT id FROM h WHERE NOT split AND parent NOT IN (SELECT id FROM up) UNION ALL SELECT c.id FROM nodes c JOIN h ON c.parent = h.id WHERE h.split UNION ALL SELECT id FROM up"""


@query(_STEP_SQL)
def incremental_cut(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return tree.step_cut(n, tree.depth_cut(n, 5).select("id"), F.col("size") > 0.125, F.col("weight") < 9.8e2)


@query(f"WITH {NODES}, g(target) AS (VALUES (1e0), (5e-1), (25e-2), (12e-2), (6e-2), (3e-2)), c AS (SELECT target, count(*) AS n FROM g, nodes n LEFT JOIN nodes p ON n.parent = p.id WHERE (n.size < target AND (p.size IS NULL OR p.size >= target)) OR (n.child_count = 0 AND n.size >= target) GROUP BY target) SELECT target, n FROM c WHERE n <= 150 ORDER BY target LIMIT 1")
def budgeted_cut(spark, sf_dir):
    return tree.budgeted_target(nodes(spark, sf_dir), [1.0, 0.5, 0.25, 0.12, 0.06, 0.03], 150)


@query(f"WITH {NODES} SELECT CASE WHEN (n.parent * 7919) % 100 < 30 AND n.parent >= 0 AND NOT EXISTS (SELECT 1 FROM nodes s WHERE s.parent = n.parent AND s.child_count > 0) THEN n.parent ELSE n.id END AS id, count(*) AS n FROM nodes n WHERE n.child_count = 0 GROUP BY 1")
def random_cut(spark, sf_dir):
    """All leaves, of which a hashed share of sibling pairs gives way to their parents."""
    n = nodes(spark, sf_dir)
    inner = n.where("child_count > 0").select(F.col("parent").alias("_p")).distinct()
    leaves = n.where("child_count = 0").join(inner, F.col("parent") == F.col("_p"), "left")
    up = ((F.col("parent") * 7919) % 100 < 30) & (F.col("parent") >= 0) & F.col("_p").isNull()
    return leaves.groupBy(F.when(up, F.col("parent")).otherwise(F.col("id")).alias("id")).agg(F.count("*").alias("n"))


@query(f"WITH {NODES}, c AS (SELECT id, depth, row_number() OVER (ORDER BY id) - 1 AS k FROM nodes WHERE child_count = 0 AND weight > 9.3e2) SELECT 1000000 + 2 * k + s AS id, id AS parent, (depth + 1)::INT AS depth, CASE WHEN s = 0 THEN 1000000 + 2 * k + 1 ELSE 0 END AS next_sibling FROM c, (VALUES (0), (1)) v(s)")
def node_split(spark, sf_dir):
    return tree.split_nodes(nodes(spark, sf_dir), F.col("weight") > 9.3e2, 1_000_000)


@query(f"WITH {NODES}, k AS (SELECT id, parent, row_number() OVER (ORDER BY id) - 1 AS new_id FROM nodes WHERE weight < 9.7e2) SELECT a.id, a.new_id, coalesce(b.new_id, -1) AS new_parent FROM k a LEFT JOIN k b ON a.parent = b.id")
def active_compaction(spark, sf_dir):
    return tree.compact(nodes(spark, sf_dir), F.col("weight") < 9.7e2)


@query(f"WITH {NODES}, d AS (SELECT *, child_count = 0 AND weight > 9.6e2 AS dd FROM nodes), e AS (SELECT *, dd AND NOT (row_number() OVER (PARTITION BY parent ORDER BY id) = 1 AND bool_and(dd) OVER (PARTITION BY parent)) AS dead FROM d), f AS (SELECT *, count(*) FILTER (WHERE NOT dead) OVER (PARTITION BY parent) AS alive FROM e) SELECT id, parent, alive = 1 AND parent >= 0 AS promoted FROM f WHERE NOT dead")
def relocate_dead(spark, sf_dir):
    return tree.relocate(nodes(spark, sf_dir), F.col("weight") > 9.6e2)


_MOVED = f"""WITH RECURSIVE {NODES}, n AS (SELECT id, parent, child_count, child_count = 0 AND weight > 9.6e2 AS dd, -ln(((id * 48271 + 7) % 1000003 + 1) / 1000004e0) / weight AS o FROM nodes WHERE parent >= 0),
f AS (SELECT *, dd AND NOT (bool_and(dd) OVER w AND id = max(id) OVER w) AS goes, count(*) OVER w AS kids FROM n WINDOW w AS (PARTITION BY parent)),
h AS (SELECT *, max(id) FILTER (WHERE NOT goes) OVER (PARTITION BY parent) AS sib FROM f),
going AS (SELECT id AS dead, sib, parent, row_number() OVER (ORDER BY id) AS k FROM h WHERE goes AND kids = 2),
tg AS (SELECT id AS target, row_number() OVER (ORDER BY o, id) AS k FROM h WHERE child_count = 0 AND NOT dd AND id NOT IN (SELECT sib FROM going)),
pairs AS (SELECT dead, sib, parent, target FROM going JOIN tg USING (k)),
chain AS (SELECT parent AS id, sib AS src FROM pairs UNION ALL SELECT c.id, p.sib FROM chain c JOIN pairs p ON c.src = p.parent),
content AS (SELECT id, src FROM chain WHERE src NOT IN (SELECT parent FROM pairs)),
freed AS (SELECT dead AS id, target FROM pairs UNION ALL SELECT sib, target FROM pairs),
tops AS (SELECT id AS stands, src AS held FROM content WHERE id NOT IN (SELECT id FROM freed)),
whole AS (SELECT n0.id, coalesce(t.stands, n0.parent) AS parent, coalesce(c.src, n0.id) AS source FROM n0 LEFT JOIN content c ON c.id = n0.id LEFT JOIN tops t ON t.held = n0.parent
  WHERE n0.id NOT IN (SELECT id FROM freed) UNION ALL SELECT id, target, target FROM freed),
deep AS (SELECT id, 0 AS depth FROM whole WHERE parent < 0 UNION ALL SELECT w.id, d.depth + 1 FROM whole w JOIN deep d ON w.parent = d.id),
kids AS (SELECT parent, count(*)::INT AS child_count, min(id) AS first_child FROM whole WHERE parent >= 0 GROUP BY parent)
SELECT w.id, w.parent, d.depth, coalesce(k.child_count, 0)::INT AS child_count, coalesce(k.first_child, 0)::BIGINT AS first_child,
CASE WHEN w.parent < 0 THEN 0 ELSE coalesce(lead(w.id) OVER (PARTITION BY w.parent ORDER BY w.id), 0) END::BIGINT AS next_sibling, w.source
FROM whole w JOIN deep d USING (id) LEFT JOIN kids k ON k.parent = w.id"""


@query(_MOVED[: _MOVED.index("chain AS")].rstrip().rstrip(",") + " SELECT dead, sib AS sibling, parent, target FROM pairs")
def relocation_pairs(spark, sf_dir):
    """Dead leaves that move, never both of two siblings, and the living leaf each goes below."""
    return relocation.chosen_pairs(nodes(spark, sf_dir), F.col("weight") > 9.6e2, relocation.sampling_key(F.col("weight"), 7))


@query(_MOVED)
def relocate_tree(spark, sf_dir):
    """The whole tree after dead leaves were moved below sampled living ones."""
    return relocation.relocate(nodes(spark, sf_dir), F.col("weight") > 9.6e2, relocation.sampling_key(F.col("weight"), 7))


@query(f"WITH {NODES}, p AS (SELECT *, child_count = 0 AND weight > 9.5e2 AS dead FROM nodes) SELECT parent, count(*) FILTER (WHERE dead) AS dead, max(id) FILTER (WHERE dead) AS last FROM p WHERE parent >= 0 GROUP BY parent HAVING count(*) FILTER (WHERE dead) > 0")
def sibling_exclusion(spark, sf_dir):
    n = nodes(spark, sf_dir).where("parent >= 0").withColumn("dead", F.expr("child_count = 0 AND weight > 9.5e2"))
    return n.groupBy("parent").agg(F.count_if("dead").alias("dead"), F.max(F.when(F.col("dead"), F.col("id"))).alias("last")).where("dead > 0")


@query(f"WITH {NODES}, t AS (SELECT max(id) + 1 AS n FROM nodes) SELECT id + 1 AS id, CASE WHEN parent < 0 THEN 0 ELSE parent + 1 END AS parent, (depth + 1)::INT AS depth FROM nodes UNION ALL SELECT id + 1 + n, CASE WHEN parent < 0 THEN 0 ELSE parent + 1 + n END, (depth + 1)::INT FROM nodes, t UNION ALL SELECT 0, -1, 0")
def chunk_merge(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return tree.merge_chunks([n, n])


@query(f"WITH RECURSIVE {NODES}, w AS (SELECT id, first_child, depth, [id] AS path FROM nodes WHERE parent < 0 UNION ALL SELECT c.id, c.first_child, c.depth, list_append(w.path, c.id) FROM nodes c JOIN w ON c.parent = w.id) SELECT id, row_number() OVER (ORDER BY path) - 1 AS preorder FROM w")
def linearise(spark, sf_dir):
    """Depth-first places, from the path of ids as a sort key."""
    n = nodes(spark, sf_dir).select("id", "parent", "child_count")
    step = F.lpad(F.hex("id"), 12, "0")
    walked = tree.descend(n, F.col("child_count") > 0, {"path": (step, F.concat("up_path", step))})
    return blocks.dense_rank(walked.select("id", "path"), ["path"], "preorder").select("id", "preorder")


@query(f"WITH {NODES}, m AS (SELECT id, parent, child_count, weight < 9.8e2 AS marked FROM nodes) SELECT a.id FROM m a WHERE a.marked AND NOT EXISTS (SELECT 1 FROM m c WHERE c.parent = a.id AND c.marked)")
def bottom_cut(spark, sf_dir):
    """Marked nodes none of whose children is marked."""
    m = nodes(spark, sf_dir).where("weight < 9.8e2")
    return m.select("id").join(m.select(F.col("parent").alias("id")), "id", "left_anti")


@query(f"""WITH RECURSIVE {NODES}, w AS (SELECT id, parent, depth, [id] AS path FROM nodes WHERE parent < 0 UNION ALL SELECT c.id, c.parent, c.depth, list_append(w.path, c.id) FROM nodes c JOIN w ON c.parent = w.id),
up AS (SELECT id, parent FROM nodes UNION ALL SELECT p.id, p.parent FROM up u JOIN nodes p ON u.parent = p.id), m AS (SELECT id, count(*) AS subtree FROM up GROUP BY id),
o AS (SELECT w.id, w.parent, w.depth, subtree, child_count, row_number() OVER (ORDER BY path) - 1 AS preorder, row_number() OVER (PARTITION BY w.parent ORDER BY w.id) - 1 AS nth, lead(w.id) OVER (PARTITION BY w.parent ORDER BY w.id) AS after FROM w JOIN m USING (id) JOIN nodes USING (id)),
f AS (SELECT *, CASE WHEN child_count > 0 THEN 1 + coalesce(sum(child_count) OVER (ORDER BY preorder ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE -1 END::BIGINT AS first_child FROM o)
SELECT f.id, f.parent, f.depth, f.preorder, f.subtree, CASE WHEN f.after IS NULL OR f.parent < 0 THEN 0 ELSE f.preorder + f.subtree END AS next_sibling, coalesce(p.first_child, 0) + f.nth AS place, f.first_child FROM f LEFT JOIN f p ON f.parent = p.id""")
def tree_layout(spark, sf_dir):
    """Both orders in which a tree is written out, from subtree sizes and offsets."""
    return levels.linearise(nodes(spark, sf_dir))


_CUT = "(size < 5e-2 AND (p_size IS NULL OR p_size >= 5e-2)) OR (child_count = 0 AND size >= 5e-2)"
_SEEN = f"s AS (SELECT n.*, ({_CUT.replace('size', 'n.size').replace('p_n.size', 'p.size').replace('child_count', 'n.child_count')}) AS seen FROM nodes n LEFT JOIN nodes p ON n.parent = p.id)"
_BOTTOM = f"""WITH RECURSIVE {NODES}, {_SEEN}, up AS (SELECT id AS leaf, id, parent, seen AS hit FROM s WHERE child_count = 0 UNION ALL SELECT u.leaf, p.id, p.parent, u.hit OR p.seen FROM up u JOIN s p ON u.parent = p.id),
c AS (SELECT id, bool_and(hit) AS covered FROM up GROUP BY id), k AS (SELECT s.parent AS id, count(*) FILTER (WHERE covered) AS n FROM s JOIN c USING (id) GROUP BY s.parent),
b AS (SELECT s.*, covered, seen AND coalesce(n, 0) = 0 AS bottom FROM s JOIN c USING (id) LEFT JOIN k USING (id))"""


@query(f"{_BOTTOM} SELECT id, covered, bottom FROM b")
def cut_bottom(spark, sf_dir):
    """What a cut covers and its lowest nodes; an incomplete cut is an error."""
    n = tree.with_parent(nodes(spark, sf_dir), ["size"])
    return levels.bottom(n, F.expr(_CUT))


_MARKED = "((id * 7919) % 10 < 3)"


@query(f"""{_BOTTOM}, m AS (SELECT *, {_MARKED} AS marked FROM b), t AS (SELECT id AS of, id, parent, marked OR bottom OR child_count = 0 AS stop, bottom AND NOT marked AND child_count > 0 AS opens FROM m
UNION ALL SELECT t.of, p.id, p.parent, p.marked OR p.bottom OR p.child_count = 0, p.bottom AND NOT p.marked AND p.child_count > 0 FROM t JOIN m p ON t.parent = p.id WHERE NOT t.stop),
g AS (SELECT of AS id, id AS top FROM t WHERE stop AND opens AND of <> id), kept AS (SELECT m.*, coalesce(g.top, m.parent) AS np FROM m LEFT JOIN g ON g.id = m.parent WHERE m.id NOT IN (SELECT id FROM g)),
d AS (SELECT id, 0 AS depth FROM kept WHERE np < 0 UNION ALL SELECT k.id, d.depth + 1 FROM kept k JOIN d ON k.np = d.id), n AS (SELECT np, count(*)::INT AS n FROM kept GROUP BY np)
SELECT k.id, k.np AS parent, d.depth, coalesce(n.n, 0)::INT AS child_count, k.marked, k.bottom FROM kept k JOIN d USING (id) LEFT JOIN n ON n.np = k.id""")
def collapse_tree(spark, sf_dir):
    """The tree without unmarked interiors below a cut, contracted to the nearest marked ones."""
    n = nodes(spark, sf_dir)
    cut = levels.bottom(tree.with_parent(n, ["size"]), F.expr(_CUT)).select("id", "bottom")
    t = n.join(cut, "id").select("id", "parent", "depth", "child_count", F.expr(_MARKED).alias("marked"), "bottom")
    return levels.collapse(t)


@query(f"WITH RECURSIVE {NODES}, t AS (SELECT id, {_MARKED} AND depth > 2 AS hit FROM nodes WHERE parent < 0 UNION ALL SELECT c.id, t.hit OR (((c.id * 7919) % 10 < 3) AND c.depth > 2) FROM nodes c JOIN t ON c.parent = t.id) SELECT id FROM t WHERE hit")
def below_marked(spark, sf_dir):
    return levels.below(nodes(spark, sf_dir), F.expr(f"{_MARKED} AND depth > 2")).select("id")


@query(None)
def thin_tree(spark, sf_dir):
    """Nodes that are left when the cuts at growing limits have each been contracted."""
    seen = lambda limit: F.expr(f"(size < {limit!r}D AND (p_size IS NULL OR p_size >= {limit!r}D)) OR (child_count = 0 AND size >= {limit!r}D)")
    return levels.thinned(nodes(spark, sf_dir), 0.02, 5.0, seen).select("id", "parent", "depth", "child_count", "marked")


_T = "power(size * 2e0, 2) / (x*x + y*y + (z + 1e0)*(z + 1e0))"
_SPANS = f"""WITH RECURSIVE {NODES}, v AS (SELECT id, parent, child_count, {_VIS} AS vis, {_T} AS t FROM nodes), r AS (SELECT *, 'inf'::DOUBLE AS hi FROM v WHERE parent < 0
UNION ALL SELECT v.*, least(r.hi, r.t) FROM v JOIN r ON v.parent = r.id WHERE r.vis), iv AS (SELECT id, CASE WHEN child_count = 0 THEN '-inf'::DOUBLE ELSE t END AS lo, hi FROM r WHERE vis AND (child_count = 0 OR t < hi) AND (child_count > 0 OR hi > '-inf'::DOUBLE))"""


def _spans(spark, sf_dir):
    return levels.intervals(nodes(spark, sf_dir), F.expr(_VIS), F.expr(_T))


@query(f"""{_SPANS}, e AS (SELECT lo AS m, 1 AS d FROM iv UNION ALL SELECT hi, -1 FROM iv), g AS (SELECT m, sum(d) AS d FROM e GROUP BY m),
u AS (SELECT m, (sum(d) OVER (ORDER BY m))::BIGINT AS n FROM g) SELECT round(m, 9) AS m, n FROM u WHERE isfinite(m)""")
def cut_curve(spark, sf_dir):
    """How many rows the cut has for every multiplier, from one sweep."""
    c = levels.curve(_spans(spark, sf_dir))
    return c.where((F.col("m") < float("inf")) & (F.col("m") > float("-inf"))).select(F.round("m", 9).alias("m"), F.col("n").cast("long").alias("n"))


@query(f"""{_SPANS}, g AS (SELECT k, 1e-3 * power(2e0, k) AS m FROM range(21) q(k)), n AS (SELECT k, m, count(iv.id) AS n FROM g LEFT JOIN iv ON lo <= m AND m < hi GROUP BY k, m), f AS (SELECT min(k) AS k FROM n WHERE n <= 60),
s AS (SELECT 0 AS step, a.m AS lo, b.m AS hi FROM f JOIN n a ON a.k = f.k - 1 JOIN n b ON b.k = f.k
UNION ALL SELECT step + 1, CASE WHEN c <= 60 THEN lo ELSE mid END, CASE WHEN c <= 60 THEN mid ELSE hi END FROM (SELECT s.step, s.lo, s.hi, (s.lo + s.hi) / 2 AS mid, (SELECT count(*) FROM iv WHERE iv.lo <= (s.lo + s.hi) / 2 AND (s.lo + s.hi) / 2 < iv.hi) AS c FROM s WHERE step < 4))
SELECT hi AS multiplier, (SELECT count(*) FROM iv WHERE iv.lo <= s.hi AND s.hi < iv.hi) AS n FROM s WHERE step = 4""")
def budget_search(spark, sf_dir):
    """The multiplier that fits 60 rows: doubled from 0.001, then halved back four times."""
    from tessera.session import staged

    m, n = levels.within_budget(staged(levels.curve(_spans(spark, sf_dir)), "curve"), 1e-3, 60)
    return spark.createDataFrame([(m, n)], "multiplier double, n long")


#: A point's sphere: three times its largest axis.
RADIUS = "3e0 * exp(greatest(s0, s1, s2))"


def kd_full_sql(points: str, levels: int = 14) -> str:
    """Common tables k<levels> of id and leaf (cell) of every row of ``points``, of at most 2 ** levels rows."""
    out = [f"k0 AS (SELECT id, x, y, z, {RADIUS} AS r, 1::BIGINT AS cell FROM {points})"]
    for k in range(levels):
        wide = ", ".join(f"round(max({a} + r) OVER c - min({a} - r) OVER c, 9) AS w{a}" for a in "xyz")
        out.append(
            f"w{k} AS (SELECT *, {wide}, count(*) OVER c AS n FROM k{k} WINDOW c AS (PARTITION BY cell)), "
            f"a{k} AS (SELECT *, CASE WHEN wx >= wy AND wx >= wz THEN x WHEN wy >= wz THEN y ELSE z END AS v FROM w{k}), "
            f"k{k + 1} AS (SELECT id, x, y, z, r, CASE WHEN n = 1 THEN cell ELSE 2 * cell + CASE WHEN 2 * row_number() OVER (PARTITION BY cell ORDER BY v, id) > n THEN 1 ELSE 0 END END AS cell FROM a{k})"
        )
    return ", ".join(out)


@query(f"WITH {POINTS}, {kd_full_sql('pts', 1)} SELECT id, cell FROM k1")
def median_split(spark, sf_dir):
    return tree.kd_levels(points(spark, sf_dir), 1, radius=F.expr(RADIUS)).select("id", "cell")


@query(f"WITH {POINTS}, {kd_full_sql('pts')} SELECT id, cell FROM k14")
def kd_build(spark, sf_dir):
    """Each point's leaf: halves along the axis on which the spheres' box is widest, down to single points."""
    p = points(spark, sf_dir).select("id", *hierarchy.AXES, F.expr(RADIUS).alias("r"))
    zero = F.lit(0.0)
    nodes = hierarchy.merged(p.withColumns({"w": F.lit(1.0)} | dict.fromkeys(hierarchy.COVARIANCE, zero)), radius="r")
    return nodes.where("height = 0").select(F.col("point").alias("id"), F.col("code").alias("cell"))


@query(f"WITH {NODES}, j AS (SELECT n.id, n.x, n.y, n.z, n.size, p.x AS px, p.y AS py, p.z AS pz, p.size AS ps FROM nodes n JOIN nodes p ON n.parent = p.id), s AS (SELECT j.*, (i * 754877666 % 1000) / 5e2 - 1 AS a, (i * 569840291 % 1000) / 5e2 - 1 AS b, (i * 430159709 % 1000) / 5e2 - 1 AS c FROM j, range(64) r(i)) SELECT id, avg(CASE WHEN power(x + a * size - px, 2) + power(y + b * size - py, 2) + power(z + c * size - pz, 2) > ps * ps THEN 1e0 ELSE 0e0 END) AS outside FROM s GROUP BY id")
def sphere_divergence(spark, sf_dir):
    """The share of sample points of a child's box that lie outside the parent's sphere; samples from a fixed lattice."""
    j = tree.with_parent(nodes(spark, sf_dir), ["x", "y", "z", "size"]).where("parent >= 0")
    s = j.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")))).withColumns({n: F.expr(f"(i * {m} % 1000) / 5e2 - 1") for n, m in (("a", 754877666), ("b", 569840291), ("c", 430159709))})
    out = F.expr("power(x + a * size - p_x, 2) + power(y + b * size - p_y, 2) + power(z + c * size - p_z, 2) > p_size * p_size")
    return s.groupBy("id").agg(F.avg(F.when(out, 1.0).otherwise(0.0)).alias("outside"))
