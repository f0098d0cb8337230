import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import blocks, neighbours, stateful, tree


def complete_tree(spark, depth):
    n = 2 ** (depth + 1) - 1
    rows = [(i, (i + 1).bit_length() - 1, (i - 1) // 2 if i else -1, 2 if 2 * i + 2 < n else 0, 2 * i + 1 if 2 * i + 2 < n else 0, i + 1 if i % 2 else 0, 4.0 / 2 ** ((i + 1).bit_length() - 1)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, depth int, parent long, child_count int, first_child long, next_sibling long, size double")


@pytest.mark.parametrize("cell", [7, 20_000])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 120])
def test_knn_equals_brute_force(spark, monkeypatch, n, cell):
    monkeypatch.setattr(neighbours, "CELL", cell)
    monkeypatch.setattr(neighbours, "SAMPLE", 5)
    r = random.Random(n)
    pts = [(k, r.random(), r.choice([0.0, 0.5]), r.gauss(0, 1)) for k in range(n)]
    if n > 5:
        pts[3] = (3, *pts[2][1:])  # the same place twice
    df = spark.createDataFrame(pts, "id long, x double, y double, z double")
    got = {(r["id"], r["rank"]): r["nid"] for r in neighbours.nearest(df, 3).collect()}
    want = {}
    for a in pts:
        near = sorted((sum((u - v) ** 2 for u, v in zip(a[1:], b[1:], strict=True)), b[0]) for b in pts if b[0] != a[0])[:3]
        want |= {(a[0], k): b for k, (_, b) in enumerate(near, 1)}
    assert got == want


def test_cuts_of_a_complete_tree(spark):
    t = complete_tree(spark, 4)
    assert tree.audit(t).first()[:] == (31, 0, 0, 0, 31)
    assert {r["id"] for r in tree.depth_cut(t, 2).collect()} == {3, 4, 5, 6}
    assert {r["id"] for r in tree.size_cut(t, F.lit(1.5)).collect()} == {3, 4, 5, 6}
    cut = {r["id"] for r in tree.predicate_cut(t, F.col("id") != 2, F.col("size") > 1.5).collect()}
    assert cut == {3, 4}
    assert {r["id"] for r in tree.predicate_cut(t, F.lit(True), F.lit(True)).collect()} == set(range(15, 31))


def test_audit_finds_faults(spark):
    t = complete_tree(spark, 2)
    bad = t.withColumn("depth", F.when(F.col("id") == 4, 9).otherwise(F.col("depth"))).withColumn("parent", F.when(F.col("id") == 6, 77).otherwise(F.col("parent")))
    assert tree.audit(bad).first()[:] == (7, 1, 1 + 1, 1, 6)


def test_deep_chain_and_cycle(spark, monkeypatch):
    chain = spark.createDataFrame([(k, k, k - 1, int(k < 20), k + 1, 0, 1.0) for k in range(21)], complete_tree(spark, 0).schema)
    assert tree.descend(chain, F.lit(True)).count() == 21
    monkeypatch.setattr(tree, "DEEPEST", 10)
    with pytest.raises(RuntimeError, match="cycle"):
        tree.descend(chain, F.lit(True))


def test_audit_broadcasts_no_table_and_stops_at_cycles(spark):
    from tessera.session import staged

    t = staged(complete_tree(spark, 5), "tree")
    got = tree.audit(t)
    assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == 0
    assert got.first()[:] == (63, 0, 0, 0, 63)
    # 1 and 3 are each other's parents, 2 hangs below a missing one: what is below them is not reached
    torn = t.withColumn("parent", F.when(F.col("id") == 1, 3).when(F.col("id") == 2, 99).otherwise(F.col("parent")).cast("long"))
    assert tree.audit(torn).first()["reachable"] == 1
    assert [r["id"] for r in tree.rooted(torn).collect()] == [0]
    assert tree.audit(t.limit(0)).first()[:] == (0, 0, 0, 0, 0)


def test_descend_writes_each_level_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(tree, "scratch", lambda s, name, f=tree.scratch: written.append(f(s, name)) or written[-1])
    assert {r["id"] for r in tree.descend(complete_tree(spark, 5), F.lit(True)).collect()} == set(range(63))
    sizes = spark.read.parquet(written[0]).groupBy("reached_at").count().collect()
    assert dict(map(tuple, sizes)) == {k: 1 << k for k in range(6)}


def test_interval_cut_is_a_cut(spark):
    t = complete_tree(spark, 4)
    r = tree.subtree_ranges(t, 1.5, F.col("size"), F.expr("CASE WHEN child_count = 0 THEN -1e9 ELSE size END"))
    roots = r.where("id = root").select("root")
    for d in (0.3, 0.75, 3.0, 1e6):
        cut = tree.interval_cut(r, roots.withColumn("d", F.lit(d))).select("root", "id").collect()
        leaves = {i: i for i in range(15, 31)}
        above = lambda i: {i} | (above((i - 1) // 2) if i else set())
        for leaf in leaves:  # each leaf has one ancestor in the cut
            assert len(above(leaf) & {c["id"] for c in cut}) == 1


def test_roll_up_and_compaction(spark):
    t = complete_tree(spark, 3).select("id", "depth", "parent")
    got = {r["id"]: r["n"] for r in tree.roll_up(t, F.lit(1).cast("long"), F.sum("n") + 1, "n").collect()}
    assert got[0] == 15 and got[1] == 7 and got[14] == 1
    kept = {r["id"]: (r["new_id"], r["new_parent"]) for r in tree.compact(t, F.col("id") % 2 == 0).collect()}
    assert kept[6] == (3, 1) and kept[4] == (2, -1)


def test_ranks_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select(F.expr("(id * 7919) % 1000").alias("k"))
    for n in (1, 7):
        got = blocks.dense_rank(df.repartition(n), ["k"], "pos").collect()
        assert all(r["k"] == r["pos"] for r in got) and len(got) == 1000


def test_largest_remainder_spends_the_budget(spark):
    df = spark.createDataFrame([(k, n) for k, n in enumerate((3, 3, 3, 1))], "b long, n long")
    got = [r["share"] for r in blocks.largest_remainder(df, "b", "n", 7).orderBy("b").collect()]
    assert sum(got) == 7 and got == [2, 2, 2, 1]


def test_frozen_rows_do_not_move(spark):
    df = spark.createDataFrame([(0, 1.0, 0.1, 0.2, 0.5, False), (1, 1.0, 0.1, 0.2, 0.5, True), (2, 1.0, 0.1, 0.2, None, False)], "id long, p double, m double, v double, g double, f boolean")
    got = {r["id"]: r[1:] for r in stateful.adam_step(df, 3, 0.1, F.col("f")).collect()}
    assert got[1] == got[2] == (1.0, 0.1, 0.2) and got[0][1] == pytest.approx(0.14) and got[0][0] < 1


def test_contracts():
    old = {"iterations": 10, "cap": 5, "seed": 1}
    grow = ("iterations", "cap")
    assert stateful.contract_matches(old, dict(old), 4, grow) == (True, False)
    assert stateful.contract_matches(old, old | {"cap": 9}, 4, grow) == (True, True)
    assert stateful.contract_matches(old, old | {"cap": 1}, 4, grow) == (False, False)
    assert stateful.contract_matches(old, old | {"seed": 2}, 4, grow) == (False, False)


def test_downstream_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "before string, after string")
    assert {r["step"] for r in stateful.downstream(edges, spark.createDataFrame([("a",)], "step string")).collect()} == {"a", "b", "c"}


def test_walks_follow_edges_and_repeat(spark):
    edges = spark.createDataFrame([(k, (k + d) % 10, 1.0 + d) for k in range(10) for d in (1, 2, 3)], "src long, dst long, weight double")
    starts = spark.createDataFrame([(k,) for k in range(10)], "node long")
    for mh in (False, True):
        a = {(r["start"], r["step"]): r["node"] for r in stateful.walks(edges, starts, 10, 5, mh).collect()}
        assert a == {(r["start"], r["step"]): r["node"] for r in stateful.walks(edges.repartition(5), starts, 10, 5, mh).collect()}
        assert len(a) == 110
        for (s, k), v in a.items():
            if k:
                assert (v - a[s, k - 1]) % 10 in ((0, 1, 2, 3) if mh else (1, 2, 3))


def test_ssim_of_equal_images_is_one(spark):
    px = spark.range(400).select(F.lit(1).alias("image"), (F.col("id") % 20).alias("x"), F.floor(F.col("id") / 20).alias("y"), F.rand(1).alias("a"))
    assert stateful.ssim_of_images(px.withColumn("b", F.col("a"))).first()["ssim"] == pytest.approx(1.0)
    assert stateful.ssim_of_images(px.withColumn("b", 1 - F.col("a"))).first()["ssim"] < 0.5


def test_workers_find_the_package_by_themselves(tmp_path):
    """A driver in another folder, without PYTHONPATH: workers get the package from the session."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
from tessera.operators import stateful
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
px = s.range(4).select(F.lit(1).alias("image"), "id", (F.col("id") % 2).alias("x"), F.floor(F.col("id") / 2).alias("y"), F.lit(0.5).alias("a"), F.lit(0.5).alias("b"))
from tessera.session import ship
ship(s)
def run(batches):
    from tessera.functions.expressions import SH0
    for b in batches:
        yield b.assign(v=SH0)[["v"]]
assert s.range(1).mapInPandas(run, "v double").first()["v"] > 0.28
assert stateful.ssim_of_images(px).count() == 1
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env, timeout=120, capture_output=True)


def test_staged_tables_are_kept_by_application_and_cleared(spark, tmp_path):
    from tessera import session

    other = session.scratch(spark, "x")
    assert spark.sparkContext.applicationId in other
    df = session.staged(spark.range(5).toDF("id"), "five")
    assert df.count() == 5
    folder = session._own_dir(spark).removeprefix("file://")
    import os

    assert os.path.isdir(folder)
    assert session.clear(spark) and not os.path.isdir(folder)
    assert not session.clear(spark)


def test_walk_schedules_go_on_where_they_stopped(spark):
    edges = spark.createDataFrame([(k * 2, (k + s) % 9 * 2, 1.0 + k) for k in range(9) for s in (1, 2, 5)], "src long, dst long, weight double")
    near = {}
    for r in edges.collect():
        near.setdefault(r["src"], set()).add(r["dst"])
    rows = lambda *a: [tuple(r) for r in stateful.graph_schedule(edges, *a, again=5).orderBy("step").collect()]
    whole = rows(33, 4)
    assert [s for s, _ in whole] == list(range(33)) and whole[0][1] in near[0]
    for (s, a), (_, b) in zip(whole, whole[1:], strict=False):
        assert s % 5 == 0 or b in near[a]
    assert rows(33, 4, 12) == whole[12:] and rows(33, 4, 33) == [] and rows(33, 5) != whole
    with pytest.raises(ValueError, match="neighbour"):
        stateful.graph_schedule(edges.where("src > 0"), 5, 1)
