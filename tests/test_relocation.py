"""Relocation against a plain pointer-by-pointer version, and audits of the result."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import relocation, tree

SCHEMA = "id long, depth int, parent long, child_count int, first_child long, next_sibling long, dead boolean, o double"


def grown(r, splits):
    """A random binary tree: rows by id."""
    t = {0: dict(depth=0, parent=-1, kids=[])}
    leaves = [0]
    for _ in range(splits):
        p = leaves.pop(r.randrange(len(leaves)))
        for _ in range(2):
            i = len(t)
            t[i] = dict(depth=t[p]["depth"] + 1, parent=p, kids=[])
            t[p]["kids"].append(i)
            leaves.append(i)
    for i, n in t.items():
        n["dead"] = not n["kids"] and r.random() < 0.4
        n["o"] = r.random()
    return t


def frame(spark, t):
    sib = lambda i: next((k for k in t[t[i]["parent"]]["kids"] if k > i), 0) if t[i]["parent"] >= 0 else 0
    return spark.createDataFrame([(i, n["depth"], n["parent"], len(n["kids"]), min(n["kids"], default=0), sib(i), n["dead"], n["o"]) for i, n in t.items()], SCHEMA)


def plain(t):
    """One dead leaf after the other, the deepest first, by pointers."""
    going = {}
    for p in t.values():
        if len(p["kids"]) == 2:
            a, b = p["kids"]
            gone = a if t[a]["dead"] else b if t[b]["dead"] else None
            if gone is not None:
                going[gone] = b if gone == a else a
    free = sorted((n["o"], i) for i, n in t.items() if not n["kids"] and not n["dead"] and n["parent"] >= 0 and i not in going.values())
    pairs = [(d, going[d], t[d]["parent"], target) for d, (_, target) in zip(sorted(going), free, strict=False)]
    out = {i: dict(parent=n["parent"], kids=list(n["kids"]), source=i) for i, n in t.items()}
    for d, s, p, _ in sorted(pairs, key=lambda x: -t[x[0]]["depth"]):
        out[p]["source"], out[p]["kids"] = out[s]["source"], out[s]["kids"]
        for k in out[p]["kids"]:
            out[k]["parent"] = p
    for d, s, _, target in pairs:
        for k in (d, s):
            out[k] = dict(parent=target, kids=[], source=target)
        out[target]["kids"] = [d, s]
    return {i: (n["parent"], n["source"], sorted(n["kids"])) for i, n in out.items()}


@pytest.mark.parametrize("seed", range(6))
def test_relocation_equals_pointers(spark, seed):
    r = random.Random(seed)
    t = grown(r, (0, 1, 5, 20, 60, 60)[seed])
    if seed == 5:  # many chains: every leaf beside an interior node dies
        for n in t.values():
            n["dead"] = not n["kids"] and n["parent"] >= 0 and any(t[k]["kids"] for k in t[n["parent"]]["kids"])
    got = relocation.relocate(frame(spark, t), F.col("dead"), F.col("o"))
    rows = {x["id"]: x for x in got.collect()}
    kids = {}
    for x in rows.values():
        kids.setdefault(x["parent"], []).append(x["id"])
    want = plain(t)
    assert {i: (x["parent"], x["source"], sorted(kids.get(i, []))) for i, x in rows.items()} == want
    audit = tree.audit(spark.createDataFrame(list(rows.values()), got.schema)).first()
    assert audit[:] == (len(t), 0, 0, 0, len(t))


def test_all_dead_and_none(spark):
    t = grown(random.Random(1), 10)
    df = frame(spark, t)
    for dead in (F.lit(True), F.lit(False)):
        got = {x["id"]: (x["parent"], x["source"]) for x in relocation.relocate(df, dead, F.col("o")).collect()}
        assert got == {i: (n["parent"], i) for i, n in t.items()}
    assert relocation.relocate(df.limit(0), F.lit(True), F.col("o")).count() == 0


def test_jump_follows_chains_and_finds_cycles(spark, monkeypatch):
    links = spark.createDataFrame([(k, k + 1, 1) for k in range(37)] + [(100, None, 0)], "id long, to long, w int")
    got = {r["id"]: (r["end"], r["steps"]) for r in relocation.jump(links).collect()}
    assert got == {k: (37, 37 - k) for k in range(37)} | {100: (None, 0)}
    monkeypatch.setattr(relocation, "ROUNDS", 4)
    with pytest.raises(RuntimeError, match="cycle"):
        relocation.jump(spark.createDataFrame([(1, 2, 1), (2, 1, 1)], "id long, to long, w int"))


def test_sampling_follows_the_weights(spark):
    df = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    picked = df.orderBy(relocation.sampling_key(F.col("w"), 5), "id").limit(400).collect()
    heavy = sum(r["w"] == 3.0 for r in picked)
    assert 270 < heavy < 330  # three of four
