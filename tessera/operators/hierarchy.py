"""A hierarchy of Gaussians over points: k-d tree, bottom-up merge, top-down alignment.

Nodes have heap numbers: the root is 1, the children of c are 2c and 2c + 1, so
a number says its parent and depth. The top of the tree is split by range
partitions, all cells of a level at once; a cell of at most ``leaf_rows`` points
is finished in one task, down to single points. Nodes are merged pairwise:
weights add up, means and covariances are weighted, the latter around the new
mean, so nothing cancels far from the origin. Only one row a cell is left above
the cells. Rotations are then aligned from the root
down, each with its parent's aligned one: level by level above the cells, in one
task a cell below.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.blocks import dense_rank
from tessera.session import ship, staged

#: Points up to which a cell is finished in one task.
LEAF_ROWS = 20_000
AXES = ("x", "y", "z")
COVARIANCE = ("xx", "xy", "xz", "yy", "yz", "zz")
#: What a point brings besides its id: weight, place, covariance.
POINT = ("w", *AXES, *COVARIANCE)
MEANS, SPREADS = tuple("m" + a for a in AXES), tuple("m" + c for c in COVARIANCE)
BOX = tuple(f"{side}_{a}" for side in ("lo", "hi") for a in AXES)
#: Of a node: points, levels below it, weight, mean, covariance, and the box of its points' spheres.
SUMS = ("n", "height", "w", *MEANS, *SPREADS, *BOX)
ROTATION = tuple(f"r{i}{j}" for i in range(3) for j in range(3))
SCALES = ("s0", "s1", "s2")
_ROWS, _COLS = np.triu_indices(3)


def cells(points: DataFrame, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """``points`` (id, x, y, z and radius) with cell, the heap number of a cell of at most
    ``leaf_rows``: halves along the axis on which the box of all spheres is
    widest (to nine decimals, ties to the first axis, places to the id); of an odd
    number the right half has one more."""
    p = points.withColumn("cell", F.lit(1).cast("long"))
    while True:
        size = p.groupBy("cell").agg(F.count("*").alias("_n"), *[F.round(F.max(F.col(a) + F.col("radius")) - F.min(F.col(a) - F.col("radius")), 9).alias("_w" + a) for a in AXES])
        widest = F.greatest(*[F.col("_w" + a) for a in AXES])
        size = staged(size.withColumn("_axis", F.coalesce(*[F.when(F.col("_w" + a) == widest, F.lit(a)) for a in AXES])).where(F.col("_n") > leaf_rows).select("cell", "_n", "_axis"), "kd-cells")
        if not size.take(1):
            return p
        along = F.coalesce(*[F.when(F.col("_axis") == a, F.col(a)) for a in AXES])
        j = p.join(size, "cell", "left").withColumn("_along", along)
        split = dense_rank(j.where("_n IS NOT NULL"), ["cell", "_along", "id"], "_place")
        first = split.groupBy("cell").agg(F.min("_place").alias("_first"))
        right = (2 * (F.col("_place") - F.col("_first") + 1) > F.col("_n")).cast("long")
        halves = split.join(first, "cell").withColumn("cell", 2 * F.col("cell") + right)
        p = staged(halves.select(*p.columns).unionByName(j.where("_n IS NULL").select(*p.columns)), "kd")


def _finish(cell: int, ids: np.ndarray, at: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Heap numbers of the leaves of the points of one cell."""
    out = np.zeros(len(ids), np.int64)
    todo = [(cell, np.arange(len(ids)))]
    while todo:
        code, rows = todo.pop()
        if len(rows) == 1:
            out[rows] = code
            continue
        part, r = at[rows], radius[rows, None]
        axis = int(np.argmax(((part + r).max(0) - (part - r).min(0)).round(9)))
        rows = rows[np.lexsort((ids[rows], part[:, axis]))]
        half = len(rows) // 2
        todo += [(2 * code, rows[:half]), (2 * code + 1, rows[half:])]
    return out


def _subtree(pdf: pd.DataFrame, also: tuple[str, ...]) -> pd.DataFrame:
    """The nodes of one cell, itself the first, merged from its points up."""
    cell = int(pdf["cell"].iloc[0])
    at, radius = pdf[list(AXES)].to_numpy(float), pdf["radius"].to_numpy(float)
    codes, point = _finish(cell, pdf["id"].to_numpy(), at, radius), pdf["id"].to_numpy()
    counts = np.column_stack([np.ones(len(pdf)), np.zeros(len(pdf))])
    w, mean, more = pdf["w"].to_numpy(float), at, pdf[list(also)].to_numpy(float).reshape(len(pdf), len(also))
    spread, box = pdf[list(COVARIANCE)].to_numpy(float), np.column_stack([at - radius[:, None], at + radius[:, None]])
    state, out = [codes, point, counts, w, mean, spread, box, more], []
    while len(state[0]):
        codes, point, counts, w, mean, spread, box, more = state
        # the deepest nodes are merged in their parents, which join the nodes of the level above
        deep = codes >= 1 << (int(codes.max()).bit_length() - 1)
        out.append([x[deep] for x in state])
        inner = deep & (codes != cell)
        up, of = np.unique(codes[inner] >> 1, return_inverse=True)
        total = lambda x, up=up, of=of: _summed(x, of, len(up))
        wi, whole = w[inner], total(w[inner])
        with np.errstate(divide="ignore", invalid="ignore"):
            centre = total(wi[:, None] * mean[inner]) / whole[:, None]
            off = mean[inner] - centre[of]
            around = total(wi[:, None] * (spread[inner] + off[:, _ROWS] * off[:, _COLS])) / whole[:, None]
            means = total(wi[:, None] * more[inner]) / whole[:, None]
        added = total(counts[inner])
        added[:, 1] = 0
        np.maximum.at(added[:, 1], of, counts[inner, 1] + 1)
        hull = np.column_stack([np.full((len(up), 3), np.inf), np.full((len(up), 3), -np.inf)])
        np.minimum.at(hull[:, :3], of, box[inner, :3])
        np.maximum.at(hull[:, 3:], of, box[inner, 3:])
        new = [up, np.full(len(up), -1), added, whole, centre, around, hull, means]
        state = [np.concatenate([x[~deep], y]) for x, y in zip(state, new, strict=True)]
    codes, point, counts, w, mean, spread, box, more = (np.concatenate(x) for x in zip(*out, strict=True))
    made = pd.DataFrame(np.column_stack([counts, w, mean, spread, box, more]), columns=[*SUMS, *also])
    made.insert(0, "cell", cell)
    made.insert(1, "code", codes)
    made.insert(2, "point", point)
    return made.astype({"n": "int64", "height": "int64"})


def _summed(x: np.ndarray, of: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros((count, *x.shape[1:]))
    np.add.at(out, of, x)
    return out


_NODE = "cell long, code long, point long, n long, height long, " + ", ".join(f"{s} double" for s in SUMS[2:])


def merged(points: DataFrame, leaf_rows: int = LEAF_ROWS, radius: str | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """cell, code, point (its id at a leaf, else -1), SUMS and the weighted means of ``also`` of all
    nodes over ``points`` (id and POINT). Nodes above the cells have the cell 0.

    ``radius`` names the column of the points' spheres, which widen the boxes (0 without it). Rows that
    repeat an id or a place are points of their own; a single point is a root;
    no points make no nodes.
    """
    ship(points.sparkSession)
    spheres = points.select("id", *POINT, (F.lit(0.0) if radius is None else F.col(radius).cast("double")).alias("radius"), *[F.col(c).cast("double").alias(c) for c in also])
    schema = _NODE + "".join(f", {c} double" for c in also)
    split = cells(spheres, leaf_rows).select("id", "cell", *POINT, "radius", *also)
    low = staged(split.groupBy("cell").applyInPandas(lambda pdf: _subtree(pdf, also), schema), "subtrees")
    out, level = low, low.where("code = cell AND code > 1")
    depth = level.agg(F.max(F.length(F.bin("code")))).first()[0] or 1
    for d in range(depth, 1, -1):
        here = F.length(F.bin("code")) == d
        pair = Window.partitionBy("_up")
        rows = level.where(here).withColumn("_up", F.shiftright("code", 1))
        centre = {"_" + a: F.sum(F.col("w") * F.col(a)).over(pair) / F.sum("w").over(pair) for a in MEANS}
        rows = rows.withColumns(centre)
        off = {a: F.col("m" + a) - F.col("_m" + a) for a in AXES}
        weighted = lambda c: F.sum(F.col("w") * c) / F.sum("w")
        sums = {"n": F.sum("n"), "height": F.max("height") + 1, "w": F.sum("w")} | {a: F.max("_" + a) for a in MEANS}
        sums |= {"m" + c: weighted(F.col("m" + c) + off[c[0]] * off[c[1]]) for c in COVARIANCE}
        sums |= {b: (F.min if b.startswith("lo") else F.max)(b) for b in BOX} | {c: weighted(F.col(c)) for c in also}
        up = rows.groupBy("_up").agg(*[v.alias(k) for k, v in sums.items()])
        up = staged(up.select(F.lit(0).cast("long").alias("cell"), F.col("_up").alias("code"), F.lit(-1).cast("long").alias("point"), *SUMS, *also), "upper")
        out, level = out.unionByName(up), level.where(~here).unionByName(up)
    return out


def moments(nodes: DataFrame) -> DataFrame:
    """``nodes`` with the weighted mean x, y, z and the covariance of each."""
    return nodes.withColumns({a: F.col("m" + a) for a in (*AXES, *COVARIANCE)})


def _turns() -> np.ndarray:
    out = []
    for p, s in product(permutations(range(3)), product((1, -1), repeat=3)):
        m = np.zeros((3, 3))
        m[range(3), p] = s
        if np.linalg.det(m) > 0:
            out.append(m)
    return np.array(out)


#: The 24 proper signed axis permutations.
TURNS = _turns()


def shapes(nodes: DataFrame) -> DataFrame:
    """``nodes`` (with moments) with SCALES, ROTATION (proper) and opacity, the
    weight over the surface of the scales."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    ship(nodes.sparkSession)
    added = [*SCALES, *ROTATION, "opacity"]
    schema = StructType([*nodes.schema.fields, *[StructField(a, DoubleType()) for a in added]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = np.zeros((len(pdf), 3, 3))
            c[:, _ROWS, _COLS] = c[:, _COLS, _ROWS] = pdf[list(COVARIANCE)].to_numpy(float)
            values, axes = np.linalg.eigh(c)
            axes[np.linalg.det(axes) < 0, :, 0] *= -1
            s = np.sqrt(np.abs(values))
            surface = s[:, 0] * s[:, 1] + s[:, 0] * s[:, 2] + s[:, 1] * s[:, 2]
            with np.errstate(divide="ignore", invalid="ignore"):
                opacity = pdf["w"].to_numpy(float) / surface
            more = np.column_stack([s, axes.reshape(-1, 9), opacity])
            yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(more, columns=added)], axis=1)

    return nodes.mapInPandas(run, schema)


def _turned(r: np.ndarray, s: np.ndarray, ref: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotations and scales under the turn that brings each nearest to its reference; ties to the first."""
    t = TURNS[np.einsum("nij,tjk,nik->nt", r, TURNS, ref).round(9).argmax(1)]
    return r @ t, np.einsum("nj,njk->nk", s, np.abs(t))


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    """One cell from its root down; the row with the parent of its root, if there is one, is not returned."""
    pdf = pdf.sort_values("code").reset_index(drop=True)
    r, s = pdf[list(ROTATION)].to_numpy(float).reshape(-1, 3, 3), pdf[list(SCALES)].to_numpy(float)
    code = pdf["code"].to_numpy()
    depth = np.array([int(c).bit_length() for c in code])
    for d in range(depth.min() + 1, depth.max() + 1):
        here = np.flatnonzero(depth == d)
        r[here], s[here] = _turned(r[here], s[here], r[np.searchsorted(code, code[here] >> 1)])
    pdf[list(ROTATION)], pdf[list(SCALES)] = r.reshape(-1, 9), s
    return pdf[pdf["cell"] == pdf["cell"].max()] if pdf["_above"].any() else pdf


def align(nodes: DataFrame) -> DataFrame:
    """``nodes`` (of ``shapes``) with rotations and scales turned, from the root
    down, to be nearest to the aligned ones of their parents."""
    kind = nodes.schema
    here = staged(nodes, "shapes")
    upper = here.where("cell = 0")
    depth = upper.agg(F.max(F.length(F.bin("code")))).first()[0] or 0
    done, level = None, None
    for d in range(1, depth + 1):
        rows = upper.where(F.length(F.bin("code")) == d)
        if level is not None:
            ref = level.select(F.col("code").alias("_up"), *[F.col(c).alias("_" + c) for c in ROTATION])
            pairs = rows.join(ref, F.shiftright("code", 1) == F.col("_up"))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    r = pdf[list(ROTATION)].to_numpy(float).reshape(-1, 3, 3)
                    ref = pdf[["_" + c for c in ROTATION]].to_numpy(float).reshape(-1, 3, 3)
                    r, s = _turned(r, pdf[list(SCALES)].to_numpy(float), ref)
                    pdf[list(ROTATION)], pdf[list(SCALES)] = r.reshape(-1, 9), s
                    yield pdf[kind.names]

            rows = pairs.mapInPandas(run, kind)
        level = staged(rows, "aligned")
        done = level if done is None else done.unionByName(level)
    low = here.where("cell > 0").withColumn("_above", F.lit(False))
    if done is not None:
        tops = low.select("cell").distinct().select(F.col("cell").alias("_cell"), F.shiftright("cell", 1).alias("_up"))
        ends = done.join(tops, F.col("code") == F.col("_up")).withColumn("_above", F.lit(True))
        low = low.withColumn("_group", F.col("cell")).unionByName(ends.withColumn("_group", F.col("_cell")).drop("_cell", "_up"))
    else:
        low = low.withColumn("_group", F.col("cell"))
    made = low.groupBy("_group").applyInPandas(lambda pdf: _aligned(pdf)[kind.names], kind)
    return made if done is None else made.unionByName(done)


def quaternions(nodes: DataFrame) -> DataFrame:
    """``nodes`` with qw, qx, qy, qz (qw >= 0) of ROTATION: each part from the
    largest of the four squares."""
    r = {c: F.col(c) for c in ROTATION}
    four = {"w": 1 + r["r00"] + r["r11"] + r["r22"], "x": 1 + r["r00"] - r["r11"] - r["r22"], "y": 1 - r["r00"] + r["r11"] - r["r22"], "z": 1 - r["r00"] - r["r11"] + r["r22"]}
    pair = {"wx": r["r21"] - r["r12"], "wy": r["r02"] - r["r20"], "wz": r["r10"] - r["r01"], "xy": r["r01"] + r["r10"], "xz": r["r02"] + r["r20"], "yz": r["r12"] + r["r21"]}
    out = nodes.withColumns({"_t" + k: v for k, v in four.items()}).withColumn("_big", F.greatest(*["_t" + k for k in "wxyz"]))
    for k in "wxyz":
        term = lambda lead, k=k: F.col("_t" + k) if lead == k else pair["".join(sorted(lead + k, key="wxyz".index))]
        out = out.withColumn("_q" + k, F.coalesce(*[F.when(F.col("_big") == F.col("_t" + lead), term(lead) / (2 * F.sqrt("_t" + lead))) for lead in "wxyz"]))
    sign = F.when(F.col("_qw") < 0, -1.0).otherwise(1.0)
    return out.withColumns({"q" + k: sign * F.col("_q" + k) for k in "wxyz"}).drop("_big", *["_t" + k for k in "wxyz"], *["_q" + k for k in "wxyz"])


def static_tables(built: DataFrame, harmonics: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points and nodes of a static hierarchy's file, from the nodes of ``align``:
    each node has one row among the points, in preorder, and a node's children
    lie side by side. ``harmonics`` are columns, by coefficient and channel;
    missing ones are 0. A node's depth is its height; boxes end with their longest side."""
    from tessera.operators import levels
    from tessera.sources.hierarchies import SH

    here = staged(quaternions(built), "built")
    bits = F.length(F.bin("code"))
    tree = here.select(F.col("code").alias("id"), F.when(F.col("code") > 1, F.shiftright("code", 1)).otherwise(F.lit(-1)).cast("long").alias("parent"), (bits - 1).cast("int").alias("depth"))
    at = staged(levels.linearise(tree).select(F.col("id").alias("code"), F.col("parent").alias("_up"), "preorder", "place", "first_child"), "layout")
    j = here.join(at, "code").join(at.select(F.col("code").alias("_up"), F.col("place").alias("up_place")), "_up", "left")
    real = lambda *c: F.array(*[F.col(x).cast("float") for x in c])
    sh = F.concat(real(*harmonics), F.array_repeat(F.lit(0.0).cast("float"), SH - len(harmonics)))
    points = j.select(F.col("preorder").alias("id"), real(*AXES).alias("xyz"), real("qw", "qx", "qy", "qz").alias("rotation"), F.array(*[F.ln(c).cast("float") for c in SCALES]).alias("scale"), F.col("opacity").cast("float").alias("opacity"), sh.alias("sh"))
    side = F.greatest(*[F.col("hi_" + a) - F.col("lo_" + a) for a in AXES]).cast("float")
    leaf = F.col("first_child") < 0
    corner = lambda s: F.concat(real(*[f"{s}_{a}" for a in AXES]), F.array(side))
    nodes = j.select(F.col("place").alias("id"), F.col("height").alias("depth"), F.coalesce("up_place", F.lit(-1)).alias("parent"), F.col("preorder").alias("start"), leaf.cast("int").alias("count_leafs"), (~leaf).cast("int").alias("count_merged"), F.col("first_child").alias("start_children"), F.when(leaf, 0).otherwise(2).alias("count_children"), corner("lo").alias("box_min"), corner("hi").alias("box_max"))
    return points, nodes
