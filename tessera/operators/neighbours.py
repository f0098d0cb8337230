"""Exact nearest neighbours in cells that follow the density.

A bounded sample of the places builds a tree of median splits, so a cell has
about as many places where they are dense as where they are sparse, and an
outlier costs nothing. Each place first finds its nearest ones in its own cell;
the kth of them bounds its search, and only cells whose box comes closer than
that are searched too. Inside a task cells fall into leaves of a few places,
searched from the nearest box outwards, so a full cell is not quadratic either.
Rows at one and the same place count as one, with its smallest ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship, staged

#: Places of a cell, on average; cells at most; sampled places a cell.
CELL, CELLS, SAMPLE = 20_000, 32_768, 40
#: Places of a leaf, and queries of one cell that a task takes.
LEAF, QUERIES = 24, 50_000


@dataclass
class Tree:
    """Median splits; node k's children are left[k] and left[k] + 1, and leaves have a cell number."""

    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    cell: np.ndarray

    def cells(self, p: np.ndarray) -> np.ndarray:
        """The cell of each place."""
        at = np.zeros(len(p), np.int64)
        while True:
            inner = np.flatnonzero(self.left[at] >= 0)
            if not len(inner):
                return self.cell[at]
            k = at[inner]
            at[inner] = self.left[k] + (p[inner, self.axis[k]] > self.value[k])

    def meets(self, p: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and cells: those that the ball of radius ``far`` around each place may reach into."""
        row, at = np.arange(len(p)), np.zeros(len(p), np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        while len(row):
            leaf = self.left[at] < 0
            out.append((row[leaf], self.cell[at[leaf]]))
            row, at = row[~leaf], at[~leaf]
            x, v = p[row, self.axis[at]], self.value[at]
            low, high = x - far[row] <= v, x + far[row] > v
            row, at = np.concatenate([row[low], row[high]]), np.concatenate([self.left[at][low], self.left[at][high] + 1])
        return np.concatenate([a for a, _ in out]) if out else row, np.concatenate([b for _, b in out]) if out else at


def split(p: np.ndarray, most: int) -> Tree:
    """A tree over the places ``p`` whose leaves have at most ``most`` of them, unless they are equal."""
    axis, value, left, cell = [0], [0.0], [-1], [-1]
    todo, cells = [(0, np.arange(len(p)))], 0
    while todo:
        k, rows = todo.pop()
        wide = np.ptp(p[rows], axis=0) if len(rows) > most else np.zeros(3)
        a = int(wide.argmax())
        x = p[rows, a]
        v = float(np.partition(x, (len(x) - 1) // 2)[(len(x) - 1) // 2]) if len(x) else 0.0
        if wide[a] > 0 and not (x > v).any():  # more than half are the largest: split below them
            v = float(x[x < v].max())
        if wide[a] <= 0:
            cell[k], cells = cells, cells + 1
            continue
        axis[k], value[k], left[k] = a, v, len(axis)
        for side in (rows[x <= v], rows[x > v]):
            axis.append(0)
            value.append(0.0)
            left.append(-1)
            cell.append(-1)
            todo.append((len(axis) - 1, side))
    return Tree(*map(np.array, (axis, value, left, cell)))


def _least(q: np.ndarray, rows: np.ndarray, ids: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of candidates (row, id, d2) the k nearest of each row, ties by id: row, id, d2 in order."""
    order = np.lexsort((ids, d2, rows))
    rows, ids, d2 = rows[order], ids[order], d2[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], ids[keep], d2[keep]


def search(q: np.ndarray, own: np.ndarray, bound: np.ndarray, p: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of the places ``p`` (with ids) to each of ``q``, no farther
    than ``bound`` (squared) and without the id in ``own``: rows, ids, d2."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if not len(q) or not len(p):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    leaf_of = split(p, LEAF).cells(p)
    order = np.argsort(leaf_of, kind="stable")
    p, ids = p[order], ids[order]
    cut = np.concatenate((np.flatnonzero(np.diff(leaf_of[order], prepend=-1)), [len(p)]))
    lo, hi = np.minimum.reduceat(p, cut[:-1]), np.maximum.reduceat(p, cut[:-1])
    block_of = split(q, LEAF).cells(q)
    for block in np.split(np.argsort(block_of, kind="stable"), np.flatnonzero(np.diff(np.sort(block_of))) + 1):
        x = q[block]
        gap = np.maximum(0.0, np.maximum(lo - x.max(0), x.min(0) - hi))
        apart = (gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1]) + gap[:, 2] * gap[:, 2]
        near = np.argsort(apart, kind="stable")
        rows, found, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        limit = bound[block].copy()
        at, step = 0, 8
        while at < len(near) and apart[near[at]] <= limit.max():
            some = near[at : at + step]
            at, step = at + step, step * 2
            some = some[apart[some] <= limit.max()]
            pick = np.concatenate([np.arange(cut[s], cut[s + 1]) for s in some])
            diff = x[:, None] - p[pick][None]
            d2 = (diff[..., 0] * diff[..., 0] + diff[..., 1] * diff[..., 1]) + diff[..., 2] * diff[..., 2]
            r, c = np.nonzero((d2 <= limit[:, None]) & (ids[pick][None] != own[block][:, None]))
            rows, found, d = _least(x, np.concatenate([rows, r]), np.concatenate([found, ids[pick][c]]), np.concatenate([d, d2[r, c]]), k)
            full = np.bincount(rows, minlength=len(x)) >= k
            last = np.zeros(len(x))
            last[rows] = d  # rows ascend and distances within a row: the last is the largest
            limit = np.where(full, np.minimum(limit, last), limit)
        out.append((block[rows], found, d))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def nearest(points: DataFrame, k: int, others: DataFrame | None = None) -> DataFrame:
    """The k nearest other rows of each row: id, nid, d2, rank (ties by id).

    ``points`` and ``others`` have unique ids and x, y, z, which must be finite. With ``others``
    the nearest of those are sought, the row's own id among them if it has it.
    Fewer than k where there are no more rows.
    """
    spark = points.sparkSession
    ship(spark)
    plain = points.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    source = plain if others is None else others.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    # -- places: one a set of equal coordinates, with its k + 1 smallest ids; two steps, so that a common place is dealt out
    salted = Window.partitionBy(*"xyz", "_salt").orderBy("id")
    few = source.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64))).withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= k + 1)
    sites = few.groupBy(*"xyz").agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    sites = staged(sites.select(F.get("ids", F.lit(0)).alias("site"), *"xyz", "ids"), "sites")
    total = sites.count()
    if not total:
        return plain.limit(0).select("id", F.col("id").alias("nid"), F.lit(0.0).alias("d2"), F.lit(1).alias("rank"))
    cells = min(CELLS, -(-total // CELL))
    wanted = cells * max(SAMPLE, k + 1)
    share = min(1.0, 1.2 * wanted / total)
    drawn = sites.where(F.pmod(F.xxhash64("site"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select(*"xyz").collect()  # CELLS * SAMPLE places at most, about
    tree = split(np.array(drawn, float).reshape(-1, 3), max(SAMPLE, k + 1)) if cells > 1 else split(np.zeros((0, 3)), 1)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = tree.cells(np.stack([b.column(c).to_numpy() for c in (1, 2, 3)], 1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at)], names=["site", "x", "y", "z", "cell"])

    held = staged(sites.select("site", *"xyz").mapInArrow(placed, "site long, x double, y double, z double, cell long"), "places")
    if others is None:
        asked = held
    else:
        spots = plain.groupBy(*"xyz").agg(F.min("id").alias("site")).select("site", *"xyz")
        asked = staged(spots.mapInArrow(placed, "site long, x double, y double, z double, cell long"), "asked")
    # a place doesn't meet itself: its own ids are added at the end
    itself = others is None

    def sought(queries: DataFrame) -> DataFrame:
        """site, near, d2 of queries (site, x, y, z, bound, cell) in their cells."""
        # a cell with many queries is searched in parts, each with a copy of its places
        parts = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("_parts"))
        q = queries.join(parts, "cell").withColumn("part", F.pmod(F.xxhash64("site"), F.col("_parts"))).drop("_parts")
        # columns of their own: queries may be places themselves
        h = held.select(*[F.col(c).alias(c) for c in held.columns]).join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts").cast("long") - 1))).drop("_parts")

        def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            own = a["site"].to_numpy() if itself else np.full(len(a), np.iinfo(np.int64).min)
            rows, near, d2 = search(a[["x", "y", "z"]].to_numpy(float), own, a["bound"].to_numpy(float), b[["x", "y", "z"]].to_numpy(float), b["site"].to_numpy(), k)
            return pd.DataFrame({"site": a["site"].to_numpy()[rows], "near": near, "d2": d2})

        return q.groupBy("cell", "part").cogroup(h.groupBy("cell", "part")).applyInPandas(run, "site long, near long, d2 double")

    first = staged(sought(asked.withColumn("bound", F.lit(float("inf")))), "near")
    found = first
    if cells > 1:
        reach = first.groupBy("site").agg(F.count("*").alias("_n"), F.max("d2").alias("_far"))
        edge = asked.join(reach, "site", "left").withColumn("bound", F.when(F.col("_n") == k, F.col("_far")).otherwise(F.lit(float("inf"))))

        def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                p = np.stack([b.column(c).to_numpy() for c in (1, 2, 3)], 1)
                bound = b.column(5).to_numpy()
                row, cell = tree.meets(p, np.nextafter(np.sqrt(bound), np.inf) * (1 + 1e-12))
                keep = cell != b.column(4).to_numpy()[row]
                row, cell = row[keep], cell[keep]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row)) for c in range(4)), b.column(5).take(pa.array(row)), pa.array(cell)], names=["site", "x", "y", "z", "bound", "cell"])

        further = edge.select("site", *"xyz", "cell", "bound").mapInArrow(onward, "site long, x double, y double, z double, bound double, cell long")
        found = first.unionByName(staged(sought(staged(further, "further")), "near"))
    # -- from places back to rows
    own_site = asked.select("site", *"xyz")
    rows = plain.join(own_site, list("xyz")).select("id", "site")
    ids = sites.select(F.col("site").alias("near"), "ids")
    reached = found.select("site", "near", "d2")
    if itself:
        reached = reached.unionByName(asked.select("site", F.col("site").alias("near"), F.lit(0.0).alias("d2")))
    ranked = Window.partitionBy("site").orderBy("d2", "nid")
    each = reached.join(ids, "near").select("site", "d2", F.explode("ids").alias("nid")).withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= k + 1)
    lists = each.groupBy("site").agg(F.sort_array(F.collect_list(F.struct("d2", "nid"))).alias("list"))
    # a row leaves itself out; k of the k + 1 nearest ids of its place are left
    taken = rows.join(staged(lists, "lists"), "site")
    mine = F.filter("list", lambda s: s["nid"] != F.col("id")) if itself else F.col("list")
    out = taken.select("id", F.posexplode(F.slice(mine, 1, k)).alias("_at", "s"))
    return out.select("id", F.col("s.nid").alias("nid"), F.col("s.d2").alias("d2"), (F.col("_at") + 1).alias("rank"))
