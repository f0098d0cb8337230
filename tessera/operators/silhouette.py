"""Silhouettes: masks as pixel tables, exact distances to them, and votes.

A mask is rows (view, u, v, inside). Distances go by columns, then by rows:
along a column the nearest pixel inside comes from two running windows; along a
row the squared distances are the lower envelope of one parabola a pixel, an
array a line, so no task holds more than the lines of its batch. A vote joins
each projected point with the distance at its pixel, by (view, u, v).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Views that are broadcast at a time; more of them are taken in turns.
VIEWS = 1_000


def shrunk(pixels: DataFrame, most: int) -> DataFrame:
    """Pixels (view, u, v, value) of images of at most ``most`` pixels a side,
    each the one under its centre; smaller images stay. The image's size is
    that of its largest u and v."""
    size = pixels.groupBy("view").agg((F.max("u") + 1).alias("_w"), (F.max("v") + 1).alias("_h"))
    j = pixels.join(size, "view")
    long = F.greatest("_w", "_h")
    keep = long <= most
    for c, side in (("u", "_w"), ("v", "_h")):
        new = F.when(keep, F.col(side)).otherwise(F.greatest(F.lit(1), F.floor((F.col(side) * most + long / 2) / long))).cast("long")
        # the one new pixel whose centre may lie in this old one
        at = F.floor((F.col(c) * new * 2 + F.col(side) - 1) / (2 * F.col(side))).cast("long")
        under = F.floor((2 * at + 1) * F.col(side) / (2 * new)) == F.col(c)
        j = j.withColumns({"_new_" + c: at, "_at_" + c: under & (at < new)})
    return j.where("_at_u AND _at_v").select("view", F.col("_new_u").alias("u"), F.col("_new_v").alias("v"), "value")


def envelope(g: np.ndarray) -> np.ndarray:
    """min over j of (i - j)² + g[j] for every i; g may hold infinities."""
    n = len(g)
    js = np.flatnonzero(np.isfinite(g))
    if not len(js):
        return np.full(n, np.inf)
    low, border = [int(js[0])], [-np.inf]
    for j in js[1:].tolist():
        while True:
            i = low[-1]
            meet = ((g[j] + j * j) - (g[i] + i * i)) / (2 * (j - i))
            if meet > border[-1]:
                break
            low.pop()
            border.pop()
        low.append(j)
        border.append(meet)
    at = np.arange(n)
    its = np.array(low)[np.searchsorted(border, at, side="left") - 1]
    return (at - its) ** 2 + g[its]


def distances(mask: DataFrame) -> DataFrame:
    """Rows (view, u, v, d2): squared distance from each pixel to the nearest one
    that is ``inside``, in pixels; infinity if its view has none. Pixels that a
    view doesn't have are passed over; u and v are whole numbers from 0."""
    column = Window.partitionBy("view", "u").orderBy("v")
    hit = F.when(F.col("inside"), F.col("v"))
    before = F.max(hit).over(column.rowsBetween(Window.unboundedPreceding, 0))
    after = F.min(hit).over(column.rowsBetween(0, Window.unboundedFollowing))
    gap = F.least(F.col("v") - before, after - F.col("v")).cast("double")
    by_column = mask.select("view", "u", "v", F.coalesce(gap * gap, F.lit(float("inf"))).alias("g"))
    lines = by_column.groupBy("view", "v").agg(F.sort_array(F.collect_list(F.struct(F.col("u").cast("long").alias("u"), "g"))).alias("line"))
    lines = lines.select("view", "v", F.col("line.u").alias("us"), F.col("line.g").alias("gs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for us, gs in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                full = np.full(us[-1] + 1, np.inf)
                full[us] = gs
                out.append(envelope(full)[us].tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["view", "v", "us", "d2s"])

    view, v = (mask.schema[c].dataType.simpleString() for c in ("view", "v"))
    found = lines.mapInArrow(run, f"view {view}, v {v}, us array<long>, d2s array<double>")
    return found.select("view", "v", F.explode(F.arrays_zip("us", "d2s")).alias("p")).select("view", F.col("p.us").alias("u"), "v", F.col("p.d2s").alias("d2"))


def projected(points: DataFrame, views: DataFrame, radius: Column) -> DataFrame:
    """Rows (id, view, u, v, r): the pixel of each point in each view whose
    image it lies in, before the camera by more than its radius, and the
    projected radius. ``views``: view, r0 to r8 (rows of the rotation), t0 to
    t2, fx, fy, px, py, w, h."""
    names = [f"r{k}" for k in range(9)] + ["t0", "t1", "t2", "fx", "fy", "px", "py", "w", "h"]
    count = views.count()
    parts = [views] if count <= VIEWS else [views.where(F.pmod(F.xxhash64("view"), F.lit(-(-count // VIEWS))) == k) for k in range(-(-count // VIEWS))]
    out = None
    for part in parts:
        j = points.select("id", "x", "y", "z", radius.alias("_r")).join(F.broadcast(part.select("view", *names)))
        j = j.withColumns({c: sum((F.col(f"r{3 * k + i}") * F.col(a) for i, a in enumerate("xyz")), F.col(f"t{k}")) for k, c in enumerate(("_x", "_y", "_z"))})
        j = j.where(F.col("_z") > F.col("_r") + 1e-6)
        a, b = F.col("_x") / F.col("_z"), F.col("_y") / F.col("_z")
        j = j.withColumns({"_u": a * F.col("fx") + F.col("px"), "_v": b * F.col("fy") + F.col("py")})
        j = j.where((F.col("_u") >= 0) & (F.col("_u") < F.col("w")) & (F.col("_v") >= 0) & (F.col("_v") < F.col("h")))
        r = F.greatest("fx", "fy") * F.col("_r") / (F.col("_z") - F.col("_r")) * (1 + F.greatest(F.abs((F.col("_u") - F.col("px")) / F.col("fx")), F.abs((F.col("_v") - F.col("py")) / F.col("fy"))))
        j = j.select("id", "view", F.floor("_u").cast("long").alias("u"), F.floor("_v").cast("long").alias("v"), r.alias("r"))
        out = j if out is None else out.unionByName(j)
    return out


def mask_vote(points: DataFrame, views: DataFrame, mask: DataFrame, radius: Column, margin: float, min_views: int, fraction: float) -> DataFrame:
    """id, observed, outside and keep of every point. A view that a point is
    seen in counts as outside if the silhouette is farther from its pixel than
    its projected radius and ``margin``; a point goes if at least ``min_views``
    views, and the ``fraction`` of those that see it, do. A pixel that the mask
    lacks is no vote against the point."""
    far = distances(mask).withColumn("d", F.sqrt("d2")).drop("d2")
    seen = projected(points, views, radius)
    beyond = F.coalesce(F.col("d") > F.col("r") + margin, F.lit(False))
    votes = seen.join(far, ["view", "u", "v"], "left").groupBy("id").agg(F.count("*").alias("observed"), F.count_if(beyond).alias("outside"))
    every = points.select("id").join(votes, "id", "left").select("id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("observed", "outside")])
    gone = (F.col("outside") >= min_views) & (F.col("outside") >= F.lit(float(fraction)) * F.greatest("observed", F.lit(1)))
    return every.withColumn("keep", ~gone)
