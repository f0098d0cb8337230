"""Spatial joins and filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frustum_filter(points: DataFrame, clip: list[str], radius: str, always: Column | None = None) -> DataFrame:
    """Points whose sphere is inside or touches the four side planes; one filter, no join."""
    from tessera.functions import expressions as X

    seen = F.expr(X.inside_planes("x", "y", "z", radius, X.planes(clip)))
    return points.where(seen if always is None else seen | always)


def mean_distance2(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("id").agg(F.avg("d2").alias("mean_d2"))


def cross_fade(points: DataFrame, centres: DataFrame, own: Column, band: float = 0.05) -> DataFrame:
    """For each point the distance to its own centre, that to the nearest other
    one, and a weight that falls from 1 to 0 while their ratio goes through
    1 - band to 1 + band. ``centres`` (cam, cx, cy, cz) is a small fixed list."""
    d = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 + (F.col("z") - F.col("cz")) ** 2)
    pairs = points.withColumn("own", own).join(F.broadcast(centres)).withColumn("d", d)
    both = pairs.groupBy("id").agg(F.min(F.when(F.col("cam") == F.col("own"), F.col("d"))).alias("d_own"), F.min(F.when(F.col("cam") != F.col("own"), F.col("d"))).alias("d_other"))
    own_d, other = F.col("d_own"), F.col("d_other")
    between = ((1 + band) * other - own_d) / (2 * band * other)
    return both.withColumn("weight", F.when(other.isNull() | (own_d <= (1 - band) * other), F.lit(1.0)).when(own_d >= (1 + band) * other, F.lit(0.0)).otherwise(between))


def annulus(points: DataFrame, cx: float, cy: float, extent: float, inner: float = 0.5, outer: float = 1.5, always: Column | None = None) -> DataFrame:
    far = F.greatest(F.abs(F.col("x") - cx), F.abs(F.col("y") - cy))
    ring = (far > inner * extent) & (far < outer * extent)
    return points.where(ring if always is None else ring | always)


def silhouette_vote(points: DataFrame, views: DataFrame, limit: float, min_views: int, fraction: float) -> DataFrame:
    """Observed and outside counts of each point over a short list of views
    (cam, cx, cy, cz, looking along +z with unit focal length), and keep. A
    point is observed if it lies before the camera and inside the image, and
    outside if its image lies beyond ``limit`` from the centre."""
    p = points.join(F.broadcast(views)).withColumns({"w": F.col("z") - F.col("cz")})
    p = p.withColumns({"u": F.try_divide(F.col("x") - F.col("cx"), F.col("w")), "v": F.try_divide(F.col("y") - F.col("cy"), F.col("w"))})
    seen = (F.col("w") > 0.01) & (F.abs("u") <= 1) & (F.abs("v") <= 1)
    beyond = seen & (F.col("u") * F.col("u") + F.col("v") * F.col("v") > limit * limit)
    votes = p.groupBy("id").agg(F.count_if(F.coalesce(seen, F.lit(False))).alias("observed"), F.count_if(F.coalesce(beyond, F.lit(False))).alias("outside"))
    gone = (F.col("outside") >= min_views) & (F.col("outside") >= F.lit(float(fraction)) * F.greatest("observed", F.lit(1)))
    return votes.withColumn("keep", ~gone)


def semi(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids, "id", "left_semi")


def anti(points: DataFrame, ids: DataFrame) -> DataFrame:
    return points.join(ids, "id", "left_anti")
