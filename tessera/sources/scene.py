"""A scene put together: posed images with their cameras, a split, a cloud, a frame of reference."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocks import dense_rank
from tessera.sources import ply, reconstruction


class Scene(NamedTuple):
    """``images`` have their camera's columns, centre (cx, cy, cz) and test;
    ``cloud`` is that of the points; ``centre`` and ``radius`` come from the
    training views (all, if there is none)."""

    images: DataFrame
    cloud: DataFrame
    centre: tuple[float, float, float]
    radius: float


def assemble(spark: SparkSession, folder: str, hold: int = 0, test_names: DataFrame | None = None, depths: DataFrame | None = None) -> Scene:
    """The scene in ``folder``, which holds a model's files.

    Every ``hold``th image by name is held out, or those in ``test_names`` (name),
    or none. The cloud is read from points3D.ply; the first time, that file is
    written from the points. ``depths`` (name, scale, offset) are joined to the
    images, with med_scale, the median of all positive scales (0 if there is none). An image without
    a camera is an error when it is read.
    """
    cameras, images, points = reconstruction.read_model(spark, folder)
    joined = reconstruction.join_cameras(images, cameras)
    w, x, y, z = (F.get("qvec", F.lit(k)) for k in range(4))
    t = [F.get("tvec", F.lit(k)) for k in range(3)]
    n = w * w + x * x + y * y + z * z
    r = [[1 - 2 * (y * y + z * z) / n, 2 * (x * y - w * z) / n, 2 * (x * z + w * y) / n], [2 * (x * y + w * z) / n, 1 - 2 * (x * x + z * z) / n, 2 * (y * z - w * x) / n], [2 * (x * z - w * y) / n, 2 * (y * z + w * x) / n, 1 - 2 * (x * x + y * y) / n]]
    centre = {c: -(r[0][k] * t[0] + r[1][k] * t[1] + r[2][k] * t[2]) for k, c in enumerate(("cx", "cy", "cz"))}
    joined = joined.withColumns(centre)
    if hold > 0:
        held = dense_rank(joined.select("name"), ["name"], "_k").where(F.col("_k") % hold == 0).select("name")
    else:
        held = joined.select("name").where(F.lit(False)) if test_names is None else test_names.select("name").distinct()
    joined = joined.join(held.withColumn("_held", F.lit(True)), "name", "left").withColumn("test", F.coalesce("_held", F.lit(False))).drop("_held")
    if depths is not None:
        from tessera.operators.ranks import quantiles

        median = quantiles(depths.where("scale > 0"), F.col("scale"), [0.5])[0] or 0.0
        joined = joined.join(depths.select("name", "scale", "offset"), "name", "left").withColumn("med_scale", F.when(F.col("scale").isNotNull(), F.lit(float(median))))
    path = f"{folder}/points3D.ply"
    if not reconstruction.exists(spark, path):
        at = lambda c, k: F.get(c, F.lit(k))
        ply.write_cloud(points.select(F.col("point3d_id").alias("id"), *[at("xyz", k).alias(c) for k, c in enumerate("xyz")], *[(at("rgb", k) / 255).alias(c) for k, c in enumerate("rgb")]), path)
    train = joined.where("NOT test")
    train = train if train.take(1) else joined
    mean = train.agg(*[F.avg(c) for c in centre]).first()
    middle = tuple(float(v or 0.0) for v in mean)
    far = train.agg(F.max(F.sqrt(sum(((F.col(c) - m) ** 2 for c, m in zip(centre, middle, strict=True)), F.lit(0.0))))).first()[0]
    return Scene(joined, ply.read_cloud(spark, path), middle, 1.1 * float(far or 0.0))
