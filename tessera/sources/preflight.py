"""Checks of a dataset's tables before anything is built on them.

Each fault is a row: what kind it is, and which image or camera has it. The
tables stand for a reconstruction's cameras and images, the image files' sizes
and those of the masks. A fingerprint of all rows doesn't depend on their order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How far the shapes of an image and its camera may differ.
ASPECT = 1e-3
#: Parameters that are focal lengths, of each model that is read.
FOCALS = {"PINHOLE": 2, "SIMPLE_PINHOLE": 1}


def _finite(c: Column) -> Column:
    return F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))


def _leaves(name: Column) -> Column:
    """Whether a relative path ends up outside the folder it starts in."""
    steps = F.filter(F.split(name, "/"), lambda s: (s != "") & (s != "."))
    depth = F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(False).alias("out")), lambda a, s: F.struct((a["at"] + F.when(s == "..", -1).otherwise(1)).alias("at"), (a["out"] | ((s == "..") & (a["at"] == 0))).alias("out")))
    return name.startswith("/") | depth["out"]


def faults(cameras: DataFrame, images: DataFrame, files: DataFrame, masks: DataFrame | None = None) -> DataFrame:
    """Rows (kind, image, camera) of everything that is wrong.

    ``cameras``: camera_id, model, width, height, params; ``images``: name,
    camera_id, qvec, tvec; ``files`` and ``masks``: name, width, height.
    Kinds: no_cameras, no_images, model, size, parameter, focal (cameras); pose,
    dangling, path, missing, aspect, mask_size (images).
    """
    spark = cameras.sparkSession
    first = F.slice("params", 1, F.coalesce(*[F.when(F.col("model") == m, F.lit(n)) for m, n in FOCALS.items()], F.lit(0)))
    known = F.coalesce(F.col("model").isin(*FOCALS), F.lit(False))
    wrong = lambda c: ~F.coalesce(c, F.lit(False))
    camera = {"model": ~known, "size": wrong((F.col("width") > 0) & (F.col("height") > 0)), "parameter": wrong(_finite(F.col("params"))), "focal": known & wrong(F.forall(first, lambda v: v > 0) & (F.size(first) > 0))}
    of_cameras = cameras.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in camera.items()]), lambda k: k.isNotNull())).alias("kind"), F.lit(None).cast("string").alias("image"), F.col("camera_id").cast("long").alias("camera"))
    cam = cameras.select(F.col("camera_id").alias("_c"), F.col("width").alias("_cw"), F.col("height").alias("_ch")).dropDuplicates(["_c"])
    j = images.join(cam, images["camera_id"] == F.col("_c"), "left")
    j = j.join(files.select(F.col("name").alias("_f"), F.col("width").alias("_fw"), F.col("height").alias("_fh")), j["name"] == F.col("_f"), "left")
    if masks is None:
        j = j.withColumns({"_mw": F.lit(None).cast("long"), "_mh": F.lit(None).cast("long")})
    else:
        j = j.join(masks.select(F.col("name").alias("_m"), F.col("width").alias("_mw"), F.col("height").alias("_mh")), j["name"] == F.col("_m"), "left")
    shape, own = F.try_divide("_fw", "_fh"), F.try_divide("_cw", "_ch")
    image = {
        "pose": wrong(_finite(F.col("qvec")) & _finite(F.col("tvec"))),
        "dangling": F.col("_c").isNull(),
        "path": F.coalesce(_leaves(F.col("name")), F.lit(True)),
        "missing": F.col("_f").isNull(),
        "aspect": F.coalesce(F.abs(shape - own) > ASPECT * own, F.lit(False)),
        "mask_size": F.coalesce((F.col("_mw") != F.col("_fw")) | (F.col("_mh") != F.col("_fh")), F.lit(False)),
    }
    of_images = j.select(F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in image.items()]), lambda k: k.isNotNull())).alias("kind"), F.col("name").alias("image"), F.col("camera_id").cast("long").alias("camera"))
    empty = [spark.range(1).where(F.lit(not df.take(1))).select(F.lit(k).alias("kind"), F.lit(None).cast("string").alias("image"), F.lit(None).cast("long").alias("camera")) for k, df in (("no_cameras", cameras), ("no_images", images))]
    return reduce(DataFrame.unionByName, [of_cameras, of_images, *empty])


def training_bytes(images: DataFrame, sizes: DataFrame, resolution: int, hold: int) -> DataFrame:
    """One row: images, training views, and the bytes their pixels take decoded
    (16 a pixel) and compact (4, or 16 with a mask), 1024 an image. Every
    ``hold``th image by name is held out (none if 0). ``sizes``: name, width, height, masked."""
    from tessera.operators.blocks import dense_rank

    ranked = dense_rank(images.select("name"), ["name"], "_k")
    j = ranked.join(sizes, "name")
    side = lambda c: F.greatest(F.bround(F.col(c) / resolution).cast("long"), F.lit(1))
    pixels = side("width") * side("height")
    train = ~((F.lit(hold) > 0) & (F.col("_k") % max(hold, 1) == 0))
    each = lambda size: F.coalesce(F.sum(F.when(train, pixels * size + 1024)), F.lit(0)).cast("long")
    return j.agg(F.count("*").alias("images"), F.count_if(train).alias("training"), each(F.lit(16)).alias("decoded"), each(F.when(F.col("masked"), 16).otherwise(4)).alias("compact"))


def fingerprint(*tables: DataFrame) -> str:
    """One digest of the rows of all tables, in any order within each: SHA-256 of
    each row's SHA-256 halves, added up and combined, with the counts. Columns count by name."""
    import hashlib

    out = []
    for t in tables:
        row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(t.columns)]), {"ignoreNullFields": "false"}), 256)
        parts = [F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(20,0)") for k in range(8)]
        got = t.agg(F.count("*"), *[F.coalesce(F.sum(p), F.lit(0)) for p in parts]).first()
        out.append(",".join([*sorted(t.columns), *map(str, got)]))
    return hashlib.sha256("\n".join(out).encode()).hexdigest()


# -- options ---------------------------------------------------------------------

#: What must be positive, or not negative, wherever it stands in a step's settings.
POSITIVE = frozenset("resolution llff_hold block_size camera_limit tile_size pool_gib iterations coarse_iterations cap_max position_lr_max_steps densification_interval tiles_per_camera checkpoint_every".split())
NOT_NEGATIVE = frozenset("steps headroom_gib image_cache_gib densify_max_new_nodes".split())
#: Ranges that both ends belong to.
RANGES = {"halo": (5, float("inf")), "viewer_port": (0, 65535), "densify_max_leaf_fraction": (0, 1)}
STATES = ("pending", "stale", "running", "completed", "failed", "interrupted")


def check_settings(settings: dict, path: str = "settings") -> None:
    """An error with the path of the first setting that is not finite or out of its range."""
    import math

    for key, v in settings.items():
        at = f"{path}.{key}"
        if isinstance(v, dict):
            check_settings(v, at)
        elif isinstance(v, (int, float)) and not isinstance(v, bool):
            low, high = RANGES.get(key, (-math.inf, math.inf))
            if not math.isfinite(v):
                raise ValueError(f"{at} is not finite")
            if (key in POSITIVE and v <= 0) or (key in NOT_NEGATIVE and v < 0) or not low <= v <= high:
                raise ValueError(f"{at} is out of range")


def load_project(spark, path: str, defaults: dict[str, dict]) -> dict:
    """A project file: version 1, its settings filled with ``defaults`` by step,
    every step with settings and a known state; a step that was running when the
    file was written is interrupted now."""
    import json

    project = json.loads("\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect()))
    if project.get("version") != 1:
        raise ValueError("an unknown version of a project")
    for step, values in defaults.items():
        if not isinstance(project.get("settings", {}).get(step), dict) or step not in project.get("steps", {}):
            raise ValueError(f"the project has no step {step}")
        project["settings"][step] = values | project["settings"][step]
        state = project["steps"][step]
        if state.get("status") not in STATES:
            raise ValueError(f"step {step} has no known state")
        if state["status"] == "running":
            state["status"] = "interrupted"
    check_settings(project["settings"])
    return project
