"""Readers and writers of reconstruction models: cameras, image poses, sparse
points, dense arrays; text and binary.

Files are read by Spark, so any store that Spark knows will do; binary ones are
parsed in the tasks, a file at a time, which is how the format has to be read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ship

#: Camera model ids, names and numbers of parameters.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}
CAMERAS = "camera_id int, model string, width long, height long, params array<double>"
IMAGES = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points2d array<struct<x:double,y:double,point3d_id:long>>"
POINTS = "point3d_id long, xyz array<double>, rgb array<int>, error double, track array<struct<image_id:int,point2d_idx:int>>"


class Cursor:
    """Reads little-endian fields from bytes; running out of them is an error."""

    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, fields: str) -> tuple:
        out = struct.unpack_from("<" + fields, self.raw, self.at)
        self.at += struct.calcsize("<" + fields)
        return out

    def name(self) -> str:
        end = self.raw.index(b"\0", self.at)
        s = self.raw[self.at : end].decode()
        self.at = end + 1
        return s

    def array(self, kind: str, n: int) -> np.ndarray:
        dt = np.dtype(kind)
        out = np.frombuffer(self.raw, dt, n, self.at)
        self.at += n * dt.itemsize
        return out


def parsed(spark: SparkSession, path: str, parse: Callable[[bytes], list[tuple]], schema: str) -> DataFrame:
    """The rows of every binary file at ``path``."""
    ship(spark)
    names = [c.name for c in spark.createDataFrame([], schema).schema]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                yield pd.DataFrame(parse(bytes(raw)), columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def parse_cameras(raw: bytes) -> list[tuple]:
    c = Cursor(raw)
    out = []
    for _ in range(c.take("Q")[0]):
        cid, model, w, h = c.take("iiQQ")
        name, n = MODELS[model]
        out.append((cid, name, w, h, list(c.take(f"{n}d"))))
    return out


def parse_images(raw: bytes) -> list[tuple]:
    c = Cursor(raw)
    out = []
    for _ in range(c.take("Q")[0]):
        head = c.take("idddddddi")
        name = c.name()
        flat = c.array("<f8,<f8,<i8", c.take("Q")[0])
        out.append((head[0], list(head[1:5]), list(head[5:8]), head[8], name, [{"x": float(x), "y": float(y), "point3d_id": int(p)} for x, y, p in flat]))
    return out


def parse_points(raw: bytes) -> list[tuple]:
    c = Cursor(raw)
    out = []
    for _ in range(c.take("Q")[0]):
        p = c.take("QdddBBBd")
        track = c.array("<i4", 2 * c.take("Q")[0]).reshape(-1, 2)
        out.append((p[0], list(p[1:4]), list(p[4:7]), p[7], [{"image_id": int(a), "point2d_idx": int(b)} for a, b in track]))
    return out


def read_cameras(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_cameras, CAMERAS)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_images, IMAGES)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark, path, parse_points, POINTS)


def _fields(spark: SparkSession, path: str) -> DataFrame:
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+").alias("f"))


def _doubles(f, first: int, n=None):
    part = F.slice(f, first, n if n is not None else F.greatest(F.size(f) - first + 1, F.lit(0)))
    return F.transform(part, lambda v: v.cast("double"))


def read_cameras_text(spark: SparkSession, path: str, only: str | None = None) -> DataFrame:
    """Cameras; with ``only`` a camera of another model is an error."""
    f = F.col("f")
    out = _fields(spark, path).select(f[0].cast("int").alias("camera_id"), f[1].alias("model"), f[2].cast("long").alias("width"), f[3].cast("long").alias("height"), _doubles(f, 5).alias("params"))
    if only:
        out = out.withColumn("model", F.when(F.col("model") == only, F.col("model")).otherwise(F.raise_error(F.concat(F.lit("unsupported camera model "), "model"))))
    return out


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines an image: its pose, then its 2-D points, which may be blank."""
    whole = spark.read.text(path, wholetext=True)
    lines = F.filter(F.split("value", "\r?\n"), lambda s: ~F.ltrim(s).startswith("#"))
    pair = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size("l") - 1) / 2), F.lit(0)).cast("int")), lambda i: F.struct(F.get(F.col("l"), 2 * i).alias("a"), F.coalesce(F.get(F.col("l"), 2 * i + 1), F.lit("")).alias("b")))
    rows = whole.select(lines.alias("l")).select(F.explode(pair).alias("p")).where(F.trim("p.a") != "")
    f, g = F.split(F.trim("p.a"), r"\s+"), F.split(F.trim("p.b"), r"\s+")
    n = F.when(F.trim("p.b") == "", F.lit(0)).otherwise(F.floor(F.size(g) / 3).cast("int"))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    pts = F.transform(at, lambda i: F.struct(F.get(g, 3 * i).cast("double").alias("x"), F.get(g, 3 * i + 1).cast("double").alias("y"), F.get(g, 3 * i + 2).cast("long").alias("point3d_id")))
    return rows.select(f[0].cast("int").alias("image_id"), _doubles(f, 2, 4).alias("qvec"), _doubles(f, 6, 3).alias("tvec"), f[8].cast("int").alias("camera_id"), f[9].alias("name"), pts.alias("points2d"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    f = F.col("f")
    at = F.when(F.size(f) > 9, F.sequence(F.lit(8), F.size(f) - 2, F.lit(2))).otherwise(F.array().cast("array<int>"))
    track = F.transform(at, lambda i: F.struct(F.get(f, i).cast("int").alias("image_id"), F.get(f, i + 1).cast("int").alias("point2d_idx")))
    rgb = F.transform(F.slice(f, 5, 3), lambda v: v.cast("int"))
    return _fields(spark, path).select(f[0].cast("long").alias("point3d_id"), _doubles(f, 2, 3).alias("xyz"), rgb.alias("rgb"), F.get(f, 7).cast("double").alias("error"), track.alias("track"))


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def detect_format(spark: SparkSession, folder: str) -> str | None:
    """".bin" or ".txt", whichever has all three files first; None if neither."""
    for ext in (".bin", ".txt"):
        if all(exists(spark, f"{folder}/{n}{ext}") for n in ("cameras", "images", "points3D")):
            return ext
    return None


def read_model(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ext = detect_format(spark, folder)
    if ext is None:
        raise FileNotFoundError(f"no model in {folder}")
    readers = (read_cameras, read_images, read_points) if ext == ".bin" else (read_cameras_text, read_images_text, read_points_text)
    return tuple(r(spark, f"{folder}/{n}{ext}") for r, n in zip(readers, ("cameras", "images", "points3D"), strict=True))


def join_cameras(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with their camera's columns; an image without one is an error."""
    known = cameras.withColumnRenamed("camera_id", "_c")
    j = images.join(known, images["camera_id"] == known["_c"], "left")
    return j.withColumn("model", F.when(F.col("_c").isNull(), F.raise_error(F.concat(F.lit("no camera "), F.col("camera_id").cast("string")))).otherwise(F.col("model"))).drop("_c")


def text_lines(kind: str, df: DataFrame) -> DataFrame:
    """The lines of a text file, in a column value: "cameras", "images" or "points3D"."""
    nums = lambda c: F.concat_ws(" ", F.transform(c, lambda v: v.cast("string")))
    if kind == "cameras":
        return df.select(F.concat_ws(" ", F.col("camera_id").cast("string"), "model", F.col("width").cast("string"), F.col("height").cast("string"), nums("params")).alias("value"))
    if kind == "images":
        pts = F.concat_ws(" ", F.transform("points2d", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["point3d_id"].cast("string"))))
        head = F.concat_ws(" ", F.col("image_id").cast("string"), nums("qvec"), nums("tvec"), F.col("camera_id").cast("string"), "name")
        return df.select(F.concat(head, F.lit("\n"), pts).alias("value"))
    track = F.concat_ws(" ", F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["point2d_idx"].cast("string"))))
    return df.select(F.concat_ws(" ", F.col("point3d_id").cast("string"), nums("xyz"), nums("rgb"), F.col("error").cast("string"), track).alias("value"))


def write_text(kind: str, df: DataFrame, folder: str) -> None:
    text_lines(kind, df).write.mode("overwrite").text(folder)


def packed(kind: str, rows: list) -> bytes:
    """A binary file of collected rows; models are small beside what they describe."""
    out = [struct.pack("<Q", len(rows))]
    ids = {name: k for k, (name, _) in MODELS.items()}
    for r in rows:
        if kind == "cameras":
            out.append(struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], ids[r["model"]], r["width"], r["height"], *r["params"]))
        elif kind == "images":
            out.append(struct.pack("<idddddddi", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["points2d"])))
            out += [struct.pack("<ddq", p["x"], p["y"], p["point3d_id"]) for p in r["points2d"]]
        else:
            out.append(struct.pack("<QdddBBBdQ", r["point3d_id"], *r["xyz"], *r["rgb"], r["error"], len(r["track"])))
            out += [struct.pack("<ii", t["image_id"], t["point2d_idx"]) for t in r["track"]]
    return b"".join(out)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """width, height, channels and data (row by row, channels last) of arrays
    with a header "w&h&c&" and column-major float32."""

    def parse(raw: bytes) -> list[tuple]:
        w, h, c, body = raw.split(b"&", 3)
        w, h, c = int(w), int(h), int(c)
        a = np.frombuffer(body, "<f4").reshape((w, h, c), order="F").transpose(1, 0, 2)
        return [(w, h, c, a.ravel().tolist())]

    return parsed(spark, path, parse, "width int, height int, channels int, data array<float>")
