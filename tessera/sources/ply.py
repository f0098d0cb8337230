"""Point clouds and splats in PLY files, and hierarchies in their binary formats,
all read and written by byte ranges."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources import records
from tessera.sources.records import Section

#: PLY's names of number types.
TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def header(raw: bytes) -> tuple[int, np.dtype, int]:
    """Vertices, their layout, and where they begin."""
    end = raw.index(b"end_header")
    body = raw.index(b"\n", end) + 1
    lines = raw[:end].decode("ascii").split("\n")
    if not any(x.strip() == "format binary_little_endian 1.0" for x in lines):
        raise ValueError("only binary little-endian files are read")
    count, fields, inside = 0, [], False
    for x in lines:
        w = x.split()
        if w[:1] == ["element"]:
            inside = w[1] == "vertex"
            count = int(w[2]) if inside else count
        elif w[:1] == ["property"] and inside:
            fields.append((w[2], "<" + TYPES[w[1]]))
    return count, np.dtype(fields), body


def read_ply(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """id and the properties of a file's vertices, as they are."""
    n, kind, at = header(records.head(path))
    fields = tuple((c, kind[c].str.lstrip("<|"), 0) for c in kind.names)
    return records.read_records(spark, path, [Section(at, fields)], n, skip)


def read_cloud(spark: SparkSession, path: str) -> DataFrame:
    """id, x, y, z, r, g, b in 0 to 1 (0.5 if the file has no colours), nx, ny, nz (0 if none)."""
    v = read_ply(spark, path)
    has = set(v.columns)
    real = lambda c: F.col(c).cast("double")
    colours = [(real(n) / 255.0 if n in has else F.lit(0.5)).alias(a) for a, n in (("r", "red"), ("g", "green"), ("b", "blue"))]
    normals = [(real(n) if n in has else F.lit(0.0)).alias(n) for n in ("nx", "ny", "nz")]
    return v.select("id", *[real(c).alias(c) for c in "xyz"], *colours, *normals)


#: The properties of a cloud's file.
CLOUD = (*((c, "f4", 0) for c in ("x", "y", "z", "nx", "ny", "nz")), *((c, "u1", 0) for c in ("red", "green", "blue")))


def write_cloud(cloud: DataFrame, path: str) -> int:
    """A cloud (id, x, y, z, r, g, b and, if it has them, nx, ny, nz) as one
    file in the order of ids; colours are rounded to bytes."""
    byte = lambda c: F.round(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * 255).cast("smallint")
    normals = [F.col(c) if c in cloud.columns else F.lit(0.0).alias(c) for c in ("nx", "ny", "nz")]
    rows = cloud.select("id", *"xyz", *normals, *[byte(a).alias(n) for a, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
    return _write_ply(rows, path, CLOUD)


def _write_ply(rows: DataFrame, path: str, fields: tuple[tuple[str, str, int], ...]) -> int:
    named = {v: k for k, v in TYPES.items() if not k[-1].isdigit()}

    def layout(counts: list[int]) -> tuple[list[tuple[int, bytes]], list[list[Section]]]:
        top = file_header([(c, named[t]) for c, t, _ in fields], counts[0])
        return [(0, top)], [[Section(len(top), fields)]]

    return records.write_records(path, [rows], layout)[0]


def _numbered(names: tuple[str, ...], prefix: str) -> list[str]:
    return sorted((n for n in names if n.startswith(prefix)), key=lambda n: int(re.sub(r"\D", "", n)))


SPLATS = "id long, xyz array<float>, scale array<float>, rotation array<float>, dc array<float>, opacity float, rest array<float>"


def read_splats(spark: SparkSession, path: str, degree: int, skip: int = 0) -> DataFrame:
    """Rows of a splat file; rest goes from channels first in the file to
    coefficients first. ``skip`` leaves out the file's first rows."""
    v = read_ply(spark, path, skip)
    names = tuple(v.columns)
    rest = _numbered(names, "f_rest_")
    n = (degree + 1) ** 2 - 1
    if len(rest) != 3 * n:
        raise ValueError(f"{len(rest)} rest columns for degree {degree}")
    group = lambda cols: F.array(*[F.col(c).cast("float") for c in cols]) if cols else F.array().cast("array<float>")
    by_coefficient = [rest[c * n + k] for k in range(n) for c in range(3)]
    return v.select("id", group("xyz").alias("xyz"), group(_numbered(names, "scale_")).alias("scale"), group(_numbered(names, "rot_")).alias("rotation"), group(_numbered(names, "f_dc_")).alias("dc"), F.col("opacity").cast("float").alias("opacity"), group(by_coefficient).alias("rest"))


def activated(splats: DataFrame) -> DataFrame:
    """Opacity through a sigmoid, scales through exp, rotations normalised."""
    q = F.col("rotation")
    norm = F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return splats.withColumns({"opacity": 1 / (1 + F.exp(-F.col("opacity").cast("double"))), "scale": F.transform("scale", lambda s: F.exp(s.cast("double"))), "rotation": F.transform(q, lambda v: v / norm)})


def splat_properties(degree: int) -> list[str]:
    return [*"xyz", "nx", "ny", "nz", "f_dc_0", "f_dc_1", "f_dc_2", *[f"f_rest_{k}" for k in range(3 * (degree + 1) ** 2 - 3)], "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]


def file_header(properties: list[tuple[str, str]], count: int) -> bytes:
    lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *[f"property {t} {n}" for n, t in properties], "end_header", ""]
    return "\n".join(lines).encode("ascii")


def write_splats(splats: DataFrame, path: str, degree: int, where: Column | None = None) -> int:
    """One file, in the order of ids; a row that is not finite is an error."""
    n = (degree + 1) ** 2 - 1
    rows = splats if where is None else splats.where(where)
    channels = F.transform(F.sequence(F.lit(0), F.lit(3 * n - 1)), lambda j: F.get(F.col("rest"), (j % n) * 3 + F.floor(j / n).cast("int"))) if n else F.array().cast("array<float>")
    names = splat_properties(degree)
    flat = F.concat("xyz", F.array_repeat(F.lit(0.0).cast("float"), 3), "dc", channels, F.array("opacity"), "scale", "rotation")
    every = rows.select("id", flat.alias("_all"))
    return _write_ply(every.select("id", *[F.get("_all", F.lit(k)).alias(c) for k, c in enumerate(names)]), path, tuple((c, "f4", 0) for c in names))


NODES = "id long, xyz array<float>, rotation array<float>, scale array<float>, opacity float, sh array<float>, depth int, parent int, child_count int, first_child int, next_sibling int, aux int"


def _hierarchy(n: int, degree: int) -> list[Section]:
    """Sections of a dynamic hierarchy: arrays, then six integers a node."""
    out, at = [], 8
    for c, w in (("xyz", 3), ("rotation", 4), ("scale", 3), ("opacity", 0), ("sh", 3 * (degree + 1) ** 2)):
        out.append(Section(at, ((c, "f4", w),)))
        at += 4 * n * max(w, 1)
    return [*out, Section(at + 4, tuple((c, "i4", 0) for c in ("depth", "parent", "child_count", "first_child", "next_sibling", "aux")))]


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    n, degree = np.frombuffer(records.head(path, 8), "<i4").tolist()
    return records.read_records(spark, path, _hierarchy(n, degree), n)


def write_hierarchy(rows: DataFrame, path: str, degree: int) -> int:
    """Rows of NODES as a dynamic hierarchy, in the order of ids."""

    def layout(counts: list[int]) -> tuple[list[tuple[int, bytes]], list[list[Section]]]:
        sections = _hierarchy(counts[0], degree)
        return [(0, np.array([counts[0], degree], "<i4").tobytes()), (sections[-1].offset - 4, np.array(counts, "<i4").tobytes())], [sections]

    return records.write_records(path, [rows], layout)[0]


def with_background(tree: DataFrame, background: DataFrame) -> DataFrame:
    """A tree behind background rows: ids and links move by their number, the
    root's parent is -1, links of the background are -99, first children only
    where there are two, opacities as logits of at most 0.99999."""
    k = background.count()
    links = {c: F.when(F.col(c) < 0, F.lit(-1)).when((F.col(c) == 0) & F.lit(c != "parent"), F.lit(0)).otherwise(F.col(c) + k) for c in ("parent", "first_child", "next_sibling")}
    p = F.least(F.col("opacity").cast("double"), F.lit(0.99999))
    moved = tree.withColumns(links | {"id": F.col("id") + k, "opacity": F.ln(p / (1 - p))})
    moved = moved.withColumn("first_child", F.when(F.col("child_count") == 2, F.col("first_child")).otherwise(0))
    none = {c: F.lit(-99) for c in ("depth", "parent", "child_count", "first_child", "next_sibling", "aux")}
    return background.withColumns(none).unionByName(moved, allowMissingColumns=True)
