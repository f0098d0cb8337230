"""Scalar functions over the point and step carriers."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.plans.carriers import CLIP, POINTS, STEPS, points, steps
from tessera.plans.registry import query

_EXP = ("exp(s0)", "exp(s1)", "exp(s2)")
_ROT = X.rotation("qw", "qx", "qy", "qz")
_COV = X.covariance(_ROT, list(_EXP))
_LEN = "sqrt(x*x + y*y + z*z)"


def _scalar(name: str, cols: dict[str, str], carrier: str = "pts", key: str = "id") -> None:
    """A query that projects ``cols`` (rounded) from a carrier, and its SQL."""
    kept = {c: (f"round({t}, 6)" if not t.startswith("=") else t[1:]) for c, t in cols.items()}
    with_ = POINTS if carrier == "pts" else STEPS

    def run(spark, sf_dir):
        base = points(spark, sf_dir) if carrier == "pts" else steps(spark, sf_dir)
        return base.select(key, *[F.expr(t).alias(c) for c, t in kept.items()])

    run.__name__ = name
    query(f"WITH {with_} SELECT {key}, {', '.join(f'{t} AS {c}' for c, t in kept.items())} FROM {carrier}")(run)


_scalar("support_radius", {"radius": X.support_radius("s0", "s1", "s2")})
_scalar("activations", {"opacity": X.sigmoid("op"), "back": X.logit(X.sigmoid("op"), 1e-6), "clamped": X.logit(X.sigmoid("op * 10"), 5e-3)})
_scalar("quaternion_rotation", {f"r{k // 3}{k % 3}": t for k, t in enumerate(_ROT)})
_scalar("covariance", dict(zip(("xx", "xy", "xz", "yy", "yz", "zz"), _COV, strict=True)))
_scalar("min_distance", {"area": X.surface(*_EXP), "distance": X.min_distance(*_EXP, 0.05, "id % 2 = 1")})
_scalar("camera_fov_focal", {"fov": X.field_of_view("(500 + id)", "1200"), "focal": X.focal_length("(3e-1 + (id % 90) / 1e2)", "800")})
_scalar("projected_depth", {"u": "2.5e0 * (x - 5e-2) / (z + 6e-1 + 1e-7)", "v": "2.8e0 * (y + 5e-2) / (z + 6e-1 + 1e-7)", "depth": "z + 6e-1"})
_scalar("screen_scores", {"pixels": "sqrt(x*x + y*y)", "scaled": "sqrt(power(x * 6e2, 2) + power(y * 4e2, 2))"})
_scalar("relocation_formula", {"opacity2": X.relocated_opacity(X.sigmoid("op"), "2"), "scale2": X.relocated_scale(X.sigmoid("op"), 2), "opacity5": X.relocated_opacity(X.sigmoid("op"), "5"), "scale5": X.relocated_scale(X.sigmoid("op"), 5)})
_scalar("projected_size", {"size": f"2e-1 * (1 + id % 5) / greatest({_LEN}, 1e-9)", "weight": X.interpolation(f"(2e-1 / greatest({_LEN}, 1e-9))", f"(5e-1 / greatest({_LEN}, 1e-9))", "9e-1")})
_scalar("dynamic_size", {"size": f"exp(greatest(s0, s1, s2)) / greatest({_LEN}, 1e-9)", "front": f"=(z / greatest({_LEN}, 1e-9) > -5e-1)"})
_scalar("exposure_affine", {"r": "9e-1 * d0 + 1e-1 * d1 + 5e-2", "g": "-1e-1 * d0 + 11e-1 * d1 + 1e-2", "b": "2e-1 * d1 + 8e-1 * d2 - 2e-2"})
_scalar("orbit_camera", {"ex": "2 * cos(least(greatest(y * 9, -155e-2), 155e-2)) * sin(x * 6)", "ey": "2 * sin(least(greatest(y * 9, -155e-2), 155e-2))", "ez": "2 * cos(least(greatest(y * 9, -155e-2), 155e-2)) * cos(x * 6)"})
_scalar("frustum_planes", {f"p{k}{c}": e for k, side in enumerate(X.planes([*CLIP[:3], "x", *CLIP[4:7], "y", *CLIP[8:]])) for c, e in zip("abcd", side, strict=True)})
_scalar("learning_rate", {"plain": X.learning_rate("step", 1.6e-4, 1.6e-6, 5000), "warm": X.learning_rate("(step - 10)", 1e-2, 1e-4, 5000, 500, 0.01)}, "steps", "step")
_scalar("training_plan", {"steps": "least(greatest(camera * 40, 3000), 30000)", "cache": "least(8.0 * 1024, 25e-2 * camera * 512)", "growth": "=CAST(greatest(100, floor(camera / 3)) AS BIGINT)"}, "steps", "step")

_T, _SIDE = ["x", "y", "z"], ("1200e0", "800e0", "(9e-1 + (id % 7) / 1e1)", "(7e-1 + (id % 5) / 1e1)", "(4e-1 + (id % 3) / 1e1)", "55e-2")
_VIEW = X.recentred(_ROT, _T, ["1e-1", "-2e-1", "3e-1"], "15e-1")
_CLIP = X.projection("1e-2", "1e2", *_SIDE[2:])
_scalar("camera_matrices", {f"v{k}": e for k, e in enumerate(X.world_view(_ROT, _T)[:12])} | {f"m{k}": _VIEW[k] for k in (3, 7, 11)} | {f"p{k}": _CLIP[k] for k in (0, 2, 5, 6, 10, 11)} | dict(zip(("fx", "fy", "cx", "cy", "focal"), X.intrinsics(*_SIDE), strict=True)))
_scalar("projected_points", dict(zip(("u", "v", "w"), X.transformed(X.product(_CLIP, X.world_view(_ROT, ["0e0", "0e0", "3e0"])), ("x", "y", "z")), strict=True)))


def _sh(degree: int) -> None:
    at = (degree + 1) ** 2
    unit = tuple(f"({c} / greatest({_LEN}, 1e-9))" for c in "xyz")

    def run(spark, sf_dir):
        p = points(spark, sf_dir)
        c = {f"c{k}": F.element_at("e", 12 + k).cast("double") for k in range(at)}
        return p.withColumns(c).select("id", F.expr(f"round({X.sh_colour(list(c), unit, degree)}, 6)").alias("red"))

    run.__name__ = f"sh_colour_deg{degree}"
    query(f"WITH {POINTS} SELECT id, round({X.sh_colour([f'e[{12 + k}]::DOUBLE' for k in range(at)], unit, degree)}, 6) AS red FROM pts")(run)


for _degree in range(5):
    _sh(_degree)


@query("SELECT p_partkey AS id, CAST(greatest(CASE WHEN p_size % 3 = 0 THEN round_even(p_partkey / greatest(p_partkey / 1600e0, 1e0), 0) WHEN p_size % 3 = 1 THEN round_even(p_partkey / 4e0, 0) ELSE 640 END, 1) AS BIGINT) AS width FROM part")
def image_size(spark, sf_dir):
    """The width an image is trained at: capped at 1600, a quarter, or 640 pixels."""
    from tessera.session import table

    w = F.col("p_partkey").cast("double")
    size = F.when(F.col("p_size") % 3 == 0, F.bround(w / F.greatest(w / 1600, F.lit(1.0)), 0)).when(F.col("p_size") % 3 == 1, F.bround(w / 4, 0)).otherwise(F.lit(640.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.greatest(size, F.lit(1.0)).cast("long").alias("width"))


@query(
    f"WITH {STEPS}, h AS (SELECT step, sha256('camera:7:' || step) AS s FROM steps) SELECT step, "
    + "((" + " + ".join(f"(('0x' || substr(s, {2 * k + 1}, 2))::BIGINT * {pow(256, k, 37)})" for k in range(8)) + ") % 37)::BIGINT AS camera FROM h"
)
def hash_schedule(spark, sf_dir):
    """A camera for each step: the first eight bytes of a SHA-256, little-endian, modulo their number."""
    return steps(spark, sf_dir).select("step", scheduled(F.col("step"), "camera:7:", 37).alias("camera"))


def scheduled(step, prefix: str, count: int):
    """Modular arithmetic byte by byte: no unsigned 64-bit number is needed."""
    h = F.sha2(F.concat(F.lit(prefix), step.cast("string")), 256)
    total = sum((F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("long") * pow(256, k, count) for k in range(8)), F.lit(0).cast("long"))
    return total % count


@query("""
WITH m AS (SELECT vec_id AS id, embedding[7]::DOUBLE w, embedding[8]::DOUBLE x, embedding[9]::DOUBLE y, embedding[10]::DOUBLE z FROM embeddings),
n AS (SELECT id, w / l AS w, x / l AS x, y / l AS y, z / l AS z FROM (SELECT *, sqrt(w*w + x*x + y*y + z*z) AS l FROM m) WHERE l > 0)
SELECT id, round(abs(w), 5) AS w, round(CASE WHEN w < 0 THEN -x ELSE x END, 5) AS x, round(CASE WHEN w < 0 THEN -y ELSE y END, 5) AS y, round(CASE WHEN w < 0 THEN -z ELSE z END, 5) AS z FROM n WHERE abs(w) > 1e-3
""")
def rotation_to_quaternion(spark, sf_dir):
    """Back from the matrix to a quaternion with w >= 0, by the largest of the four squares."""
    p = points(spark, sf_dir).where("qw*qw + qx*qx + qy*qy + qz*qz > 0 AND abs(qw) / sqrt(qw*qw + qx*qx + qy*qy + qz*qz) > 1e-3")
    m = p.select("id", *[F.expr(t).alias(f"m{k // 3}{k % 3}") for k, t in enumerate(_ROT)])
    four = {"w": "1 + m00 + m11 + m22", "x": "1 + m00 - m11 - m22", "y": "1 - m00 + m11 - m22", "z": "1 - m00 - m11 + m22"}
    m = m.withColumns({f"t{k}": F.expr(t) for k, t in four.items()}).withColumn("big", F.greatest("tw", "tx", "ty", "tz"))
    pair = {"wx": "m21 - m12", "wy": "m02 - m20", "wz": "m10 - m01", "xy": "m01 + m10", "xz": "m02 + m20", "yz": "m12 + m21"}
    term = lambda a, b: f"t{a}" if a == b else "(" + pair["".join(sorted((a, b), key="wxyz".index))] + ")"
    raw = {k: F.expr("CASE " + " ".join(f"WHEN big = t{lead} THEN {term(lead, k)} / (2 * sqrt(t{lead}))" for lead in "wxyz") + " END") for k in "wxyz"}
    q = m.select("id", *[c.alias(f"q{k}") for k, c in raw.items()])
    return q.select("id", *[F.round(F.when(F.col("qw") < 0, -F.col(f"q{k}")).otherwise(F.col(f"q{k}")), 5).alias(k) for k in "wxyz"])
