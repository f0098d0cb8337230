"""Scalar expressions over points, cameras and schedules, as SQL text.

The text is plain enough for any engine; ``F.expr`` makes columns of it, so
everything stays in whole-stage code generation. Arguments are column names or
expressions.
"""

from __future__ import annotations

#: Real spherical-harmonic constants by degree.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)
SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)

SH4 = (2.5033429417967046, -1.7701307697799304, 0.9461746957575601, -0.6690465435572892, 0.10578554691520431, -0.6690465435572892, 0.47308734787878004, -1.7701307697799304, 0.6258357354491761)


def num(v: float) -> str:
    """A double literal in both dialects."""
    return f"{v:.17e}"


def sigmoid(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


def logit(p: str, eps: float = 1e-6) -> str:
    p = f"least(greatest({p}, {num(eps)}), {num(1 - eps)})"
    return f"ln({p} / (1 - {p}))"


def support_radius(s0: str, s1: str, s2: str) -> str:
    """Three standard deviations along the longest axis, from log scales."""
    return f"(3 * exp(greatest({s0}, {s1}, {s2})))"


def rotation(w: str, x: str, y: str, z: str) -> list[str]:
    """The nine entries, row by row, for a quaternion that need not be normal; a zero one is the identity."""
    n = f"({w}*{w} + {x}*{x} + {y}*{y} + {z}*{z})"
    k = f"(CASE WHEN {n} = 0 THEN 0 ELSE 2 / {n} END)"
    one, two = (lambda a, b: f"(1 - {k} * ({a}*{a} + {b}*{b}))"), (lambda a, b, s, c, d: f"({k} * ({a}*{b} {s} {c}*{d}))")
    return [one(y, z), two(x, y, "-", w, z), two(x, z, "+", w, y), two(x, y, "+", w, z), one(x, z), two(y, z, "-", w, x), two(x, z, "-", w, y), two(y, z, "+", w, x), one(x, y)]


def covariance(r: list[str], s: list[str]) -> list[str]:
    """xx, xy, xz, yy, yz, zz of R S S R' for rotation entries and scales."""
    row = [r[0:3], r[3:6], r[6:9]]
    return ["(" + " + ".join(f"{row[i][k]}*{row[j][k]}*{s[k]}*{s[k]}" for k in range(3)) + ")" for i in range(3) for j in range(i, 3)]


def surface(s0: str, s1: str, s2: str) -> str:
    return f"({s0}*{s1} + {s0}*{s2} + {s1}*{s2})"


def min_distance(s0: str, s1: str, s2: str, granularity: float, leaf: str) -> str:
    """From where a node is fine enough; leaves always are."""
    return f"(CASE WHEN {leaf} THEN -1e9 ELSE sqrt({surface(s0, s1, s2)}) / {num(granularity)} END)"


def sh_basis(x: str, y: str, z: str, degree: int) -> list[str]:
    """The basis at a unit direction, 1 to 25 terms, for degrees 0 to 4."""
    out = [num(SH0)]
    if degree > 0:
        out += [f"({num(-SH1)} * {y})", f"({num(SH1)} * {z})", f"({num(-SH1)} * {x})"]
    if degree > 1:
        terms = (f"{x}*{y}", f"{y}*{z}", f"(2*{z}*{z} - {x}*{x} - {y}*{y})", f"{x}*{z}", f"({x}*{x} - {y}*{y})")
        out += [f"({num(c)} * {t})" for c, t in zip(SH2, terms, strict=True)]
    if degree > 2:
        terms = (
            f"{y}*(3*{x}*{x} - {y}*{y})", f"{x}*{y}*{z}", f"{y}*(4*{z}*{z} - {x}*{x} - {y}*{y})", f"{z}*(2*{z}*{z} - 3*{x}*{x} - 3*{y}*{y})",
            f"{x}*(4*{z}*{z} - {x}*{x} - {y}*{y})", f"{z}*({x}*{x} - {y}*{y})", f"{x}*({x}*{x} - 3*{y}*{y})",
        )
        out += [f"({num(c)} * {t})" for c, t in zip(SH3, terms, strict=True)]
    if degree > 3:
        d2, z2 = f"({x}*{x} - {y}*{y})", f"{z}*{z}"
        terms = (
            f"{x}*{y}*{d2}", f"{y}*{z}*(3*{x}*{x} - {y}*{y})", f"{x}*{y}*(7*{z2} - 1)", f"{y}*{z}*(7*{z2} - 3)", f"(35*{z2}*{z2} - 30*{z2} + 3)",
            f"{x}*{z}*(7*{z2} - 3)", f"{d2}*(7*{z2} - 1)", f"{x}*{z}*({x}*{x} - 3*{y}*{y})", f"({d2}*{d2} - 4*{x}*{x}*{y}*{y})",
        )
        out += [f"({num(c)} * {t})" for c, t in zip(SH4, terms, strict=True)]
    return out


def sh_colour(coefficients: list[str], direction: tuple[str, str, str], degree: int) -> str:
    """A colour channel, not below zero."""
    basis = sh_basis(*direction, degree)
    return "greatest(0.5 + " + " + ".join(f"{c} * {b}" for c, b in zip(coefficients, basis, strict=True)) + ", 0)"


def quantised(v: str, low: str, high: str, bits: int) -> str:
    """A coordinate on a grid of 2**bits cells, the maximum in the last one."""
    top = (1 << bits) - 1
    return f"CAST(floor(least(greatest(({v} - {low}) / greatest({high} - {low}, 1e-12) * {top}, 0), {top})) AS BIGINT)"


def morton(axes: list[str], bits: int, pushed: str = "shiftleft({}, {})", anded: str = "({} & 1)") -> str:
    """Bits of the axes interleaved, the first axis lowest."""
    n = len(axes)
    return "(" + " + ".join(f"(({a} >> {b}) & 1) * CAST({1 << (n * b + k)} AS BIGINT)" for b in range(bits) for k, a in enumerate(axes)) + ")"


def planes(m: list[str]) -> list[list[str]]:
    """Left, right, bottom, top as (a, b, c, d) with a unit normal, for the 16
    entries, row by row, of a matrix that maps column vectors to clip space."""
    row = [m[4 * k : 4 * k + 4] for k in range(4)]
    out = []
    for axis in (0, 1):
        for sign in ("+", "-"):
            v = [f"({row[3][k]} {sign} {row[axis][k]})" for k in range(4)]
            length = f"sqrt({v[0]}*{v[0]} + {v[1]}*{v[1]} + {v[2]}*{v[2]})"
            out.append([f"({e} / {length})" for e in v])
    return out


def inside_planes(x: str, y: str, z: str, r: str, sides: list[list[str]]) -> str:
    """Whether a sphere is on the inner side of each plane, or touches it."""
    return "(" + " AND ".join(f"({a}*{x} + {b}*{y} + {c}*{z} + {d} + {r} >= 0)" for a, b, c, d in sides) + ")"


def box_in_planes(low: list[str], high: list[str], sides: list[list[str]]) -> str:
    """The same for a box: centre . n + half . |n| + d >= 0."""
    tests = []
    for side in sides:
        n, d = side[:3], side[3]
        tests.append("(" + " + ".join(f"({lo} + {hi}) / 2 * {k} + ({hi} - {lo}) / 2 * abs({k})" for lo, hi, k in zip(low, high, n, strict=True)) + f" + {d} >= 0)")
    return "(" + " AND ".join(tests) + ")"


def relocated_opacity(a: str, n: str) -> str:
    """Each of n copies that together are as opaque as one."""
    return f"(1 - power(1 - {a}, 1 / CAST({n} AS DOUBLE)))"


def relocated_scale(a: str, n: int) -> str:
    """What the scale is multiplied by when a point becomes n copies of itself."""
    from math import comb, sqrt

    new = relocated_opacity(a, str(n))
    terms = [f"({num(comb(i - 1, k) * (-1) ** k / sqrt(k + 1))} * power({new}, {k + 1}))" for i in range(1, n + 1) for k in range(i)]
    return f"({a} / ({' + '.join(terms)}))"


def learning_rate(step: str, first: float, last: float, steps: int, delay_steps: int = 0, delay_mult: float = 1.0) -> str:
    """Log-linear from first to last, with a sine warm-up; 0 before step 0 or without a first rate."""
    if first == 0:
        return num(0.0)
    t = f"least(greatest({step} / {num(steps)}, 0), 1)"
    warm = f"({num(delay_mult)} + {num(1 - delay_mult)} * sin({num(1.5707963267948966)} * least(greatest({step} / {num(delay_steps)}, 0), 1)))" if delay_steps else "1"
    from math import log

    return f"(CASE WHEN {step} < 0 THEN 0 ELSE {warm} * exp({num(log(first))} * (1 - {t}) + {num(log(last))} * {t}) END)"


def interpolation(own: str, parent: str, target: str) -> str:
    """The weight of a node between its parent's size and its own: 1 if the parent is over twice the target."""
    start = f"greatest({parent} / 2, {own})"
    return f"(CASE WHEN {parent} > 2 * {target} THEN 1 WHEN {parent} <= {start} THEN 1 ELSE greatest(1 - greatest({target} - {start}, 0) / ({parent} - {start}), 0) END)"


def field_of_view(focal: str, pixels: str) -> str:
    return f"(2 * atan({pixels} / (2 * {focal})))"


def focal_length(fov: str, pixels: str) -> str:
    return f"({pixels} / (2 * tan({fov} / 2)))"


def world_view(r: list[str], t: list[str]) -> list[str]:
    """The 16 entries, row by row, that map column vectors of the world to those
    of the camera, for its rotation's entries (camera to world) and translation."""
    rows = [[*(r[3 * k + i] for k in range(3)), t[i]] for i in range(3)]
    return [*(e for row in rows for e in row), "0e0", "0e0", "0e0", "1e0"]


def recentred(r: list[str], t: list[str], shift: list[str], scale: str) -> list[str]:
    """``world_view`` of the camera whose centre is moved by ``shift``, then scaled."""
    centre = [f"(-({' + '.join(f'{r[3 * i + k]} * {t[k]}' for k in range(3))}) + {shift[i]}) * {scale}" for i in range(3)]
    moved = [f"(-({' + '.join(f'{r[3 * k + i]} * ({centre[k]})' for k in range(3))}))" for i in range(3)]
    return world_view(r, moved)


def projection(near: str, far: str, fov_x: str, fov_y: str, px: str = "5e-1", py: str = "5e-1") -> list[str]:
    """The 16 entries, row by row, of a projection with the principal point at
    shares ``px``, ``py`` of the image; depths go to 0 to 1."""
    out = ["0e0"] * 16
    # the sides at the near plane: p of 2 tan from the one, 1 - p from the other, so their distance is 2 tan
    for k, (fov, p) in enumerate(((fov_x, px), (fov_y, py))):
        out[5 * k], out[4 * k + 2] = f"(1e0 / tan({fov} / 2))", f"(2 * {p} - 1)"
    out[10], out[11], out[14] = f"({far} / ({far} - {near}))", f"(-({far} * {near}) / ({far} - {near}))", "1e0"
    return out


def product(a: list[str], b: list[str]) -> list[str]:
    """a b of two matrices of 16 entries."""
    return ["(" + " + ".join(f"{a[4 * i + k]} * {b[4 * k + j]}" for k in range(4)) + ")" for i in range(4) for j in range(4)]


def transformed(m: list[str], v: tuple[str, str, str]) -> list[str]:
    """x, y, z of a place under a matrix, over its fourth coordinate plus 1e-7."""
    row = lambda i: "(" + " + ".join(f"{m[4 * i + k]} * {c}" for k, c in enumerate((*v, "1e0"))) + ")"
    return [f"({row(i)} / ({row(3)} + 1e-7))" for i in range(3)]


def intrinsics(width: str, height: str, fov_x: str, fov_y: str, px: str = "5e-1", py: str = "5e-1") -> list[str]:
    """fx, fy, cx, cy in pixels, and the effective focal length, the larger one."""
    fx, fy = focal_length(fov_x, width), focal_length(fov_y, height)
    return [fx, fy, f"({width} * {px})", f"({height} * {py})", f"greatest({fx}, {fy})"]
