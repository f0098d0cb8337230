"""Spatial filters, neighbours, blocks and aggregates over the point carrier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import blocks, neighbours, ranks, silhouette, spatial
from tessera.plans.carriers import CAMERAS_SQL, CLIP, MASK, POINTS, VIEWS, cameras, mask, points, views
from tessera.plans.registry import query

_R = X.support_radius("s0", "s1", "s2")
_SEEN = X.inside_planes("x", "y", "z", _R, X.planes(CLIP))


@query(f"WITH {POINTS} SELECT id, round({_R}, 6) AS radius FROM pts WHERE background OR {_SEEN}")
def frustum_points(spark, sf_dir):
    seen = spatial.frustum_filter(points(spark, sf_dir), CLIP, _R, F.col("background"))
    return seen.select("id", F.expr(f"round({_R}, 6)").alias("radius"))


@query(f"""WITH {POINTS} SELECT id FROM pts WHERE NOT isnan(op) AND op <> 0 AND abs(op) < 1e300
AND greatest(s0, s1, s2) <= -32e-1 AND NOT (isnan(x) OR isnan(y) OR isnan(z))""")
def validity_filter(spark, sf_dir):
    """Rows with usable opacity, scales up to a limit and finite places."""
    bad = F.isnan("op") | F.isnan("x") | F.isnan("y") | F.isnan("z")
    return points(spark, sf_dir).where(~bad & (F.col("op") != 0) & (F.abs("op") < 1e300) & (F.greatest("s0", "s1", "s2") <= -3.2)).select("id")


@query(f"WITH {POINTS} SELECT id, label FROM pts WHERE NOT (x > 1e-1 AND NOT background)")
def prune_points(spark, sf_dir):
    return points(spark, sf_dir).where(~((F.col("x") > 0.1) & ~F.col("background"))).select("id", "label")


@query(f"WITH {POINTS} SELECT id, op <= ln(5e-3 / 995e-3) * 1e-1 AS dead, round(least(op, ln(1e-2 / 99e-2) * 1e-1 + 5e-1), 6) AS reset FROM pts")
def opacity_floor(spark, sf_dir):
    return points(spark, sf_dir).select("id", F.expr("op <= ln(5e-3 / 995e-3) * 1e-1").alias("dead"), F.expr("round(least(op, ln(1e-2 / 99e-2) * 1e-1 + 5e-1), 6)").alias("reset"))


@query(f"WITH {POINTS} SELECT id FROM pts WHERE background OR (greatest(abs(x - 1e-1), abs(y)) > 1e-1 AND greatest(abs(x - 1e-1), abs(y)) < 3e-1)")
def annulus_filter(spark, sf_dir):
    return spatial.annulus(points(spark, sf_dir), 0.1, 0.0, 0.2, always=F.col("background")).select("id")


@query(f"""WITH {POINTS}, {CAMERAS_SQL}, q AS (SELECT id, z - cz AS w, (x - cx) / (z - cz) AS u, (y - cy) / (z - cz) AS v FROM pts, cams),
o AS (SELECT id, coalesce(w > 1e-2 AND abs(u) <= 1 AND abs(v) <= 1, false) AS s, coalesce(u*u + v*v > 16e-2, false) AS b FROM q),
t AS (SELECT id, count(*) FILTER (WHERE s) AS observed, count(*) FILTER (WHERE s AND b) AS outside FROM o GROUP BY id)
SELECT id, observed, outside, NOT (outside >= 2 AND outside >= 5e-1 * greatest(observed, 1)) AS keep FROM t""")
def silhouette_vote(spark, sf_dir):
    return spatial.silhouette_vote(points(spark, sf_dir), cameras(spark), 0.4, 2, 0.5)


_FAR = f"""{MASK}, far AS (SELECT a.view, a.u, a.v, min((a.u - b.u) * (a.u - b.u) + (a.v - b.v) * (a.v - b.v)) AS d2
FROM mask a LEFT JOIN mask b ON b.view = a.view AND b.inside GROUP BY a.view, a.u, a.v)"""


@query(f"WITH {_FAR} SELECT view, u, v, coalesce(d2, -1)::BIGINT AS d2 FROM far")
def distance_transform(spark, sf_dir):
    """Squared distances to the silhouette in every pixel of five masks; -1 where a mask is empty."""
    d = silhouette.distances(mask(spark, sf_dir))
    return d.select("view", "u", "v", F.when(F.col("d2") == float("inf"), -1).otherwise(F.col("d2")).cast("long").alias("d2"))


@query(f"""WITH {POINTS}, {CAMERAS_SQL}, {_FAR}, {VIEWS}, p AS (SELECT id, view, fx, fy, px, py, w, h, {_R} AS r, r0 * x + r1 * y + r2 * z + t0 AS a, r3 * x + r4 * y + r5 * z + t1 AS b, r6 * x + r7 * y + r8 * z + t2 AS c FROM pts, views),
q AS (SELECT *, a / c * fx + px AS u, b / c * fy + py AS v FROM p WHERE c > r + 1e-6), s AS (SELECT id, view, floor(u)::BIGINT AS u, floor(v)::BIGINT AS v, greatest(fx, fy) * r / (c - r) * (1 + greatest(abs((u - px) / fx), abs((v - py) / fy))) AS r FROM q WHERE u >= 0 AND u < w AND v >= 0 AND v < h),
t AS (SELECT s.id, count(*) AS observed, count(*) FILTER (WHERE sqrt(coalesce(f.d2, 'inf'::DOUBLE)) > s.r + 5e-1) AS outside FROM s JOIN far f USING (view, u, v) GROUP BY s.id)
SELECT id, coalesce(observed, 0) AS observed, coalesce(outside, 0) AS outside, NOT (coalesce(outside, 0) >= 2 AND coalesce(outside, 0) >= 6e-1 * greatest(coalesce(observed, 0), 1)) AS keep FROM pts LEFT JOIN t USING (id)""")
def mask_vote(spark, sf_dir):
    """Points whose support lies outside the silhouette in most of the views that see them."""
    return silhouette.mask_vote(points(spark, sf_dir), views(spark, sf_dir), mask(spark, sf_dir), F.expr(_R), 0.5, 2, 0.6)


@query(f"""WITH {POINTS}, d AS (SELECT a.id, b.id AS nid, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM pts a JOIN pts b ON a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, nid) AS k FROM d)
SELECT id, round(avg(d2), 9) AS mean_d2 FROM r WHERE k <= 3 GROUP BY id""")
def knn3_mean_dist2(spark, sf_dir):
    near = neighbours.nearest(points(spark, sf_dir), 3)
    return spatial.mean_distance2(near).select("id", F.round("mean_d2", 9).alias("mean_d2"))


@query(f"""WITH {POINTS}, c AS (SELECT * FROM pts WHERE NOT background), d AS (SELECT a.id AS src, b.id AS dst, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS w FROM c a JOIN c b ON a.id <> b.id)
SELECT src, dst, round(w, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w, dst) AS k FROM d) WHERE k <= 5""")
def knn_edges(spark, sf_dir):
    """A directed graph of cameras, each to its five nearest, the held-out ones (label 0) left out."""
    near = neighbours.nearest(points(spark, sf_dir).where("NOT background"), 5)
    return near.select(F.col("id").alias("src"), F.col("nid").alias("dst"), F.round(F.sqrt("d2"), 6).alias("weight"))


@query(f"""WITH {POINTS}, {CAMERAS_SQL}, d AS (SELECT id, id % 5 AS own, cam, sqrt(power(x-cx, 2) + power(y-cy, 2) + power(z-cz, 2)) AS d FROM pts, cams),
m AS (SELECT id, min(d) FILTER (WHERE cam = own) AS a, min(d) FILTER (WHERE cam <> own) AS b FROM d GROUP BY id)
SELECT id, round(a, 6) AS d_own, round(b, 6) AS d_other, round(CASE WHEN a / b <= 95e-2 THEN 1 WHEN a / b >= 105e-2 THEN 0 ELSE (105e-2 - a / b) / 1e-1 END, 5) AS weight FROM m""")
def chunk_crossfade(spark, sf_dir):
    w = spatial.cross_fade(points(spark, sf_dir), cameras(spark), F.col("id") % 5)
    return w.select("id", F.round("d_own", 6).alias("d_own"), F.round("d_other", 6).alias("d_other"), F.round("weight", 5).alias("weight"))


@query(f"WITH {POINTS} SELECT * FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS pos FROM pts WHERE label >= 3) WHERE id IN (SELECT id FROM pts WHERE x > 0)")
def rank_remap(spark, sf_dir):
    """Global ids to places in a sorted subset."""
    p = points(spark, sf_dir)
    places = blocks.dense_rank(p.where("label >= 3").select("id"), ["id"], "pos")
    return p.where("x > 0").select("id").join(places, "id")


@query(f"WITH {POINTS} SELECT id, EXISTS (SELECT 1 FROM pts b WHERE b.id = a.id + 1 AND b.label = a.label) AS paired FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts c WHERE c.id = a.id AND c.label = 9)")
def semi_anti(spark, sf_dir):
    p = points(spark, sf_dir)
    kept = spatial.anti(p, p.where("label = 9").select("id"))
    mark = p.select((F.col("id") - 1).alias("id"), F.col("label").alias("l2"))
    return kept.join(mark, "id", "left").select("id", F.coalesce(F.col("l2") == F.col("label"), F.lit(False)).alias("paired"))


@query(f"""WITH {POINTS} SELECT label AS block, count(*) AS row_count, round(min(x - {_R}), 6) AS min_x, round(max(x + {_R}), 6) AS max_x, round(min(y - {_R}), 6) AS min_y,
round(max(y + {_R}), 6) AS max_y, round(min(z - {_R}), 6) AS min_z, round(max(z + {_R}), 6) AS max_z FROM pts GROUP BY label""")
def block_bounds(spark, sf_dir):
    m = blocks.manifest(points(spark, sf_dir).withColumn("block", F.col("label")), _R)
    return m.select("block", "row_count", *[F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y", "min_z", "max_z")])


_BLOCKS = f"blocks AS (SELECT id // 25 AS block, count(*) AS row_count, bool_or(background) AS background, min(x - {_R} / 9) AS min_x, max(x + {_R} / 9) AS max_x, min(y - {_R} / 9) AS min_y, max(y + {_R} / 9) AS max_y, min(z - {_R} / 9) AS min_z, max(z + {_R} / 9) AS max_z FROM pts GROUP BY 1)"
_HIT = X.box_in_planes(["min_x", "min_y", "min_z"], ["max_x", "max_y", "max_z"], X.planes([*CLIP[:3], "-1.1e0", *CLIP[4:]]))


def _manifest(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("block", F.floor(F.col("id") / 25).cast("long"))
    return p, blocks.manifest(p, f"{_R} / 9")


@query(f"WITH {POINTS}, {_BLOCKS} SELECT block, row_count FROM blocks WHERE {_HIT}")
def block_prune(spark, sf_dir):
    _, m = _manifest(spark, sf_dir)
    return blocks.candidates(m, _HIT).select("block", "row_count")


@query(f"WITH {POINTS}, {_BLOCKS} SELECT p.id, p.id // 25 AS block FROM pts p WHERE p.id // 25 IN (SELECT block FROM blocks WHERE {_HIT}) AND {_SEEN}")
def block_scan_semi(spark, sf_dir):
    """Rows of the blocks that a camera can see, then the rows themselves."""
    p, m = _manifest(spark, sf_dir)
    near = p.join(blocks.candidates(m, _HIT).select("block"), "block", "left_semi")
    return spatial.frustum_filter(near, CLIP, _R).select("id", "block")


#: The clip matrix of each camera of the list: the one above, moved to the camera's centre.
_OWN_CLIP = [e if k % 4 < 3 else f"({e} - {CLIP[k - 3]} * cx - {CLIP[k - 2]} * cy - {CLIP[k - 1]} * (cz + 1e0))" for k, e in enumerate(CLIP)]
_SEES = X.box_in_planes(["min_x", "min_y", "min_z"], ["max_x", "max_y", "max_z"], X.planes([*_OWN_CLIP[:3], f"({_OWN_CLIP[3]} - 5e-1)", *_OWN_CLIP[4:]]))


@query(f"WITH {POINTS}, {_BLOCKS}, {CAMERAS_SQL} SELECT block, cam FROM blocks, cams WHERE {_SEES}")
def block_camera_pairs(spark, sf_dir):
    """Which blocks each camera may see: boxes against planes, on the manifest alone."""
    _, m = _manifest(spark, sf_dir)
    # a row a block against a short list
    return m.join(F.broadcast(cameras(spark))).where(F.expr(_SEES)).select("block", "cam")


@query(f"WITH {POINTS}, {_BLOCKS} SELECT p.id, p.id // 25 AS block, round(p.x, 6) AS x FROM pts p WHERE p.id // 25 IN (SELECT block FROM blocks WHERE {_HIT})")
def block_store_scan(spark, sf_dir):
    """Rows of the blocks that a camera can see, from a store that opens only their files."""
    from tessera.session import scratch
    from tessera.sources.block_store import BlockStore

    store = BlockStore(spark, scratch(spark, "block-store"))
    p, _ = _manifest(spark, sf_dir)
    store.write(p.drop("e"), f"{_R} / 9", finite=True)
    return store.read(_HIT).select("id", F.floor(F.col("id") / 25).cast("long").alias("block"), F.round("x", 6).alias("x"))


@query(f"""WITH {POINTS} SELECT round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz,
(SELECT round(11e-1 * quantile_cont(sqrt(power(x - a, 2) + power(y - b, 2) + power(z - c, 2)), 9e-1), 6) FROM pts, (SELECT avg(x) AS a, avg(y) AS b, avg(z) AS c FROM pts)) AS radius FROM pts""")
def scene_norm(spark, sf_dir):
    p = points(spark, sf_dir)
    mean = p.agg(*[F.avg(c).alias("m" + c) for c in "xyz"])
    d = F.sqrt((F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2 + (F.col("z") - F.col("mz")) ** 2)
    far = ranks.quantiles(p.join(F.broadcast(mean)), d, [0.9])[0]
    return mean.select(*[F.round("m" + c, 6).alias("c" + c) for c in "xyz"], F.round(1.1 * F.lit(far).cast("double"), 6).alias("radius"))


@query(f"WITH {POINTS} SELECT round(quantile_cont(x, 5e-1), 6) AS cx, round(quantile_cont(y, 5e-1), 6) AS cy, round(quantile_cont(z, 5e-1), 6) AS cz FROM pts WHERE op > -22e-2 AND NOT background")
def home_view(spark, sf_dir):
    p = points(spark, sf_dir).where("op > -22e-2 AND NOT background")
    middle = {c: ranks.quantiles(p, F.col(c), [0.5])[0] for c in "xyz"}
    return spark.createDataFrame([tuple(middle.values())], "cx double, cy double, cz double").select(*[F.round("c" + c, 6).alias("c" + c) for c in "xyz"])


_MIN = ", ".join(f"min({c}) OVER () AS lo_{c}, max({c}) OVER () AS hi_{c}" for c in "xyz")


def _with_bounds(p):
    return p.join(F.broadcast(p.agg(*[f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("lo", F.min), ("hi", F.max))])))


def _morton(name: str, bits: int) -> None:
    cells = [X.quantised(c, f"lo_{c}", f"hi_{c}", bits) for c in "xyz"]
    code = X.morton(["qx_", "qy_", "qz_"], bits)

    def run(spark, sf_dir):
        p = _with_bounds(points(spark, sf_dir))
        return p.select("id", *[F.expr(c).alias(n) for c, n in zip(cells, ("qx_", "qy_", "qz_"), strict=True)]).select("id", F.expr(code).cast("long").alias("code"))

    run.__name__ = name
    query(f"WITH {POINTS}, b AS (SELECT id, x, y, z, {_MIN} FROM pts), q AS (SELECT id, {', '.join(f'{c} AS {n}' for c, n in zip(cells, ('qx_', 'qy_', 'qz_'), strict=True))} FROM b) SELECT id, CAST({code} AS BIGINT) AS code FROM q")(run)


_morton("morton10", 10)
_morton("morton21", 21)

_CELLS = [X.quantised(c, f"lo_{c}", f"hi_{c}", 10) for c in "xyz"]
_CODE = X.morton(["qx_", "qy_", "qz_"], 10)
_BANDED = f"""WITH {POINTS}, b AS (SELECT id, x, y, z, greatest(s0, s1, s2) AS s, {_MIN}, median(greatest(s0, s1, s2)) OVER () AS mid FROM pts),
q AS (SELECT id, {', '.join(f'{c} AS {n}' for c, n in zip(_CELLS, ('qx_', 'qy_', 'qz_'), strict=True))}, CAST(greatest(ceil((ln(3e0) + s - ln(12e-1) - mid) / ln(2e0)), 0) AS BIGINT) AS band FROM b),
o AS (SELECT id, band, CAST({_CODE} AS BIGINT) AS code FROM q),
g AS (SELECT id, band, code, (row_number() OVER (PARTITION BY band ORDER BY code, id) - 1) // 40 AS page FROM o)"""


def _banded(spark, sf_dir):
    p = _with_bounds(points(spark, sf_dir)).withColumn("s", F.greatest("s0", "s1", "s2"))
    p = p.withColumn("mid", F.lit(ranks.quantiles(p, F.col("s"), [0.5])[0]).cast("double"))
    band = F.greatest(F.ceil(F.expr("(ln(3e0) + s - ln(12e-1) - mid) / ln(2e0)")), F.lit(0).cast("long"))
    p = p.select("id", "x", "y", "z", "s0", "s1", "s2", "background", *[F.expr(c).alias(n) for c, n in zip(_CELLS, ("qx_", "qy_", "qz_"), strict=True)], band.alias("band")).withColumn("code", F.expr(_CODE).cast("long"))
    return p


@query(f"{_BANDED} SELECT id, band, page FROM g")
def band_paging(spark, sf_dir):
    """Pages of at most 40 rows in (band, Morton) order, none across bands."""
    return blocks.pages(_banded(spark, sf_dir), "band", ["code", "id"], 40).select("id", "band", "page")


@query(f"{_BANDED} SELECT band, count(*) AS n, count(DISTINCT page) AS n_pages FROM g GROUP BY band")
def band_counts(spark, sf_dir):
    p = blocks.pages(_banded(spark, sf_dir), "band", ["code", "id"], 40)
    return p.groupBy("band").agg(F.count("*").alias("n"), F.count_distinct("page").alias("n_pages"))


@query(f"{_BANDED} SELECT id, row_number() OVER (ORDER BY band, code, id) - 1 AS pos FROM o")
def band_morton_order(spark, sf_dir):
    return blocks.dense_rank(_banded(spark, sf_dir).select("band", "code", "id"), ["band", "code", "id"], "pos").select("id", "pos")


@query(f"WITH {POINTS}, n AS (SELECT label, count(*) AS n FROM pts GROUP BY label), f AS (SELECT label, n, floor(137 * n / t)::BIGINT AS base, (137 * n) % t AS rem FROM n, (SELECT sum(n)::BIGINT AS t FROM n)), g AS (SELECT *, row_number() OVER (ORDER BY rem DESC, label) AS k, 137 - sum(base) OVER () AS over FROM f) SELECT label, (base + CASE WHEN k <= over THEN 1 ELSE 0 END)::BIGINT AS share FROM g")
def largest_remainder(spark, sf_dir):
    sizes = points(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    return blocks.largest_remainder(sizes, "label", "n", 137).select("label", "share")


@query(f"WITH {POINTS} SELECT id FROM (SELECT id, row_number() OVER (ORDER BY label, id) - 1 AS k FROM pts) WHERE k % 7 = 0")
def stride_sample(spark, sf_dir):
    return blocks.dense_rank(points(spark, sf_dir).select("label", "id"), ["label", "id"], "k").where("k % 7 = 0").select("id")


@query(f"WITH {POINTS}, g AS (SELECT label, 40 + label * 3 - (SELECT 0) AS used FROM (SELECT DISTINCT label FROM pts)), n AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY id) - 1 AS k FROM pts) SELECT n.id, n.label, CASE WHEN k < 50 - used % 50 THEN 0 ELSE 1 + (k - (50 - used % 50)) // 50 END AS page FROM n JOIN g USING (label)")
def tail_coalescing(spark, sf_dir):
    """New rows of a band first fill its last page (of 50), then begin new ones."""
    p = points(spark, sf_dir).select("id", F.col("label").alias("band"))
    tails = p.select("band").distinct().withColumn("used", (40 + F.col("band") * 3) % 50)
    return blocks.append_pages(p, tails, 50).select("id", F.col("band").alias("label"), "page")


@query(f"WITH {POINTS} SELECT a.id AS id FROM pts a WHERE a.label IN (1, 2) UNION ALL SELECT b.id FROM pts b WHERE b.label = 3 UNION ALL SELECT c.id FROM pts c WHERE c.background")
def cut_union(spark, sf_dir):
    p = points(spark, sf_dir)
    return p.where("label IN (1, 2)").select("id").unionByName(p.where("label = 3").select("id")).unionByName(p.where("background").select("id"))


@query(f"WITH {POINTS} SELECT label AS block, min(id) AS first_at FROM pts GROUP BY label")
def distinct_in_order(spark, sf_dir):
    return points(spark, sf_dir).groupBy(F.col("label").alias("block")).agg(F.min("id").alias("first_at"))


@query("SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    from tessera.session import table

    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").select(F.col("l_orderkey").alias("key"), "n")


@query(f"WITH {POINTS}, b AS (SELECT id, CASE WHEN label = 3 THEN x + 1 ELSE x END AS x, label FROM pts WHERE label <> 5) SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'gone' ELSE 'changed' END AS state FROM pts a LEFT JOIN b ON a.id = b.id WHERE b.id IS NULL OR a.x IS DISTINCT FROM b.x")
def changed_rows(spark, sf_dir):
    p = points(spark, sf_dir).select("id", "x", "label")
    later = p.where("label <> 5").select("id", F.when(F.col("label") == 3, F.col("x") + 1).otherwise(F.col("x")).alias("nx"), F.lit(True).alias("there"))
    j = p.join(later, "id", "left").where(F.col("there").isNull() | ~F.col("x").eqNullSafe(F.col("nx")))
    return j.select("id", F.when(F.col("there").isNull(), "gone").otherwise("changed").alias("state"))


@query(f"WITH {POINTS}, a AS (SELECT id, x + y AS d FROM pts WHERE label <> 1), b AS (SELECT id, x - y + 1e-3 AS d FROM pts WHERE label <> 2) SELECT coalesce(a.id, b.id) AS id, CASE WHEN a.id IS NULL THEN 'load' WHEN b.id IS NULL THEN 'demote' WHEN abs(a.d - b.d) <= 2e-1 * abs(a.d) THEN 'reuse' ELSE 'reload' END AS state FROM a FULL JOIN b ON a.id = b.id")
def prev_state_diff(spark, sf_dir):
    p = points(spark, sf_dir)
    a = p.where("label <> 1").select("id", F.expr("x + y").alias("old"))
    b = p.where("label <> 2").select("id", F.expr("x - y + 1e-3").alias("new"))
    j = a.join(b, "id", "full")
    state = F.when(F.col("old").isNull(), "load").when(F.col("new").isNull(), "demote").when(F.abs(F.col("old") - F.col("new")) <= 0.2 * F.abs("old"), "reuse").otherwise("reload")
    return j.select("id", state.alias("state"))


@query(f"WITH {POINTS} SELECT id, label FROM pts WHERE label BETWEEN 2 AND 4 ORDER BY x + y DESC, id LIMIT 25")
def eligible_topk(spark, sf_dir):
    """Rows over the threshold, as many as the least of the budgets allows."""
    return points(spark, sf_dir).where("label BETWEEN 2 AND 4").orderBy(F.expr("x + y").desc(), "id").limit(25).select("id", "label")


@query(f"WITH {POINTS} SELECT id, round(x, 6) AS x FROM pts WHERE x > 5e-2 ORDER BY x DESC, id LIMIT 40")
def flat_split_topk(spark, sf_dir):
    return points(spark, sf_dir).where("x > 5e-2").orderBy(F.col("x").desc(), "id").limit(40).select("id", F.round("x", 6).alias("x"))


@query(f"""WITH {POINTS}, t AS (SELECT * FROM pts WHERE x > 5e-2 AND NOT background), s AS (SELECT t.*, v.k AS side FROM t, (VALUES (-1), (1)) v(k))
SELECT id, side::INT AS side, round(x + side * exp(s0) * 5e-1, 6) AS x, round({X.relocated_opacity(X.sigmoid('op'), '2')}, 6) AS opacity, round(s0 + ln({X.relocated_scale(X.sigmoid('op'), 2)}), 6) AS s0 FROM s
UNION ALL SELECT id, 0, round(x, 6), round({X.sigmoid('op')}, 6), round(s0, 6) FROM pts WHERE NOT (x > 5e-2 AND NOT background)""")
def flat_split(spark, sf_dir):
    """Chosen points are replaced by two smaller ones along their first axis."""
    p = points(spark, sf_dir)
    chosen = (F.col("x") > 0.05) & ~F.col("background")
    kids = p.where(chosen).withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    kids = kids.select("id", "side", F.expr("round(x + side * exp(s0) * 5e-1, 6)").alias("x"), F.expr(f"round({X.relocated_opacity(X.sigmoid('op'), '2')}, 6)").alias("opacity"), F.expr(f"round(s0 + ln({X.relocated_scale(X.sigmoid('op'), 2)}), 6)").alias("s0"))
    rest = p.where(~chosen).select("id", F.lit(0).alias("side"), F.round("x", 6).alias("x"), F.expr(f"round({X.sigmoid('op')}, 6)").alias("opacity"), F.round("s0", 6).alias("s0"))
    return kids.unionByName(rest)


@query(f"WITH {POINTS}, c AS (SELECT id, x + abs(y) AS g, op FROM pts) SELECT id, CASE WHEN g * power({X.sigmoid('op')}, 2e-1) >= 2e-1 AND {X.sigmoid('op')} > 35e-2 THEN CASE WHEN id % 2 = 0 THEN 'split' ELSE 'clone' END ELSE 'keep' END AS action FROM c")
def densify_actions(spark, sf_dir):
    a = X.sigmoid("op")
    hit = F.expr(f"(x + abs(y)) * power({a}, 2e-1) >= 2e-1 AND {a} > 35e-2")
    return points(spark, sf_dir).select("id", F.when(hit, F.when(F.col("id") % 2 == 0, "split").otherwise("clone")).otherwise("keep").alias("action"))


@query(f"WITH {POINTS}, w AS (SELECT id, sum(label + 1) OVER (ORDER BY id) AS upto, label + 1 AS w FROM pts WHERE NOT background), t AS (SELECT sum(label + 1)::BIGINT AS t FROM pts WHERE NOT background), d AS (SELECT i, (i * 7919) % t AS pick FROM range(100) r(i), t) SELECT w.id, count(*) AS n FROM d JOIN w ON pick < upto AND pick >= upto - w.w GROUP BY w.id")
def sample_bincount(spark, sf_dir):
    """Draws with replacement in proportion to weights, by an inverse of the running sum; counts per id."""
    p = points(spark, sf_dir).where("NOT background").select("id", (F.col("label") + 1).alias("w"))
    return blocks.weighted_draws(p, 100, 7919)


#: A number of a row from all its columns; the same text in both engines.
_ROW = "(id * 2654435761 + label * 40503 + " + " + ".join(f"CAST(floor({c} * 1e6) AS BIGINT) * {k}" for c, k in zip(("x", "y", "z", "s0", "s1", "s2", "qw", "qx", "qy", "qz", "d0", "d1", "d2", "op"), range(69069, 10**6, 60493))) + ") % 4294967296 + 4294967296"


@query(f"WITH {POINTS} SELECT (sum({_ROW}) % 4611686018427387904)::BIGINT AS digest, count(*) AS n FROM pts")
def row_digest(spark, sf_dir):
    return blocks.digest(points(spark, sf_dir), F.expr(_ROW))


@query(None)
def row_digest_bits(spark, sf_dir):
    """A digest of all columns' bits, in any order of rows, with sums of the numbers."""
    return blocks.bit_digest(points(spark, sf_dir))


@query(None)
def weighted_sample(spark, sf_dir):
    """Draws with replacement in proportion to weights, as counts an id."""
    p = points(spark, sf_dir).where("NOT background").select("id", F.col("label").cast("double").alias("w"))
    return blocks.multinomial(p, 5_000, 17)


@query("SELECT n_nationkey AS file FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 AND s_nationkey IS NOT NULL) AND n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900 AND c_nationkey IS NOT NULL)")
def gc_orphans(spark, sf_dir):
    """Files that neither the current nor the previous manifest names."""
    from tessera.session import table

    now = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("file"))
    before = table(spark, sf_dir, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("file"))
    return blocks.orphans(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("file")), [now, before])
