"""Step logs, schedules, quality figures and relational sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import expressions as X
from tessera.operators import blocks, hierarchy, neighbours, ranks, stateful
from tessera.plans.carriers import POINTS, STEPS, points, steps
from tessera.plans.registry import query
from tessera.plans.tree_queries import RADIUS, kd_full_sql
from tessera.session import table


@query(f"WITH {STEPS} SELECT step, camera, row_number() OVER (PARTITION BY camera ORDER BY step) AS visit FROM steps")
def visit_counter(spark, sf_dir):
    return stateful.visit_counter(steps(spark, sf_dir)).select("step", "camera", "visit")


_CLOCK = f"{STEPS}, clock AS (SELECT step, camera, sum((camera % 7 + 1) / 1e2) OVER (PARTITION BY camera ORDER BY step) AS progress FROM steps)"


def _clock(spark, sf_dir):
    return stateful.coverage_clock(steps(spark, sf_dir), F.expr("(camera % 7 + 1) / 1e2"), "camera")


@query(f"WITH {_CLOCK} SELECT step, round(progress, 6) AS progress FROM clock")
def coverage_clock(spark, sf_dir):
    return _clock(spark, sf_dir).select("step", F.round("progress", 6).alias("progress"))


@query(f"WITH {_CLOCK}, l AS (SELECT *, (floor(coalesce(lag(progress) OVER (PARTITION BY camera ORDER BY step), 0) / 25e-2 + 1e-8) + 1) * 25e-2 AS due FROM clock) SELECT step, camera, due FROM l WHERE progress + 1e-8 >= due AND due > 2e-1 AND due < 35e-1")
def growth_trigger(spark, sf_dir):
    return stateful.growth_trigger(_clock(spark, sf_dir), "camera", 0.2, 3.5, 0.25).select("step", "camera", "due")


@query(f"WITH RECURSIVE {STEPS}, o AS (SELECT camera, value, row_number() OVER (PARTITION BY camera ORDER BY step) AS k, count(*) OVER (PARTITION BY camera) AS n FROM steps), e AS (SELECT camera, k, n, 4e-1 * value AS ema FROM o WHERE k = 1 UNION ALL SELECT o.camera, o.k, o.n, 4e-1 * o.value + 6e-1 * e.ema FROM e JOIN o ON o.camera = e.camera AND o.k = e.k + 1) SELECT camera, round(ema, 6) AS ema FROM e WHERE k = n")
def moving_average(spark, sf_dir):
    return stateful.ema(steps(spark, sf_dir), "camera").select("camera", F.round("ema", 6).alias("ema"))


@query(f"WITH {STEPS}, m AS (SELECT camera AS id, max(value) AS g FROM steps WHERE value >= 5e1 GROUP BY camera), o AS (SELECT camera AS id, max(value) AS g FROM steps WHERE value < 5e1 GROUP BY camera) SELECT coalesce(m.id, o.id) AS id, round(greatest(coalesce(m.g, o.g), coalesce(o.g, m.g)), 6) AS score FROM m FULL JOIN o ON m.id = o.id")
def score_max_merge(spark, sf_dir):
    s = steps(spark, sf_dir)
    new = s.where("value >= 50").groupBy(F.col("camera").alias("id")).agg(F.max("value").alias("g"))
    old = s.where("value < 50").groupBy(F.col("camera").alias("id")).agg(F.max("value").alias("o"))
    return new.join(old, "id", "full").select("id", F.round(F.greatest("g", "o"), 6).alias("score"))


@query(f"WITH {STEPS} SELECT count(*) AS visible, count(*) FILTER (WHERE value > 0) AS positive, count(*) FILTER (WHERE value > 100) AS eligible, round(quantile_cont(value, 5e-1) FILTER (WHERE value > 0), 6) AS p50, round(quantile_cont(value, 9e-1) FILTER (WHERE value > 0), 6) AS p90, round(quantile_cont(value, 99e-2) FILTER (WHERE value > 0), 6) AS p99 FROM steps")
def window_report(spark, sf_dir):
    s = steps(spark, sf_dir)
    n = s.agg(F.count("*").alias("visible"), F.count_if(F.col("value") > 0).alias("positive"), F.count_if(F.col("value") > 100).alias("eligible"))
    at = ranks.quantiles(s.where("value > 0"), F.col("value"), [0.5, 0.9, 0.99])
    return n.select("*", *[F.round(F.lit(q).cast("double"), 6).alias(c) for c, q in zip(("p50", "p90", "p99"), at, strict=True)])


_ERR = "err AS (SELECT user_id % 12 AS image, power((value - floor(value)) - 5e-1, 2) AS e2, abs((value - floor(value)) - 5e-1) AS e1 FROM events)"


def _errors(spark, sf_dir):
    v = F.expr("(value - floor(value)) - 5e-1")
    return table(spark, sf_dir, "events").select((F.col("user_id") % 12).alias("image"), (v * v).alias("e2"), F.abs(v).alias("e1"), F.col("event_type").alias("kind"))


@query(f"WITH {_ERR} SELECT count(*) AS pixels, round(sum(e2) / count(*), 9) AS mse, round(CASE WHEN sum(e2) = 0 THEN NULL ELSE -10 * log10(sum(e2) / count(*)) END, 6) AS psnr FROM err")
def pooled_psnr(spark, sf_dir):
    """Pooled over all pixels, which is not the mean of the images' figures; none if there is no error."""
    p = _errors(spark, sf_dir).agg(F.count("*").alias("pixels"), (F.sum("e2") / F.count("*")).alias("m"))
    return p.select("pixels", F.round("m", 9).alias("mse"), F.round(F.when(F.col("m") > 0, -10 * F.log10("m")), 6).alias("psnr"))


@query(f"WITH {_ERR} SELECT image, round(avg(e1), 9) AS l1, round(avg(e2), 9) AS l2, round(20 * log10(1 / sqrt(avg(e2))), 6) AS psnr FROM err GROUP BY image")
def image_losses(spark, sf_dir):
    g = _errors(spark, sf_dir).groupBy("image").agg(F.avg("e1").alias("a"), F.avg("e2").alias("b"))
    return g.select("image", F.round("a", 9).alias("l1"), F.round("b", 9).alias("l2"), F.round(20 * F.log10(1 / F.sqrt("b")), 6).alias("psnr"))


@query("SELECT coalesce(event_type, 'all') AS kind, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), ())")
def eval_means(spark, sf_dir):
    g = table(spark, sf_dir, "events").rollup("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("*").alias("n"))
    return g.select(F.coalesce("event_type", F.lit("all")).alias("kind"), "mean", "n")


@query("SELECT event_type AS phase, count(*) AS n, round(median(value), 6) AS median, round(avg(CASE WHEN value > 50 THEN 1e0 ELSE 0e0 END), 6) AS hit_ratio, round((arg_max(value, event_id) - arg_min(value, event_id)) / count(*), 6) AS per_step FROM events WHERE event_id >= 100 GROUP BY event_type")
def profile_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_id >= 100")
    per = (F.max_by("value", "event_id") - F.min_by("value", "event_id")) / F.count("*")
    middle = ranks.grouped_quantile(e, "event_type", "value", "event_id", 0.5, "median").withColumnRenamed("event_type", "_p")
    g = e.groupBy(F.col("event_type").alias("phase")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)).alias("hits"), per.alias("per"))
    return g.join(middle, F.col("phase").eqNullSafe(F.col("_p"))).select("phase", "n", F.round("median", 6).alias("median"), F.round("hits", 6).alias("hit_ratio"), F.round("per", 6).alias("per_step"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events WHERE (props->>'k')::BIGINT >= 50")
def profile_scan(spark, sf_dir):
    """A field of JSON records, after the warm-up."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k")).where("k >= 50")


@query("WITH s AS (SELECT o_custkey AS name, o_totalprice AS scale FROM orders) SELECT name, round(max(scale), 4) AS scale, (SELECT round(median(scale), 4) FROM s WHERE scale > 0) AS med FROM s GROUP BY name")
def depth_params(spark, sf_dir):
    """The median of the positive scales goes to every entry."""
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_totalprice").alias("scale"))
    med = ranks.quantiles(s.where("scale > 0"), F.col("scale"), [0.5])[0]
    return s.groupBy("name").agg(F.round(F.max("scale"), 4).alias("scale")).withColumn("med", F.round(F.lit(med).cast("double"), 4))


@query("SELECT o_orderkey AS image, c_custkey AS camera, c_mktsegment AS model FROM orders JOIN customer ON o_custkey = c_custkey")
def image_camera_join(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("o_orderkey").alias("image"), F.col("c_custkey").alias("camera"), F.col("c_mktsegment").alias("model"))


@query("SELECT count(*) AS images, count(*) FILTER (WHERE c_custkey IS NULL) AS dangling, count(*) FILTER (WHERE NOT (o_totalprice > 0)) AS bad_value, count(*) FILTER (WHERE o_custkey % 2 = 0) AS even FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def preflight(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey")
    j = o.join(c, o["o_custkey"] == c["c_custkey"], "left")
    return j.agg(F.count("*").alias("images"), F.count_if(F.col("c_custkey").isNull()).alias("dangling"), F.count_if(~(F.col("o_totalprice") > 0)).alias("bad_value"), F.count_if(F.col("o_custkey") % 2 == 0).alias("even"))


_DATASET = """cam AS (SELECT c_custkey AS camera_id, CASE WHEN c_custkey % 50 = 7 THEN 'OPENCV' ELSE 'PINHOLE' END AS model, 640 + c_custkey % 9 AS w, CASE WHEN c_custkey % 61 = 3 THEN 0 ELSE 480 END AS h,
CASE WHEN c_custkey % 53 = 5 THEN 'nan'::DOUBLE ELSE 5e2 END AS f FROM customer),
img AS (SELECT CASE WHEN o_orderkey % 97 = 4 THEN '../' ELSE '' END || 'i' || o_orderkey || '.png' AS name, o_custkey + CASE WHEN o_orderkey % 89 = 1 THEN 100000000 ELSE 0 END AS camera_id, o_orderkey % 71 = 2 AS odd, o_orderkey FROM orders),
fil AS (SELECT name, coalesce(c.w, 640) * 2 AS w, CASE WHEN o_orderkey % 67 = 0 THEN 700 ELSE 960 END AS h, o_orderkey FROM img LEFT JOIN cam c USING (camera_id) WHERE o_orderkey % 73 <> 9)"""


@query(f"""WITH {_DATASET}, j AS (SELECT i.name, i.camera_id, i.odd, c.camera_id AS c, c.w, c.h, f.name AS f, f.w AS fw, f.h AS fh FROM img i LEFT JOIN cam c USING (camera_id) LEFT JOIN fil f ON f.name = i.name)
SELECT 'model' AS kind, NULL::VARCHAR AS image, camera_id AS camera FROM cam WHERE model <> 'PINHOLE' UNION ALL SELECT 'size', NULL, camera_id FROM cam WHERE h <= 0
UNION ALL SELECT 'parameter', NULL, camera_id FROM cam WHERE isnan(f)
UNION ALL SELECT 'pose', name, camera_id FROM j WHERE odd UNION ALL SELECT 'dangling', name, camera_id FROM j WHERE c IS NULL UNION ALL SELECT 'path', name, camera_id FROM j WHERE name LIKE '../%'
UNION ALL SELECT 'missing', name, camera_id FROM j WHERE f IS NULL UNION ALL SELECT 'aspect', name, camera_id FROM j WHERE h > 0 AND fh IS NOT NULL AND abs(fw / fh - w / h) > 1e-3 * w / h
UNION ALL SELECT 'mask_size', name, camera_id FROM j JOIN fil USING (name) WHERE fil.o_orderkey % 79 = 5""")
def preflight_faults(spark, sf_dir):
    """All faults of a dataset made of customers as cameras and orders as images."""
    from tessera.sources import preflight as checks

    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    real = lambda *e: F.array(*[F.expr(x).cast("double") for x in e])
    cameras = c.select(F.col("c_custkey").alias("camera_id"), F.expr("CASE WHEN c_custkey % 50 = 7 THEN 'OPENCV' ELSE 'PINHOLE' END").alias("model"), F.expr("640 + c_custkey % 9").alias("width"), F.expr("CASE WHEN c_custkey % 61 = 3 THEN 0 ELSE 480 END").alias("height"), real("CASE WHEN c_custkey % 53 = 5 THEN double('nan') ELSE 5e2 END", "5e2", "3e2", "2e2").alias("params"))
    key = F.col("o_orderkey")
    images = o.select(key.alias("key"), F.concat(F.when(key % 97 == 4, F.lit("../")).otherwise(F.lit("")), F.lit("i"), key.cast("string"), F.lit(".png")).alias("name"), (F.col("o_custkey") + F.when(key % 89 == 1, 100000000).otherwise(0)).alias("camera_id"), real("1", "0", "0", "0").alias("qvec"), real("CASE WHEN o_orderkey % 71 = 2 THEN double('inf') ELSE 0 END", "0", "1").alias("tvec"))
    wide = images.join(cameras.select("camera_id", "width"), "camera_id", "left").where("key % 73 <> 9")
    files = wide.select("name", (F.coalesce("width", F.lit(640)) * 2).alias("width"), F.expr("CASE WHEN key % 67 = 0 THEN 700 ELSE 960 END").alias("height"), "key")
    masks = files.select("name", F.expr("width + CASE WHEN key % 79 = 5 THEN 1 ELSE 0 END").alias("width"), "height")
    return checks.faults(cameras, images.drop("key"), files.drop("key"), masks)


@query("SELECT c_name AS name, (row_number() OVER (ORDER BY c_name) - 1) % 8 = 0 AS test FROM customer")
def llff_split(spark, sf_dir):
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"))
    return blocks.dense_rank(names, ["name"], "k").select("name", (F.col("k") % 8 == 0).alias("test"))


@query("SELECT c_name AS name FROM customer ORDER BY c_name LIMIT 12")
def name_limit(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).orderBy("name").limit(12)


@query("SELECT o_custkey AS src, count(*) AS weight FROM orders GROUP BY o_custkey HAVING count(*) > 10")
def consistency_edges(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("src")).agg(F.count("*").alias("weight")).where("weight > 10")


@query(f"WITH {POINTS} SELECT id, (sum(label) OVER (ORDER BY id) - label)::BIGINT AS at FROM pts")
def prefix_sum(spark, sf_dir):
    """Where each row's output begins: sums within range partitions, then over them."""
    p = points(spark, sf_dir).select("id", "label")
    return blocks.running_sum(p, ["id"], "label", "at").select("id", "at")


@query("WITH m AS (SELECT p_partkey AS pos, 1 AS d FROM part WHERE p_size = 3 UNION ALL SELECT p_partkey + 20, -1 FROM part WHERE p_size = 3), s AS (SELECT pos, sum(d) OVER (ORDER BY pos RANGE UNBOUNDED PRECEDING) AS inside FROM m) SELECT DISTINCT pos, inside::BIGINT AS depth FROM s")
def range_marks(spark, sf_dir):
    starts = table(spark, sf_dir, "part").where("p_size = 3").select(F.col("p_partkey").alias("pos"), F.lit(1).alias("d"))
    marks = starts.unionByName(starts.select((F.col("pos") + 20).alias("pos"), F.lit(-1).alias("d"))).groupBy("pos").agg(F.sum("d").alias("d"))
    return blocks.running_sum(marks, ["pos"], "d", "before").select("pos", (F.col("before") + F.col("d")).alias("depth"))


@query("WITH t AS (SELECT c_custkey AS camera, 640 + c_custkey % 700 AS w, 480 + c_custkey % 300 AS h FROM customer), n AS (SELECT *, ceil(w / 256e0)::BIGINT AS nx, ceil(h / 256e0)::BIGINT AS ny FROM t) SELECT camera, i + nx * j AS tile, w * i // nx AS x, h * j // ny AS y, w * (i + 1) // nx - w * i // nx AS tw, h * (j + 1) // ny - h * j // ny AS th FROM n, range(8) a(i), range(8) b(j) WHERE i < nx AND j < ny")
def tile_cover(spark, sf_dir):
    """Balanced tiles: each pixel of an image lies in one of them."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("camera"), (640 + F.col("c_custkey") % 700).alias("w"), (480 + F.col("c_custkey") % 300).alias("h"))
    t = t.withColumns({"nx": F.ceil(F.col("w") / 256), "ny": F.ceil(F.col("h") / 256)})
    t = t.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("nx") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ny") - 1)))
    cut = lambda n, k, m: F.expr(f"{n} * ({k}) DIV {m}")
    return t.select("camera", (F.col("i") + F.col("nx") * F.col("j")).alias("tile"), cut("w", "i", "nx").alias("x"), cut("h", "j", "ny").alias("y"), (cut("w", "i + 1", "nx") - cut("w", "i", "nx")).alias("tw"), (cut("h", "j + 1", "ny") - cut("h", "j", "ny")).alias("th"))


@query(f"""WITH {POINTS}, r AS (SELECT id, x AS p, y * 1e-1 AS m, abs(z) * 1e-2 AS v, CASE WHEN label <> 3 THEN d0 END AS g, background AS frozen FROM pts),
n AS (SELECT *, g IS NOT NULL AND NOT frozen AS k, 9e-1 * m + 1e-1 * g AS m1, 999e-3 * v + 1e-3 * g * g AS v1 FROM r)
SELECT id, round(CASE WHEN k THEN p - 1e-2 * (m1 / (1 - power(9e-1, 5))) / (sqrt(v1 / (1 - power(999e-3, 5))) + 1e-8) ELSE p END, 6) AS p, round(CASE WHEN k THEN m1 ELSE m END, 8) AS m, round(CASE WHEN k THEN v1 ELSE v END, 8) AS v FROM n""")
def adam_one_step(spark, sf_dir):
    r = points(spark, sf_dir).select("id", F.col("x").alias("p"), F.expr("y * 1e-1").alias("m"), F.expr("abs(z) * 1e-2").alias("v"), F.expr("CASE WHEN label <> 3 THEN d0 END").alias("g"), "background")
    return stateful.adam_step(r, 5, 0.01, F.col("background")).select("id", F.round("p", 6).alias("p"), F.round("m", 8).alias("m"), F.round("v", 8).alias("v"))


@query("WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey * 2 AS b FROM part UNION ALL SELECT p_partkey, p_partkey + 7 FROM part WHERE p_size = 10), r AS (SELECT 5::BIGINT AS step UNION SELECT e.b FROM r JOIN e ON e.a = r.step) SELECT step FROM r")
def invalidated_steps(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    edges = p.select(F.col("p_partkey").alias("before"), (2 * F.col("p_partkey")).alias("after")).unionByName(p.where("p_size = 10").select(F.col("p_partkey").alias("before"), (F.col("p_partkey") + 7).alias("after")))
    return stateful.downstream(edges, spark.createDataFrame([(5,)], "step long"))


@query("WITH v AS (SELECT c_custkey AS view, epoch FROM customer, range(3) e(epoch)), s AS (SELECT row_number() OVER (ORDER BY epoch, sha256('11:' || epoch || ':' || view), view) - 1 AS step, epoch, view FROM v) SELECT step, epoch, view FROM s WHERE step >= 40 AND step < (SELECT count(*) * 5 // 2 FROM customer)")
def view_schedule(spark, sf_dir):
    """Two and a half rounds over all views, from step 40 on."""
    views = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    return stateful.view_schedule(views, views.count() * 5 // 2, 11, 40)


@query(f"WITH {POINTS}, p AS (SELECT id, id % 3 AS mode, d0 AS c, d1 AS t, abs(d2) AS a, label >= 5 AS mask FROM pts) SELECT id, round(CASE WHEN mode = 0 THEN c WHEN mode = 1 THEN CASE WHEN mask THEN c ELSE t END ELSE c END, 6) AS image, round(CASE WHEN mode = 2 THEN CASE WHEN mask THEN t ELSE 5e-1 END ELSE t END, 6) AS target, round(CASE WHEN mode = 2 AND NOT mask THEN a ELSE 0 END, 6) AS alpha_loss FROM p")
def mask_targets(spark, sf_dir):
    """No mask, masked pixels ignored, or cropped to a background of one half."""
    t = {"image": "CASE WHEN id % 3 = 1 AND label < 5 THEN d1 ELSE d0 END", "target": "CASE WHEN id % 3 = 2 AND label < 5 THEN 5e-1 ELSE d1 END", "alpha_loss": "CASE WHEN id % 3 = 2 AND label < 5 THEN abs(d2) ELSE 0e0 END"}
    return points(spark, sf_dir).select("id", *[F.expr(f"round({e}, 6)").alias(n) for n, e in t.items()])


_BLUR = ", ".join(f"sum(g.w * {e}) AS {n}" for n, e in (("ma", "s.a"), ("mb", "s.b"), ("aa", "s.a * s.a"), ("bb", "s.b * s.b"), ("ab", "s.a * s.b")))


@query(f"""WITH {STEPS}, q AS (SELECT (step - 1) // 1000 AS image, (step - 1) % 40 AS x, (step - 1) // 40 % 25 AS y, value - floor(value) AS a, (value - floor(value)) * 9e-1 + 5e-2 AS b FROM steps),
k AS (SELECT d, exp(-d * d / 45e-1) / (SELECT sum(exp(-c * c / 45e-1)) FROM range(-5, 6) r(c)) AS w FROM range(-5, 6) r(d)), g AS (SELECT a.d AS dx, b.d AS dy, a.w * b.w AS w FROM k a, k b),
size AS (SELECT image, max(x) + 1 AS w, max(y) + 1 AS h FROM q GROUP BY image), px AS (SELECT image, x, y FROM size, range(40) u(x), range(25) v(y) WHERE x < w AND y < h),
m AS (SELECT px.image, px.x, px.y, {_BLUR} FROM px CROSS JOIN g LEFT JOIN q s ON s.image = px.image AND s.x = px.x + g.dx AND s.y = px.y + g.dy GROUP BY px.image, px.x, px.y),
c AS (SELECT image, ((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4)) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4)) AS s FROM m)
SELECT image, round(avg(s), 6) AS ssim FROM c GROUP BY image""")
def ssim(spark, sf_dir):
    """Images of 40 x 25 pixels from the event log, against their shifted selves."""
    e = steps(spark, sf_dir).select(F.floor((F.col("step") - 1) / 1000).alias("image"), ((F.col("step") - 1) % 40).alias("x"), (F.floor((F.col("step") - 1) / 40) % 25).alias("y"), F.expr("value - floor(value)").alias("a"))
    return stateful.ssim_of_images(e.withColumn("b", F.col("a") * 0.9 + 0.05)).select("image", F.round("ssim", 6).alias("ssim"))


def _walk_sql(share: str, there: str, starts: str = "SELECT id AS start, 0 AS step, id AS node FROM pts", length: int = 12, out: str = "SELECT start, step, node FROM w") -> str:
    """Walks from every point over its four nearest, drawn from hashes."""
    draw = lambda salt: f"('0x' || substr(sha256('3:{salt}:' || w.start || ':' || (w.step + 1)), 1, 13))::BIGINT / 4503599627370496e0"
    return f"""WITH RECURSIVE {POINTS}, d AS (SELECT a.id AS src, b.id AS dst, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM pts a JOIN pts b ON a.id <> b.id),
e AS (SELECT src, dst, sqrt(d2) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS k FROM d) WHERE k <= 4),
g AS (SELECT src, sum(weight) AS deg FROM e GROUP BY src), p AS (SELECT *, {share} AS p FROM e),
t AS (SELECT p.src, p.dst, p.p, g.deg, h.deg AS deg2, sum(p) OVER (PARTITION BY p.src ORDER BY p.dst ROWS UNBOUNDED PRECEDING) AS hi, sum(p) OVER (PARTITION BY p.src) AS whole FROM p JOIN g ON g.src = p.src JOIN g h ON h.src = p.dst),
w AS ({starts} UNION ALL SELECT w.start, w.step + 1, {there.replace("@", draw(1))} FROM w LEFT JOIN t ON t.src = w.node AND {draw(0)} * t.whole >= t.hi - t.p AND {draw(0)} * t.whole < t.hi WHERE w.step < {length})
{out}"""


@query(_walk_sql("1 / (weight + 2e1)", "coalesce(t.dst, w.node)"))
def random_walk(spark, sf_dir):
    edges = neighbours.nearest(points(spark, sf_dir), 4).select(F.col("id").alias("src"), F.col("nid").alias("dst"), F.sqrt("d2").alias("weight"))
    return stateful.walks(edges, points(spark, sf_dir).select(F.col("id").alias("node")), 12, 3)


@query(_walk_sql("weight", "CASE WHEN @ < t.deg / t.deg2 THEN coalesce(t.dst, w.node) ELSE w.node END"))
def metropolis_walk(spark, sf_dir):
    edges = neighbours.nearest(points(spark, sf_dir), 4).select(F.col("id").alias("src"), F.col("nid").alias("dst"), F.sqrt("d2").alias("weight"))
    return stateful.walks(edges, points(spark, sf_dir).select(F.col("id").alias("node")), 12, 3, accept_by_degree=True)


@query(
    _walk_sql(
        "1 / (weight + 2e1)", "coalesce(t.dst, w.node)",
        "SELECT s AS start, 0 AS step, v.id AS node FROM range(0, (SELECT count(*) FROM pts) // 10 + 2) r(s) JOIN (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k, count(*) OVER () AS n FROM pts) v ON v.k = CASE WHEN s = 0 THEN 0 ELSE ('0x' || substr(sha256('view:3:' || s), 1, 13))::BIGINT % v.n END",
        10, "SELECT step, view FROM (SELECT CASE WHEN start = 0 THEN 0 ELSE (start - 1) * 10 + step END AS step, node AS view FROM w WHERE step > 0 AND (start > 0 OR step = 1)) WHERE step < (SELECT count(*) FROM pts)",
    )
)
def graph_schedule(spark, sf_dir):
    """A step a point over the graph of four nearest ones, drawn anew every ten steps."""
    p = points(spark, sf_dir)
    edges = neighbours.nearest(p, 4).select(F.col("id").alias("src"), F.col("nid").alias("dst"), F.sqrt("d2").alias("weight"))
    return stateful.graph_schedule(edges, p.count(), 3, again=10).select("step", "view")


#: Levels of a heap that are aligned in one task.
TASK_LEVELS = 14


@query(None)
def rotation_align(spark, sf_dir):
    """Points in a heap by id: each one's rotation turned to its parent's turned one, from the root down."""
    entries = X.rotation("qw", "qx", "qy", "qz")
    r = points(spark, sf_dir).select((F.col("id") + 1).alias("code"), *[F.expr(t).alias(n) for n, t in zip(hierarchy.ROTATION, entries, strict=True)], *[F.exp(c).alias(c) for c in hierarchy.SCALES])
    bits = F.length(F.bin("code"))
    above = max((r.agg(F.max(bits)).first()[0] or 0) - TASK_LEVELS, 0)
    r = r.withColumn("cell", F.when(bits <= above, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", "code", (bits - above - 1).cast("int"))))
    return hierarchy.align(r).select((F.col("code") - 1).alias("id"), *[F.round(c, 6).alias(c) for c in (*hierarchy.ROTATION, *hierarchy.SCALES)])


@query(f"WITH {POINTS} SELECT id, round(greatest(exp(s0), exp(s1), exp(s2)), 5) AS s0, round(least(exp(s0), exp(s1), exp(s2)), 5) AS s2 FROM pts")
def covariance_scales(spark, sf_dir):
    """Scales back from covariances: the eigenvalues are the squared axes."""
    cov = X.covariance(X.rotation("qw", "qx", "qy", "qz"), ["exp(s0)", "exp(s1)", "exp(s2)"])
    c = points(spark, sf_dir).select("id", *[F.expr(t).alias(n) for n, t in zip(("xx", "xy", "xz", "yy", "yz", "zz"), cov, strict=True)])
    return stateful.eigen_scales(c).select("id", F.round("s0", 5).alias("s0"), F.round("s2", 5).alias("s2"))


#: What the build takes in: no missing or infinite opacity or one of zero, no odd place or rotation, no scale above 10.
VALID = "NOT isnan(op) AND abs(op) <= 1e300 AND op <> 0 AND NOT isnan(x + y + z + qw + qx + qy + qz) AND NOT isnan(s0 + s1 + s2) AND greatest(exp(s0), exp(s1), exp(s2)) <= 10"
_WEIGHT = f"{X.sigmoid('op')} * {X.surface('exp(s0)', 'exp(s1)', 'exp(s2)')}"
_COV = dict(zip(hierarchy.COVARIANCE, X.covariance(X.rotation("qw", "qx", "qy", "qz"), ["exp(s0)", "exp(s1)", "exp(s2)"]), strict=True))


def _merged(spark, sf_dir):
    p = points(spark, sf_dir).where(VALID)
    p = p.select("id", *hierarchy.AXES, F.expr(_WEIGHT).alias("w"), F.expr(RADIUS).alias("r"), "d0", "d1", "d2", *[F.expr(t).alias(c) for c, t in _COV.items()])
    return hierarchy.moments(hierarchy.merged(p, radius="r", also=("d0", "d1", "d2")))


_NODES_SQL = (
    f"WITH {POINTS}, v AS (SELECT * FROM pts WHERE {VALID}), {kd_full_sql('v')}, g AS (SELECT id, {_WEIGHT} AS w, d0, d2, "
    + ", ".join(f"{t} AS {c}" for c, t in _COV.items())
    + " FROM v), up AS (SELECT k14.cell >> r.i AS code, r.i, k14.x, k14.y, k14.z, k14.r AS radius, g.* FROM k14 JOIN g USING (id), range(0, 15) r(i) WHERE (k14.cell >> r.i) >= 1), "
    + "s AS (SELECT code, count(*) AS n, max(i)::BIGINT AS height, sum(w) AS w, "
    + ", ".join(f"sum(w * {a}) / sum(w) AS m{a}" for a in hierarchy.AXES)
    + ", "
    + ", ".join(f"sum(w * ({c} + {c[0]} * {c[1]})) / sum(w) AS m{c}" for c in hierarchy.COVARIANCE)
    + ", sum(w * d0) / sum(w) AS d0, sum(w * d2) / sum(w) AS d2, "
    + ", ".join(f"min({a} - radius) AS lo_{a}, max({a} + radius) AS hi_{a}" for a in hierarchy.AXES)
    + " FROM up GROUP BY code)"
)


@query(
    f"{_NODES_SQL} SELECT code, n, height, round(w, 5) AS w, "
    + ", ".join(f"round({c}, 5) + 0e0 AS {c}" for c in (*hierarchy.BOX, "d0", "d2"))
    + ", "
    + ", ".join(f"round(m{a}, 5) + 0e0 AS {a}" for a in hierarchy.AXES)
    + ", "
    + ", ".join(f"round(m{c} - m{c[0]} * m{c[1]}, 5) + 0e0 AS {c}" for c in hierarchy.COVARIANCE)
    + " FROM s"
)
def hierarchy_merge(spark, sf_dir):
    """Validity filter, k-d tree down to single points; weighted means, covariances, harmonics and boxes of all nodes."""
    return _merged(spark, sf_dir).select("code", "n", "height", *[F.round(c, 5).alias(c) for c in ("w", *hierarchy.AXES, *hierarchy.COVARIANCE, *hierarchy.BOX, "d0", "d2")])


@query(None)
def hierarchy_build(spark, sf_dir):
    """The build, end to end: what hierarchy_merge makes, as scales, rotations aligned from the root down, and opacities."""
    made = hierarchy.align(hierarchy.shapes(_merged(spark, sf_dir)))
    return made.select("code", F.shiftright("code", 1).alias("parent"), "point", "n", "height", *hierarchy.AXES, *[F.round(c, 5).alias(c) for c in (*hierarchy.SCALES, *hierarchy.ROTATION, "opacity")])


@query(
    f"{_NODES_SQL}, d AS (SELECT *, length(bin(code)) - 1 AS deep, code > 1 AS below FROM s), o AS (SELECT *, row_number() OVER (ORDER BY code << (20 - deep), deep) - 1 AS pre FROM d), "
    "f AS (SELECT *, CASE WHEN height > 0 THEN 1 + coalesce(sum(CASE WHEN height > 0 THEN 2 ELSE 0 END) OVER (ORDER BY pre ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE -1 END::BIGINT AS kids FROM o), "
    "p AS (SELECT f.*, CASE WHEN f.below THEN g.kids + (f.code & 1) ELSE 0 END AS place, g.code AS up FROM f LEFT JOIN f g ON g.code = f.code >> 1) "
    "SELECT p.place AS id, p.height::INT AS depth, coalesce(q.place, -1)::INT AS parent, p.pre::INT AS start, (p.height = 0)::INT AS count_leafs, p.kids::INT AS start_children, CASE WHEN p.height > 0 THEN 2 ELSE 0 END AS count_children, "
    "round(p.lo_x::FLOAT::DOUBLE, 4) + 0e0 AS lo_x, round(p.hi_z::FLOAT::DOUBLE, 4) + 0e0 AS hi_z FROM p LEFT JOIN p q ON q.code = p.up"
)
def hierarchy_build_file(spark, sf_dir):
    """The build written as a static hierarchy's file, in its layout, and its nodes read again."""
    from tessera.session import scratch
    from tessera.sources import hierarchies

    built = hierarchy.align(hierarchy.shapes(_merged(spark, sf_dir)))
    path = scratch(spark, "built") + ".hier"
    hierarchies.write_static(*hierarchy.static_tables(built, ["d0", "d1", "d2"]), path)
    back = hierarchies.read_static_nodes(spark, path)
    real = lambda c, k: F.round(F.get(c, F.lit(k)).cast("double"), 4)
    return back.select("id", "depth", "parent", "start", "count_leafs", "start_children", "count_children", real("box_min", 0).alias("lo_x"), real("box_max", 2).alias("hi_z"))
