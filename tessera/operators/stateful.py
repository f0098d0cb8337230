"""Step-ordered state: clocks, triggers, averages, optimizer steps, plans.

Everything is keyed by camera, block or row, so a window sees one key's steps;
a hot key's steps are ordered sums, which need only the key's own rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import ship


def visit_counter(steps: DataFrame, key: str = "camera") -> DataFrame:
    return steps.withColumn("visit", F.row_number().over(Window.partitionBy(key).orderBy("step")).cast("long"))


def coverage_clock(steps: DataFrame, area: Column, key: str) -> DataFrame:
    """Progress after each step: the running sum of the shares of an image that were covered."""
    w = Window.partitionBy(key).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("progress", F.sum(area).over(w))


def growth_trigger(clock: DataFrame, key: str, start: float, stop: float, interval: float) -> DataFrame:
    """Steps at which the progress of a key passes the next multiple of the interval strictly inside (start, stop)."""
    before = F.coalesce(F.lag("progress").over(Window.partitionBy(key).orderBy("step")), F.lit(0.0))
    due = (F.floor(before / interval + 1e-8) + 1) * F.lit(float(interval))
    return clock.withColumn("due", due).where((F.col("progress") + 1e-8 >= F.col("due")) & (F.col("due") > start) & (F.col("due") < stop))


def ema(steps: DataFrame, key: str, keep: float = 0.6) -> DataFrame:
    """The average after each key's last step: (1 - keep) * x + keep * previous, starting at 0.

    A weighted sum: step i of n has the weight (1 - keep) * keep ** (n - i), so
    it needs one window of counts and a sum, not an ordered fold.
    """
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.col("step").desc())) - 1
    weight = F.pow(F.lit(float(keep)), back)
    return steps.withColumn("_w", weight).groupBy(key).agg(((1 - keep) * F.sum(F.col("value") * F.col("_w"))).alias("ema"))


def adam_step(rows: DataFrame, step: int, rate: float, frozen: Column) -> DataFrame:
    """One step over rows (id, p, m, v, g): only rows with a gradient move, and frozen ones stay as they are."""
    moves = F.col("g").isNotNull() & ~frozen
    m, v = F.lit(0.9) * F.col("m") + F.lit(0.1) * F.col("g"), F.lit(0.999) * F.col("v") + F.lit(0.001) * F.col("g") * F.col("g")
    new = rows.withColumns({"_m": F.when(moves, m).otherwise(F.col("m")), "_v": F.when(moves, v).otherwise(F.col("v"))})
    stride = rate * (F.col("_m") / (1 - 0.9**step)) / (F.sqrt(F.col("_v") / (1 - 0.999**step)) + 1e-8)
    return new.select("id", F.when(moves, F.col("p") - stride).otherwise(F.col("p")).alias("p"), F.col("_m").alias("m"), F.col("_v").alias("v"))


def downstream(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """step of everything that depends, over any number of edges (before, after), on the changed steps."""
    from tessera.session import staged

    seen = staged(changed.select("step").distinct(), "steps")
    front = seen
    while front.take(1):
        new = front.join(edges, F.col("step") == F.col("before")).select(F.col("after").alias("step")).distinct()
        front = staged(new.join(seen, "step", "left_anti"), "steps")
        seen = seen.unionByName(front)
    return seen


def contract_matches(old: dict, new: dict, iteration: int, may_grow: tuple[str, ...]) -> tuple[bool, bool]:
    """(whether a run may go on, whether its scores begin anew): equal
    contracts, or only the named settings changed, none of them below what it
    was nor below the iteration reached."""
    if old == new:
        return True, False
    differ = {k for k in old.keys() | new.keys() if old.get(k) != new.get(k)}
    fine = differ <= set(may_grow) and all(k in old and k in new and new[k] >= old[k] for k in differ) and new.get("iterations", iteration) >= iteration
    return fine, fine


def walks(edges: DataFrame, starts: DataFrame, length: int, seed: int, accept_by_degree: bool = False, softening: float = 20.0) -> DataFrame:
    """start, step and node of a walk from each start node over edges (src, dst, weight).
    ``starts`` has node, and start if walks are to be told apart by something else.

    Plain walks choose a neighbour in proportion to 1 / (weight + softening);
    with ``accept_by_degree`` the proposal is in proportion to the weight and is
    taken with probability min(1, degree here / degree there), the degree being
    the sum of weights. Random numbers are hashes of seed, start and step, so
    walks do not depend on partitions. All walks go one step at a time, each
    step a join on the node they are at.
    """
    share = F.col("weight") if accept_by_degree else 1 / (F.col("weight") + softening)
    w = Window.partitionBy("src").orderBy("dst")
    table = edges.withColumn("_p", share)
    table = table.withColumns({"_hi": F.sum("_p").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_all": F.sum("_p").over(Window.partitionBy("src"))}).withColumn("_lo", F.col("_hi") - F.col("_p"))
    degree = edges.groupBy("src").agg(F.sum("weight").alias("deg"))
    table = table.join(degree, "src").join(degree.select(F.col("src").alias("dst"), F.col("deg").alias("deg2")), "dst", "left")
    from tessera.session import staged

    table = staged(table, "walk-edges")
    # 52 bits of a SHA-256, which any engine can draw again
    uniform = lambda k, salt: F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), "start", F.lit(k)), 256), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))
    now = starts.select(F.col("start" if "start" in starts.columns else "node").alias("start"), F.col("node"))
    out = now.withColumn("step", F.lit(0))
    for k in range(1, length + 1):
        j = now.withColumn("_u", uniform(k, 0)).join(table, (F.col("node") == F.col("src")) & (F.col("_u") * F.col("_all") >= F.col("_lo")) & (F.col("_u") * F.col("_all") < F.col("_hi")), "left")
        there = F.coalesce("dst", "node")
        if accept_by_degree:
            there = F.when(uniform(k, 1) < F.col("deg") / F.coalesce("deg2", "deg"), F.coalesce("dst", "node")).otherwise(F.col("node"))
        now = j.select("start", there.alias("node"))
        if k % 8 == 0:
            now = staged(now, "walk")
        out = out.unionByName(now.withColumn("step", F.lit(k)))
    return out.select("start", "step", "node")


def view_schedule(views: DataFrame, count: int, seed: int, start: int = 0) -> DataFrame:
    """step, epoch and view of steps ``start`` to ``count`` (exclusive) over the ids in
    ``views``: each epoch is a permutation in the order of a hash, so a run that
    begins anew at a step goes on as the first one would have."""
    from tessera.operators.blocks import dense_rank

    n = views.count()
    if not n or not 0 <= start <= count:
        raise ValueError("no views, or a start beyond the end")
    first, last = start // n, -(-count // n)
    epochs = views.sparkSession.range(first, max(last, first)).select(F.col("id").alias("epoch"))
    each = views.select(F.col("id").alias("view")).join(F.broadcast(epochs))
    shuffled = each.withColumn("_o", F.sha2(F.concat_ws(":", F.lit(seed), "epoch", "view"), 256))
    placed = dense_rank(shuffled, ["epoch", "_o", "view"], "_at")
    steps = placed.select((F.col("_at") + first * n).alias("step"), "epoch", "view")
    return steps.where((F.col("step") >= start) & (F.col("step") < count))


def graph_schedule(edges: DataFrame, count: int, seed: int, start: int = 0, again: int = 100) -> DataFrame:
    """step and view of steps ``start`` to ``count`` (exclusive) of a walk over a graph of
    views (src, dst, weight), each to a neighbour in proportion to
    1 / (weight + 20). It begins at the first view; after step 0 and every
    ``again``th one it goes on from a view drawn from all, so the stretches
    between are walked side by side, whatever the count. A view without a
    neighbour is an error.
    """
    from tessera.operators.blocks import dense_rank

    spark = edges.sparkSession
    if not 0 <= start <= count:
        raise ValueError("a start beyond the end")
    views = dense_rank(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), ["id"], "_k")
    n = views.count()
    if not n or views.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti").take(1):
        raise ValueError("a view has no neighbour")
    # stretch 0 is step 0; stretch s has the steps (s - 1) * again + 1 to s * again
    drawn = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit("view"), F.lit(seed), "start"), 256), 1, 13), 16, 10).cast("long") % n
    first, last = -(-start // again), -(-max(count - 1, 0) // again)
    starts = spark.range(first, last + 1).select(F.col("id").alias("start")).withColumn("_k", F.when(F.col("start") == 0, F.lit(0).cast("long")).otherwise(drawn))
    starts = starts.join(views.withColumnRenamed("id", "node"), "_k").select("start", "node")
    one = walks(edges, starts.where("start = 0"), 1, seed) if first == 0 else None
    rest = walks(edges, starts.where("start > 0"), again, seed)
    out = rest if one is None else rest.unionByName(one)
    step = F.when(F.col("start") == 0, F.lit(0)).otherwise((F.col("start") - 1) * again + F.col("step"))
    return out.where("step > 0").select(step.alias("step"), F.col("node").alias("view")).where((F.col("step") >= start) & (F.col("step") < count))


def ssim_of_images(pixels: DataFrame, image: str = "image") -> DataFrame:
    """Mean SSIM of images given as rows (image, x, y, a, b): an 11 x 11
    Gaussian window of sigma 1.5, zero beyond the border. One task holds one
    image, which has a bounded size."""
    k = np.exp(-((np.arange(11) - 5) ** 2) / (2 * 1.5**2))
    k /= k.sum()

    def blur(a: np.ndarray) -> np.ndarray:
        along = lambda r: np.convolve(r, k, "same") if len(r) >= 11 else np.convolve(np.pad(r, 5), k, "valid")
        return np.apply_along_axis(along, 0, np.apply_along_axis(along, 1, a))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, h = int(pdf["x"].max()) + 1, int(pdf["y"].max()) + 1
        a, b = np.zeros((h, w)), np.zeros((h, w))
        a[pdf["y"], pdf["x"]], b[pdf["y"], pdf["x"]] = pdf["a"], pdf["b"]
        ma, mb = blur(a), blur(b)
        va, vb, ab = blur(a * a) - ma * ma, blur(b * b) - mb * mb, blur(a * b) - ma * mb
        s = ((2 * ma * mb + 0.01**2) * (2 * ab + 0.03**2)) / ((ma * ma + mb * mb + 0.01**2) * (va + vb + 0.03**2))
        return pd.DataFrame({image: [pdf[image].iloc[0]], "ssim": [float(s.mean())]})

    ship(pixels.sparkSession)
    kind = pixels.schema[image].dataType.simpleString()
    return pixels.select(image, "x", "y", "a", "b").groupBy(image).applyInPandas(one, f"{image} {kind}, ssim double")


def eigen_scales(cov: DataFrame) -> DataFrame:
    """id and the square roots s0 >= s1 >= s2 of the eigenvalues of a covariance (xx, xy, xz, yy, yz, zz)."""
    ship(cov.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            c = pdf[["xx", "xy", "xz", "xy", "yy", "yz", "xz", "yz", "zz"]].to_numpy(float).reshape(-1, 3, 3)
            e = np.sqrt(np.abs(np.linalg.eigvalsh(c)))[:, ::-1]
            yield pd.DataFrame({"id": pdf["id"], "s0": e[:, 0], "s1": e[:, 1], "s2": e[:, 2]})

    return cov.mapInPandas(run, "id long, s0 double, s1 double, s2 double")
