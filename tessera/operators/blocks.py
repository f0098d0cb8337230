"""Blocks: bounds, pruning, paging, budgets and digests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Stretches of a running sum in which rows and picks meet.
STRETCHES = 4_096
#: Rows, or groups, that one group of a multinomial draw has.
GROUP = 4_096


def manifest(points: DataFrame, radius: str, key: str = "block") -> DataFrame:
    """Row count and bounds of every block, spheres included: a zone map."""
    r = F.expr(radius)
    sides = [f(F.col(c) + s * r).alias(f"{n}_{c}") for c in "xyz" for n, f, s in (("min", F.min, -1), ("max", F.max, 1))]
    return points.groupBy(key).agg(F.count("*").alias("row_count"), F.bool_or("background").alias("background"), *sides)


def candidates(manifest: DataFrame, hit: str) -> DataFrame:
    """Blocks whose box passes the planes; a filter on the small manifest, before any row is read."""
    return manifest.where(F.expr(hit))


def dense_rank(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with their 0-based place in the order of unique keys.

    Range partitions are sorted by themselves; only their sizes meet, so no
    task sorts all rows.
    """
    from tessera.session import staged

    sorted_ = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return sorted_.join(F.broadcast(before), "_part").withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_part", "_local", "_before")


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows before each in the order of
    unique keys: sums inside range partitions, and of the partitions before."""
    from tessera.session import staged

    part = staged(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "running")
    upto = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = part.groupBy("_part").agg(F.sum(value).alias("_s"))
    before = sums.select("_part", (F.sum("_s").over(Window.orderBy("_part")) - F.col("_s")).alias("_b"))  # a row per partition
    return part.withColumn(name, upto).join(F.broadcast(before), "_part").withColumn(name, F.col(name) + F.col("_b")).drop("_part", "_b")


def pages(rows: DataFrame, band: str, order: list[str], size: int) -> DataFrame:
    """``rows`` with a page number inside their band, ``size`` rows a page."""
    ranked = dense_rank(rows, [band, *order], "_place")
    first = ranked.groupBy(band).agg(F.min("_place").alias("_first"))  # a row per band, 64 at most
    return ranked.join(F.broadcast(first), band).withColumn("page", F.floor((F.col("_place") - F.col("_first")) / size).cast("long")).drop("_place", "_first")


def append_pages(rows: DataFrame, tails: DataFrame, size: int) -> DataFrame:
    """New rows (id, band) go to the room that the band's last page (band,
    used) has, as page 0, then to new pages."""
    ranked = dense_rank(rows, ["band", "id"], "_place")
    first = ranked.groupBy("band").agg(F.min("_place").alias("_first"))
    j = ranked.join(F.broadcast(first), "band").join(F.broadcast(tails), "band")
    k, room = F.col("_place") - F.col("_first"), F.lit(size) - F.col("used")
    return j.withColumn("page", F.when(k < room, F.lit(0)).otherwise(1 + F.floor((k - room) / size)).cast("long")).drop("_place", "_first", "used")


def largest_remainder(sizes: DataFrame, key: str, n: str, budget: int) -> DataFrame:
    """``budget`` units over the rows in proportion to n; what is left goes to
    the largest remainders, ties to the smaller key. Ranks come from range partitions."""
    total = sizes.agg(F.greatest(F.sum(n), F.lit(1)).alias("_t"))
    s = sizes.join(F.broadcast(total)).withColumns({"_base": F.floor(F.lit(budget) * F.col(n) / F.col("_t")).cast("long"), "_less": -((F.lit(budget) * F.col(n)) % F.col("_t"))})
    ranked = dense_rank(s, ["_less", key], "_k")
    over = ranked.agg((F.lit(budget) - F.sum("_base")).alias("_over"))
    return ranked.join(F.broadcast(over)).withColumn("share", F.col("_base") + F.when(F.col("_k") < F.col("_over"), 1).otherwise(0)).drop("_t", "_base", "_less", "_k", "_over")


def weighted_draws(rows: DataFrame, draws: int, step: int) -> DataFrame:
    """id and n for ``draws`` picks at i * step modulo the total weight (of whole
    numbers): each pick belongs to the row whose share of the running sum it falls in."""
    from tessera.session import staged

    part = staged(rows.repartitionByRange("id").sortWithinPartitions("id").withColumn("_part", F.spark_partition_id()), "draws")
    local = part.withColumn("_upto", F.sum("w").over(Window.partitionBy("_part").orderBy("id")))
    sums = part.groupBy("_part").agg(F.sum("w").alias("_w"))
    before = sums.select("_part", (F.sum("_w").over(Window.orderBy("_part")) - F.col("_w")).alias("_before"), F.sum("_w").over(Window.partitionBy(F.lit(0))).alias("_total"))
    placed = local.join(F.broadcast(before), "_part").withColumn("_upto", F.col("_upto") + F.col("_before"))
    placed = staged(placed, "draws")
    total = placed.agg(F.max("_total")).first()[0]
    if not total:
        return rows.limit(0).select("id", F.lit(0).cast("long").alias("n"))
    # rows and picks meet in equal stretches of the running sum; a row spans STRETCHES of them at most
    wide = max(1, -(-int(total) // STRETCHES))
    stretch = lambda c: F.floor(c / wide).cast("long")
    spans = placed.where("w > 0").withColumn("_s", F.explode(F.sequence(stretch(F.col("_upto") - F.col("w")), stretch(F.col("_upto") - 1))))
    picks = rows.sparkSession.range(draws).select(((F.col("id") * step) % F.lit(int(total))).alias("_at")).groupBy("_at").agg(F.count("*").alias("_picked"))
    hit = spans.join(picks.withColumn("_s", stretch(F.col("_at"))), "_s").where((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("w")))
    return hit.groupBy("id").agg(F.sum("_picked").alias("n"))


def multinomial(rows: DataFrame, draws: int, seed: int, weight: str = "w") -> DataFrame:
    """id and n of ``draws`` draws with replacement in proportion to ``weight``;
    rows that no draw hits are left out.

    The draws are split down: over a fixed number of groups of ids, then over
    the ids of a group, each time by binomials of what is left. Seeds come from
    the group, not from tasks, so the same rows give the same counts under any
    partitioning; nothing grows with the draws.
    """
    import numpy as np
    import pandas as pd

    from tessera.session import ship, staged

    spark = rows.sparkSession
    ship(spark)
    total = rows.where(F.col(weight) > 0).count()
    if not total or draws <= 0:
        return rows.limit(0).select("id", F.lit(0).cast("long").alias("n"))
    # groups by the order of ids, which no partitioning changes
    placed = dense_rank(rows.where(F.col(weight) > 0).select("id", F.col(weight).cast("double").alias("_w")), ["id"], "_k")
    placed = staged(placed.withColumn("_group", F.floor(F.col("_k") / GROUP).cast("long")), "drawn-from")
    sums = placed.groupBy("_group").agg(F.sum("_w").alias("_w"))

    def split(level: int):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            key = "_k" if level < 0 else "_group"
            pdf = pdf.sort_values(key, kind="stable")
            r = np.random.default_rng([seed, level + 2, int(pdf["_of"].iloc[0])])
            w = pdf["_w"].to_numpy()
            left, rest = int(pdf["_draws"].iloc[0]), np.cumsum(w[::-1])[::-1]
            out = np.zeros(len(w), np.int64)
            for k in range(len(w)):
                if not left:
                    break
                out[k] = left if k == len(w) - 1 else r.binomial(left, min(1.0, w[k] / rest[k]))
                left -= out[k]
            return pd.DataFrame({key: pdf[key], "n": out})

        return run

    # up: sums of groups of groups, until one is left
    tiers = [staged(sums, "draw-tier")]
    while tiers[-1].count() > 1:
        tiers.append(staged(tiers[-1].groupBy(F.floor(F.col("_group") / GROUP).cast("long").alias("_group")).agg(F.sum("_w").alias("_w")), "draw-tier"))
    # down: the draws of a group are dealt to its parts
    dealt = tiers[-1].select("_group", F.lit(draws).cast("long").alias("n"))
    for level in range(len(tiers) - 2, -1, -1):
        parts = tiers[level].withColumn("_of", F.floor(F.col("_group") / GROUP).cast("long"))
        j = parts.join(dealt.where("n > 0").select(F.col("_group").alias("_of"), F.col("n").alias("_draws")), "_of")
        dealt = staged(j.groupBy("_of").applyInPandas(split(level), "_group long, n long"), "draw-tier")
    j = placed.join(dealt.where("n > 0").select("_group", F.col("n").alias("_draws")), "_group").withColumn("_of", F.col("_group"))
    drawn = j.select("_of", "_k", "_w", "_draws").groupBy("_of").applyInPandas(split(-1), "_k long, n long").where("n > 0")
    return placed.join(drawn, "_k").select("id", "n")


def digest(rows: DataFrame, value: Column) -> DataFrame:
    """A digest of whole numbers that does not depend on the order of rows: their
    sum modulo 2 ** 62, in which rows that are equal count each."""
    total = F.coalesce(F.sum(value.cast("decimal(20,0)")), F.lit(0)) % F.lit(1 << 62)
    return rows.agg(total.cast("long").alias("digest"), F.count("*").alias("n"))


def bit_digest(rows: DataFrame) -> DataFrame:
    """n, added and mixed (sum and exclusive or of the rows' 64-bit hashes, modulo 2 ** 64), and the sum
    of each floating column. Hashes see bit patterns, so the smallest change
    shows; sum and mix don't depend on the order of rows."""
    h = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    total = F.sum(h.cast("decimal(20,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    real = [c for c, t in rows.dtypes if t in ("float", "double")]
    return rows.agg(F.count("*").alias("n"), F.coalesce(total, F.lit(0)).cast("string").alias("added"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("mixed"), *[F.sum(c).alias("sum_" + c) for c in real])


def orphans(files: DataFrame, named: list[DataFrame]) -> DataFrame:
    return files.join(reduce(DataFrame.unionByName, named).distinct(), "file", "left_anti")
