"""Exact order statistics without sorting all rows in one task.

A sketch of the values gives a bracket around each wanted rank; counting the
values below and inside it tells whether the rank is there; the bracket is
narrowed until it holds few values. Each round is one aggregate over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values of a bracket that the driver sorts.
FEW = 50_000
#: Half the width of a bracket, as a share of the values that it is taken from.
MARGIN = 0.002


@dataclass
class _Bracket:
    """low < value < high (or no bound); ``below`` values are at or under low."""

    rank: int
    count: int
    below: int = 0
    low: float | None = None
    high: float | None = None
    value: float | None = None

    def inside(self, v: Column) -> Column:
        out = F.lit(True)
        out = out if self.low is None else out & (v > self.low)
        return out if self.high is None else out & (v < self.high)


def _values(rows: DataFrame, value: Column) -> tuple[DataFrame, int, int]:
    """The non-null values that are numbers, how many there are, and how many NaNs."""
    data = rows.select(value.cast("double").alias("_v")).where("_v IS NOT NULL")
    n, nans = data.agg(F.count("*"), F.count_if(F.isnan("_v"))).first()
    return data.where(~F.isnan("_v")), n - nans, nans


def order_statistics(rows: DataFrame, value: Column, ranks: list[int]) -> list[float | None]:
    """The values at 0-based ``ranks`` of the non-null values in ascending order;
    None where there is none. NaN counts as larger than any number."""
    data, real, nans = _values(rows, value)
    found = _at(data, real, nans, ranks)
    return [found.get(k) for k in ranks]


def quantiles(rows: DataFrame, value: Column, shares: list[float]) -> list[float | None]:
    """The values at ``shares`` (0 to 1) of the way through the non-null values in
    ascending order, interpolated between two; None if there are no values."""
    data, real, nans = _values(rows, value)
    n = real + nans
    if not n:
        return [None] * len(shares)
    places = [(n - 1) * p for p in shares]
    found = _at(data, real, nans, [k for x in places for k in (int(x), min(int(x) + 1, n - 1))])
    out = []
    for x in places:
        a, b = found[int(x)], found[min(int(x) + 1, n - 1)]
        out.append(a if x == int(x) else a + (b - a) * (x - int(x)))
    return out


def grouped_quantile(rows: DataFrame, key: str, value: str, tie: str, share: float, name: str) -> DataFrame:
    """``key`` and the value at ``share`` of the way through each group's non-null values,
    interpolated between two. ``tie`` tells equal values of a group apart. Rows
    are placed by range partitions, so no task holds a whole group."""
    from tessera.operators.blocks import dense_rank

    placed = dense_rank(rows.where(F.col(value).isNotNull()).select(F.col(key).alias("_g"), F.col(value).cast("double").alias("_v"), F.col(tie).alias("_t")), ["_g", "_v", "_t"], "_k")
    spans = placed.groupBy("_g").agg(F.min("_k").alias("_first"), F.count("*").alias("_n")).withColumnRenamed("_g", "_h")
    spans = spans.withColumn("_at", (F.col("_n") - 1) * F.lit(float(share))).withColumn("_lo", F.floor("_at"))
    j = placed.join(spans, F.col("_g").eqNullSafe(F.col("_h"))).withColumn("_d", F.col("_k") - F.col("_first") - F.col("_lo")).where("_d IN (0, 1)")
    two = j.groupBy("_g").agg(F.max(F.when(F.col("_d") == 0, F.col("_v"))).alias("_a"), F.max(F.when(F.col("_d") == 1, F.col("_v"))).alias("_b"), F.max(F.col("_at") - F.col("_lo")).alias("_f"))
    return two.select(F.col("_g").alias(key), F.when(F.col("_f") == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_f")).alias(name))


def _at(data: DataFrame, real: int, nans: int, ranks: list[int]) -> dict[int, float]:
    v = F.col("_v")
    wanted = {k for k in ranks if 0 <= k < real + nans}
    state = {k: _Bracket(k, real) for k in wanted if k < real}
    done = {k: float("nan") for k in wanted if k >= real}
    while len(done) < len(wanted):
        todo = [b for k, b in state.items() if k not in done]
        small = [b for b in todo if b.count <= FEW]
        if small:
            spans = {(b.low, b.high): b for b in small}
            hit = F.lit(False)
            for b in spans.values():
                hit = hit | b.inside(v)
            got = sorted(r[0] for r in data.where(hit).collect())  # at most FEW a span
            for b in small:
                here = [x for x in got if (b.low is None or x > b.low) and (b.high is None or x < b.high)]
                done[b.rank] = here[b.rank - b.below]
            continue
        asked = []
        for b in todo:
            at = (b.rank - b.below) / max(b.count - 1, 1)
            ends = F.array(F.lit(max(0.0, at - MARGIN)), F.lit(min(1.0, at + MARGIN)))
            asked.append(F.percentile_approx(F.when(b.inside(v), v), ends, 10_000))
        pairs = list(data.agg(*[a.alias(f"q{k}") for k, a in enumerate(asked)]).first())
        counts = []
        for k, (b, (lo, hi)) in enumerate(zip(todo, pairs, strict=True)):
            inside = b.inside(v)
            counts += [F.count_if(inside & c).alias(f"{n_}{k}") for n_, c in (("a", v < lo), ("b", v == lo), ("c", (v > lo) & (v < hi)), ("d", (v == hi) & (v > lo)))]
        seen = data.agg(*counts).first()
        for k, (b, (lo, hi)) in enumerate(zip(todo, pairs, strict=True)):
            at = b.rank - b.below
            under, first, between, last = (seen[f"{c}{k}"] for c in "abcd")
            if at < under:
                b.high, b.count = lo, under
            elif at < under + first:
                done[b.rank] = lo
            elif at < under + first + between:
                b.low, b.high, b.below, b.count = lo, hi, b.below + under + first, between
            elif at < under + first + between + last:
                done[b.rank] = hi
            else:
                skipped = under + first + between + last
                b.low, b.below, b.count = hi, b.below + skipped, b.count - skipped
    return done
