"""Step logs as streams: coverage, scores and growth as state that survives restarts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.session import ship


def score_max(stream: DataFrame) -> DataFrame:
    """The largest value of each camera so far (update or complete mode)."""
    return stream.groupBy("camera").agg(F.max("value").alias("score"), F.count("*").alias("visits"))


def daily(stream: DataFrame, late: str = "1 day") -> DataFrame:
    """Windows of event time, an extension: steps and values of each day, with late rows up to a watermark."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def coverage(stream: DataFrame, interval: float) -> DataFrame:
    """camera, progress and fired for each camera and batch: the coverage so far
    and how many multiples of the interval it passed in this batch. Rows have
    camera, step and area; steps at or below the last one seen are repeats and
    do not count again."""

    ship(stream.sparkSession)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        progress, last = state.get if state.exists else (0.0, -1)
        before = progress
        rows = pd.concat(list(batches)).sort_values("step").drop_duplicates("step")
        rows = rows[rows["step"] > last]
        if len(rows):
            progress += float(rows["area"].sum())
            last = int(rows["step"].max())
            state.update((progress, last))
        fired = int(progress / interval + 1e-8) - int(before / interval + 1e-8)
        yield pd.DataFrame({"camera": [key[0]], "progress": [progress], "fired": [fired]})

    kind = stream.schema["camera"].dataType.simpleString()
    return stream.groupBy("camera").applyInPandasWithState(run, f"camera {kind}, progress double, fired int", "progress double, last long", "update", GroupStateTimeout.NoTimeout)
