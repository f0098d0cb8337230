import pytest
from pyspark.sql import functions as F

from tessera.streaming import steps


@pytest.fixture
def log(spark, tmp_path):
    rows = spark.range(200).select((F.col("id") % 5).alias("camera"), "id", F.col("id").alias("step"), ((F.col("id") * 37) % 101).cast("double").alias("value"), F.lit(0.1).alias("area"), (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.col("id").cast("int"))).alias("ts"))
    for k in range(4):
        rows.where((F.col("id") >= 50 * k) & (F.col("id") < 50 * k + 50)).write.mode("append").parquet(f"{tmp_path}/log")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/log"), rows, tmp_path


def finish(spark, df, mode, name, tmp):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_score_max(spark, log):
    stream, rows, tmp = log
    got = {(r["camera"], r["score"], r["visits"]) for r in finish(spark, steps.score_max(stream), "complete", "score_max", tmp)}
    want = {(r["camera"], r["score"], r["visits"]) for r in steps.score_max(rows).collect()}
    assert got == want


def test_coverage(spark, log):
    stream, _, tmp = log
    got = finish(spark, steps.coverage(stream, 1.0), "update", "coverage", tmp)
    last, fired = {}, {}
    for r in got:
        last[r["camera"]] = max(last.get(r["camera"], 0), r["progress"])
        fired[r["camera"]] = fired.get(r["camera"], 0) + r["fired"]
    assert set(fired.values()) == {int(v + 1e-8) for v in last.values()} or all(fired[c] == int(last[c] + 1e-8) for c in last)


def test_daily(spark, log):
    stream, rows, tmp = log
    got = finish(spark, steps.daily(stream), "append", "daily", tmp)
    assert 0 < len(got) < 10 and all(r["n"] <= 24 for r in got)
