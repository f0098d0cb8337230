"""Shared storage of a session: where lineage is cut and tables are staged."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()

#: Bytes of rows that go to a Python worker at a time, about; a longer row goes alone.
BATCH_BYTES = 1 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of BATCH_BYTES, unless the session has a limit of its own.

    An executor holds each batch several times outside its heap (as vectors, as
    written, in the worker) and doesn't give that memory back; 10,000 texts to a
    batch, as Spark has it, take hundreds of MB.
    """
    if _BATCH_LIMIT not in spark.conf.getAll:
        spark.conf.set(_BATCH_LIMIT, f"{BATCH_BYTES}b")


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a session, so that they
    need no path of their own to it, and bound what they get at a time."""
    small_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    files = sorted(os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".py"))
    mark = hashlib.sha256()
    for f in files:
        with open(f, "rb") as g:
            mark.update(f.encode() + g.read())
    path = os.path.join(tempfile.mkdtemp(prefix="tessera-"), f"tessera-{mark.hexdigest()[:16]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in files:
            z.write(f, os.path.join("tessera", os.path.relpath(f, root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Only a session on one machine that names none, as in tests, gets a folder
    of its own; on a cluster that is an error.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/tessera/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> bool:
    """Delete all that this application has staged; results that were not written
    elsewhere can't be read any more. Returns whether there was anything."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_dir(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    ship(spark)
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
