"""Immutable blocks with versioned manifests.

Blocks are Parquet folders of their own and never change; a manifest table
names the live ones with their bounds. A commit writes a new manifest, then one
small pointer with the next number, which is made whole before it gets its name
and never replaced: readers take the largest number, so they see the old state
or the new one, and of two writers with one number the second fails. Forking
copies the manifest only, and leaves a note of the fork with each store whose
files it names, so that their garbage collection passes over them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.blocks import manifest as bounds


class BlockStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # -- the pointer -----------------------------------------------------------
    def versions(self) -> list[str]:
        """Names of the current and the previous manifest."""
        last = self._last()
        if last < 0:
            return []
        return [r["value"] for r in self.spark.read.text(f"{self.root}/pointers/{last:012d}").collect()][0].split(",")

    def _names(self, folder: str) -> list[str]:
        p = self._path(f"{self.root}/{folder}")
        return [f.getPath().getName() for f in self._fs.listStatus(p)] if self._fs.exists(p) else []

    def _last(self) -> int:
        return max((int(n) for n in self._names("pointers") if n.isdigit()), default=-1)

    def _put(self, path: str, text: str) -> None:
        out = self._fs.create(self._path(path))
        out.write(bytearray(text.encode()))
        out.close()

    def _commit(self, name: str) -> None:
        number = self._last() + 1
        made = f"{self.root}/made/{uuid.uuid4().hex}"
        self._put(made, ",".join([name, *self.versions()[:1]]))
        target = self._path(f"{self.root}/pointers/{number:012d}")
        self._fs.mkdirs(self._path(f"{self.root}/pointers"))
        # a rename takes no name that is taken, but the local file system's does
        if self._fs.exists(target) or not self._fs.rename(self._path(made), target):
            raise RuntimeError("another writer has committed")

    def manifest(self, version: int = 0) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/manifests/{self.versions()[version]}")

    # -- writing ---------------------------------------------------------------
    def write(self, rows: DataFrame, radius: str, finite: bool = False, block_rows: int | None = None) -> None:
        """Write ``rows`` (with columns block, background, x, y, z) as new block
        folders; blocks of other numbers stay as they are. With ``finite`` a
        number that isn't is an error; a block of over ``block_rows`` rows is,
        too, and so are other columns than the store's. No error changes the store."""
        if self.versions():
            there = self.spark.read.parquet(self._full(self.manifest().select("file").first()["file"])) if self.manifest().take(1) else None
            if there is not None and set(there.columns) != set(rows.columns) - {"block"}:
                raise ValueError(f"the store's columns are {sorted(there.columns)}")
        if finite:
            for c, t in rows.dtypes:
                if t in ("float", "double"):
                    fine = ~F.isnan(c) & (F.abs(c) < float("inf"))
                    rows = rows.withColumn(c, F.when(fine, F.col(c)).otherwise(F.raise_error(F.lit(f"{c} is not finite")).cast(t)))
        new = uuid.uuid4().hex
        path = f"{self.root}/data/{new}"
        # until the commit no manifest names the folder
        self._put(f"{self.root}/pending/{new}", "")
        rows.repartition("block").write.partitionBy("block").parquet(path)
        fresh = bounds(self.spark.read.parquet(path), radius).withColumn("file", F.concat(F.lit(f"{new}/block="), F.col("block").cast("string")))
        fresh = fresh.withColumn("block", F.col("block").cast("long"))
        if block_rows is not None and (full := fresh.where(F.col("row_count") > block_rows).select("block").first()):
            raise ValueError(f"block {full[0]} has over {block_rows} rows")
        if self.versions():
            fresh = fresh.unionByName(self.manifest().join(fresh.select("block"), "block", "left_anti"))
        self._save(fresh)
        self._fs.delete(self._path(f"{self.root}/pending/{new}"), False)

    def _save(self, table: DataFrame) -> None:
        name = uuid.uuid4().hex
        table.write.parquet(f"{self.root}/manifests/{name}")
        self._commit(name)

    def drop(self, blocks: list[int]) -> None:
        self._save(self.manifest().where(~F.col("block").isin(blocks)))

    def fork(self, root: str) -> BlockStore:
        """A store of its own over the same files: what it writes goes to its folder."""
        other = BlockStore(self.spark, root)
        whole = F.col("file").startswith("/") | F.col("file").contains("://")
        here = self.manifest().withColumn("file", F.when(whole, F.col("file")).otherwise(F.concat(F.lit(f"{self.root}/data/"), "file")))
        roots = here.select(F.regexp_extract("file", "^(.*)/data/[0-9a-f]{32}/", 1).alias("r")).distinct().collect()  # one row a store
        for r in {self.root, *(r["r"] for r in roots)}:
            BlockStore(self.spark, r)._put(f"{r}/forks/{uuid.uuid4().hex}", other.root)
        other._save(here)
        return other

    def _forks(self) -> list[BlockStore]:
        return [BlockStore(self.spark, r["value"]) for r in self.spark.read.text(f"{self.root}/forks").distinct().collect()] if self._names("forks") else []

    # -- reading ---------------------------------------------------------------
    def _full(self, file: str) -> str:
        return file if file[0] == "/" or "://" in file else f"{self.root}/data/{file}"

    def read(self, hit: str | None = None, scores: DataFrame | None = None) -> DataFrame:
        """Rows of the live blocks whose bounds pass ``hit``; only their files
        are opened. Blocks without scores have zeros."""
        m = self.manifest() if hit is None else self.manifest().where(F.expr(hit))
        files = [r["file"] for r in m.select("file").collect()]  # one short name a block
        full = [self._full(f) for f in files]
        if not full:
            full_table = self.manifest().select("file").first()
            one = full_table["file"] if full_table else None
            if one is None:
                raise ValueError("the store has no blocks")
            rows = self.spark.read.parquet(self._full(one)).limit(0)
        else:
            rows = self.spark.read.parquet(*full)
        if scores is not None:
            rows = rows.join(scores, "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        return rows

    def collect_garbage(self) -> list[str]:
        """Delete data folders that neither the current nor the previous manifest
        names, of this store or of a fork, and that no unfinished write made.
        A write that failed for good stays pending: delete its note by hand."""
        there = set(self._names("data"))
        named = set(self._names("pending"))
        for store in (self, *self._forks()):
            for k in range(len(store.versions())):
                files = store.manifest(k).select(F.regexp_extract("file", "(?:^|/)([0-9a-f]{32})/block=", 1).alias("f"))
                named |= {r["f"] for r in files.distinct().collect()}
        gone = sorted(n for n in there - named if len(n) == 32 and all(c in "0123456789abcdef" for c in n))
        for n in gone:
            self._fs.delete(self._path(f"{self.root}/data/{n}"), True)
        return gone
