"""Subtree ranges kept as a table, of which a change recomputes its part.

The rows of a subtree lie in one bucket; a second table says to which subtree a
node belongs, bucketed by the node. A refresh finds the subtrees that own the
changed nodes, reads their buckets, computes the dirty subtrees anew and writes
these buckets under the next version; all other files stay as they are. A
pointer with the version of each bucket makes the new state visible at once.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tessera.operators import levels
from tessera.operators.relocation import jump
from tessera.session import staged
from tessera.sources.pointers import Pointers

#: Buckets of either table; what the driver learns of a refresh is at most a number a bucket.
BUCKETS = 256
#: Owner of a node above all subtrees.
ABOVE = -1


class Buckets:
    """A table of rows with a column ``bucket``, in versions by bucket."""

    def __init__(self, spark: SparkSession, root: str, state: dict[str, str], schema: StructType | None) -> None:
        self.spark, self.root, self.state, self.schema = spark, root, dict(state), schema

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of these buckets, all by default; no other file is opened."""
        wanted = {v: [] for v in self.state.values()}
        for b, v in self.state.items():
            if buckets is None or int(b) in buckets:
                wanted[v].append(int(b))
        inner = StructType([f for f in self.schema.fields if f.name != "bucket"])
        names = [f.name for f in inner.fields]
        out = None
        for v, some in wanted.items():
            if some:
                rows = self.spark.read.option("basePath", f"{self.root}/{v}").schema(StructType([*inner.fields, StructField("bucket", IntegerType())])).parquet(*[f"{self.root}/{v}/bucket={b}" for b in sorted(some)])
                out = rows if out is None else out.unionByName(rows)
        return self.spark.createDataFrame([], self.schema).select("bucket", *names) if out is None else out

    def write(self, rows: DataFrame, buckets: list[int] | None) -> None:
        """``rows`` become what these buckets hold (all, if None)."""
        version = uuid.uuid4().hex
        self.schema = rows.schema
        # hashed by root or node: rows of one bucket may come from many tasks, and need no shuffle
        rows.write.partitionBy("bucket").parquet(f"{self.root}/{version}")
        there = [r[0] for r in self.spark.read.schema(StructType([StructField("bucket", IntegerType())])).parquet(f"{self.root}/{version}").select("bucket").distinct().collect()]
        for b in list(self.state) if buckets is None else map(str, buckets):
            self.state.pop(str(b), None)
        self.state |= {str(b): version for b in there}


class RangeStore:
    """Ranges (root, id, min_d, max_d) of the subtrees of a tree.

    ``volume`` and ``own_min`` are expressions (as SQL text) over the nodes'
    columns. The subtrees' roots are the first nodes on each way down whose
    volume isn't over ``root_volume`` or that are leaves.
    """

    def __init__(self, spark: SparkSession, root: str, root_volume: float, volume: str, own_min: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.count = spark, root.rstrip("/"), buckets
        self.how = (root_volume, F.expr(volume), F.expr(own_min))
        self.pointers = Pointers(spark, self.root)

    # -- state -----------------------------------------------------------------
    def _state(self) -> dict:
        last = self.pointers.last()
        return json.loads(self.pointers.read(last)) if last >= 0 else {}

    def _tables(self) -> tuple[Buckets, Buckets, int]:
        s = self._state()
        if not s:
            raise ValueError("nothing has been built here")
        make = lambda name: Buckets(self.spark, f"{self.root}/{name}", s[name], StructType.fromJson(s[name + "_schema"]))
        return make("ranges"), make("members"), s["number"]

    def _commit(self, ranges: Buckets, members: Buckets, number: int) -> None:
        state = {"number": number, "ranges": ranges.state, "members": members.state, "ranges_schema": ranges.schema.jsonValue(), "members_schema": members.schema.jsonValue()}
        self.pointers.commit(number, json.dumps(state))

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(self.count)).cast("int")

    def _computed(self, nodes: DataFrame, bucket: Column) -> DataFrame:
        found = levels.subtree_ranges(nodes, *self.how)
        return found.withColumn("bucket", bucket)

    # -- the whole table ---------------------------------------------------------
    def build(self, nodes: DataFrame) -> None:
        """Compute everything from ``nodes`` (id, parent, depth, child_count, and what
        the expressions need)."""
        found = staged(self._computed(nodes, self._bucket("root")), "ranges")
        ranges, members = Buckets(self.spark, f"{self.root}/ranges", {}, None), Buckets(self.spark, f"{self.root}/members", {}, None)
        ranges.write(found.where("root IS NOT NULL"), None)
        members.write(found.select("id", F.coalesce("root", F.lit(ABOVE)).alias("root"), F.when(F.col("root").isNotNull(), F.col("bucket")).alias("home"), self._bucket("id").alias("bucket")), None)
        self._commit(ranges, members, self.pointers.last() + 1)

    def read(self) -> DataFrame:
        return self._tables()[0].read().select("root", "id", "depth", "min_d", "max_d")

    # -- changes -----------------------------------------------------------------
    def refresh(self, changes: DataFrame) -> dict[str, int]:
        """Apply ``changes``: rows of the nodes' columns for new and changed nodes
        (a parent whose children change is one), and ``gone``.

        Returns how many subtrees were dirty, rows of their buckets were read,
        and rows the table had. A dirty subtree whose root is now over the
        volume falls apart into smaller ones. Changes above the subtrees are an
        error: they shift the roots, so build anew.
        """
        ranges, members, number = self._tables()
        ch = staged(changes.withColumn("gone", F.coalesce("gone", F.lit(False))), "changes")
        some = lambda df, c: [r[0] for r in df.select(self._bucket(c).alias("b")).distinct().collect()]
        owner = members.read(some(ch, "id")).select("id", "root", "home")
        known = staged(ch.select("id", "parent").join(owner, "id", "left"), "owners")
        new = known.where("root IS NULL")
        # a new node belongs to the nearest node above it that is not new
        links = jump(new.select("id", F.col("parent").alias("to"), F.lit(0).alias("w"))).select("id", F.col("end").alias("_end"))
        links = staged(links, "links")
        ends = members.read(some(links, "_end")).select(F.col("id").alias("_end"), "root", "home")
        late = links.join(ends, "_end", "left")
        owned = staged(known.where("root IS NOT NULL").select("id", "root", "home").unionByName(late.select("id", "root", "home")), "owned")
        lost = owned.where(f"root IS NULL OR root = {ABOVE}").select("id").take(1)
        if lost:
            raise ValueError(f"node {lost[0][0]} is above all subtrees; build anew")
        dirty = owned.select("root", "home").distinct()
        homes = [r[0] for r in dirty.select("home").distinct().collect()]
        held = ranges.read(homes)
        dirty = staged(dirty, "dirty").select(F.col("root").alias("_dirty"))
        mine = staged(held.join(F.broadcast(dirty) if dirty.count() <= 10_000 else dirty, F.col("root") == F.col("_dirty"), "left"), "read")
        rest = mine.where("_dirty IS NULL").drop("_dirty")
        columns = [c for c in ch.columns if c != "gone"]
        old = mine.where("_dirty IS NOT NULL").join(ch.select("id"), "id", "left_anti")
        old = old.select(*[F.col(c) for c in columns], F.col("root").alias("_was"), F.col("bucket").alias("_home"))
        now = ch.where("NOT gone").join(owned.select("id", F.col("root").alias("_was"), F.col("home").alias("_home")), "id").select(*columns, "_was", "_home")
        forest = staged(old.unionByName(now), "forest")
        # each dirty subtree is a tree of its own
        forest = forest.withColumn("parent", F.when(F.col("id") == F.col("_was"), F.lit(-1).cast("long")).otherwise(F.col("parent")))
        parents = mine.where("id = root AND _dirty IS NOT NULL").select("id", F.col("parent").alias("_parent"))
        fresh = self._computed(forest, F.col("_home"))
        fresh = fresh.join(parents, "id", "left").withColumn("parent", F.coalesce("_parent", F.col("parent"))).drop("_parent")
        fresh = staged(fresh.select(*[F.col(c) for c in [*columns, "_was", "bucket", "root", "min_d", "max_d"]]), "fresh")
        keep = [f.name for f in ranges.schema.fields]
        out = rest.select(*keep).unionByName(fresh.where("root IS NOT NULL").select(*keep))
        rows, before = mine.count(), ranges.read().count()
        ranges.write(out, homes)
        # ownership of the nodes that are new, gone or in a subtree of another root now
        moved = fresh.select("id", F.coalesce("root", F.lit(ABOVE)).alias("root"), F.when(F.col("root").isNotNull(), F.col("bucket")).alias("home"))
        same = mine.where("_dirty IS NOT NULL").select("id", F.col("root").alias("_old"))
        moved = staged(moved.join(same, "id", "left").where("_old IS NULL OR _old <> root").select("id", "root", "home"), "moved")
        gone = mine.where("_dirty IS NOT NULL").select("id").join(fresh.select("id"), "id", "left_anti")
        touched = staged(moved.select("id").unionByName(gone), "touched")
        where = some(touched, "id")
        if where:
            stay = members.read(where).join(touched, "id", "left_anti").select("id", "root", "home", "bucket")
            members.write(staged(stay.unionByName(moved.withColumn("bucket", self._bucket("id"))), "members"), where)
        self._commit(ranges, members, number + 1)
        return {"dirty": dirty.count(), "rows_read": rows, "rows": before}
