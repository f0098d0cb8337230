"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint of 64 bits is cut into three segments, so that of two
fingerprints which differ in at most four bits one segment differs in at most
one. Every segment is indexed as it is and once for each bit left out; rows
with the same key join by equality, and the whole fingerprints are compared in
the join itself. A key with one bit left out joins only rows whose bit is 0
with rows whose bit is 1, so equal segments meet under one key, not under all.

Equal fingerprints are one node, whatever the number of copies: copies are
never expanded into pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.text import slices
from tessera.session import ship

#: (lowest bit, width) of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
#: Shingles that are hashed and counted at a time.
CHUNK = 1 << 17


def fingerprints(texts: list[bytes | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """The unsigned 64-bit SimHash of each text in UTF-8.

    A-Z is lower-cased, words are runs without ASCII white space, every
    shingle of ``words`` words counts as often as it occurs; fewer words make
    one shingle, none gives zero.
    """
    import xxhash

    digest, out = xxhash.xxh64_intdigest, np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        parts = (text or b"").lower().split()
        if not parts:
            continue
        flat = b" ".join(parts)
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
        width = min(words, len(parts))
        begin = np.concatenate(([0], ends[: len(parts) - width] + 1)).tolist()
        end = ends[width - 1 :].tolist()
        ones = np.zeros(64, np.int64)
        for at in range(0, len(begin), CHUNK):
            part = zip(begin[at : at + CHUNK], end[at : at + CHUNK], strict=True)
            h = np.array([digest(flat[a:b], seed) for a, b in part], "<u8")
            ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out[k] = np.packbits(ones * 2 > len(begin), bitorder="little").view("<u8")[0]
    return out


def ident(text: F.Column) -> F.Column:
    """What tells rows with one id apart: a hash of the text, null as the empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def with_fingerprint(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, ident and fp (the fingerprint's bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = fingerprints(b.column(2).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["id", "ident", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, ident(F.col(text_col)), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, ident long, fp long")


def _field(at: int, width: int) -> F.Column:
    return F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << width) - 1))


def links(nodes: DataFrame, max_bits: int = 4) -> DataFrame:
    """Pairs (a, b) of different fingerprints of ``nodes`` (one column fp, no
    row twice) that differ in at most ``max_bits`` <= 5 bits; a pair may come
    more than once."""
    if max_bits > 5:
        raise ValueError("three segments cover at most five differing bits")
    kinds = []
    for s, (at, width) in enumerate(SEGMENTS):
        whole = _field(at, width)
        # bits 0-21 the segment, 22-27 the bit left out (63: none), 28-29 the segment's number
        tag = lambda i, s=s: (s << 28) | (i << 22)
        kinds.append(F.struct(whole.bitwiseOR(F.lit(tag(63))).cast("int").alias("key"), F.lit(None).cast("boolean").alias("bit")))
        kinds += [
            F.struct(whole.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << i))).bitwiseOR(F.lit(tag(i))).cast("int").alias("key"), (F.shiftrightunsigned("fp", at + i).bitwiseAND(F.lit(1)) == 1).alias("bit"))
            for i in range(width)
        ]
    # every row becomes 67: dealt out by number, which the engine doesn't merge into few tasks for being small, and by
    # another hash than the grouping's, or it would leave the rows where they are
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = nodes.repartition(tasks, F.xxhash64("fp")).select("fp", F.explode(F.array(*kinds)).alias("v")).select("fp", "v.key", "v.bit")
    a, b = index.select(F.col("fp").alias("a"), "key", F.col("bit").alias("abit")), index.select(F.col("fp").alias("b"), "key", F.col("bit").alias("bbit"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits
    halves = F.when(a["abit"].isNull(), F.col("a") < F.col("b")).otherwise(~F.col("abit") & F.col("bbit"))
    # the engine's estimate doesn't see that a row becomes 67, so by itself it would broadcast the index through the driver
    return a.hint("merge").join(b.hint("merge"), (a["key"] == b["key"]) & halves & near).select("a", "b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = 4) -> DataFrame:
    """id_col, ident, fp and component_id (the smallest id reachable over links)
    of every row of ``docs``.

    Defined results: null, empty and blank texts have fingerprint zero and link
    like any other; rows that repeat an id or a text are rows of the same node;
    a null id is never a component_id unless all ids of the component are null;
    an empty table gives no rows.
    """
    from tessera.session import staged

    rows = staged(with_fingerprint(docs, id_col, text_col), "simhash")
    nodes = rows.groupBy("fp").agg(F.min("id").alias("id"))
    labels = components(nodes.select(F.col("fp").alias("node"), F.col("id").alias("rank")), links(nodes.select("fp"), max_bits))
    return rows.join(labels.withColumnRenamed("node", "fp"), "fp").select(F.col("id").alias(id_col), "ident", "fp", F.col("component").alias("component_id"))


def hex16(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
