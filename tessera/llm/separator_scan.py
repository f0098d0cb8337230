"""Token counts by a separator scan.

Token files are flat: little-endian unsigned integers of 2 or 4 bytes, an
end-of-document id after each document, no index. They are cut into blocks of
a fixed number of tokens; each block is read by itself and searched for the
separator with numpy. A document that spans blocks is put together by a prefix
scan over the blocks' summaries (number of separators, last separator), first
within runs of blocks, then over the runs, so that no task sees all blocks of
a long file.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.text import slices
from tessera.session import ship

#: Tokens in a block.
BLOCK = 4_000_000
#: Blocks in a run of the prefix scan.
RUN = 1024
#: Texts that are tokenised at a time.
BATCH = 256


def file_system(uri: str):
    """The store behind a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri))


def write_token_files(docs: DataFrame, folder: str, tokenizer: Callable[[], Callable[[list[str]], list]], separator: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2) -> DataFrame:
    """Write one token file for each partition of ``docs`` into ``folder``, a
    store that driver and executors share, and return file, n_tokens and ids
    (the documents' ids in the file's order), one row for each file.

    ``tokenizer`` makes, in the task, a function from texts to lists of ids. A
    repeated task writes the same file again: it appears under its name only
    when it is complete.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        name, ids, total = f"{root}/tokens-{context.partitionId():06d}.bin", [], 0
        part = f"{name}.{uuid.uuid4().hex}"
        encode, end = tokenizer(), np.array([separator], f"<u{width}")
        sink = None
        for b in slices(batches):
            texts = b.column(1).to_pylist()
            for at in range(0, len(texts), BATCH):
                for t in encode([t or "" for t in texts[at : at + BATCH]]):
                    row = np.asarray(t, np.int64)
                    if len(row) and (row.max() >= 1 << 8 * width or (row == separator).any()):
                        raise ValueError("a token id is too large or is the separator's")
                    sink = sink or store.open_output_stream(part)
                    sink.write(row.astype(f"<u{width}").tobytes() + end.tobytes())
                    total += len(row) + 1
            ids.append(b.column(0))
        if sink is None:
            return
        sink.close()
        store.move(part, name)
        flat = pa.chunked_array(ids).combine_chunks()
        flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([total], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["file", "n_tokens", "ids"])

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"file string, n_tokens long, ids array<{kind}>")


def blocks(spark: SparkSession, folder: str, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, block, from and to (in tokens) of every block of the files in ``folder``.

    A file whose size is no multiple of ``width`` is an error."""
    from pyarrow import fs

    store, root = file_system(folder)
    files = [f for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.path.endswith(".bin")]
    if odd := [f.path for f in files if f.size % width]:
        raise ValueError(f"not whole tokens of {width} bytes: {odd[:3]}")
    rows = spark.createDataFrame([(f.path, f.size // width) for f in files], "file string, n long")
    cut = rows.select("file", "n", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / block) - 1, F.lit(0)).cast("int"))).alias("block"))
    out = cut.select("file", "block", (F.col("block") * F.lit(block).cast("long")).alias("from"), F.least((F.col("block") + 1) * F.lit(block).cast("long"), "n").alias("to"))
    n = spark.sparkContext.defaultParallelism
    return out.repartition(max(n, min(20 * n, len(files))), "file", "block")


def scan(spark: SparkSession, folder: str, separator: int, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, ordinal (from 0), start (in tokens) and n_tokens of every document
    in the token files of ``folder``, separators not counted.

    Defined results: two separators in a row are an empty document; tokens
    after a file's last separator are a document that was cut off, with
    complete = false; an empty file has none.
    """

    ship(spark)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(folder)
        for b in batches:
            for file, k, lo, hi in zip(*(b.column(c).to_pylist() for c in ("file", "block", "from", "to")), strict=True):
                with store.open_input_file(file) as f:
                    f.seek(lo * width)
                    ids = np.frombuffer(f.read((hi - lo) * width), f"<u{width}")
                at = np.flatnonzero(ids == separator).astype(np.int64) + lo
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([k], pa.int32()), pa.array([hi], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), pa.array(at))], names=["file", "block", "hi", "at"])

    from tessera.session import staged

    found = staged(blocks(spark, folder, width, block).mapInArrow(search, "file string, block int, hi long, at array<long>"), "separators")
    short = found.select("file", "block", "hi", F.size("at").cast("long").alias("n"), F.when(F.size("at") > 0, F.element_at("at", -1)).alias("last"), F.floor(F.col("block") / RUN).alias("run"))
    inner = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    local = short.withColumns({"n_in": F.coalesce(F.sum("n").over(inner), F.lit(0)), "last_in": F.max("last").over(inner)})
    runs = short.groupBy("file", "run").agg(F.sum("n").alias("rn"), F.max("last").alias("rlast"))
    outer = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    ahead = runs.select("file", "run", F.coalesce(F.sum("rn").over(outer), F.lit(0)).alias("n_out"), F.max("rlast").over(outer).alias("last_out"))
    carried = local.join(ahead, ["file", "run"]).select("file", "block", (F.col("n_in") + F.col("n_out")).alias("before"), F.coalesce("last_in", "last_out", F.lit(-1).cast("long")).alias("prior"))
    each = found.join(carried, ["file", "block"]).select("file", "before", F.posexplode(F.arrays_zip(F.concat(F.array("prior"), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0)))).alias("p"), F.col("at").alias("q"))).alias("k", "z")).where("z.q IS NOT NULL")
    whole = each.select("file", (F.col("before") + F.col("k")).alias("ordinal"), (F.col("z.p") + 1).alias("start"), (F.col("z.q") - F.col("z.p") - 1).alias("n_tokens"), F.lit(True).alias("complete"))
    ends = short.groupBy("file").agg(F.max("hi").alias("hi"), F.max("last").alias("last"), F.sum("n").alias("n"))
    cut = ends.select("file", F.col("n").alias("ordinal"), (F.coalesce("last", F.lit(-1)) + 1).alias("start"), (F.col("hi") - F.coalesce("last", F.lit(-1)) - 1).alias("n_tokens"), F.lit(False).alias("complete")).where("n_tokens > 0")
    return whole.unionByName(cut)


def rank_tokenizer(path: str, pattern: str) -> Callable[[], Callable[[list[str]], list]]:
    """A byte-level BPE from a file of ranks, made once in each worker."""

    def make() -> Callable[[list[str]], list]:
        encoder = _encoder(path, pattern)
        return lambda texts: [encoder.encode_ordinary(t) for t in texts]

    return make


_made: dict = {}


def _encoder(path: str, pattern: str):
    if path not in _made:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _made[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _made[path]


def token_counts(docs: DataFrame, folder: str, tokenizer: Callable, separator: int, id_col: str = "doc_id", text_col: str = "text", width: int = 2, block: int = BLOCK) -> DataFrame:
    """id_col, file, ordinal, start and n_tokens of every row of ``docs``: the
    texts are written as token files, which are then scanned.

    Defined results: null and empty texts are empty documents; rows that repeat
    an id are documents of their own; an empty table has no rows.
    """
    from tessera.session import staged

    spark = docs.sparkSession
    listing = staged(write_token_files(docs, folder, tokenizer, separator, id_col, text_col, width), "listing")
    named = listing.select("file", F.posexplode("ids").alias("ordinal", id_col)).withColumn("ordinal", F.col("ordinal").cast("long"))
    found = scan(spark, folder, separator, width, block)
    return named.join(found, ["file", "ordinal"]).select(id_col, "file", "ordinal", "start", "n_tokens")
