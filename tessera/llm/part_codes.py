"""Vector codes of 16 parts, each the nearest of 64 entries, by partial distances.

The dimensions of a part are taken in descending variance over its codebook.
Squared differences add up in whole numbers; an entry is dropped for a vector
as soon as its sum strictly exceeds the best complete distance known for that
vector, so what is left at the end holds all nearest entries, ties included.

Spark deals the vectors out: each task adds up what it assigned, a row an
entry; the sums of 16 x 64 entries are all that meets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import ship, staged

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: A component is floor(SCALE * x).
SCALE = 256
#: Vectors that are compared with a codebook at a time, and entries that get complete distances together.
ROWS, BLOCK = 2_000, 16
#: Components above this could make a sum of squares leave 64 bits.
LARGEST = 1 << 26


def nearest(vectors: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each vector's nearest entry of ``book`` (the lowest of ties),
    and its squared distance. Both of whole numbers, a row a vector or entry."""
    order = np.argsort(-book.astype(float).var(axis=0), kind="stable")
    x, c = vectors[:, order], book[:, order]
    # a first complete distance: that to the entry that is nearest in the first dimension
    rank = np.argsort(c[:, 0], kind="stable")
    at = rank[np.clip(np.searchsorted(c[rank, 0], x[:, 0]), 0, len(c) - 1)]
    best = ((x - c[at]) ** 2).sum(axis=1)
    for start in range(0, len(c), BLOCK):
        block = c[start : start + BLOCK]
        total = (x[:, :1] - block[None, :, 0]) ** 2
        row, entry = np.nonzero(total <= best[:, None])
        total = total[row, entry]
        for d in range(1, c.shape[1]):
            total = total + (x[row, d] - block[entry, d]) ** 2
            alive = total <= best[row]
            row, entry, total = row[alive], entry[alive], total[alive]
        # complete now; rows ascend and within a row entries, so the first that equals a row's least is its lowest
        least = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(least, row, total)
        hit = total == least[row]
        first = np.unique(row[hit], return_index=True)
        found, its = first[0], entry[hit][first[1]] + start
        closer = (least[found] < best[found]) | ((least[found] == best[found]) & (its < at[found]))
        best[found[closer]], at[found[closer]] = least[found[closer]], its[closer]
    return at, best


def assign(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of each part of ``vectors`` (rows, parts, width)."""
    pairs = [nearest(vectors[:, p], books[p]) for p in range(vectors.shape[1])]
    return np.stack([a for a, _ in pairs], axis=1), np.stack([d for _, d in pairs], axis=1)


def usable(vector: Column, parts: int = PARTS) -> Column:
    """Whether a vector has components, finite ones, that can be cut into equal parts."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & finite


def _ints(column: pa.ListArray, parts: int) -> np.ndarray:
    x = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(x) and np.abs(x).max() > LARGEST:
        raise ArithmeticError(f"a component of over {LARGEST // SCALE} can't be summed in whole numbers of 64 bits")
    return x.astype(np.int64).reshape(len(column), parts, -1)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of the usable vectors (id, vector).

    They start as the parts of the ``entries`` smallest ids (repeated ids by
    their components); fewer vectors give fewer entries. A round replaces each
    entry by the floor of its parts' mean; unused ones stay.
    """
    first = [r[0] for r in vectors.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).select("vector").collect()]
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = _ints(pa.array(first, pa.list_(pa.float64())), parts).transpose(1, 0, 2)
    width = books.shape[2]
    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], books: np.ndarray = books) -> Iterator[pa.RecordBatch]:
            total = np.zeros(books.shape, np.int64)
            count = np.zeros(books.shape[:2], np.int64)
            for b in _batches(batches):
                x = _ints(b.column(0), parts)
                at, _ = assign(x, books)
                for p in range(parts):
                    np.add.at(total[p], at[:, p], x[:, p])
                    count[p] += np.bincount(at[:, p], minlength=books.shape[1])
            p, e = np.nonzero(count)
            flat = pa.array(total[p, e].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * width), flat)], names=["part", "entry", "n", "total"])

        found = vectors.select("vector").mapInArrow(sums, "part long, entry long, n long, total array<long>")
        whole = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[k]) for k in range(width)]).alias("total"))
        books = books.copy()
        for p, e, n, total in whole.collect():  # at most parts * entries rows
            books[p, e] = np.array(total, np.int64) // n
    return books


def books_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """``id_col``, code, error, label_error and codebooks_sha256 of each vector kept.

    code has two hex digits a part; label_error is the sum over the rows of a
    label, nulls together. Defined results: a vector that is null or empty,
    holds a null or non-finite component, can't be cut into ``parts`` equal
    parts or has another length than that of the smallest id left, is dropped;
    rows that repeat an id are coded each; null ids come after all others;
    components of over LARGEST / SCALE are an error; an empty table gives an
    empty table. Other columns are not read.
    """
    ship(rows.sparkSession)
    kept = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")).where(usable(F.col("vector"), parts))
    first = kept.orderBy(F.asc_nulls_last("id"), "vector").select(F.size("vector")).first()
    kept = kept.where(F.size("vector") == (first[0] if first else 0))
    books = learn(kept, parts, entries, rounds)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            at, d = assign(_ints(b.column(2), parts), books)
            texts = [bytes(r).hex() for r in at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(d.sum(axis=1))], names=["id", "label", "code", "error"])

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*kept.schema.fields[:2], StructField("code", StringType()), StructField("error", LongType())])
    # written: read for the sums and for the rows, and what a join of a common label has a shuffle of its own for
    coded = staged(kept.mapInArrow(code, schema), "codes")
    sums = staged(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors").withColumnRenamed("label", "of")
    joined = coded.join(sums, coded["label"].eqNullSafe(sums["of"]))
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(books_sha256(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """One round of the SQL: assignment to books b<k>, and books b<k + 1>."""
    near = f"""n{k} AS MATERIALIZED (
  SELECT vec_id, p, min(d * 64 + entry) % 64 AS entry, min(d * 64 + entry) // 64 AS d
  FROM (SELECT v.vec_id, v.p, b.entry, list_sum(list_transform(list_zip(v.x, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d
        FROM v JOIN b{k} b ON v.p = b.p) GROUP BY vec_id, p
)"""
    books = f"""b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (
    SELECT p, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (
      SELECT n.p, n.entry, i, sum(v.x[i])::BIGINT AS s, count(*) AS n
      FROM n{k} n JOIN v ON v.vec_id = n.vec_id AND v.p = n.p, (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM v))) AS i)
      GROUP BY n.p, n.entry, i) GROUP BY p, entry) m ON m.p = b.p AND m.entry = b.entry
)"""
    return near + (", " + books if k < ROUNDS else "")


#: Rows of op13, for unique ids and vectors of one length.
ORACLE = f"""
WITH kept AS (
  SELECT vec_id, label, embedding AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), v AS MATERIALIZED (
  SELECT vec_id, label, p, list_transform(e[p * (len(e) // 16) + 1 : (p + 1) * (len(e) // 16)], lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x
  FROM kept, (SELECT unnest(generate_series(0, 15)) AS p)
), b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS entry, x AS c
  FROM v WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)
), {", ".join(_round(k) for k in range(ROUNDS + 1))}, sha AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, entry)) AS s FROM b{ROUNDS}
), rows AS (
  SELECT n.vec_id, v.label, string_agg(lower(lpad(to_hex(n.entry), 2, '0')), '' ORDER BY n.p) AS code, sum(n.d)::BIGINT AS error
  FROM n{ROUNDS} n JOIN v ON v.vec_id = n.vec_id AND v.p = n.p GROUP BY n.vec_id, v.label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, s AS codebooks_sha256 FROM rows, sha
"""
