"""How filters interact, with exact duplicates found by a fingerprint-routed RDD.

Each text goes to the partition of its xxhash. There (and before the shuffle,
in the partition it comes from) a table keeps for each fingerprint a chain of
the different texts that have it, each in full with its smallest id; rows of
any other id are sent on as duplicates at once. So a text that a third of all
rows share is shuffled once a partition, not once a row.

A document's failures are a mask of five bits. ``combineByKey`` adds up, for
each part, how many documents have each mask; all orders of the filters are
read from these 32 counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import ship

FILTERS = "ABCDE"
#: The bit of the filter that duplicates fail.
SEEN = 1 << FILTERS.index("E")
#: Bytes of text that a table holds before the shuffle until it is sent on, and that a partition gets of the texts of all rows.
HELD_BYTES, PARTITION_BYTES = 32_000_000, 64_000_000

#: (smallest id, rows of that id by payload)
Owner = tuple[int, Counter]


def mask_of(text: str) -> int:
    """Bits of the filters A to D that a text fails."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at space and U+0009 to U+000D
    few = len(words) < 100
    same = 100 * len(set(words)) < 80 * len(words)
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    loud = 100 * upper > 10 * len(text)
    signs = any(c in raw for c in (b"#", b"$", b"%", b"&", b"*", b"|"))
    return few | same << 1 | loud << 2 | signs << 3


class Chains:
    """For each fingerprint its different texts, each with its owner."""

    def __init__(self) -> None:
        self.of: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, owner: Owner) -> Owner | None:
        """Takes a row in; what is no longer the smallest of its text comes back."""
        chain = self.of.setdefault(key, [])
        for link in chain:
            if link[0] == text:
                (least, rows), (new, more) = link[1], owner
                if new == least:
                    rows.update(more)
                    return None
                link[1] = min(link[1], owner, key=lambda o: o[0])
                return owner if new > least else (least, rows)
        chain.append([text, owner])
        self.bytes += len(text) + 200
        return None

    def drain(self) -> Iterator[tuple[int, tuple[bytes, Owner]]]:
        for key, chain in self.of.items():
            for text, owner in chain:
                yield key, (text, owner)
        self.of, self.bytes = {}, 0


def routed(rows: RDD, partitions: int, fingerprint=xxhash.xxh64_intdigest, held_bytes: int = HELD_BYTES) -> RDD:
    """From rows (id, text as bytes, payload) to (id, payload, n, smallest):
    ``smallest`` says whether no smaller id has the same text; ``n`` rows were
    equal. A null id is neither smaller nor larger than any."""

    def before(part: Iterator) -> Iterator:
        chains = Chains()
        no_id: Counter = Counter()
        for ident, text, payload in part:
            if ident is None:
                no_id[payload] += 1
                continue
            gone = chains.add(fingerprint(text), text, (ident, Counter({payload: 1})))
            if gone:
                yield from ((gone[0], (gone[0], p, n, False)) for p, n in gone[1].items())
            if chains.bytes > held_bytes:
                yield from chains.drain()
        yield from chains.drain()
        yield from ((k, (None, p, n, True)) for k, (p, n) in enumerate(no_id.items()))

    def after(part: Iterator) -> Iterator:
        chains = Chains()
        for key, value in part:
            if len(value) == 4:  # settled before the shuffle, dealt out by its id
                yield value
                continue
            gone = chains.add(key, *value)
            if gone:
                yield from ((gone[0], p, n, False) for p, n in gone[1].items())
        for _, (_, (ident, held)) in chains.drain():
            yield from ((ident, p, n, True) for p, n in held.items())

    return rows.mapPartitions(before).partitionBy(partitions, lambda k: k).mapPartitions(after)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Rows (id, part, mask, n): n rows of this id and part fail the filters in ``mask``."""
    spark = docs.sparkSession
    ship(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"))
    # a partition holds its different texts in memory: as many partitions as all bytes need
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    rows = plain.rdd.map(lambda r: (r[0], r[1].encode("utf-8", "surrogatepass"), (r[2], mask_of(r[1]))))
    found = routed(rows, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES)))
    flat = found.map(lambda r: (r[0], r[1][0], r[1][1] | (0 if r[3] else SEEN), r[2]))
    return spark.createDataFrame(flat, "id long, part string, mask int, n long", verifySchema=False)


def non_minimum(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of the documents whose text a smaller id has, as (id, n rows)."""
    found = judged(docs.withColumn("_part", F.lit("")), id_col, text_col, "_part")
    return found.where(F.col("mask").bitwiseAND(F.lit(SEEN)) != 0).groupBy("id").agg(F.sum("n").alias("n"))


def report(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of one part from its counts (documents, good, toxic) by mask."""
    masks = np.arange(32)
    has = {f: (masks >> k & 1).astype(bool) for k, f in enumerate(FILTERS)}
    fails = np.array([bin(m).count("1") for m in masks])
    docs = counts[0]
    # of the filters that a document fails, each comes first in equally many of the 120 orders
    share = {f: int((docs[has[f]] * (120 // fails[has[f]])).sum()) for f in FILTERS}
    alone = {f: int(docs[1 << k]) for k, f in enumerate(FILTERS)}
    for order in permutations(FILTERS):
        left = np.ones(32, bool)
        for step, f in enumerate(order, 1):
            here = left & has[f]
            redundant = int(docs[~left & has[f]].sum())
            left = left & ~has[f]
            yield part, "".join(order), step, int(docs[left].sum()), int(docs[here].sum()), redundant, alone[f], int(counts[1][here].sum()), int(counts[2][here].sum()), share[f]


SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """600 rows for each part: every order of the filters, step by step.

    Defined results: a null text is the empty one, a null part the empty
    string; rows that repeat an id count each, and those of one id and text are
    no duplicates of each other; a row with a null id is never a duplicate and
    has no labels; a document is good or toxic if one of its label rows says
    so; an empty table gives an empty table.
    """
    one = lambda c: F.max((F.col(c) == 1).cast("int")).alias(c)
    known = labels.groupBy(F.col(id_col).cast("long").alias("id")).agg(one("quality"), one("toxic"))
    rows = judged(docs, id_col, text_col, part_col).join(known, "id", "left")
    small = rows.select("part", "mask", "n", F.coalesce("quality", F.lit(0)), F.coalesce("toxic", F.lit(0))).rdd

    def add(total: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, toxic = row
        total[:, mask] += (n, n * good, n * toxic)
        return total

    counts = small.map(lambda r: (r[0], tuple(r[1:]))).combineByKey(lambda row: add(np.zeros((3, 32), np.int64), row), add, lambda a, b: a + b)
    return docs.sparkSession.createDataFrame(counts.flatMap(lambda kv: report(*kv)), SCHEMA, verifySchema=False)


#: Rows of op12.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part,
         list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS w,
         coalesce(min(doc_id) OVER (PARTITION BY coalesce(text, '')) < doc_id, false) AS e
  FROM documents
), m AS (
  SELECT d.doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w),
         100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t),
         regexp_matches(t, '[#$%&*|]'), e] AS f,
         coalesce(q, 0) AS q, coalesce(x, 0) AS x
  FROM d LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS q, max((toxic = 1)::INT) AS x FROM labels GROUP BY doc_id) l
    ON d.doc_id = l.doc_id
), l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS a), o AS (
  SELECT a.a || b.a || c.a || d.a || e.a AS filter_order
  FROM l a, l b, l c, l d, l e
  WHERE len(list_distinct([a.a, b.a, c.a, d.a, e.a])) = 5
), g AS (
  SELECT part, f, count(*) AS n, sum(q) AS q, sum(x) AS x FROM m GROUP BY part, f
), s AS (
  SELECT part, filter_order, step, f, n, q, x,
         f[ascii(substr(filter_order, step, 1)) - 64] AS here,
         len(list_filter(range(1, step), lambda j: f[ascii(substr(filter_order, j, 1)) - 64])) > 0 AS gone
  FROM g, o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), r AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (NOT here AND NOT gone), 0) AS kept,
         coalesce(sum(n) FILTER (here AND NOT gone), 0) AS removed,
         coalesce(sum(n) FILTER (here AND gone), 0) AS redundant,
         coalesce(sum(n) FILTER (here AND len(list_filter(f, lambda b: b)) = 1), 0) AS unique_fails,
         coalesce(sum(q) FILTER (here AND NOT gone), 0) AS good_lost,
         coalesce(sum(x) FILTER (here AND NOT gone), 0) AS toxic_lost
  FROM s GROUP BY part, filter_order, step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant,
       unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
       (sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1)))::BIGINT AS shapley
FROM r
"""
