"""Line deduplication with DataFrame operations only.

Lines are exploded, normalised and hashed to 128 bits; the documents of each
hash are counted; lines over the threshold go from all documents but one, and
what stays is put together again by position.

Only hashes, ids and positions are shuffled for the count. A hash that a third
of all documents share costs one partial row per task in the count, and its
rows of the marking join can be split by the engine (inner sort-merge join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import BLANKS, ascii_lower, fresh
from tessera.session import staged


def trimmed(line: Column) -> Column:
    """A line without white space at its ends."""
    return F.btrim(line, F.lit(BLANKS))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with repeated lines removed from ``text_col``, and n_lines, n_dropped.

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines, except in the largest id that holds it.

    Defined results: a null or empty text is one empty line; a document is its
    id, so rows that repeat an id count once and lose the same keys; a null id
    is one document, below every other; an empty table gives an empty table.
    Other columns stay as they are. If ``docs`` has columns n_lines or
    n_dropped, the new ones get underscores in front.
    """
    n_lines, n_dropped, ident, lines, gone, of, its = fresh(docs, ["n_lines", "n_dropped", "ident", "lines", "gone", "of", "its"])
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.withColumn(ident, F.xxhash64(text))
    split = F.split(text, "\n", -1)
    # each line is normalised once: an inner transform, whose result the outer one hashes twice
    keys = F.transform(F.split(ascii_lower(text), "\n", -1), trimmed)
    hashed = F.transform(keys, lambda k, i: F.struct(i.alias("pos"), F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), (F.char_length(k) >= min_chars).alias("long")))
    rows = base.select(F.col(id_col).alias("id"), F.col(ident).alias("ident"), F.explode(F.filter(hashed, lambda s: s["long"])).alias("s")).select("id", "ident", "s.pos", "s.h1", "s.h2")
    repeated = rows.groupBy("h1", "h2").agg(F.count_distinct(F.struct("id")).alias("n"), F.max("id").alias("keep")).where(F.col("n") >= min_docs).select("h1", "h2", "keep")
    # written, so that the join has a shuffle of its own on both sides and the rows of a very common line can be split
    repeated = staged(repeated, "repeated-lines").hint("merge")
    dropped = rows.join(repeated, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keep"))).groupBy("id", "ident").agg(F.collect_set("pos").alias("gone"))
    joined = base.join(
        dropped.select(F.col("id").alias(of), F.col("ident").alias(its), F.col("gone").alias(gone)),
        base[id_col].eqNullSafe(F.col(of)) & (base[ident] == F.col(its)),
        "left",
    ).drop(of, its)
    split_once = joined.withColumn(lines, split)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    kept = F.when(F.col(gone).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col(lines), i)), "\n"))
    return split_once.select(
        *[kept.alias(c) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
    )


#: Rows of op8, with the defaults above.
ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines
), repeated AS (
  SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT doc_id) >= 3
)
SELECT y.doc_id, count(*)::BIGINT AS n_lines,
       count(*) FILTER (WHERE r.k IS NOT NULL AND y.doc_id <> r.keep)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(y.line, chr(10) ORDER BY y.pos)
              FILTER (WHERE r.k IS NULL OR y.doc_id = r.keep), '')) AS kept_sha256
FROM keyed y LEFT JOIN repeated r ON y.k = r.k
GROUP BY y.doc_id
"""
