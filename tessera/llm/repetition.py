"""Repetition coverage by rolling hashes in numpy.

The UTF-8 bytes of many texts lie in one array. Equal words get one number,
equal lines another (by a dictionary of their bytes, so no two different ones
share a number); an n-gram's hash rolls over random values of its words'
numbers. Per text, n-grams whose hash comes again are found by sorting, and
those with one hash are compared word by word, so a chance hit marks nothing.
Marked characters are counted by differences and a running sum.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import fresh, slices
from tessera.session import ship

#: Word counts of the n-grams whose coverage is measured.
LENGTHS = (5, 8, 12)
#: The largest share of word characters inside repeated n-grams of each length, and inside repeated lines: the longer
#: the repeat, the less. No text labelled good of sf0.1 that passes the base has more than 0.28, 0.28, 0.16 and 0.14.
#: And the most symbols per word character: texts labelled good have none there, nine of ten bad ones more than this.
LIMITS = {5: 0.35, 8: 0.30, 12: 0.20, "lines": 0.20, "symbols": 0.10}
#: Bytes of text that are measured at a time.
PART_BYTES = 2_000_000

_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
#: First bytes of code points.
_FIRST = (np.arange(256) & 0xC0) != 0x80
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def _numbers(data: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The same number for equal runs and another for different ones, of runs
    of these sizes that lie one after the other in ``data``."""
    ends = np.concatenate(([0], np.cumsum(size)))
    runs = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
    return runs.dictionary_encode().indices.to_numpy().astype(np.uint64)


def _twice(hashes: np.ndarray, columns: list[np.ndarray]) -> np.ndarray:
    """Which rows of ``columns`` occur twice or more; ``hashes`` are equal where rows are."""
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    same = h[1:] == h[:-1]
    # of rows with one hash each is compared with its neighbour; where one differs, the rows themselves are sorted
    a, b = order[1:][same], order[:-1][same]
    if not all(np.array_equal(c[a], c[b]) for c in columns):
        order = np.lexsort(columns)
        same = np.logical_and.reduce([c[order][1:] == c[order][:-1] for c in columns])
    out = np.zeros(len(hashes), bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray) -> np.ndarray:
    """Which keys have an equal one before them."""
    out = np.ones(len(key), bool)
    out[np.unique(key, return_index=True)[1]] = False
    return out


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """For each text in UTF-8: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, dup_line_chars, and dup_<n>_chars for each n of LENGTHS."""
    count = len(texts)
    # a line feed after each text: none of its words or lines goes on in the next
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    limit = np.cumsum(np.fromiter(map(len, texts), np.int64, count) + 1)
    first = _FIRST[raw]
    chars = np.concatenate(([0], np.cumsum(first, dtype=np.int64)))
    out = {"n_symbols": np.add.reduceat(_SYMBOL[raw], limit - np.diff(limit, prepend=0), dtype=np.int64)}

    inside = ~_BLANK[raw]
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    begin, end = edge[::2], edge[1::2]
    of = np.searchsorted(limit, begin, side="right")
    size = chars[end] - chars[begin]
    out["n_words"] = np.bincount(of, minlength=count)
    out["word_chars"] = np.bincount(of, weights=size, minlength=count).astype(np.int64)
    word = _numbers(raw[inside], end - begin)
    value = _mix((word + np.uint64(1)) * _STEP)
    number = of.astype(np.uint64)
    salt = _mix(np.arange(count, dtype=np.uint64) + _STEP)

    def repeated_words(n: int) -> np.ndarray:
        """Words inside n-grams that occur twice or more in their text."""
        starts = len(word) - n + 1
        if starts < 2:
            return np.zeros(len(word), bool)
        h = np.zeros(starts, np.uint64)
        for k in range(n):
            h = h * _BASE + value[k : k + starts]
        whole = np.flatnonzero(of[:starts] == of[n - 1 :])
        at = whole[_twice(_mix(h[whole]) ^ salt[of[whole]], [number[whole], *(word[whole + k] for k in range(n))])]
        delta = np.zeros(len(word) + 1, np.int64)
        np.add.at(delta, at, 1)
        np.add.at(delta, at + n, -1)
        return np.cumsum(delta[:-1]) > 0

    out["n_repeat_words"] = np.bincount(of[repeated_words(3)], minlength=count)
    for n in LENGTHS:
        marked = repeated_words(n)
        out[f"dup_{n}_chars"] = np.bincount(of[marked], weights=size[marked], minlength=count).astype(np.int64)

    stop = np.flatnonzero(raw == 10)
    start = np.concatenate(([0], stop[:-1] + 1))
    line_of = np.searchsorted(limit, start, side="right")
    words_before = np.searchsorted(begin, np.concatenate((start, [len(raw)])))
    full = np.flatnonzero(np.diff(words_before) > 0)
    upto = np.concatenate(([0], np.cumsum(size)))
    line_chars = upto[words_before[1:]] - upto[words_before[:-1]]
    # raw ends with a line feed, so a line with the one after it is from its start to the next one's
    line = _numbers(raw, stop + 1 - start).astype(np.int64)
    later = _later(line[full] * count + line_of[full])
    out["n_dup_lines"] = np.bincount(line_of[full[later]], minlength=count)
    out["dup_line_chars"] = np.bincount(line_of[full[later]], weights=line_chars[full[later]], minlength=count).astype(np.int64)
    return {k: v.astype(np.int64) for k, v in out.items()}


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *(f"dup_{n}_chars" for n in LENGTHS))


def repetition(docs: DataFrame, text_col: str = "text", limits: dict | None = None) -> DataFrame:
    """``docs`` with MEASURES (long), base_failed and kept.

    kept is false if base_failed, or if the share of word characters inside
    repeated n-grams of a length, or inside lines equal to an earlier line, or
    that of symbols, is over its limit.

    Defined results: a null, empty or blank text has no word and fails; texts
    are measured whole, in parts of about ``PART_BYTES`` (a longer one by
    itself, in memory of about 60 bytes a byte); an empty table gives an empty
    table. A column of ``docs`` with one of the new names is replaced.
    """
    ship(docs.sparkSession)
    limits = LIMITS | (limits or {})
    names = {*MEASURES, "base_failed", "kept"}
    base = docs.drop(*[c for c in docs.columns if c.lower() in names and c != text_col])
    source = fresh(base, ["text_in"])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            raw = b.column(b.num_columns - 1).cast(pa.binary())
            at, k = 0, 0
            part: list[bytes] = []
            room = PART_BYTES
            for k, t in enumerate(raw.to_pylist(), 1):
                part.append(t or b"")
                room -= len(part[-1])
                if room <= 0 or k == b.num_rows:
                    got = measure(part)
                    yield pa.RecordBatch.from_arrays([c.slice(at, k - at) for c in b.columns[:-1]] + [pa.array(got[m]) for m in MEASURES], names=out_names)
                    at, part, room = k, [], PART_BYTES

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType(base.schema.fields + [StructField(m, LongType()) for m in MEASURES])
    out_names = schema.names
    measured = base.withColumn(source, F.col(text_col).cast("string")).mapInArrow(run, schema)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    shares = [(f"dup_{n}_chars", limits[n]) for n in LENGTHS] + [("dup_line_chars", limits["lines"]), ("n_symbols", limits["symbols"])]
    over = F.lit(False)
    for name, most in shares:
        over = over | (F.col(name) > F.lit(float(most)) * F.col("word_chars"))
    return measured.withColumn("base_failed", failed).withColumn("kept", ~(F.col("base_failed") | over))


