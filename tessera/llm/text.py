"""Column expressions that several text operators share."""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

if TYPE_CHECKING:
    import pyarrow as pa

#: Rows that become Python objects at a time.
ROWS = 500
#: White space as every contract here defines it: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def fresh(df: DataFrame, wanted: Iterable[str]) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into parts of at most ``rows`` rows, without copies:
    what a worker holds as Python objects is a part, not a whole batch."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
