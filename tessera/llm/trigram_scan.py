"""Secret scans through an inverted index of byte trigrams.

From each rule's regular expression a Boolean query of trigrams is derived that
every match must satisfy. Documents are indexed a part at a time: postings of
the trigrams that some rule asks for. A rule's query intersects and unites
postings; only the documents that are left are searched with the expression
itself. A rule whose expression has no mandatory trigram searches all.

Texts are UTF-8 bytes, trigrams have A-Z in lower case. ``postings`` keeps the
index of a table, for rules that come later; ``candidates`` asks it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce
from itertools import product
from re import _constants as op
from re import _parser as parser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import fresh, slices
from tessera.session import ship


class Rule(NamedTuple):
    """Spans of ``kind``: leftmost, non-overlapping matches of ``pattern``
    whose ``group`` has at least ``least`` bytes; others are dropped, and the
    search goes on behind them. Patterns of ASCII characters only."""

    kind: str
    pattern: bytes
    group: int = 0
    least: int = 0


#: The contract's kinds. A run of 16 or more is a run that passes: runs are taken whole.
BASE = (
    Rule("assign", rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", rb"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", rb"[0-9a-f]{16,}"),
)
#: Forms of keys that services publish. No two starts share a run of characters, so a search takes linear time.
MORE = (
    Rule("private_key", rb"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?"),
    Rule("jwt", rb"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("github", rb"(?<![A-Za-z0-9])gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", rb"(?<![A-Za-z0-9-])xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", rb"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])"),
    Rule("stripe", rb"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("login", rb"(?:https?|ftp|ssh|mysql|postgres(?:ql)?|mongodb|redis|amqp)://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!~*=&$-]+@[A-Za-z0-9.-]+"),
)
RULES = BASE + MORE

#: Strings that stand for a part of an expression before they become a query, and characters of a class that is spelled out.
MOST_STRINGS, MOST_CHARS = 64, 6
#: Bytes that are indexed at a time, and in one piece of a text.
PART_BYTES = 4_000_000

Query = tuple | bytes | None
Spans = list[tuple[int, int, int]]

_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


# -- from an expression to a query ---------------------------------------------


def _all(*parts: Query) -> Query:
    """All of the parts; None asks for nothing."""
    kept = list(dict.fromkeys(q for p in parts if p is not None for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else (p,))))
    return None if not kept else kept[0] if len(kept) == 1 else ("and", tuple(kept))


def _any(parts: list[Query]) -> Query:
    """One of the parts; what asks for more than another part does is left out."""
    if not parts or None in parts:
        return None
    needs = {q: set(q[1]) if isinstance(q, tuple) and q[0] == "and" else {q} for q in parts}
    kept = [q for q in needs if not any(needs[other] < needs[q] for other in needs)]
    return kept[0] if len(kept) == 1 else ("or", tuple(sorted(kept, key=repr)))


def _of(strings: frozenset[bytes]) -> Query:
    """What a text with one of the strings has."""
    return _any([_all(*(s[i : i + 3] for i in range(len(s) - 2))) for s in sorted(strings)])


class Part(NamedTuple):
    """What matches of a part of an expression are like: all of ``strings``
    if ``exact``, else they begin with one of ``heads``, end with one of
    ``tails`` and satisfy ``query``."""

    exact: bool
    heads: frozenset[bytes]
    tails: frozenset[bytes]
    query: Query = None


def _words(*strings: bytes) -> Part:
    return Part(True, frozenset(strings), frozenset(strings))


_ANYTHING = Part(False, frozenset([b""]), frozenset([b""]))


def _open(p: Part) -> Part:
    """``p`` as a part that isn't exact, its strings cut to what can meet a neighbour."""
    query = _all(p.query, _of(p.heads), _of(p.tails))
    heads, tails = frozenset(s[:2] for s in p.heads), frozenset(s[-2:] for s in p.tails)
    return Part(False, heads if len(heads) <= MOST_STRINGS else frozenset([b""]), tails if len(tails) <= MOST_STRINGS else frozenset([b""]), query)


def _then(a: Part, b: Part) -> Part:
    """``a`` followed by ``b``."""
    joined = frozenset(x + y for x, y in product(a.tails, b.heads)) if len(a.tails) * len(b.heads) <= MOST_STRINGS else None
    if a.exact and b.exact and joined is not None:
        return Part(True, joined, joined)
    if joined is None:
        a, b = _open(a), _open(b)
    # strings at an end go on growing; those in the middle become a query
    met = _of(joined) if joined is not None and not a.exact and not b.exact else None
    return Part(False, joined if a.exact else a.heads, joined if b.exact else b.tails, _all(a.query, b.query, met))


def _either(parts: list[Part]) -> Part:
    union = lambda sets: frozenset().union(*sets)
    strings = union(p.heads for p in parts)
    if all(p.exact for p in parts) and len(strings) <= MOST_STRINGS:
        return Part(True, strings, strings)
    parts = [_open(p) for p in parts]
    return Part(False, union(p.heads for p in parts), union(p.tails for p in parts), _any([p.query for p in parts]))


def _class(items: list) -> Part:
    chars: set[bytes] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(bytes([value]).lower())
        elif kind is op.RANGE:
            chars |= {bytes([c]).lower() for c in range(value[0], value[1] + 1)}
        else:
            return _ANYTHING
    return _words(*chars) if len(chars) <= MOST_CHARS else _ANYTHING


def _part(tree) -> Part:
    out = _words(b"")
    for kind, value in tree:
        if kind is op.LITERAL:
            p = _words(bytes([value]).lower())
        elif kind is op.IN:
            p = _class(value)
        elif kind is op.BRANCH:
            p = _either([_part(t) for t in value[1]])
        elif kind is op.SUBPATTERN:
            p = _part(value[3])
        elif kind is op.ATOMIC_GROUP:
            p = _part(value)
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = value
            one = _part(inner)
            p = reduce(_then, [one] * min(least, 3), _words(b""))
            if (least, most) == (0, 1):
                p = _either([_words(b""), one])
            elif least == 0:
                p = _ANYTHING
            elif most > min(least, 3):
                p = _then(_then(_open(p), _ANYTHING), _open(one))
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            p = _words(b"")
        else:
            p = _ANYTHING
        out = _then(out, p)
    return out


def trigram_query(pattern: bytes) -> Query:
    """Trigrams that the text of any match has: a trigram, ("and", parts),
    ("or", parts), or None if none is certain."""
    return _open(_part(parser.parse(pattern))).query


def grams_of(query: Query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*(grams_of(q) for q in query[1]))


# -- the index of a part of the documents -------------------------------------


def _number(gram: bytes) -> int:
    return int.from_bytes(gram, "big")


def index(texts: list[bytes], wanted: np.ndarray | None = None) -> dict[int, np.ndarray]:
    """For each trigram the ascending numbers of the texts that have it; only
    trigrams that are set in ``wanted``, if given. Long texts go in pieces."""
    pairs = []
    piece, of, room = [], [], PART_BYTES

    def add() -> None:
        nonlocal piece, of, room
        if piece:
            raw = _LOWER[np.frombuffer(b"".join(piece), np.uint8)].astype(np.int32)
            code = (raw[:-2] << 16) | (raw[1:-1] << 8) | raw[2:]
            end = np.cumsum(np.fromiter(map(len, piece), np.int64, len(piece)))
            at = np.arange(len(code)) if wanted is None else np.flatnonzero(wanted[code])
            where = np.searchsorted(end, at, side="right")
            whole = at + 2 < end[where]
            pairs.append(np.unique((code[at[whole]].astype(np.int64) << 32) | np.array(of, np.int64)[where[whole]]))
        piece, of, room = [], [], PART_BYTES

    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - 2, 0), PART_BYTES - 2):
            part = t[at : at + PART_BYTES]
            if len(part) > room:
                add()
            piece.append(part)
            of.append(k)
            room -= len(part)
    add()
    every = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    gram = every >> 32
    cut = np.flatnonzero(np.diff(gram)) + 1
    lists = np.split(every & 0xFFFFFFFF, cut) if len(every) else []
    return dict(zip(gram[np.concatenate(([0], cut))].tolist() if len(every) else [], lists, strict=True))


def ask(postings: dict[int, np.ndarray], query: Query) -> np.ndarray:
    """Numbers of the texts that satisfy a query."""
    if isinstance(query, bytes):
        return postings.get(_number(query), np.zeros(0, np.int64))
    lists = [ask(postings, q) for q in query[1]]
    if query[0] == "or":
        return reduce(np.union1d, lists)
    lists.sort(key=len)  # the rarest first
    out = lists[0]
    for other in lists[1:]:
        if not len(out):
            break
        out = np.intersect1d(out, other, assume_unique=True)
    return out


class Scanner:
    """Rules, ready to be applied to parts of the documents."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.wanted = np.zeros(1 << 24, bool)
        for _, _, q in self.rules:
            self.wanted[[_number(g) for g in grams_of(q)]] = True

    def find(self, texts: list[bytes]) -> list[Spans]:
        """Spans (start, number of the rule, end) in bytes of each text, in order."""
        postings = index(texts, self.wanted)
        out: list[Spans] = [[] for _ in texts]
        for k, (rule, pattern, query) in enumerate(self.rules):
            for i in range(len(texts)) if query is None else ask(postings, query).tolist():
                out[i] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[i]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in out:
            spans.sort()
        return out


def code_points(text: bytes, spans: Spans) -> Spans:
    """Spans in bytes as spans in code points."""
    if not spans or text.isascii():
        return spans
    before = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), k, int(before[b])) for a, k, b in spans]


def parts(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """``texts`` in runs of about PART_BYTES, with the place of each run's first."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > PART_BYTES:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if texts:
        yield at, texts[at:]


# -- over tables ----------------------------------------------------------------


def secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = MORE) -> DataFrame:
    """``docs`` with n_assign, n_access, n_hex, base_sha256, spans (all, as text
    kind:start:end, comma-joined) and n_added; ``rules`` are applied beside BASE.

    Offsets are code points, ends exclusive; spans of different kinds may
    overlap. Defined results: a null text is the empty one and has no spans;
    texts are searched whole (in memory of a few times the longest one); rows
    are independent, so repeats get equal results; an empty table gives an
    empty table. A column of ``docs`` with one of the new names is replaced.
    """
    ship(docs.sparkSession)
    every = BASE + tuple(rules)
    names = [*(f"n_{r.kind}" for r in BASE), "base_sha256", "spans", "n_added"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in names and c != text_col])
    source = fresh(base, ["text_in"])[0]

    def joined(spans: Spans) -> str:
        return ",".join(f"{every[k].kind}:{a}:{b}" for a, k, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(every)
        for b in slices(batches):
            texts = [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            for at, some in parts(texts):
                found = [code_points(t, s) for t, s in zip(some, scanner.find(some), strict=True)]
                own = [[s for s in spans if s[1] < len(BASE)] for spans in found]
                cols = [pa.array([sum(s[1] == k for s in spans) for spans in own], pa.int64()) for k in range(len(BASE))]
                cols.append(pa.array([hashlib.sha256(joined(s).encode()).hexdigest() for s in own], pa.string()))
                cols.append(pa.array([joined(s) for s in found], pa.string()))
                cols.append(pa.array([len(s) - len(o) for s, o in zip(found, own, strict=True)], pa.int64()))
                yield pa.RecordBatch.from_arrays([c.slice(at, len(some)) for c in b.columns[:-1]] + cols, names=out_names)

    from pyspark.sql.types import StructType

    added = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    schema = StructType(base.schema.fields + StructType.fromDDL(added).fields)
    out_names = schema.names
    return base.withColumn(source, F.col(text_col).cast("string")).mapInArrow(run, schema)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (gram, ids): the index of all trigrams, a row per trigram and part of
    the documents, so that no list grows with the table. To be written
    (partitioned or sorted by gram) and asked by ``candidates``.

    Null and short texts are in no list; null ids are in none.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, some in parts([t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]):
                lists = index(some)
                if lists:
                    size = np.fromiter(map(len, lists.values()), np.int32, len(lists))
                    values = ids[at + np.concatenate(list(lists.values()))]
                    column = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.array(values, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(list(lists), pa.int32()), column], names=["gram", "ids"])

    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return plain.where("id is not null").mapInArrow(run, "gram int, ids array<long>")


def candidates(index_rows: DataFrame, pattern: bytes) -> DataFrame:
    """Ids of the documents that may match, from a written index: the rows of
    the query's trigrams (a pushed filter), then which of them each id has.
    A pattern without mandatory trigrams is an error: all documents may match."""
    query = trigram_query(pattern)
    if query is None:
        raise ValueError("the pattern has no mandatory trigram; scan the documents")
    grams = sorted(grams_of(query))

    def holds(q: Query) -> Column:
        if isinstance(q, bytes):
            return F.array_contains("grams", _number(q))
        return reduce((lambda a, b: a & b) if q[0] == "and" else (lambda a, b: a | b), [holds(x) for x in q[1]])

    hits = index_rows.where(F.col("gram").isin([_number(g) for g in grams])).select("gram", F.explode("ids").alias("id"))
    return hits.groupBy("id").agg(F.collect_set("gram").alias("grams")).where(holds(query)).select("id")
