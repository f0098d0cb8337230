"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is cut where no piece of the vocabulary can cross: before a run of
blanks that follows another character, around line feeds, and between letters
and signs or digits that no piece joins to letters. Each segment is
encoded by a score-ordered agenda of adjacent symbol pairs: the pair whose
piece has the highest score merges first, the leftmost of equals; pairs whose
symbols have changed meanwhile are skipped. Symbols that are no piece become
their UTF-8 bytes. Segments repeat, so each worker keeps a bounded table of
them; every segment that enters the table is checked, batch by batch, against
the sentencepiece library.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import fresh, slices
from tessera.session import ship

SPACE = "▁"
#: Segments in a worker's table; beyond that it becomes the older table and a new one starts, so those in use stay.
TABLE = 150_000
#: Segments longer than this are not kept.
KEEP_CHARS = 64
#: Texts are handed on in parts of about so many characters.
PART_CHARS = 2_000_000


#: Segments up to this length keep their agenda in a list, longer ones in a heap.
SHORT = 48
NEVER = float("inf")


class Disagreement(AssertionError):
    """The agenda's ids and the library's differ."""


def _apart(pieces: Iterable[str]) -> set[str]:
    """Characters, none of them letters, that no piece joins to any other
    character than these (or the blank before them)."""
    pairs = {(a, b) for p in pieces for a, b in zip(p, p[1:], strict=False) if SPACE not in (a, b) and "\n" not in (a, b)}
    apart = {c for pair in pairs for c in pair if not c.isalpha()} | {c for c in map(chr, range(33, 127)) if not c.isalpha()}
    while joined := {c for a, b in pairs if (a in apart) != (b in apart) for c in (a, b) if c in apart}:
        apart -= joined
    return apart


class Agenda:
    """The encoder and decoder of one model file."""

    def __init__(self, model: bytes, check: bool = True):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        lib, n = self.library, self.library.get_piece_size()
        pieces = [lib.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.rank = {pieces[i]: i for i in plain}
        self.score = [lib.get_score(i) for i in range(n)]
        self.cost = {p: -self.score[i] for p, i in self.rank.items()}
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.begin, self.end, self.check = lib.bos_id(), lib.eos_id(), check
        inner = any(SPACE in p.lstrip(SPACE) or ("\n" in p and len(p) > 1) for p in self.rank)
        apart = "".join(map(re.escape, sorted(_apart(self.rank))))
        whole, parts = f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n+", f"{SPACE}*(?:[^{SPACE}\n{apart}]+|[{apart}]+)|{SPACE}+|\n+"
        self.cut = re.compile("(?s).+" if inner else parts if apart else whole)
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segment(self, text: str) -> list[int]:
        """The ids of one segment."""
        if len(text) <= SHORT:
            return self._ids(self._short(text))
        rank, score = self.rank, self.score
        symbol: list[str | None] = list(text)
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = []
        for i in range(n - 1):
            k = rank.get(text[i : i + 2])
            if k is not None:
                agenda.append((-score[k], i, text[i : i + 2], i + 1))
        heapq.heapify(agenda)
        while agenda:
            _, i, piece, j = heapq.heappop(agenda)
            a, b = symbol[i], symbol[j]
            if a is None or b is None or after[i] != j or a + b != piece:
                continue
            symbol[i], symbol[j] = piece, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                longer = piece + symbol[k]
                r = rank.get(longer)
                if r is not None:
                    heapq.heappush(agenda, (-score[r], i, longer, k))
            k = before[i]
            if k >= 0:
                longer = symbol[k] + piece
                r = rank.get(longer)
                if r is not None:
                    heapq.heappush(agenda, (-score[r], k, longer, i))
        return self._ids([s for s in symbol if s is not None])

    def _short(self, text: str) -> list[str]:
        """The same agenda for a short segment: the costs of the adjacent pairs
        in a list, the first of the least of which is next."""
        cost, symbol = self.cost, list(text)
        agenda = [cost.get(text[i : i + 2], NEVER) for i in range(len(text) - 1)]
        while agenda:
            least = min(agenda)
            if least == NEVER:
                break
            i = agenda.index(least)
            piece = symbol[i] = symbol[i] + symbol[i + 1]
            del symbol[i + 1], agenda[i]
            if i < len(agenda):
                agenda[i] = cost.get(piece + symbol[i + 1], NEVER)
            if i:
                agenda[i - 1] = cost.get(symbol[i - 1] + piece, NEVER)
        return symbol

    def _ids(self, symbols: list[str]) -> list[int]:
        ids: list[int] = []
        for s in symbols:
            k = self.rank.get(s)
            if k is not None:
                ids.append(k)
            else:
                ids.extend(self.bytes[b] for b in s.encode())
        return ids

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        made = [self.segment(s) for s in new]
        if self.check:
            # the library puts one blank before a text; a segment in the middle of a text has none to spare after a line feed
            plain = [k for k, s in enumerate(new) if s.startswith(SPACE)]
            for k, ids in zip(plain, self.library.encode([new[k][1:].replace(SPACE, " ") for k in plain], num_threads=1), strict=True):
                # a lone blank is the library's empty text
                if ids != made[k] and new[k] != SPACE:
                    raise Disagreement(f"{new[k]!r}: {made[k]} and {ids}")
            inner = [k for k, s in enumerate(new) if not s.startswith(SPACE)]
            lead = self.library.encode("\n")
            for k, ids in zip(inner, self.library.encode(["\n" + new[k] for k in inner], num_threads=1), strict=True):
                if ids != lead + made[k]:
                    raise Disagreement(f"{new[k]!r}: {made[k]} and {ids}")
        return {s: array("I", ids).tobytes() for s, ids in zip(new, made, strict=True)}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers, without begin and end."""
        cut = [self.cut.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.table) > TABLE:
            self.table, self.older = {}, self.table
        table, older = self.table, self.older
        new = {s for parts in cut for s in parts if s not in table}
        again = new & older.keys()
        table.update((s, older[s]) for s in again)
        out = []
        known = self._learn(list(new - again))
        if known:
            kept = {s: b for s, b in known.items() if len(s) <= KEEP_CHARS}
            table.update(kept)
            if len(kept) < len(known):
                table = table | known
        for parts in cut:
            out.append(b"".join(map(table.__getitem__, parts)))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


@lru_cache(maxsize=2)
def _agenda(model: bytes, check: bool) -> Agenda:
    return Agenda(model, check)


def _parts(texts: list[str], chars: int) -> Iterator[list[str]]:
    part, n = [], 0
    for t in texts:
        part.append(t)
        n += len(t)
        if n >= chars:
            yield part
            part, n = [], 0
    if part:
        yield part


def encode_decode(docs: DataFrame, model_path: str, text_col: str = "text", with_ids: bool = True, check: bool = True) -> DataFrame:
    """``docs`` with columns pieces (array of int, begin and end ids included;
    only with ``with_ids``), n_tokens, ids_sha256, decoded, decoded_sha256.

    ``model_path`` is read on the driver (493 kB) and goes to the tasks with
    the function.

    Defined results: a null or empty text is the begin and the end id and
    decodes to the empty text; a text is handled whole, whatever its length; an
    empty table gives an empty table. A column of ``docs`` that has one of the
    new names is replaced.
    """
    ship(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = f.read()
    added = (["pieces array<int>"] if with_ids else []) + ["n_tokens long", "ids_sha256 string", "decoded string", "decoded_sha256 string"]
    names = {a.split(" ")[0] for a in added}
    base = docs.drop(*[c for c in docs.columns if c.lower() in names and c != text_col])
    source = fresh(base, ["text_in"])[0]
    fed = base.withColumn(source, F.col(text_col).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = _agenda(model, check)
        begin, end = array("I", [agenda.begin]).tobytes(), array("I", [agenda.end]).tobytes()
        for b in slices(batches):
            at = 0
            for part in _parts([t or "" for t in b.column(b.num_columns - 1).to_pylist()], PART_CHARS):
                raw = [begin + x + end for x in agenda.encode(part)]
                ids = [np.frombuffer(x, "<u4") for x in raw]
                text = agenda.decode([x.tolist() for x in ids])
                cols = [c.slice(at, len(part)) for c in b.columns[:-1]]
                at += len(part)
                if with_ids:
                    flat = np.concatenate(ids).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(flat)))
                cols.append(pa.array([len(x) for x in ids], pa.int64()))
                cols.append(pa.array([hashlib.sha256(x).hexdigest() for x in raw]))
                cols.append(pa.array(text, pa.string()))
                cols.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in text]))
                yield pa.RecordBatch.from_arrays(cols, names=out_names)

    from pyspark.sql.types import StructType

    schema = StructType(base.schema.fields + StructType.fromDDL(", ".join(added)).fields)
    out_names = schema.names
    return fed.mapInArrow(run, schema)

