"""Main text of web pages through inferred wrappers.

For each host the pages' token streams are aligned, one after the other, into
one union-free regular expression: tags that match stay; neighbours that repeat
fold into a repeated group; what only one side has becomes optional; text
becomes a slot, which remembers its text as long as all pages agree on it.
Alignment goes level by level through the nesting of the tags, so a mismatch
inside an element is resolved inside it.

Every page takes part. A task folds the pages it sees into one wrapper a host,
so only wrappers are shuffled, and those of one host meet in two steps (first
by host and salt): no task ever gets all pages of a host.

The wrapper says where a host's main text is: from the root down, the element
with most of the variable text is followed as long as what is left beside it is
little. Names of elements and classes only weigh in: an article or main element
on that way with half of the text is the region, marked elements count less. A
page's tree is matched against its host's wrapper, which finds the region in it
(a page without it, or of a host with fewer than LEAST pages, finds its own).
All text there is main text but for what lies in menus, headers, footers,
sidebars, notices, adverts, forms or comments inside the region; and, unless
the region is an article, for what all pages with a slot have in it.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import fresh, slices
from tessera.session import ship

#: Fixed values of HTML: elements without content, with raw content, and those that begin a new block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template svg math".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements and words of class, id or role that mark a region as no part of the main text.
OUTSIDE = frozenset("head nav header footer aside form menu dialog button select input label fieldset script style noscript iframe template svg math textarea title object embed audio video canvas".split())
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promoted promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split()
)
#: Words that make a longer name of a mark: "ad-box" marks as "ad" does, "share-price" and "has-sidebar" mark nothing.
PARTS = frozenset("area bar block bottom box button buttons container element frame group holder inner item items left link links list outer panel placeholder row section slot top unit wrap wrapper".split())
MAIN = frozenset(("article", "main"))
#: Elements that may be the region, and headings.
HOLDERS = MAIN | frozenset("html body div section center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Share of a level's text that may be left beside the region, in elements that are HOLDERS; weight of marked elements' text.
BESIDE, MARKED = 0.3, 0.25
#: A closing or opening of these ends an open paragraph.
_P_ENDS = BLOCKS - {"br", "option", "select", "title", "body", "html"}
_NAME = re.compile(r"/?([a-zA-Z][a-zA-Z0-9:-]*)")
_TAG_END = re.compile(r"""(?:[^"'>]++|"[^"]*+"|'[^']*+')*+>""")
_MARK_ATTR = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")
#: Wrappers that a task keeps before it hands them on.
HELD = 2_000
#: Characters of all wrappers together up to which they are broadcast.
BROADCAST_CHARS = 16_000_000
SALTS = 32
#: Characters up to which a wrapper holds a slot's text itself; of longer ones it holds LONG and a digest.
SHORT = 120
LONG = "\ue000"
#: Pages that must have a slot for its text to be template text.
LEAST = 3
#: Levels of elements that a wrapper has.
DEEPEST = 80
#: Products of the lengths of two lists of children above which those in the middle are aligned by their keys alone.
WIDE = 250_000


def _marks(value: str) -> Iterator[str]:
    """Marks in a class, id or role: whole names, with nothing but PARTS beside."""
    for name in value.split():
        words = _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
        marks = [w for w in words if w in MARKS]
        if marks and all(w in MARKS or w in PARTS for w in words):
            yield from marks


def events(page: str) -> Iterator[tuple[int, str, str]]:
    """(1, tag, marks) for opened, (-1, tag, "") for closed elements, (0, text, "")
    for text; comments, declarations and the content of raw elements are left out."""
    at, size, quotes = 0, len(page), True
    while at < size:
        lt = page.find("<", at)
        if lt < 0:
            yield 0, page[at:], ""
            return
        m = _NAME.match(page, lt + 1)
        after = page[lt + 1 : lt + 2]
        if m is None and after not in ("!", "?", "/"):
            if lt + 1 == size:  # cut off in a tag
                if lt > at:
                    yield 0, page[at:lt], ""
                return
            nxt = page.find("<", lt + 1)
            nxt = size if nxt < 0 else nxt
            yield 0, page[at:nxt], ""
            at = nxt
            continue
        if lt > at:
            yield 0, page[at:lt], ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            if end < 0:
                return
            at = end + 3
            continue
        if quotes:
            e = _TAG_END.match(page, lt + 1)
            quotes = e is not None
        gt = e.end() - 1 if quotes else page.find(">", lt + 1)
        if gt < 0:
            return
        at = gt + 1
        if m is None:
            continue
        tag = m.group(1).lower()
        if after == "/":
            yield -1, tag, ""
            continue
        body = page[m.end() : gt]
        marks = ""
        if "=" in body:
            marks = ".".join(sorted({w for g in _MARK_ATTR.findall(body) for w in _marks("".join(g))}))
        yield 1, tag, marks
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            if end is None:
                return
            at = end.start()
        elif tag in VOID:
            yield -1, tag, ""


#: Open elements that a tag closes, of each group the innermost, if no element of _FENCES is open in between.
_IMPLIED = {t: (("p",),) for t in _P_ENDS}
for _same, _shut in ((("li",), ("li",)), (("dt", "dd"), ("dt", "dd")), (("td", "th"), ("td", "th", "tr")), (("tr",), ("tr",)), (("option",), ("option",))):
    _IMPLIED |= {t: (*_IMPLIED.get(t, ()), _same) for t in _shut}
_FENCES = frozenset(("ul", "ol", "dl", "table", "article", "section", "div", "body", "main", "select"))


def walk(page: str) -> Iterator[tuple[str, str]]:
    """("open" | "close" | "text", key or text) with elements closed where HTML closes them."""
    stack: list[tuple[str, str]] = []  # key, tag
    places: dict[str, list[int]] = {}  # of each tag where it is open
    fences = [-1]  # where elements of _FENCES are open
    for kind, what, marks in events(page):
        if kind == 0:
            yield "text", what
            continue
        upto = []
        if kind == 1:
            for same in _IMPLIED.get(what, ()):
                near = max((places[t][-1] for t in same if places.get(t)), default=-1) if len(same) > 1 else places[same[0]][-1] if places.get(same[0]) else -1
                if near > fences[-1]:
                    upto.append(near)
        elif places.get(what):
            upto.append(places[what][-1])
        if upto:
            upto = min(upto)
            while len(stack) > upto:
                key, tag = stack.pop()
                places[tag].pop()
                if tag in _FENCES:
                    fences.pop()
                yield "close", key
        if kind == 1:
            key = what + "." + marks if marks else what
            at = places.get(what)
            if at is None:
                at = places[what] = []
            at.append(len(stack))
            if what in _FENCES:
                fences.append(len(stack))
            stack.append((key, what))
            yield "open", key
    while stack:
        yield "close", stack.pop()[0]


# -- wrappers: a node is [key, optional, repeated, children, texts, varies, pages, chars, run]
# pages: how many pages surely have the node; chars: characters of a slot on all pages
# key "#": a text slot with the texts (digests of long ones) that all pages with the slot have in it, and whether it ever had two; key "()": a group.
# run: for a reader's page, the numbers of the first and after the last text of an element, and of the marked elements until its start

#: How two nodes meet: of one page, of different pages, or of pages that may overlap.
PAGE, PAGES, EITHER = "page", "pages", "either"


def _key(node: list) -> str:
    return "(" + " ".join(_key(c) for c in node[3]) + ")" if node[0] == "()" else node[0]


def _join(a: list, b: list, how: str) -> list:
    """One node for two with the same key: of different pages, which must agree
    on a slot's texts, or of one page, whose slot then has the texts of both.
    Nodes of one page are used up: ``a`` becomes the joined one."""
    if how == PAGE:
        a[1], a[2], a[5], a[7] = a[1] or b[1], a[2] or b[2], a[5] or b[5] or a[4][:1] != b[4][:1], a[7] + b[7]
        a[4].extend(b[4])
        a[3], a[6] = align(a[3], b[3], PAGE), max(a[6], b[6])
        return a
    texts, varies = a[4], a[5] or b[5]
    if a[4] != b[4]:
        both = set(a[4]) & set(b[4])
        texts, varies = sorted(both), varies or len(both) != len(set(a[4])) or len(both) != len(set(b[4]))
    pages = a[6] + b[6] if how == PAGES else max(a[6], b[6])
    return [a[0], a[1] or b[1], a[2] or b[2], align(a[3], b[3], how), texts, varies, pages, a[7] + b[7], None]


def _by_key(nodes: list, how: str) -> list:
    """One repeated, optional node for each key, in the order of their first ones."""
    first: dict[str, list] = {}
    for n in nodes:
        old = first.setdefault(_key(n), n)
        if old is not n:
            first[_key(n)] = _join(old, n, how)
    return [[n[0], True, n[0] != "#", *n[3:]] for n in first.values()]


def _edges(ka: list[str], kb: list[str]) -> tuple[int, int]:
    """How many keys two lists begin with together, and how many of the rest they end with."""
    most = min(len(ka), len(kb))
    head = next((k for k in range(most) if ka[k] != kb[k]), most)
    tail = next((k for k in range(most - head) if ka[-1 - k] != kb[-1 - k]), most - head)
    return head, tail


def _keys(nodes: list) -> list[str]:
    return [n[0] if n[0] != "()" else _key(n) for n in nodes]


def fold(nodes: list, how: str = PAGE) -> list:
    """Neighbours that repeat, alone or up to four together, become repeated nodes and groups."""
    out: list = []
    keys: list[str] = []
    for n, key in zip(nodes, _keys(nodes), strict=True):
        if keys and keys[-1] == key:
            out[-1] = _join(out[-1], n, how)
            out[-1][2] = n[0] != "#"
        else:
            out.append(n)
            keys.append(key)
    for width in (2, 3, 4):
        k = 0
        while k + 2 * width <= len(out):
            reps = 1
            while keys[k + reps * width : k + (reps + 1) * width] == keys[k : k + width]:
                reps += 1
            if reps > 1:
                group = out[k : k + width]
                for r in range(1, reps):
                    group = [_join(a, b, how) for a, b in zip(group, out[k + r * width : k + (r + 1) * width], strict=True)]
                out[k : k + reps * width] = [["()", False, True, group, [], False, max(n[6] for n in group), 0, None]]
                keys[k : k + reps * width] = [_key(out[k])]
            k += 1
    return out


def align(a: list, b: list, how: str = PAGES) -> list:
    """Two child lists as one: what both have is joined, the rest is optional.
    A page aligned with itself is that page."""
    if a is b or not (a or b):
        return a
    ka, kb = _keys(a), _keys(b)
    if ka == kb:
        return [_join(x, y, how) for x, y in zip(a, b, strict=True)]
    head, tail = _edges(ka, kb)
    ea, eb = len(a) - tail, len(b) - tail
    join = lambda x, y: [_join(m, n, how) for m, n in zip(x, y, strict=True)]
    inner = PAGE if how == PAGE else EITHER
    middle: list = []
    if (ea - head) * (eb - head) > WIDE:
        middle = _by_key(_by_key(a[head:ea], inner) + _by_key(b[head:eb], inner), how)
    else:
        for op, a1, a2, b1, b2 in SequenceMatcher(None, ka[head:ea], kb[head:eb], autojunk=False).get_opcodes():
            if op == "equal":
                middle += join(a[head + a1 : head + a2], b[head + b1 : head + b2])
            else:
                middle += [[n[0], True, *n[2:]] for n in a[head + a1 : head + a2] + b[head + b1 : head + b2]]
    return fold(join(a[:head], b[:head]) + middle + join(a[ea:], b[eb:]), inner)


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def tree(page: str, reader: Reader | None = None) -> list:
    """The wrapper of one page: the children of its root. With a ``reader``,
    texts come with the numbers of the reader's texts, elements with their runs.
    Elements nested deeper than DEEPEST have no node; their texts belong to the
    node there."""
    levels: list[list] = [[]]
    since: list[tuple[int, int]] = []
    deep = 0
    for what, value in walk(page):
        if reader is not None:
            reader.see(what, value)
        if what == "text":
            said = " ".join(html.unescape(value).split())
            if said:
                chars = len(said)
                if chars > SHORT:
                    said = LONG + _digest(said)
                levels[-1].append(["#", False, False, [], [said if reader is None else (said, len(reader.texts) - 1)], False, 1, chars, None])
        elif deep or (what == "open" and len(levels) > DEEPEST):
            deep += 1 if what == "open" else -1
        elif what == "open":
            levels.append([])
            if reader is not None:
                since.append((len(reader.texts), reader.made))
        else:
            inner, run = fold(levels.pop()), None
            if reader is not None:
                at, made = since.pop()
                run = (at, len(reader.texts), made)
            levels[-1].append([value, False, False, inner, [], False, 1, 0, run])
    return fold(levels[0])


def expression(nodes: list) -> str:
    """The wrapper written as a regular expression over tags and slots."""
    out = []
    for key, optional, repeated, inner, texts, varies, *_ in nodes:
        s = (json.dumps(texts[0], ensure_ascii=False) if texts and not varies else "#TEXT") if key == "#" else expression(inner) if key == "()" else f"<{key}>{expression(inner)}</{key}>"
        sign = {(True, True): "*", (True, False): "?", (False, True): "+"}.get((optional, repeated), "")
        out.append(f"({s}){sign}" if sign else s)
    return "".join(out)


def region(nodes: list) -> list | None:
    """The node with the main text, of a wrapper or of one page; None is all."""
    mass: dict[int, float] = {}

    def weigh(n: list) -> float:
        if n[0] == "#":
            fixed = n[6] >= LEAST and n[4] and not n[5]
            out = 0.0 if fixed else float(n[7])
        else:
            tag, _, marks = n[0].partition(".")
            out = 0.0 if tag in OUTSIDE else sum(map(weigh, n[3])) * (MARKED if marks else 1)
        mass[id(n)] = out
        return out

    def headed(n: list) -> bool:
        tag, _, marks = n[0].partition(".")
        return mass[id(n)] > 0 and not marks and (tag in HEADINGS or any(map(headed, n[3])))

    total = sum(map(weigh, nodes))
    found, close, level = None, True, nodes
    while level:
        best = max(level, key=lambda n: mass[id(n)])
        tag = best[0].partition(".")[0]
        whole = sum(mass[id(n)] for n in level)
        if tag not in HOLDERS or best[2] or 2 * mass[id(best)] < whole or not whole:
            return found
        if tag in MAIN and 2 * mass[id(best)] >= total * (MARKED if "." in best[0] else 1):
            found, close = best, False  # only another one inside it is closer
        elif close and tag not in ("html", "body"):
            rest = [n for n in level if n is not best and mass[id(n)] > 0]
            close = whole - mass[id(best)] <= BESIDE * whole and all(n[0].partition(".")[0] in HOLDERS and not headed(n) for n in rest)
            found = best if close else found
        level = best[3]
    return found


@lru_cache(maxsize=512)
def _wrapper(wrapper: str) -> tuple[int, list, bool, list | None]:
    """Pages and nodes, whether anything differs between the host's pages
    (pages that never differ don't tell template from text), and the region."""
    pages, nodes = json.loads(wrapper)

    def differs(level: list) -> bool:
        return any(n[1] or n[5] or differs(n[3]) for n in level)

    return pages, nodes, differs(nodes), region(nodes)


def match(nodes: list, wrapper: list, shared: set[int], place: list | None = None) -> list | None:
    """Match a page's tree, made with a reader, against the wrapper: numbers of
    texts that all pages with their slot, ``LEAST`` at least, have in it go to
    ``shared``; returns the page's node for the wrapper's node ``place``. What
    the wrapper doesn't have stays variable."""
    found = None
    ka, kb = _keys(nodes), _keys(wrapper)
    head, tail = _edges(ka, kb)
    ea, eb = len(ka) - tail, len(kb) - tail
    pairs = list(zip(nodes[:head] + nodes[ea:], wrapper[:head] + wrapper[eb:], strict=True))
    if (ea - head) * (eb - head) > WIDE:
        first = dict(zip(kb[head:eb][::-1], wrapper[head:eb][::-1], strict=True))
        pairs += [(n, first[k]) for n, k in zip(nodes[head:ea], ka[head:ea], strict=True) if k in first]
    elif ea > head and eb > head:
        blocks = SequenceMatcher(None, ka[head:ea], kb[head:eb], autojunk=False).get_matching_blocks()
        pairs += [(nodes[head + i + k], wrapper[head + j + k]) for i, j, n in blocks for k in range(n)]
    for n, w in pairs:
        if w is place:
            found = n
        if n[0] == "#":
            if w[6] >= LEAST:
                shared |= {k for said, k in n[4] if said in w[4]}
        else:
            found = match(n[3], w[3], shared, place) or found
    return found


class Reader:
    """The texts of a page, and where each stands."""

    def __init__(self) -> None:
        #: text, number of its line, whether in an element of OUTSIDE, marked elements around it
        self.texts: list[tuple[str, int, bool, tuple[int, ...]]] = []
        self.line = self.skip = self.made = 0
        self.marks: tuple[int, ...] = ()

    def see(self, what: str, value: str) -> None:
        if what == "text":
            self.texts.append((value, self.line, self.skip > 0, self.marks))
            return
        tag, _, mark = value.partition(".")
        if tag in OUTSIDE:
            self.skip += 1 if what == "open" else -1
        elif mark and tag not in ("html", "body"):
            if what == "open":
                self.made += 1
                self.marks = (*self.marks, self.made)
            else:
                self.marks = self.marks[:-1]
        if tag in BLOCKS:
            self.line += 1


def extract(page: str, wrapper: str) -> str:
    """The main text of ``page``: blocks in page order, one line each.

    The text of the region, without elements of OUTSIDE and marked ones in it;
    outside articles, without what all pages share. A mark is void if most of
    the region's text is below it."""
    reader = Reader()
    nodes = tree(page, reader)
    pages, how, differs, place = _wrapper(wrapper)
    shared: set[int] = set()
    here = None
    if pages >= LEAST and differs:
        here = match(nodes, how, shared, place)
    if here is None and not (pages >= LEAST and place is None):
        here = region(nodes)
    at, end, made = here[8] if here is not None else (0, len(reader.texts), 0)
    if here is not None and here[0].partition(".")[0] in MAIN:
        shared = set()
    rest, size = [], {}
    for k in range(at, end):
        said, line, skip, marks = reader.texts[k]
        if not skip and k not in shared and said.strip():
            inner = [m for m in marks if m > made]
            rest.append((said, line, inner))
            for m in inner:
                size[m] = size.get(m, 0) + len(said)
    total = sum(len(t[0]) for t in rest)
    lines: dict[int, list[str]] = {}
    for said, line, marks in rest:
        if all(2 * size[m] > total for m in marks):
            lines.setdefault(line, []).append(said)
    out = (" ".join(html.unescape("".join(texts)).split()) for texts in lines.values())
    return "\n".join(x for x in out if x)


# -- Spark -----------------------------------------------------------------------

def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _merged(packed: Iterator[str]) -> str:
    pages, nodes = 0, None
    for p in packed:
        n, more = json.loads(p)
        pages, nodes = pages + n, more if nodes is None else align(nodes, more)
    return json.dumps([pages, nodes or []], ensure_ascii=False)


def infer(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host and wrapper (JSON of the number of pages and the nodes) of every host."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held: dict[str, list] = {}

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(v, ensure_ascii=False) for v in held.values()])], names=["host", "salt", "wrapper"])
            held.clear()
            return out

        for b in slices(batches):
            for h, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                nodes, old = tree(page or ""), held.get(h)
                held[h] = [1, nodes] if old is None else [old[0] + 1, align(old[1], nodes)]
                if len(held) >= HELD:
                    yield hand_on()
        if held:
            yield hand_on()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("wrapper")
        return pd.DataFrame({"host": [pdf["host"].iloc[0]], "wrapper": [_merged(pdf["wrapper"])]})

    ship(pages.sparkSession)
    some = pages.select(host(F.col(url_col)).alias("host"), F.col(html_col).cast("string")).mapInArrow(partial, "host string, salt int, wrapper string")
    return some.groupBy("host", "salt").applyInPandas(meet, "host string, wrapper string").groupBy("host").applyInPandas(meet, "host string, wrapper string")


def main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars.

    Defined results: a null or empty page has the empty text; a null or odd
    url belongs to the host "", which has a wrapper like any other; rows that
    repeat an id or a page are pages of their own; pages are read whole, in
    time linear in their length; an empty table gives an empty table. Columns
    of ``pages`` named text or n_chars (other than the page itself) are replaced.
    """
    from tessera.session import staged

    wrappers = staged(infer(pages, url_col, html_col), "wrappers")
    base = pages.drop(*[c for c in pages.columns if c.lower() in ("text", "n_chars") and c not in (url_col, html_col)])
    body, home, how = fresh(base, ["body", "home", "how"])
    chars = wrappers.agg(F.sum(F.length("wrapper"))).first()[0] or 0
    side = wrappers.select(F.col("host").alias(home), F.col("wrapper").alias(how))
    side = F.broadcast(side) if chars <= BROADCAST_CHARS else side
    joined = base.withColumn(home, host(F.col(url_col))).join(side, home).select(*[base[c] for c in base.columns], F.col(html_col).cast("string").alias(body), how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n = b.num_columns
            text = [extract(p or "", w) for p, w in zip(b.column(n - 2).to_pylist(), b.column(n - 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=out_names)

    from pyspark.sql.types import LongType, StringType, StructField, StructType

    schema = StructType([*base.schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())])
    out_names = schema.names
    return joined.mapInArrow(run, schema)
