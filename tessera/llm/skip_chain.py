r"""Personal data by patterns and a skip-chain conditional random field.

The base finds emails, IPv4 addresses, card and phone numbers by fixed
patterns; full phone numbers whose base pattern ran on too far are certain as
well. Over the tokens that hold a digit or an at sign then runs a
conditional random field whose labels are "none" and the four kinds. Tokens of
these spans are observed. Neighbouring tokens share a transition potential;
tokens of one document with the same key (the same address in lower case, the
same four numbers of an IP address, the same last seven digits, the same whole
run of digits) share a skip potential, so that a number which is certain in one
place carries its label to its other, bare mentions. All tokens of a key meet
in one hub variable, so a key that occurs a thousand times costs a thousand
edges and not half a million. A token is tied to its hub by a distribution over
the hub's labels, so a key that no other token has says nothing, and a known
mention never makes its kind less likely for the others, against any other kind.
Inference is loopy sum-product message passing, for all documents of a batch at
once. All other tokens are "none" with certainty and cut the chain, so leaving
them out changes nothing.

The weights are trained here, by pseudo-likelihood, on a generated sample.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import fresh, slices
from tessera.session import ship

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int, int]  # start, index of the kind, end

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_FULL = re.compile(r"(?<![0-9+])\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3,4}[-. ][0-9]{4}(?![0-9])")
_HINT = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<![^ \t-\r])[^ \t-\r0-9@]*+[0-9@][^ \t-\r]*+")
_EDGES = " \t\n\x0b\x0c\r.,;:!?\"'()[]{}<>|*&$#"


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost matches of each kind that pass its check, by start and kind."""
    if not _HINT.search(text):
        return []
    out: list[Span] = []
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL_CHARS:
            begin -= 1
        if begin < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((begin, 0, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or "0") <= 255 for x in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def certain_spans(text: str, base: list[Span]) -> list[Span]:
    """International numbers with an area code in brackets that are in no base
    span, as the base's pattern ran on into the numbers behind them."""
    if "+" not in text:
        return []
    found = [(m.start(), 3, m.end()) for m in _FULL.finditer(text)]
    return [s for s in found if not any(b[0] < s[2] and s[0] < b[2] for b in base)]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# -- tokens --------------------------------------------------------------------

_DOTTED = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?\Z")
_GROUPED = re.compile(r"\(?[0-9]{2,4}\)?[-. ]?[0-9]{3,4}[-. ]?[0-9]{0,4}\Z")
_NATIONAL = re.compile(r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\Z")
_QUAD = re.compile(r"([0-9]{1,3})([.-])([0-9]{1,3})\2([0-9]{1,3})\2([0-9]{1,3})(?::[0-9]+)?\Z")
_ADDRESS = re.compile(r"[^@]+@[^@]+\.[^@.]+\Z")
_FEATURES = 21


def features(core: str) -> np.ndarray:
    """What the unary potentials see of a token without punctuation at its ends."""
    d = _digits(core)
    n = len(d)
    letters = any(c.isalpha() for c in core)
    x = [1, "@" in core, bool(_ADDRESS.match(core)), bool(_DOTTED.match(core)), n < 4, 4 <= n <= 6, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15, 16 <= n <= 19, n > 19, letters, core.startswith("+"), "-" in core, "/" in core or ":" in core]
    x += [12 <= n <= 19 and luhn(d), bool(_GROUPED.match(core)), core.isdigit(), "." in core, n > 0 and not letters and n / len(core) > 0.7]
    x.append(bool(m := _QUAD.match(core)) and all(int(m[k]) <= 255 for k in (1, 3, 4, 5)))
    return np.array(x, float)


def keys(core: str) -> list[str]:
    """Keys by which a token is similar to others of its document."""
    if "@" in core:
        return ["@" + core.lower()]
    d = _digits(core)
    if any(c.isalpha() for c in core):
        return []
    quad = ["q" + ".".join(str(int(m[k])) for k in (1, 3, 4, 5))] if (m := _QUAD.match(core)) else []
    return quad + (["7" + d[-7:]] if len(d) >= 7 else []) + (["a" + d] if len(d) > 7 else [])


class Graph:
    """Tokens, chain edges and skip hubs of any number of texts."""

    def __init__(self) -> None:
        self.spans: list[tuple[int, int, int]] = []  # text, start, end
        self.x: list[np.ndarray] = []
        self.seen: list[int] = []  # observed label, or -1
        self.chain: list[int] = []  # tokens whose next token follows at once
        self.hub: dict[tuple[int, str], int] = {}
        self.skip: list[tuple[int, int]] = []
        self.known: dict[tuple[int, int], str] = {}  # hub, kind of an observed token that it links: the digits of its span

    def add(self, number: int, text: str, base: list[Span]) -> None:
        last = None
        k = 0
        for m in _TOKEN.finditer(text):
            a, b = m.span()
            core = m.group().strip(_EDGES)
            if not core:
                last = None
                continue
            a = text.index(core, a, b)
            while k < len(base) and base[k][2] <= a:
                k += 1
            cover = [s for s in base[k : k + 4] if s[0] < a + len(core) and s[2] > a]
            me = len(self.spans)
            if last == m.start() - 1 and me:
                self.chain.append(me - 1)
            last = m.end()
            self.spans.append((number, a, a + len(core)))
            self.x.append(features(core))
            self.seen.append(cover[0][1] + 1 if cover else -1)
            named = keys(core)
            if cover and (cover[0][0] < a or cover[0][2] > a + len(core)):
                named += keys(text[cover[0][0] : cover[0][2]])
            for key in dict.fromkeys(named):
                hub = self.hub.setdefault((number, key), len(self.hub))
                self.skip.append((me, hub))
                if cover:
                    self.known[hub, cover[0][1]] = _digits(text[cover[0][0] : cover[0][2]])

    def arrays(self) -> tuple[np.ndarray, ...]:
        x = np.array(self.x).reshape(-1, _FEATURES)
        return x, np.array(self.seen, np.int64), np.array(self.chain, np.int64), np.array(self.skip, np.int64).reshape(-1, 2)


# -- potentials ----------------------------------------------------------------

LABELS = 1 + len(KINDS)
#: Tokens that a linked one may take in on its sides.
WIDEST = 4
#: The largest skip weight that counts: beyond it a hub would be a certainty.
MOST = 6.0


def _sample(texts: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Generated texts with all their true spans, bare mentions included."""
    r = np.random.default_rng(seed)
    word = lambda: "".join(r.choice(list("abcdefghilmnoprstu"), r.integers(2, 9)))
    num = lambda n: "".join(map(str, r.integers(0, 10, n)))

    def card() -> str:
        d = "4" + num(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def phone() -> tuple[str, list[str]]:
        a, b, c = num(3), num(3), num(4)
        return f"+{r.integers(1, 99)} ({a}) {b}-{c}", [f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{b}-{c}", f"{a}.{b}.{c}", f"{a}{b}{c}"]

    def noise() -> str:
        kinds = (lambda: str(r.integers(1900, 2030)), lambda: num(r.integers(1, 5)), lambda: f"{num(2)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"#{num(6)}", lambda: f"{word()}{num(2)}", lambda: f"{num(1)},{num(3)}", lambda: "%032x" % int(r.integers(1, 1 << 62)), lambda: num(r.integers(7, 20)), lambda: f"{num(3)}-{num(4)}", lambda: f"@{word()}")
        return kinds[r.integers(len(kinds))]()

    out = []
    for _ in range(texts):
        parts: list[tuple[str, int]] = []
        for _ in range(r.integers(1, 4)):
            kind = int(r.integers(0, 5))
            if kind == 0:
                e = f"{word()}.{num(2)}@{word()}.example.com"
                parts += [(e, 1)] + [(e.upper() if r.random() < 0.5 else e, 1)] * int(r.integers(0, 2))
            elif kind == 1:
                ip = ".".join(str(v) for v in r.integers(1, 255, 4))
                bare = (f"{ip}:{num(4)}", ip.replace(".", "-"))
                parts += [(ip, 2)] + [(bare[r.integers(2)], 2) for _ in range(r.integers(0, 3))]
            elif kind == 2:
                c = card()
                parts += [(c, 3)] + [(f"{c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]}", 3)] * int(r.integers(0, 2))
            elif kind == 3:
                full, bare = phone()
                parts += [(full, 4)] + [(bare[r.integers(len(bare))], 4) for _ in range(r.integers(0, 3))]
            for _ in range(r.integers(1, 4)):
                parts += [(noise(), 0)] * int(r.integers(1, 3))  # an order number, say, comes again
        text, spans = "", []
        for k in r.permutation(len(parts)):
            s, kind = parts[k]
            text += " ".join(word() for _ in range(r.integers(0, 4))) + " "
            if kind:
                spans.append((len(text), kind - 1, len(text) + len(s)))
            text += s + " "
        out.append((text, spans))
    return out


@lru_cache(maxsize=1)
def trained(texts: int = 1500, seed: int = 7, steps: int = 400) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unary weights (features x labels), transitions (labels x labels) and the
    skip potential (labels, all the same) that maximise the ridge-penalised pseudo-likelihood."""
    g, truth = Graph(), []
    for k, (text, spans) in enumerate(_sample(texts, seed)):
        g.add(k, text, [])
        for _, a, b in g.spans[len(truth) :]:
            truth.append(next((s[1] + 1 for s in spans if s[0] < b and s[2] > a), 0))
    x, _, chain, skip = g.arrays()
    y = np.array(truth)
    one = np.eye(LABELS)[y]
    before, after = np.zeros_like(one), np.zeros_like(one)
    before[chain + 1], after[chain] = one[chain], one[chain + 1]
    total = np.zeros((len(g.hub), LABELS))
    np.add.at(total, skip[:, 1], one[skip[:, 0]])
    others = np.zeros_like(one)
    np.add.at(others, skip[:, 0], (total[skip[:, 1]] - one[skip[:, 0]]) > 0)
    w, t, s = np.zeros((_FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)
    # one skip weight for all labels, never below zero: mentions of one thing never repel each other
    moment = [np.zeros_like(a) for a in (w, t, s)] + [np.zeros_like(a) for a in (w, t, s)]
    for k in range(1, steps + 1):
        z = x @ w + before @ t + after @ t.T + others * s
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        e = (one - p) / len(y)
        grads = (x.T @ e - 1e-4 * w, before.T @ e + (after.T @ e).T - 1e-4 * t, np.full(LABELS, (others * e).sum()) - 1e-4 * s)
        for i, (a, d) in enumerate(zip((w, t, s), grads, strict=True)):
            moment[i] = 0.9 * moment[i] + 0.1 * d
            moment[i + 3] = 0.99 * moment[i + 3] + 0.01 * d * d
            a += 0.1 * (moment[i] / (1 - 0.9**k)) / (np.sqrt(moment[i + 3] / (1 - 0.99**k)) + 1e-8)
        np.maximum(s, 0, out=s)
    return w, t, s


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis, keepdims=True))).squeeze(axis)


def tie(s: np.ndarray) -> np.ndarray:
    """Log probabilities of a hub's labels (columns) given a token's (rows).
    With one s for all labels a hub of two tokens is the pair potential that
    makes equal labels exp(s) times as likely as different ones."""
    e = np.exp(np.minimum(s, MOST))
    x = e + np.sqrt(e * e + (LABELS - 2) * e - (LABELS - 1))
    k = np.where(np.eye(LABELS, dtype=bool), x[:, None], 1.0)
    return np.log(k / k.sum(1, keepdims=True))


def marginals(g: Graph, weights: tuple[np.ndarray, ...], rounds: int = 12) -> np.ndarray:
    """Label probabilities of the tokens of ``g`` after ``rounds`` of messages."""
    w, t, s = weights
    x, seen, chain, skip = g.arrays()
    own = x @ w
    fixed = seen >= 0
    own[fixed] = -50.0
    own[fixed, seen[fixed]] = 50.0
    tok, hub = skip[:, 0], skip[:, 1]
    agree = tie(s)
    norm = lambda m: m - _lse(m, 1)[:, None]
    right, left = np.zeros((len(chain), LABELS)), np.zeros((len(chain), LABELS))
    up, down = np.zeros((len(tok), LABELS)), np.zeros((len(tok), LABELS))
    for _ in range(rounds):
        belief = own.copy()
        np.add.at(belief, chain + 1, right)
        np.add.at(belief, chain, left)
        np.add.at(belief, tok, down)
        if len(chain):
            right, left = (
                norm(_lse((belief[chain] - left)[:, :, None] + t[None], 1)),
                norm(_lse((belief[chain + 1] - right)[:, :, None] + t.T[None], 1)),
            )
        if len(tok):
            up = norm(_lse((belief[tok] - down)[:, :, None] + agree[None], 1))
            total = np.zeros((len(g.hub), LABELS))
            np.add.at(total, hub, up)
            down = norm(_lse((total[hub] - up)[:, :, None] + agree.T[None], 1))
    belief = own.copy()
    np.add.at(belief, chain + 1, right)
    np.add.at(belief, chain, left)
    np.add.at(belief, tok, down)
    return np.exp(norm(belief))


def stands_alone(kind: int, s: str) -> bool:
    """Whether a span has the full form of its kind, seen by itself."""
    d = _digits(s)
    if kind == 0:
        return bool(_ADDRESS.match(s))
    if kind == 1:
        return bool(_DOTTED.match(s)) and all(int(x) <= 255 for x in s.split(":")[0].split("."))
    if any(c.isalpha() for c in s):
        return False
    if kind == 2:
        return 12 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and (s.startswith("+") or bool(_NATIONAL.match(s)))


def find(texts: list[str], weights: tuple[np.ndarray, ...], least: float = 0.9, linked: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text. The field adds a token in no base
    span whose likeliest label is a kind: with a probability of at least
    ``linked`` if the token shares a key with a base span of that kind, else of at
    least ``least`` if it has the kind's full form. Tokens that follow each other, none
    of which is enough by itself, are one span if together they have
    the full form: labels that come from neighbours alone are too weak. A token
    that shares a key takes in those beside it as long as their digits, put
    together, are the end or the beginning of the known ones."""
    base = [base_spans(t) for t in texts]
    more = [certain_spans(t, b) for t, b in zip(texts, base, strict=True)]
    g = Graph()
    for k, t in enumerate(texts):
        if base[k] or _HINT.search(t):
            g.add(k, t, sorted(base[k] + more[k]))
    if g.spans:
        p = marginals(g, weights)
        best = p.argmax(1)
        best[np.array(g.seen) >= 0] = 0
        follows = set(g.chain)
        hubs: dict[int, list[int]] = {}
        for i, h in g.skip:
            hubs.setdefault(i, []).append(h)
        run: list[int] = []  # tokens in a row with one label, none enough by itself

        def end_run() -> None:
            if len(run) > 1:
                k, kind = g.spans[run[0]][0], int(best[run[0]]) - 1
                a, b = g.spans[run[0]][1], g.spans[run[-1]][2]
                if stands_alone(kind, texts[k][a:b]):
                    more[k].append((a, kind, b))
            run.clear()

        def widened(i: int, kind: int) -> Span:
            k, a, b = g.spans[i]
            whole = [g.known[h, kind] for h in hubs[i] if (h, kind) in g.known]
            left = right = i
            for _ in range(WIDEST):
                for x, y, edge in ((left - 1, right, left - 1), (left, right + 1, right)):
                    if edge in follows and g.seen[x] < 0 and g.seen[y] < 0:
                        d = _digits(texts[k][g.spans[x][1] : g.spans[y][2]])
                        if len(d) > len(_digits(texts[k][a:b])) and any(w.endswith(d) or w.startswith(d) for w in whole):
                            left, right, a, b = x, y, g.spans[x][1], g.spans[y][2]
                            break
            return a - (texts[k][a - 1 : a] == "("), kind, b

        for i in np.flatnonzero(best).tolist():
            k, a, b = g.spans[i]
            kind = int(best[i]) - 1
            sure = p[i, best[i]] >= least
            known = any((h, kind) in g.known for h in hubs.get(i, ()))
            if known and p[i, best[i]] >= linked:
                run[:] = [j for j in run if g.spans[j][0] != k or i - j > WIDEST]
                end_run()
                more[k].append(widened(i, kind))
            elif sure and stands_alone(kind, texts[k][a:b]):
                end_run()
                more[k].append((a, kind, b))
            elif sure:
                if not (run and run[-1] == i - 1 and i - 1 in follows and best[i - 1] == best[i]):
                    end_run()
                run.append(i)
        end_run()
    return [(b, sorted(b + m)) for b, m in zip(base, more, strict=True)]


def personal_data(docs: DataFrame, text_col: str = "text", least: float = 0.9) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone (base spans), base_sha256,
    spans (all, as text kind:start:end, comma-joined) and n_added.

    Offsets are code points, ends exclusive. Defined results: a null text is
    the empty one and has no spans; texts are scanned whole in linear time;
    rows are independent, so repeats get equal results; an empty table gives an
    empty table. A column of ``docs`` with one of the new names is replaced.
    """
    ship(docs.sparkSession)
    weights = trained()
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
    base = docs.drop(*[c for c in docs.columns if c.lower() in names and c != text_col])
    source = fresh(base, ["text_in"])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = find([t or "" for t in b.column(b.num_columns - 1).to_pylist()], weights, least)
            cols = [pa.array([sum(s[1] == k for s in own) for own, _ in got], pa.int64()) for k in range(len(KINDS))]
            cols.append(pa.array([hashlib.sha256(joined(own).encode()).hexdigest() for own, _ in got], pa.string()))
            cols.append(pa.array([joined(every) for _, every in got], pa.string()))
            cols.append(pa.array([len(every) - len(own) for own, every in got], pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=out_names)

    from pyspark.sql.types import StructType

    added = ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names)
    schema = StructType(base.schema.fields + StructType.fromDDL(added).fields)
    out_names = schema.names
    return base.withColumn(source, F.col(text_col).cast("string")).mapInArrow(run, schema)
