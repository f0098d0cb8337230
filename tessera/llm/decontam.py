r"""Benchmark decontamination by template canonicalisation, DataFrame operations only.

Texts become token sequences in which numbers, names and units are typed
placeholders, so that a question with other figures or other persons has the
same template. Windows of templates are hashed and joined with those of the
benchmark; then, in each alignment of a document with an item, a value of the
item must map to one value of the document. Windows with a slot that doesn't
count only if their values are the item's.

Tokens (the same for both sides) are what ``SEPARATORS`` leave, in lower case,
a dot or comma between digits included:

* number: begins with a digit;
* unit: a word of ``UNITS`` that follows a number;
* name: begins with a capital and a small letter, wherever it stands: the start
  of a sentence can be a name too;
* any other: a word.

A document's window is hashed with its placeholders, or with its values if it
has no word. An item's windows are sought in both forms, and in one with
placeholders but names as words; a document's windows with names come in the
latter form, too. Documents are sought by part of an item's windows:
at least so many that a document with the wanted share of them must hold one
sought, those first that the fewest items have. So a preamble that all items
share joins nothing unless an item is little else. Where a document has one,
all windows of the item and of the document are looked at for places where they
may align, so each part of an item that has been torn apart is found; at each
the whole item is held against the document's tokens.

Two tokens fit if they are the same but for case, or placeholders of one kind.
An alignment whose windows hold fewer words than a window less ``max_slots``
says too little as a template; only windows with the item's own values count in
it. Of the alignments of an item in one document that with the most windows
sets the values; windows of others that contradict them don't count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import staged

#: Unit words that become placeholders after a number.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons cup cups "
    "s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "usd eur gbp dollar dollars euro euros cent cents percent degree degrees mph kmh"
)
#: ASCII and Latin-1 characters that are neither letters nor digits, general and CJK punctuation; dots and commas apart.
SEPARATORS = r"[\x00-+\-/:-@\[-`{-\u00a9\u00ab-\u00b1\u00b4\u00b6-\u00b8\u00bb\u00bf\u00d7\u00f7\u2000-\u206f\u3000-\u303f\uff01-\uff0f\uff1a-\uff20]+"
#: Kinds of tokens; a template holds the placeholder's kind where it holds a larger hash for a word.
WORD, NUMBER, UNIT, NAME = range(4)
#: Rows and bytes (words and overhead) of all items up to which they are broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
#: Bytes that a row or a word takes besides its text, at most.
ROW_BYTES, WORD_BYTES = 100, 24


def tokens(text: Column) -> Column:
    """The text's tokens as they stand in it, in their own case."""
    # most characters fail the first test, which is one table
    between = rf"(?![0-9A-Za-z])(?:{SEPARATORS}|[.,](?:(?![0-9])|(?<![0-9][.,]))(?:{SEPARATORS})?)"
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), between), "")


# Expressions are SQL text: as Column calls they take longer to build than a small query takes to run.

_UNITS = ", ".join(f"'{u}'" for u in UNITS.split())
_CAPITALISED = r"{0} RLIKE r'^\p{{Lu}}\p{{Ll}}'"


def _word(x: str) -> str:
    """A hash above NAME."""
    return f"(shiftrightunsigned(xxhash64(lower({x})), 2) + {NAME + 1})"


def _windows(df: DataFrame, width: int) -> DataFrame:
    """``df`` (with a, the tokens) once for each window, with pos and its tokens
    as bare0, bare1 and so on, a word's hash or the kind of a placeholder: all
    windows of ``width`` tokens, or one that is shorter. Tokens are hashed once
    each, windows by generated code."""
    name = f"CASE WHEN get(a, i - 1) < ':' AND lower(x) IN ({_UNITS}) THEN {UNIT}L WHEN {_CAPITALISED.format('x')} THEN {NAME}L ELSE {_word('x')} END"
    # nearly all tokens are decided by their first byte
    bare = f"transform(a, (x, i) -> CASE WHEN x >= 'a' THEN CASE WHEN x < '{{' THEN {_word('x')} ELSE {name} END WHEN x < ':' THEN {NUMBER}L ELSE {name} END)"
    at = df.selectExpr("*", f"{bare} AS bare").selectExpr("*", f"explode(CASE WHEN size(a) > 0 THEN sequence(0, greatest(size(a) - {width}, 0)) END) AS pos")
    units = ", ".join(_word(f"'{u}'") for u in UNITS.split())
    each = [f"CASE WHEN get(bare, pos + {k - 1}) = {NUMBER} AND get(bare, pos + {k}) IN ({units}) THEN {UNIT}L ELSE get(bare, pos + {k}) END AS bare{k}" for k in range(width)]
    return at.selectExpr(*df.columns, "pos", *each)


def _value(width: int) -> str:
    """The hash of the window's tokens themselves; a hash passes over those past the end."""
    return "xxhash64(" + ", ".join(f"lower(get(a, pos + {k}))" for k in range(width)) + ")"


def _template(width: int) -> str:
    return "xxhash64(" + ", ".join(f"bare{k}" for k in range(width)) + ")"


def _unlike(width: int) -> str:
    """Whether a window says too little as a template: it has no word or is all there is."""
    return f"(size(a) < {width} OR greatest({', '.join(f'bare{k}' for k in range(width))}) <= {NAME})"


def _named(width: int) -> str:
    """The hash of the template in which names are words."""
    return "xxhash64(" + ", ".join(f"CASE WHEN bare{k} = {NAME} THEN {_word(f'get(a, pos + {k})')} ELSE bare{k} END" for k in range(width)) + ")"


def _forms(width: int) -> str:
    return f"CASE WHEN {_unlike(width)} THEN array({_value(width)}) ELSE array_distinct(array({_value(width)}, {_template(width)}, {_named(width)})) END"


def _index(items: DataFrame, width: int, coverage: float) -> DataFrame:
    """h, item, v, ipos, n, sought: the hashes of each item's windows, and whether
    documents are sought by them. Windows without a word come last, as they are
    only found with the item's own values."""
    words = " + ".join(f"int(bare{k} > {NAME})" for k in range(width))
    each = _windows(items, width).selectExpr("item", "v", "pos", "size(a) AS n", f"greatest(size(a) - {width - 1}, 1) AS all", f"{words} AS words", f"{_unlike(width)} AS unlike", f"{_template(width)} AS template", f"{_forms(width)} AS forms")
    common = each.groupBy("template").agg(F.count_distinct("item", "v").alias("items"))
    rank = F.row_number().over(Window.partitionBy("item", "v").orderBy("unlike", "items", F.desc("words"), "pos"))
    picked = each.join(common, "template").withColumn("sought", rank <= F.expr(f"greatest(floor({1 - coverage} * all + 1e-9) + 1, ceil(all / 2))"))
    return picked.selectExpr("explode(forms) AS h", "item", "v", "pos AS ipos", "n", "sought")


def _once(df: DataFrame, name: str, value: str) -> DataFrame:
    """``df`` with a column that later lambdas read; as a plain column the
    optimizer would write its expression into them, to be computed at each step."""
    return df.selectExpr("*", f"explode(array({value})) AS {name}")


def _small(a: str) -> str:
    return f"transform({a}, x -> lower(x))"


def _kinds(a: str) -> str:
    unit = f"coalesce(get({a}, i - 1) < ':' AND lower(x) IN ({_UNITS}), false)"
    return f"transform({a}, (x, i) -> CASE WHEN x < ':' THEN {NUMBER} WHEN {unit} THEN {UNIT} WHEN {_CAPITALISED.format('x')} THEN {NAME} ELSE {WORD} END)"


def _cut() -> list[str]:
    """The n tokens of ``a`` from ``shift`` on and the one before them, as far as
    there are any, and the place of the first of the n among them."""
    return ["size(a) AS size", "slice(a, greatest(shift - 1, 0) + 1, shift + n - greatest(shift - 1, 0)) AS da", "shift - greatest(shift - 1, 0) AS off"]


def _aligned(docs: DataFrame, index: DataFrame, few: bool, width: int) -> DataFrame:
    """doc, item, v, shift, size (of the document) and what _cut() takes, for each
    alignment with a hit: the windows sought tell which documents hold an item,
    then all windows of both where."""
    seed = f"CASE WHEN {_unlike(width)} THEN array({_value(width)}) WHEN least({', '.join(f'abs(bare{k} - {NAME})' for k in range(width))}) = 0 THEN array({_template(width)}, {_named(width)}) ELSE array({_template(width)}) END"
    spots, sought = _windows(docs, width), index.where("sought").select("h", "item", "v")
    if few:
        # the tokens are at hand where the hit is, and no more of them leaves the scan
        pairs = spots.selectExpr("doc", "a", f"explode({seed}) AS h").join(F.broadcast(sought), "h").select("doc", "item", "v", "a").distinct()
    else:
        lines = spots.selectExpr("doc", f"explode({seed}) AS h").join(sought, "h").selectExpr("doc", "struct(item, v) AS line")
        # their number grows with the input, so they are never broadcast
        by_doc = staged(lines.groupBy("doc").agg(F.collect_set("line").alias("lines")), "lines")
        pairs = docs.join(by_doc.hint("merge"), "doc").selectExpr("doc", "a", "explode(lines) AS line").select("doc", "a", "line.*")
    every = index.select("h", "item", "v", "ipos", "n")
    here = _windows(pairs, width).selectExpr("doc", "item", "v", "a", "pos", f"explode({_forms(width)}) AS h")
    hits = here.join(F.broadcast(every) if few else every, ["item", "v", "h"]).selectExpr("doc", "item", "v", "pos - ipos AS shift", "n", "a")
    return hits.selectExpr("doc", "item", "v", "shift", *_cut()).distinct()


def _compared(pairs: DataFrame, width: int, max_slots: int) -> DataFrame:
    """doc, item, v, n and wins, the windows of each alignment that count in it:
    their place, whether all values are the item's, and their slots."""
    t = _once(_once(pairs, "dw", _small("da")), "dk", _kinds("da"))
    t = _once(t, "both", "transform(sequence(0, size(iw) - 1), k -> struct(get(iw, k) AS i, get(dw, k + off) AS d, get(ik, k) AS ik, get(dk, k + off) AS dk, coalesce(get(iw, k) = get(dw, k + off), false) AS same))")
    word = f"(x.same AND (x.ik = {WORD} OR x.dk = {WORD}))"
    fits = f"(x.same OR (x.d IS NOT NULL AND x.ik = x.dk AND x.ik <> {WORD}))"
    t = _once(t, "tokens", f"transform(both, x -> struct({fits} AS fits, x.same AS same, {word} AS word, struct(x.ik AS kind, x.i AS i) AS key, coalesce(x.d, '') AS d))")
    part = f"slice(tokens, k + 1, least({width}, size(iw)))"
    t = _once(t.drop("both", "dw", "dk", "da", "ik"), "fit", f"filter(sequence(0, size(iw) - least({width}, size(iw))), k -> forall({part}, x -> x.fits))").where("size(fit) > 0")
    t = _once(t, "inside", f"transform(array_distinct(flatten(transform(fit, k -> sequence(k, k + least({width}, size(iw)) - 1)))), p -> get(tokens, p))")
    t = _once(t, "slots", "array_distinct(transform(filter(inside, x -> NOT x.word), x -> struct(x.key AS key, x.d AS d)))")
    t = _once(t, "many", "filter(slots.key, v -> size(filter(slots, z -> z.key = v)) > 1)")
    t = _once(t, "enough", f"size(iw) >= {width} AND size(filter(inside, x -> x.word)) >= {width - max_slots}")
    t = _once(t, "at", f"filter(fit, k -> forall({part}, x -> x.same) OR (enough AND forall({part}, x -> x.word OR NOT array_contains(many, x.key))))")
    # an item shorter than a window is evidence only where it is the whole document
    t = t.where(f"size(at) > 0 AND (size(iw) >= {width} OR (size = size(iw) AND shift = 0))")
    win = f"struct(k AS k, forall({part}, x -> x.same) AS same, transform(filter({part}, x -> NOT x.word), x -> struct(x.key AS key, x.d AS d)) AS slots)"
    return t.selectExpr("doc", "item", "v", "shift", f"greatest(size(iw) - {width - 1}, 1) AS n", f"transform(at, k -> {win}) AS wins")


def leaks(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = 5, max_slots: int = 2, coverage: float = 0.8) -> DataFrame:
    """Pairs (doc, item, n_windows, n_found, n_changed): an item of which a
    share of at least ``coverage`` windows stands in a document, with its own
    values or with slots that are consistent.

    n_changed counts different slots whose value in the document is another
    one than in the item: above zero the question is re-parameterised.

    Defined results: null and empty texts have no token and match nothing; an
    item of fewer tokens than ``width`` is in those documents that say nothing
    else; rows that repeat an id are one document or item, and an item with
    several texts is found where one of them is; null ids match nothing; empty
    tables give no rows. A document in which a capital or small letter begins
    a word otherwise than in the item is found by its other windows.
    """
    words = bench.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), tokens(F.col(item_text)).alias("a")).where("size(a) > 0")
    words = words.withColumn("v", F.xxhash64("a")).dropDuplicates(["item", "v"])
    known = words.selectExpr("item", "v", f"{_small('a')} AS iw", f"{_kinds('a')} AS ik")
    # each word begins at most one window of at most three forms; the other table has its words and kinds
    size = words.selectExpr("coalesce(sum(3 * size(a)), 0) AS rows", f"coalesce(sum(size(a) * {3 * ROW_BYTES + 2 * WORD_BYTES} + {ROW_BYTES} + 2 * octet_length(array_join(a, ''))), 0) AS bytes").first()
    few = size["rows"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES
    told = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), tokens(F.col(text_col)).alias("a"))
    aligned = _aligned(told, _index(words, width, coverage), few, width)
    t = _compared(aligned.join(F.broadcast(known) if few else known, ["item", "v"]), width, max_slots)
    every = t.groupBy("doc", "item", "v", "n").agg(F.sort_array(F.collect_list(F.expr("struct(-size(wins) AS size, shift, wins)"))).alias("every"))
    every = _once(every, "first", "array_distinct(flatten(transform(get(every, 0).wins, x -> x.slots)))")
    agrees = "x.same OR NOT exists(x.slots, z -> exists(first, y -> y.key = z.key AND y.d <> z.d))"
    wins = _once(every, "wins", f"filter(flatten(transform(every, e -> e.wins)), x -> {agrees})")
    changed = "size(filter(array_distinct(flatten(transform(wins, x -> x.slots))), z -> z.key.i <> z.d))"
    found = wins.selectExpr("doc", "item", "n", "size(array_distinct(transform(wins, x -> x.k))) AS f", f"{changed} AS c").where(f"f >= {coverage} * n")
    best = found.groupBy("doc", "item").agg(F.expr("max_by(struct(n, f, c), struct(f / n, n, -c))").alias("b"))
    return best.selectExpr("doc", "item", "bigint(b.n) AS n_windows", "bigint(b.f) AS n_found", "bigint(b.c) AS n_changed")


def decontaminate(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id holds no item of ``bench``, as they were;
    rows with a null id stay."""
    bad = leaks(docs, bench, id_col=id_col, **options).select(F.col("doc").alias("_bad")).distinct()
    return docs.join(bad, docs[id_col] == bad["_bad"], "left_anti")
