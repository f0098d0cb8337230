"""Each operator over nulls, empty and very long texts, ties, repeated rows,
empty tables and clashing columns, held against plain Python."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, decontam, line_dedup, merge_agenda, repetition, separator_scan, simhash, skip_chain, warc_store, wrappers, zstd_quality
from tessera.llm.queries import tokenizer_path
from tessera.session import scratch, staged

LONG = "word " * 40_000 + "x" * 100_000
WORDS = "the quick brown fox jumps over a lazy dog while seven bright stars watch from above and nobody speaks".split()


def sentence(r, n=12):
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    shared = "This line stands in Several documents."
    out = [None, "", " \n\t ", LONG, "a", "tie tie tie", "tie tie tie"]
    for k in range(30):
        lines = [sentence(r) for _ in range(r.randint(1, 6))]
        if k % 3 == 0:
            lines.insert(r.randint(0, len(lines)), "  " + shared.upper() + "\t")
        out.append("\n".join(lines))
    out += [out[10], out[11], out[10] + " indeed"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(k, t, "x", 1, 1.0, "y") for k, t in enumerate(texts)]
    # names that the operators use themselves
    return spark.createDataFrame(rows, "doc_id long, text string, H string, n_words int, score double, spans string").repartition(3)


def empty(docs):
    return docs.limit(0)


def rows(df, *cols):
    return {r["doc_id"]: tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()}


# -- op1 ----------------------------------------------------------------------

def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m.group())
        if 12 <= len(d) <= 19 and skip_chain.luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(1)
    for _ in range(4000):
        t = "".join(r.choice("a1.@+-( )5%é\n") for _ in range(50))
        assert skip_chain.base_spans(t) == plain_spans(t)
    assert skip_chain.base_spans("9" * 6000 + ".1.1.1 a@b.c@d.e") == [(6007, 0, 6012)]


def test_field_carries_labels_to_bare_mentions():
    t = "Call +1 (743) 555-3824 now. Later 743.555.3824, in 2024, room 12, v1.2.3, 555-9999; é A.B@C.org a.b@c.ORG"
    ((base, every),) = skip_chain.find([t], skip_chain.trained())
    added = [t[a:b] for a, k, b in every if (a, k, b) not in base]
    assert added == ["743.555.3824"]
    assert set(base) <= set(every)


def test_clean_text_gets_no_spans():
    t = "In 1999 the 12 men paid 1,250 for 3.5 tons at 12:30 on 2024-01-02; see page 17, build 4111111111111112."
    assert skip_chain.find([t, ""], skip_chain.trained()) == [([], []), ([], [])]


def test_hub_messages_equal_exact_enumeration():
    import itertools

    w, t, s = skip_chain.trained()
    assert (s > 0).all()
    for text in ("x 555-3824 y", "x 555-3824 y +1 (743) 555-3824", "555-9999, 743-555-9999 then 7435559999 zz 555-9999", "10.20.30.40 and 10-20-30-40"):
        g = skip_chain.Graph()
        g.add(0, text, skip_chain.base_spans(text))
        x, seen, chain, skip = g.arrays()
        # a tree, so that messages are exact: one hub only
        g.skip = [(i, h) for i, h in g.skip if h == 0 and i not in chain and i - 1 not in chain]
        skip, tie = np.array(g.skip).reshape(-1, 2), skip_chain.tie(s)
        p = np.zeros((len(x), skip_chain.LABELS))
        free = [i for i in range(len(x)) if seen[i] < 0]
        for y in itertools.product(range(skip_chain.LABELS), repeat=len(free)):
            z = seen.copy()
            z[free] = y
            chance = sum(x[i] @ w[:, z[i]] for i in free) + sum(t[z[i], z[i + 1]] for i in chain)
            hub = np.exp(sum((tie[z[i]] for i, _ in skip), np.zeros(skip_chain.LABELS))).sum()
            p[np.arange(len(x)), z] += np.exp(chance) * hub
        assert np.allclose(skip_chain.marginals(g, (w, t, s)), p / p.sum(1, keepdims=True), atol=1e-6), text


def test_pair_through_a_hub():
    k = np.exp(skip_chain.tie(np.full(skip_chain.LABELS, 2.0)))
    pair = k @ k.T
    assert np.allclose(pair / pair[0, 1], np.where(np.eye(skip_chain.LABELS) > 0, np.exp(2.0), 1))


def test_known_mentions_never_lower_a_repeat():
    w, t, s = skip_chain.trained()
    for text, bare in (("card 4111111111111111 then 4111.1111.1111.1111 fine", "4111.1111.1111.1111"), ("host 10.20.30.40 and then 10-20-30-40 up", "10-20-30-40"), ("call +1 (743) 555-3824 or 555-3824 now", "555-3824")):
        p = []
        for skips in (s, s * 0):
            g = skip_chain.Graph()
            g.add(0, text, skip_chain.base_spans(text))
            kind = skip_chain.base_spans(text)[0][1] + 1
            at = next(i for i, (_, a, b) in enumerate(g.spans) if text[a:b] == bare and g.seen[i] < 0)
            p.append(skip_chain.marginals(g, (w, t, skips))[at, kind])
        assert p[0] > p[1]
        ((base, every),) = skip_chain.find([text], (w, t, s))
        assert bare in [text[a:b] for a, _, b in every if (a, _, b) not in base]


def test_linked_mentions_have_their_whole_extent():
    cases = {
        "ip 10.1.2.3 then 10-1-2-3 ok": ["10-1-2-3"],
        "no 7536784127813050 4845168114407329 here": ["7536784127813050", "4845168114407329"],  # not one span over both
        "Call +1 (743) 555-3824 now. Later 743.555.3824 or (743) 555-3824, 12 555-3824": ["743.555.3824", "(743) 555-3824", "555-3824"],
        "at +18 (536) 228-0535 4711 he said (536) 228-0535": ["+18 (536) 228-0535", "(536) 228-0535"],
        "at +1 (836) 228-0535 x 2024-01-02 or 228-0536 and 10-1-2-3": [],
    }
    for (text, want), (base, every) in zip(cases.items(), skip_chain.find(list(cases), skip_chain.trained()), strict=True):
        assert [text[a:b] for a, k, b in every if (a, k, b) not in base] == want, text
        assert set(base) <= set(every)


def test_recall_of_bare_mentions():
    """Nine of ten at least, with their extents, and none that isn't; far fewer without skips."""
    w, t, s = skip_chain.trained()
    for seed in (99, 123):
        sample = skip_chain._sample(200, seed)
        share = {}
        for name, weights in (("skips", (w, t, s)), ("none", (w, t, s * 0))):
            hits = wanted = 0
            for (text, true), (base, every) in zip(sample, skip_chain.find([x for x, _ in sample], weights), strict=True):
                bare = [m for m in true if not any(m[0] < b[2] and b[0] < m[2] for b in base)]
                wanted, hits = wanted + len(bare), hits + sum(m in every for m in bare)
                if name == "skips":
                    assert all(any(e[1] == m[1] and e[0] < m[2] and m[0] < e[2] for m in true) for e in every if e not in base)
            share[name] = hits / wanted
        assert share["skips"] >= 0.95 and share["none"] < 0.5


def test_skips_find_bare_mentions():
    w, t, s = skip_chain.trained()
    sample = skip_chain._sample(300, 99)

    def found(weights):
        hits = false = wanted = 0
        for (_, true), (base, every) in zip(sample, skip_chain.find([text for text, _ in sample], weights), strict=True):
            meet = lambda a, b: a[0] < b[2] and b[0] < a[2]
            bare = [m for m in true if not any(meet(m, b) for b in base)]
            wanted += len(bare)
            hits += sum(any(meet(m, e) and m[1] == e[1] for e in every) for m in bare)
            false += sum(not any(meet(m, e) for m in true) for e in every if e not in base)
        return hits / wanted, false

    hits, false = found((w, t, s))
    assert hits > 0.75 and false <= 2
    assert found((w, t, s * 0))[0] < 0.5


def test_personal_data(docs, texts):
    got = rows(skip_chain.personal_data(docs), "base_sha256", "spans", "n_email")
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        own = skip_chain.joined(plain_spans(t or ""))
        assert got[k][0] == hashlib.sha256(own.encode()).hexdigest()
    assert skip_chain.personal_data(empty(docs)).count() == 0


# -- op2 ----------------------------------------------------------------------

def test_scan_stitches_blocks(spark):
    r = np.random.default_rng(3)
    folder = scratch(spark, "t").removeprefix("file://")
    import os

    os.makedirs(folder)
    want = []
    for name, end in (("a.bin", True), ("b.bin", False), ("c.bin", True), ("d.bin", True)):
        sizes = {"a.bin": r.integers(0, 40, 60).tolist(), "b.bin": [500, 0, 0, 3], "c.bin": [], "d.bin": [0]}[name]
        ids, at = [], 0
        for k, n in enumerate(sizes):
            ids += r.integers(0, 9, n).tolist() + [9]
            want.append((name, k, at, n, True))
            at += n + 1
        if not end:
            ids += [1, 2, 3]
            want.append((name, len(sizes), at, 3, False))
        np.array(ids, "<u2").tofile(f"{folder}/{name}")
    for block in (7, 64, 10_000):
        got = [(x["file"].split("/")[-1], x["ordinal"], x["start"], x["n_tokens"], x["complete"]) for x in separator_scan.scan(spark, "file://" + folder, 9, 2, block).collect()]
        assert sorted(got) == sorted(want)


def test_runs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(separator_scan, "RUN", 3)
    test_scan_stitches_blocks(spark)


def test_token_counts(spark, docs, texts):
    import public_tokenizers

    make = separator_scan.rank_tokenizer(tokenizer_path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    encode = make()
    got = rows(separator_scan.token_counts(docs, scratch(spark, "t"), make, 50_256, block=500), "n_tokens")
    assert got == {k: len(encode([t or ""])[0]) for k, t in enumerate(texts)}
    assert separator_scan.token_counts(empty(docs), scratch(spark, "t"), make, 50_256).count() == 0


# -- op3 ----------------------------------------------------------------------

def plain_repetition(t):
    w = re.findall("[^\x20\x09-\x0d]+", t)

    def marked(n):
        c = collections.Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
        m = [False] * len(w)
        for i in range(len(w) - n + 1):
            if c[tuple(w[i : i + n])] > 1:
                m[i : i + n] = [True] * n
        return m

    seen, dup, chars = set(), 0, 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            if line in seen:
                dup += 1
                chars += sum(map(len, re.findall("[^\x20\x09-\x0d]+", line)))
            seen.add(line)
    cover = [sum(len(x) for x, m in zip(w, marked(n), strict=True) if m) for n in repetition.LENGTHS]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, sum(marked(3)), chars, *cover)


def test_repetition(docs, texts):
    got = rows(repetition.repetition(docs), *repetition.MEASURES)
    for k, t in enumerate(texts):
        assert got[k] == plain_repetition(t or ""), k
    assert repetition.repetition(empty(docs)).count() == 0
    verdict = rows(repetition.repetition(docs), "base_failed", "kept")
    assert verdict[0] == (True, False) and not any(f and k for f, k in verdict.values())


def test_repetition_of_random_texts():
    r = random.Random(2)
    many = ["".join(r.choice("ab é\n#") for _ in range(r.randint(0, 80))) for _ in range(400)]
    got = repetition.measure([t.encode() for t in many])
    for k, t in enumerate(many):
        assert tuple(int(got[m][k]) for m in repetition.MEASURES) == plain_repetition(t)


def test_repetition_verifies_equal_hashes():
    bits = [0]
    while len(bits) < 4096:
        bits += [1 - b for b in bits]
    a, b = ("".join(pair[x] for x in bits) for pair in ("ab", "ba"))  # collide in every polynomial modulo 2 ** 64
    got = repetition.measure([f"{a}\n{b}\n{a}".encode()])
    assert got["n_dup_lines"][0] == 1 and got["dup_line_chars"][0] == 4096
    same = np.zeros(6, np.uint64)  # hashes that say nothing
    assert repetition._twice(same, [np.array([1, 1, 2, 3, 2, 4])]).tolist() == [True, True, True, False, True, False]


def test_repetition_rejects_beyond_the_base(spark):
    r = random.Random(6)
    fresh = [" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(20)) for _ in range(14)]
    text = "\n".join([*fresh, *fresh[:4]])
    clean = "\n".join(fresh)
    noisy = " ".join(w + "%*#" for w in clean.split())  # 3 signs a word of 9 characters
    some = " ".join(w + "#" * (k % 2) for k, w in enumerate(clean.split()))
    df = spark.createDataFrame([(0, text), (1, clean), (2, noisy), (3, some)], "doc_id long, text string")
    got = rows(repetition.repetition(df), "base_failed", "kept")
    assert got == {0: (False, False), 1: (False, True), 2: (False, False), 3: (False, True)}
    assert rows(repetition.repetition(df, limits={"symbols": 0.5}), "base_failed", "kept")[2] == (False, True)


# -- op4 ----------------------------------------------------------------------

def test_agenda_equals_library(docs, texts):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    odd = ["  a  b ", "\n\n x", "▁▁", "é𝕏\x00", "<s> <0x41>", "日本 語", "a b", "x" * 5000, " ", "\n"]
    agenda = merge_agenda.Agenda(open(path, "rb").read())
    for t, ids in zip(odd, agenda.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(t), t
    got = rows(merge_agenda.encode_decode(docs, path), "pieces", "decoded", "n_tokens", "ids_sha256")
    for k, t in enumerate(texts):
        ids = lib.encode(t or "", add_bos=True, add_eos=True)
        assert got[k] == (ids, lib.decode(ids), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert merge_agenda.encode_decode(empty(docs), path).count() == 0


def test_both_agendas_agree():
    agenda = merge_agenda.Agenda(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    for t in ("▁internationalization", "▁aaaaaaabbbbb", "▁▁▁x"):
        short = agenda.segment(t)
        try:
            merge_agenda.SHORT, old = 0, merge_agenda.SHORT
            assert agenda.segment(t) == short
        finally:
            merge_agenda.SHORT = old


# -- op5 ----------------------------------------------------------------------

def test_quality(spark, docs, texts):
    r = random.Random(4)
    good = [sentence(r, 60) for _ in range(300)]
    bad = [" ".join(w.upper() + "!! ###" for w in sentence(r, 40).split()) for _ in range(300)]
    d = spark.createDataFrame([(k, t) for k, t in enumerate(good + bad)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 300), 0) for k in range(600)] + [(901, None, None)], "doc_id long, quality int, toxic int")
    model = zstd_quality.learn(d, labels)
    got = rows(zstd_quality.score_quality(d, model).withColumn("h", zstd_quality.held_out("doc_id")), "score", "predicted", "h")
    assert all(0 <= s <= 1 for s, _, _ in got.values())
    held = [(k, v) for k, v in got.items() if v[2] and k < 600]
    assert len(held) > 60 and sum(v[1] == (k < 300) for k, v in held) / len(held) > 0.97
    assert got[900][0] == got[901][0]
    none = zstd_quality.learn(d, labels.limit(0))
    assert set(rows(zstd_quality.score_quality(docs, none), "score").values()) == {0.5}
    assert zstd_quality.score_quality(empty(docs), model).count() == 0


def test_quality_equals_recomputed_scores(spark):
    r = random.Random(14)
    good = [sentence(r, r.choice((30, 60, 3000))) for _ in range(80)]
    bad = [" ".join(w.upper() + "!! ###" for w in sentence(r, 40).split()) for _ in range(60)]
    d = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 80)) for k in range(140)], "doc_id long, quality int")
    model = zstd_quality.learn(d.repartition(5).unionByName(d.where("doc_id = 1").withColumn("text", F.lit(""))), labels.unionByName(labels.limit(9)))
    order = [x["doc_id"] for x in labels.where(~zstd_quality.held_out("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    ones = sum(k < 80 for k in order)
    want = zstd_quality.fit([good[k].encode() for k in order if k < 80], [bad[k - 80].encode() for k in order if k >= 80], (ones + 1) / (len(order) + 2))
    assert model == want

    import math

    import zstandard

    pack = [zstandard.ZstdCompressor(level=zstd_quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_dict_id=False) for x in (model.good, model.bad)]
    for k, score in rows(zstd_quality.score_quality(d, model), "score").items():
        t = (good + bad)[k].encode()
        a, b = (sum(len(p.compress(t[i : i + 1024])) for i in range(0, len(t), 1024)) for p in pack)
        diff, long = max(-0.5, min(0.5, (b - a) / (len(t) + 1))), math.log(len(t) + 1)
        z = model.weights[0] + sum(w * (x - m) / s for w, x, m, s in zip(model.weights[1:], (diff, long, diff * long), model.mean, model.scale, strict=True))
        assert abs(score - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_pieces_are_spread_over_the_whole_text():
    text = bytes(range(100)) * 1024
    pieces = zstd_quality.spread(text)
    assert len(pieces) <= zstd_quality.PIECES and pieces[0] == text[:1024] and text.rindex(pieces[-1]) > len(text) // 2
    assert zstd_quality.spread(b"") == [] and zstd_quality.spread(b"abc") == [b"abc"]


# -- op6 ----------------------------------------------------------------------

def test_archive(spark):
    big, other = "é" * 80, "y" * 100
    pages = [(1, "u1", big), (2, "u2", big), (3, None, None), (4, "u4", ""), (5, "u5", "small"), (6, "u6", "small"), (7, "u7", other), (7, "u7", other), (0, "u0\r\nX: 1", big), (None, "n", other)]
    df = spark.createDataFrame([(*p, "z") for p in pages], "page_id long, url string, html string, digest string").repartition(3)
    folder = scratch(spark, "warc")
    warc_store.write_archive(df, folder)
    index = warc_store.read_index(spark, folder).collect()
    assert len(index) == len(pages) and all(r["payload_digest"] == hashlib.sha256(b).hexdigest() for r in index for b in [next((h or "").encode() for p, _, h in pages if p == r["page_id"])])
    kinds = collections.Counter((r["page_id"], r["record_type"], r["refers_to"]) for r in index)
    assert kinds == {(0, "response", None): 1, (1, "revisit", 0): 1, (2, "revisit", 0): 1, (3, "response", None): 1, (4, "response", None): 1, (5, "response", None): 1, (6, "response", None): 1, (7, "response", None): 2, (None, "response", None): 1}
    body = {(r["page_id"], bytes(r["payload"])) for r in warc_store.read_records(spark, folder).collect()}
    assert body == {(p, (h or "").encode()) for p, _, h in pages}
    for r in warc_store.read_records(spark, folder).collect():
        raw = bytes(r["record"])
        head, _, rest = raw.partition(b"\r\n\r\n")
        assert len(rest) - 4 == int(re.search(rb"Content-Length: (\d+)", head)[1]) and b"\r\nX: 1" not in head
        assert r["page_id"] != 0 or b"WARC-Target-URI: u0%0D%0AX: 1\r\n" in head
    assert warc_store.read_payloads(spark, folder).count() == 4
    broken = scratch(spark, "warc")
    warc_store.write_archive(df, broken)
    stored = spark.read.parquet(f"{broken}/payloads")
    for change in (stored.where(F.length("payload") < 100), stored.withColumn("payload", F.when(F.length("payload") < 100, F.col("payload")).otherwise(F.lit(b"x")))):
        other = scratch(spark, "warc")
        spark.read.parquet(f"{broken}/records").write.parquet(f"{other}/records")
        change.write.parquet(f"{other}/payloads")
        for read in (warc_store.read_index, warc_store.read_records):
            with pytest.raises(Exception, match="payload lost or changed"):
                read(spark, other).collect()
    named = spark.createDataFrame([("a b>\r\n/é", "u", big), ("z", "u", big)], "page_id string, url string, html string")
    warc_store.write_archive(named, other := scratch(spark, "warc"))
    assert {(r["page_id"], r["refers_to"]) for r in warc_store.read_index(spark, other).collect()} == {("a b>\r\n/é", None), ("z", "a b>\r\n/é")}
    warc_store.write_archive(df.limit(0), folder)
    assert warc_store.read_index(spark, folder).count() == 0


# -- op7 ----------------------------------------------------------------------

def plain_simhash(t):
    import xxhash

    w = (t or "").encode().lower().split()
    if not w:
        return 0
    s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def closure(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def test_simhash(docs, texts):
    fp = [plain_simhash(t) for t in texts]
    want = closure(len(fp), [(i, j) for i in range(len(fp)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    got = rows(simhash.near_duplicates(docs).select("doc_id", simhash.hex16().alias("f"), "component_id"), "f", "component_id")
    assert got == {k: (f"{fp[k]:016x}", want[k]) for k in range(len(fp))}
    assert simhash.near_duplicates(empty(docs)).count() == 0


def test_links_lose_none(spark):
    r = random.Random(6)
    fps = {r.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for n in range(1, 7):
            g = f
            for b in r.sample(range(64), n):
                g ^= 1 << b
            fps.add(g)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = {frozenset((x["a"] % (1 << 64), x["b"] % (1 << 64))) for x in simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()}
    assert got == {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}


def broadcast_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin")


def test_links_never_broadcast_the_index(spark):
    """A staged table of few bytes, whose rows become 67 each."""
    nodes = staged(spark.range(500).select(F.xxhash64("id").alias("fp")), "nodes")
    assert broadcast_joins(simhash.links(nodes)) == 0


def test_near_copies_of_the_pipeline_never_broadcast_the_index(spark, docs, monkeypatch):
    import corpus_pipeline

    plans = {}
    monkeypatch.setattr(components, "staged", lambda df, name: (plans.setdefault(name, broadcast_joins(df)), staged(df, name))[1])
    given = staged(docs, "documents")
    assert corpus_pipeline.near_copies(spark, given, "").count() == simhash.near_duplicates(given).select("component_id").distinct().count()
    assert plans["edges"] == 0


def test_components_of_chains_and_stars(spark):
    r = random.Random(7)
    pairs = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(r.randint(200, 260), r.randint(200, 260)) for _ in range(40)]
    want = closure(300, pairs)
    nodes = spark.createDataFrame([(k, k) for k in range(300)], "node long, rank long")
    got = {x["node"]: x["component"] for x in components.components(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == dict(enumerate(want))


# -- op8 ----------------------------------------------------------------------

def plain_line_dedup(texts):
    blanks = " \t\n\x0b\x0c\r"
    key = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s.strip(blanks))
    held = collections.defaultdict(set)
    for k, t in texts:
        for line in (t or "").split("\n"):
            held[key(line)].add(k)
    gone = {x: max(ids) for x, ids in held.items() if len(x) >= 20 and len(ids) >= 3}
    out = {}
    for k, t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if gone.get(key(x), k) == k]
        out[k] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(spark, docs, texts):
    got = rows(line_dedup.line_dedup(docs), "n_lines", "n_dropped", "text")
    assert got == plain_line_dedup(list(enumerate(texts)))
    assert sum(v[1] for v in got.values()) > 5
    assert line_dedup.line_dedup(empty(docs)).count() == 0
    again = docs.where("doc_id >= 5").unionByName(docs.where("doc_id >= 5")).withColumn("n_lines", F.lit(1))
    twice = line_dedup.line_dedup(again)
    assert twice.columns[-2:] == ["_n_lines", "n_dropped"]
    assert rows(twice, "_n_lines", "n_dropped", "text") == plain_line_dedup([(k, t) for k, t in enumerate(texts) if k >= 5])
    assert twice.count() == 2 * (len(texts) - 5)


def test_line_dedup_null_ids(spark):
    t = "a line of more than twenty characters"
    d = spark.createDataFrame([(None, t), (1, t), (2, t + "\nx")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(d).collect()} == {None: "", 1: "", 2: t + "\nx"}


# -- op9 ----------------------------------------------------------------------

PAGE = '<html><head><title>T</title></head><body><nav><a>Home</a></nav>{ad}<article class="post"><h1>{h} &amp; more</h1>{p}<div class="share-bar">Share</div><section id="comments"><p>bad</p></section></article><aside>no</aside><footer>&copy; us</footer></body></html>'


def page(h, paragraphs, ad=""):
    return PAGE.format(h=h, p="".join(f"<p>{x}</p>" for x in paragraphs), ad=ad)


def test_main_text(spark):
    rows_ = [(k, "http://h.example/x", page(f"Title {k}", [f"one {k}<br>two", "a <b>bold</b>\n  word"] + ["more"] * (k % 3), '<div class="ad">buy</div>' if k % 2 else "")) for k in range(9)]
    odd = [(20, None, None), (21, "not a url", ""), (22, "http://x.example", "<p>un<b>closed <p>two<"), (23, "http://x.example", "<script>if (a<b) x()</script>text <!-- no"), (24, "http://h.example/y", rows_[0][2])]
    df = spark.createDataFrame([(*r, "old") for r in rows_ + odd], "page_id long, url string, html string, text string").repartition(4)
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in wrappers.main_text(df).collect()}
    for k in range(9):
        want = "\n".join([f"Title {k} & more", f"one {k}", "two", "a bold word"] + ["more"] * (k % 3))
        assert got[k] == (want, len(want))
    assert got[20][0] == got[21][0] == "" and got[22][0] == "unclosed\ntwo" and got[23][0] == "text" and got[24] == got[0]
    assert wrappers.main_text(df.limit(0)).count() == 0


def _wrapped(pages):
    import json

    nodes = None
    for p in pages:
        nodes = wrappers.tree(p) if nodes is None else wrappers.align(nodes, wrappers.tree(p))
    return json.dumps([len(pages), nodes])


def test_deep_and_wide_pages():
    kinds = ("<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<p><b>{0}</b>,{0}</p>")
    r = random.Random(3)
    for make in (
        lambda j: "<div>" * 100_000 + f"hello {j}",
        lambda j: "<p><b>" * 5_000 + f"hello {j}",
        lambda j: "".join(f"<p>said {j} {k}</p>" for k in range(20_000)) + f"hello {j}",
        lambda j: "".join(r.choice(kinds).format(f"{k}.{j}") for k in range(3_000)) + f"hello {j}",
    ):
        pages = [make(j) for j in range(3)]
        wrapper = _wrapped(pages)
        for j, p in enumerate(pages):
            want = [x for x in re.sub(r"</?(?:p|h2|ul|li|div)>", "\n", re.sub(r"</?b>", "", p)).split("\n") if x]
            assert wrappers.extract(p, wrapper) == "\n".join(want) and want[-1] == f"hello {j}"


def test_long_lists_of_children_are_aligned_by_key(monkeypatch):
    monkeypatch.setattr(wrappers, "WIDE", 0)
    pages = [f"<h1>Title {j}</h1>" + "<h3>Also read</h3>" * (j % 2) + f"<p>text {j}</p><h2>more {j}</h2>" + "<h6>All rights reserved</h6>" for j in range(6)]
    wrapper = _wrapped(pages)
    assert [wrappers.extract(p, wrapper) for p in pages] == [f"Title {j}\ntext {j}\nmore {j}" for j in range(6)]


def test_comments_in_articles_go():
    pages = [f'<main><article><h1>T{j}</h1><p>body {j}</p><article class="comment"><p>nice {j}</p></article></article><article id="comments"><p>bad {j}</p></article></main>' for j in range(3)]
    assert [wrappers.extract(p, _wrapped(pages)) for p in pages] == [f"T{j}\nbody {j}" for j in range(3)]
    teasers = [f'<article class="promo"><p>alone {j}</p></article>' for j in range(3)]
    assert [wrappers.extract(p, _wrapped(teasers)) for p in teasers] == [f"alone {j}" for j in range(3)]


def test_open_paragraphs_far_up_are_closed():
    page = "<p>one" + "<b>" * 20 + "two<p>three"
    assert wrappers.extract(page, _wrapped([page])) == "onetwo\nthree"


def test_wrapper_has_options_repeats_and_slots():
    a, b = wrappers.tree(page("A", ["x", "y"])), wrappers.tree(page("B", ["z"], '<div class="ad">buy</div>'))
    e = wrappers.expression(wrappers.align(a, b))
    assert '(<div.ad>"buy"</div.ad>)?' in e and "(<p>#TEXT</p>)+" in e and '<nav><a>"Home"</a></nav>' in e
    assert wrappers.align(a, a) == a


def test_constant_slots_outside_an_article_go(spark):
    html = lambda k: f"<body><div>Welcome to our site</div><div>story {k} text</div></body>"
    df = spark.createDataFrame([(k, "http://c.example/", html(k)) for k in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(df).collect()} == {f"story {k} text" for k in range(4)}


def test_all_lines_of_an_article_stay(spark):
    html = lambda k: f"<body><p>Welcome to our site</p><article><h1>Weekly report</h1><p>By the staff writers</p><p>Common opening paragraph.</p>" + "".join(f"<p>story {k} part {n}</p>" for n in range(1 + k % 3)) + '<div class="ad-box">Buy</div></article></body>'
    df = spark.createDataFrame([(k, "http://t.example/", html(k)) for k in range(6)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}
    assert got == {k: "\n".join(["Weekly report", "By the staff writers", "Common opening paragraph."] + [f"story {k} part {n}" for n in range(1 + k % 3)]) for k in range(6)}
    same = spark.createDataFrame([(k, "http://t.example/", html(0)) for k in range(4)], "page_id long, url string, html string")
    assert {r["text"] for r in wrappers.main_text(same).collect()} == {"Weekly report\nBy the staff writers\nCommon opening paragraph.\nstory 0 part 0"}


def test_marks_are_whole_names():
    for name in ("share-price", "search-results-explained", "related-work", "has-sidebar", "adverbs"):
        assert wrappers.extract(f'<article><h1>Title of it all</h1><div class="{name}">The share price rose</div></article>', "[0, []]") == "Title of it all\nThe share price rose"
    for name in ("share", "share-buttons", "big ad-box", "relatedLinks", "sidebar-left"):
        assert wrappers.extract(f'<article><h1>Title of it all</h1><div class="{name}">Share</div></article>', "[0, []]") == "Title of it all"


def planted(r, layout, k):
    """A page without telling names, and its main text."""
    lines = [sentence(r, r.choice((3, 14, 25))) for _ in range(r.randint(1, 7))]
    head = f"Headline {k} {sentence(r, 3)}"
    body = "".join(f"<p>{x}</p>" for x in lines)
    teasers = "".join(f"<li>{sentence(r, 3)}</li>" for _ in range(3))
    offer = sentence(r, 5)
    page_ = {
        "section": f"<div><ul>{teasers}</ul></div><section><h2>{head}</h2>{body}</section><div><i>{offer}</i></div>",
        "table": f"<table><tr><td><ul>{teasers}</ul></td></tr></table><p>Open every day</p><div><h2>{head}</h2>{body}</div>",
        "flat": f"<p>Welcome to our site</p><h2>{head}</h2>{body}<p><b>All rights reserved</b></p>",
        "deep": f"<div><div><section><h2>{head}</h2>{body}</section></div><table><tr><td>{offer}</td></tr></table></div>",
    }[layout]
    return f"<html><body>{page_}</body></html>", [head, *lines]


def test_regions_without_names_are_found_by_the_wrapper():
    r = random.Random(8)
    found = wanted = said = alone = 0
    for layout in ("section", "table", "flat", "deep"):
        pages = [planted(r, layout, k) for k in range(12)]
        wrapper = _wrapped([p for p, _ in pages])
        for p, want in pages:
            got = wrappers.extract(p, wrapper).split("\n")
            both = sum((collections.Counter(got) & collections.Counter(want)).values())
            found, wanted, said = found + both, wanted + len(want), said + len(got)
            alone += wrappers.extract(p, "[0, []]").split("\n") != got
    print(found / wanted, found / said, alone)
    assert found >= 0.95 * wanted and found >= 0.9 * said
    assert alone >= 20  # with an empty wrapper other texts come out


def plain_align(a, b):
    """Keys of a least common supersequence, by exhaustive search: (length, keys)."""
    if not a or not b:
        return len(a) + len(b)
    if a[0] == b[0]:
        return 1 + plain_align(a[1:], b[1:])
    return 1 + min(plain_align(a[1:], b), plain_align(a, b[1:]))


def test_alignment_of_small_trees_keeps_both_sides():
    """What is aligned matches both pages, with no slot or tag lost, and is not
    much longer than the shortest list of children that holds both."""
    r = random.Random(4)
    longer = 0
    for _ in range(300):
        a, b = (["".join(r.choice("abc")) for _ in range(r.randint(0, 7))] for _ in range(2))
        x, y = ("".join(f"<{t}>{i}</{t}>" for i, t in enumerate(z)).replace("<a>", "<h1>").replace("</a>", "</h1>").replace("<b>", "<h2>").replace("</b>", "</h2>").replace("<c>", "<h3>").replace("</c>", "</h3>") for z in (a, b))
        w = wrappers.align(wrappers.tree(x), wrappers.tree(y))
        pattern = re.sub(r"#TEXT|\"[^\"]*\"", "[0-9]", wrappers.expression(w))
        for z in (x, y):
            assert re.fullmatch(pattern, z), (pattern, z)
        squeeze = lambda z: [t for i, t in enumerate(z) if not i or z[i - 1] != t]
        longer += max(0, len(w) - plain_align(squeeze(a), squeeze(b)))
    assert longer <= 60


def test_slots_of_one_page_stay_and_long_template_text_goes(spark):
    notice = "All prices include the tax of the land in which the buyer lives; " * 4
    only = ["<ul><li>one item</li></ul>", "<table><tr><td>one cell</td></tr></table>", "<h3>one heading</h3>", "<blockquote>one quote</blockquote>", ""]
    html = lambda k: f"<body><div><b>{notice}</b></div><h1>Title {k}</h1>{only[k]}</body>"
    df = spark.createDataFrame([(k, "http://s.example/", html(k)) for k in range(5)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in wrappers.main_text(df).collect()}
    assert got == {0: "Title 0\none item", 1: "Title 1\none cell", 2: "Title 2\none heading", 3: "Title 3\none quote", 4: "Title 4"}


def test_marks_do_not_take_whole_articles():
    none = "[1, []]"
    for around in ("content has-sidebar", "no-sidebar", "with-comments", "search-results", "page withoutWidgets"):
        assert wrappers.extract(f'<body><div class="{around}"><article><p>The story</p><div class="share">Share</div></article></div></body>', none) == "The story"
    for around in ("content has-sidebar", "search-results"):
        assert wrappers.extract(f'<body><div class="{around}"><p>A long story is told here</p><div class="share">Share</div></div><div>short</div></body>', none).startswith("A long story is told here")
    assert "Share" not in wrappers.extract('<body><div class="search"><p>A long story is told here</p><div class="share">Share</div></div></body>', none)
    assert wrappers.extract('<body><article>Story</article><div class="related"><article>Teaser</article></div><aside><article>Other</article></aside></body>', none) == "Story"
    assert wrappers.extract('<body><div class="sidebar">Side</div><p>The story is longer</p></body>', none) == "The story is longer"


# -- op10 ---------------------------------------------------------------------

ITEMS = [
    (1, "A farmer named Tom has 12 apples and gives Ann 5 apples before Tom eats 2 apples alone today"),
    (2, "the quick brown fox jumps over the lazy dog near the quiet river bank every single morning"),
    (3, "three words only"),
    (4, None),
    (5, ""),
    (6, "yes"),
    (None, "some words without an id in this benchmark table here"),
]


def plain_tokens(t):
    """Words in lower case and their kinds: 0 word, 1 number, 2 unit, 3 name."""
    own = [x for x in re.split(decontam.SEPARATORS + r"|[.,](?![0-9])|(?<![0-9])[.,]", t or "") if x]
    out = []
    for k, x in enumerate(own):
        after = k and own[k - 1] < ":"
        kind = 1 if x < ":" else 2 if after and x.lower() in decontam.UNITS.split() else 3 if len(x) > 1 and x[0].isupper() and x[1].islower() else 0
        out.append((x.lower(), kind))
    return out


def plain_leaks(docs, items, width=5, max_slots=2, coverage=0.8):
    """Every shift of every item against every document."""
    out = {}
    for doc, text in docs:
        d = plain_tokens(text)
        for item, said in items:
            i = plain_tokens(said)
            n = len(i)
            if not n or not d or doc is None or item is None:
                continue
            w, every = min(width, n), []
            for shift in range(-n + 1, len(d)):
                tokens = []
                for k, (a, ka) in enumerate(i):
                    b, kb = d[shift + k] if 0 <= shift + k < len(d) else (None, None)
                    same = a == b
                    tokens.append((same or (ka == kb and ka > 0), same, same and 0 in (ka, kb), ((ka, a), b)))
                at = [k for k in range(n - w + 1) if all(x[0] for x in tokens[k : k + w])]
                inside = {p for k in at for p in range(k, k + w)}
                slots = {tokens[p][3] for p in inside if not tokens[p][2]}
                many = {s for s, c in collections.Counter(s for s, _ in slots).items() if c > 1}
                enough = n >= width and sum(tokens[p][2] for p in inside) >= width - max_slots
                if n < width and (shift or len(d) != n):
                    continue
                fine = lambda part: all(x[1] for x in part) or (enough and all(x[2] or x[3][0] not in many for x in part))
                wins = [(k, all(x[1] for x in tokens[k : k + w]), [x[3] for x in tokens[k : k + w] if not x[2]]) for k in at if fine(tokens[k : k + w])]
                if wins:
                    every.append((-len(wins), shift, wins))
            if not every:
                continue
            every.sort(key=lambda e: e[:2])
            first = collections.defaultdict(set)
            for _, _, z in every[0][2]:
                for key, b in z:
                    first[key].add(b)
            wins = [x for e in every for x in e[2] if x[1] or not any(key in first and first[key] != {b} for key, b in x[2])]
            found = {k for k, _, _ in wins}
            if len(found) >= coverage * (n - w + 1):
                out[doc, item] = (n - w + 1, len(found), len({s for x in wins for s in x[2] if s[0][1] != s[1]}))
    return out


def test_leaks(spark):
    d = [
        (1, "Intro text. " + ITEMS[0][1] + ". The end follows here."),
        (2, "Intro text. A farmer named Bob has 30 apples and gives Eve 7 apples before Bob eats 9 apples alone today. Bye."),
        (3, "Intro. A farmer named Bob has 30 apples and gives Eve 7 apples before Kim eats 9 apples alone today. Bye."),
        (4, "Well, " + ITEMS[1][1].upper() + "!!"),
        (5, "the quick brown fox jumps over the lazy dog and that is all there is to it in this text"),
        (6, "Three words, only."),
        (7, None),
        (8, ""),
        (9, LONG),
        (None, ITEMS[1][1]),
        (4, "a second row of this id"),
        (10, "oh yes, these are three words only, yes"),
    ]
    docs = spark.createDataFrame([(*x, "a", 1) for x in d], "doc_id long, text string, item string, pos int").repartition(3)
    bench = spark.createDataFrame([(*x, "b") for x in ITEMS], "item_id long, text string, doc string")
    found = decontam.leaks(docs, bench)
    got = {(r["doc"], r["item"]): r["n_changed"] for r in found.collect()}
    assert set(got) == {(1, 1), (2, 1), (4, 2), (6, 3)}
    assert got[1, 1] == 0 and got[2, 1] > 0
    left = sorted((r["doc_id"] is None, r["doc_id"]) for r in decontam.decontaminate(docs, bench).collect())
    assert [x for _, x in left] == [3, 5, 7, 8, 9, 10, None]
    assert decontam.leaks(docs.limit(0), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0
    twice = bench.unionByName(spark.createDataFrame([(1, "another text of item one that nobody ever says", "b"), (2, ITEMS[1][1], "b")], bench.schema))
    assert {(r["doc"], r["item"]): r["n_changed"] for r in decontam.leaks(docs, twice).collect()} == got


def test_leaks_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    test_leaks(spark)


def leaked(spark, item, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    return {r["doc"]: r["n_changed"] for r in decontam.leaks(docs, bench).collect()}


def test_leaks_with_dense_slots_and_first_names(spark):
    item = "Tom ran 5 miles in 3 hours and Ann ran 8 miles in 4 hours"
    got = leaked(spark, item, ["So. Bob ran 7 miles in 2 hours and Eve ran 9 miles in 6 hours.", item, "It took 5 miles in 3 hours or 8 miles in 4 hours", "He ran 7 miles in 2 hours"])
    assert set(got) == {0, 1} and got[0] > 0 and got[1] == 0
    assert set(leaked(spark, "Tom ran 5 miles home today", ["Kim ran 7 miles home today", "Kim sold 7 miles home today"])) == {0}
    alice = "Alice has 3 apples. Bob gives Alice 4 more apples. How many apples does Alice have in the end?"
    assert leaked(spark, alice, [alice.replace("Alice", "Carol").replace("Bob", "Dave").replace("3", "7").replace("4", "2")])[0] > 0
    sums = "Compute 12 + 15 * 3 - 7 / 2 and then multiply by 9 to give 88, or divide by 4 to give 21"
    assert leaked(spark, sums, ["Compute 14 + 11 * 5 - 6 / 8 and then multiply by 3 to give 71, or divide by 9 to give 1,250.5"])[0] > 0


def test_leaks_with_one_inconsistent_slot(spark):
    item = "The shop had 12 red boxes on the long shelf near the old door and sold them all before noon, then the owner brought 12 new boxes and 5 bags from the store room behind the house"
    got = leaked(spark, item, [item.replace("12 new", "13 new"), item.replace("12", "4").replace("5 bags", "4 bags")])
    assert set(got) == {0, 1}
    balls = "A bag holds 3 red balls and 5 blue balls and somebody draws two balls without looking"
    assert set(leaked(spark, balls, [balls.replace("3", "4").replace("5", "4")])) == {0}


def test_slots_agree_over_all_alignments(spark):
    item = "Tom walks to Tom's old house and Tom buys bread there then Tom walks home and Tom eats what Tom bought while Tom hums and after that Tom sleeps until Tom hears a bell"
    swap = lambda a, b: item[:52].replace("Tom", a) + " slowly" + item[52:].replace("Tom", b)
    assert set(leaked(spark, item, [swap("Bob", "Bob"), swap("Bob", "Kim")])) == {0}


def test_shared_preambles_do_not_join(spark):
    rows_ = [(k, f"Read the question with care and choose the one right answer from the list below: what does the {a} say of the {b}") for k, (a, b) in enumerate([("sailor", "storm"), ("baker", "oven"), ("judge", "witness"), ("teacher", "pupil")])]
    bench = spark.createDataFrame(rows_, "item_id long, text string")
    words = bench.select(F.col("item_id").alias("item"), decontam.tokens(F.col("text")).alias("a")).withColumn("v", F.lit(0))
    index = decontam._index(words, 5, 0.8)
    own = index.where("n - ipos <= 10").count()
    assert own and index.groupBy("h").count().where("count = 4").count() <= 10


def test_leaks_equal_brute_force(spark):
    r = random.Random(11)
    names, units = ["Tom", "Ann", "Bob", "Eve", "Kim"], ["km", "kg", "hours"]

    def question():
        out = []
        for _ in range(r.randint(4, 30)):
            x = r.random()
            out += [r.choice(names)] if x < 0.15 else [str(r.randint(1, 30)), r.choice(units)] if x < 0.25 else [str(r.randint(1, 30))] if x < 0.3 else [r.choice(WORDS)]
        return " ".join(out)

    def other(t):
        figures, people = {}, dict(zip(names, r.sample(names, len(names)), strict=True))
        return " ".join(people.get(x, figures.setdefault(x, str(r.randint(31, 90))) if x.isdigit() else x) for x in t.split())

    items = [(k, question()) for k in range(25)]
    docs, planted = [], set()
    for k in range(150):
        parts, item = [sentence(r, r.randint(0, 8))], r.randrange(25)
        if k % 3:
            t = items[item][1] if k % 3 == 1 else other(items[item][1])
            words = t.split()
            if k % 4 == 1:  # a word more, or another one
                words.insert(r.randrange(len(words)), "indeed")
            elif k % 4 == 2:
                words[r.randrange(len(words))] = "indeed"
            elif len(words) >= 8:
                planted.add((k, item))
            parts.append(" ".join(words))
        docs.append((k, ". ".join([*parts, sentence(r, r.randint(0, 8))])))
    want = plain_leaks(docs, items)
    got = {(x["doc"], x["item"]): (x["n_windows"], x["n_found"], x["n_changed"]) for x in decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == set(want)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert sum(got[k] == want[k] for k in got) >= 0.9 * len(got)  # alignments without a sought window add chance windows to the brute force alone
    assert len(planted) > 20 and sum(p in got for p in planted) >= 0.9 * len(planted)


def test_templates(spark):
    t = "Hello the Tom has 3 kg, of 1.5apples;\n\n and Ann *** 7 Km x. ÉTÉ Été A 1,250.5."
    df = spark.range(1).select(decontam.tokens(F.lit(t)).alias("a"))
    got = df.selectExpr(f"{decontam._small('a')} AS w", f"{decontam._kinds('a')} AS k").first()
    assert list(zip(got["w"], got["k"], strict=True)) == plain_tokens(t)
    assert got["w"] == ["hello", "the", "tom", "has", "3", "kg", "of", "1.5apples", "and", "ann", "7", "km", "x", "été", "été", "a", "1,250.5"]
    assert got["k"] == [3, 0, 3, 0, 1, 2, 0, 1, 0, 3, 1, 2, 0, 0, 3, 0, 1]
    bare = decontam._windows(df, 1).orderBy("pos").collect()
    assert [b["bare0"] if b["bare0"] <= 3 else 0 for b in bare] == got["k"]


# -- all windows and places -------------------------------------------------------

WORDS = "brook lantern meadow copper willow harbor saddle timber violet engine parcel cotton hollow marble candle ribbon feather anchor pepper basket mirror bottle garden ladder needle button puddle kettle pillow hammer saucer thimble walnut turnip radish barrel cellar pebble copse bramble".split()


@pytest.mark.parametrize("few", [True, False])
def test_items_torn_apart_are_found(spark, monkeypatch, few):
    """A word put in after two thirds: every part is found where it stands."""
    if not few:
        monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    item = " ".join(WORDS)
    torn = " ".join([*WORDS[:27], "instead", *WORDS[27:]])
    title = " ".join(w.capitalize() if k % 5 < 2 else w for k, w in enumerate(WORDS))
    docs = spark.createDataFrame([(1, torn), (2, title), (3, "nothing of it here at all"), (4, "so " + item)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc"]: (r["n_windows"], r["n_found"], r["n_changed"]) for r in decontam.leaks(docs, bench).collect()}
    assert got == {1: (36, 32, 0), 2: (36, 36, 0), 4: (36, 36, 0)}


def test_items_of_few_words_are_found_with_other_values(spark):
    """Most windows hold no word, so that only the others can tell."""
    item = "add 1 2 3 4 5 6 7 8 9 10 11 to twelve apples quickly"
    docs = spark.createDataFrame([(1, "add 21 22 23 24 25 26 27 28 29 30 31 to twelve apples quickly")], "doc_id long, text string")
    got = decontam.leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert [(r["doc"], r["n_windows"], r["n_found"]) for r in got] == [(1, 12, 12)]


def test_segments_end_between_letters_and_signs(spark):
    a = merge_agenda.Agenda(open(tokenizer_path("piece_bpe_32k.model"), "rb").read())
    assert a.cut.findall("\u2581word,\u2581(two)12b") == ["\u2581word", ",", "\u2581(", "two", ")12", "b"]
    r = random.Random(3)
    texts = ["".join(r.choice("abé, .()12\u201d\u2019\u0939\u0948\n-_\u00b2ß中") for _ in range(r.randint(1, 60))) for _ in range(300)]
    assert [np.frombuffer(x, "<u4").tolist() for x in a.encode(texts)] == a.library.encode(texts)
