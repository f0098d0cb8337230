"""The pipeline and the registered queries on a small table, against plain Python."""

import random

import pyarrow as pa
import pytest

from pyspark.sql import functions as F

import corpus_pipeline
from tessera import session
from tessera.llm import queries, zstd_quality
from tests.llm.test_operators import closure, plain_line_dedup, plain_simhash, sentence


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(9)
    bench = [(k, sentence(r, 20)) for k in range(4)]
    shared = "A notice that many documents of this table carry."
    rows = []
    for k in range(120):
        t = "\n".join([sentence(r, 30) for _ in range(3)] + ([shared] if k % 4 == 0 else []))
        if k % 10 == 3:
            t += "\n" + bench[k % 4][1] + "."
        if k % 6 == 5:
            t = " ".join(w.upper() + "!! $$$" for w in t.split())
        rows.append((k, t, "en", f"s{k % 3}", len(t)))
    rows += [(200 + k, rows[k][1], "en", "s", rows[k][4]) for k in range(10)] + [(300, None, "en", "s", 0), (301, "", "en", "s", 0)]
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 6 != 5), 0) for k in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    pages = [(k, f"http://h{k % 2}/p{k}", None if k == 5 else f"<article><p>page {k}</p></article>") for k in range(6)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    vectors = [(k, [r.random() for _ in range(16)], k % 3) for k in range(70)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    return d, rows, bench


def test_pipeline_equals_plain_python(spark, folder):
    d, rows, bench = folder
    model = zstd_quality.learn(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    score = model.scorer().scores([(t or "").encode() for _, t, *_ in rows])
    kept = [(k, t) for (k, t, *_), s in zip(rows, score, strict=True) if s >= 0.3]
    lines = {k: v[2] for k, v in plain_line_dedup(kept).items()}
    ids = sorted(lines)
    fp = [plain_simhash(lines[k]) for k in ids]
    root = closure(len(ids), [(i, j) for i in range(len(ids)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 4])
    firsts = [k for i, k in enumerate(ids) if root[i] == i]

    def leaked(t):
        w = t.lower().replace(".", "").split()
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for _, b in bench:
            v = b.split()
            own = [tuple(v[i : i + 5]) for i in range(len(v) - 4)]
            if sum(g in grams for g in own) >= 0.8 * len(own):
                return True
        return False

    want = {k for k in firsts if not leaked(lines[k])}
    got = {r["doc_id"]: r["n_chars"] for r in corpus_pipeline.run(spark, d).collect()}
    assert got == {k: len(lines[k]) for k in want}
    assert 0 < len(want) < len(firsts) < len(ids) < len(rows)


def test_workers_get_texts_in_small_batches(spark, folder):
    """All but a text that is longer itself; a session's own limit stays."""
    d, *_ = folder

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    plain, own = spark.newSession(), spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    for s in (plain, own):
        corpus_pipeline.tokens(s, s.read.parquet(f"{d}/documents.parquet"), d)
    texts = plain.range(0, 5000, 1, 1).select(F.expr("repeat('word ', if(id = 2500, 1000000, 400))").alias("text"))
    got = texts.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 5000 and sum(r["size"] for r in got) >= 4999 * 2000 + 5_000_000
    *others, longest = sorted(r["size"] for r in got)
    assert max(others, default=0) <= 2 * session.BATCH_BYTES and longest <= 5_000_000 + 2 * session.BATCH_BYTES
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "8m"


def test_stages_keep_columns_and_tell_repeats_apart(spark, folder):
    d, rows, _ = folder
    docs = spark.read.parquet(f"{d}/documents.parquet")
    odd = docs.withColumn("score", F.lit("mine")).withColumn("Predicted", F.col("doc_id")).withColumn("component_id", F.lit(5)).withColumn("n_lines", F.lit(None).cast("int"))
    own = ("y", "t", "_id", "_o", "_key", "id", "ident", "_ident", "gone", "of", "mark", "first", "doc", "item")
    odd = odd.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in own})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, d)
        assert out.columns == odd.columns
        assert all(r[c] == f"{c}{r['doc_id']}" for r in out.collect() for c in own)
        held = out.select("doc_id", "score", "Predicted", "component_id", "n_lines").collect()
        assert held and all(r["score"] == "mine" and r["Predicted"] == r["doc_id"] and r["component_id"] == 5 and r["n_lines"] is None for r in held)
        assert stage(spark, odd.limit(0), d).count() == 0
    # id 1 comes twice: one text is a copy of document 0, the other is like nothing else
    r = random.Random(3)
    copy, alone = sentence(r, 200), sentence(r, 210)
    twice = spark.createDataFrame([(0, copy), (1, copy), (1, alone), (2, None), (2, None), (3, ""), (None, copy)], "doc_id long, text string")
    kept = [(x["doc_id"], x["text"]) for x in corpus_pipeline.near_copies(spark, twice, d).collect()]
    assert sorted(kept, key=str) == sorted([(0, copy), (1, alone), (2, None), (2, None)], key=str)


def test_registered_queries(spark, folder):
    d, rows, _ = folder
    ops = queries.queries()
    assert len(ops) == 13
    for name, f in ops.items():
        pages = name.split("_")[0] in ("op6", "op9")
        if name != "op10_template_leaks":
            assert f(spark, d).count() == (6 if pages else 600 if name == "op12_filter_audit" else 70 if name == "op13_partial_codes" else len(rows)), name
        else:
            found = {x["doc_id"] for x in f(spark, d).collect()}
            assert {k for k, t, *_ in rows if k % 10 == 3 and k < 120 and "$$$" not in t} <= found
