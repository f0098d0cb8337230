"""Quality classification by compression.

Two zstandard dictionaries are built, one from text labelled good and one from
text labelled bad. A text is compressed piece by piece under both: the
difference of the two sizes, divided by the text's size, says which of them it
is more like. A logistic calibration, fitted on labelled texts that the
dictionaries have not seen, turns that difference into a probability; it looks
at the text's length too, as the difference of a short text says less.

Learning takes a bounded sample of the labelled rows, as the parameters say.
Their whole texts calibrate, as scoring compresses every whole text; only a
dictionary takes no more of a text than a few pieces, spread over all of it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import fresh, slices
from tessera.session import ship, staged

#: Labelled rows of each class, at most, that learning reads; half of them build the dictionary, half calibrate.
SAMPLE_ROWS = 3_000
#: Labelled rows of each class without which nothing is learned.
LEAST_ROWS = 16
#: Pieces, at most, that a dictionary takes of each of these rows, at equal distances over the whole text.
PIECES = 8
DICTIONARY_BYTES = 65_536
LEVEL = 3
#: Bytes that are compressed at a time: each piece starts anew from the dictionary.
PIECE = 1_024


@dataclass(frozen=True)
class QualityModel:
    """Dictionaries and calibration; picklable."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    prior: float

    def scorer(self) -> Scorer:
        return Scorer(self)


def _features(sizes: np.ndarray) -> np.ndarray:
    """From columns raw bytes, bytes under good, bytes under bad."""
    raw = sizes[:, 0] + 1
    diff, long = np.clip((sizes[:, 2] - sizes[:, 1]) / raw, -0.5, 0.5), np.log(raw)
    return np.stack([diff, long, diff * long], axis=1)


class Scorer:
    def __init__(self, model: QualityModel):
        import zstandard

        self.model, self.pack = model, []
        for raw in (model.good, model.bad):
            if raw:
                d = zstandard.ZstdCompressionDict(raw)
                d.precompute_compress(level=LEVEL)
                self.pack.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False).compress)

    def sizes(self, text: bytes) -> tuple[int, int, int]:
        good = bad = 0
        for at in range(0, len(text), PIECE):
            p = text[at : at + PIECE]
            good += len(self.pack[0](p))
            bad += len(self.pack[1](p))
        return len(text), good, bad

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities that the label is 1."""
        m = self.model
        if len(self.pack) < 2:
            return np.full(len(texts), m.prior)
        x = (_features(np.array([self.sizes(t) for t in texts], float).reshape(-1, 3)) - m.mean) / m.scale
        return 1 / (1 + np.exp(-np.clip(x @ m.weights[1:] + m.weights[0], -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton steps for a ridge-penalised logistic regression; the intercept comes first and is free."""
    x = np.column_stack([np.ones(len(x)), x])
    w, pen = np.zeros(x.shape[1]), np.diag([0.0, *[ridge * len(x) / 100] * (x.shape[1] - 1)]) + 1e-9 * np.eye(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + pen, x.T @ (y - p) - pen @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def spread(text: bytes) -> list[bytes]:
    """At most PIECES pieces of the text, the first one among them."""
    starts = range(0, len(text), PIECE)
    return [text[a : a + PIECE] for a in starts[:: -(-len(starts) // PIECES) or 1]]


def dictionaries(good: list[bytes], bad: list[bytes], prior: float) -> QualityModel:
    """A model without calibration from pieces of either class. Without enough
    text for a dictionary it knows no more than ``prior``."""
    import zstandard

    try:
        made = [zstandard.train_dictionary(DICTIONARY_BYTES, pieces).as_bytes() for pieces in (good, bad)]
    except zstandard.ZstdError:
        made = [b"", b""]
    return QualityModel(*made, (), (), (), prior)


def calibrated(bare: QualityModel, sizes: np.ndarray, y: np.ndarray) -> QualityModel:
    """``bare`` with the weights that fit the labels ``y`` of texts with these
    sizes; of one class alone nothing can be learned."""
    if not bare.good or min(y.sum(), len(y) - y.sum()) < 1:
        return QualityModel(b"", b"", (), (), (), bare.prior)
    x = _features(sizes)
    mean, scale = x.mean(0), x.std(0) + 1e-9
    w = _logistic((x - mean) / scale, y)
    # the sample takes as many rows of either class; the prior of the labels comes back in the intercept
    w[0] += np.log(bare.prior / (1 - bare.prior)) - np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
    return QualityModel(bare.good, bare.bad, tuple(mean), tuple(scale), tuple(w), bare.prior)


def fit(good: list[bytes], bad: list[bytes], prior: float | None = None) -> QualityModel:
    """A model of texts with label 1 and label 0, as ``learn`` makes it.

    Every second text of each list builds the dictionaries, the others
    calibrate. With fewer than LEAST_ROWS texts of a class the model knows no
    more than ``prior``, the share of good texts (0.5 if there are none at all).
    """
    prior = (len(good) + 1) / (len(good) + len(bad) + 2) if prior is None else prior
    if min(len(good), len(bad)) < LEAST_ROWS:
        return QualityModel(b"", b"", (), (), (), prior)
    bare = dictionaries(*([p for t in texts[::2] for p in spread(t)] for texts in (good, bad)), prior)
    if not bare.good:
        return bare
    scorer = bare.scorer()
    return calibrated(bare, np.array([scorer.sizes(t) for t in good[1::2] + bad[1::2]], float), np.array([1.0] * len(good[1::2]) + [0.0] * len(bad[1::2])))


def held_out(id_col: str) -> Column:
    """Rows that learning never sees: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = SAMPLE_ROWS) -> QualityModel:
    """Fit on at most ``rows`` labelled, not held out rows of each class: those
    with the smallest hash of their id, so that the sample does not depend on
    partitions.

    Their whole texts are written to the shared folder once; the driver gets
    pieces of one half and three sizes a row of the other. Defined results: an
    id with several labels has the largest; one with several texts the largest
    of them; a null text is the empty one; null ids and labels are passed over.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    known = known.where(~held_out("id") & F.col("y").isin(0, 1)).groupBy("id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    n1, n0 = share.get(1, 0), share.get(0, 0)
    prior = (n1 + 1) / (n1 + n0 + 2)
    if min(n1, n0) < LEAST_ROWS:
        return QualityModel(b"", b"", (), (), (), prior)
    picked = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).select(F.col("id").alias("_id"), "y", F.xxhash64("id").alias("_o")).orderBy("_o", "_id").limit(rows)
        picked = part if picked is None else picked.unionByName(part)
    # 2 * rows ids at most: a fixed bound
    plain = docs.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    text = plain.join(F.broadcast(picked), F.col("_key") == F.col("_id")).drop("_key")
    sample = staged(text.groupBy("_id", "y", "_o").agg(F.max("t").alias("t")), "quality-sample")
    order = sorted((r["_o"], r["_id"], r["y"]) for r in sample.select("_id", "y", "_o").collect())
    second = {i for y in (0, 1) for i in [k for _, k, c in order if c == y][1::2]}

    def reader(model: QualityModel | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scorer = None if model is None else model.scorer()
            for b in slices(batches):
                at = [k for k, i in enumerate(b.column(0).to_pylist()) if (i in second) == (scorer is not None)]
                texts = b.column(3).take(pa.array(at, pa.int64())).cast(pa.binary()).to_pylist()
                got = pa.array([spread(t) for t in texts], pa.list_(pa.binary())) if scorer is None else pa.array([scorer.sizes(t) for t in texts], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in (0, 1, 2)), got], names=["_id", "y", "_o", "got"])

        return run

    def read(model: QualityModel | None, kind: str) -> list[list]:
        schema = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in ("_id", "y", "_o"))
        rows = sample.mapInArrow(reader(model), f"{schema}, got array<{kind}>").collect()  # bounded by rows and PIECES
        return [[(r["y"], r["got"]) for r in sorted(rows, key=lambda r: (r["_o"], r["_id"])) if r["y"] == y] for y in (1, 0)]

    good, bad = read(None, "binary")
    if min(len(good), len(bad)) < LEAST_ROWS // 2:
        return QualityModel(b"", b"", (), (), (), prior)
    bare = dictionaries(*([bytes(p) for _, pieces in rows for p in pieces] for rows in (good, bad)), prior)
    if not bare.good:
        return bare
    both = [r for rows in read(bare, "bigint") for r in rows]
    return calibrated(bare, np.array([s for _, s in both], float).reshape(-1, 3), np.array([float(y) for y, _ in both]))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Only ``text_col`` is an input of the score. Defined results: a null text
    scores as the empty one; texts are compressed whole; rows are scored one by
    one, so repeats get equal scores; an empty table gives an empty table. A
    column of ``docs`` with one of the new names is replaced.
    """
    ship(docs.sparkSession)
    base = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted") and c != text_col])
    source = fresh(base, ["text_in"])[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = model.scorer()
        for b in slices(batches):
            texts = [t or b"" for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scorer.scores(texts), pa.float64())], names=out_names)

    from pyspark.sql.types import DoubleType, StructField, StructType

    schema = StructType([*base.schema.fields, StructField("score", DoubleType())])
    out_names = schema.names
    scored = base.withColumn(source, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
