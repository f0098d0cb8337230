"""From raw documents to token sequences, in five stages.

Quality classifier, line dedup, SimHash near-dedup, benchmark decontamination,
SentencePiece encoding. Each stage gets what its predecessor kept, written as
Parquet and read again; all but the last return the columns of ``documents``,
with n_chars as the text then is.

Every stage: a null text counts as the empty one; rows that repeat an id are
one document that stays or goes as a whole, unless they differ in what the
stage looks at; an empty table gives an empty table; columns that have the name
of one of an operator's own are handed on as they were.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, line_dedup, merge_agenda, simhash, zstd_quality
from tessera.llm.queries import tokenizer_path
from tessera.llm.text import fresh
from tessera.session import staged, table


def _hidden(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The rows and text that ``operator`` leaves of ``docs``, whose columns
    beside doc_id and text it sees under names that it can't replace."""
    beside = [c for c in docs.columns if c not in ("doc_id", "text")]
    names = dict(zip(beside, fresh(docs, [f"column{k}" for k in range(len(beside))]), strict=True))
    out = operator(docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(names[c]) for c in beside]))
    return out.select(*[F.col(names.get(c, c)).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts to be good stay; each row is scored by its own text."""
    model = zstd_quality.learn(docs, table(spark, sf_dir, "labels"))
    return _hidden(docs, lambda d: zstd_quality.score_quality(d, model).where(F.col("predicted") == 1))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of at least 20 characters that three or more documents hold stay in one of them only; a null text becomes the empty one."""
    kept = line_dedup.line_dedup(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays. Rows that repeat
    an id are told apart by their texts: one in another group stays only if its id is the smallest there."""
    mark, first = fresh(docs, ["mark", "first"])
    groups = simhash.near_duplicates(docs.select("doc_id", "text"))
    firsts = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(first), F.col("ident").alias(mark)).distinct()
    here = docs["doc_id"].eqNullSafe(firsts[first]) & (simhash.ident(docs["text"]) == firsts[mark])
    return docs.join(firsts, here, "left_semi")


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of such an id."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    coded = merge_agenda.encode_decode(docs, tokenizer_path("piece_bpe_32k.model"))
    return coded.select("doc_id", "lang", "source", "n_chars", "pieces", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmarks),
    ("SentencePiece", tokens),
]

#: SQL can't express the stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
