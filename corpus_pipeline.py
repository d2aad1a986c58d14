"""From raw documents to tokens: quality, repeated lines, near-duplicates, benchmark passages, tokens.

Every stage works on all that the one before kept. A stage takes (spark, docs, sf_dir),
docs having the columns of `documents`, and returns them again with what it decided done:
rejected documents and all but the smallest id of a group of near-duplicates are gone;
dropped lines and benchmark passages are cut out of the text, and n_chars follows. The
last stage returns tokens instead.

Rows with a null id or text go through every stage that has nothing against them. Rows
that repeat an id are one document, which stays or goes as a whole. Further columns of
the input are kept.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearthstat.llm import bpe, decontam, lines, minhash, quality
from hearthstat.llm.staging import small, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Bytes of a batch that Spark sends to Python. Executor and Python hold a batch several times over.
BATCH_BYTES = 4 << 20

CORE = ("doc_id", "text", "lang", "source", "n_chars")


def _bound_batches(spark: SparkSession) -> None:
    """Batches of few bytes from here on, however long texts are; they are lazily run, so this is not undone."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def _keeping_columns(step: Stage) -> Stage:
    """The stage, with further columns out of the way of the operators' own and back in place after it."""

    @wraps(step)
    def kept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _bound_batches(spark)
        names = docs.columns
        hidden = [c if c in CORE else f"_further{i}" for i, c in enumerate(names)]
        return step(spark, docs.toDF(*hidden), sf_dir).select(*hidden).toDF(*names)

    return kept


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


@_keeping_columns
def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity under the model of trusted text is usual for their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = quality.classify(docs, labels.where("quality = 1"))
    return judged.where("keep")


@_keeping_columns
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the lines that ten or more documents hold."""
    return _recounted(lines.dedup_lines(docs, min_docs=10))


@_keeping_columns
def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    groups = minhash.near_duplicates(docs, percent=80)
    copies = stage(groups.where("not kept and doc_id is not null").select("doc_id"))
    return docs.join(small(copies), "doc_id", "left_anti")


@_keeping_columns
def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the passages that the benchmark has too."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _recounted(decontam.scan(docs, benchmark, cut=True))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, with digests of them and of the bytes that they decode to."""
    _bound_batches(spark)
    coded = bpe.encode(docs.select("doc_id", "text"), *bpe.multi_ranks(), decoded=True)
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_duplicates", drop_copies),
    ("benchmark", cut_benchmark),
    ("tokens", tokenize),
]

#: The quality model and the similarity join are not for SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES:
        docs = stage(step(spark, docs, sf_dir))
    return docs
