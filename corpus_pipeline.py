"""Corpus pipeline over ``documents``: five stages, each working on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.functions.storage import written_alone
from acrework.llm.common import materialise
from acrework.llm.language_id import UNKNOWN, predict_languages, train
from acrework.llm.near_dedup import near_duplicate_components
from acrework.llm.packing import pack_documents
from acrework.llm.secrets import redact_secrets
from acrework.llm.suffix_dedup import identified, remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Calibrated probability of the predicted language below which a document goes.
LEAST_SCORE = 0.5
MARK = "[redacted]"
#: Shingle similarity in percent from which two documents are near duplicates.
NEAR_PERCENT = 80

#: Rows that Spark hands to a Python worker at once; documents are large, and workers of several stages share a machine.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "1000"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Fewer rows at once for what runs inside; the session's setting is then as before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def written_stage(stage: Callable) -> Callable:
    """A stage whose result is written while batches are small, and read back; tables that led to it are deleted."""

    @wraps(stage)
    def run_and_write(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with small_batches(spark):
            return written_alone(lambda: stage(spark, docs, sf_dir), spark, stage.__name__.replace("_", "-"))

    return run_and_write


@written_stage
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language stays uncertain, go."""
    scored = predict_languages(docs, train(docs), keep=COLUMNS)
    return scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component stays, that of the least id (null last); ids may be null or shared."""
    rows = identified(docs, tuple(c for c in COLUMNS if c != "text"), nulls_last=True)
    with small_batches(spark):
        found = near_duplicate_components(rows.select(F.col("uid").alias("doc_id"), "text"), NEAR_PERCENT)
    kept = found.filter("kept").select(F.col("doc_id").alias("uid"))
    return rows.join(kept, "uid", "left_semi").select(*COLUMNS)


@written_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of 100 bytes and more are cut out; a document of which nothing is left goes."""
    cut = remove_repeats(docs, keep=("doc_id", "lang", "source"), as_text=True)
    left = cut.filter((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    return left.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mark; all documents stay."""
    return redact_secrets(docs.select(*COLUMNS), MARK).withColumn("n_chars", F.length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into training sequences."""
    import public_tokenizers

    with small_batches(spark):
        return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("MinHash near-dedup", near_dedup_stage),
    ("suffix-array dedup", repeats_stage),
    ("secret scans", secrets_stage),
    ("packing", packing_stage),
]

#: The stages include trained models and tokenisers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; what a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        if stage in (near_dedup_stage, secrets_stage):  # the others write their results themselves
            docs = materialise(docs, name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
