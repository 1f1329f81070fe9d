"""From raw documents to training tokens: five stages, each an operator of gaitline.llm.

Every stage gets the documents that the one before has kept, as a written table.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaitline.llm import jaccard, mixing, pieces, pii, queries, toxicity
from gaitline.llm.common import column, fresh, materialize


#: Documents in an Arrow batch: with thousands of long texts in each, as by default, a batch would take more than a task's share of memory.
BATCH_ROWS = 500
#: Words whose ids an encoding worker keeps: workers and heap have grown in the stages before, so that there is less room than in a job of its own.
CACHED_WORDS = 50_000


def small_batches(stage):
    """``stage`` in a session whose Arrow batches hold ``BATCH_ROWS`` documents; the setting stays for its lazy result."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
        return stage(spark, docs, sf_dir)

    return run_stage


@small_batches
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows of the stage's own input and keeps the documents that score under the cut. Odd rows as in ``toxicity.keep_clean``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.train(docs, labels))


@small_batches
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; documents without words all stay. Odd rows as in ``jaccard.keep_one``."""
    return jaccard.keep_one(docs)


@small_batches
def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every span of personal data replaced by its kind and ``n_chars``, if there is one, counted again (0 for a missing text)."""
    masked = pii.redact(docs)
    if "n_chars" not in docs.columns:
        return masked
    kind = docs.schema["n_chars"].dataType
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(kind))


@small_batches
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes, in training order. Odd rows as in ``mixing.mixed_rows``."""
    return mixing.mixed_rows(docs)


def in_written_order(docs: DataFrame) -> DataFrame:
    """``docs``, a written and reread table, and last its ``position`` (underscored where there is such a column): 0.. in the order of writing, which a scan of several files loses.

    Files stand by the number of the task and of the file that wrote them; their sizes are one row per file.
    """
    position, file, task, nth, at, size, start = fresh(docs, "position", "file", "file_task", "file_nth", "file_row", "file_rows", "file_start")
    name = F.col(f"{file}.file_name")
    rows = docs.select("*", F.col("_metadata").alias(file)).select(*map(column, docs.columns), F.regexp_extract(name, "^part-([0-9]+)", 1).cast("int").alias(task), F.regexp_extract(name, "-c([0-9]+)", 1).cast("int").alias(nth), F.col(f"{file}.row_index").alias(at))
    sizes = rows.groupBy(task, nth).agg(F.count(F.lit(1)).alias(size))
    before = F.sum(size).over(Window.orderBy(task, nth).rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select(task, nth, F.coalesce(before, F.lit(0)).alias(start))
    return rows.join(F.broadcast(starts), [task, nth]).select(*map(column, docs.columns), (F.col(start) + F.col(at)).alias(position))


@small_batches
def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every copy, with its ``position`` in the training order that the mix has written. Odd rows as in ``pieces.encode_documents``."""
    ordered = in_written_order(docs)
    position = ordered.columns[-1]
    return pieces.encode_documents(ordered, queries.piece_model(), with_ids=True, keep=(position,), cache_size=CACHED_WORDS).withColumnRenamed(position, "position")


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("personal_data", mask_personal_data), ("mixing", mix_sources), ("pieces", encode_pieces)]

#: SQL can't express the trained classifier, the bootstrapped patterns or the encoding.
ORACLE_SQL = None


def training_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that the last stage gives: doc_id, n_tokens, ids_sha256, decoded_sha256, ids and position."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query: counts and hashes of ``training_tokens``, in training order."""
    digests = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return training_tokens(spark, sf_dir).select(*digests, "position").orderBy("position").select(*digests)
