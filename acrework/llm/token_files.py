"""Token-id output: whole texts to ids, ids to patched frame-of-reference files, and back.

``write_token_files`` range-partitions documents by id, so that files follow ascending ids without a global sort, and
writes segments of about a million ids through Spark's file committer (a retried or lost task leaves no half file).
A segment row holds the ids of its documents in the coding of ``pfor``, the documents' ids and lengths, and how many
ids precede it in its partition.  Only one total for each partition is needed to know where every document starts.

Defined results: null text is an empty text (only the end id); an empty table writes no segment; rows that share a
doc_id stand next to each other, ordered by a hash of the text; a null doc_id sorts first; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrework.llm import pfor
from acrework.llm.common import documents, scratch_path, text_slices
from acrework.llm.library_bpe import with_end, worker_encoder

SEGMENT = "part int, seq long, ids_before long, n_ids long, doc_ids array<bigint>, lengths array<bigint>, payload binary"
RESULT = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
#: Ids in a segment, about two megabytes.
SEGMENT_IDS = 1_000_000


def _segments(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, block: int, percentile: float) -> Iterator[pa.RecordBatch]:
    encoder, schema = worker_encoder(tokenizer), _arrow_segment()
    part, seq, before = TaskContext.get().partitionId(), 0, 0
    ids, doc_ids, lengths, held = [], [], [], 0

    def flush():
        nonlocal seq, before, ids, doc_ids, lengths, held
        payload = pfor.encode(np.concatenate(ids), block, percentile)
        row = pa.RecordBatch.from_pylist(
            [{"part": part, "seq": seq, "ids_before": before, "n_ids": held, "doc_ids": doc_ids, "lengths": np.concatenate(lengths), "payload": payload}], schema
        )
        seq, before = seq + 1, before + held
        ids, doc_ids, lengths, held = [], [], [], 0
        return row

    for batch in text_slices(batches, "text"):
        found, count = with_end(*encoder.encode(batch.column("text")), end_id)
        ids.append(found)
        doc_ids += batch.column("doc_id").to_pylist()
        lengths.append(count)
        held += len(found)
        if held >= SEGMENT_IDS:
            yield flush()
    if doc_ids:
        yield flush()


def _arrow_segment() -> pa.Schema:
    return pa.schema(
        [("part", pa.int32()), ("seq", pa.int64()), ("ids_before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())]
    )


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block: int = 256, percentile: float = 95.0) -> None:
    """Write the ids of every whole text to ``path`` in ascending doc_id order, one end id after each document."""
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    rows = ordered.mapInArrow(lambda it: _segments(it, tokenizer, end_id, block, percentile), SEGMENT)
    rows.write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Each document's start over all files, its number of ids, and their crc32, decoded from the files."""
    files = spark.read.schema(SEGMENT).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each written partition
    base = totals.select("part", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    # at most one row for each range partition that was written (spark.sql.shuffle.partitions), so small at any input
    placed = files.join(F.broadcast(base), "part").select((F.col("base") + F.col("ids_before")).alias("start"), "doc_ids", "lengths", "payload")
    return placed.mapInArrow(_documents, RESULT)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            raw = pfor.decode(batch.column("payload")[i].as_py()).astype("<u4").tobytes()
            lengths = batch.column("lengths")[i].values.to_numpy()
            ends = np.cumsum(lengths)
            starts = ends - lengths
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
            yield pa.record_batch(
                [batch.column("doc_ids")[i].values, pa.array(starts + batch.column("start")[i].as_py()), pa.array(lengths), pa.array(crc, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all ``documents``, write the files and read every document back from them."""
    import public_tokenizers

    path = scratch_path(spark, "token-files")
    write_token_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_files(spark, path)
