"""Exact removal of repeated byte passages by a depth-limited radix sort of suffixes.

Suffixes count only through the threshold (100 bytes).  They are dealt into groups by one digit after the other, each
digit a string of their bytes; a group of one leaves the sort at once, and the groups that are equal through the
threshold are exactly the repeated windows.  The order of different groups is never needed, so each pass groups by the
digits instead of ordering them.  So that a pass need not move every suffix, neighbouring suffixes travel together:

1. *First digit*: the 48 bytes that stand at the place of the least hash in a window (its anchor).  Windows that share an
   anchor are one row (a run), and equal windows have equal anchors.  Runs are counted by a hash of this digit, and a
   run whose hash is unique leaves.
2. Of the runs that are left, those equal in all their bytes (by their SHA-256) are repeats but for the first.
3. *Following digits*: where a first digit still has different runs, the bytes of the first of each go out, cut into
   stretches of ``WIDTHS`` windows (at equal distances from the anchor).  The digit is now what all windows of the stretch
   share: 91 bytes, and then, for single windows, all 100.  In each pass rows whose digit is unique leave, and of rows
   with equal bytes all but the first are repeats.

Hashes of digits only let rows leave, and only where no other row has the same; collisions cost work and change nothing.

Repeats inside one document are found while its text is at hand.  Counts are combined before they are shuffled and
joined back to the rows, so that a passage in a third of all documents is split by the adaptive skew join.

Defined results: null and short texts lose nothing; rows that share a doc_id (or have none, which comes first) stand in
an order fixed by a hash of their text, and of equal rows all but one count as later; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from acrework.functions.storage import delete_written, written
from acrework.llm.common import documents, materialise, same_bytes, text_slices, utf8
from acrework.llm.rolling import Prefix, sliding_min

THRESHOLD = 100
DIGIT = 48
#: Windows in a stretch of each later pass; the last must be single windows.
WIDTHS = (9, 1)
#: Bytes of text at once, so that the arrays stay in a core's cache.
SLICE = 250_000
#: Low bits of a hash that give way to its place, so that of equal hashes the leftmost is least; the same at any length.
PLACE_BITS = 20


class Runs:
    """Runs of windows with one anchor, over concatenated texts.

    ``digit_bits`` keeps that many leading bits of the hashes; fewer make different digits collide, which costs work but
    changes no result.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, threshold: int = THRESHOLD, digit: int = DIGIT, digit_bits: int = 64):
        self.threshold, self.data, self.prefix = threshold, data, Prefix(data)
        windows = np.maximum(np.diff(offsets) - threshold + 1, 0)
        total = int(windows.sum())
        self.doc = self.start = self.size = self.left = np.zeros(0, np.int64)
        self.digit = np.zeros(0, np.uint64)
        if not total:
            return
        has = np.flatnonzero(windows)
        before = np.cumsum(windows[has]) - windows[has]
        hashes = self.prefix.windows(digit) >> np.uint64(64 - digit_bits) << np.uint64(64 - digit_bits)
        at = np.arange(total) + np.repeat(offsets[:-1][has] - before, windows[has])
        anchor = _anchors(hashes, threshold - digit + 1)[at]
        head = np.ones(total, bool)
        head[1:] = anchor[1:] != anchor[:-1]
        head[before] = True
        first = np.flatnonzero(head)
        self.size = np.diff(first, append=total)
        self.start, self.digit = at[first], hashes[anchor[first]]
        self.left = anchor[first] - self.start
        self.doc = np.repeat(has, np.diff(np.searchsorted(first, np.append(before, total))))

    def _alike(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs in an order that puts equal digits of a document side by side, and which equal the one before."""
        order = np.argsort(self.digit, kind="stable")
        same = (self.digit[order][1:] == self.digit[order][:-1]) & (self.doc[order][1:] == self.doc[order][:-1])
        return order, np.append(False, same) if len(order) else np.zeros(0, bool)

    def digits(self) -> np.ndarray:
        """The digits of each document, each once."""
        order, same = self._alike()
        return self.digit[order[~same]]

    def different(self) -> np.ndarray:
        """Ascending runs without those that equal an earlier one of their document byte for byte."""
        order, same = self._alike()
        shared = same.copy()
        shared[:-1] |= same[1:]
        some = np.sort(order[shared])
        keep = np.ones(len(order), bool)
        if len(some):
            length = self.size[some] + self.threshold - 1
            keep[some[self._later(self.start[some], length, self.doc[some])]] = False
        return np.flatnonzero(keep)

    def _later(self, start: np.ndarray, length: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Which ranges of bytes equal an earlier one of their document; hashes propose and bytes decide."""
        value = self.prefix.ranges(start, start + length)
        order = np.argsort(value, kind="stable")
        head = np.append(True, (value[order][1:] != value[order][:-1]) | (doc[order][1:] != doc[order][:-1]))
        group = np.cumsum(head) - 1
        first = order[np.flatnonzero(head)][group]
        rest = np.flatnonzero(~head)
        a, b = order[rest], first[rest]
        equal = length[a] == length[b]
        equal[equal] = same_bytes(self.data, start[a[equal]], self.data, start[b[equal]], length[a[equal]])
        later = np.zeros(len(start), bool)
        later[a] = True
        if not equal.all():  # different ranges with one hash
            for g in np.unique(group[rest[~equal]]).tolist():
                seen = set()
                for i in np.sort(order[np.searchsorted(group, g) : np.searchsorted(group, g, "right")]).tolist():
                    found = self.data[start[i] : start[i] + length[i]].tobytes()
                    later[i] = found in seen
                    seen.add(found)
        return later

    def repeated_inside(self) -> np.ndarray:
        """Starts of windows that also start earlier in their own document."""
        order, same = self._alike()
        same[:-1] |= same[1:]
        chosen = np.sort(order[same])
        size = self.size[chosen]
        run = np.repeat(chosen, size)
        starts = np.arange(len(run)) + np.repeat(self.start[chosen] - (np.cumsum(size) - size), size)
        return starts[self._later(starts, np.full(len(starts), self.threshold), self.doc[run])] if len(starts) else starts


def _anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each ``width`` neighbouring hashes the place of the least, of equal ones the leftmost."""
    low, step, out = np.uint64((1 << PLACE_BITS) - 1), (1 << PLACE_BITS) - width, []
    for begin in range(0, max(1, len(hashes) - width + 1), step):
        some = hashes[begin : begin + step + width - 1]
        least = sliding_min(some & ~low | np.arange(len(some), dtype=np.uint64), width)
        out.append((least & low).astype(np.int64) + begin)
    return np.concatenate(out)


def _digit_rows(batches: Iterator[pa.RecordBatch], threshold: int, digit_bits: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """The first digits of each document, each once."""
    for batch in text_slices(batches, "text", at_once):
        runs = Runs(*utf8(batch.column("text")), threshold, digit_bits=digit_bits)
        yield pa.record_batch([pa.array(runs.digits().view(np.int64))], ["digit"])


def _run_rows(batches: Iterator[pa.RecordBatch], threshold: int, digit_bits: int, at_once: int) -> Iterator[pa.RecordBatch]:
    """Runs, one row for equal runs of a document: start in the text, number of windows, bytes before the anchor."""
    for batch in text_slices(batches, "text", at_once):
        data, offsets = utf8(batch.column("text"))
        runs = Runs(data, offsets, threshold, digit_bits=digit_bits)
        uid = batch.column("uid").to_numpy(zero_copy_only=False)
        at = runs.different()
        doc = runs.doc[at]
        yield pa.record_batch(
            [pa.array(runs.digit[at].view(np.int64)), pa.array(uid[doc]), pa.array((runs.start[at] - offsets[:-1][doc]).astype(np.int32)), pa.array(runs.size[at].astype(np.int16)), pa.array(runs.left[at].astype(np.int16))],
            ["digit", "uid", "start", "size", "left"],
        )


def _listed(batches: Iterator[pa.RecordBatch], threshold: int, digest: bool) -> Iterator[pa.RecordBatch]:
    """The runs listed beside each text, with the bytes of all their windows or the SHA-256 of these bytes."""
    for batch in text_slices(batches, "text", 1_000_000):
        data, offsets = utf8(batch.column("text"))
        lists = batch.column("runs")
        owner = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        flat, raw = lists.flatten(), data.tobytes()
        begin = flat.field("start").to_numpy() + offsets[:-1][owner]
        end = begin + flat.field("size").to_numpy() + threshold - 1
        uid = batch.column("uid").take(pa.array(owner))
        for a in range(0, len(owner), 20_000):
            some = slice(a, a + 20_000)
            found = [raw[i:j] for i, j in zip(begin[some].tolist(), end[some].tolist())]
            if digest:
                found = [hashlib.sha256(f).digest() for f in found]
            cut = [flat.field(c).slice(a, 20_000) for c in ("digit", "start", "size", "left")]
            yield pa.record_batch([uid.slice(a, 20_000), *cut, pa.array(found, pa.binary())], ["uid", "digit", "start", "size", "left", "data"])


def _cover(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(np.bincount(starts, minlength=n + 1) - np.bincount(ends, minlength=n + 1))[:-1] > 0


def _remove(batches: Iterator[pa.RecordBatch], threshold: int, as_text: bool, digit_bits: int, at_once: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", at_once):
        data, offsets = utf8(batch.column("text"))
        inside = Runs(data, offsets, threshold, digit_bits=digit_bits).repeated_inside()
        lists = batch.column("spans").to_pylist()
        starts, ends = [inside], [inside + threshold]
        for i, spans in enumerate(lists):
            if spans:
                pairs = np.asarray([(s["start"], s["size"]) for s in spans], np.int64)
                starts.append(pairs[:, 0] + offsets[i])
                ends.append(pairs[:, 0] + pairs[:, 1] - 1 + threshold + offsets[i])
        gone = _cover(np.concatenate(starts), np.concatenate(ends), len(data))
        edge = np.zeros(len(data), bool)
        if len(data):
            edge[0], edge[1:] = gone[0], gone[1:] & ~gone[:-1]
            first = offsets[:-1][np.diff(offsets) > 0]
            edge[first] = gone[first]
        n_gone, n_edge = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(edge))
        kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(offsets.tolist(), offsets[1:].tolist())]
        result = [pa.array(np.diff(offsets)), pa.array(np.diff(n_gone[offsets])), pa.array(np.diff(n_edge[offsets]))]
        result.append(pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary()))
        carried = [c for c in batch.schema.names if c not in ("text", "spans")]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carried), *result], [*carried, "n_bytes", "n_removed", "n_spans", "kept_bytes"])


def identified(docs: DataFrame, keep: tuple[str, ...], nulls_last: bool = False) -> DataFrame:
    """The kept columns, text and a unique uid in the order of the contract: doc_id where it is unique and never null."""
    docs = docs.select(*(docs[c] for c in keep), docs["text"].cast("string").alias("text"), docs["doc_id"].cast("long").alias("uid"))
    repeated = docs.groupBy("uid").count().filter((F.col("count") > 1) | F.col("uid").isNull()).limit(1).count()
    if not repeated:
        return docs
    order = (F.col("uid").asc_nulls_last() if nulls_last else F.col("uid").asc(), F.xxhash64("text"))
    ordered = docs.repartitionByRange(*order).sortWithinPartitions(*order)
    place = ordered.columns.index("uid")

    def number(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            uid = pa.array((np.int64(part) << 40) + n + np.arange(batch.num_rows))
            n += batch.num_rows
            yield batch.set_column(place, "uid", uid)

    return materialise(ordered.mapInArrow(number, ordered.schema), "numbered")


PLACE = "uid bigint, digit bigint, start int, size smallint, left smallint"


def _settled(rows: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The rows, ``later`` where a document with a smaller uid has a row with equal data (null then)."""
    rows = rows.withColumn("hash", F.xxhash64("data"))
    firsts = rows.groupBy("hash", "data").agg(F.min("uid").alias("first"))  # equal in bytes; the hash only speeds up
    placed = rows.join(firsts, ["hash", "data"]).withColumn("later", F.col("uid") > F.col("first"))
    return written(placed.withColumn("data", F.when(~F.col("later"), F.col("data"))).drop("hash", "first"), name, "zstd")


def _shared(rows: DataFrame) -> DataFrame:
    """Rows whose digit other rows have too."""
    return rows.join(rows.groupBy("digit").count().filter("count > 1").select("digit"), "digit")


def _bytes_of(texts: DataFrame, runs: DataFrame, threshold: int, digest: bool, name: str) -> tuple[DataFrame, str]:
    """The runs with their bytes, fetched from the texts of their documents."""
    own = runs.groupBy("uid").agg(F.collect_list(F.struct("digit", "start", "size", "left")).alias("runs"))  # a document's own runs
    return written(texts.join(own, "uid").mapInArrow(lambda it: _listed(it, threshold, digest), f"{PLACE}, data binary"), name, "zstd")


def _stretches(runs: DataFrame, width: int, threshold: int) -> DataFrame:
    """Rows cut at every ``width`` distances from the anchor; the digit is what all windows of a stretch share."""
    most = threshold - DIGIT
    cut = runs.withColumn("stretch", F.explode(F.expr(f"sequence((`left` - size + 1) div {width}, `left` div {width})")))
    cut = cut.withColumns({"low": F.col("stretch") * width, "high": F.least(F.col("stretch") * width + width - 1, F.lit(most))})
    cut = cut.withColumns({"top": F.least("left", "high"), "bottom": F.greatest(F.col("left") - F.col("size") + 1, "low")})
    return cut.select(
        "uid",
        (F.col("start") + F.col("left") - F.col("top")).cast("int").alias("start"),
        (F.col("top") - F.col("bottom") + 1).cast("smallint").alias("size"),
        F.col("top").cast("smallint").alias("left"),
        F.expr(f"substring(data, `left` - top + 1, top - bottom + {threshold})").alias("data"),
        F.xxhash64("stretch", F.expr(f"substring(data, `left` - low + 1, {threshold} - high + low)")).alias("digit"),
    )


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, keep: tuple[str, ...] = ("doc_id",), as_text: bool = False, digit_bits: int = 64, at_once: int = SLICE) -> DataFrame:
    """Remove each byte covered by a passage of ``threshold`` bytes that also starts earlier in the corpus.

    Returns the ``keep`` columns, n_bytes, n_removed, n_spans and kept_bytes (the remaining bytes, which need not be
    valid UTF-8), or kept_text (without parts of characters that a cut left).  ``digit_bits`` and ``at_once`` (bytes of
    text in one slice) change the work, never the result.
    """
    if threshold <= DIGIT:
        raise ValueError(f"threshold must be more than {DIGIT}")
    spark = docs.sparkSession
    docs = identified(docs, keep)
    texts = docs.select("uid", "text")
    runs = texts.mapInArrow(lambda it: _run_rows(it, threshold, digit_bits, at_once), "digit bigint, uid bigint, start int, size smallint, left smallint")
    digits = texts.select("text").mapInArrow(lambda it: _digit_rows(it, threshold, digit_bits, at_once), "digit bigint")
    shared_digits = digits.groupBy("digit").count().filter("count > 1").select("digit")
    shared, places = written(runs.join(shared_digits, "digit"), "shared-runs", "zstd")
    hashed, digests = _bytes_of(texts, shared, threshold, True, "run-digests")
    settled, _ = _settled(hashed, "settled-runs")
    repeats = settled.filter("later").select("uid", "start", "size")
    rows, path = _bytes_of(texts, _shared(settled.filter("NOT later")), threshold, False, "runs")
    delete_written(spark, places, digests)
    for width in WIDTHS:
        cut, stretches = written(_shared(_stretches(rows, width, threshold)), "stretches", "zstd")
        settled, _ = _settled(cut, "settled-stretches")
        delete_written(spark, stretches)
        repeats = repeats.unionByName(settled.filter("later").select("uid", "start", "size"))
        rows = _shared(settled.filter("NOT later"))
    delete_written(spark, path)
    spans = materialise(_side_by_side(repeats).groupBy("uid").agg(F.collect_list(F.struct("start", "size")).alias("spans")), "repeat-spans")
    cut = docs.join(spans, "uid", "left").select(*keep, "text", "spans")
    kept = StructField("kept_bytes", StringType() if as_text else BinaryType())
    schema = StructType([*(cut.schema[c] for c in keep), *(StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")), kept])
    out = cut.mapInArrow(lambda it: _remove(it, threshold, as_text, digit_bits, at_once), schema)
    return out.withColumnRenamed("kept_bytes", "kept_text") if as_text else out


def _side_by_side(rows: DataFrame) -> DataFrame:
    """Rows of a document that follow one another without a gap as one span of windows."""
    order = Window.partitionBy("uid").orderBy("start")
    reach = F.max(F.col("start") + F.col("size")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("opens", F.when(F.col("start") <= reach, 0).otherwise(1))
    marked = marked.withColumn("island", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = marked.groupBy("uid", "island").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("size")).alias("end"))
    return span.select("uid", "start", (F.col("end") - F.col("start")).cast("int").alias("size"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of at least 100 bytes removed from all ``documents``."""
    out = remove_repeats(documents(spark, sf_dir))
    return out.withColumn("kept_sha256", F.sha2("kept_bytes", 256)).drop("kept_bytes")
