"""Importance resampling towards a target: hashed n-gram counts by a dictionary automaton, gains, and a weighted draw.

The distinct words of a slice of text form an Aho-Corasick automaton.  Its keys carry a delimiter at both ends, so that
only whole words match, and each key has a payload: CRC-32 and length.  One scan of the slice emits the payloads in
order.  The CRC of a run of words follows from the payloads of its neighbours alone (a CRC is shifted by the length of
what follows and added), so no n-gram is ever put together as a string.  Words longer than ``DICTIONARY_BYTES`` would
only swell the automaton; they are not looked up but carry their payload directly.

The text is scanned twice, for the counts and for the weights; nothing as large as the text is shuffled or written.
Only one vector of ``BUCKETS`` counts for each table reaches the driver.  The draw orders (score, id) of the documents
by a range shuffle.

Defined results: null and empty texts have no words and weight 0; a null doc_id draws as an empty one and comes first
among ties; repeated rows count each time; with an empty target all its counts are 0; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from acrework.functions.storage import cut_lineage
from acrework.llm.common import documents, text_slices, utf8
from acrework.operators.aggregates import prefix_sums

BUCKETS = 10_000
MOST = 3
SEED = 42
LEAST_WORDS, PERCENT = 20, 5
#: Bytes of text whose words share an automaton.
SLICE = 1_000_000
DICTIONARY_BYTES = 200
_GAP = 10  # what every delimiter becomes


def _folded() -> np.ndarray:
    """What each byte becomes: a word's byte, A-Z in lower case, or the delimiter."""
    out = np.full(256, _GAP, np.uint8)
    for low, high, to in (("0", "9", "0"), ("a", "z", "a"), ("A", "Z", "a")):
        out[ord(low) : ord(high) + 1] = np.arange(ord(high) - ord(low) + 1) + ord(to)
    out[128:] = np.arange(128, 256)
    return out


_FOLDED = _folded()


@cache
def _shift_tables(power: int) -> np.ndarray:
    """For each byte of a CRC the effect of 2**power zero bytes after it; effects add up by exclusive or."""
    places = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    if power:
        once = _shift_tables(power - 1)
        return _through(once, _through(once, places))
    for _ in range(8):  # one byte, bit by bit
        places = (places >> np.uint32(1)) ^ np.where(places & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return places


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & np.uint32(255)] ^ tables[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ tables[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ tables[3][crc >> np.uint32(24)]


def compose(crc: np.ndarray, following: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings in a row from their own, and the length of the second."""
    out, power = crc.copy(), 0
    while len(at := np.flatnonzero(length >> power)):
        some = at[(length[at] >> power & 1).astype(bool)]
        out[some] = _through(_shift_tables(power), out[some])
        power += 1
    return out ^ following


def word_payloads(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, CRC-32 and length of each word, in order."""
    texts = len(offsets) - 1
    line = np.full(len(data) + texts + 1, _GAP, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, texts + 1), np.diff(offsets))
    line[at] = _FOLDED[data]
    inside = line != _GAP
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    long = np.flatnonzero(end - begin > DICTIONARY_BYTES)
    crc, length = np.zeros(len(begin), np.uint32), end - begin
    raw = line.tobytes()
    for i in long.tolist():
        crc[i] = zlib.crc32(raw[begin[i] : end[i]])
    for i in long.tolist():
        line[begin[i] : end[i]] = _GAP
    scanned = line.tobytes().decode("latin-1") if len(long) else raw.decode("latin-1")
    dictionary, gap = ahocorasick.Automaton(ahocorasick.STORE_INTS), chr(_GAP)
    distinct = sorted(set(scanned.split(gap)) - {""})
    for k, word in enumerate(distinct):
        dictionary.add_word(f"{gap}{word}{gap}", k)
    if distinct:
        dictionary.make_automaton()
        found = np.fromiter(chain.from_iterable(dictionary.iter(scanned)), np.int64).reshape(-1, 2)
        payload = np.fromiter((zlib.crc32(w.encode("latin-1")) for w in distinct), np.uint32, len(distinct))
        crc[np.searchsorted(end, found[:, 0])] = payload[found[:, 1]]
    text = np.searchsorted(offsets + np.arange(texts + 1), begin, "left") - 1
    return text, crc, length


def features(data: np.ndarray, offsets: np.ndarray, buckets: int = BUCKETS, most: int = MOST) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n up to ``most`` the texts and the buckets of all runs of n words."""
    text, crc, length = word_payloads(data, offsets)
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    spaced = compose(space, crc, length)
    run = crc
    for n in range(1, most + 1):
        if n > 1:
            run = compose(run[:-1], spaced[n - 1 :], length[n - 1 :] + 1)
        if not len(run):
            return
        whole = text[: len(run)] == text[n - 1 :]
        yield text[: len(run)][whole], (run[whole] % np.uint32(buckets)).astype(np.intp)


def _count_rows(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    total = np.zeros(buckets, np.int64)
    for batch in text_slices(batches, "text", SLICE):
        for _, bucket in features(*utf8(batch.column("text")), buckets):
            total += np.bincount(bucket, minlength=buckets)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket; at most ``buckets`` rows reach the driver."""
    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lambda it: _count_rows(it, buckets), "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of the smoothed shares of each bucket in the target and in the raw table."""
    s, t, k = raw.astype(float), target.astype(float), len(raw)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def _weight_rows(batches: Iterator[pa.RecordBatch], gains: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", SLICE):
        n = batch.num_rows
        weight, number, words = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for k, (text, bucket) in enumerate(features(*utf8(batch.column("text")), len(gains))):
            np.add.at(weight, text, gains[bucket])
            count = np.bincount(text, minlength=n)
            number += count
            if k == 0:
                words = count
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*(batch.column(c) for c in kept), pa.array(words), pa.array(number), pa.array(weight)], [*kept, "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the gains of all features of the text) of each row."""
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    schema = StructType([source.schema["doc_id"], *(StructField(c, LongType()) for c in ("n_words", "n_features", "weight"))])
    return source.mapInArrow(lambda it: _weight_rows(it, gains), schema)


def draw(weighed: DataFrame, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """``weighed`` with score, the weight and Gumbel noise that a hash of the id sets, and rank.

    Of the N rows with at least ``least_words`` words the floor(percent * N / 100) highest scores are drawn, ties to the
    least id; they are ranked from 1, all others have none.
    """
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    h = F.conv(digits, 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = cut_lineage(weighed.withColumn("score", F.col("weight") + noise), "scored")
    enough = F.col("n_words") >= least_words
    order = [F.desc("score"), F.asc_nulls_first("doc_id"), "weight", "n_features"]
    placed = prefix_sums(scored.filter(enough).withColumn("_one", F.lit(1).cast("long")), order, "_one", "_place").drop("_one")
    drawn = scored.filter(enough).agg(F.floor(F.count("*") * percent / 100).cast("long").alias("_drawn"))
    ranked = placed.crossJoin(drawn).withColumn("rank", F.when(F.col("_place") <= F.col("_drawn"), F.col("_place"))).drop("_place", "_drawn")  # one row
    return ranked.unionByName(scored.filter(~enough).withColumn("rank", F.lit(None).cast("long")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` drawn towards the n-grams of ``benchmark``."""
    docs = documents(spark, sf_dir)
    gains = bucket_gains(bucket_counts(docs), bucket_counts(documents(spark, sf_dir, "benchmark")))
    return draw(weigh(docs, gains)).select("doc_id", "n_features", "weight", "score", "rank")
