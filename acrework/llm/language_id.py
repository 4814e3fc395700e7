"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of lower-cased code points, hashed to ``BUCKETS``; a value is the n-gram's share of the
document's n-grams times its inverse document frequency, scaled.  Document frequencies are counted over *all* training
rows, partition by partition, and only one vector of ``BUCKETS`` counts reaches the driver.  Weights are fitted by
follow-the-regularised-leader (per-coordinate steps, elastic-net penalties, so most weights stay zero) on a bounded
sample, ``SAMPLE_PER_LANG`` whole texts of each language; a part of it, not used for fitting, sets the temperature.

Defined results: null text, or one without a letter, gives ``und`` with score 0; with no training rows every text does;
rows with null language are predicted but not learnt from; repeated rows count each time in the document frequencies and
once in the sample; other columns are ignored.  There is no limit on languages; the driver needs about 1.5 MB for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.llm.common import bounded_sample, documents, held_out, text_slices

BUCKETS = 1 << 16
MOST = 3
#: Bounds of the sample that the classifier is fitted on: whole texts and their bytes for each language.  With very many
#: languages each has fewer, so that ``SAMPLE_IN_ALL`` texts are not exceeded (one text of each language always stays).
SAMPLE_PER_LANG = 500
SAMPLE_BYTES = 8_000_000
SAMPLE_IN_ALL = 100_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
SCALE = 30.0
UNKNOWN = "und"
#: Bytes of text at once; arrays of n-grams take some sixty times as much.
SLICE = 250_000


def ngram_buckets(points: np.ndarray, doc_of: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For n = 1..MOST the bucket of the n-gram at each position, and the positions (n-grams do not cross texts)."""
    value = np.zeros(len(points), np.uint32)
    for n in range(1, MOST + 1):
        m = len(points) - n + 1
        if m <= 0:
            return
        value = value[:m] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = value ^ (value >> np.uint32(15))
        mixed = mixed * np.uint32(0x2C1B3C6D)
        at = np.flatnonzero(doc_of[:m] == doc_of[n - 1 :]) if n > 1 else np.arange(m)
        yield (mixed[at] >> np.uint32(16)).astype(np.intp), at


def as_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.repeat(np.arange(len(low)), [len(t) for t in low])


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text, and how often each occurs."""
    points, doc = as_points([text])
    every = [b for b, _ in ngram_buckets(points, doc)]
    return np.unique(np.concatenate(every), return_counts=True) if every else (np.zeros(0, np.intp), np.zeros(0, np.int64))


@dataclass
class LanguageModel:
    langs: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequency and scale included
    bias: np.ndarray
    temperature: float

    def margins(self, texts: list[str]) -> np.ndarray:
        points, doc = as_points(texts)
        total = np.zeros((len(texts), len(self.langs)))
        number = np.zeros(len(texts))
        for bucket, at in ngram_buckets(points, doc):
            d = doc[at]
            number += np.bincount(d, minlength=len(texts))
            for k in range(len(self.langs)):
                total[:, k] += np.bincount(d, self.weights[bucket, k], len(texts))
        return total / np.maximum(number, 1)[:, None] + self.bias

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score, label = np.zeros(len(texts)), [UNKNOWN] * len(texts)
        known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.langs else []
        if known:
            z = self.margins([texts[i] for i in known]) / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            best = p.argmax(1)
            score[known] = p[np.arange(len(known)), best]
            for i, k in zip(known, best):
                label[i] = self.langs[k]
        return label, score


class Ftrl:
    """Follow-the-regularised-leader, one row of weights for each bucket and one column for each class."""

    def __init__(self, rows: int, classes: int):
        self.z, self.n = np.zeros((rows, classes)), np.zeros((rows, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, at: np.ndarray, values: np.ndarray, target: int) -> None:
        w = self.weights(at)
        margin = values @ w
        p = np.exp(margin - margin.max())
        p /= p.sum()
        p[target] -= 1
        g = values[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _temperature(margins: np.ndarray, target: np.ndarray) -> float:
    """The temperature of least log loss on rows that the weights have not seen."""
    if not len(target):
        return 1.0
    grid, loss = np.geomspace(0.05, 20, 121), []
    for t in grid:
        z = margins / t
        z = z - z.max(1, keepdims=True)
        loss.append(float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(target)), target])))
    return float(grid[int(np.argmin(loss))])


def fit_model(rows: list[tuple[str, str]], frequency: np.ndarray, n_docs: int) -> LanguageModel:
    """Fit on (text, lang) pairs; every fifth pair of each language is kept for the temperature."""
    langs = sorted({lang for _, lang in rows})
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    idf = SCALE * np.log((1 + n_docs) / (1 + frequency))
    place = {lang: k for k, lang in enumerate(langs)}
    seen: dict[str, int] = dict.fromkeys(langs, 0)
    fit, check = [], []
    for text, lang in rows:
        seen[lang] += 1
        (check if seen[lang] % 5 == 0 else fit).append((text, place[lang]))
    examples = []
    for text, k in fit:
        bucket, count = counts(text)
        if len(bucket):
            examples.append((np.append(bucket, BUCKETS), np.append(count / count.sum() * idf[bucket], 1.0), k))
    model = Ftrl(BUCKETS + 1, len(langs))
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(examples)):
            model.step(*examples[i])
    weights = model.weights()
    out = LanguageModel(langs, (weights[:BUCKETS] * idf[:, None]).astype(np.float32), weights[BUCKETS], 1.0)
    if check:
        out.temperature = _temperature(out.margins([t for t, _ in check]), np.asarray([k for _, k in check]))
    return out


def _count_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition: one row for each bucket that occurs; bucket -1 counts documents."""
    total, n = np.zeros(BUCKETS, np.int64), 0
    seen = np.zeros(BUCKETS, bool)
    for batch in text_slices(batches, "text", SLICE):
        texts = batch.column("text").to_pylist()
        points, doc = as_points(texts)
        per_n = [(b, doc[at]) for b, at in ngram_buckets(points, doc)]
        cuts = [np.searchsorted(d, np.arange(len(texts) + 1)) for _, d in per_n]
        for i in range(len(texts)):
            seen[:] = False
            for (bucket, _), cut in zip(per_n, cuts):
                seen[bucket[cut[i] : cut[i + 1]]] = True
            total += seen
        n += len(texts)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(total[at], n))], ["bucket", "n"])


def train(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG) -> LanguageModel:
    """Learn from text and non-null lang of rows that are not held out."""
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    frequency = np.zeros(BUCKETS, np.int64)
    n_docs = 0
    for bucket, n in rows.select("text").mapInArrow(_count_documents, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n")).collect():  # at most BUCKETS + 1 rows
        if bucket < 0:
            n_docs = n
        else:
            frequency[bucket] = n
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # one row for each language
    if not sizes:
        return fit_model([], frequency, n_docs)
    each = max(1, min(sample_per_lang, SAMPLE_IN_ALL // len(sizes)))
    # an expected 1.2 times the bound of each language, by a hash of id and text; then cut to the bound in hash order
    draw = F.xxhash64(F.lit("language"), "doc_id", "text") / 2.0**64 + 0.5
    share = {lang: min(2.0, (1.2 * each + 20) / n) for lang, n in sizes.items()}
    drawn = bounded_sample(rows.withColumn("draw", draw).select("draw", "lang", "text"), "lang", share, dict.fromkeys(sizes, each), SAMPLE_BYTES)
    sample = [(r["text"], r["lang"]) for r in sorted(drawn.collect(), key=lambda r: (r["draw"], r["lang"], r["text"]))]
    return fit_model(sample, frequency, n_docs)


def predict_languages(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, lang_pred and score; the model (a table of fixed size) is sent to the workers once."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    source = docs.select(*dict.fromkeys((*keep, "text"))).withColumn("text", F.col("text").cast("string"))
    schema = StructType([*source.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "text", SLICE):
            label, score = shared.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return source.mapInArrow(run, schema).select(*keep, "lang_pred", "score")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every whole text of ``documents``."""
    docs = documents(spark, sf_dir)
    return predict_languages(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
