"""Quality rules: word statistics with fixed limits, then robust multivariate outliers.

Of each document five transformed statistics form a vector.  Per language and source, per language, and over all, a
regularised minimum-covariance-determinant estimate is found: of all choices of ``INNER_SHARE`` of a group's documents
the one whose regularised covariance has the least determinant.  Concentration steps take the share of documents nearest
to the present centre (Mahalanobis distance) and let their mean and covariance be the next estimate, which never raises
the determinant; they go on until no group's determinant falls any more.  Two deterministic starts run side by side
(medians with absolute deviations; plain mean and covariance); the smaller determinant wins.  The covariance is mixed
with a diagonal target, the squared robust spreads of the group itself (Boudt et al., 2020), at ``MIXED``; a spread is
never taken below ``UNIT``, what is ordinary anywhere in a statistic that most documents of a group share.

Every step is a pair of grouped aggregations over all rows, combined before they are shuffled; ranks come from fixed
fine bins of the distance, the last of which enters with the weight that makes the share exact, so no group is ever
gathered in one place.

A group's estimate is pooled with that of its language, and this with that of all documents, in proportion to their
sizes and ``PRIOR`` rows: small groups lean on wider ones, without a limit at which something switches.

Defined results: null text has no words and so fails; null language or source is a value of its own; repeated rows
count each time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrework.llm import chi_square
from acrework.llm.common import documents, materialise, mix64, text_slices, utf8
from acrework.llm.rolling import Prefix

SYMBOLS = "#*$%&|<>"
INNER_SHARE = 0.75
REJECT_P = 0.9999
#: Rows of the wider group that stand beside a group's own.
PRIOR = 60
#: Share of the target in the covariance, and the fall of a log determinant that still counts.
MIXED, STILL = 0.1, 1e-3
#: Least deviation of each statistic in the target.
UNIT = (1.1, 0.19, 0.16, 0.63, 0.63)
DIMS = len(UNIT)
#: Bins of log2 of the squared distance: from 2**-20 upward, 64 to each doubling.
BIN_LOW, BIN_PER_OCTAVE = -20, 64
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(9, 14)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word (a run without white space) in concatenated texts."""
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    start = np.flatnonzero(begin)
    return start, np.flatnonzero(end) + 1, np.searchsorted(offsets, start, "right") - 1


def _per_doc(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flags))
    return np.diff(total[offsets])


def _in_repeated_windows(doc: np.ndarray, value: np.ndarray, n: int, span: int = 3) -> np.ndarray:
    """Words that lie in a window of ``span`` words found twice or more in their document."""
    hit = np.zeros(n, bool)
    if n < span:
        return hit
    whole = doc[span - 1 :] == doc[: n - span + 1]
    window = np.zeros(n - span + 1, np.uint64)
    for k in range(span):
        window = mix64(window * np.uint64(0x100000001B3) + value[k : n - span + 1 + k])
    at = np.flatnonzero(whole)
    key = mix64(window[at] + doc[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = at[order[twice]]
    for k in range(span):
        hit[found + k] = True
    return hit


def statistics(column: pa.Array) -> dict[str, np.ndarray]:
    data, offsets = utf8(column)
    n_docs = len(offsets) - 1
    start, end, doc = words(data, offsets)
    n_words = np.bincount(doc, minlength=n_docs)
    visible = ~_SPACE[data] & ((data & 0xC0) != 0x80)
    value = Prefix(data).ranges(start, end)
    repeated = np.bincount(doc[_in_repeated_windows(doc, value, len(doc))], minlength=n_docs)
    dup = np.zeros(n_docs, np.int64)
    for i, text in enumerate(column.to_pylist()):
        if text and "\n" in text:
            lines = [line for line in text.split("\n") if line.strip(" \t\n\r\x0b\x0c")]
            dup[i] = len(lines) - len(set(lines))
    lines = _per_doc(data == 10, offsets) + 1
    return {"n_words": n_words, "word_chars": _per_doc(visible, offsets), "n_symbols": _per_doc(_SYMBOL[data], offsets), "n_dup_lines": dup, "n_repeat_words": repeated, "n_lines": lines}


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text"):
        stats = statistics(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(v.astype(np.int64)) for v in stats.values())], ["doc_id", "lang", "source", *stats])


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, the fixed verdict, and the transformed vector x0.. of each document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    rows = texts.mapInArrow(_rows, "doc_id bigint, lang string, source string, " + ", ".join(f"{c} bigint" for c in (*STATS, "n_lines")))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.col(a) / F.greatest(F.col(b), F.lit(1)), F.lit(1.0))))
    return rows.withColumns(
        {
            "base_failed": (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
            "x0": F.log1p("n_words"),
            "x1": F.log((F.col("word_chars") + 1) / (F.col("n_words") + 1)),
            "x2": share("n_symbols", "word_chars"),
            "x3": share("n_dup_lines", "n_lines"),
            "x4": share("n_repeat_words", "n_words"),
        }
    )


def _keys() -> dict[str, F.Column]:
    """The group of language and source, that of the language, and that of all, by level."""
    lang, source = F.coalesce("lang", F.lit("\x1e")), F.coalesce("source", F.lit("\x1e"))
    return {"own": F.concat_ws("\x1f", F.lit("s"), lang, source), "by_lang": F.concat_ws("\x1f", F.lit("l"), lang), "by_all": F.lit("*")}


PAIRS = [(i, j) for i in range(DIMS) for j in range(i, DIMS)]


def _moments(rows: DataFrame, keys: list[str], weight: F.Column) -> DataFrame:
    """Weight, sums and sums of products of each group, as columns."""
    x = [F.col(f"x{i}") for i in range(DIMS)]
    return rows.groupBy(*keys).agg(F.sum(weight).alias("n"), *(F.sum(weight * x[i]).alias(f"s{i}") for i in range(DIMS)), *(F.sum(weight * x[i] * x[j]).alias(f"p{i}{j}") for i, j in PAIRS))


MEANS, INVERSE, TARGET = [f"m{i}" for i in range(DIMS)], [f"w{i}{j}" for i, j in PAIRS], [f"t{i}" for i in range(DIMS)]
STATE = "key string, start int, n double, logdet double, " + ", ".join(f"{c} double" for c in (*MEANS, *INVERSE))


def _matrices(pdf, columns: list[str]) -> np.ndarray:
    """Symmetric matrices from their upper triangles, one for each row."""
    out = np.zeros((len(pdf), DIMS, DIMS))
    for (i, j), c in zip(PAIRS, columns):
        out[:, i, j] = out[:, j, i] = pdf[c].to_numpy(float)
    return out


def _estimates(batches: Iterator) -> Iterator:
    """Mean, inverse covariance (mixed with the target) and its determinant from the moments of each group."""
    import pandas as pd

    for pdf in batches:
        if not len(pdf):
            continue
        n = pdf["n"].to_numpy(float)[:, None]
        mean = pdf[[f"s{i}" for i in range(DIMS)]].to_numpy(float) / n
        cov = _matrices(pdf, [f"p{i}{j}" for i, j in PAIRS]) / n[:, :, None] - mean[:, :, None] * mean[:, None, :]
        scale = np.where(pdf["trimmed"].to_numpy(bool), CONSISTENCY, 1.0)[:, None, None]
        cov = (1 - MIXED) * scale * cov + MIXED * np.einsum("ni,ij->nij", pdf[TARGET].to_numpy(float), np.eye(DIMS))
        inverse = np.linalg.inv(cov)
        out = {"key": pdf["key"], "start": pdf["start"], "n": pdf["n"], "logdet": np.linalg.slogdet(cov)[1]}
        out |= {f"m{i}": mean[:, i] for i in range(DIMS)} | {f"w{i}{j}": inverse[:, i, j] for i, j in PAIRS}
        yield pd.DataFrame(out)


def _consistency() -> float:
    q = chi_square.quantile(INNER_SHARE, DIMS)
    return INNER_SHARE / chi_square.cdf(q, DIMS + 2)


CONSISTENCY = _consistency()


def _distance() -> F.Column:
    d = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(DIMS)]
    return sum(((1 if i == j else 2) * F.col(f"w{i}{j}") * d[i] * d[j] for i, j in PAIRS), F.lit(0.0))


def _robust_spreads(rows: DataFrame) -> DataFrame:
    """Of each key the rows, medians m0.. and targets t0.. (squared spreads), by quantile sketches of bounded size."""
    mids = rows.groupBy("key").agg(F.count("x0").cast("double").alias("rows"), *(F.percentile_approx(f"x{i}", 0.5, 1000).alias(f"m{i}") for i in range(DIMS)))
    away = rows.join(mids.drop("rows"), "key").groupBy("key").agg(*(F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 1000).alias(f"a{i}") for i in range(DIMS)))
    return mids.join(away, "key").select("key", "rows", *MEANS, *(F.pow(F.greatest(1.4826 * F.col(f"a{i}"), F.lit(UNIT[i])), 2).alias(f"t{i}") for i in range(DIMS)))


def _concentrated(rows: DataFrame, state: DataFrame, targets: DataFrame) -> DataFrame:
    """One concentration step for every key and start."""
    near = rows.join(state.drop("n", "logdet"), "key").withColumn("d2", _distance())
    bin_of = F.greatest(F.floor((F.log2(F.greatest("d2", F.lit(1e-30))) - BIN_LOW) * BIN_PER_OCTAVE), F.lit(0)).cast("int")
    near = near.withColumn("bin", bin_of).select("key", "start", "bin", *(f"x{i}" for i in range(DIMS)))
    counts = near.groupBy("key", "start", "bin").count()
    upto = Window.partitionBy("key", "start").orderBy("bin")  # a few thousand bins at most
    whole = Window.partitionBy("key", "start")
    ranked = counts.withColumns({"upto": F.sum("count").over(upto), "inner": INNER_SHARE * F.sum("count").over(whole)})
    last = ranked.filter((F.col("upto") >= F.col("inner")) & (F.col("upto") - F.col("count") < F.col("inner")))
    last = last.select("key", "start", F.col("bin").alias("limit"), ((F.col("inner") - F.col("upto") + F.col("count")) / F.col("count")).alias("part"))
    inner = near.join(last, ["key", "start"]).filter("bin <= limit")
    moments = _moments(inner, ["key", "start"], F.when(F.col("bin") < F.col("limit"), 1.0).otherwise(F.col("part")))
    return moments.join(targets.select("key", *TARGET), "key").withColumn("trimmed", F.lit(True)).mapInPandas(_estimates, STATE)


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each key over rows with columns key, x0..: key, rows, mean m0.. and inverse covariance w00.."""
    spreads = materialise(_robust_spreads(rows), "mcd-spreads")
    medians = spreads.select("key", F.lit(0).alias("start"), F.col("rows").alias("n"), F.lit(0.0).alias("logdet"), *MEANS, *((1 / F.col(f"t{i}") if i == j else F.lit(0.0)).alias(f"w{i}{j}") for i, j in PAIRS))
    plain = _moments(rows, ["key"], F.lit(1.0)).join(spreads.select("key", *TARGET), "key").withColumns({"start": F.lit(1), "trimmed": F.lit(False)}).mapInPandas(_estimates, STATE)
    state = materialise(_concentrated(rows, medians.unionByName(plain), spreads), "mcd-state")
    while True:
        following = materialise(_concentrated(rows, state, spreads), "mcd-state")
        fall = following.join(state.select("key", "start", F.col("logdet").alias("before")), ["key", "start"]).agg(F.max(F.col("before") - F.col("logdet"))).first()[0]
        state = following
        if fall is None or fall <= STILL:
            break
    best = state.groupBy("key").agg(F.min(F.struct("logdet", "start")).alias("best"))
    return state.join(best, "key").filter("start = best.start").join(spreads.select("key", "rows"), "key").select("key", "rows", *MEANS, *INVERSE)


def _pooled(batches: Iterator) -> Iterator:
    """Mean and inverse covariance of each group, pooled with its language and with all documents."""
    import pandas as pd

    for pdf in batches:
        if not len(pdf):
            continue
        mean = cov = None
        for level in ("all_", "lang_", "own_"):
            rows = pdf[f"{level}rows"].to_numpy(float)[:, None]
            here, spread = pdf[[level + c for c in MEANS]].to_numpy(float), np.linalg.inv(_matrices(pdf, [level + c for c in INVERSE]))
            if mean is None:
                mean, cov = here, spread * (1 + PRIOR / rows)[:, :, None]
                continue
            share = rows / (rows + PRIOR)
            gap = here - mean
            cov = share[:, :, None] * spread + (1 - share)[:, :, None] * cov + (share * (1 - share))[:, :, None] * gap[:, :, None] * gap[:, None, :]
            mean = share * here + (1 - share) * mean
        inverse = np.linalg.inv(cov)
        yield pd.DataFrame({"own": pdf["own"]} | {f"m{i}": mean[:, i] for i in range(DIMS)} | {f"w{i}{j}": inverse[:, i, j] for i, j in PAIRS})


def quality_verdicts(docs: DataFrame, reject_p: float = REJECT_P) -> DataFrame:
    """Counts, base_failed, distance2 (null where no estimate exists) and kept for every document."""
    stats = materialise(document_statistics(docs).withColumns(_keys()), "document-statistics")
    sound = stats.filter("NOT base_failed")
    estimates = materialise(mcd_estimates(sound.select(F.explode(F.array("own", "by_lang", "by_all")).alias("key"), *(f"x{i}" for i in range(DIMS)))), "mcd-estimates")
    named = lambda prefix, key: estimates.select(F.col("key").alias(key), *(F.col(c).alias(prefix + c) for c in ("rows", *MEANS, *INVERSE)))
    groups = sound.select("own", "by_lang", "by_all").distinct().join(named("own_", "own"), "own").join(named("lang_", "by_lang"), "by_lang").join(named("all_", "by_all"), "by_all")
    pooled = groups.mapInPandas(_pooled, "own string, " + ", ".join(f"{c} double" for c in (*MEANS, *INVERSE)))
    placed = stats.join(pooled, "own", "left").withColumn("distance2", _distance())
    far = F.coalesce(F.col("distance2") > chi_square.quantile(reject_p, DIMS), F.lit(False))
    return placed.select("doc_id", *STATS, "base_failed", "distance2", (~F.col("base_failed") & ~far).alias("kept"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict for every whole text of ``documents``."""
    return quality_verdicts(documents(spark, sf_dir))
