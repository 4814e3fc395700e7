"""Near-duplicate documents by tensored MinHash tables, with every link confirmed on full shingle sets.

1. Each text becomes its set of distinct five-word shingles; equal sets form a class (one fingerprint), and from here
   on only classes count, so exact copies never meet in pairs.
2. Two collections of n keys, each key of ``ROWS`` minhashes, are computed; every pair of a key from the first and one
   from the second is the key of a table.  So 2 * n * ROWS minhashes fill n**2 tables, and a pair of similarity s is
   missed with probability below 2 * (1 - s**ROWS)**n.  n is the least that brings this below ``MISSED`` at the limit
   (10 at 0.85, 14 at 0.80).
3. Table keys, those of ``ROUND_TABLES`` tables at a time, are counted before they are shuffled; classes that share a key are tied to the least of them.  The
   components of these ties are *families*: no link leaves a family.
4. Families are cut into bands of sizes that can link, and dealt to groups of bounded size (pairs of blocks, where a band
   is too large for one), in which pairs that share a table and whose sizes allow it are compared on full sets, most
   similar first.  Pairs already connected
   are skipped, since they cannot change a component; a group gives the links of a spanning forest only.
5. Components of the links give the result.

A family of n different texts costs up to n**2 comparisons of keys inside its groups (no rows); exact links need that.

Defined results: null text and texts without words have an empty set and link with nothing; rows that share a doc_id
are rows of their own, and those with the component's least id are all kept; a null doc_id comes last and is kept only
where all ids of its component are null; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acrework.llm.common import documents, materialise, mix64, text_slices, utf8
from acrework.llm.shingles import shingle_sets
from acrework.operators.components import connected_components

SHINGLE = 5
ROWS = 3
#: Links need 100 * intersection >= percent * union; this is the limit of op4.
PERCENT = 85
#: Bound of the probability that a link at the limit is missed.
MISSED = 0.00015
#: Tables whose keys are shuffled at once; bounds the disk that shuffles take.
ROUND_TABLES = 100
#: Bounds of a block: shingles and classes.
BLOCK_SHINGLES, BLOCK_CLASSES = 300_000, 1_500
#: Bytes of text at once, so that the arrays stay small.
SLICE = 250_000
SIGNATURE = "doc_id bigint, digest bigint, n_shingles bigint, node bigint, a array<int>, b array<int>"


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(98765).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)


def tables_for(percent: int) -> int:
    """Keys of each collection that bring the bound of missed links at the limit below ``MISSED``."""
    if not 1 <= percent <= 100:
        raise ValueError(f"percent must be from 1 to 100, not {percent}")
    n = 1
    while 2 * (1 - (percent / 100) ** ROWS) ** n >= MISSED:
        n += 1
    return n


def fingerprints(key: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One hash of each set (0 for an empty one)."""
    total = np.append(np.uint64(0), np.cumsum(mix64(key ^ np.uint64(0xA0761D6478BD642F)), dtype=np.uint64))
    size = np.diff(bounds).astype(np.uint64)
    return np.where(size > 0, mix64(total[bounds[1:]] - total[bounds[:-1]] + size * np.uint64(0x9E3779B97F4A7C15)), np.uint64(0))


def table_keys(key: np.ndarray, bounds: np.ndarray, tables: int = tables_for(PERCENT)) -> tuple[np.ndarray, np.ndarray]:
    """The keys of both collections, one row for each set (rows of empty sets are 0)."""
    full = np.flatnonzero(np.diff(bounds) > 0)
    out = np.zeros((2 * tables, len(bounds) - 1), np.uint64)
    if len(full):
        at = bounds[full]
        for i, multiplier in enumerate(_multipliers(2 * tables * ROWS)):
            x = key * multiplier
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x9E3779B97F4A7C15)
            out[i // ROWS, full] = mix64(out[i // ROWS, full] ^ np.minimum.reduceat(x, at))
    both = (out >> np.uint64(32)).astype(np.uint32).view(np.int32).T
    return np.ascontiguousarray(both[:, :tables]), np.ascontiguousarray(both[:, tables:])


def _lists(values: np.ndarray) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def _signatures(batches: Iterator[pa.RecordBatch], tables: int) -> Iterator[pa.RecordBatch]:
    for batch in text_slices(batches, "text", SLICE):
        key, bounds = shingle_sets(*utf8(batch.column("text")), SHINGLE)
        a, b = table_keys(key, bounds, tables)
        yield pa.record_batch([batch.column("doc_id"), batch.column("digest"), pa.array(np.diff(bounds)), pa.array(fingerprints(key, bounds).view(np.int64)), _lists(a), _lists(b)], ["doc_id", "digest", "n_shingles", "node", "a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The full set of each wanted class, from the text of its representative; once in a task, though equal rows come."""
    seen: set[int] = set()
    for batch in text_slices(batches, "text", SLICE):
        key, bounds = shingle_sets(*utf8(batch.column("text")), SHINGLE)
        same = np.flatnonzero(fingerprints(key, bounds).view(np.int64) == batch.column("node").to_numpy())
        nodes = batch.column("node").to_pylist()
        same = np.asarray([i for i in same.tolist() if nodes[i] not in seen and not seen.add(nodes[i])], np.int64)
        sets = [key[bounds[i] : bounds[i + 1]].tobytes() for i in same.tolist()]
        yield pa.record_batch([batch.column("node").take(pa.array(same)), pa.array(sets, pa.binary())], ["node", "members"])


def _links_of_group(table: pa.Table, percent: int) -> pa.Table:
    """Links of a spanning forest among one group's classes (between its two blocks only, if it has two)."""
    node = table.column("node").to_numpy()
    block, own = table.column("block").to_numpy(), np.asarray(table.column("own").to_pylist(), bool)
    sets = [np.frombuffer(m, np.uint64) for m in table.column("members").to_pylist()]
    size = np.asarray([len(s) for s in sets])
    keys = [np.asarray(table.column(c).to_pylist(), np.int32).reshape(len(node), -1) for c in ("a", "b")]
    parent = list(range(len(node)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    two = len(np.unique(block)) > 1
    pairs, agree = [], []
    for i in range(len(node) - 1):
        rest = np.arange(i + 1, len(node))
        if two:
            rest = rest[block[rest] != block[i]]
        if not own[i]:
            rest = rest[own[rest]]  # visitors meet one another in their own band
        same = [keys[k][rest] == keys[k][i] for k in range(2)]
        fits = 100 * np.minimum(size[rest], size[i]) >= percent * np.maximum(size[rest], size[i])
        hit = fits & same[0].any(1) & same[1].any(1)
        pairs.append(np.stack((np.full(hit.sum(), i), rest[hit]), 1))
        agree.append(same[0][hit].sum(1) + same[1][hit].sum(1))
    links = []
    if pairs:
        every = np.concatenate(pairs)
        for i, j in every[np.argsort(-np.concatenate(agree), kind="stable")].tolist():
            x, y = root(i), root(j)
            if x == y:
                continue
            small, large = (sets[i], sets[j]) if size[i] <= size[j] else (sets[j], sets[i])
            at = np.searchsorted(large, small)
            common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * common >= percent * (len(small) + len(large) - common):
                parent[max(x, y)] = min(x, y)
                links.append((int(node[i]), int(node[j])))
    return pa.table({"src": pa.array([x for x, _ in links], pa.int64()), "dst": pa.array([y for _, y in links], pa.int64())})


def _ties(classes: DataFrame, first: int, n: int) -> DataFrame:
    """Each class with the least class of every table key that it shares, in the tables of ``n`` keys of the first collection."""
    pairs = F.expr(f"flatten(transform(slice(a, {first + 1}, {n}), (x, i) -> transform(b, (y, j) -> xxhash64(i + {first}, j, x, y))))")
    keys = classes.select("node", F.explode(pairs).alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).filter("least < most").drop("most")
    return keys.join(shared, "key").filter("node <> least").select("node", "least").distinct()


def near_duplicate_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document; links need a similarity of ``percent`` or more."""
    spark, tables = docs.sparkSession, tables_for(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.withColumn("digest", F.xxhash64("text"))
    signed = materialise(texts.mapInArrow(lambda it: _signatures(it, tables), SIGNATURE), "signatures")
    classes = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min_by("a", F.coalesce("doc_id", F.lit(0))).alias("a"), F.min_by("b", F.coalesce("doc_id", F.lit(0))).alias("b"), F.min_by("digest", F.coalesce("doc_id", F.lit(2**63 - 1))).alias("digest"), F.min("n_shingles").alias("n_shingles"))
    classes = materialise(classes, "classes")
    step = max(1, ROUND_TABLES // tables)
    ties = None
    for first in range(0, tables, step):
        found = materialise(_ties(classes, first, step), "ties")
        ties = found if ties is None else ties.unionByName(found)
    families = connected_components(ties, "node", "least").withColumnRenamed("component", "family")
    members = materialise(families.join(classes, "node"), "family-members")
    # a class is fetched by the id and the text's hash of one of its rows, so rows without id or with a shared one do not
    # meet each other's classes; of rows equal in both one stays
    place = F.coalesce("doc_id", F.lit(-(2**63))).alias("place")
    wanted = members.select("node", place, "digest")
    full = texts.select(place, "digest", "text").join(wanted, ["place", "digest"]).select("node", "text")
    full = materialise(full.mapInArrow(_sets, "node bigint, members binary"), "shingle-sets")
    # only sizes of neighbouring bands can link, so a class stays in its band and visits the next one
    width = math.log(100 / percent) * (1 + 1e-9)
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / width) if percent < 100 else F.col("n_shingles")
    banded = members.withColumn("at", F.explode(F.array(F.struct(band.alias("band"), F.lit(True).alias("own")), F.struct((band + 1).alias("band"), F.lit(False).alias("own"))))).select("node", "a", "b", "n_shingles", "family", "at.band", "at.own")
    blocks = banded.groupBy("family", "band").agg(F.greatest(F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES), F.ceil(F.count("node") / BLOCK_CLASSES)).cast("int").alias("blocks"), F.max("own").alias("any"), F.count("node").alias("n"))
    placed = banded.drop("n_shingles").join(blocks.filter("any AND n > 1").drop("any", "n"), ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    partner = F.explode(F.expr("CASE WHEN blocks = 1 THEN array(0) ELSE sequence(0, blocks - 1) END")).alias("partner")
    dealt = placed.select("*", partner).withColumns({"low": F.least("block", "partner"), "high": F.greatest("block", "partner")}).drop("partner", "blocks")
    groups = dealt.join(full, "node").groupBy("family", "band", "low", "high")
    links = materialise(groups.applyInArrow(lambda t: _links_of_group(t, percent), "src bigint, dst bigint"), "links")
    joined = connected_components(links).join(classes.select("node", "doc_id"), "node")
    least = joined.groupBy("component").agg(F.min("doc_id").alias("least"))
    linked = joined.join(least, "component").select("node", "least")
    alone = classes.join(linked, "node", "left_anti").select("node", F.col("doc_id").alias("least"))
    found = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(linked.unionByName(alone), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_duplicate_components(documents(spark, sf_dir), PERCENT)
