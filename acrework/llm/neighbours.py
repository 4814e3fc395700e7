"""Approximate nearest neighbours by cosine through stable projections and kd-trees.

Unit vectors are projected by a fixed Gaussian matrix to ``DIMS`` coordinates.  For two vectors at distance d the
squared projected distance over d**2 follows a chi-square law with ``DIMS`` degrees of freedom, whatever the data.  So
once projected neighbours have been verified up to radius r, and the k-th best true distance found is d, a vector
nearer than d is still unseen with probability of at most 1 - chi2(r**2 / d**2); the search stops when that is small.

The index is a kd-tree in two levels.  Its upper splits come from a bounded sample (``SAMPLE`` projected rows) and cut
the space into cells of about ``CELL_ROWS`` rows; every row is indexed.  A query first searches its own cell, which
bounds d, and then descends the tree to the cells whose box the stopping radius reaches.  In a cell, leaves are verified in
order of projected distance until the test holds.  A cell with many rows is dealt to several parts by a hash.

Equal vectors are indexed once, with their smallest ids, and asked once, so a vector that a third of the rows share costs
one entry and one search.  Both sides of a cell are bounded: its rows are dealt to parts, the queries that reach it to
blocks.  Vectors are scaled by a power of two before anything is squared, which changes no cosine.

Defined results: vectors that are null, zero, or hold a null or non-finite component (or have another length than most)
take no part, neither do null ids; of rows with one id and one vector a single one counts; with fewer candidates than k
all are returned, and without candidates none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from acrework.llm import chi_square
from acrework.llm.common import documents, materialise

DIMS = 8
#: The test stops when a nearer vector would have been seen with this probability.
CONFIDENCE = 0.95
CELL_ROWS, LEAF_ROWS = 20_000, 64
#: Queries that meet a part of a cell in one task.
BLOCK_QUERIES = 5_000
#: Leaves that are verified together at most.
STEP = 16
#: Rows whose projections choose the upper splits, and the most levels of these: the splits and the boxes of all cells
#: (under 1.2 MB) go to every task.  Where rows are so many that cells grow, a cell is dealt to more parts.
SAMPLE, MOST_DEPTH = 20_000, 12
QUERY_EVERY = 50
FOUND = "query_id bigint, vec_id bigint, score double"


def projection(width: int) -> np.ndarray:
    return np.random.default_rng(271828).normal(0, 1, (width, DIMS))


def scaled(v: np.ndarray) -> np.ndarray:
    """Each vector times a power of two, so that its largest component is from a half to one; without any rounding."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True))[1])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


class Splits:
    """The upper levels of the tree: a complete binary tree of median splits over cycling widest axes."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(max(1, (1 << depth) - 1), np.int64)
        self.value = np.zeros(len(self.axis))
        parts = [sample]
        for level in range(depth):
            following = []
            for i, part in enumerate(parts):
                node = (1 << level) - 1 + i
                self.axis[node] = int(np.argmax(np.ptp(part, axis=0))) if len(part) else 0
                self.value[node] = float(np.median(part[:, self.axis[node]])) if len(part) else 0.0
                right = part[:, self.axis[node]] > self.value[node]
                following += [part[~right], part[right]]
            parts = following

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            right = points[np.arange(len(points)), self.axis[node]] > self.value[node]
            node = 2 * node + 1 + right
        return node - ((1 << self.depth) - 1)

    def reached(self, points: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a point's position and a cell that its ball may reach, by descent from the root."""
        who, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.depth):
            at, value = points[who, self.axis[node]], self.value[node]
            left, right = at - radius[who] <= value, at + radius[who] >= value
            who, node = np.concatenate((who[left], who[right])), np.concatenate((2 * node[left] + 1, 2 * node[right] + 2))
        return who, node - ((1 << self.depth) - 1)


class Leaves:
    """The lower levels: leaves of few rows with their boxes."""

    def __init__(self, points: np.ndarray):
        self.members: list[np.ndarray] = []
        stack = [np.arange(len(points))]
        while stack:
            rows = stack.pop()
            if len(rows) <= LEAF_ROWS:
                self.members.append(rows)
                continue
            axis = int(np.argmax(np.ptp(points[rows], axis=0)))
            half = len(rows) // 2
            order = np.argpartition(points[rows, axis], half)
            stack += [rows[order[:half]], rows[order[half:]]]
        self.low = np.stack([points[m].min(0) for m in self.members])
        self.high = np.stack([points[m].max(0) for m in self.members])

    def distances(self, point: np.ndarray) -> np.ndarray:
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return np.sqrt((gap * gap).sum(1))


def _stop_radius(confidence: float) -> float:
    """Projected radius, in units of the true distance, at which the chi-square test holds."""
    return float(np.sqrt(chi_square.quantile(confidence, DIMS)))


def _search_cell(data: pa.Table, queries: pa.Table, k: int, ratio: float) -> list[tuple[int, int, float]]:
    """The k best ids in this part of a cell for each query (its own among them), no further than the stopping test asks.

    Leaves are verified in order of projected distance, in steps of one, two, four and up to ``STEP`` leaves; only rows
    that reach the k-th best score so far are looked at one by one.
    """
    vectors, points = _matrix(data.column("vec")), _matrix(data.column("proj"))
    leaves = Leaves(points)
    order = np.concatenate(leaves.members)
    bounds = np.append(0, np.cumsum([len(m) for m in leaves.members]))
    vectors, ids = vectors[order], data.column("ids").take(pa.array(order)).to_pylist()
    norms, out = np.sqrt((vectors * vectors).sum(1)), []
    limits = queries.column("bound").to_numpy()
    for query_id, q, p, limit in zip(queries.column("query_id").to_pylist(), _matrix(queries.column("vec")), _matrix(queries.column("proj")), limits):
        away = leaves.distances(p)
        nearest = np.argsort(away, kind="stable")
        q_norm = np.sqrt((q * q).sum())
        best: list[tuple[float, int]] = []
        far, at, step = float(limit), 0, 1
        while at < len(nearest) and away[nearest[at]] <= ratio * far + 1e-9:
            some = nearest[at : at + step]
            rows = np.concatenate([np.arange(bounds[i], bounds[i + 1]) for i in some])
            score = (vectors[rows] @ q) / (norms[rows] * q_norm)
            least = -best[-1][0] if len(best) == k else -np.inf
            close = np.flatnonzero(score >= least)
            if len(close) > 4 * k:
                close = close[score[close] >= np.partition(score[close], -k)[-k]]
            for r in close.tolist():
                best += [(-float(score[r]), i) for i in ids[rows[r]]]
            best.sort()
            del best[k:]
            if len(best) == k:
                far = min(far, float(np.sqrt(max(0.0, 2 + 2 * best[-1][0]))))
            at, step = at + step, min(2 * step, STEP)
        out += [(query_id, i, -s) for s, i in best]
    return out


def _found(rows: list[tuple[int, int, float]]) -> pa.Table:
    return pa.table({"query_id": pa.array([r[0] for r in rows], pa.int64()), "vec_id": pa.array([r[1] for r in rows], pa.int64()), "score": pa.array([r[2] for r in rows], pa.float64())})


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_neighbours(vectors: DataFrame, queries: F.Column, k: int = 5, confidence: float = CONFIDENCE) -> DataFrame:
    """The k nearest rows by cosine for each row that satisfies ``queries``; input columns vec_id and embedding."""
    spark = vectors.sparkSession
    vec = F.col("embedding").cast("array<double>")
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(
        F.col("vec_id").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    )
    common = usable.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    width, n = common["width"], common["count"]
    matrix = projection(width)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = scaled(_matrix(batch.column("vec")))
                unit = v / np.sqrt((v * v).sum(1, keepdims=True))
                lists = [pa.array(list(m), pa.list_(pa.float64())) for m in (v, unit @ matrix)]
                others = [c for c in batch.schema.names if c != "vec"]
                yield pa.RecordBatch.from_arrays([lists[0], *(batch.column(c) for c in others), lists[1]], ["vec", *others, "proj"])

    rows = usable.filter(F.size("vec") == width).distinct()
    # of equal vectors the k + 1 smallest ids can ever be asked for (one may be the query's own)
    smallest = Window.partitionBy("vec").orderBy("vec_id")
    ranked = rows.withColumn("r", F.row_number().over(smallest)).filter(F.col("r") <= k + 1)
    distinct = ranked.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    index = distinct.mapInArrow(project, "vec array<double>, ids array<bigint>, proj array<double>")
    wanted = rows.filter(queries)
    first = materialise(wanted.groupBy("vec").agg(F.min("vec_id").alias("query_id")), "different-queries")
    members = wanted.withColumnRenamed("vec_id", "member").join(first, "vec").select("member", "query_id")
    asked = first.mapInArrow(project, "vec array<double>, query_id bigint, proj array<double>")
    index, asked = materialise(index, "projected"), materialise(asked, "queries")

    draw = F.pmod(F.xxhash64("ids"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, SAMPLE / n))
    sample = np.asarray([r["proj"] for r in index.filter(draw).select("proj").limit(2 * SAMPLE).collect()]).reshape(-1, DIMS)
    splits = Splits(sample, min(MOST_DEPTH, int(np.ceil(np.log2(max(1, n / CELL_ROWS))))))

    def celled(schema: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splits.cells(_matrix(batch.column("proj"))))], [*batch.schema.names, "cell"])

        return lambda df: df.mapInArrow(run, f"{schema}, cell bigint")

    index = celled("vec array<double>, ids array<bigint>, proj array<double>")(index)
    asked = celled("vec array<double>, query_id bigint, proj array<double>")(asked)
    sizes = index.groupBy("cell").agg(
        F.ceil(F.count("cell") / (2 * CELL_ROWS)).cast("int").alias("parts"), *(F.min(F.element_at("proj", i + 1)).alias(f"low{i}") for i in range(DIMS)), *(F.max(F.element_at("proj", i + 1)).alias(f"high{i}") for i in range(DIMS))
    )
    boxes = materialise(sizes, "cells")  # one row for each cell
    parted = index.join(F.broadcast(boxes.select("cell", "parts")), "cell").withColumn("part", F.pmod(F.xxhash64("ids"), F.col("parts")).cast("int")).drop("parts")
    parted = materialise(parted, "cells-of-rows")
    ratio = _stop_radius(confidence)

    def search(to_cells: DataFrame) -> DataFrame:
        blocks = materialise(to_cells.groupBy("cell").agg(F.ceil(F.count("cell") / BLOCK_QUERIES).cast("int").alias("blocks")), "query-blocks")  # one row for each cell
        dealt = to_cells.join(F.broadcast(boxes.select("cell", "parts")), "cell").join(F.broadcast(blocks), "cell")
        dealt = dealt.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "block": F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")})
        there = parted.join(F.broadcast(blocks), "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        key = ("cell", "part", "block")
        sides = there.groupBy(*key).cogroup(dealt.select(*key, "query_id", "vec", "proj", "bound").groupBy(*key))
        return sides.applyInArrow(lambda a, b: _found(_search_cell(a, b, k + 1, ratio) if a.num_rows and b.num_rows else []), FOUND)

    # one more than k, since a query's own row is among them
    near = materialise(_best(search(asked.withColumn("bound", F.lit(2.0))), k + 1), "own-cell")
    bound = near.filter(F.col("rank") == k + 1).select("query_id", F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))
    bounded = asked.join(bound, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(2.0)))
    lows, highs = np.full((1 << splits.depth, DIMS), np.inf), np.full((1 << splits.depth, DIMS), -np.inf)
    for r in boxes.collect():  # at most 2**MOST_DEPTH cells
        lows[r["cell"]], highs[r["cell"]] = [r[f"low{i}"] for i in range(DIMS)], [r[f"high{i}"] for i in range(DIMS)]

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points, radius = _matrix(batch.column("proj")), ratio * batch.column("bound").to_numpy() + 1e-9
            for a in range(0, len(points), 256):
                who, cell = splits.reached(points[a : a + 256], radius[a : a + 256])
                who += a
                gap = np.maximum(np.maximum(lows[cell] - points[who], points[who] - highs[cell]), 0)
                near_enough = (np.sqrt((gap * gap).sum(1)) <= radius[who]) & (cell != batch.column("cell").to_numpy()[who])
                rows = batch.select(["query_id", "vec", "proj", "bound"]).take(pa.array(who[near_enough]))
                yield pa.RecordBatch.from_arrays([pa.array(cell[near_enough]), *rows.columns], ["cell", *rows.schema.names])

    reached = bounded.mapInArrow(descend, "cell bigint, query_id bigint, vec array<double>, proj array<double>, bound double")
    every = near.select("query_id", "vec_id", "score").unionByName(search(reached))
    found = _best(every, k + 1).drop("rank").join(members, "query_id").filter(F.col("vec_id") != F.col("member"))
    return _best(found.select(F.col("member").alias("query_id"), "vec_id", "score"), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest rows of ``embeddings`` for every row whose id is divisible by 50."""
    return nearest_neighbours(documents(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)
