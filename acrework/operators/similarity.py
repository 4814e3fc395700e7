"""Exact nearest rows by cosine with a pivot index and the triangle inequality."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from acrework.functions.storage import cut_lineage

#: Pivots at most, drawn by a hash among at most ``DRAWN`` rows; with the figures of their cells they go to every task.
PIVOTS, DRAWN = 256, 20_000
#: Rows, and queries, that meet in one task.
ROWS_EACH, QUERIES_EACH = 20_000, 4_000
#: What rounding may add to a distance; bounds are widened by it, so that no row is lost.
SLACK = 1e-7


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    v = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    v = np.ldexp(v, -np.frexp(np.abs(v).max(1, keepdims=True, initial=0))[1])
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


class Pivots:
    """The pivots, and of each one's cell how near and how far its rows are, and the distances of its k nearest."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.between = vectors, _apart(vectors, vectors)
        self.low, self.high = np.full(len(vectors), np.inf), np.full(len(vectors), -np.inf)
        self.first = np.zeros(0), np.zeros(0, np.int64)

    def describe(self, cells: list[tuple[int, float, float, list[float]]]) -> None:
        for cell, low, high, _ in cells:
            self.low[cell], self.high[cell] = low, high
        near = [(r, cell) for cell, _, _, rs in cells for r in rs]
        self.first = np.asarray([r for r, _ in near]), np.asarray([c for _, c in near], np.int64)

    def limit(self, away: np.ndarray, k: int) -> np.ndarray:
        """A distance within which each query surely has k rows (and itself)."""
        far = away[:, self.first[1]] + self.first[0]
        return np.partition(far, k, axis=1)[:, k] + SLACK if far.shape[1] > k else np.full(len(away), 2.0 + SLACK)

    def reached(self, away: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a query and a cell that may hold a row within its limit."""
        own = away.argmin(1)
        outside = np.maximum(away - self.high, self.low - away)
        with np.errstate(divide="ignore", invalid="ignore"):  # beyond the plane between two pivots
            plane = (away**2 - away.min(1, keepdims=True) ** 2) / (2 * self.between[own])
        plane[~np.isfinite(plane)] = 0
        return np.nonzero(np.maximum(outside, plane) <= limit[:, None] + SLACK)


def _best(df: DataFrame, left_id: str, right_id: str, k: int) -> DataFrame:
    order = Window.partitionBy(left_id).orderBy(F.desc("score"), right_id)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_by_cosine(left: DataFrame, right: DataFrame, left_id: str, right_id: str, vector: str, k: int, compared: list[int] | None = None) -> DataFrame:
    """The k right rows of largest cosine for each left row: ids, ``score`` and ``rank``; equal ids never meet.

    Right rows belong to the cell of their nearest pivot.  The k nearest of each cell give every query a distance within
    which it surely has k rows; it is sent only to cells that reach into it, and there compared only with rows whose
    distance to the pivot differs by less.  Each task keeps the k best of its queries, so only these are shuffled.  The
    result is exact whatever the data; how much is left out depends on them (clustered vectors much, vectors of random
    direction in many dimensions next to nothing).  Cells are dealt to parts and their queries to blocks by number.
    Vectors that are null, empty, zero or hold a null or non-finite component take no part, nor do others than the most
    common length; ids are unique and not null.  ``compared`` receives the number of pairs whose cosine was taken.
    """
    vec = F.col(vector).cast("array<double>").alias("vec")
    fit = F.col("vec").isNotNull() & (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows, asked = right.select(right_id, vec).filter(fit), left.select(left_id, vec).filter(fit)
    common = rows.groupBy(F.size("vec").alias("width")).count().orderBy(F.desc("count"), "width").first()
    spark = right.sparkSession
    kinds = [left.schema[left_id], right.schema[right_id]]
    if common is None:
        return spark.createDataFrame([], StructType([*kinds])).withColumns({"score": F.lit(0.0), "rank": F.lit(0)})
    rows, asked = rows.filter(F.size("vec") == common["width"]), asked.filter(F.size("vec") == common["width"])
    draw = F.pmod(F.xxhash64("vec"), F.lit(1_000_003)) < int(1_000_003 * min(1.0, DRAWN / common["count"])) + 1
    sample = rows.filter(draw).select("vec").distinct().orderBy(F.xxhash64("vec")).limit(min(PIVOTS, max(1, int(common["count"] ** 0.5)))).collect()
    pivots = Pivots(_unit(pa.array([r["vec"] for r in sample], pa.list_(pa.float64()))))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _apart(_unit(batch.column("vec")), pivots.vectors)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(away[np.arange(len(cell)), cell])], [*batch.schema.names, "cell", "radius"])

    index = cut_lineage(rows.mapInArrow(placed, StructType([*rows.schema.fields, *StructType.fromDDL("cell long, radius double").fields])), "pivot-cells")
    nearest = Window.partitionBy("cell").orderBy("radius")
    first = index.select("cell", "radius").withColumn("_r", F.row_number().over(nearest)).filter(F.col("_r") <= k + 1).groupBy("cell").agg(F.collect_list("radius").alias("first"))
    cells = cut_lineage(index.groupBy("cell").agg(F.min("radius").alias("low"), F.max("radius").alias("high"), F.ceil(F.count("*") / ROWS_EACH).cast("int").alias("parts")).join(first, "cell"), "pivot-figures")
    pivots.describe([(r["cell"], r["low"], r["high"], r["first"]) for r in cells.collect()])  # one row for each pivot

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                away = _apart(_unit(batch.column("vec")), pivots.vectors)
                limit = pivots.limit(away, k)
                who, cell = pivots.reached(away, limit)
                again = batch.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(cell), pa.array(away[who, cell]), pa.array(limit[who])], [*batch.schema.names, "cell", "radius", "limit"])

    queries = asked.mapInArrow(sent, StructType([*asked.schema.fields, *StructType.fromDDL("cell long, radius double, limit double").fields]))
    queries = cut_lineage(queries, "pivot-queries")
    blocks = cut_lineage(queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERIES_EACH).cast("int").alias("blocks")).join(cells.select("cell", "parts"), "cell"), "pivot-blocks")
    few = F.broadcast(blocks)  # one row for each pivot
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = index.join(few, "cell").withColumns({"part": F.pmod(F.xxhash64(right_id), F.col("parts")).cast("int"), "block": spread("blocks")})
    here = queries.join(few, "cell").withColumns({"block": F.pmod(F.xxhash64(left_id), F.col("blocks")).cast("int"), "part": spread("parts")})
    key = ("cell", "part", "block")
    out = StructType([*kinds, *StructType.fromDDL("score double, pairs long").fields])

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        """The k best rows of a part for each query of a block; one more row tells how many pairs were compared."""
        ids, own = b.column(right_id), a.column(left_id)
        v, q = _unit(b.column("vec").combine_chunks()), _unit(a.column("vec").combine_chunks())
        radius, order = b.column("radius").to_numpy(), np.argsort(b.column("radius").to_numpy(), kind="stable")
        v, radius, ids = v[order], radius[order], ids.take(pa.array(order))
        plain, mine, found, pairs = ids.to_numpy(), own.to_numpy(), [], 0
        for i, (r, limit) in enumerate(zip(a.column("radius").to_numpy(), a.column("limit").to_numpy())):
            low, high = np.searchsorted(radius, r - limit, "left"), np.searchsorted(radius, r + limit, "right")
            score = v[low:high] @ q[i]
            pairs += high - low
            score[plain[low:high] == mine[i]] = -np.inf
            best = np.lexsort((plain[low:high], -score))[:k] if high - low <= 4 * k else None
            if best is None:
                close = np.flatnonzero(score >= np.partition(score, -k)[-k])
                best = close[np.lexsort((plain[low:high][close], -score[close]))[:k]]
            best = best[score[best] > -np.inf]
            found.append((np.full(len(best), i), low + best, score[best]))
        who, which, score = (np.concatenate(c) for c in zip(*found))
        columns = [own.take(pa.array(who)).combine_chunks(), ids.take(pa.array(which)).combine_chunks(), pa.array(score), pa.array(np.full(len(who), 0))]
        count = [pa.nulls(1, columns[0].type), pa.nulls(1, columns[1].type), pa.nulls(1, pa.float64()), pa.array([pairs])]
        return pa.table([pa.concat_arrays([x, y]) for x, y in zip(columns, count)], names=[left_id, right_id, "score", "pairs"])

    empty = pa.table({left_id: [], right_id: [], "score": [], "pairs": []})
    both = here.select(*key, left_id, "vec", "radius", "limit").groupBy(*key).cogroup(there.select(*key, right_id, "vec", "radius").groupBy(*key))
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(out)
    found = cut_lineage(both.applyInArrow(lambda a, b: met(a, b).cast(shape) if a.num_rows and b.num_rows else empty.cast(shape), StructType([StructField(f.name, f.dataType) for f in out.fields])), "pivot-found")
    if compared is not None:
        compared.append(found.agg(F.coalesce(F.sum("pairs"), F.lit(0).cast(LongType()))).first()[0])
    return _best(found.filter(F.col(left_id).isNotNull()).drop("pairs"), left_id, right_id, k)
