"""Cosine search for many queries at once, and exact search that skips most of the vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructType

from carlake.operators.reshape import union_all

QUERY_BLOCK = 1024  # queries that a task holds at once
SLACK = 1e-9  # what rounding may change in a score or a distance
PIVOTS = 64
SAMPLE = 20_000  # rows that pivots are chosen among, at most
PARTITION = "_pivot"


def _matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors as rows, and which rows have a direction: no null, no other width, no zero vector."""
    whole = np.zeros((len(column), width))
    lists = column if isinstance(column, pa.ListArray) else pa.chunked_array([column]).combine_chunks()
    lengths = np.diff(lists.offsets.to_numpy())
    good = (lengths == width) & ~np.asarray(lists.is_null())
    flat = lists.values.to_numpy(zero_copy_only=False).astype(float)
    starts = lists.offsets.to_numpy()[:-1][good]
    whole[good] = flat[starts[:, None] + np.arange(width)]
    length = np.sqrt((whole * whole).sum(axis=1))
    good &= np.isfinite(length) & (length > 0)
    whole[good] /= length[good, None]
    return whole, good


class Best:
    """The k best rows of each query so far: highest score, then smallest id."""

    def __init__(self, queries: np.ndarray, k: int) -> None:
        self.queries, self.k = queries, k
        self.scores = [np.empty(0)] * len(queries)
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        self.least = np.full(len(queries), -np.inf)  # what a row needs at least

    def take(self, vectors: np.ndarray, ids: np.ndarray) -> None:
        rough = vectors @ self.queries.T
        for q in np.flatnonzero((rough >= self.least - SLACK).any(axis=0)):
            rows = np.flatnonzero(rough[:, q] >= self.least[q] - SLACK)
            # summed row by row, so that equal vectors have equal scores wherever they stand
            scores = np.concatenate([self.scores[q], (vectors[rows] * self.queries[q]).sum(axis=1)])
            names = np.concatenate([self.ids[q], ids[rows]])
            best = np.lexsort((names, -scores))[: self.k]
            self.scores[q], self.ids[q] = scores[best], names[best]
            if len(best) == self.k:
                self.least[q] = scores[best[-1]]


def _blocks(queries: DataFrame, id_col: str, vector: str, size: int) -> Iterator[tuple[list, np.ndarray]]:
    """Queries in blocks of ``size``, unit length; those without a direction find nothing."""
    rows = queries.select(id_col, vector).toLocalIterator()
    while block := list(islice(rows, size)):
        found = [(r[0], np.array(r[1], float)) for r in block if r[1] is not None and None not in r[1]]
        found = [(name, v / np.linalg.norm(v)) for name, v in found if np.linalg.norm(v) > 0]
        by_width: dict[int, list] = {}
        for name, v in found:
            by_width.setdefault(len(v), []).append((name, v))
        for same in by_width.values():
            yield [name for name, _ in same], np.array([v for _, v in same])


def vector_topk_many(
    df: DataFrame, queries: DataFrame, k: int = 3, vector: str = "embedding", tie: str = "vec_id", query_id: str = "query_id", block: int = QUERY_BLOCK
) -> DataFrame:
    """(query_id, rank, tie, score): for every row of ``queries`` the ``k`` rows closest by cosine, ties by smallest id.

    The queries go through the table in blocks: a task scores each batch of rows against the whole block and keeps
    the best k rows of each query, so it sends on k rows a query at most, however many rows it has read. More than
    ``block`` queries take a pass over the table for each block. ``tie`` is a number. Rows and queries without
    a direction (null, zero) have no cosine and are left out, as are vectors of another width."""
    found = best_of_tasks(df, queries, k, vector, tie, query_id, block)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), F.asc(tie))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_id, "rank", tie, "score")


def best_of_tasks(df: DataFrame, queries: DataFrame, k: int, vector: str, tie: str, query_id: str, block: int) -> DataFrame:
    """(query_id, tie, score): the best rows each task has seen for each query."""
    out = f"{query_id} {dict(queries.dtypes)[query_id]}, {tie} long, score double"

    def search(names: list, matrix: np.ndarray):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(matrix, k)
            for batch in batches:
                vectors, good = _matrix(batch.column(1), matrix.shape[1])
                best.take(vectors[good], batch.column(0).to_numpy(zero_copy_only=False)[good])
            counts = [len(s) for s in best.scores]
            owner = pa.array([n for n, c in zip(names, counts) for _ in range(c)])
            columns = [owner, pa.array(np.concatenate(best.ids), pa.int64()), pa.array(np.concatenate(best.scores))]
            yield pa.RecordBatch.from_arrays(columns, names=[query_id, tie, "score"])

        return run

    rows = df.where(F.col(tie).isNotNull()).select(F.col(tie).cast("long").alias(tie), vector)
    parts = [rows.mapInArrow(search(names, matrix), out) for names, matrix in _blocks(queries, query_id, vector, block)]
    return union_all(*parts) if parts else df.sparkSession.createDataFrame([], out)


# --- pivots -----------------------------------------------------------------------------


def choose_pivots(df: DataFrame, vector: str, n: int, seed: int = 1) -> np.ndarray:
    """Unit vectors far from each other, among at most SAMPLE rows: each next one is the furthest from those chosen."""
    share = min(1.0, 1.2 * SAMPLE / max(1, df.count()))
    rows = df.where(F.col(vector).isNotNull()).select(vector).sample(share, seed).limit(SAMPLE).toArrow().column(0)
    widths = [len(v) for v in rows.to_pylist()]
    if not widths:
        return np.zeros((0, 1))
    unit, good = _matrix(rows.combine_chunks(), max(set(widths), key=widths.count))
    unit = unit[good]
    if not len(unit):
        return np.zeros((0, 1))
    chosen, distance = [0], np.linalg.norm(unit - unit[0], axis=1)
    while len(chosen) < n and distance.max() > SLACK:
        chosen.append(int(distance.argmax()))
        distance = np.minimum(distance, np.linalg.norm(unit - unit[chosen[-1]], axis=1))
    return unit[chosen]


def write_pivots(df: DataFrame, path: str, vector: str = "embedding", n: int = PIVOTS) -> None:
    """Writes the rows in partitions by their nearest pivot, and beside them each partition's pivot, radius and size.

    Rows without a direction lie in partition -1. A pivot that draws a third of all rows is a large partition of many
    files, not one task: rows are written where they are read."""
    pivots = choose_pivots(df, vector, n)
    schema = StructType([*df.schema.fields]).add(PARTITION, IntegerType()).add("_distance", DoubleType())
    at = df.columns.index(vector)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit, good = _matrix(batch.column(at), pivots.shape[1])
            nearest, distance = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            if len(pivots):
                apart = np.sqrt(np.maximum(0, 2 - 2 * unit @ pivots.T))
                nearest = np.where(good, apart.argmin(axis=1), -1).astype(np.int32)
                distance = np.linalg.norm(unit - pivots[np.maximum(nearest, 0)], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nearest), pa.array(distance)], names=[*batch.schema.names, PARTITION, "_distance"])

    df.mapInArrow(assign, schema).write.mode("overwrite").partitionBy(PARTITION).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    sizes = rows.groupBy(PARTITION).agg(F.max("_distance").alias("radius"), F.count("*").alias("n"))
    centres = df.sparkSession.createDataFrame([(i, p.tolist()) for i, p in enumerate(pivots)], f"{PARTITION} int, pivot array<double>")
    sizes.join(centres, PARTITION, "left").write.mode("overwrite").parquet(f"{path}/pivots")


def plan_partitions(pivots: list, unit: np.ndarray, k: int) -> list[tuple[float, int, int]]:
    """(least possible distance to the query, partition, rows), nearest first; ``pivots`` are rows of write_pivots."""
    out = []
    for p in pivots:
        if p["pivot"] is not None:
            reach = float(np.linalg.norm(unit - np.array(p["pivot"])))
            out.append((max(0.0, reach - p["radius"] - SLACK), p[PARTITION], p["n"]))
    return sorted(out)


def pivot_topk(spark: SparkSession, path: str, query: list[float], k: int = 3, vector: str = "embedding", tie: str = "vec_id") -> tuple[DataFrame, dict]:
    """The rows that ``vector_topk`` gives, out of the partitions that may hold them; also says what was read.

    By the triangle inequality no row of a partition is nearer than the query is to its pivot, less the radius. The partitions
    nearest by that bound are read until they hold k rows; their k-th distance then rules out every partition
    whose bound is larger. What is left is read, and no row that belongs to the result can lie elsewhere."""
    unit = np.array(query, float)
    unit /= np.linalg.norm(unit)
    order = plan_partitions(spark.read.parquet(f"{path}/pivots").collect(), unit, k)  # one row a pivot
    rows = spark.read.parquet(f"{path}/rows")
    score = F.try_divide(_dot(F.col(vector), unit), F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))))

    def best(partitions: list[int]) -> DataFrame:
        chosen = rows.where(F.col(PARTITION).isin(partitions)).drop(PARTITION, "_distance")
        return chosen.withColumn("score", score).orderBy(F.desc_nulls_last("score"), F.asc(tie)).limit(k)

    first, held = [], 0
    for _, partition, n in order:
        if held >= k:
            break
        first.append(partition)
        held += n
    found = [r["score"] for r in best(first).select("score").collect()]
    reach = np.inf if len(found) < k else np.sqrt(max(0.0, 2 - 2 * found[-1])) + SLACK**0.5
    wanted = [p for bound, p, _ in order if bound <= reach or p in first]
    read = sum(n for _, p, n in order if p in wanted)
    return best(wanted), {"partitions": len(order), "read": len(wanted), "rows": sum(n for *_, n in order), "rows_read": read}


def _dot(column, unit: np.ndarray):
    pairs = F.zip_with(column, F.array(*[F.lit(float(x)) for x in unit]), lambda x, y: x.cast("double") * y)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)
