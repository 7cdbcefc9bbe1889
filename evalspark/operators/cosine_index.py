"""Exact top-k by cosine similarity over pivot cells.

Pool vectors belong to the cell of their nearest pivot; a cell knows the
range of angles between its members and the pivot. A query at angle a to the
pivot can't be nearer to any member than max(a - widest, narrowest - a, 0),
whose cosine bounds the cell's best score. Two rounds of Spark joins:

1. a query visits its best cells by bound until they hold more than k
   vectors; the k-th score found is a floor under the final one;
2. it visits every cell whose bound reaches that floor.

A vector doesn't travel once per cell: cells lie one after the other in
``REGIONS`` regions, queries are dealt to as many chunks, and a task joins a
region with a chunk. A query goes once to each region that has a cell to
visit, a pool vector once to each chunk, so what is shuffled is a fixed number
of copies of the tables however many cells there are (until regions reach
``TASK_ROWS``, which bounds a task's memory; then there are more of them).
Within a task neighbouring queries are taken together, and only the cells that
one of them visits are scored. A cell larger than a region is spread over several. Copies of a pool vector are cut
to the k + 1 lowest ids first (no more can be returned, one may be the query
itself).

Scores are compared after rounding to 1e-9; ties go to the lower pool id.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SCORE_DIGITS = 9
SLACK = 1e-7             # bounds come from arc cosines, which are off by up to 2e-8 near 1
CELL_ROWS = 4096         # wanted vectors of a cell
CHUNK_ROWS = 20_000      # queries of a task that are scored together, at most
REGIONS = 8              # regions of the pool, and chunks of the queries
REGION_ROWS = 256        # smaller tables have fewer
TASK_ROWS = 200_000      # larger ones more
PIVOT_BYTES = 32 << 20   # pivots, and the sample they're drawn from, are never larger
SAMPLE_FACTOR = 16       # sampled vectors per pivot
ROUNDS = 4
SUB_BATCH = 512
SCORES = 1 << 21         # scores that a task holds at once


def _parts(rows: int) -> int:
    """Number of regions, or chunks, of a table."""
    return max(1, min(REGIONS, rows // REGION_ROWS), math.ceil(rows / TASK_ROWS))


def l2_normalize(vec: Column | str) -> Column:
    """Unit-length copy of a numeric array (zero vectors stay zero)."""
    v = F.col(vec) if isinstance(vec, str) else vec
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(F.lit(0.0)))


def _usable(v: str) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(v) > 0) & ~bad, F.lit(False))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Cells(NamedTuple):
    """Per length of vector: pivots as rows, first cell number; per cell: vectors and range of cosines to the pivot.

    Cell number first + len(pivots) holds the zero vectors of a length.
    """

    pivots: dict[int, np.ndarray]
    first: dict[int, int]
    size: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def bounds(self, dim: int, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores in each cell of a length, zero vectors last."""
        at = self.first[dim]
        here = slice(at, at + len(self.pivots[dim]))
        angle = np.arccos(np.clip(queries @ self.pivots[dim].T, -1, 1))
        near = np.maximum(np.maximum(angle - np.arccos(self.low[here]), np.arccos(self.high[here]) - angle), 0)
        near = np.where(self.size[here] > 0, np.cos(np.minimum(near, math.pi)), -2.0)
        return np.column_stack([near, np.zeros(len(queries))])

    def visits(self, dim: int, queries: np.ndarray, k: int, floor: np.ndarray | None) -> np.ndarray:
        """Which cells each query visits: in the first round (no floor) its best ones until they hold over k vectors."""
        at = self.first[dim]
        size = self.size[at:at + len(self.pivots[dim]) + 1]
        bound = self.bounds(dim, queries)
        if floor is not None:
            return (size > 0) & (bound >= floor[:, None] - SLACK)
        order = np.argsort(-bound, axis=1, kind="stable")
        before = np.cumsum(size[order], axis=1) - size[order]
        begun = np.zeros(bound.shape, bool)
        np.put_along_axis(begun, order, before <= k, axis=1)
        return begun & (size > 0)

    def spans(self, regions: int) -> tuple[np.ndarray, np.ndarray]:
        """First and last region of every cell, when the pool's rows lie cell after cell in regions of equal size."""
        end = np.cumsum(self.size)
        rows = max(1, int(end[-1]) if len(end) else 1)
        place = lambda at: np.clip(at * regions // rows, 0, regions - 1)
        return place(end - self.size), place(np.maximum(end - 1, end - self.size))


def _pivots(sample: np.ndarray, m: int) -> np.ndarray:
    """``m`` unit pivots: the first ones of the sample, moved to their cells' means a few times."""
    pivots = sample[:m].copy()
    for _ in range(ROUNDS):
        cell = (sample @ pivots.T).argmax(axis=1)
        sums = np.zeros_like(pivots)
        np.add.at(sums, cell, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        pivots = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), pivots)
    return pivots


def _assign(pool: DataFrame, cells: _Cells) -> DataFrame:
    """(pid, v, cell, cosine) of pool vectors."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _matrix(part.column("v"))
                dots = x @ cells.pivots[dim].T
                cell, zero = dots.argmax(axis=1), ~x.any(axis=1)
                best = dots[np.arange(len(x)), cell]
                cell = cells.first[dim] + np.where(zero, dots.shape[1], cell)
                yield pa.RecordBatch.from_arrays([part.column("pid"), part.column("v"), pa.array(cell), pa.array(np.where(zero, 0.0, best))],
                                                 ["pid", "v", "cell", "cosine"])

    return pool.mapInArrow(run, "pid long, v array<double>, cell long, cosine double")


def _visits(queries: DataFrame, cells: _Cells, k: int, first_round: bool, regions: int = 1) -> DataFrame:
    """(qid, v, dim, floor, region, cells) for every region that a query visits, with its cells there.

    The second round reads the column ``floor``; its tasks find the cells again, which may be many, from it.
    """
    qtype = queries.schema["qid"].dataType.simpleString()
    low, high = cells.spans(regions)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, SUB_BATCH):
                batch = whole.slice(a, SUB_BATCH)
                dims = batch.column("dim").to_numpy()
                for dim in np.unique(dims).tolist():
                    if dim not in cells.pivots:
                        continue
                    part = batch.filter(pa.array(dims == dim))
                    floor = None if first_round else part.column("floor").to_numpy(zero_copy_only=False)
                    seen = cells.visits(dim, _matrix(part.column("v")), k, floor)
                    numbers = np.arange(seen.shape[1]) + cells.first[dim]
                    for region in range(regions):
                        here = seen & (low[numbers] <= region) & (region <= high[numbers])
                        goes = np.flatnonzero(here.any(axis=1))
                        if not len(goes):
                            continue
                        row, cell = np.nonzero(here[goes] if first_round else np.zeros((len(goes), 0), bool))
                        at = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(goes)))])
                        listed = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(cell + cells.first[dim]))
                        rows = part.take(pa.array(goes))
                        yield pa.RecordBatch.from_arrays(
                            [rows.column("qid"), rows.column("v"), rows.column("dim"), pa.array(np.full(len(goes), -2.0) if floor is None else floor[goes]),
                             pa.array(np.full(len(goes), region, np.int32)), listed], ["qid", "v", "dim", "floor", "region", "cells"])

    return queries.mapInArrow(run, f"qid {qtype}, v array<double>, dim int, floor double, region int, cells array<bigint>")


def _score(visits: DataFrame, pool: DataFrame, cells: _Cells, k: int, exclude_self: bool, first_round: bool, regions: int, chunks: int,
           chunk_rows: int) -> DataFrame:
    """(qid, pid, score): the k best of every query in each region that it visits."""
    qtype = visits.schema["qid"].dataType.simpleString()
    qkind = visits.limit(0).select("qid").toArrow().schema.field("qid").type
    left = visits.withColumn("chunk", F.pmod(F.xxhash64("qid"), chunks).cast("int"))
    right = pool.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def best(row: np.ndarray, pid: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best of every row."""
        order = np.lexsort((pid, -np.round(score, SCORE_DIGITS), row))
        row, pid, score = row[order], pid[order], score[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[kept], pid[kept], score[kept]

    def some(part: pa.Table, pid: np.ndarray, v: np.ndarray, members: np.ndarray) -> Iterator[tuple]:
        """Candidates of some queries among the given rows of ``v``, a bounded number of scores at a time."""
        x, qid = _matrix(part.column("v")), part.column("qid").combine_chunks()
        floor = part.column("floor").to_numpy() - SLACK
        step = max(1, SCORES // len(x))
        for a in range(0, len(members), step):
            here = members[a:a + step]
            scores = x @ v[here].T
            least = floor
            if len(here) > k + 1 and np.count_nonzero(scores >= least[:, None]) > 2 * k * len(x):     # one may be the query itself
                least = np.maximum(least, np.partition(scores, -k - 1, axis=1)[:, -k - 1] - SLACK)
            row, col = np.nonzero(scores >= least[:, None])
            if exclude_self and pa.types.is_integer(qid.type):          # other ids equal no pool id
                other = qid.to_numpy(zero_copy_only=False)[row] != pid[here[col]]
                row, col = row[other], col[other]
            yield best(row, pid[here[col]], scores[row, col])

    def run(q: pa.Table, p: pa.Table) -> pa.Table:
        found: list[tuple] = []
        dims, places = q.column("dim").to_numpy(), p.column("cell").to_numpy()
        for dim in np.unique(dims).tolist():
            at, width = cells.first[dim], len(cells.pivots[dim]) + 1
            kin = p.filter(pa.array((places >= at) & (places < at + width)))
            if not kin.num_rows:
                continue
            pid, v, cell = kin.column("pid").to_numpy(), _matrix(kin.column("v")), kin.column("cell").to_numpy() - at
            asked = q.filter(pa.array(dims == dim))
            nearest = np.concatenate([cells.bounds(dim, _matrix(asked.column("v").slice(a, SUB_BATCH))).argmax(axis=1)
                                      for a in range(0, asked.num_rows, SUB_BATCH)])
            asked = asked.take(pa.array(np.argsort(nearest, kind="stable")))      # neighbours ask the same cells
            size = max(1, min(SUB_BATCH, chunk_rows))
            for a in range(0, asked.num_rows, size):
                part = asked.slice(a, size).combine_chunks()
                visited = np.zeros(width, bool)
                if first_round:
                    visited[part.column("cells").combine_chunks().flatten().to_numpy() - at] = True
                else:
                    visited = cells.visits(dim, _matrix(part.column("v")), k, part.column("floor").to_numpy()).any(axis=0)
                got = list(some(part, pid, v, np.flatnonzero(visited[cell])))
                if got:
                    row, ids, score = best(*(np.concatenate([g[i] for g in got]) for i in range(3)))
                    found.append((part.column("qid").combine_chunks().take(pa.array(row)), ids, score))
        return pa.table([pa.chunked_array([f[0] for f in found], qkind), pa.array(np.concatenate([f[1] for f in found]) if found else [], pa.int64()),
                         pa.array(np.concatenate([f[2] for f in found]) if found else [], pa.float64())], names=["qid", "pid", "score"])

    keys = ["region", "chunk"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, f"qid {qtype}, pid long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc(F.round("score", SCORE_DIGITS)), F.asc("pid"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class CosineIndex:
    """Pool vectors in pivot cells, for exact top-k queries.

    Pool rows whose vector is null, empty or holds a null or non-finite
    component are left out; zero vectors score 0 with everything. Vectors
    are compared with those of their own length only.
    """

    def __init__(self, pool: DataFrame, k: int, pool_id: str, vector: str, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> None:
        self.k, self.cell_rows, self.chunk_rows = k, cell_rows, chunk_rows
        unit = (pool.filter(_usable(vector)).select(F.col(pool_id).cast("bigint").alias("pid"), l2_normalize(vector).alias("v")))
        copies = Window.partitionBy("v").orderBy("pid")
        unit = unit.withColumn("copy", F.row_number().over(copies)).filter(F.col("copy") <= k + 1).select("pid", "v", F.size("v").alias("dim"))
        unit = unit.checkpoint()
        pivots, first, at = {}, {}, 0
        for r in sorted(unit.groupBy("dim").agg(F.count("*").alias("n")).collect()):
            dim = r["dim"]
            most = max(1, PIVOT_BYTES // (8 * dim))
            m = max(1, min(math.ceil(r["n"] / cell_rows), most // SAMPLE_FACTOR))
            rows = (unit.filter((F.col("dim") == dim) & F.exists("v", lambda x: x != 0)).orderBy(F.xxhash64("pid"), "pid").limit(m * SAMPLE_FACTOR)
                    .select("v").toArrow().column("v"))
            sample = _matrix(rows) if len(rows) else np.ones((1, dim)) / math.sqrt(dim)
            pivots[dim], first[dim] = _pivots(sample, min(m, len(sample))), at
            at += len(pivots[dim]) + 1
        size, low, high = np.zeros(at, np.int64), np.ones(at), np.ones(at)
        self.pool = _assign(unit, _Cells(pivots, first, size, low, high)).checkpoint()
        for r in self.pool.groupBy("cell").agg(F.count("*").alias("n"), F.min("cosine").alias("low"), F.max("cosine").alias("high")).collect():
            size[r["cell"]], low[r["cell"]], high[r["cell"]] = r["n"], np.clip(r["low"], -1, 1), np.clip(r["high"], -1, 1)
        self.cells = _Cells(pivots, first, size, low, high)

    def top(self, queries: DataFrame, query_id: str, vector: str, exclude_self: bool = False) -> DataFrame:
        """(qid, rank, pid, score): the k best pool rows of every query row; ids of queries are distinct.

        A query whose vector isn't usable, or whose length the pool doesn't
        have, has no rows. With ``exclude_self`` a pool row of the query's id is
        passed over.
        """
        rows = (queries.filter(_usable(vector)).select(F.col(query_id).alias("qid"), l2_normalize(vector).alias("v"))
                .withColumn("dim", F.size("v")))
        first = self._found(rows, True, exclude_self).checkpoint()
        floors = first.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("least"))
        floor = F.when(F.col("n") >= self.k, F.col("least")).otherwise(-2.0)
        again = rows.join(floors, "qid", "left").withColumn("floor", F.coalesce(floor, F.lit(-2.0)))
        return self._found(again, False, exclude_self)

    def _found(self, rows: DataFrame, first_round: bool, exclude_self: bool) -> DataFrame:
        regions, chunks = _parts(int(self.cells.size.sum())), _parts(rows.count())
        visits = _visits(rows, self.cells, self.k, first_round, regions)
        return _ranked(_score(visits, self._regions(regions), self.cells, self.k, exclude_self, first_round, regions, chunks, self.chunk_rows), self.k)

    def _regions(self, regions: int) -> DataFrame:
        """The pool with each row's region; rows of a cell that spans several are dealt by id."""
        low, high = self.cells.spans(regions)
        spans = self.pool.sparkSession.createDataFrame([(i, int(a), int(b - a) + 1) for i, (a, b) in enumerate(zip(low, high))],
                                                       "cell bigint, low int, many int")
        return (self.pool.join(F.broadcast(spans), "cell")
                .select("pid", "v", "cell", (F.col("low") + F.pmod(F.xxhash64("pid"), F.col("many"))).cast("int").alias("region")))

    def share_scored(self, queries: DataFrame, query_id: str, vector: str, exclude_self: bool = False) -> float:
        """Share of all (query, pool) pairs whose score :meth:`top` computes."""
        rows = (queries.filter(_usable(vector)).select(F.col(query_id).alias("qid"), l2_normalize(vector).alias("v")).withColumn("dim", F.size("v")))
        first = self._found(rows, True, exclude_self).checkpoint()
        floors = first.groupBy("qid").agg(F.when(F.count("*") >= self.k, F.min("score")).otherwise(-2.0).alias("floor"))
        again = rows.join(floors, "qid", "left").withColumn("floor", F.coalesce("floor", F.lit(-2.0)))
        cells, k = self.cells, self.k

        def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dim").to_numpy()
                for dim in [d for d in np.unique(dims).tolist() if d in cells.pivots]:
                    part = batch.filter(pa.array(dims == dim))
                    at, x = cells.first[dim], _matrix(part.column("v"))
                    seen = cells.visits(dim, x, k, None) | cells.visits(dim, x, k, part.column("floor").to_numpy(zero_copy_only=False))
                    yield pa.RecordBatch.from_arrays([pa.array(seen @ cells.size[at:at + seen.shape[1]])], ["n"])

        total = again.mapInArrow(pairs, "n long").agg(F.sum("n")).first()[0] or 0
        return total / max(1, rows.count() * int(self.cells.size.sum()))


def topk_cosine(queries: DataFrame, pool: DataFrame, k: int, query_id: str, pool_id: str, vector: str,
                exclude_self: bool = False, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The ``k`` pool rows most cosine-similar to each query (``k`` capped at the pool size).

    Returns ``query_id, rank (1-based), pool_id, score``. An empty pool or
    ``k <= 0`` gives no rows. With ``exclude_self`` a row is never its own
    neighbour (for self-similarity over one table). Null, empty or
    non-finite vectors neither ask nor answer.
    """
    if k <= 0:
        kind = queries.schema[query_id].dataType.simpleString()
        return queries.sparkSession.createDataFrame([], f"`{query_id}` {kind}, rank int, `{pool_id}` bigint, score double")
    index = CosineIndex(pool, k, pool_id, vector, cell_rows, chunk_rows)
    return index.top(queries, query_id, vector, exclude_self).select(F.col("qid").alias(query_id), "rank", F.col("pid").alias(pool_id), "score")
