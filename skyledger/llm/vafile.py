"""Exact top-k by inner product with vector-approximation files.

1. Every dimension is cut into 256 cells of equal width between its least and largest value. The
   approximation file is a table of chunks: ids, a hash of the exact vector and the cells, a byte a
   dimension, packed for up to 8,192 vectors. It is written once; exact vectors stay where they are.
2. Queries, a stated set, meet all chunks in passes of as many queries as 32 MB hold, sent to the tasks
   once a pass. Only cells are scanned: the score of the cells' middles, less and plus the sum of |q|
   times half a cell, bounds each score. A task leaves, for each query, what its own k-th lower bound
   can't rule out.
3. Exact vectors are read in the order of their upper bounds, in two joins: first the k leading
   candidates of each query, whose k-th exact score is a floor; then those whose upper bound reaches
   it. So the result is certain.

Many equal vectors: of vectors with one hash and equal cells a task keeps, for each query, the 2k of
the smallest ids, k at most of one id. Others can't be among the k best, even after the query's own
rows are left out, since ties go to the smaller id.

Cases: vectors that are null, or hold null, NaN or infinite components, take no part. Vectors of
unequal length are compared as if filled with zeros; an empty one scores 0. A query has no row of its
own id as a candidate. Ties go to the smaller id; of repeated rows each counts as a candidate, and a
repeated query is answered once, by the smallest of its vectors. Null ids take no part. Fewer
candidates than k give all of them. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skyledger.llm.common import Scratch, near

CELLS, CHUNK = 256, 8192
RESULT = "query_id long, rank int, vec_id long, score long"
#: Bytes of the queries that a pass sends to the tasks.
PASS_BYTES = 32 << 20


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v, h): the components floor(scale * x) and their hash, of the rows that take part."""
    x = F.transform(F.col(vec_col), lambda c: c.cast("double"))
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & whole)
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("double")).alias("v")).withColumn("h", F.xxhash64("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column, filled with zeros to dims."""
    out = np.zeros((len(column), dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.array(pa.compute.list_value_length(column), int) if len(column) else np.zeros(0, int)
    if len(flat) == out.size and (sizes == dims).all():
        return flat.reshape(len(column), dims)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


class Grid:
    """The cells' limits, a row a dimension."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.width = low, (high - low) / CELLS
        self.reach = np.maximum(np.abs(low), np.abs(high)).max(initial=0)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((x - self.low) / np.where(self.width > 0, self.width, 1)), 0, CELLS - 1).astype(np.uint8)

    def middles(self, cells: np.ndarray) -> np.ndarray:
        return self.low + (cells + 0.5) * self.width


def approximations(rows: DataFrame, grid: Grid) -> DataFrame:
    """(n, ids, hashes, cells): chunks of vectors, as bytes."""
    dims = len(grid.low)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, CHUNK):
                part = batch.slice(start, CHUNK)
                cells = grid.cells(matrix(part["v"], dims))
                out = {"ids": part["vec_id"].to_numpy(), "hashes": part["h"].to_numpy(), "cells": cells}
                yield pa.record_batch({"n": pa.array([part.num_rows], pa.int32())} | {k: pa.array([np.ascontiguousarray(x).tobytes()], pa.binary()) for k, x in out.items()})

    return rows.select("vec_id", "v", "h").mapInArrow(run, "n int, ids binary, hashes binary, cells binary")


class Bounds:
    """What a task knows of a pass: for each query its candidates so far, with bounds of their scores."""

    def __init__(self, grid: Grid, ids: np.ndarray, q: np.ndarray, k: int):
        self.grid, self.ids, self.q, self.k = grid, ids, q, k
        # Rounding of the products is far below a thousandth of a cell's share of the slack.
        self.slack = np.abs(q) @ (grid.width / 2) + np.abs(q).sum(1) * grid.reach * 2.0**-40 + 0.5
        self.floor = np.full(len(ids), -np.inf)  # the k-th lower bound so far
        self.found: list[list[tuple]] = [[] for _ in ids]

    def useful(self, ids: np.ndarray, hashes: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Rows less those that 2k rows of an equal vector and no larger id make useless."""
        order = np.lexsort((ids, hashes))
        h, i = hashes[order], ids[order]
        new = np.r_[True, (h[1:] != h[:-1]) | (cells[order][1:] != cells[order][:-1]).any(1)]
        if new.all():
            return np.arange(len(ids))
        new_id = new | np.r_[True, i[1:] != i[:-1]]
        at = np.arange(len(ids))
        of_id = at - np.maximum.accumulate(np.where(new_id, at, 0))  # place among the rows of its id
        order, new = order[of_id < self.k], new[of_id < self.k]  # the first of a group stays
        at = np.arange(len(order))
        place = at - np.maximum.accumulate(np.where(new, at, 0))
        return np.sort(order[place < 2 * self.k])

    def add(self, ids: np.ndarray, hashes: np.ndarray, cells: np.ndarray) -> None:
        at = self.useful(ids, hashes, cells)
        ids, hashes = ids[at], hashes[at]
        middles = self.grid.middles(cells[at]).T
        step = max(1, (4 << 20) // max(len(ids), 1))
        for start in range(0, len(self.ids), step):
            part = slice(start, start + step)
            about = self.q[part] @ middles
            about[ids[None, :] == self.ids[part, None]] = -np.inf  # a query's own rows are no candidates
            slack = self.slack[part]
            if self.k <= len(ids):
                kth = np.partition(about, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - slack
                self.floor[part] = np.maximum(self.floor[part], kth)
            rows, cols = np.nonzero((about + slack[:, None] >= self.floor[part][:, None]) & (about > -np.inf))
            ends = np.searchsorted(rows, np.arange(len(slack) + 1))
            for j in np.flatnonzero(np.diff(ends)):
                c = cols[ends[j] : ends[j + 1]]
                self.keep(start + j, about[j, c], ids[c], hashes[c])

    def keep(self, j: int, about: np.ndarray, ids: np.ndarray, hashes: np.ndarray) -> None:
        have = self.found[j]
        have.append((about, ids, hashes))
        if sum(len(x[0]) for x in have) > 8 * self.k:
            about, ids, hashes = (np.concatenate(x) for x in zip(*have, strict=True))
            if len(about) >= self.k:
                self.floor[j] = max(self.floor[j], np.partition(about, len(about) - self.k)[len(about) - self.k] - self.slack[j])
            ok = about + self.slack[j] >= self.floor[j]
            self.found[j] = [(about[ok], ids[ok], hashes[ok])]

    def result(self):
        for j, have in enumerate(self.found):
            if have:
                about, ids, hashes = (np.concatenate(x) for x in zip(*have, strict=True))
                ok = about + self.slack[j] >= self.floor[j]
                yield np.full(ok.sum(), self.ids[j]), ids[ok], hashes[ok], about[ok] - self.slack[j], about[ok] + self.slack[j]


CANDIDATES = "query_id long, vec_id long, h long, lower double, upper double"


def scan(approx: DataFrame, grid: Grid, ids: np.ndarray, q: np.ndarray, k: int) -> DataFrame:
    """Candidates of a pass's queries, from the cells alone."""
    shared, dims, names = approx.sparkSession.sparkContext.broadcast((ids, q)), len(grid.low), [x.split()[0] for x in CANDIDATES.split(", ")]

    def run(batches):
        own = Bounds(grid, *shared.value, k)
        for batch in batches:
            for n, i, h, c in zip(*(batch[x].to_pylist() for x in ("n", "ids", "hashes", "cells")), strict=True):
                own.add(np.frombuffer(i, np.int64), np.frombuffer(h, np.int64), np.frombuffer(c, np.uint8).reshape(n, dims))
        rows = list(own.result())
        for start in range(0, len(rows), 1000):
            columns = [np.concatenate(x) for x in zip(*rows[start : start + 1000], strict=True)]
            yield pa.record_batch(dict(zip(names, map(pa.array, columns), strict=True)))

    return approx.mapInArrow(run, CANDIDATES)


def exact_scores(wanted: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) for wanted(query_id, vec_id, h), a written table: reads the exact
    vectors of these alone, and of equal rows k at most."""
    keys = wanted.select("vec_id", "h").distinct()
    read = rows.join(near(keys), ["vec_id", "h"], "left_semi").withColumn("copy", F.row_number().over(W.partitionBy("vec_id", "h").orderBy("vec_id"))).where(F.col("copy") <= k)
    joined = wanted.select("query_id", "vec_id", "h").distinct().join(read, ["vec_id", "h"]).join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")

    def run(batches):
        for batch in batches:
            out = []
            for a, b in zip(batch["q"].to_pylist(), batch["v"].to_pylist(), strict=True):
                s = sum(int(x) * int(y) for x, y in zip(a, b, strict=False))  # whole numbers of any size
                out.append(max(-(2**63), min(2**63 - 1, s)))
            yield pa.record_batch({"query_id": batch["query_id"], "vec_id": batch["vec_id"], "score": pa.array(out, pa.int64())})

    return joined.select("query_id", "vec_id", "q", "v").mapInArrow(run, "query_id long, vec_id long, score long")


def ranked(scores: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(df: DataFrame, is_query, id_col: str = "vec_id", vec_col: str = "embedding", *, k: int = 5, scale: int = 256, pass_bytes: int = PASS_BYTES, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows for which is_query, a Column over vec_id, holds.

    report, if given, gets the number of candidates and of exact vectors read.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vec_col, scale)
    dims, shortest, n = rows.agg(F.max(F.size("v")), F.min(F.size("v")), F.count(F.when(is_query, 1))).first()
    if not n or k < 1:
        return spark.createDataFrame([], RESULT)
    scratch = Scratch(spark, "topk")
    ends = rows.select(F.posexplode("v")).groupBy("pos").agg(F.min("col").alias("low"), F.max("col").alias("high")).collect()  # a row a dimension
    low, high = np.zeros(dims), np.zeros(dims)
    for pos, a, b in ends:
        low[pos], high[pos] = a, b
    grid = Grid(np.minimum(low, 0), np.maximum(high, 0)) if shortest < dims else Grid(low, high)
    approx = scratch.save(approximations(rows, grid), "approximations")
    queries = scratch.save(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    parts = -(-n * max(dims, 1) * 8 // pass_bytes)
    found = None
    for b in range(parts):
        mine = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == b).toArrow()  # about pass_bytes
        if mine.num_rows:
            got = scratch.save(scan(approx, grid, mine["vec_id"].to_numpy(), matrix(mine["v"].combine_chunks(), dims), k), f"pass-{b}")
            found = got if found is None else found.union(got)
    # A candidate stands for all rows of its id and hash; in each there are the bounds of one at least.
    by_bound = W.partitionBy("query_id").orderBy
    place = F.row_number().over(by_bound(F.desc("upper"), "vec_id", "h"))
    first = scratch.save(found.withColumn("place", place).where(F.col("place") <= k), "first")
    scores = scratch.save(exact_scores(first, rows, queries, k), "first-scores")
    floor = ranked(scores, k).groupBy("query_id").agg(F.min("score").alias("floor"), F.count("*").alias("n")).where(F.col("n") >= k).select("query_id", "floor")
    rest = found.join(first.select("query_id", "vec_id", "h").distinct(), ["query_id", "vec_id", "h"], "left_anti").join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("upper") >= F.col("floor")))
    rest = scratch.save(rest.select("query_id", "vec_id", "h"), "rest")
    more = scratch.save(exact_scores(rest, rows, queries, k), "rest-scores")
    if report is not None:
        report |= {"queries": queries.count(), "candidates": found.count(), "exact": scores.count() + more.count()}
    scratch.keep_only("first-scores", "rest-scores")
    return ranked(scores.union(more), k)


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(v) AS v FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
