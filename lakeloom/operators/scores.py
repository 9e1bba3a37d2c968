"""Scores of all vectors of several stores, kept as partial states: counts, sums and best lists."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

#: Rows of a store whose scores with a block of queries are held at a time.
ROWS = 2000
#: Entries of best lists after which a task hands its states on and begins anew.
MOST_ENTRIES = 500_000
#: Digits of a score; equal ones are ties.
DIGITS = 9
SCHEMA = "query_id long, store string, n long, total double, best double, hits array<struct<score:double,id:long>>"


class State:
    """Count, and of each query the sum, the best score and the ``top`` best rows, of what a task has seen of a store."""

    def __init__(self, queries: int, top: int):
        self.top, self.n = top, 0
        self.total, self.best = np.zeros(queries), np.full(queries, -np.inf)
        self.query, self.score, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` has a row a vector and a column a query."""
        self.n += len(ids)
        self.total += scores.sum(0)
        self.best = np.maximum(self.best, scores.max(0))
        least = np.partition(scores, len(ids) - self.top, axis=0)[len(ids) - self.top] if len(ids) > self.top else np.full(scores.shape[1], -np.inf)
        query, row = np.nonzero(scores.T >= least[:, None])
        query, score, name = np.append(self.query, query), np.append(self.score, scores[row, query]), np.append(self.id, ids[row])
        order = np.lexsort((name, -score, query))
        query = query[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = order[place < self.top]
        self.query, self.score, self.id = query[place < self.top], score[kept], name[kept]


def states_of(asked: list[tuple[int, list[float]]], top: int):
    """The task's work on batches of ``id, store, v`` for one block of queries."""
    by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for size in {len(q) for _, q in asked}:
        same = [(i, q) for i, q in asked if len(q) == size]
        by_size[size] = np.array([i for i, _ in same], np.int64), np.array([q for _, q in same], float).reshape(len(same), size)

    def rows(states: dict[tuple, State]) -> pa.RecordBatch:
        out: list[tuple] = []
        for (store, size), s in states.items():
            cuts = np.searchsorted(s.query, np.arange(len(s.total) + 1))
            for k, name in enumerate(by_size[size][0].tolist()):
                a, b = cuts[k], cuts[k + 1]
                hits = [{"score": x, "id": i} for x, i in zip(s.score[a:b].tolist(), s.id[a:b].tolist(), strict=True)]
                out.append((name, store, s.n, float(s.total[k]), float(s.best[k]), hits))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.struct([("score", pa.float64()), ("id", pa.int64())]))]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["query_id", "store", "n", "total", "best", "hits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, State] = {}
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS):
                batch = whole.slice(a, ROWS)
                ids, vectors = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
                sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
                values, first = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes) - sizes
                groups: dict[tuple, list[int]] = {}
                for k, (store, size) in enumerate(zip(batch.column(1).to_pylist(), sizes.tolist(), strict=True)):
                    if size in by_size:
                        groups.setdefault((store, size), []).append(k)
                for (store, size), members in groups.items():
                    at = np.array(members)
                    block = values[first[at][:, None] + np.arange(size)]
                    state = states.setdefault((store, size), State(len(by_size[size][0]), top))
                    state.add(np.round(block @ by_size[size][1].T, DIGITS) + 0.0, ids[at])
                if sum(len(s.query) for s in states.values()) > MOST_ENTRIES:
                    yield rows(states)
                    states = {}
        if states:
            yield rows(states)

    return run


def store_scores(vectors: DataFrame, queries: DataFrame, top: int, block: int = 1000, salts: int = 64) -> DataFrame:
    """``query_id, store, n, total, best, hits``: of each store, cosines of all its vectors with each of a stated query set.

    ``vectors`` has ``id long, store string, v``, ``queries`` ``id, v``. ``n`` vectors were compared, ``total`` is the sum of their scores, ``hits`` the
    ``top`` best as structs of ``score`` and ``id``, ties to the smaller id. A task multiplies batches of vectors with a block of ``block`` queries and keeps a state for
    each store, so what is shuffled is one state a task, store and query, merged by a salted key, then by key. Vectors of another length than the query's are
    skipped, as are null ones and those that hold a null or a number that is not finite, on both sides; a null store is one of its own; zero vectors score 0;
    rows with one id count as often as they are there, of queries with one id the least vector counts. Stores and query sets that are empty give no rows.
    """
    finite = "v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf'))"
    unit = vectors.where(finite).select(F.col("id").cast("long").alias("id"), "store", normalized(F.col("v")).alias("v"))
    asked = queries.where(finite).select(F.col("id").cast("long").alias("id"), normalized(F.col("v")).alias("v"))
    blocks = max(1, -(-asked.count() // block))
    found = None
    for b in range(blocks):
        mine = [(r.id, r.v) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).groupBy("id").agg(F.min("v").alias("v")).collect()]
        part = unit.mapInArrow(states_of(mine, top), SCHEMA)
        found = part if found is None else found.unionAll(part)
    merged = found.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    for keys in (["query_id", "store", "_salt"], ["query_id", "store"]):
        best = F.slice(F.array_sort(F.flatten(F.collect_list(F.transform("hits", lambda h: F.struct((-h["score"]).alias("low"), h["id"].alias("id")))))), 1, top)
        merged = merged.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"), F.transform(best, lambda h: F.struct((-h["low"]).alias("score"), h["id"].alias("id"))).alias("hits"))
    return merged
