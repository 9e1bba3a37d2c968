"""Vector stores: search, neighbours, group means, federated ranking and document results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import normalized
from .profile import global_row_number


#: Queries of a block and stored vectors of a part; a block meets a part in one cell.
CELL_QUERIES, CELL_VECTORS = 4096, 8192
#: Rows of a store whose scores with a block of queries are held at a time.
ROWS = 1024
#: Scores are ranked by nine digits; products of matrices, whose sums have another order, are off by far less than this.
SLACK = 3e-9


def vector_search(store: DataFrame, queries: DataFrame, top: int, least: float | None = None) -> DataFrame:
    """``query_id, id, score, rank``: the nearest vectors of a stated query set by cosine, ties to the smaller id.

    ``store`` and ``queries`` have ``id, v``. Blocks of queries meet parts of the store in cells, each of a bounded size, in which a matrix product finds the
    candidates; only those leave it, with their scores in the order of components. Vectors of another length than the query's are skipped, as are null ones;
    a score with a null component is null and comes last, one that is not a number comes first.
    """
    # the sides share no column, else a cogroup of one table with itself loses those of one side
    unit, asked = (rows.where("v is not null").select(F.col("id").alias(name), normalized(F.col("v")).alias(v)) for rows, name, v in ((store, "id", "v"), (queries, "query_id", "q")))
    blocks, parts = (max(1, -(-rows.count() // most)) for rows, most in ((queries, CELL_QUERIES), (store, CELL_VECTORS)))
    dealt = lambda rows, own, n, other, m: rows.select("*", F.pmod(F.xxhash64(rows.columns[0]), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other))
    tasks = min(blocks * parts, int(store.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    x, y = (rows.repartition(tasks, "_part", "_block").groupBy("_part", "_block") for rows in (dealt(unit, "_part", parts, "_block", blocks), dealt(asked, "_block", blocks, "_part", parts)))
    schema = f"query_id {dict(queries.dtypes)['id']}, id {dict(store.dtypes)['id']}, score double"
    pairs = x.cogroup(y).applyInArrow(_nearest_in_cell(top, least), schema).withColumn("score", F.round("score", 9))
    if least is not None:
        pairs = pairs.where(F.col("score") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def scoped_neighbours(rows: DataFrame, by: list[str], top: int, least: float) -> DataFrame:
    """``by..., query_id, id, score, rank``: for each row of a scope (``by..., id, v``) the nearest of its other ids by cosine, ``least`` or more, ties to the smaller id.

    A scope's vectors are dealt into blocks of about ``CELL_QUERIES``; a block meets a block in one cell, as in ``vector_search``, so pairs are products of matrices
    and only candidates leave a cell. Null scopes match nothing.
    """
    from .state import checkpointed

    unit = checkpointed(rows.where(" and ".join(f"`{c}` is not null" for c in [*by, "id", "v"])).select("id", normalized(F.col("v")).alias("v"), *by))
    sizes = unit.groupBy(*by).agg(F.ceil(F.count("*") / CELL_QUERIES).alias("_n"))
    dealt = lambda name, v, own, other: unit.join(sizes, by).select(F.col("id").alias(name), F.col("v").alias(v), *(F.col(c).alias(c) for c in by), F.pmod(F.xxhash64("id"), "_n").alias(own), F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)).alias(other))
    tasks, cell = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), [*by, "_part", "_block"]
    x, y = (side.repartition(tasks, *cell).groupBy(*cell) for side in (dealt("id", "v", "_part", "_block"), dealt("query_id", "q", "_block", "_part")))
    kind, inner = dict(rows.dtypes), _nearest_in_cell(top, least, apart=True)

    def run(key, store, asked):
        import pyarrow as pa

        found = inner(store, asked)
        return pa.table({c: pa.repeat(k, len(found)) for c, k in zip(by, key, strict=False)} | dict(zip(found.column_names, found.columns, strict=True))) if found.num_columns else found

    schema = ", ".join([*(f"`{c}` {kind[c]}" for c in by), f"query_id {kind['id']}, id {kind['id']}, score double"])
    pairs = x.cogroup(y).applyInArrow(run, schema).withColumn("score", F.round("score", 9)).where(F.col("score") >= least)
    order = Window.partitionBy(*by, "query_id").orderBy(F.desc("score"), "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def _nearest_in_cell(top: int, least: float | None, apart: bool = False):
    """Of a cell's vectors those that may be among the ``top`` best of each of its queries, equal ones by id; with ``apart`` (and ``least``) no vector of the query's id."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def read(table: pa.Table):
        """Ids, their order, lengths, where each vector begins, components, and which vectors hold a null."""
        ids, lists = (table.column(k).combine_chunks() for k in range(2))
        place = np.empty(len(ids), np.int64)
        place[pc.sort_indices(ids).to_numpy(zero_copy_only=False)] = np.arange(len(ids))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        flat, starts = lists.flatten(), np.cumsum(sizes) - sizes
        gaps = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False)))
        return ids, place, sizes, starts, flat.fill_null(0.0).to_numpy(zero_copy_only=False), gaps[starts + sizes] > gaps[starts]

    def run(store: pa.Table, asked: pa.Table) -> pa.Table:
        if not store.num_columns or not asked.num_columns:  # a side without rows has no columns
            return pa.table({})
        ids, place, sizes, starts, values, holes = read(store)
        names, _, lengths, begins, wanted, gone = read(asked)
        number = pc.index_in(names, value_set=pc.unique(ids)).fill_null(-1).to_numpy(zero_copy_only=False) if apart else None
        own_number = pc.index_in(ids, value_set=pc.unique(ids)).to_numpy(zero_copy_only=False) if apart else None
        out: list[tuple] = []
        for size in np.intersect1d(sizes, lengths):
            mine, own = np.flatnonzero(lengths == size), np.flatnonzero(sizes == size)
            q = wanted[begins[mine][:, None] + np.arange(size)]
            floor = np.full(len(mine), -np.inf if least is None else least - SLACK)
            held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, float))
            for first in range(0, len(own), ROWS):
                rows = own[first : first + ROWS]
                v = values[starts[rows][:, None] + np.arange(size)]
                with np.errstate(invalid="ignore"):
                    near = q @ v.T
                near[np.isnan(near)] = np.inf
                near[gone[mine], :] = near[:, holes[rows]] = -np.inf
                if apart:
                    near[number[mine][:, None] == own_number[rows]] = -np.inf
                if len(rows) > top:
                    floor = np.maximum(floor, np.partition(near, len(rows) - top, axis=1)[:, len(rows) - top] - SLACK) if not first else floor
                at, row = np.nonzero(near >= floor[:, None])
                score = np.zeros(len(at))
                for k in range(size):  # as Spark adds them up
                    score += q[at, k] * v[row, k]
                score[np.isneginf(near[at, row])] = -np.inf
                held = tuple(np.append(x, y) for x, y in zip(held, (at, rows[row], score), strict=True))
                # of equal scores the smallest ids are enough; the best scores so far bound those to come
                key = np.where(np.isnan(held[2]), np.inf, held[2])
                order = np.lexsort((place[held[1]], -key, held[0]))
                at, key = held[0][order], key[order]
                rank = np.arange(len(at)) - np.searchsorted(at, at)
                last = rank == top - 1
                floor[at[last]] = np.maximum(floor[at[last]], key[last] - SLACK)
                fresh = np.append(True, (at[1:] != at[:-1]) | (key[1:] != key[:-1]))[: len(at)]
                run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
                keep = order[(key >= floor[at]) & (np.arange(len(at)) - run_start < top)]
                held = tuple(x[keep] for x in held)
            out.append((mine[held[0]], held[1], held[2]))
        at, row, score = (np.concatenate([o[k] for o in out]) if out else np.zeros(0, t) for k, t in enumerate((np.int64, np.int64, float)))
        return pa.table({"query_id": names.take(pa.array(at)), "id": ids.take(pa.array(row)), "score": pa.array(score, mask=np.isneginf(score), from_pandas=False)})

    return run


def group_means(vectors: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """``..., v``: mean vector of each group, divided by its length; weighted if a weight is given."""
    w = F.lit(1.0) if weight is None else weight
    flat = vectors.select(*by, w.alias("_w"), F.posexplode("v").alias("pos", "x"))
    means = flat.groupBy(*by, "pos").agg((F.sum(F.col("x").cast("double") * F.col("_w")) / F.sum("_w")).alias("x"))
    rows = means.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda s: s["x"]).alias("v"))
    return rows.withColumn("v", normalized(F.col("v")))


def federated(results: DataFrame, mode: str = "combined") -> DataFrame:
    """``position``: results of several stores in one order: by ``rank``, ``raw`` or ``combined`` score, ties by store and id.

    ``results`` has ``store, id, score``; the rank score falls from 1 to 0 within each store.
    """
    own = Window.partitionBy("store")
    place, n = F.row_number().over(own.orderBy(F.desc("score"), "id")), F.count("*").over(own)
    out = results.withColumns({"_i": place, "_n": n}).withColumn("rank_score", F.when(F.col("_n") == 1, 1.0).otherwise(1 - (F.col("_i") - 1) / (F.col("_n") - 1)))
    key = {"rank": F.col("rank_score"), "raw": F.col("score"), "combined": (F.col("rank_score") + F.greatest("score", F.lit(0.0))) / 2}[mode]
    out = out.withColumn("final", F.round(key, 9)).drop("_i", "_n")
    place = global_row_number(out.withColumn("_low", -F.col("final")), ["_low", "store", "id"])
    return place.withColumnRenamed("_row", "position").drop("_low")


def union_of(stores: dict[str, DataFrame]) -> DataFrame:
    """The rows of several stores as one bag, with the name of each as ``store``; columns that one lacks are null."""
    out = None
    for name, rows in stores.items():
        part = rows.withColumn("store", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def by_document(hits: DataFrame, document: str, top_chunks: int) -> DataFrame:
    """Hits of each document: count, best and mean score, and the best chunks."""
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))), 1, top_chunks)
    return hits.groupBy(document).agg(F.count("*").alias("n"), F.max("score").alias("best"), F.avg("score").alias("mean"), F.transform(best, lambda x: x["id"]).alias("chunks"))


def limited(df: DataFrame, order: list, top: int) -> DataFrame:
    """The first ``top`` rows in order and ``truncated``, whether there were more."""
    more = df.select(*df.columns).limit(top + 1).count() > top
    return df.orderBy(*order).limit(top).withColumn("truncated", F.lit(more))


def prioritised(edges: DataFrame, first: Column, score: str, top: int) -> DataFrame:
    """Edges up to a limit: preferred ones first, then by score."""
    return edges.withColumn("_p", F.when(first, 0).otherwise(1)).orderBy("_p", F.desc(score), "a", "b").limit(top).drop("_p")
