"""Kernels that solve whole components of a graph within a task, over Arrow tables of edges ``a, b``."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package


def numbered(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The nodes in order, and the places of both ends of every edge among them."""
    names = pc.unique(pa.chunked_array([*table.column("a").chunks, *table.column("b").chunks], table.schema.field("a").type))
    names = names.take(pc.sort_indices(names))
    places = [pc.index_in(table.column(c), names).to_numpy().astype(np.int64) for c in ("a", "b")]
    return names, *places


def adjacency(n: int, a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Where the neighbours of each node begin, and the neighbours."""
    order = np.argsort(a, kind="stable")
    return np.searchsorted(a[order], np.arange(n + 1)).tolist(), b[order].tolist()


def cores(table: pa.Table, *, least: int = 0) -> pa.Table:
    """``node, core`` of edges in both directions; nodes that peel off below ``least`` have it as their core."""
    names, a, b = numbered(table)
    start, near = adjacency(len(names), a, b)
    degree = np.diff(start).tolist()
    waiting: list[list[int]] = [[] for _ in range(max(degree, default=0) + 1)]
    for x, d in enumerate(degree):
        waiting[d].append(x)
    gone, found = bytearray(len(names)), [0] * len(names)
    for d, own in enumerate(waiting):
        while own:
            x = own.pop()
            if gone[x] or degree[x] != d:
                continue
            gone[x], found[x] = 1, max(d, least)
            for y in near[start[x] : start[x + 1]]:
                if not gone[y] and degree[y] > d:
                    degree[y] -= 1
                    waiting[degree[y]].append(y)
    return pa.table({"node": names, "core": pa.array(found, pa.int32())})


def strong(table: pa.Table) -> pa.Table:
    """``node, component`` of directed edges: nodes that reach each other share the smallest of them."""
    names, a, b = numbered(table)
    n = len(names)
    start, near = adjacency(n, a, b)
    index, low, at, open_ = [-1] * n, [0] * n, start[:n], bytearray(n)
    found, held, count = np.arange(n), [], 0
    for root in range(n):
        path = [root] if index[root] < 0 else []
        while path:
            x = path[-1]
            if index[x] < 0:
                index[x] = low[x] = count
                count += 1
                held.append(x)
                open_[x] = 1
            if at[x] < start[x + 1]:
                y = near[at[x]]
                at[x] += 1
                if index[y] < 0:
                    path.append(y)
                elif open_[y]:
                    low[x] = min(low[x], index[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == index[x]:
                cut = len(held) - 1
                while held[cut] != x:
                    cut -= 1
                own = held[cut:]
                del held[cut:]
                found[own] = min(own)
                for y in own:
                    open_[y] = 0
    return pa.table({"node": names, "component": names.take(pa.array(found))})
