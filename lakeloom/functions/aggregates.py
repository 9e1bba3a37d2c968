"""Aggregates that users register: start, update, merge and finish over numpy arrays.

Each Arrow batch becomes partial states in the task that reads it; only states are shuffled, and they are merged by a tree, first by
salted key, then by key. States are binary columns: they can be written, and merged with another day's.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Keys that a task holds states of before it sends them on.
TASK_KEYS = 10_000
#: Parts of a key whose states are merged apart at first.
SALTS = 32


@dataclass(frozen=True)
class Aggregate:
    """How to aggregate: a state is a one-dimensional array of ``dtype``; values come as arrays without nulls."""

    dtype: str
    start: Callable[[], np.ndarray]
    update: Callable[[np.ndarray, np.ndarray], np.ndarray]
    merge: Callable[[np.ndarray, np.ndarray], np.ndarray]
    finish: Callable[[np.ndarray], float | None]

    def load(self, state: bytes) -> np.ndarray:
        return np.frombuffer(state, self.dtype)

    def dump(self, state: np.ndarray) -> bytes:
        return np.ascontiguousarray(state, self.dtype).tobytes()


AGGREGATES: dict[str, Aggregate] = {}


def register(name: str, aggregate: Aggregate) -> Aggregate:
    """Make an aggregate known by name; a name is given once."""
    if AGGREGATES.setdefault(name, aggregate) is not aggregate:
        raise ValueError(f"there is an aggregate {name} already")
    return aggregate


def _moments(values: np.ndarray) -> np.ndarray:
    mean = values.mean()
    return np.array([len(values), mean, ((values - mean) ** 2).sum()])


def _pooled(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number, mean and squared deviations of two samples together."""
    n = a[0] + b[0]
    if not n:
        return a
    gap = b[1] - a[1]
    return np.array([n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n])


def _moment(finish: Callable[[np.ndarray], float | None]) -> Aggregate:
    return Aggregate("f8", lambda: np.zeros(3), lambda s, v: _pooled(s, _moments(v.astype(float))) if len(v) else s, _pooled, finish)


def mixed(values: np.ndarray) -> np.ndarray:
    """64 evenly spread bits of each number; equal numbers of any type have the same."""
    x = (values.astype(float) + 0.0).view(np.uint64) if values.dtype.kind == "f" else values.astype(np.int64).view(np.uint64)
    with np.errstate(over="ignore"):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x


def distinct_sketch(k: int) -> Aggregate:
    """The number of different values from their ``k`` smallest hashes: exact below ``k``, above it with a standard error of 1 / sqrt(k - 2)."""
    smallest = lambda a, b: np.unique(np.concatenate((a, b)))[:k]
    return Aggregate("u8", lambda: np.zeros(0, np.uint64), lambda s, v: smallest(s, mixed(v)), smallest, lambda s: float(len(s)) if len(s) < k else (k - 1) / (float(s[-1]) / 2.0**64))


MEAN = register("mean", _moment(lambda s: float(s[1]) if s[0] else None))
VARIANCE = register("variance", _moment(lambda s: float(s[2] / (s[0] - 1)) if s[0] > 1 else None))
DISTINCT = register("distinct", distinct_sketch(4096))
#: Keeps every hash, of which equal ones come from equal numbers only: exact, but a state grows with its values, so keys are to be split as by ``value_part``.
EXACT_DISTINCT = register("exact_distinct", distinct_sketch(sys.maxsize))
#: Parts of the values of a key.
VALUE_PARTS = 64


def value_part(value: str) -> Column:
    """The part that a value belongs to: different values of a key are the sum of those of its parts."""
    return F.pmod(F.xxhash64(value), F.lit(VALUE_PARTS)).cast("int")


def partial_states(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, state``: one state of each key for each task that has seen it, or several if there are very many keys. Null values count for nothing."""
    one = AGGREGATES[name]
    rows = rows.select(*keys, F.col(value).alias("_value"))
    kept = T.StructType([*rows.select(*keys).schema.fields, T.StructField("state", T.BinaryType())])

    def pack(held: dict[tuple, np.ndarray], like: pa.Schema) -> pa.RecordBatch:
        columns = list(zip(*held, strict=True)) or [[] for _ in keys]
        arrays = [pa.array(c, like.field(i).type) for i, c in enumerate(columns)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([one.dump(s) for s in held.values()], pa.binary())], names=[*keys, "state"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        like = None
        for batch in batches:
            like = batch.schema
            # rows of one key next to each other, as slices of one array
            place: dict[tuple, int] = {}
            code = np.array([place.setdefault(k, len(place)) for k in zip(*(c.to_pylist() for c in batch.columns[:-1]), strict=True)] if keys else np.zeros(batch.num_rows), int)
            if not keys:
                place[()] = 0
            known = ~batch.columns[-1].is_null().to_numpy(zero_copy_only=False)
            values = batch.columns[-1].drop_null().to_numpy(zero_copy_only=False)
            order = np.argsort(code[known], kind="stable")
            cuts = np.searchsorted(code[known][order], np.arange(len(place) + 1))
            for k, a, b in zip(place, cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                held[k] = one.update(held[k] if k in held else one.start(), values[order[a:b]])
            if len(held) > TASK_KEYS:
                yield pack(held, like)
                held = {}
        if held:
            yield pack(held, like)

    return rows.mapInArrow(run, kept)


def merge_states(states: DataFrame, keys: list[str], name: str, salts: int = SALTS) -> DataFrame:
    """``keys, state``: one state a key, merged by salted key first, so that a key with states in all tasks is no task's alone."""
    one = AGGREGATES[name]

    def run(table: pa.Table) -> pa.Table:
        state = one.start()
        for s in table.column("state"):
            state = one.merge(state, one.load(s.as_py()))
        return table.slice(0, 1).set_column(table.schema.get_field_index("state"), "state", pa.array([one.dump(state)], pa.binary())).select([*keys, "state"])

    schema = states.select(*keys, "state").schema
    salted = states.select(*keys, "state", F.pmod(F.xxhash64("state"), F.lit(salts)).alias("_salt"))
    return salted.groupBy(*keys, "_salt").applyInArrow(run, schema).groupBy(*keys).applyInArrow(run, schema)


def finish_states(states: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``keys, value double`` of states."""
    one = AGGREGATES[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[Any] = [one.finish(one.load(s.as_py())) for s in batch.column(len(keys))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.float64())], names=[*keys, "value"])

    kept = T.StructType([*states.select(*keys).schema.fields, T.StructField("value", T.DoubleType())])
    return states.select(*keys, "state").mapInArrow(run, kept)


def aggregate(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """``keys, value``: a registered aggregate of a numeric column by key."""
    return finish_states(merge_states(partial_states(rows, keys, value, name), keys, name), keys, name)
