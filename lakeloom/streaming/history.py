"""The latest items of each key as streaming state, with eviction by number and by age."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import AtomicType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows and bytes that a task holds when it looks for rows that change no state.
CHUNK_ROWS, CHUNK_BYTES = 1 << 18, 1 << 24


def telling(rows: pa.Table, key: str, time: str, item: str, kind: str, most: int) -> pa.Table:
    """The rows that can change a state: each key's ``most`` latest different items and one latest row of each of its kinds."""
    df = rows.to_pandas()
    df.columns = ["key", "time", "item", "kind"]
    order = df.sort_values(["time", "item"])
    items = order.drop_duplicates(["key", "time", "item"]).groupby("key", dropna=False).tail(most)
    kinds = order[order["kind"].notna()].drop_duplicates(["key", "kind"], keep="last")
    return rows.take(pa.array(np.union1d(items.index, kinds.index)))


def combine(batches: Iterator[pa.RecordBatch], *names) -> Iterator[pa.RecordBatch]:
    """``telling`` rows of every chunk, so that a key with very many rows sends few of them to its task."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= CHUNK_ROWS or sum(b.nbytes for b in held) >= CHUNK_BYTES:
            yield from telling(pa.Table.from_batches(held), *names).to_batches()
            held = []
    if held:
        yield from telling(pa.Table.from_batches(held), *names).to_batches()


class Latest(StatefulProcessor):
    """Keeps the ``most`` latest items of a key, and when each kind was last seen, in one value: each call that a key makes for its state is a round trip to the JVM.

    Whatever the order of arrival, the items with the greatest (time, item) stay. The items are forgotten when their key gets no rows for ``keep_ms``, if given, a kind when it has not been written for so long.
    """

    STATE = "times array<long>, items array<long>, kinds array<string>, seen array<long>, written array<long>"

    def __init__(self, key: str, time: str, item: str, kind: str, most: int, keep_ms: int | None = None):
        self.names, self.most, self.keep_ms = (key, time, item, kind), most, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("latest", self.STATE, self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        _, time, item, kind = self.names
        now = timerValues.getCurrentProcessingTimeInMs() if self.keep_ms else 0
        times, items, *kinds = self.state.get() or ([], [], [], [], [])
        held = list(zip(times, items, strict=True))  # ascending, so a heap
        last = {k: (t, w) for k, t, w in zip(*kinds, strict=True) if not self.keep_ms or now < w + self.keep_ms}
        for row in rows:
            t, k = row[time], row[kind]
            one = (t, row[item])
            if len(held) < self.most:
                if one not in held:
                    heapq.heappush(held, one)
            elif held[0] < one and one not in held:
                heapq.heapreplace(held, one)
            if k is not None and (k not in last or last[k][0] < t):
                last[k] = t, now
        held.sort()
        self.state.update(([t for t, _ in held], [i for _, i in held], list(last), [t for t, _ in last.values()], [w for _, w in last.values()]))
        found = Row(self.names[0], "place", "at", "item", "kinds")
        for place, (t, i) in enumerate(reversed(held), 1):
            yield found(key[0], place, t, i, len(last))

    def close(self) -> None:
        pass


def latest_items(rows: DataFrame, key: str, time: str, item: str, kind: str, most: int, keep_ms: int | None = None) -> DataFrame:
    """A stream of ``key, place, at, item, kinds``: whenever a key gets rows, its ``most`` latest items (place 1 the last) and its number of kinds.

    ``time`` and ``item`` are long columns; rows where one of them or the key is null are left out. The state needs the session's state store to be
    RocksDB (``spark.sql.streaming.stateStore.providerClass`` set to ``ROCKSDB``), which keeps it on disk and in the checkpoint. With ``keep_ms`` Spark runs batches without rows for ever to look for what is too old: a query that shall end by itself
    (``availableNow``) wants ``spark.sql.streaming.noDataMicroBatches.enabled`` off.
    """
    rows = rows.select(key, time, item, kind).where(" and ".join(f"`{c}` is not null" for c in (key, time, item)))
    schema = f"{key} {dict(rows.dtypes)[key]}, place long, at long, item long, kinds long"
    processor = Latest(key, time, item, kind, most, keep_ms)
    if isinstance(rows.schema[key].dataType, AtomicType):
        rows = rows.mapInArrow(lambda batches: combine(batches, key, time, item, kind, most), rows.schema)
    return rows.groupBy(key).transformWithState(processor, schema, "Update", "ProcessingTime" if keep_ms else "None")
