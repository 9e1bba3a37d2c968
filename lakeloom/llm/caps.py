"""Near-duplicate embeddings by spherical-cap filters from random product codes.

A filter is a direction; a vector passes it if their inner product reaches a bound (the vector lies in the cap). Directions
are the products of a few small random codes over blocks of a rotated vector, so the filters that a
vector passes are decoded part by part, without looking at the others: a partial sum that the best
remaining parts cannot lift to the bound is dropped. Close vectors share filters, others hardly do.
Vectors meet by the filters they share and every pair that meets is verified; a pair is counted in the
smallest filter it shares only, so counts need no table of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .components import components

#: Filters of one code that a vector passes, on average, and vectors of one label that a filter gets, about.
FILTERS, BUCKET = 6, 64
#: Parts of a product code.
PARTS = 3
#: Independent codes at least; some vectors lie badly for one code, hardly one for all. There is one more for each half power of ten of vectors over 100,000.
CODES = 8
#: Most vectors of a group of filters in one task; larger groups are compared in pairs of blocks.
TASK_ROWS = 10_000
#: Vectors that are decoded at a time.
CHUNK = 256


@dataclass(frozen=True)
class Code:
    """A random product code: a rotation of the space and, for each block of coordinates, unit directions.

    Each block of a turned vector is scaled to the same length, so that all vectors pass about as many filters.
    """

    rotation: np.ndarray
    blocks: tuple[np.ndarray, ...]
    bound: float

    @classmethod
    def draw(cls, dimension: int, rows: int, filters: int = FILTERS, bucket: int = BUCKET, seed: int = 20240607) -> Code:
        """A code for ``rows`` vectors: the more there are, the smaller the caps and the more of them.

        The bound is where random vectors pass ``filters`` of them on average.
        """
        share = min(0.02, max(bucket / max(rows, 1), 1e-9))
        parts = min(PARTS, dimension)
        size = max(2, math.ceil((filters / share) ** (1 / parts)))
        rng = np.random.default_rng(seed)
        rotation, _ = np.linalg.qr(rng.standard_normal((dimension, dimension)))
        blocks = []
        for width in (len(c) for c in np.array_split(np.arange(dimension), parts)):
            block = rng.standard_normal((size, width))
            blocks.append(block / np.linalg.norm(block, axis=1, keepdims=True) / parts)
        some, low, high = rng.standard_normal((CHUNK, dimension)), 0.0, 1.0
        for _ in range(12):
            middle = (low + high) / 2
            found = cls(rotation, tuple(blocks), middle).decode(some, most=filters)
            low, high = (middle, high) if found is None else (low, middle)
        return cls(rotation, tuple(blocks), high)

    def decode(self, vectors: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
        """``row, filter``: all filters that each vector passes, and the best one of a vector that passes none.

        None if there come to be more than ``most`` for a vector, on average.
        """
        at, scores = 0, []
        turned = vectors @ self.rotation
        for block in self.blocks:
            part = turned[:, at : at + block.shape[1]]
            length = np.linalg.norm(part, axis=1, keepdims=True)
            scores.append(part / np.where(length > 0, length, 1) @ block.T)
            at += block.shape[1]
        tops = [s.max(axis=1) for s in scores]
        best = sum(tops)
        bound = np.minimum(self.bound, best) - 1e-12
        row, total, name, ahead = np.arange(len(vectors)), np.zeros(len(vectors)), np.zeros(len(vectors), np.int64), best
        for s, top in zip(scores, tops, strict=True):
            ahead = ahead - top
            pick, code = np.nonzero(total[:, None] + s[row] + ahead[row][:, None] >= bound[row][:, None])
            if most is not None and len(pick) > most * len(vectors):
                return None
            total = total[pick] + s[row[pick], code]
            name = name[pick] * s.shape[1] + code
            row = row[pick]
        return row, name


def units(table: pa.RecordBatch | pa.Table, column: str, dimension: int) -> np.ndarray:
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dimension)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow or loss of tiny vectors in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what ``a``, ``b`` connect, at most n - 1."""
    from .simhash import connect

    root = connect(n, a, b)
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def links_of_group(unit: np.ndarray, weight: np.ndarray, side: np.ndarray, owner: np.ndarray, name: np.ndarray, lowest: int, least: float, strip: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the vectors of one group of filters: the weight each links to, and a forest ``a, b`` of its links.

    ``owner, name`` are the filters that each vector passes up to the last of the group, which begins with ``lowest``. A pair that
    shares a smaller filter was counted there. Pairs of one side are another task's, unless the side is negative.
    """
    order = np.lexsort((owner, name))
    owner, name = owner[order], name[order]
    by_owner = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[by_owner], np.arange(len(unit) + 1))
    cuts = np.flatnonzero(np.concatenate(([True], name[1:] != name[:-1], [True])))
    count, a, b = np.zeros(len(unit), np.int64), [], []
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo < 2 or name[lo] < lowest:
            continue
        rows, earlier = owner[lo:hi], None
        for at in range(0, len(rows), strip):
            left = rows[at : at + strip]
            near = unit[left] @ unit[rows].T >= least
            near &= np.arange(len(rows)) > np.arange(at, at + len(left))[:, None]
            near &= (side[left][:, None] != side[rows]) | (side[left][:, None] < 0)
            if not near.any():
                continue
            if earlier is None:
                held = np.concatenate([by_owner[starts[r] : starts[r + 1]] for r in rows])
                held = held[name[held] < name[lo]]
                seen, column = np.unique(name[held], return_inverse=True)
                earlier = np.zeros((len(rows), len(seen)), np.float32)
                earlier[np.searchsorted(rows, owner[held]), column] = 1
                earlier = earlier[:, earlier.sum(axis=0) > 1]
            if earlier.shape[1]:
                near &= earlier[at : at + strip] @ earlier.T < 0.5
            x, y = np.nonzero(near)
            x, y = left[x], rows[y]
            np.add.at(count, x, weight[y])
            np.add.at(count, y, weight[x])
            tx, ty = forest(len(unit), x, y)
            a.append(tx)
            b.append(ty)
    none = [np.zeros(0, np.int64)]
    return count, *forest(len(unit), np.concatenate(a or none), np.concatenate(b or none))


def draw_codes(dimension: int, rows: int, filters: int = FILTERS, bucket: int = BUCKET, seed: int = 20240607) -> list[Code]:
    """The independent codes for ``rows`` vectors of one label."""
    number = max(CODES, math.ceil(2 * math.log10(max(rows, 1))) - 2)
    return [Code.draw(dimension, rows, filters, bucket, seed + k) for k in range(number)]


def decode_all(codes: list[Code], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``row, filter`` by all codes, in order."""
    parts, volume = [], math.prod(len(b) for b in codes[0].blocks)
    for k, code in enumerate(codes):
        row, name = code.decode(vectors)
        parts.append((row, name + k * volume))
    row, name = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((name, row))
    return row[order], name[order]


def cap_links(vectors: DataFrame, dimension: int, rows: int, least: float, task_rows: int = TASK_ROWS, filters: int = FILTERS, bucket: int = BUCKET, scope: str = "lakeloom") -> DataFrame:
    """``a, b, n``: with a null ``b`` how many vectors ``a`` links to (partial sums), otherwise links that connect what is connected.

    ``vectors`` are ``id, label, weight, v`` of one dimension, without repeats; ``rows`` is the size of
    the largest label and sets the codes. Filters of one code that begin with the same part are a group, and a vector is sent once for each
    group of its filters. Where a group of a label has more than ``task_rows`` vectors, they are dealt into blocks, and each pair of blocks is a task.
    """
    codes = draw_codes(dimension, rows, filters, bucket)
    size = math.prod(len(b) for b in codes[0].blocks[1:])
    wide = len(codes) * size * len(codes[0].blocks[0]) >= 1 << 31
    kind = T.LongType() if wide else T.IntegerType()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                row, name = decode_all(codes, units(part, "v", dimension))
                ends = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(name, pa.int64() if wide else pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, "filters"])

    rows_ = vectors.select("id", "label", "weight", "v")
    kept = T.StructType([*rows_.schema.fields, T.StructField("filters", T.ArrayType(kind))])
    group_of = lambda f: F.floor(f / size).cast("int")
    sent = materialize(rows_.mapInArrow(decode, kept), scope).withColumn("group", F.explode(F.array_distinct(F.transform("filters", group_of))))
    many = sent.groupBy("label", "group").count().where(F.col("count") > task_rows)
    many = materialize(many.select("label", "group", F.ceil(F.col("count") * 2 / task_rows).cast("int").alias("blocks")), scope)
    sent = sent.join(F.broadcast(many) if many.count() <= 10_000 else many, ["label", "group"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    sent = sent.withColumn("block", F.pmod(F.xxhash64("id", "group"), "blocks").cast("int"))
    pair = lambda k: F.struct(F.least("block", k).alias("one"), F.greatest("block", k).alias("two"))
    sent = sent.withColumn("meets", F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), pair)))
    # groups are small as a rule: a task of about task_rows vectors takes several
    shards = max(1, -(-vectors.count() * len(codes) * 2 // task_rows))
    shard = F.pmod(F.xxhash64("label", "group", "meets"), F.lit(shards)).alias("shard")
    upto = F.filter("filters", lambda f: f < (F.col("group").cast(kind) + 1) * F.lit(size).cast(kind)).alias("filters")
    sent = sent.select(shard, "label", "group", F.col("meets.one").alias("one"), F.col("meets.two").alias("two"), "block", "id", "weight", "v", upto)
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        keys = {c: table.column(c).to_numpy() for c in ("label", "group", "one", "two", "id")}
        order = np.lexsort(tuple(keys[c] for c in ("id", "two", "one", "group", "label")))
        keys = {c: v[order] for c, v in keys.items()}
        new = np.logical_or.reduce([keys[c][1:] != keys[c][:-1] for c in ("label", "group", "one", "two")])
        cuts, out = np.flatnonzero(np.concatenate(([True], new, [True]))), []
        for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if hi - lo < 2:
                continue
            part = table.take(pa.array(order[lo:hi])).combine_chunks()
            ids, lists = part.column("id").to_numpy(), part.column("filters").combine_chunks()
            owner = np.repeat(np.arange(hi - lo), lists.value_lengths().to_numpy())
            side = part.column("block").to_numpy() if keys["one"][lo] != keys["two"][lo] else np.full(hi - lo, -1)
            count, a, b = links_of_group(units(part, "v", dimension), part.column("weight").to_numpy(), side, owner, lists.flatten().to_numpy(), int(keys["group"][lo]) * size, least)
            some = np.flatnonzero(count)
            out.append(pa.table({"a": ids[some], "b": pa.nulls(len(some), pa.int64()), "n": count[some]}))
            out.append(pa.table({"a": ids[a], "b": ids[b], "n": np.zeros(len(a), np.int64)}))
        return pa.concat_tables([t.cast(schema) for t in out]) if out else schema.empty_table()

    return sent.groupBy("shard").applyInArrow(run, "a long, b long, n long")


def near_embeddings(embeddings: DataFrame, least: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", scope: str = "lakeloom", **options) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Vectors of one label and length with a cosine of ``least`` or more are linked. Links are found by filters, so that a pair at exactly ``least`` is missed once in hundreds; none is made below it. A vector that is null, empty, zero or holds null or
    non-finite components, and one with a null label or id, is linked with nothing; it is its own component and kept. Equal vectors
    of a label take part once, with their number. An id in several rows counts once for each different label and vector;
    its rows then share the sum of links and the smallest component. Other columns are ignored; an empty table gives no rows.
    """
    v = F.col(vec_col)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"), F.col(label_col).cast("long").alias("label"))
    good = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0), F.lit(False))
    whole = rows.where(good & F.col("vec_id").isNotNull() & F.col("label").isNotNull()).distinct()
    # equal vectors once, by a digest of their numbers
    members = whole.withColumn("vh", F.sha2(F.array_join(F.transform("v", lambda x: x.cast("double").cast("string")), " "), 256))
    members = materialize(members.withColumn("size", F.size("v")), scope)
    distinct = materialize(members.groupBy("label", "vh", "size").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("v").alias("v")), scope)
    distinct = materialize(distinct.withColumn("id", F.xxhash64("label", "vh")), scope)
    found: list[DataFrame] = []
    for size, count in sorted((r[0], r[1]) for r in distinct.groupBy("size", "label").count().groupBy("size").agg(F.max("count")).collect()):
        found.append(materialize(cap_links(distinct.where(F.col("size") == size), size, count, least, scope=scope, **options), scope))
    empty = embeddings.sparkSession.createDataFrame([], "a long, b long, n long")
    links = found[0] if found else empty
    for part in found[1:]:
        links = links.unionAll(part)
    counts = links.where("b is null").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    roots = components(links.where("b is not null").select("a", "b"), scope).toDF("id", "root")
    classes = materialize(distinct.select("id", "label", "vh", "weight").join(counts, "id", "left").join(roots, "id", "left"), scope)
    named = members.select("vec_id", "label", "vh").join(classes, ["label", "vh"])
    named = materialize(named.select("vec_id", F.coalesce("root", "id").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n")), scope)
    lowest = named.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    one = named.join(lowest, "root").groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.min("component_id").alias("component_id"))
    out = rows.select("vec_id").join(one, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op12_near_embeddings(spark, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    from .common import table

    return near_embeddings(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with recursive good as (
  select vec_id, label, embedding::double[] as v from embeddings
  where vec_id is not null and label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from good a join good b on a.label = b.label and a.vec_id <> b.vec_id and len(a.v) = len(b.v) where list_cosine_similarity(a.v, b.v) >= 0.93),
reach as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
roots as (select a, min(b) as b from reach group by a),
counts as (select a, count(distinct b) as n from links group by a)
select e.vec_id, coalesce(c.n, 0)::bigint as n_links, least(e.vec_id, coalesce(r.b, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(r.b, e.vec_id)) as kept
from embeddings e left join roots r on r.a = e.vec_id left join counts c on c.a = e.vec_id
"""
