"""Term statistics and similarity joins over token sets.

Most similarity joins go through an inverted index: an equi-join on the term, so only pairs that share one
are ever built. The join with a threshold counts shared terms in cells, a block of sets by a block; equal
sets take part once. Nothing else is left out, but by ``max_df_ratio`` where an operator has that parameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ngrams, tokens


def term_counts(docs: DataFrame, id_col: str = "id", text_col: str = "text", pattern: str = "[a-z0-9_]+", least: int = 1, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """``id, term, n, first``: counts of each document's terms and the place of their first occurrence.

    Texts are dealt out by id before they become terms, so rows of one id meet and no term is shuffled.
    """
    dealt = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).repartition("id")
    at = dealt.select("id", F.posexplode(tokens("_text", pattern=pattern, least=least, stopwords=stopwords)).alias("pos", "term"))
    return at.groupBy("id", "term").agg(F.count("*").alias("n"), F.min("pos").alias("first"))


def keywords(counts: DataFrame, top: int, ties: str = "term") -> DataFrame:
    """The most frequent terms of each document; ties by term, or by ``first`` occurrence."""
    order = Window.partitionBy("id").orderBy(F.desc("n"), ties, "term")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def set_classes(sets: DataFrame) -> DataFrame:
    """``id, copies, n, terms``: the distinct term sets of ``id, term``, each named by the smallest id that has it."""
    held = sets.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    key = F.sha2(F.array_join("terms", "\n"), 256)
    found = held.groupBy(key.alias("_key")).agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("terms").alias("terms"))
    return found.select("id", "copies", F.size("terms").alias("n"), "terms")


def set_members(sets: DataFrame) -> DataFrame:
    """``id, class_id``: the smallest id with the same term set."""
    key = F.sha2(F.array_join(F.array_sort(F.collect_set("term")), "\n"), 256)
    held = sets.groupBy("id").agg(key.alias("_key"))
    return held.join(held.groupBy("_key").agg(F.min("id").alias("class_id")), "_key").select("id", "class_id")


#: Sets of a task's side of ``jaccard_pairs`` and blocks that they are cut into by size, postings of a block at most.
SIDE_SETS, SIDE_BLOCKS, BLOCK_POSTINGS = 16384, 8, 1 << 22


def jaccard_pairs(sets: DataFrame, least: float, about: int | None = None) -> DataFrame:
    """``a, b, shared, jaccard, overlap``: all pairs a < b of distinct term sets (named as by ``set_classes``) with a Jaccard similarity of ``least`` > 0 or more.

    Exact, and no pair and no posting is shuffled. Distinct sets, as 64-bit hashes of terms, are dealt out once; each task sorts its own by size and cuts
    them into blocks, kept by term. Tasks of a Cartesian product read two sides of blocks each from where they are checkpointed, and shared terms are counted for a block by a block, whatever
    their frequency; blocks whose sizes differ too much do not meet. Time grows with the square of the sets, disk in proportion.
    ``about`` is the number of ids or more, if known; it only says how many tasks there are.
    """
    from .state import checkpointed

    if about is None:
        about = sets.select("id").distinct().count()
    sides = max(1, min(-(-about // 8192), 32), -(-about // SIDE_SETS))
    most = max(256, -(-about // (sides * SIDE_BLOCKS)))
    kind = sets.schema["id"].dataType.simpleString()
    held = sets.groupBy("id").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    held = held.select(F.sha2(F.array_join("terms", "\n"), 256).alias("_key"), "id", F.transform("terms", lambda t: F.xxhash64(t)).alias("hs"))
    dealt = held.mapInArrow(_one_of_batch, held.schema).repartition(sides, "_key")
    classes = dealt.groupBy("_key").agg(F.min("id").alias("id"), F.first("hs").alias("hs")).coalesce(sides)
    packed = classes.select("id", "hs", F.size("hs").alias("n")).where("n > 0").sortWithinPartitions("n", "id")
    blocks = checkpointed(packed.mapInArrow(_blocks(most), f"block long, low int, high int, ids array<{kind}>, n binary, terms binary, df binary, rows binary"))
    x, y = (blocks.select(*(F.col(c).alias(f"{c}_{side}") for c in blocks.columns)) for side in "xy")
    near = (F.col("high_x") >= F.col("low_y") * least - 1e-9) & (F.col("high_y") >= F.col("low_x") * least - 1e-9)
    cells = x.join(y.hint("shuffle_replicate_nl"), (F.col("block_x") <= F.col("block_y")) & near)
    return cells.mapInArrow(_similar_in_cell(least), f"a {kind}, b {kind}, shared long, jaccard double, overlap double")


def _one_of_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each ``_key`` of a batch, with the smallest id, so that very many equal sets are not sent to one task."""
    import pyarrow.compute as pc

    for batch in batches:
        order = pc.sort_indices(batch, sort_keys=[("_key", "ascending"), ("id", "ascending")])
        keys = batch.column("_key").take(order)
        first = pa.concat_arrays([pa.array([True][: len(keys)]), pc.not_equal(keys[1:], keys[:-1])]) if len(keys) > 1 else None
        yield batch if first is None else batch.take(order.filter(first))


def _blocks(most: int):
    """Rows ``id, hs, n`` in order of size as blocks of ``most`` sets at most: for each term, in order, its number of sets and their places."""
    import numpy as np
    import pyarrow.compute as pc
    from pyspark import TaskContext

    def block(number: int, ids: list[pa.Array], sizes: list[np.ndarray], hashes: list[np.ndarray]) -> pa.RecordBatch:
        n, flat = np.concatenate(sizes).astype(np.int32), np.concatenate(hashes)
        order = np.argsort(flat, kind="stable")
        ordered, places = flat[order], np.repeat(np.arange(len(n), dtype=np.uint16), n)[order]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))[: len(ordered)])
        df = np.diff(np.append(starts, len(ordered))).astype(np.int32)
        held = pa.concat_arrays(ids)
        one = {"ids": pa.ListArray.from_arrays(pa.array([0, len(held)], pa.int32()), held)}
        one |= {k: pa.array([v.tobytes()], pa.binary()) for k, v in (("n", n), ("terms", ordered[starts]), ("df", df), ("rows", places))}
        return pa.RecordBatch.from_pydict({"block": pa.array([number]), "low": pa.array([n[0]]), "high": pa.array([n[-1]])} | one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, sizes, hashes, sets, postings = [], [], [], 0, 0
        for batch in batches:
            n, flat = batch.column("n").to_numpy(), pc.list_flatten(batch.column("hs")).to_numpy(zero_copy_only=False)
            ends = np.cumsum(n, dtype=np.int64)
            at = 0
            while at < len(n):
                done = ends[at - 1] if at else 0
                room = int(np.searchsorted(ends, done + BLOCK_POSTINGS - postings, "right")) - at
                take = min(len(n) - at, most - sets, room)
                if take <= 0 and sets:  # the block is full
                    yield block(number, ids, sizes, hashes)
                    number, ids, sizes, hashes, sets, postings = number + 1, [], [], [], 0, 0
                    continue
                take = max(take, 1)  # a set of more postings is a block of its own
                ids.append(batch.column("id").slice(at, take))
                sizes.append(n[at : at + take])
                hashes.append(flat[done : ends[at + take - 1]])
                sets, postings, at = sets + take, postings + int(ends[at + take - 1] - done), at + take
        if sets:
            yield block(number, ids, sizes, hashes)

    return run


def _similar_in_cell(least: float):
    """Pairs of two blocks of sets. Terms that are rare in them are counted: each adds one at all its left by all its right sets. With the number of its frequent terms, what a pair
    can reach is known; of those that can reach ``least`` the frequent terms are counted too, as bits."""
    import numpy as np
    import pyarrow.compute as pc

    share = least / (1 + least)

    def postings(side: dict, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of some terms, and the places of the sets that have it."""
        df = side["df"][terms].astype(np.int64)
        of = np.repeat(np.arange(len(terms)), df)
        return of, side["rows"][np.arange(len(of)) + np.repeat(side["ends"][terms] - np.cumsum(df), df)].astype(np.int64)

    def frequent(left: dict, right: dict, s: np.ndarray, t: np.ndarray, met: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
        """How many terms to leave to the bits, and how many of them each set has: the least work, by the sizes of some sets of each side."""
        n, m = left["n"], right["n"]
        p, q = (np.unique(np.linspace(0, len(x) - 1, 128).astype(np.int64)) for x in (n, m))
        need = share * (n[p][:, None] + m[q])
        left_of = np.append(met.sum() - np.cumsum(met), 0) if len(met) else np.zeros(1)
        f, g, done, best = np.zeros(len(n), np.int64), np.zeros(len(m), np.int64), 0, None
        for k in (0, 64, 128, 256, 512, 1024, 2048, 4096, 8192):
            k = min(k, len(met))
            f, g = f + np.bincount(postings(left, s[done:k])[1], minlength=len(n)), g + np.bincount(postings(right, t[done:k])[1], minlength=len(m))
            adds = (left_of[k - 1] if k else met.sum()) / (len(n) * len(m))
            work = 8 * adds + (np.minimum(f[p][:, None], g[q]) + adds + 2 >= need).mean() * (40 + k / 16)
            if best is None or work < best[0]:
                best = work, k, f, g
            done = k
        return best[1:]

    def bits(side: dict, terms: np.ndarray) -> np.ndarray:
        held = np.zeros((len(side["n"]), -(-len(terms) // 64) * 64), bool)
        of, rows = postings(side, terms)
        held[rows, of] = True
        return np.packbits(held, axis=1).view(np.uint64)

    def counted(left: dict, right: dict, s: np.ndarray, t: np.ndarray, met: np.ndarray) -> np.ndarray:
        """For each left by each right set how many of the terms ``s`` and ``t`` both have."""
        width = len(right["n"])
        counts = np.zeros((len(left["n"]), width), np.uint16 if min(left["n"].max(), right["n"].max()) < 1 << 16 else np.uint32)
        for k in np.flatnonzero(met >= 512):
            l, r = (side["rows"][side["ends"][x] - side["df"][x] : side["ends"][x]] for side, x in ((left, s[k]), (right, t[k])))  # noqa: E741
            counts[l.astype(np.int64)[:, None], r] += 1
        rare = np.flatnonzero(met < 512)
        flat, one = counts.reshape(-1), counts.dtype.type(1)
        for part in np.split(rare, np.searchsorted(np.cumsum(met[rare]), np.arange(1 << 21, int(met[rare].sum()), 1 << 21))):
            product, wide = met[part], right["df"][t[part]].astype(np.int64)
            of = np.repeat(np.arange(len(part)), product)
            step = np.arange(len(of)) - np.repeat(np.cumsum(product) - product, product)
            l = left["rows"][(left["ends"][s[part]] - left["df"][s[part]])[of] + step // wide[of]].astype(np.int64)  # noqa: E741
            np.add.at(flat, l * width + right["rows"][(right["ends"][t[part]] - right["df"][t[part]])[of] + step % wide[of]], one)
        return counts

    def pairs(left: dict, right: dict) -> Iterator[tuple[np.ndarray, ...]]:
        """Places and sizes of left and right sets, and how many terms they share, for all pairs that share enough."""
        at = np.minimum(np.searchsorted(right["terms"], left["terms"]), len(right["terms"]) - 1)
        s = np.flatnonzero(right["terms"][at] == left["terms"])
        t = at[s]
        met = left["df"][s].astype(np.int64) * right["df"][t]
        most = min(len(met), 1 << 13)
        top = np.argpartition(-met, most - 1)[:most] if most < len(met) else np.arange(most)
        top = top[np.argsort(-met[top])]
        others = np.ones(len(met), bool)
        others[top] = False
        order = np.append(top, np.flatnonzero(others))
        s, t, met = s[order], t[order], met[order]
        k, f, g = frequent(left, right, s, t, met)
        counts = counted(left, right, s[k:], t[k:], met[k:])
        marked = [bits(side, terms) for side, terms in ((left, s[:k]), (right, t[:k]))]
        n, m = left["n"], right["n"]
        # bounds in float32 let through a little more than is left after the exact test
        x, xf, y, yf = ((v - d).astype(np.float32) for v, d in ((n * share, 0.05), (n * share - f, 0.05), (m * share, 0), (m * share - g, 0)))
        for r in range(0, len(counts), 64):
            part = counts[r : r + 64]
            p, q = np.nonzero((part >= xf[r : r + 64, None] + y) & (part >= x[r : r + 64, None] + yf))
            for c in range(0, len(p), 1 << 14):
                i, j = p[c : c + (1 << 14)] + r, q[c : c + (1 << 14)]
                both = counts[i, j].astype(np.int64) + np.bitwise_count(marked[0][i] & marked[1][j]).sum(axis=1, dtype=np.int64)
                a, b = n[i].astype(np.int64), m[j].astype(np.int64)
                keep = both / (a + b - both) >= least
                yield i[keep], j[keep], a[keep], b[keep], both[keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                sides, ids = [], []
                for side in "xy":
                    held = {c: np.frombuffer(batch.column(f"{c}_{side}")[row].as_buffer(), kind) for c, kind in (("n", np.int32), ("terms", np.int64), ("df", np.int32), ("rows", np.uint16))}
                    sides.append(held | {"ends": np.cumsum(held["df"], dtype=np.int64)})
                    ids.append(batch.column(f"ids_{side}")[row].values)
                same = batch.column("block_x")[row] == batch.column("block_y")[row]
                for found in pairs(*sides):
                    p, q, n, m, both = (v[found[0] < found[1]] for v in found) if same else found
                    if len(p):
                        one, other = ids[0].take(pa.array(p)), ids[1].take(pa.array(q))
                        less = pc.less(one, other)
                        ends = {"a": pc.if_else(less, one, other), "b": pc.if_else(less, other, one)}
                        yield pa.RecordBatch.from_pydict(ends | {"shared": pa.array(both), "jaccard": pa.array(both / (n + m - both)), "overlap": pa.array(both / np.minimum(n, m))})

    return run


def scoped_similarity(sets: DataFrame, by: list[str], least: float = 0.0, least_shared: int = 1) -> DataFrame:
    """``by..., a, b, shared, jaccard, overlap`` of the term sets ``by..., id, term`` of one scope, as the chunks of a file or the turns of a conversation."""
    size = sets.groupBy(*by, "id").agg(F.count("*").alias("n"))
    held = sets.join(size, [*by, "id"])
    a, b = (held.select(*by, "term", F.col("id").alias(x), F.col("n").alias(f"n_{x}")) for x in "ab")
    out = a.join(b, [*by, "term"]).where("a < b").groupBy(*by, "a", "b", "n_a", "n_b").agg(F.count("*").alias("shared"))
    out = out.withColumns({"jaccard": F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared")), "overlap": F.col("shared") / F.least("n_a", "n_b")})
    return out.where((F.col("jaccard") >= least) & (F.col("shared") >= least_shared)).select(*by, "a", "b", "shared", "jaccard", "overlap")


#: Sets of a block; two blocks of one scope meet in a cell of ``scoped_overlaps``, whose counts are a matrix of that many rows and columns.
CELL_SETS = 4096


def scoped_overlaps(sets: DataFrame, by: list[str], least_shared: int) -> DataFrame:
    """``by..., a, b, shared``: pairs a < b of one scope that share ``least_shared`` > 0 terms or more, of sets ``by..., id, term`` whose scopes grow with the table.

    A scope's sets are dealt into blocks of about ``CELL_SETS``. A set is sent once to each cell of its block, shared terms are counted within the
    cell, and no pair is shuffled. A term that an id has twice in one scope counts for each; null scopes match nothing.
    """
    from .state import checkpointed

    scoped = sets.where(" and ".join(f"`{c}` is not null" for c in [*by, "id", "term"]))
    held = checkpointed(scoped.groupBy(*by, "id").agg(F.collect_list("term").alias("terms")))
    blocks = held.groupBy(*by).agg(F.ceil(F.count("*") / CELL_SETS).alias("_blocks"))
    dealt = held.join(blocks, by).withColumn("_block", F.pmod(F.xxhash64("id"), "_blocks")).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
    dealt = dealt.select(*by, F.least("_block", "_k").alias("_x"), F.greatest("_block", "_k").alias("_y"), "_block", "id", "terms")
    # cells are few bytes and much work: as many tasks as shuffles have partitions
    spread = dealt.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, "_x", "_y")
    kind = lambda c: sets.schema[c].dataType.simpleString()
    schema = ", ".join([*(f"`{c}` {kind(c)}" for c in by), f"a {kind('id')}, b {kind('id')}, shared long"])
    return spread.groupBy(*by, "_x", "_y").applyInArrow(_overlaps_in_cell(by, least_shared), schema)


def _overlaps_in_cell(by: list[str], least: int):
    """Counts of a cell: each term adds one at all its left by all its right sets; pairs leave it by some rows at a time."""
    import numpy as np
    import pyarrow.compute as pc

    def postings(codes: np.ndarray, rows: np.ndarray, terms: int):
        """Rows and their repeats by term, and where each term's begin."""
        keys, n = np.unique(codes * (rows.max(initial=0) + 1) + rows, return_counts=True)
        code, row = np.divmod(keys, rows.max(initial=0) + 1)
        return row, n, np.searchsorted(code, np.arange(terms + 1))

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).select(["_block", "id", "terms"]).combine_chunks()
        ids, lists, block = (table.column(c).combine_chunks() for c in ("id", "terms", "_block"))
        x, y = key[-2].as_py(), key[-1].as_py()
        block, n = block.to_numpy(zero_copy_only=False), table.num_rows
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        encoded = pc.dictionary_encode(lists.flatten())
        codes, terms = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(encoded.dictionary)
        place = np.empty(n, np.int64)
        place[pc.sort_indices(ids).to_numpy(zero_copy_only=False)] = np.arange(n)
        members = [np.flatnonzero(block == k) for k in (x, y)]
        sides = []
        for own in members:
            at = np.full(n, -1)
            at[own] = np.arange(len(own))
            row = np.repeat(at, sizes)
            sides.append(postings(codes[row >= 0], row[row >= 0], terms))
        (left, left_n, left_at), (right, right_n, right_at) = sides
        most = int(sizes.max(initial=0)) * int(max(left_n.max(initial=1), right_n.max(initial=1)))
        counts = np.zeros((len(members[0]), len(members[1])), np.min_scalar_type(most))
        a, b = np.diff(left_at), np.diff(right_at)
        for t in np.flatnonzero(a * b >= 256):
            l, r = slice(left_at[t], left_at[t + 1]), slice(right_at[t], right_at[t + 1])
            counts[left[l][:, None], right[r]] += np.outer(left_n[l], right_n[r]).astype(counts.dtype)
        rare = np.flatnonzero((a * b > 0) & (a * b < 256))
        product = (a * b)[rare]
        t = np.repeat(rare, product)
        step = np.arange(len(t)) - np.repeat(np.cumsum(product) - product, product)
        l, r = left_at[t] + step // b[t], right_at[t] + step % b[t]
        np.add.at(counts, (left[l], right[r]), (left_n[l] * right_n[r]).astype(counts.dtype))
        for first in range(0, len(counts), 64):
            part = counts[first : first + 64]
            p, q = np.nonzero(part >= least)
            one, other = members[0][p + first], members[1][q]
            keep = place[one] < place[other] if x == y else np.ones(len(one), bool)
            one, other, shared = one[keep], other[keep], part[p, q][keep].astype(np.int64)
            swapped = place[one] > place[other]
            low, high = np.where(swapped, other, one), np.where(swapped, one, other)
            if len(low):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(k, len(low)) for k in key[:-2]), ids.take(pa.array(low)), ids.take(pa.array(high)), pa.array(shared)], names=[*by, "a", "b", "shared"])

    return run


def shared_terms(left: DataFrame, right: DataFrame, within: Column | None = None) -> DataFrame:
    """``a, b, shared``: how many terms each pair of a left and a right document shares, with ``within`` as a condition on a and b."""
    pairs = left.select(F.col("id").alias("a"), "term").join(right.select(F.col("id").alias("b"), "term"), "term")
    if within is not None:
        pairs = pairs.where(within)
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared"))


def set_similarity(sets: DataFrame, least: float = 0.0, least_shared: int = 1, within: Column | None = None, other: DataFrame | None = None) -> DataFrame:
    """``a, b, shared, jaccard, overlap`` of pairs of term sets, each pair once (a < b) or left by right with ``other``."""
    from .state import checkpointed

    if other is None:
        sets = checkpointed(sets)  # read three times
    right = sets if other is None else other
    rule = (F.col("a") < F.col("b")) if other is None else F.lit(True)
    pairs = shared_terms(sets, right, rule if within is None else rule & within)
    size = lambda s, name: s.groupBy("id").agg(F.count("*").alias(f"size_{name}")).withColumnRenamed("id", name)
    out = pairs.join(size(sets, "a"), "a").join(size(right, "b"), "b")
    out = out.withColumn("jaccard", F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared")))
    out = out.withColumn("overlap", F.col("shared") / F.least("size_a", "size_b"))
    return out.where((F.col("jaccard") >= least) & (F.col("shared") >= least_shared)).select("a", "b", "shared", "jaccard", "overlap")


def top_neighbours(pairs: DataFrame, score: str, top: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The best partners of each ``a`` (of a scope), ties to the smaller ``b``."""
    order = Window.partitionBy(*by, "a").orderBy(F.desc(score), "b")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def both_ways(pairs: DataFrame) -> DataFrame:
    """Each pair in both directions; pairs are computed once, not once for each."""
    rest = [c for c in pairs.columns if c not in ("a", "b")]
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    return pairs.select(F.explode(ways).alias("_way"), *rest).select("_way.a", "_way.b", *rest)


def tfidf_cosine(counts: DataFrame, by: list[str], least: float, top: int, max_df_ratio: float = 0.75) -> DataFrame:
    """``by..., a, b, cosine``: pairs a < b of one scope (``by..., id, term, n``) that survive in the top list of a, whatever b's list says.

    Terms in more than ``max_df_ratio`` of a scope's members have no weight.
    """
    size = counts.select(*by, "id").distinct().groupBy(*by).agg(F.count("*").alias("of"))
    df = counts.groupBy(*by, "term").agg(F.count("*").alias("df")).join(size, by).where(F.col("df") <= max_df_ratio * F.col("of"))
    weighted = counts.join(df, [*by, "term"]).select(*by, "id", "term", (F.col("n") * (F.log((F.col("of") + 1) / (F.col("df") + 1)) + 1)).alias("w"))
    norms = weighted.groupBy(*by, "id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = weighted.join(norms, [*by, "id"]).select(*by, "id", "term", (F.col("w") / F.col("norm")).alias("w"))
    a, b = (unit.select(*by, F.col("id").alias(x), "term", F.col("w").alias(f"w_{x}")) for x in "ab")
    pairs = a.join(b, [*by, "term"]).where("a < b").groupBy(*by, "a", "b").agg(F.sum(F.col("w_a") * F.col("w_b")).alias("cosine")).where(F.col("cosine") >= least)
    pairs = pairs.withColumn("cosine", F.round("cosine", 9))  # ties must not hang on the order of a sum
    return top_neighbours(both_ways(pairs), "cosine", top, tuple(by)).where("a < b").select(*by, "a", "b", "cosine")


def with_shared_terms(pairs: DataFrame, terms: DataFrame, by: list[str], most: int) -> DataFrame:
    """``pairs`` (``by..., a, b`` and more) with ``shared_terms``: the first ``most`` terms in order that both sides have.

    ``terms`` has ``by..., id, term``. Only pairs that are left after all ranking are joined with term sets.
    """
    sets = terms.groupBy(*by, "id").agg(F.array_sort(F.collect_set("term")).alias("_terms"))
    for side in "ab":
        pairs = pairs.join(sets.select(*by, F.col("id").alias(side), F.col("_terms").alias(f"_{side}")), [*by, side])
    return pairs.withColumn("shared_terms", F.slice(F.array_intersect("_a", "_b"), 1, most)).drop("_a", "_b")


def cooccurrence(counts: DataFrame, top_terms: int) -> DataFrame:
    """Pairs of the most frequent terms by the documents that hold both: count, Jaccard, overlap and their mean."""
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    chosen = df.orderBy(F.desc("df"), "term").limit(top_terms)
    held = counts.join(F.broadcast(chosen), "term").select("id", "term", "df")
    a, b = held.select("id", F.col("term").alias("left"), F.col("df").alias("df_left")), held.select("id", F.col("term").alias("right"), F.col("df").alias("df_right"))
    pairs = a.join(b, "id").where("left < right").groupBy("left", "right", "df_left", "df_right").agg(F.count("*").alias("together"))
    j, o = F.col("together") / (F.col("df_left") + F.col("df_right") - F.col("together")), F.col("together") / F.least("df_left", "df_right")
    return pairs.select("left", "right", "together", j.alias("jaccard"), o.alias("overlap"), ((j + o) / 2).alias("score"))


def window_pairs(docs: DataFrame, width: int, id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
    """``left, right, n, distance``: pairs of terms at most ``width`` places apart in one document, self pairs included."""
    words = docs.select(F.col(id_col).alias("id"), tokens(text_col, **options).alias("w"))
    # neighbours come from the document's own array: no join, no shuffle before the count
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(width)), lambda k: F.transform(F.filter(F.sequence(F.lit(1), F.greatest(F.size("w"), F.lit(1))), lambda i: i + k <= F.size("w")), lambda i: F.struct(F.get("w", i - 1).alias("x"), F.get("w", i + k - 1).alias("y"), k.alias("k")))))
    pairs = words.select(F.explode(steps).alias("p")).select(F.least("p.x", "p.y").alias("left"), F.greatest("p.x", "p.y").alias("right"), "p.k")
    return pairs.groupBy("left", "right").agg(F.count("*").alias("n"), F.avg("k").alias("distance"))


def ngram_counts(docs: DataFrame, n: int, id_col: str = "id", text_col: str = "text", **options) -> DataFrame:
    """``term, n, documents``: runs of n tokens over all documents."""
    found = docs.select(F.col(id_col).alias("row"), F.explode(ngrams(tokens(text_col, **options), n)).alias("term"))
    return found.groupBy("row", "term").agg(F.count("*").alias("n")).groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("documents"))


def bridge_terms(sets: DataFrame, label: str, least: int = 2) -> DataFrame:
    """Terms under at least so many labels, with the labels in order."""
    return sets.groupBy("term").agg(F.count_distinct(label).alias("labels"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("names")).where(F.col("labels") >= least)


def greedy_match(pairs: DataFrame, score: str, per_a: int, per_b: int, limit: int | None = None) -> DataFrame:
    """Accept pairs from the best on while both sides have room; ties by a, then b.

    Whether a pair is accepted depends only on the better pairs of its own a and b, so pairs are
    decided in rounds: one that ranks within the room that is left on both its sides, counting all
    open better pairs, is accepted at once, and one whose side is full is dropped. Every round decides
    at least the best open pair of each component; nothing is collected.
    """
    from .state import checkpointed

    open_pairs = checkpointed(pairs.withColumn("_order", F.struct((-F.col(score)).alias("s"), "a", "b")))
    done = None
    while not open_pairs.isEmpty():
        taken = done
        if taken is None:
            ranked = open_pairs.withColumns({"_ta": F.lit(0), "_tb": F.lit(0)})
        else:
            ta, tb = taken.groupBy("a").agg(F.count("*").alias("_ta")), taken.groupBy("b").agg(F.count("*").alias("_tb"))
            ranked = open_pairs.join(ta, "a", "left").join(tb, "b", "left").fillna(0, ["_ta", "_tb"])
        ranked = ranked.where((F.col("_ta") < per_a) & (F.col("_tb") < per_b))
        ranked = ranked.withColumns({"_ra": F.row_number().over(Window.partitionBy("a").orderBy("_order")) + F.col("_ta"), "_rb": F.row_number().over(Window.partitionBy("b").orderBy("_order")) + F.col("_tb")})
        ranked = checkpointed(ranked)
        accept = (F.col("_ra") <= per_a) & (F.col("_rb") <= per_b)
        fresh = ranked.where(accept).drop("_ta", "_tb", "_ra", "_rb")
        done = checkpointed(fresh if done is None else done.unionByName(fresh))
        open_pairs = ranked.where(~accept).drop("_ta", "_tb", "_ra", "_rb")
    if done is None:
        return pairs
    out = done.drop("_order")
    return out if limit is None else out.orderBy(F.desc(score), "a", "b").limit(limit)


