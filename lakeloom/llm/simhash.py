"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2k bits share a variant that differs from each in at most
k bits. Every fingerprint emits all such variants, equal variants meet in one task, and what meets is
linked and verified.

Variants travel folded: those of one fingerprint that begin with the same bits go to the same task,
so the fingerprint is sent there once and unfolded there. The number of leading bits follows from
the number of fingerprints; a fingerprint reaches 1 + b + b(b-1)/2 tasks for b bits and radius 4, not 2081.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize
from .components import components

#: Variants that a task unfolds at a time, and about how many of them it gets in all.
UNFOLD = 2_000_000
TASK_VARIANTS = 8 * UNFOLD

#: Fingerprints that one task gets of the variants that begin alike; classes with more are split by further bits.
CLASS_ROWS = 1_000_000

#: Documents and words of a block of candidates, and members of a large group that all its blocks compare with.
BLOCK = 2048
BLOCK_WORDS = 2_000_000
CENTRES = 16


def shingle_hashes(text: str | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle of ``words`` words, repeats included, of the text with A-Z lower-cased.

    Words are runs of bytes other than ASCII white space; a text of fewer words is one shingle.
    """
    parts = (text or "").encode().lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    data = b" ".join(parts)
    gaps = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(data)]
    hash64 = xxhash.xxh64_intdigest
    return np.array([hash64(data[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=False)] if len(parts) >= words else [hash64(data, seed)], np.uint64)


def fingerprint(hashes: np.ndarray, weights: np.ndarray | None = None, block: int = 1 << 16) -> int:
    """The bits that are set in over half of the hashes (by weight), as a signed 64-bit number."""
    if not len(hashes):
        return 0
    count = np.zeros(64)
    for a in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[a : a + block].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        count += bits.sum(axis=0, dtype=np.int64) if weights is None else weights[a : a + block] @ bits
    total = len(hashes) if weights is None else weights.sum()
    return int(np.packbits(count * 2 > total).view(">i8")[0])


def fingerprints(documents: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp long``: the SimHash of each whole text; texts without words have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(shingle_hashes(t.as_py(), words)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def flips(bits: int, most: int) -> np.ndarray:
    """All masks over the lowest ``bits`` bits with at most ``most`` of them set."""
    return np.array([sum(1 << k for k in c) for n in range(most + 1) for c in combinations(range(bits), n)], np.uint64)


def star_links(variants: np.ndarray, owner: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the owners of each variant that occurs again to the smallest of them."""
    ordered = np.sort(variants)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    none = np.zeros(0, np.int64)
    if not len(again):
        return none, none
    place = lambda v: ((v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)
    marked = np.zeros(1 << 22, bool)
    marked[place(again)] = True
    some = np.flatnonzero(marked[place(variants)])
    at = np.searchsorted(again, variants[some])
    some = some[again[np.minimum(at, len(again) - 1)] == variants[some]]
    v, f = variants[some], fps[owner[some]]
    order = np.lexsort((f, v))
    v, f = v[order], f[order]
    new = np.concatenate(([True], v[1:] != v[:-1]))
    first = f[np.maximum.accumulate(np.where(new, np.arange(len(v)), 0))]
    pairs = np.unique(np.stack((first[~new], f[~new])), axis=1)
    return pairs[0], pairs[1]


def meet(fps: np.ndarray, base: np.ndarray, left: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among fingerprints whose variants share the leading 64 - ``bits`` bits of ``base``.

    ``left`` says how many of the other bits each may still flip. Where the variants would be too
    many to unfold at once, the next bit splits them in two.
    """
    sizes = {k: len(flips(bits, k)) for k in set(left.tolist())}
    if sum(sizes[k] for k in left.tolist()) <= UNFOLD or bits == 0:
        parts = []
        for k in sizes:
            rows = np.flatnonzero(left == k)
            mask = flips(bits, k)
            parts.append(((base[rows][:, None] ^ mask).ravel(), np.repeat(rows, len(mask))))
        yield star_links(np.concatenate([v for v, _ in parts]), np.concatenate([o for _, o in parts]), fps)
        return
    bit = np.uint64(1 << (bits - 1))
    for want in (np.uint64(0), bit):
        same = (base & bit) == want
        keep = same | (left > 0)
        if keep.sum() > 1:
            yield from meet(fps[keep], np.where(same, base, base ^ bit)[keep], np.where(same, left, left - 1)[keep], bits - 1)


def connect(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of the numbers 0 to n - 1 that each can reach by the links ``a``, ``b``."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        open_links = x != y
        if not open_links.any():
            return root
        a, b, x, y = a[open_links], b[open_links], x[open_links], y[open_links]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def ball_links(fps: DataFrame, rows: int, radius: int = 4, class_rows: int = CLASS_ROWS, scope: str = "lakeloom") -> DataFrame:
    """``a, b``: links that connect exactly the distinct fingerprints ``fp``, named by ``id``, within an even ``radius``.

    Whatever shares a variant is within the radius of each other, so the owners of a variant get a
    star of links instead of all pairs; each link is verified, and the links of a task leave it as a
    spanning forest, so their number is in proportion to the fingerprints. ``rows`` is the number of
    fingerprints and sets how finely variants are spread. A class of variants that gets more than
    ``class_rows`` fingerprints, as a large family of near-copies makes it, is split by further leading bits.
    """
    half = radius // 2
    total = rows * sum(math.comb(64, k) for k in range(half + 1))
    lead = min(24, max(3, math.ceil(math.log2(max(1, total / TASK_VARIANTS)))))

    def split(sent: DataFrame, old: int, new: int) -> DataFrame:
        kinds = [F.struct(F.lit(int(m)).alias("mask"), F.lit(int(m).bit_count()).alias("used")) for m in flips(new - old, half)]
        sent = sent.select("class", "spare", "fp", "id", F.explode(F.array(*kinds)).alias("way")).where("way.used <= spare")
        bits = F.shiftrightunsigned("fp", 64 - new).bitwiseAND(F.lit((1 << (new - old)) - 1)).bitwiseXOR(F.col("way.mask"))
        return sent.select(F.shiftleft("class", new - old).bitwiseOR(bits).alias("class"), (F.col("spare") - F.col("way.used")).alias("spare"), "fp", "id")

    sent = split(fps.select(F.lit(0).cast("long").alias("class"), F.lit(half).alias("spare"), "fp", "id"), 0, lead).withColumn("lead", F.lit(lead))
    done = []
    while rows > class_rows and lead < 64:  # a class never holds a fingerprint twice
        sent = materialize(sent, scope)
        many = materialize(sent.groupBy("class").count().where(F.col("count") > class_rows).select("class"), scope)
        if not many.head(1):
            break
        done.append(sent.join(many, "class", "left_anti"))
        more = min(64, lead + 12)
        sent = split(sent.join(many, "class", "left_semi"), lead, more).withColumn("lead", F.lit(more))
        lead = more
    for part in done:
        sent = sent.unionByName(part)

    def run(table: pa.Table) -> pa.Table:
        first = table.column("lead")[0].as_py()
        kind = np.uint64(table.column("class")[0].as_py() & (2**64 - 1))
        own, at = np.unique(table.column("fp").to_numpy().view(np.uint64), return_index=True)
        ids = table.column("id").to_numpy()[at]
        low = np.uint64((1 << (64 - first)) - 1)
        base = (own & low) | (kind << np.uint64(64 - first) if first < 64 else kind)
        left = half - np.bitwise_count(own ^ base).astype(np.int64)
        root = np.arange(len(own))
        for x, y in meet(own, base, left, 64 - first):
            x, y = x.astype(np.uint64), y.astype(np.uint64)
            near = np.bitwise_count(x ^ y) <= radius
            a, b = np.searchsorted(own, x[near]), np.searchsorted(own, y[near])
            root = connect(len(own), np.concatenate((np.arange(len(own)), a)), np.concatenate((root, b)))
        tied = np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"a": pa.array(ids[tied]), "b": pa.array(ids[root[tied]])})

    return sent.select("lead", "class", "fp", "id").groupBy("lead", "class").applyInArrow(run, "a long, b long").distinct()


def near_components(documents: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", scope: str = "lakeloom") -> DataFrame:
    """``doc_id, fp, component_id``: documents whose fingerprints are linked, directly or through others.

    Fingerprints within ``radius`` bits are linked. ``component_id`` is the smallest id reachable, its
    own included. Null and empty texts have fingerprint 0 and are linked like any others; equal
    texts share a fingerprint, which takes part once, however many they are; repeated rows are kept;
    a null id never names a component; an empty table gives no rows; other columns are ignored.
    """
    docs = materialize(fingerprints(documents, words, id_col, text_col), scope)
    fps = materialize(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), scope)
    found = components(ball_links(fps.select("fp", F.col("fp").alias("id")), fps.count(), radius, scope=scope), scope)
    roots = fps.join(found, fps["fp"] == found["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    roots = materialize(roots, scope)
    lowest = roots.groupBy("root").agg(F.min("first").alias("component_id"))
    named = roots.join(lowest, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    from .common import table

    found = near_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near-copies for filtering: candidates by ball hashing of word fingerprints, verified on shingles.


def word_fingerprints(documents: DataFrame, tables: int) -> DataFrame:
    """``doc_id, th, key, n, f0, f1, ... long``: hashes of the text and of its words, their number, and fingerprints over words.

    Words (A-Z lower-cased) weigh the root of how often they occur. Fingerprints over long shingles change too
    much between texts that share four fifths of them, those over words hardly change.
    """
    names = [f"f{k}" for k in range(tables)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64 = xxhash.xxh64_intdigest
        for batch in batches:
            rows: list[tuple] = []
            for text in batch.column(2):
                parts = (text.as_py() or "").encode().lower().split()
                count = Counter(parts)
                weight = np.sqrt(np.fromiter(count.values(), float, len(count)))
                h = np.array([hash64(w, 42) for w in count], np.uint64)
                found = []
                for k in range(tables):
                    with np.errstate(over="ignore"):
                        x = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * k)
                        found.append(fingerprint((x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB), weight))
                same = xxhash.xxh3_64_intdigest(b" ".join(parts))
                rows.append((same - 2**64 if same >> 63 else same, len(parts), *found))
            columns = list(zip(*rows, strict=True)) or [()] * (tables + 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns)], names=["doc_id", "th", "key", "n", *names])

    schema = ", ".join(["doc_id long", "th long", "key long", "n long", *(f"{n} long" for n in names)])
    return documents.select("doc_id", "th", "text").mapInArrow(run, schema)


def shingle_sets(documents: DataFrame, words: int) -> DataFrame:
    """``key, shingles array<long>``: the sorted distinct shingle hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                found = [np.unique(shingle_hashes(t.as_py(), words)).view(np.int64) for t in part.column(1)]
                ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found)))], names=["key", "shingles"])

    return documents.select("key", "text").mapInArrow(run, "key long, shingles array<long>")


def shared_counts(flat: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray, columns: int = 4096) -> np.ndarray:
    """How many of the numbers ``flat`` each owner in ``left`` shares with each in ``right``; no owner holds one twice."""
    _, at, count = np.unique(flat, return_inverse=True, return_counts=True)
    again = count[at] > 1
    owner, at = owner[again], (np.cumsum(count > 1) - 1)[at[again]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    total = int(at[-1]) + 1 if len(at) else 0
    shared = np.zeros((len(left), len(right)), np.float32)  # exact up to 2**24
    held = np.zeros((int(max(left.max(), right.max(), owner.max(initial=0))) + 1, min(columns, total)), np.float32)
    for c in range(0, total, columns):
        lo, hi = np.searchsorted(at, (c, c + columns))
        held[:] = 0
        held[owner[lo:hi], at[lo:hi] - c] = 1
        shared += held[left] @ held[right].T
    return shared


def alike(sizes: np.ndarray, flat: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets, one of ``left`` and one of ``right``, with a Jaccard similarity of ``least`` or more; ``flat`` holds the sets end to end."""
    shared = shared_counts(flat, np.repeat(np.arange(len(sizes)), sizes), left, right)
    x, y = np.nonzero(shared >= least * (sizes[left][:, None] + sizes[right] - shared) - 1e-3)
    found, x, y = shared[x, y].astype(float), left[x], right[y]
    near = (x != y) & (found >= least * (sizes[x] + sizes[y] - found) - 1e-9)
    return x[near], y[near]


def similar(groups: DataFrame, sets: DataFrame, least: float, scope: str = "lakeloom") -> DataFrame:
    """``node, root``: the smallest key that each key of a group ``key, group, n`` reaches by Jaccard similarities of ``least`` or more.

    Similarity is not transitive, so no document can stand for another. A group is dealt into blocks
    of about ``BLOCK`` documents or ``BLOCK_WORDS`` words (``n`` a document) at most. All pairs of a block and
    its pairs with ``CENTRES`` members of the whole group are compared. A family of near-copies is one
    component by then; what is not in the largest component of its group is compared with
    all blocks of the group. So every pair that may still join two components is compared, and the work on a
    family grows in proportion to it. What a task finds leaves it as a spanning forest.
    """
    many = groups.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS)).cast("int").alias("blocks"), F.count("*").alias("docs"), F.sum("n").alias("words"))
    many = materialize(many.where("docs > 1"), scope)
    small, large = many.where("blocks = 1").agg(F.coalesce(F.sum("words"), F.lit(0)), F.count("*")).first(), many.where("blocks > 1")
    shards = max(1, -(-small[0] // BLOCK_WORDS), -(-small[1] // BLOCK))
    rows = groups.join(many.drop("words", "docs"), "group").withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    rows = materialize(rows.join(sets, "key").select("group", "blocks", "block", "key", "n", "shingles"), scope)
    place = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("group"), F.lit(shards))).otherwise(F.col("group")).alias("place")
    first = Window.partitionBy("group").orderBy(F.xxhash64("key"), "key")
    centres = rows.where("blocks > 1").select("group", "blocks", "key").withColumn("at", F.row_number().over(first)).where(F.col("at") <= CENTRES)
    centres = materialize(centres.select("group", "key"), scope)
    everywhere = rows.join(F.broadcast(centres) if centres.count() <= 10_000 else centres, ["group", "key"], "left_semi")
    everywhere = everywhere.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = "a long, b long"

    def forest(keys: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]]) -> pa.Table:
        a, b = (np.concatenate([p[k] for p in pairs] or [np.zeros(0, np.int64)]) for k in (0, 1))
        own, ends = np.unique(np.concatenate((keys[a], keys[b])), return_inverse=True)
        root = connect(len(own), ends[: len(a)], ends[len(a) :])
        tied = np.flatnonzero(root != np.arange(len(own)))
        return pa.table({"a": pa.array(own[tied], pa.int64()), "b": pa.array(own[root[tied]], pa.int64())})

    def columns(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        lists = table.column("shingles").combine_chunks()
        return table.column("group").to_numpy(), table.column("key").to_numpy(), lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()

    def inside(table: pa.Table) -> pa.Table:
        table = table.sort_by([("group", "ascending"), ("key", "ascending")])
        group, keys, sizes, flat = columns(table)
        again = np.concatenate(([False], (group[1:] == group[:-1]) & (keys[1:] == keys[:-1])))  # a centre in its own block
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        ends, pairs = np.append(0, np.cumsum(sizes)), []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = np.flatnonzero(~again[a:b])
            if len(some) > 1:
                x, y = alike(sizes[a:b], flat[ends[a] : ends[b]], some, some, least)
                pairs.append((x + a, y + a))
        return forest(keys, pairs)

    def across(table: pa.Table) -> pa.Table:
        _, keys, sizes, flat = columns(table)
        open_ = table.column("open").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(open_), np.flatnonzero(~open_)
        return forest(keys, [alike(sizes, flat, left, right, least)] if len(left) and len(right) else [])

    wanted = ["group", "block", "key", "shingles"]
    dealt = rows.select(place, *wanted).unionByName(everywhere.select(F.col("group").alias("place"), *wanted))
    links = materialize(dealt.groupBy("place", "block").applyInArrow(inside, schema), scope)
    found = materialize(components(links, scope), scope)
    if not large.head(1):
        discard(rows, links)
        return found
    members = rows.where("blocks > 1").select("group", "key", "n", "blocks").join(found, F.col("key") == F.col("node"), "left")
    members = members.select("group", "key", "n", "blocks", F.coalesce("root", "key").alias("part"))
    main = members.groupBy("group", "part").count().groupBy("group").agg(F.max_by("part", F.struct("count", "part")).alias("main"))
    rest = materialize(members.join(main, "group").where("part <> main").select("group", "key", "n", "blocks"), scope)
    parts = rest.groupBy("group").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_WORDS)).cast("int").alias("parts"))
    if not parts.head(1):
        return found
    # an open side of the rest, dealt anew, against a closed side of all members
    lists = rows.select("group", "block", "key", "shingles")
    one = lists.join(rest.select("group", "key", "blocks"), ["group", "key"]).join(parts, "group")
    one = one.select("group", F.pmod(F.xxhash64("key", F.lit(1)), "parts").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "key", "shingles", F.lit(True).alias("open"))
    other = lists.join(parts, "group").select("group", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", "key", "shingles", F.lit(False).alias("open"))
    more = materialize(one.unionByName(other).groupBy("group", "part", "block").applyInArrow(across, schema), scope)
    return components(links.unionAll(more), scope)


def near_copies(documents: DataFrame, words: int = 5, least: float = 0.8, tables: int = 4, radius: int = 4, scope: str = "lakeloom") -> DataFrame:
    """``doc_id, th, group_id``: documents that are copies of others (``th``: the hash of the text), and the smallest id of their group.

    Texts with equal words (A-Z lower-cased) are copies. Of the rest, candidates are the texts with
    word fingerprints within ``radius`` bits in one of ``tables`` tables, directly or through others; of
    these, all pairs with a Jaccard similarity of ``least`` or more over distinct shingles of ``words``
    words are linked, and links make groups. Texts are told apart by 64-bit hashes of their words, so an id with two texts
    takes part with each. Documents without a copy do not appear, nor do rows with a null id or without words.
    """
    whole = documents.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    whole = whole.withColumn("th", F.xxhash64(F.coalesce("text", F.lit(""))))
    docs = materialize(word_fingerprints(whole, tables).where("n > 0"), scope)
    names = [f"f{k}" for k in range(tables)]
    rep = F.min(F.struct("doc_id", "th")).alias("rep")
    texts = materialize(docs.groupBy("key").agg(rep, F.count("*").alias("copies"), F.max("n").alias("n"), *(F.first(n).alias(n) for n in names)), scope)
    links = []
    for n in names:
        fps = materialize(texts.groupBy(F.col(n).alias("fp")).agg(F.min("key").alias("id"), F.count("*").alias("texts")), scope)
        links.append(materialize(ball_links(fps.select("fp", "id"), fps.count(), radius, scope=scope), scope))
        first = fps.where("texts > 1").select("fp", F.col("id").alias("a"))
        links.append(texts.join(first, texts[n] == first["fp"]).where("key <> a").select("a", F.col("key").alias("b")))
    close = components(functools.reduce(DataFrame.unionAll, links), scope)
    close = materialize(texts.join(close, texts["key"] == close["node"]).select("key", F.col("root").alias("group"), "n", "rep.*"), scope)
    discard(*links)
    one = whole.join(close.select("doc_id", "th", "key").hint("shuffle_hash"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    sets = shingle_sets(one, words)
    groups = materialize(similar(close.select("key", "group", "n"), sets, least, scope), scope)
    discard(close)
    named = texts.join(groups, texts["key"] == groups["node"], "left").select("key", "copies", "rep.doc_id", F.coalesce("root", "key").alias("root"), F.col("root").isNotNull().alias("linked"))
    named = materialize(named.where("linked or copies > 1"), scope)
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("group_id"))
    return docs.join(named.select("key", "root").join(lowest, "root"), "key").select("doc_id", "th", "group_id")


def drop_near_copies(documents: DataFrame, scope: str = "lakeloom", **options) -> DataFrame:
    """The documents without all but one (the one with the smallest id) of each group of near-copies.

    Rows with a null id or without words are kept as they are. Of an id with two texts only the copies
    go; equal rows stay or go together.
    """
    found = near_copies(documents, scope=scope, **options)
    gone = materialize(found.where("doc_id <> group_id").select(F.col("doc_id").alias("gone_id"), F.col("th").alias("gone_th")).distinct(), scope)
    same = (documents["doc_id"].cast("long") == gone["gone_id"]) & (F.xxhash64(F.coalesce(documents["text"], F.lit(""))) == gone["gone_th"])
    return documents.join(gone, same, "left_anti")
