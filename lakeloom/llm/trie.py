"""A trie of conversation prefixes with counts, leaves and the tokens that shared prefixes save.

Turns become digests, a conversation the string of its digests (its path), and equal conversations one
path with a count. Paths are hash-partitioned by the digest of their first turn; a task builds the
subtries of its paths from dictionaries that point to child nodes, and sums them up in iterative postorder.
A first turn with more turns behind it than a task should hold is repartitioned by the next turn, again and again:
the run of nodes that all its paths share is taken off as a chain, and what follows it spreads by the turn after.
Leaves and savings of the subtries are added to the chains above them from the lowest round up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Bytes of a turn's digest in a path, of SHA-256.
DIGEST = 16
#: Turns of different paths that one task's trie holds, about.
TASK_TURNS = 50_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, own``: each conversation's turns in order, as structs of a digest (hex) and a number of words."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    role = text("role")
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text("text")).cast("binary"), 256), 1, 2 * DIGEST)
    turn = F.col("turn").cast("long")
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(turn.isNotNull().alias("known"), F.coalesce(turn, F.lit(0)).alias("turn"), digest.alias("digest"), F.regexp_count(text("text"), F.lit(WORD)).alias("words")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("own"))


def paths(turns: DataFrame) -> DataFrame:
    """``conv_id, path binary, words array<int>`` from lists of turns ``conv_id, turns``."""
    joined = F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    return turns.select("conv_id", joined.alias("path"), F.transform("turns", lambda t: t["words"]).alias("words"))


def digest_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, n, ends``: of each run of equal ``pid`` the first id, its length and the digest of its ids, which ascend."""
    names = ["conv_id", "n", "ends"]
    pid, first, n, state = None, None, 0, None
    for batch in batches:
        done: list[tuple] = []
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        a = 0
        while a < len(keys):
            b = a
            while b < len(keys) and keys[b] == keys[a]:
                b += 1
            part = ",".join(map(str, ids[a:b])).encode()
            if keys[a] == pid:
                state.update(b"," + part)
                n += b - a
            else:
                if state is not None:
                    done.append((first, n, state.hexdigest()))
                pid, first, n, state = keys[a], ids[a], b - a, hashlib.sha256(part)
            a = b
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], names=names)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in ([first], [n], [state.hexdigest()])], names=names)


def distinct_paths(rows: DataFrame) -> DataFrame:
    """``c, n, ends, path, words``: each path once, with its smallest id, its number of conversations and the digest of their ids.

    The ids of a path are hashed as they pass in a sorted partition, so a path of any number of conversations needs no list of them.
    """
    ids = rows.select(F.sha2("path", 256).alias("pid"), "conv_id").repartition("pid").sortWithinPartitions("pid", "conv_id")
    ids = ids.mapInArrow(digest_runs, "conv_id long, n long, ends string")
    return rows.join(ids, "conv_id").select(F.col("conv_id").alias("c"), "n", "ends", "path", "words")


def digest_at(depth: Column) -> Column:
    """The digest of the turn that follows ``depth`` turns of a path."""
    return F.substring(F.col("path"), depth * DIGEST + 1, F.lit(DIGEST))


def key_below(depth: Column) -> Column:
    """The name of the subtrie of a path whose top is the turn that follows ``depth`` turns."""
    return F.sha2(F.substring(F.col("path"), F.lit(1), (depth + 1) * DIGEST), 256)


def build_tries(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes below ``depth`` of the given paths, which may belong to several subtries (``key``); ``above`` names the chain over a subtrie's top."""
    tops: dict[str, int] = {}
    kids: list[dict[bytes, int]] = []
    parent, depth, words, convs, first, ends = [], [], [], [], [], []
    above, above_conv = [], []

    def node(up: int, d: int, w: int, over: str | None, over_conv: int | None) -> int:
        kids.append({})
        for column, value in ((parent, up), (depth, d), (words, w), (convs, 0), (first, None), (ends, NO_ENDS), (above, over), (above_conv, over_conv)):
            column.append(value)
        return len(kids) - 1

    for r in rows.itertuples(index=False):
        at = -1
        for d in range(r.depth, len(r.path) // DIGEST):
            step = r.path[d * DIGEST : (d + 1) * DIGEST]
            known = kids[at].get(step) if at >= 0 else tops.get(r.key)
            if known is None:
                top = at < 0
                known = node(at, d + 1, int(r.words[d]), r.above if top else None, r.above_conv if top else None)
                if top:
                    tops[r.key] = known
                else:
                    kids[at][step] = known
            at = known
            convs[at] += r.n
            first[at] = r.c if first[at] is None else min(first[at], r.c)
        ends[at] = r.ends
    leaves, saved = [0] * len(kids), [0] * len(kids)
    for top in tops.values():
        stack = [(top, iter(kids[top].values()))]
        while stack:  # postorder: a node is summed up when its children are through
            at, rest = stack[-1]
            child = next(rest, None)
            if child is not None:
                stack.append((child, iter(kids[child].values())))
                continue
            stack.pop()
            leaves[at] += not kids[at]
            saved[at] += (convs[at] - 1) * words[at]
            if parent[at] >= 0:
                leaves[parent[at]] += leaves[at]
                saved[parent[at]] += saved[at]
    up = [above_conv[i] if p < 0 else first[p] for i, p in enumerate(parent)]
    columns = {"conv_id": first, "depth": depth, "parent_conv_id": up, "n_convs": convs, "n_children": [len(k) for k in kids], "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "above": above}
    return pd.DataFrame(columns)


def prefix_trie(conversations: DataFrame, task_turns: int = TASK_TURNS, scope: str = "lakeloom") -> DataFrame:
    """One row per node of the trie of ``conv_id, turns`` (turns: structs of ``digest`` in hex and ``words``); ids are distinct.

    A node is a sequence of first turns. ``conv_id`` is its smallest member, ``n_leaves`` and ``saved_tokens`` are summed over
    its subtree. No conversations give no rows; conversations without turns end at the root.
    """
    rows = materialize(distinct_paths(materialize(paths(conversations), scope)), scope)
    width = (F.octet_length("path") / DIGEST).cast("int")
    empty = F.lit(NO_ENDS)
    here = F.max(F.when(F.octet_length("path") == F.col("depth") * DIGEST, F.col("ends")))
    summary = [F.sum("n").alias("n"), F.min("c").alias("c")]
    # the root is the first chain; it has no words
    root = rows.withColumn("depth", F.lit(0)).groupBy().agg(*summary, here.alias("ends"), F.count_distinct(F.when(width > 0, digest_at(F.lit(0)))).alias("children"))
    root = root.where("n is not null").select(F.lit("").alias("key"), F.lit(None).cast("string").alias("above"), F.lit(None).cast("long").alias("above_conv"), F.lit(-1).alias("from"), F.lit(0).alias("to"), "n", "c", F.coalesce("ends", empty).alias("ends"), "children", F.array(F.lit(0)).alias("words"))
    chains = [materialize(root, scope)]
    lowest = rows.agg(F.min("c")).first()[0]
    held = rows.where(width > 0).select(key_below(F.lit(0)).alias("key"), F.lit("").alias("above"), F.lit(lowest).cast("long").alias("above_conv"), F.lit(0).alias("depth"), "c", "n", "ends", "path", "words")
    fit: list[DataFrame] = []
    while True:
        held = materialize(held, scope)
        big = held.groupBy("key", "above", "above_conv", "depth").agg(*summary, F.count("*").alias("paths"), F.sum(width - F.col("depth")).alias("turns"), F.min("path").alias("low"), F.max("path").alias("high"))
        big = big.where((F.col("paths") > 1) & (F.col("turns") > task_turns))
        lengths = F.sequence(F.col("depth") + 1, (F.least(F.octet_length("low"), F.octet_length("high")) / DIGEST).cast("int"))
        shared = F.size(F.filter(lengths, lambda k: F.substring(F.col("low"), F.lit(1), k * DIGEST) == F.substring(F.col("high"), F.lit(1), k * DIGEST)))
        big = materialize(big.withColumn("to", F.col("depth") + shared).drop("low", "high", "turns", "paths"), scope)
        if not big.head(1):
            fit.append(held)
            break
        named = F.broadcast(big.select("key", "to", F.col("c").alias("chain_conv"))) if big.count() <= 10_000 else big.select("key", "to", F.col("c").alias("chain_conv"))
        fit.append(held.join(named, "key", "left_anti"))
        open_ = held.join(named, "key")
        ends_here = F.octet_length("path") == F.col("to") * DIGEST
        tail = open_.groupBy("key").agg(F.max(F.when(ends_here, F.col("ends"))).alias("ends"), F.count_distinct(F.when(~ends_here, digest_at(F.col("to")))).alias("children"), F.first(F.slice("words", F.col("depth") + 1, F.col("to") - F.col("depth"))).alias("words"))
        chain = big.join(tail, "key").select("key", "above", "above_conv", F.col("depth").alias("from"), "to", "n", "c", F.coalesce("ends", empty).alias("ends"), "children", "words")
        chains.append(materialize(chain, scope))
        held = open_.where(~ends_here).select(key_below(F.col("to")).alias("key"), F.col("key").alias("above"), F.col("chain_conv").alias("above_conv"), F.col("to").alias("depth"), "c", "n", "ends", "path", "words")
    some = fit[0]
    for part in fit[1:]:
        some = some.unionByName(part)
    total = some.agg(F.coalesce(F.sum(width - F.col("depth")), F.lit(0))).first()[0]
    shard = F.pmod(F.xxhash64("key"), F.lit(max(1, -(-total // task_turns)))).alias("shard")
    tries = materialize(some.withColumn("shard", shard).groupBy("shard").applyInPandas(lambda t: build_tries(t), NODE + ", above string"), scope)
    out, below = [tries.drop("above")], tries.where("above is not null").select("above", "n_leaves", "saved_tokens")
    for chain in reversed(chains):
        sums = below.groupBy(F.col("above").alias("key")).agg(F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        whole = chain.join(sums, "key", "left").withColumns({"leaves": F.coalesce("leaves", F.lit(1)), "saved": F.coalesce("saved", F.lit(0))})
        rest = lambda k: F.aggregate(F.slice("words", k, F.size("words")), F.lit(0).cast("long"), lambda a, w: a + w)
        nodes = whole.withColumn("d", F.explode(F.sequence(F.col("from") + 1, F.col("to"))))
        last = F.col("d") == F.col("to")
        out.append(
            nodes.select(
                F.col("c").alias("conv_id"), F.col("d").cast("long").alias("depth"), F.when(F.col("d") == F.col("from") + 1, F.col("above_conv")).otherwise(F.col("c")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
                F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"),
                (F.col("saved") + (F.col("n") - 1) * rest(F.col("d") - F.col("from"))).alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(empty).alias("ends_sha256"),
            )
        )
        tops = whole.select("above", F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * rest(F.lit(1))).alias("saved_tokens"))
        below = materialize(below.where(F.col("above").isNotNull()).join(chain.select(F.col("key").alias("above")), "above", "left_anti").unionByName(tops.where("above is not null")), scope)
    nodes = out[0]
    for part in out[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def with_shared_openings(lists: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``conv_id, turns``: each conversation with its first h turns, h below ``most`` by its id's CRC-32, from the conversation with the id rounded down to ``every``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    base = lists.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("own", 1, most - 1).alias("opening"))
    both = lists.withColumn("base", F.col("conv_id") - F.col("conv_id") % every).join(base, "base", "left")
    opening = F.coalesce(F.slice("opening", F.lit(1), h), F.slice("own", 1, 0))
    return both.select("conv_id", F.concat(opening, F.slice("own", h + 1, F.size("own"))).alias("turns"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations with shared openings.

    Turns go by their number (nulls first), then by the digest of role and text; a null role or text is empty, a row
    with a null ``conv_id`` takes no part, a repeated row is a turn of its own, other columns are ignored.
    """
    from .common import table

    return prefix_trie(with_shared_openings(turn_lists(table(spark, sf_dir, "conversations"))))


def _sql() -> str:
    from .repair import crc32_sql

    return rf"""
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, turn from conversations where conv_id is not null),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, left(sha256(octet_length(role::blob)::varchar || ':' || role || text), {2 * DIGEST})) as pos from turns),
ids as (select conv_id, conv_id - conv_id % 20 as base, {crc32_sql("conv_id::varchar")} % 4 as h from (select distinct conv_id from turns)),
taken as (
  select i.conv_id, p.role, p.text, p.pos as pos, 0 as part from ids i join placed p on p.conv_id = i.base and p.pos <= i.h
  union all
  select i.conv_id, p.role, p.text, p.pos as pos, 1 as part from ids i join placed p on p.conv_id = i.conv_id and p.pos > i.h),
rebuilt as (select conv_id, row_number() over (partition by conv_id order by part, pos) as d, {{'role': role, 'text': text}} as turn, len(regexp_extract_all(text, '{WORD}')) as words from taken),
chains as (
  select conv_id, d, list(turn) over (partition by conv_id order by d) as path, words from rebuilt
  union all select conv_id, 0, [], 0 from ids),
lengths as (select conv_id, max(d) as last from chains group by conv_id),
nodes as (
  select d as depth, path, min(c.conv_id) as conv_id, count(*) as n_convs, max(words) as words,
    sha256(coalesce(string_agg(c.conv_id::varchar, ',' order by c.conv_id) filter (d = last), '')) as ends
  from chains c join lengths l on c.conv_id = l.conv_id group by d, path),
links as (select n.*, p.conv_id as parent from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = n.path[1:n.depth - 1]),
children as (select depth - 1 as depth, parent as conv_id, count(*) as n from links where parent is not null group by all),
below as (
  select a.depth, a.conv_id, count(*) filter (c.n is null) as leaves, sum((b.n_convs - 1) * b.words) as saved
  from links a join links b on b.depth >= a.depth and b.path[1:a.depth] = a.path left join children c on c.depth = b.depth and c.conv_id = b.conv_id
  group by a.depth, a.conv_id)
select l.conv_id, l.depth::bigint as depth, l.parent as parent_conv_id, l.n_convs::bigint as n_convs, coalesce(c.n, 0)::bigint as n_children,
  b.leaves::bigint as n_leaves, b.saved::bigint as saved_tokens, l.ends as ends_sha256
from links l join below b on b.depth = l.depth and b.conv_id = l.conv_id left join children c on c.depth = l.depth and c.conv_id = l.conv_id
"""


OP11_SQL = _sql()
