"""Removal of long repeated passages with suffix arrays.

A suffix array over a whole corpus is cut into independent ones: every window of ``length`` bytes
belongs to the smallest hash of its ``gram``-byte grams, so equal windows belong to equal hashes.
Consecutive windows of one hash form a segment. Segments of a hash that occurs once cannot hold a
repeat; the others are reduced to distinct ones with their counts, and those of a few hashes at a
time share a suffix array. It is built by two-stage sorting: suffixes smaller than their successors
are sorted, the others follow from a scan of the buckets; then adjacent common prefixes tell which
windows occur again. The windows of a hash that has too many different segments for one array, as a very
common passage in many surroundings gives, are cut again by longer grams, at last by the windows themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

LENGTH, GRAM = 400, 128
#: Most windows of a segment; longer runs of one hash (periodic texts) are cut.
SEGMENT_STARTS = 4096
#: Bytes of segments that share a suffix array, about.
SHARD_BYTES = 1_000_000
#: The segments of hashes with more distinct ones than this, more than fit a shard, are cut again by a longer gram.
HOT_SEGMENTS = 4096
_TABLE = np.random.default_rng(20240401).integers(0, 1 << 64, 256, dtype=np.uint64)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of every run of ``size`` bytes or word codes, from those of powers of two, which follow by doubling."""
    h, k, p = _TABLE[data] if data.dtype == np.uint8 else spread(data.astype(np.uint64)), 1, np.uint64(0x9E3779B97F4A7C15)
    n, out, at = len(data) - size + 1, np.zeros(max(0, len(data) - size + 1), np.uint64), 0
    with np.errstate(over="ignore"):
        while True:
            if size & k:
                out = out * np.uint64(0xD6E8FEB86659FD93) + h[at : at + n]
                at += k
            if 2 * k > size:
                break
            h = h[:-k] * p + h[k:]
            k, p = 2 * k, p * p
    return spread(out)


def spread(x: np.ndarray) -> np.ndarray:
    """Mix the bits of ``x`` in place."""
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def finer_grams(length: int, gram: int) -> list[int]:
    """The longer grams by which segments are cut again: twice as long, nearly a window, a window."""
    return sorted({g for g in (2 * gram, length - length // 25, length) if gram < g <= length})


def sliding(x: np.ndarray, width: int, ufunc: np.ufunc, fill: np.uint64) -> np.ndarray:
    """Running minimum or maximum over windows of ``width``, from two scans of blocks of that width."""
    n = len(x) - width + 1
    if n < 1:
        return x[:0]
    blocks = np.full(-(-len(x) // width) * width, fill, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    head = ufunc.accumulate(blocks, axis=1).ravel()
    tail = ufunc.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return ufunc(tail[:n], head[width - 1 : width - 1 + n])


def segments(data: np.ndarray, first: np.ndarray, size: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts laid end to end: text, start (in ``data``), windows, hash, repeats of the hash inside."""
    none = np.zeros(0, np.int64)
    width = length - gram + 1
    h = gram_hashes(data, gram) if len(data) >= length else np.zeros(0, np.uint64)
    low = sliding(h, width, np.minimum, np.uint64(2**64 - 1))
    if not len(low):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    count = np.maximum(0, size - length + 1)
    text = np.repeat(np.arange(len(size)), count)
    start = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first, count)
    value = low[start]
    if not len(start):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, bool)
    change = np.concatenate(([True], (value[1:] != value[:-1]) | (text[1:] != text[:-1])))
    at = np.flatnonzero(change)
    runs = np.diff(np.append(at, len(start)))
    if runs.max() > SEGMENT_STARTS:  # cut long runs
        pieces = -(-runs // SEGMENT_STARTS)
        inner = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        at = np.repeat(at, pieces) + inner * SEGMENT_STARTS
        runs = np.diff(np.append(at, len(start)))
    seg_start, seg_hash = start[at], value[at]
    # positions whose hash is the smallest of some window, to see which segments hold theirs twice
    valid = np.zeros(len(h), np.uint64)
    valid[start] = value
    top = sliding(np.concatenate((np.zeros(width - 1, np.uint64), valid)), width, np.maximum, np.uint64(0))
    place = np.flatnonzero(top == h)
    own, rank = np.unique(h[place], return_inverse=True)
    span = len(data) + 1
    key = np.sort(rank * span + place)
    of = np.searchsorted(own, seg_hash) * span
    inside = np.searchsorted(key, of + seg_start + runs - 1 + width) - np.searchsorted(key, of + seg_start)
    return text[at], seg_start, runs, seg_hash, inside > 1


def two_stage_sort(text: np.ndarray, wanted: np.ndarray, raw: bytes, end: np.ndarray, length: int) -> np.ndarray:
    """Positions ``wanted`` and those they are induced from, in the order of their first ``length`` bytes.

    ``text`` holds bytes plus one and a zero before and behind every segment; ``end`` is where each
    position's segment ends. A suffix is of type S if it is smaller than its successor, else L.
    """
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int16), append=0))
    at = np.arange(n, dtype=np.int32)
    decided = np.where(step != 0, at, np.int32(n - 1))
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    small = step[decided] > 0
    small[text == 0] = True
    # an L suffix is induced from its successor, up to the next S suffix or the end of the segment
    next_small = np.minimum.accumulate(np.where(small, at, np.int32(n - 1))[::-1])[::-1]
    last = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, last + 1, 1)
    np.add.at(edge, np.minimum(next_small[np.minimum(last + 1, n - 1)], n - 1) + 1, -1)
    inset = wanted | (np.cumsum(edge[:n]) > 0) | (text == 0)
    direct = np.flatnonzero(inset & small & (text > 0)).astype(np.int32)
    direct = direct[np.argsort(text[direct], kind="stable")]
    cuts = np.searchsorted(text[direct], np.arange(258))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):  # one bucket's keys are held at a time
        part = direct[a:b]
        keys = [raw[x:y] for x, y in zip(part.tolist(), np.minimum(part + length, end[part]).tolist(), strict=True)]
        direct[a:b] = part[sorted(range(len(keys)), key=keys.__getitem__)]
    buckets: list[list[np.ndarray]] = [[] for _ in range(257)]
    large = inset & ~small
    order = []

    def induce(found: np.ndarray, c: int) -> np.ndarray:
        before = found - 1
        before = before[large[before]]
        chars = text[before]
        by = np.argsort(chars, kind="stable")
        before, chars = before[by], chars[by]
        at = np.flatnonzero(np.concatenate(([True], chars[1:] != chars[:-1]))) if len(chars) else []
        same = before[:0]
        for k, a in enumerate(at):
            part = before[a : at[k + 1] if k + 1 < len(at) else None]
            if chars[a] == c:
                same = part
            else:
                buckets[chars[a]].append(part)
        return same

    for c in range(257):
        wave = np.concatenate(buckets[c]) if buckets[c] else np.zeros(0, np.int32)
        buckets[c] = []
        while len(wave):  # suffixes that begin with a run of c
            order.append(wave)
            wave = induce(wave, c)
        seeds = np.flatnonzero(text == 0)[1:].astype(np.int32) if c == 0 else direct[cuts[c] : cuts[c + 1]]
        if len(seeds):
            order.append(seeds)
            induce(seeds, c)
    return np.concatenate(order) if order else np.zeros(0, np.int64)


def common_prefixes(raw: np.ndarray, order: np.ndarray, length: int, chunk: int = 8192) -> np.ndarray:
    """Common prefix of each position with the one before it in the order, ``length`` at most; the first has 0."""
    out = np.zeros(len(order), np.int64)
    view = np.lib.stride_tricks.sliding_window_view(raw, length)
    for a in range(1, len(order), chunk):
        rows = view[order[a - 1 : a + chunk]]
        differs = rows[1:] != rows[:-1]
        where = differs.argmax(axis=1)
        out[a : a + chunk] = np.where(differs[np.arange(len(where)), where], where, length)
    return out


def repeated_starts(parts: list[bytes], counts: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """For each distinct segment the runs (first, last) of windows that occur at least twice among all.

    ``counts`` says how often each segment occurs.
    """
    raw = b"\0" + b"\0".join(parts) + b"\0"
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    first = 1 + np.cumsum(size + 1) - size - 1
    data = np.frombuffer(raw, np.uint8)
    text = data.astype(np.uint16) + 1
    text[0] = 0
    text[first + size] = 0
    owner = np.zeros(len(raw), np.int32)
    owner[first] = 1
    owner = np.maximum(np.cumsum(owner, dtype=np.int32) - 1, 0)
    wanted = np.zeros(len(raw) + 1, np.int8)
    np.add.at(wanted, first, 1)
    np.add.at(wanted, first + size - length + 1, -1)
    wanted = np.cumsum(wanted[:-1], dtype=np.int8) > 0
    order = two_stage_sort(text, wanted, raw, (first + size).astype(np.int32)[owner], length)
    order = order[wanted[order]]
    new = common_prefixes(data, order, length) < length
    group = np.cumsum(new) - 1
    times = np.bincount(group, counts[owner[order]].astype(float)) if len(order) else np.zeros(0)
    again = np.sort(order[times[group] >= 2]) if len(order) else order
    found: list[list[tuple[int, int]]] = [[] for _ in parts]
    if len(again):
        cut = np.flatnonzero((np.diff(again) > 1) | (np.diff(owner[again]) > 0)) + 1
        for a, b in zip(again[np.append(0, cut)].tolist(), again[np.append(cut - 1, len(again) - 1)].tolist(), strict=True):
            k = int(owner[a])
            found[k].append((a - int(first[k]), b - int(first[k])))
    return found


def keyed(documents: DataFrame, id_col: str, text_col: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``_id`` and ``_h``, which together name a document and its text, ``_text``, the id, and the columns in ``keep`` as ``_k0``, ``_k1``, ..."""
    text, own = F.coalesce(F.col(f"`{text_col}`"), F.lit("")), F.col(f"`{id_col}`").cast("long")
    kept = [F.col(f"`{c}`").alias(f"_k{k}") for k, c in enumerate(keep)]
    return documents.select(F.coalesce(own, F.lit(-(2**63))).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("_text"), own.alias("_doc"), *kept)


def stored(value: pa.Scalar) -> bytes:
    """The bytes of a string or binary value."""
    data = value.as_py()
    return data.encode() if isinstance(data, str) else data


def find_segments(rows: DataFrame, length: int, gram: int, unit: int = 1) -> DataFrame:
    """``h, seg, _id, _h, start int, n int, twice boolean``: every segment of every text, in bytes.

    With a ``unit`` of 4 bytes windows start at whole word codes only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, size = 0, 0
            sizes = [len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(2)]
            for b, s in enumerate(sizes):
                size += s
                if size >= 1_000_000 or b == len(sizes) - 1:
                    yield found(batch.slice(a, b + 1 - a))
                    a, size = b + 1, 0

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [stored(t) for t in batch.column(2)]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        joined, first = b"".join(texts), np.cumsum(size) - size
        data = np.frombuffer(joined, "<u4" if unit == CODE else np.uint8)
        text, start, n, h, twice = segments(data, first // unit, size // unit, length // unit, gram // unit)
        start, n = start * unit, (n - 1) * unit + 1
        hash64 = xxhash.xxh3_64_intdigest
        seg = np.array([hash64(joined[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)], np.uint64)
        rows = pa.array(text)
        return pa.RecordBatch.from_pydict(
            {
                "h": pa.array(h.view(np.int64)),
                "seg": pa.array(seg.view(np.int64)),
                "_id": batch.column(0).take(rows),
                "_h": batch.column(1).take(rows),
                "start": pa.array((start - first[text]).astype(np.int32)),
                "n": pa.array(n.astype(np.int32)),
                "twice": pa.array(twice),
            }
        )

    schema = "h long, seg long, _id long, _h long, start int, n int, twice boolean"
    return rows.where(F.octet_length("_text") >= length).select("_id", "_h", "_text").mapInArrow(run, schema)


def fetch(rows: DataFrame, distinct: DataFrame, length: int) -> DataFrame:
    """``h, seg, times long, data binary``: the bytes of the distinct segments; repeated rows may send one twice."""
    asked = F.collect_list(F.struct("h", "seg", "times", "start", "n")).alias("asked")
    wanted = distinct.select("h", "seg", "times", "rep.*").groupBy("_id", "_h").agg(asked)
    rows = rows.select("_id", "_h", "_text").join(wanted.hint("shuffle_hash"), ["_id", "_h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for text, asked in zip(batch.column(0), batch.column(1), strict=True):
                data = stored(text)
                for q in asked.as_py():
                    a, n = q["start"], q["n"]
                    out.append((q["h"], q["seg"], q["times"], data[a : a + n + length - 1]))
                    size += n + length
                    if size > 4_000_000:
                        yield packed(out)
                        out, size = [], 0
            if out:
                yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = {"h": pa.int64(), "seg": pa.int64(), "times": pa.int64(), "data": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], names=list(kinds))

    return rows.select("_text", "asked").mapInArrow(run, "h long, seg long, times long, data binary")


def cut_again(parts: DataFrame, length: int, gram: int) -> DataFrame:
    """``h, seg, times, start int, h2, seg2 long, twice boolean, data binary``: the segments of segments by another gram; ``h2`` also tells the ``h``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64 = xxhash.xxh3_64_intdigest
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = part.column(3).to_pylist()
                size = np.fromiter(map(len, texts), np.int64, len(texts))
                joined, first = b"".join(texts), np.cumsum(size) - size
                text, start, n, h, twice = segments(np.frombuffer(joined, np.uint8), first, size, length, gram)
                data = [joined[x:y] for x, y in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True)]
                of = part.column(0).take(pa.array(text))
                own = (h ^ (of.to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))).view(np.int64)
                seg = np.array([hash64(x) for x in data], np.uint64).view(np.int64)
                columns = {"h": of, "seg": part.column(1).take(pa.array(text)), "times": part.column(2).take(pa.array(text)), "start": pa.array((start - first[text]).astype(np.int32))}
                yield pa.RecordBatch.from_pydict(columns | {"h2": pa.array(own), "seg2": pa.array(seg), "twice": pa.array(twice), "data": pa.array(data, pa.binary())})

    return parts.select("h", "seg", "times", "data").mapInArrow(run, "h long, seg long, times long, start int, h2 long, seg2 long, twice boolean, data binary")


RUNS = "array<struct<a:int,b:int>>"


def shifted(runs: str, by: str):
    return F.transform(runs, lambda r: F.struct((r["a"] + F.col(by)).alias("a"), (r["b"] + F.col(by)).alias("b")))


def solve(parts: DataFrame, length: int, grams: list[int], scope: str) -> DataFrame:
    """``h, seg, runs``: runs (first, last) of windows that occur again, for distinct segments ``h, seg, times, data``.

    Segments of one hash share a suffix array with those of a few others. Those of a hash with more than
    ``HOT_SEGMENTS`` distinct ones are cut by the next longer gram, which spreads them over further hashes; by the last gram,
    a whole window, a hash has one segment.
    """

    def run(table: pa.Table) -> pa.Table:
        held = {}
        for h, seg, times, data in zip(*(table.column(c).to_pylist() for c in ("h", "seg", "times", "data")), strict=True):
            held.setdefault((h, seg), (times, data))
        found = repeated_starts([d for _, d in held.values()], np.array([t for t, _ in held.values()], np.int64), length)
        rows = [(h, seg, [{"a": a, "b": b} for a, b in runs]) for (h, seg), runs in zip(held, found, strict=True) if runs]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({"h": pa.array(columns[0], pa.int64()), "seg": pa.array(columns[1], pa.int64()), "runs": pa.array(columns[2], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))})

    hot = materialize(parts.groupBy("h").agg(F.count_distinct("seg").alias("kinds")).where(F.col("kinds") > HOT_SEGMENTS).select("h"), scope) if grams else None
    some = hot is not None and bool(hot.head(1))
    cold = parts.join(hot, "h", "left_anti") if some else parts
    total = cold.agg(F.coalesce(F.sum(F.octet_length("data")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = cold.select("h", "seg", "times", "data", F.pmod(F.xxhash64("h"), F.lit(shards)).alias("shard"))
    found = materialize(dealt.groupBy("shard").applyInArrow(run, f"h long, seg long, runs {RUNS}"), scope)
    if not some:
        return found
    again = materialize(cut_again(parts.join(hot, "h", "left_semi").dropDuplicates(["h", "seg"]), length, grams[0]), scope)
    often = again.groupBy("h2").agg(F.sum("times").alias("k"), F.max("twice").alias("twice")).where("k > 1 or twice").select("h2")
    again = materialize(again.join(often, "h2").drop("twice"), scope)
    inner = materialize(again.groupBy(F.col("h2").alias("h"), F.col("seg2").alias("seg")).agg(F.sum("times").alias("times"), F.first("data").alias("data")), scope)
    inside = solve(inner, length, grams[1:], scope).select(F.col("h").alias("h2"), F.col("seg").alias("seg2"), "runs")
    back = again.join(inside, ["h2", "seg2"]).select("h", "seg", shifted("runs", "start").alias("runs"))
    return found.unionByName(materialize(back.groupBy("h", "seg").agg(F.flatten(F.collect_list("runs")).alias("runs")), scope))


def repeats(rows: DataFrame, length: int = LENGTH, gram: int = GRAM, scope: str = "lakeloom", unit: int = 1) -> DataFrame:
    """``_id, _h, runs array<struct<a,b>>``: first and last windows of the runs that occur elsewhere too; with a ``unit`` those in between may be missing unless they start at one."""
    all_segments = materialize(find_segments(rows, length, gram, unit), scope)
    often = all_segments.groupBy("h").agg(F.count("*").alias("k"), F.max("twice").alias("twice")).where("k > 1 or twice").select("h")
    some = materialize(all_segments.join(often, "h").drop("twice"), scope)
    discard(all_segments)
    rep = F.min(F.struct("_id", "_h", "start", "n")).alias("rep")
    distinct = some.groupBy("h", "seg").agg(F.count("*").alias("times"), rep)
    parts = materialize(fetch(rows, distinct, length), scope)
    found = solve(parts, length, finer_grams(length, gram), scope)
    placed = some.join(found, ["h", "seg"]).select("_id", "_h", shifted("runs", "start").alias("runs"))
    placed = materialize(placed.groupBy("_id", "_h").agg(F.flatten(F.collect_list("runs")).alias("runs")), scope)
    discard(some, parts, found)
    return placed


def spans(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], r["b"] + length) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), text: bool = False, least_words: int = 0, passage_words: int = 0, scope: str = "lakeloom") -> DataFrame:
    """Remove every byte that a ``length``-byte string covers which also starts anywhere else.

    Returns a row a row of the input: ``doc_id, n_bytes, n_removed, n_spans long, kept binary`` and
    the columns in ``keep``; with ``text`` also ``kept_text``, the kept bytes without those that are no
    whole character. With ``least_words`` only maximal runs of at least so many words go. With ``passage_words`` there are also
    ``n_passage_words, n_passages long``: the words (between ASCII white space) that a run of so many words covers which also starts
    anywhere else, however few its bytes, and the maximal runs of them; they stay in ``kept``. Strings are UTF-8 bytes of one text, judged on the input; overlaps and
    repeats within a text count; all copies of a passage go. Null texts count as empty, texts shorter
    than ``length`` stay whole; repeated rows are copies of each other; an empty table gives no rows.
    Bytes may be cut inside a character. Columns of any name may be there; only the id, the text and ``keep`` are read.
    """
    rows = keyed(documents, id_col, text_col, keep)
    joined = rows.join(repeats(rows, length, gram, scope).withColumnRenamed("runs", "_runs"), ["_id", "_h"], "left")
    if passage_words:
        joined = joined.join(repeated_word_runs(rows, passage_words, scope=scope).withColumnRenamed("runs", "_again"), ["_id", "_h"], "left")
    kinds = dict(documents.dtypes)
    joined = joined.select("_doc", "_text", "_runs", *["_again"] * bool(passage_words), *(f"_k{k}" for k in range(len(keep))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, count, kept = [], [], [], []
            for own, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = own.as_py().encode()
                cut = [(a, b) for a, b in spans(runs.as_py(), length) if not least_words or len(data[a:b].split()) >= least_words]
                at, rest = 0, []
                for a, b in cut:
                    rest.append(data[at:a])
                    at = b
                rest.append(data[at:])
                kept.append(b"".join(rest))
                sizes.append(len(data))
                removed.append(len(data) - len(kept[-1]))
                count.append(len(cut))
            out = {"doc_id": batch.column(0), "n_bytes": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept": pa.array(kept, pa.binary())}
            if text:
                out["kept_text"] = pa.array([b.decode("utf-8", "ignore") for b in kept], pa.string())
            if passage_words:
                found = [word_spans(runs.as_py(), passage_words) for runs in batch.column(3)]
                out["n_passage_words"] = pa.array([sum(b - a for a, b in runs) for runs in found], pa.int64())
                out["n_passages"] = pa.array([len(runs) for runs in found], pa.int64())
            yield pa.RecordBatch.from_pydict(out | {c: batch.column(3 + bool(passage_words) + k) for k, c in enumerate(keep)})

    passages = [f"{c} long" for c in ("n_passage_words", "n_passages")] * bool(passage_words)
    schema = ", ".join(["doc_id long", "n_bytes long", "n_removed long", "n_spans long", "kept binary", *["kept_text string"] * text, *passages, *(f"`{c}` {kinds[c]}" for c in keep)])
    return joined.mapInArrow(run, schema)


#: Bytes that stand for a word.
CODE = 4
#: Words of a repeated passage, at least.
PASSAGE_WORDS = 50
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


#: Longer words are hashed one by one.
LONG_WORD = 64
_POWERS = np.cumprod(np.full(LONG_WORD, 0xD6E8FEB86659FD93, np.uint64))


def codes_of(texts: list[bytes]) -> list[bytes]:
    """The words of each text, between ASCII white space, as codes of ``CODE`` bytes."""
    joined = b" ".join(texts) + b" "
    data = np.frombuffer(joined, np.uint8)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge[1:] == 1) + 1
    if not len(start):
        return [b""] * len(texts)
    at = np.arange(len(data), dtype=np.int32)
    offset = at - np.maximum.accumulate(np.where(edge == -1, at, np.int32(0)))
    value = _TABLE[data] * _POWERS[np.minimum(offset, LONG_WORD - 1)]
    value[space] = 0
    codes = (spread(np.add.reduceat(value, start)) >> np.uint64(32)).astype("<u4")
    for k in np.flatnonzero(end - start > LONG_WORD).tolist():
        codes[k] = xxhash.xxh32_intdigest(joined[start[k] : end[k]])
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    cuts = np.searchsorted(start, np.cumsum(size)).tolist()
    return [codes[x:y].tobytes() for x, y in zip([0, *cuts], cuts, strict=False)]


def word_codes(rows: DataFrame) -> DataFrame:
    """``_id, _h, _text binary``: the words of each text, between ASCII white space, as codes of ``CODE`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, some, size = [], [], 0
            for t in batch.column(2):
                some.append(stored(t))
                size += len(some[-1])
                if size >= 200_000:
                    out += codes_of(some)
                    some, size = [], 0
            out += codes_of(some)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["_id", "_h", "_text"])

    return rows.select("_id", "_h", "_text").mapInArrow(run, "_id long, _h long, _text binary")


def word_spans(runs: list[dict] | None, words: int) -> list[tuple[int, int]]:
    """Maximal runs of words (first, behind the last) from runs of windows over codes; windows between two words count for nothing."""
    whole = [{"a": -(-r["a"] // CODE), "b": r["b"] // CODE} for r in runs or ()]
    return spans([r for r in whole if r["a"] <= r["b"]], words)


def repeated_word_runs(rows: DataFrame, words: int, gram: int = 16, scope: str = "lakeloom") -> DataFrame:
    """``_id, _h, runs``: runs of windows of ``words`` word codes that occur elsewhere too, for ``word_spans``."""
    codes = materialize(word_codes(rows), scope)
    found = repeats(codes, CODE * words, CODE * gram, scope, CODE)
    discard(codes)
    return found


def remove_repeated_words(documents: DataFrame, words: int = 50, gram: int = 16, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), scope: str = "lakeloom") -> DataFrame:
    """Remove every word that a run of ``words`` words covers which also starts anywhere else.

    The suffix arrays are over sequences of words, each a code of 32 bits, so a run of short words is found as one of long words, and
    none of fewer words is; runs that differ in words of equal code only would count as equal. Returns a row a row of the
    input: ``doc_id, n_words, n_removed, n_spans long, kept_text string`` and the columns in ``keep``. Words are what lies between
    ASCII white space; runs are judged on the input, and white space between words does not matter; overlaps and repeats within a text count; all copies
    of a passage go, with the white space inside, and that around it stays. Null texts count as empty, texts of fewer words stay whole; repeated rows are copies of each other; an
    empty table gives no rows. Columns of any name may be there; only the id, the text and ``keep`` are read.
    """
    rows = keyed(documents, id_col, text_col, keep)
    found = repeated_word_runs(rows, words, gram, scope).withColumnRenamed("runs", "_runs")
    kinds = dict(documents.dtypes)
    joined = rows.join(found, ["_id", "_h"], "left")
    joined = joined.select("_doc", "_text", "_runs", *(f"_k{k}" for k in range(len(keep))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, count, kept = [], [], [], []
            for own, runs in zip(batch.column(1), batch.column(2), strict=True):
                data = stored(own)
                cut = word_spans(runs.as_py(), words)
                places = [m.span() for m in WORD.finditer(data)] if cut else []
                at, rest = 0, []
                for a, b in cut:
                    rest.append(data[at : places[a][0]])
                    at = places[b - 1][1]
                rest.append(data[at:])
                kept.append(b"".join(rest).decode())
                sizes.append(len(places) if cut else len(data.split()))
                removed.append(sum(b - a for a, b in cut))
                count.append(len(cut))
            out = {"doc_id": batch.column(0), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(count, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            yield pa.RecordBatch.from_pydict(out | {c: batch.column(3 + k) for k, c in enumerate(keep)})

    schema = ", ".join(["doc_id long", "n_words long", "n_removed long", "n_spans long", "kept_text string", *(f"`{c}` {kinds[c]}" for c in keep)])
    return joined.mapInArrow(run, schema)


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """What is left of every document without the 400-byte strings that occur elsewhere, and its words in repeated passages of any length in bytes."""
    from .common import table

    kept = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), text=True, passage_words=PASSAGE_WORDS)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), F.col("kept_text").alias("text")]
    return kept.select(*columns, "n_passage_words", "n_passages")
