"""Best-fit packing of documents into sequences under conflicts of source and duplicate cluster."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents that are packed together; a corpus has as many such shards as it needs.
SHARD_ROWS = 2048


class Bins:
    """Open bins in the order of their residual capacity, each with bitmaps of what it must not take again.

    ``sources`` has one plane of bits for each document of a source that a bin may hold, so a set
    bit in the last plane means that the source is full; ``clusters`` has one bit a cluster.
    """

    def __init__(self, capacity: int, rows: int, sources: int, clusters: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.residual = np.empty(0, np.int64)  # ascending
        self.order = np.empty(0, np.int64)  # the bin behind each residual
        self.sources = np.zeros((per_source, rows, -(-max(1, sources) // 64)), np.uint64)
        self.clusters = np.zeros((rows, -(-max(1, clusters) // 64)), np.uint64)
        self.count = 0

    def place(self, size: int, source: int, cluster: int) -> int:
        """Put an item into the tightest compatible bin; cluster -1 conflicts with nothing."""
        source_bit, cluster_bit = np.uint64(1 << (source & 63)), np.uint64(1 << (cluster & 63)) if cluster >= 0 else np.uint64(0)
        at, step = int(np.searchsorted(self.residual, size)), 16
        while at < len(self.residual):  # successors, until one is compatible
            bins = self.order[at : at + step]
            free = (self.sources[-1, bins, source >> 6] & source_bit) == 0
            if cluster >= 0:
                free &= (self.clusters[bins, cluster >> 6] & cluster_bit) == 0
            hit = int(free.argmax())
            if free[hit]:
                at += hit
                chosen, left = int(bins[hit]), int(self.residual[at]) - size
                self.residual, self.order = np.delete(self.residual, at), np.delete(self.order, at)
                break
            at, step = at + step, step * 2
        else:
            chosen, left = self.count, self.capacity - size
            self.count += 1
        if left:
            to = int(np.searchsorted(self.residual, left))
            self.residual, self.order = np.insert(self.residual, to, left), np.insert(self.order, to, chosen)
        for plane in self.sources[:, chosen]:
            if not plane[source >> 6] & source_bit:
                plane[source >> 6] |= source_bit
                break
        if cluster >= 0:
            self.clusters[chosen, cluster >> 6] |= cluster_bit
        return chosen


def pack_shard(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """Bins of one shard's items (``doc_id, piece, n_tokens, source, cluster``), longest first."""
    rows = rows.sort_values(["n_tokens", "doc_id", "piece", "row"], ascending=[False, True, True, True], kind="stable")
    source, sources = pd.factorize(rows["source"])
    cluster, clusters = pd.factorize(rows["cluster"])
    shared = np.bincount(cluster, minlength=len(clusters)) > 1
    bit = np.where(shared, np.cumsum(shared) - 1, -1)
    bins = Bins(capacity, len(rows), len(sources), int(shared.sum()), per_source)
    found = [bins.place(n, s, c) for n, s, c in zip(rows["n_tokens"].tolist(), source.tolist(), bit[cluster].tolist(), strict=True)]
    return rows.assign(bin=np.array(found, np.int64))


def word_count(text) -> F.Column:
    """Words of a text, split at white space."""
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))


def pack(documents: DataFrame, capacity: int = 2048, per_source: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster=None, tokens=None) -> DataFrame:
    """Pack whole documents into sequences of ``capacity`` tokens.

    A document counts its words and one separator, or ``tokens`` (a column). One longer than the
    capacity is cut: its full pieces fill a bin each and the rest is packed like any other item.
    Items go, longest first, into the open bin with the least room that fits and conflicts with
    nothing: a bin holds at most ``per_source`` items of one source (null is a source) and at most
    one of a duplicate cluster (``cluster``, a column; by default documents with equal words).
    Corpora are split into shards of about 2048 documents by a hash of their id, words and row number, so
    repeated rows are spread as well, and packed each by itself.

    Returns a row a piece: ``doc_id, piece int, start long, n_tokens long, bin_id string, position
    int``; ``start`` is the piece's first token. Null and empty texts hold the separator only;
    repeated rows are items of their own and share a cluster; an empty table gives no rows; other
    columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = F.xxhash64(F.regexp_replace(F.trim(F.lower(text)), r"\s+", " ")) if cluster is None else cluster
    size = (word_count(F.col(text_col)) + 1 if tokens is None else F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1))).cast("long")
    items = documents.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        F.coalesce(own.cast("string"), F.lit("")).alias("cluster"),
        size.alias("size"),
        F.monotonically_increasing_id().alias("row"),
    )
    from .common import materialize

    items = materialize(items)  # the row numbers stay what they are when a task runs again
    shards = max(1, -(-items.count() // SHARD_ROWS))
    piece = F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / capacity).cast("int"))).alias("piece")
    items = items.select("*", piece).withColumn("start", F.col("piece").cast("long") * capacity)
    items = items.withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start")))
    full = F.col("n_tokens") == capacity
    alone = items.where(full).select("doc_id", "piece", "start", "n_tokens", F.concat(F.lit("f"), F.col("row"), F.lit("."), F.col("piece")).alias("bin_id"), F.lit(0).alias("position"))
    rest = items.where(~full).select("doc_id", "piece", "start", "n_tokens", "source", "cluster", "row", F.pmod(F.xxhash64("doc_id", "cluster", "size", "row"), F.lit(shards)).cast("int").alias("shard"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(rows, capacity, per_source)
        out["position"] = out.groupby("bin").cumcount().astype("int32")
        out["bin_id"] = "s" + str(out["shard"].iat[0]) + "." + out["bin"].astype(str)
        return out[["doc_id", "piece", "start", "n_tokens", "bin_id", "position"]]

    packed = rest.groupBy("shard").applyInPandas(run, "doc_id long, piece int, start long, n_tokens long, bin_id string, position int")
    return alone.unionByName(packed)


def sequences(documents: DataFrame, separator: str = "<|endoftext|>", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``bin_id, n_tokens long, doc_ids array<long>, tokens array<string>``: the packed sequences themselves.

    Tokens are the words of the documents in the order of their pieces, with the separator behind the last word of
    each document. A sequence has ``capacity`` tokens at most, so it is a bounded group. Of an id with several
    texts each has its pieces; options are those of ``pack`` but ``tokens``.
    """
    named = documents.select(F.xxhash64(id_col, F.coalesce(F.col(text_col), F.lit(""))).alias("doc_id"), F.col(id_col).cast("long").alias("own"), F.col(text_col).alias("text"), F.col(options.get("source_col", "source")).alias("source"))
    packed = pack(named, **{k: v for k, v in options.items() if k != "source_col"})
    words = F.concat(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.array(F.lit(separator)))
    texts = named.dropDuplicates(["doc_id"]).select("doc_id", "own", words.alias("w"))
    pieces = packed.join(texts, "doc_id").select("bin_id", "position", "own", F.slice("w", (F.col("start") + 1).cast("int"), F.col("n_tokens").cast("int")).alias("t"))
    rows = pieces.groupBy("bin_id").agg(F.array_sort(F.collect_list(F.struct("position", "own", "t"))).alias("p"))
    return rows.select("bin_id", F.size(F.flatten("p.t")).cast("long").alias("n_tokens"), F.col("p.own").alias("doc_ids"), F.flatten("p.t").alias("tokens"))


def op4_best_fit(spark, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens from all documents."""
    from .common import table

    return pack(table(spark, sf_dir, "documents"))
