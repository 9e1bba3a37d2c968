"""Stores as tables: incremental skip, upserts, caches, queues, merged counters and keyed memory.

All take the old table and the new rows and return the new table; the caller decides where it is
written, to a fresh path or version, never over what is still read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import global_row_number


def changed_files(found: DataFrame, known: DataFrame, keys: tuple[str, ...] = ("path", "mtime", "size")) -> DataFrame:
    """Files that are not in the store in this state."""
    return found.join(known.select(*keys).distinct(), list(keys), "left_anti")


def replace_paths(old: DataFrame, new: DataFrame, path: str = "path") -> DataFrame:
    """The store without what it had under the new paths, and the new rows."""
    return old.join(new.select(path).distinct(), path, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def add_weights(old: DataFrame, new: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Weights of equal keys add up."""
    return old.unionByName(new).groupBy(*keys).agg(F.sum(weight).alias(weight))


def upsert_keep_null(old: DataFrame, new: DataFrame, keys: list[str], replaced: tuple[str, ...] = ()) -> DataFrame:
    """New values win where they are not null; columns in ``replaced`` are taken from the new row as they are."""
    a, b = old.alias("o"), new.alias("n")
    rule = None
    for k in keys:
        part = F.col(f"o.{k}") == F.col(f"n.{k}")
        rule = part if rule is None else rule & part
    columns: list[Column] = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys]
    hit = F.col(f"n.{keys[0]}").isNotNull()
    for c in old.columns:
        if c not in keys:
            columns.append((F.when(hit, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) if c in replaced else F.coalesce(f"n.{c}", f"o.{c}")).alias(c))
    return a.join(b, rule, "full_outer").select(*columns)


def entry_key(*columns: str) -> Column:
    """SHA-256 of the columns as JSON with sorted names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns))).cast("binary"), 256)


def page(rows: DataFrame, order: list, limit: int, keep: Column) -> DataFrame:
    """The first ``limit`` rows of those to keep: the filter comes first."""
    return rows.where(keep).orderBy(*order).limit(limit)


def newest(rows: DataFrame, by: list[str], used: Column, top: int) -> DataFrame:
    """The ``top`` most recently used entries of each scope."""
    w = Window.partitionBy(*by).orderBy(used.desc(), *by)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def merged_counters(old: DataFrame, new: DataFrame, keys: list[str], top: int | None = None) -> DataFrame:
    """``keys, n``: counters add up; with ``top`` the largest of each first key stay, ties by the last key."""
    out = old.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"))
    if top is None:
        return out
    w = Window.partitionBy(keys[0]).orderBy(F.desc("n"), keys[-1])
    return out.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top).drop("_r")


def reordered(rows: DataFrame, first: list[str], id_col: str = "id", pos: str = "pos") -> DataFrame:
    """``pos`` anew: listed ids first in their order, the rest as before."""
    at = F.array_position(F.array(*(F.lit(x) for x in first)), F.col(id_col))
    held = rows.withColumns({"_first": F.when(at > 0, at).otherwise(len(first) + 1), "_pos": F.col(pos)}).drop(pos)
    return global_row_number(held, ["_first", "_pos"]).withColumnRenamed("_row", pos).drop("_first", "_pos")


def upsert_segments(old: DataFrame | None, new: DataFrame, by: list[str], id_col: str, order: str | None = None) -> DataFrame:
    """Segments with ``pos``: known ids take the new content at their old place, the others follow in their order."""
    mine = Window.partitionBy(*by).orderBy(order or id_col)
    if old is None:
        return new.withColumn("pos", F.row_number().over(mine))
    known = old.select(*by, id_col, "pos")
    last = old.groupBy(*by).agg(F.max("pos").alias("_last"))
    held = new.join(known, [*by, id_col], "left")
    again = held.where("pos is not null")
    added = held.where("pos is null").drop("pos").join(last, by, "left").withColumn("pos", F.coalesce("_last", F.lit(0)) + F.row_number().over(mine)).drop("_last")
    kept = old.join(new.select(*by, id_col), [*by, id_col], "left_anti")
    return kept.unionByName(again).unionByName(added)


def first_seen(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the first in order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def latest_memory(rows: DataFrame, by: list[str], id_col: str, order: list[str], most: int) -> DataFrame:
    """The last row of each id, and of these the newest ``most`` of each scope."""
    rest = [c for c in rows.columns if c not in (*by, id_col)]
    last = rows.groupBy(*by, id_col).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*by, id_col, "_row.*")
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return last.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= most).drop("_r")


def cache_store(entries: DataFrame, new: DataFrame, scope: list[str], key: str) -> DataFrame:
    """Cache entries (``scope..., key, content, used, uses``) after storing others: known keys take the new content, the later time and one more use a row."""
    fresh = new.groupBy(*scope, key).agg(F.max_by("content", "used").alias("content"), F.max("used").alias("used"), F.count("*").alias("uses"))
    both = entries.unionByName(fresh)
    return both.groupBy(*scope, key).agg(F.max_by("content", "used").alias("content"), F.max("used").alias("used"), F.sum("uses").alias("uses"))


def cache_delete(entries: DataFrame, keys: DataFrame, scope: list[str], key: str) -> DataFrame:
    return entries.join(keys.select(*scope, key).distinct(), [*scope, key], "left_anti")


def cache_stats(entries: DataFrame, scope: list[str]) -> DataFrame:
    """``scope..., entries, uses, last, mean_uses`` of a cache."""
    return entries.groupBy(*scope).agg(F.count("*").alias("entries"), F.sum("uses").alias("uses"), F.max("used").alias("last"), F.round(F.avg("uses"), 6).alias("mean_uses"))


def cache_features(similarity: Column, left: Column, right: Column, age_hours: Column) -> Column:
    """``[similarity, 1 - difference of the lengths by the larger, 1 / (1 + days)]`` of a prompt against a cache entry."""
    n, m = F.length(left), F.length(right)
    return F.array(similarity, 1 - F.abs(n - m) / F.greatest(n, m, F.lit(1)), 1 / (1 + F.greatest(age_hours, F.lit(0.0)) / 24))


def cache_admission(candidates: DataFrame, least_similarity: float, weights: list[float], bias: float, least_decision: float) -> DataFrame:
    """``query_id, entry_id, similarity, decision, hit``: the best cache entry of each prompt by similarity, then the smaller id, and whether a
    learned logistic unit over ``features`` accepts it."""
    best = candidates.groupBy("query_id").agg(F.max_by(F.struct("entry_id", "similarity", "features"), F.struct("similarity", -F.col("entry_id"))).alias("b")).select("query_id", "b.*")
    raw = sum((F.lit(w) * F.get("features", F.lit(k)) for k, w in enumerate(weights)), F.lit(bias))
    out = best.withColumn("decision", 1 / (1 + F.exp(-raw)))
    return out.withColumn("hit", (F.col("similarity") >= least_similarity) & (F.col("decision") >= least_decision)).drop("features")


def replay(rows: DataFrame, by: list[str], order: str, features: Column, label: Column, rate: float, kind: str = "logistic") -> DataFrame:
    """``weights, bias`` of each group after one pass of an online learner over its rows in order.

    The pass is a fold over the sorted array of a group, inside the JVM: perceptron, hinge or logistic steps.
    """
    held = rows.select(*by, F.struct(F.col(order).alias("o"), features.alias("x"), label.cast("double").alias("y")).alias("r"))
    held = held.groupBy(*by).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    start = F.struct(F.transform(F.get("rs", F.lit(0))["x"], lambda _: F.lit(0.0)).alias("w"), F.lit(0.0).alias("b"))

    def step(s: Column, r: Column) -> Column:
        raw = F.aggregate(F.zip_with(s["w"], r["x"], lambda w, x: w * x), F.lit(0.0), lambda t, v: t + v) + s["b"]
        if kind == "logistic":
            error = r["y"] - 1 / (1 + F.exp(-raw))
        elif kind == "perceptron":
            error = r["y"] - F.when(raw >= 0, 1.0).otherwise(0.0)
        else:
            sign = 2 * r["y"] - 1
            error = F.when(sign * raw < 1, sign).otherwise(0.0)
        return F.struct(F.zip_with(s["w"], r["x"], lambda w, x: w + rate * error * x).alias("w"), (s["b"] + rate * error).alias("b"))

    return held.select(*by, F.aggregate("rs", start, step).alias("m")).select(*by, F.col("m.w").alias("weights"), F.col("m.b").alias("bias"))
