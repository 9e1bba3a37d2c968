"""Operators over ordered sequences: lags, islands, buckets, windows, budgets and packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import jaccard


def micros(ts) -> Column:
    """Microseconds since 1970 of a timestamp's wall clock; independent of the session's zone for zone-less ones."""
    at = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), at.cast("timestamp_ntz"))


def rank_score(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``score``: 1 for the first of each group down to 0 for the last; 1 for one alone."""
    n, i = F.count("*").over(Window.partitionBy(*by)), F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumns({"_n": n, "_i": i}).withColumn("score", F.when(F.col("_n") == 1, 1.0).otherwise(1 - (F.col("_i") - 1) / (F.col("_n") - 1))).drop("_n", "_i")


def shifts(df: DataFrame, by: list[str], order: list[str], speaker: str, terms: Column, marker: Column, low: float = 0.2) -> DataFrame:
    """Score of each step against the one before: 0.4 another speaker, 0.3 a marker, 0.3 a low Jaccard similarity; at most 1."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_terms", terms).withColumns({"_before": F.lag("_terms").over(w), "_speaker": F.lag(speaker).over(w)})
    similarity = jaccard(F.col("_terms"), F.col("_before"))
    score = F.when(F.col("_speaker") != F.col(speaker), 0.4).otherwise(0.0) + F.when(marker, 0.3).otherwise(0.0) + F.when(similarity < low, 0.3).otherwise(0.0)
    return out.where("_before is not null").withColumns({"similarity": similarity, "score": F.least(F.round(score, 6), F.lit(1.0))}).drop("_terms", "_before", "_speaker")


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, most: int | None = None) -> DataFrame:
    """``island``: runs of rows that no break starts anew, cut after ``most`` rows; numbered from 1 within the group."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_new", F.when(breaks, 1).otherwise(0)).withColumn("_run", F.sum("_new").over(w))
    if most is None:
        return out.withColumn("island", F.col("_run") - F.min("_run").over(Window.partitionBy(*by)) + 1).drop("_new", "_run")
    inside = F.row_number().over(Window.partitionBy(*by, "_run").orderBy(*order)) - 1
    out = out.withColumn("_cut", F.when((F.col("_new") == 1) | (inside % most == 0), 1).otherwise(0))
    return out.withColumn("island", F.sum("_cut").over(w)).drop("_new", "_run", "_cut")


def sessions(df: DataFrame, by: list[str], ts: str, gap_seconds: int) -> DataFrame:
    """``island``: rows of a group whose distance to the one before is at most the gap."""
    w = Window.partitionBy(*by).orderBy(ts)
    return islands(df, by, [ts], F.lag(ts).over(w).isNull() | (micros(ts) - micros(F.lag(ts).over(w)) > gap_seconds * 1_000_000))


def dense_buckets(df: DataFrame, ts: str, width_us: int, *aggregates: Column) -> DataFrame:
    """``bucket, start_us, ...``: buckets of fixed width from the earliest time on, empty ones with null aggregates.

    The spine of buckets comes from one row of bounds; the rows themselves are aggregated before they meet it.
    """
    bounds = df.agg(F.min(micros(ts)).alias("lo"), F.max(micros(ts)).alias("hi"))
    lo, hi = bounds.first()
    if lo is None:
        lo, hi = 0, -width_us
    filled = df.groupBy(F.floor((micros(ts) - lo) / width_us).alias("bucket")).agg(*aggregates)
    spine = df.sparkSession.range((hi - lo) // width_us + 1).select(F.col("id").alias("bucket"), (F.lit(lo) + F.col("id") * width_us).alias("start_us"))
    return spine.join(filled, "bucket", "left")


def count_windows(df: DataFrame, by: list[str], order: list[str], size: int, step: int, *aggregates: Column) -> DataFrame:
    """Aggregates over full windows of ``size`` rows, one every ``step`` rows; one window where a group has fewer rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumns({"_i": F.row_number().over(w) - 1, "_n": F.count("*").over(Window.partitionBy(*by))})
    last = F.greatest(F.floor((F.col("_n") - size) / step), F.lit(0))
    first = F.greatest(F.ceil((F.col("_i") - size + 1) / step), F.lit(0))
    own = F.when(first <= F.least(F.floor(F.col("_i") / step), last), F.sequence(first, F.least(F.floor(F.col("_i") / step), last)))
    return numbered.select("*", F.explode(own).alias("window")).groupBy(*by, "window").agg(*aggregates)


def tumbling(df: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``window``: blocks of ``size`` rows, the last one as long as it is."""
    return df.withColumn("window", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))


def budget(df: DataFrame, by: list[str], order: list[str], size: Column, limit: int) -> DataFrame:
    """Rows in order while their sizes add up to the limit at most; ``before`` is what those before took. A limiting operator."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_size", size).withColumn("_sum", F.sum("_size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.where(F.col("_sum") <= limit).withColumn("before", F.col("_sum") - F.col("_size")).drop("_sum", "_size")


def trend_labels(df: DataFrame, by: list[str], order: list[str], value: str, threshold: float) -> DataFrame:
    """``delta, label``: start, rise, fall or steady against the row before; the delta is rounded to 4 digits first."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("delta", F.round(F.col(value) - F.lag(value).over(w), 4))
    label = F.when(F.col("delta").isNull(), "start").when(F.col("delta") > threshold, "rise").when(F.col("delta") < -threshold, "fall").otherwise("steady")
    return out.withColumn("label", label)


def look_back(df: DataFrame, by: list[str], order: list[str], terms: Column, width: int, top: int, least: float = 0.0) -> DataFrame:
    """``i, j, score``: Jaccard similarity of each row with the ``width`` rows before it, the best ``top`` of them.

    The earlier rows come from a window frame, so no join is needed.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.select(*by, F.row_number().over(w).alias("i"), terms.alias("_terms"))
    frame = Window.partitionBy(*by).orderBy("i").rowsBetween(-width, -1)
    out = out.withColumn("_past", F.collect_list(F.struct("i", "_terms")).over(frame))
    out = out.select(*by, "i", "_terms", F.explode("_past").alias("p")).select(*by, "i", F.col("p.i").alias("j"), jaccard(F.col("_terms"), F.col("p._terms")).alias("score"))
    order_by = Window.partitionBy(*by, "i").orderBy(F.desc("score"), "j")
    return out.where(F.col("score") > least).withColumn("rank", F.row_number().over(order_by)).where(F.col("rank") <= top)


def band_join(left: DataFrame, right: DataFrame, left_time: str, right_time: str, tolerance: int, condition: Column | None = None) -> DataFrame:
    """Pairs whose times differ by ``tolerance`` at most: an equi-join on buckets of that width and their neighbours."""
    a = left.withColumn("_bucket", F.floor(F.col(left_time) / tolerance))
    b = right.withColumn("_bucket", F.explode(F.array(*(F.floor(F.col(right_time) / tolerance) + k for k in (-1, 0, 1)))))
    rule = F.abs(F.col(left_time) - F.col(right_time)) <= tolerance
    return a.join(b, "_bucket").where(rule if condition is None else rule & condition).drop("_bucket")


def nearest_larger(df: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """``name``: the place (``order``) of the nearest earlier row of the group with a larger whole number ``value`` >= 0; null without one.

    A number is larger than another if at some bit it has a one and the other a zero while all higher bits
    agree. So for each bit the rows with the same higher bits are one sequence, and the last of them with a one is
    a running value: no row carries its past.
    """
    most = df.agg(F.max(value)).first()[0] or 0
    bits = F.array(*(F.lit(k) for k in range(max(1, int(most).bit_length()))))
    n = F.col(value).cast("long")
    rows = df.select(*by, order, n.alias("_n"), F.explode(bits).alias("_bit"))
    one = F.expr("shiftright(_n, _bit) & 1")
    rows = rows.withColumns({"_one": one, "_high": F.expr("shiftright(shiftright(_n, _bit), 1)")})
    w = Window.partitionBy(*by, "_bit", "_high").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_one") == 1, F.col(order)), ignorenulls=True).over(w)
    found = rows.withColumn("_last", F.when(F.col("_one") == 0, last)).groupBy(*by, order).agg(F.max("_last").alias(name))
    return df.join(found, [*by, order], "left")


def parent_heading(headings: DataFrame, by: list[str], levels: int = 6) -> DataFrame:
    """``parent, end`` of headings (``line, depth`` from 1 to ``levels``): the nearest earlier shallower one, and the last line before the next one as shallow.

    Both come from running values of each level, forwards and backwards, so no row carries its past.
    """
    forward, backward = Window.partitionBy(*by).orderBy("line"), Window.partitionBy(*by).orderBy(F.desc("line"))
    seen = lambda k, w: F.last(F.when(F.col("depth") == k, F.col("line")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    held = headings.withColumns({f"_p{k}": seen(k, forward) for k in range(1, levels + 1)} | {f"_n{k}": seen(k, backward) for k in range(1, levels + 1)})
    parent = F.array_max(F.array(*(F.when(F.col("depth") > k, F.col(f"_p{k}")) for k in range(1, levels + 1))))
    end = F.array_min(F.array(*(F.when(F.col("depth") >= k, F.col(f"_n{k}")) for k in range(1, levels + 1)))) - 1
    return held.withColumns({"parent": parent, "end": end}).drop(*(f"_{s}{k}" for s in "pn" for k in range(1, levels + 1)))
