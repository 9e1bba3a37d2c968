"""Profiles of tables: type inference, numeric and categorical summaries, drift, anomalies and trends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def melt(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """``keys..., column, value string``: one row a cell, in one pass without a shuffle."""
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(*(keys or []), F.explode(cells).alias("cell")).select(*(keys or []), "cell.column", "cell.value")


def classify(value: Column) -> Column:
    """``missing``, ``bool``, ``number`` or ``text``; blank is missing, thousands commas are dropped, NaN and infinities are text."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (
        F.when(v == "", "missing")
        .when(F.lower(v).isin("true", "false"), "bool")
        .when(F.replace(v, F.lit(","), F.lit("")).rlike(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "number")
        .otherwise("text")
    )


def number(value: Column) -> Column:
    return F.replace(F.trim(value), F.lit(","), F.lit("")).try_cast("double")


def chosen_columns(columns: list[str], include: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """The columns that an include list names (all without one), in their own order, less those of an exclude list; case does not matter."""
    wanted = {c.strip().lower() for c in include or ()}
    gone = {c.strip().lower() for c in exclude or ()}
    return [c for c in columns if (not wanted or c.lower() in wanted) and c.lower() not in gone]


def listed_only(value: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Whether a value is on the include list (any value without one) and not on the exclude list, trimmed and without case; null is on none."""
    v = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    clean = lambda names: [n.strip().lower() for n in names or ()]
    on = v.isin(clean(include)) if include else F.lit(True)
    return on & ~v.isin(clean(exclude)) if exclude else on


def column_kinds(cells: DataFrame, least_ratio: float = 0.6) -> DataFrame:
    """``column, cells, missing, numbers, kind``: numeric if at least ``least_ratio`` of the present cells are numbers."""
    kind = classify(F.col("value"))
    counted = cells.groupBy("column").agg(F.count("*").alias("cells"), F.count(F.when(kind == "missing", 1)).alias("missing"), F.count(F.when(kind == "number", 1)).alias("numbers"))
    present = F.col("cells") - F.col("missing")
    numeric = (F.col("numbers") > 0) & (F.col("numbers") >= least_ratio * present)
    return counted.withColumn("kind", F.when(numeric, "numeric").otherwise("categorical"))


def numeric_summary(cells: DataFrame, by: list[str], quantiles: bool = True) -> DataFrame:
    """Count, missing, mean, sample deviation, range, the 95 % interval of the mean and, with ``quantiles``, median and quartiles.

    The deviation of one value is 0; quantiles interpolate linearly. ``cells`` has ``value double``.
    """
    v = F.col("value")
    found = cells.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.count(F.when(v.isNull(), 1)).alias("missing"),
        F.avg(v).alias("mean"),
        F.coalesce(F.stddev_samp(v), F.when(F.count(v) > 0, F.lit(0.0))).alias("sd"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
    reach = 1.96 * F.col("sd") / F.sqrt("n")
    found = found.withColumn("ci_low", F.col("mean") - reach).withColumn("ci_high", F.col("mean") + reach)
    if not quantiles:
        return found
    same = lambda one, other: [one[c].eqNullSafe(other[f"_{c}"]) for c in by]
    held = exact_quantiles(cells, by, {"median": 0.5, "p25": 0.25, "p75": 0.75}).withColumnsRenamed({c: f"_{c}" for c in by})
    return found.join(held, same(found, held), "left").drop(*(f"_{c}" for c in by))


def exact_quantiles(cells: DataFrame, by: list[str], at: dict[str, float]) -> DataFrame:
    """``by...`` and quantiles of ``value`` by name, interpolated linearly; nulls do not count, groups of nulls only have no row.

    Equal values are counted first and dealt out by ranges; what lies before a value follows from the ranges' sums, so no task holds the values of a group.
    """
    from .state import checkpointed

    counted = cells.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count("*").alias("_n"))
    # checkpointed, as bounds of ranges are sampled
    ordered = checkpointed(counted.repartitionByRange(*by, "value").withColumn("_part", F.spark_partition_id()))
    sums = ordered.groupBy(*by, "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(before), F.lit(0)), "_all": F.sum("_sum").over(Window.partitionBy(*by))}).drop("_sum")
    sums = sums.withColumnsRenamed({c: f"_{c}" for c in [*by, "_part"]})
    placed = ordered.join(sums, [ordered["_part"] == sums["__part"], *(ordered[c].eqNullSafe(sums[f"_{c}"]) for c in by)])
    last = F.col("_before") + F.sum("_n").over(Window.partitionBy("_part", *by).orderBy("value"))
    placed = placed.withColumn("_last", last).withColumn("_first", F.col("_last") - F.col("_n"))
    found = []
    for name, q in at.items():
        place = (F.col("_all") - 1) * F.lit(q)
        one = lambda k: F.max(F.when((F.col("_first") <= k) & (k < F.col("_last")), F.col("value")))
        found += [one(F.floor(place)).alias(f"_low_{name}"), one(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_rest_{name}")]
    low, high, rest = (lambda n, s=s: F.col(f"_{s}_{n}") for s in ("low", "high", "rest"))
    # as Spark's percentile puts it
    between = lambda n: F.when((rest(n) == 0) | (low(n) == high(n)), low(n)).otherwise((1 - rest(n)) * low(n) + rest(n) * high(n))
    return placed.groupBy(*by).agg(*found).select(*by, *(between(n).alias(n) for n in at))


def categorical_summary(cells: DataFrame, by: list[str], top: int = 10) -> DataFrame:
    """The most frequent values of each group with their share and rank, ties by value, and the number of distinct values."""
    counted = cells.where(F.col("value").isNotNull()).groupBy(*by, "value").agg(F.count("*").alias("n"))
    own = Window.partitionBy(*by)
    ranked = counted.withColumns(
        {
            "share": F.col("n") / F.sum("n").over(own),
            "distinct_values": F.count("*").over(own),
            "rank": F.row_number().over(own.orderBy(F.desc("n"), "value")),
        }
    )
    return ranked.where(F.col("rank") <= top)


def pooled_effect(n1: Column, sd1: Column, n2: Column, sd2: Column, delta: Column) -> Column:
    """Difference of means by the pooled deviation; 0 where that is not defined."""
    pooled = F.sqrt(((n1 - 1) * sd1 * sd1 + (n2 - 1) * sd2 * sd2) / (n1 + n2 - 2))
    return F.when((n1 + n2 > 2) & (pooled > 0), delta / pooled).otherwise(F.lit(0.0))


def drift(summary: DataFrame, order: str, by: list[str], least_effect: float = 0.5) -> DataFrame:
    """Change of the mean against the group's previous summary, with its effect size and flag."""
    w = Window.partitionBy(*by).orderBy(order)
    before = {c: F.lag(c).over(w) for c in ("n", "mean", "sd")}
    out = summary.withColumns({f"before_{c}": x for c, x in before.items()}).where("before_n is not null")
    out = out.withColumn("delta", F.col("mean") - F.col("before_mean"))
    out = out.withColumn("effect", pooled_effect(F.col("before_n"), F.col("before_sd"), F.col("n"), F.col("sd"), F.col("delta")))
    return out.withColumn("flagged", F.abs("effect") >= least_effect)


def anomalies(summary: DataFrame, by: list[str], value: str = "mean", least: float = 2.5) -> DataFrame:
    """Standard scores of values within their group; groups of one and without spread have none."""
    w = Window.partitionBy(*by)
    out = summary.withColumns({"_n": F.count(value).over(w), "_mean": F.avg(value).over(w), "_sd": F.stddev_samp(value).over(w)})
    out = out.where("_n > 1 and _sd > 0").withColumn("z", (F.col(value) - F.col("_mean")) / F.col("_sd"))
    return out.withColumn("flagged", F.abs("z") >= least).drop("_n", "_mean", "_sd")


def trend(rows: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """Least-squares line of y over x for each group, and whether it beats a constant."""
    fit = rows.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.coalesce(F.regr_slope(y, x), F.lit(0.0)).alias("slope"),
        F.coalesce(F.regr_intercept(y, x), F.avg(y)).alias("intercept"),
        F.coalesce(F.regr_r2(y, x), F.lit(1.0)).alias("r2"),
        F.coalesce(F.var_pop(y), F.lit(0.0)).alias("spread"),
    )
    flat = F.when(F.col("spread") == 0, 1.0).otherwise(0.0)
    return fit.withColumn("model", F.when(F.col("r2") > flat, "linear").otherwise("constant")).drop("spread")


def accumulate(summary: DataFrame, by: list[str]) -> DataFrame:
    """Mergeable totals over summaries: mean and deviation of means, overall mean, count and range."""
    return summary.groupBy(*by).agg(
        F.count("*").alias("datasets"),
        F.sum("n").alias("n"),
        F.avg("mean").alias("mean_of_means"),
        F.coalesce(F.stddev_samp("mean"), F.lit(0.0)).alias("sd_of_means"),
        (F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("overall_mean"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
    )


def uniform_sample(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """Every ``n // rows``-th row in order, then the first ``rows`` of them; a sampling operator.

    Row numbers come from the sizes of range partitions, so no task orders the whole table.
    """
    numbered = global_row_number(df, order)
    n = df.count()
    step = max(1, n // rows)
    return numbered.where((F.col("_row") - 1) % step == 0).where(F.col("_row") <= step * rows).drop("_row")


def global_row_number(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``_row``, their 1-based place in a total order.

    Sorts by range partitions; each partition's offset is the number of rows in those before it, of
    which there are as many as partitions. The sorted rows are checkpointed: bounds of ranges are sampled, and
    joined partitions depend on sizes, so a second evaluation for the offsets might deal rows otherwise.
    """
    from .state import checkpointed

    # the upper bits of the identifier are the partition's, the lower 33 the place in it
    ordered = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    ordered = ordered.withColumn("_part", F.shiftright("_id", 33))
    sizes = ordered.groupBy("_part").agg(F.count("*").alias("_size"))
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ordered.join(F.broadcast(offsets), "_part").withColumn("_row", F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_id", "_before")
