"""Queries of table profiles, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from .base import query, r6, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CELLS = "SELECT l_shipdate, unnest([{'c': 'l_quantity', 'v': l_quantity}, {'c': 'l_extendedprice', 'v': l_extendedprice}, {'c': 'l_discount', 'v': l_discount}, {'c': 'l_tax', 'v': l_tax}], recursive := true) FROM lineitem"


def cells(spark, d, keys=()):
    at = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in NUMERIC))
    return table(spark, d, "lineitem").select(*keys, F.explode(at).alias("x")).select(*[k.split(" as ")[-1] if isinstance(k, str) else k for k in keys], "x.column", "x.value")


def monthly(spark, d):
    line = table(spark, d, "lineitem").withColumn("month", F.date_format("l_shipdate", "yyyy-MM"))
    at = F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in NUMERIC))
    return P.numeric_summary(line.select("month", F.explode(at).alias("x")).select("month", "x.*"), ["column", "month"], quantiles=False)


MONTHLY = f"""WITH cells AS ({CELLS}), m AS (
  SELECT c AS "column", strftime(l_shipdate, '%Y-%m') AS month, count(v) AS n, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS sd, min(v) AS low, max(v) AS high
  FROM cells GROUP BY 1, 2)"""


@query(
    "a5_numeric_profile",
    f"""WITH cells AS ({CELLS})
SELECT c AS "column", count(v) AS n, count(*) FILTER (v IS NULL) AS missing, {r6('avg(v)')} AS mean, {r6('quantile_cont(v, 0.5)')} AS median,
  {r6('coalesce(stddev_samp(v), 0)')} AS sd, min(v) AS low, max(v) AS high, {r6('quantile_cont(v, 0.25)')} AS p25, {r6('quantile_cont(v, 0.75)')} AS p75,
  {r6('avg(v) - 1.96 * stddev_samp(v) / sqrt(count(v))')} AS ci_low, {r6('avg(v) + 1.96 * stddev_samp(v) / sqrt(count(v))')} AS ci_high
FROM cells GROUP BY 1""",
)
def a5_numeric_profile(spark, d):
    found = P.numeric_summary(cells(spark, d), ["column"])
    return found.select("column", "n", "missing", "low", "high", *(F.round(c, 6).alias(c) for c in ("mean", "median", "sd", "p25", "p75", "ci_low", "ci_high")))


@query(
    "a7_categorical_profile",
    """WITH cells AS (SELECT unnest([{'c': 'l_returnflag', 'v': l_returnflag}, {'c': 'l_linestatus', 'v': l_linestatus}, {'c': 'l_linenumber', 'v': CAST(l_linenumber AS VARCHAR)}], recursive := true) FROM lineitem),
t AS (SELECT c AS "column", v AS value, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY 1, 2),
r AS (SELECT "column", value, n, round(n / sum(n) OVER (PARTITION BY "column"), 6) AS share, count(*) OVER (PARTITION BY "column") AS distinct_values,
  CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INTEGER) AS rank FROM t)
SELECT * FROM r WHERE rank <= 10""",
)
def a7_categorical_profile(spark, d):
    found = P.categorical_summary(P.melt(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]), ["column"])
    return found.withColumn("share", F.round("share", 6))


@query(
    "p4_type_inference",
    """WITH cells AS (SELECT unnest([{'c': 'c_name', 'v': c_name}, {'c': 'c_acctbal', 'v': CAST(c_acctbal AS VARCHAR)}, {'c': 'c_custkey', 'v': CAST(c_custkey AS VARCHAR)}, {'c': 'c_mktsegment', 'v': c_mktsegment}], recursive := true) FROM customer),
k AS (SELECT c AS "column", count(*) AS cells, count(*) FILTER (trim(coalesce(v, '')) = '') AS missing,
  count(*) FILTER (regexp_full_match(replace(trim(v), ',', ''), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)([eE][+-]?[0-9]+)?')) AS numbers FROM cells GROUP BY 1)
SELECT *, CASE WHEN numbers > 0 AND numbers >= 0.6 * (cells - missing) THEN 'numeric' ELSE 'categorical' END AS kind FROM k""",
)
def p4_type_inference(spark, d):
    return P.column_kinds(P.melt(table(spark, d, "customer"), ["c_name", "c_acctbal", "c_custkey", "c_mktsegment"]))


@query(
    "w2_drift",
    MONTHLY
    + """, l AS (SELECT *, lag(n) OVER w AS n0, lag(mean) OVER w AS mean0, lag(sd) OVER w AS sd0 FROM m WINDOW w AS (PARTITION BY "column" ORDER BY month)),
e AS (SELECT *, sqrt(((n0 - 1) * sd0 * sd0 + (n - 1) * sd * sd) / nullif(n0 + n - 2, 0)) AS pooled FROM l WHERE n0 IS NOT NULL)
SELECT "column", month, round(mean - mean0, 6) AS delta, round(CASE WHEN n0 + n > 2 AND pooled > 0 THEN (mean - mean0) / pooled ELSE 0 END, 6) AS effect,
  abs(CASE WHEN n0 + n > 2 AND pooled > 0 THEN (mean - mean0) / pooled ELSE 0 END) >= 0.5 AS flagged FROM e""",
)
def w2_drift(spark, d):
    return P.drift(monthly(spark, d), "month", ["column"]).select("column", "month", F.round("delta", 6).alias("delta"), F.round("effect", 6).alias("effect"), "flagged")


@query(
    "a10_anomalies",
    MONTHLY
    + """, s AS (SELECT "column", month, mean, count(mean) OVER w AS k, avg(mean) OVER w AS mu, stddev_samp(mean) OVER w AS dev FROM m WINDOW w AS (PARTITION BY "column"))
SELECT "column", month, round((mean - mu) / dev, 6) AS z, abs((mean - mu) / dev) >= 2.5 AS flagged FROM s WHERE k > 1 AND dev > 0""",
)
def a10_anomalies(spark, d):
    return P.anomalies(monthly(spark, d), ["column"]).select("column", "month", F.round("z", 6).alias("z"), "flagged")


@query(
    "a11_trend",
    MONTHLY
    + """, x AS (SELECT "column", mean, row_number() OVER (PARTITION BY "column" ORDER BY month) AS x FROM m)
SELECT "column", count(mean) AS n, round(avg(mean), 6) AS mean, round(regr_slope(mean, x), 6) AS slope, round(regr_intercept(mean, x), 6) AS intercept,
  round(regr_r2(mean, x), 6) AS r2, CASE WHEN regr_r2(mean, x) > CASE WHEN var_pop(mean) = 0 THEN 1 ELSE 0 END THEN 'linear' ELSE 'constant' END AS model FROM x GROUP BY 1""",
)
def a11_trend(spark, d):
    from pyspark.sql import Window

    rows = monthly(spark, d).withColumn("x", F.row_number().over(Window.partitionBy("column").orderBy("month")))
    return P.trend(rows, ["column"], "x", "mean").select("column", "n", "model", *(F.round(c, 6).alias(c) for c in ("mean", "slope", "intercept", "r2")))


@query(
    "a8_accumulator",
    MONTHLY
    + """ SELECT "column", count(*) AS datasets, CAST(sum(n) AS BIGINT) AS n, round(avg(mean), 6) AS mean_of_means, round(coalesce(stddev_samp(mean), 0), 6) AS sd_of_means,
  round(sum(mean * n) / sum(n), 6) AS overall_mean, min(low) AS low, max(high) AS high FROM m GROUP BY 1""",
)
def a8_accumulator(spark, d):
    found = P.accumulate(monthly(spark, d), ["column"])
    return found.select("column", "datasets", "n", "low", "high", *(F.round(c, 6).alias(c) for c in ("mean_of_means", "sd_of_means", "overall_mean")))


@query(
    "s10_uniform_sample",
    """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) AS i, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, o_custkey FROM o WHERE (i - 1) % greatest(1, n // 500) = 0 AND i <= greatest(1, n // 500) * 500""",
)
def s10_uniform_sample(spark, d):
    return P.uniform_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"], 500)


@query(
    "a13_rollup",
    """SELECT r_name AS layer, n_name AS sector, c_mktsegment AS subsector, CAST(grouping(r_name, n_name, c_mktsegment) AS BIGINT) AS level, count(*) AS n, round(avg(c_acctbal), 4) AS mean
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""",
)
def a13_rollup(spark, d):
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    out = joined.rollup(F.col("r_name").alias("layer"), F.col("n_name").alias("sector"), F.col("c_mktsegment").alias("subsector"))
    return out.agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean"))


@query(
    "a58_cube_approx",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)""",
)
def a58_cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("a45_count_max", "SELECT count(*) AS n, max(l_shipdate) AS latest, count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a45_count_max(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), F.max("l_shipdate").alias("latest"), F.count_distinct("l_suppkey").alias("suppliers"))
