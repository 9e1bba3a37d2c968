"""Queries of vector operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import search as S
from .base import query, table

UNIT = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS raw, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm FROM embeddings), v AS (SELECT id, label, raw, CASE WHEN norm = 0 THEN raw ELSE list_transform(raw, lambda x: x / norm) END AS v FROM u)"


def store(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


@query("o1_vector_search", f"""WITH {UNIT}, s AS (SELECT q.id AS query_id, c.id AS id, round(list_dot_product(q.v, c.v), 9) AS score FROM v q, v c WHERE q.id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def o1_vector_search(spark, d):
    found = S.vector_search(store(spark, d), store(spark, d).where("id % 100 = 0"), 10)
    return found.withColumn("score", F.round("score", 6))


MEANS = UNIT + """, f AS (SELECT label, unnest(range(1, len(raw) + 1)) AS pos, unnest(raw) AS x FROM u), m AS (SELECT label, pos, avg(x) AS x FROM f GROUP BY 1, 2),
g AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1), k AS (SELECT label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM g)"""


@query("a12_group_means", f"WITH {MEANS} SELECT label, list_transform(v, lambda x: round(x, 6)) AS v FROM k")
def a12_group_means(spark, d):
    return S.group_means(store(spark, d), ["label"]).select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("j8_related_groups", f"WITH {MEANS}, p AS (SELECT a.label AS a, b.label AS b, round(list_dot_product(a.v, b.v), 9) AS score FROM k a JOIN k b ON a.label <> b.label), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS INTEGER) AS rank FROM p) SELECT a, b, round(score, 6) AS score, rank FROM r WHERE rank <= 3")
def j8_related_groups(spark, d):
    means = S.group_means(store(spark, d), ["label"]).select(F.col("label").alias("id"), "v")
    found = S.vector_search(means, means, 4).where("query_id <> id")
    from pyspark.sql import Window

    again = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", again).where("rank <= 3").select(F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score"), "rank")


@query("a14_weighted_means", f"""WITH {UNIT}, w AS (SELECT label, raw, 1 - pow(0.5, CAST(id AS DOUBLE) / 100) + 0.1 AS w FROM u), f AS (SELECT label, w, unnest(range(1, len(raw) + 1)) AS pos, unnest(raw) AS x FROM w),
m AS (SELECT label, pos, sum(x * w) / sum(w) AS x FROM f GROUP BY 1, 2), g AS (SELECT label, list(x ORDER BY pos) AS v FROM m GROUP BY 1)
SELECT label, list_transform(v, lambda x: round(x / sqrt(list_dot_product(v, v)), 6)) AS v FROM g""")
def a14_weighted_means(spark, d):
    rows = store(spark, d).withColumn("w", 1 - V.decay(F.col("id").cast("double"), 100) + 0.1)
    return S.group_means(rows, ["label"], F.col("w")).select("label", F.transform("v", lambda x: F.round(x, 6)).alias("v"))


@query("f20_quantise", f"""WITH {UNIT}, t AS (SELECT id, raw, list_max(list_transform(raw, lambda x: abs(x))) AS top FROM u), s AS (SELECT id, raw, CASE WHEN top = 0 THEN 1.0 ELSE top / 127 END AS sc FROM t)
SELECT id, round(sc, 9) AS scale, list_transform(raw, lambda x: CAST(round_even(x / sc, 0) AS INTEGER)) AS q, round(list_max(list_transform(raw, lambda x: abs(x - sc * round_even(x / sc, 0)))), 9) AS error FROM s""")
def f20_quantise(spark, d):
    rows = store(spark, d).select("id", "v", V.quantized_int8(F.col("v")).alias("x")).select("id", "v", "x.*")
    back = V.dequantized(F.col("q"), F.col("scale"))
    error = F.array_max(F.zip_with(F.col("v"), back, lambda a, b: F.abs(a.cast("double") - b)))
    rows = rows.withColumn("error", F.round(error, 9))
    return rows.select("id", F.round(F.col("scale"), 9).alias("scale"), "q", "error")


@query("f20_bits", f"WITH {UNIT} SELECT id, list_transform(range(0, len(raw) // 8), lambda i: CAST(list_sum(list_transform(range(0, 8), lambda k: CASE WHEN raw[i * 8 + k + 1] >= 0 THEN CAST(pow(2, k) AS BIGINT) ELSE 0 END)) AS INTEGER)) AS bits FROM u")
def f20_bits(spark, d):
    return store(spark, d).select("id", V.quantized_bits(F.col("v")).alias("bits"))


@query("f18_softmax", f"WITH {UNIT}, e AS (SELECT id, raw, list_transform(raw, lambda x: exp(x - list_max(raw))) AS e FROM u) SELECT id, list_transform(e, lambda x: round(x / list_sum(e), 6)) AS p, CAST(list_position(raw, list_max(raw)) AS BIGINT) AS best FROM e")
def f18_softmax(spark, d):
    v = F.transform("v", lambda x: x.cast("double"))
    return store(spark, d).select("id", F.transform(V.softmax(v), lambda x: F.round(x, 6)).alias("p"), V.argmax(v).alias("best"))


ACTIVATIONS = {"sigmoid": "1 / (1 + exp(-x))", "tanh": "tanh(x)", "relu": "greatest(x, 0)", "leaky": "CASE WHEN x >= 0 THEN x ELSE x * 0.01 END", "softplus": "greatest(x, 0) + ln(1 + exp(-abs(x)))", "linear": "x"}


@query("f16_activations", f"WITH {UNIT}, x AS (SELECT id, unnest(raw) * 8 AS x FROM u) SELECT id, " + ", ".join(f"round(sum({e}), 4) AS {k}" for k, e in ACTIVATIONS.items()) + " FROM x GROUP BY 1")
def f16_activations(spark, d):
    """Sums of each activation over all components."""
    total = lambda kind: V.total(F.transform("v", lambda x: V.activation(x.cast("double") * 8, kind)))
    return store(spark, d).select("id", *(F.round(total(k), 4).alias(k) for k in ACTIVATIONS))


FEDERATED = f"""WITH {UNIT}, s AS (SELECT q.id AS query_id, 'store' || c.label AS store, c.id AS id, round(list_dot_product(c.v, q.v), 9) AS score FROM v q JOIN v c ON q.id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, store ORDER BY score DESC, id) AS i, count(*) OVER (PARTITION BY query_id, store) AS n FROM s),
k AS (SELECT *, CASE WHEN n = 1 THEN 1.0 ELSE 1 - (i - 1) / (n - 1) END AS rs FROM r)"""


def hits(spark, d, top: int):
    """States of the scores of all vectors, each in its store, with every hundredth."""
    from ..operators.scores import store_scores

    stores = store(spark, d).withColumn("store", F.concat(F.lit("store"), F.col("label")))
    return store_scores(stores, store(spark, d).where("id % 100 = 0"), top)


@query("o4_federated", FEDERATED + " SELECT query_id, store, id, round(round((rs + greatest(score, 0)) / 2, 9), 6) AS final, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round((rs + greatest(score, 0)) / 2, 9) DESC, store, id) AS INTEGER) AS position FROM k WHERE i <= 20")
def o4_federated(spark, d):
    """The 20 best of each store in one order for each query."""
    from pyspark.sql import Window

    ranked = hits(spark, d, 20).select("query_id", "store", "n", F.posexplode("hits").alias("i", "hit")).select("query_id", "store", "n", (F.col("i") + 1).alias("i"), "hit.*")
    rs = F.when(F.col("n") == 1, 1.0).otherwise(1 - (F.col("i") - 1) / (F.col("n") - 1))
    out = ranked.withColumn("final", F.round((rs + F.greatest("score", F.lit(0.0))) / 2, 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("final"), "store", "id"))
    return out.select("query_id", "store", "id", F.round("final", 6).alias("final"), place.alias("position"))


@query("a36_document_hits", FEDERATED + " SELECT query_id, store, count(*) AS n, round(max(score), 6) AS best, round(avg(score), 6) AS mean, list(id ORDER BY i) FILTER (i <= 3) AS chunks FROM r GROUP BY 1, 2")
def a36_document_hits(spark, d):
    """Hits of each store for each query: number, best and mean score, and the three best."""
    ids = F.transform("hits", lambda h: h["id"])
    return hits(spark, d, 3).select("query_id", "store", "n", F.round("best", 6).alias("best"), F.round(F.col("total") / F.col("n"), 6).alias("mean"), ids.alias("chunks"))


@query("j7_dot_self_join", f"""WITH {UNIT}, p AS (SELECT a.label, a.id AS a, b.id AS b, round(list_dot_product(a.v, b.v), 9) AS score FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY label, a ORDER BY score DESC, b) AS rank FROM p WHERE score >= 0.1) SELECT label, a, b, round(score, 6) AS score FROM r WHERE rank <= 5 AND a < b""")
def j7_dot_self_join(spark, d):
    """Similar vectors of one label, which is to them what a file is to its chunks."""
    found = S.scoped_neighbours(store(spark, d), ["label"], 5, 0.1).where("query_id < id")
    return found.select("label", F.col("query_id").alias("a"), F.col("id").alias("b"), F.round("score", 6).alias("score"))
