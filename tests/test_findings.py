"""Findings of reviews: each test failed before its change."""

from pyspark.sql import functions as F

from lakeloom import plans
from lakeloom.operators import profile

QUERIES, SQL = plans.load()


def test_row_numbers_are_whole_when_ranges_are_sampled_again(spark):
    """Rows from many unordered partitions, of which two evaluations draw different bounds."""
    rows = spark.range(0, 400_000, 1, 3).select((F.col("id") * 7919 % 400_009).alias("k"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("ballast"))
    found = profile.global_row_number(rows, ["k"]).agg(F.count_distinct("_row").alias("n"), F.min("_row").alias("low"), F.max("_row").alias("high")).first()
    assert tuple(found) == (400_000, 1, 400_000)
    got = [r.k for r in profile.uniform_sample(rows, ["k"], 500).orderBy("k").collect()]
    assert got == sorted(r.k for r in rows.select("k").collect())[::800][:500]


def test_users_beyond_the_sketch_are_counted_exactly(spark, tmp_path):
    """6,000 users of one kind of event, each in both halves of the month."""
    day = F.when(F.col("id") % 2 == 0, 3).otherwise(20)
    rows = spark.range(24_000).select(F.col("id").alias("event_id"), F.make_timestamp(F.lit(2024), F.lit(1), day, F.lit(0), F.lit(0), F.lit(0)).alias("ts"), (F.floor(F.col("id") / 4)).alias("user_id"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    (one,) = QUERIES["u7_user_aggregates"](spark, str(tmp_path)).collect()
    assert (one.mean, one.variance, one.users) == (1.0, 0.0, 6000.0)


def test_similarity_join_ships_no_set_with_a_pair(spark):
    """Pairs meet their sets in cells: the postings' join is the only one."""
    from lakeloom.operators import terms

    rows = spark.createDataFrame([(k, f"t{(k * 7 + i) % 40}") for k in range(60) for i in range(12)], "id long, term string")
    found = terms.jaccard_pairs(rows, 0.5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in line for line in plan.splitlines()) == 1
    assert found.count() > 0


def test_second_keys_are_not_ranked_with_first_ones(spark, tmp_path):
    """Rows of the second key of customers that have the first are never made, so there is nothing to rank."""
    spark.createDataFrame([(1, 5), (2, 5), (2, 6), (9, 6), (None, 5)], "c_custkey long, c_nationkey int").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, 5), (2, 6), (3, 5)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    found = QUERIES["j25_fallback_keys"](spark, str(tmp_path))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, 1), (2, 2), (9, 2), (None, 1), (None, 3)], key=str)


def test_links_by_name_are_summed_by_pair_for_pages_of_several_names_only(spark, tmp_path):
    """A page that comes twice under one name and once under another, and links written twice."""
    html = '<a href="/x">1</a><a href="/X">2</a><a href="/y">3</a>'
    rows = [(1, "https://h/a", html), (2, "https://h/x", ""), (2, "https://h/x", ""), (2, "https://h/y", ""), (3, "https://h/y", ""), (4, "https://h", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["j19_name_references"](spark, str(tmp_path))
    assert "Union" in found._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, found.collect())) == [(1, 2, 10), (1, 3, 2)]


def test_ngrams_take_the_words_of_a_long_text_once(spark):
    """A document of 30,000 words: reading them again for each run took minutes."""
    import time

    from lakeloom.operators import terms

    docs = spark.range(1).select("id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(29_999)), lambda i: F.concat(F.lit("w"), i.cast("string"))), " ").alias("text")).localCheckpoint()
    start = time.monotonic()
    assert terms.ngram_counts(docs, 3).count() == 29_998
    assert time.monotonic() - start < 30
    short = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, ""), (4, None), (5, "a")], "id long, text string")
    assert sorted(map(tuple, terms.ngram_counts(short, 2).collect())) == [("a b", 2, 2), ("b c", 1, 1)]
    assert sorted(map(tuple, terms.ngram_counts(short, 3).collect())) == [("a b c", 1, 1)]
    assert sorted(map(tuple, terms.ngram_counts(short, 1).collect())) == [("a", 3, 3), ("b", 2, 2), ("c", 1, 1)]


def test_pairs_of_both_ways_are_computed_once(spark):
    from lakeloom.operators import terms

    ids = spark.range(6)
    pairs = ids.select(F.col("id").alias("a")).join(ids.select(F.col("id").alias("b")), F.expr("a < b")).withColumn("score", F.col("a") * 10 + F.col("b"))
    found = terms.both_ways(pairs)
    assert sum("Join " in line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines()) == 1
    want = [(a, b, min(a, b) * 10 + max(a, b)) for a in range(6) for b in range(6) if a != b]
    assert found.columns == ["a", "b", "score"] and sorted(map(tuple, found.collect())) == want


def test_overlaps_of_large_scopes_are_counted_in_cells(spark, monkeypatch):
    """Scopes of several blocks, a repeated row, ids of two scopes and null scopes; no pair is shuffled."""
    from collections import Counter

    from lakeloom.operators import terms

    monkeypatch.setattr(terms, "CELL_SETS", 16)
    rows = [(("x", "y", None)[k % 7 % 3], k, f"t{(k * k + 3 * i) % 23}") for k in range(120) for i in range(6)] + [("x", 7, "t1"), ("x", 7, "t1"), ("y", 0, "t0"), ("y", 0, "t3")]
    found = terms.scoped_overlaps(spark.createDataFrame(rows, "scope string, id long, term string"), ["scope"], 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString().split("FlatMapGroupsInArrow")[0]
    want = Counter((s, i, j) for s, i, t in rows for r, j, u in rows if s is not None and s == r and t == u and i < j)
    assert sorted(map(tuple, found.collect())) == sorted((*k, n) for k, n in want.items() if n >= 3)


def test_vector_search_meets_queries_in_cells(spark, monkeypatch):
    """Several blocks and parts, copies, zero vectors, nulls, numbers that are none and other lengths; candidates are as if all pairs were ranked."""
    import random

    from lakeloom.functions.vectors import dot, normalized
    from lakeloom.operators import search

    monkeypatch.setattr(search, "CELL_QUERIES", 7)
    monkeypatch.setattr(search, "CELL_VECTORS", 40)
    monkeypatch.setattr(search, "ROWS", 8)
    r = random.Random(5)
    rows = [(k, [r.gauss(0, 1) for _ in range(4)]) for k in range(150)]
    rows += [(200 + k, rows[3][1]) for k in range(40)] + [(300, [0.0] * 4), (301, None), (302, [1.0, None, 0.0, 2.0]), (303, [1.0, float("nan"), 0.0, 2.0]), (304, [1.0, 2.0]), (305, [3.0, 1.0]), (306, [])]
    store = spark.createDataFrame(rows, "id long, v array<double>")
    asked = store.where("id % 10 < 3 or id >= 300")
    unit = lambda rows, i, v: rows.select(F.col("id").alias(i), normalized(F.col("v")).alias(v))
    pairs = unit(store, "id", "v").join(unit(asked, "query_id", "q"), F.size("v") == F.size("q")).select("query_id", "id", F.round(dot(F.col("v"), F.col("q")), 9).alias("score")).collect()
    for top, least in ((1, None), (5, None), (5, 0.7), (300, None)):
        want = []
        for q in {p.query_id for p in pairs}:
            mine = [p for p in pairs if p.query_id == q and (least is None or p.score is not None and (p.score != p.score or p.score >= least))]
            order = sorted(mine, key=lambda p: (p.score is None, 0 if p.score is None else float("-inf") if p.score != p.score else -p.score, p.id))
            want += [str((p.query_id, p.id, p.score, k + 1)) for k, p in enumerate(order[:top])]
        found = search.vector_search(store, asked, top, least)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted(str(tuple(p)) for p in found.collect()) == sorted(want), (top, least)


def test_few_files_of_sources_are_the_work_of_many_tasks(spark):
    """One partition of sources is parsed by as many tasks as shuffles have partitions; loops find their functions without a second parse."""
    from lakeloom.operators import braces, code, matches, rules

    text = "def f(n):\n    for i in n: f(g(i.f(1)))\n    while h(n): pass\ndef g(n):\n    return [k.g() for k in n]\n"
    docs = spark.createDataFrame([(k, text) for k in range(40)] + [(99, "def ("), (98, None)], "id long, text string").coalesce(1)
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for found in (rules.python_symbols(docs), code.variables(docs), code.loop_data(docs), code.brace_chunks(docs, ("class",)), braces.brace_loops(docs), braces.brace_variables(docs)):
        assert "RepartitionByExpression [id#" in (plan := found._jdf.queryExecution().optimizedPlan().toString()) and f", {most}" in plan
    loops = matches.recursive_calls(rules.python_symbols(docs))
    assert loops._jdf.queryExecution().optimizedPlan().toString().count("MapInPandas") == 1
    assert {(r.line, tuple(r.recursive)) for r in loops.collect()} == {(2, ("f", "g")), (3, ())} and loops.count() == 80


def test_terms_are_counted_without_being_shuffled(spark):
    """Texts are dealt out by id; label terms are broadcast to the documents' terms."""
    from lakeloom.operators import matches, terms

    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a"), (3, None)], "id long, text string")
    counts = terms.term_counts(docs)
    assert counts._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert counts._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, counts.collect())) == [(1, "a", 2, 0), (1, "b", 2, 0), (1, "c", 1, 1), (2, "a", 1, 0)]
    labels = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "c")], "label string, term string")
    found = matches.recommend_labels(counts.select("id", "term"), labels, 1)
    assert "BroadcastHashJoin [term" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.id, r.label, r.shared) for r in found.collect()) == [(1, "x", 2), (2, "x", 1)]


def test_taxonomy_makes_words_of_a_text_once(spark, tmp_path):
    from lakeloom.operators import signals

    spark.createDataFrame([(1, "the of the in"), (2, None), (3, "zz the")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["a19_taxonomy_buckets"](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "Join" not in plan
    assert sorted((r.category, r["items"], r.terms) for r in found.collect()) == [("article", 2, ["the", "in", "of"]), ("other", 1, []), ("place", 1, ["the", "in", "of"])]
    rows = spark.createDataFrame([(1, "a", ["x", "x", "y"]), (2, "a", None), (3, "b", [])], "id long, category string, words array<string>")
    assert sorted((r.category, r["items"], r.terms) for r in signals.buckets(rows, 1).collect()) == [("a", 2, ["x"]), ("b", 1, [])]


def test_quantiles_of_a_group_are_no_ones_task(spark):
    """Equal to Spark's percentile over many ranges, with repeats, nulls, a null group, one value and no values; no task gathers a group's values."""
    rows = spark.range(5_000).select(F.when(F.col("id") % 3 < 2, F.concat(F.lit("g"), F.col("id") % 3)).alias("g"), F.when(F.col("id") % 11 != 0, F.floor(F.col("id") * 7919 % 997) / 8.0).alias("value"))
    rows = rows.unionAll(spark.createDataFrame([("one", 2.5), ("none", None)], "g string, value double"))
    found = profile.numeric_summary(rows, ["g"])
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = rows.groupBy("g").agg(F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.25)).alias("p25"), F.percentile("value", F.lit(0.75)).alias("p75"))
    assert sorted(map(str, found.select("g", "median", "p25", "p75").collect())) == sorted(map(str, want.collect()))


def test_depths_broadcast_no_front(spark):
    """Fronts are merged with the nodes: the rounds leave no broadcast join, which would pass them through the driver."""
    from unittest import mock

    from lakeloom.operators import graph

    plans_seen = []
    cut = graph.checkpointed
    with mock.patch.object(graph, "checkpointed", lambda df: plans_seen.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df)):
        rows = [(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5), (7, 3)]
        found = graph.depths(spark.createDataFrame(rows, "node long, parent long"))
    assert {r.node: r.depth for r in found.collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0, 7: 3}
    assert sum("SortMergeJoin" in p for p in plans_seen) >= 5 and not any("Broadcast" in p for p in plans_seen)


def test_a_keys_history_costs_two_state_calls_and_few_rows():
    """Each call for state is a round trip; a key's rows are combined before they reach its task. Kinds go after keep_ms, items with their key."""
    import random
    from unittest import mock

    import pyarrow as pa
    from pyspark.sql import Row

    from lakeloom.streaming import history

    kept, calls, clock = [None], [], mock.Mock()
    state = mock.Mock(get=lambda: calls.append("get") or kept[0], update=lambda v: calls.append("update") or kept.__setitem__(0, v))
    latest = history.Latest("u", "at", "item", "kind", 2, 10)
    latest.init(mock.Mock(getValueState=lambda *_: state))
    take = lambda now, *rows: clock.configure_mock(**{"getCurrentProcessingTimeInMs.return_value": now}) or [tuple(r) for r in latest.handleInputRows((1,), iter([Row(u=1, at=t, item=i, kind=k) for t, i, k in rows]), clock)]
    assert take(0, *((t, t, f"k{t}") for t in (3, 1, 2, 3))) == [(1, 1, 3, 3, 3), (1, 2, 2, 2, 3)] and calls == ["get", "update"]
    assert take(5, (2, 9, "k2"), (2, 9, None), (9, 0, "k1")) == [(1, 1, 9, 0, 3), (1, 2, 3, 3, 3)]
    assert take(10, (1, 1, None)) == [(1, 1, 9, 0, 1), (1, 2, 3, 3, 1)]

    rng = random.Random(0)
    rows = [{"u": u if rng.random() < 0.5 else "hot", "at": rng.randrange(30), "item": rng.randrange(9), "kind": rng.choice(["a", "b", "c", None])} for u in map(str, range(100)) for _ in range(30)]
    schema = pa.schema([("u", pa.string()), ("at", pa.int64()), ("item", pa.int64()), ("kind", pa.string())])
    batches = [pa.RecordBatch.from_pylist(rows[k : k + 100], schema) for k in range(0, len(rows), 100)]
    with mock.patch.object(history, "CHUNK_ROWS", 1000):
        found = [r for b in history.combine(iter(batches), "u", "at", "item", "kind", 5) for r in b.to_pylist()]

    def states(some):
        items, kinds = {}, {}
        for r in some:
            items.setdefault(r["u"], set()).add((r["at"], r["item"]))
            if r["kind"]:
                kinds[r["u"], r["kind"]] = max(r["at"], kinds.get((r["u"], r["kind"]), -1))
        return {u: sorted(x)[-5:] for u, x in items.items()}, kinds

    assert states(found) == states(rows) and sum(r["u"] == "hot" for r in found) <= 3 * 8 < 1000 < sum(r["u"] == "hot" for r in rows)
