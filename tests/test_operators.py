"""Operators against brute force on small inputs, with empty, null and tied ones."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as X
from lakeloom.functions import vectors as V
from lakeloom.operators import chunking, graph, lexicon, ordered, profile, rules, scores, stores, terms
from lakeloom.sources import files
from lakeloom.streaming import windows


def edges_of(seed, n, m):
    rng = random.Random(seed)
    return sorted({(min(p), max(p)) for p in ((rng.randrange(n), rng.randrange(n)) for _ in range(m)) if p[0] != p[1]})


@pytest.mark.parametrize("most", [1 << 20, 30])
def test_components_and_cores(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_EDGES", most)
    edges = edges_of(1, 60, 55)
    df = spark.createDataFrame(edges, "a long, b long")
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    want = {}
    for s in sorted(near):
        if s not in want:
            todo = [s]
            while todo:
                x = todo.pop()
                if x not in want:
                    want[x] = s
                    todo += near[x]
    assert {r.node: r.component for r in graph.components(df).collect()} == want
    core, left, k = {}, {x: set(y) for x, y in near.items()}, 0
    while left:
        x = min(left, key=lambda n: (len(left[n]), n))
        k = max(k, len(left[x]))
        core[x] = k
        for y in left.pop(x):
            left[y].discard(x)
    assert {r.node: r.core for r in graph.core_numbers(df).collect()} == core
    assert graph.core_numbers(df.limit(0)).count() == 0


def test_triangle_has_core_two(spark):
    df = spark.createDataFrame([(1, 2), (2, 3), (1, 3)], "a long, b long")
    assert {r.core for r in graph.core_numbers(df).collect()} == {2}


@pytest.mark.parametrize("most", [1 << 20, 12])
def test_strong_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "MOST_EDGES", most)
    rng = random.Random(3)
    edges = {(rng.randrange(25), rng.randrange(25)) for _ in range(45)} | {(7, 7)}
    reach = {x: {x} for e in edges for x in e}
    for _ in range(30):
        for a, b in edges:
            reach[a] |= reach[b]
    want = {a: min(b for b in reach[a] if a in reach[b]) for a in reach}
    got = graph.strong_components(spark.createDataFrame(sorted(edges), "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == want


def jobs(spark, name, work):
    """How many jobs ``work`` takes."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")


def test_graph_of_words_nulls_and_repeats(spark):
    edges = [("é", "a"), ("a", "b"), ("b", "é"), ("b", "é"), ("b", "z"), ("z", "z"), ("q", "q"), (None, "a"), ("a", None), (None, None)]
    df = spark.createDataFrame(edges, "a string, b string").withColumn("component", F.lit(1)).withColumn("node", F.lit("x"))
    assert {tuple(r) for r in graph.core_numbers(df).collect()} == {("a", 2), ("b", 2), ("é", 2), ("z", 1)}
    assert {tuple(r) for r in graph.strong_components(df).collect()} == {("a", "a"), ("b", "a"), ("é", "a"), ("z", "z"), ("q", "q")}
    assert graph.strong_components(df.limit(0)).count() == 0


def test_long_paths_take_few_jobs(spark):
    n, rng = 10_000, random.Random(4)
    names = rng.sample(range(n), n)
    path = spark.createDataFrame(list(zip(names, names[1:])), "a long, b long")
    assert jobs(spark, "cores", lambda: check_cores(path, n)) < 40
    assert jobs(spark, "strong", lambda: check_strong(path, n)) < 40


def check_cores(path, n):
    assert [tuple(r) for r in graph.core_numbers(path).groupBy("core").count().collect()] == [(1, n)]


def check_strong(path, n):
    assert graph.strong_components(path).where("node = component").count() == n


def test_depths_of_forest_and_cycle(spark):
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 5)], "node long, parent long")
    assert {r.node: r.depth for r in graph.depths(df).collect()} == {1: 0, 2: 1, 3: 2, 4: 0, 5: 0, 6: 0}


def test_greedy_match(spark):
    rng = random.Random(5)
    pairs = [(a, b, rng.randrange(6) / 10) for a in range(8) for b in range(8) if rng.random() < 0.6]
    na, nb, want = defaultdict(int), defaultdict(int), set()
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if na[a] < 2 and nb[b] < 1:
            na[a] += 1
            nb[b] += 1
            want.add((a, b))
    got = terms.greedy_match(spark.createDataFrame(pairs, "a long, b long, s double"), "s", 2, 1)
    assert {(r.a, r.b) for r in got.collect()} == want


def test_window_pairs_counts_self_pairs(spark):
    got = terms.window_pairs(spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "id long, text string"), 2)
    assert {(r.left, r.right): r.n for r in got.collect()} == {("a", "b"): 2, ("a", "a"): 1}


def test_row_numbers_and_sample(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    numbered = profile.global_row_number(df, ["k"])
    assert numbered.where("_row <> k + 1").count() == 0
    assert sorted(r.k for r in profile.uniform_sample(df, ["k"], 7).collect()) == [0, 142, 284, 426, 568, 710, 852]


def test_kinds(spark):
    cells = spark.createDataFrame([("a", x) for x in ("1,234", "2", "x", None, " ")] + [("b", x) for x in ("nan", "inf", "1d", "1_000", "true")], "column string, value string")
    assert {r.column: r.kind for r in profile.column_kinds(cells).collect()} == {"a": "numeric", "b": "categorical"}
    got = [r[0] for r in cells.select(profile.classify(F.col("value"))).collect()]
    assert got == ["number", "number", "text", "missing", "missing", "text", "text", "text", "text", "bool"]


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 5, 7, 100])
def test_truncate_utf8(spark, limit):
    texts = ["aé日🎉z", "", "é" * 4, "🎉🎉"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.truncate_utf8("t", limit)).collect()
    assert [r[0] for r in got] == [t.encode()[:limit].decode("utf-8", "ignore") for t in texts]


def test_vectors(spark):
    r = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "v array<double>, z array<double>").select(V.normalized(F.col("v")), V.normalized(F.col("z")), V.dot(F.col("v"), F.array(F.lit(1.0))), V.quantized_bits(F.col("v"))).first()
    assert [list(r[0]), list(r[1]), r[2], list(r[3])] == [[0.6, 0.8], [0.0, 0.0], 0.0, [3]]


def test_sequence_ratio_and_diff(spark):
    from difflib import SequenceMatcher

    r = spark.createDataFrame([("abcd", "bcde"), (None, "")], "a string, b string").select(X.sequence_ratio("a", "b"), X.unified_diff("a", "b")).collect()
    assert [x[0] for x in r] == [SequenceMatcher(None, "abcd", "bcde").ratio(), 1.0]
    assert "-abcd" in r[0][1] and "+bcde" in r[0][1] and r[1][1] == ""


def test_times(spark):
    values = ["2024-01-01T00:00:00Z", "1.5", "01:30", "1:00:00", "x", None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(X.timestamp_ns("v")).collect()]
    assert got == [1704067200 * 10**9, 1_500_000_000, 90 * 10**9, 3600 * 10**9, None, None]
    got = [r[0] for r in spark.createDataFrame([("5m",), ("2",), ("3 parsecs",), ("",)], "v string").select(X.duration_ns("v")).collect()]
    assert got == [300 * 10**9, 2 * 10**9, None, None]


def test_variable_chunks(spark):
    docs = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, "ab")], "id long, text string")
    got = [(r.id, r.content) for r in chunking.variable_chars(docs, [1, 3]).orderBy("id", "chunk").collect()]
    assert got == [(1, "a"), (1, "bcd"), (1, "e"), (1, "fgh"), (1, "i"), (1, "j"), (3, "a"), (3, "b")]
    got = [(r.id, r.content) for r in chunking.variable_chars(docs, [1, 3], repeat=False).orderBy("id", "chunk").collect()]
    assert got == [(1, "a"), (1, "bcd"), (1, "efghij"), (3, "a"), (3, "b")]


def test_headings(spark):
    docs = spark.createDataFrame([(1, "# A\n```\n# no\n```\n## B\nx\n# C\ny")], "id long, text string")
    found = ordered.parent_heading(chunking.headings(docs), ["id"])
    assert [(r.line, r.depth, r.title, r.parent, r.end) for r in found.orderBy("line").collect()] == [(1, 1, "A", None, 6), (5, 2, "B", 1, 6), (7, 1, "C", None, None)]


def test_code_chunks(spark):
    text = "a = [\n1,\n2]\nb = 1\nc = '''\nx\n'''\nd = 2"
    got = [r.content for r in chunking.code_chunks(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), 4).orderBy("chunk").collect()]
    assert got == ["a = [\n1,\n2]\nb = 1", "c = '''\nx\n'''\nd = 2"]


def test_symbols_and_imports(spark):
    text = "import os\nfrom a.b import c\nclass K:\n    def f(self):\n        for x in y:\n            g(x)\n"
    docs = spark.createDataFrame([(1, text), (2, "def (")], "id long, text string")
    assert [(r.kind, r.name, r.parent, r.calls) for r in rules.python_symbols(docs).orderBy("line").collect()] == [("class", "K", None, ["g"]), ("function", "f", "K", ["g"]), ("loop", "for", "f", ["g"])]
    assert [(r.line, r.module) for r in rules.import_references(docs).orderBy("line").collect()] == [(1, "os"), (2, "a.b")]


def test_conversation_segments(spark):
    docs = spark.createDataFrame([(1, "Ann: hi\nthere\nBob: yes\n\nfree")], "id long, text string")
    got = [(r.speaker, r.content) for r in rules.conversation_segments(docs).orderBy("index").collect()]
    assert got == [("Ann", "hi there"), ("Bob", "yes"), (None, "free")]


def test_stores(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n long")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "path string, n long")
    assert {tuple(r) for r in stores.replace_paths(old, new).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in stores.add_weights(old, new, ["path"], "n").collect()} == {("a", 1), ("b", 5), ("c", 4)}
    assert {tuple(r) for r in stores.merged_counters(old, new, ["path"]).collect()} == {("a", 1), ("b", 5), ("c", 4)}


def test_lexicon_is_size_checked(spark, monkeypatch):
    monkeypatch.setattr(lexicon, "MAX_TERMS", 2)
    docs = spark.createDataFrame([(1, "abc")], "id long, text string")
    with pytest.raises(ValueError):
        lexicon.match_terms(docs, spark.createDataFrame([("a",), ("b",), ("c",)], "term string"))


def test_citations(spark):
    answers = spark.createDataFrame([(1, "so [e1] and [e9]"), (2, "none")], "id long, text string")
    evidence = spark.createDataFrame([(1, "e1")], "id long, evidence_id string")
    assert [tuple(r) for r in rules.citation_errors(answers, evidence).collect()] == [(1, "e9")]


def test_sources(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.txt").write_text("one\ntwo\nthree")
    (tmp_path / "b.md").write_bytes(b"ab\xff")
    (tmp_path / "t.csv").write_text("k,v\n1,x\n2,\n")
    (tmp_path / "c.json").write_text('{"k": [1, 2], "v": ["a"]}')
    (tmp_path / "r.json").write_text('{"rows": [{"k": 1}, {"k": 2}]}')
    (tmp_path / "l.json").write_text('{"k": 1}\n{"k": 2}\n')
    found = files.scan_files(spark, str(tmp_path), files.include_globs(["TXT", "md"]), ["x/b*"])
    assert sorted(r.rel for r in found.select("rel").collect()) == ["b.md", "x/a.txt"]
    texts, errors = files.whole_texts(found, 5)
    assert [r.text for r in texts.collect()] == ["ab�"] and errors.count() == 1
    texts, _ = files.whole_texts(found)
    assert [r.content for r in files.line_range(texts.where("path like '%a.txt'"), 1, 1).collect()] == ["two"]
    assert files.read_table(spark, str(tmp_path / "t.csv")).dtypes == [("k", "string"), ("v", "string")]
    assert [tuple(r) for r in files.read_table(spark, str(tmp_path / "c.json")).collect()] == [(1, "a"), (2, None)]
    assert files.read_table(spark, str(tmp_path / "r.json")).count() == 2
    assert files.read_table(spark, str(tmp_path / "l.json")).count() == 2
    words = files.dictionary_lines(spark.createDataFrame([("# c\ncat: an animal\nDog - barks\nbare",)], "text string"))
    assert [tuple(r) for r in words.collect()] == [("cat", "an animal"), ("dog", "barks"), ("bare", None)]


def test_stream_chunks(spark, tmp_path):
    assert windows.cut_at("One. Two three", 8, 0) == 4
    (tmp_path / "in").mkdir()
    rows = spark.createDataFrame([("k", "One two. Three four. Five")], "key string, text string")
    rows.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, text string").json(str(tmp_path / "in"))
    q = windows.text_chunks(stream, "key", "text", 12).writeStream.format("memory").queryName("chunks").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.content for r in spark.table("chunks").orderBy("seq").collect()] == ["One two.", "Three four."]


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "id long, text string")
    assert terms.term_counts(empty).count() == 0
    assert chunking.fixed_chars(empty, 5).count() == 0
    assert lexicon.sentence_flags(empty).count() == 0
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
    events = spark.createDataFrame([], "ts timestamp, v double")
    assert ordered.dense_buckets(events, "ts", 1000, F.count("*").alias("n")).count() == 0


def test_similarity_join_equals_brute_force_with_hot_terms(spark):
    rng = random.Random(12)
    sets = {}
    for i in range(160):
        base = sets[rng.randrange(i)] if i and rng.random() < 0.6 else set(rng.sample(range(60), rng.randrange(1, 40)))
        sets[i] = {x for x in base if rng.random() > 0.1} | set(rng.sample(range(60), rng.randrange(3))) | {"hot"}
    rows = [(i, str(t)) for i, s in sets.items() for t in s]
    df = spark.createDataFrame(rows + rows[:50], "id long, term string")
    names = {}
    for i, s in sets.items():
        names.setdefault(frozenset(s), i)
    for least in (0.2, 0.5, 0.8, 1.0):
        want = {}
        for x, a in names.items():
            for y, b in names.items():
                if a < b and len(x & y) / len(x | y) >= least:
                    want[a, b] = (len(x & y), round(len(x & y) / len(x | y), 9), round(len(x & y) / min(len(x), len(y)), 9))
        got = {(r.a, r.b): (r.shared, round(r.jaccard, 9), round(r.overlap, 9)) for r in terms.jaccard_pairs(df, least).collect()}
        assert got == want, least
    assert terms.jaccard_pairs(df.where("false"), 0.5).count() == 0


def test_clusters_are_slices_of_components(spark):
    edges = [(i, i + 1, float(i)) for i in range(0, 30)] + [(100, 101, 1.0), (101, 100, 3.0), (7, 7, 9.0)]
    df = spark.createDataFrame(edges, "a long, b long, s double")
    nodes, summary = graph.clusters(df, 12, None, "s")
    got = {}
    for r in nodes.collect():
        got.setdefault(r.cluster, []).append((r.place, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {1: list(range(12)), 2: list(range(12, 24)), 3: list(range(24, 31)), 4: [100, 101]}
    assert sorted(map(tuple, summary.collect())) == [(1, 0, 12, 11, 5.0, True), (2, 0, 12, 11, 17.0, True), (3, 0, 7, 6, 26.5, True), (4, 100, 2, 1, 3.0, False)]
    nodes, summary = graph.clusters(df, 40, 1)
    assert nodes.count() == 31 and [r.truncated for r in summary.collect()] == [True]
    assert graph.clusters(df.where("false"), 3)[1].count() == 0


def test_automaton_equals_search_term_by_term(spark):
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("abÄé🎉 ") for _ in range(rng.randrange(60)))) for i in range(80)] + [(99, None), (100, ""), (100, "aaaa")]
    words = sorted({"".join(rng.choice("abä🎉") for _ in range(rng.randrange(1, 4))) for _ in range(40)} | {"aa", "AA", ""})
    docs = spark.createDataFrame(texts, "id long, text string")
    lex = spark.createDataFrame([(w, f"c{k % 3}") for k, w in enumerate(words)] + [(None, "none")], "term string, category string")
    want = {(i, w): (t.lower().count(w.lower()), t.lower().find(w.lower()) + 1) for i, t in texts for w in words if t and w and w.lower() in t.lower()}
    assert {(r.id, r.term): (r.n, r.first_at) for r in lexicon.match_terms(docs, lex).collect()} == want
    found = {(r.id, r.category): r.terms for r in lexicon.categories(docs, lex).collect()}
    assert found == {(i, c): sum((i, w) in want and f"c{k % 3}" == c for k, w in enumerate(words)) for i, _ in texts for c in ("c0", "c1", "c2", "none")}
    assert lexicon.match_terms(docs, lex.where("false")).count() == 0


@pytest.mark.parametrize("entries", [500_000, 10])
def test_store_scores_equal_all_products(spark, monkeypatch, entries):
    """Several stores, blocks and partial states, ties, odd vectors, lengths of two kinds."""
    monkeypatch.setattr(scores, "MOST_ENTRIES", entries)
    monkeypatch.setattr(scores, "ROWS", 7)
    rng = random.Random(3)
    rows = [(k, rng.choice(["a", "b", None]), [float(rng.randrange(-2, 3)) for _ in range(rng.choice([3, 3, 2]))]) for k in range(300)]
    rows += [(300, "a", None), (301, "a", []), (302, "b", [1.0, None, 0.0]), (303, "b", [float("nan"), 1.0, 0.0]), (304, "c", [0.0, 0.0, 0.0]), (7, *rows[7][1:])]
    df = spark.createDataFrame(rows, "id long, store string, v array<double>").repartition(5)
    asked = df.where("id % 40 = 0 or id >= 300")
    got = {(r.query_id, r.store): r for r in scores.store_scores(df, asked, 4, block=4).collect()}
    unit = lambda v: np.array(v) / (np.linalg.norm(v) or 1.0)
    good = [(i, s, unit(v)) for i, s, v in rows if v and not any(x is None or x != x for x in v)]
    seen = set()
    for q, _, x in good:
        if q % 40 and q < 300:
            continue
        for store in ("a", "b", None, "c"):
            hits = sorted((-round(float(x @ v), 9), i) for i, s, v in good if s == store and len(v) == len(x))
            if hits:
                r = got[q, store]
                assert r.n == len(hits) and r.total == pytest.approx(-sum(h[0] for h in hits)) and r.best == pytest.approx(-hits[0][0])
                assert [h.id for h in r.hits] == [h[1] for h in hits[:4]]
                seen.add((q, store))
    assert seen == set(got)
    assert scores.store_scores(df.limit(0), asked, 4).count() == 0 and scores.store_scores(df, asked.limit(0), 4).count() == 0


def test_shared_terms_are_in_order_and_bounded(spark):
    sets = {1: "dbcea", 2: "xdcab", 3: "qx", 4: "dbcea"}
    held = spark.createDataFrame([(g, k, t) for g in ("s", "t") for k, ts in sets.items() for t in ts * 2] + [(None, 1, "a"), ("s", None, "a")], "g string, id long, term string")
    pairs = spark.createDataFrame([("s", 1, 2, 0.5), ("t", 2, 1, 0.5), ("s", 2, 3, 0.1), ("s", 1, 3, 0.0), ("t", 1, 4, 1.0)], "g string, a long, b long, score double")
    got = {(r.g, r.a, r.b): r.shared_terms for r in terms_of(pairs, held).collect()}
    assert got == {("s", 1, 2): ["a", "b", "c"], ("t", 2, 1): ["a", "b", "c"], ("s", 2, 3): ["x"], ("s", 1, 3): [], ("t", 1, 4): ["a", "b", "c"]}
    assert terms_of(pairs.limit(0), held).count() == 0


def terms_of(pairs, sets):
    return terms.with_shared_terms(pairs, sets, ["g"], 3)
