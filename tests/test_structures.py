"""Newer operators against brute force and at their edges."""

import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import actions, code, lexicon, matches, ordered, segments, signals, stores, terms
from lakeloom.sources import files


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_jaccard_pairs_against_brute_force(spark):
    """A token in every set, equal sets, sets of one token, and an empty table."""
    rng = random.Random(1)
    sets = {k: {"hot"} | {f"t{rng.randrange(25)}" for _ in range(rng.randrange(1, 9))} for k in range(120)}
    sets |= {200: {"hot"}, 201: {"hot"}, 202: {"t1"}, 203: set(sets[0]), 204: set(sets[0])}
    frame = spark.createDataFrame([(k, t) for k, s in sets.items() for t in s], "id long, term string")
    names = {}
    for k in sorted(sets):
        names.setdefault(frozenset(sets[k]), k)
    for least in (0.2, 0.5, 1.0):
        want = []
        for (x, a), (y, b) in itertools.combinations(sorted(names.items(), key=lambda n: n[1]), 2):
            if len(x & y) / len(x | y) >= least:
                want.append((a, b, len(x & y), round(len(x & y) / len(x | y), 6)))
        got = terms.jaccard_pairs(frame, least).select("a", "b", "shared", F.round("jaccard", 6))
        assert rows_of(got) == sorted(want, key=str)
    assert {r.id: r.class_id for r in terms.set_members(frame).collect()} == {k: names[frozenset(s)] for k, s in sets.items()}
    assert terms.jaccard_pairs(frame.limit(0), 0.5).count() == 0


def test_nearest_larger(spark):
    rng = random.Random(2)
    rows = [(g, k, rng.choice([0, 1, 3, 3, 7, 8, 100, 10**9])) for g in range(3) for k in range(60)] + [(9, 1, None), (9, 2, 5), (9, 3, 4)]
    df = spark.createDataFrame(rows, "g long, k long, n long")
    got = {(r.g, r.k): r.p for r in ordered.nearest_larger(df, ["g"], "k", "n", "p").collect()}
    for g, k, n in rows:
        want = max((j for h, j, m in rows if h == g and j < k and m is not None and n is not None and m > n), default=None)
        assert got[g, k] == want
    assert ordered.nearest_larger(df.limit(0), ["g"], "k", "n", "p").count() == 0


def test_parent_heading(spark):
    rng = random.Random(3)
    rows = [(g, 2 * k + 1, rng.randrange(1, 7)) for g in range(4) for k in range(40)]
    got = {(r.g, r.line): (r.parent, r.end) for r in ordered.parent_heading(spark.createDataFrame(rows, "g long, line int, depth int"), ["g"]).collect()}
    for g, line, depth in rows:
        before = [x for h, x, y in rows if h == g and x < line and y < depth]
        after = [x for h, x, y in rows if h == g and x > line and y <= depth]
        assert got[g, line] == (max(before, default=None), min(after) - 1 if after else None)


def test_schema_errors():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": ["integer", "null"]}, "b": {"type": "array", "items": {"type": "string", "maxLength": 2}, "minItems": 1}, "c": {"enum": [1, "x"]}}, "additionalProperties": {"type": "number"}}
    ok = lambda v: actions.schema_errors(schema, v)
    assert ok({"a": 1}) == [] and ok({"a": None, "b": ["xy"], "c": "x", "z": 1.5}) == []
    assert ok([]) == ["$: not of type object"] and ok({}) == ["$.a: missing"] and ok({"a": True}) == ["$.a: not of type integer|null"]
    assert ok({"a": 1, "b": []}) == ["$.b: too short"] and ok({"a": 1, "b": ["abc", 3]}) == ["$.b[0]: too long", "$.b[1]: not of type string"]
    assert ok({"a": 1, "c": 2, "z": "s"}) == ["$.c: not one of the listed values", "$.z: not of type number"]


def test_actions(spark):
    known = actions.Actions()
    known.register("numbers", lambda s, n: s.range(n), {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "maximum": 5}}, "additionalProperties": False})
    known.alias("three", "numbers", n=3)
    assert known.run("numbers", spark, n=2).count() == 2 and known.run("three", spark).count() == 3
    for call, error in ((lambda: known.run("numbers", spark, n=9), ValueError), (lambda: known.run("numbers", spark, m=1), ValueError), (lambda: known.run("none", spark), KeyError), (lambda: known.register("numbers", None), ValueError), (lambda: known.register("a b", None), ValueError)):
        with pytest.raises(error):
            call()
    specs = [("never", json.dumps({"name": "x", "description": "", "parameters": {}, "sql": "select 1", "permission": "never"})), ("null", None)]
    assert actions.load_specs(spark.createDataFrame(specs, "path string, text string"), known) == [("null", "not JSON")]
    assert [r.name for r in known.listing(spark).collect()] == ["numbers", "three"]


def test_replaced_folder(spark, tmp_path):
    to = f"file://{tmp_path}/jobs"
    for n in (3, 5):
        files.replace_folder(spark.range(n), to)
        assert spark.read.parquet(to).count() == n
    files.replace_folder(spark.read.parquet(to).where("id < 2"), to)
    assert spark.read.parquet(to).count() == 2 and sorted(p.name for p in tmp_path.iterdir()) == ["jobs"]


def test_catalog(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"path": "a", "store_type": "sqlite", "min_score": 0.5}\n{"path": \n{"store_type": "faiss"}\n{"path": "b", "store_type": "other"}\n')
    good, bad = files.load_catalog(spark, f"file://{tmp_path}/c.jsonl")
    assert rows_of(good) == [("a", "sqlite", "a", 0.5, None)]
    assert sorted(r.error for r in bad.collect()) == ["no path", "not readable", "unknown store type"]


def test_units_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "a b c d e\n\nf. g! h"), (6, "w " * 5000)], "id long, text string")
    got = {(r.id, r.chunk): (r.first, r.last, r.content, r.truncated) for r in segments.unit_chunks(docs, "words", 3, 1, 2).collect()}
    assert got[4, 0] == (0, 0, "one", False) and got[5, 1] == (2, 4, "c d e", True) and got[6, 1][3] and not any(k[0] < 4 for k in got)
    assert segments.unit_chunks(docs, "paragraphs", 1).where("id = 5").count() == 2 and segments.unit_chunks(docs, "chars", 2).where("id = 4").count() == 2
    for unit in segments.JOINERS:
        assert segments.unit_chunks(docs.limit(0), unit, 2).count() == 0
    large = segments.unit_chunks(docs, "lines", 10, max_bytes=100).where("id = 6").first()
    assert large.content is None and large.error == "over 100 bytes"


def test_dialogue_and_times(spark):
    docs = spark.createDataFrame([(1, "Ann: hello\nthere\n\nno name\nBob: x"), (2, None), (3, "")], "id long, text string")
    assert rows_of(segments.dialogue(docs)) == [(1, 1, "Ann", "hello there"), (1, 2, None, "no name"), (1, 3, "Bob", "x")]
    assert rows_of(segments.dialogue(docs, 5)) == [(1, 1, "Ann", "hello there"), (1, 2, None, "no name")]
    timed = spark.createDataFrame([(1, "intro\n[00:10] a\nb\n[01:02:03] c"), (2, "")], "id long, text string")
    assert rows_of(segments.timestamped(timed)) == [(1, 0, None, "intro"), (1, 1, 10, "a b"), (1, 2, 3723, "c")]
    marks = spark.createDataFrame([(1, "00:05 a\nnothing\n00:10-00:12 b\n1:00:00 c")], "id long, text string")
    assert rows_of(segments.intervals(marks)) == [(1, 1, 5, 10, "a"), (1, 2, 10, 12, "b"), (1, 3, 3600, None, "c")]


def test_group_levels(spark):
    rows = spark.createDataFrame([(g, k, f"t{k}") for g, n in ((1, 7), (2, 1), (3, 3)) for k in range(n)], "g long, k long, content string")
    got = segments.group_levels(rows, ["g"], "k", 3, 100)
    assert {(r.g, r.level): r.n for r in got.groupBy("g", "level").agg(F.count("*").alias("n")).collect()} == {(1, 0): 7, (1, 1): 3, (1, 2): 1, (2, 0): 1, (3, 0): 3, (3, 1): 1}
    assert got.where("g = 1 and level = 2").first().content == "t0 t1 t2 t3 t4 t5 t6"
    assert segments.group_levels(rows.limit(0), ["g"], "k", 3, 10).count() == 0


def test_inheritance_with_a_cycle(spark):
    bases = spark.createDataFrame([(1, "a", "b"), (1, "b", "a"), (1, "c", "object"), (1, "d", "c"), (1, "e", "d"), (1, "e", "c"), (2, "a", None)], "id long, name string, base string")
    got = {(r.id, r.name): (r.group_name, r.depth) for r in code.inheritance_groups(bases).collect()}
    assert got == {(1, "a"): ("a", 1), (1, "b"): ("a", 1), (1, "c"): ("c", 1), (1, "d"): ("c", 2), (1, "e"): ("c", 3), (2, "a"): ("a", 1)}


def test_code_of_odd_sources(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "def (:"), (4, "x = 1")], "id long, text string")
    assert rows_of(code.variables(docs)) == [(4, "", 0, "global", "x", 1)] and code.loop_data(docs).count() == 0
    assert code.brace_chunks(docs, ("class",)).count() == 0 and code.symbol_chunks(docs, "class").count() == 0
    assert [r.id for r in code.structures(docs, 3, 2).where("kind = 'code'").orderBy("id").collect()] == [3, 4]


def test_complex_numbers_and_categories(spark):
    df = spark.createDataFrame([("a 1+2i b -3.5 - 4j, 7i x2 ii", "no question here but a plan"), (None, None), ("", "why?")], "t string, s string")
    got = df.select(signals.complex_numbers(F.col("t")).alias("c"), signals.categories(F.col("s")).alias("k")).collect()
    assert [(c.re, c.im) for c in got[0].c] == [(1, 2), (-3.5, -4), (0, 7)] and got[1].c == [] and got[2].c == []
    assert got[0].k == ["plan", "disagreement"] and got[1].k == ["statement"] and got[2].k == ["question"]


def test_lexicon_is_bounded_by_bytes(spark):
    with pytest.raises(ValueError):
        lexicon.checked(spark.range(5).select(F.repeat(F.lit("x"), 2_000_000).alias("term")))
    assert lexicon.checked(spark.createDataFrame([("a",)], "term string")).count() == 1


def test_chosen_and_requested(spark):
    known = spark.createDataFrame([("Old Tale",), ("epic",)], "name string")
    asked = spark.createDataFrame([("old-tale",), (" EPIC ",), ("none",), (None,)], "asked string")
    assert {(r.asked, r.name) for r in matches.requested(asked, known).collect()} == {("old-tale", "Old Tale"), (" EPIC ", "epic"), ("none", None), (None, None)}
    cached = stores.cache_store(spark.createDataFrame([], "s long, k string, content string, used long, uses long"), spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 2)], "s long, k string, content string, used long"), ["s"], "k")
    assert rows_of(cached) == [(1, "a", "y", 2, 2)]
