"""The similarity join over blocks of sets, against all pairs, and what its plan moves."""

import itertools
import random

from lakeloom import plans
from lakeloom.operators import terms


def test_blocks_against_all_pairs(spark, monkeypatch):
    """Many blocks, sets of very different sizes, terms that nearly all have and terms of two sets."""
    monkeypatch.setattr(terms, "SIDE_SETS", 300)
    monkeypatch.setattr(terms, "BLOCK_POSTINGS", 1500)
    rng, sets = random.Random(3), {}
    for i in range(700):
        if i % 3 and sets:
            held = list(sets[rng.choice(list(sets))])
            sets[i] = frozenset(rng.sample(held, max(1, len(held) * 4 // 5)) + [f"new{i}"])
        else:
            sets[i] = frozenset([*rng.sample([f"often{k}" for k in range(12)], 9), *(f"t{rng.randrange(900)}" for _ in range(rng.choice((1, 8, 60))))])
    sets |= {700 + i: sets[i] for i in range(40)}
    frame = spark.createDataFrame([(i, t) for i, own in sets.items() for t in own], "id long, term string")
    first = {}
    for i, own in sets.items():
        first.setdefault(own, i)
    for least in (0.2, 0.5, 0.7):
        found = terms.jaccard_pairs(frame, least, len(sets))
        want = {(min(a, b), max(a, b), len(x & y), len(x & y) / len(x | y), len(x & y) / min(len(x), len(y))) for (x, a), (y, b) in itertools.combinations(first.items(), 2) if len(x & y) / len(x | y) >= least}
        got = [tuple(r) for r in found.collect()]
        assert len(got) == len(want) and set(got) == want and len(want) > 20


def test_no_pair_is_shuffled(spark, tmp_path):
    """What follows the checkpoint of the blocks has no exchange, for the queries that only list pairs."""
    spark.createDataFrame([(i, f"red green blue word{i}", "en", "web") for i in range(9)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("j5_jaccard_pairs", "j5_loose_pairs"):
        found = plans.load()[0][name](spark, str(tmp_path))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "Exchange" not in plan
        assert found.count() == 36
