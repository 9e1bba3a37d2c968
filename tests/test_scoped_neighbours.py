"""Nearest vectors of a scope in cells, against all pairs."""

import random

from lakeloom import plans
from lakeloom.operators import search


def test_neighbours_of_one_label_against_all_pairs(spark, tmp_path, monkeypatch):
    """Blocks of a few vectors; equal vectors, an id that comes twice, other lengths, and rows without a label or a vector."""
    monkeypatch.setattr(search, "CELL_QUERIES", 9)
    rng = random.Random(4)
    rows = [(i, i % 3, [float(rng.randint(-2, 2)) for _ in range(5)]) for i in range(90)]
    rows += [(i, i % 3, list(rows[i - 100][2])) for i in range(100, 130)] + [(7, 1, [1.0, 2.0, 0.0, 0.0, 1.0]), (200, 0, [1.0, 0.0]), (201, None, [1.0] * 5), (202, 1, None), (203, 2, [0.0] * 5)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    found = plans.load()[0]["j7_dot_self_join"](spark, str(tmp_path))
    assert "CoGroup" in found._jdf.queryExecution().executedPlan().toString()  # pairs are no rows of a join
    lists = {}
    for i, label, v in rows:
        for j, other, w in rows:
            if label is not None and label == other and i != j and v and w and len(v) == len(w):
                n, m = (sum(x * x for x in u) ** 0.5 or 1.0 for u in (v, w))
                score = round(sum((x / n) * (y / m) for x, y in zip(v, w, strict=True)), 9)
                if score >= 0.1:
                    lists.setdefault((label, i), []).append((-score, j))
    want = sorted((label, i, j, round(-s, 6)) for (label, i), own in lists.items() for s, j in sorted(own)[:5] if i < j)
    assert sorted((r.label, r.a, r.b, round(r.score, 6)) for r in found.collect()) == want and len(want) > 100
