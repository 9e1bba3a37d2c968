"""Where the toxicity network is trained, and what comes of tables that teach nothing."""

import os

import numpy as np

from lakeloom.llm import toxicity


def rows(spark, n):
    docs = spark.createDataFrame([(i, "you utter moron" if i % 2 else "a fine day by the lake") for i in range(n)], "doc_id long, text string")
    return docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as toxic")


def test_network_is_trained_in_a_task(spark, monkeypatch):
    plain = toxicity.fit

    def fit(docs, y):
        net = plain(docs, y, rounds=1, steps=3)
        net.pid, net.seen = os.getpid(), (docs, y)
        return net

    monkeypatch.setattr(toxicity, "fit", fit)
    net = toxicity.train(*rows(spark, 60))
    docs, y = net.seen
    assert net.pid != os.getpid()
    assert {(" ".join(d), int(v)) for d, v in zip(docs, y, strict=True)} == {("you utter moron", 1), ("a fine day by the lake", 0)}
    want = plain(docs, y, rounds=1, steps=3)
    assert all(np.array_equal(net.p[k], want.p[k]) for k in want.p)


def test_no_labels_give_a_network_that_accepts(spark):
    docs, labels = rows(spark, 4)
    net = toxicity.train(docs, labels.where("doc_id < 0"))
    assert (net.probabilities([["moron"]]) < 0.5).all()
