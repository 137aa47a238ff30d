"""Operator 3 learns from long texts too."""

from __future__ import annotations

import numpy as np

from cohortlens.llm import toxicity


def test_long_texts_are_learned_from(spark):
    texts = ["you are a moron, " * 5000 if i % 2 else "a nice day to all, " * 20 for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert all(r.predicted == r.doc_id % 2 for r in rows)


def test_features_differ_beyond_chance():
    a, b = np.array([0.0, 5.0, 50.0, 0.0]), np.array([0.0, 5.0, 0.0, 20.0])
    g = toxicity.g_statistic(a, b, 100.0, 100.0)
    assert g[0] == 0 and abs(g[1]) < 1e-9 and g[2] > 60 and g[3] > 20
