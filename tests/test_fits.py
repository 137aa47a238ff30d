"""Clusterings fitted in shared passes, against plain versions."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import fits


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(x)], "row_id long, embedding array<double>").repartition(4)


def blobs(seed=0, n=240, k=4, dim=3, far=8.0):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (n, dim)) + (np.arange(n) % k)[:, None] * far


def clusters(df):
    return np.array([r["cluster"] for r in df.orderBy("row_id").collect()])


def same(a, b):
    return len({(x, y) for x, y in zip(a, b)}) == len(set(a)) == len(set(b))


def plain_ward(x, w, k):
    groups = [([i], x[i].astype(float), float(w[i])) for i in range(len(x))]
    while len(groups) > k:
        cost = {(i, j): groups[i][2] * groups[j][2] / (groups[i][2] + groups[j][2]) * ((groups[i][1] - groups[j][1]) ** 2).sum()
                for i in range(len(groups)) for j in range(i + 1, len(groups))}
        i, j = min(cost, key=cost.get)
        a, b = groups[i], groups[j]
        groups[i] = (a[0] + b[0], (a[1] * a[2] + b[1] * b[2]) / (a[2] + b[2]), a[2] + b[2])
        del groups[j]
    out = np.zeros(len(x), int)
    for g, (m, _, _) in enumerate(groups):
        out[m] = g
    return out


@pytest.mark.parametrize("seed", range(6))
def test_ward_chain_equals_pairwise_ward(seed):
    rng = np.random.default_rng(seed)
    x, w = rng.normal(0, 3, (40, 3)), rng.integers(1, 9, 40)
    found = fits.ward(x, w, [1, 2, 5, 11, 40])
    for k, labels in found.items():
        assert len(set(labels)) == k and same(labels, plain_ward(x, w, k))
    assert list(fits.ward(np.array([[0.0], [0.1], [10.0], [10.2]]), np.array([5, 5, 5, 5]), [2])[2]) == [0, 0, 1, 1]


def test_ward_of_rows_and_of_micro_centroids(spark):
    x = np.vstack([blobs(3, 60), blobs(3, 60)[:7]])  # copies count as weight
    got = clusters(fits.fit_grid(frame(spark, x), "agglomerative", [4])[4][0])
    assert same(got, plain_ward(x, np.ones(len(x)), 4))
    coarse, info = fits.fit_grid(frame(spark, x), "agglomerative", [4], micro=20)[4]
    assert same(clusters(coarse), got) and info["micro"] <= 20


@pytest.mark.parametrize("threshold,max_micro", [(0.5, 2000), (2.0, 2000), (0.01, 30)])
def test_birch_keeps_its_radius(spark, threshold, max_micro):
    x = np.round(blobs(1, 300), 2)
    cf = fits.clustering_features(frame(spark, x), "embedding", threshold, max_micro)
    own = cf.tree.micro(x)
    assert cf.n.sum() == len(x) and len(cf.n) <= max_micro and cf.radius.max() <= cf.threshold
    for c in range(len(cf.n)):
        some = x[own == c]
        assert len(some) == cf.n[c] and np.allclose(some.mean(axis=0), cf.centroids[c])
        assert np.sqrt(((some - some.mean(axis=0)) ** 2).sum(axis=1).mean()) <= cf.threshold + 1e-9
    assert cf.threshold == threshold or max_micro == 30


def test_birch_and_ward_are_different_methods(spark):
    rng = np.random.default_rng(5)
    x = rng.uniform(0, 10, (400, 2))
    df = frame(spark, x)
    birch, info = fits.fit_grid(df, "birch", [5], threshold=1.5)[5]
    assert info["radius"] <= 1.5 and not same(clusters(birch), clusters(fits.fit_grid(df, "agglomerative", [5])[5][0]))
    copies = frame(spark, np.repeat(x[:1], 50, axis=0))
    assert set(clusters(fits.fit_grid(copies, "birch", [3])[3][0])) == {0}


def test_k_means_keeps_the_best_of_all_starts(spark):
    x = blobs(2)
    df = frame(spark, x)
    many = fits.fit_grid(df, "kmeans", [2, 4, 7])
    assert same(clusters(many[4][0]), np.arange(len(x)) % 4)
    for k, (labels, info) in many.items():
        own = clusters(labels)
        assert np.isclose(info["cost"], sum(((x[own == j] - info["centers"][j]) ** 2).sum() for j in range(k)))
        assert info["cost"] <= fits.fit_grid(df, "kmeans", [k], starts=1)[k][1]["cost"] * 1.001
    assert many[2][1]["cost"] > many[4][1]["cost"] > many[7][1]["cost"]


def test_passes_do_not_grow_with_starts(spark, monkeypatch):
    df, calls = frame(spark, blobs(2, 100)), []
    real = fits.one_pass
    monkeypatch.setattr(fits, "one_pass", lambda *a: calls.append(1) or real(*a))
    fits.k_means(df, "row_id", "embedding", [3, 4], 1, rounds=5)
    few = len(calls)
    calls.clear()
    fits.k_means(df, "row_id", "embedding", [3, 4], 20, rounds=5)
    assert len(calls) <= 6 and few <= 6


def test_mixture_separates_shapes(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(0, 1, (300, 2)) * [8, 0.3], rng.normal(0, 1, (300, 2)) * [0.3, 8] + [0, 30]])
    labels, info = fits.fit_grid(frame(spark, x), "gmm", [2])[2]
    own = clusters(labels)
    assert (own[:300] == own[0]).mean() > 0.97 and (own[300:] != own[0]).mean() > 0.97
    joint = info["mixture"].log_joint(x)
    assert np.isclose(np.logaddexp.reduce(joint, axis=1).mean(), info["log_likelihood"], atol=0.02)
    assert np.isclose(info["mixture"].weights.sum(), 1)


def test_shared_metrics_equal_the_single_ones(spark):
    from pyspark.sql import functions as F

    from cohortlens.operators import cluster as CL
    x = blobs(8, 160, 3, 2, 5.0)
    df = frame(spark, x)
    outcome = spark.createDataFrame([(i, i % 3 == 0) for i in range(160)], "row_id long, dead boolean").withColumn("dead", F.col("dead").cast("int"))
    exp, labels = CL.sweep(df, outcome, ks=[2, 3], key="row_id", target="dead", n_init=2, dbscan_grid=[(0.9, 6)], sample_size=100)
    assert {r["method"] for r in exp.collect()} == set(CL.METHODS)
    for r in exp.collect():
        lab = labels[r["experiment_id"]]
        one = CL.evaluate(df, lab, "row_id", 100)
        for name in ("n_clusters", "noise_ratio", "coverage", "silhouette", "calinski_harabasz", "davies_bouldin"):
            assert r[name] == pytest.approx(one[name], rel=1e-6, abs=1e-9), (r["experiment_id"], name)
        rates = lab.join(outcome, "row_id").where("cluster <> -1").groupBy("cluster").agg(F.avg("dead").alias("r"))
        assert r["mortality_separation"] == pytest.approx(rates.agg(F.stddev_pop("r")).first()[0])


def test_blocks_are_dealt_to_all_cores(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (3 * fits.SLICE + 5, 3))
    df = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "row_id long, embedding array<double>").coalesce(1)
    blocks = fits.packed(df, "embedding")
    tasks = spark.sparkContext.defaultParallelism
    held = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(held) >= 4 and max(held) <= max(1, 2 * sum(held) / tasks)
    total = fits.one_pass(blocks, 4, 2, lambda s: np.vstack([np.r_[len(s), s.sum(axis=0)], np.zeros(4)]))
    assert np.allclose(total, np.vstack([np.r_[len(x), x.sum(axis=0)], np.zeros(4)]))


def test_centres_at_one_distance_share_no_row(spark):
    x = np.repeat([[0.0, 0.0], [5.0, 0.0]], 20, axis=0)  # fewer distinct rows than centres
    found = fits.k_means(frame(spark, x), "row_id", "embedding", [2, 4], 3)
    assert all(cost == pytest.approx(0) for _, cost in found.values())
    assert {tuple(c) for c in np.round(found[4][0], 9).tolist()} == {(0.0, 0.0), (5.0, 0.0)}
