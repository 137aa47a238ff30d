"""Distance joins over pivot cells and DBSCAN against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from cohortlens.operators import assign, cluster
from cohortlens.operators import neighbours as NB


def frame(spark, x, label=None, first=0):
    rows = [(first + i, [float(v) for v in p], int(label[i]) if label is not None else i % 3) for i, p in enumerate(x)]
    return spark.createDataFrame(rows, "id long, embedding array<double>, cluster int").repartition(5)


def blobs(seed, n, dim=3, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(0, 1, (n, dim)) + rng.integers(0, 4, (n, 1)) * 6.0, 2)
    return np.vstack([x, np.repeat(x[:1], copies, axis=0)]) if copies else x


def plain_knn(q, r, k, self_):
    out = {}
    for i, p in enumerate(q):
        d = np.sqrt(((r - p) ** 2).sum(axis=1))
        order = sorted((float(d[j]), j) for j in range(len(r)) if not (self_ and i == j))[:k]
        out[i] = [(j, round(a, 9)) for a, j in order]
    return out


@pytest.mark.parametrize("n,copies,k,pivots,block", [(300, 0, 5, None, 4096), (300, 150, 7, 20, 16), (60, 30, 200, 9, 8), (5, 0, 3, 1, 2)])
def test_knn_equals_brute_force(spark, n, copies, k, pivots, block):
    """Ties by the key, copies of one point in many blocks, fewer rows than k, one to many cells."""
    x = blobs(n, n, copies=copies)
    df = frame(spark, x)
    for self_ in (False, True):
        got = {}
        rows = NB.knn_join(df.select("id", "embedding"), df, "id", "id", "embedding", k, self_, ["cluster"], pivots, block).collect()
        for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
            got.setdefault(r["id"], []).append((r["ref_key"], round(r["distance"], 9)))
            assert r["cluster"] == r["ref_key"] % 3
        assert got == plain_knn(x, x, k, self_)


def test_knn_outside_points_and_missing_vectors(spark):
    x = blobs(4, 200)
    q = np.vstack([x[:20] + 0.3, [[1e6, 0, 0]], [[-1e3, 5, 5]]])
    queries = frame(spark, q).union(spark.createDataFrame([(900, None, 0), (901, [1.0, None, 2.0], 0)], "id long, embedding array<double>, cluster int"))
    rows = NB.knn_join(queries, frame(spark, x), "id", "id", "embedding", 4, n_pivots=15, block=32).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["id"], r["rank"])):
        got.setdefault(r["id"], []).append((r["ref_key"], round(r["distance"], 9)))
    assert got == plain_knn(q, x, 4, False)
    empty = frame(spark, x).limit(0)
    assert NB.knn_join(frame(spark, q), empty, "id", "id", "embedding", 4, carry=["cluster"]).collect() == []
    assert NB.knn_join(empty, frame(spark, x), "id", "id", "embedding", 4).collect() == []


def test_lower_bounds_hold_and_prune(spark):
    x = blobs(9, 900)
    rows, cells = NB.in_cells(NB.points(frame(spark, x), "id", "embedding"), NB.pivots_of(NB.points(frame(spark, x), "id", "embedding")))
    of = {r["k"]: r["cell"] for r in rows.select("k", "cell").collect()}
    d = cells.distances(x)
    bounds = cells.lower_bounds(d)
    real = np.sqrt(NB.squared(x, x))
    for cell in set(of.values()):
        members = [k for k, c in of.items() if c == cell]
        assert (bounds[:, cell] <= real[:, members].min(axis=1)).all()
    halo = NB.within_visits(rows, cells, 0.5)
    assert NB.compared_pairs(rows, halo) < len(x) ** 2 / 4


def plain_dbscan(x, eps, ms):
    near = NB.squared(x, x) <= eps ** 2 + 1e-12
    core = near.sum(axis=1) >= ms
    label = np.where(core, np.arange(len(x)), -1)
    while True:
        new = np.array([min([label[i]] + [label[j] for j in np.flatnonzero(near[i] & core)]) if core[i] else -1 for i in range(len(x))])
        if (new == label).all():
            break
        label = new
    for i in np.flatnonzero(~core):
        found = [label[j] for j in np.flatnonzero(near[i] & core)]
        label[i] = min(found) if found else -1
    ids = {v: n for n, v in enumerate(sorted(set(label) - {-1}))}
    return [ids.get(v, -1) for v in label]


@pytest.mark.parametrize("seed,copies,eps,ms,pivots,block", [(1, 0, 0.6, 4, None, 4096), (2, 60, 0.5, 5, 12, 10), (3, 200, 0.01, 3, 5, 16), (4, 0, 50.0, 2, 8, 20)])
def test_dbscan_equals_brute_force(spark, seed, copies, eps, ms, pivots, block):
    x = blobs(seed, 220, 2, copies)
    df = frame(spark, x).union(spark.createDataFrame([(5000, None, 0)], "id long, embedding array<double>, cluster int"))
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, "id", "embedding", eps, ms, pivots, block).collect()}
    assert got.pop(5000) == -1
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, eps, ms)


def test_dbscan_of_nothing(spark):
    assert cluster.dbscan(frame(spark, blobs(1, 5)).limit(0), "id").collect() == []


def test_vote_on_the_join(spark):
    x = blobs(7, 120)
    df = frame(spark, x)
    out = assign.assign_clusters(df.select("id", "embedding"), df.select(df["id"].alias("ref"), "embedding", "cluster"), "id", "ref", 1)
    assert all(r["cluster"] >= 0 and r["neighbors_used"] == 1 for r in out.collect()) and out.count() == 120


def test_products_decide_as_exact_differences():
    """Pairs at the radius itself, far from the origin, of tiny numbers and beyond single precision."""
    rng = np.random.default_rng(3)
    grid = np.round(rng.uniform(0, 3, (300, 3)), 1)
    for x, limit in ((grid, 1.0), (grid + 1e7, 1.0), (grid * 1e-25, 1e-50), (grid * 1e30, 1e60), (grid[:5].repeat(40, axis=0), 0.0)):
        assert (NB.decided(x[:50], x, limit) == (NB.squared(x[:50], x) <= limit)).all()


def test_a_point_is_sent_once_for_a_group_of_cells(spark):
    x = blobs(9, 900)
    points = NB.points(frame(spark, x), "id", "embedding")
    rows, cells = NB.in_cells(points, NB.pivots_of(points), 4096)
    assert len(cells.held) == 1 < len(cells.pivots) and cells.held.sum() == len(x)
    assert NB.within_visits(rows, cells, 50.0).count() == len(x)
    rows, cells = NB.in_cells(points, NB.pivots_of(points), 100)
    assert 1 < len(cells.held) < len(cells.pivots) and cells.held.max() <= max(100, cells.rows.max())


def test_dbscan_stores_each_row_a_few_times(spark, monkeypatch):
    """Every row used to be stored once for each group of cells within its reach, which filled the disk."""
    from cohortlens import session
    from cohortlens.operators import density
    stored, plain = [], session.cut_lineage

    def counted(df):
        out = plain(df)
        stored.append(out.count())
        return out

    for module in (session, NB, density):
        monkeypatch.setattr(module, "cut_lineage", counted, raising=False)
    x = np.random.default_rng(5).random((600, 6))
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(frame(spark, x), "id", "embedding", 0.45, 5, 24, 25).collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, 0.45, 5)
    assert sum(stored) <= 3 * len(x)


def test_dbscan_with_a_large_graph_of_labels(spark, monkeypatch):
    """More edges than the driver merges: Spark merges them, and the roots go to files."""
    from cohortlens.operators import density
    monkeypatch.setattr(density, "EDGES", 2)
    x = blobs(3, 220, 2, 100)
    got = {r["id"]: r["cluster"] for r in cluster.dbscan(frame(spark, x), "id", "embedding", 0.4, 4, 20, 10).collect()}
    assert [got[i] for i in range(len(x))] == plain_dbscan(x, 0.4, 4)


def test_blocks_of_density_hold_bounded_rows(spark, tmp_path):
    """Copies of one point and a cell with most of the rows are cut into blocks; counts and keys add up."""
    from cohortlens.operators import density
    x = np.vstack([np.zeros((700, 2)), np.random.default_rng(1).random((300, 2))])
    points = NB.points(frame(spark, x), "id", "embedding")
    cells, blocks = density.packed(points, np.array([[0.0, 0.0], [50.0, 50.0]]), str(tmp_path), 10)
    parts = [density._points(b, 2) for b in blocks]
    members = [np.frombuffer(density._get(b.members), np.int64).reshape(-1, 2) for b in blocks]
    assert max(b.n for b in blocks) <= 2 * 10 and max(p[3].sum() for p in parts) <= (density.COPIES + 1) * 10
    assert sum(p[3].sum() for p in parts) == 1000 and cells.rows.sum() == sum(b.n for b in blocks)
    assert sorted(np.concatenate([m[:, 1] for m in members]).tolist()) == list(range(1000))
    for (points_, _, keys, _), m in zip(parts, members):
        assert (points_[m[:, 0]] == x[m[:, 1]]).all() and (keys == [m[m[:, 0] == i, 1].min() for i in range(len(keys))]).all()


def test_dbscan_with_null_and_repeated_keys(spark):
    """Rows without a key count as neighbours and are in no cluster; every row of a repeated key has its cluster."""
    from pyspark.sql import functions as F
    rows = [(1, 0.0), (1, 0.0), (None, 0.0), (2, 0.1), (3, 9.0), (None, 9.0)]
    df = spark.createDataFrame(rows, "id long, v double").select("id", F.array("v").alias("embedding"))
    got = {(r["id"], r["cluster"]) for r in cluster.dbscan(df, "id", "embedding", 0.5, 4).collect()}
    assert got == {(1, 0), (2, 0), (3, -1), (None, -1)}
