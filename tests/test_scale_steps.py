"""Steps that were rewritten to scale, against plain versions."""

from __future__ import annotations

import hashlib
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import text as TX
from cohortlens.operators import explain as X
from cohortlens.operators import features as FT


def random_tree(rng, depth=4):
    n = 2 ** (depth + 1) - 1
    t = {"left": -np.ones(n, int), "right": -np.ones(n, int), "feat": -np.ones(n, int), "thr": np.zeros(n), "cover": np.ones(n), "value": rng.normal(size=n)}
    for i in range(n // 2):
        t["left"][i], t["right"][i], t["feat"][i], t["thr"][i] = 2 * i + 1, 2 * i + 2, rng.integers(0, 6), round(rng.normal(), 1)
    for i in range(n - 1, -1, -1):
        t["cover"][i] = 10 + i if i >= n // 2 else t["cover"][2 * i + 1] + t["cover"][2 * i + 2]
    return t


def test_each_outcome_of_a_tree_is_worked_out_once(monkeypatch):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(5000, 6)), 1)  # values at the thresholds too
    x[rng.random(x.shape) < 0.02] = np.nan
    plain, sizes = X._leaf_by_leaf, []
    monkeypatch.setattr(X, "_leaf_by_leaf", lambda leaves, rows: sizes.append(len(rows)) or plain(leaves, rows))
    for _ in range(4):
        leaves = X.leaf_paths(random_tree(rng))
        assert np.allclose(X.tree_shap(leaves, x), plain(leaves, x), atol=1e-12)
    assert max(sizes) < 2500
    deep = X.leaf_paths(random_tree(rng, 6))  # more tests than the table takes
    assert np.allclose(X.tree_shap(deep, x[:300]), plain(deep, x[:300]), atol=1e-12)


def test_quartiles_after_imputation_come_from_one_set_of_counts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    a, b = np.round(rng.normal(size=400), 1), rng.normal(size=400)
    rows = [(float(a[i]) if i % 3 else None, float(b[i]) if i % 7 > 3 else None, None) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, nothing double").repartition(3)
    from cohortlens.functions import quantiles as Q
    counted, plain = [], Q.value_counts
    monkeypatch.setattr(Q, "value_counts", lambda *args: counted.append(1) or plain(*args))
    p = FT.Preprocessor.fit(df, ["a", "b", "nothing"], [])
    assert len(counted) == 1 and p.medians["nothing"] is None and p.q1["nothing"] is None
    for i, c in enumerate(("a", "b")):
        v = np.array([np.nan if r[i] is None else r[i] for r in rows])
        median = np.nanmedian(v)
        full = np.where(np.isnan(v), median, v)
        assert (p.medians[c], p.q1[c], p.q3[c]) == pytest.approx((median, np.quantile(full, 0.25), np.quantile(full, 0.75)))


def test_moments_of_projections(spark):
    rng = np.random.default_rng(5)
    x, v = rng.normal(1e6, 1, (300, 4)), rng.normal(size=(3, 4))
    df = spark.createDataFrame([([float(n) for n in r],) for r in x], "f array<double>").repartition(5)
    mean, sd = FT.moments(df, "f", v.tolist())
    assert np.allclose(mean, (x @ v.T).mean(axis=0)) and np.allclose(sd, (x @ v.T).std(axis=0), rtol=1e-6)
    assert np.allclose(FT.gram_matrix(df, "f", 4), x.T @ x)


def test_fold_keeps_ascii_buffers_and_folds_the_rest(spark):
    texts = [None, "", "plain", "Añb ﬁ ½ ㎏ 漢 é", "e\u0301x"] * 40
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").coalesce(1).select("i", TX.ascii_fold(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r["t"] for r in got] == [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode() for t in texts]


def test_texts_are_written_to_few_folders(spark, tmp_path, monkeypatch):
    """A folder, a checksum and two renames per text took longer than the texts; tasks now fill folders of many files."""
    from cohortlens.plans.io_queries import src10_text_scan
    from cohortlens.sources import ingest
    rows = [(i, None if i == 3 else "é\nline\n" * (i % 4)) for i in range(25)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(ingest, "TEXT_FILES", 10)
    monkeypatch.setattr(ingest, "TEXT_BYTES", 8)
    monkeypatch.setattr(ingest, "scratch_path", lambda spark, name: f"{tmp_path}/{name}")
    found = {r["doc_id"]: (r["n_chars"], r["digest"]) for r in src10_text_scan(spark, str(tmp_path)).collect()}
    assert found == {i: (len(t or ""), hashlib.md5((t or "").encode()).hexdigest()) for i, t in rows}
    folders = sorted(p.name for p in (tmp_path / "texts").iterdir())
    assert folders == [f"part-00000-0000{i}" for i in range(3)]
    assert [len(list((tmp_path / "texts" / f).iterdir())) for f in folders] == [10, 10, 5]


def test_written_texts_keep_rows_without_key_and_repeated_keys(spark, tmp_path):
    from cohortlens.sources import ingest
    df = spark.createDataFrame([("b/c", "x"), (None, "y"), ("b/c", "z")], "name string, text string").coalesce(1)
    path = ingest.write_texts(df, "name", "text", str(tmp_path / "t"))
    assert sorted(r["value"] for r in ingest.read_texts(spark, path).collect()) == ["x\nz\n", "y\n"]
    none = ingest.write_texts(df.where("text = 'none'"), "name", "text", str(tmp_path / "none"))
    assert ingest.read_texts(spark, none).count() == 0
