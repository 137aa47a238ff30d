"""Cases that the driver tables do not hold: odd files, NaN, ties, empty sides, constant variables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortlens.functions import quantiles as Q
from cohortlens.operators import assign, association, features, quality, ranks
from cohortlens.sources import ingest as IO


def test_quantiles_equal_numpy_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(ranks, "ROWS_PER_RANGE", 20)  # forces more than 64 ranges
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.arange(6000) % 3, "a": rng.normal(size=6000), "b": rng.integers(0, 4, 6000).astype(float)})
    pdf.loc[::50, "a"] = None
    df = spark.createDataFrame(pdf).withColumn("nothing", F.lit(None).cast("double"))
    probs = [0.0, 0.25, 0.33, 0.5, 0.75, 1.0]
    got = Q.column_quantiles(df, ["a", "b", "nothing"], probs)
    assert set(got) == {"a", "b"}
    for c in "ab":
        assert np.allclose(got[c], np.quantile(pdf[c].dropna(), probs))
    for r in Q.exact_quantiles(df, ["a"], probs, ["g"]).collect():
        part = pdf[pdf.g == r["g"]].a.dropna()
        assert np.allclose(r["q"], np.quantile(part, probs)) and r["n_values"] == len(part)


def test_nan_is_no_outlier(spark):
    df = spark.createDataFrame([(float(i % 10),) for i in range(100)] + [(float("nan"),)] * 5 + [(1000.0,)], "x double")
    assert quality.iqr_outliers(df, ["x"]).first()["n_outliers"] == 1
    z = quality.zscore_outliers(df, ["x"]).first()
    assert z["n_outliers"] == 1 and not np.isnan(z["mean"])


def test_constant_variable_does_not_stop_the_others(spark):
    df = spark.createDataFrame([(i % 2, 1.0, float(i)) for i in range(20)], "cluster int, same double, x double")
    assert [r["variable"] for r in association.kruskal_wallis(df, "cluster", ["same", "x"]).collect()] == ["x"]


def test_knn_ties_precision_and_empty_side(spark):
    ref = spark.createDataFrame([(i, [1e4 + (i % 3), 5.0], i % 2) for i in range(60)], "k long, embedding array<double>, cluster int")
    got = assign.knn(ref.where("k < 3"), ref, "k", "k", k=7).collect()
    for q in range(3):
        rows = sorted((r for r in got if r["k"] == q), key=lambda r: r["rank"])
        assert [r["ref_key"] for r in rows] == [q + 3 * i for i in range(7)] and all(r["distance"] == 0 for r in rows)
    assert assign.knn(ref.limit(0), ref, "k", "k", k=2, carry=["cluster"]).count() == 0
    full = ref.select("k", F.col("embedding")[0].alias("a"), F.col("k").cast("double").alias("b"))
    assert assign.knn_impute(full, "k", ["a"], ["b"], 2).count() == 60


def test_typing_of_odd_columns(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n,big,f\n1,9007199254740993,1.5\nNA,2,nan\n3,,None\n")
    df = IO.load_delimited(spark, str(tmp_path / "x.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "big": "bigint", "f": "double"}
    assert [tuple(r) for r in df.collect()] == [(1, 9007199254740993, 1.5), (None, 2, None), (3, None, None)]


def test_row_ids_follow_files(spark, tmp_path):
    sizes, at = [3, 4000, 1, 900], 0
    for k, n in enumerate(sizes):
        (tmp_path / f"part-{k}.csv").write_text("v\n" + "\n".join(str(at + i) for i in range(n)) + "\n")
        at += n
    rows = IO.with_row_id(spark.read.option("header", True).csv(str(tmp_path)), "rid").collect()
    assert len(rows) == at and all(int(r["v"]) == r["rid"] for r in rows)


def test_whole_texts(spark, tmp_path):
    for k in range(2):
        (tmp_path / f"{k}.txt").write_text(f"line {k}\nsecond\n")
    assert sorted(r["value"] for r in IO.read_texts(spark, str(tmp_path)).collect()) == ["line 0\nsecond\n", "line 1\nsecond\n"]


def test_too_many_levels_fail_clearly(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_LEVELS", 3)
    df = spark.createDataFrame([(str(i),) for i in range(5)], "c string")
    with pytest.raises(ValueError, match="levels"):
        features.Preprocessor.fit(df, [], ["c"])
