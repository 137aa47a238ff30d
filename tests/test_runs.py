"""A clustering run, its record and its bundle."""

from __future__ import annotations

import json
import os
import shutil

import numpy as np
import pytest

from cohortlens.operators import runs
from cohortlens.sources.ingest import scratch_path


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(6 * (i % 3), 1)), float(rng.normal(-6 * (i % 3), 1)) if i % 10 else None, "ab"[i % 2], int(i % 3 == 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "row_id long, x double, y double, c string, target int").repartition(3)
    folder = scratch_path(spark, "test-run")
    return df, folder, runs.clustering_run(df, folder, "r-1", ["x", "y"], ["c"], target="target", ks=[2, 3], n_init=3, dbscan_grid=[(0.8, 4)])


def test_the_record_states_what_the_run_did(made):
    df, _, bundle = made
    stages = {r["stage"]: r for r in bundle.stages.orderBy("step").collect()}
    assert list(stages) == ["input", "prepare", "reduce", "sweep", "best", "profile"]
    assert {r["run_id"] for r in stages.values()} == {"r-1"}
    assert all(stages[s]["rows"] == 150 for s in ("input", "prepare", "reduce", "best"))
    assert json.loads(stages["input"]["facts"])["nulls"] == {"x": 0, "y": 15, "c": 0}
    assert stages["prepare"]["columns"] == bundle.preprocessor.feature_names
    chosen = json.loads(stages["best"]["facts"])
    top = bundle.experiments.orderBy("selection_score", ascending=False).first()
    assert chosen["selection_score"] == top["selection_score"]
    methods = {r["method"] for r in bundle.experiments.collect()}
    assert {"kmeans", "gmm", "birch", "agglomerative"} <= methods and stages["sweep"]["rows"] == bundle.experiments.count()
    assert stages["profile"]["rows"] == bundle.reference.select("cluster").distinct().count() == bundle.profile.count()


def test_a_loaded_bundle_places_rows_alike(spark, made):
    df, folder, bundle = made
    before = sorted(map(str, bundle.assign(df, k=3).select("row_id", "cluster", "weight", "severity_rank", "mortality_rate").collect()))
    again = runs.Bundle.load(spark, folder)
    assert sorted(map(str, again.assign(df, k=3).select("row_id", "cluster", "weight", "severity_rank", "mortality_rate").collect())) == before
    own = {r["row_id"]: r["cluster"] for r in bundle.reference.collect()}
    assert {r["row_id"]: r["cluster"] for r in again.assign(df, k=1).collect()} == {k: c for k, c in own.items()}


def test_a_missing_part_is_named(spark, made):
    _, folder, _ = made
    local = folder.removeprefix("file:")
    other = local + "-copy"
    shutil.copytree(local, other)
    for part in runs.PARTS:
        os.rename(f"{other}/{part}", f"{other}/{part}.away")
        with pytest.raises(runs.MissingPart, match=part):
            runs.Bundle.load(spark, other)
        os.rename(f"{other}/{part}.away", f"{other}/{part}")
    assert runs.Bundle.load(spark, other).stages.count() == 6
