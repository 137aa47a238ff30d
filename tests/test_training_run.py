"""A training run, its stored outputs and the contexts of new rows."""

from __future__ import annotations

import json
import os
import shutil

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import runs
from cohortlens.sources.ingest import scratch_path


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=240), rng.normal(size=240)
    hit = (x + 0.4 * y + rng.normal(scale=0.4, size=240) > 0.3).astype(int)
    rows = [(i, 1000 + i // 2, float(x[i]), float(y[i]) if i % 9 else None, "ab"[i % 2], int(hit[i]) if i else None) for i in range(240)]
    df = spark.createDataFrame(rows, "row_id long, subject_id long, x double, y double, c string, target int").repartition(3)
    context = spark.createDataFrame([(i, i % 3, f"cluster_{i % 3}", 1 + i % 3) for i in range(0, 240, 2) for _ in (0, 1)],
                                    "row_id long, cluster int, cluster_label string, severity_rank int")
    folder = scratch_path(spark, "test-training")
    return df, folder, runs.training_run(df, folder, "t-1", ["x", "y"], ["c"], "target", context=context, max_iter=12, max_depth=3)


def test_the_record_states_what_the_run_did(made):
    df, _, fitted = made
    stages = {r["stage"]: r for r in fitted.stages.orderBy("step").collect()}
    assert list(stages) == ["split", "prepare", "fit", "score", "evaluate", "contributions", "cases", "clusters"]
    split, fit = json.loads(stages["split"]["facts"]), json.loads(stages["fit"]["facts"])
    assert stages["split"]["rows"] == 239 == split["train"] + split["test"] and split["nulls"]["y"] == 26
    assert fit["trees"] == 12 and stages["fit"]["rows"] == split["train"]
    assert stages["score"]["rows"] == split["test"] == fitted.scored.count() == fitted.cases.count()
    assert stages["contributions"]["rows"] == split["test"] * (len(fitted.preprocessor.feature_names) + 1)
    assert json.loads(stages["evaluate"]["facts"]) == {r["metric"]: r["value"] for r in fitted.metrics.collect()}


def test_stored_metrics_equal_sql_over_the_stored_scores(made):
    _, folder, fitted = made
    at = folder.removeprefix("file:")
    con = duckdb.connect()
    for name in ("scored", "contributions", "cases", "clusters", "importance", "report"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}/{name}/*.parquet')")
    got = {r["metric"]: r["value"] for r in fitted.metrics.collect()}
    auc, brier, loss = con.execute("""
        SELECT (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0.0 END)
                FROM (SELECT predicted_probability AS p FROM scored WHERE true_label = 1) a, (SELECT predicted_probability AS p FROM scored WHERE true_label = 0) b),
               avg((predicted_probability - true_label) ** 2),
               avg(-ln(CASE WHEN true_label = 1 THEN predicted_probability ELSE 1 - predicted_probability END)) FROM scored""").fetchone()
    assert got["roc_auc"] == pytest.approx(auc) and got["brier_score"] == pytest.approx(brier) and got["log_loss"] == pytest.approx(loss)
    precision = con.execute("""
        WITH t AS (SELECT predicted_probability AS p, count(*) AS n, sum(true_label) AS pos FROM scored GROUP BY p),
             c AS (SELECT pos, sum(n) OVER w AS cn, sum(pos) OVER w AS cp FROM t WINDOW w AS (ORDER BY p DESC))
        SELECT sum(pos * cp / cn) / sum(pos) FROM c""").fetchone()[0]
    assert got["average_precision"] == pytest.approx(precision) and 0.8 < auc <= 1
    right = con.execute("SELECT avg(CAST((predicted_probability >= 0.5) = (true_label = 1) AS INT)) FROM scored").fetchone()[0]
    assert con.execute("SELECT f1_score FROM report WHERE label = 'accuracy'").fetchone()[0] == pytest.approx(right)
    worst = con.execute("""SELECT max(abs(v - ln(predicted_probability / (1 - predicted_probability)))) FROM scored
                           JOIN (SELECT row_id, sum(value) AS v FROM contributions GROUP BY row_id) USING (row_id)""").fetchone()[0]
    assert worst < 1e-9
    want = con.execute("SELECT replace(replace(feature, 'num__', ''), 'cat__', '') AS f, avg(abs(value)) FROM contributions WHERE feature <> 'bias' GROUP BY f").fetchall()
    assert dict(con.execute("SELECT feature, mean_abs_contribution FROM importance").fetchall()) == pytest.approx(dict(want))
    sizes = dict(con.execute("SELECT cluster_label, count(*) FROM scored WHERE cluster_label IS NOT NULL GROUP BY 1").fetchall())
    assert dict(con.execute("SELECT cluster_label, n_patients_test FROM clusters").fetchall()) == sizes and sum(sizes.values()) < fitted.scored.count()
    assert con.execute("SELECT count(*) FROM cases WHERE (cluster IS NULL) <> (llm_summary NOT LIKE '%severity cluster%')").fetchone()[0] == 0


def test_a_loaded_classifier_answers_alike(spark, made):
    df, folder, fitted = made
    again = runs.Classifier.load(spark, folder)
    test = df.join(fitted.scored.select("row_id"), "row_id")
    got = {r["row_id"]: r for r in again.explain(test).collect()}
    for r in fitted.cases.collect():
        assert got[r["row_id"]]["predicted_probability"] == pytest.approx(r["predicted_probability"])
        assert got[r["row_id"]]["top_positive_features"] == r["top_positive_features"]
    assert again.explain(df.limit(0)).collect() == []


def test_missing_parts_and_classes_are_named(spark, made):
    df, folder, _ = made
    other = folder.removeprefix("file:") + "-copy"
    shutil.copytree(folder.removeprefix("file:"), other)
    for part in runs.CLASSIFIER_PARTS:
        os.rename(f"{other}/{part}", f"{other}/{part}.away")
        with pytest.raises(runs.MissingPart, match=part):
            runs.Classifier.load(spark, other)
        os.rename(f"{other}/{part}.away", f"{other}/{part}")
    with pytest.raises(ValueError, match="both classes"):
        runs.training_run(df.filter("target = 1"), other + "-one", "t-2", ["x"], [], "target", max_iter=2)


def test_case_contexts(spark, made):
    df, _, fitted = made
    clusters = runs.clustering_run(df, scratch_path(spark, "test-context"), "c-1", ["x", "y"], ["c"], target="target", ks=[2, 3], n_init=2,
                                   dbscan_grid=[(0.8, 4)])
    new = df.filter("row_id % 20 = 1")
    rows = runs.case_contexts(new, fitted, clusters, ["row_id", "subject_id"], ["x", "y"], k=5).collect()
    assert sorted(r["row_id"] for r in rows) == list(range(1, 240, 20))
    sizes = {r["cluster_label"]: r for r in clusters.profile.collect()}
    for r in rows:
        c = json.loads(r["prompt_json"])
        assert c["patient_identifiers"] == {"row_id": str(r["row_id"]), "subject_id": str(r["subject_id"])}
        assert c["patient_features"] == {k: v for k, v in (("x", r["x"]), ("y", r["y"])) if v is not None}
        assert c["model_outputs"]["predicted_probability"] == r["predicted_probability"] and c["model_outputs"]["top_positive_features"]
        a = c["cluster_assignment"]
        votes = a["neighbor_cluster_vote"]
        assert a["neighbors_used"] == 5 and votes[0]["cluster"] == a["cluster"] and [v["weight"] for v in votes] == sorted((v["weight"] for v in votes), reverse=True)
        assert a["severity_rank"] == sizes[a["cluster_label"]]["severity_rank"]
    assert runs.case_contexts(new.limit(0), fitted, clusters, ["row_id"], ["x"], k=5).filter(F.col("prompt_json").isNotNull()).collect() == []
