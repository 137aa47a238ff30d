"""Registered classifier queries.

Metric and explanation operators are checked on a deterministic score and a
deterministic additive attribution derived from the cohort (so the DuckDB
oracle is exact).  The same operators over the fitted trees read the stored
outputs of one training run, which the tests check by SQL over them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify as CF
from ..operators import features as FT
from ..sources.tables import cohort, segment_cluster, with_cohort
from .registry import query

SCORE_EXPR = "round(1.0 / (1.0 + exp(-(totalprice / 100000.0 - 1.5))), 2)"
ATTR_COLS = ["totalprice", "acctbal", "quantity_max", "price_max", "discount_max"]


def scored(spark, sf_dir):
    """Deterministic score: logistic transform of the order value, rounded to 2 decimals (ties)."""
    df = cohort(spark, sf_dir)
    p = F.round(1.0 / (1.0 + F.exp(-(F.col("totalprice") / 100000.0 - 1.5))), 2)
    return df.select("row_id", "subject_id", F.col("target").alias("true_label"), p.alias("predicted_probability"),
                     CF.predicted_label(p).alias("predicted_label"), CF.risk_band(p).alias("predicted_risk_group"),
                     segment_cluster().alias("cluster"))


def contributions(spark, sf_dir):
    """Deterministic additive attribution: standardised (population sd) measure, null -> 0."""
    df = cohort(spark, sf_dir).select("row_id", *ATTR_COLS)
    z = FT.standard_scale(df, ATTR_COLS)
    long = z.unpivot("row_id", ATTR_COLS, "feature", "value").withColumn("value", F.coalesce("value", F.lit(0.0)))
    return long.withColumn("feature", F.concat(F.lit("num__"), F.col("feature")))


_SCORED_SQL = f"""
SELECT row_id, subject_id, target AS true_label, {SCORE_EXPR} AS predicted_probability,
       CAST({SCORE_EXPR} >= 0.5 AS INTEGER) AS predicted_label,
       CASE WHEN {SCORE_EXPR} < 0.2 THEN 'low' WHEN {SCORE_EXPR} < 0.6 THEN 'medium' ELSE 'high' END AS predicted_risk_group,
       cluster
FROM cohort
"""
_CONTRIB_SQL = f"""
SELECT row_id, 'num__' || variable AS feature, coalesce((x - m) / CASE WHEN s = 0 OR s IS NULL THEN 1.0 ELSE s END, 0.0) AS value
FROM ({" UNION ALL ".join(f"SELECT row_id, '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM cohort" for c in ATTR_COLS)}) l
JOIN ({" UNION ALL ".join(f"SELECT '{c}' AS variable, avg({c}) AS m, stddev_pop({c}) AS s FROM cohort" for c in ATTR_COLS)}) g
USING (variable)
"""


def _with(body):
    return with_cohort(f", scored AS ({_SCORED_SQL}), contrib AS ({_CONTRIB_SQL})\n{body}")


SPLIT_SQL = with_cohort("""
, h AS (SELECT row_id, target, CAST(CAST(('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|42'), 1, 13)) AS BIGINT) AS DOUBLE) AS h
        FROM cohort)
SELECT row_id, target, row_number() OVER (PARTITION BY target ORDER BY h, row_id)
       <= ceil(0.2 * count(*) OVER (PARTITION BY target)) AS is_test
FROM h
""", clustered=False)


@query("ml14_stratified_split", SPLIT_SQL)
def ml14_stratified_split(spark, sf_dir):
    return CF.stratified_split(cohort(spark, sf_dir).select("row_id", "target"), "row_id", "target", 0.2, 42)


@query("prj16_risk_band", _with("SELECT row_id, predicted_probability, predicted_risk_group FROM scored"))
def prj16_risk_band(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", "predicted_probability", "predicted_risk_group")


@query("prj17_threshold_label", _with("SELECT row_id, predicted_label FROM scored"))
def prj17_threshold_label(spark, sf_dir):
    return scored(spark, sf_dir).select("row_id", "predicted_label")


AUC_SQL = _with("""
, r AS (SELECT true_label, rank() OVER (ORDER BY predicted_probability)
               + (count(*) OVER (PARTITION BY predicted_probability) - 1) / 2.0 AS rk FROM scored)
SELECT round((sum(rk) FILTER (WHERE true_label = 1) - sum(true_label) * (sum(true_label) + 1) / 2.0)
             / (sum(true_label) * (count(*) - sum(true_label))), 6) AS roc_auc FROM r
""")


@query("mt01_roc_auc", AUC_SQL)
def mt01_roc_auc(spark, sf_dir):
    return CF.roc_auc(scored(spark, sf_dir))


AP_SQL = _with("""
, c AS (SELECT predicted_probability AS p, count(*) AS n, sum(true_label) AS pos FROM scored GROUP BY 1)
, cum AS (SELECT p, pos, sum(n) OVER (ORDER BY p DESC) AS cum_n, sum(pos) OVER (ORDER BY p DESC) AS cum_pos FROM c)
SELECT round(sum(pos / (SELECT sum(true_label) FROM scored) * cum_pos / cum_n), 6) AS average_precision FROM cum WHERE pos > 0
""")


@query("mt02_average_precision", AP_SQL)
def mt02_average_precision(spark, sf_dir):
    return CF.average_precision(scored(spark, sf_dir))


@query("mt03_brier_score", _with("SELECT round(avg((predicted_probability - true_label) ** 2), 6) AS brier_score FROM scored"))
def mt03_brier_score(spark, sf_dir):
    return CF.brier(scored(spark, sf_dir))


LL_SQL = _with("""
, c AS (SELECT true_label AS y, least(greatest(predicted_probability, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS p FROM scored)
SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS log_loss FROM c
""")


@query("mt04_log_loss", LL_SQL)
def mt04_log_loss(spark, sf_dir):
    return CF.log_loss(scored(spark, sf_dir))


REPORT_SQL = _with("""
, cm AS (SELECT sum(CASE WHEN true_label = 0 AND predicted_label = 0 THEN 1 ELSE 0 END) AS c00,
                sum(CASE WHEN true_label = 0 AND predicted_label = 1 THEN 1 ELSE 0 END) AS c01,
                sum(CASE WHEN true_label = 1 AND predicted_label = 0 THEN 1 ELSE 0 END) AS c10,
                sum(CASE WHEN true_label = 1 AND predicted_label = 1 THEN 1 ELSE 0 END) AS c11 FROM scored)
, pc AS (SELECT '0' AS label, CASE WHEN c00 + c10 = 0 THEN 0.0 ELSE c00 / (c00 + c10) END AS pr,
                CASE WHEN c00 + c01 = 0 THEN 0.0 ELSE c00 / (c00 + c01) END AS re, CAST(c00 + c01 AS DOUBLE) AS sup FROM cm
         UNION ALL
         SELECT '1', CASE WHEN c11 + c01 = 0 THEN 0.0 ELSE c11 / (c11 + c01) END,
                CASE WHEN c11 + c10 = 0 THEN 0.0 ELSE c11 / (c11 + c10) END, CAST(c11 + c10 AS DOUBLE) FROM cm)
, f AS (SELECT *, CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS f1 FROM pc)
, t AS (SELECT CAST(c00 + c01 + c10 + c11 AS DOUBLE) AS tot, (c00 + c11) / (c00 + c01 + c10 + c11) AS acc FROM cm)
SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f1, 6) AS f1_score, sup AS support FROM f
UNION ALL SELECT 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), tot FROM t
UNION ALL SELECT 'macro avg', round(avg(pr), 6), round(avg(re), 6), round(avg(f1), 6), max(tot) FROM f, t
UNION ALL SELECT 'weighted avg', round(sum(pr * sup) / max(tot), 6), round(sum(re * sup) / max(tot), 6),
                 round(sum(f1 * sup) / max(tot), 6), max(tot) FROM f, t
""")


@query("mt05_classification_report", REPORT_SQL)
def mt05_classification_report(spark, sf_dir):
    return CF.classification_report(scored(spark, sf_dir))


GLOBAL_SQL = _with("""
SELECT feature, round(avg(abs(value)), 6) AS mean_abs_contribution, round(avg(value), 6) AS mean_signed_contribution
FROM contrib GROUP BY feature
""")


@query("ag34_global_importance", GLOBAL_SQL)
def ag34_global_importance(spark, sf_dir):
    return CF.global_importance(contributions(spark, sf_dir))


def _named_contrib(spark, sf_dir):
    return contributions(spark, sf_dir).withColumn("feature", CF.simplify_feature_name(F.col("feature")))


SC17_SQL = _with("SELECT DISTINCT feature AS raw_name, regexp_replace(feature, '^(num|cat)__', '') AS feature FROM contrib")


@query("sc17_simplify_feature_name", SC17_SQL)
def sc17_simplify_feature_name(spark, sf_dir):
    c = contributions(spark, sf_dir).select(F.col("feature").alias("raw_name")).distinct()
    return c.withColumn("feature", CF.simplify_feature_name(F.col("raw_name")))


TOP_SQL = _with("""
, nc AS (SELECT row_id, regexp_replace(feature, '^(num|cat)__', '') AS feature, value FROM contrib)
, pos AS (SELECT row_id, string_agg(printf('%s (%+.4f)', feature, value), ', ' ORDER BY value DESC, feature DESC) AS s
          FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value DESC, feature DESC) AS r FROM nc WHERE value > 0)
          WHERE r <= 3 GROUP BY row_id)
, neg AS (SELECT row_id, string_agg(printf('%s (%+.4f)', feature, value), ', ' ORDER BY value, feature) AS s
          FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY value, feature) AS r FROM nc WHERE value < 0)
          WHERE r <= 3 GROUP BY row_id)
SELECT ids.row_id, coalesce(pos.s, 'none') AS top_positive_features, coalesce(neg.s, 'none') AS top_negative_features
FROM (SELECT DISTINCT row_id FROM nc) ids LEFT JOIN pos USING (row_id) LEFT JOIN neg USING (row_id)
""")


@query("wn06_top_features", TOP_SQL)
def wn06_top_features(spark, sf_dir):
    return CF.top_features(_named_contrib(spark, sf_dir), "row_id", 3)


CLUSTER_EXPL_SQL = _with("""
, s AS (SELECT *, 'cluster_' || cluster AS cluster_label, NULL::INTEGER AS severity_rank FROM scored WHERE cluster IS NOT NULL)
, h AS (SELECT cluster_label, min(cluster) AS cluster, CAST(count(*) AS BIGINT) AS n_patients_test,
               round(avg(true_label), 6) AS observed_mortality_test, round(avg(predicted_probability), 6) AS mean_predicted_probability
        FROM s GROUP BY cluster_label)
, imp AS (SELECT cluster_label, regexp_replace(feature, '^(num|cat)__', '') AS feature, avg(abs(value)) AS m
          FROM contrib JOIN s USING (row_id) GROUP BY ALL)
, top AS (SELECT cluster_label, string_agg(printf('%s (%.4f)', feature, m), ', ' ORDER BY m DESC, feature) AS t
          FROM (SELECT *, row_number() OVER (PARTITION BY cluster_label ORDER BY m DESC, feature) AS r FROM imp) WHERE r <= 3
          GROUP BY cluster_label)
SELECT h.cluster_label, h.cluster, NULL::INTEGER AS severity_rank, n_patients_test, observed_mortality_test,
       mean_predicted_probability, t AS top_explanatory_features
FROM h LEFT JOIN top USING (cluster_label)
""")


@query("ag35_cluster_explanations", CLUSTER_EXPL_SQL)
def ag35_cluster_explanations(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("cluster_label", F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))) \
        .withColumn("severity_rank", F.lit(None).cast("int"))
    return CF.cluster_explanations(s, _named_contrib(spark, sf_dir), "row_id", 3).select(
        "cluster_label", "cluster", "severity_rank", "n_patients_test", "observed_mortality_test",
        "mean_predicted_probability", "top_explanatory_features")


def explanation_rows(spark, sf_dir):
    s = scored(spark, sf_dir).withColumn("cluster_label", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    tops = CF.top_features(_named_contrib(spark, sf_dir), "row_id", 3)
    return s.join(tops, "row_id", "left")


_TOPS_ONLY = TOP_SQL[TOP_SQL.index(", nc AS"):]
SUMMARY_SQL = with_cohort(f"""
, scored AS ({_SCORED_SQL}), contrib AS ({_CONTRIB_SQL})
{_TOPS_ONLY.replace("SELECT ids.row_id", ", tops AS (SELECT ids.row_id", 1)})
SELECT s.row_id, printf('Predicted mortality risk: %.3f (%s).', predicted_probability, predicted_risk_group)
       || CASE WHEN cluster IS NULL THEN '' ELSE ' Clinical severity cluster: cluster_' || cluster || '.' END
       || ' Main factors increasing risk: ' || top_positive_features || '.'
       || ' Main factors decreasing risk: ' || top_negative_features || '.'
       || ' Use this together with the sepsis knowledge base to propose monitoring or treatment actions.' AS llm_summary
FROM scored s JOIN tops USING (row_id)
""")


@query("sc18_summary_sentence", SUMMARY_SQL)
def sc18_summary_sentence(spark, sf_dir):
    e = explanation_rows(spark, sf_dir).withColumn("cluster_label", F.when(F.col("cluster").isNotNull(), F.col("cluster_label")))
    e = e.withColumn("severity_rank", F.lit(None).cast("int"))
    return e.select("row_id", CF.summary_sentence(e).alias("llm_summary"))


PRJ13_SQL = with_cohort(f"""
, scored AS ({_SCORED_SQL}), contrib AS ({_CONTRIB_SQL})
{_TOPS_ONLY.replace("SELECT ids.row_id", ", tops AS (SELECT ids.row_id", 1)})
SELECT row_id, subject_id, predicted_probability, predicted_risk_group, true_label, cluster,
       'cluster_' || cluster AS cluster_label, top_positive_features, top_negative_features
FROM scored JOIN tops USING (row_id)
""")


@query("prj13_ordered_projection", PRJ13_SQL)
def prj13_ordered_projection(spark, sf_dir):
    return CF.ordered_projection(explanation_rows(spark, sf_dir))


JN04_SQL = _with("""
SELECT s.row_id, s.predicted_probability, a.cluster, 'cluster_' || a.cluster AS cluster_label
FROM scored s LEFT JOIN (SELECT row_id, cluster FROM cohort WHERE acctbal >= 0) a USING (row_id)
""")


@query("jn04_scored_cluster_context", JN04_SQL)
def jn04_scored_cluster_context(spark, sf_dir):
    """Scored rows left-joined with a clustering context that covers only part of them
    (customers with a non-negative balance); context is never a feature."""
    ctx = cohort(spark, sf_dir).where("acctbal >= 0").select("row_id", segment_cluster().alias("cluster")) \
        .withColumn("cluster_label", F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return scored(spark, sf_dir).select("row_id", "predicted_probability").join(ctx, "row_id", "left")


JN05_SQL = _with("""
SELECT t.row_id, t.true_label, d.subject_id
FROM scored t LEFT JOIN (SELECT DISTINCT row_id, subject_id FROM scored) d USING (row_id)
""")


@query("jn05_dedup_left_join", JN05_SQL)
def jn05_dedup_left_join(spark, sf_dir):
    s = scored(spark, sf_dir)
    right = s.unionByName(s).select("row_id", "subject_id").dropDuplicates()  # duplicated input, deduplicated projection
    return s.select("row_id", "true_label").join(right, "row_id", "left")


NUMS = ["totalprice", "acctbal", "quantity_min", "quantity_max", "price_max", "discount_max", "tax_max"]
CATS = ["cat_priority", "cat_region"]
TREES = 300
_RUNS: dict[tuple, str] = {}


def risk_run(spark, sf_dir):
    """The training run over the whole cohort.  Its outputs are stored once per session and input, and every query below
    reads them.  The segment clusters with their severity are its context."""
    from ..operators import profile as PR
    from ..operators import runs
    from ..sources.ingest import scratch_path
    from ..sources.tables import _fingerprint
    mark = (id(spark.sparkContext), _fingerprint(spark, sf_dir, ["orders", "customer", "nation", "lineitem"]))
    if mark not in _RUNS:
        c = cohort(spark, sf_dir).withColumn("cluster", segment_cluster())
        summary = PR.cluster_summary(c.select("cluster", "target"), "cluster", "target").select("cluster", "cluster_label", "severity_rank")
        context = c.select("row_id", "cluster").join(F.broadcast(summary), "cluster")  # one row per segment
        folder = scratch_path(spark, "training-run")
        runs.training_run(c, folder, "cohort-risk", NUMS, CATS, "target", context=context, max_iter=TREES)
        _RUNS[mark] = folder
    return runs.Classifier.load(spark, _RUNS[mark])


@query("ml15_gbt_scored_test_rows")
def ml15_gbt_scored_test_rows(spark, sf_dir):
    """Trees fitted on the stratified train split (class-weighted) score the test split."""
    return risk_run(spark, sf_dir).scored.select("row_id", "true_label", "predicted_probability", "predicted_label", "predicted_risk_group")


RUN_ROWS_SQL = with_cohort(f"""
, split AS ({SPLIT_SQL[SPLIT_SQL.rindex("SELECT row_id, target, row_number()"):].replace("FROM h", "FROM hashed")})
, rates AS (SELECT cluster, row_number() OVER (ORDER BY avg(target) DESC, cluster) AS severity_rank FROM cohort GROUP BY cluster)
SELECT row_id, CAST(s.target AS INTEGER) AS true_label, CAST(cluster AS INTEGER) AS cluster, 'cluster_' || cluster AS cluster_label,
       CAST(severity_rank AS INTEGER) AS severity_rank
FROM split s JOIN cohort USING (row_id) JOIN rates USING (cluster) WHERE is_test
""").replace(", split AS", """, hashed AS (SELECT row_id, target, CAST(CAST(('0x' || substr(md5(CAST(row_id AS VARCHAR) || '|42'), 1, 13)) AS BIGINT) AS DOUBLE) AS h
        FROM cohort)
, split AS""", 1)


@query("ml15_run_test_rows", RUN_ROWS_SQL)
def ml15_run_test_rows(spark, sf_dir):
    """The rows that the run scored, with their labels and cluster context."""
    return risk_run(spark, sf_dir).scored.select("row_id", "true_label", "cluster", "cluster_label", "severity_rank")


RUN_CLUSTERS_SQL = f"""
SELECT cluster_label, cluster, severity_rank, count(*) AS n_patients_test, round(avg(true_label), 6) AS observed_mortality_test
FROM ({RUN_ROWS_SQL}) t GROUP BY ALL
"""


@query("ag35_run_cluster_rates", RUN_CLUSTERS_SQL)
def ag35_run_cluster_rates(spark, sf_dir):
    """Test rows and their observed rate per cluster, from the run's stored cluster explanations."""
    return risk_run(spark, sf_dir).clusters.select("cluster_label", "cluster", "severity_rank", "n_patients_test",
                                                   F.round("observed_mortality_test", 6).alias("observed_mortality_test"))


@query("ag35_run_cluster_explanations")
def ag35_run_cluster_explanations(spark, sf_dir):
    """Mean probability and top features of the fitted model per cluster."""
    return risk_run(spark, sf_dir).clusters


@query("mt01_run_metrics")
def mt01_run_metrics(spark, sf_dir):
    """MT-01 to MT-04 of the fitted model on the test rows."""
    return risk_run(spark, sf_dir).metrics


@query("mt05_run_report")
def mt05_run_report(spark, sf_dir):
    """MT-05 of the fitted model on the test rows."""
    return risk_run(spark, sf_dir).report


@query("ag34_run_importance")
def ag34_run_importance(spark, sf_dir):
    """AG-34 over the fitted model's contributions."""
    return risk_run(spark, sf_dir).importance


@query("sc18_run_cases")
def sc18_run_cases(spark, sf_dir):
    """WN-06, SC-18 and PRJ-13 over the fitted model: one explained row per test row."""
    return risk_run(spark, sf_dir).cases


@query("src11_training_stages")
def src11_training_stages(spark, sf_dir):
    """What the training run read, wrote and found, step by step."""
    return risk_run(spark, sf_dir).stages


@query("ml17_tree_contributions")
def ml17_tree_contributions(spark, sf_dir):
    """Per-row contributions of the fitted trees on the test split (the additivity invariant is checked in tests)."""
    return risk_run(spark, sf_dir).contributions


@query("ml16_score_rows")
def ml16_score_rows(spark, sf_dir):
    """The fitted model scores every cohort row: probability, label, risk band (rows-only)."""
    run = risk_run(spark, sf_dir)
    x = CF.to_features(run.preprocessor.transform(cohort(spark, sf_dir), ["row_id"]))
    return CF.score(run.model, x, ["row_id"])
