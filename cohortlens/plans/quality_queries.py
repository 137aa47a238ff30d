"""Registered data-quality / EDA queries on the stand-in cohort."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..sources.tables import COHORT_CATEGORICAL, cohort, with_cohort
from .registry import query, union_sql

MEASURES = ["totalprice", "acctbal", "quantity_min", "quantity_max", "price_min", "price_max",
            "discount_max", "tax_max"]
_LONG = union_sql(MEASURES)

IQR_SQL = with_cohort(f"""
, long AS ({_LONG})
, q AS (SELECT variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3
        FROM long WHERE x IS NOT NULL GROUP BY variable)
, f AS (SELECT variable, q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT f.variable, 'IQR' AS method, round(q1, 6) AS q1, round(q3, 6) AS q3, round(iqr, 6) AS iqr,
       round(lo, 6) AS lower_fence, round(hi, 6) AS upper_fence,
       CAST(count(*) FILTER (WHERE x < lo OR x > hi) AS BIGINT) AS n_outliers,
       round(count(*) FILTER (WHERE x < lo OR x > hi) * 100.0 / count(*), 6) AS pct_outliers
FROM f JOIN long USING (variable)
GROUP BY f.variable, q1, q3, iqr, lo, hi
""", clustered=False)


@query("ag12_iqr_outliers", IQR_SQL)
def ag12_iqr_outliers(spark, sf_dir):
    """IQR outlier report over all cohort measures (the minimum slice)."""
    return Q.iqr_outliers(cohort(spark, sf_dir), MEASURES)


ZSCORE_SQL = with_cohort(f"""
, long AS ({_LONG})
, s AS (SELECT variable, avg(x) AS m, stddev_samp(x) AS sd FROM long GROUP BY variable)
SELECT s.variable, 'zscore' AS method, round(m, 6) AS mean, round(sd, 6) AS sd, 3.0::DOUBLE AS threshold,
       CAST(count(*) FILTER (WHERE abs((x - m) / sd) > 3.0) AS BIGINT) AS n_outliers,
       round(count(*) FILTER (WHERE abs((x - m) / sd) > 3.0) * 100.0 / count(*), 6) AS pct_outliers
FROM s JOIN long USING (variable)
WHERE sd IS NOT NULL AND sd <> 0
GROUP BY s.variable, m, sd
""", clustered=False)


@query("ag13_zscore_outliers", ZSCORE_SQL)
def ag13_zscore_outliers(spark, sf_dir):
    return Q.zscore_outliers(cohort(spark, sf_dir), MEASURES, 3.0)


TOP_SQL = f"SELECT * FROM ({IQR_SQL}) t ORDER BY n_outliers DESC, variable LIMIT 6"


@query("ag14_top_outlier_variables", TOP_SQL)
def ag14_top_outlier_variables(spark, sf_dir):
    return Q.top_outlier_variables(Q.iqr_outliers(cohort(spark, sf_dir), MEASURES), 6)


ALL_COLS = ["row_id", "subject_id", "cat_priority", "cat_segment", "cat_region", "totalprice", "acctbal",
            "quantity_min", "quantity_max", "price_min", "price_max", "discount_max", "tax_max", "has_return",
            "constant_col", "leakage_last_ship", "target"]

NULLS_SQL = with_cohort("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, CAST(count(*) FILTER (WHERE {c} IS NULL) AS BIGINT) AS n_missing, "
    f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_rate FROM cohort" for c in ALL_COLS),
    clustered=False)


@query("ag08_null_rates", NULLS_SQL)
def ag08_null_rates(spark, sf_dir):
    return Q.null_rates(cohort(spark, sf_dir))


@query("pre05_missing_analysis", NULLS_SQL)
def pre05_missing_analysis(spark, sf_dir):
    """PRE-05 is AG-08 applied to the raw table."""
    return Q.null_rates(cohort(spark, sf_dir))


CAT_SQL = with_cohort(f"""
, long AS ({union_sql(COHORT_CATEGORICAL, value_type='VARCHAR')})
SELECT variable, coalesce(x, 'nan') AS value, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY 1, 2
""", clustered=False)


@query("ag07_category_counts", CAT_SQL)
def ag07_category_counts(spark, sf_dir):
    return Q.category_counts(cohort(spark, sf_dir), COHORT_CATEGORICAL)


@query("pre03_categorical_analysis", CAT_SQL)
def pre03_categorical_analysis(spark, sf_dir):
    return Q.category_counts(cohort(spark, sf_dir), COHORT_CATEGORICAL)


RATE_SQL = with_cohort("""
SELECT coalesce(CAST(cat_priority AS VARCHAR), 'Missing') AS category, CAST(count(*) AS BIGINT) AS n,
       round(avg(target), 6) AS outcome_rate
FROM cohort GROUP BY 1
""", clustered=False)


@query("ag06_outcome_rate_by_category", RATE_SQL)
def ag06_outcome_rate_by_category(spark, sf_dir):
    return Q.outcome_rate_by_category(cohort(spark, sf_dir), "cat_priority", "target")


# pre/post comparison: "post" = cohort after PRE-07 (negatives -> null) and PRE-08 (dates dropped)
MISSCMP_SQL = with_cohort(f"""
, post AS (SELECT * EXCLUDE (leakage_last_ship) REPLACE (CASE WHEN acctbal < 0 THEN NULL ELSE acctbal END AS acctbal) FROM cohort)
, a AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS k, count(*) AS n FROM cohort" for c in ALL_COLS)})
, b AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, count(*) FILTER (WHERE {c} IS NULL) AS k, count(*) AS n FROM post" for c in ALL_COLS if c != 'leakage_last_ship')})
SELECT coalesce(a.variable, b.variable) AS variable, CAST(a.k AS BIGINT) AS missing_pre, round(a.k / a.n, 6) AS rate_pre,
       CAST(b.k AS BIGINT) AS missing_post, round(b.k / b.n, 6) AS rate_post,
       a.k IS NOT NULL AS in_pre, b.k IS NOT NULL AS in_post, CAST(a.k - b.k AS BIGINT) AS missing_diff
FROM a FULL JOIN b ON a.variable = b.variable
""", clustered=False)


@query("jn09_missing_comparison", MISSCMP_SQL)
def jn09_missing_comparison(spark, sf_dir):
    raw = cohort(spark, sf_dir)
    post = Q.drop_date_columns(Q.negatives_to_null(raw, ["acctbal"]))
    return Q.missing_comparison(raw, post)


TOTAL_MISSING_SQL = f"""
SELECT CAST(sum(missing_pre) AS BIGINT) AS total_missing_pre, CAST(sum(missing_post) AS BIGINT) AS total_missing_post,
       CAST(sum(missing_diff) AS BIGINT) AS total_missing_diff
FROM ({MISSCMP_SQL}) m
"""


@query("ag09_total_missing", TOTAL_MISSING_SQL)
def ag09_total_missing(spark, sf_dir):
    cmp = jn09_missing_comparison(spark, sf_dir)
    return cmp.agg(F.sum("missing_pre").cast("bigint").alias("total_missing_pre"),
                   F.sum("missing_post").cast("bigint").alias("total_missing_post"),
                   F.sum("missing_diff").cast("bigint").alias("total_missing_diff"))


OVERVIEW_SQL = with_cohort("""
SELECT 'raw' AS dataset, CAST(count(*) AS BIGINT) AS n_rows, 17 AS n_columns, round(avg(target), 6) AS target_mean FROM cohort
UNION ALL
SELECT 'complete' AS dataset, CAST(count(*) AS BIGINT), 17, round(avg(target), 6) FROM cohort WHERE quantity_min IS NOT NULL
""", clustered=False)


@query("ag10_overview", OVERVIEW_SQL)
def ag10_overview(spark, sf_dir):
    raw = cohort(spark, sf_dir)
    return Q.overview(raw, "target", "raw").unionByName(
        Q.overview(raw.where(F.col("quantity_min").isNotNull()), "target", "complete"))


BOX_SQL = with_cohort(f"""
, long AS ({union_sql(['totalprice', 'quantity_max', 'price_max'], extra='target')})
, q AS (SELECT target, variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.75) AS q3
        FROM long WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT q.target, q.variable, round(q1, 6) AS q1, round(med, 6) AS median, round(q3, 6) AS q3,
       round(min(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
       round(max(x) FILTER (WHERE x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
       CAST(count(*) FILTER (WHERE NOT (x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_fliers,
       CAST(count(*) AS BIGINT) AS n
FROM q JOIN long ON long.target = q.target AND long.variable = q.variable AND long.x IS NOT NULL
GROUP BY q.target, q.variable, q1, med, q3
""", clustered=False)


@query("ag15_boxplot_stats", BOX_SQL)
def ag15_boxplot_stats(spark, sf_dir):
    return Q.boxplot_stats(cohort(spark, sf_dir), ["totalprice", "quantity_max", "price_max"], by="target")


HIST_SQL = with_cohort(f"""
, long AS ({union_sql(['totalprice', 'quantity_max'])})
, e AS (SELECT variable, min(x) AS lo, max(x) AS hi FROM long GROUP BY variable)
, b AS (SELECT long.variable, lo, CASE WHEN hi > lo THEN (hi - lo) / 20 ELSE 1.0 END AS w, x FROM long JOIN e USING (variable)
        WHERE x IS NOT NULL)
, c AS (SELECT variable, lo, w, CAST(least(floor((x - lo) / w), 19) AS INT) AS bin FROM b)
SELECT variable, bin, round(lo + bin * w, 6) AS bin_start, round(lo + (bin + 1) * w, 6) AS bin_end, CAST(count(*) AS BIGINT) AS n
FROM c GROUP BY variable, bin, lo, w
""", clustered=False)


@query("ag16_histogram", HIST_SQL)
def ag16_histogram(spark, sf_dir):
    return Q.histogram(cohort(spark, sf_dir), ["totalprice", "quantity_max"], bins=20)


def _kde_sql(src, expr):
    return f"""
SELECT '{src}' AS source, g AS grid_index, gx AS x, sum(k) / max(n) AS density FROM (
  SELECT g, gx, n, exp(-0.5 * ((gx - x) / h) ** 2) / (h * sqrt(2 * pi())) AS k FROM (
    SELECT v.x, n, h, g.g, lo - 3 * h + g.g * (hi - lo + 6 * h) / 63 AS gx FROM
      (SELECT {expr} AS x FROM cohort) v,
      (SELECT count(x) AS n, stddev_samp(x) * pow(count(x), -0.2) AS h, min(x) AS lo, max(x) AS hi
       FROM (SELECT {expr} AS x FROM cohort) q) s, range(64) g(g)
    WHERE v.x IS NOT NULL))
GROUP BY g, gx"""


KDE_SQL = with_cohort("\nUNION ALL\n".join(
    [_kde_sql("pre", "acctbal"), _kde_sql("post", "CASE WHEN acctbal < 0 THEN NULL ELSE acctbal END")]), clustered=False)
KDE_SQL = f"SELECT source, CAST(grid_index AS INTEGER) AS grid_index, round(x, 6) AS x, round(density, 6) AS density FROM ({KDE_SQL})"


@query("ag17_kde_pre_post", KDE_SQL)
def ag17_kde_pre_post(spark, sf_dir):
    """Density of a measure before and after PRE-07 on a 64-point grid."""
    raw = cohort(spark, sf_dir)
    post = Q.negatives_to_null(raw, ["acctbal"])
    return Q.union_tagged({"pre": Q.kde_grid(raw, "acctbal"), "post": Q.kde_grid(post, "acctbal")})


PRE02_SQL = with_cohort("""
, top AS (SELECT cat_priority AS v FROM cohort WHERE cat_priority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
SELECT CASE WHEN cat_priority IS NULL THEN NULL WHEN cat_priority IN (SELECT v FROM top) THEN cat_priority ELSE 'other' END AS cat_priority,
       CAST(count(*) AS BIGINT) AS n
FROM cohort GROUP BY 1
""", clustered=False)


@query("pre02_group_rare_categories", PRE02_SQL)
def pre02_group_rare_categories(spark, sf_dir):
    df = Q.group_rare_categories(cohort(spark, sf_dir), "cat_priority", top_n=3)
    return df.groupBy("cat_priority").agg(F.count(F.lit(1)).alias("n"))


PRE04_SQL = with_cohort(f"""
, long AS ({union_sql(COHORT_CATEGORICAL, value_type='VARCHAR')})
, c AS (SELECT variable, x AS value, count(*) AS n FROM long WHERE x IS NOT NULL GROUP BY 1, 2)
SELECT variable, value, CAST(n AS BIGINT) AS n,
       CAST(row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) - 1 AS INT) AS code
FROM c
""", clustered=False)


@query("pre04_frequency_codes", PRE04_SQL)
def pre04_frequency_codes(spark, sf_dir):
    return Q.frequency_codes(cohort(spark, sf_dir), COHORT_CATEGORICAL)


PRE06_SQL = with_cohort("\nUNION ALL\n".join(
    f"SELECT '{c}' AS variable, round(count(*) FILTER (WHERE {c} IS NULL) / count(*), 6) AS missing_rate, "
    f"count(*) FILTER (WHERE {c} IS NULL) / count(*) > 0.01 AS dropped FROM cohort" for c in ALL_COLS),
    clustered=False)


@query("pre06_drop_sparse_columns", PRE06_SQL)
def pre06_drop_sparse_columns(spark, sf_dir):
    """Columns above 1% nulls are dropped; the report shows every decision."""
    return Q.sparse_column_report(cohort(spark, sf_dir), 0.01)


PRE07_SQL = with_cohort("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(count(CASE WHEN acctbal < 0 THEN NULL ELSE acctbal END) AS BIGINT) AS n_acctbal,
       round(min(CASE WHEN acctbal < 0 THEN NULL ELSE acctbal END), 6) AS min_acctbal
FROM cohort
""", clustered=False)


@query("pre07_negatives_to_null", PRE07_SQL)
def pre07_negatives_to_null(spark, sf_dir):
    df = Q.negatives_to_null(cohort(spark, sf_dir), ["acctbal"])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count("acctbal").alias("n_acctbal"), F.min("acctbal").alias("min_acctbal"))


PRE08_SQL = with_cohort("""
SELECT * EXCLUDE (leakage_last_ship) FROM cohort
""", clustered=False)


@query("pre08_drop_date_columns", PRE08_SQL)
def pre08_drop_date_columns(spark, sf_dir):
    return Q.drop_date_columns(cohort(spark, sf_dir))
