"""Registered queries for the per-cluster profile table and its pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import profile_tables as PT
from ..sources.tables import clustered_cohort, with_cohort
from .profile_queries import (ATLP_SQL, BINARY, CATEGORICAL, NUMERIC, PROFILE_NUMS, PROFILES_SQL, SUMMARY_MEANS,
                              SUMMARY_SQL_BODY, atlp, summary)
from .registry import query

# Stand-in feature families for the stand-in cohort's measures.
STANDIN_FAMILIES = {
    "severity": ["totalprice", "price_max"],
    "renal_metabolic": ["quantity_min", "quantity_max"],
    "hemodynamic": ["discount_max", "tax_max"],
    "neurologic": ["acctbal"],
}


def profiles(spark, sf_dir):
    return P.cluster_profiles(clustered_cohort(spark, sf_dir, True), PROFILE_NUMS, "cluster", 3)


LISTS_SQL = f"""
SELECT cluster, direction, string_agg(printf('%s (%+.3f)', variable, delta_vs_global), ', ' ORDER BY position) AS rendered
FROM ({PROFILES_SQL}) p GROUP BY cluster, direction
"""


@query("wn05_top_feature_lists", LISTS_SQL)
def wn05_top_feature_lists(spark, sf_dir):
    return PT.top_feature_lists(profiles(spark, sf_dir), 3).select("cluster", "direction", "rendered")


def _fam_values():
    return "(VALUES " + ", ".join(f"('{f}', '{v}', {2 if f == 'frailty' else 1})" for f, vs in STANDIN_FAMILIES.items()
                                  for v in vs) + ") AS fam(family, variable, weight)"


VOTES_SQL = f"""
SELECT cluster, family, CAST(sum(weight) AS BIGINT) AS votes
FROM ({PROFILES_SQL}) p JOIN {_fam_values()} USING (variable)
WHERE direction = 'high' GROUP BY cluster, family
"""


@query("ag39_family_votes", VOTES_SQL)
def ag39_family_votes(spark, sf_dir):
    lists = PT.top_feature_lists(profiles(spark, sf_dir), 3).where("direction = 'high'")
    return PT.family_votes_table(lists, PT.families_frame(spark, STANDIN_FAMILIES))


def _v(fam):
    members = ", ".join(f"'{m}'" for m in STANDIN_FAMILIES.get(fam, [])) or "NULL"
    return f"count(*) FILTER (WHERE direction = 'high' AND variable IN ({members}))"


_SUMMARY_ONLY = with_cohort(SUMMARY_SQL_BODY, noise=True)
PROFILE_TABLE_SQL = f"""
WITH summ AS ({_SUMMARY_ONLY}),
prof AS ({PROFILES_SQL}),
votes AS (SELECT cluster, {_v('renal_metabolic')} AS renal, {_v('neurologic')} AS neuro, {_v('inflammatory')} AS inflam,
                 {_v('hemodynamic')} AS hemo, {_v('severity')} AS sev FROM prof GROUP BY cluster),
lists AS (SELECT cluster, direction, string_agg(printf('%s (%+.3f)', variable, delta_vs_global), ', ' ORDER BY position) AS rendered
          FROM prof GROUP BY cluster, direction)
SELECT s.cluster, s.cluster_label,
       CASE WHEN coalesce(v.renal, 0) >= 2 AND coalesce(v.sev, 0) >= 1 THEN 'renal_metabolic_high_severity'
            WHEN coalesce(v.neuro, 0) >= 1 AND coalesce(v.inflam, 0) >= 1 AND coalesce(v.sev, 0) >= 1
                 AND s.severity_rank IN (1, 2) THEN 'neurologic_inflammatory_high_severity'
            WHEN coalesce(v.hemo, 0) >= 2 AND coalesce(v.sev, 0) >= 1 THEN 'hemodynamic_instability'
            WHEN s.severity_rank >= 5 THEN 'stable_low_severity'
            WHEN coalesce(v.sev, 0) >= 2 THEN 'moderate_to_high_severity'
            WHEN s.severity_rank >= 4 THEN 'mixed_lower_severity'
            ELSE 'mixed_intermediate' END AS phenotype_name,
       s.severity_rank, s.n_patients, s.size_pct,
       coalesce(h.rendered, 'none') AS top_high_features, coalesce(l.rendered, 'none') AS top_low_features,
       concat_ws(', ', {", ".join(f"printf('{c}=%.2f', mean_{c})" for c in SUMMARY_MEANS)}) AS clinical_snapshot,
       s.mortality_rate AS clustering_mortality_rate
FROM summ s LEFT JOIN votes v ON v.cluster = s.cluster
LEFT JOIN lists h ON h.cluster = s.cluster AND h.direction = 'high'
LEFT JOIN lists l ON l.cluster = s.cluster AND l.direction = 'low'
"""


def profile_table(spark, sf_dir):
    return PT.profile_table(summary(spark, sf_dir, noise=True), profiles(spark, sf_dir), 3,
                            families=STANDIN_FAMILIES, snapshot=SUMMARY_MEANS)


@query("sc12_phenotype_profile_table", PROFILE_TABLE_SQL)
def sc12_phenotype_profile_table(spark, sf_dir):
    """Profile table: phenotype name (SC-12), snapshot (SC-13), feature strings (SC-14)."""
    return profile_table(spark, sf_dir)


@query("sc13_clinical_snapshot", f"SELECT cluster, clinical_snapshot FROM ({PROFILE_TABLE_SQL}) t")
def sc13_clinical_snapshot(spark, sf_dir):
    return profile_table(spark, sf_dir).select("cluster", "clinical_snapshot")


@query("sc14_feature_list_strings", f"SELECT cluster, top_high_features, top_low_features FROM ({PROFILE_TABLE_SQL}) t")
def sc14_feature_list_strings(spark, sf_dir):
    return profile_table(spark, sf_dir).select("cluster", "top_high_features", "top_low_features")


REPORT_SQL = f"""
SELECT cluster, severity_rank, concat_ws(chr(10), t, repeat('-', greatest(12, length(t))),
       'Severity rank: ' || coalesce(CAST(severity_rank AS VARCHAR), 'nan'),
       printf('Patients: %d (%.2f%%)', n_patients, size_pct * 100),
       'Clinical snapshot: ' || clinical_snapshot, 'Top high features: ' || top_high_features,
       'Top low features: ' || top_low_features) AS report
FROM (SELECT *, cluster_label || ' | ' || phenotype_name AS t FROM ({PROFILE_TABLE_SQL}))
"""


@query("sc22_report_lines", REPORT_SQL)
def sc22_report_lines(spark, sf_dir):
    """Report block per cluster (title, rule, severity, size, snapshot, feature lists)."""
    r = PT.report_lines(profile_table(spark, sf_dir))
    return r.select("cluster", "severity_rank", F.array_join("lines", "\n").alias("report"))


SALIENT_SQL = f"""
WITH a AS (SELECT * FROM ({ATLP_SQL}) x WHERE variable_type IN ('numeric', 'binary')),
r AS (SELECT cluster, variable,
             row_number() OVER (PARTITION BY cluster ORDER BY z_score_vs_global DESC NULLS LAST, variable) AS rh,
             row_number() OVER (PARTITION BY cluster ORDER BY z_score_vs_global ASC NULLS LAST, variable) AS rl,
             row_number() OVER (PARTITION BY cluster ORDER BY uncertainty DESC NULLS LAST, variable) AS ru FROM a)
SELECT cluster, 'salient_high' AS kind, CAST(rh AS INTEGER) AS position, variable FROM r WHERE rh <= 3
UNION ALL SELECT cluster, 'salient_low', CAST(rl AS INTEGER), variable FROM r WHERE rl <= 3
UNION ALL SELECT cluster, 'most_uncertain', CAST(ru AS INTEGER), variable FROM r WHERE ru <= 3
"""


@query("wn07_salient_cells", SALIENT_SQL)
def wn07_salient_cells(spark, sf_dir):
    return PT.salient_cells(atlp(spark, sf_dir), 3).withColumn("position", F.col("position").cast("int"))


def _clip(x):
    return f"least(greatest({x}, 0.0), 1.0)"


OLDER_SQL = with_cohort(f"""
, nl AS ({" UNION ALL ".join(f"SELECT cluster, '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM cohort" for c in NUMERIC)})
, s AS (SELECT cluster, variable, stddev_samp(x) AS sd, avg(x) AS m, quantile_cont(x, 0.5) AS med, quantile_cont(x, 0.25) AS q1,
               quantile_cont(x, 0.75) AS q3, min(x) AS lo, max(x) AS hi, count(DISTINCT x) AS nd, count(x) AS n
        FROM nl GROUP BY ALL)
, c AS (SELECT *, CASE WHEN abs(m) >= 1e-9 THEN abs(sd / m) ELSE 1.0 END AS cv FROM s)
, r AS (SELECT *, CASE WHEN abs(med) >= 1e-9 THEN (q3 - q1) / (abs(med) + 1e-9) ELSE cv END AS rob,
               CASE WHEN hi - lo > 1e-9 THEN (q3 - q1) / (hi - lo) ELSE 0.0 END AS bnd FROM c)
SELECT cluster, variable, round(CASE WHEN n = 0 THEN 1.0 ELSE {_clip(
    f"CASE WHEN nd <= 20 THEN 0.4 * {_clip('cv')} + 0.35 * {_clip('rob')} + 0.25 * {_clip('bnd')} "
    f"ELSE least({_clip('cv')}, {_clip('rob')}) END")} END, 6) AS uncertainty
FROM r
""")


@query("ag36_older_uncertainty", OLDER_SQL)
def ag36_older_uncertainty(spark, sf_dir):
    return P.older_uncertainty(clustered_cohort(spark, sf_dir), NUMERIC)


CANDIDATES = NUMERIC + BINARY + CATEGORICAL + ["target", "constant_col"]
GROUPS_SQL = with_cohort(" UNION ALL ".join(
    [f"SELECT '{c}' AS variable, CASE WHEN count(*) FILTER (WHERE CAST({c} AS DOUBLE) NOT IN (0, 1)) = 0 AND count({c}) > 0 "
     f"THEN 'binary' ELSE 'numeric' END AS variable_type FROM cohort" for c in CANDIDATES if c not in CATEGORICAL]
    + [f"SELECT '{c}', 'categorical'" for c in CATEGORICAL]))


@query("prj07_variable_groups", GROUPS_SQL)
def prj07_variable_groups(spark, sf_dir):
    return P.variable_groups_frame(clustered_cohort(spark, sf_dir), CANDIDATES, CATEGORICAL)


COHORT_COLS = ["row_id", "subject_id", "cat_priority", "cat_segment", "cat_region", "totalprice", "acctbal",
               "quantity_min", "quantity_max", "price_min", "price_max", "discount_max", "tax_max", "has_return",
               "constant_col", "leakage_last_ship", "target"]
EXCLUDE = CATEGORICAL + ["row_id", "subject_id"]
CAND_SQL = f"""
WITH prof AS ({PROFILES_SQL}),
first AS (SELECT * FROM (VALUES {", ".join(f"('{v}', 0, {i})" for i, v in enumerate(SUMMARY_MEANS))}) t(variable, prio, pos)),
second AS (SELECT variable, 1 AS prio, row_number() OVER (ORDER BY count(*) DESC, variable) AS pos FROM prof GROUP BY variable),
allv AS (SELECT * FROM first UNION ALL SELECT * FROM second),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY prio, pos) AS r FROM allv
         WHERE variable IN ({", ".join(f"'{c}'" for c in COHORT_COLS)})
           AND variable NOT IN ({", ".join(f"'{c}'" for c in EXCLUDE)})) WHERE r = 1)
SELECT CAST(position AS INTEGER) AS position, variable FROM
  (SELECT variable, row_number() OVER (ORDER BY prio, pos) AS position FROM best) WHERE position <= 6
"""


@query("prj09_candidate_variables", CAND_SQL)
def prj09_candidate_variables(spark, sf_dir):
    s = summary(spark, sf_dir, noise=True)
    return P.candidate_variables(s, profiles(spark, sf_dir), COHORT_COLS, EXCLUDE, cap=6).withColumn(
        "position", F.col("position").cast("int"))


JOIN_SQL = with_cohort("""
SELECT c.row_id, c.totalprice, a.cluster FROM cohort c JOIN (SELECT row_id, cluster FROM cohort) a USING (row_id)
""")


@query("jn01_validated_join", JOIN_SQL)
def jn01_validated_join(spark, sf_dir):
    df = clustered_cohort(spark, sf_dir)
    assign = df.select("row_id", "cluster")
    return P.validated_join(df.select("row_id", "totalprice"), assign, "row_id")


ASSIGN_SQL = f"""
WITH summ AS ({_SUMMARY_ONLY}),
base AS ({with_cohort('SELECT subject_id, row_id, cluster FROM cohort', noise=True)})
SELECT b.subject_id, b.row_id, b.cluster, CASE WHEN b.cluster = -1 THEN 'noise' ELSE 'cluster_' || b.cluster END AS cluster_label,
       s.severity_rank FROM base b LEFT JOIN summ s ON s.cluster = b.cluster
"""


@query("jn02_assignments_severity", ASSIGN_SQL)
def jn02_assignments_severity(spark, sf_dir):
    df = clustered_cohort(spark, sf_dir, True)
    return P.assignments(df, summary(spark, sf_dir, noise=True), ["subject_id"])


@query("sc15_cluster_label", f"SELECT row_id, cluster_label FROM ({ASSIGN_SQL}) t")
def sc15_cluster_label(spark, sf_dir):
    df = clustered_cohort(spark, sf_dir, True)
    return df.select("row_id", P.cluster_label(F.col("cluster")).alias("cluster_label"))


@query("prj11_noise_filter", with_cohort("SELECT row_id, cluster FROM cohort WHERE cluster <> -1", noise=True))
def prj11_noise_filter(spark, sf_dir):
    return clustered_cohort(spark, sf_dir, True).where(F.col("cluster") != -1).select("row_id", "cluster")

