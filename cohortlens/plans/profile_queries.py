"""Registered profiling queries: cluster summary, profiles, the flagship aTLP
summary and the colour / uncertainty operators that make it up.

Stand-in configuration (cluster = market-segment index):
numeric measures, one binary flag, two categorical codes, and a small
stand-in rule table so that all three clinical rule shapes are exercised.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import colors as C
from ..operators import profile as P
from ..sources.tables import clustered_cohort, cohort, with_cohort
from .registry import query

NUMERIC = ["totalprice", "acctbal", "quantity_min", "quantity_max", "price_max", "discount_max", "tax_max"]
BINARY = ["has_return"]
CATEGORICAL = ["cat_priority", "cat_region"]
INVERT = ["acctbal"]
# Stand-in rules for the stand-in cohort (one per rule shape, plus a flag).
STANDIN_RULES = [
    ("quantity_max", C.HIGHER_WORSE, 40.0, 48.0),
    ("discount_max", C.LOWER_WORSE, 0.08, 0.04),
    ("tax_max", C.TARGET_RANGE, (0.02, 0.07), (0.01, 0.08)),
    ("has_return", C.HIGHER_WORSE, 0.25, 0.75),
]
SUMMARY_MEANS = ["totalprice", "acctbal", "quantity_max", "price_max"]
SUMMARY_MODES = ["cat_priority", "cat_region"]


def summary(spark, sf_dir, noise=False):
    return P.cluster_summary(clustered_cohort(spark, sf_dir, noise), "cluster", "target", SUMMARY_MEANS, SUMMARY_MODES)


def atlp(spark, sf_dir):
    # the profile reads its input ~6 times; the cohort is a materialised table (sources.tables)
    df = clustered_cohort(spark, sf_dir)
    sev = P.cluster_summary(df, "cluster", "target")
    return P.atlp_summary(df, NUMERIC, BINARY, CATEGORICAL, severity=sev,
                          rules=C.rules_frame(spark, STANDIN_RULES), invert=INVERT)


# ---------------------------------------------------------------- SQL side --

def _mode_sql(col):
    return (f"(SELECT v FROM (SELECT {col} AS v, count(*) AS k FROM cohort c2 WHERE c2.cluster = c1.cluster "
            f"AND {col} IS NOT NULL GROUP BY 1) ORDER BY k DESC, v LIMIT 1)")


SUMMARY_SQL_BODY = f"""
, s AS (SELECT cluster, count(*) AS n_patients, avg(target) AS mortality_rate,
               {", ".join(f"avg({c}) AS mean_{c}" for c in SUMMARY_MEANS)}
        FROM cohort GROUP BY cluster)
, m AS (SELECT DISTINCT cluster, {", ".join(f"{_mode_sql(c)} AS mode_{c}" for c in SUMMARY_MODES)} FROM cohort c1)
SELECT s.cluster, CAST(n_patients AS BIGINT) AS n_patients, round(mortality_rate, 6) AS mortality_rate,
       {", ".join(f"round(mean_{c}, 6) AS mean_{c}" for c in SUMMARY_MEANS)},
       {", ".join(f"mode_{c}" for c in SUMMARY_MODES)},
       CASE WHEN s.cluster = -1 THEN 'noise' ELSE 'cluster_' || s.cluster END AS cluster_label,
       round(n_patients / sum(n_patients) OVER (), 6) AS size_pct,
       CAST(CASE WHEN s.cluster <> -1 THEN row_number() OVER (PARTITION BY s.cluster <> -1
            ORDER BY mortality_rate DESC NULLS LAST, s.cluster) END AS INTEGER) AS severity_rank
FROM s JOIN m ON s.cluster = m.cluster
"""


@query("ag01_cluster_summary", with_cohort(SUMMARY_SQL_BODY))
def ag01_cluster_summary(spark, sf_dir):
    return summary(spark, sf_dir)


@query("ag01_cluster_summary_noise", with_cohort(SUMMARY_SQL_BODY, noise=True))
def ag01_cluster_summary_noise(spark, sf_dir):
    """Same with a noise cluster (-1): label 'noise', no severity rank."""
    return summary(spark, sf_dir, noise=True)


MODE_SQL = with_cohort(f"""
SELECT DISTINCT cluster, {_mode_sql('cat_priority')} AS mode_cat_priority, {_mode_sql('quantity_max')} AS mode_quantity_max
FROM cohort c1
""")


@query("ag02_safe_mode", MODE_SQL)
def ag02_safe_mode(spark, sf_dir):
    """Most frequent non-null value, smallest on ties."""
    return P.modes(clustered_cohort(spark, sf_dir), "cluster", ["cat_priority", "quantity_max"])


SHARE_SQL = with_cohort("""
SELECT cluster, CAST(count(*) AS BIGINT) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS size_pct FROM cohort GROUP BY cluster
""")


@query("ag03_group_share", SHARE_SQL)
def ag03_group_share(spark, sf_dir):
    from pyspark.sql import Window as W
    s = clustered_cohort(spark, sf_dir).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("size_pct", F.col("n") / F.sum("n").over(W.partitionBy()))


DISP_SQL = with_cohort("""
SELECT round(stddev_pop(r), 6) AS mortality_separation FROM (SELECT cluster, avg(target) AS r FROM cohort GROUP BY cluster) t
WHERE cluster <> -1
""", noise=True)


@query("ag04_mortality_dispersion", DISP_SQL)
def ag04_mortality_dispersion(spark, sf_dir):
    return P.mortality_dispersion(summary(spark, sf_dir, noise=True))


WN02_SQL = with_cohort("""
SELECT cluster, CAST(CASE WHEN cluster <> -1 THEN row_number() OVER (PARTITION BY cluster <> -1
       ORDER BY avg(target) DESC NULLS LAST, cluster) END AS INTEGER) AS severity_rank
FROM cohort GROUP BY cluster
""", noise=True)


@query("wn02_severity_rank", WN02_SQL)
def wn02_severity_rank(spark, sf_dir):
    return summary(spark, sf_dir, noise=True).select("cluster", "severity_rank")


PROFILE_NUMS = ["totalprice", "acctbal", "quantity_min", "quantity_max", "price_max", "discount_max", "tax_max"]
PROFILES_SQL = with_cohort(f"""
, g AS ({" UNION ALL ".join(f"SELECT '{c}' AS variable, avg({c}) AS m, stddev_samp({c}) AS sd FROM cohort" for c in PROFILE_NUMS)})
, cm AS ({" UNION ALL ".join(f"SELECT cluster, '{c}' AS variable, avg({c}) AS cm FROM cohort WHERE cluster <> -1 GROUP BY cluster" for c in PROFILE_NUMS)})
, d AS (SELECT cluster, variable, (cm - m) / CASE WHEN sd = 0 THEN NULL ELSE sd END AS delta FROM cm JOIN g USING (variable))
, r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY delta DESC, variable) AS rh,
               row_number() OVER (PARTITION BY cluster ORDER BY delta ASC, variable) AS rl FROM d WHERE delta IS NOT NULL)
SELECT cluster, 'high' AS direction, variable, round(delta, 6) AS delta_vs_global, CAST(rh AS INTEGER) AS position FROM r WHERE rh <= 3
UNION ALL
SELECT cluster, 'low', variable, round(delta, 6), CAST(rl AS INTEGER) FROM r WHERE rl <= 3
""", noise=True)


@query("ag05_cluster_profiles", PROFILES_SQL)
def ag05_cluster_profiles(spark, sf_dir):
    return P.cluster_profiles(clustered_cohort(spark, sf_dir, True), PROFILE_NUMS, "cluster", 3).withColumn(
        "position", F.col("position").cast("int"))


WEIGHT_SQL = with_cohort("""
SELECT round(CASE WHEN sum(target) = 0 THEN 1.0 ELSE (count(*) - sum(target)) / sum(target) END, 6) AS scale_pos_weight FROM cohort
""", clustered=False)


@query("ag19_class_weight", WEIGHT_SQL)
def ag19_class_weight(spark, sf_dir):
    return P.class_weight(cohort(spark, sf_dir), "target")


GNUM = NUMERIC + BINARY
_NLONG = " UNION ALL ".join(f"SELECT cluster, '{c}' AS variable, CAST({c} AS DOUBLE) AS x FROM cohort" for c in GNUM)
_CLONG = " UNION ALL ".join(
    f"SELECT cluster, '{c}' AS variable, coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM cohort" for c in CATEGORICAL)

GLOBAL_SQL = with_cohort(f"""
, nl AS ({_NLONG})
, cl AS ({_CLONG})
, gc0 AS (SELECT variable, value, count(*) AS n FROM cl GROUP BY variable, value)
, gc AS (SELECT *, sum(n) OVER (PARTITION BY variable) AS tot FROM gc0)
SELECT variable, round(quantile_cont(x, 0.5), 6) AS median, round(avg(x), 6) AS mean, round(quantile_cont(x, 0.33), 6) AS p_low,
       round(quantile_cont(x, 0.66), 6) AS p_high, round(stddev_samp(x), 6) AS std, NULL::VARCHAR AS global_mode,
       NULL::DOUBLE AS global_mode_share
FROM nl GROUP BY variable
UNION ALL
SELECT variable, NULL, NULL, NULL, NULL, NULL, value, round(n / tot, 6)
FROM (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS r FROM gc) WHERE r = 1
""")


@query("ag20_global_stats", GLOBAL_SQL)
def ag20_global_stats(spark, sf_dir):
    num, cat = P.global_stats(clustered_cohort(spark, sf_dir), GNUM, CATEGORICAL)
    nul_s, nul_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    return num.select("*", nul_s.alias("global_mode"), nul_d.alias("global_mode_share")).unionByName(
        cat.select("variable", *[nul_d.alias(c) for c in ("median", "mean", "p_low", "p_high", "std")],
                   "global_mode", "global_mode_share"))


def _rules_values():
    rows = []
    for var, d, g, r in STANDIN_RULES:
        if d == C.TARGET_RANGE:
            rows.append(f"('{var}', '{d}', {g[0]}, {g[1]}, {r[0]}, {r[1]})")
        else:
            rows.append(f"('{var}', '{d}', {g}, NULL, {r}, NULL)")
    return "(VALUES " + ", ".join(rows) + ") AS rules(variable, direction, g1, g2, r1, r2)"


def _pct_color(v, lo, hi, inv):
    normal = f"CASE WHEN {v} <= {lo} THEN 'green' WHEN {v} >= {hi} THEN 'red' ELSE 'yellow' END"
    inverted = f"CASE WHEN {v} >= {hi} THEN 'green' WHEN {v} <= {lo} THEN 'red' ELSE 'yellow' END"
    return (f"CASE WHEN {v} IS NULL OR {lo} IS NULL OR {hi} IS NULL THEN 'yellow' WHEN {inv} THEN {inverted} "
            f"ELSE {normal} END")


_INV = "variable IN (" + ", ".join(f"'{v}'" for v in INVERT) + ")"
_IS_BIN = "variable IN (" + ", ".join(f"'{v}'" for v in BINARY) + ")"
_CLINICAL = """CASE WHEN proto IS NULL THEN 'yellow'
  WHEN direction = 'higher_worse' THEN CASE WHEN proto <= g1 THEN 'green' WHEN proto >= r1 THEN 'red' ELSE 'yellow' END
  WHEN direction = 'lower_worse' THEN CASE WHEN proto >= g1 THEN 'green' WHEN proto <= r1 THEN 'red' ELSE 'yellow' END
  ELSE CASE WHEN proto BETWEEN g1 AND g2 THEN 'green' WHEN proto < r1 OR proto > r2 THEN 'red' ELSE 'yellow' END END"""
_IS_SCORE = "(variable LIKE '%\\_score' ESCAPE '\\')"


def _sat(expr):
    return f"CAST(round_even(least(greatest({expr}, 0), 255), 0) AS INTEGER)"


_PRIM = _sat("80 + 125 * (1 - uc) + 50 * (1 - uc) * (1 - uc)")
_YEL = _sat("180 + 180 * (1 - uc) - 143 * power(1 - uc, 2) + 38 * power(1 - uc, 3)")

ATLP_SQL = with_cohort(f"""
, sev AS (SELECT cluster, CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster_' || cluster END AS cluster_label,
                 CAST(CASE WHEN cluster <> -1 THEN row_number() OVER (PARTITION BY cluster <> -1
                      ORDER BY avg(target) DESC NULLS LAST, cluster) END AS INTEGER) AS severity_rank
          FROM cohort GROUP BY cluster)
, nl AS ({_NLONG})
, pc AS (SELECT cluster, variable, quantile_cont(x, 0.5) AS med, avg(x) AS mean, stddev_samp(x) AS sd, count(x) AS n
         FROM nl GROUP BY ALL)
, gl AS (SELECT variable, quantile_cont(x, 0.5) AS g_median, avg(x) AS g_mean, quantile_cont(x, 0.33) AS p_low,
                quantile_cont(x, 0.66) AS p_high, stddev_samp(x) AS g_std FROM nl GROUP BY variable)
, nj AS (SELECT pc.*, gl.* EXCLUDE (variable), rules.* EXCLUDE (variable),
                CASE WHEN {_IS_BIN} THEN mean ELSE med END AS proto,
                CASE WHEN {_IS_BIN} THEN g_mean ELSE g_median END AS ref
         FROM pc JOIN gl USING (variable) LEFT JOIN {_rules_values()} USING (variable))
, num AS (SELECT cluster, variable, CASE WHEN {_IS_BIN} THEN 'binary' ELSE 'numeric' END AS variable_type,
                 proto AS prototype_num, NULL::VARCHAR AS prototype_cat, ref AS global_reference_num,
                 NULL::VARCHAR AS global_reference_cat, proto - ref AS delta_vs_global,
                 CASE WHEN NOT {_IS_BIN} AND g_std IS NOT NULL AND g_std <> 0 THEN (proto - g_mean) / g_std END AS z_score_vs_global,
                 CASE WHEN direction IS NOT NULL THEN {_CLINICAL}
                      WHEN {_IS_SCORE} THEN {_pct_color('proto', 'p_low', 'p_high', 'false')}
                      ELSE {_pct_color('proto', 'p_low', 'p_high', _INV)} END AS tlp_color,
                 CASE WHEN direction IS NOT NULL THEN direction WHEN {_IS_SCORE} THEN 'higher_worse'
                      WHEN {_INV} THEN 'lower_worse' ELSE 'higher_worse' END AS tlp_polarity,
                 CASE WHEN direction IS NOT NULL THEN 'clinical_threshold' WHEN {_IS_SCORE} THEN 'percentile_score_fallback'
                      ELSE 'percentile_fallback' END AS tlp_color_basis,
                 CASE WHEN {_IS_BIN} THEN CASE WHEN n = 0 THEN 1.0 ELSE 1.0 - abs(2 * mean - 1) END
                      WHEN n = 0 OR sd IS NULL THEN 1.0
                      ELSE abs(sd / CASE WHEN abs(mean) >= 1e-9 THEN abs(mean) WHEN abs(med) >= 1e-9 THEN abs(med) ELSE 1e-9 END)
                 END AS uncertainty
          FROM nj)
, cl AS ({_CLONG})
, cc AS (SELECT cluster, variable, value, count(*) AS n FROM cl GROUP BY ALL)
, ct AS (SELECT cluster, variable, sum(n) AS tot, count(*) AS levels FROM cc GROUP BY ALL)
, ent AS (SELECT cc.cluster, cc.variable, levels,
                 CASE WHEN levels <= 1 THEN 0.0 ELSE -sum((n / tot) * log2(n / tot + 1e-12)) / log2(levels) END AS h
          FROM cc JOIN ct USING (cluster, variable) GROUP BY cc.cluster, cc.variable, levels)
, md AS (SELECT cluster, variable, value AS dominant, n / tot AS share FROM
           (SELECT cc.*, tot, row_number() OVER (PARTITION BY cc.cluster, cc.variable ORDER BY n DESC, value) AS r
            FROM cc JOIN ct USING (cluster, variable)) WHERE r = 1)
, gcc AS (SELECT variable, value, sum(n) AS n FROM cc GROUP BY ALL)
, gmd AS (SELECT variable, value AS global_mode, n / sum(n) OVER (PARTITION BY variable) AS gshare,
                 row_number() OVER (PARTITION BY variable ORDER BY n DESC, value) AS r FROM gcc)
, cat AS (SELECT md.cluster, md.variable, 'categorical' AS variable_type, NULL::DOUBLE AS prototype_num,
                 dominant AS prototype_cat, NULL::DOUBLE AS global_reference_num, global_mode AS global_reference_cat,
                 share - gshare AS delta_vs_global, NULL::DOUBLE AS z_score_vs_global, 'yellow' AS tlp_color,
                 'categorical_context' AS tlp_polarity, 'mode_entropy' AS tlp_color_basis, h AS uncertainty
          FROM md JOIN ent USING (cluster, variable) JOIN gmd ON gmd.variable = md.variable AND gmd.r = 1)
, allrows AS (SELECT *, least(greatest(uncertainty, 0.0), 1.0) AS uc FROM (SELECT * FROM num UNION ALL SELECT * FROM cat))
SELECT a.cluster, sev.cluster_label, sev.severity_rank, variable, variable_type,
       round(prototype_num, 6) AS prototype_num, prototype_cat, round(global_reference_num, 6) AS global_reference_num,
       global_reference_cat, round(delta_vs_global, 6) AS delta_vs_global, round(z_score_vs_global, 6) AS z_score_vs_global,
       tlp_color, tlp_polarity, tlp_color_basis,
       CASE tlp_color WHEN 'green' THEN '#00ff00' WHEN 'red' THEN '#ff0000' ELSE '#ffff00' END AS tlp_color_hex,
       CASE WHEN uncertainty <= 0.3 THEN 'pure' WHEN uncertainty < 0.9 THEN 'mid' ELSE 'dark' END AS atlp_darkening,
       round(uc, 6) AS atlp_uncertainty_clipped,
       CASE tlp_color WHEN 'red' THEN printf('#%02x%02x%02x', {_PRIM}, 0, 0)
                      WHEN 'green' THEN printf('#%02x%02x%02x', 0, {_PRIM}, 0)
                      ELSE printf('#%02x%02x%02x', {_YEL}, {_YEL}, 0) END AS atlp_color_hex,
       round(uncertainty, 6) AS uncertainty,
       CASE WHEN uncertainty <= 0.3 THEN 'high' WHEN uncertainty >= 0.9 THEN 'low' ELSE 'medium' END AS confidence
FROM allrows a JOIN sev ON sev.cluster = a.cluster
""")


@query("ag24_atlp_summary", ATLP_SQL)
def ag24_atlp_summary(spark, sf_dir):
    """Flagship: annotated traffic-light profile of every cluster × variable."""
    return atlp(spark, sf_dir)


def _from_atlp(cols, where=""):
    return f"SELECT {cols} FROM ({ATLP_SQL}) atlp {where}"


@query("ag21_variation_coefficient", _from_atlp("cluster, variable, uncertainty", "WHERE variable_type = 'numeric'"))
def ag21_variation_coefficient(spark, sf_dir):
    return atlp(spark, sf_dir).where("variable_type = 'numeric'").select("cluster", "variable", "uncertainty")


@query("ag22_binary_uncertainty", _from_atlp("cluster, variable, uncertainty", "WHERE variable_type = 'binary'"))
def ag22_binary_uncertainty(spark, sf_dir):
    return atlp(spark, sf_dir).where("variable_type = 'binary'").select("cluster", "variable", "uncertainty")


@query("ag23_normalized_entropy", _from_atlp("cluster, variable, uncertainty", "WHERE variable_type = 'categorical'"))
def ag23_normalized_entropy(spark, sf_dir):
    return atlp(spark, sf_dir).where("variable_type = 'categorical'").select("cluster", "variable", "uncertainty")


CATCTX_SQL = _from_atlp(
    "cluster, cluster_label, severity_rank, variable, prototype_cat AS dominant_category, global_reference_cat AS global_mode, "
    "delta_vs_global AS dominant_share_delta, uncertainty, confidence", "WHERE variable_type = 'categorical'")


@query("ag25_categorical_context", CATCTX_SQL)
def ag25_categorical_context(spark, sf_dir):
    from ..operators.profile_tables import categorical_context
    return categorical_context(atlp(spark, sf_dir))


@query("sc01_confidence", _from_atlp("cluster, variable, confidence"))
def sc01_confidence(spark, sf_dir):
    return atlp(spark, sf_dir).select("cluster", "variable", "confidence")


@query("sc02_darkening", _from_atlp("cluster, variable, atlp_darkening"))
def sc02_darkening(spark, sf_dir):
    return atlp(spark, sf_dir).select("cluster", "variable", "atlp_darkening")


@query("sc03_percentile_color", _from_atlp("cluster, variable, tlp_color", "WHERE tlp_color_basis = 'percentile_fallback'"))
def sc03_percentile_color(spark, sf_dir):
    return atlp(spark, sf_dir).where("tlp_color_basis = 'percentile_fallback'").select("cluster", "variable", "tlp_color")


for _name, _dir in (("sc04_higher_worse_color", "higher_worse"), ("sc05_lower_worse_color", "lower_worse"),
                    ("sc06_target_range_color", "target_range")):
    def _mk(direction):
        def fn(spark, sf_dir):
            return atlp(spark, sf_dir).where(
                (F.col("tlp_color_basis") == "clinical_threshold") & (F.col("tlp_polarity") == direction)
            ).select("cluster", "variable", "prototype_num", "tlp_color")
        return fn
    query(_name, _from_atlp("cluster, variable, prototype_num, tlp_color",
                            f"WHERE tlp_color_basis = 'clinical_threshold' AND tlp_polarity = '{_dir}'"))(_mk(_dir))


@query("sc07_rule_dispatch", _from_atlp("cluster, variable, tlp_color, tlp_polarity, tlp_color_basis"))
def sc07_rule_dispatch(spark, sf_dir):
    return atlp(spark, sf_dir).select("cluster", "variable", "tlp_color", "tlp_polarity", "tlp_color_basis")


@query("sc08_saturation", _from_atlp("cluster, variable, atlp_uncertainty_clipped, atlp_color_hex"))
def sc08_saturation(spark, sf_dir):
    return atlp(spark, sf_dir).select("cluster", "variable", "atlp_uncertainty_clipped", "atlp_color_hex")


@query("sc09_color_hex", _from_atlp("cluster, variable, tlp_color_hex, atlp_color_hex"))
def sc09_color_hex(spark, sf_dir):
    return atlp(spark, sf_dir).select("cluster", "variable", "tlp_color_hex", "atlp_color_hex")


SC10_SQL = _from_atlp(
    "cluster, variable, atlp_color_hex, CASE WHEN 0.2126 * CAST(('0x' || substr(atlp_color_hex, 2, 2)) AS INTEGER) / 255.0 "
    "+ 0.7152 * CAST(('0x' || substr(atlp_color_hex, 4, 2)) AS INTEGER) / 255.0 "
    "+ 0.0722 * CAST(('0x' || substr(atlp_color_hex, 6, 2)) AS INTEGER) / 255.0 >= 0.45 THEN 'black' ELSE 'white' END AS text_color")


@query("sc10_readable_text_color", SC10_SQL)
def sc10_readable_text_color(spark, sf_dir):
    return atlp(spark, sf_dir).select("cluster", "variable", "atlp_color_hex",
                                      C.readable_text_color(F.col("atlp_color_hex")).alias("text_color"))


SC11_SQL = _from_atlp(
    "cluster, variable, CASE WHEN atlp_uncertainty_clipped <= 0.5 THEN printf('#%02x%02x%02x', "
    "CAST(round_even(255 * atlp_uncertainty_clipped / 0.5, 0) AS INTEGER), 255, 0) ELSE printf('#%02x%02x%02x', 255, "
    "CAST(round_even(255 * (1 - (atlp_uncertainty_clipped - 0.5) / 0.5), 0) AS INTEGER), 0) END AS heat_hex")


@query("sc11_uncertainty_heat", SC11_SQL)
def sc11_uncertainty_heat(spark, sf_dir):
    a = atlp(spark, sf_dir)
    return a.select("cluster", "variable", C.uncertainty_heat_hex(F.col("uncertainty")).alias("heat_hex"))


SC21_SQL = _from_atlp(
    "cluster, variable, CASE WHEN prototype_num IS NULL THEN '' WHEN prototype_num = floor(prototype_num) "
    "THEN CAST(CAST(prototype_num AS BIGINT) AS VARCHAR) WHEN abs(prototype_num) >= 100 THEN printf('%.0f', prototype_num) "
    "ELSE printf('%.1f', prototype_num) END AS cell_label", "WHERE variable_type <> 'categorical'")


@query("sc21_cell_label", SC21_SQL)
def sc21_cell_label(spark, sf_dir):
    a = atlp(spark, sf_dir).where("variable_type <> 'categorical'")
    return a.select("cluster", "variable", C.cell_label(F.col("prototype_num")).alias("cell_label"))


PIVOT_VARS = NUMERIC + BINARY
PIVOT_SQL = _from_atlp(
    "cluster_label, " + ", ".join(f"max(CASE WHEN variable = '{v}' THEN tlp_color END) AS \"{v}\"" for v in PIVOT_VARS),
    "WHERE variable_type IN ('numeric', 'binary') GROUP BY cluster_label")


@query("ag37_pivot_atlp", PIVOT_SQL)
def ag37_pivot_atlp(spark, sf_dir):
    from ..operators.profile_tables import pivot_atlp
    return pivot_atlp(atlp(spark, sf_dir), "tlp_color", PIVOT_VARS)
