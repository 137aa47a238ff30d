"""Registered rank / association queries on the clustered stand-in cohort
(cluster = market-segment index)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import association as A
from ..operators.ranks import percentile_rank
from ..sources.tables import clustered_cohort, cohort, with_cohort
from .registry import query

CATS = ["cat_priority", "cat_region", "has_return"]
NUMS = ["totalprice", "acctbal", "quantity_max", "price_min", "discount_max", "tax_max"]


def _cat_long(cols, key="cluster"):
    return "\nUNION ALL\n".join(
        f"SELECT {key} AS cluster, '{c}' AS variable, coalesce(CAST({c} AS VARCHAR), 'nan') AS value FROM cohort"
        for c in cols)


def _num_long(cols, key="cluster"):
    return "\nUNION ALL\n".join(
        f"SELECT {key} AS cluster, '{c}' AS variable, CAST({c} AS DOUBLE) AS value FROM cohort WHERE {c} IS NOT NULL"
        for c in cols)


# chi-square upper tail for EVEN dof, closed form (all stand-in tables have even dof)
_EVEN_SF = "(SELECT exp(-{x} / 2) * sum(pow({x} / 2, i) / CAST(factorial(CAST(i AS INTEGER)) AS DOUBLE)) FROM range({dof} // 2) t(i))"

CONTINGENCY_SQL = with_cohort(f"""
, long AS ({_cat_long(CATS)})
SELECT variable, cluster, value, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY ALL
""")


@query("ag26_contingency_table", CONTINGENCY_SQL)
def ag26_contingency_table(spark, sf_dir):
    return A.contingency_long(clustered_cohort(spark, sf_dir), "cluster", CATS)


def _chi_sql(cats, key, with_p=True):
    p = f"round({_EVEN_SF.format(x='chi2', dof='dof')}, 6) AS p_value," if with_p else ""
    return with_cohort(f"""
, long AS ({_cat_long(cats, key)})
, obs AS (SELECT variable, cluster, value, count(*) AS o FROM long GROUP BY ALL)
, rt AS (SELECT variable, cluster, sum(o) AS rt FROM obs GROUP BY ALL)
, ct AS (SELECT variable, value, sum(o) AS ct FROM obs GROUP BY ALL)
, sh AS (SELECT variable, sum(o) AS n, count(DISTINCT cluster) AS r, count(DISTINCT value) AS k FROM obs GROUP BY ALL
         HAVING count(DISTINCT value) >= 2)
, grid AS (SELECT rt.variable, rt.rt, ct.ct, sh.n, sh.r, sh.k, (sh.r - 1) * (sh.k - 1) AS dof,
                  CAST(coalesce(obs.o, 0) AS DOUBLE) AS o, rt.rt * ct.ct / sh.n AS e
           FROM rt JOIN sh ON rt.variable = sh.variable JOIN ct ON ct.variable = rt.variable
           LEFT JOIN obs ON obs.variable = rt.variable AND obs.cluster = rt.cluster AND obs.value = ct.value)
, adj AS (SELECT *, CASE WHEN dof = 1 THEN o + sign(e - o) * least(0.5, abs(e - o)) ELSE o END AS oa FROM grid)
, chi AS (SELECT variable, n, r, k, dof, sum((oa - e) * (oa - e) / e) AS chi2 FROM adj GROUP BY variable, n, r, k, dof)
, v AS (SELECT *, greatest(0.0, chi2 / n - (k - 1) * (r - 1) / greatest(n - 1, 1)) AS phi2c,
               least(k - (k - 1) * (k - 1) / greatest(n - 1, 1) - 1, r - (r - 1) * (r - 1) / greatest(n - 1, 1) - 1) AS den
        FROM chi)
SELECT variable, round(chi2, 6) AS chi2, {p} CAST(dof AS INTEGER) AS dof,
       round(CASE WHEN den <= 0 THEN 0.0 ELSE sqrt(phi2c / den) END, 6) AS cramers_v
FROM v
""")


@query("ag27_chi_square", _chi_sql(CATS, "cluster"))
def ag27_chi_square(spark, sf_dir):
    return A.chi_square(clustered_cohort(spark, sf_dir), "cluster", CATS)


@query("ag28_cramers_v", f"SELECT variable, cramers_v FROM ({_chi_sql(CATS, 'cluster')}) t")
def ag28_cramers_v(spark, sf_dir):
    return A.chi_square(clustered_cohort(spark, sf_dir), "cluster", CATS).select("variable", "cramers_v")


@query("ag27_chi_square_yates_2x2", _chi_sql(["has_return"], "target", with_p=False))
def ag27_chi_square_yates_2x2(spark, sf_dir):
    """2×2 table (target × has_return): the Yates-corrected path."""
    return A.chi_square(cohort(spark, sf_dir), "target", ["has_return"]).drop("p_value")


KRUSKAL_SQL = with_cohort(f"""
, long AS ({_num_long(NUMS)})
, tv AS (SELECT variable, value, count(*) AS t FROM long GROUP BY ALL)
, rk AS (SELECT variable, cluster, rank() OVER (PARTITION BY variable ORDER BY value)
                + (count(*) OVER (PARTITION BY variable, value) - 1) / 2.0 AS r FROM long)
, g AS (SELECT variable, cluster, sum(r) AS rs, count(*) AS nj FROM rk GROUP BY ALL)
, ti AS (SELECT variable, CAST(sum(t) AS DOUBLE) AS nn, sum(CAST(t AS DOUBLE) * t * t - t) AS tie FROM tv GROUP BY ALL)
, h AS (SELECT g.variable, count(*) AS groups,
               (12.0 / (nn * (nn + 1)) * sum(rs * rs / nj) - 3 * (nn + 1)) / (1 - tie / (nn * nn * nn - nn)) AS kh
        FROM g JOIN ti USING (variable) GROUP BY g.variable, nn, tie HAVING count(*) >= 2)
, tot AS (SELECT count(*) AS n_all, count(DISTINCT cluster) AS k_all FROM cohort)
SELECT variable, round(kh, 6) AS kruskal_h, round({_EVEN_SF.format(x='kh', dof='(groups - 1)')}, 6) AS p_value,
       round(CASE WHEN n_all > k_all THEN greatest((kh - k_all + 1) / (n_all - k_all), 0.0) END, 6) AS eta_squared
FROM h, tot
""")


@query("ag29_kruskal_wallis", KRUSKAL_SQL)
def ag29_kruskal_wallis(spark, sf_dir):
    return A.kruskal_wallis(clustered_cohort(spark, sf_dir), "cluster", NUMS)


SPEARMAN_COLS = ["totalprice", "acctbal", "quantity_max", "price_max", "discount_max"]
_PAIRS = [(a, b) for i, a in enumerate(SPEARMAN_COLS) for b in SPEARMAN_COLS[i + 1:]]
SPEARMAN_SQL = with_cohort(f"""
, pairs AS ({" UNION ALL ".join(
    f"SELECT '{a}' AS var_a, '{b}' AS var_b, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y FROM cohort "
    f"WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in _PAIRS)})
, r AS (SELECT var_a, var_b,
               rank() OVER (PARTITION BY var_a, var_b ORDER BY x) + (count(*) OVER (PARTITION BY var_a, var_b, x) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY var_a, var_b ORDER BY y) + (count(*) OVER (PARTITION BY var_a, var_b, y) - 1) / 2.0 AS ry
        FROM pairs)
SELECT var_a, var_b, round(corr(rx, ry), 6) AS rho, CAST(count(*) AS BIGINT) AS n FROM r GROUP BY ALL
""", clustered=False)


@query("ag18_spearman", SPEARMAN_SQL)
def ag18_spearman(spark, sf_dir):
    return A.spearman(cohort(spark, sf_dir), SPEARMAN_COLS)


WN01_SQL = with_cohort("""
SELECT row_id, quantity_max,
  round(CASE WHEN quantity_max IS NOT NULL THEN (rank() OVER (ORDER BY quantity_max ASC NULLS LAST)
        + (count(*) OVER (PARTITION BY quantity_max) - 1) / 2.0) / count(quantity_max) OVER () END, 6) AS pct_high,
  round(CASE WHEN quantity_max IS NOT NULL THEN (rank() OVER (ORDER BY quantity_max DESC NULLS LAST)
        + (count(*) OVER (PARTITION BY quantity_max) - 1) / 2.0) / count(quantity_max) OVER () END, 6) AS pct_low
FROM cohort
""", clustered=False)


@query("wn01_percentile_rank", WN01_SQL)
def wn01_percentile_rank(spark, sf_dir):
    df = cohort(spark, sf_dir).select("row_id", "quantity_max")
    df = percentile_rank(df, "quantity_max", True, out="pct_high")
    return percentile_rank(df, "quantity_max", False, out="pct_low")


_PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
WIDE_SQL = with_cohort("SELECT cluster, " + ", ".join(
    f"CAST(count(*) FILTER (WHERE cat_priority = '{v}') AS BIGINT) AS \"{v}\"" for v in _PRIORITIES) + " FROM cohort GROUP BY cluster")


@query("ag26_contingency_wide", WIDE_SQL)
def ag26_contingency_wide(spark, sf_dir):
    """Wide crosstab (clusters × categories) of one variable."""
    return A.contingency_wide(clustered_cohort(spark, sf_dir), "cluster", "cat_priority")



