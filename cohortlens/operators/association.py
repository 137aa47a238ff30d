"""Association tests between clusters and variables, and rank correlation.

All tests start from counts per (variable, value, cluster): one unpivot that
is pipelined into a partial aggregate, so the shuffle carries distinct
combinations, not rows.  Statistics are finished on tables with one row per
variable; only the chi-square tail probability runs in Python (Arrow batch
over that small table).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import chi2_sf_col
from .ranks import ranked_value_counts


def _melt(df: DataFrame, keys: list[str], cols: list[str], as_string: bool) -> DataFrame:
    if as_string:  # null categories become the category "nan"
        vals = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols]
    else:
        vals = [F.col(c).cast("double").alias(c) for c in cols]
    return df.select(*keys, *vals).unpivot(keys, cols, "variable", "value")


def contingency_long(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """AG-26: long contingency table (variable, cluster, value, n); nulls are the category 'nan'."""
    return (_melt(df, [cluster], cols, True)
            .groupBy("variable", F.col(cluster).alias("cluster"), "value")
            .agg(F.count(F.lit(1)).alias("n")))


def contingency_wide(df: DataFrame, cluster: str, col: str) -> DataFrame:
    """AG-26 (wide): clusters × categories crosstab of one variable."""
    return (df.select(cluster, F.coalesce(F.col(col).cast("string"), F.lit("nan")).alias(col))
            .groupBy(cluster).pivot(col).count().na.fill(0))


def chi_square(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """AG-27 + AG-28: chi-square (Yates only when dof = 1), p-value, dof and
    bias-corrected Cramér's V per categorical variable.

    Without correction chi2 = sum_{observed cells} o^2/e - n, so empty cells
    never need to be materialised; the dof = 1 (2x2) case builds its 4 cells."""
    obs = contingency_long(df, cluster, cols).withColumnRenamed("n", "o")
    rows = obs.groupBy("variable", "cluster").agg(F.sum("o").alias("rt"))
    colt = obs.groupBy("variable", "value").agg(F.sum("o").alias("ct"))
    shape = obs.groupBy("variable").agg(
        F.sum("o").alias("n"), F.countDistinct("cluster").alias("r"), F.countDistinct("value").alias("k"))
    shape = shape.where(F.col("k") >= 2).withColumn("dof", (F.col("r") - 1) * (F.col("k") - 1))

    cells = obs.join(rows, ["variable", "cluster"]).join(colt, ["variable", "value"]).join(shape, "variable")
    cells = cells.withColumn("e", F.col("rt") * F.col("ct") / F.col("n"))
    plain = cells.where(F.col("dof") != 1).groupBy("variable").agg(
        F.sum(F.col("o") * F.col("o") / F.col("e")).alias("s"))
    plain = plain.join(shape, "variable").select("variable", (F.col("s") - F.col("n")).alias("chi2"))

    # 2x2 tables: every cell, observed 0 where absent, Yates-shifted toward expected
    small = shape.where(F.col("dof") == 1).select("variable", "n")
    grid = (rows.join(small, "variable").join(colt, "variable")
            .join(obs, ["variable", "cluster", "value"], "left")
            .withColumn("o", F.coalesce("o", F.lit(0)).cast("double"))
            .withColumn("e", F.col("rt") * F.col("ct") / F.col("n")))
    diff = F.col("e") - F.col("o")
    shifted = F.col("o") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))
    yates = grid.groupBy("variable").agg(F.sum(F.pow(shifted - F.col("e"), 2) / F.col("e")).alias("chi2"))

    chi = plain.unionByName(yates).join(shape, "variable")
    nm1 = F.greatest(F.col("n") - 1, F.lit(1))
    phi2 = F.col("chi2") / F.col("n")
    phi2c = F.greatest(F.lit(0.0), phi2 - (F.col("k") - 1) * (F.col("r") - 1) / nm1)
    rc = F.col("r") - F.pow(F.col("r") - 1, 2) / nm1
    kc = F.col("k") - F.pow(F.col("k") - 1, 2) / nm1
    denom = F.least(kc - 1, rc - 1)
    v = F.when(denom <= 0, F.lit(0.0)).otherwise(F.sqrt(phi2c / denom))
    return chi.select(
        "variable", F.col("chi2").cast("double").alias("chi2"),
        chi2_sf_col(F.col("chi2"), F.col("dof")).alias("p_value"),
        F.col("dof").cast("int").alias("dof"), v.alias("cramers_v"),
    ).orderBy(F.desc("cramers_v"), F.desc("chi2"))


def kruskal_wallis(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """AG-29: Kruskal-Wallis H with tie correction, p-value (dof = groups - 1)
    and eta² = max((H - k + 1)/(n - k), 0) with n = ALL rows and k = ALL
    clusters (the reference's definition, kept on purpose)."""
    melted = _melt(df, [cluster], cols, False).where(F.col("value").isNotNull() & ~F.isnan("value"))
    cnt = melted.groupBy("variable", "value", F.col(cluster).alias("cluster")).agg(F.count(F.lit(1)).alias("c"))
    per_value = cnt.groupBy("variable", "value").agg(F.sum("c").alias("t"))
    ranked = ranked_value_counts(per_value, ["variable"], "value", "t")
    ties = ranked.groupBy("variable").agg(
        F.sum("t").alias("N"), F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie"))
    sums = (cnt.join(ranked.select("variable", "value", "avg_rank"), ["variable", "value"])
            .groupBy("variable", "cluster").agg(F.sum(F.col("c") * F.col("avg_rank")).alias("R"),
                                                 F.sum("c").alias("nj")))
    h = sums.groupBy("variable").agg(F.sum(F.pow("R", 2) / F.col("nj")).alias("ssr"), F.count(F.lit(1)).alias("groups"))
    h = h.join(ties, "variable").where(F.col("groups") >= 2)
    N = F.col("N").cast("double")
    raw = 12.0 / (N * (N + 1)) * F.col("ssr") - 3 * (N + 1)
    corr = 1 - F.try_divide(F.col("tie"), F.pow(N, 3) - N)
    # all values equal: no ranks to compare, the variable is left out (the others stay)
    h = h.where((F.col("N") > 1) & (corr > 0)).withColumn("kruskal_h", raw / corr)
    totals = df.agg(F.count(F.lit(1)).alias("n_all"), F.countDistinct(cluster).alias("k_all"))
    # one row of two numbers: inlined as literals
    h = h.withColumns({k: F.lit(v) for k, v in totals.first().asDict().items()})
    eta = F.when(F.col("n_all") > F.col("k_all"), F.greatest(
        (F.col("kruskal_h") - F.col("k_all") + 1) / (F.col("n_all") - F.col("k_all")), F.lit(0.0)))
    return h.select("variable", "kruskal_h", chi2_sf_col(F.col("kruskal_h"), F.col("groups") - 1).alias("p_value"),
                    eta.cast("double").alias("eta_squared")).orderBy(F.desc("eta_squared"), F.desc("kruskal_h"))


def spearman(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG-18: Spearman rho for every pair (a < b) on pairwise-complete rows.

    Each pair is ranked on its own complete rows (average ties), as pandas does;
    rho is the Pearson correlation of the two rank columns."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    # a pair goes through every shuffle as its number, not as two names
    structs = [F.struct(F.lit(i).alias("pair"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for i, (a, b) in enumerate(pairs)]
    stacked = df.select(F.explode(F.array(*structs)).alias("s")).select("s.*").where(
        F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    pair = ["pair"]

    # One row per distinct (x, y) of a pair: a hot value is a few weighted rows in everything that follows.
    cells = stacked.groupBy(*pair, "x", "y").agg(F.count(F.lit(1)).alias("__c"))

    def rank_table(value, out):
        # counts per (pair, value) -> average rank per value; independent of the other side
        counts = cells.groupBy(*pair, value).agg(F.sum("__c").alias("__n"))
        return ranked_value_counts(counts, pair, value, "__n").select(*pair, value, F.col("avg_rank").alias(out))
    totals = cells.groupBy(*pair).agg(F.sum("__c").alias("n"))
    ranked = cells.join(rank_table("x", "rx"), [*pair, "x"]).join(rank_table("y", "ry"), [*pair, "y"]).join(totals, pair)
    mean = (F.col("n") + 1) / 2.0  # of average ranks, whatever the ties
    dx, dy, c = F.col("rx") - mean, F.col("ry") - mean, F.col("__c")
    names = [F.element_at(F.array(*[F.lit(p[i]) for p in pairs]), F.col("pair") + 1).alias(n) for i, n in enumerate(("var_a", "var_b"))]
    return ranked.groupBy(*pair, "n").agg(F.sum(c * dx * dy).alias("xy"), F.sum(c * dx * dx).alias("xx"),
                                          F.sum(c * dy * dy).alias("yy")).select(
        *names, F.try_divide(F.col("xy"), F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"), "n")
