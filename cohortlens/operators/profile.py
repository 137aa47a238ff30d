"""Cluster summaries, standardised profiles and the annotated traffic-light
(aTLP) profile.

Per-cluster statistics are ONE grouped aggregate with a column of results per
variable (partial aggregation map-side, so a cluster holding a third of the
rows is just a bigger partial buffer, not a hot reducer); the result has
clusters rows and is melted afterwards.  Global statistics are one ungrouped
aggregate.  Everything after that works on (clusters × variables) rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import colors as C
from ..functions.quantiles import exact_quantiles

SEVERITY_CANDIDATES = ["mortality_rate", "mean_apsiii_prob", "mean_apsiii"]


def cluster_label(cluster: Column) -> Column:
    """SC-15: 'noise' for -1, else 'cluster_<k>'."""
    return F.when(cluster == -1, F.lit("noise")).otherwise(F.concat(F.lit("cluster_"), cluster.cast("string")))


def sanitize_label(label: Column, cluster: Column) -> Column:
    """SC-15: keep a present label, else 'cluster_<k>'."""
    return F.coalesce(label.cast("string"), F.concat(F.lit("cluster_"), cluster.cast("string")))


def _melt_row(df: DataFrame, keys: list[str], cols: list[str], fields: dict[str, str]) -> DataFrame:
    """Wide per-group result with ``{field}__{col}`` columns -> one row per (group, variable)."""
    structs = [F.struct(F.lit(c).alias("variable"), *[F.col(f"`{f}__{c}`").cast(t).alias(f) for f, t in fields.items()])
               for c in cols]
    return df.select(*keys, F.explode(F.array(*structs)).alias("s")).select(*keys, "s.*")


def modes(df: DataFrame, cluster: str, cols: list[str]) -> DataFrame:
    """AG-02: cluster and, per column, its most frequent non-null value (the smallest on ties) as ``mode_<column>``.

    Values are counted per (cluster, column, value) first, so no buffer holds a cluster's distinct values; a cell takes the
    least (-count, value) of its counts."""
    out = df.select(F.col(cluster).alias("cluster")).distinct()
    for c in cols:
        counts = df.where(F.col(c).isNotNull()).groupBy(F.col(cluster).alias("__c"), F.col(c).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
        best = counts.groupBy("__c").agg(F.min_by("__v", F.struct((-F.col("__n")).alias("n"), F.col("__v").alias("v"))).alias(f"mode_{c}"))
        out = out.join(best, out["cluster"].eqNullSafe(best["__c"]), "left").drop("__c")
    return out


# ---------------------------------------------------------------- summary ---

def cluster_summary(df: DataFrame, cluster: str = "cluster", target: str | None = None,
                    mean_cols: list[str] = (), mode_cols: list[str] = (),
                    severity_candidates: list[str] = SEVERITY_CANDIDATES) -> DataFrame:
    """AG-01/02/03 + WN-02: size, target mean, means, deterministic modes (smallest on ties),
    label, share of all rows and severity rank (1 = most severe, noise null)."""
    aggs = [F.count(F.lit(1)).alias("n_patients")]
    if target and target in df.columns:
        aggs.append(F.avg(target).alias("mortality_rate"))
    aggs += [F.avg(c).alias(f"mean_{c}") for c in mean_cols]
    s = df.groupBy(F.col(cluster).alias("cluster")).agg(*aggs)
    if mode_cols:  # one row per cluster
        found = modes(df, cluster, list(mode_cols)).withColumnRenamed("cluster", "__k")
        s = s.join(found, s["cluster"].eqNullSafe(found["__k"]), "left").drop("__k")
    s = s.withColumn("cluster_label", cluster_label(F.col("cluster")))
    # the summary has one row per cluster; windows over it are tiny
    s = s.withColumn("size_pct", F.col("n_patients") / F.sum("n_patients").over(W.partitionBy()))
    return add_severity_rank(s, severity_candidates)


def add_severity_rank(summary: DataFrame, candidates: list[str] = SEVERITY_CANDIDATES) -> DataFrame:
    """WN-02: rank real clusters by the first available severity column, descending
    (nulls last, ties by cluster id); noise gets null."""
    sev = next((c for c in candidates if c in summary.columns), None)
    if sev is None:
        return summary.withColumn("severity_rank", F.lit(None).cast("int"))
    real = F.col("cluster") != -1
    w = W.partitionBy(real).orderBy(F.desc_nulls_last(sev), F.asc("cluster"))
    return summary.withColumn("severity_rank", F.when(real, F.row_number().over(w)).cast("int"))


def mortality_dispersion(summary: DataFrame) -> DataFrame:
    """AG-04: population sd of cluster outcome rates, noise excluded."""
    return summary.where(F.col("cluster") != -1).agg(F.stddev_pop("mortality_rate").alias("mortality_separation"))


def class_weight(df: DataFrame, target: str) -> DataFrame:
    """AG-19: negatives / positives, 1.0 if there are no positives."""
    pos = F.sum(F.col(target).cast("double"))
    return df.agg(F.when(pos == 0, F.lit(1.0)).otherwise((F.count(F.lit(1)) - pos) / pos).alias("scale_pos_weight"))


def cluster_profiles(df: DataFrame, numeric_cols: list[str], cluster: str = "cluster", top_n: int = 5) -> DataFrame:
    """AG-05: standardised delta (cluster mean - global mean) / global sd (sample sd,
    0 -> null), the ``top_n`` highest ('high') and lowest ('low') per real cluster."""
    g = df.agg(*[F.avg(c).alias(f"m__{c}") for c in numeric_cols],
               *[F.stddev_samp(c).alias(f"s__{c}") for c in numeric_cols]).first()
    per = df.where(F.col(cluster) != -1).groupBy(F.col(cluster).alias("cluster")).agg(
        *[F.avg(c).alias(f"cm__{c}") for c in numeric_cols])
    deltas = []
    for c in numeric_cols:
        m, s = g[f"m__{c}"], g[f"s__{c}"]
        d = F.lit(None).cast("double") if (s is None or s == 0 or m is None) else (F.col(f"cm__{c}") - F.lit(m)) / F.lit(s)
        deltas.append(F.struct(F.lit(c).alias("variable"), d.alias("delta_vs_global")))
    long = per.select("cluster", F.explode(F.array(*deltas)).alias("s")).select("cluster", "s.*") \
              .where(F.col("delta_vs_global").isNotNull() & ~F.isnan("delta_vs_global"))
    hi = long.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.desc("delta_vs_global"), "variable")))
    lo = long.withColumn("r", F.row_number().over(W.partitionBy("cluster").orderBy(F.asc("delta_vs_global"), "variable")))
    return (hi.where(F.col("r") <= top_n).select("cluster", F.lit("high").alias("direction"), "variable", "delta_vs_global", "r")
            .unionByName(lo.where(F.col("r") <= top_n).select("cluster", F.lit("low").alias("direction"), "variable",
                                                               "delta_vs_global", "r"))
            .withColumnRenamed("r", "position"))


# ------------------------------------------------------------ variable typing

def infer_variable_groups(df: DataFrame, candidates: list[str], categorical: list[str]) -> dict[str, list[str]]:
    """PRJ-07: numeric / binary / categorical.  A numeric column whose non-null values
    are a non-empty subset of {0, 1} is binary.  One aggregate decides every column."""
    types = dict(df.dtypes)
    num_like = [c for c in candidates if c in types and c not in categorical and
                types[c] in ("int", "bigint", "double", "float", "smallint", "tinyint", "boolean") or
                (c in types and types[c].startswith("decimal") and c not in categorical)]
    checks = df.agg(*[F.count_if(~F.col(c).cast("double").isin(0.0, 1.0)).alias(f"o__{c}") for c in num_like],
                    *[F.count(c).alias(f"n__{c}") for c in num_like]).first() if num_like else None
    groups = {"numeric": [], "binary": [], "categorical": []}
    for c in candidates:
        if c not in types:
            continue
        if c in categorical:
            groups["categorical"].append(c)
        elif c in num_like:
            is_bin = types[c] == "boolean" or (checks[f"o__{c}"] == 0 and checks[f"n__{c}"] > 0)
            groups["binary" if is_bin else "numeric"].append(c)
        else:
            groups["categorical"].append(c)
    for c in categorical:
        if c in types and c not in groups["categorical"]:
            groups["categorical"].append(c)
    return groups


def variable_groups_frame(df: DataFrame, candidates: list[str], categorical: list[str]) -> DataFrame:
    g = infer_variable_groups(df, candidates, categorical)
    rows = [(v, k) for k in ("numeric", "binary", "categorical") for v in g[k]]
    return df.sparkSession.createDataFrame(rows, "variable string, variable_type string")


def candidate_variables(summary: DataFrame, profiles: DataFrame, columns: list[str], exclude: list[str],
                        cap: int = 18) -> DataFrame:
    """PRJ-09: variables behind ``mean_*`` summary columns first (summary column order),
    then profile variables by frequency (ties by name); deduplicated, capped."""
    spark = summary.sparkSession
    means = [c[len("mean_"):] for c in summary.columns if c.startswith("mean_")]
    first = spark.createDataFrame([(v, 0, i) for i, v in enumerate(means)], "variable string, prio int, pos int")
    freq = profiles.groupBy("variable").agg(F.count(F.lit(1)).alias("n"))
    second = freq.select("variable", F.lit(1).alias("prio"),
                         F.row_number().over(W.partitionBy().orderBy(F.desc("n"), "variable")).alias("pos"))
    allv = first.unionByName(second).where(F.col("variable").isin(columns) & ~F.col("variable").isin(exclude))
    best = allv.withColumn("r", F.row_number().over(W.partitionBy("variable").orderBy("prio", "pos"))).where("r = 1")
    ordered = best.withColumn("position", F.row_number().over(W.partitionBy().orderBy("prio", "pos")))
    return ordered.where(F.col("position") <= cap).select("position", "variable")


# ------------------------------------------------------------------ aTLP ---

def global_stats(df: DataFrame, numeric: list[str], categorical: list[str],
                 low: float = C.LOW_PERCENTILE, high: float = C.HIGH_PERCENTILE) -> tuple[DataFrame, DataFrame]:
    """AG-20: (numeric: median, mean, p_low, p_high, sd) and (categorical: mode, share).

    Categorical values are strings with null -> 'nan'; the mode is the most
    frequent value, smallest on ties."""
    pl, ph = low / 100.0, high / 100.0
    num = df.agg(*[F.avg(c).alias(f"mean__{c}") for c in numeric],
                 *[F.stddev_samp(c).alias(f"sd__{c}") for c in numeric])
    moments = _melt_row(num, [], numeric, {"mean": "double", "sd": "double"})
    num_long = moments.join(exact_quantiles(df, numeric, [0.5, pl, ph]), "variable", "left").select(
        "variable", F.col("q")[0].alias("median"), "mean", F.col("q")[1].alias("p_low"), F.col("q")[2].alias("p_high"),
        F.col("sd").alias("std"))
    counts = _cat_counts(df, None, categorical)
    # mode = most frequent value, smallest on ties: an aggregate (min_by), not a window
    best = F.min_by(F.struct("value", "n"), F.struct((-F.col("n")).alias("neg"), F.col("value")))
    cat = counts.groupBy("variable").agg(best.alias("b"), F.sum("n").alias("tot")).select(
        "variable", F.col("b.value").alias("global_mode"), (F.col("b.n") / F.col("tot")).alias("global_mode_share"))
    return num_long, cat


def _cat_counts(df: DataFrame, cluster: str | None, cols: list[str]) -> DataFrame:
    keys = [F.col(cluster).alias("cluster")] if cluster else []
    vals = [F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols]
    kn = ["cluster"] if cluster else []
    melted = df.select(*keys, *vals).unpivot(kn, cols, "variable", "value")
    return melted.groupBy(*kn, "variable", "value").agg(F.count(F.lit(1)).alias("n"))


def variation_coefficient(sd: Column, mean: Column, median: Column, n: Column) -> Column:
    """AG-21: |sd / mean|; |mean| < 1e-9 -> |median|, then 1e-9; no data or undefined sd -> 1."""
    denom = F.when(F.abs(mean) >= 1e-9, F.abs(mean)).when(F.abs(median) >= 1e-9, F.abs(median)).otherwise(F.lit(1e-9))
    return F.when((n == 0) | sd.isNull() | F.isnan(sd), F.lit(1.0)).otherwise(F.abs(sd / denom))


def binary_uncertainty(p: Column) -> Column:
    """AG-22: 1 - |2p - 1| (empty -> 1)."""
    return F.when(p.isNull(), F.lit(1.0)).otherwise(1.0 - F.abs(2 * p - 1))


def older_numeric_uncertainty(sd, mean, median, q1, q3, vmin, vmax, n_distinct, n) -> Column:
    """AG-36 (earlier release): CV and IQR/|median| blended with IQR/span when the
    variable has <= 20 distinct values, else the smaller of the two; clipped to [0, 1]."""
    def clip(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    cv = F.when(F.abs(mean) >= 1e-9, F.abs(sd / mean)).otherwise(F.lit(1.0))
    iqr = q3 - q1
    robust = F.when(F.abs(median) >= 1e-9, iqr / (F.abs(median) + 1e-9)).otherwise(cv)
    span = vmax - vmin
    bounded = F.when(span > 1e-9, iqr / span).otherwise(F.lit(0.0))
    # pandas: a NaN sd makes the CV NaN; np.clip keeps NaN; min() with NaN keeps the first argument
    blend = 0.4 * clip(cv) + 0.35 * clip(robust) + 0.25 * clip(bounded)
    u = F.when(n_distinct <= 20, blend).otherwise(F.least(clip(cv), clip(robust)))
    return F.when(n == 0, F.lit(1.0)).otherwise(clip(u))


def atlp_summary(df: DataFrame, numeric: list[str], binary: list[str], categorical: list[str],
                 cluster: str = "cluster", severity: DataFrame | None = None, rules: DataFrame | None = None,
                 invert: list[str] = C.DEFAULT_INVERT, low: float = C.LOW_PERCENTILE, high: float = C.HIGH_PERCENTILE,
                 k1: float = C.ATLP_K1, k2: float = C.ATLP_K2) -> DataFrame:
    """AG-24: one row per cluster × variable with prototype, reference, delta, z,
    traffic-light colour (clinical rule / percentile fallback), polarity, basis,
    uncertainty, confidence, darkening and the continuous aTLP hex colour.

    ``severity`` (cluster, severity_rank[, cluster_label]) defaults to the
    summary's own ranking; ``rules`` defaults to the clinical rule table."""
    spark = df.sparkSession
    nb = numeric + binary
    gnum, gcat = global_stats(df, nb, categorical, low, high)

    pieces = []
    if nb:
        per = df.groupBy(F.col(cluster).alias("cluster")).agg(
            *[F.avg(F.col(c).cast("double")).alias(f"mean__{c}") for c in nb],
            *[F.stddev_samp(F.col(c).cast("double")).alias(f"sd__{c}") for c in nb],
            *[F.count(c).alias(f"n__{c}") for c in nb])
        long = _melt_row(per, ["cluster"], nb, {"mean": "double", "sd": "double", "n": "bigint"})
        medians = exact_quantiles(df.withColumn("cluster", F.col(cluster)), nb, [0.5], ["cluster"])
        long = long.join(medians.select("cluster", "variable", F.col("q")[0].alias("med")), ["cluster", "variable"], "left")
        g = gnum.select("variable", F.col("median").alias("g_median"), F.col("mean").alias("g_mean"),
                        "p_low", "p_high", F.col("std").alias("g_std"))
        long = long.join(F.broadcast(g), "variable")  # one row per variable
        rule_df = rules if rules is not None else C.rules_frame(spark)
        long = long.join(F.broadcast(rule_df), "variable", "left")  # fixed rule table
        is_bin = F.col("variable").isin(binary) if binary else F.lit(False)
        long = (long.withColumn("proto", F.when(is_bin, F.col("mean")).otherwise(F.col("med")))
                    .withColumn("ref", F.when(is_bin, F.col("g_mean")).otherwise(F.col("g_median"))))
        unc = F.when(is_bin, F.when(F.col("n") == 0, F.lit(1.0)).otherwise(binary_uncertainty(F.col("mean")))) \
               .otherwise(variation_coefficient(F.col("sd"), F.col("mean"), F.col("med"), F.col("n")))
        inv = F.col("variable").isin(invert) if invert else F.lit(False)
        col = C.rule_color(F.col("variable"), F.col("proto"), F.col("p_low"), F.col("p_high"), inv,
                           F.col("direction"), F.col("g1"), F.col("g2"), F.col("r1"), F.col("r2"))
        gstd = F.col("g_std")
        z = F.when(~is_bin & gstd.isNotNull() & ~F.isnan(gstd) & (gstd != 0), (F.col("proto") - F.col("g_mean")) / gstd)
        pieces.append(long.select(
            "cluster", "variable",
            F.when(is_bin, F.lit("binary")).otherwise(F.lit("numeric")).alias("variable_type"),
            F.col("proto").alias("prototype_num"), F.lit(None).cast("string").alias("prototype_cat"),
            F.col("ref").alias("global_reference_num"), F.lit(None).cast("string").alias("global_reference_cat"),
            (F.col("proto") - F.col("ref")).alias("delta_vs_global"), z.alias("z_score_vs_global"),
            col["color"].alias("tlp_color"), col["polarity"].alias("tlp_polarity"), col["basis"].alias("tlp_color_basis"),
            unc.alias("uncertainty")))
    if categorical:
        cc = _cat_counts(df, cluster, categorical)
        tot = cc.groupBy("cluster", "variable").agg(F.sum("n").alias("tot"),
                                                    F.count(F.lit(1)).alias("levels"))
        ent = cc.join(tot, ["cluster", "variable"]).withColumn("p", F.col("n") / F.col("tot"))
        entropy = ent.groupBy("cluster", "variable", "levels").agg(
            (-F.sum(F.col("p") * F.log2(F.col("p") + F.lit(1e-12)))).alias("h"))
        entropy = entropy.select("cluster", "variable", F.when(F.col("levels") <= 1, F.lit(0.0))
                                 .otherwise(F.col("h") / F.log2(F.col("levels").cast("double"))).alias("uncertainty"))
        best = F.min_by(F.struct("value", "p"), F.struct((-F.col("n")).alias("neg"), F.col("value")))
        mode = ent.groupBy("cluster", "variable").agg(best.alias("b")).select(
            "cluster", "variable", F.col("b.value").alias("dominant"), F.col("b.p").alias("share"))
        cat = mode.join(entropy, ["cluster", "variable"]).join(F.broadcast(gcat), "variable")
        pieces.append(cat.select(
            "cluster", "variable", F.lit("categorical").alias("variable_type"),
            F.lit(None).cast("double").alias("prototype_num"), F.col("dominant").alias("prototype_cat"),
            F.lit(None).cast("double").alias("global_reference_num"), F.col("global_mode").alias("global_reference_cat"),
            (F.col("share") - F.col("global_mode_share")).alias("delta_vs_global"),
            F.lit(None).cast("double").alias("z_score_vs_global"),
            F.lit("yellow").alias("tlp_color"), F.lit("categorical_context").alias("tlp_polarity"),
            F.lit("mode_entropy").alias("tlp_color_basis"), "uncertainty"))
    out = reduce(lambda a, b: a.unionByName(b), pieces)
    u = F.col("uncertainty")
    out = out.select(
        "*", C.tlp_hex(F.col("tlp_color")).alias("tlp_color_hex"), C.darkening(u, k1, k2).alias("atlp_darkening"),
        C.clipped_uncertainty(u).alias("atlp_uncertainty_clipped"), C.atlp_hex(F.col("tlp_color"), u).alias("atlp_color_hex"),
        C.confidence(u, k1, k2).alias("confidence"))
    if severity is None:
        severity = add_severity_rank(df.groupBy(F.col(cluster).alias("cluster")).agg(
            F.count(F.lit(1)).alias("n_patients")), [])
    sev_cols = [c for c in ("cluster_label", "severity_rank") if c in severity.columns]
    out = out.join(F.broadcast(severity.select("cluster", *sev_cols)), "cluster", "left")
    if "cluster_label" not in sev_cols:
        out = out.withColumn("cluster_label", cluster_label(F.col("cluster")))
    if "severity_rank" not in sev_cols:
        out = out.withColumn("severity_rank", F.lit(None).cast("int"))
    return out.select(
        "cluster", "cluster_label", "severity_rank", "variable", "variable_type", "prototype_num", "prototype_cat",
        "global_reference_num", "global_reference_cat", "delta_vs_global", "z_score_vs_global", "tlp_color",
        "tlp_polarity", "tlp_color_basis", "tlp_color_hex", "atlp_darkening", "atlp_uncertainty_clipped",
        "atlp_color_hex", "uncertainty", "confidence",
    ).orderBy(F.asc_nulls_last("severity_rank"), "cluster", "variable_type", "variable")


def older_uncertainty(df: DataFrame, numeric: list[str], cluster: str = "cluster") -> DataFrame:
    """AG-36: the earlier release's numeric uncertainty per cluster × variable."""
    per = df.groupBy(F.col(cluster).alias("cluster")).agg(
        *[F.stddev_samp(F.col(c).cast("double")).alias(f"sd__{c}") for c in numeric],
        *[F.avg(F.col(c).cast("double")).alias(f"mean__{c}") for c in numeric],
        *[F.min(F.col(c).cast("double")).alias(f"min__{c}") for c in numeric],
        *[F.max(F.col(c).cast("double")).alias(f"max__{c}") for c in numeric],
        *[F.count(c).alias(f"n__{c}") for c in numeric])
    long = _melt_row(per, ["cluster"], numeric, {"sd": "double", "mean": "double", "min": "double", "max": "double", "n": "bigint"})
    spread = exact_quantiles(df.withColumn("cluster", F.col(cluster)), numeric, [0.25, 0.5, 0.75], ["cluster"])
    long = long.join(spread, ["cluster", "variable"], "left").withColumn("nd", F.coalesce("n_distinct", F.lit(0)))
    u = older_numeric_uncertainty(F.col("sd"), F.col("mean"), F.col("q")[1], F.col("q")[0], F.col("q")[2],
                                  F.col("min"), F.col("max"), F.col("nd"), F.col("n"))
    return long.select("cluster", "variable", u.alias("uncertainty"))


def validated_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-01: inner 1:1 join; raises if either side repeats a key or the result is empty.

    The checks are two grouped counts (keys are hash-partitioned, map-side combined)."""
    for side, name in ((left, "left"), (right, "right")):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{name} side repeats {key}")
    joined = left.join(right, key, "inner")
    if joined.limit(1).count() == 0:
        raise ValueError("join of cohort and assignments is empty")
    return joined


def assignments(df: DataFrame, summary: DataFrame, id_cols: list[str], cluster: str = "cluster") -> DataFrame:
    """JN-02 + SC-15: ids, row_id, cluster, label and the summary's severity rank
    (left join to a one-row-per-cluster table)."""
    keep = [c for c in id_cols if c in df.columns and c != "row_id"]
    a = df.select(*keep, "row_id", F.col(cluster).alias("cluster")).withColumn("cluster_label", cluster_label(F.col("cluster")))
    return a.join(F.broadcast(summary.select("cluster", "severity_rank")), "cluster", "left")
