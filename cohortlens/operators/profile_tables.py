"""Tables derived from the aTLP summary and the cluster profiles: categorical
context view, pivots, feature lists, family votes, phenotype names, profile
table and report lines.  Inputs have (clusters × variables) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Clinical feature families used to name phenotypes.
FEATURE_FAMILIES = {
    "renal_metabolic": ["creatinine_max", "creatinine_min", "creatinine_score", "bun_max", "bun_min", "bun_score",
                        "urineoutput", "uo_score", "sodium_min", "sodium_max", "glucose_max", "glucose_min"],
    "neurologic": ["gcs_score", "gcs_motor", "gcs_verbal", "gcs_eyes", "gcs_unable"],
    "inflammatory": ["temp_score", "temperature_max", "temperature_min", "wbc_score", "wbc_max", "wbc_min",
                     "resp_rate_score", "resp_rate_max", "resp_rate_min", "heart_rate_max", "heart_rate_min", "hr_score"],
    "hemodynamic": ["mbp_score", "mbp_min", "mbp_max"],
    "severity": ["apsiii", "apsiii_prob", "sepsis3", "admission_age"],
    # each frailty member counts twice (see FAMILY_WEIGHT)
    "frailty": ["admission_age"],
}
FAMILY_ORDER = ["renal_metabolic", "neurologic", "inflammatory", "hemodynamic", "severity", "frailty"]
FAMILY_WEIGHT = {"frailty": 2}

# Summary means quoted in the clinical snapshot, in order.
SNAPSHOT_FEATURES = ["apsiii", "admission_age", "creatinine_max", "bun_max", "mbp_min", "temperature_max",
                     "urineoutput", "gcs_score"]


def families_frame(spark: SparkSession, families: dict[str, list[str]] = FEATURE_FAMILIES) -> DataFrame:
    rows = [(fam, feat, FAMILY_WEIGHT.get(fam, 1)) for fam, feats in families.items() for feat in feats]
    return spark.createDataFrame(rows, "family string, variable string, weight int")


def categorical_context(atlp: DataFrame) -> DataFrame:
    """AG-25: categorical rows of the aTLP summary under context names."""
    return atlp.where(F.col("variable_type") == "categorical").select(
        "cluster", "cluster_label", "severity_rank", "variable",
        F.col("prototype_cat").alias("dominant_category"), F.col("global_reference_cat").alias("global_mode"),
        F.col("delta_vs_global").alias("dominant_share_delta"), "uncertainty", "confidence")


def pivot_atlp(atlp: DataFrame, measure: str, variables: list[str]) -> DataFrame:
    """AG-37: cluster × variable grid of one measure for numeric/binary rows
    (variables listed explicitly so the pivot needs no extra pass)."""
    nb = atlp.where(F.col("variable_type").isin("numeric", "binary"))
    return nb.groupBy("cluster_label").pivot("variable", variables).agg(F.first(measure))


def top_feature_lists(profiles: DataFrame, top_n: int) -> DataFrame:
    """WN-05 + SC-14: per cluster, the ordered top-n high/low variables and the
    rendered list 'var (+0.123), ...' ('none' when empty)."""
    w = W.partitionBy("cluster", "direction").orderBy(
        F.when(F.col("direction") == "low", F.col("delta_vs_global")).otherwise(-F.col("delta_vs_global")), "variable")
    ranked = profiles.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_n)
    item = F.struct(F.col("k"), F.col("variable"), F.col("delta_vs_global"))
    lists = ranked.groupBy("cluster", "direction").agg(F.array_sort(F.collect_list(item)).alias("items"))
    rendered = F.array_join(F.transform("items", lambda s: F.format_string("%s (%+.3f)", s["variable"], s["delta_vs_global"])), ", ")
    return lists.select("cluster", "direction", F.transform("items", lambda s: s["variable"]).alias("features"),
                        rendered.alias("rendered"))


def family_votes(features: Column, families: dict[str, list[str]] | None = None) -> Column:
    """AG-39 (expression form): struct of votes per family for an array of feature names.

    Family membership is fixed data (small), inlined into the expression."""
    fam = families or FEATURE_FAMILIES
    fields = []
    for name in FAMILY_ORDER:
        members = fam.get(name, [])
        weight = FAMILY_WEIGHT.get(name, 1)
        uniq = sorted(set(members))
        votes = F.size(F.filter(features, lambda f: f.isin(uniq))) if uniq else F.lit(0)
        fields.append((votes * weight).alias(name))
    return F.struct(*fields)


def family_votes_table(profiles_features: DataFrame, families: DataFrame) -> DataFrame:
    """AG-39 (table form): explode features, join the family table, sum votes."""
    ex = profiles_features.select("cluster", F.explode("features").alias("variable"))
    return ex.join(F.broadcast(families), "variable").groupBy("cluster", "family").agg(
        F.sum("weight").cast("bigint").alias("votes"))


def _mean(summary_cols: list[str], feature: str) -> Column:
    name = f"mean_{feature}"
    return F.col(name).cast("double") if name in summary_cols else F.lit(None).cast("double")


def phenotype_name(votes: Column, low: Column, severity_rank: Column, summary_cols: list[str]) -> Column:
    """SC-12: ordered decision list on family votes, severity rank and summary means."""
    age, aps, crea, bun, temp, gcs = (_mean(summary_cols, f) for f in
                                      ("admission_age", "apsiii", "creatinine_max", "bun_max", "temperature_max", "gcs_score"))
    rank = severity_rank.cast("int")
    low_key = F.arrays_overlap(low, F.array(*[F.lit(x) for x in ["apsiii", "creatinine_max", "bun_max", "sepsis3", "gcs_score"]]))
    gt = F.coalesce  # null-safe helper: a missing mean never satisfies a condition

    def cond(c):
        return gt(c, F.lit(False))
    return (
        F.when(cond((rank >= 4) & (aps < 35) & low_key), "stable_low_severity")
        .when((votes["renal_metabolic"] >= 2) & (votes["severity"] >= 1), "renal_metabolic_high_severity")
        .when((votes["neurologic"] >= 1) & (votes["inflammatory"] >= 1) & (votes["severity"] >= 1)
              & (cond(gcs >= 10) | cond(rank.isin(1, 2)) | cond(temp >= 37.4)), "neurologic_inflammatory_high_severity")
        .when(cond((age >= 70) & (aps < 45)), "older_frail_lower_severity")
        .when(cond(age >= 67) & (cond((aps >= 45) & (aps < 55)) | cond(bun >= 25) | cond(crea >= 1.2)),
              "older_intermediate_moderate_severity")
        .when((votes["hemodynamic"] >= 2) & (votes["severity"] >= 1), "hemodynamic_instability")
        .when(cond(rank >= 5), "stable_low_severity")
        .when(votes["severity"] >= 2, "moderate_to_high_severity")
        .when(cond(rank >= 4), "mixed_lower_severity")
        .otherwise("mixed_intermediate"))


def clinical_snapshot(summary_cols: list[str], features: list[str] = SNAPSHOT_FEATURES) -> Column:
    """SC-13: 'feature=12.34, ...' for the summary means that exist and are not null."""
    parts = [F.when(_mean(summary_cols, f).isNotNull(), F.format_string(f"{f}=%.2f", _mean(summary_cols, f)))
             for f in features if f"mean_{f}" in summary_cols]
    return F.concat_ws(", ", *parts) if parts else F.lit("")


def profile_table(summary: DataFrame, profiles: DataFrame, top_n: int = 5,
                  explain_summary: DataFrame | None = None, families: dict[str, list[str]] | None = None,
                  snapshot: list[str] = SNAPSHOT_FEATURES) -> DataFrame:
    """build_profile_table: one row per cluster with phenotype name, top feature
    lists, snapshot and (optionally) the classifier's per-cluster context joined by
    label (first match per label, JN-06)."""
    lists = top_feature_lists(profiles, top_n)
    hi = lists.where("direction = 'high'").select("cluster", F.col("features").alias("high"), F.col("rendered").alias("top_high_features"))
    lo = lists.where("direction = 'low'").select("cluster", F.col("features").alias("low"), F.col("rendered").alias("top_low_features"))
    cols = summary.columns
    t = summary.join(hi, "cluster", "left").join(lo, "cluster", "left")
    empty = F.array().cast("array<string>")
    high = F.coalesce(F.col("high"), empty)
    low = F.coalesce(F.col("low"), empty)
    out = t.select(
        "cluster", F.coalesce(F.col("cluster_label"), F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))).alias("cluster_label"),
        phenotype_name(family_votes(high, families), low, F.col("severity_rank"), cols).alias("phenotype_name"),
        "severity_rank", "n_patients", "size_pct",
        F.coalesce("top_high_features", F.lit("none")).alias("top_high_features"),
        F.coalesce("top_low_features", F.lit("none")).alias("top_low_features"),
        clinical_snapshot(cols, snapshot).alias("clinical_snapshot"),
        *([F.col("mortality_rate").alias("clustering_mortality_rate")] if "mortality_rate" in cols else []))
    if explain_summary is not None:
        first = explain_summary.withColumn("__r", F.row_number().over(
            W.partitionBy("cluster_label").orderBy(F.monotonically_increasing_id()))).where("__r = 1").drop("__r", "cluster", "severity_rank")
        ren = {c: f"xgb_{c}" for c in first.columns if c != "cluster_label"}
        out = out.join(F.broadcast(first.withColumnsRenamed(ren)), "cluster_label", "left")
    return out


def report_lines(profile: DataFrame) -> DataFrame:
    """SC-22: report block per cluster as an array of lines (ordered by severity rank)."""
    title = F.concat_ws(" | ", "cluster_label", "phenotype_name")
    lines = F.array(
        title, F.repeat(F.lit("-"), F.greatest(F.lit(12), F.length(title))),
        F.concat(F.lit("Severity rank: "), F.coalesce(F.col("severity_rank").cast("string"), F.lit("nan"))),
        F.format_string("Patients: %d (%.2f%%)", F.col("n_patients"), F.col("size_pct") * 100),
        F.concat(F.lit("Clinical snapshot: "), F.col("clinical_snapshot")),
        F.concat(F.lit("Top high features: "), F.col("top_high_features")),
        F.concat(F.lit("Top low features: "), F.col("top_low_features")),
    )
    return profile.select("cluster", "severity_rank", lines.alias("lines"))


def salient_cells(atlp: DataFrame, n: int = 3) -> DataFrame:
    """WN-07: per cluster the n highest-z, n lowest-z and n most uncertain numeric/binary cells.
    Null z sorts last in both directions (pandas ``sort_values`` semantics)."""
    nb = atlp.where(F.col("variable_type").isin("numeric", "binary"))
    part = W.partitionBy("cluster")
    hi = F.row_number().over(part.orderBy(F.desc_nulls_last("z_score_vs_global"), "variable"))
    lo = F.row_number().over(part.orderBy(F.asc_nulls_last("z_score_vs_global"), "variable"))
    un = F.row_number().over(part.orderBy(F.desc_nulls_last("uncertainty"), "variable"))
    r = nb.select("cluster", "variable", "prototype_num", "z_score_vs_global", "uncertainty", "tlp_color", "confidence",
                  hi.alias("rh"), lo.alias("rl"), un.alias("ru"))
    return (r.where(F.col("rh") <= n).select("cluster", F.lit("salient_high").alias("kind"), F.col("rh").alias("position"), "variable")
            .unionByName(r.where(F.col("rl") <= n).select("cluster", F.lit("salient_low").alias("kind"), F.col("rl").alias("position"), "variable"))
            .unionByName(r.where(F.col("ru") <= n).select("cluster", F.lit("most_uncertain").alias("kind"), F.col("ru").alias("position"), "variable")))
