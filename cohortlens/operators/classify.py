"""Risk classifier: exact stratified split, gradient-boosted trees, scoring,
threshold metrics and per-row / global / per-cluster explanations.

Metrics that need an ordering of scores (ROC AUC, average precision) work
on counts per distinct score, ranked with the distributed prefix sum of
``ranks.ranked_value_counts``; nothing sorts all rows in one task.
Explanations work on a long contributions table (key, feature, value).
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import boosting
from .ranks import ranked_value_counts

# Risk band cut points and the decision threshold.
RISK_LOW = 0.20
RISK_HIGH = 0.60
THRESHOLD = 0.5


def seeded_hash(key: Column, seed: int) -> Column:
    """52-bit number from md5(key|seed): exact in a double, identical in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", key.cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double")


def stratified_split(df: DataFrame, key: str, label: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """ML-14: exactly ceil(test_fraction · n_y) rows of every class go to the test set,
    chosen by the seeded hash (ties by key).  Adds ``is_test``.

    The per-class ordering is a distributed prefix count (no class-wide window)."""
    h = df.select(key, label, seeded_hash(F.col(key), seed).alias("__h")).withColumn("__one", F.lit(1))
    ranked = ranked_value_counts(h, [label], "__h", "__one", tie_break=[key])
    sizes = df.groupBy(label).agg(F.ceil(F.count(F.lit(1)) * test_fraction).alias("__cut"))  # one row per class
    flags = ranked.join(F.broadcast(sizes), label).select(key, (F.col("before") < F.col("__cut")).alias("is_test"))
    return df.join(flags, key)


def risk_band(p: Column, low: float = RISK_LOW, high: float = RISK_HIGH) -> Column:
    """PRJ-16: low (< low), medium (< high), high."""
    return F.when(p < low, "low").when(p < high, "medium").otherwise("high")


def predicted_label(p: Column, threshold: float = THRESHOLD) -> Column:
    """PRJ-17."""
    return (p >= threshold).cast("int")


def fit_gbt(train: DataFrame, label: str, features: str = "features", weight: str | None = None, max_iter: int = 300,
            max_depth: int = 4, step: float = 0.05, subsample: float = 0.85, colsample: float = 0.85,
            min_instances: int = 3, seed: int = 42):
    """ML-15: logistic gradient-boosted trees (Spark GBT, fitted by ``boosting``; see README for parity notes)."""
    gbt = GBTClassifier(featuresCol=features, labelCol=label, maxIter=max_iter, maxDepth=max_depth, stepSize=step,
                        subsamplingRate=subsample, featureSubsetStrategy=str(colsample), minInstancesPerNode=min_instances,
                        seed=seed, lossType="logistic", maxBins=64)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return boosting.fit(gbt, train)


def score(model, df: DataFrame, keep: list[str], features: str = "features") -> DataFrame:
    """ML-16: probability of class 1, predicted label and risk band."""
    out = model.transform(df).withColumn("predicted_probability", vector_to_array("probability")[1])
    p = F.col("predicted_probability")
    return out.select(*keep, "predicted_probability", predicted_label(p).alias("predicted_label"),
                      risk_band(p).alias("predicted_risk_group"))


def with_class_weight(df: DataFrame, label: str, pos_weight: float, out: str = "weight") -> DataFrame:
    return df.withColumn(out, F.when(F.col(label) == 1, F.lit(float(pos_weight))).otherwise(F.lit(1.0)))


def to_features(df: DataFrame, col: str = "features") -> DataFrame:
    return df.withColumn(col, array_to_vector(col))


# ------------------------------------------------------------------ metrics --

def _score_counts(scored: DataFrame, label: str, prob: str) -> DataFrame:
    return scored.groupBy(prob).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))


def roc_auc(scored: DataFrame, label: str = "true_label", prob: str = "predicted_probability") -> DataFrame:
    """MT-01: Mann-Whitney AUC with average ranks for tied scores."""
    c = ranked_value_counts(_score_counts(scored, label, prob), [], prob, "n")
    s = c.agg(F.sum(F.col("pos") * F.col("avg_rank")).alias("r1"), F.sum("pos").alias("n1"), F.sum("n").alias("nn"))
    n0 = F.col("nn") - F.col("n1")
    return s.select(((F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)).alias("roc_auc"))


def average_precision(scored: DataFrame, label: str = "true_label", prob: str = "predicted_probability") -> DataFrame:
    """MT-02: Σ (R_k - R_{k-1}) · P_k over distinct score thresholds, descending.

    Two distributed prefix sums over the distinct scores (rows and positives at or
    above each threshold)."""
    c = _score_counts(scored, label, prob)
    rows_above = ranked_value_counts(c.select(prob, "n"), [], prob, "n", descending=True) \
        .select(prob, (F.col("before") + F.col("n")).alias("cum_n"))
    pos_above = ranked_value_counts(c.select(prob, "pos"), [], prob, "pos", descending=True) \
        .select(prob, "pos", (F.col("before") + F.col("pos")).alias("cum_pos"))
    t = rows_above.join(pos_above, prob).where(F.col("pos") > 0)
    n1 = float(c.agg(F.sum("pos")).first()[0] or 0)  # one number: inlined, no join
    return t.agg(F.sum(F.col("pos") / F.lit(n1) * (F.col("cum_pos") / F.col("cum_n"))).alias("average_precision"))


def brier(scored: DataFrame, label: str = "true_label", prob: str = "predicted_probability") -> DataFrame:
    """MT-03."""
    return scored.agg(F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier_score"))


def log_loss(scored: DataFrame, label: str = "true_label", prob: str = "predicted_probability",
             eps: float = 2.220446049250313e-16) -> DataFrame:
    """MT-04: mean negative log-likelihood with p clipped to [eps, 1 - eps]."""
    p = F.least(F.greatest(F.col(prob), F.lit(eps)), F.lit(1 - eps))
    y = F.col(label)
    return scored.agg(F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p))).alias("log_loss"))


def classification_report(scored: DataFrame, label: str = "true_label", pred: str = "predicted_label") -> DataFrame:
    """MT-05: precision / recall / F1 / support per class, accuracy, macro and weighted
    averages; 0 where a denominator is 0."""
    cm = scored.groupBy(F.col(label).cast("int").alias("y"), F.col(pred).cast("int").alias("p")).agg(
        F.count(F.lit(1)).alias("n"))
    per = (cm.groupBy().agg(*[F.sum(F.when((F.col("y") == a) & (F.col("p") == b), F.col("n")).otherwise(0)).alias(f"c{a}{b}")
                              for a in (0, 1) for b in (0, 1)]))

    def safe(num, den):
        return F.when(den == 0, F.lit(0.0)).otherwise(num / den)
    rows = []
    for cls in (0, 1):
        other = 1 - cls
        tp, fp, fn = F.col(f"c{cls}{cls}"), F.col(f"c{other}{cls}"), F.col(f"c{cls}{other}")
        prec, rec = safe(tp, tp + fp), safe(tp, tp + fn)
        rows.append(F.struct(F.lit(str(cls)).alias("label"), prec.alias("precision"), rec.alias("recall"),
                             safe(2 * prec * rec, prec + rec).alias("f1_score"), (tp + fn).cast("double").alias("support")))
    base = per.select(F.array(*rows).alias("r"), (F.col("c00") + F.col("c11")).alias("ok"),
                      (F.col("c00") + F.col("c01") + F.col("c10") + F.col("c11")).alias("tot"))
    r0, r1 = F.col("r")[0], F.col("r")[1]
    macro = F.struct(F.lit("macro avg").alias("label"), ((r0["precision"] + r1["precision"]) / 2).alias("precision"),
                     ((r0["recall"] + r1["recall"]) / 2).alias("recall"), ((r0["f1_score"] + r1["f1_score"]) / 2).alias("f1_score"),
                     F.col("tot").cast("double").alias("support"))

    def wavg(f):
        return safe(r0[f] * r0["support"] + r1[f] * r1["support"], F.col("tot").cast("double"))
    weighted = F.struct(F.lit("weighted avg").alias("label"), wavg("precision").alias("precision"), wavg("recall").alias("recall"),
                        wavg("f1_score").alias("f1_score"), F.col("tot").cast("double").alias("support"))
    acc = safe(F.col("ok").cast("double"), F.col("tot").cast("double"))
    accuracy = F.struct(F.lit("accuracy").alias("label"), acc.alias("precision"), acc.alias("recall"), acc.alias("f1_score"),
                        F.col("tot").cast("double").alias("support"))
    return base.select(F.explode(F.array(r0, r1, accuracy, macro, weighted)).alias("s")).select("s.*")


# ------------------------------------------------------------- explanations --

def simplify_feature_name(name: Column) -> Column:
    """SC-17: strip a leading 'num__' / 'cat__'."""
    return F.regexp_replace(name, "^(num|cat)__", "")


def global_importance(contrib: DataFrame) -> DataFrame:
    """AG-34: mean |contribution| and mean signed contribution per feature."""
    return contrib.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_contribution"),
                                          F.avg("value").alias("mean_signed_contribution")).orderBy(
        F.desc("mean_abs_contribution"), "feature")


def top_features(contrib: DataFrame, key: str, top_n: int = 5) -> DataFrame:
    """WN-06: per row, the top-n strictly positive (largest first) and strictly negative
    (most negative first) contributions rendered 'name (+0.1234)', 'none' if empty.
    Each row's list has one entry per model feature (bounded by the feature count)."""
    items = contrib.groupBy(key).agg(F.collect_list(F.struct("value", "feature")).alias("items"))

    def render(arr):
        return F.when(F.size(arr) == 0, F.lit("none")).otherwise(
            F.array_join(F.transform(arr, lambda s: F.format_string("%s (%+.4f)", s["feature"], s["value"])), ", "))
    pos = F.slice(F.reverse(F.array_sort(F.filter("items", lambda s: s["value"] > 0))), 1, top_n)
    neg = F.slice(F.array_sort(F.filter("items", lambda s: s["value"] < 0)), 1, top_n)
    return items.select(key, render(pos).alias("top_positive_features"), render(neg).alias("top_negative_features"))


def cluster_explanations(scored: DataFrame, contrib: DataFrame, key: str, top_n: int = 5) -> DataFrame:
    """AG-35: per cluster label: test rows, observed rate, mean probability and the top-n
    features by mean |contribution| 'name (0.1234)'."""
    base = scored.where(F.col("cluster_label").isNotNull())
    head = base.groupBy("cluster_label").agg(
        F.min("cluster").alias("cluster"), F.min("severity_rank").alias("severity_rank"),
        F.count(F.lit(1)).alias("n_patients_test"), F.avg("true_label").alias("observed_mortality_test"),
        F.avg("predicted_probability").alias("mean_predicted_probability"))
    imp = contrib.join(base.select(key, "cluster_label"), key).groupBy("cluster_label", "feature").agg(
        F.avg(F.abs("value")).alias("m"))
    lists = imp.groupBy("cluster_label").agg(F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("neg"), "feature", "m"))).alias("l"))
    txt = F.array_join(F.transform(F.slice("l", 1, top_n), lambda s: F.format_string("%s (%.4f)", s["feature"], s["m"])), ", ")
    return head.join(lists.select("cluster_label", txt.alias("top_explanatory_features")), "cluster_label", "left")


def summary_sentence(df: DataFrame) -> Column:
    """SC-18: one explanation sentence per scored row (cluster part only when present)."""
    cluster_part = F.when(F.col("cluster_label").isNotNull(), F.concat(
        F.lit("Clinical severity cluster: "), F.col("cluster_label"),
        F.when(F.col("severity_rank").isNotNull(), F.format_string(" (severity rank %d)", F.col("severity_rank").cast("int")))
        .otherwise(F.lit("")), F.lit("."))) if "cluster_label" in df.columns else F.lit(None)
    return F.concat_ws(" ",
                       F.format_string("Predicted mortality risk: %.3f (%s).", F.col("predicted_probability"), F.col("predicted_risk_group")),
                       cluster_part,
                       F.concat(F.lit("Main factors increasing risk: "), F.col("top_positive_features"), F.lit(".")),
                       F.concat(F.lit("Main factors decreasing risk: "), F.col("top_negative_features"), F.lit(".")),
                       # Fixed value: closing sentence of the summary.
                       F.lit("Use this together with the sepsis knowledge base to propose monitoring or treatment actions."))


# Column order of the per-row context output.
CONTEXT_ORDER = ["row_id", "subject_id", "hadm_id", "stay_id", "predicted_probability", "predicted_risk_group", "true_label",
                 "cluster", "cluster_label", "severity_rank", "top_positive_features", "top_negative_features", "llm_summary"]


def ordered_projection(df: DataFrame, order: list[str] = CONTEXT_ORDER) -> DataFrame:
    """PRJ-13: the listed columns that exist, in that order."""
    return df.select(*[c for c in order if c in df.columns])
