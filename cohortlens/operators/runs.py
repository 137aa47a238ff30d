"""Runs from cohort to stored outputs, and the bundles that later requests load.

``clustering_run`` prepares, reduces, sweeps, ranks, picks the best experiment and writes every output under one folder,
keyed by ``run_id``.  Row counts and null counts come from ``DataFrame.observe`` while the outputs are written, so the
record states what the run did.  ``Bundle.load`` checks that every part is there (a missing one is named) and reads
fitted parameters and tables back; ``Bundle.assign`` places new rows by the stored reference.

``training_run`` splits, prepares, fits, scores, evaluates and explains a risk classifier the same way; ``Classifier`` is
its bundle, scores and explains new rows, and ``case_contexts`` joins both bundles' answers into one context per row.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import assign, classify, cluster, explain, profile
from .context import case_context
from .features import Preprocessor, Reducer

PARTS = ("preprocessor", "reducer", "reference", "experiments", "profile", "stages")


class MissingPart(FileNotFoundError):
    """A part of a bundle is not in its folder."""


def _text(spark: SparkSession, path: str, text: str) -> None:
    spark.createDataFrame([(text,)], "params string").coalesce(1).write.mode("overwrite").json(path)


def _read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    try:
        return (spark.read.json if name in ("preprocessor", "reducer") else spark.read.parquet)(f"{folder}/{name}")
    except AnalysisException as error:
        raise MissingPart(f"the bundle in {folder} has no {name}") from error


def _observed(df: DataFrame, path: str, watch: list[str]) -> dict:
    """Write ``df`` and return its rows and the nulls of the watched columns, counted on the way."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in watch]
               ).write.mode("overwrite").parquet(path)
    found = seen.get
    return {"rows": found["rows"], "nulls": {c: found[f"null {c}"] for c in watch}}


def clustering_run(df: DataFrame, folder: str, run_id: str, numeric: list[str], categorical: list[str], key: str = "row_id",
                   target: str | None = None, max_components: int = 15, seed: int = 42, **sweep) -> "Bundle":
    """Fit on ``df`` and write preprocessor, reducer, reference (key, embedding, cluster), experiments (ranked), profile (one
    row per cluster, with label and severity) and stages (what each step read, wrote and chose).  ``sweep`` has the
    parameters of ``cluster.sweep``."""
    spark = df.sparkSession
    stages: list[tuple] = []

    def done(stage: str, rows: int, columns: list[str], facts: dict) -> None:
        stages.append((run_id, len(stages), stage, rows, columns, json.dumps(facts, sort_keys=True, default=str)))

    prepared = Preprocessor.fit(df, numeric, categorical)
    _text(spark, f"{folder}/preprocessor", prepared.to_json())
    kept = [key, *([target] if target else [])]
    cohort_path = f"{folder}/work/prepared"
    facts = _observed(df.select(*kept, *numeric, *categorical), f"{folder}/work/input", [*numeric, *categorical])
    done("input", facts["rows"], [*numeric, *categorical], {"nulls": facts["nulls"]})
    features = prepared.transform(spark.read.parquet(f"{folder}/work/input"), kept)
    facts = _observed(features, cohort_path, ["features"])
    done("prepare", facts["rows"], prepared.feature_names, {"features": len(prepared.feature_names)})
    features = spark.read.parquet(cohort_path)
    reducer = Reducer.fit(features, "features", len(prepared.feature_names), facts["rows"], max_components)
    _text(spark, f"{folder}/reducer", json.dumps(asdict(reducer)))
    facts = _observed(reducer.transform(features, "features", kept), f"{folder}/work/reduced", ["embedding"])
    done("reduce", facts["rows"], [f"component_{i}" for i in range(len(reducer.mean))], {"max_components": max_components})
    reduced = spark.read.parquet(f"{folder}/work/reduced")
    emb = reduced.select(key, "embedding")
    found, labels = cluster.sweep(emb, reduced.select(*kept) if target else None, key=key, target=target, seed=seed, **sweep)
    ranked = cluster.rank_experiments(found)
    facts = _observed(ranked, f"{folder}/experiments", ["silhouette"])
    experiments = spark.read.parquet(f"{folder}/experiments")
    done("sweep", facts["rows"], experiments.columns, {"seed": seed, "without_silhouette": facts["nulls"]["silhouette"]})
    best = experiments.orderBy(F.desc_nulls_last("selection_score"), F.desc_nulls_last("silhouette"), F.desc_nulls_last("coverage"), "experiment_id").first()
    facts = _observed(reduced.join(labels[best["experiment_id"]], key), f"{folder}/reference", ["cluster"])
    done("best", facts["rows"], [key, "embedding", "cluster"], {"experiment_id": best["experiment_id"], "config": json.loads(best["config"]),
                                                               "selection_score": best["selection_score"]})
    reference = spark.read.parquet(f"{folder}/reference")
    facts = _observed(profile.cluster_summary(reference.select("cluster", *kept[1:]).withColumnRenamed(target, "target") if target else reference.select("cluster"),
                                              "cluster", "target" if target else None), f"{folder}/profile", ["severity_rank"])
    done("profile", facts["rows"], ["cluster", "n_patients", "cluster_label", "size_pct", "severity_rank"], {"target": target})
    spark.createDataFrame(stages, "run_id string, step int, stage string, rows long, columns array<string>, facts string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stages")
    return Bundle.load(spark, folder)


@dataclass
class Bundle:
    """The stored outputs of a run."""

    preprocessor: Preprocessor
    reducer: Reducer
    reference: DataFrame
    experiments: DataFrame
    profile: DataFrame
    stages: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Bundle":
        parts = {name: _read(spark, folder, name) for name in PARTS}
        return cls(Preprocessor.from_json(parts["preprocessor"].first()["params"]),
                   Reducer(**json.loads(parts["reducer"].first()["params"])), *[parts[n] for n in PARTS[2:]])

    def embed(self, rows: DataFrame, key: str = "row_id") -> DataFrame:
        return self.reducer.transform(self.preprocessor.transform(rows, [key]), "features", [key])

    def assign(self, rows: DataFrame, key: str = "row_id", k: int = 15) -> DataFrame:
        """ML-18: embed new rows, vote among the nearest reference rows, and add the cluster's profile."""
        reference = self.reference.select(F.col(key).alias("ref_id"), "embedding", "cluster")
        return assign.assign_clusters(self.embed(rows, key), reference, key, "ref_id", k, self.profile)


CLASSIFIER_PARTS = ("preprocessor", "model", "scored", "metrics", "report", "contributions", "importance", "cases", "clusters", "stages")


def evaluate(scored: DataFrame) -> DataFrame:
    """MT-01 to MT-04, one row of (metric, value) each; ``scored`` has true_label and predicted_probability."""
    tables = [classify.roc_auc(scored), classify.average_precision(scored), classify.brier(scored), classify.log_loss(scored)]
    rows = [t.select(F.lit(t.columns[0]).alias("metric"), F.col(t.columns[0]).cast("double").alias("value")) for t in tables]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def _explained(scored: DataFrame, contributions: DataFrame, key: str, top_n: int) -> DataFrame:
    """Scored rows with their bias, top features (WN-06) and summary sentence (SC-18)."""
    named = contributions.withColumn("feature", classify.simplify_feature_name(F.col("feature")))
    tops = classify.top_features(named.filter("feature <> 'bias'"), key, top_n)
    rows = scored.join(named.filter("feature = 'bias'").select(key, F.col("value").alias("base_value")), key).join(tops, key)
    return rows.withColumn("llm_summary", classify.summary_sentence(rows))


def training_run(df: DataFrame, folder: str, run_id: str, numeric: list[str], categorical: list[str], target: str, key: str = "row_id",
                 test_fraction: float = 0.2, seed: int = 42, context: DataFrame | None = None, top_n: int = 5, **trees) -> "Classifier":
    """Fit a classifier of ``target`` (0/1; rows where it is null are left out) on ``df`` and write every output.

    Outputs are the preprocessor, the model, scored (test rows: key, true_label, probability, label, risk group and
    ``context``'s columns), metrics and report on the test rows, contributions (long), importance, cases (scored rows with top
    features and summary), clusters (test rows and top features per cluster label; empty without ``context``) and stages.
    ``context`` (key, cluster, cluster_label, severity_rank) joins what was scored and is never a feature; repeated keys in it
    count once.  ``trees`` has the parameters of ``classify.fit_gbt``.  Without rows of both classes ValueError is raised."""
    spark = df.sparkSession
    stages: list[tuple] = []

    def done(stage: str, rows: int, columns: list[str], facts: dict) -> None:
        stages.append((run_id, len(stages), stage, rows, columns, json.dumps(facts, sort_keys=True, default=str)))

    def kept(rows: DataFrame, name: str, watch: list[str]) -> tuple[DataFrame, dict]:
        facts = _observed(rows, f"{folder}/{name}", watch)
        return spark.read.parquet(f"{folder}/{name}"), facts

    used = df.select(key, F.col(target).cast("int").alias("target"), *numeric, *categorical).filter("target is not null")
    split, facts = kept(classify.stratified_split(used, key, "target", test_fraction, seed), "work/split", [*numeric, *categorical])
    sides = {(r["is_test"], r["target"]): r["n"] for r in split.groupBy("is_test", "target").agg(F.count("*").alias("n")).collect()}
    n0, n1 = sides.get((False, 0), 0), sides.get((False, 1), 0)
    if not n0 or not n1:
        raise ValueError(f"training rows of both classes are needed, not {n0} of class 0 and {n1} of class 1")
    done("split", facts["rows"], [*numeric, *categorical],
         {"nulls": facts["nulls"], "train": n0 + n1, "test": facts["rows"] - n0 - n1, "test_fraction": test_fraction, "seed": seed})
    prepared = Preprocessor.fit(split.filter("not is_test"), numeric, categorical)
    _text(spark, f"{folder}/preprocessor", prepared.to_json())
    ready, facts = kept(prepared.transform(split, [key, "target", "is_test"]), "work/prepared", ["features"])
    done("prepare", facts["rows"], prepared.feature_names, {"features": len(prepared.feature_names)})
    weight = n0 / n1
    train = classify.to_features(classify.with_class_weight(ready.filter("not is_test"), "target", weight))
    model = classify.fit_gbt(train, "target", weight="weight", seed=seed, **trees)
    model.write().overwrite().save(f"{folder}/model")
    done("fit", n0 + n1, prepared.feature_names, {"trees": model.getNumTrees, "positive_weight": weight, **trees})
    test = classify.to_features(ready.filter("is_test"))
    rows = classify.score(model, test, [key, F.col("target").alias("true_label")])
    around = ["cluster", "cluster_label", "severity_rank"]
    if context is not None:
        rows = rows.join(context.select(key, *around).dropDuplicates([key]), key, "left")
    scored, facts = kept(rows, "scored", ["predicted_probability", *(around if context is not None else [])])
    done("score", facts["rows"], scored.columns, {"nulls": facts["nulls"]})
    metrics, facts = kept(evaluate(scored), "metrics", ["value"])
    done("evaluate", facts["rows"], metrics.columns, {r["metric"]: r["value"] for r in metrics.collect()})
    kept(classify.classification_report(scored), "report", ["f1_score"])
    contributions, facts = kept(explain.contributions(spark, model, test, key, prepared.feature_names), "contributions", ["value"])
    done("contributions", facts["rows"], contributions.columns, {"features": len(prepared.feature_names)})
    of_features = contributions.filter("feature <> 'bias'").withColumn("feature", classify.simplify_feature_name(F.col("feature")))
    kept(classify.global_importance(of_features), "importance", ["mean_abs_contribution"])
    order = list(dict.fromkeys([key, *classify.CONTEXT_ORDER, "predicted_label", "base_value"]))
    cases, facts = kept(classify.ordered_projection(_explained(scored, contributions, key, top_n), order), "cases", ["llm_summary"])
    done("cases", facts["rows"], cases.columns, {"top_n": top_n})
    bare = scored if context is not None else scored.select("*", *[F.lit(None).cast(t).alias(c) for c, t in zip(around, ("int", "string", "int"))])
    _, facts = kept(classify.cluster_explanations(bare, of_features, key, top_n), "clusters", ["top_explanatory_features"])
    done("clusters", facts["rows"], around, {"as_feature": False})
    spark.createDataFrame(stages, "run_id string, step int, stage string, rows long, columns array<string>, facts string").coalesce(1).write.mode("overwrite").parquet(f"{folder}/stages")
    return Classifier.load(spark, folder)


@dataclass
class Classifier:
    """The stored outputs of a training run."""

    preprocessor: Preprocessor
    model: GBTClassificationModel
    scored: DataFrame
    metrics: DataFrame
    report: DataFrame
    contributions: DataFrame
    importance: DataFrame
    cases: DataFrame
    clusters: DataFrame
    stages: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> "Classifier":
        """Read all parts; one that is not there raises ``MissingPart`` with its name."""
        _read(spark, folder, "model/data")  # GBTClassificationModel.load has no error of its own for a missing folder
        parts = {name: _read(spark, folder, name) for name in CLASSIFIER_PARTS if name != "model"}
        return cls(Preprocessor.from_json(parts["preprocessor"].first()["params"]), GBTClassificationModel.load(f"{folder}/model"),
                   *[parts[n] for n in CLASSIFIER_PARTS[2:]])

    def explain(self, rows: DataFrame, key: str = "row_id", top_n: int = 5) -> DataFrame:
        """Probability, label, risk group, base value, top features and summary of new rows."""
        ready = classify.to_features(self.preprocessor.transform(rows, [key]))
        found = explain.contributions(rows.sparkSession, self.model, ready, key, self.preprocessor.feature_names)
        return _explained(classify.score(self.model, ready, [key]), found, key, top_n)


def case_contexts(rows: DataFrame, classifier: Classifier, clusters: Bundle, ids: list[str], features: list[str], key: str = "row_id",
                  k: int = 15, top_n: int = 5) -> DataFrame:
    """SC-19: ``rows`` with the classifier's answer, the cluster assignment with all neighbours' votes, the cluster's profile,
    and ``prompt_json``, the context as JSON.  ``key`` must be unique and not null."""
    placed = clusters.assign(rows, key, k).withColumnRenamed("weight", "vote_weight")
    answered = classifier.explain(rows, key, top_n)
    joined = rows.select(*dict.fromkeys([key, *ids, *features])).join(answered, key, "left").join(placed, key, "left")
    return joined.withColumn("prompt_json", case_context(joined, ids, features))
