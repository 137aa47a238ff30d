"""Clustering: partition quality metrics, the method × k sweep and experiment ranking.

Inputs are frames of (key, array<double> embedding, cluster).  Metrics:

* partition stats, Calinski-Harabasz and Davies-Bouldin are aggregates
  (per-cluster sums of vectors, then a k×k centroid table);
* silhouette is quadratic, so (as in the reference) it runs on a bounded
  sample (<= 5000 rows by default): the sample is broadcast once and every
  task computes its rows' distances to it with numpy; no pair rows exist.

Fitting is in ``fits``: all cluster counts and starts of a method share their passes over the rows.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import density, fits
from . import neighbours as NB
from .ranks import percentile_rank_small


def partition_stats(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    """AG-30: clusters (noise -1 excluded), noise ratio, coverage."""
    return df.agg(
        F.count_distinct(F.when(F.col(cluster) != -1, F.col(cluster))).cast("double").alias("n_clusters"),
        F.avg((F.col(cluster) == -1).cast("double")).alias("noise_ratio"),
        F.avg((F.col(cluster) != -1).cast("double")).alias("coverage"))


def metric_sample(df: DataFrame, key: str, n: int = 5000, seed: int = 42) -> DataFrame:
    """PRJ-10 / ML-19: exactly ``n`` rows chosen by a seeded hash of the key (all rows if fewer).

    ``orderBy().limit()`` is a distributed top-n (each task keeps n rows)."""
    h = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed))))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def _dim(df: DataFrame, col: str) -> int:
    return int(df.select(F.size(col).alias("d")).where("d IS NOT NULL").first()["d"])


def _cluster_sums(df: DataFrame, col: str, cluster: str, d: int) -> DataFrame:
    x = F.col(col)
    return df.groupBy(F.col(cluster).alias("cluster")).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(x[i].cast("double")) for i in range(d)]).alias("sx"),
        F.sum(F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))).alias("sxx"))


def calinski_harabasz(df: DataFrame, col: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """AG-32: [B/(k-1)] / [W/(n-k)] from per-cluster n, Σx, Σ|x|² (noise excluded)."""
    real = df.where(F.col(cluster) != -1)
    d = _dim(real, col)
    s = _cluster_sums(real, col, cluster, d)
    cent = s.select("cluster", "n", "sxx", F.transform("sx", lambda v: v / F.col("n")).alias("c"))
    s = s.cache()
    tot = s.agg(F.sum("n").alias("ntot"), F.array(*[F.sum(F.col("sx")[i]) for i in range(d)]).alias("sx"),
                F.count(F.lit(1)).alias("k")).first()
    # the global centroid is one row of d numbers: inlined as literals (no join)
    ntot, k = tot["ntot"], tot["k"]
    g = F.array(*[F.lit(float(v) / ntot) for v in tot["sx"]])
    sq = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, v: a + v * v)
    j = cent.select((F.col("n") * sq(F.zip_with("c", g, lambda a, b: a - b))).alias("b"),
                    (F.col("sxx") - F.col("n") * sq(F.col("c"))).alias("w"))
    r = j.agg(F.sum("b").alias("between"), F.sum("w").alias("within"))
    s.unpersist()
    return r.select(F.when((F.lit(k) > 1) & (F.col("within") != 0),
                           (F.col("between") / (k - 1)) / (F.col("within") / (ntot - k)))
                    .otherwise(F.lit(1.0)).alias("calinski_harabasz"))


def davies_bouldin(df: DataFrame, col: str = "embedding", cluster: str = "cluster") -> DataFrame:
    """AG-33: mean over clusters of max_j (s_i + s_j) / |c_i - c_j| with s = mean
    Euclidean distance to the own centroid.  Centroids (k rows) are joined by key."""
    real = df.where(F.col(cluster) != -1)
    d = _dim(real, col)
    s = _cluster_sums(real, col, cluster, d)
    cent = s.select("cluster", F.transform("sx", lambda v: v / F.col("n")).alias("c"))
    dist = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, v: acc + v))
    xs = real.select(F.col(cluster).alias("cluster"), F.transform(col, lambda v: v.cast("double")).alias("x"))
    spread = xs.join(F.broadcast(cent), "cluster").groupBy("cluster").agg(F.avg(dist(F.col("x"), F.col("c"))).alias("s"))
    cs = cent.join(spread, "cluster")
    # the k centroids (k rows by definition) are inlined as a literal array of structs
    rows = cs.collect()
    allc = F.array(*[F.struct(F.lit(r["cluster"]).alias("cluster"), F.array(*[F.lit(float(v)) for v in r["c"]]).alias("c"),
                              F.lit(float(r["s"])).alias("s")) for r in rows])
    j = cs.withColumn("others", allc)
    others = F.filter("others", lambda o: o["cluster"] != F.col("cluster"))

    def ratio(o):
        m = dist(F.col("c"), o["c"])
        return F.when(m == 0, F.lit(float("inf"))).otherwise((F.col("s") + o["s"]) / m)
    per = j.select(F.array_max(F.transform(others, ratio)).alias("r"))
    return per.agg(F.avg("r").alias("davies_bouldin"))


def silhouette(sample: DataFrame, col: str = "embedding", cluster: str = "cluster", max_rows: int = 5000) -> DataFrame:
    """AG-31: mean Euclidean silhouette of a bounded sample (noise excluded).

    The sample (<= ``max_rows`` × dim doubles, checked) is broadcast; each task
    computes its rows' mean distance to every cluster with numpy."""
    spark = sample.sparkSession
    real = sample.where(F.col(cluster) != -1).select(F.col(cluster).alias("c"), F.transform(col, lambda v: v.cast("double")).alias("x"))
    pdf = real.limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"silhouette sample exceeds {max_rows} rows; draw it with metric_sample first")
    if len(pdf) < 3 or pdf["c"].nunique() < 2:
        return spark.createDataFrame([(None,)], "silhouette double")
    X = np.vstack(pdf["x"].to_numpy())
    labels = pdf["c"].to_numpy()
    bx = spark.sparkContext.broadcast((X, labels))

    def part(it):
        Xa, la = bx.value
        uniq = np.unique(la)
        sizes = np.array([(la == u).sum() for u in uniq])
        onehot = (la[:, None] == uniq[None, :]).astype(float)
        ya = (Xa * Xa).sum(1)
        for p in it:
            for lo in range(0, len(p), 512):  # chunk: 512 × sample distances in memory
                q = p.iloc[lo:lo + 512]
                xs = np.vstack(q["x"].to_numpy())
                d2 = (xs * xs).sum(1)[:, None] + ya[None, :] - 2.0 * xs @ Xa.T
                sums = np.sqrt(np.maximum(d2, 0.0)) @ onehot
                own = np.searchsorted(uniq, q["c"].to_numpy())
                idx = np.arange(len(q))
                n_own = sizes[own]
                a = np.where(n_own > 1, sums[idx, own] / np.maximum(n_own - 1, 1), 0.0)
                means = sums / sizes[None, :]
                means[idx, own] = np.inf
                b = means.min(1)
                s = np.where(n_own > 1, (b - a) / np.maximum(a, b), 0.0)
                yield pd.DataFrame({"s": s})
    return real.repartition(max(1, min(64, len(pdf) // 200 + 1))).mapInPandas(part, "s double").agg(
        F.avg("s").alias("silhouette"))


# ------------------------------------------------------------------ fitting --

def fit_labels(emb: DataFrame, method: str, k, key: str = "row_id", seed: int = 42, n_init: int | None = None,
               micro: int = 500, threshold: float = 0.5) -> tuple[DataFrame, dict]:
    """ML-08..12: fit one configuration on (key, embedding); returns (key, cluster) and info.  ``k`` is (eps, min_samples)
    for dbscan; ``n_init`` defaults to 20 starts of k-means and 5 of the mixture."""
    if method == "dbscan":
        eps, ms = k
        return dbscan(emb.select(key, "embedding"), key, "embedding", eps, ms), {"eps": eps, "min_samples": ms}
    return fits.fit_grid(emb, method, [k], key, "embedding", seed, n_init, threshold, micro)[k]


def config_id(config: dict) -> str:
    """SC-16: 'k1=v1,k2=v2' with keys sorted."""
    return ",".join(f"{k}={v}" for k, v in sorted(config.items()))


def evaluate(emb: DataFrame, labels: DataFrame, key: str = "row_id", sample_size: int = 5000, seed: int = 42) -> dict:
    """Partition stats, Calinski-Harabasz and Davies-Bouldin on all rows; the silhouette, whose cost is quadratic, on
    the seeded metric sample of the non-noise rows (its definition in the reference)."""
    j = emb.join(labels, key)
    st = partition_stats(j).first().asDict()
    real = j.where(F.col("cluster") != -1)
    out = dict(st, silhouette=None, calinski_harabasz=None, davies_bouldin=None)
    if st["n_clusters"] < 2:
        return out
    out["silhouette"] = silhouette(metric_sample(real, key, sample_size, seed), max_rows=sample_size).first()[0]
    out["calinski_harabasz"] = calinski_harabasz(real).first()[0]
    out["davies_bouldin"] = davies_bouldin(real).first()[0]
    return out


METHODS = ("kmeans", "gmm", "birch", "agglomerative", "dbscan")


def evaluate_all(wide: DataFrame, n_configs: int, key: str, sample_size: int = 5000, seed: int = 42) -> list[dict]:
    """``evaluate`` for all configurations in shared passes over (key, x, labels, target): sums per cluster, distances to
    the centroids, and one metric sample for all configurations without noise.  ``mortality_separation`` is the spread of the
    clusters' target rates.  The driver holds one row of sums per cluster."""
    dim = _dim(wide, "x")
    sums = fits.partition_sums(wide, dim)
    of = {c: g.set_index("cluster").sort_index() for c, g in sums.groupby("config")}
    centroids = {(c, n): row[[f"v{i}" for i in range(1, dim + 1)]].to_numpy(float) / row["v0"] for c, g in of.items() for n, row in g.iterrows() if n != -1}
    away = fits.centroid_distances(wide, centroids)
    sample, noisy, out = None, [], []
    for c in range(n_configs):
        g = of.get(c, pd.DataFrame({f"v{i}": [] for i in range(dim + 4)}))
        total, real = g["v0"].sum(), g[g.index != -1]
        m = {"n_clusters": float(len(real)), "noise_ratio": float(1 - real["v0"].sum() / total) if total else None,
             "coverage": float(real["v0"].sum() / total) if total else None,
             "silhouette": None, "calinski_harabasz": None, "davies_bouldin": None, "mortality_separation": None}
        out.append(m)
        if len(real) < 2:
            continue
        n, k = real["v0"].to_numpy(float), len(real)
        centre = np.array([centroids[c, i] for i in real.index])
        middle = (n[:, None] * centre).sum(axis=0) / n.sum()
        between = float((n * ((centre - middle) ** 2).sum(axis=1)).sum())
        within = float((real[f"v{dim + 1}"].to_numpy(float) - n * (centre ** 2).sum(axis=1)).sum())
        m["calinski_harabasz"] = float(between / (k - 1) / (within / (n.sum() - k))) if within != 0 else 1.0
        spread = np.array([away[c, i] for i in real.index]) / n
        gaps = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        with np.errstate(divide="ignore"):
            ratio = np.where(gaps > 0, (spread[:, None] + spread[None]) / np.where(gaps > 0, gaps, 1), np.inf)
        np.fill_diagonal(ratio, -np.inf)
        m["davies_bouldin"] = float(ratio.max(axis=1).mean())
        rated = real[real[f"v{dim + 3}"] > 0]
        if len(rated):
            m["mortality_separation"] = float(np.std(rated[f"v{dim + 2}"] / rated[f"v{dim + 3}"]))
        if len(real) < len(g):
            noisy.append(c)
    plain = [c for c in range(n_configs) if out[c]["n_clusters"] >= 2 and c not in noisy]
    for some in ([plain] if plain else []) + [[c] for c in noisy]:  # noise rows are left out of a sample
        rows = wide if some is plain else wide.where(F.col("labels")[some[0]] != -1)
        for c, value in zip(some, silhouettes(metric_sample(rows.select(key, "x", "labels"), key, sample_size, seed), some)):
            out[c]["silhouette"] = value
    return out


def silhouettes(sample: DataFrame, configs: list[int]) -> list[float | None]:
    """AG-31 for several labellings of one bounded metric sample (x, labels), whose distances are computed once."""
    pdf = sample.select("x", "labels").toPandas()  # the sample's bound
    x, labels = np.vstack(pdf["x"]).astype(float), np.vstack(pdf["labels"])[:, configs]
    spark = sample.sparkSession
    sent = spark.sparkContext.broadcast((x, labels))

    def part(it):
        every, names = sent.value
        square = (every * every).sum(1)
        for p in it:
            at = p["at"].to_numpy()
            for low in range(0, len(at), 512):
                i = at[low:low + 512]
                d = np.sqrt(np.maximum(square[i, None] + square[None] - 2.0 * every[i] @ every.T, 0.0))
                for c in range(names.shape[1]):
                    uniq, own = np.unique(names[:, c], return_inverse=True)
                    sizes, sums = np.bincount(own), d @ np.eye(len(uniq))[own]
                    row, mine = np.arange(len(i)), own[i]
                    a = sums[row, mine] / np.maximum(sizes[mine] - 1, 1)
                    means = sums / sizes
                    means[row, mine] = np.inf
                    b = means.min(axis=1)
                    with np.errstate(invalid="ignore"):
                        s = np.where(sizes[mine] > 1, (b - a) / np.maximum(a, b), 0.0)
                    yield pd.DataFrame({"c": [c], "s": [float(s.sum())]})

    n = len(x)
    places = spark.range(n).withColumnRenamed("id", "at").repartition(max(1, min(64, n // 200 + 1)))
    found = dict(places.mapInPandas(part, "c int, s double").groupBy("c").agg(F.sum("s")).collect())
    return [found[c] / n if n >= 3 and len(np.unique(labels[:, c])) >= 2 else None for c in range(len(configs))]


METHODS = ("kmeans", "gmm", "birch", "agglomerative", "dbscan")


def sweep(emb: DataFrame, outcome: DataFrame | None, methods: list[str] = METHODS, ks: list[int] = tuple(range(3, 9)),
          key: str = "row_id", target: str | None = None, seed: int = 42, n_init: int | None = None, sample_size: int = 5000,
          dbscan_grid: list[tuple[float, int]] = ((1.0, 50), (1.2, 50))) -> tuple[DataFrame, dict]:
    """ML-13: fit every (method, k) on the (checkpointed) embedding frame, keep
    configurations with >= 2 clusters, collect metrics and outcome dispersion.
    All k and starts of a method share their passes over the rows, and all configurations those of the metrics.
    Returns (experiments table, {experiment_id: labels frame})."""
    from ..session import cut_lineage
    configs, fitted, scans = [], [], []
    blocks = fits.packed(emb, "embedding") if set(methods) - {"dbscan"} else None  # one set for all methods
    for method in methods:
        if method == "dbscan":
            scans += [({"eps": e, "min_samples": m}, found) for (e, m), found in zip(dbscan_grid, density.clusterings(emb, key, "embedding", list(dbscan_grid)))]
        else:
            found = fits.fit_all(emb, method, list(ks), key, "embedding", seed, n_init, blocks=blocks)
            configs += [(method, {"n_clusters": k}) for k in ks]
            fitted += [found[k] for k in ks]
    wide = fits.label_arrays(emb, key, "embedding", fitted)
    for config, labels in scans:
        configs.append(("dbscan", config))
        wide = wide.join(labels.withColumnRenamed("cluster", "scanned"), key).withColumn("labels", F.concat("labels", F.array("scanned"))).drop("scanned")
    if outcome is not None and target:
        wide = wide.join(outcome.select(key, F.col(target).cast("double").alias("target")), key, "left")
    else:
        wide = wide.withColumn("target", F.lit(None).cast("double"))
    wide = cut_lineage(wide)
    rows, labels = [], {}
    for i, ((method, config), m) in enumerate(zip(configs, evaluate_all(wide, len(configs), key, sample_size, seed))):
        if m["n_clusters"] < 2:
            continue
        eid = f"{method}|{config_id(config)}"
        labels[eid] = wide.select(key, F.col("labels")[i].alias("cluster"))
        rows.append((eid, method, json.dumps(config, sort_keys=True), m["n_clusters"], m["noise_ratio"],
                     m["coverage"], m["silhouette"], m["calinski_harabasz"], m["davies_bouldin"], m["mortality_separation"]))
    if not rows:
        raise RuntimeError("no clustering produced at least two clusters")
    schema = ("experiment_id string, method string, config string, n_clusters double, noise_ratio double, coverage double, "
              "silhouette double, calinski_harabasz double, davies_bouldin double, mortality_separation double")
    return emb.sparkSession.createDataFrame(rows, schema), labels


def rank_experiments(exp: DataFrame) -> DataFrame:
    """WN-03: average-tie percentile rank of each metric (1 = best), selection score =
    mean of the available ranks, sorted by (score, silhouette, coverage) desc."""
    spec = [("silhouette", True, "rank_silhouette"), ("calinski_harabasz", True, "rank_calinski"),
            ("davies_bouldin", False, "rank_davies"), ("coverage", True, "rank_coverage"),
            ("noise_ratio", False, "rank_noise")]
    has_sep = exp.where(F.col("mortality_separation").isNotNull()).limit(1).count() > 0
    if has_sep:
        spec.append(("mortality_separation", True, "rank_mortality_separation"))
    out = exp
    for metric, higher, name in spec:
        out = percentile_rank_small(out, metric, higher, out=name)  # one row per configuration
    ranks = [F.col(n) for _, _, n in spec]
    present = sum(F.when(r.isNotNull(), 1).otherwise(0) for r in ranks)
    total = sum(F.coalesce(r, F.lit(0.0)) for r in ranks)
    out = out.withColumn("selection_score", F.when(present > 0, total / present))
    return out.orderBy(F.desc_nulls_last("selection_score"), F.desc_nulls_last("silhouette"),
                       F.desc_nulls_last("coverage"), "experiment_id")


def best_experiment(ranked: DataFrame) -> DataFrame:
    """WN-04: the top row of the ranking."""
    return ranked.limit(1)



# ------------------------------------------------------------------ DBSCAN --

def _merged_labels(edges: DataFrame) -> DataFrame:
    """label, root: the smallest label that each one is joined to by ``edges`` (a, b).  Least labels spread along the
    edges and jump to their own least label until none changes; lineage is cut every round."""
    from ..session import cut_lineage
    both = cut_lineage(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    nodes = cut_lineage(both.select(F.col("a").alias("label")).distinct().withColumn("root", F.col("label")))
    while True:
        least = both.join(nodes, F.col("b") == F.col("label")).groupBy("a").agg(F.min("root").alias("least"))
        step = nodes.join(least, F.col("label") == F.col("a"), "left").select("label", "root", F.least("root", F.coalesce("least", "root")).alias("new"))
        hop = step.select(F.col("label").alias("at"), F.col("new").alias("further"))
        step = cut_lineage(step.join(hop, F.col("new") == F.col("at"), "left").select("label", "root", F.least("new", F.coalesce("further", "new")).alias("new")))
        nodes = step.select("label", F.col("new").alias("root"))
        if step.where("new <> root").isEmpty():
            return nodes


def dbscan(emb: DataFrame, key: str = "row_id", col: str = "embedding", eps: float = 1.0, min_samples: int = 50,
           n_pivots: int | None = None, block: int = NB.BLOCK_ROWS) -> DataFrame:
    """ML-12: density clustering.  Core points have >= ``min_samples`` points (themselves included) within ``eps``; core
    points within eps of each other share a cluster; a border point joins the cluster with the smallest label among its
    core neighbours; the rest is noise (-1), rows without a whole vector too.  Clusters are numbered 0.. by their
    smallest key.  See ``density`` for how it runs."""
    return density.clusterings(emb, key, col, [(eps, min_samples)], n_pivots, block)[0]
