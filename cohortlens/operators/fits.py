"""Clusterings fitted together: every pass over the rows serves all cluster counts and all starts.

The vectors are packed once into blocks of rows, dealt evenly, and every pass reads these.  A pass is one ``mapInArrow`` in
which each task adds up its rows' contributions to every open model (counts, sums, products) and sends its sums; Spark
adds these up and the driver, which holds only the models, takes the step.  The number of passes does not depend on the
number of starts.

* k-means: Lloyd's rounds from k-means++ seeds of a bounded sample; the start with the least cost is kept.
* Gaussian mixtures with full covariances: EM rounds; the start with the highest likelihood is kept.
* BIRCH: clustering features (n, sum, sum of squares) per micro-cluster; one whose radius exceeds the threshold is cut
  at the mean of its widest dimension.  When more than ``MAX_MICRO`` would be needed the threshold grows by half, as
  the method itself rebuilds its tree when memory is short.  Micro-centroids are then merged by Ward's criterion.
* Ward: distinct rows, or k-means centres where there are more than ``micro`` of them, merged by nearest-neighbour chains.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

STARTS = {"kmeans": 20, "gmm": 5}
SAMPLE = 2000  # rows that seeds are drawn from
SLICE = 2048
CELLS = 1 << 18  # numbers that a step over a slice holds
MAX_MICRO = 2000
REGULAR = 1e-6


def vectors_of(column: pa.Array) -> np.ndarray:
    if column.null_count:
        raise ValueError("a row has no vector")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def as_doubles(df: DataFrame, col: str):
    """The column as array<double>; one that is such already is not built anew."""
    return F.col(col) if dict(df.dtypes)[col] == "array<double>" else F.transform(col, lambda v: v.cast("double"))


def packed(emb: DataFrame, col: str) -> DataFrame:
    """dim, block: the vectors as blocks of at most ``SLICE`` rows, in the shared folder.  Where some task would have more than
    twice its share of the blocks, they are dealt anew, so that a pass over few files keeps all cores busy."""
    from ..session import cut_lineage
    ship_package(emb.sparkSession)

    def run(batches):
        for batch in batches:
            x = vectors_of(batch.column(0))
            for at in range(0, len(x), SLICE):
                yield pa.RecordBatch.from_arrays([pa.array([x.shape[1]], pa.int32()), pa.array([x[at:at + SLICE].tobytes()], pa.binary())],
                                                 names=["dim", "block"])

    blocks = cut_lineage(emb.select(as_doubles(emb, col).alias("x")).mapInArrow(run, "dim int, block binary"))
    tasks = emb.sparkSession.sparkContext.defaultParallelism
    held = [r["count"] for r in blocks.groupBy(F.spark_partition_id()).count().collect()]  # one row per task
    if held and max(held) > max(1, 2 * sum(held) / tasks):
        blocks = cut_lineage(blocks.repartition(tasks))
    return blocks


def one_pass(blocks: DataFrame, width: int, groups: int, part) -> np.ndarray:
    """Sum over all rows of ``part(X)``, a matrix of ``groups`` rows and ``width`` numbers for a slice of rows."""
    rows = max(128, min(SLICE, CELLS // max(1, groups)))

    def run(batches):
        total = np.zeros((groups, width))
        for batch in batches:
            for dim, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                x = np.frombuffer(block.as_buffer(), float).reshape(-1, dim)
                for at in range(0, len(x), rows):
                    total += part(x[at:at + rows])
        used = np.flatnonzero(total)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total.ravel()[used])], names=["at", "v"])

    sums = blocks.select("dim", "block").mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(groups * width)  # the numbers of the open models
    out[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
    return out.reshape(groups, width)


def seeds_sample(emb: DataFrame, key: str, col: str, seed: int) -> np.ndarray:
    from .cluster import metric_sample
    rows = metric_sample(emb.select(key, col), key, SAMPLE, seed).orderBy(key).collect()
    return np.array([r[col] for r in rows], float)


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ seeds; where the sample has fewer distinct rows some seeds repeat."""
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(axis=1)
    for _ in range(k - 1):
        total = d.sum()
        out.append(x[rng.choice(len(x), p=d / total)] if total > 0 else x[rng.integers(len(x))])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :]
    at = d.argmin(axis=1)
    return at, np.maximum(d[np.arange(len(x)), at], 0.0)


def runs_of(values: list) -> list[tuple[int, int]]:
    """(first, end) of each run of equal neighbours."""
    cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
    return list(zip(cuts, cuts[1:]))


def k_means(emb: DataFrame, key: str, col: str, ks: list[int], starts: int, seed: int = 42, rounds: int = 100,
            tolerance: float = 1e-4, blocks: DataFrame | None = None) -> dict[int, tuple[np.ndarray, float]]:
    """The best centres and their cost for each k.  ``blocks`` are the ``packed`` vectors, if there already."""
    sample = seeds_sample(emb, key, col, seed)
    rng = np.random.default_rng(seed)
    dim, models = sample.shape[1], [(k, plus_plus(sample, k, rng)) for k in ks for _ in range(starts)]
    still = tolerance * float(sample.var(axis=0).mean())
    open_, cost = list(range(len(models))), np.full(len(models), np.inf)
    blocks = packed(emb, col) if blocks is None else blocks

    def sums(some: list[int], costs: bool = False) -> list[np.ndarray]:
        """Per model: the rows of each centre, their sum and, if asked for, the model's cost in its first row."""
        centres = [models[i][1] for i in some]
        first = np.cumsum([0, *map(len, centres)])
        every = np.vstack(centres)
        lines = np.hstack([(every * every).sum(axis=1)[:, None], -2 * every])
        alike = [(a, b, len(centres[a])) for a, b in runs_of(list(map(len, centres)))]  # models in a row with as many centres

        def part(x):
            one = np.hstack([np.ones((len(x), 1)), x])
            d = lines @ one.T  # centre by row, without the rows' own squares, which change no choice
            hot = np.empty(d.shape)
            least = np.empty((len(centres), len(x)))
            for a, b, k in alike:
                at = slice(first[a], first[b])
                of = d[at].reshape(b - a, k, len(x))
                of.min(axis=1, out=least[a:b])
                own = of == least[a:b, None]
                if np.count_nonzero(own) != (b - a) * len(x):  # of centres at one distance the first
                    own = of.argmin(axis=1)[:, None] == np.arange(k)[None, :, None]
                hot[at] = own.reshape(-1, len(x))
            out = np.zeros((len(d), dim + 2))
            out[:, :-1] = hot @ one
            if costs:
                out[first[:-1], -1] = np.maximum(least + (x * x).sum(axis=1), 0.0).sum(axis=1)
            return out

        total = one_pass(blocks, dim + 2, int(first[-1]), part)
        return [total[a:b] for a, b in zip(first, first[1:])]

    for _ in range(rounds):
        closed = []
        for i, s in zip(open_, sums(open_)):
            k, old = models[i]
            new = np.where(s[:, :1] > 0, s[:, 1:-1] / np.maximum(s[:, :1], 1), old)
            models[i] = (k, new)
            if ((new - old) ** 2).sum() <= still:
                closed.append(i)
        open_ = [i for i in open_ if i not in closed]
        if not open_:
            break
    for i, s in enumerate(sums(list(range(len(models))), costs=True)):
        cost[i] = s[:, -1].sum()
    best = {}
    for k in ks:
        i = min((i for i in range(len(models)) if models[i][0] == k), key=lambda i: cost[i])
        best[k] = (models[i][1], float(cost[i]))
    return best


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    def __post_init__(self):
        low = np.linalg.cholesky(self.covariances)
        # all components at once: rows of ``whiten`` times (x - middle) minus ``shift``
        self.whiten = np.linalg.inv(low).reshape(-1, low.shape[-1])
        self.middle = self.means.mean(axis=0)
        self.shift = np.einsum("kij,kj->ki", np.linalg.inv(low), self.means - self.middle).reshape(-1, 1)
        half = np.log(np.diagonal(low, axis1=1, axis2=2)).sum(axis=1)
        self.constant = np.log(np.maximum(self.weights, 1e-300)) - half - 0.5 * self.means.shape[1] * math.log(2 * math.pi)

    def log_joint(self, x: np.ndarray) -> np.ndarray:
        return self.by_component(x).T

    def by_component(self, x: np.ndarray) -> np.ndarray:
        """The log joint densities, one line per component."""
        z = self.whiten @ (x - self.middle).T
        z -= self.shift
        z *= z
        return self.constant[:, None] - 0.5 * z.reshape(*self.means.shape, len(x)).sum(axis=1)


def _mixture(n: np.ndarray, sx: np.ndarray, sxx: np.ndarray) -> Mixture:
    n_ = np.maximum(n, 10 * np.finfo(float).eps)
    means = sx / n_[:, None]
    cov = sxx / n_[:, None, None] - means[:, :, None] * means[:, None, :]
    cov[:, np.arange(sx.shape[1]), np.arange(sx.shape[1])] = np.maximum(cov[:, np.arange(sx.shape[1]), np.arange(sx.shape[1])], 0) + REGULAR
    return Mixture(n / n.sum(), means, cov)


def gaussian_mixtures(emb: DataFrame, key: str, col: str, ks: list[int], starts: int, seed: int = 42, rounds: int = 100,
                      tolerance: float = 1e-3, blocks: DataFrame | None = None) -> dict[int, tuple[Mixture, float]]:
    """The best mixture and its mean log-likelihood for each k.  ``blocks`` are the ``packed`` vectors, if there already."""
    sample = seeds_sample(emb, key, col, seed)
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    low = np.tril_indices(dim)
    models: list[tuple[int, Mixture]] = []
    for k in ks:
        for _ in range(starts):
            centres = plus_plus(sample, k, rng)
            for _ in range(10):
                own = nearest(sample, centres)[0]
                centres = np.array([sample[own == j].mean(axis=0) if (own == j).any() else centres[j] for j in range(k)])
            hot = np.eye(k)[nearest(sample, centres)[0]] + 1e-6
            models.append((k, _mixture(hot.sum(axis=0), hot.T @ sample, np.einsum("nk,ni,nj->kij", hot, sample, sample))))
    likelihood, open_ = np.full(len(models), -np.inf), list(range(len(models)))
    blocks = packed(emb, col) if blocks is None else blocks
    for _ in range(rounds):
        mixtures = [models[i][1] for i in open_]
        first = np.cumsum([0, *(len(m.weights) for m in mixtures)])

        def part(x, mixtures=mixtures, first=first):
            share, fit = np.empty((first[-1], len(x))), np.zeros(first[-1])
            for at, m in zip(first, mixtures):
                joint = m.by_component(x)
                top = joint.max(axis=0)
                joint -= top
                total = np.log(np.exp(joint).sum(axis=0))
                share[at:at + len(joint)] = np.exp(joint - total)
                fit[at] = (top + total).sum()
            terms = np.hstack([np.ones((len(x), 1)), x, x[:, low[0]] * x[:, low[1]]])
            return np.hstack([share @ terms, fit[:, None]])

        total = one_pass(blocks, dim + 2 + len(low[0]), int(first[-1]), part)
        closed = []
        for i, a, b in zip(open_, first, first[1:]):
            s = total[a:b]
            sxx = np.zeros((b - a, dim, dim))
            sxx[:, low[0], low[1]] = s[:, dim + 1:-1]
            sxx[:, low[1], low[0]] = s[:, dim + 1:-1]
            new = float(s[0, -1] / s[:, 0].sum())
            if new - likelihood[i] < tolerance:
                closed.append(i)
            else:
                models[i] = (models[i][0], _mixture(s[:, 0], s[:, 1:dim + 1], sxx))
            likelihood[i] = max(likelihood[i], new)
        open_ = [i for i in open_ if i not in closed]
        if not open_:
            break
    best = {}
    for k in ks:
        i = max((i for i in range(len(models)) if models[i][0] == k), key=lambda i: likelihood[i])
        best[k] = (models[i][1], float(likelihood[i]))
    return best


@dataclass
class FeatureTree:
    """Micro-clusters as the leaves of a tree of cuts; ``leaf`` gives a node's micro-cluster or -1."""

    dim: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    leaf: np.ndarray

    def micro(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            inner = self.left[node] >= 0
            if not inner.any():
                return self.leaf[node]
            at = node[inner]
            node[inner] = self.left[at] + (x[inner, self.dim[at]] > self.cut[at])


@dataclass
class Features:
    """Clustering features of the micro-clusters, the tree that finds a row's one, and the threshold that they keep."""

    tree: FeatureTree
    n: np.ndarray
    centroids: np.ndarray
    radius: np.ndarray
    threshold: float


def sums_by(groups: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` per group 0..n-1."""
    out, order = np.zeros((n, values.shape[1])), np.argsort(groups, kind="stable")
    if len(order):
        used, at = np.unique(groups[order], return_index=True)
        out[used] = np.add.reduceat(values[order], at, axis=0)
    return out


def clustering_features(emb: DataFrame, col: str, threshold: float = 0.5, max_micro: int = MAX_MICRO, blocks: DataFrame | None = None) -> Features:
    """Micro-clusters whose radius (root mean square distance to the centroid) is at most the threshold."""
    blocks = packed(emb, col) if blocks is None else blocks
    dim = int(emb.select(F.size(col).alias("d")).first()["d"])
    dims, cuts, left, leaf = [0], [0.0], [-1], [0]
    while True:
        tree = FeatureTree(np.array(dims), np.array(cuts), np.array(left), np.array(leaf))
        n_leaves = int(tree.leaf.max()) + 1

        def part(x, tree=tree, n_leaves=n_leaves):
            return sums_by(tree.micro(x), np.hstack([np.ones((len(x), 1)), x, x * x]), n_leaves)

        s = one_pass(blocks, 1 + 2 * dim, n_leaves, part)
        n = np.maximum(s[:, 0], 1)
        mean = s[:, 1:dim + 1] / n[:, None]
        spread = np.maximum(s[:, dim + 1:] / n[:, None] - mean ** 2, 0.0)
        radius = np.sqrt(spread.sum(axis=1))
        wide = np.flatnonzero((radius > threshold) & (spread.max(axis=1) > 1e-12 * np.maximum(1.0, (mean ** 2).max(axis=1))))
        while len(wide) and n_leaves + len(wide) > max_micro:
            threshold *= 1.5
            wide = wide[radius[wide] > threshold]
        if not len(wide):
            return Features(tree, s[:, 0], mean, radius, threshold)
        node_of = {v: i for i, v in enumerate(leaf) if v >= 0}
        for c in wide.tolist():
            node, d = node_of[c], int(spread[c].argmax())
            dims[node], cuts[node], left[node], leaf[node] = d, float(mean[c, d]), len(dims), -1
            dims += [0, 0]
            cuts += [0.0, 0.0]
            left += [-1, -1]
            leaf += [c, n_leaves]
            n_leaves += 1


def ward(centroids: np.ndarray, weights: np.ndarray, ks: list[int]) -> dict[int, np.ndarray]:
    """Groups of weighted centroids by Ward's criterion for each k, numbered by their first centroid.  A chain of nearest
    neighbours ends in a pair that are each other's nearest, which is merged; merges are then taken by cost."""
    m = len(centroids)
    c, w = np.vstack([centroids.astype(float)]), weights.astype(float).copy()
    active, merges, chain = np.ones(m, bool), [], []
    while active.sum() > 1:
        if not chain:
            chain.append(int(np.flatnonzero(active)[0]))
        a = chain[-1]
        cost = w[a] * w / (w[a] + w) * ((c - c[a]) ** 2).sum(axis=1)
        cost[~active] = np.inf
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            del chain[-2:]
            low, high = min(a, b), max(a, b)
            merges.append((float(cost[b]), low, high))
            c[low] = (w[low] * c[low] + w[high] * c[high]) / (w[low] + w[high])
            w[low] += w[high]
            active[high] = False
        else:
            chain.append(b)
    order = sorted(range(len(merges)), key=lambda i: (merges[i][0], i))
    out = {}
    for k in ks:
        parent = list(range(m))

        def find(i, parent=parent):
            while parent[i] != i:
                parent[i] = i = parent[parent[i]]
            return i

        for i in order[:max(0, m - k)]:
            a, b = find(merges[i][1]), find(merges[i][2])
            parent[max(a, b)] = min(a, b)
        roots = [find(i) for i in range(m)]
        number = {r: n for n, r in enumerate(sorted(set(roots)))}
        out[k] = np.array([number[r] for r in roots])
    return out


def _labelled(x: np.ndarray, label) -> np.ndarray:
    return np.concatenate([label(x[at:at + SLICE]) for at in range(0, len(x), SLICE)]).astype(np.int32)


def labels_by(emb: DataFrame, key: str, col: str, label) -> DataFrame:
    """key, cluster by ``label(X)``."""
    ship_package(emb.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_labelled(vectors_of(batch.column(1)), label))], names=[key, "cluster"])

    rows = emb.select(key, as_doubles(emb, col).alias("x"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, cluster int")


@dataclass
class Fit:
    """``label(X)`` gives the clusters of rows; ``facts`` of the fit."""

    label: object
    facts: dict


def fit_grid(emb: DataFrame, method: str, ks: list[int], key: str = "row_id", col: str = "embedding", seed: int = 42,
             starts: int | None = None, threshold: float = 0.5, micro: int = 500, max_micro: int = MAX_MICRO) -> dict[int, tuple[DataFrame, dict]]:
    """ML-08..11: labels (key, cluster) and facts of the fit for every k, fitted together."""
    found = fit_all(emb, method, ks, key, col, seed, starts, threshold, micro, max_micro)
    return {k: (labels_by(emb, key, col, f.label), f.facts) for k, f in found.items()}


def fit_all(emb: DataFrame, method: str, ks: list[int], key: str, col: str, seed: int, starts: int | None = None, threshold: float = 0.5,
            micro: int = 500, max_micro: int = MAX_MICRO, blocks: DataFrame | None = None) -> dict[int, Fit]:
    """The fits of one method for every k; ``blocks`` are the ``packed`` vectors, if there already."""
    blocks = packed(emb, col) if blocks is None else blocks
    if method == "kmeans":
        found = k_means(emb, key, col, ks, starts or STARTS[method], seed, blocks=blocks)
        return {k: Fit(lambda x, c=c: nearest(x, c)[0], {"cost": cost, "centers": c}) for k, (c, cost) in found.items()}
    if method == "gmm":
        found = gaussian_mixtures(emb, key, col, ks, starts or STARTS[method], seed, blocks=blocks)
        return {k: Fit(lambda x, m=m: m.by_component(x).argmax(axis=0), {"log_likelihood": v, "mixture": m}) for k, (m, v) in found.items()}
    if method == "birch":
        cf = clustering_features(emb, col, threshold, max_micro, blocks)
        groups = ward(cf.centroids, np.maximum(cf.n, 1), ks)
        facts = {"micro": len(cf.n), "threshold": cf.threshold, "radius": float(cf.radius.max())}
        return {k: Fit(lambda x, g=g, t=cf.tree: g[t.micro(x)], facts) for k, g in groups.items()}
    if method == "agglomerative":
        distinct = emb.groupBy(F.transform(col, lambda v: v.cast("double")).alias("x")).count().orderBy("x").limit(micro + 1).collect()
        if len(distinct) <= micro:
            centres, weights = np.array([r["x"] for r in distinct], float), np.array([r["count"] for r in distinct], float)
        else:
            centres = np.unique(k_means(emb, key, col, [micro], 1, seed, rounds=20, blocks=blocks)[micro][0], axis=0)

            def part(x):
                return np.bincount(nearest(x, centres)[0], minlength=len(centres)).astype(float)[:, None]

            weights = one_pass(blocks, 1, len(centres), part)[:, 0]
            centres, weights = centres[weights > 0], weights[weights > 0]
        groups = ward(centres, weights, ks)
        return {k: Fit(lambda x, g=g: g[nearest(x, centres)[0]], {"micro": len(centres)}) for k, g in groups.items()}
    raise ValueError(f"unknown method {method}")


def label_arrays(emb: DataFrame, key: str, col: str, fits: list[Fit]) -> DataFrame:
    """key, x and labels: the clusters of every row under all fits, in one pass."""
    ship_package(emb.sparkSession)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch.column(1))
                labels = np.column_stack([_labelled(x, f.label) for f in fits]) if fits else np.zeros((len(x), 0), np.int32)
                ends = pa.array(np.arange(len(x) + 1) * labels.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, pa.array(labels.ravel()))], names=[key, "x", "labels"])

    rows = emb.select(key, as_doubles(emb, col).alias("x"))
    return rows.mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, x array<double>, labels array<int>")


def partition_sums(wide: DataFrame, dim: int) -> pd.DataFrame:
    """For each configuration and cluster, noise too: n, sum of x, of its squares, of the target and of its rows; one row
    per cluster.  Every task adds up its rows first."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, labels = vectors_of(batch.column(0)), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            target = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            known = ~np.isnan(target)
            values = np.column_stack([np.ones(len(x)), x, (x * x).sum(axis=1), np.where(known, target, 0), known])
            out = []
            for c in range(labels.shape[1]):
                names, at = np.unique(labels[:, c], return_inverse=True)
                sums = sums_by(at, values, len(names))
                out += [(c, int(n), s.tolist()) for n, s in zip(names, sums)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                                              pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["config", "cluster", "v"])

    width = dim + 4
    rows = wide.select("x", "labels", "target").mapInArrow(run, "config int, cluster int, v array<double>")
    return rows.groupBy("config", "cluster").agg(*[F.sum(F.col("v")[i]).alias(f"v{i}") for i in range(width)]).toPandas()


def centroid_distances(wide: DataFrame, centroids: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], float]:
    """Sum of the distances of each configuration's rows to their cluster's centroid."""
    sent = wide.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x, labels = vectors_of(batch.column(0)), batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            out = []
            for c in range(labels.shape[1]):
                for n in np.unique(labels[:, c]).tolist():
                    if n != -1:
                        out.append((c, n, float(np.sqrt(((x[labels[:, c] == n] - sent.value[c, n]) ** 2).sum(axis=1)).sum())))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))],
                                             names=["config", "cluster", "s"])

    rows = wide.select("x", "labels").mapInArrow(run, "config int, cluster int, s double").groupBy("config", "cluster").agg(F.sum("s").alias("s"))
    return {(r["config"], r["cluster"]): r["s"] for r in rows.collect()}
