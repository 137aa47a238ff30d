"""Feature preparation: column choice, imputation, robust scaling, one-hot
encoding, truncated SVD and standard scaling.

Fitting is a handful of ungrouped aggregates whose results are a few numbers
per column (medians, quartiles, modes, level lists bounded by the column's
cardinality, a p×p Gram matrix).  Those parameters are kept in a small
``Preprocessor`` object (saved as JSON next to the data) and applied as plain
column expressions, so transforming 100 TB is one map-only stage.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.quantiles import ranked_quantiles, stored_ranks, with_copies


def select_feature_columns(df: DataFrame, target: str | None, categorical: list[str], ids: list[str],
                           exclude: list[str] = ()) -> dict[str, list[str]]:
    """PRJ-02 (+PRJ-03): drop ids, target, leakage and constant columns.

    'Constant' = at most one distinct value counting null as a value, decided
    exactly with O(1) state per column: all null, or no null and min == max."""
    skip = set(ids) | set(exclude) | ({target} if target else set())
    cand = [c for c in df.columns if c not in skip]
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"n__{c}") for c in cand],
                 *[(F.min(c) == F.max(c)).alias(f"eq__{c}") for c in cand]).first()
    n = row["__n"]
    valid = [c for c in cand if not (row[f"n__{c}"] == 0 or (row[f"n__{c}"] == n and row[f"eq__{c}"]))]
    cats = [c for c in categorical if c in valid]
    return {"features": valid, "numeric": [c for c in valid if c not in cats], "categorical": cats}


def constant_column_report(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRJ-02 (table): per column, non-null count, min == max, and the constant decision."""
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(f"n__{c}") for c in cols],
                 *[(F.min(c) == F.max(c)).alias(f"eq__{c}") for c in cols])
    structs = [F.struct(F.lit(c).alias("variable"),
                        ((F.col(f"n__{c}") == 0) | ((F.col(f"n__{c}") == F.col("__n")) & F.coalesce(F.col(f"eq__{c}"), F.lit(False))))
                        .alias("is_constant")) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


MAX_LEVELS = 10_000  # one output column per level


@dataclass
class Preprocessor:
    """ML-01..05: median impute + robust scale numeric; mode impute + one-hot categorical."""
    numeric: list[str]
    categorical: list[str]
    medians: dict[str, float | None] = field(default_factory=dict)
    q1: dict[str, float | None] = field(default_factory=dict)
    q3: dict[str, float | None] = field(default_factory=dict)
    modes: dict[str, str | None] = field(default_factory=dict)
    levels: dict[str, list[str]] = field(default_factory=dict)

    # -- fit --------------------------------------------------------------
    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categorical: list[str]) -> "Preprocessor":
        p = cls(list(numeric), list(categorical))
        if numeric:
            ranked = stored_ranks(df, numeric)
            med = ranked_quantiles(ranked, [0.5])
            p.medians = {c: med[c][0] if c in med else None for c in numeric}
            # quartiles of the IMPUTED column (the scaler is fitted after the imputer): the counts with the nulls at the median
            nulls = df.agg(*[F.count_if(F.col(f"`{c}`").cast("double").isNull()).alias(f"n{i}") for i, c in enumerate(numeric)]).first()
            q = ranked_quantiles(with_copies(ranked, {c: (med[c][0], nulls[i]) for i, c in enumerate(numeric) if c in med and nulls[i]}), [0.25, 0.75])
            p.q1 = {c: q[c][0] if c in q else None for c in numeric}
            p.q3 = {c: q[c][1] if c in q else None for c in numeric}
        if categorical:
            # counts per (column, level); the mode (smallest on ties) is a level, so it adds none
            counts = df.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot(
                [], categorical, "variable", "level").where(F.col("level").isNotNull()).groupBy("variable", "level").count()
            first = F.min_by("level", F.struct((-F.col("count")).alias("neg"), F.col("level")))
            per = {r["variable"]: r for r in counts.groupBy("variable").agg(first.alias("mode"), F.count(F.lit(1)).alias("n")).collect()}
            wide = [c for c, r in per.items() if r["n"] > MAX_LEVELS]
            if wide:
                raise ValueError(f"one-hot columns with more than {MAX_LEVELS} levels: {wide}; group rare levels first")
            levels: dict[str, list[str]] = {c: [] for c in categorical}
            for r in counts.collect():  # at most MAX_LEVELS rows per column
                levels[r["variable"]].append(r["level"])
            p.modes = {c: per[c]["mode"] if c in per else None for c in categorical}
            p.levels = {c: sorted(v) for c, v in levels.items()}
        return p

    # -- transform --------------------------------------------------------
    def imputed_columns(self) -> dict[str, Column]:
        out = {c: F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in self.numeric}
        out.update({c: F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c])) for c in self.categorical})
        return out

    def feature_columns(self) -> list[tuple[str, Column]]:
        cols = []
        for c in self.numeric:
            med, q1, q3 = self.medians[c], self.q1[c], self.q3[c]
            scale = (q3 - q1) if (q1 is not None and q3 is not None and q3 - q1 != 0) else 1.0
            x = F.coalesce(F.col(c).cast("double"), F.lit(med))
            cols.append((f"num__{c}", (x - F.lit(med if med is not None else 0.0)) / F.lit(scale)))
        for c in self.categorical:
            v = F.coalesce(F.col(c).cast("string"), F.lit(self.modes[c]))
            for lvl in self.levels[c]:
                cols.append((f"cat__{c}_{lvl}", F.when(v == F.lit(lvl), 1.0).otherwise(0.0)))
        return cols

    @property
    def feature_names(self) -> list[str]:
        return [n for n, _ in self.feature_columns()]

    def transform(self, df: DataFrame, keep: list[str] = ("row_id",), as_array: str | None = "features") -> DataFrame:
        fc = self.feature_columns()
        if as_array:
            return df.select(*keep, F.array(*[c for _, c in fc]).alias(as_array))
        return df.select(*keep, *[c.alias(n) for n, c in fc])

    # -- persistence (SRC-08) ---------------------------------------------
    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> "Preprocessor":
        return cls(**json.loads(text))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.to_json(),)], "params string").coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark, path: str) -> "Preprocessor":
        return cls.from_json(spark.read.json(path).first()["params"])


# ------------------------------------------------------------------ SVD ----

def vectors_of(batch: pa.RecordBatch) -> np.ndarray:
    """The matrix of an array column's batch; as before, rows of unequal length are an error and nulls are NaN."""
    column = batch.column(0)
    if column.null_count or (np.diff(column.offsets.to_numpy()) != column.offsets[1].as_py() - column.offsets[0].as_py()).any():
        return np.vstack(column.to_numpy(zero_copy_only=False)).astype(float)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def gram_matrix(df: DataFrame, col: str, dim: int) -> np.ndarray:
    """XᵀX of an array column: each partition sums its own p×p block in numpy
    (Arrow batches); only (#partitions × p²) numbers reach the driver."""
    def part(batches):
        acc = np.zeros((dim, dim))
        for batch in batches:
            if batch.num_rows:
                x = vectors_of(batch)
                acc += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([acc.ravel().tolist()])], names=["g"])
    blocks = df.select(col).mapInArrow(part, "g array<double>")
    summed = blocks.select(F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
    g = np.zeros(dim * dim)
    for r in summed:
        g[r["i"]] = r["v"]
    return g.reshape(dim, dim)


def moments(df: DataFrame, col: str, components: list[list[float]]) -> tuple[list, list]:
    """Mean and population sd of the projections.  A task sends its count, means and squared deviations, which are merged
    without differences of large sums."""
    v, k = np.array(components, float).T, len(components)

    def part(batches):
        n, mean, spread = 0, np.zeros(k), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                z = vectors_of(batch) @ v
                n, mean, spread = _merged((n, mean, spread), (len(z), z.mean(axis=0), ((z - z.mean(axis=0)) ** 2).sum(axis=0)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([mean.tolist()]), pa.array([spread.tolist()])], names=["n", "m", "s"])

    total = (0, np.zeros(k), np.zeros(k))
    for r in df.select(col).mapInArrow(part, "n long, m array<double>, s array<double>").collect():  # one row per task
        total = _merged(total, (r["n"], np.array(r["m"]), np.array(r["s"])))
    n, mean, spread = total
    return (mean.tolist(), np.sqrt(spread / n).tolist()) if n else ([None] * k, [None] * k)


def _merged(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + gap ** 2 * (a[0] * b[0] / n)


@dataclass
class Reducer:
    """ML-06 + ML-07: uncentred truncated SVD (right singular vectors of X from the
    eigen-decomposition of XᵀX) followed by a centred standard scaler (ddof 0,
    zero variance -> 1).  Skipped (scaler only) when p <= 2."""
    components: list[list[float]] | None
    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, df: DataFrame, col: str, dim: int, n_rows: int, max_components: int = 15) -> "Reducer":
        comps = None
        if dim > 2:
            k = min(max_components, n_rows - 1, dim - 1)
            k = k if k >= 2 else min(2, dim)
            w, v = np.linalg.eigh(gram_matrix(df, col, dim))
            order = np.argsort(w)[::-1][:k]
            v = v[:, order]
            # sign convention: largest |loading| of each component is positive
            signs = np.sign(v[np.abs(v).argmax(axis=0), range(v.shape[1])])
            signs[signs == 0] = 1
            comps = (v * signs).T.tolist()
        red = cls(comps, [], [])
        if comps:
            mean, sd = moments(df, col, comps)
        else:  # of the columns themselves, nulls left out
            st = red._project(df, col).agg(*[f(F.col("z")[i]).alias(f"{n}{i}") for i in range(dim) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
            mean, sd = [st[f"m{i}"] for i in range(dim)], [st[f"s{i}"] for i in range(dim)]
        red.mean = mean
        red.scale = [s if s else 1.0 for s in sd]
        return red

    def _project(self, df: DataFrame, col: str, keep: list[str] = ()) -> DataFrame:
        if self.components is None:
            return df.select(*keep, F.col(col).alias("z"))
        comps = [F.lit(np.array(c, dtype=float).tolist()) for c in self.components]
        dots = [F.aggregate(F.zip_with(F.col(col), cv, lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
                for cv in comps]
        return df.select(*keep, F.array(*dots).alias("z"))

    def transform(self, df: DataFrame, col: str = "features", keep: list[str] = ("row_id",), out: str = "embedding") -> DataFrame:
        z = self._project(df, col, list(keep))
        k = len(self.mean)
        scaled = [(F.col("z")[i] - F.lit(self.mean[i])) / F.lit(self.scale[i]) for i in range(k)]
        return z.select(*keep, F.array(*scaled).alias(out))


def standard_scale(df: DataFrame, cols: list[str]) -> DataFrame:
    """ML-07 on plain columns: (x - mean) / population sd, zero sd -> 1."""
    st = df.agg(*[F.avg(c).alias(f"m__{c}") for c in cols], *[F.stddev_pop(c).alias(f"s__{c}") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - F.lit(st[f"m__{c}"])) / F.lit(st[f"s__{c}"] or 1.0) for c in cols})


def to_vector(df: DataFrame, col: str = "embedding", out: str = "features") -> DataFrame:
    """array<double> -> ML vector column for Spark ML estimators."""
    return df.withColumn(out, array_to_vector(F.col(col)))

