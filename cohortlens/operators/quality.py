"""Data quality and descriptive statistics (outliers, missingness, EDA).

Design: statistics over many columns are computed in ONE wide aggregate
(map-side partial aggregation, one shuffle of a single small row per
partition) instead of one job per column.  Long ("melted") outputs are made
by unpivoting that one-row result, so the row count of the data never
multiplies.  Where a second pass needs the first pass's numbers (fences,
means), those numbers are at most a few per column and are inlined as
literals, which keeps the second pass inside whole-stage codegen.

Quantiles are exact at every size (linear interpolation, the same definition
as the reference); see ``functions.quantiles``.  NaN is no value.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.quantiles import column_quantiles, exact_quantiles

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame, suggested: list[str] | None = None, exclude: list[str] | None = None) -> list[str]:
    """PRJ-06: suggested columns that exist, else every numeric column."""
    exclude = set(exclude or [])
    if suggested:
        present = [c for c in suggested if c in df.columns and c not in exclude]
        if present:
            return present
    return [f.name for f in df.schema.fields if isinstance(f.dataType, _NUMERIC) and f.name not in exclude]


def _melt_one_row(row_df: DataFrame, cols: list[str], fields: list[str]) -> DataFrame:
    """Turn a one-row frame with ``{col}__{field}`` columns into one row per column."""
    structs = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"`{c}__{f}`").alias(f) for f in fields])
        for c in cols
    ]
    return row_df.select(F.explode(F.array(*structs)).alias("s")).select("s.*")


def iqr_outliers(df: DataFrame, cols: list[str], factor: float = 1.5) -> DataFrame:
    """AG-12: q1/q3 (linear), fences q ± factor·IQR, outlier count and % of ALL rows.  NaN is no value."""
    if not cols:
        raise ValueError("no columns")
    quart = column_quantiles(df, cols, [0.25, 0.75])
    stats = {}
    for c in cols:
        q = quart.get(c)
        if q is None:  # empty after dropping nulls: skipped
            continue
        q1, q3 = float(q[0]), float(q[1])
        iqr = q3 - q1
        stats[c] = (q1, q3, iqr, q1 - factor * iqr, q3 + factor * iqr)
    if not stats:
        return df.sparkSession.createDataFrame([], _IQR_SCHEMA)
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(((F.col(c) < lo) | (F.col(c) > hi)) & ~F.isnan(F.col(c).cast("double"))).alias(c) for c, (_, _, _, lo, hi) in stats.items()],
    )
    structs = [
        F.struct(
            F.lit(c).alias("variable"), F.lit("IQR").alias("method"),
            F.lit(q1).alias("q1"), F.lit(q3).alias("q3"), F.lit(iqr).alias("iqr"),
            F.lit(lo).alias("lower_fence"), F.lit(hi).alias("upper_fence"),
            F.col(f"`{c}`").alias("n_outliers"),
            (F.col(f"`{c}`") * 100.0 / F.col("__n")).alias("pct_outliers"),
        )
        for c, (q1, q3, iqr, lo, hi) in stats.items()
    ]
    return counts.select(F.explode(F.array(*structs)).alias("s")).select("s.*").orderBy(
        F.desc("n_outliers"), "variable")


_IQR_SCHEMA = T.StructType([
    T.StructField("variable", T.StringType()), T.StructField("method", T.StringType()),
    T.StructField("q1", T.DoubleType()), T.StructField("q3", T.DoubleType()),
    T.StructField("iqr", T.DoubleType()), T.StructField("lower_fence", T.DoubleType()),
    T.StructField("upper_fence", T.DoubleType()), T.StructField("n_outliers", T.LongType()),
    T.StructField("pct_outliers", T.DoubleType()),
])


def zscore_outliers(df: DataFrame, cols: list[str], threshold: float = 3.0) -> DataFrame:
    """AG-13: |x - mean| / sd > threshold with sample sd; columns with sd 0 or empty skipped."""
    def value(c):
        return F.when(~F.isnan(F.col(c).cast("double")), F.col(c))  # NaN is no value

    moments = df.agg(*[F.avg(value(c)).alias(f"{c}__m") for c in cols], *[F.stddev_samp(value(c)).alias(f"{c}__s") for c in cols]).first()
    keep = {c: (moments[f"{c}__m"], moments[f"{c}__s"]) for c in cols
            if moments[f"{c}__s"] is not None and moments[f"{c}__s"] != 0}
    if not keep:
        return df.sparkSession.createDataFrame([], "variable string, method string, mean double, sd double, "
                                                   "threshold double, n_outliers bigint, pct_outliers double")
    counts = df.agg(
        F.count(F.lit(1)).alias("__n"),
        *[F.count_if(F.abs((value(c) - F.lit(m)) / F.lit(s)) > threshold).alias(c) for c, (m, s) in keep.items()],
    )
    structs = [
        F.struct(
            F.lit(c).alias("variable"), F.lit("zscore").alias("method"), F.lit(float(m)).alias("mean"),
            F.lit(float(s)).alias("sd"), F.lit(float(threshold)).alias("threshold"),
            F.col(f"`{c}`").alias("n_outliers"), (F.col(f"`{c}`") * 100.0 / F.col("__n")).alias("pct_outliers"),
        )
        for c, (m, s) in keep.items()
    ]
    return counts.select(F.explode(F.array(*structs)).alias("s")).select("s.*").orderBy(F.desc("n_outliers"), "variable")


def top_outlier_variables(summary: DataFrame, n: int = 6) -> DataFrame:
    """AG-14: the n variables with most outliers (ties by name)."""
    return summary.orderBy(F.desc("n_outliers"), F.asc("variable")).limit(n)


def null_rates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """AG-08: null count and null rate per column, one aggregate for all columns.

    Float NaN counts as missing (pandas semantics)."""
    cols = cols or df.columns
    types = dict(df.dtypes)

    def missing(c):
        m = F.col(f"`{c}`").isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(F.col(f"`{c}`"))
        return m

    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(missing(c)).alias(f"{c}__k") for c in cols])
    structs = [F.struct(F.lit(c).alias("variable"), F.col(f"`{c}__k`").alias("n_missing"),
                        (F.col(f"`{c}__k`") / F.col("__n")).alias("missing_rate")) for c in cols]
    return row.select(F.explode(F.array(*structs)).alias("s")).select("s.*").orderBy(F.desc("missing_rate"), "variable")


def missing_comparison(pre: DataFrame, post: DataFrame) -> DataFrame:
    """JN-09 / AG-09: side-by-side missingness of two versions of a table.

    ``in_pre``/``in_post`` flag column presence; difference = pre - post on shared columns."""
    a = null_rates(pre).select("variable", F.col("n_missing").alias("missing_pre"), F.col("missing_rate").alias("rate_pre"))
    b = null_rates(post).select("variable", F.col("n_missing").alias("missing_post"), F.col("missing_rate").alias("rate_post"))
    return (a.join(b, "variable", "full")
            .withColumn("in_pre", F.col("missing_pre").isNotNull())
            .withColumn("in_post", F.col("missing_post").isNotNull())
            .withColumn("missing_diff", F.col("missing_pre") - F.col("missing_post")))


def overview(df: DataFrame, target: str | None = None, label: str = "data") -> DataFrame:
    """AG-10: rows, columns and target mean of one table (union two for a before/after view)."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    aggs.append(F.avg(target).alias("target_mean") if target and target in df.columns else F.lit(None).cast("double").alias("target_mean"))
    return df.agg(*aggs).select(F.lit(label).alias("dataset"), "n_rows",
                                F.lit(len(df.columns)).cast("int").alias("n_columns"), "target_mean")


def schema_profile(df: DataFrame, top: int = 15) -> tuple[DataFrame, DataFrame]:
    """AG-11: (columns per Spark type, the ``top`` columns with most nulls)."""
    spark = df.sparkSession
    types = spark.createDataFrame([(c, t) for c, t in df.dtypes], "variable string, dtype string")
    by_type = types.groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))
    return by_type, top_outlier_like(null_rates(df), "n_missing", top)


def top_outlier_like(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(col), F.asc("variable")).limit(n)


def category_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """AG-07 / PRE-03: frequency of every value of every categorical column (nulls as 'nan')."""
    melted = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("nan")).alias(c) for c in cols]).unpivot(
        [], cols, "variable", "value")
    return melted.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("variable", F.desc("n"), "value")


def outcome_rate_by_category(df: DataFrame, col: str, target: str) -> DataFrame:
    """AG-06: target mean and size per category, nulls in a 'Missing' bucket."""
    return (df.groupBy(F.coalesce(F.col(col).cast("string"), F.lit("Missing")).alias("category"))
            .agg(F.count(F.lit(1)).alias("n"), F.avg(target).alias("outcome_rate"))
            .orderBy(F.desc("outcome_rate"), "category"))


def boxplot_stats(df: DataFrame, cols: list[str], by: str | None = None, factor: float = 1.5) -> DataFrame:
    """AG-15: quartiles, whiskers (most extreme points inside the fences) and flier counts.

    Grouped by variable (and optionally by a class column).  The quartile table
    has (#variables × #classes) rows and is joined back by broadcast."""
    keys = [by] if by else []
    melted = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        keys, cols, "variable", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
    quart = exact_quantiles(df, cols, [0.25, 0.5, 0.75], keys)
    quart = quart.select(*keys, "variable", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    quart = quart.withColumn("lo", F.col("q1") - factor * (F.col("q3") - F.col("q1"))) \
                 .withColumn("hi", F.col("q3") + factor * (F.col("q3") - F.col("q1")))
    joined = melted.join(F.broadcast(quart), [*keys, "variable"])
    inside = (F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi"))
    return joined.groupBy(*keys, "variable", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_fliers"),
        F.count(F.lit(1)).alias("n"),
    )


def histogram(df: DataFrame, cols: list[str], bins: int = 30) -> DataFrame:
    """AG-16: equal-width bins between min and max per variable (last bin closed), counts."""
    ext = df.agg(*[F.min(c).alias(f"{c}__lo") for c in cols], *[F.max(c).alias(f"{c}__hi") for c in cols]).first()
    parts = []
    for c in cols:
        lo, hi = ext[f"{c}__lo"], ext[f"{c}__hi"]
        if lo is None:
            continue
        lo, hi = float(lo), float(hi)
        width = (hi - lo) / bins if hi > lo else 1.0
        b = F.least(F.floor((F.col(c) - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
        parts.append(F.struct(F.lit(c).alias("variable"), F.when(F.col(c).isNotNull(), b).alias("bin"),
                              F.lit(lo).alias("lo"), F.lit(width).alias("width")))
    exploded = df.select(F.explode(F.array(*parts)).alias("s")).select("s.*").where(F.col("bin").isNotNull())
    return exploded.groupBy("variable", "bin", "lo", "width").agg(F.count(F.lit(1)).alias("n")).select(
        "variable", "bin", (F.col("lo") + F.col("bin") * F.col("width")).alias("bin_start"),
        (F.col("lo") + (F.col("bin") + 1) * F.col("width")).alias("bin_end"), "n")


def kde_grid(df: DataFrame, col: str, grid_points: int = 64, group: str | None = None) -> DataFrame:
    """AG-17: Gaussian kernel density on a grid, Scott bandwidth sd·n^(-1/5); exact kernel sums.

    Rows become counts per distinct value first; one grouped aggregate with a sum per grid point does the rest, so no
    row is multiplied.  Groups without spread (sd 0 or a single row) have no density."""
    keys = [group] if group else []
    base = df.select(*keys, F.col(col).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    counts = base.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("cnt"))
    st = base.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("x").alias("sd"),
                                 F.min("x").alias("lo"), F.max("x").alias("hi"))
    st = st.where("sd > 0").withColumn("h", F.col("sd") * F.pow(F.col("n"), F.lit(-0.2)))
    if keys:
        weighted = counts.join(st, keys)
    else:
        # one-row statistics: inline as literals instead of joining
        r = st.first()
        weighted = counts.select("x", "cnt", *[F.lit(r[k] if r else None).cast("double").alias(k) for k in ("n", "lo", "hi", "h")])
        weighted = weighted.where(F.col("h").isNotNull())

    def at(g):
        return F.col("lo") - 3 * F.col("h") + F.lit(g) * (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (grid_points - 1)

    scale = F.col("n") * F.col("h") * F.lit((2 * 3.141592653589793) ** 0.5)
    sums = weighted.groupBy(*keys, "n", "lo", "hi", "h").agg(
        *[F.sum(F.col("cnt") * F.exp(-0.5 * F.pow((at(g) - F.col("x")) / F.col("h"), 2))).alias(f"g{g}") for g in range(grid_points)])
    points = F.array(*[F.struct(F.lit(g).alias("grid_index"), at(g).alias("x"), (F.col(f"g{g}") / scale).alias("density"))
                       for g in range(grid_points)])
    return sums.select(*keys, F.explode(points).alias("p")).select(*keys, "p.grid_index", "p.x", "p.density")


# --- preprocessing steps named by the reference (semantics are ours) ---------

def group_rare_categories(df: DataFrame, col: str, top_n: int = 5, other: str = "other") -> DataFrame:
    """PRE-02: keep the ``top_n`` most frequent values (ties by value), map the rest to ``other``.

    The kept list has at most ``top_n`` rows by construction, so it is inlined."""
    keep = [r[0] for r in df.groupBy(col).count().where(F.col(col).isNotNull())
            .orderBy(F.desc("count"), F.asc(col)).limit(top_n).collect()]
    return df.withColumn(col, F.when(F.col(col).isNull(), F.lit(None))
                         .when(F.col(col).isin(keep), F.col(col).cast("string")).otherwise(F.lit(other)))


def frequency_codes(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRE-04 (table): integer code per category = rank by count desc, then value (0 = most frequent)."""
    counts = category_counts(df, cols).where(F.col("value") != "nan")
    from pyspark.sql import Window as W
    w = W.partitionBy("variable").orderBy(F.desc("n"), F.asc("value"))
    return counts.withColumn("code", (F.row_number().over(w) - 1).cast("int"))


def encode_categories(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRE-04: replace categories by their frequency codes.  The code table grows with the categories, so it is joined
    plainly: Spark broadcasts it only below its size threshold and splits hot categories otherwise."""
    codes = frequency_codes(df, cols)
    out = df
    for c in cols:
        m = codes.where(F.col("variable") == c).select(F.col("value").alias(f"__v_{c}"), F.col("code").alias(f"__c_{c}"))
        out = out.join(m, F.col(c).cast("string") == F.col(f"__v_{c}"), "left").drop(c, f"__v_{c}").withColumnRenamed(f"__c_{c}", c)
    return out


def sparse_column_report(df: DataFrame, max_missing_rate: float) -> DataFrame:
    """PRE-06 (decision table): null rate per column and whether it is dropped."""
    return null_rates(df).select("variable", "missing_rate",
                                 (F.col("missing_rate") > max_missing_rate).alias("dropped"))


def drop_sparse_columns(df: DataFrame, max_missing_rate: float, keep: list[str] | None = None) -> DataFrame:
    """PRE-06: drop columns whose null rate is above the threshold (one aggregate;
    the collected table has one row per column)."""
    keep = set(keep or [])
    dropped = [r["variable"] for r in sparse_column_report(df, max_missing_rate).where("dropped").collect()]
    return df.drop(*[c for c in dropped if c not in keep])


def negatives_to_null(df: DataFrame, cols: list[str]) -> DataFrame:
    """PRE-07: negative measurements become null."""
    return df.withColumns({c: F.when(F.col(c) < 0, F.lit(None)).otherwise(F.col(c)) for c in cols})


def drop_date_columns(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """PRE-08: drop date/timestamp columns and any listed by name."""
    dated = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))]
    return df.drop(*dated, *(extra or []))


def union_tagged(frames: dict[str, DataFrame]) -> DataFrame:
    """ML-20 helper: stack equally shaped results with a ``source`` tag."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("source", F.lit(k)) for k, f in frames.items()])
