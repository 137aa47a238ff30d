"""Average-tie ranks computed without sorting all rows in one task.

Ranks are needed by Spearman correlation, Kruskal-Wallis, ROC AUC and the
experiment ranking.  The work is done on *distinct values* (counts per
(group, value)), never on raw rows, and the prefix sum over the ordered
values is distributed:

1. approximate quantiles of the distinct values split each group into
   ``ranges`` value ranges (a table of #groups rows);
2. totals per (group, range) get their offsets from a window over that
   small table;
3. inside a range a window partitioned by (group, range) adds the local
   prefix.  Each window task holds ~1/ranges of a group's distinct values.

So even a single variable with billions of distinct values is spread over
``ranges`` tasks, and a hot value is just one row of the counts table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000   # distinct values one window task may hold
MAX_RANGES = 65_536


def _range_index(bounds: Column, key: Column, n_bounds: int) -> Column:
    """Number of bounds strictly below ``key`` by binary search over the sorted bounds
    (O(log ranges) per row, so thousands of ranges stay cheap)."""
    if n_bounds <= 256:  # few bounds: one linear pass is cheaper than a lambda loop
        return F.size(F.filter(bounds, lambda b: b < key))
    steps = max(1, math.ceil(math.log2(n_bounds + 1)) + 1)
    init = F.struct(F.lit(0).alias("lo"), F.lit(n_bounds).alias("hi"))

    def step(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        below = F.element_at(bounds, mid + 1) < key
        moved = F.when(below, F.struct((mid + 1).alias("lo"), acc["hi"].alias("hi"))).otherwise(
            F.struct(acc["lo"].alias("lo"), mid.alias("hi")))
        return F.when(acc["lo"] < acc["hi"], moved).otherwise(acc)
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), init, step)["lo"]


def ranked_value_counts(counts: DataFrame, groups: list[str], value: str, weight: str = "n",
                        ranges: int | str = "auto", descending: bool = False, tie_break: list[str] = ()) -> DataFrame:
    """Add ``before`` (#rows with a strictly smaller value in the group) and
    ``avg_rank`` (1-based average rank of the value's ties) to a counts table.

    ``counts`` must have one row per (groups, value) with a positive ``weight``."""
    v = F.col(value)
    key = (-v.cast("double")) if descending else v.cast("double")
    c = counts.withColumn("__k", key)
    drop_g = not groups
    if drop_g:  # a constant group keeps every step an equi-join
        c = c.withColumn("__g", F.lit(0))
        groups = ["__g"]
    auto = ranges == "auto"
    if auto:
        ranges = 64

    def bounds_for(r):
        probs = [i / r for i in range(1, r)]
        return c.groupBy(*groups).agg(
            F.percentile_approx("__k", F.array(*[F.lit(p) for p in probs]), max(1000, 4 * r)).alias("__b"))
    if ranges > 1:
        if auto:  # more ranges only when one of 64 would be too big
            largest = c.groupBy(*groups).count().agg(F.max("count")).first()[0] or 1
            ranges = int(min(MAX_RANGES, max(64, math.ceil(largest / ROWS_PER_RANGE))))
        bounds = bounds_for(ranges)
        if drop_g:
            # a single group: its bounds are one row of <= MAX_RANGES numbers, inlined as a literal
            row = bounds.first()
            b = F.array(*[F.lit(float(v)) for v in (row["__b"] or [])]) if row else F.array().cast("array<double>")
            c = c.withColumn("__r", _range_index(b, F.col("__k"), ranges - 1))
        else:
            # bounds: one row per group (#variables / #pairs) of <= MAX_RANGES numbers
            c = c.join(F.broadcast(bounds), groups, "left")
            c = c.withColumn("__r", _range_index(F.col("__b"), F.col("__k"), ranges - 1)).drop("__b")
    else:
        c = c.withColumn("__r", F.lit(0))
    tot = c.groupBy(*groups, "__r").agg(F.sum(weight).alias("__t"))
    wo = W.partitionBy(*groups).orderBy("__r").rowsBetween(W.unboundedPreceding, -1)
    tot = tot.withColumn("__off", F.coalesce(F.sum("__t").over(wo), F.lit(0))).drop("__t")
    c = c.join(tot.drop("__g") if drop_g else tot, ["__r"] if drop_g else [*groups, "__r"])
    wl = W.partitionBy(*groups, "__r").orderBy("__k", *tie_break).rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("before", F.col("__off") + F.coalesce(F.sum(weight).over(wl), F.lit(0)))
    c = c.withColumn("avg_rank", F.col("before") + (F.col(weight) + 1) / 2.0)
    return c.drop("__k", "__r", "__off", *(["__g"] if drop_g else []))


def average_rank(df: DataFrame, value: str, groups: list[str] | None = None, descending: bool = False,
                 out: str = "rank") -> DataFrame:
    """Per-row average-tie rank of ``value`` within ``groups`` (nulls get null)."""
    groups = groups or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ranked_value_counts(counts, groups, value, "__n", descending=descending).select(
        *groups, value, F.col("avg_rank").alias(out))
    return df.join(ranked, [*groups, value], "left")


def percentile_rank(df: DataFrame, value: str, higher_is_better: bool = True, groups: list[str] | None = None,
                    out: str = "rank_pct") -> DataFrame:
    """WN-01: average-tie rank / count of non-null values, so that 1.0 is the best value.

    ``higher_is_better`` ranks ascending (largest value -> 1.0); otherwise descending."""
    groups = groups or []
    ranked = average_rank(df, value, groups, descending=not higher_is_better, out="__rk")
    n = df.where(F.col(value).isNotNull()).groupBy(*groups).agg(F.count(F.lit(1)).alias("__cnt"))
    if groups:
        ranked = ranked.join(F.broadcast(n), groups, "left")
    else:
        ranked = ranked.withColumn("__cnt", F.lit(n.first()["__cnt"]))
    return ranked.withColumn(out, F.col("__rk") / F.col("__cnt")).drop("__rk", "__cnt")


def percentile_rank_small(df: DataFrame, value: str, higher_is_better: bool = True, out: str = "rank_pct") -> DataFrame:
    """WN-01 for tables bounded by construction (experiment lists, cluster summaries):
    plain windows, rank + (ties - 1)/2 over the non-null count."""
    order = F.col(value).asc_nulls_last() if higher_is_better else F.col(value).desc_nulls_last()
    everything = W.partitionBy()
    avg_rank = F.rank().over(everything.orderBy(order)) + (F.count(F.lit(1)).over(W.partitionBy(value)) - 1) / 2.0
    return df.withColumn(out, F.when(F.col(value).isNotNull(), avg_rank / F.count(value).over(everything)))


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank", salt_buckets: int = 32) -> DataFrame:
    """First ``k`` rows per key by ``order`` (must be a total order), skew-safe: stage 1
    keeps k rows per (key, salt) so a hot key is spread over ``salt_buckets`` tasks, stage 2
    ranks the <= k·salt_buckets survivors per key."""
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(salt_buckets)))
    s1 = salted.withColumn("__r1", F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order))) \
               .where(F.col("__r1") <= k).drop("__r1", "__salt")
    return s1.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
