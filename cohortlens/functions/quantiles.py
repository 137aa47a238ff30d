"""Exact quantiles at every size, from counts per distinct value.

Rows are reduced to (keys, variable, value, count) with map-side aggregation, the counts get their position by the
distributed prefix sum of ``operators.ranks`` (value ranges, no task holds a whole variable), and a quantile is read
off the one or two values around its position, with linear interpolation.  Nulls and NaN do not count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """keys, variable, x, n: how often each value of each numeric column occurs."""
    melted = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot(
        list(keys), list(cols), "variable", "x")
    return melted.where(F.col("x").isNotNull() & ~F.isnan("x")).groupBy(*keys, "variable", "x").agg(F.count(F.lit(1)).alias("n"))


def exact_quantiles(df: DataFrame, cols: list[str], probs: list[float], keys: list[str] = ()) -> DataFrame:
    """keys, variable, q (array, one per probability), n_values (non-null), n_distinct.  A column (or group) without
    values has no row."""
    return _read_off(_ranked(df, cols, keys), [*keys, "variable"], probs)


def _ranked(df: DataFrame, cols: list[str], keys: list[str] = ()) -> DataFrame:
    """The counts with ``before`` and, per group, n_values and n_distinct."""
    from ..operators.ranks import ranked_value_counts
    groups = [*keys, "variable"]
    counts = value_counts(df, cols, keys)
    totals = counts.groupBy(*groups).agg(F.sum("n").alias("n_values"), F.count(F.lit(1)).alias("n_distinct"))
    return ranked_value_counts(counts, groups, "x", "n").join(totals, groups)


def _read_off(ranked: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    def at(position):
        return F.max(F.when((F.col("before") <= position) & (position < F.col("before") + F.col("n")), F.col("x")))

    found = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n_values") - 1)
        found += [at(F.floor(position)).alias(f"lo{i}"), at(F.ceil(position)).alias(f"hi{i}")]
    picked = ranked.groupBy(*groups, "n_values", "n_distinct").agg(*found)
    values = []
    for i, p in enumerate(probs):
        position = F.lit(float(p)) * (F.col("n_values") - 1)
        values.append(F.col(f"lo{i}") + (F.col(f"hi{i}") - F.col(f"lo{i}")) * (position - F.floor(position)))
    return picked.select(*groups, F.array(*values).alias("q"), "n_values", "n_distinct")


def stored_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """The ranked counts of the columns as a table in the shared folder, for several readings of one set of counts."""
    from ..sources.ingest import scratch_path
    path = scratch_path(df.sparkSession, "ranks")
    _ranked(df, cols).select("variable", "x", "n", "before", "n_values", "n_distinct").write.parquet(path)
    return df.sparkSession.read.parquet(path)


def with_copies(ranked: DataFrame, added: dict[str, tuple[float, int]]) -> DataFrame:
    """Ranked counts after ``added`` has put copies of a number (variable: number, copies) among a variable's values."""
    if not added:
        return ranked
    extra = ranked.sparkSession.createDataFrame([(v, float(m), int(n)) for v, (m, n) in added.items()], "variable string, at double, copies long")
    joined = ranked.join(F.broadcast(extra), "variable", "left")  # one row per variable
    copies = F.coalesce("copies", F.lit(0))
    held = joined.select("variable", "x", "n", (F.col("before") + F.when(F.col("x") > F.col("at"), copies).otherwise(0)).alias("before"),
                         (F.col("n_values") + copies).alias("n_values"), "n_distinct")
    # the copies stand behind the equal values, which keep their places
    below = joined.where("at IS NOT NULL").groupBy("variable", "at", "copies", "n_values", "n_distinct").agg(
        F.sum(F.when(F.col("x") <= F.col("at"), F.col("n")).otherwise(0)).alias("before"))
    return held.unionByName(below.select("variable", F.col("at").alias("x"), F.col("copies").alias("n"), "before",
                                         (F.col("n_values") + F.col("copies")).alias("n_values"), "n_distinct"))


def ranked_quantiles(ranked: DataFrame, probs: list[float]) -> dict[str, list[float]]:
    """Quantiles per column of ranked counts, on the driver."""
    return {r["variable"]: list(r["q"]) for r in _read_off(ranked, ["variable"], probs).collect()}


def column_quantiles(df: DataFrame, cols: list[str], probs: list[float]) -> dict[str, list[float]]:
    """Quantiles per column on the driver (one row per column); a column without values is missing."""
    return {r["variable"]: list(r["q"]) for r in exact_quantiles(df, cols, probs).collect()} if cols else {}
