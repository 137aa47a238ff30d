"""Readers for the driver tables and the stand-in cohort built from them.

The reference works on one flat patient table.  The driver data has no
patients, so the stand-in ``cohort`` has one row per order (``row_id`` =
``o_orderkey``, unique) with categorical codes, min/max measures, a binary
flag, a constant column, a post-outcome (leakage) column and a 0/1 target.
Orders without line items give genuine NULL measures.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

# The five TPC-H market segments, in alphabetical order; the
# stand-in cluster id of a row is the position of its segment in this list.
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

COHORT_ID_COLUMNS = ["row_id", "subject_id"]
COHORT_CATEGORICAL = ["cat_priority", "cat_segment", "cat_region"]
COHORT_MEASURES = [
    "totalprice", "acctbal", "quantity_min", "quantity_max", "price_min", "price_max",
    "discount_max", "tax_max",
]
COHORT_BINARY = ["has_return"]
COHORT_TARGET = "target"
COHORT_LEAKAGE = ["leakage_last_ship"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_MATERIALIZED: dict[tuple, str] = {}


def _fingerprint(spark: SparkSession, sf_dir: str, names: list[str]) -> str:
    """Identity of the input files: path, size and time of change of each, as the store lists them."""
    parts = []
    for n in names:
        p = f"{sf_dir.rstrip('/')}/{n}.parquet"
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        parts += sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in store.listStatus(path))
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def materialized(spark: SparkSession, name: str, sf_dir: str, inputs: list[str], build) -> DataFrame:
    """Write a derived table once per session and input fingerprint into the shared
    checkpoint folder, then read it as parquet (pruning and pushdown apply).  Queries that
    use it never re-run the joins that produced it; lineage is cut by the write."""
    from ..session import ensure_checkpoint_dir
    key = (id(spark.sparkContext), name, sf_dir, _fingerprint(spark, sf_dir, inputs))
    path = _MATERIALIZED.get(key)
    if path is not None:
        try:
            return spark.read.parquet(path)
        except Exception:  # files removed since (e.g. a cleaned checkpoint folder): rebuild
            _MATERIALIZED.pop(key, None)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{key[3]}-{uuid.uuid4().hex[:8]}"
    build().write.mode("overwrite").parquet(path)
    _MATERIALIZED[key] = path
    return spark.read.parquet(path)


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order (materialised once per session; see ``build_cohort``)."""
    return materialized(spark, "cohort", sf_dir, ["orders", "customer", "nation", "lineitem"],
                        lambda: build_cohort(spark, sf_dir))


def build_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order; see FIXTURES.md §2.1 for the equivalent SQL."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
    customer = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    # nation has 25 rows by definition of the schema: a proven bound for broadcast
    nation = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    lines = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(
            F.min("l_quantity").alias("quantity_min"),
            F.max("l_quantity").alias("quantity_max"),
            F.min("l_extendedprice").alias("price_min"),
            F.max("l_extendedprice").alias("price_max"),
            F.max("l_discount").alias("discount_max"),
            F.max("l_tax").alias("tax_max"),
            F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("has_return"),
            F.max("l_shipdate").alias("last_ship"),
        )
    )
    joined = (
        orders
        .join(customer, orders.o_custkey == customer.c_custkey, "left")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    )
    return joined.select(
        F.col("o_orderkey").alias("row_id"),
        F.col("o_custkey").alias("subject_id"),
        F.col("o_orderpriority").alias("cat_priority"),
        F.col("c_mktsegment").alias("cat_segment"),
        F.col("n_regionkey").cast("string").alias("cat_region"),
        F.col("o_totalprice").alias("totalprice"),
        F.col("c_acctbal").alias("acctbal"),
        "quantity_min", "quantity_max", "price_min", "price_max", "discount_max", "tax_max",
        F.col("has_return").cast("int").alias("has_return"),
        F.lit(1).alias("constant_col"),
        F.col("last_ship").alias("leakage_last_ship"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("int").alias("target"),
    )


def segment_cluster(col: str = "cat_segment"):
    """Stand-in cluster id: position of the segment in ``SEGMENTS`` (null if unknown)."""
    expr = F.lit(None).cast("int")
    for idx, seg in reversed(list(enumerate(SEGMENTS))):
        expr = F.when(F.col(col) == seg, F.lit(idx)).otherwise(expr)
    return expr


def clustered_cohort(spark: SparkSession, sf_dir: str, with_noise: bool = False) -> DataFrame:
    """Cohort with a ``cluster`` column (segment index).

    ``with_noise`` marks customers with a negative balance as noise (-1), a
    data-driven stand-in for density-clustering noise.
    """
    df = cohort(spark, sf_dir).withColumn("cluster", segment_cluster())
    if with_noise:
        df = df.withColumn("cluster", F.when(F.col("acctbal") < 0, F.lit(-1)).otherwise(F.col("cluster")))
    return df


# --- SQL text of the same fixtures, used by the DuckDB oracle -----------------

COHORT_SQL = """
SELECT o.o_orderkey AS row_id, o.o_custkey AS subject_id,
       o.o_orderpriority AS cat_priority, c.c_mktsegment AS cat_segment,
       CAST(n.n_regionkey AS VARCHAR) AS cat_region,
       o.o_totalprice AS totalprice, c.c_acctbal AS acctbal,
       l.quantity_min, l.quantity_max, l.price_min, l.price_max,
       l.discount_max, l.tax_max, CAST(l.has_return AS INT) AS has_return,
       1 AS constant_col, l.last_ship AS leakage_last_ship,
       CAST(CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 0 END AS INT) AS target
FROM orders o
LEFT JOIN customer c ON c.c_custkey = o.o_custkey
LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey
LEFT JOIN (SELECT l_orderkey, min(l_quantity) quantity_min, max(l_quantity) quantity_max,
                  min(l_extendedprice) price_min, max(l_extendedprice) price_max,
                  max(l_discount) discount_max, max(l_tax) tax_max,
                  max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) has_return,
                  max(l_shipdate) last_ship
           FROM lineitem GROUP BY l_orderkey) l ON l.l_orderkey = o.o_orderkey
"""

SEGMENT_CASE_SQL = (
    "CASE cat_segment WHEN 'AUTOMOBILE' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'FURNITURE' THEN 2 "
    "WHEN 'HOUSEHOLD' THEN 3 WHEN 'MACHINERY' THEN 4 END"
)

CLUSTERED_SQL = f"SELECT *, CAST({SEGMENT_CASE_SQL} AS INT) AS cluster FROM ({COHORT_SQL}) base"

CLUSTERED_NOISE_SQL = (
    f"SELECT * REPLACE (CAST(CASE WHEN acctbal < 0 THEN -1 ELSE cluster END AS INT) AS cluster) "
    f"FROM ({CLUSTERED_SQL}) cn"
)


def with_cohort(sql_body: str, noise: bool = False, clustered: bool = True) -> str:
    """Prefix a DuckDB query with the cohort CTE (named ``cohort``)."""
    src = COHORT_SQL if not clustered else (CLUSTERED_NOISE_SQL if noise else CLUSTERED_SQL)
    return f"WITH cohort AS ({src})\n{sql_body}"
