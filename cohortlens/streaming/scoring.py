"""ST-01 / ST-02: score patient files as they arrive and keep the case history.

Structured Streaming file source -> ``foreachBatch``.  Each micro-batch is
validated (required columns, ids present), aligned to the training schema,
scored with the fitted preprocessing + GBT model, assigned to a cluster by
the kNN vote over the reference embeddings, and written under
``<output>/batch_id=<epoch>`` with overwrite, so a retried epoch (e.g. after
an executor loss) replaces its own output instead of duplicating it.  The
history is an append-only version log (same per-epoch overwrite); its
current view is ``context.latest_versions``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import assign as AS
from ..operators import classify as CF
from ..operators.context import iso_utc, latest_versions
from ..operators.features import Preprocessor, Reducer
from ..operators.schema import ensure_columns
from ..sources.ingest import coerce_numeric, sniff_format


@dataclass
class ScoringModels:
    preprocessor: Preprocessor          # classifier features
    model: object                       # fitted GBTClassificationModel
    cluster_preprocessor: Preprocessor  # clustering features
    reducer: Reducer                    # SVD + scaler of the clustering space
    reference: DataFrame                # (ref_id, embedding, cluster) historical rows
    k: int = 15


def score_batch(batch: DataFrame, m: ScoringModels, key: str, numeric: list[str], categorical: list[str]) -> DataFrame:
    """One micro-batch: align, coerce, score, assign the rows that have a key (see ``rejected_rows`` for the rest)."""
    cols = [key] + numeric + categorical
    b = ensure_columns(batch, cols, {c: "string" for c in cols})
    b = b.select(F.col(key).try_cast("bigint").alias(key), *[coerce_numeric(F.col(c)).alias(c) for c in numeric],
                 *[F.col(c).cast("string").alias(c) for c in categorical]).where(F.col(key).isNotNull())
    x = CF.to_features(m.preprocessor.transform(b, [key]))
    scored = CF.score(m.model, x, [key])
    emb = m.reducer.transform(m.cluster_preprocessor.transform(b, [key]), "features", [key], "embedding")
    assigned = AS.assign_clusters(emb, m.reference, key, "ref_id", m.k).select(key, "cluster", "cluster_label")
    return scored.join(assigned, key, "left")


def rejected_rows(batch: DataFrame, key: str) -> DataFrame:
    """Rows that cannot be scored: their key is missing or is no whole number."""
    return batch.where(F.col(key).try_cast("bigint").isNull())


def run_scoring_stream(spark: SparkSession, input_dir: str, output_dir: str, checkpoint: str, models: ScoringModels,
                       key: str, numeric: list[str], categorical: list[str], sep: str | None = None,
                       max_files_per_trigger: int = 1000) -> None:
    """Process every file currently in ``input_dir`` (availableNow) and stop.

    ``max_files_per_trigger`` bounds a micro-batch, and with it the query side that the
    kNN assignment broadcasts per pass."""
    found_sep, _ = sniff_format(spark, input_dir)
    sep = sep or found_sep
    header = spark.read.option("header", True).option("sep", sep).csv(input_dir).columns
    missing = [c for c in [key] + numeric + categorical if c not in header]
    if missing:
        raise ValueError(f"the input has no columns {missing}")
    # Columns go by the header's names and order; a file with another header is an error, never read by position.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    stream = (spark.readStream.schema(schema).option("header", True).option("sep", sep).option("enforceSchema", False)
              .option("maxFilesPerTrigger", max_files_per_trigger).csv(input_dir))

    def handle(batch_df: DataFrame, epoch_id: int) -> None:
        rejected_rows(batch_df, key).write.mode("overwrite").parquet(f"{output_dir}/rejected/batch_id={epoch_id}")
        path = f"{output_dir}/scored/batch_id={epoch_id}"
        score_batch(batch_df, models, key, numeric, categorical).write.mode("overwrite").parquet(path)
        out = batch_df.sparkSession.read.parquet(path)  # scored once; the history reads the written batch
        versions = out.select(F.col(key).cast("string").alias("request_id"),
                              iso_utc(F.current_timestamp()).alias("created_at"),
                              iso_utc(F.current_timestamp()).alias("updated_at"),
                              "predicted_probability", "predicted_risk_group", "cluster", "cluster_label",
                              F.lit("").alias("comentario_medico"))
        versions.write.mode("overwrite").parquet(f"{output_dir}/history/batch_id={epoch_id}")

    q = (stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def history_view(spark: SparkSession, output_dir: str) -> DataFrame:
    """ST-02: current history = newest version per request id over the whole log."""
    return latest_versions(spark.read.parquet(f"{output_dir}/history"), "request_id", "updated_at")


def comment_update(spark: SparkSession, output_dir: str, request_id: str, comment: str, batch_tag: str) -> None:
    """ST-02: a comment edit is a new version appended to the log."""
    cur = history_view(spark, output_dir).where(F.col("request_id") == request_id)
    cur = cur.withColumn("comentario_medico", F.lit(comment)).withColumn("updated_at", iso_utc(F.current_timestamp()))
    cur.drop("batch_id").write.mode("overwrite").parquet(f"{output_dir}/history/batch_id={batch_tag}")


def stream_latest_events(spark: SparkSession, events_dir: str, out_dir: str, checkpoint: str, schema: str) -> DataFrame:
    """Events replayed as a file stream into the version log; returns the latest view
    per user (must equal the batch ``latest_versions``)."""
    stream = spark.readStream.schema(schema).parquet(events_dir)

    def handle(batch_df: DataFrame, epoch_id: int) -> None:
        batch_df.write.mode("overwrite").parquet(f"{out_dir}/log/batch_id={epoch_id}")

    q = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return latest_versions(spark.read.parquet(f"{out_dir}/log").drop("batch_id"), "user_id", "ts")
