"""Best-fit packing by minimum bin slack.

Documents are cut into pieces of at most ``capacity`` tokens.  A packing depends on the pieces' lengths alone, so
their histogram (at most ``capacity`` rows, whatever the data) is all that the driver sees.  Per bin the largest
length left is set, and a subset-sum dynamic program over the lengths left, on a bitset of reachable sums, finds the
fullest bin that holds it.  That combination is removed as often as the counts allow, which gives a plan of
(pattern, times) rows.  Spark then ranks the pieces of each length and joins the ranks with the plan.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_arrow, texts, written
from .tokenizing import word_bpe

CAPACITY = 4096
RANK_ROWS = 500
"""Pieces of one length that are ranked together; a length with more is dealt to several buckets."""


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece.  A null text is empty (the end id alone)."""

    def cut(batch: pa.RecordBatch):
        coder, end = word_bpe(tokenizer), np.uint32(end_id).tobytes()
        keys, piece, start, length, crc = [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
            ids = coder.ids(text) + end
            for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at:at + 4 * capacity]
                keys.append(doc_id)
                piece.append(k)
                start.append(at // 4)
                length.append(len(part) // 4)
                crc.append(zlib.crc32(part))
        return keys, piece, start, length, crc

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), cut,
                    "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(counts: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The fullest combination with the largest length in it: (length, times) with times <= counts.

    ``reach`` is the bitset of sums; layers remember it before each length so that the combination can be read
    back.  Larger lengths are tried first and the program stops when the bin is full, so small pieces stay for
    later bins."""
    order = sorted(counts, reverse=True)
    seed, room = order[0], capacity - order[0]
    full, reach, layers = 1 << room, 1, []
    below = (1 << (room + 1)) - 1
    for size in order:
        n = min(counts[size] - (size == seed), room // size if size else 0)
        if n <= 0:
            continue
        layers.append((size, n, reach))
        left, step = n, 1
        while left > 0:  # times in powers of two: log2(n) shifts
            k = min(step, left)
            reach |= (reach << (k * size)) & below
            left, step = left - k, step * 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, [(seed, 1)]
    for size, n, before in reversed(layers):
        k = next(k for k in range(n + 1) if total >= k * size and before >> (total - k * size) & 1)
        if k:
            taken.append((size, k))
            total -= k * size
    merged: dict[int, int] = {}
    for size, k in taken:
        merged[size] = merged.get(size, 0) + k
    return list(merged.items())


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int, int]]:
    """Rows (length, first rank, end rank, times in a bin, first bin, bins, offset in the bin)."""
    counts = {size: n for size, n in histogram.items() if n > 0}
    used, rows, bins = dict.fromkeys(counts, 0), [], 0
    while counts:
        pattern = fullest(counts, capacity)
        times = min(counts[size] // k for size, k in pattern)
        offset = 0
        for size, k in pattern:
            rows.append((size, used[size], used[size] + k * times, k, bins, times, offset))
            used[size] += k * times
            counts[size] -= k * times
            if not counts[size]:
                del counts[size]
            offset += k * size
        bins += times
    return rows


def pack(pieces: DataFrame, capacity: int = CAPACITY, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, length and any other columns; every length from 1
    to ``capacity``); columns of these two names are replaced.  Rows that repeat doc_id and piece are packed one by one.  An empty table gives no rows.

    The plan has a bounded number of rows (each pattern uses up a length), so it is broadcast.  A length that a
    third of the pieces share is ranked in buckets of about ``rank_rows`` rows whose first ranks come from their
    counts.
    """
    spark = pieces.sparkSession
    names = pieces.columns
    # The caller's columns travel in a struct, so their names cannot clash with the ones used here.
    whole = pieces.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("length").cast("long").alias("length"))
    histogram = {r["length"]: r["n"] for r in whole.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if histogram and not 1 <= min(histogram) <= max(histogram) <= capacity:
        raise ValueError("a length is outside 1 to capacity")
    plan = spark.createDataFrame(
        plan_bins(histogram, capacity),
        "plan_length long, from_rank long, to_rank long, times long, first_bin long, bins long, pattern_offset long")
    per_length = spark.createDataFrame(
        [(size, -(-n // rank_rows)) for size, n in histogram.items()], "length long, buckets long")

    keys = [F.col("row").getField(c) for c in ("doc_id", "piece", "start", "ids_crc32") if c in names]
    dealt = written(whole.join(F.broadcast(per_length), "length").withColumn(
        "bucket", F.pmod(F.xxhash64(*keys), F.col("buckets"))).drop("buckets"), "dealt")
    sizes = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy(*keys)
    ranked = (dealt.withColumn("local", F.row_number().over(inside) - 1).join(offsets, ["length", "bucket"])
              .select("row", "length", (F.col("local") + F.col("before")).alias("rank")))
    nth = F.col("rank") - F.col("from_rank")
    kept = [F.col("row").getField(c).alias(c) for c in names if c not in ("sequence_id", "offset")]
    return ranked.join(F.broadcast(plan), (F.col("length") == F.col("plan_length")) & (F.col("rank") >= F.col("from_rank"))
                       & (F.col("rank") < F.col("to_rank"))).select(
        *kept, (F.col("first_bin") + F.floor(nth / F.col("times")).cast("long")).alias("sequence_id"),
        (F.col("pattern_offset") + nth % F.col("times") * F.col("length")).alias("offset"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(token_pieces(docs, tokenizer, end_id, capacity), "pieces")
    return pack(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
