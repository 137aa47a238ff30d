"""Token-ID output: Arrow stream files with fixed-size-list batches.

``write_token_files`` deals the documents by ascending ``doc_id`` to shards, encodes every whole text once, and
writes per shard

* ``shard-N.arrows``: an Arrow IPC stream whose batches have ``input_ids`` (fixed-size list of the smallest unsigned
  type that holds the vocabulary) and ``mask`` (fixed-size list of bool: true for a token, false for padding).  All
  sequences have the same length; only the last one of a shard may be padded.
* ``shard-N.index.arrows``: ``doc_id``, ``start`` (in the shard) and ``n_tokens`` of each document.

``TokenShard`` maps a shard into memory and gives any sequence, mask or document as a view, without a copy.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_arrow, open_fs, put_file, shared_path, texts, written
from .tokenizing import word_bpe

SEQUENCE = 2048
BATCH = 64
SHARD_BYTES = 32 << 20


def id_type(vocabulary: int) -> pa.DataType:
    """The smallest unsigned type for ids below ``vocabulary``."""
    return pa.uint16() if vocabulary <= 1 << 16 else pa.uint32()


class ShardWriter:
    """Collects the ids of documents and writes full batches as they come; holds one batch of tokens and the
    document at hand."""

    def __init__(self, sink, dtype: pa.DataType, length: int, rows: int):
        self.dtype, self.length, self.rows = dtype, length, rows
        self.schema = pa.schema([("input_ids", pa.list_(dtype, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.out = pa.ipc.new_stream(sink, self.schema)
        self.waiting, self.n_waiting = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        if self.n_waiting >= self.length * self.rows:
            flat = np.concatenate(self.waiting)
            full = len(flat) // (self.length * self.rows) * self.length * self.rows
            for at in range(0, full, self.length * self.rows):
                self._batch(flat[at:at + self.length * self.rows], self.length * self.rows)
            self.waiting, self.n_waiting = [flat[full:]], len(flat) - full

    def _batch(self, flat: np.ndarray, n: int) -> None:
        mask = np.arange(len(flat)) < n
        self.out.write_batch(pa.record_batch([
            pa.FixedSizeListArray.from_arrays(pa.array(flat, type=self.dtype), self.length),
            pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)], schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            n = len(flat)
            self._batch(np.concatenate([flat, np.zeros(-n % self.length, flat.dtype)]), n)
        self.out.close()


class TokenShard:
    """One shard, mapped into memory (or read at once where the store cannot map)."""

    def __init__(self, path: str):
        store, at = open_fs(path)
        source = pa.memory_map(at) if store.type_name == "local" else store.open_input_file(at)
        self.batches = list(pa.ipc.open_stream(source))
        self.rows = self.batches[0].num_rows if self.batches else 0
        self.length = self.batches[0].schema.field("input_ids").type.list_size if self.batches else 1

    def _flat(self, batch: int, column: int) -> pa.Array:
        return self.batches[batch].column(column).flatten()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, i: int) -> np.ndarray:
        """Ids of sequence ``i``: a view of the file."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        at = i % self.rows * self.length
        return self._flat(i // self.rows, 0).slice(at, self.length).to_numpy(zero_copy_only=True)

    def mask(self, i: int) -> pa.Array:
        """Mask of sequence ``i``: a view of the file's bits."""
        if not 0 <= i < len(self):
            raise IndexError(i)
        return self._flat(i // self.rows, 1).slice(i % self.rows * self.length, self.length)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """``n`` ids from token ``start`` of the shard; a view where they lie in one batch."""
        size, parts = self.rows * self.length, []
        while n > 0:
            batch, at = divmod(start, size)
            part = self._flat(batch, 0).slice(at, min(n, size - at)).to_numpy(zero_copy_only=True)
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def documents(self, path: str) -> pa.Table:
        """The shard's index."""
        store, at = open_fs(path)
        with store.open_input_file(at) as source:
            return pa.ipc.open_stream(source).read_all()


def shard_count(docs: DataFrame, shard_bytes: int) -> int:
    size = docs.agg(F.sum(F.octet_length(F.col("text")))).first()[0] or 0
    return max(1, math.ceil(size / shard_bytes))


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int, sequence: int = SEQUENCE,
                      batch_rows: int = BATCH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write the token files of ``docs`` (``doc_id``, ``text``) under ``folder``; return one row per shard: shard,
    path, n_docs, n_tokens and base (the tokens of all shards before it).

    A null text is an empty one and gives the end id alone.  Rows with a null doc_id come first; rows that repeat
    a doc_id are kept, in the order of their texts' hashes.  An empty table gives no shard.  Texts are shuffled
    once, by ranges of doc_id; a task holds one batch of tokens and one document at a time.
    """
    n = shard_count(docs, shard_bytes)
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .repartitionByRange(n, F.col("doc_id").asc_nulls_first())
             .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"))
    schema = T.StructType.fromDDL("shard int, path string, n_docs long, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        shard = TaskContext.get().partitionId()
        path = f"{folder}/shard-{shard:07d}.arrows"
        coder = word_bpe(tokenizer)
        dtype = id_type(coder.tokenizer.get_vocab_size())
        doc_ids, counts, first = [], [], next(batches, None)
        if first is None:
            return

        def write(sink) -> None:
            writer = ShardWriter(sink, dtype, sequence, batch_rows)
            for batch in chain_first(first, batches):
                doc_ids.append(batch.column(0))
                for text in texts(batch.column(1)):
                    ids = np.append(np.frombuffer(coder.ids(text), np.uint32), np.uint32(end_id))
                    counts.append(len(ids))
                    writer.add(ids.astype(dtype.to_pandas_dtype()))
            writer.close()

        put_file(path, write)
        n_tokens = np.array(counts, np.int64)
        index = pa.table({"doc_id": pa.chunked_array(doc_ids), "start": np.cumsum(n_tokens) - n_tokens,
                          "n_tokens": n_tokens})

        def write_index(sink) -> None:
            with pa.ipc.new_stream(sink, index.schema) as out:
                out.write_table(index, max_chunksize=1 << 16)

        put_file(path.replace(".arrows", ".index.arrows"), write_index)
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path],
                                          "n_docs": [len(counts)], "n_tokens": [int(n_tokens.sum())]})

    shards = written(dealt.mapInArrow(run, schema), "shards")
    # One row per file, as in any listing of files: the running total over shards is small next to the data.
    from pyspark.sql import Window
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def chain_first(first, rest):
    yield first
    yield from rest


def read_documents(shards: DataFrame) -> DataFrame:
    """Documents as the files hold them: doc_id, start (over all shards), n_tokens, ids_crc32."""

    def read(batch: pa.RecordBatch):
        doc_ids, starts, counts, crcs = [], [], [], []
        for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            shard = TokenShard(path)
            index = shard.documents(path.replace(".arrows", ".index.arrows"))
            doc_ids.append(index["doc_id"])
            start, n_tokens = index["start"].to_numpy(), index["n_tokens"].to_numpy()
            starts.append(start + base)
            counts.append(n_tokens)
            crcs += [zlib.crc32(shard.tokens(s, n).astype("<u4").tobytes()) for s, n in zip(start.tolist(), n_tokens.tolist())]
        return [pa.concat_arrays([c for d in doc_ids for c in d.chunks]), np.concatenate(starts),
                np.concatenate(counts), np.array(crcs, np.int64)]

    spread = shards.repartition(max(1, shards.count()), "shard").select("path", "base")
    return by_arrow(spread, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_output(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the token files to the shared folder and read every document back from them."""
    return read_documents(write_token_files(docs, tokenizer, shared_path(spark, "tokens"), end_id))
