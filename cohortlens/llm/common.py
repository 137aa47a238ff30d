"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
"""``bytes.translate`` table: lower-case A-Z only."""

ALNUM = bytes(LOWER[c] if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
"""``bytes.translate`` table: lower-case A-Z, every ASCII byte outside 0-9a-zA-Z becomes a space, so that
``split()`` gives the words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``."""

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""Setting of a session: a query's shuffle files are removed when it ends."""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table or files, under the shared checkpoint folder."""
    ship_package(spark)
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs only
    the tasks it ran.  The shuffle files of the write go as soon as it ends: nobody reads them again."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


_CACHES: dict[str, object] = {}


def cache_of(owner: str, clear) -> None:
    """Register what empties a module's cache; Python workers outlive the stage that filled it."""
    _CACHES[owner] = clear


def claim_cache(owner: str) -> None:
    """Called by the tasks of a module that is about to fill its cache: those of other modules are emptied, so a
    worker holds one module's cache at a time."""
    for other, clear in _CACHES.items():
        if other != owner:
            clear()
    pa.default_memory_pool().release_unused()


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path; used inside tasks."""
    return fs.FileSystem.from_uri(path)


def put_file(path: str, write) -> None:
    """Write a file under another name and move it to ``path``: a repeated or speculative attempt replaces the
    file as a whole by the same content."""
    store, target = open_fs(path)
    store.create_dir(target.rsplit("/", 1)[0], recursive=True)
    temporary = f"{target}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temporary) as sink:
        write(sink)
    store.move(temporary, target)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts of an Arrow string column as UTF-8 bytes; null is the empty text."""
    return [x if x is not None else b"" for x in column.cast(pa.large_binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow string column; null is the empty text."""
    return [x if x is not None else "" for x in column.to_pylist()]


def by_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` for a function from one record batch to columns, in the order of ``schema``."""
    ship_package(df.sparkSession)
    out = df.sparkSession.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = fn(batch)
                yield pa.RecordBatch.from_arrays(
                    [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow)],
                    schema=arrow)

    return df.mapInArrow(run, out)


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` over all columns of ``docs``, with the same columns out; ``run`` finds them by place.  The
    columns have plain names meanwhile, because theirs may hold dots."""
    ship_package(docs.sparkSession)
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as decimal text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; null is the empty text."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.coalesce(text, F.lit("")), upper, upper.lower())


def most_frequent(counts: DataFrame, name: str, count: str, k: int) -> DataFrame:
    """The ``k`` rows with the largest ``count`` (ties by ``name``).  A histogram of the counts' magnitudes, of a
    bounded number of rows, gives a floor first, so that partitions do not each send ``k`` rows."""
    magnitude = F.floor(F.log2(F.col(count)) * 4)
    floor, seen = None, 0
    for at, n in sorted(counts.groupBy(magnitude.alias("m")).count().collect(), reverse=True):
        floor, seen = at, seen + n
        if seen >= k:
            break
    if floor is not None:
        counts = counts.filter(magnitude >= floor)
    return counts.orderBy(F.desc(count), name).limit(k)
