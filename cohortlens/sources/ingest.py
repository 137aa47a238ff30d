"""Delimited-file ingest, JSON documents, sinks and fitted-artifact files.

Reading is Spark's CSV/JSON/text sources.  Type inference is ONE aggregate
over all string columns (how many non-null values fail a numeric parse),
then a projection: no driver-side parsing of data.
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, ship_package

# Identifier-like columns dropped by the outlier loader; null spellings.
LOADER_DROP = ["Unnamed: 0", "H1"]
NULL_TOKENS = ["", "nan", "None", "NA"]

TEXT_FILES = 2048  # of one folder of ``write_texts``
TEXT_BYTES = 4 << 20  # of texts that a task reads before it hands them on
TEXT_FOLDER = re.compile(r"part-\d{5,}-\d{5,}")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a machine-local path on a cluster)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}/{uuid.uuid4().hex}"


def sniff_format(spark: SparkSession, path: str) -> tuple[str, str]:
    """SRC-01: header with more ';' than ',' -> (';', ',') else (',', '.').  Reads one line."""
    header = spark.read.text(path).limit(1).first()
    line = header[0] if header else ""
    return (";", ",") if line.count(";") > line.count(",") else (",", ".")


def coerce_numeric(c: Column) -> Column:
    """PRJ-05: trim; '', nan, None, NA -> null; ',' -> '.'; invalid -> null."""
    s = F.regexp_replace(c.cast("string"), r"^\s+|\s+$", "")
    s = F.when(s.isin(NULL_TOKENS), F.lit(None)).otherwise(s)
    return F.regexp_replace(s, ",", ".").try_cast("double")


def infer_types(df: DataFrame, decimal: str = ".") -> DataFrame:
    """Pandas-like inference for all-string frames: a column whose non-null values all
    parse as integers becomes bigint, as numbers becomes double, else stays string."""
    cols = df.columns

    def text(c):
        s = F.col(f"`{c}`")
        return F.when(~F.trim(s).isin(NULL_TOKENS), s)  # the shared null spellings, "nan" among them

    def num(c):
        s = text(c)
        return (F.regexp_replace(s, ",", ".") if decimal == "," else s).try_cast("double")
    stats = df.agg(*[F.count(text(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                   *[F.count_if(text(c).isNotNull() & (num(c).isNull() | F.isnan(num(c)))).alias(f"b{i}") for i, c in enumerate(cols)],
                   *[F.count_if(text(c).isNotNull() & ~(text(c).rlike(r"^\s*[-+]?\d+\s*$") & F.trim(text(c)).try_cast("bigint").isNotNull())).alias(f"f{i}")
                     for i, c in enumerate(cols)]).first()
    out = []
    for i, c in enumerate(cols):
        if stats[f"n{i}"] > 0 and stats[f"b{i}"] == 0:
            # integers are cast from their text: a double holds 53 bits only
            out.append((F.trim(text(c)).cast("bigint") if stats[f"f{i}"] == 0 else num(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return df.select(*out)


def _blank_headers(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("_c") and c[2:].isdigit()]


def load_delimited(spark: SparkSession, path: str, blank_header: str = "rename") -> DataFrame:
    """SRC-01 + SRC-03: sniff separator/decimal, read strings, infer types.

    Spark names blank header cells ``_c<i>``; ``rename`` maps the first to 'Unnamed: 0',
    ``drop`` removes them all."""
    sep, dec = sniff_format(spark, path)
    raw = spark.read.option("header", True).option("sep", sep).option("inferSchema", False).csv(path)
    blanks = _blank_headers(raw)
    if blanks and blank_header == "rename":
        raw = raw.withColumnRenamed(blanks[0], "Unnamed: 0")
    elif blanks:
        raw = raw.drop(*blanks)
    return infer_types(raw, dec)


def load_with_fallback(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: read with ';'; when that yields one column, re-read with ','; drop loader ids."""
    df = spark.read.option("header", True).option("sep", ";").csv(path)
    dec = ","
    if len(df.columns) <= 1:
        df = spark.read.option("header", True).option("sep", ",").csv(path)
        dec = "."
    df = df.drop(*[c for c in LOADER_DROP if c in df.columns], *_blank_headers(df))
    return infer_types(df, dec)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """SRC-04: consecutive 0..n-1 in file order without gaps, for a frame read from files (not shuffled since).

    The order is (file path, offset of the block in the file, row in the block): Spark packs blocks into tasks by
    size, so the task number says nothing, but a task reads each block as a whole and in order.  One row per block
    (its number of rows and its first task-wide id) gives the offsets."""
    from pyspark.sql import Window as W
    block = ["__file", "__start"]
    tagged = (df.withColumn("__file", F.input_file_name()).withColumn("__start", F.input_file_block_start())
              .withColumn("__mid", F.monotonically_increasing_id()))
    counts = tagged.groupBy(*block).agg(F.count(F.lit(1)).alias("__n"), F.min("__mid").alias("__first"))
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__n").over(
        W.orderBy(*block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))  # one row per block of a file
    out = tagged.join(offsets.drop("__n"), block)
    return out.withColumn(name, F.col("__off") + F.col("__mid") - F.col("__first")).drop(*block, "__mid", "__first", "__off")


def cardinality_violations(df: DataFrame, expected: int = 1) -> DataFrame:
    """SRC-05 (batch form): input files whose row count differs from ``expected``."""
    return df.groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows")).where(
        F.col("n_rows") != expected)


def write_delimited(df: DataFrame, path: str, sep: str = ";", decimal: str = ",", files: int | None = None) -> str:
    """SRC-07 CSV sink in the reference's file dialect (decimal comma when sep is ';')."""
    cols = []
    for name, t in df.dtypes:
        c = F.col(f"`{name}`")
        if t in ("double", "float") and decimal == ",":
            c = F.regexp_replace(c.cast("string"), r"\.", ",")
        cols.append(c.cast("string").alias(name))
    out = df.select(*cols)
    if files:
        out = out.repartition(files)
    out.write.mode("overwrite").option("header", True).option("sep", sep).csv(path)
    return path


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite", partition_by: list[str] = ()) -> str:
    """SRC-07 default sink: parquet (or json/csv), optional partition columns."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    getattr(w, fmt)(path)
    return path


def read_json_documents(spark: SparkSession, path: str, schema: str | None = None, multiline: bool = True) -> DataFrame:
    """SRC-06: JSON documents (one pretty-printed document per file when ``multiline``,
    else JSON Lines as written by Spark's JSON sink)."""
    r = spark.read.option("multiLine", multiline)
    return (r.schema(schema) if schema else r).json(path)


def write_json(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").json(path)
    return path


def _store(path: str) -> tuple[fs.FileSystem, str] | None:
    """File system and place of a folder that tasks can open themselves and whose folders can be renamed; None elsewhere."""
    try:
        store, place = fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return None
    return (store, place.rstrip("/")) if store.type_name in ("local", "hdfs") else None


def write_texts(df: DataFrame, key: str, text: str, path: str) -> str:
    """SRC-10: each row's text, ended by a line break, as a file of its own named after the row's ``key``; rows of one key
    in a task share a file, a line break after each.

    Tasks write the files themselves, in folders of ``TEXT_FILES`` that get their names when they are whole, so a repeated
    attempt changes nothing.  Other stores get one folder per key from Spark's own writer."""
    spark, found = df.sparkSession, _store(path)
    if found is None:
        df.select(key, F.col(text).cast("string").alias("value")).write.partitionBy(key).text(path)
        return path
    ship_package(spark)
    found[0].create_dir(found[1], recursive=True)

    def write(batches):
        store, top = _store(path)
        task, n, folder, files, name, sink = TaskContext.get().partitionId(), 0, "", 0, None, None

        def whole():
            target = f"{top}/part-{task:05d}-{n:05d}"
            if store.get_file_info(target).type == fs.FileType.Directory:
                store.delete_dir(folder)  # another attempt at this task came first
            else:
                store.move(folder, target)

        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                some = batch.slice(low, 512)
                for k, value in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    k = quote(k, safe="") if k else "__HIVE_DEFAULT_PARTITION__"  # as Spark names it
                    if sink is None or k != name:
                        if sink is not None:
                            sink.close()
                        if files == TEXT_FILES:
                            whole()
                            n, folder = n + 1, ""
                        if not folder:
                            folder, files = f"{top}/_part-{task:05d}-{n:05d}-{uuid.uuid4().hex}", 0
                            store.create_dir(folder)
                        name, files, sink = k, files + 1, store.open_output_stream(f"{folder}/{key}={k}.txt")
                    sink.write((value or b"") + b"\n")
        if sink is not None:
            sink.close()
            whole()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    named = df.select(F.col(key).cast("string").alias("k"), F.col(text).cast("binary").alias("text")).sortWithinPartitions("k")
    named.mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return path


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-10: one row per file with its whole decoded text.

    The folders of ``write_texts`` are listed and read by tasks, one each; any other place is read by Spark's reader."""
    found = _store(path)
    listed = found[0].get_file_info(fs.FileSelector(found[1], allow_not_found=True)) if found else []
    folders = sorted(i.base_name for i in listed if i.type == fs.FileType.Directory and TEXT_FOLDER.fullmatch(i.base_name))
    if not folders:
        return spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    ship_package(spark)
    base = path.rstrip("/") if ":" in path else f"file://{path.rstrip('/')}"

    def read(batches):
        store, top = _store(path)
        for batch in batches:
            for at in batch.column(0).to_pylist():
                values, paths, held = [], [], 0
                for file in sorted(i.base_name for i in store.get_file_info(fs.FileSelector(f"{top}/{folders[at]}"))):
                    with store.open_input_stream(f"{top}/{folders[at]}/{file}") as source:
                        values.append(source.read())
                    paths.append(f"{base}/{folders[at]}/{file}")
                    held += len(values[-1])
                    if held > TEXT_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths)], names=["value", "path"])
                        values, paths, held = [], [], 0
                if values:
                    yield pa.RecordBatch.from_arrays([pa.array(values, pa.binary()), pa.array(paths)], names=["value", "path"])

    one_each = spark.range(0, len(folders), 1, len(folders))
    return one_each.mapInArrow(read, "value binary, path string").select(F.col("value").cast("string").alias("value"), "path")


def fill_from_template(found: DataFrame, template: DataFrame, columns: list[str]) -> DataFrame:
    """SRC-09: start from the one-row template and overwrite the fields that were found.

    Found numbers are written by the reference's number format (TX-03: ``80``, ``36,6``).  The template is a single
    row (checked) and is inlined as literals, its numbers in the same format."""
    rows = template.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("template must have exactly one row")
    from ..functions.text import format_number
    numeric = {c for c, t in found.dtypes if t in ("double", "float")}
    shown = template.select(*[format_number(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in template.dtypes])
    t = shown.first().asDict()
    keep = [c for c in found.columns if c not in columns]
    return found.select(*keep, *[F.coalesce((format_number(F.col(c)) if c in numeric else F.col(c).cast("string")) if c in found.columns else F.lit(None),
                                            F.lit(None if t.get(c) is None else str(t.get(c)))).alias(c) for c in columns])


def required_columns(df: DataFrame, required: list[str], keep: list[str] | None = None) -> DataFrame | None:
    """SRC-12: None when a required column is missing, else the kept columns that exist."""
    if not set(required).issubset(df.columns):
        return None
    keep = keep or required
    return df.select(*[c for c in keep if c in df.columns])


def run_metadata(spark: SparkSession, run_id: str, info: dict) -> DataFrame:
    """SRC-11: one-row run record (lists and maps kept as JSON text)."""
    return spark.createDataFrame([(run_id, json.dumps(info, sort_keys=True, default=str))], "run_id string, metadata string")

