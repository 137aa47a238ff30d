"""Fill-in-middle transformation with a sparse exception index.

A text is cut into units (lines or code points); two keyed draws name the units after which prefix and middle end.
Texts are cut as UTF-8 bytes.  ``ExceptionIndex`` records only the characters of more than one byte, by place, with
the bytes that they and those before them take beyond one each: ``searchsorted`` finds how many lie before a cut and
so converts between code points and bytes; a stretch of ASCII costs nothing and stays arithmetic.

Defined cases: a null text is the empty one, and an empty text is plain (no units); a text that holds a sentinel
already is plain, so that every output can be taken apart again; a null id draws as the empty text of an id; rows
that repeat an id draw alike; all other columns are kept as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, utf8

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


@dataclass(frozen=True)
class FimOptions:
    """``seed`` keys the draws; ``rate`` percent of the texts are transformed, ``spm`` percent of those with the
    suffix first; ``unit`` is "line" or "char"."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = "line"


class ExceptionIndex:
    """Code points and bytes of one UTF-8 text."""

    def __init__(self, raw: np.ndarray):
        lead = np.flatnonzero(raw >= 0xC0)
        extra = 1 + (raw[lead] >= 0xE0).astype(np.int64) + (raw[lead] >= 0xF0)
        self.excess = np.concatenate([np.zeros(1, np.int64), np.cumsum(extra)])
        self.at_byte = lead
        self.at_char = lead - self.excess[:-1]
        self.n_bytes, self.n_chars = len(raw), len(raw) - int(self.excess[-1])

    def char_of(self, byte):
        """Code points before a byte cut (or an array of cuts) that lies between characters."""
        return byte - self.excess[np.searchsorted(self.at_byte, byte)]

    def byte_of(self, char):
        """Bytes before a code-point cut (or an array of cuts)."""
        return char + self.excess[np.searchsorted(self.at_char, char)]


def line_ends(raw: np.ndarray) -> np.ndarray:
    """Byte places after each line; a last line may lack its line feed."""
    ends = np.flatnonzero(raw == 10) + 1
    return ends if not len(raw) or (len(ends) and ends[-1] == len(raw)) else np.append(ends, len(raw))


def draws(doc_id, seed: int) -> list[int]:
    """Four keyed 32-bit numbers of an id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def transform(text: bytes, doc_id, options: FimOptions) -> tuple[int, str, int | None, int | None, bytes]:
    """n units, form, code points of prefix and middle (None if plain) and the output of one text."""
    raw = np.frombuffer(text, np.uint8)
    index = ends = None
    if options.unit == "line":
        ends = line_ends(raw)
        n = len(ends)
    else:
        index = ExceptionIndex(raw)
        n = index.n_chars
    h1, h2, h3, h4 = draws(doc_id, options.seed)
    if not text or any(s.encode() in text for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= options.rate:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    index = index or ExceptionIndex(raw)
    if ends is not None:
        a, b = (int(ends[u - 1]) if u else 0 for u in (first, second))
        chars = [int(index.char_of(x)) for x in (a, b)]
    else:
        a, b = (int(index.byte_of(x)) for x in (first, second))
        chars = [first, second]
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    spm = h4 % 100 < options.spm
    out = b"".join((s, suffix, p, prefix, m, middle) if spm else (p, prefix, s, suffix, m, middle))
    return n, "spm" if spm else "psm", chars[0], chars[1] - chars[0], out


COLUMNS = [("n", "long"), ("form", "string"), ("prefix_chars", "long"), ("middle_chars", "long"), ("output", "string")]


def fill_in_middle(docs: DataFrame, options: FimOptions = FimOptions(), names: dict[str, str] | None = None) -> DataFrame:
    """All columns of ``docs`` (``doc_id`` and ``text`` are read) and n, form, prefix_chars, middle_chars and output.

    ``names`` renames added columns; where one would clash with a column of ``docs``, that column gives way.
    Rows are changed in place: nothing is shuffled, and a task holds one Arrow batch.
    """
    names = {c: c for c, _ in COLUMNS} | (names or {})
    at_id, at_text = docs.columns.index("doc_id"), docs.columns.index("text")
    keep = [i for i, c in enumerate(docs.columns) if c not in names.values()]
    blank = docs.select("*", *[F.lit(None).cast(kind).alias(f"fim added {c}") for c, kind in COLUMNS])
    width = len(docs.columns)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(at_id).to_pylist(), utf8(batch.column(at_text))
            rows = [transform(t, i, options) for i, t in zip(ids, texts)]
            added = []
            for k, field in enumerate(batch.schema.names[width:]):
                kind = batch.schema.field(field).type
                values = [r[k] for r in rows]
                added.append(pa.array(values, pa.binary()).cast(kind) if k == 4 else pa.array(values, kind))
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *added], schema=batch.schema)

    done = map_rows(blank, run)
    out = done.toDF(*[f"c{i}" for i in range(width)], *[f"a{k}" for k in range(len(COLUMNS))])
    return out.select(*[F.col(f"c{i}").alias(docs.columns[i]) for i in keep],
                      *[F.col(f"a{k}").alias(names[c]) for k, (c, _) in enumerate(COLUMNS)])


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made from: a plain one is the text, another is taken apart at its sentinels (the
    text holds none, and none can arise where a part meets a sentinel)."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, third = (parts.getItem(i) for i in (1, 2, 3))
    return (F.when(form == "psm", F.concat(first, third, second))
            .when(form == "spm", F.concat(second, third, first)).otherwise(output))


def fim_digests(docs: DataFrame, options: FimOptions = FimOptions()) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and SHA-256 of the output and of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast(T.BinaryType()), 256)
    made = fill_in_middle(docs.select("doc_id", "text"), options)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
