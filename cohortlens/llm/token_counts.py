"""Token counts by a map-side two-tier lookup.

Tier one: a compact table of the lengths (in tokens) of the most frequent pre-tokens, broadcast to the workers.
Tier two: each worker's cache of the lengths of pre-tokens it met and encoded itself.  No pre-token is shuffled.
Which pre-tokens are frequent comes from all texts: every task keeps a bounded summary of its pre-tokens and only
the summaries are merged.  The choice changes the speed and never a count.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, most_frequent, ship_package, texts, written
from .tokenizing import MAX_PART, CACHE_PARTS, piece_bpe

FREQUENT = 1 << 14
SUMMARY = 1 << 13
SUMMARY_KEEP = 1 << 17


class FrequentLengths:
    """Pre-tokens and their lengths as one byte block, offsets and one array of lengths."""

    def __init__(self, lengths: dict[str, int]):
        raw = [p.encode() for p in lengths]
        self.block = b"".join(raw)
        self.ends = np.cumsum([len(r) for r in raw], dtype=np.int32) if raw else np.zeros(0, np.int32)
        self.lengths = np.array(list(lengths.values()), np.uint16)

    def as_dict(self) -> dict[str, int]:
        starts = np.concatenate([[0], self.ends[:-1]]) if len(self.ends) else self.ends
        return {self.block[a:b].decode(): n
                for a, b, n in zip(starts.tolist(), self.ends.tolist(), self.lengths.tolist())}


class _Lengths(dict):
    """Tier one at its making, tier two by ``__missing__``; at most ``CACHE_PARTS`` misses are remembered."""

    def __init__(self, frequent: dict[str, int], encode):
        super().__init__(frequent)
        self.frequent, self.encode, self.old = frequent, encode, {}

    def __missing__(self, part):
        n = self.old.get(part)
        if n is None:
            n = len(self.encode(part))
        if len(part) <= MAX_PART:
            if len(self) >= CACHE_PARTS:
                self.old = dict(self)
                self.clear()
                self.update(self.frequent)
            self[part] = n
        return n


@lru_cache(maxsize=2)
def _tiers(path: str, key: int, table) -> _Lengths:
    """One pair of tiers per worker, model and broadcast."""
    return _Lengths(table.value.as_dict(), piece_bpe(path).model.encode)


def frequent_pretokens(docs: DataFrame, model: str, top: int = FREQUENT, summary: int = SUMMARY,
                       keep: int = SUMMARY_KEEP) -> list[str]:
    """The ``top`` pre-tokens by the merged summaries of all tasks.  A task counts its pre-tokens; when it holds
    more than ``keep`` it drops those seen once less than the rest (lossy counting), and it reports ``summary``."""

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, seen = piece_bpe(model), Counter()
        for batch in batches:
            for text in texts(batch.column(0)):
                seen.update(coder.units(text) or ())
            if len(seen) > keep:
                seen = Counter(dict(seen.most_common(keep // 2)))
        best = [(p, n) for p, n in seen.most_common(summary) if 0 < len(p) <= MAX_PART]
        yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in best], pa.string()),
                                          "n": pa.array([n for _, n in best], pa.int64())})

    ship_package(docs.sparkSession)
    merged = docs.select("text").mapInArrow(summarise, "part string, n long").groupBy("part").agg(F.sum("n").alias("n"))
    return [r[0] for r in most_frequent(written(merged, "summaries"), "part", "n", top).select("part").collect()]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, top: int = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit per row of ``docs`` (doc_id, text); a null text is empty and has no
    token.  The table sent to the workers has at most ``top`` pre-tokens of at most ``MAX_PART`` characters."""
    spark = docs.sparkSession
    coder = piece_bpe(model)
    frequent = FrequentLengths({p: len(coder.model.encode(p)) for p in frequent_pretokens(docs, model, top)})
    sent = spark.sparkContext.broadcast(frequent)

    def count(batch: pa.RecordBatch):
        coder = piece_bpe(model)
        lengths = _tiers(model, sent.id if hasattr(sent, "id") else 0, sent)
        n_bytes, n_tokens = [], []
        for text in texts(batch.column(1)):
            units = coder.units(text)
            n_bytes.append(len(text.encode()))
            n_tokens.append(len(coder.model.encode(text)) if units is None else sum(map(lengths.__getitem__, units)))
        return batch.column(0), n_bytes, n_tokens, [n > limit for n in n_tokens]

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), count,
                    "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
