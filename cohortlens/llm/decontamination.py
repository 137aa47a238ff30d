"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items make one automaton whose states stand for the items' word sequences.  A document's
words stream through it and the longest match that ends at each word is tracked.  A match of at least ``window``
words covers windows of some item; an item of fewer words is one window of its own, found on the suffix links.

The benchmark is cut into blocks of a bounded size, written to the shared folder by tasks; a worker holds the
automata of a few blocks.  One block is the common case.  Documents are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, by_arrow, cache_of, claim_cache, map_rows, open_fs, put_file, ship_package, shared_path, utf8, written

WINDOW = 10
BLOCK_BYTES = 2 << 20
MAX_COVERAGE = 0.5
PAIR_BITS = 20


class _Vocabulary(dict):
    def __missing__(self, word):
        return -1


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences, with the items of every window."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.vocabulary = _Vocabulary()
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = []
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                coded.append((item, ids))
                last = 0
                for w in ids:
                    last = self._extend(last, w)
        self._mark(coded)
        self.least = min((min(window, len(ids)) for _, ids in coded), default=0)
        self.pairs = np.zeros(1 << PAIR_BITS, bool)
        for _, ids in coded:
            if len(ids) > 1:
                self.pairs[self._slot(np.array(ids[:-1]), np.array(ids[1:]))] = True

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        mixed = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        return (mixed >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def _state(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int) -> int:
        """The state of p's longest string followed by w; splits the target if that stands for longer strings."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        self.link[new] = self._split(p, w) if p >= 0 else 0
        return new

    def _mark(self, coded: list[tuple[str, list[int]]]) -> None:
        """``anchor``: for a state with long strings, the state of their last ``window`` words; ``long_items`` and
        ``short_items``: the items of windows; ``short_up``: the next state on the suffix links with a short item."""
        n, m = len(self.length), self.window
        by_length = sorted(range(1, n), key=self.length.__getitem__)
        self.anchor = [-1] * n
        for s in by_length:
            if self.length[s] >= m:
                up = self.link[s]
                self.anchor[s] = s if self.length[up] < m else self.anchor[up]
        self.long_items: dict[int, set[str]] = {}
        self.short_items: dict[int, dict[int, set[str]]] = {}
        for item, ids in coded:
            s = 0
            for i, w in enumerate(ids):
                s = self.next[s][w]
                if i + 1 >= m:
                    self.long_items.setdefault(self.anchor[s], set()).add(item)
            if len(ids) < m:
                self.short_items.setdefault(s, {}).setdefault(len(ids), set()).add(item)
        self.short_up = [-1] * n
        for s in by_length:
            self.short_up[s] = s if s in self.short_items else self.short_up[self.link[s]]

    def _runs(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Stretches of words whose neighbours all stand together in some item, long enough for a window."""
        if self.least == 1:
            good = ids >= 0
            extra = 0
        else:
            good = (ids[:-1] >= 0) & (ids[1:] >= 0)
            good[good] = self.pairs[self._slot(ids[:-1][good], ids[1:][good])]
            extra = 1
        edges = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a + extra >= self.least:
                yield a, b + extra

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Hit spans (first word, word after the last; ascending, apart) and the items with a window in ``words``."""
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        if not self.least or len(words) < self.least:
            return spans, items
        ids = np.fromiter(map(self.vocabulary.__getitem__, words), np.int64, len(words))
        seen: set[int] = set()
        for a, b in self._runs(ids):
            s = matched = 0
            for i, w in enumerate(ids[a:b].tolist(), a):
                while s and w not in self.next[s]:
                    s = self.link[s]
                    matched = self.length[s]
                if w not in self.next[s]:
                    continue
                s = self.next[s][w]
                matched += 1
                hit = 0
                if matched >= self.window:
                    # s may stand for longer strings than the match; its anchor is the same for all of them
                    hit = matched
                    if self.anchor[s] not in seen:
                        seen.add(self.anchor[s])
                        items |= self.long_items[self.anchor[s]]
                up = self.short_up[s]
                while up > 0:
                    for k, found in self.short_items[up].items():
                        if k <= matched:
                            hit = max(hit, k)
                            items |= found
                    up = self.short_up[self.link[up]] if self.link[up] > 0 else -1
                if hit:
                    start = i + 1 - hit
                    while spans and spans[-1][1] >= start:
                        start = min(start, spans.pop()[0])
                    spans.append((start, i + 1))
        return spans, items


def words_of(text: bytes) -> list[bytes]:
    return text.translate(ALNUM).split()


def word_offsets(text: bytes) -> list[tuple[int, int]]:
    """Byte ranges of the words of ``words_of``."""
    flags = np.frombuffer(text.translate(ALNUM), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def write_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Deal the items (item_id, text) to block files of about ``block_bytes`` and return their paths.  An item
    without an id counts under the empty id; one without words has no window."""
    spark = benchmark.sparkSession
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = shared_path(spark, "benchmark")
    dealt = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                             F.coalesce("text", F.lit("")).alias("text")).repartition(max(1, math.ceil(size / block_bytes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        found = [b for b in batches if b.num_rows]
        if found:
            path = f"{folder}/block-{TaskContext.get().partitionId():06d}.arrows"
            block = pa.Table.from_batches(found)

            def write(sink) -> None:
                with pa.ipc.new_stream(sink, block.schema) as out:
                    out.write_table(block)

            put_file(path, write)
            yield pa.RecordBatch.from_pydict({"path": [path]})

    ship_package(spark)
    return sorted(r[0] for r in written(dealt.mapInArrow(run, "path string"), "blocks").collect())


@lru_cache(maxsize=2)
def automaton(path: str, window: int) -> SuffixAutomaton:
    """The automaton of a block, built once per worker."""
    store, at = open_fs(path)
    with store.open_input_file(at) as source:
        block = pa.ipc.open_stream(source).read_all()
    return SuffixAutomaton([(i, words_of(t)) for i, t in zip(block["item_id"].to_pylist(), utf8(block["text"].combine_chunks()))], window)


cache_of("decontamination", automaton.cache_clear)


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def scan_texts(texts: list[bytes], blocks: list[str], window: int):
    """Words, hit spans and items of each text, over all blocks."""
    claim_cache("decontamination")
    words = [words_of(t) for t in texts]
    spans: list[list[tuple[int, int]]] = [[] for _ in words]
    items: list[set[str]] = [set() for _ in words]
    for path in blocks:
        block = automaton(path, window)
        for i, w in enumerate(words):
            found, ids = block.scan(w)
            if found:
                spans[i] += found
                items[i] |= ids
    return words, [s if len(blocks) == 1 else _merge(s) for s in spans], items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (first word, word after the last) of
    every row of ``docs``.  A null text has no words; without benchmark words nothing is hit.  Repeated rows are
    repeated in the result."""
    blocks = write_blocks(benchmark, block_bytes)

    def run(batch: pa.RecordBatch):
        words, spans, items = scan_texts(utf8(batch.column(1)), blocks, window)
        hits = [sum(b - a for a, b in s) for s in spans]
        return [batch.column(0), [len(w) for w in words], hits, [len(i) for i in items],
                [hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], [h > 0 for h in hits],
                [[{"first": a, "end": b} for a, b in s] for s in spans]]

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
                    "spans array<struct<first: int, end: int>>")


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the bytes from the first to the last word of each span; a line break marks the cut."""
    at, out, offsets = 0, [], word_offsets(text)
    for a, b in spans:
        out.append(text[at:offsets[a][0]])
        at = offsets[b - 1][1]
    return b"\n".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE,
                         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with every hit span taken out of its text, and without the documents of which more than
    ``max_coverage`` of the words were hit.  What a cut brings together is scanned again until nothing is hit.
    All columns stay; an ``n_chars`` column is set to the new length.  Other rows are unchanged."""
    blocks = write_blocks(benchmark, block_bytes)
    names = docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(at))
            words, spans, _ = scan_texts(texts, blocks, window)
            hit = [i for i, s in enumerate(spans) if s]
            if not hit:
                yield batch
                continue
            changed = batch.column(at).to_pylist()
            keep = np.ones(len(texts), bool)
            n_chars = batch.column(names.index("n_chars")).to_pylist() if "n_chars" in names else None
            for i in hit:
                if sum(b - a for a, b in spans[i]) > max_coverage * len(words[i]):
                    keep[i] = False
                    continue
                text, found = texts[i], spans[i]
                while found:
                    text = without_spans(text, found)
                    found = scan_texts([text], blocks, window)[1][0]
                changed[i] = text.decode()
                if n_chars:
                    n_chars[i] = len(changed[i])
            columns = list(batch.columns)
            columns[at] = pa.array(changed, batch.schema.field(at).type)
            if n_chars:
                k = names.index("n_chars")
                columns[k] = pa.array(n_chars, batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))

    return map_rows(docs, run)
