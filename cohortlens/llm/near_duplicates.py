"""MinHash near-duplicates with sequential Bayesian verification.

1. Every text gets its set of word shingles, a MinHash signature and band keys, in one pass over the texts.
   Texts with equal sets are one class (an aggregation on the set's digest); only one of each class goes on.
2. Classes that share a band key are candidates.  First, every bucket names a hub and its other members are compared
   with the hub only.  The hub is the member that meets most others over all its bands: in a group of edited copies
   that is the text they were made from, which is closer to each copy than the copies are to each other.  Members that are already in one component need no comparison, so after ``HUB_ROUNDS`` rounds
   few buckets hold more than one component.  Those are compared in blocks of ``BLOCK`` members: a task compares two
   blocks in memory and emits the links alone, never a bucket's pairs.
3. A candidate pair is compared signature batch by signature batch.  After each batch the posterior probability of a
   similarity at or above the threshold, given the matches so far (uniform prior), must exceed the chosen miss
   probability; survivors of all batches are verified exactly on the full sets.
4. Links make components by label propagation over written tables.

Sizes: a signature part is 1 byte for each of 256 hashes; band keys are 48 longs of 6 hashes each, so that a pair at
similarity 0.8 meets in no band with probability 5e-7.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, cache_of, claim_cache, utf8, written

SHINGLE = 5
PERCENT = 80
BANDS, ROWS = 48, 6
COMPARED, BATCH = 256, 32
MISS = 1e-6
HUB_ROUNDS = 2
BLOCK = 1024


def words_of(text: bytes) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of the text in lower case (A-Z only)."""
    return text.lower().split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _WordHashes(dict):
    """word -> 64-bit hash, the same in every worker; emptied when it holds 400,000 words."""

    def __missing__(self, word):
        h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        if len(self) >= 400_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_HASHES = _WordHashes()
cache_of("near_duplicates", _HASHES.clear)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; a text of fewer words is one shingle, one without
    words none."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    n = min(shingle, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - n + 1 + k])
    return np.unique(out)


@lru_cache(maxsize=1)
def _multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 31, n, np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minhash(hashes: np.ndarray) -> np.ndarray:
    """MinHash values of a set of at least one hash; 64 KB of hashes at a time."""
    a, b = _multipliers()
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 1024):
        part = np.multiply.outer(a, x[at:at + 1024])
        part += b[:, None]
        np.minimum(low, part.min(axis=1), out=low)
    return low


def sketch(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, set_id (digest of the set), signature (bytes), bands (keys), marks (the keys' low 32 bits);
    empty sets have nulls."""

    def run(batch: pa.RecordBatch):
        claim_cache("near_duplicates")
        sizes, digests, signatures, minima = [], [], [], []
        for text in utf8(batch.column(1)):
            hashes = shingle_hashes(text, shingle)
            sizes.append(len(hashes))
            if len(hashes):
                digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                minima.append(minhash(hashes))
                signatures.append(minima[-1][:COMPARED].astype(np.uint8).tobytes())
            else:
                digests.append(None)
                signatures.append(None)
        keys = iter(())
        if minima:
            rows = np.stack(minima).reshape(len(minima), BANDS, ROWS).astype(np.uint64)
            key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
            for k in range(ROWS):
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
            keys = iter(key.astype(np.int64))
        bands = [next(keys) if d is not None else None for d in digests]
        marks = [None if b is None else b.astype(np.uint32).tobytes() for b in bands]
        return [batch.column(0), sizes, digests, signatures, bands, marks]

    return by_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run,
                    "doc_id long, n_shingles long, set_id binary, signature binary, bands array<long>, marks binary")


@lru_cache(maxsize=8)
def least_matches(percent: int, miss: float, compared: int = COMPARED, batch: int = BATCH) -> list[int]:
    """For 1, 2, ... batches, the least number of equal signature bytes with which the posterior probability that
    the similarity is ``percent`` or more is at least ``miss``.  Different hashes agree in a byte once in 256."""
    s = (np.arange(2000) + 0.5) / 2000
    p = s + (1 - s) / 256
    out = []
    for n in range(batch, compared + 1, batch):
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p + 1e-300)
        like = np.exp(log - log.max(axis=1, keepdims=True))
        posterior = like[:, s >= percent / 100].sum(axis=1) / like.sum(axis=1)
        out.append(int(np.argmax(posterior >= miss)))
    return out


def survivors(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, least: list[int]) -> np.ndarray:
    """Positions of the pairs (row ``i`` of ``left``, row ``j`` of ``right``) that no batch rules out."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for k, bound in enumerate(least):
        part = slice(k * BATCH, (k + 1) * BATCH)
        matches = matches + (left[i[alive], part] == right[j[alive], part]).sum(axis=1)
        passed = matches >= bound
        alive, matches = alive[passed], matches[passed]
        if not len(alive):
            break
    return alive


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COMPARED)


def near_hub(members: DataFrame, percent: int, miss: float, order: Column) -> DataFrame:
    """Pairs a < b of a member and its bucket's hub that the signatures do not rule out.  ``members``: key, id, size,
    component, signature.  The hub is the member with the highest ``order``."""
    columns = ["id", "size", "component", "signature"]
    hubs = members.groupBy("key").agg(F.max_by(F.struct(*columns), order).alias("h")).select(
        "key", *[F.col(f"h.{c}").alias(f"{c}_h") for c in columns])
    close = 100 * F.least("size", "size_h") >= percent * F.greatest("size", "size_h")
    met = members.join(hubs, "key").filter((F.col("component") != F.col("component_h")) & close)
    least = least_matches(percent, miss)

    def run(batch: pa.RecordBatch):
        every = np.arange(batch.num_rows)
        alive = pa.array(survivors(_signatures(batch.column(2)), _signatures(batch.column(3)), every, every, least))
        return [batch.column(0).take(alive), batch.column(1).take(alive)]

    ordered = met.select(F.least("id", "id_h").alias("a"), F.greatest("id", "id_h").alias("b"), "signature", "signature_h")
    return by_arrow(ordered, run, "a long, b long").distinct()


def _marks(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, BANDS)


def _alive(rows: pa.RecordBatch, percent: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of one block pair that are compared here and not ruled out by their signatures.

    ``rows``: key, low, high, own, id, size, component, signature, marks.  Members of one component are not compared,
    and a pair is compared only in the first of the bands that it shares."""
    key, low, high = (rows.column(k)[0].as_py() for k in range(3))
    own, size, component = (rows.column(k).to_numpy() for k in (3, 5, 6))
    first, second = np.flatnonzero(own == low), np.flatnonzero(own == high)
    small, large = np.minimum.outer(size[first], size[second]), np.maximum.outer(size[first], size[second])
    wanted = (component[first][:, None] != component[second]) & (100 * small >= percent * large)
    if low == high:
        wanted = np.triu(wanted, 1)
    x, y = np.nonzero(wanted)
    if not len(x):
        return x, y
    signatures, marks = _signatures(rows.column(7)), _marks(rows.column(8))
    x, y = first[x], second[y]
    alive = survivors(signatures, signatures, x, y, least)
    x, y = x[alive], y[alive]
    here = np.flatnonzero(marks[0] == np.uint32(key & 0xFFFFFFFF))
    mine = np.isin((marks[x] == marks[y]).argmax(axis=1), here)
    return x[mine], y[mine]


def _by_block(batches: Iterator[pa.RecordBatch], fn) -> Iterator[pa.RecordBatch]:
    """``fn`` of the rows of each (key, low, high), the first three columns, by which the rows are sorted; the last
    group of a batch may go on in the next."""
    def groups(rows: pa.RecordBatch, whole: bool):
        keys = np.stack([rows.column(k).to_numpy().astype(np.int64) for k in range(3)])
        edges = [0, *(np.flatnonzero(np.any(np.diff(keys, axis=1) != 0, axis=0)) + 1).tolist(), rows.num_rows]
        done = edges if whole else edges[:-1]
        found = [f for f in (fn(rows.slice(a, b - a)) for a, b in zip(done, done[1:])) if f is not None]
        return found, rows.slice(done[-1])

    rest = None
    for batch in batches:
        if batch.num_rows:
            found, rest = groups(batch if rest is None else pa.concat_batches([rest, batch]), False)
            yield from found
    if rest is not None and rest.num_rows:
        yield from groups(rest, True)[0]


def in_blocks(members: DataFrame, texts: DataFrame, shingle: int, percent: int, miss: float, block: int) -> DataFrame:
    """Links a < b between members of different components in one bucket: signatures first, then the full sets.

    A bucket of n members has n / ``block`` blocks; a task holds two of them.  A first pass names the members with a
    pair that the signatures do not rule out; only these bring their texts to the second pass, in which the task that
    compares two blocks verifies their pairs.  No pair leaves a task unless it is a link."""
    sizes = members.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    dealt = members.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own",
                         "id", "size", "component", "signature", "marks")
    least = least_matches(percent, miss)

    def name(rows: pa.RecordBatch):
        x, y = _alive(rows, percent, least)
        if not len(x):
            return None
        return pa.RecordBatch.from_arrays([rows.column(k).take(pa.array(np.unique(np.concatenate([x, y])))) for k in range(9)],
                                          schema=rows.schema)

    def verify(rows: pa.RecordBatch):
        x, y = _alive(rows, percent, least)
        sets = [shingle_hashes(t, shingle) for t in utf8(rows.column(9))]
        ids, links = rows.column(4).to_numpy(), []
        for i, j in zip(x.tolist(), y.tolist()):
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, j))
        if not links:
            return None
        i, j = np.array(links).T
        return pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(ids[i], ids[j])), "b": pa.array(np.maximum(ids[i], ids[j]))})

    blocks = ["key", "low", "high"]
    named = written(dealt.repartition(*blocks).sortWithinPartitions(*blocks).mapInArrow(
        lambda batches: _by_block(batches, name), dealt.schema), "named")
    full = named.join(texts.select("id", "text"), "id").select(*dealt.columns, "text")
    return full.repartition(*blocks).sortWithinPartitions(*blocks).mapInArrow(
        lambda batches: _by_block(batches, verify), "a long, b long").distinct()


def exact(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union.  ``texts``: id, text of classes."""

    def run(batch: pa.RecordBatch):
        kept, last, left = [], None, None
        for i, (x, y) in enumerate(zip(utf8(batch.column(2)), utf8(batch.column(3)))):
            if y != last:
                last, left = y, shingle_hashes(y, shingle)
            own = shingle_hashes(x, shingle)
            both = len(np.intersect1d(own, left, assume_unique=True))
            if 100 * both >= percent * (len(own) + len(left) - both):
                kept.append(i)
        kept = pa.array(kept, pa.int64())
        return [batch.column(0).take(kept), batch.column(1).take(kept)]

    joined = (pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b"))
    return by_arrow(joined.select("a", "b", "text_a", "text_b"), run, "a long, b long").distinct()


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """node, component (its smallest reachable node) of the nodes of ``links`` (a, b).  Each round a node takes the
    smallest label among its neighbours and then its label's label, until no label changes."""
    both = written(links.select("a", "b").union(links.select("b", "a")), "links")
    labels = both.groupBy("a").agg(F.least("a", F.min("b")).alias("component")).withColumnRenamed("a", "node")
    if start is not None:
        known = start.select("node", F.col("component").alias("known"))
        labels = labels.join(known, "node", "left").select("node", F.least("component", "known").alias("component"))
    labels = written(labels, "labels")
    while True:
        theirs = labels.select(F.col("node").alias("b"), F.col("component").alias("theirs"))
        near = both.join(theirs, "b").groupBy("a").agg(F.min("theirs").alias("theirs")).withColumnRenamed("a", "node")
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"),
                                                 F.least("component", "theirs").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        step = written(lower.join(jump, "component", "left").select(
            "node", "old", F.least("component", "further").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.filter("component < old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, miss: float = MISS,
                    hub_rounds: int = HUB_ROUNDS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links, its own included) and kept (doc_id =
    component_id) of every row of ``docs`` (doc_id, text).

    A text without words has an empty set and is linked with nothing.  Rows that repeat a doc_id count as one node.
    A row without a doc_id is linked with nothing: component_id null, kept true.
    """
    sketched = written(sketch(docs, shingle), "sketches")
    full = sketched.filter("n_shingles > 0 and doc_id is not null")
    # One row per set: equal sets are linked by definition.
    classes = written(full.groupBy("set_id").agg(F.min_by(F.struct("doc_id", "n_shingles", "signature", "bands", "marks"), "doc_id").alias("c"))
                      .select("set_id", F.col("c.doc_id").alias("id"), F.col("c.n_shingles").alias("size"),
                              F.col("c.signature").alias("signature"), F.col("c.bands").alias("bands"), F.col("c.marks").alias("marks")), "classes")
    keyed = classes.select("id", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    met = written(keyed.join(shared, "key"), "members")
    members = met.select("id", "key")
    wanted = written(met.groupBy("id").agg(F.sum("n").alias("degree")), "degrees")
    known = classes.select("id", "size", "signature", "marks").join(wanted, "id")
    texts = None
    links = tested = labels = None
    for turn in range(hub_rounds + 1):
        here = known.withColumn("component", F.col("id")) if labels is None else (
            known.join(labels.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id")))
        if labels is not None:
            members = mixed(members, here)
        here = members.join(here, "id")
        if texts is None:
            texts = written(docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(wanted, "id", "left_semi"), "texts")
        if turn == hub_rounds:
            found = in_blocks(here, texts, shingle, percent, miss, block)
        else:
            # The first round's hub is the same in all buckets of a group, so its pairs are few; the next ones differ.
            order = F.struct(F.lit(0) if turn else F.col("degree"), F.xxhash64("id", *([F.col("key"), F.lit(turn)] if turn else [])))
            alive = near_hub(here, percent, miss, order)
            if tested is not None:
                alive = alive.join(tested, ["a", "b"], "left_anti")
            alive = written(alive, "alive")
            if alive.isEmpty():
                continue
            tested = alive if tested is None else tested.union(alive)
            found = exact(alive, texts, shingle, percent)
        found = written(found, "found")
        if not found.isEmpty():
            links = found if links is None else links.union(found)
            labels = components(links, labels)

    rows = full.select("doc_id", "n_shingles", "set_id")
    named = classes.select("set_id", "id")
    if labels is not None:
        named = named.join(labels.withColumnRenamed("node", "id"), "id", "left")
        named = named.select("set_id", F.coalesce("component", "id").alias("component_id"))
    else:
        named = named.withColumnRenamed("id", "component_id")
    linked = rows.join(named, "set_id").select("doc_id", "n_shingles", "component_id")
    alone = sketched.filter("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def mixed(members: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (id, key) of the buckets that hold more than one component."""
    placed = members.join(known.select("id", "component"), "id")
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    return written(members.join(keys.select("key"), "key", "left_semi"), "mixed")


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` without those that are near-duplicates of a row that stays.  One row stays of rows that
    repeat a doc_id; rows without a doc_id stay."""
    kept = near_duplicates(docs, shingle, percent).filter("kept and doc_id is not null").select("doc_id").distinct()
    with_id = docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    with_id = with_id.select(*[F.col(f"`{c}`") for c in docs.columns])
    return with_id.union(docs.filter("doc_id is null"))
