"""Prefix trie of conversations by union-find over sorted neighbours.

A turn is a 16-byte digest of role and text; texts are not shuffled.  A conversation is the row of its turns' digests;
sorted, conversations with a common prefix are neighbours, and the longest common prefix (LCP) of two neighbours
is an edge.  ``Forest`` takes the edges of one batch from the deepest to the shallowest: every merge of two
components makes (or widens) the branching node at that depth, and the turns above it, up to the next branching,
are a chain with one child each.  A batch or partition ends where it ends: only nodes that are a prefix of its
first or last conversation *and* of the neighbour across the boundary are open.  All their values are sums or minima
over the batches, so the forests are contracted to these paths and merged by key; everything else is final.

Long conversations are cut into blocks of ``BLOCK`` turns.  A block's trie hangs below the node where the blocks
before it end; levels are worked from the deepest up, each handing its roots' sums to the nodes above.

Defined cases: rows without conv_id belong to no conversation; a null role or text is empty; turns go by ``turn``
(null first), ties by the digest of role and text, and repeated rows are kept as turns of their own; an empty table
has no node; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..session import ensure_checkpoint_dir, ship_package
from .common import written

WIDTH = 16
BLOCK = 512  # turns of a conversation in one row; a batch of 10,000 rows is at most 100 MB
SHARED = 100  # conversation c starts like conversation c - c % SHARED ...
HEADS = 6  # ... by crc32(c) % HEADS turns
BUCKET = 1024  # conversation ids in one piece of a list of members


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:WIDTH]


def in_order(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` sorted over all its partitions, which stay as they are: later jobs see the same rows in each."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys).checkpoint()


def per_partition(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` of ``fn(part, batches)`` that yields lists of columns."""
    ship_package(df.sparkSession)
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        for columns in fn(TaskContext.get().partitionId(), (b for b in batches if b.num_rows)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return df.mapInArrow(run, out)


# --- turns to pieces of conversations -----------------------------------------------------------------------------

def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and chars (code points of the text) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    framed = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.substring(F.unhex(F.sha2(framed, 256)), 1, WIDTH).alias("digest"), F.length(text).alias("chars"))


def first_and_last(part: int, batches: Iterator[pa.RecordBatch]):
    """First and last conversation of a sorted partition with their turns in it."""
    first = last = None
    n_first = n_last = 0
    for batch in batches:
        ids = batch.column(0).to_numpy()
        first = ids[0] if first is None else first
        n_first += int((ids == first).sum())
        n_last = int((ids == ids[-1]).sum()) + (n_last if last == ids[-1] else 0)
        last = ids[-1]
    if first is not None:
        yield [[part], [int(first)], [n_first], [int(last)], [n_last]]


def pieces(turns: DataFrame, block: int) -> DataFrame:
    """Runs of one conversation's turns in their order: conv_id, first (place of the run's first turn), digests and
    chars (4 bytes a turn).  Turns are dealt by ranges of (conv_id, turn), so one long conversation lies in many
    tasks; two numbers per partition give each one its place."""
    ordered = in_order(turns, "conv_id", "turn", "digest").select("conv_id", "digest", "chars")
    bounds = per_partition(ordered.select("conv_id"), first_and_last, "part int, first long, n_first long, last long, n_last long")
    before, tail = {}, (None, 0)
    for b in sorted(bounds.collect()):  # one row per partition
        before[b.part] = tail[1] if tail[0] == b.first else 0
        tail = (b.last, b.n_last + (before[b.part] if b.first == b.last else 0))

    def cut(part, batches):
        at, last = before.get(part, 0), None
        for batch in batches:
            ids = batch.column(0).to_numpy()
            flat = b"".join(batch.column(1).to_pylist())
            chars = batch.column(2).to_numpy().astype("<i4").tobytes()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]]).tolist()
            out = [[], [], [], []]
            for a, b in zip(starts, starts[1:]):
                if last is not None and ids[a] != last:
                    at = 0
                last = ids[a]
                for x in range(a, b, block):
                    y = min(b, x + block)
                    for column, value in zip(out, (int(last), at, flat[WIDTH * x:WIDTH * y], chars[4 * x:4 * y])):
                        column.append(value)
                    at += y - x
            yield out

    return per_partition(ordered, cut, "conv_id long, first long, digests binary, chars binary")


def joined(parts: str, field: str) -> str:
    """SQL for the bytes of ``field`` of an ordered array of structs, one after the other."""
    return f"aggregate({parts}, CAST('' AS BINARY), (a, x) -> concat(a, x.{field}))"


def rebuilt(runs: DataFrame, block: int) -> DataFrame:
    """Conversation c as the first h turns of conversation c - c % 100 and its own turns after its first h, in blocks:
    conv_id, block, digests, chars.  h = crc32(decimal c) % 6.  At most five turns of a base travel, and each
    base has at most 99 others; a long conversation has one row per block."""
    runs = written(runs, "runs")
    heads = (runs.filter(f"conv_id % {SHARED} = 0 AND first < {HEADS - 1}").groupBy(F.col("conv_id").alias("base_id"))
             .agg(F.sort_array(F.collect_list(F.struct("first", F.substring("digests", 1, WIDTH * HEADS).alias("digests"),
                                                        F.substring("chars", 1, 4 * HEADS).alias("chars")))).alias("parts"))
             .selectExpr("base_id", f"{joined('parts', 'digests')} AS base_digests", f"{joined('parts', 'chars')} AS base_chars"))
    with_base = (runs.withColumn("base_id", F.expr(f"conv_id - conv_id % {SHARED}")).join(heads, "base_id", "left")
                 .withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS)
                 .withColumn("k", F.least("h", F.coalesce(F.expr(f"octet_length(base_digests) DIV {WIDTH}"), F.lit(0)))))
    own = with_base.selectExpr(
        "conv_id", "IF(first = 0, 0L, greatest(first, h) - h + k) AS place",
        *[f"""concat(IF(first = 0 AND k > 0, substring(base_{c}, 1, CAST({w} * k AS INT)), CAST('' AS BINARY)),
                     substring({c}, CAST({w} * greatest(h - first, 0) + 1 AS INT))) AS {c}""" for c, w in (("digests", WIDTH), ("chars", 4))],
        "first = 0 AS starts")
    own = own.withColumn("n", F.expr(f"octet_length(digests) DIV {WIDTH}")).filter("n > 0 OR starts")
    in_blocks = own.select("*", F.explode(F.expr(f"sequence(place DIV {block}, greatest(place, place + n - 1) DIV {block})")).alias("block"))
    low, high = f"greatest(place, block * {block})", f"least(place + n, (block + 1) * {block})"
    cut = in_blocks.selectExpr("conv_id", "block", f"{low} AS place", *[
        f"substring({c}, CAST({w} * ({low} - place) + 1 AS INT), CAST({w} * ({high} - {low}) AS INT)) AS {c}"
        for c, w in (("digests", WIDTH), ("chars", 4))])
    return (cut.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("place", "digests", "chars"))).alias("parts"))
            .selectExpr("conv_id", "block", f"{joined('parts', 'digests')} AS digests", f"{joined('parts', 'chars')} AS chars"))


def paths(blocks: DataFrame) -> DataFrame:
    """``path``: a block's digests behind one for all blocks before it (zeros for the first); ``next``: that of the
    block after it, null where the conversation ends.  Only conversations of several blocks take part in the window,
    with one digest per block."""
    zero = F.lit(b"\0" * WIDTH)
    long = blocks.filter("block > 0").select("conv_id").distinct()
    digests = F.substring(F.unhex(F.sha2("digests", 256)), 1, WIDTH)
    order = Window.partitionBy("conv_id").orderBy("block")
    so_far = F.array_join(F.collect_list(F.hex("d")).over(order.rowsBetween(Window.unboundedPreceding, -1)), "")
    chain = (blocks.join(long, "conv_id", "left_semi").select("conv_id", "block", digests.alias("d"))
             .select("conv_id", "block", F.substring(F.unhex(F.sha2(so_far.cast("binary"), 256)), 1, WIDTH).alias("chain"))
             .withColumn("chain", F.when(F.col("block") == 0, zero).otherwise(F.col("chain")))
             .withColumn("next", F.lead("chain").over(order)))
    chain = written(chain, "chains")
    return (blocks.join(chain, ["conv_id", "block"], "left")
            .select("conv_id", "block", F.concat(F.coalesce("chain", zero), "digests").alias("path"), "chars", "next"))


# --- equal blocks to one row ----------------------------------------------------------------------------------------

def members(blocks: DataFrame) -> DataFrame:
    """One row per distinct path: block, path, chars, next, n (conversations), conv_id (smallest) and ends (SHA-256 of
    the ascending ids of those that end there; null if none).  Members are gathered in pieces of ``BUCKET`` ids, and
    the pieces of one path are hashed as they stream by."""
    ended = F.when(F.col("next").isNull(), F.col("conv_id"))
    gathered = blocks.groupBy("block", "path", F.floor(F.col("conv_id") / BUCKET).alias("bucket")).agg(
        F.array_join(F.sort_array(F.collect_list(ended)), ",").alias("ended"), F.count("*").alias("n"),
        F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"), F.max("next").alias("next"))
    dealt = (gathered.repartition("block", "path").sortWithinPartitions("block", "path", "bucket")
             .select("block", "path", "ended", "n", "conv_id", "chars", "next"))

    def stream(part, batches):
        now = None
        for batch in batches:
            out = []
            for block, path, ended, n, conv_id, chars, following in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or (now[0], now[1]) != (block, path):
                    if now:
                        out.append(now)
                    now = [block, path, chars, None, 0, conv_id, None]
                now[4] += n
                now[3] = now[3] or following
                if ended:
                    if now[6] is None:
                        now[6] = hashlib.sha256()
                    else:
                        now[6].update(b",")
                    now[6].update(ended.encode())
            if out:
                yield closed_rows(out)
        if now:
            yield closed_rows([now])

    def closed_rows(rows):
        return [*zip(*((*r[:6], r[6] and r[6].hexdigest()) for r in rows))]

    return per_partition(dealt, stream, "block long, path binary, chars binary, next binary, n long, conv_id long, ends string")


# --- sorted paths to nodes ------------------------------------------------------------------------------------------

def lcp(a: bytes, b: bytes) -> int:
    """Common leading digests."""
    low, high = 0, min(len(a), len(b)) // WIDTH
    while low < high:
        middle = (low + high + 1) // 2
        if a[WIDTH * low:WIDTH * middle] == b[WIDTH * low:WIDTH * middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Forest:
    """Nodes of one batch of sorted distinct paths.

    ``rows`` are (path, chars, n, conv_id, ends, children, leaves, saved, continues, root_conv); children, leaves and saved come
    from the blocks below the path's end.  ``before`` and ``after`` are the LCPs with the neighbours outside.
    Components are ranges of neighbours; each knows its deepest node not yet closed (``bottom``) and that node's sums.
    Depths count the path's digests: 1 is the root of a trie."""

    def __init__(self, rows: list[tuple], before: int, after: int):
        self.rows, self.before, self.after = rows, before, after
        size = len(rows)
        edges = [before, *(lcp(a[0], b[0]) for a, b in zip(rows, rows[1:])), after]
        self.parent = list(range(size))
        self.low, self.high = list(range(size)), list(range(size))
        self.bottom = [len(r[0]) // WIDTH for r in rows]
        self.n, self.conv, self.ends = [r[2] for r in rows], [r[3] for r in rows], [r[4] for r in rows]
        self.children, self.saved = [r[5] for r in rows], [r[7] for r in rows]
        self.leaves = [r[6] if r[8] else int(edges[i + 1] < self.bottom[i]) for i, r in enumerate(rows)]
        self.costs = [np.frombuffer(r[1], "<i4").tolist() for r in rows]
        self.below: list[list[int]] = [[] for _ in rows]
        self.nodes: list[tuple] = []
        self.parent_node: list[int] = []
        for i in sorted((i for i in range(1, size) if edges[i]), key=lambda i: -edges[i]):
            a, b = self.find(i - 1), self.find(i)
            self.lift(a, edges[i])
            self.lift(b, edges[i])
            self.merge(a, b)
        for c in {self.find(i) for i in range(size)}:
            self.lift(c, 0)

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def merge(self, a: int, b: int) -> None:
        """Join two components whose open nodes are the same one; the list of nodes below goes to the longer one."""
        if len(self.below[a]) < len(self.below[b]):
            a, b = b, a
        self.parent[b] = a
        self.low[a], self.high[a] = min(self.low[a], self.low[b]), max(self.high[a], self.high[b])
        self.conv[a], self.ends[a] = min(self.conv[a], self.conv[b]), self.ends[a] or self.ends[b]
        for values in (self.n, self.children, self.leaves, self.saved):
            values[a] += values[b]
        self.below[a] += self.below[b]
        self.below[b] = []

    def lift(self, c: int, depth: int) -> None:
        """Close the nodes of a component that lie deeper than ``depth``."""
        low = self.low[c]
        for d in range(self.bottom[c], depth, -1):
            cost = self.costs[low][d - 2] if d > 1 else 0
            started = not (low == 0 and d <= self.before)
            self.saved[c] += (self.n[c] - started) * cost
            is_open = not started or (self.high[c] == len(self.rows) - 1 and d <= self.after)
            node = len(self.nodes)
            for child in self.below[c]:
                self.parent_node[child] = node
            self.nodes.append((d, low, self.n[c], self.conv[c], self.children[c], self.leaves[c], self.saved[c], self.ends[c], is_open))
            self.parent_node.append(-1)
            self.below[c], self.children[c], self.ends[c] = [node], int(started), None
        self.bottom[c] = min(self.bottom[c], depth)

    def columns(self, part: int, depth0: int) -> list[list]:
        out = []
        for (d, low, n, conv, children, leaves, saved, ends, is_open), above in zip(self.nodes, self.parent_node):
            path = self.rows[low][0]
            up = self.nodes[above] if above >= 0 else None
            if d == 1 and self.rows[low][9] is not None:
                conv = self.rows[low][9]
            parent_conv = parent_key = None
            if up and up[8]:
                parent_key = digest(path[:WIDTH * (d - 1)])
            elif up:
                parent_conv = self.rows[up[1]][9] if d == 2 and self.rows[up[1]][9] is not None else up[3]
            out.append((part, digest(path[:WIDTH * d]) if is_open else None, parent_key, path[:WIDTH] if d == 1 else None,
                        depth0 + d - 1, conv, parent_conv, n, children, leaves, saved, ends, is_open))
        return [*zip(*out)]


NODES = ("part int, key binary, parent_key binary, root binary, depth long, conv_id long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string, open boolean")


def neighbour_lcps(ordered: DataFrame) -> tuple[dict[int, int], dict[int, int]]:
    """LCP of each partition's first path with the last one before it, and of its last path with the next one."""
    def ends(part, batches):
        first = last = None
        for batch in batches:
            column = batch.column(0)
            first = first or column[0].as_py()
            last = column[-1].as_py()
        if first:
            yield [[part], [first], [last]]

    def common(part, batches):
        for batch in batches:
            after, first, last = (batch.column(i).to_pylist() for i in range(3))
            yield [after, [lcp(a, b) for a, b in zip(first, last)]]

    bounds = written(per_partition(ordered.select("path"), ends, "part int, first binary, last binary"), "bounds")
    parts = sorted(r.part for r in bounds.select("part").collect())  # numbers of the partitions that have rows
    if len(parts) < 2:
        return {}, {}
    order = bounds.sparkSession.createDataFrame(list(zip(parts, parts[1:])), "part int, after int")
    pairs = (bounds.select("part", "last").join(F.broadcast(order), "part")
             .join(bounds.selectExpr("part AS after", "first"), "after").select("after", "first", "last"))
    before = {r.after: r.common for r in per_partition(pairs, common, "after int, common int").collect()}
    return before, {a: before[b] for a, b in zip(parts, parts[1:])}


def forest_nodes(level: DataFrame, depth0: int) -> DataFrame:
    """Nodes of the tries of one level of blocks, as far as each batch knows them."""
    ordered = in_order(level.select("path", "chars", "n", "conv_id", "ends", "children", "leaves", "saved",
                                    F.col("next").isNotNull().alias("continues"), "root_conv"), "path")
    before, after = neighbour_lcps(ordered)

    def run(part, batches):
        waiting, at = None, before.get(part, 0)
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            if waiting:
                shared = lcp(waiting[-1][0], rows[0][0])
                yield Forest(waiting, at, shared).columns(part, depth0)
                at = shared
            waiting = rows
        if waiting:
            yield Forest(waiting, at, after.get(part, 0)).columns(part, depth0)

    return written(per_partition(ordered, run, NODES), "nodes")


def merged(nodes: DataFrame) -> DataFrame:
    """Final nodes of a level: the open ones summed over the batches, and every parent's id looked up.  A node below an
    open one finds it through its own partition, so no key of this join has more rows than a partition."""
    values = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends", "root"]
    pieces_of = nodes.filter("open")
    whole = written(pieces_of.groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("root").alias("root"), F.first("depth").alias("depth"),
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends").alias("ends")), "open")
    ids = whole.selectExpr("key AS parent_key", "conv_id AS found")
    in_part = pieces_of.select("part", F.col("key").alias("parent_key")).distinct().join(ids, "parent_key").select("part", "parent_key", "found")
    closed = nodes.filter("NOT open")
    below = closed.filter("parent_key IS NOT NULL").join(in_part, ["part", "parent_key"]).withColumn("parent_conv_id", F.col("found"))
    upper = whole.join(ids, "parent_key", "left").withColumn("parent_conv_id", F.col("found"))
    return closed.filter("parent_key IS NULL").select(values).unionByName(below.select(values)).unionByName(upper.select(values))


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """Nodes of the trie of rebuilt conversations: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens and ends_sha256.  Reads conv_id, turn, role and text."""
    blocks = written(rebuilt(pieces(turn_digests(conversations), block), block), "blocks")
    deepest = blocks.agg(F.max("block")).first()[0]
    if not deepest:  # all conversations end in their first block
        zero = F.lit(b"\0" * WIDTH)
        blocks = blocks.select("conv_id", "block", F.concat(zero, "digests").alias("path"), "chars", F.lit(None).cast("binary").alias("next"))
    else:
        blocks = paths(blocks)
    groups = members(blocks)
    if deepest:
        groups = written(groups, "paths")
    out, roots = None, None
    for at in range(deepest or 0, -1, -1):
        level = groups.filter(F.col("block") == at)
        if roots is None:
            level = level.select("*", *[F.lit(0).cast("long").alias(c) for c in ("children", "leaves", "saved")])
        else:
            level = level.join(roots, "next", "left").fillna(0, ["children", "leaves", "saved"])
        if at:
            above = groups.filter((F.col("block") == at - 1) & F.col("next").isNotNull()).selectExpr("next AS root", "conv_id AS root_conv")
            level = level.withColumn("root", F.substring("path", 1, WIDTH)).join(above, "root").drop("root")
        else:
            level = level.withColumn("root_conv", F.lit(None).cast("long"))
        nodes = merged(forest_nodes(level, at * block))
        if at:
            nodes = written(nodes, "level")
            roots = nodes.filter("root IS NOT NULL").selectExpr("root AS next", "n_children AS children", "n_leaves AS leaves", "saved_tokens AS saved")
            nodes = nodes.filter("root IS NULL")
        out = nodes if out is None else out.unionByName(nodes)
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                      F.coalesce("ends", F.sha2(F.lit(b""), 256)).alias("ends_sha256"))
