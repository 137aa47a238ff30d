"""Exact density clustering over packed blocks of points.

Rows go to the cell of their nearest pivot (``neighbours``) through one shuffle, and the task that gets a cell's rows writes
them as packed blocks of distinct points to the shared folder.  No row is sent to a neighbouring cell: a task that works on a
block opens the blocks of the cells that the bounds of ``neighbours.Cells`` cannot rule out, nearest first, and holds at most
``HELD`` bytes of them.

1. Counting: a point leaves the search as soon as it has its ``min_samples`` neighbours.
2. Linking: core points of a block are joined by search from point to point, then components of two blocks; pairs of points
   that are joined already are not compared.  The driver merges the labels' graph, or Spark does in rounds where it is large.
3. Placing: a point that is not core looks for the component with the smallest label, among those smaller than what it has.

A block is some thousands of points, and copies of a point are one point with a count, so neither a dense cell nor many copies
make a large one.  The driver holds the pivots and a few numbers per block.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict, defaultdict
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir, ship_package
from . import neighbours as NB
from .fits import vectors_of

HELD = 96 << 20  # bytes of other blocks that a task holds
COPIES = 16  # rows of a block, at most, for each point that it may hold
TASKS = 6  # for each core
NEAREST = 8  # cells of a block, its own among them, that it is linked with first
EDGES = 1_000_000  # of the labels' graph that the driver merges by itself
ROOM = 1e-6  # added to the room of the bounds, relative and absolute
NONE = np.iinfo(np.int64).max  # key of a point whose rows have none
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass
class Block:
    """Place of a block's file, its cell and number of points, and the places of what is known of its points."""

    path: str
    members: str
    cell: int
    n: int
    core: str = ""
    label: str = ""
    roots: str = ""


def _put(path: str, *arrays: np.ndarray) -> str:
    """A new file of the arrays' bytes; no name comes twice, so attempts at a task do not meet."""
    path = f"{path}-{uuid.uuid4().hex}"
    store, place = fs.FileSystem.from_uri(path)
    with store.open_output_stream(place) as sink:
        for a in arrays:
            sink.write(np.ascontiguousarray(a).data.cast("B") if a.size else b"")
    return path


def _get(path: str) -> bytes:
    store, place = fs.FileSystem.from_uri(path)
    with store.open_input_stream(place) as source:
        return source.read()


def _points(b: Block, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Points, distances to the pivot, smallest keys (``NONE``: all null) and copies of a block."""
    raw = _get(b.path)
    x = np.frombuffer(raw, float, b.n * dim).reshape(b.n, dim)
    own = np.frombuffer(raw, float, b.n, b.n * dim * 8)
    keys, copies = (np.frombuffer(raw, np.int64, b.n, b.n * (dim + 1 + i) * 8) for i in range(2))
    return x, own, keys, copies


class Held:
    """What ``load`` returns for a block, for the last blocks asked for."""

    def __init__(self, load):
        self.load, self.found, self.size = load, OrderedDict(), 0

    def __call__(self, i: int):
        if i in self.found:
            self.found.move_to_end(i)
            return self.found[i]
        self.found[i] = out = self.load(i)
        self.size += sum(a.nbytes for a in out)
        while self.size > HELD and len(self.found) > 1:
            self.size -= sum(a.nbytes for a in self.found.popitem(last=False)[1])
        return out


def _open(cells: NB.Cells, d: np.ndarray, home: int, own: np.ndarray, some: np.ndarray, eps: float) -> np.ndarray:
    """Mask of ``some`` cells that may hold a row within ``eps`` of the points of the cell ``home``."""
    bound = cells.bounds(d, np.full(len(d), home), own, some)
    return ~(bound > eps + ROOM * (1 + d)) & (cells.rows[some] > 0)


def _to_pivots(cells: NB.Cells, x: np.ndarray, home: int) -> np.ndarray:
    """Distances to all pivots by products around the home pivot, which no other is nearer than."""
    a, p = x - cells.pivots[home], cells.pivots - cells.pivots[home]
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * (a @ p.T), 0.0))


def _facing(cells: NB.Cells, x: np.ndarray, cell: int, own: np.ndarray, other: int, eps: float) -> np.ndarray:
    """The points of a block of ``cell`` that may be within ``eps`` of a row of the cell ``other``."""
    d = np.sqrt(NB.paired(x, np.broadcast_to(cells.pivots[other], x.shape)))[:, None]
    return np.flatnonzero(_open(cells, d, cell, own, np.array([other]), eps)[:, 0])


def nearest(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of each row (the first of equal ones) and the distance to it."""
    d, room = NB.products(x, pivots, float)
    rows = np.arange(len(x))
    home = np.where(np.isfinite(d), d, np.inf).argmin(axis=1)
    least = d[rows, home]
    d[rows, home] = np.inf
    unsure = np.flatnonzero(~(d.min(axis=1) > least + 2 * room))
    home[unsure] = NB.squared(x[unsure], pivots).argmin(axis=1)
    return home, np.sqrt(NB.paired(x, pivots[home]))


def packed(x: DataFrame, pivots: np.ndarray, folder: str, block: int) -> tuple[NB.Cells, list[Block]]:
    """Write the points of ``x`` (k, x) as blocks of about ``block`` points of one cell; near cells are near in the list."""
    spark, n_pivots = x.sparkSession, len(pivots)
    ship_package(spark)
    sent = spark.sparkContext.broadcast(pivots)

    def assign(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                some = batch.slice(low, 1024)
                home, own = nearest(vectors_of(some.column(1)), sent.value)
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(home.astype(np.int32)), pa.array(own)], names=["k", "x", "cell", "own"])

    def pack(batches):
        parts, cell, n, rows = [], -1, 0, 0

        def stored():
            points, own, keys, copies, at, k = (np.concatenate([q[i] for q in parts]) for i in range(6))
            path = _put(f"{folder}/block", points, own, keys, copies)
            members = _put(f"{folder}/members", np.column_stack([at, k]))
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([members]), pa.array([cell], pa.int32()), pa.array([len(points)]), pa.array([own.min()]),
                                               pa.array([own.max()])], names=["path", "members", "cell", "n", "near", "far"])

        for batch in batches:
            if not batch.num_rows:
                continue
            homes = batch.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(homes)) + 1).tolist(), len(homes)]
            steps = [(a, min(a + block, high)) for low, high in zip(cuts, cuts[1:]) for a in range(low, high, block)]
            for low, high in steps:
                some = batch.slice(low, high - low)
                if parts and (homes[low] != cell or n >= block or rows >= COPIES * block):
                    yield stored()
                    parts, n, rows = [], 0, 0
                cell = int(homes[low])
                v, own = vectors_of(some.column(1)), some.column(3).to_numpy()
                first = np.flatnonzero(np.append(True, (v[1:] != v[:-1]).any(axis=1)))  # copies stand together
                real, k = some.column(0).is_valid().to_numpy(zero_copy_only=False), some.column(0).fill_null(NONE).to_numpy()
                copies = np.diff(np.append(first, len(v)))
                at = n + np.repeat(np.arange(len(first)), copies)
                parts.append((v[first], own[first], np.minimum.reduceat(k, first), copies.astype(np.int64), at[real], k[real]))
                n, rows = n + len(first), rows + len(v)
        if parts:
            yield stored()

    n_parts = max(1, -(-x.count() // (n_pivots * block)))
    homes = x.mapInArrow(assign, "k bigint, x array<double>, cell int, own double").withColumn("h", F.xxhash64("x"))
    dealt = homes.repartition("cell", F.pmod("h", F.lit(n_parts))).sortWithinPartitions("cell", "h").select("k", "x", "cell", "own")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        found = dealt.mapInArrow(pack, "path string, members string, cell int, n long, near double, far double").collect()  # one row per block
    finally:
        spark.conf.set(CLEANUP, before)
    cells = NB.Cells(pivots, np.zeros(n_pivots, np.int64), np.full(n_pivots, np.inf), np.zeros(n_pivots), np.arange(n_pivots))
    for r in found:
        c = r["cell"]
        cells.rows[c], cells.near[c], cells.far[c] = cells.rows[c] + r["n"], min(cells.near[c], r["near"]), max(cells.far[c], r["far"])
    cells.near[cells.rows == 0] = 0.0
    beside = NB.groups_of(pivots, cells.rows, block)
    blocks = [Block(r["path"], r["members"], r["cell"], r["n"]) for r in sorted(found, key=lambda r: (beside[r["cell"]], r["cell"], r["path"]))]
    return cells, blocks


def _by_block(spark, cells: NB.Cells, blocks: list[Block], work, schema: str) -> DataFrame:
    """``work(cells, blocks, blocks of each cell, some)`` for lists ``some`` of numbers of blocks that lie together."""
    of = defaultdict(list)
    for i, b in enumerate(blocks):
        of[b.cell].append(i)
    sent = spark.sparkContext.broadcast((cells, blocks, dict(of)))
    n_tasks = min(len(blocks), max(TASKS * spark.sparkContext.defaultParallelism, len(blocks) // 32))
    ends = np.linspace(0, len(blocks), n_tasks + 1).astype(int).tolist()

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                yield from work(*sent.value, range(ends[task], ends[task + 1]))

    return spark.range(0, n_tasks, 1, n_tasks).mapInArrow(run, schema)


def _core_points(cells: NB.Cells, blocks: list[Block], of: dict, some: range, folder: str, eps: float, e2: float, min_samples: int):
    """Number of each block and the file that says which of its points are core."""
    dim = cells.pivots.shape[1]
    held = Held(lambda j: _points(blocks[j], dim))
    for i in some:
        (x, own, keys, copies), home = held(i), blocks[i].cell
        open_ = _open(cells, _to_pivots(cells, x, home), home, own, np.arange(len(cells.pivots)), eps)
        found = copies * 0
        for c in np.argsort(cells.apart[home], kind="stable"):
            if not open_[:, c].any():
                continue
            left = np.flatnonzero(open_[:, c] & (found < min_samples))
            for j in of[c]:
                if not len(left):
                    break
                y, own_, _, copies_ = held(j)
                facing = _facing(cells, y, c, own_, home, eps)
                single, within = bool((copies_[facing] == 1).all()), NB.Within(y[facing], e2)
                for here in NB.slices(len(left), len(facing)) if len(facing) else ():
                    near = within(x[left[here]])
                    found[left[here]] += np.count_nonzero(near, axis=1) if single else near @ copies_[facing]
                left = left[found[left] < min_samples]
        name = _put(f"{folder}/core", (found >= min_samples) & (keys != NONE))
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([name])], names=["block", "path"])


def components(x: np.ndarray, keys: np.ndarray, e2: float) -> np.ndarray:
    """For each point the smallest key among those that it is joined to by steps within the radius."""
    label, rest = np.empty(len(x), np.int64), np.arange(len(x))
    while len(rest):
        members, ahead, rest = [rest[:1]], rest[:1], rest[1:]
        while len(ahead) and len(rest):
            step = max(16, min(128, NB.PAIRS // len(rest)))
            near = NB.decided(x[ahead[:step]], x[rest], e2).any(axis=0)
            members.append(rest[near])
            ahead, rest = np.append(ahead[step:], rest[near]), rest[~near]
        members = np.concatenate(members)
        label[members] = keys[members].min()
    return label


def _core_view(b: Block, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core points of a block, their distances to the pivot and labels."""
    x, own, _, _ = _points(b, dim)
    core = np.frombuffer(_get(b.core), bool)
    return x[core], own[core], np.frombuffer(_get(b.label), np.int64)


def _block_labels(cells: NB.Cells, blocks: list[Block], of: dict, some: range, folder: str, e2: float):
    """Number of each block, the file of its core points' labels in the block, and the labels."""
    for i in some:
        x, _, keys, _ = _points(blocks[i], cells.pivots.shape[1])
        core = np.frombuffer(_get(blocks[i].core), bool)
        label = components(x[core], keys[core], e2)
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([_put(f"{folder}/label", label)])], names=["block", "path"])


class Joined:
    """Union-find over labels; the smallest label of a set names it."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, a: int) -> int:
        top = a
        while self.up.get(top, top) != top:
            top = self.up[top]
        while a != top:
            self.up[a], a = top, self.up.get(a, a)
        return top

    def join(self, a: int, b: int) -> None:
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def _met(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of values of ``a`` (of the rows) and ``b`` (of the columns) with a mark in ``near``."""
    def folded(mask, names, axis):
        order = np.argsort(names, kind="stable")
        found, first = np.unique(names[order], return_index=True)
        return np.logical_or.reduceat(np.take(mask, order, axis=axis), first, axis=axis), found
    rows = np.flatnonzero(near.any(axis=1))
    if not len(rows):
        return []
    mask, right = folded(near[rows], b, 1)
    mask, left = folded(mask, a[rows], 0)
    i, j = np.nonzero(mask)
    return list(zip(left[i].tolist(), right[j].tolist()))


def _tops(label: np.ndarray, roots: tuple) -> np.ndarray:
    """The roots of labels; a label that ``roots`` (labels in order, their roots) does not name is its own."""
    labels, tops = roots
    if not len(labels):
        return label
    at = np.minimum(np.searchsorted(labels, label), len(labels) - 1)
    return np.where(labels[at] == label, tops[at], label)


def _links(cells: NB.Cells, blocks: list[Block], of: dict, some: range, roots: tuple, most_cells: int, eps: float, e2: float):
    """Pairs of labels of different blocks that lie within the radius of each other, as trees: those of the ``most_cells``
    nearest cells of each block.  ``roots`` says which labels are joined already."""
    dim, joined = cells.pivots.shape[1], Joined()

    def rooted(j):
        x, own, label = _core_view(blocks[j], dim)
        names, at = np.unique(_tops(label, roots), return_inverse=True)
        return x, own, names, at.ravel()

    held = Held(rooted)
    for i in some:
        (x, own, names, at), home = held(i), blocks[i].cell
        if not len(x):
            continue
        open_ = _open(cells, _to_pivots(cells, x, home), home, own, np.arange(len(cells.pivots)), eps)
        for c in np.argsort(cells.apart[home], kind="stable")[:most_cells]:
            if not open_[:, c].any():
                continue
            for j in of[c]:
                if j == i or (j > i) == bool((i + j) % 2):  # each pair of blocks in one place
                    continue
                y, own_, names_, at_ = held(j)
                a, b = ([joined.root(name) for name in some_.tolist()] for some_ in (names, names_))
                if len({*a, *b}) < 2:
                    continue
                a, b = np.array(a)[at], np.array(b)[at_]
                tops, counts = np.unique(np.append(a, b), return_counts=True)
                most = tops[counts.argmax()]
                facing = _facing(cells, y, c, own_, home, eps)
                for rows, cols in ((np.flatnonzero(open_[:, c] & (a == most)), facing[b[facing] != most]), (np.flatnonzero(open_[:, c] & (a != most)), facing)):
                    within = NB.Within(y[cols], e2)
                    for here in NB.slices(len(rows), len(cols)) if len(cols) else ():
                        for one, other in _met(within(x[rows[here]]), a[rows[here]], b[cols]):
                            joined.join(one, other)
    edges = [(a, joined.root(a)) for a in list(joined.up)]
    edges = [(a, b) for a, b in edges if a != b]
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in range(2)], names=["a", "b"])


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels in order and the smallest label that each is joined to by the edges."""
    labels, at = np.unique(np.append(a, b), return_inverse=True)
    up, (i, j) = np.arange(len(labels)), np.split(at.ravel(), 2)
    while True:
        one, other = up[i], up[j]
        if (one == other).all():
            return labels, labels[up]
        np.minimum.at(up, np.maximum(one, other), np.minimum(one, other))
        while (up[up] != up).any():
            up = up[up]


def _placed(cells: NB.Cells, blocks: list[Block], of: dict, some: range, roots: tuple, eps: float, e2: float):
    """Key and root of the rows in a cluster; a point that is not core has the smallest root among its core neighbours."""
    dim = cells.pivots.shape[1]

    def rooted(j):
        x, own, label = _core_view(blocks[j], dim)
        label = _tops(label, roots if not blocks[j].roots else np.frombuffer(_get(blocks[j].roots), np.int64).reshape(2, -1))
        order = np.argsort(label, kind="stable")  # the smallest roots first
        return x[order], own[order], label[order], np.argsort(order)

    held = Held(rooted)
    for i in some:
        (x, own, _, _), home = _points(blocks[i], dim), blocks[i].cell
        core = np.frombuffer(_get(blocks[i].core), bool)
        best = np.full(len(x), NONE)
        _, _, label, back = held(i)
        best[core] = label[back]
        other = np.flatnonzero(~core)
        open_ = _open(cells, _to_pivots(cells, x[other], home), home, own[other], np.arange(len(cells.pivots)), eps)
        for c in np.argsort(cells.apart[home], kind="stable"):
            for j in of[c] if open_[:, c].any() else ():
                y, own_, label_, _ = held(j)
                if not len(y):
                    continue
                rows = other[open_[:, c] & (best[other] > label_[0])]
                if not len(rows):
                    continue
                facing = _facing(cells, y, c, own_, home, eps)
                facing = facing[label_[facing] < best[rows].max()]
                within = NB.Within(y[facing], e2)
                for here in NB.slices(len(rows), len(facing)) if len(facing) else ():
                    near = within(x[rows[here]])
                    first = near.argmax(axis=1)  # columns are in the order of their roots
                    hit = near[np.arange(len(first)), first]
                    best[rows[here][hit]] = np.minimum(best[rows[here][hit]], label_[facing[first[hit]]])
        at, k = np.frombuffer(_get(blocks[i].members), np.int64).reshape(-1, 2).T
        root = best[at]
        yield pa.RecordBatch.from_arrays([pa.array(k[root != NONE]), pa.array(root[root != NONE])], names=["k", "root"])


def _labels(spark, cells: NB.Cells, blocks: list[Block], folder: str, eps: float, min_samples: int) -> DataFrame:
    """k, root of the rows that are in a cluster; stored."""
    from .cluster import _merged_labels
    e2 = float(eps) ** 2 + 1e-12

    def files(work, *given) -> dict[int, str]:
        found = _by_block(spark, cells, blocks, lambda c, b, of, some: work(c, b, of, some, folder, *given), "block long, path string")
        return {r["block"]: r["path"] for r in found.collect()}  # one row per block

    core = files(_core_points, eps, e2, min_samples)
    blocks = [replace(b, core=core[i]) for i, b in enumerate(blocks)]
    label = files(_block_labels, e2)
    blocks = [replace(b, label=label[i]) for i, b in enumerate(blocks)]
    roots = np.zeros((2, 0), np.int64)

    def links(most_cells: int) -> DataFrame:
        return cut_lineage(_by_block(spark, cells, blocks, lambda c, b, of, some: _links(c, b, of, some, roots, most_cells, eps, e2), "a long, b long").distinct())

    def by_driver(edges: DataFrame) -> np.ndarray | None:
        if edges.count() > EDGES:
            return None
        found = edges.toPandas()
        return np.vstack(merged(found["a"].to_numpy(np.int64), found["b"].to_numpy(np.int64)))

    first = links(NEAREST)  # most of what is one cluster is joined by near cells; the rest is then compared with little
    known = by_driver(first)
    if known is not None:
        roots = known
    edges = first.union(links(len(cells.pivots)))
    roots = by_driver(edges)
    if roots is None:
        roots = np.zeros((2, 0), np.int64)
        tops = _merged_labels(edges)

        def names(c, b, of, some):
            for i in some:
                here = np.unique(np.frombuffer(_get(b[i].label), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(here), i)), pa.array(here)], names=["block", "label"])

        def store(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("label")
            path = _put(f"{folder}/roots", np.vstack([pdf["label"].to_numpy(np.int64), pdf["root"].to_numpy(np.int64)]))
            return pd.DataFrame({"block": pdf["block"].iloc[:1], "path": [path]})

        here = _by_block(spark, cells, blocks, names, "block long, label long").join(tops, "label")
        stored = {r["block"]: r["path"] for r in here.groupBy("block").applyInPandas(store, "block long, path string").collect()}
        blocks = [replace(b, roots=stored.get(i, "")) for i, b in enumerate(blocks)]
    return cut_lineage(_by_block(spark, cells, blocks, lambda c, b, of, some: _placed(c, b, of, some, roots, eps, e2), "k long, root long"))


def clusterings(emb: DataFrame, key: str, col: str, grid: list[tuple[float, int]], n_pivots: int | None = None, block: int = NB.BLOCK_ROWS) -> list[DataFrame]:
    """``cluster.dbscan`` for every (eps, min_samples) of ``grid`` over one set of blocks."""
    spark = emb.sparkSession
    every = emb.select(F.col(key).cast("bigint").alias("k"), col)
    x = NB.points(every, "k", col)
    pivots = NB.pivots_of(x, n_pivots)
    if not len(pivots):
        return [every.select(F.col("k").alias(key), F.lit(-1).alias("cluster")) for _ in grid]
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/density/{uuid.uuid4().hex}"
    store, place = fs.FileSystem.from_uri(folder)
    store.create_dir(place, recursive=True)
    try:
        cells, blocks = packed(x, pivots, folder, block)
        found = [_labels(spark, cells, blocks, folder, eps, ms) for eps, ms in grid]
    finally:
        store.delete_dir(place)
    out = []
    for labels in found:
        ids = labels.select("root").distinct()
        ids = ids.withColumn("cluster", (F.row_number().over(W.orderBy("root")) - 1).cast("int"))  # one row per cluster
        named = labels.join(F.broadcast(ids), "root").select("k", "cluster")
        out.append(every.select("k").join(named, "k", "left").select(F.col("k").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster")))
    return out
