"""Exact distance joins over cells of nearest pivots (the k nearest rows, all rows within a radius).

A bounded sample of rows are the pivots; every row belongs to the cell of its nearest pivot, and each cell knows its
number of rows and the nearest and farthest of them.  The triangle inequality and the plane between two pivots give
a lower bound of the distance from a point to any row of a cell, so a point is compared only with the cells that
the bound cannot rule out:

* ``knn_join``: a first pass looks in the cells next to the query until they hold k rows; the k-th distance found
  there is the radius within which the second pass visits all other cells.
* ``within_join``: a point visits every cell that may hold a row within the radius.

Neighbouring cells are joined to groups of at most about ``BLOCK_ROWS`` rows (more where there are many rows), so that a
point is sent once for all of a group's cells.  Rows and visitors of a group are dealt by hash to blocks, and every pair of
blocks is a group of its own, so neither a dense cell nor many copies of one point make a large one.  The driver holds the
pivots and one row of numbers per cell, both at most ``MAX_PIVOTS`` long.

Distances in a block are one matrix product with a bound on its rounding; wherever the bound leaves a choice open the exact
differences decide, so results are those of the plain sum of squares.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from ..session import cut_lineage, ship_package

MAX_PIVOTS = 512
BLOCK_ROWS = 4096
MAX_BLOCK = 16_384
SLICE = 256
PAIRS = 1 << 18  # pairs of a block whose distances are held at once
SLACK = 1e-9  # relative and absolute room for rounding in the bounds


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by exact differences: equal rows are at 0."""
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += (a[:, j, None] - b[None, :, j]) ** 2
    return out


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``squared`` of the rows of ``a`` and ``b`` that stand side by side."""
    out = np.zeros(len(a))
    for j in range(a.shape[1]):
        out += (a[:, j] - b[:, j]) ** 2
    return out


class Within:
    """``squared(a, b) <= limit`` for many ``a``; what the products need of ``b`` is worked out once."""

    def __init__(self, b: np.ndarray, limit: float):
        self.b, self.limit, self.ready = b, limit, {}

    def _right(self, kind: type) -> tuple:
        if kind not in self.ready:
            b = self.b
            with np.errstate(invalid="ignore", over="ignore"):
                middle = b.mean(axis=0) if len(b) else 0.0
                y = b - middle
                ny = (y * y).sum(axis=1)
                right = np.column_stack([y, np.ones(len(y)), ny]).astype(kind).T
                self.ready[kind] = middle, right, ny.max(initial=0.0), (b * b).sum(axis=1).max(initial=0.0)
        return self.ready[kind]

    def products(self, a: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances by a matrix product, and per row of ``a`` a bound on their difference from ``squared``."""
        middle, right, most, size_b = self._right(kind)
        with np.errstate(invalid="ignore", over="ignore"):
            x = a - middle
            nx = (x * x).sum(axis=1)
            d = np.column_stack([-2 * x, nx, np.ones(len(x))]).astype(kind) @ right
            size = (a * a).sum(axis=1) + size_b  # what the shift rounds
            room = (nx + most) * (8 * (a.shape[1] + 6) * np.finfo(kind).eps) + size * (64 * np.finfo(float).eps) + 1e-30
        return d, room

    def __call__(self, a: np.ndarray) -> np.ndarray:
        for kind in (np.float32, np.float64):
            d, room = self.products(a, kind)
            if not (np.isfinite(room).all() and np.isfinite(d).all()):
                continue
            near = d <= (self.limit - room)[:, None]
            maybe = d <= (self.limit + room)[:, None]
            unsure = np.count_nonzero(maybe) - np.count_nonzero(near)
            if unsure <= d.size // 64 or kind is np.float64:
                i, j = np.nonzero(maybe & ~near) if unsure else ((), ())
                for at in range(0, len(i), PAIRS):
                    here = slice(at, at + PAIRS)
                    near[i[here], j[here]] = paired(a[i[here]], self.b[j[here]]) <= self.limit
                return near
        return squared(a, self.b) <= self.limit


def products(a: np.ndarray, b: np.ndarray, kind: type = np.float32) -> tuple[np.ndarray, np.ndarray]:
    """``Within.products`` of one ``a``."""
    return Within(b, 0.0).products(a, kind)


def decided(a: np.ndarray, b: np.ndarray, limit: float) -> np.ndarray:
    """``squared(a, b) <= limit``."""
    return Within(b, limit)(a)


def slices(n: int, m: int) -> list[slice]:
    """Slices of ``n`` rows whose pairs with ``m`` others are held at once."""
    step = max(16, PAIRS // max(m, 1))
    return [slice(low, low + step) for low in range(0, n, step)]


@dataclass
class Cells:
    """Pivots with the number of rows of each cell and their distances to the pivot; ``group`` numbers the groups of cells."""

    pivots: np.ndarray
    rows: np.ndarray
    near: np.ndarray
    far: np.ndarray
    group: np.ndarray

    @cached_property
    def apart(self) -> np.ndarray:
        return np.sqrt(squared(self.pivots, self.pivots))

    @property
    def held(self) -> np.ndarray:
        """Rows of each group."""
        return np.bincount(self.group, self.rows).astype(np.int64)

    def grouped(self, mask: np.ndarray) -> np.ndarray:
        """Mask of the groups that hold a cell of ``mask``."""
        order = np.argsort(self.group, kind="stable")
        return np.logical_or.reduceat(mask[:, order], np.searchsorted(self.group[order], np.arange(self.group.max() + 1)), axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(squared(x, self.pivots))

    def lower_bounds(self, d: np.ndarray) -> np.ndarray:
        """For points with the distances ``d`` to the pivots, a bound below the distance to any row of each cell;
        infinite for an empty cell."""
        home = d.argmin(axis=1)
        return self.bounds(d, home, d[np.arange(len(d)), home], np.arange(len(self.pivots)))

    def bounds(self, d: np.ndarray, home: np.ndarray, own: np.ndarray, some: np.ndarray) -> np.ndarray:
        """The bounds for ``some`` cells, to whose pivots the distances are ``d``; ``home`` is the nearest pivot of all, ``own`` its distance."""
        ball = np.maximum(d - self.far[some], self.near[some] - d)
        apart = self.apart[home[:, None], some[None, :]]
        plane = np.divide(d ** 2 - own[:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
        bound = np.maximum(np.maximum(ball, plane), 0.0)
        bound = bound - SLACK * (1 + d)
        bound[:, self.rows[some] == 0] = np.inf
        return bound

    def parts(self, some: pd.DataFrame, who: pd.DataFrame, reach: np.ndarray):
        """Pairs of index arrays: the rows of a cell in ``some`` and the rows of ``who`` that it may hold rows within ``reach`` of."""
        x, home, own, at = matrix(who["x"]), who["home"].to_numpy(), who["own"].to_numpy(), some["home"].to_numpy()
        here, first = np.unique(at, return_inverse=True)
        open_ = self.bounds(np.sqrt(squared(x, self.pivots[here])), home, own, here) <= reach[:, None]
        for c in range(len(here)):
            rows, visitors = np.flatnonzero(first == c), np.flatnonzero(open_[:, c])
            if len(visitors):
                yield rows, visitors

    def first_visits(self, d: np.ndarray, k: int) -> np.ndarray:
        """Mask of the nearest cells that together hold ``k`` rows."""
        order = np.argsort(np.where(self.rows > 0, d, np.inf), axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        take = (held - self.rows[order] < k) & (self.rows[order] > 0)
        out = np.zeros(d.shape, bool)
        np.put_along_axis(out, order, take, axis=1)
        return out


def matrix(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy()).astype(float)


def points(df: DataFrame, key: str, col: str, *carry: str) -> DataFrame:
    """k, x and carried columns of the rows that have a whole vector."""
    x = F.transform(col, lambda v: v.cast("double"))
    out = df.select(F.col(key).alias("k"), x.alias("x"), *carry)
    return out.where(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))


def pivots_of(rows: DataFrame, n_pivots: int | None = None) -> np.ndarray:
    """Distinct vectors of a sample by hash: the root of the number of rows, at most ``MAX_PIVOTS``."""
    if n_pivots is None:
        n_pivots = math.isqrt(rows.count())
    n_pivots = max(1, min(MAX_PIVOTS, n_pivots))
    found = rows.orderBy(F.xxhash64("k"), "k").select("x").limit(n_pivots).collect()
    return np.unique(np.array([r["x"] for r in found], float), axis=0) if found else np.zeros((0, 0))


def groups_of(pivots: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """The group of each cell: pivots are halved along their widest dimension until a part holds at most ``block`` rows."""
    group, parts, n = np.zeros(len(pivots), np.int64), [np.arange(len(pivots))], 0
    while parts:
        some = parts.pop()
        if len(some) == 1 or rows[some].sum() <= block:
            group[some] = n
            n += 1
            continue
        x = pivots[some]
        order = some[np.argsort(x[:, (x.max(axis=0) - x.min(axis=0)).argmax()], kind="stable")]
        held = np.cumsum(rows[order])
        at = min(max(1, int(np.searchsorted(held, held[-1] / 2))), len(order) - 1)
        parts += [order[at:], order[:at]]
    return group


def in_cells(rows: DataFrame, pivots: np.ndarray, block: int | None = None) -> tuple[DataFrame, Cells]:
    """``rows`` with their cell, stored, and the cells' numbers.  With ``block``, cells are joined to groups of about that many
    rows (``MAX_BLOCK`` at most where there are many rows) and the column ``cell`` names the group."""
    ship_package(rows.sparkSession)
    sent = rows.sparkSession.sparkContext.broadcast(pivots)

    def assign(it):
        for p in it:
            if len(p):
                x = matrix(p["x"])
                at, away = [], []
                for low in range(0, len(x), SLICE * 4):
                    d = squared(x[low:low + SLICE * 4], sent.value)
                    at.append(d.argmin(axis=1))
                    away.append(np.sqrt(d.min(axis=1)))
                yield p.assign(cell=np.concatenate(at).astype("int32"), away=np.concatenate(away))

    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("away", DoubleType())])
    stored = cut_lineage(rows.mapInPandas(assign, schema))
    n = len(pivots)
    cells = Cells(pivots, np.zeros(n, np.int64), np.zeros(n), np.zeros(n), np.arange(n))
    for r in stored.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("near"), F.max("away").alias("far")).collect():
        cells.rows[r["cell"]], cells.near[r["cell"]], cells.far[r["cell"]] = r["n"], r["near"], r["far"]
    if block is not None:
        cells.group = groups_of(pivots, cells.rows, _block_of(cells, block))
    stored = stored.withColumnsRenamed({"cell": "home", "away": "own"}).withColumn("cell", F.col("home") if block is None else _number(cells.group, "home").cast("int"))
    return stored, cells


def _block_of(cells: Cells, block: int) -> int:
    """Rows of a block: the more rows there are the more a block holds, as each is sent once per block."""
    return max(block, min(MAX_BLOCK, int(cells.rows.sum()) // 64)) if block >= BLOCK_ROWS else block


def visits(who: DataFrame, cells: Cells, choose) -> DataFrame:
    """A row of ``who`` (with k and x) for each cell or group that ``choose(cells, distances, rows)`` names; stored."""
    sent = who.sparkSession.sparkContext.broadcast(cells)

    def run(it):
        for p in it:
            for low in range(0, len(p), SLICE * 4):
                some = p.iloc[low:low + SLICE * 4]
                d = sent.value.distances(matrix(some["x"]))
                row, cell = np.nonzero(choose(sent.value, d, some))
                if len(row):
                    yield some.iloc[row].assign(home=d.argmin(axis=1)[row].astype("int32"), own=d.min(axis=1)[row], cell=cell.astype("int32"))

    added = [StructField("home", IntegerType()), StructField("own", DoubleType()), StructField("cell", IntegerType())]
    return cut_lineage(who.mapInPandas(run, StructType([*[f for f in who.schema.fields if f.name not in ("home", "own", "cell")], *added])))


def _number(values: np.ndarray, column: str = "cell") -> Column:
    """A number per cell as an expression of the column that names it."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), F.col(column) + 1)


def by_blocks(rows: DataFrame, visitors: DataFrame, cells: Cells, kernel, schema: str, block: int = BLOCK_ROWS) -> DataFrame:
    """``kernel(rows, visitors)`` on every pair of blocks of a cell; both have a column ``cell``."""
    block, counts = _block_of(cells, block), np.zeros(len(cells.held), np.int64)
    for r in visitors.groupBy("cell").count().collect():  # one row per cell
        counts[r["cell"]] = r["count"]
    n_rows, n_visitors = (_number(np.maximum(1, -(-c // block))) for c in (cells.held, counts))
    left = (rows.withColumn("rb", F.pmod(F.xxhash64("k"), n_rows).cast("int"))
            .withColumn("vb", F.explode(F.sequence(F.lit(0), n_visitors - 1))))
    right = (visitors.withColumn("vb", F.pmod(F.xxhash64("k"), n_visitors).cast("int"))
             .withColumn("rb", F.explode(F.sequence(F.lit(0), n_rows - 1))))
    names = ["cell", "rb", "vb"]
    return left.groupBy(*names).cogroup(right.groupBy(*names)).applyInPandas(kernel, schema)


def first_k(rows: np.ndarray, cols: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k smallest finite values per row; of equal values the first columns."""
    real = np.isfinite(d)
    rows, cols, d = rows[real], cols[real], d[real]
    order = np.lexsort((cols, d, rows))
    rows, cols, d = rows[order], cols[order], d[order]
    first = np.searchsorted(rows, rows)  # where each row's values begin
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep], d[keep]


def knn_join(queries: DataFrame, reference: DataFrame, qkey: str, rkey: str, col: str, k: int, exclude_self: bool = False,
             carry: list[str] = (), n_pivots: int | None = None, block: int = BLOCK_ROWS) -> DataFrame:
    """The k nearest reference rows of every query (ties by reference key): qkey, ref_key, distance, rank and ``carry``.

    Rows without a whole vector take no part; a query gets fewer rows where the reference has fewer.  A query's key
    names it (queries of one key share their k rows); with ``exclude_self`` it passes over the rows of its own key."""
    from .ranks import top_k
    q, r = points(queries, qkey, col), points(reference, rkey, col, *carry)
    types = dict(r.dtypes)
    qtype = dict(q.dtypes)["k"]
    schema = f"__q {qtype}, ref_key {types['k']}, distance double" + "".join(f", {c} {types[c]}" for c in carry)
    pivots = pivots_of(r, n_pivots)
    if not len(pivots):  # no reference row: no neighbours, with the usual columns
        none = r.select(F.col("k").alias("ref_key"), F.lit(0.0).alias("distance"), *carry).where(F.lit(False))
        return none.select(F.lit(None).cast(qtype).alias(qkey), "*", F.lit(0).alias("rank"))
    rows, cells = in_cells(r, pivots, block)
    need = k + 1 if exclude_self else k
    names = list(carry)
    sent = r.sparkSession.sparkContext.broadcast(cells)

    def kernel(some: pd.DataFrame, who: pd.DataFrame) -> pd.DataFrame:
        if not len(some) or not len(who):
            return pd.DataFrame({c: [] for c in ["__q", "ref_key", "distance", *names]})
        some = some.sort_values("k", ignore_index=True)  # equal distances then stand in key order
        R, keys, Q, who_keys = matrix(some["x"]), some["k"].to_numpy(), matrix(who["x"]), who["k"].to_numpy()
        reach = who["reach"].to_numpy() if "reach" in who else np.full(len(Q), np.inf)
        out = []
        for rows_, visitors in sent.value.parts(some, who, reach):
            for here in slices(len(visitors), len(rows_)):
                v = visitors[here]
                d, room = products(Q[v], R[rows_])
                if exclude_self:
                    d[who_keys[v, None] == keys[None, rows_]] = np.inf
                limit = reach[v] ** 2 * (1 + 1e-12)
                open_ = np.flatnonzero(~np.isfinite(limit))  # no radius is known
                if len(open_) and len(rows_) > k:
                    limit[open_] = np.partition(d[open_], k - 1, axis=1)[:, k - 1] + room[open_]
                limit += room
                limit[np.isnan(limit)] = np.inf
                a, b = np.nonzero(~(d > limit[:, None]))  # also where the product gave no number
                exact = paired(Q[v[a]], R[rows_[b]])
                if exclude_self:
                    exact[who_keys[v[a]] == keys[rows_[b]]] = np.inf
                a, b, exact = first_k(a, b, exact, k)
                out.append((who_keys[v[a]], rows_[b], np.sqrt(exact)))
        if not out:
            return pd.DataFrame({c: [] for c in ["__q", "ref_key", "distance", *names]})
        q_, r_, d_ = (np.concatenate([o[i] for o in out]) for i in range(3))
        out = [pd.DataFrame({"__q": q_, "ref_key": keys[r_], "distance": d_} | {c: some[c].to_numpy()[r_] for c in names})]
        return pd.concat(out, ignore_index=True)

    order = [F.col("distance"), F.col("ref_key")]
    first = visits(q, cells, lambda c, d, p: c.grouped(c.first_visits(d, need)))
    near = cut_lineage(top_k(by_blocks(rows, first, cells, kernel, schema, block), ["__q"], order, k))
    radius = near.groupBy("__q").agg(F.max("distance").alias("radius"), F.count(F.lit(1)).alias("found"))
    reach = F.when(F.col("found") >= k, F.col("radius")).otherwise(F.lit(float("inf")))
    more = visits(q.join(radius.select(F.col("__q").alias("k"), reach.alias("reach")), "k", "left").fillna(float("inf"), ["reach"]), cells,
                  lambda c, d, p: c.grouped((c.lower_bounds(d) <= p["reach"].to_numpy()[:, None]) & (c.rows > 0)) & ~c.grouped(c.first_visits(d, need)))
    both = near.drop("rank").unionByName(by_blocks(rows, more, cells, kernel, schema, block))
    return top_k(both, ["__q"], order, k).withColumnRenamed("__q", qkey)


def within_visits(rows: DataFrame, cells: Cells, radius: float) -> DataFrame:
    """Every row once in each cell that may hold a row within ``radius``."""
    return visits(rows, cells, lambda c, d, p: c.grouped(c.lower_bounds(d) <= radius))


def compared_pairs(rows: DataFrame, visitors: DataFrame) -> int:
    """Pairs that the blocks of all cells compare."""
    both = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("a")).join(visitors.groupBy("cell").agg(F.count(F.lit(1)).alias("b")), "cell")
    return both.agg(F.sum(F.col("a") * F.col("b"))).first()[0] or 0
