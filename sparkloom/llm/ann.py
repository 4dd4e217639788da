"""Approximate nearest neighbours by counting collisions in single-projection sorted arrays.

Vectors are dealt into cells by a few random splits, so that near ones tend to share a cell, and cells into blocks of
bounded size. Every block is indexed once and written: for each of M random directions its vectors in order of their
projection. A query opens a window around its own projection in every array; vectors inside collide. Windows are
widened step by step (virtual rehashing), only the new rings being counted, and a vector whose collisions pass the
threshold is verified with its exact score. A query stops in a block when the windows' radius holds its k-th best.

Queries search the block they would lie in themselves first. The k-th best score found there gives the radius for
all others: a query goes on only to cells that could hold a vector with enough collisions within it, opens its windows
at that width at once, and brings back only what is no worse. A window wider than half its array is counted by what
lies outside of it. Blocks travel once for each 16,384 queries, queries once for each block they touch.

Inner products are searched as distances: scaled to the largest norm, each vector gets one more component that lifts
it to the unit sphere, where the nearest vector is the one with the largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import map_arrow, ship
from sparkloom.workspace import materialise

DIRECTIONS = 96
#: Vectors, and components of vectors, that a block holds on average at most.
BLOCK, COMPONENTS = 8192, 1 << 22
QUERY_BLOCK = 16_384
SEED = 0xC211
#: Share of the directions in which a vector must collide before it is verified.
SHARE = 0.83
#: Half widths of the windows, as multiples of the distance within which the k-th neighbour is sought.
WIDTH = 1.5
#: Those distances, closest together where unrelated vectors begin.
RADII = (0.15, 0.4, 0.65, 0.85, 1.0, 1.1, 1.2, 1.3, 1.45, 1.65)
#: The splits are the medians of a sample of this size; there are 2^SPLITS cells at most, however large the table.
SAMPLE, SPLITS = 16_384, 10


def random_directions(n: int, d: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, d]).standard_normal((n, d))


def lift(vectors: np.ndarray, scale: float) -> np.ndarray:
    x = vectors / scale
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1 - (x**2).sum(1)))[:, None]], axis=1)


def lift_queries(queries: np.ndarray) -> np.ndarray:
    return np.concatenate([queries / np.linalg.norm(queries, axis=1)[:, None], np.zeros((len(queries), 1))], axis=1)


def _project(lifted: np.ndarray, direction: np.ndarray) -> np.ndarray:
    """Row by row, so that a vector's projection does not depend on the rows beside it."""
    return (lifted * direction).sum(axis=1)


def radius_of(score: np.ndarray | float, reach: np.ndarray | float) -> np.ndarray | float:
    """On the unit sphere: how far from the query a vector of this score lies; *reach* is the largest score there could be."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * np.maximum(score, -reach) / reach))


class Cells:
    """Random splits at the medians of a sample, level by level: a cell is the path of a vector's sides."""

    def __init__(self, projections: np.ndarray, directions: np.ndarray):
        """*projections*: a row for each vector of the sample, a column for each level."""
        self.depth, self.directions = len(directions), directions
        self.medians = np.zeros(1 << self.depth)  # of the node with the heap number 1, 2, 3, ...
        node = np.ones(len(projections), np.int64)
        for level in range(self.depth):
            p = projections[:, level]
            for x in range(1 << level, 2 << level):
                here = p[node == x]
                self.medians[x] = np.median(here) if len(here) else 0.0
            node = 2 * node + (p > self.medians[node])

    def of(self, lifted: np.ndarray) -> np.ndarray:
        node = np.ones(len(lifted), np.int64)
        for level in range(self.depth):
            node = 2 * node + (_project(lifted, self.directions[level]) > self.medians[node])
        return node - (1 << self.depth)


class Bounds:
    """Between which projections the vectors of each cell lie."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cells, self.low, self.high = cells, low, high

    def touched(self, queries: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """Which cells (columns) may hold a vector that collides often enough within *radius* of each query."""
        need = int(np.ceil(SHARE * self.low.shape[1]))
        at = lift_queries(queries) @ random_directions(self.low.shape[1], queries.shape[1] + 1, SEED).T
        out = np.ones((len(queries), len(self.cells)), bool)
        for i in range(len(queries)):
            w = WIDTH * max(radius[i], RADII[0])
            out[i] = ((at[i] + w >= self.low) & (at[i] - w <= self.high)).sum(axis=1) >= need
        return out


class BlockIndex:
    """Sorted arrays of one block."""

    def __init__(self, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, sorted_: np.ndarray, order: np.ndarray, scale: float, seed: int = SEED):
        self.ids, self.times, self.vectors, self.sorted, self.order, self.scale = ids, times, vectors, sorted_, order.astype(np.intp), scale
        self.directions = random_directions(len(order), vectors.shape[1] + 1, seed)
        self.verified = 0

    @classmethod
    def build(cls, ids: np.ndarray, times: np.ndarray, vectors: np.ndarray, scale: float, directions: int = DIRECTIONS, seed: int = SEED) -> BlockIndex:
        p = (random_directions(directions, vectors.shape[1] + 1, seed) @ lift(vectors, scale).T).astype(np.float32)
        order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        return cls(ids, times, vectors, np.take_along_axis(p, order, axis=1), order, scale, seed)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> list[tuple[int, int, float, int]]:
        """The k nearest found of each query, without itself: ``(query id, id, inner product, times)``.

        *floors* are scores that k others are known to reach; what lies below them is not returned.
        """
        norms = np.linalg.norm(queries, axis=1)
        at = (self.directions @ lift_queries(queries).T).astype(np.float32)
        radii = np.where(np.isinf(floors)[:, None], RADII, np.maximum(RADII[0], radius_of(floors, self.scale * norms))[:, None])
        out = []
        for whole, some in ((True, np.flatnonzero(np.isinf(floors))), (False, np.flatnonzero(~np.isinf(floors)))):
            r = radii[some] if whole else radii[some, :1]
            w = WIDTH * r
            edge = lambda sign, side: np.stack([row.searchsorted((x[some, None] + sign * w).astype(np.float32), side) for row, x in zip(self.sorted, at, strict=True)], axis=2)  # noqa: B023, E731
            lo, hi = edge(-1, "left"), edge(1, "right")
            for j, i in enumerate(some.tolist()):
                exact = self._one(int(query_ids[i]), queries[i], norms[i], r[j], lo[j].tolist(), hi[j].tolist(), floors[i], k)
                out += [(int(query_ids[i]), *found) for found in self._best(queries[i], exact, k, 1e-12 * self.scale * norms[i], floors[i])]
        return out

    def _kth(self, scores: np.ndarray, times: np.ndarray, k: int) -> float:
        """The k-th best score, each counted *times* times; minus infinity if there are fewer."""
        if len(scores) >= k:
            at = np.argpartition(-scores, k - 1)[:k]
            scores, times = scores[at], times[at]
        order = np.argsort(-scores, kind="stable")
        enough = np.searchsorted(np.cumsum(times[order]), k)
        return float(scores[order[enough]]) if enough < len(order) else -np.inf

    def _best(self, q: np.ndarray, exact: np.ndarray, k: int, slack: float, floor: float) -> list[tuple[int, float, int]]:
        """Ids, scores and times of the k best. Sums row by row: equal vectors score equal, in whichever block they lie."""
        some = np.flatnonzero((exact >= floor - slack) & (exact > -np.inf))
        if len(some) > k:
            some = some[exact[some] >= np.partition(exact[some], -k)[-k] - slack]
        score = (self.vectors[some] * q).sum(axis=1)
        at = np.lexsort((self.ids[some], -score))[:k]
        return list(zip(self.ids[some][at].tolist(), score[at].tolist(), self.times[some][at].tolist(), strict=True))

    def _collisions(self, lo: list[int], hi: list[int]) -> np.ndarray:
        """In how many arrays each vector lies in the window; the shorter of inside and outside is counted."""
        n, order = len(self.ids), self.order
        if 2 * (sum(hi) - sum(lo)) <= order.size:
            return np.bincount(np.concatenate([r[a:b] for r, a, b in zip(order, lo, hi, strict=True)]), minlength=n)
        outside = [r[:a] for r, a in zip(order, lo, strict=True)] + [r[b:] for r, b in zip(order, hi, strict=True)]
        return len(order) - np.bincount(np.concatenate(outside), minlength=n)

    def _one(self, query_id: int, q: np.ndarray, norm: float, radii: np.ndarray, lo: list[list[int]], hi: list[list[int]], floor: float, k: int) -> np.ndarray:
        """Scores of the verified vectors, minus infinity for the others."""
        n, order = len(self.ids), self.order
        need = int(np.ceil(SHARE * len(order)))
        done, exact, kth, seen = self.ids == query_id, np.full(n, -np.inf), floor, None
        for level, radius in enumerate(radii):
            if seen is None:
                seen = self._collisions(lo[0], hi[0])
            else:
                rings = [r[a:b] for r, a, b in zip(order, lo[level], lo[level - 1], strict=True)]
                rings += [r[a:b] for r, a, b in zip(order, hi[level - 1], hi[level], strict=True)]
                seen = seen + np.bincount(np.concatenate(rings), minlength=n)
            fresh = np.flatnonzero((seen >= need) & ~done)
            if len(fresh):
                done[fresh] = True
                exact[fresh] = self.vectors[fresh] @ q
                self.verified += len(fresh)
                good = np.flatnonzero(exact >= floor)
                kth = max(kth, self._kth(exact[good], self.times[good], k))
            if radius_of(kth, self.scale * norm) <= radius:
                return exact
        rest = np.flatnonzero(~done)
        exact[rest] = self.vectors[rest] @ q
        self.verified += len(rest)
        return exact


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Vectors that take part: not null, not zero, every component a finite number."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array | pa.ChunkedArray, d: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(values.flatten(), dtype=np.float64).reshape(len(column), d)


def _by_length(b: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    d = b.column("d").to_numpy()
    for x in np.unique(d).tolist():
        yield x, b.take(pa.array(np.flatnonzero(d == x)))


def _fit_cells(data: DataFrame, n: int, scale: float, block: int) -> tuple[int, Cells | None]:
    """Splits for the commonest length in the sample; vectors of other lengths share one cell for each length."""
    some = data.select("d", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE)
    d = some.groupBy("d").count().orderBy(F.desc("count"), "d").first()[0]
    depth = min(SPLITS, int(np.ceil(np.log2(max(1, n / block)))))
    if not depth:
        return d, None
    directions = random_directions(depth, d + 1, SEED + 1)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = lift(_matrix(b.column(0), d), scale)
                yield pa.RecordBatch.from_arrays([pa.array(np.stack([_project(x, y) for y in directions], axis=1).tolist(), pa.list_(pa.float64()))], names=["p"])

    rows = map_arrow(some.filter(F.col("d") == d).select("v"), project, "p array<double>").collect()  # SAMPLE x SPLITS numbers at most
    return d, Cells(np.array([r[0] for r in rows]), directions)


def _bounds(indexes: DataFrame, d: int) -> Bounds:
    """Collects 2^SPLITS x DIRECTIONS pairs of numbers at most, however many blocks there are."""
    at = indexes.filter(F.col("d") == d).select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("m", "e"))
    rows = at.groupBy("cell", "m").agg(F.min("e.low"), F.max("e.high")).collect()
    cells = np.array(sorted({r[0] for r in rows}))
    low, high = np.zeros((len(cells), DIRECTIONS)), np.zeros((len(cells), DIRECTIONS))
    for cell, m, lo, hi in rows:
        i = np.searchsorted(cells, cell)
        low[i, m], high[i, m] = lo, hi
    return Bounds(cells, low, high)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, every: int = 20, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every vector whose id is divisible by *every*, its k nearest others.

    Nearness is the inner product in double precision, ties go to the smaller id. Vectors that are null, zero, hold a
    null or a non-finite component, or differ in length from the query's, take no part. Rows that repeat an id are
    candidates each, except for the query of that id, which is asked with its first vector in order. Rows that repeat
    id and vector are held once, with their number. Fewer candidates than k are all returned; an empty table gives an
    empty result. The result does not depend on the order or partitions of the rows.
    """
    data = usable(vectors, id_col, vector_col).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    data = materialise(data.withColumn("d", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    n, scale = data.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not n:
        return data.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    main, cells = _fit_cells(data, n, scale, block)
    ship(data.sparkSession)

    def place(batches: Iterator[pa.RecordBatch], lifted) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x in _by_length(b):
                at = cells.of(lifted(_matrix(x.column("v"), d))) if cells and d == main else np.zeros(x.num_rows)
                yield x.append_column("cell", pa.array(at.astype(np.int32)))

    placed = map_arrow(data, lambda bs: place(bs, lambda v: lift(v, scale)), "vec_id long, v array<double>, times long, d int, cell int")
    parts = F.ceil(F.count(F.lit(1)) / F.least(F.lit(block), F.greatest(F.lit(1), F.lit(COMPONENTS) / F.col("d")))).cast("int")
    # A row for each cell: 2^SPLITS at most, and one for each further length of vectors.
    sizes = materialise(placed.groupBy("d", "cell").agg(parts.alias("parts")), "cells")

    def build(t: pa.Table) -> pa.Table:
        d = t.column("d")[0].as_py()
        v, ids, times = _matrix(t.column("v"), d), t.column("vec_id").to_numpy(), t.column("times").to_numpy()
        at = np.lexsort((*v.T[::-1], ids))
        x = BlockIndex.build(ids[at], times[at], v[at], scale)
        keys = {c: t.column(c).slice(0, 1).cast(pa.int32()) for c in ("d", "cell", "part")}
        blobs = {c: pa.array([a.tobytes()], pa.binary()) for c, a in (("ids", x.ids), ("times", x.times), ("vectors", x.vectors), ("sorted", x.sorted), ("places", x.order.astype(np.int32)))}
        return pa.table(keys | blobs | {"low": pa.array([x.sorted[:, 0].tolist()], pa.list_(pa.float32())), "high": pa.array([x.sorted[:, -1].tolist()], pa.list_(pa.float32()))})

    dealt = placed.join(sizes, ["d", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int"))
    index_schema = "d int, cell int, part int, ids binary, times binary, vectors binary, sorted binary, places binary, low array<float>, high array<float>"
    indexes = materialise(dealt.groupBy("d", "cell", "part").applyInArrow(build, index_schema), "indexes")

    asked = data.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("d", F.size("v"))
    asked = map_arrow(asked, lambda bs: place(bs, lift_queries), "vec_id long, v array<double>, d int, cell int").join(sizes, ["d", "cell"], "left")
    asked = materialise(asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")), "queries")
    groups = max(1, -(-asked.count() // query_block))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple[int, int, float, int]] = []
        if left.num_rows and right.num_rows:
            (r,) = left.to_pylist()
            ids = np.frombuffer(r["ids"], np.int64)
            arrays = (np.frombuffer(r[c], t).reshape(-1, len(ids)) for c, t in (("sorted", np.float32), ("places", np.int32)))
            x = BlockIndex(ids, np.frombuffer(r["times"], np.int64), np.frombuffer(r["vectors"]).reshape(-1, r["d"]), *arrays, scale)
            at = np.argsort(right.column("vec_id").to_numpy())
            found = x.search(right.column("vec_id").to_numpy()[at], _matrix(right.column("v"), r["d"])[at], right.column("floor").to_numpy()[at], k)
        q, i, s, times = zip(*found, strict=True) if found else ((), (), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.float64()), "times": pa.array(times, pa.int64())})

    def found(queries: DataFrame) -> DataFrame:
        """What the blocks give for queries of ``d, cell, part, vec_id, v, floor``."""
        keys = ["d", "cell", "part", "g"]
        each = indexes.drop("low", "high").withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        grouped = queries.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
        return each.groupBy(*keys).cogroup(grouped.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double, times long")

    def best(results: DataFrame) -> DataFrame:
        """The k best of each query, and how many come before each row."""
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = results.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= k)
        before = F.coalesce(F.sum("times").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return ranked.withColumn("before", before).filter(F.col("before") < k)

    nothing = F.lit(float("-inf"))
    at_home = materialise(found(asked.filter("parts IS NOT NULL").select("d", "cell", "part", "vec_id", "v", nothing.alias("floor"))), "home")
    kth = best(at_home).filter(F.col("before") + F.col("times") >= k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    bounds = _bounds(indexes, main)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, whole in _by_length(b):
                step = max(1, COMPONENTS // (d * len(bounds.cells)))
                for x in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                    v = _matrix(x.column("v"), d)
                    reach = scale * np.linalg.norm(v, axis=1)
                    radius = np.where(np.isinf(x.column("floor").to_numpy()), np.inf, radius_of(x.column("floor").to_numpy(), reach))
                    q, c = np.nonzero(bounds.touched(v, radius)) if d == main else (np.arange(len(v)), None)
                    cell = np.zeros(len(v)) if c is None else bounds.cells[c]
                    yield x.take(pa.array(q)).append_column("cell", pa.array(cell.astype(np.int32)))

    rest = asked.join(kth, "vec_id", "left").select("d", "vec_id", "v", F.coalesce("floor", nothing).alias("floor"), F.col("cell").alias("own"), F.col("part").alias("own_part"))
    rest = map_arrow(rest, visit, "d int, vec_id long, v array<double>, floor double, own int, own_part int, cell int").join(sizes, ["d", "cell"])
    rest = rest.withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).filter("NOT (cell <=> own AND part <=> own_part)")
    nearest_of = best(at_home.unionByName(found(rest.select("d", "cell", "part", "vec_id", "v", "floor"))))
    ranks = F.explode(F.expr(f"sequence(CAST(before + 1 AS INT), CAST(least(before + times, {k}) AS INT))"))
    return nearest_of.select("query_id", ranks.alias("rank"), "vec_id", "score")
