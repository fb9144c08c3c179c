"""Nearest neighbours by cosine with vantage-point trees, one for each shard; shards are rings around pivots."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._common import bound_batches, stage

#: Vectors of a shard, as expected, and of a leaf; queries that are searched for together.
SHARD, LEAF, BLOCK = 8192, 256, 512
#: Pivots at most: their vectors go to every worker.
PIVOTS = 4096
TOP = 5
#: Distances are compared with this much room for rounding.
EPSILON = 1e-7


class VpTree:
    """A tree over unit vectors with the chord distance (a metric that grows as the cosine falls).

    Equal vectors stand on one place with their ids in order: of them only the first ``copies`` can be among a query's
    nearest, as ties go to the smaller id, so a group of equal vectors of any size costs as much as ``copies`` vectors.
    Nodes are rows of arrays: vantage point, children and the range of distances in each child; leaves hold runs of ``order``.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: int):
        by_id = np.argsort(ids, kind="stable")
        ids, vectors = ids[by_id], vectors[by_id]
        _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
        group = group.reshape(-1)
        self.vectors = vectors[first]
        self.unit = self.vectors / norms(self.vectors)[:, None]
        by_group = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[by_group], np.arange(len(first)))
        rank = np.arange(len(ids)) - starts[group[by_group]]
        kept = by_group[rank < copies]
        self.ids = ids[kept]
        self.starts = np.searchsorted(group[kept], np.arange(len(first) + 1))
        self.order = np.arange(len(first))
        self.nodes: list[tuple] = []
        self.root = self._build(0, len(first))

    def _build(self, begin: int, end: int) -> int:
        node = len(self.nodes)
        if end - begin <= LEAF:
            self.nodes.append((begin, end, None))
            return node
        # The vantage point: of the run's ends, that whose distances vary more.
        run = self.order[begin:end]
        spread = [chords(self.unit[run], self.unit[run[k]]) for k in (0, len(run) // 2, -1)]
        k = int(np.argmax([d.std() for d in spread]))
        distances, vantage = spread[k], run[(0, len(run) // 2, -1)[k]]
        by = np.argsort(distances, kind="stable")
        self.order[begin:end] = run[by]
        half = (end - begin) // 2
        distances = distances[by]
        self.nodes.append(())
        inner, outer = self._build(begin, begin + half), self._build(begin + half, end)
        ranges = (distances[0], distances[half - 1]), (distances[half], distances[-1])
        self.nodes[node] = (begin, end, (vantage, inner, outer, ranges))
        return node

    def search(self, queries: np.ndarray, own: np.ndarray, top: int, factor: float, bounds: np.ndarray | None = None) -> Iterator[tuple[int, int, float]]:
        """For each query its best ``top`` in this tree, as (query's place, id, cosine); ``own``: the queries' ids, left out.

        A child is skipped if the triangle inequality puts all of it farther than the worst of the best so far, or than
        the query's bound, a distance within which ``top`` others are known; the gap
        counts ``factor`` times, so 1 skips nothing that could be better and more skips more. ``seen`` counts the vectors compared.
        """
        best = [[] for _ in queries]
        worst = np.full(len(queries), np.inf) if bounds is None else bounds.copy()
        self.seen = 0
        unit = queries / norms(queries)[:, None]
        stack = [(self.root, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, active, gap = stack.pop()
            live = gap * factor <= worst[active] + EPSILON
            active = active[live]
            if not len(active):
                continue
            begin, end, inside = self.nodes[node]
            if inside is None:
                self._leaf(self.order[begin:end], active, queries, unit, own, top, best, worst)
                continue
            vantage, inner, outer, ranges = inside
            d = chords(unit[active], self.unit[vantage])
            gaps = [np.maximum(np.maximum(d - high, low - d), 0) for low, high in ranges]
            near = gaps[0] <= gaps[1]
            # Each query goes to its nearer child first: what is pushed last is done first.
            for some, first, second in ((near, (inner, 0), (outer, 1)), (~near, (outer, 1), (inner, 0))):
                if some.any():
                    stack.append((second[0], active[some], gaps[second[1]][some]))
                    stack.append((first[0], active[some], gaps[first[1]][some]))
        for q, found in enumerate(best):
            for score, vec_id in found:
                yield q, vec_id, score

    def _leaf(self, run, active, queries, unit, own, top, best, worst) -> None:
        self.seen += len(run) * len(active)
        near = chords_between(unit[active], self.unit[run]) <= worst[active][:, None] + EPSILON
        for row in np.flatnonzero(near.any(axis=1)):
            q, places = active[row], run[near[row]]
            scores = cosines(self.vectors[places], queries[q])
            found = best[q]
            for place, score in zip(places, scores, strict=True):
                found += [(float(score), int(i)) for i in self.ids[self.starts[place] : self.starts[place + 1]] if i != own[q]]
            found.sort(key=lambda x: (-x[0], x[1]))
            del found[top:]
            if len(found) == top:
                worst[q] = min(worst[q], np.sqrt(max(2 - 2 * found[-1][0], 0)))


def norms(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows * rows).sum(axis=-1))


def cosines(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Cosines in double precision; sums follow the components' order, so a row's value depends on the row and the query alone."""
    total = lambda x: np.add.accumulate(x, axis=-1)[..., -1]
    return total(rows * query) / (np.sqrt(total(rows * rows)) * np.sqrt(total(query * query)))


def chords(rows: np.ndarray, one: np.ndarray) -> np.ndarray:
    return norms(rows - one)


def chords_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``v`` (array of double) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    square = F.aggregate(v, F.lit(0.0), lambda total, x: total + x * x)
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite & (square > 0) & (square < float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _units(column) -> np.ndarray:
    rows = _matrix(column)
    return rows / norms(rows)[:, None]


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """The rows with the pivot nearest to them and their distance from it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = chords_between(_units(batch.column(1)), pivots)
                near = far.argmin(axis=1)
                arrays = [*batch.columns, pa.array(near.astype(np.int32)), pa.array(far[np.arange(len(near)), near])]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "pivot", "d"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, pivot int, d double")


def _visits(asked: DataFrame, pivots: np.ndarray, low: np.ndarray, high: np.ndarray, factor: float) -> DataFrame:
    """``vec_id, v, bound, pivot``: each query beside the other pivots whose ring may hold something within its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = chords_between(_units(batch.column(1)), pivots)
                gap = np.maximum(np.maximum(d - high, low - d), 0)
                may = gap * factor <= batch.column(3).to_numpy(zero_copy_only=False)[:, None] + EPSILON
                may[np.arange(len(may)), batch.column(2).to_numpy()] = False
                arrays = [batch.column(0), batch.column(1), batch.column(3), pa.array([np.flatnonzero(x).astype(np.int32) for x in may], pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "v", "bound", "pivots"])

    found = asked.select("vec_id", "v", "pivot", "bound").mapInArrow(run, "vec_id long, v array<double>, bound double, pivots array<int>")
    return found.select("vec_id", "v", "bound", F.explode("pivots").alias("pivot"))


def _searched(index: DataFrame, asked: DataFrame, top: int, factor: float) -> DataFrame:
    """Each query's best ``top`` in each shard that it is sent to: ``query_id, vec_id, score``.

    A shard's vectors and then its queries pass through one task: a tree is built once and the queries stream by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, tree = None, [], None
        for batch in batches:
            shards, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(shards) != 0) | (np.diff(asks) != 0)) + 1
            for begin, end in zip(np.append(0, cuts), np.append(cuts, len(shards)), strict=True):
                if begin == end:
                    continue
                cut = batch.slice(begin, end - begin)
                if shards[begin] != shard:
                    shard, parts, tree = shards[begin], [], None
                ids, found = cut.column(2).to_numpy(), _matrix(cut.column(3))
                if not asks[begin]:
                    parts.append((ids.copy(), found.copy()))
                    continue
                if tree is None:
                    if not parts:
                        continue
                    tree, parts = VpTree(*map(np.concatenate, zip(*parts, strict=True)), top + 1), []
                bounds = cut.column(4).to_numpy(zero_copy_only=False)
                for k in range(0, len(ids), BLOCK):
                    some = slice(k, k + BLOCK)
                    hits = [(int(ids[some][q]), i, score) for q, i, score in tree.search(found[some], ids[some], top, factor, bounds[some])]
                    columns = list(zip(*hits, strict=True)) or [(), (), ()]
                    arrays = [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])

    rows = index.select("shard", F.lit(False).alias("asks"), "vec_id", "v", F.lit(0.0).alias("bound"))
    rows = rows.unionByName(asked.select("shard", F.lit(True).alias("asks"), "vec_id", "v", "bound"))
    return rows.repartition("shard").sortWithinPartitions("shard", "asks").mapInArrow(run, "query_id long, vec_id long, score double")


def nearest(
    vectors: DataFrame,
    every: int = 50,
    top: int = TOP,
    factor: float = 1.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard: int = SHARD,
) -> DataFrame:
    """Each query's ``top`` nearest other vectors by cosine; queries are the rows whose id is divisible by ``every``.

    Vectors go to the nearest of some pivots (one for each ``shard`` vectors, ``PIVOTS`` at most, drawn by a hash of the id); a pivot with more
    vectors than a shard takes has several, dealt by a hash, so a hot cluster is split. Each shard's tree is built once, by the one task that its
    queries stream through. First a query is searched for around its own pivot; the distance of the worst found then
    bounds it, and it goes on only to the pivots whose ring of distances the triangle inequality can't rule out: on clustered
    vectors to few, on vectors spread evenly in many dimensions to all, as an exact search must. With ``factor`` 1 the search is exact; a greater one
    rules out more, rings and branches alike.

    Defined results: vectors that are null, of another length than most, hold null or non-finite components, or whose sum of squares
    is zero or overflows take no part, nor do rows with a null id; ties go to the smaller id; of rows that repeat an id the one with the
    least vector counts; fewer candidates than ``top`` are all returned; other columns are neither read nor returned; an empty table gives an empty result.

    Returns ``query_id, rank, vec_id, score``.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("size")).count()
    size = (sizes.orderBy(F.desc("count"), "size").first() or (0,))[0]
    rows = stage(rows.where(F.size("v") == size).groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(PIVOTS, max(1, -(-n // shard)))).select("v").collect()
    pivots = np.array([r.v for r in drawn], float).reshape(len(drawn), size)
    pivots = pivots / norms(pivots)[:, None]
    placed = stage(_placed(rows, pivots), "placed")
    rings = placed.groupBy("pivot").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
    rings = stage(rings, "rings")  # a row for each pivot, so PIVOTS at most
    low, high = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in rings.collect():
        low[r.pivot], high[r.pivot] = r.low, r.high
    parts = F.broadcast(rings.select("pivot", "parts"))
    name = lambda part: F.col("pivot").cast("long") * (1 << 32) + part
    index = placed.join(parts, "pivot").withColumn("shard", name(F.pmod(F.xxhash64("vec_id"), F.col("parts"))))
    sent = lambda asked: asked.join(parts, "pivot").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("shard", name(F.col("_part")))
    asked = placed.where(F.col("vec_id") % every == 0)
    first = stage(_searched(index, sent(asked.withColumn("bound", F.lit(float("inf")))), top, factor), "hits")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    worst = ranked.where(F.col("rank") == top).select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(2 - 2 * F.col("score"), F.lit(0.0))).alias("bound"))
    bounded = asked.join(worst, "vec_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf"))))
    second = _searched(index, sent(_visits(bounded, pivots, low, high, factor)), top, factor)
    hits = ranked.select("query_id", "vec_id", "score").unionByName(second)
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
