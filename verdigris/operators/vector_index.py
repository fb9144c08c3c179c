"""A stored vector index: lists around coarse centroids, product-quantised residuals, exact re-ranking of what is read."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.operators.lexical_index import input_version
from verdigris.operators.ranking import cosine
from verdigris.session import shared_dir, staged

#: Vectors that centroids and codebooks are fitted on, as expected; all vectors are indexed.
SAMPLE = 20_000
#: Lists: about the square root of the number of vectors, so many at most. Vectors of the sample for each list at least.
MOST_LISTS, FOR_EACH = 1024, 16
#: Dimensions that share a code byte, and codes.
TOGETHER, CODES = 4, 256
ROUNDS = 12
#: Stored vectors that ask after the build, and the share of their true neighbours that each step may not lose.
ASKING, NEIGHBOURS, TARGET = 128, 10, 0.98


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, in blocks."""
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([np.zeros(0, np.int64), *[(x[i : i + 4096] @ centroids.T - half).argmax(axis=1) for i in range(0, len(x), 4096)]])


def fitted_centroids(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k-means by Lloyd's rounds; a centroid without rows moves to the row that is worst placed."""
    draw = np.random.Generator(np.random.PCG64(seed))
    centroids = x[draw.permutation(len(x))[:k]].astype(np.float32)
    for _ in range(ROUNDS):
        at = nearest_centroid(x, centroids)
        counts = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids, dtype=np.float64)
        np.add.at(sums, at, x)
        centroids = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centroids).astype(np.float32)
        if (empty := np.flatnonzero(counts == 0)).size:
            far = np.argsort(-((x - centroids[at]) ** 2).sum(axis=1))[: len(empty)]
            centroids[empty[: len(far)]] = x[far]
    return centroids


@dataclass(frozen=True)
class Quantizer:
    """``centroids`` (lists, dimensions); ``codebooks`` (parts, codes, dimensions of a part), zero-padded at the end."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, lists: int) -> Quantizer:
        centroids = fitted_centroids(x, lists, 1)
        rest = cls._parts(x - centroids[nearest_centroid(x, centroids)])
        return cls(centroids, np.stack([fitted_centroids(part, min(CODES, len(part)), 2 + i) for i, part in enumerate(rest.transpose(1, 0, 2))]))

    @staticmethod
    def _parts(x: np.ndarray) -> np.ndarray:
        padded = np.pad(x, ((0, 0), (0, -x.shape[1] % TOGETHER)))
        return padded.reshape(len(x), -1, TOGETHER).astype(np.float32)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The list of each unit vector and the codes of what is left of it there."""
        at = nearest_centroid(x, self.centroids)
        parts = self._parts(x - self.centroids[at])
        return at, np.stack([nearest_centroid(parts[:, i], book) for i, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)

    def order(self, query: np.ndarray) -> np.ndarray:
        """The lists, nearest to a query first."""
        return np.argsort(-(self.centroids @ query - (self.centroids**2).sum(axis=1) / 2), kind="stable")

    def scorer(self, query: np.ndarray):
        """``(lists, codes) -> `` the inner products that the codes stand for: a table lookup for each part."""
        table = np.einsum("pcd,pd->pc", self.codebooks, self._parts(query[None])[0])
        coarse, part = self.centroids @ query, np.arange(len(table))
        return lambda lists, codes: coarse[lists] + table[part, codes].sum(axis=1)


def usable(column: str):
    """Whether a vector takes part: no null, every component a finite number, not zero."""
    x = F.col(column)
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return x.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _best(held: pa.Table | None, found: pa.Table, by: str, most: int) -> pa.Table:
    whole = found if held is None else pa.concat_tables([held, found])
    return whole.sort_by([(by, "descending"), ("id", "ascending")]).slice(0, most)


class VectorIndex:
    """An index in a folder.

    ``rows`` (``id, generation, codes, vector``) is partitioned by ``list``: a search reads the folders of the lists that it probes, first
    their codes alone, then the vectors of the best. New rows are appended to their lists; ids that were deleted are kept in ``dead`` with
    the generation from which on they may come again. Vectors that are null, zero or not finite throughout aren't indexed.
    All vectors have one width; an index that was built of none is built again when there are some.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self._kind = spark, path.rstrip("/"), ""

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    @property
    def built(self) -> bool:
        return self._exists("settings/_SUCCESS")

    def settings(self):
        """The fitted quantizer with the numbers of lists and of rows that a search reads."""
        row = self.spark.read.parquet(f"{self.path}/settings").first()
        array = lambda x, *shape: np.frombuffer(bytes(x), np.float32).reshape(*shape)
        return Quantizer(array(row.centroids, -1, row.width), array(row.codebooks, row.parts, -1, TOGETHER)), row.probes, row.shortlist

    def build(self, rows: DataFrame, id_col: str, vector_col: str, lists: int | None = None) -> None:
        """Fit on a sample of about ``SAMPLE`` vectors, index every vector, then measure what a search must read to keep 98 % of the true
        neighbours at each of its two steps. Settings are written last: an index that was broken off is built anew."""
        given = rows.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        self._kind = given.schema["id"].dataType.simpleString()
        n = given.count()
        share = F.lit(min(1.0, SAMPLE / max(n, 1)))
        draw = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)
        sample = given.where(draw < share).select("vector").toArrow().column(0).combine_chunks()  # bounded by SAMPLE as expected
        x = unit_rows(_matrix(sample)) if len(sample) else np.ones((1, TOGETHER)) / 2
        lists = lists or max(1, min(MOST_LISTS, round(n**0.5), len(x) // FOR_EACH or 1))
        quantizer = Quantizer.fit(x, lists)
        self._append(given, quantizer, 0, "overwrite")
        probes, shortlist = self._measured(quantizer, n)
        one = (quantizer.centroids.shape[1], len(quantizer.codebooks), bytearray(quantizer.centroids.tobytes()), bytearray(quantizer.codebooks.tobytes()), probes, shortlist, self._kind)
        self.spark.createDataFrame([one], "width int, parts int, centroids binary, codebooks binary, probes int, shortlist int, kind string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/settings")

    def _append(self, given: DataFrame, quantizer: Quantizer, generation: int, mode: str = "append") -> None:
        shared = self.spark.sparkContext.broadcast(quantizer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    at, codes = shared.value.encode(unit_rows(_matrix(batch.column(1))))
                    packed = pa.array([row.tobytes() for row in codes], pa.binary())
                    arrays = [pa.array(at.astype(np.int32)), batch.column(0), pa.array(np.full(len(at), generation)), packed, batch.column(1)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["list", "id", "generation", "codes", "vector"])

        coded = given.mapInArrow(run, f"list int, id {self._id_type()}, generation long, codes binary, vector array<float>")
        # A list that holds a large share of all vectors is split over as many partitions as it fills.
        coded.repartitionByRange("list", "id").write.mode(mode).partitionBy("list").parquet(f"{self.path}/rows")

    def _id_type(self) -> str:
        self._kind = self._kind or self.spark.read.parquet(f"{self.path}/settings").first().kind
        return self._kind

    def living(self) -> DataFrame:
        """The rows of ids that weren't deleted since they came."""
        rows = self.spark.read.schema(f"id {self._id_type()}, generation long, codes binary, vector array<float>, list int").parquet(f"{self.path}/rows")
        if not self._exists("dead"):
            return rows
        dead = self.spark.read.parquet(f"{self.path}/dead").groupBy(F.col("id").alias("_id")).agg(F.max("generation").alias("_dies"))
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("generation") < F.col("_dies")), "left_anti")

    def _generation(self) -> int:
        return self.spark.read.parquet(f"{self.path}/dead").agg(F.max("generation")).first()[0] or 0 if self._exists("dead") else 0

    def insert(self, rows: DataFrame, id_col: str, vector_col: str) -> None:
        """Append the vectors of ids that aren't in the index to the lists of their nearest centroids; nothing else is written."""
        given = rows.where(usable(vector_col)).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
        new = given.join(self.living().select("id"), "id", "left_anti")
        self._append(staged(new, "new-vectors"), self.settings()[0], self._generation())

    def delete(self, ids: DataFrame) -> None:
        """Forget ids (column ``id``): searches leave them out until they are inserted again."""
        ids.select("id").distinct().withColumn("generation", F.lit(self._generation() + 1).cast("long")).write.mode("append").parquet(f"{self.path}/dead")

    def search(self, queries: dict[str, list[float]], k: int, exact: bool = False, probes: int | None = None, shortlist: int | None = None) -> DataFrame:
        """``q, id, score, rank``: the ``k`` nearest to each of some queries by cosine, ties by id.

        The codes of each query's nearest lists give a shortlist, whose vectors are then compared in full. ``exact`` reads all vectors.
        """
        asked = {q: np.asarray(v, np.float64) for q, v in queries.items()}
        quantizer, usual_probes, usual_short = self.settings()
        if exact or any(len(v) != quantizer.centroids.shape[1] for v in asked.values()):  # an index of no vectors has no width
            return self._exact(asked, k)
        probes, shortlist = probes or usual_probes, max(k, shortlist or usual_short)
        lists = {q: quantizer.order(v / np.linalg.norm(v))[:probes] for q, v in asked.items()}
        some = sorted({int(x) for found in lists.values() for x in found})
        rows = self.living().where(F.col("list").isin(some))
        near = self._shortlisted(rows, quantizer, asked, lists, shortlist)
        order = Window.partitionBy("q").orderBy(F.desc("near"), "id")
        short = near.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shortlist).select("q", "id", F.col("list").alias("_list"))
        # At most ``shortlist`` rows for each query are broadcast; the second read takes vectors of probed lists alone.
        met = rows.select("id", "list", "vector").join(F.broadcast(short.withColumnRenamed("id", "_id")), (F.col("id") == F.col("_id")) & (F.col("list") == F.col("_list")))
        table = self.spark.createDataFrame([(q, [float(x) for x in v]) for q, v in asked.items()], "q string, asked array<double>")
        scored = met.join(F.broadcast(table), "q").select("q", "id", F.round(cosine(F.col("vector"), F.col("asked")), 6).alias("score"))
        return self._ranked(scored, k)

    @staticmethod
    def _ranked(scored: DataFrame, k: int) -> DataFrame:
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def _exact(self, asked: dict[str, np.ndarray], k: int) -> DataFrame:
        """All vectors against some queries: each task keeps its best rows for each query."""
        shared = self.spark.sparkContext.broadcast((list(asked), np.stack([v / np.linalg.norm(v) for v in asked.values()])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, units = shared.value
            best: dict[str, pa.Table] = {}
            for batch in batches:
                if batch.num_rows:
                    scores = np.round(unit_rows(_matrix(batch.column(1))) @ units.T, 6)
                    for i, q in enumerate(names):
                        found = pa.table([batch.column(0), pa.array(scores[:, i])], names=["id", "score"])
                        best[q] = _best(best.get(q), found, "score", k)
            for q, found in best.items():
                yield from pa.table([pa.array([q] * len(found)), *found.combine_chunks().columns], names=["q", "id", "score"]).to_batches()

        return self._ranked(self.living().select("id", "vector").mapInArrow(run, f"q string, id {self._id_type()}, score double"), k)

    def _shortlisted(self, rows: DataFrame, quantizer: Quantizer, asked: dict, lists: dict, shortlist: int) -> DataFrame:
        """``q, id, list, near``: each task's best rows for each query, by the codes."""
        shared = self.spark.sparkContext.broadcast((quantizer, {q: v / np.linalg.norm(v) for q, v in asked.items()}, lists))
        kind = rows.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted, queries, probed = shared.value
            score = {q: fitted.scorer(v) for q, v in queries.items()}
            read = {q: np.isin(np.arange(len(fitted.centroids)), probed[q]) for q in queries}
            best: dict[str, pa.Table] = {}
            for batch in batches:
                at = batch.column(1).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(at), -1)
                for q, wanted in read.items():
                    some = np.flatnonzero(wanted[at])
                    if len(some):
                        found = pa.table([batch.column(0).take(pa.array(some)), pa.array(at[some]), pa.array(score[q](at[some], codes[some]))], names=["id", "list", "near"])
                        best[q] = _best(best.get(q), found, "near", shortlist)
            for q, found in best.items():
                whole = found.combine_chunks()
                yield from pa.table([pa.array([q] * len(whole)), *whole.columns], names=["q", "id", "list", "near"]).to_batches()

        return rows.select("id", "list", "codes").mapInArrow(run, f"q string, id {kind}, list int, near double")

    def _measured(self, quantizer: Quantizer, n: int) -> tuple[int, int]:
        """How many lists and rows of a shortlist keep ``TARGET`` of the true neighbours of some stored vectors, by an exact search and a count."""
        every = len(quantizer.centroids)
        if n <= NEIGHBOURS:
            return every, NEIGHBOURS
        turn = F.xxhash64("id", F.lit(5))
        drawn = self.living().select("id", "vector").orderBy(turn, "id").limit(ASKING).collect()  # any rows will do, but of all lists
        if not drawn:
            return every, NEIGHBOURS
        asked = {str(i): np.asarray(r.vector, np.float64) for i, r in enumerate(drawn)}
        own = self.spark.createDataFrame([(str(i), r.id) for i, r in enumerate(drawn)], f"q string, id {self._id_type()}")
        units = {q: v / np.linalg.norm(v) for q, v in asked.items()}
        truth = self._exact(asked, NEIGHBOURS + 1).join(F.broadcast(own), ["q", "id"], "left_anti").select("q", F.col("id").alias("_id"))
        true = self.living().join(F.broadcast(truth), F.col("id") == F.col("_id")).select("q", "list", "codes").collect()  # ASKING times NEIGHBOURS rows
        place = {q: np.argsort(quantizer.order(v)) for q, v in units.items()}
        probes = int(np.quantile([place[r.q][r.list] for r in true], TARGET, method="higher")) + 1
        limits = {q: np.sort([quantizer.scorer(units[q])(np.array([r.list]), np.frombuffer(bytes(r.codes), np.uint8)[None])[0] for r in true if r.q == q]) for q in asked}
        shared = self.spark.sparkContext.broadcast((quantizer, units, limits))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            fitted, queries, bounds = shared.value
            score = {q: fitted.scorer(v) for q, v in queries.items()}
            above = {q: np.zeros(len(b), np.int64) for q, b in bounds.items()}
            for batch in batches:
                at = batch.column(0).to_numpy()
                codes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(at), -1)
                for q in queries:
                    found = np.sort(score[q](at, codes))
                    above[q] += len(found) - np.searchsorted(found, bounds[q] + 1e-12)
            names = [(q, i, int(c)) for q, counts in above.items() for i, c in enumerate(counts)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*names, strict=True)] if names else [pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.int64())], names=["q", "i", "above"])

        ranks = self.living().select("list", "codes").mapInArrow(run, "q string, i long, above long").groupBy("q", "i").agg(F.sum("above").alias("n")).collect()
        shortlist = int(np.quantile([r.n for r in ranks], TARGET, method="higher")) + 1
        return probes, max(shortlist, 4 * NEIGHBOURS)


def vector_index_for(rows: DataFrame, id_col: str, vector_col: str, folder: str | None = None, name: str = "") -> VectorIndex:
    """The index of a table of vectors read from files: the one of this version of the files, built if there is none."""
    spark = rows.sparkSession
    version = hashlib.sha256(f"{input_version(rows)} {id_col} {vector_col} {name}".encode()).hexdigest()[:24]
    index = VectorIndex(spark, f"{folder or shared_dir(spark)}/vector-index-{version}")
    if not index.built:
        index.build(rows, id_col, vector_col)
    return index
