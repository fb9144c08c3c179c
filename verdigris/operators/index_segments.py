"""A positional index that is kept up to date: immutable segments, tombstones, statistics by segment, merges."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.lexical_index import ROW_GROUP, LexicalIndex, in_order, own_words, postings_of

#: Segments that an index has at most before the smaller ones are merged.
MOST = 8
#: Versions whose tables stay for readers that opened them.
KEPT = 2


@dataclass(frozen=True)
class Version:
    """What a version of the index consists of; small, whatever the index holds.

    ``segments``: number (the commit that made it), folder, rows. ``graves``: number of the commit, folder; a grave's ids are dead
    in all segments with a smaller number. ``batches``: the last batch of each stream that was taken in.
    """

    number: int = 0
    segments: tuple[tuple[int, str, int], ...] = ()
    graves: tuple[tuple[int, str], ...] = ()
    totals: str = ""
    batches: tuple[tuple[str, int], ...] = ()


def _digest(text_col: str) -> Column:
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256)


class Folder:
    """A folder that all tasks share, through Hadoop's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self.system = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self) -> list[str]:
        there = self._path(self.path)
        return sorted(s.getPath().getName() for s in self.system.listStatus(there)) if self.system.exists(there) else []

    def read(self, name: str) -> str:
        return self.spark.read.text(f"{self.path}/{name}", wholetext=True).first()[0]

    def publish(self, name: str, text: str) -> bool:
        """Write a small file that appears whole or not at all, and only if there is none of that name."""
        parts = self._path(f"{self.path}/.{name}-{uuid.uuid4().hex}")
        out = self.system.create(parts)
        out.write(bytearray(text.encode()))
        out.close()
        target = self._path(f"{self.path}/{name}")
        done = not self.system.exists(target) and self.system.rename(parts, target)
        if not done:
            self.system.delete(parts, False)
        return done

    def delete(self, name: str) -> None:
        self.system.delete(self._path(f"{self.path}/{name}"), True)


class SegmentedIndex:
    """An index in a folder, which takes in changes and never tokenises a text twice.

    A segment is what one commit tokenised: ``postings`` (as in ``LexicalIndex``), ``forward`` (``id, digest, length, words``: each
    distinct word with its count) and ``terms`` (``token, df, tf``). A commit writes a segment of the texts that are new or changed, a grave of
    the ids that went or changed with ``minus``, what the dead texts had added to each older segment's terms, and then publishes a version
    that names them. Readers see one version; a commit that fails, or meets another one, leaves nothing behind that a reader could see.
    """

    def __init__(self, spark: SparkSession, path: str, most: int = MOST):
        self.spark, self.folder, self.most = spark, Folder(spark, path), most

    def version(self) -> Version:
        """The last version; an empty one if there is none."""
        names = [n for n in self.folder.names() if n.startswith("version-") and n.endswith(".json")]
        if not names:
            return Version()
        v = json.loads(self.folder.read(names[-1]))
        return Version(v["number"], *(tuple(map(tuple, v[k])) for k in ("segments", "graves")), v["totals"], tuple(map(tuple, v["batches"])))

    def _table(self, folder: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder.path}/{folder}/{name}")

    def _live(self, v: Version, name: str, columns: list[str]) -> DataFrame:
        """The rows of all segments but those whose id a later grave holds."""
        parts = [self._table(folder, name).select(*columns, F.lit(n).alias("segment")) for n, folder, _ in v.segments]
        rows = reduce(DataFrame.unionByName, parts)
        if not v.graves:
            return rows
        graves = [self._table(folder, "ids").select("id", F.lit(n).alias("_dies")) for n, folder in v.graves]
        dead = reduce(DataFrame.unionByName, graves).groupBy(F.col("id").alias("_id")).agg(F.max("_dies").alias("_dies"))
        return rows.join(dead, (F.col("id") == F.col("_id")) & (F.col("segment") < F.col("_dies")), "left_anti")

    def _terms(self, v: Version) -> DataFrame:
        """``token, df, tf`` of the living texts: the segments' sums less what their dead had added."""
        parts = [self._table(folder, "terms").select("token", "df", "tf") for _, folder, _ in v.segments]
        there = [n for n, _, _ in v.segments]
        parts += [self._table(folder, "minus").where(F.col("segment").isin(there)).select("token", (-F.col("df")).alias("df"), (-F.col("tf")).alias("tf")) for _, folder in v.graves]
        summed = reduce(DataFrame.unionByName, parts).groupBy("token").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))
        return summed.where("df > 0")

    def open(self, version: Version | None = None) -> LexicalIndex:
        """The tables of a version (the last by default), to search as any other index.

        A filter on tokens reaches every segment's files; ids of graves are left out after it.
        """
        v = version or self.version()
        if not v.segments:
            raise ValueError(f"there is no index in {self.folder.path}")
        postings = self._live(v, "postings", ["token", "id", "positions", "tf", "length"]).drop("segment")
        texts = self._live(v, "forward", ["id", "length"]).drop("segment")
        return LexicalIndex(postings, self._terms(v), texts, self._table(v.totals, "totals"))

    def _write_segment(self, folder: str, forward: DataFrame, postings: DataFrame) -> int:
        path = f"{self.folder.path}/{folder}"
        forward.write.parquet(f"{path}/forward")
        postings.write.option("parquet.block.size", 8 * ROW_GROUP).parquet(f"{path}/postings")
        # Postings lie in the order of tokens, so a task sends on few rows for each; the texts' own words don't.
        terms = self._table(folder, "postings").groupBy("token").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").cast("long").alias("tf"))
        terms.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{path}/terms")
        return self._table(folder, "forward").count()

    def _tokenised(self, folder: str, texts: DataFrame) -> int:
        """Write the segment of ``id, digest, text``: each text is tokenised once and written as its words with their positions, then turned into postings."""
        path = f"{self.folder.path}/{folder}/words"
        own_words(texts.select("id", "digest", "text")).write.parquet(path)
        rows = self.spark.read.parquet(path)
        counted = F.transform("words", lambda w: F.struct(w["token"].alias("token"), F.size(w["positions"]).alias("tf")))
        n = self._write_segment(folder, rows.select("id", "digest", "length", counted.alias("words")), postings_of(rows))
        self.folder.delete(f"{folder}/words")
        return n

    def changes(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """``id, digest, had`` of what a whole table of texts has new (``had`` is null), changed, or no longer (``digest`` is null)."""
        now = texts.select(F.col(id_col).alias("id"), _digest(text_col).alias("digest"))
        v = self.version()
        if not v.segments:
            return now.withColumn("had", F.lit(None).cast("string"))
        held = self._live(v, "forward", ["id", "digest"]).select("id", F.col("digest").alias("had"))
        return now.join(held, "id", "full_outer").where(~F.col("digest").eqNullSafe(F.col("had")))

    def update(self, texts: DataFrame, id_col: str, text_col: str = "text") -> dict[str, int]:
        """Make the index that of a whole table of texts: only what is new or changed is tokenised. Returns the numbers of each kind of change."""
        folder = f"changes-{uuid.uuid4().hex}"
        self.changes(texts, id_col, text_col).write.parquet(f"{self.folder.path}/{folder}/rows")
        found = self._table(folder, "rows")
        new = found.where("digest IS NOT NULL").select(F.col("id").alias("_id"), "digest")
        # Texts are met again by id and digest alone: the rows that stay as they are go no further than this join.
        rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        if self.version().segments:
            # The narrow side is hashed, so that no text is sorted.
            rows = rows.join(new.hint("shuffle_hash"), F.col("id") == F.col("_id")).drop("_id")
        else:
            rows = rows.withColumn("digest", _digest("text"))  # all are new
        kinds = found.selectExpr("count_if(had IS NULL) AS added", "count_if(had IS NOT NULL AND digest IS NOT NULL) AS changed", "count_if(digest IS NULL) AS removed").first().asDict()
        self._commit(rows, found.where("had IS NOT NULL").select("id"), kinds["added"] + kinds["changed"], kinds["changed"] + kinds["removed"])
        self.folder.delete(folder)
        return kinds

    def apply(self, upserts: DataFrame, deletes: DataFrame | None, id_col: str, text_col: str = "text", stream: str = "", batch: int = 0) -> bool:
        """Take in a batch: rows that replace those of their ids, and ids to forget. A batch of a stream that is taken in already does nothing.

        An id comes once in a batch; ``foreachBatch`` delivers a batch again after a failure, which the version's own record of batches
        makes harmless.
        """
        v = self.version()
        if stream and batch <= dict(v.batches).get(stream, -1):
            return False
        rows = upserts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _digest(text_col).alias("digest"))
        ids = rows.select("id") if deletes is None else rows.select("id").unionByName(deletes.select(F.col(id_col).alias("id"))).distinct()
        self._commit(rows, ids if v.segments else ids.limit(0), rows.count(), ids.count() if v.segments else 0, {stream: batch} if stream else {})
        return True

    def _commit(self, texts: DataFrame, dead: DataFrame, tokenised: int, gone: int, batches: dict[str, int] | None = None) -> None:
        v = self.version()
        number = v.number + 1
        segments, graves = list(v.segments), list(v.graves)
        if gone and segments:
            folder = f"grave-{number}-{uuid.uuid4().hex}"
            dead.distinct().write.parquet(f"{self.folder.path}/{folder}/ids")
            died = self._live(v, "forward", ["id", "words"]).join(self._table(folder, "ids"), "id", "left_semi")
            words = died.select("segment", F.explode("words").alias("w")).groupBy("segment", "w.token")
            words.agg(F.count(F.lit(1)).alias("df"), F.sum("w.tf").cast("long").alias("tf")).write.parquet(f"{self.folder.path}/{folder}/minus")
            graves.append((number, folder))
        if tokenised or not segments:
            folder = f"segment-{number}-{uuid.uuid4().hex}"
            segments.append((number, folder, self._tokenised(folder, texts)))
        self._publish(replace(v, number=number, segments=tuple(segments), graves=tuple(graves), batches=tuple((dict(v.batches) | (batches or {})).items())))
        if len(segments) > self.most:
            self.merge()

    def merge(self, few: int | None = None) -> None:
        """Make one segment of all but the ``few`` largest, without their dead. Postings are read and written, no text is."""
        v = self.version()
        few = self.most // 2 if few is None else few
        large = sorted(v.segments, key=lambda s: -s[2])[:few]
        small = [s for s in v.segments if s not in large]
        if not small:
            return
        number, folder = v.number + 1, f"segment-{v.number + 1}-{uuid.uuid4().hex}"
        some = replace(v, segments=tuple(small))
        postings = self._live(some, "postings", ["token", "id", "positions", "tf", "length"]).drop("segment")
        postings = in_order(postings, postings.select("id").count())
        rows = self._write_segment(folder, self._live(some, "forward", ["id", "digest", "length", "words"]).drop("segment"), postings)
        segments = tuple(s for s in v.segments if s in large) + ((number, folder, rows),)
        # A grave is of use as long as an older segment stands.
        graves = tuple(g for g in v.graves if any(n < g[0] for n, _, _ in segments))
        self._publish(replace(v, number=number, segments=segments, graves=graves))

    def _publish(self, v: Version) -> None:
        """Write the totals, then the version's file: another commit that was faster makes this one fail."""
        v = replace(v, totals=f"totals-{v.number}-{uuid.uuid4().hex}")
        total = self._live(v, "forward", ["id", "length"]).agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean")).first()
        one = F.log(F.lit(total.n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
        mean = self._terms(v).agg(F.lit(total.n).cast("long").alias("n"), F.lit(total.mean).cast("double").alias("mean"), F.avg(one).alias("mean_idf"))
        mean.coalesce(1).write.parquet(f"{self.folder.path}/{v.totals}/totals")  # one row
        text = json.dumps({"number": v.number, "segments": v.segments, "graves": v.graves, "totals": v.totals, "batches": v.batches})
        if not self.folder.publish(f"version-{v.number:012d}.json", text):
            raise RuntimeError(f"another commit made version {v.number} of the index in {self.folder.path}")

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Delete what none of the last ``kept`` versions names, once no reader uses older ones; returns the folders' names."""
        names = self.folder.names()
        versions = [n for n in names if n.startswith("version-")]
        used: set[str] = set()
        for name in versions[-kept:]:
            v = json.loads(self.folder.read(name))
            used |= {name, v["totals"], *(s[1] for s in v["segments"]), *(g[1] for g in v["graves"])}
        gone = [n for n in names if n not in used and n.split("-")[0] in ("version", "segment", "grave", "totals", "changes")]
        for name in gone:
            self.folder.delete(name)
        return gone
