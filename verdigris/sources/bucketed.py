"""Tables dealt to buckets by key under a manifest: changes write the buckets that they touch, and a reader sees one version."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.curation import upsert
from verdigris.operators.index_segments import Folder

#: Buckets of a new table: a change rewrites one of so many parts for each key at most.
BUCKETS = 256
#: Versions whose files stay for readers that opened them.
KEPT = 2


class BucketedTable:
    """A table in a folder.

    ``part-<id>/bucket=<n>`` holds the rows of bucket n as some change wrote them; a version (``version-<n>.json``) names the part of each
    bucket. A change reads and writes the touched buckets alone and then publishes the next version, a small file that appears whole or
    not at all; of two changes at a time the slower fails and leaves nothing that a reader could see. ``batches`` remembers what streams
    delivered.
    """

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, Folder(spark, path), key, buckets

    def version(self) -> dict | None:
        """The last version; None before the first change."""
        names = [n for n in self.folder.names() if n.startswith("version-") and n.endswith(".json")]
        return json.loads(self.folder.read(names[-1])) if names else None

    def bucket(self, n: int) -> Column:
        return F.pmod(F.xxhash64(*self.key), F.lit(n)).cast("int")

    def read(self, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version (the last by default), or those of some buckets; later changes don't alter what is opened."""
        v = version or self.version()
        if v is None:
            raise ValueError(f"there is no table in {self.folder.path}")
        wanted = v["parts"] if buckets is None else {str(b): v["parts"][str(b)] for b in buckets if str(b) in v["parts"]}
        paths = [f"{self.folder.path}/{part}/bucket={b}" for b, part in wanted.items()]
        return self.spark.read.schema(v["schema"]).parquet(*paths) if paths else self.spark.createDataFrame([], v["schema"])

    def upsert(self, updates: DataFrame, keep_old_where_null: list[str] | None = None, stream: str = "", batch: int = 0) -> list[int]:
        """Put rows in place of those with their keys and add the others; returns the touched buckets. A key comes once in ``updates``."""
        return self._change(updates, lambda old, new: upsert(old, new, self.key, keep_old_where_null), stream, batch)

    def delete(self, keys: DataFrame, stream: str = "", batch: int = 0) -> list[int]:
        """Drop the rows with some keys; returns the touched buckets."""
        return self._change(keys.select(*self.key).distinct(), lambda old, new: old.join(new, self.key, "left_anti"), stream, batch)

    def _change(self, rows: DataFrame, made: Callable[[DataFrame, DataFrame], DataFrame], stream: str, batch: int) -> list[int]:
        v = self.version()
        if v is None:
            v = {"number": 0, "buckets": self.buckets, "schema": rows._jdf.schema().toDDL(), "parts": {}, "batches": {}}
        if stream and batch <= v["batches"].get(stream, -1):
            return []
        held = self.bucket(v["buckets"])
        touched = sorted(r.b for r in rows.select(held.alias("b")).distinct().collect())  # one of a fixed number
        part = f"part-{uuid.uuid4().hex}"
        if touched:
            after = made(self.read(v, touched), rows)
            after.withColumn("bucket", held).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder.path}/{part}")
        written = {n.split("=")[1] for n in Folder(self.spark, f"{self.folder.path}/{part}").names() if n.startswith("bucket=")} if touched else set()
        parts = {b: p for b, p in v["parts"].items() if int(b) not in touched} | dict.fromkeys(sorted(written), part)
        batches = v["batches"] | ({stream: batch} if stream else {})
        text = json.dumps(v | {"number": v["number"] + 1, "parts": parts, "batches": batches})
        if not self.folder.publish(f"version-{v['number'] + 1:012d}.json", text):
            raise RuntimeError(f"another change made version {v['number'] + 1} of {self.folder.path}")
        return touched

    def vacuum(self, kept: int = KEPT) -> list[str]:
        """Delete parts and versions that none of the last ``kept`` versions needs, once no reader uses older ones."""
        names = self.folder.names()
        versions = [n for n in names if n.startswith("version-")]
        used = set(versions[-kept:])
        for name in versions[-kept:]:
            used |= set(json.loads(self.folder.read(name))["parts"].values())
        gone = [n for n in names if n not in used and n.split("-")[0] in ("version", "part")]
        for name in gone:
            self.folder.delete(name)
        return gone
