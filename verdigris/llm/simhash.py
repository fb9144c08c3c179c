"""SimHash near duplicates: fingerprints of word shingles, linked through a table of distances to reference fingerprints."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.llm._common import bound_batches, drop_staged, frequent_first, stage, text_slices, tidied
from verdigris.llm.near_dedup import components

WORDS, SEED, BITS = 3, 42, 64
#: Bits in which linked fingerprints may differ.
DISTANCE = 2
#: Families of references, and references of a family: those of family b differ from the base in bits of the b-th block only.
FAMILIES, REFERENCES = 4, 8
#: Members of a bucket up to which they are compared with each other; larger buckets are linked by shared neighbours.
LARGE = 128


def fingerprint(text: str | None) -> int:
    """The fingerprint (unsigned): a bit is 1 if over half of the shingles' hashes have it; 0 for a text without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII spaces only
    if not words:
        return 0
    size = min(WORDS, len(words))
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[i:j], SEED) for i, j in spans), np.uint64, len(words) - size + 1)
    counts = np.zeros(BITS, np.int64)
    for part in range(0, len(hashes), 1 << 15):
        block = hashes[part : part + (1 << 15)].astype(">u8").view(np.uint8)
        counts += np.unpackbits(block).reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes)).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        for texts in text_slices(batch.column(1)):
            found = np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(found)], names=["doc_id", "fp"])
            at += len(texts)


def reference_fingerprints(families: int = FAMILIES, each: int = REFERENCES) -> np.ndarray:
    """The references (uint64): the base, then ``each`` for each family, which has half the bits of its block changed."""
    draw = np.random.Generator(np.random.PCG64(1313))
    base, found = int(draw.integers(0, 1 << 63, dtype=np.uint64)) * 2 + 1, []
    for block in np.array_split(np.arange(BITS), families):
        for _ in range(each):
            found.append(base ^ sum(1 << int(bit) for bit in draw.permutation(block)[: len(block) // 2]))
    return np.array([base, *found], np.uint64)


def distances(fps: np.ndarray, references: np.ndarray) -> np.ndarray:
    """The pivot table: for each fingerprint (uint64) its Hamming distance to each reference (uint8)."""
    return np.bitwise_count(fps[:, None] ^ references[None, :])


def bucket_keys(table: np.ndarray, families: int = FAMILIES) -> np.ndarray:
    """A key for each choice of ``families - DISTANCE`` families: a hash of their coordinates against the base's.

    A reference's coordinate less the base's depends on the family's own block alone. Fingerprints with at most ``DISTANCE`` differing
    bits leave all but so many blocks untouched, so they agree in one key at least.
    """
    from verdigris.llm._common import mix64

    relative = (table[:, 1:].astype(np.int64) - table[:, :1]).reshape(len(table), families, -1)
    family = np.full((len(table), families), 0, np.uint64)
    for j in range(relative.shape[2]):
        family = mix64(family * np.uint64(0x9E3779B97F4A7C15) + (relative[:, :, j] + 128).astype(np.uint64))
    keys = []
    for k, some in enumerate(combinations(range(families), families - DISTANCE)):
        key = np.full(len(table), k + 1, np.uint64)
        for b in some:
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + family[:, b])
        keys.append(key)
    return np.stack(keys, axis=1)


def pivot_table(fps: DataFrame) -> DataFrame:
    """``fp`` with its row of the pivot table (``places``, a byte for each reference), once for each of its bucket keys (``key``)."""
    references = reference_fingerprints()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_numpy()
            table = distances(found.view(np.uint64), references)
            keys = bucket_keys(table).view(np.int64)
            each = keys.shape[1]
            places = pa.array([row.tobytes() for row in table], pa.binary()).take(pa.array(np.repeat(np.arange(len(found)), each)))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(found, each)), places], names=["key", "fp", "places"])

    return fps.select("fp").mapInArrow(run, "key long, fp long, places binary")


def surviving_pairs(keys: np.ndarray, fps: np.ndarray, table: np.ndarray, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray, int]:
    """Links among rows in the order of ``keys``, within equal keys, and how many pairs the pivot table left to verify.

    By the triangle inequality no coordinate of a link differs by more than ``most``; pairs that pass in all coordinates are verified.
    """
    left, right, tested, step = [], [], 0, 1
    wide = table.astype(np.int16)
    while step < len(keys) and (at := np.flatnonzero(keys[:-step] == keys[step:])).size:
        for part in range(0, len(at), 1 << 16):
            i = at[part : part + (1 << 16)]
            i = i[np.abs(wide[i] - wide[i + step]).max(axis=1) <= most]
            tested += len(i)
            i = i[np.bitwise_count(fps[i].view(np.uint64) ^ fps[i + step].view(np.uint64)) <= most]
            left.append(fps[i])
            right.append(fps[i + step])
        step += 1
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right]), tested


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of buckets; a task's rows come in the order of their keys, and a bucket that a batch may not end is held for the next."""
    held = None

    def links(keys, fps, table):
        a, b, _ = surviving_pairs(keys, fps, table)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        rows = [keys, fps, np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(len(keys), -1)]
        rows = rows if held is None else [np.concatenate(x) for x in zip(held, rows, strict=True)]
        cut = np.searchsorted(rows[0], rows[0][-1])
        yield links(*[x[:cut] for x in rows])
        held = [x[cut:] for x in rows]
    if held is not None:
        yield links(*held)


def shared_neighbours(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` that join the same fingerprints as all pairs within two bits do, in 65 rows for each.

    Two fingerprints differ in at most two bits if and only if some value differs from each of them in at most one. At most 65
    fingerprints are so near to a value: its group is bounded whatever the table, and all in it are linked with its least.
    """
    near = F.expr(f"concat(array(fp), transform(sequence(0, {BITS - 1}), i -> fp ^ shiftleft(1L, i)))")
    groups = fps.select("fp", F.explode(near).alias("near")).groupBy("near").agg(F.collect_set("fp").alias("all")).where(F.size("all") > 1)
    return groups.select(F.array_min("all").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct()


def fingerprint_links(fps: DataFrame, large: int = LARGE) -> DataFrame:
    """Links ``a, b`` (staged) that connect the distinct fingerprints ``fp`` (staged) as all links of at most ``DISTANCE`` bits do."""
    bound_batches(fps.sparkSession)
    buckets = stage(pivot_table(fps), "pivot-table")
    sizes = stage(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bucket-sizes")
    met = stage(frequent_first(buckets, sizes, "key"), "buckets")
    some = met.where(F.col("n") <= large).select("key", "fp", "places").repartition("key").sortWithinPartitions("key")
    linked = some.mapInArrow(tidied(_bucket_links), "a long, b long")
    crowded = shared_neighbours(met.where(F.col("n") > large).select("fp").distinct())
    links = stage(linked.unionByName(crowded), "links")
    drop_staged(buckets, sizes, met)
    return links


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", large: int = LARGE) -> DataFrame:
    """The SimHash fingerprint of each document and the component that links of at most two differing bits put it in.

    1. Texts, lower-cased in A-Z only, give shingles of three words with repeats (fewer words: one shingle); a bit of the fingerprint is
       set if it is in more than half of their XXH64 hashes. Equal fingerprints go on once.
    2. The pivot table holds each fingerprint's Hamming distances to 33 references. They come in families that differ from a
       base within one block of bits, so fingerprints within two bits agree in two of four families' coordinates: six buckets for
       each fingerprint hold all that can be linked with it.
    3. In a bucket pairs with a coordinate that differs by more than two are discarded (triangle inequality); the survivors are verified.
       Members of buckets above ``large`` are linked by the values that are within one bit of both: 65 rows each, however large the bucket.
    4. Components come from smallest labels with jumps; no component meets in one task.

    Defined results: a null text counts as empty; texts without words have fingerprint zero, which links like any other. Rows with
    repeated ids are rows of their own; a component is named by its smallest id, null only if all its ids are. Other columns are neither read
    nor returned. An empty table gives an empty result.

    Returns ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id, component_size`` (rows), one row for each input row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    bound_batches(docs.sparkSession)
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidied(_fingerprints), f"doc_id {kind}, fp long"), "fingerprints")
    fps = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    links = fingerprint_links(fps, large)
    joined = components(links)
    roots = fps.join(joined.withColumnRenamed("id", "fp").hint("merge"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least", "n")
    roots = stage(roots, "roots")
    names = stage(roots.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("component_size")), "names")
    named = stage(frequent_first(roots.select("fp", "root"), names, "root").drop("root"), "named")
    drop_staged(links, fps, joined)
    out = frequent_first(rows, named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "component_size")
