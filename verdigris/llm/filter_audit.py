"""What each filter removes in each order of filters: a packed bitmap index, counted by AND-NOT and popcount."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._common import bound_batches, drop_staged, frequent_left, stage

WORD_GAP = r"[\x20\x09-\x0D]+"
#: The filters in the order of their bits; E alone needs the whole table.
FILTERS = "ABCDE"
LABELS = ("good", "toxic")
#: Rows that share bitmaps: a task holds one block's flags at a time.
BLOCK = 1 << 18


def row_failures(text: Column) -> dict[str, Column]:
    """A: under 100 words. B: distinct words under 80 %. C: A-Z over 10 % of the code points. D: any of ``#$%&*|``."""
    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {"A": n < 100, "B": distinct * F.lit(100) < n * F.lit(80), "C": capitals * F.lit(100) > F.length(text) * F.lit(10), "D": text.rlike("[#$%&*|]")}


def flagged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part, fails, marks`` (bits) of each row: bit k of ``fails`` is the k-th filter, bit k of ``marks`` the k-th label.

    The texts are read once. Filter E needs the smallest id of each text: ids and digests are combined where they lie, and copies of a
    frequent text learn it by a broadcast.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    bits = sum((F.when(x, F.lit(1 << k)).otherwise(F.lit(0)) for k, x in enumerate(row_failures(text).values())), F.lit(0)).alias("fails")
    rows = stage(docs.select(F.col(id_col).alias("doc_id"), part, bits, F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest")), "flags")
    texts = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "least")
    texts = stage(texts, "repeated")
    copied = F.when(F.col("doc_id") > F.col("least"), F.lit(1 << FILTERS.index("E"))).otherwise(F.lit(0))
    whole = stage(frequent_left(rows, texts, "digest").select("doc_id", "part", (F.col("fails") + copied).alias("fails")), "copies")
    has = [F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")]
    marks = (F.coalesce("quality", F.lit(0)) + F.coalesce("toxic", F.lit(0)) * 2).alias("marks")
    known = stage(labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(*has).select("doc_id", marks).where("marks > 0"), "marks")
    marked = stage(frequent_left(whole, known, "doc_id").select("part", "fails", F.coalesce("marks", F.lit(0)).alias("marks")), "flagged")
    drop_staged(rows, texts, whole, known)
    return marked


def packed_bits(flags: np.ndarray, bits: int, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """A bitmap for each bit of ``flags``, whose runs (``sizes``) begin at whole bytes (``starts``)."""
    within = np.arange(len(flags)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    place = np.repeat(starts * 8, sizes) + within
    out = []
    for k in range(bits):
        bitmap = np.zeros(int((starts[-1] + -(-sizes[-1] // 8)) * 8) if len(sizes) else 0, np.uint8)
        bitmap[place] = (flags >> k) & 1
        out.append(np.packbits(bitmap))
    return out


def bitmap_index(flags: DataFrame, filters: str = FILTERS, block: int = BLOCK) -> DataFrame:
    """The packed bitmap index of ``part, fails, marks``: for each block of rows and part in it ``part, rows`` and a bitmap for each filter and label."""
    names = [*filters, *LABELS]

    def index(parts: list, fails: np.ndarray, marks: np.ndarray) -> pa.RecordBatch:
        values, code = np.unique(np.array(parts, object), return_inverse=True)
        order = np.argsort(code, kind="stable")
        sizes = np.bincount(code, minlength=len(values))
        widths = -(-sizes // 8)
        starts = np.cumsum(widths) - widths
        maps = packed_bits(fails[order], len(filters), starts, sizes) + packed_bits(marks[order], len(LABELS), starts, sizes)
        cuts = [[m[i:j].tobytes() for i, j in zip(starts, starts + widths, strict=True)] for m in maps]
        return pa.RecordBatch.from_arrays([pa.array(values, pa.string()), pa.array(sizes), *[pa.array(c, pa.binary()) for c in cuts]], names=["part", "rows", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def whole():
            return index([p for parts, _, _ in held for p in parts], *[np.concatenate([x[k] for x in held]) for k in (1, 2)])

        for batch in batches:
            held.append((batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()))
            size += batch.num_rows
            if size >= block:
                yield whole()
                held, size = [], 0
        if size:
            yield whole()

    bound_batches(flags.sparkSession)
    schema = "part string, rows long, " + ", ".join(f"{c} binary" for c in names)
    return flags.select("part", "fails", "marks").mapInArrow(run, schema)


def prefix_counts(index: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``part, prefix, filter, before, removed, good, toxic``: for each set of filters (bits) and filter outside of it the rows of a part that
    the set lets through, and those of them that the filter removes. Bitmaps are combined by AND-NOT and counted where they lie; only counts meet.
    """
    k = len(filters)
    cases = [(prefix, f) for prefix in range(1 << k) for f in range(k) if not prefix >> f & 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            contents = [batch.column(2 + i).to_pylist() for i in range(k + len(LABELS))]
            widths = np.array([len(x) for x in contents[0]])
            starts = np.cumsum(widths) - widths
            maps = [np.frombuffer(b"".join(x), np.uint8) for x in contents]
            count = lambda bits: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), starts)
            rows = batch.column(1).to_numpy()
            out: list[list] = [[] for _ in range(6)]
            union = {0: np.zeros(len(maps[0]), np.uint8)}
            for prefix in range(1, 1 << k):
                top = prefix.bit_length() - 1
                union[prefix] = union[prefix ^ (1 << top)] | maps[top]
            before = {prefix: rows - count(gone) for prefix, gone in union.items()}
            for prefix, f in cases:
                hit = maps[f] & ~union[prefix]
                said = [before[prefix], count(hit), *[count(hit & label) for label in maps[k:]]]
                for column, values in zip(out, [np.full(len(rows), prefix), np.full(len(rows), f), *said], strict=True):
                    column.append(values)
            parts = batch.column(0).take(pa.array(np.tile(np.arange(len(rows)), len(cases))))
            numbers = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
            yield pa.RecordBatch.from_arrays([parts, *numbers], names=["part", "prefix", "filter", "before", "removed", *LABELS])

    local = index.mapInArrow(run, f"part string, prefix long, filter long, before long, removed long, {' long, '.join(LABELS)} long")
    return local.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in ("before", "removed", *LABELS)])


def audit(index: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The report over a bitmap index: a row for each part, order of the filters and step."""
    k = len(filters)
    counts = prefix_counts(index, filters)
    each = Window.partitionBy("part", "filter")  # a set of the other filters a row: 16 of them
    weights = F.element_at(F.array(*[F.lit(factorial(n) * factorial(k - 1 - n)) for n in range(k)]), F.bit_count("prefix") + 1)
    others = F.expr(f"{(1 << k) - 1} - shiftleft(1L, cast(filter AS int))")
    known = counts.select(
        "*",
        F.max(F.when(F.col("prefix") == 0, F.col("removed"))).over(each).alias("fails"),
        F.max(F.when(F.col("prefix") == others, F.col("removed"))).over(each).alias("unique_fails"),
        F.sum(F.col("removed") * weights).over(each).alias("shapley"),
    )
    orders = [("".join(filters[f] for f in order), step + 1, sum(1 << f for f in order[:step]), f) for order in permutations(range(k)) for step, f in enumerate(order)]
    steps = index.sparkSession.createDataFrame(orders, "filter_order string, step int, prefix long, filter long")
    return known.join(F.broadcast(steps), ["prefix", "filter"]).select(
        "part",
        "filter_order",
        "step",
        (F.col("before") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        F.col("good").alias("good_lost"),
        F.col("toxic").alias("toxic_lost"),
        "shapley",
    )


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What five filters remove from each part of the documents, in each of their 120 orders.

    1. Each row's failures are bits; only filter E (the same text under a smaller id) needs other rows, which meet by digest.
    2. Each block of rows becomes packed bitmaps by part: one for each filter and label (``bitmap_index``).
    3. For each of the 32 sets of filters that may stand before a step, AND-NOT and popcounts give what the next filter removes; these
       counts are summed over the blocks (80 for each part), and the orders are read off them. So an order costs no pass over the data.

    Defined results: a null text counts as empty, a null part as the empty string. A null id has no smaller one and is no smaller one, and
    has no labels; rows that repeat id and text don't fail E by each other. A document is good or toxic if any label of its id says so.
    Other columns are neither read nor returned. An empty table gives an empty result.

    Returns ``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.
    """
    return audit(stage(bitmap_index(flagged(docs, labels, id_col, text_col, part_col)), "bitmaps"))
