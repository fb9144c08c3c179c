"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._common import stage, with_global_rank

SHARDS = 24
DIMS, BITS = 3, 4
OVERHEAD = 8


@lru_cache(maxsize=8)
def curve(dims: int = DIMS, bits: int = BITS) -> tuple[int, ...]:
    """Place on the Hilbert curve of each cell of a grid with ``2 ** bits`` cells a side.

    The cell's number holds its coordinates one after the other, the first in the highest bits. Coordinates become
    places by undoing, from the highest bit down, the exchanges and inversions of the sub-cubes, followed by a Gray
    code (J. Skilling, Programming the Hilbert curve, 2004). The table has ``2 ** (dims * bits)`` entries.
    """
    places = []
    for cell in range(1 << (dims * bits)):
        x = [(cell >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        for level in range(bits - 1, 0, -1):
            bit, low = 1 << level, (1 << level) - 1
            for d in range(dims):
                if x[d] & bit:
                    x[0] ^= low
                else:
                    swap = (x[0] ^ x[d]) & low
                    x[0] ^= swap
                    x[d] ^= swap
        for d in range(1, dims):
            x[d] ^= x[d - 1]
        turn = 0
        for level in range(bits - 1, 0, -1):
            if x[-1] >> level & 1:
                turn ^= (1 << level) - 1
        place = 0
        for level in range(bits - 1, -1, -1):
            for d in range(dims):
                place = place << 1 | ((x[d] ^ turn) >> level & 1)
        places.append(place)
    return tuple(places)


def name_edges(docs: DataFrame, name_col: str, cells: int = 1 << BITS) -> list[str]:
    """The names at which the coordinates 1 to ``cells - 1`` begin: names in order share the rows evenly, as far as one name isn't more.

    The rows are counted by name; running counts of the names (range partitions and their offsets, no task with all names) say in
    which coordinate a name's middle row lies. At most ``cells - 1`` names come to the driver.
    """
    counts = docs.select(F.col(name_col).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    dealt = counts.repartitionByRange(F.col("name").asc_nulls_first()).withColumn("_part", F.spark_partition_id())
    inside = Window.partitionBy("_part").orderBy(F.col("name").asc_nulls_first())
    run = stage(dealt.withColumn("_upto", F.sum("n").over(inside)), "names")
    sums = run.groupBy("_part").agg(F.sum("n").alias("n"))
    before = sums.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_before"))
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # One row for each range partition.
    middle = F.col("_before") + F.col("_upto") - F.col("n") / 2
    code = F.least((middle * cells / max(total, 1)).cast("int"), F.lit(cells - 1))
    found = run.join(F.broadcast(before), "_part").groupBy(code.alias("code")).agg(F.min("name").alias("name")).where("code > 0 and name is not null")
    return [r.name for r in found.orderBy("code").collect()]


def size_edges(sizes: DataFrame, size_col: str, cells: int = 1 << BITS) -> list[int]:
    """The sizes at which the coordinates 1 to ``cells - 1`` begin: approximate quantiles, equal ones once."""
    found = sizes.agg(F.percentile_approx(size_col, [k / cells for k in range(1, cells)], 10_000)).first()[0] or []
    return sorted(set(found))


def code_of(value: Column, edges: list) -> Column:
    """How many edges the value has reached; null has reached none."""
    total = F.lit(0)
    for edge in edges:
        total = total + F.coalesce((value >= F.lit(edge)).cast("int"), F.lit(0))
    return total


def hilbert_shards(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    name_cols: tuple[str, str] = ("source", "lang"),
    shards: int = SHARDS,
) -> DataFrame:
    """Place each row in a shard: a run of the Hilbert order over two names and the size.

    Each dimension is quantised by its own quantiles, so that the grid's 16 steps a side are used however names and sizes are spread.
    Rows near each other on the curve agree in all three dimensions, so a shard covers a compact box of the grid and
    a reader that filters on any of the dimensions can leave most shards unread by their least and greatest values. The runs are cut by count: the
    shards' counts differ by one at most (law ``rows``). Inside a cell the rows follow by checksum and id, so equal
    texts with equal metadata are neighbours; a hot cell spreads over as many runs as it needs.

    The order is made by range partitions and offsets (``with_global_rank``), never in one task, and holds a few
    numbers for each document; texts are read once and not shuffled.

    Defined results: a null text has 0 bytes and the checksum of the empty text; null names come before all others; null
    ids come last in their cell; repeated rows get neighbouring slots; with fewer rows than shards some shards stay
    empty; an empty table gives an empty result.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard, curve_place``.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD
    a, b = name_cols
    keyed = docs.select(
        F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.col(a).alias("_a"), F.col(b).alias("_b")
    )
    keyed = stage(keyed, "sizes")
    codes = [code_of(F.col("_a"), name_edges(keyed, "_a")), code_of(F.col("_b"), name_edges(keyed, "_b")), code_of(F.col("size"), size_edges(keyed, "size"))]
    cell = F.shiftleft(codes[0], 2 * BITS) + F.shiftleft(codes[1], BITS) + codes[2]
    keyed = keyed.select("doc_id", "size", "text_crc32", cell.alias("_cell"))
    places = docs.sparkSession.range(1).select(
        F.posexplode(F.split(F.lit(",".join(map(str, curve()))), ",")).alias("_cell", "_p")
    )
    # 4,096 rows, whatever the data.
    keyed = keyed.join(F.broadcast(places), "_cell").withColumn("curve_place", F.col("_p").cast("int")).drop("_p", "_cell")
    ranked = with_global_rank(keyed, ["curve_place", "text_crc32", "doc_id"], "_rank", "curve")
    n = ranked.count()
    shard = F.expr(f"_rank * {shards} div {max(n, 1)}")
    first = F.expr(f"(_shard * {n} + {shards - 1}) div {shards}")
    return ranked.withColumn("_shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        (F.col("_rank") - first).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "curve_place",
    )
