"""Exact deduplication with a heavy-hitter split (native: DataFrame operations only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._common import ascii_lower, packed, stage

#: A digest that more than this share of the rows carries is certain to be found as frequent; the Misra-Gries
#: summary keeps 1 / SUPPORT counters, which is also the bound of the broadcast table.
SUPPORT = 0.0005


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: float = SUPPORT) -> DataFrame:
    """Decide for each row whether it stays among the rows with the same text.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays.

    1. The digests (SHA-256) of all texts are computed once and staged with a row number; no later pass sees a text.
    2. ``freqItems`` (a Misra-Gries summary, merged over partitions) proposes the frequent digests. It keeps at most
       ``1 / support`` candidates and misses none that more than ``support`` of the rows carry.
    3. The candidates are verified by one exact aggregation that combines on the map side: group size and winner.
       Candidates with one row are let go. What is left is broadcast; its size is bounded by ``1 / support`` rows.
    4. Rows with a frequent digest are decided on the map side. The others meet by digest in an ordinary shuffle,
       whose largest group holds at most ``support`` of the rows.

    Defined results: a null text counts as empty, so nulls and empty texts form one group. A null id loses to any
    other id. Rows repeated with the same id and text count each; exactly one of them stays. An empty table gives an
    empty result. Other columns are neither read nor returned.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` (one row for each input row).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stage(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.sha2(ascii_lower(text).cast("binary"), 256).alias("text_sha256"),
        ).withColumn("_row", F.monotonically_increasing_id()),
        "digests",
    )
    found = rows.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    best = F.max(F.struct(F.col("doc_id"), F.col("_row"))).alias("_best")
    size = F.count(F.lit(1)).alias("group_size")
    # At most 1 / support candidates: a bounded broadcast.
    winners = rows.join(F.broadcast(found), "text_sha256", "left_semi").groupBy("text_sha256").agg(best, size)
    winners = stage(winners.where(F.col("group_size") > 1), "winners")
    marked = rows.join(F.broadcast(winners), "text_sha256", "left")
    kept = F.col("_best._row") == F.col("_row")
    out = [
        F.col("doc_id"),
        F.col("_best.doc_id").alias("keep_id"),
        F.col("group_size"),
        kept.alias("kept"),
        F.col("text_sha256"),
    ]
    hot = marked.where(F.col("_best").isNotNull()).select(*out)
    group = Window.partitionBy("text_sha256")
    rest = (
        rows.join(F.broadcast(winners), "text_sha256", "left_anti")
        .withColumn("_best", F.max(F.struct(F.col("doc_id"), F.col("_row"))).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
        .select(*out)
    )
    return hot.unionByName(rest)


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, with their own columns and texts.

    The rows to drop are looked up by id and digest. Where one id stands on several equal rows (a repeated row),
    the survivors are thinned to one by id and digest as well.
    """
    decided = stage(exact_dedup(docs, id_col, text_col), "decided")
    digest = F.sha2(ascii_lower(F.coalesce(F.col(f"row.`{text_col}`"), F.lit(""))).cast("binary"), 256)
    dropped = decided.where(~F.col("kept") & ~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    dropped = dropped.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = packed(docs).select("row", digest.alias("_digest"), F.col(f"row.`{id_col}`").alias("_key"))
    left = rows.join(dropped, F.col("_digest").eqNullSafe(F.col("_sha")) & F.col("_key").eqNullSafe(F.col("_id")), "left_anti")
    if not decided.where(~F.col("kept") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).isEmpty():
        left = left.dropDuplicates(["_key", "_digest"])
    return left.select("row.*")
