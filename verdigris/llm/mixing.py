"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.llm._common import packed, stage, with_global_rank

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
#: Bits of the hash that one histogram resolves, and how many histograms are made, each inside the boundary bucket
#: of the one before: together all 60 bits of the hash.
BITS, LEVELS = 15, 4
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Targets of the sources: ``source, source_size`` in, with ``target`` (double) out.

    Sources get the weights in turn, in the order of their code points, null last. A target stops at ``most`` times
    the source's size; what is cut off goes to the others by weight, until none is above. The loop on the driver
    holds one number, the words a unit of weight brings; each turn is one small aggregation, and a turn that caps
    no further source is the last.
    """
    ranked = with_global_rank(sources, ["source"], "_rank", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    table = stage(ranked.select("source", "source_size", weight.alias("_weight")), "weights")
    total = table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    cap = F.col("source_size") * float(most)
    unit, capped = None, -1
    while True:
        over = F.lit(False) if unit is None else cap <= F.lit(unit) * F.col("_weight")
        n, spent, rest = table.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~over, F.col("_weight"))), F.lit(0.0)),
        ).first()
        if n == capped or not rest:
            break
        capped, unit = n, (total - spent) / rest
    if not rest:  # every source is at its cap
        return table.select("source", "source_size", cap.alias("target"))
    return table.select("source", "source_size", F.least(cap, F.lit(unit) * F.col("_weight")).alias("target"))


def mix_hash(key: Column, text: Column) -> Column:
    """60 bits of the MD5 of ``<key>:<MD5 of the text>`` as a long that is never negative; null keys and texts count as empty.

    The text is part of it, so that rows without an id, or with a repeated one, are told apart.
    """
    own = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    digest = F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), own).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def mix_rule(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row for each source of ``sized`` (``source, size, _hash``; staged): how often its documents are taken.

    ``_whole`` times each document; once more those whose hash lies below ``_limit``, or on it if ``_with``.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sources, weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("_whole", whole).withColumn(
        "_left", F.greatest(F.col("target") - F.col("_whole") * F.col("source_size"), F.lit(0.0))
    )
    # ``_prefix``: the top bits of the boundary so far; null once nothing is left to refine.
    plan = stage(plan.withColumn("_prefix", F.lit(0).cast("long")).withColumn("_under", F.lit(0).cast("long")), "plan")
    key = F.col("source").eqNullSafe(F.col("_source"))
    for level in range(LEVELS):
        bucket = F.shiftright(F.col("_hash"), BITS * (LEVELS - 1 - level))
        small = plan.select(F.col("source").alias("_source"), "_prefix")
        inside = sized.join(small, key).withColumn("_bucket", bucket)
        if level:
            inside = inside.where(F.shiftright(F.col("_bucket"), BITS) == F.col("_prefix"))
        sums = inside.groupBy("source", "_bucket").agg(F.sum("size").alias("_words"))
        # A bucket's place inside its boundary bucket: at most 2 ** BITS rows a source.
        place = F.col("_bucket").bitwiseAND(2**BITS - 1)
        order = Window.partitionBy("source").orderBy(place)
        sums = sums.withColumn("_before", F.sum("_words").over(order) - F.col("_words"))
        # The bucket in which the remainder is reached: the last that begins at or under it.
        reached = (
            sums.join(plan.select(F.col("source").alias("_source"), "_left"), key)
            .where(F.col("_before") <= F.col("_left"))
            .groupBy("source")
            .agg(F.max(F.struct(place, F.col("_bucket"), F.col("_before"), F.col("_words"))).alias("_b"))
        )
        reached = reached.select(
            F.col("source").alias("_source"),
            F.col("_b._bucket").alias("_at"),
            F.col("_b._before").alias("_used"),
            F.col("_b._words").alias("_words"),
        )
        joined = plan.join(reached, key, "left").drop("_source")
        plan = stage(
            joined.withColumn("_prefix", F.coalesce("_at", F.shiftleft(F.col("_prefix"), BITS)))
            .withColumn("_left", F.col("_left") - F.coalesce("_used", F.lit(0)))
            .withColumn("_last", F.coalesce("_words", F.lit(0)))
            .drop("_at", "_used", "_words"),
            "plan",
        )
    # Now the prefix is a whole hash; its rows are taken if that ends nearer to the target.
    nearer = (F.col("_left") * 2 > F.col("_last")) & (F.col("_last") > 0)
    return plan.select(F.col("source").alias("_source"), "source_size", "target", "_whole", F.col("_prefix").alias("_limit"), nearer.alias("_with"))


def copies_taken(most: int = MOST) -> Column:
    """How often a document beside its source's rule is taken."""
    more = ((F.col("_hash") < F.col("_limit")) | ((F.col("_hash") == F.col("_limit")) & F.col("_with"))).cast("long")
    return F.least(F.col("_whole") + F.when(F.col("_whole") < most, more).otherwise(0), F.lit(most).cast("long"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return stage(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"), mix_hash(F.col(id_col), F.col(text_col)).alias("_hash")),
        "sizes",
    )


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
) -> DataFrame:
    """Say how often the mix takes each document so that each source's words come near its target.

    A document's size is its number of words. A source whose target is ``q`` whole sizes and a remainder takes each of its
    documents ``q`` times, and once more those whose hash lies under the source's threshold. The thresholds come
    from histograms: words by source and the top bits of the hash, the bucket in which the remainder is reached,
    then a histogram of that bucket alone on the next bits, and so on to the last bit. No document is sorted, and
    each pass shuffles only sums. The boundary bucket is taken if that brings the sum nearer to the target.

    Defined results: a null or empty text has size 0 and is taken 0 words (``copies`` still counts it). A null source
    is a source of its own, last in the order. Ids may be null or repeat: rows are told apart by their texts as well; rows of one source
    that repeat id and text are taken or left together. An empty table gives an empty result. Reruns agree, as the hash depends on id and
    text only.

    Returns ``doc_id, size, source_size, target, taken, copies, source``.
    """
    sized = _sized(docs, id_col, text_col, source_col)
    rule = mix_rule(sized, weights, share, most)
    copies = copies_taken(most)
    return sized.join(rule, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"), "source"
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of the mix with all their columns: a document as often as it is taken. The texts meet their source's rule where they lie."""
    rule = mix_rule(_sized(docs, id_col, text_col, source_col)).select("_source", "_whole", "_limit", "_with")
    rows = packed(docs).withColumn("_hash", mix_hash(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    ruled = rows.join(rule, F.col(f"row.`{source_col}`").eqNullSafe(F.col("_source")))
    return ruled.select("row", F.explode(F.array_repeat(F.lit(0), copies_taken().cast("int"))).alias("_copy")).select("row.*")
