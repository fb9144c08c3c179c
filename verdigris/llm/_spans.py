"""Places of pattern matches in texts, with DataFrame operations only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Pattern:
    """A kind of match. ``needs``: strings without any of which a text can't match (tested first, as that is cheap)."""

    kind: str
    regex: str
    needs: tuple[str, ...] = ()
    digits: str = ""  # a cheap pattern of digits that every match holds


def _pieces(text: Column, p: Pattern, before: int, after: int) -> Column:
    """What stands between the matches, with the match that follows each (null after the last piece)."""
    regex = F.lit(p.regex)
    found = F.zip_with(
        F.regexp_extract_all(text, regex, F.lit(0)),
        F.split(text, p.regex, -1),
        lambda m, gap: F.struct(
            F.lit(p.kind).alias("kind"),
            m.alias("match"),
            F.length(gap).alias("gap"),
            F.right(gap, F.lit(before)).alias("before"),
            F.left(gap, F.lit(after)).alias("head"),
        ),
    )
    may = F.lit(True)
    if p.needs:
        may = F.lit(False)
        for word in p.needs:
            may = may | F.contains(text, F.lit(word))
    if p.digits:
        may = may & F.rlike(text, F.lit(p.digits))
    return F.when(may, F.when(F.rlike(text, regex), found))


def find_spans(
    docs: DataFrame, text_col: str, carry: list[str], patterns: list[Pattern], before: int = 0, after: int = 0
) -> DataFrame:
    """One row for each leftmost non-overlapping match of each pattern; a text without any gives one row, kind null.

    ``split`` and ``regexp_extract_all`` cut a text into the pieces between the matches and the matches themselves;
    the running sum of their lengths, a window over the row's pieces, gives the places in code points. A text is
    read where it lies; only the matches are shuffled, once, by the row's own number (``_row``).

    Returns ``_row``, the columns of ``carry``, ``kind, match, start, end, before, after`` (the last two: up to so many
    characters around the match, back to the match before it and on to the next one of the same kind).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = F.flatten(F.array_compact(F.array(*[_pieces(text, p, before, after) for p in patterns])))
    rows = docs.select(*carry, F.monotonically_increasing_id().alias("_row"), parts.alias("_parts"))
    rows = rows.select(*carry, "_row", F.posexplode_outer("_parts").alias("_pos", "_part")).repartition("_row")
    w = Window.partitionBy("_row", "_part.kind").orderBy("_pos")
    size = F.coalesce(F.length("_part.match"), F.lit(0))
    end = F.sum(F.col("_part.gap") + size).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end", end.cast("long")).withColumn("after", F.lead("_part.head").over(w))
    return rows.where(F.col("_part.match").isNotNull() | F.col("_pos").isNull()).select(
        "_row",
        *carry,
        F.col("_part.kind").alias("kind"),
        F.col("_part.match").alias("match"),
        (F.col("end") - size).alias("start"),
        "end",
        F.col("_part.before").alias("before"),
        "after",
    )


def kind_place(kinds: list[str], kind: Column) -> Column:
    """The kind's place in the list, from 1."""
    return F.array_position(F.array(*[F.lit(k) for k in kinds]), kind).cast("int")


def joined(entries: Column, by_kind_first: bool) -> Column:
    """``kind:start:end`` of all entries (structs with kind, k, start, end; nulls left out), comma-joined in order."""
    order = ("k", "start", "end", "kind") if by_kind_first else ("start", "k", "end", "kind")
    keyed = F.transform(F.array_compact(entries), lambda x: F.struct(*[x[c].alias(c) for c in order]))
    text = F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    return F.array_join(text, ",")
