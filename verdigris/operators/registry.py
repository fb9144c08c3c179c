"""Companies, establishments and partners: lookups, filters, links and bounded paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.functions.text import company_tokens, match_score


def predicate(filters: dict[str, tuple[str, object]]) -> Column:
    """A conjunction from ``column: (kind, value)``; kinds: equals, prefix, contains, from, to, in."""
    result = F.lit(True)
    for name, (kind, value) in filters.items():
        c = F.col(name)
        result = result & {
            "equals": lambda c=c, v=value: c == v,
            "prefix": lambda c=c, v=value: c.startswith(v),
            "contains": lambda c=c, v=value: F.contains(F.lower(c), F.lower(F.lit(v))),
            "from": lambda c=c, v=value: c >= v,
            "to": lambda c=c, v=value: c <= v,
            "in": lambda c=c, v=value: c.isin(list(v)),
        }[kind]()
    return result


def clamp(limit: int, low: int = 1, high: int = 100) -> int:
    return max(low, min(high, int(limit)))


def name_search(rows: DataFrame, query: list[str], name: Column, k: int, order: str) -> DataFrame:
    """The best names for a query: any prefix of a word or equal word makes a candidate, the score decides."""
    words = company_tokens(name)
    scored = rows.withColumn("match", match_score(query, words))
    return scored.where("match > 0").orderBy(F.desc("match"), order).limit(k)


def linked(edges: DataFrame, company: object, company_col: str, partner_col: str, per_partner: int | None = 100) -> DataFrame:
    """Companies that share a partner with one company: ``partner, other``; at most some of each partner, by order, or all (None)."""
    partners = edges.where(F.col(company_col) == company).select(partner_col).distinct()
    others = edges.join(partners, partner_col, "left_semi").where(F.col(company_col) != company).select(partner_col, company_col).distinct()
    if per_partner is None:
        return others
    n = F.row_number().over(Window.partitionBy(partner_col).orderBy(company_col))
    return others.withColumn("_n", n).where(F.col("_n") <= per_partner).drop("_n")


def relationship_paths(
    edges: DataFrame, sources: DataFrame | list, targets: DataFrame | list, company_col: str, partner_col: str, depth: int = 2, most: int | None = None, per_partner: int | None = None, once: bool = False
) -> DataFrame:
    """Paths from source to target companies over shared partners: ``path`` (company, partner, company, ...) and ``hops``.

    A path visits no company twice and ends at a target. Bounds make it a breadth-first search: ``once`` reaches a company by the least of its shortest
    paths alone; of a partner only the ``per_partner`` first companies are tried, so a hub makes that many rows a hop and not the square of its
    companies; ``most`` paths are kept, shorter ones first. Sources and targets are values or tables with the company column; each hop is two joins with the
    edges, whatever their size.
    """
    spark, as_text = edges.sparkSession, lambda c: F.col(c).cast("string")
    table = lambda x: x if isinstance(x, DataFrame) else spark.createDataFrame([(str(v),) for v in x], f"`{company_col}` string")
    e = edges.select(as_text(company_col).alias("c"), as_text(partner_col).alias("p"), F.col(company_col).alias("_o")).distinct()
    tried = e
    if per_partner is not None:
        tried = e.withColumn("_n", F.row_number().over(Window.partitionBy("p").orderBy("_o"))).where(F.col("_n") <= per_partner)
    ends = table(targets).select(as_text(company_col).alias("at")).distinct()
    frontier = table(sources).select(as_text(company_col).alias("at")).distinct()
    seen, found = frontier, None
    frontier = frontier.join(e.select(F.col("c").alias("at")), "at", "left_semi").withColumn("path", F.array("at"))
    for hop in range(1, depth + 1):
        step = frontier.join(e.select(F.col("c").alias("at"), "p"), "at").select("path", "p")
        step = step.join(tried.select("p", F.col("c").alias("at")), "p").where(~F.array_contains("path", F.col("at")))
        step = step.join(seen, "at", "left_anti") if once else step
        step = step.select("at", F.concat("path", F.array("p", "at")).alias("path"))
        hits = step.join(ends, "at", "left_semi").select("path", F.lit(hop).alias("hops"))
        found = hits if found is None else found.unionByName(hits)
        frontier = step.join(ends, "at", "left_anti")
        if once:
            frontier = frontier.groupBy("at").agg(F.min("path").alias("path"))
            seen = seen.unionByName(frontier.select("at"))
    return found if most is None else found.orderBy("hops", "path").limit(most)


def path_label(path: Column) -> Column:
    """A path as text."""
    return F.array_join(path, " -> ")


def company_label(name: Column, key: Column) -> Column:
    """A company's name with its key in brackets, or the key alone."""
    shown = F.concat(F.trim(name), F.lit(" ("), key.cast("string"), F.lit(")"))
    return F.when(F.coalesce(F.trim(name), F.lit("")) != "", shown).otherwise(key.cast("string"))


def partners_by_name(partners: DataFrame, name: str, words: list[str], most: int = 5) -> DataFrame:
    """Partners whose normalised name holds each of the first words asked for."""
    from verdigris.functions.text import normalize

    for word in words[:most]:
        partners = partners.where(F.contains(normalize(F.col(name)), F.lit(word)))
    return partners


def named_companies(found: DataFrame, establishments: DataFrame, key: str, seat: Column) -> DataFrame:
    """Companies found by name beside their seat: a company without one stays."""
    return found.join(establishments.where(seat), key, "left")


def count_by(rows: DataFrame, key: str, k: int) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("total")).orderBy(F.desc("total"), key).limit(k)
