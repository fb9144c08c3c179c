"""Paths between companies over shared partners: a breadth-first search from both ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.session import drop_staged, staged

#: What a path is worth if all its partners are known by document, and else.
STRONG, HINT = "forte", "indicio"


def _ends(spark, ends: DataFrame | list, column: str) -> DataFrame:
    table = ends if isinstance(ends, DataFrame) else spark.createDataFrame([(str(v),) for v in ends], f"`{column}` string")
    return table.select(F.col(column).cast("string").alias("at")).distinct()


def _backward(edges: DataFrame, tried: DataFrame, near: DataFrame) -> DataFrame:
    """The companies from which one more hop may reach ``near``: those with a partner of whom a company in ``near`` is tried."""
    keys = tried.join(near.select(F.col("at").alias("c")), "c", "left_semi").select("p").distinct()
    return edges.join(keys, "p", "left_semi").select(F.col("c").alias("at")).unionByName(near).distinct()


def paths_between(
    edges: DataFrame, sources: DataFrame | list, targets: DataFrame | list, company_col: str, partner_col: str, depth: int = 2, most: int | None = 5, per_partner: int | None = 100, weak_col: str | None = None
) -> DataFrame:
    """Paths from source to target companies: ``path`` (company, partner, company, ...), ``hops, confidence``; shorter ones first, then by path.

    What is found:

    - A company is gone on from by the least of its shortest paths alone, so each company is gone on from once.
    - Of a partner the ``per_partner`` first companies are tried, so a hub makes that many rows a hop and not the square of its companies.
    - A weak partner (``weak_col`` holds: known by name alone) is used once in the whole search, by the first company that meets it: the
      least path of the first hop. A strong one is used by each company that has it.
    - A path ends at a target and visits no company twice; a target is gone on from like any other company. ``most`` paths are kept.
    - ``confidence`` is ``forte`` if all partners of the path are strong, else ``indicio``.

    How: frontiers grow from both ends, always the one with fewer companies, as the counts of the last hop say. What the targets' side knows
    (companies within so many hops of a target) restricts the sources' frontier, from which no path is lost: a company on a path to a target
    is near it. The search stops once a frontier is empty, or ``most`` paths are found. Each hop is two joins with the edges; a hop's
    frontier is staged. Null companies and partners link nothing.
    """
    spark = edges.sparkSession
    weak = F.coalesce(F.col(weak_col).cast("boolean"), F.lit(False)) if weak_col else F.lit(False)
    rows = edges.select(F.col(company_col).cast("string").alias("c"), F.col(partner_col).cast("string").alias("p"), F.col(company_col).alias("_o"), weak.alias("weak"))
    e = staged(rows.where("c IS NOT NULL AND p IS NOT NULL").groupBy("c", "p").agg(F.min("_o").alias("_o"), F.max("weak").alias("weak")), "path-edges")
    tried = e
    if per_partner is not None:
        first = F.row_number().over(Window.partitionBy("p").orderBy("_o", "c"))  # a window group limit
        tried = e.withColumn("_n", first).where(F.col("_n") <= per_partner)
    tried = staged(tried.select("c", "p"), "path-tried")
    edges, own = e.select("c", "p", "weak"), [e, tried]
    ends = staged(_ends(spark, targets, company_col), "path-targets")
    frontier = staged(_ends(spark, sources, company_col).select("at", F.array("at").alias("path"), F.lit(True).alias("strong")), "path-frontier")
    seen, spent, found, near = [frontier.select("at")], None, [], [ends]
    own += [ends, frontier]
    forward, backward, hits, hop = frontier.count(), ends.count(), 0, 0
    while hop < depth and forward and backward and (most is None or hits < most):
        if backward < forward and len(near) <= depth - hop:
            near.append(staged(_backward(edges, tried, near[-1]), "path-near"))
            own.append(near[-1])
            backward = near[-1].count()
            continue
        left = depth - hop
        if left < len(near):  # the targets' side has come so far: only companies near enough to a target go on
            frontier = frontier.join(near[left], "at", "left_semi")
        steps = frontier.join(edges.withColumnRenamed("c", "at"), "at").select("path", "strong", "p", "weak")
        fresh = steps.where("weak") if spent is None else steps.where("weak").join(spent, "p", "left_anti")
        once = fresh.groupBy("p").agg(F.min(F.struct("path", "strong")).alias("first")).select("first.path", "first.strong", "p", F.lit(True).alias("weak"))
        keys = staged(steps.where("NOT weak").unionByName(once), "path-keys")
        spent = keys.where("weak").select("p") if spent is None else spent.unionByName(keys.where("weak").select("p"))
        moves = keys.join(tried.withColumnRenamed("c", "at"), "p").where(~F.array_contains("path", F.col("at")))
        moves = moves.select("at", F.concat("path", F.array("p", "at")).alias("path"), (F.col("strong") & ~F.col("weak")).alias("strong"))
        hop += 1
        made = staged(moves.join(ends, "at", "left_semi").select("path", F.lit(hop).alias("hops"), F.when(F.col("strong"), STRONG).otherwise(HINT).alias("confidence")), "path-found")
        found.append(made)
        own.append(keys)
        hits += made.count()
        if hop < depth and (most is None or hits < most):
            new = reduce(lambda x, y: x.join(y, "at", "left_anti"), seen, moves)
            frontier = staged(new.groupBy("at").agg(F.min(F.struct("path", "strong")).alias("first")).select("at", "first.path", "first.strong"), "path-frontier")
            seen.append(frontier.select("at"))
            own.append(frontier)
            forward = frontier.count()
    drop_staged(*own)
    if not found:
        return spark.createDataFrame([], "path array<string>, hops int, confidence string")
    whole = reduce(DataFrame.unionByName, found)
    return whole if most is None else whole.orderBy("hops", "path").limit(most)
