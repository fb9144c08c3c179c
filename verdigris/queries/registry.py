"""Queries over a registry: customers as companies, orders as establishments, suppliers as partners."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import registry as G
from verdigris.operators.likeness import alike_names
from verdigris.operators.name_index import name_index_for
from verdigris.operators.paths import paths_between
from verdigris.plans import catalog
from verdigris.queries._registry import query


@query("SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_custkey = 37")
def registry_point_lookup(table, spark):
    """One company with its establishments; the key reaches both scans."""
    rows = table("customer").where("c_custkey = 37")
    return rows.join(table("orders"), rows["c_custkey"] == F.col("o_custkey"), "left").select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 50")
def registry_list(table, spark):
    """A filtered list in order, with its company's name."""
    best = table("orders").where("o_orderstatus = 'P'").orderBy("o_orderkey").limit(50)
    return best.join(table("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, c_name, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
def registry_hq_join(table, spark):
    """All companies, with those establishments that are headquarters: the test stays in the join."""
    hq = table("orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'")
    return table("customer").join(hq, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "c_name", "o_orderkey")


EDGES = "e AS (SELECT DISTINCT o_custkey AS c, l_suppkey AS p FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _edges(table):
    lines = table("lineitem").select("l_orderkey", F.col("l_suppkey").alias("p"))
    return lines.join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("c"), "p").distinct()


@query(f"WITH {EDGES} SELECT p, c, c_name, n_name FROM e JOIN customer ON c_custkey = c LEFT JOIN nation ON n_nationkey = c_nationkey WHERE p = (SELECT min(p) FROM e)")
def partner_companies(table, spark):
    """Companies of one partner, with their names and places."""
    edges = _edges(table)
    rows = edges.join(F.broadcast(edges.agg(F.min("p").alias("p"))), "p").join(table("customer"), F.col("c") == F.col("c_custkey"))
    return rows.join(table("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("p", "c", "c_name", "n_name")


LINK_FROM = "(SELECT min(c) FROM e)"


@query(f"WITH {EDGES} SELECT DISTINCT b.p, b.c FROM e a JOIN e b ON a.p = b.p AND b.c <> a.c WHERE a.c = {LINK_FROM}")
def linked_companies(table, spark):
    """Companies that share a partner with one company."""
    edges = _edges(table)
    first = edges.agg(F.min("c")).first()[0]
    return G.linked(edges, first, "c", "p", None)


@query(
    """WITH g AS (SELECT DISTINCT l_partkey AS c, l_suppkey AS p, s_acctbal < 0 AS weak FROM lineitem JOIN supplier ON s_suppkey = l_suppkey),
    n AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY p ORDER BY c) <= 100), t AS (SELECT max(c) AS lo, min(c) AS hi FROM g),
    s1 AS (SELECT o.c AS node, [lo::VARCHAR, a.p::VARCHAR, o.c::VARCHAR] AS path, NOT a.weak AS strong FROM t JOIN g a ON a.c = lo JOIN n o ON o.p = a.p WHERE o.c <> lo),
    f1 AS (SELECT node, min(path) AS path, arg_min(strong, path) AS strong FROM s1 GROUP BY node),
    k2 AS (SELECT path, strong, a.p, a.weak FROM f1 JOIN g a ON a.c = f1.node WHERE NOT (a.weak AND a.p IN (SELECT x.p FROM g x, t WHERE x.c = t.lo))
      QUALIFY NOT a.weak OR row_number() OVER (PARTITION BY a.p ORDER BY path) = 1),
    s2 AS (SELECT o.c AS node, list_concat(path, [k2.p::VARCHAR, o.c::VARCHAR]) AS path, strong AND NOT k2.weak AS strong FROM k2 JOIN n o ON o.p = k2.p WHERE NOT list_contains(path, o.c::VARCHAR)),
    h AS (SELECT path, 1 AS hops, strong FROM s1, t WHERE node = hi UNION ALL SELECT path, 2, strong FROM s2, t WHERE node = hi)
    SELECT array_to_string(path, ' -> ') AS path, hops::INT AS hops, CASE WHEN strong THEN 'forte' ELSE 'indicio' END AS confidence FROM h ORDER BY hops, h.path LIMIT 20"""
)
def relationship_paths(table, spark):
    """The first paths of up to two shared suppliers from the last part to the first; suppliers in debt count as known by name alone."""
    suppliers = table("supplier").select(F.col("s_suppkey").alias("p"), (F.col("s_acctbal") < 0).alias("weak"))
    edges = table("lineitem").select(F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("p")).distinct().join(suppliers, "p")
    ends = edges.agg(F.max("c").alias("lo"), F.min("c").alias("hi"))
    found = paths_between(edges, ends.select(F.col("lo").alias("c")), ends.select(F.col("hi").alias("c")), "c", "p", 2, most=20, weak_col="weak")
    return found.select(G.path_label(F.col("path")).alias("path"), "hops", "confidence")


@query("SELECT count(*)::BIGINT AS total FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= 1000 AND c_name LIKE 'Customer#0000%'")
def count_filtered(table, spark):
    """A count under validated filters."""
    keep = G.predicate({"c_mktsegment": ("equals", "BUILDING"), "c_acctbal": ("from", 1000), "c_name": ("prefix", "Customer#0000")})
    return table("customer").where(keep).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT c_nationkey, count(*)::BIGINT AS total FROM customer GROUP BY c_nationkey ORDER BY total DESC, c_nationkey LIMIT 10")
def count_by_group(table, spark):
    """The largest groups."""
    return G.count_by(table("customer"), "c_nationkey", 10)


@query(
    """WITH t AS (SELECT c_mktsegment, CASE WHEN c_custkey % 11 = 0 THEN 'n/d' ELSE (floor(c_acctbal)::BIGINT)::VARCHAR || ',25' END AS v FROM customer)
    SELECT c_mktsegment, coalesce(sum(coalesce(TRY_CAST(replace(replace(v, '.', ''), ',', '.') AS DOUBLE), 0)), 0) AS total FROM t GROUP BY c_mktsegment"""
)
def sum_locale_numeric(table, spark):
    """Sums of numbers written with a decimal comma; other texts count 0."""
    v = F.when(F.col("c_custkey") % 11 == 0, "n/d").otherwise(F.concat(F.floor("c_acctbal").cast("string"), F.lit(",25")))
    return table("customer").groupBy("c_mktsegment").agg(F.sum(X.locale_number(v)).alias("total"))


NAME_SQL = r"""n AS (SELECT p_partkey, p_name, list_filter(regexp_extract_all(lower(p_name), '[a-z0-9]+'), lambda w: w NOT IN ('a','as','da','das','de','do','dos','e','em','o','os','cia','companhia','eireli','ltda','me','epp','sa','limitada')) AS t FROM part),
    q(w) AS (VALUES {words}),
    s AS (SELECT p_partkey, p_name, sum(CASE WHEN list_contains(t, w) THEN 4 WHEN length(w) >= 3 AND len(list_filter(t, lambda c: starts_with(c, w) OR starts_with(w, c))) > 0 THEN 2 ELSE 0 END) AS a, any_value(array_to_string(t, ' ')) AS name FROM n, q GROUP BY p_partkey, p_name),
    m AS (SELECT p_partkey, (CASE WHEN name = '' THEN 0 ELSE a + CASE WHEN name = '{all}' THEN 12 WHEN contains(name, '{all}') OR contains('{all}', name) THEN 6 ELSE 0 END END)::INT AS match FROM s)"""


@query("WITH " + NAME_SQL.format(words="('part'), ('blue'), ('steel')", all="part blue steel") + " SELECT p_partkey, match FROM m")
def name_match_score(table, spark):
    """A score of each name against a query."""
    return table("part").select("p_partkey", X.match_score(["part", "blue", "steel"], X.company_tokens(F.col("p_name"))).alias("match"))


@query("WITH " + NAME_SQL.format(words="('wid'), ('red')", all="wid red") + " SELECT p_partkey, match FROM m WHERE match > 0 ORDER BY match DESC, p_partkey LIMIT 20")
def name_prefix_search(table, spark):
    """The best names for a query with a beginning of a word: ranges of the name index make the candidates."""
    return name_index_for(table("part"), "p_partkey", "p_name").search(["wid", "red"], 20).withColumnRenamed("id", "p_partkey")


@query(
    r"""WITH n AS (SELECT p_partkey, p_name, regexp_extract_all(lower(p_name), '[a-z0-9]+') AS t FROM part)
    SELECT p_partkey, p_name FROM n WHERE len(list_filter(t, lambda c: starts_with(c, 'gi'))) > 0 AND len(list_filter(t, lambda c: starts_with(c, 's'))) > 0"""
)
def name_all_prefixes(table, spark):
    """Names that hold a token with each of two beginnings: the rows of two ranges, intersected."""
    found = name_index_for(table("part"), "p_partkey", "p_name").with_all(["gi", "s"]).withColumnRenamed("id", "p_partkey")
    return table("part").join(found, "p_partkey").select("p_partkey", "p_name")


@query(
    """WITH n AS (SELECT DISTINCT p_name AS name FROM part), t AS (SELECT name, '##' || lower(trim(name)) || '##' AS t FROM n),
    g AS (SELECT name, list_distinct(list_transform(range(1, length(t) - 1), lambda i: substr(t, i::INT, 3))) AS g FROM t),
    p AS (SELECT x.name AS a, y.name AS b, len(list_intersect(x.g, y.g)) AS k, len(x.g) + len(y.g) AS s FROM g x JOIN g y ON x.name <> y.name)
    SELECT a, b, round(k / (s - k)::DOUBLE, 6) AS likeness FROM p WHERE k / (s - k)::DOUBLE >= 0.5 - 1e-9"""
)
def alike_part_names(table, spark):
    """The names of parts that share half of their letter groups or more."""
    return alike_names(table("part"), table("part"), "p_name", 0.5)


@query("SELECT s_suppkey, s_name, n_name, r_name FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def lookup_join(table, spark):
    """Codes with their descriptions."""
    rows = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return rows.join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left").select("s_suppkey", "s_name", "n_name", "r_name")


SAFE = "SELECT n_name, count(*) AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query("SELECT n_name, count(*)::BIGINT AS customers FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n_name LIMIT 100")
def safe_sql(table, spark):
    """A statement that passed the guard, with a row limit and a time limit."""
    for name in ("customer", "nation"):
        table(name).createOrReplaceTempView(name)
    return catalog.run_guarded(spark, SAFE, 100, 300)


@query(
    " UNION ALL ".join(f"SELECT '{t}' AS name, (SELECT count(*) FROM {t})::BIGINT AS rows, {n} AS columns" for t, n in (("region", 2), ("nation", 3), ("customer", 5), ("orders", 6)))
)
def catalog_overview(table, spark):
    """Tables with their rows and columns."""
    return catalog.overview(spark, {n: table(n) for n in ("region", "nation", "customer", "orders")})
