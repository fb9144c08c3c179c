"""Queries of corpus curation: differences, fingerprints, consensus, impacts, coverage, rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions.text import normalize
from verdigris.operators import curation as C
from verdigris.operators.lexical_index import input_version
from verdigris.queries._registry import query
from verdigris.session import shared_dir
from verdigris.sources.bucketed import BucketedTable

OLD_SQL = "old AS (SELECT doc_id, sha256(CASE WHEN doc_id % 11 = 0 THEN 'x' ELSE text END) AS digest FROM documents WHERE doc_id % 7 <> 0), new AS (SELECT doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 5 <> 0)"


@query(
    f"""WITH {OLD_SQL} SELECT coalesce(old.doc_id, new.doc_id) AS doc_id, CASE WHEN old.doc_id IS NULL THEN 'added' WHEN new.doc_id IS NULL THEN 'removed'
    WHEN old.digest IS NOT DISTINCT FROM new.digest THEN 'same' ELSE 'modified' END AS change FROM old FULL JOIN new ON old.doc_id = new.doc_id"""
)
def registry_diff(table, spark):
    """What changed between two states of a corpus; the states are made from one table."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    docs = table("documents")
    old = docs.where("doc_id % 7 <> 0").select("doc_id", sha(F.when(F.col("doc_id") % 11 == 0, "x").otherwise(F.col("text"))).alias("digest"))
    new = docs.where("doc_id % 5 <> 0").select("doc_id", sha(F.col("text")).alias("digest"))
    return C.registry_diff(old, new, "doc_id", "digest")


@query(
    """WITH p AS (SELECT conv_id, turn, sha256(coalesce(text, '')) AS d FROM conversations)
    SELECT conv_id, count(*)::INT AS n_chunks, sha256(string_agg(turn::VARCHAR || chr(31) || d || chr(10), '' ORDER BY turn, d)) AS fingerprint FROM p GROUP BY conv_id"""
)
def doc_fingerprint(table, spark):
    """One digest for all turns of each conversation."""
    return C.fingerprint(table("conversations"), "conv_id", "turn", "text")


@query(
    """WITH u AS (SELECT c_custkey + 5 AS c_custkey, 'new ' || c_name AS c_name, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 3 = 0)
    SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, c.c_mktsegment FROM customer c WHERE c.c_custkey NOT IN (SELECT c_custkey FROM u)
    UNION ALL SELECT u.c_custkey, u.c_name, u.c_nationkey, coalesce(u.c_acctbal, c.c_acctbal), u.c_mktsegment FROM u LEFT JOIN customer c ON c.c_custkey = u.c_custkey"""
)
def upsert_rows(table, spark):
    """Rows replaced and added by key; a null leaves the old value."""
    current = table("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    updates = current.where("c_custkey % 3 = 0").select(
        (F.col("c_custkey") + 5).alias("c_custkey"),
        F.concat(F.lit("new "), F.col("c_name")).alias("c_name"),
        "c_nationkey",
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_acctbal")).alias("c_acctbal"),
        "c_mktsegment",
    )
    return C.upsert(current, updates, ["c_custkey"], ["c_acctbal"])


@query(
    """WITH u AS (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 5)
    SELECT c_custkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM u) THEN upper(c_name) ELSE c_name END AS c_name, c_acctbal FROM customer WHERE NOT (c_mktsegment = 'MACHINERY' AND c_nationkey = 7)"""
)
def bucketed_changes(table, spark):
    """All customers in a bucketed table, after some were renamed and some deleted there."""
    rows = table("customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "c_nationkey")
    held = BucketedTable(spark, f"{shared_dir(spark)}/customers-{input_version(rows)[:24]}", ["c_custkey"], 64)
    steps = (held.version() or {"number": 0})["number"]
    if steps < 1:
        held.upsert(rows)
    if steps < 2:
        held.upsert(rows.where("c_mktsegment = 'BUILDING' AND c_nationkey < 5").withColumn("c_name", F.upper("c_name")))
    if steps < 3:
        held.delete(rows.where("c_mktsegment = 'MACHINERY' AND c_nationkey = 7"))
    return held.read().select("c_custkey", "c_name", "c_acctbal")


@query(
    """WITH n AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 3 = 1 THEN 'docs/' || upper(replace(c_name, '#', ' ')) || '.PDF' ELSE 'none' || c_custkey::VARCHAR END AS name FROM customer)
    SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey END AS found, CASE c_custkey % 3 WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' END AS matched FROM n"""
)
def exact_then_normalized_join(table, spark):
    """Names met exactly, else in a form without case, marks and folders."""
    key, name = F.col("c_custkey"), F.col("c_name")
    other = F.concat(F.lit("docs/"), F.upper(F.replace(name, F.lit("#"), F.lit(" "))), F.lit(".PDF"))
    rows = table("customer").select(key, F.when(key % 3 == 0, name).when(key % 3 == 1, other).otherwise(F.concat(F.lit("none"), key.cast("string"))).alias("name"))
    lookup = table("customer").select(F.col("c_name").alias("lookup_name"), F.col("c_custkey").alias("found"))
    return C.exact_then_normalized(rows, lookup, "name", "lookup_name", "found").select("c_custkey", "found", "matched")


@query(
    """WITH c AS (SELECT l_orderkey, l_shipdate::DATE AS d, o_orderdate::DATE AS r FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT l_orderkey, strftime(arg_min(d, abs(date_diff('day', r, d)) * 100000 + date_diff('day', DATE '1970-01-01', d)), '%Y-%m-%d') AS consensus, count(*)::BIGINT AS n_candidates FROM c GROUP BY l_orderkey"""
)
def doc_consensus(table, spark):
    """Of each order's dates the one nearest to its reference."""
    orders = table("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.to_date("o_orderdate").alias("r"))
    rows = table("lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("d")).join(orders, "l_orderkey")
    return C.consensus(rows, "l_orderkey", "d", "r").withColumn("consensus", F.date_format("consensus", "yyyy-MM-dd"))


@query(
    """WITH m AS (SELECT o_orderkey AS source, o_custkey AS num, year(o_orderdate) AS y FROM orders),
    t AS (SELECT DISTINCT o_custkey AS num, year(o_orderdate) AS y, o_orderkey AS target FROM orders WHERE o_orderstatus = 'P')
    SELECT DISTINCT source, m.num::BIGINT AS num, m.y::INT AS y, target, CASE WHEN target IS NULL THEN 'target_not_found' ELSE 'target_found' END AS status
    FROM m LEFT JOIN t ON m.num = t.num AND m.y = t.y WHERE target IS NULL OR target <> source"""
)
def impact_join(table, spark):
    """Mentions of acts by number and year with the acts that they name."""
    num, y = F.col("o_custkey").alias("num"), F.year("o_orderdate").alias("y")
    mentions = table("orders").select(F.col("o_orderkey").alias("source"), num, y)
    targets = table("orders").where("o_orderstatus = 'P'").select(num, y, F.col("o_orderkey").alias("target"))
    return C.impacts(mentions, targets, ["num", "y"], "source", "target").select("source", "num", "y", "target", "status")


@query(
    """WITH l AS (SELECT p_brand, p_type, p_name, p_partkey AS found FROM part WHERE p_size <= 5),
    f AS (SELECT p_brand, p_type, min(found) AS a FROM l GROUP BY ALL), p AS (SELECT p_brand, min(found) AS b FROM l GROUP BY p_brand HAVING count(DISTINCT found) = 1),
    n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, min(found) AS c FROM l GROUP BY k)
    SELECT p_partkey, coalesce(a, b, c) AS found, CASE WHEN a IS NOT NULL THEN 'full_key' WHEN b IS NOT NULL THEN 'part_of_key' WHEN c IS NOT NULL THEN 'name' ELSE 'missing' END AS matched
    FROM part LEFT JOIN f USING (p_brand, p_type) LEFT JOIN p USING (p_brand) LEFT JOIN n ON n.k = regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')"""
)
def coverage_match(table, spark):
    """Entries met by a full key, by a part of it that is unique, or by name."""
    rows = table("part").select("p_partkey", "p_brand", "p_type", "p_name")
    lookup = table("part").where("p_size <= 5").select("p_partkey", "p_brand", "p_type", "p_name").withColumnRenamed("p_partkey", "found")
    return C.coverage(rows, lookup, ["p_brand", "p_type"], ["p_brand"], "p_name", "found").select("p_partkey", "found", "matched")


@query(
    """SELECT p_brand, count(*)::BIGINT AS n, bool_or(p_size > 48) AS any_large, max(p_size)::INT AS most, arg_min(p_name, length(p_name)::BIGINT * 10000000 + p_partkey) AS shortest,
    array_to_string(list_slice(list_sort(list_distinct(list(p_type))), 1, 8), '; ') AS types FROM part GROUP BY p_brand"""
)
def distinct_groups(table, spark):
    """Groups with counts, flags, extremes and short lists."""
    return table("part").groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("p_size") > 48).alias("any_large"),
        F.max("p_size").alias("most"),
        F.min_by("p_name", F.struct(F.length("p_name"), "p_partkey")).alias("shortest"),
        F.array_join(F.slice(F.array_sort(F.collect_set("p_type")), 1, 8), "; ").alias("types"),
    )


RULES = [("licence", ["license", "licence"]), ("secret", ["token", "password"]), ("contact", ["@", r"\+[0-9]"])]
RULE_SQL = r"CASE WHEN regexp_matches(lower(text), 'license|licence') THEN 'licence' WHEN regexp_matches(lower(text), 'token|password') THEN 'secret' WHEN regexp_matches(lower(text), '@|\+[0-9]') THEN 'contact' ELSE 'plain' END"


def _labelled(table):
    return table("documents").select("doc_id", "lang", "source", C.first_rule(F.lower("text"), RULES, "plain").alias("area"))


@query(f"SELECT doc_id, {RULE_SQL} AS area FROM documents")
def rule_classification(table, spark):
    """The first rule that fits each document."""
    return _labelled(table).select("doc_id", "area")


@query(
    f"""WITH d AS (SELECT lang, source, {RULE_SQL} AS area FROM documents)
    SELECT 'area' AS "group", area AS value, count(*)::BIGINT AS n FROM d GROUP BY area UNION ALL SELECT 'lang', coalesce(lang, 'null'), count(*) FROM d GROUP BY lang UNION ALL SELECT 'source', coalesce(source, 'null'), count(*) FROM d GROUP BY source"""
)
def classification_summary(table, spark):
    """Counts by label, language and source in one pass."""
    return C.summary(_labelled(table), ["area", "lang", "source"])


CLAUSES = {"licence": "license", "secret": "token|password", "thing": r"\bthat\b"}


@query(
    r"""WITH d AS (SELECT doc_id, lower(strip_accents(text)) AS t FROM documents), r AS (SELECT doc_id, CASE WHEN contains(t, 'license') THEN 'licence' END AS a,
    CASE WHEN regexp_matches(t, 'token|password') THEN 'secret' END AS b, CASE WHEN regexp_matches(t, '(^|[^a-z0-9_\x{80}-\x{10FFFF}])that($|[^a-z0-9_\x{80}-\x{10FFFF}])') THEN 'thing' END AS c FROM d),
    l AS (SELECT doc_id, concat_ws('_', a, b, c) AS s FROM r), k AS (SELECT CASE WHEN s = '' THEN 'none' ELSE 'combo_' || s END AS rule, doc_id FROM l)
    SELECT rule, count(*)::BIGINT AS n, min(doc_id) AS sample FROM k GROUP BY rule"""
)
def clause_labels(table, spark):
    """Combinations of labels with their counts and a sample."""
    rows = table("documents").select("doc_id", C.sentence_labels(F.col("text"), CLAUSES).alias("rule"))
    return rows.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("sample"))


@query("SELECT doc_id, md5(trim(regexp_replace(lower(strip_accents(text)), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM documents")
def normalized_text(table, spark):
    """Texts without accents and case, by digest."""
    return table("documents").select("doc_id", F.md5(normalize(F.col("text")).cast("binary")).alias("digest"))


KIND_SQL = "CASE o_custkey % 3 WHEN 0 THEN 'portaria' WHEN 1 THEN 'decreto' ELSE 'lei' END"


@query(f"SELECT o_orderkey, {KIND_SQL} AS kind, (o_orderkey % 900 + 1)::VARCHAR AS number, year(o_orderdate)::INT AS year FROM orders")
def norm_references(table, spark):
    """Acts named in texts by kind, number and year."""
    from verdigris.functions.legal import norm_references

    kind = F.when(F.col("o_custkey") % 3 == 0, "Portaria nº ").when(F.col("o_custkey") % 3 == 1, "Decreto n. ").otherwise("Lei ")
    said = F.concat(F.lit("Fica revogada a "), kind, (F.col("o_orderkey") % 900 + 1).cast("string"), F.lit("/"), F.year("o_orderdate").cast("string"), F.lit(", e nada mais."))
    found = table("orders").select("o_orderkey", F.explode(norm_references(said)).alias("r"))
    return found.select("o_orderkey", "r.kind", "r.number", "r.year")


@query(
    """WITH l AS (SELECT o_custkey, o_orderkey, o_orderkey % 3 AS k FROM orders),
    a AS (SELECT *, last_value(CASE WHEN k = 1 THEN o_orderkey END IGNORE NULLS) OVER w AS art, last_value(CASE WHEN k = 2 THEN o_orderkey END IGNORE NULLS) OVER w AS par,
      last_value(CASE WHEN k = 0 THEN o_orderkey END IGNORE NULLS) OVER w AS inc FROM l WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
    SELECT o_orderkey, CASE k WHEN 1 THEN 'artigo' WHEN 2 THEN 'paragrafo' ELSE 'inciso' END AS level,
      concat_ws(' > ', 'Artigo Art. ' || art::VARCHAR, CASE WHEN par IS NOT NULL AND (art IS NULL OR par > art) THEN 'Paragrafo § ' || par::VARCHAR END,
      CASE WHEN inc IS NOT NULL AND inc > coalesce(greatest(art, par), art, par, -1) THEN 'Inciso II' END) AS path FROM a"""
)
def device_paths(table, spark):
    """The provision in which each line of an act stands."""
    from verdigris.functions.legal import device_paths

    key = F.col("o_orderkey")
    line = F.when(key % 3 == 1, F.concat(F.lit("Art. "), key.cast("string"), F.lit(". Texto"))).when(key % 3 == 2, F.concat(F.lit("§ "), key.cast("string"), F.lit(" Texto")))
    rows = table("orders").select("o_custkey", "o_orderkey", line.alias("line")).fillna("II - texto", ["line"])
    return device_paths(rows, "o_custkey", "o_orderkey", "line").select("o_orderkey", "level", "path")


@query("SELECT o_orderkey, (o_orderkey % 90 + 1)::INT AS amount, 'day' AS unit, strftime(o_orderdate::DATE + (o_orderkey % 90 + 1)::INT, '%Y-%m-%d') AS start FROM orders")
def relative_starts(table, spark):
    """Delayed entries into force counted from publication."""
    from verdigris.functions.dates import advance
    from verdigris.functions.legal import relative_start

    said = F.concat(F.lit("Esta Portaria entra em vigor após decorridos "), (F.col("o_orderkey") % 90 + 1).cast("string"), F.lit(" dias de sua publicação."))
    rows = table("orders").select("o_orderkey", "o_orderdate", relative_start(said).alias("d"))
    start = advance(F.to_date("o_orderdate"), F.col("d.amount"), F.col("d.unit"))
    return rows.select("o_orderkey", "d.amount", "d.unit", F.date_format(start, "yyyy-MM-dd").alias("start"))


@query(
    """WITH c AS (SELECT c_custkey, 'k' || c_custkey::VARCHAR AS k FROM customer) SELECT count(*)::BIGINT AS n, min(row_id) AS low, max(row_id) AS high, count(DISTINCT row_id)::BIGINT AS ids FROM
    (SELECT (SELECT count(*) FROM c WHERE c_custkey % 4 = 0) - 1 + row_number() OVER () AS row_id FROM c WHERE c_custkey % 4 <> 0)"""
)
def index_new_rows(table, spark):
    """Rows that an index lacks get the ids that follow its greatest."""
    from verdigris.operators.enrichment import number_ids

    rows = table("customer").select(F.concat(F.lit("k"), F.col("c_custkey").cast("string")).alias("k"), "c_custkey")
    empty = spark.createDataFrame([], "k string, row_id long")
    known = number_ids(rows.where("c_custkey % 4 = 0").select("k"), empty, "k", "row_id")
    made = number_ids(rows, known, "k", "row_id")
    return made.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("low"), F.max("row_id").alias("high"), F.count_distinct("row_id").alias("ids"))


@query(
    "WITH e AS (SELECT event_type, date_trunc('day', ts) AS w FROM events) SELECT strftime(w, '%Y-%m-%d') AS day, event_type, count(*)::BIGINT AS n FROM e GROUP BY ALL"
)
def windowed_event_counts(table, spark):
    """Events by kind and day."""
    from verdigris.streaming.incremental import windowed_counts

    return windowed_counts(table("events"), "ts", "event_type", "1 day", "1 hour").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 6 = 0")
def changed_rows(table, spark):
    """Rows that differ between two states."""
    before = table("customer").select("c_custkey", "c_acctbal")
    after = before.withColumn("c_acctbal", F.when(F.col("c_custkey") % 6 == 0, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    changed = C.changed_rows(before, after, "c_custkey", ["c_acctbal"])
    return changed.select("c_custkey", (F.col("c_acctbal") - 1).alias("c_acctbal"))
