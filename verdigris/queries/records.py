"""Queries over records of acts: classes, revocations, coverage, resources. Orders, lines and customers stand for acts and their chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import classification as K
from verdigris.operators import curation as C
from verdigris.operators import lexical
from verdigris.operators import registry as G
from verdigris.operators import revocations as V
from verdigris.operators import temporal as T
from verdigris.operators.settlement import settle_ends
from verdigris.plans import catalogue_answers as A
from verdigris.queries._registry import query

#: Texts of the records by the orders' priority and status, so that all rules have something to hold.
TITLES = {
    "1-URGENT": "portaria sobre lavra de minerio", "2-HIGH": "decreto sobre imposto e divida ativa", "3-MEDIUM": "norma sobre barragem de rejeito",
    "4-NOT SPECIFIED": "regimento interno do comite", "5-LOW": "ato sobre licitacao e contrato",
}
SUMMARIES = {"F": "trata da anm e da cfem", "O": "trata de florestas e recursos hidricos", "P": "trata de dados do sistema eletronico"}
RECORDS_SQL = (
    "r AS (SELECT o_orderkey, CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in TITLES.items())
    + " END AS titulo, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE CASE o_orderstatus "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUMMARIES.items())
    + " END END AS ementa, CASE WHEN o_orderkey % 5 = 0 THEN 'anm' ELSE 'mme' END AS orgao, CASE WHEN o_orderkey % 7 = 0 THEN 'legislacao_consolidada_mineracao' ELSE 'outras' END AS collection_slug,"
    " CASE WHEN o_orderkey % 11 = 0 THEN 'lei 1' ELSE '' END AS textos_referencia_origem FROM orders)"
)


def _cases(column: str, values: dict[str, str]):
    return reduce(lambda otherwise, x: F.when(F.col(column) == x[0], x[1]).otherwise(otherwise), values.items(), F.lit(None).cast("string"))


def records(table):
    each = lambda n, yes, no: F.when(F.col("o_orderkey") % n == 0, yes).otherwise(no)
    return table("orders").select(
        "o_orderkey",
        _cases("o_orderpriority", TITLES).alias("titulo"),
        F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(_cases("o_orderstatus", SUMMARIES)).alias("ementa"),
        each(5, "anm", "mme").alias("orgao"),
        each(7, "legislacao_consolidada_mineracao", "outras").alias("collection_slug"),
        each(11, "lei 1", "").alias("textos_referencia_origem"),
    )


def _holds(column: str, patterns) -> str:
    return f"regexp_matches({column}, '{'|'.join(f'(?:{p})' for p in patterns)}')"


def _ladder(column: str, rules: dict, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {_holds(column, p)} THEN '{label}'" for label, p in rules.items()) + f" ELSE {otherwise} END"


_SANS = "regexp_replace({}, '" + "|".join(f"(?:{p})" for p in K.INSTITUTIONS) + "', ' ', 'g')"
CLASSES_SQL = f"""{RECORDS_SQL}, t AS (SELECT *, trim(concat_ws(' ', titulo, ementa, textos_referencia_origem)) AS content, trim(concat_ws(' ', titulo, ementa)) AS title FROM r),
    f AS (SELECT *, {_ladder("content", K.FAMILIES, "'nao_classificada'")} AS family, {_holds(_SANS.format("content"), K.MINING)} AS mining, {_holds(_SANS.format("title"), K.MINING)} AS strong FROM t),
    a AS (SELECT *, CASE {" ".join(f"WHEN family = '{k}' THEN '{v}'" for k, v in K.AREA_OF_FAMILY.items())}
      ELSE {_ladder("content", K.AREAS, "CASE WHEN mining THEN 'minerario' ELSE 'administrativo_indeterminado' END")} END AS area FROM f),
    c AS (SELECT o_orderkey, area, family, CASE WHEN strong OR family NOT IN ('institucional_anm_dnpm', 'nao_classificada') THEN 'direta/alta'
      WHEN collection_slug = 'legislacao_consolidada_mineracao' AND mining THEN 'direta/media'
      WHEN (orgao = 'anm' OR collection_slug LIKE '%minera%' AND regexp_matches(collection_slug, '\\b(anm|dnpm|minera)')) AND area LIKE 'administrativo%' THEN 'indireta/media'
      WHEN mining THEN 'indireta/media' WHEN textos_referencia_origem <> '' THEN 'referenciada/media' ELSE 'sem_relacao_identificada/baixa' END AS relation FROM a)"""


@query(f"WITH {CLASSES_SQL} SELECT * FROM c")
def classify_records(table, spark):
    """Area, family and relation of each record."""
    rows = K.classify(records(table))
    return rows.select("o_orderkey", "area", "family", F.concat_ws("/", "relation", "confidence").alias("relation"))


#: A revocation in an order's text: as a line of its own, in a clause, or not at all.
HEAD_SQL = """h AS (SELECT o_orderkey, (o_orderkey % 900 + 1)::VARCHAR AS n, year(o_orderdate)::INT AS y, CASE WHEN o_orderpriority LIKE '1%' THEN 'line' WHEN o_orderpriority LIKE '2%' THEN 'inline' END AS mode,
    CASE WHEN o_orderstatus = 'P' THEN 'parcialmente_revogado' ELSE 'revogado' END AS status FROM orders)"""


def heads(table):
    key, year = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    said = F.concat(F.when(F.col("o_orderstatus") == "P", "Parcialmente revogada pela ").otherwise("Revogada pela "), F.lit("Portaria nº "), (key % 900 + 1).cast("string"), F.lit("/"), year)
    line = F.concat(F.lit("Norma de teste\n\n"), said, F.lit("\nArt. 1"))
    clause = F.concat(F.lit("Esta norma, "), said, F.lit(". Art. 1"))
    text = F.when(F.col("o_orderpriority").startswith("1"), line).when(F.col("o_orderpriority").startswith("2"), clause).otherwise("Norma em vigor.")
    return table("orders").select("o_orderkey", "o_custkey", text.alias("text"))


@query(f"WITH {HEAD_SQL} SELECT o_orderkey, status, mode, 'portaria' AS kind, n AS number, y AS year FROM h WHERE mode IS NOT NULL")
def head_revocations(table, spark):
    """What the heads of texts say of their revocation."""
    found = heads(table).select("o_orderkey", V.head_revocation(F.col("text")).alias("h")).where("h is not null")
    return found.select("o_orderkey", "h.status", "h.mode", "h.kind", "h.number", "h.year")


@query(
    """WITH m AS (SELECT o_orderkey AS doc, o_custkey AS number, year(o_orderdate)::INT AS year, o_orderpriority AS said FROM orders),
    a AS (SELECT o_orderkey AS target, o_orderpriority AS name, o_orderstatus AS title, o_custkey AS number, year(o_orderdate)::INT AS year FROM orders),
    s AS (SELECT doc, target, name, CASE WHEN said = name THEN 100 ELSE 0 END + CASE WHEN contains(name, number::VARCHAR) THEN 15 ELSE 0 END + CASE WHEN contains(title, number::VARCHAR) THEN 15 ELSE 0 END
      + CASE WHEN contains(name, year::VARCHAR) THEN 10 ELSE 0 END + 1 AS score FROM m JOIN a USING (number, year) WHERE doc <> target)
    SELECT doc, target, score::INT AS score FROM s QUALIFY row_number() OVER (PARTITION BY doc ORDER BY score DESC, lower(name) DESC, target) = 1"""
)
def revoker_choice(table, spark):
    """Of the acts of a mention's number and year the one that fits best: names are the orders' priorities."""
    key = [F.lit("portaria").alias("kind"), F.col("o_custkey").alias("number"), F.year("o_orderdate").alias("year")]
    mentions = table("orders").select(F.col("o_orderkey").alias("doc"), F.col("o_orderpriority").alias("said"), *key)
    acts = table("orders").select(F.col("o_orderkey").alias("target"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("title"), *key)
    return V.best_revokers(mentions, acts, "doc")


@query(
    """WITH RECURSIVE o AS (SELECT o_orderkey AS k, o_orderdate::DATE AS p, o_orderdate::DATE + (floor(o_totalprice)::BIGINT % 90)::INT AS s, CASE WHEN o_orderstatus = 'F' THEN o_orderdate::DATE + 30 END AS e,
      lead(o_orderkey) OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY o_orderdate, o_orderkey) AS b FROM orders),
    r(k, s, ends, who, begins, state) AS (SELECT k, s, e, NULL::BIGINT, NULL::DATE, 'stated' FROM o WHERE b IS NULL UNION ALL
      SELECT k, s, CASE WHEN begins >= p THEN begins ELSE e END, who, begins, 'settled' FROM (SELECT o.k, o.s, o.p, o.e, CASE WHEN r.ends <= r.s AND r.who IS NOT NULL THEN r.who ELSE r.k END AS who,
        CASE WHEN r.ends <= r.s AND r.who IS NOT NULL THEN r.begins ELSE r.s END AS begins FROM r JOIN o ON o.b = r.k))
    SELECT k AS o_orderkey, ends AS settled_end, who AS settled_by, state FROM r"""
)
def settled_ends(table, spark):
    """Ends along chains of revokers: an order is revoked by its customer's next of the year, which starts some days after its date."""
    after = Window.partitionBy("o_custkey", F.year("o_orderdate")).orderBy("o_orderdate", "o_orderkey")
    day = F.to_date("o_orderdate")
    start = F.date_add(day, (F.floor("o_totalprice") % 90).cast("int"))
    acts = table("orders").select("o_orderkey", F.lead("o_orderkey").over(after).alias("by"), day.alias("published"), start.alias("start"), F.when(F.col("o_orderstatus") == "F", F.date_add(day, 30)).alias("end"))
    return settle_ends(acts, "o_orderkey", "by", "published", "start", "end").select("o_orderkey", "settled_end", "settled_by", "state")


BEST_SQL = f"""{HEAD_SQL}, b AS (SELECT o_custkey AS doc, o_orderkey, mode, n, y FROM h JOIN orders USING (o_orderkey) WHERE mode IS NOT NULL),
    best AS (SELECT *, count(*) OVER (PARTITION BY doc)::BIGINT AS chunks, 'portaria nº ' || n || '/' || y AS said FROM b
      QUALIFY row_number() OVER (PARTITION BY doc ORDER BY CASE mode WHEN 'line' THEN 3 ELSE 1 END DESC, length(n), o_orderkey) = 1)"""


def best(table):
    found = heads(table).select("o_orderkey", F.col("o_custkey").alias("doc"), V.head_revocation(F.col("text")).alias("h"))
    rows = found.select("o_orderkey", "doc", F.lower("h.said").alias("said"), "h.mode", "h.kind", "h.number", "h.year", "h.date", F.lit(1).alias("confidence"))
    # A clause's mention goes on to its end of sentence; here both end at the year.
    return V.best_rows(rows, "doc", "o_orderkey")


@query(f"WITH {BEST_SQL} SELECT doc, said, mode, chunks, CASE mode WHEN 'line' THEN 'alta' ELSE 'baixa' END AS quality FROM best")
def best_revocations(table, spark):
    """For each document the chunk that says best by what it was revoked."""
    return best(table).select("doc", "said", "mode", "chunks", "quality")


REVOKERS_SQL = f"""{BEST_SQL}, k AS (SELECT doc, said, mode, n || '/' || y AS key FROM best), o AS (SELECT DISTINCT (o_orderkey % 900 + 1)::VARCHAR || '/' || year(o_orderdate) AS key, o_orderpriority AS found FROM orders WHERE o_orderstatus = 'O'),
    u AS (SELECT key, list_sort(list(found)) AS names FROM o GROUP BY key),
    d AS (SELECT key, min(said) AS said, bool_or(mode = 'line') AS high, array_to_string(list_sort(list_distinct(list(mode))), ', ') AS modes, count(*)::BIGINT AS revoked,
      array_to_string(list_sort(list(doc::VARCHAR)), ' | ') AS docs FROM k GROUP BY key)"""


def revokers(table):
    rows = best(table).withColumn("key", F.concat_ws("/", "number", "year"))
    held = table("orders").where("o_orderstatus = 'O'").select(F.concat_ws("/", (F.col("o_orderkey") % 900 + 1).cast("string"), F.year("o_orderdate").cast("string")).alias("key"), "o_orderpriority")
    found = held.groupBy("key").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("found_orders"))
    rows = rows.join(found, "key", "left").withColumn("in_orders", F.col("found_orders").isNotNull()).withColumn("doc", F.col("doc").cast("string"))
    return V.distinct_revokers(rows.withColumn("found_orders", F.coalesce("found_orders", F.array().cast("array<string>"))), ["orders"])


@query(
    f"""WITH {REVOKERS_SQL} SELECT key, said, TRUE AS complete, CASE WHEN high THEN 'alta' ELSE 'baixa' END AS quality, modes, revoked, docs, names IS NOT NULL AS in_orders,
    coalesce(array_to_string(list_slice(names, 1, 8), ' | '), '') AS found_orders FROM d LEFT JOIN u USING (key)"""
)
def distinct_revokers(table, spark):
    """Revokers with all documents that they revoke and where they are held."""
    return revokers(table)


@query(
    f"""WITH {REVOKERS_SQL}, j AS (SELECT d.*, names IS NOT NULL AS held FROM d LEFT JOIN u USING (key)),
    v AS (SELECT sum(revoked) AS a, count(*) AS b, count(*) FILTER (WHERE held) AS c, count(*) FILTER (WHERE NOT held) AS e, count(*) AS f, count(*) FILTER (WHERE NOT high) AS g FROM j)
    SELECT unnest(['base', 'revoked_with_revoker', 'distinct_revokers', 'present_in_orders', 'absent_in_orders', 'complete_keys', 'low_quality']) AS metric,
    unnest(['orders', a::BIGINT::VARCHAR, b::VARCHAR, c::VARCHAR, e::VARCHAR, f::VARCHAR, g::VARCHAR]) AS value FROM v"""
)
def coverage_metrics(table, spark):
    """Numbers over all revokers."""
    return V.coverage_metrics(revokers(table), ["orders"], {"base": "orders"})


@query(
    """WITH e AS (SELECT l_orderkey, l_linenumber, l_returnflag = 'R' AS passive, CASE WHEN l_linestatus = 'F' THEN '' ELSE 'Artigo ' || l_linenumber END AS path FROM lineitem)
    SELECT l_orderkey, CASE WHEN NOT bool_or(passive) THEN 'vigente' WHEN bool_or(passive AND path = '') THEN 'revogado' ELSE 'parcialmente_revogado' END AS status,
    CASE WHEN NOT bool_or(passive) THEN '' WHEN bool_or(passive AND path = '') THEN 'total' ELSE 'parcial' END AS scope,
    coalesce('Portaria ' || coalesce(min(l_linenumber) FILTER (WHERE passive AND path = ''), min(l_linenumber) FILTER (WHERE passive)), '') AS said, bool_or(passive AND path <> '') AS partial FROM e GROUP BY l_orderkey"""
)
def passive_revocations(table, spark):
    """What became of each act by the events of its lines."""
    rows = table("lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_returnflag") == "R", "revogacao").otherwise("alteracao").alias("event"),
        F.lit("passiva").alias("direction"),
        F.when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("Artigo "), F.col("l_linenumber").cast("string"))).alias("path"),
        F.concat(F.lit("Portaria "), F.col("l_linenumber").cast("string")).alias("said"),
    )
    return V.passive_summary(rows, "l_orderkey", "l_linenumber").select("l_orderkey", "status", "scope", "said", "partial")


@query("SELECT o_custkey AS act, count(*)::BIGINT AS times FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_custkey ORDER BY times DESC, act")
def missing_acts(table, spark):
    """Acts that are referred to and not held, the most wanted first."""
    held = table("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("act"))
    return V.missing_acts(table("orders").select(F.col("o_custkey").alias("act")), held, "act")


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, o_orderdate::DATE AS p, CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'A' THEN o_orderdate::DATE ELSE l_shipdate::DATE END AS d FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
    f AS (SELECT *, CASE WHEN d IS NULL OR d <= p THEN p + 1 ELSE d END AS e FROM s)
    SELECT l_orderkey, l_linenumber, strftime(e, '%Y-%m-%d') AS start, greatest(date_diff('day', p, e), 1)::INT AS vacatio_days, d IS NULL OR d <= p AS changed FROM f"""
)
def vacatio_fixes(table, spark):
    """Starts that must lie after publication, and the days between."""
    rows = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    start = F.when(F.col("l_returnflag") == "N", F.lit(None)).when(F.col("l_returnflag") == "A", F.to_date("o_orderdate")).otherwise(F.to_date("l_shipdate"))
    sheet = rows.select("l_orderkey", "l_linenumber", F.to_date("o_orderdate").alias("published"), start.alias("start"))
    fixed = V.mend_starts(sheet, "published", "start")
    return fixed.select("l_orderkey", "l_linenumber", F.date_format("start", "yyyy-MM-dd").alias("start"), "vacatio_days", "changed")


@query("SELECT conv_id, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, coalesce(text, ''))) AS digest FROM conversations GROUP BY conv_id")
def document_texts(table, spark):
    """Whole texts put together from their chunks."""
    return lexical.document_texts(table("conversations"), "conv_id", ["turn"]).select("conv_id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND lang = 'en' AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def two_layer_filter(table, spark):
    """A base result narrowed by every active refinement."""
    base = table("documents").where(F.contains(F.lower("text"), F.lit("the")))
    return lexical.refined(base, [table("documents").where("lang = 'en'"), table("labels").where("quality = 1")], ["doc_id"]).select("doc_id")


@query("SELECT page_id FROM pages WHERE contains(url, '/en/') OR contains(html, '<h1>')")
def name_or_content(table, spark):
    """Pages that match by name or by content."""
    pages = table("pages")
    return lexical.by_name_or_content(pages.where(F.contains("url", F.lit("/en/"))), pages.where(F.contains("html", F.lit("<h1>"))), "page_id")


@query("WITH c AS (SELECT 'doc' || l_orderkey || '::' || l_linenumber AS chunk FROM lineitem) SELECT chunk FROM c WHERE NOT (starts_with(chunk, 'doc1') OR starts_with(chunk, 'doc25'))")
def delete_by_prefix(table, spark):
    """Chunks left after documents are deleted by the beginning of their ids."""
    chunks = table("lineitem").select(F.concat(F.lit("doc"), F.col("l_orderkey").cast("string"), F.lit("::"), F.col("l_linenumber").cast("string")).alias("chunk"))
    return C.delete_by_prefix(chunks, ["doc1", "doc25"], "chunk")


STATUS_TEXT = {"F": "Não normativo", "O": "Em vigor", "P": ""}


@query(
    """SELECT o_orderkey, o_orderstatus <> 'P' OR o_orderpriority LIKE '1%' AS has_metadata, o_orderstatus <> 'F' AS effective,
    CASE WHEN o_orderstatus = 'F' THEN FALSE ELSE o_orderpriority LIKE '1%' END AS in_clauses FROM orders"""
)
def normative_predicates(table, spark):
    """Whether records are ones of acts: by any metadata, by status, for the analysis of clauses."""
    status = _cases("o_orderstatus", STATUS_TEXT)
    rows = table("orders").select("o_orderkey", status.alias("status_normativo"), F.when(F.col("o_orderpriority").startswith("1"), "Lei").alias("tipo_norma"), F.array().cast("array<string>").alias("revoga"))
    columns = dict(rows.dtypes)
    s = F.col("status_normativo")
    return rows.select("o_orderkey", T.has_act_metadata(columns).alias("has_metadata"), T.effectively_normative(s).alias("effective"), T.clause_normative(s, F.col("tipo_norma"), F.lit(None).cast("string")).alias("in_clauses"))


DATASETS_SQL = """d AS (SELECT s_suppkey AS id, 'Base ' || s_name AS title, n_name AS organisation FROM supplier JOIN nation ON n_nationkey = s_nationkey),
    x AS (SELECT p_partkey, p_name AS name, p_brand AS format, CASE WHEN p_size > 10 THEN p_partkey % 120 END AS dataset_id, CASE WHEN p_size > 25 THEN 't' || p_partkey END AS table_name, CASE WHEN p_size < 5 THEN p_size END AS imported_rows FROM part)"""


def _catalogue(table):
    datasets = table("supplier").join(table("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.lit("Base "), "s_name").alias("title"), F.col("n_name").alias("organisation"))
    size, key = F.col("p_size"), F.col("p_partkey")
    resources = table("part").select(
        "p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("format"), F.when(size > 10, key % 120).alias("dataset_id"),
        F.when(size > 25, F.concat(F.lit("t"), key.cast("string"))).alias("table_name"), F.when(size < 5, size).alias("imported_rows"),
    )
    return datasets, resources


@query(
    f"""WITH {DATASETS_SQL} SELECT p_partkey, x.name, title AS dataset_title FROM x LEFT JOIN d ON d.id = dataset_id
    WHERE (contains(lower(name), 'red') OR contains(lower(coalesce(title, '')), 'red') OR contains(lower(format), 'red')) AND (contains(lower(name), 'supplier') OR contains(lower(coalesce(title, '')), 'supplier') OR contains(lower(format), 'supplier'))
    ORDER BY dataset_title NULLS FIRST, name, p_partkey LIMIT 1000000"""
)
def resources_search(table, spark):
    """Resources by words in their name, their data set's title or their format."""
    datasets, resources = _catalogue(table)
    return A.resources_of(resources, datasets, "quais recursos red supplier", 1_000_000).select("p_partkey", "name", "dataset_title")


@query(f"WITH {DATASETS_SQL} SELECT p_partkey, title FROM x LEFT JOIN d ON d.id = dataset_id WHERE table_name IS NOT NULL OR imported_rows > 0")
def imported_resources(table, spark):
    """Resources that were imported, beside their data sets."""
    datasets, resources = _catalogue(table)
    rows = A.imported_only(resources).join(datasets, F.col("dataset_id") == F.col("id"), "left")
    return rows.select("p_partkey", "title")


@query(f"WITH {DATASETS_SQL} SELECT id FROM d WHERE contains(lower(title || ' ' || organisation), 'an') OR contains(lower(title || ' ' || organisation), '00007')")
def owned_datasets(table, spark):
    """Data sets of an owner, by what their texts hold."""
    datasets, _ = _catalogue(table)
    return datasets.where(A.owned_by(F.col("title"), F.lit(None).cast("string"), F.col("organisation"), "an", "00007")).select("id")


@query(
    """SELECT l_returnflag AS run, count(DISTINCT l_partkey)::BIGINT AS resources, sum(l_quantity)::BIGINT AS rows, count(*) FILTER (WHERE l_linestatus = 'F')::BIGINT AS errors FROM lineitem GROUP BY l_returnflag"""
)
def import_statistics(table, spark):
    """Resources, rows and errors of each run of an import."""
    log = table("lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_partkey").alias("resource"), F.col("l_quantity").cast("long").alias("rows"), F.when(F.col("l_linestatus") == "F", "failed").alias("error"))
    return A.run_statistics(log)


@query("SELECT o_orderkey, strftime(o_orderdate::DATE, '%Y-%m-%d') AS stamped, 'Norma ' || o_orderkey AS text FROM orders")
def print_stamps(table, spark):
    """Texts without the date of a print at their head, and that date."""
    text = F.concat(F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 10:31  Norma  "), F.col("o_orderkey").cast("string"))
    rows = table("orders").select("o_orderkey", text.alias("t"))
    return rows.select("o_orderkey", F.date_format(V.stamp_date(F.col("t")), "yyyy-MM-dd").alias("stamped"), V.without_stamp(F.col("t")).alias("text"))


@query("SELECT page_id, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, string_split(url || ' | other', '|')[1].trim() AS first FROM pages WHERE contains(url, 'page=')")
def url_values(table, spark):
    """Parameters of URLs, and the first of several URLs."""
    rows = table("pages").where(F.contains("url", F.lit("page=")))
    return rows.select("page_id", X.url_value(F.col("url"), "page").alias("page"), X.first_url(F.concat("url", F.lit(" | other"))).alias("first"))


@query("SELECT p_partkey, array_to_string(list_filter(regexp_extract_all(lower(strip_accents(p_name)), '[a-z0-9]+'), lambda w: w NOT IN ('a','as','da','das','de','do','dos','e','em','o','os','cia','companhia','eireli','ltda','me','epp','sa','limitada')), ' ') AS name FROM part")
def company_name_function(table, spark):
    """Names in a common form by the function that SQL can call."""
    X.register_functions(spark)
    return table("part").select("p_partkey", F.expr("company_name(p_name)").alias("name"))


@query("SELECT s_suppkey, s_name FROM supplier WHERE contains(lower(s_name), 'supplier') AND contains(lower(s_name), '7')")
def partners_by_name(table, spark):
    """Partners whose names hold all words asked for."""
    return G.partners_by_name(table("supplier"), "s_name", ["supplier", "7"]).select("s_suppkey", "s_name")


@query(
    """SELECT c_custkey, c_name || ' (' || c_custkey || ')' AS label, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P') ON o_custkey = c_custkey WHERE contains(lower(c_name), '0001')"""
)
def named_companies(table, spark):
    """Companies found by name with their seats."""
    found = table("customer").where(F.contains(F.lower("c_name"), F.lit("0001")))
    seats = table("orders").withColumnRenamed("o_custkey", "c_custkey")
    rows = G.named_companies(found, seats, "c_custkey", (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "P"))
    return rows.select("c_custkey", G.company_label(F.col("c_name"), F.col("c_custkey")).alias("label"), "o_orderkey")
