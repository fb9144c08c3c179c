"""Queries over texts: tokens, postings, boolean search, names, chunks, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import html as H
from verdigris.functions import text as X
from verdigris.operators import context, lexical
from verdigris.operators.index_segments import SegmentedIndex
from verdigris.operators.lexical_index import LexicalIndex, index_for, input_version
from verdigris.plans import boolean_query as Q
from verdigris.queries._registry import ORACLES, query
from verdigris.session import shared_dir

TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
WORDS = f"WITH d AS (SELECT *, {TOKENS} AS t FROM documents)"
EXPLODED = f"{WORDS}, w AS (SELECT doc_id, source, unnest(t) AS token, generate_subscripts(t, 1) AS pos FROM d)"
LINES = r"""WITH l AS (SELECT doc_id, regexp_extract_all(lower(line), '[\p{L}\p{N}_]+') AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))"""
PHRASE = ["of", "the"]
TERMS = ["the", "la", "der", "que", "with"]


def documents_index(table) -> LexicalIndex:
    """The documents' index: built by the first query that needs it, read by all others."""
    return index_for(table("documents"), "doc_id")


def updated_index(table) -> LexicalIndex:
    """The documents' index as an update leaves it: the version before lacked a tenth, had other texts in a tenth and had others besides.

    It is made once for a version of the documents' files; the update tokenises what it adds and changes alone.
    """
    docs = table("documents")
    index = SegmentedIndex(docs.sparkSession, f"{shared_dir(docs.sparkSession)}/index-segments-{input_version(docs)[:24]}")
    if index.version().number < 2:
        turn = F.pmod(F.xxhash64("doc_id"), F.lit(10))
        text = F.when(turn == 1, F.concat(F.coalesce("text", F.lit("")), F.lit(" with some of the words of before"))).otherwise(F.col("text"))
        before = docs.where(turn != 0).select("doc_id", text.alias("text"))
        index.update(before.unionByName(docs.where(turn == 2).select((-1 - F.col("doc_id")).alias("doc_id"), "text")), "doc_id")
        index.update(docs, "doc_id")
    return index.open()


def _lines(table):
    return table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(f"{WORDS} SELECT doc_id, len(t)::INT AS n_tokens, len(list_distinct(t))::INT AS n_distinct FROM d")
def tokenize_counts(table, spark):
    """Tokens and distinct tokens of each document."""
    rows = lexical.with_tokens(table("documents"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.size(F.array_distinct("tokens")).alias("n_distinct"))


@query(f"{EXPLODED} SELECT token, count(DISTINCT doc_id)::BIGINT AS df, count(*)::BIGINT AS tf, max(pos - 1)::INT AS last_position FROM w GROUP BY token")
def postings_stats(table, spark):
    """The positional index, summed for each token."""
    return documents_index(table).postings.groupBy("token").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max(F.array_max("positions")).alias("last_position")
    )


@query(f"{EXPLODED} SELECT doc_id, count(*)::INT AS tf, min(pos - 1)::INT AS first_position FROM w WHERE token = 'with' GROUP BY doc_id")
def term_lookup(table, spark):
    """Documents that hold one word, with its frequency and first place."""
    return documents_index(table).of(["with"]).select(F.col("id").alias("doc_id"), "tf", F.col("positions")[0].alias("first_position"))


def _matching(table, text):
    return documents_index(table).matching(text).withColumnRenamed("id", "doc_id")


@query(f"{WORDS} SELECT doc_id FROM d WHERE list_contains(t, 'with') AND list_contains(t, 'from')")
def boolean_and(table, spark):
    """Documents that hold both words."""
    return _matching(table, "with AND from")


@query(f"{WORDS} SELECT doc_id FROM d WHERE list_contains(t, 'pour') OR list_contains(t, 'und')")
def boolean_or(table, spark):
    """Documents that hold either word."""
    return _matching(table, "pour OR und")


@query(f"{WORDS} SELECT doc_id FROM d WHERE list_contains(t, 'the') AND NOT list_contains(t, 'from')")
def boolean_not(table, spark):
    """Documents that hold one word and not the other."""
    return _matching(table, "the NOT from")


@query(f"{WORDS} SELECT doc_id FROM d WHERE NOT list_contains(t, 'the') AND list_contains(t, 'la') OR list_contains(t, 'und')")
def boolean_mixed(table, spark):
    """Operators from left to right, beginning with a complement."""
    return _matching(table, "NOT the AND la OR und")


PHRASES = f"{EXPLODED}, p AS (SELECT a.doc_id, a.pos FROM w a JOIN w b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 WHERE a.token = 'of' AND b.token = 'the')"


@query(f"{PHRASES} SELECT DISTINCT doc_id FROM p")
def phrase_search(table, spark):
    """Documents that hold two words in a row."""
    return _matching(table, '"of the"')


@query(f"{PHRASES} SELECT doc_id, count(*)::INT AS n FROM p GROUP BY doc_id")
def phrase_frequency(table, spark):
    """How often two words stand in a row."""
    return documents_index(table).phrase_counts(PHRASE).withColumnRenamed("id", "doc_id")


@query(ORACLES["phrase_frequency"])
def updated_phrases(table, spark):
    """The same from an index that took in additions, changes and deletions."""
    return updated_index(table).phrase_counts(PHRASE).withColumnRenamed("id", "doc_id")


@query(f"{EXPLODED} SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) <= 2 WHERE a.token = 'with' AND b.token = 'from'")
def near_search(table, spark):
    """Documents in which two words stand at most two places apart."""
    return _matching(table, "with near/2 from")


@query(
    f"""{LINES}, f AS (SELECT doc_id, bool_or(list_contains(t, 'with')) AS a, bool_or(list_contains(t, 'from')) AS b, bool_or(list_contains(t, 'license')) AS x FROM l GROUP BY doc_id)
    SELECT doc_id FROM f WHERE a AND b AND NOT x"""
)
def doc_boolean_filter(table, spark):
    """Whole documents by words that different lines may hold; an excluded word in any line excludes the document."""
    return lexical.documents_matching(_lines(table), "doc_id", Q.parse_document_query("with AND from NOT license"), "line")


@query("SELECT page_id FROM pages WHERE contains(lower(url), 'example') AND contains(lower(url), '/en/') AND NOT contains(lower(url), '.net')")
def doc_name_filter(table, spark):
    """Pages by substrings of their names."""
    return table("pages").where(Q.name_predicate("example AND /en/ NOT .net", F.col("url"))).select("page_id")


@query(
    f"{WORDS} SELECT source, "
    + ", ".join(f"sum(len(list_filter(t, lambda x: x = '{w}')))::BIGINT AS n_{w}" for w in TERMS)
    + ", sum("
    + " + ".join(f"len(list_filter(t, lambda x: x = '{w}'))" for w in TERMS)
    + ")::BIGINT AS total FROM d GROUP BY source"
)
def term_occurrence_pivot(table, spark):
    """Occurrences of some words by source, a column for each."""
    return lexical.term_pivot(table("documents"), "source", TERMS)


TAGS = (
    ("(?is)<(script|style)\\b[^>]*>.*?</(script|style)>", " "),
    ("(?s)<!--.*?-->", " "),
    ("<[^>]*>", " "),
)


def _strip_sql(expression: str) -> str:
    for pattern, to in TAGS:
        expression = f"regexp_replace({expression}, '{pattern}', '{to}', 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        expression = f"replace({expression}, '{entity}', '{sign}')"
    return f"trim(regexp_replace({expression}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"


@query(f"WITH s AS (SELECT page_id, {_strip_sql('html')} AS t FROM pages) SELECT page_id, length(t)::INT AS n_chars, md5(t) AS digest FROM s")
def html_strip(table, spark):
    """Texts of pages without markup, by length and digest."""
    t = X.strip_tags(F.col("html"))
    return table("pages").select("page_id", t.alias("t")).select("page_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("digest"))


def _blocks_sql() -> str:
    text = "regexp_replace(regexp_replace(html, '(?is)<(script|style)\\b[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g')"
    tags = "|".join(sorted(H.BLOCKS, key=len, reverse=True))
    return f"""WITH s AS (SELECT page_id, chr(2) || regexp_replace({text}, '(?i)<(/?(?:{tags}))(?:\\s[^>]*|/?)>', chr(1) || '\\1' || chr(2), 'g') AS h FROM pages),
    p AS (SELECT page_id, unnest(string_split(h, chr(1))) AS piece, generate_subscripts(string_split(h, chr(1)), 1) AS n FROM s),
    q AS (SELECT page_id, n, lower(split_part(piece, chr(2), 1)) AS tag, {_strip_sql('split_part(piece, chr(2), 2)')} AS t FROM p)
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY n) - 1)::INT AS place, CASE WHEN starts_with(tag, '/') THEN '' ELSE tag END AS tag, length(t)::INT AS n_chars, md5(t) AS digest FROM q WHERE t <> ''"""


@query(_blocks_sql())
def page_blocks(table, spark):
    """The blocks of each page that have a text: their element, length and digest."""
    rows = table("pages").select("page_id", F.explode(H.blocks(F.col("html"))).alias("b"))
    return rows.select("page_id", "b.place", "b.tag", F.length("b.text").alias("n_chars"), F.md5(F.col("b.text").cast("binary")).alias("digest"))


@query(
    r"""SELECT page_id, u.n::INT AS n, u.link AS link FROM (SELECT page_id, unnest(list_transform(regexp_extract_all(html, '(?i)<a\s+[^>]*href=["'']([^"'']*)["'']', 1), lambda x, i: {'link': x, 'n': i - 1})) AS u FROM pages)"""
)
def html_links(table, spark):
    """Targets of the anchors of each page."""
    return table("pages").select("page_id", F.posexplode(X.links(F.col("html"))).alias("n", "link"))


ENTITIES = {"code": "[0-9a-f]{24,}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "mail": r"[a-z0-9._]+@[a-z0-9.]+\.com"}


@query(
    "SELECT doc_id, key, array_to_string(list_sort(list_distinct(v)), '|') AS found FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS key, regexp_extract_all(text, '{p}') AS v FROM documents" for k, p in ENTITIES.items())
    + ") WHERE len(v) > 0"
)
def entity_extract(table, spark):
    """Entities of several kinds in each document."""
    from verdigris.operators.curation import entities

    rows = table("documents").select("doc_id", F.explode(entities(F.col("text"), ENTITIES)).alias("key", "v"))
    return rows.select("doc_id", "key", F.array_join(F.sort_array("v"), "|").alias("found"))


@query()
def chunk_documents(table, spark):
    """Chunks of all documents by structure and size."""
    chunks = context.chunk_documents(table("documents"), "doc_id")
    return chunks.select("doc_id", "chunk_index", "chunk_id", F.length("chunk").alias("n_chars"), F.md5(F.col("chunk").cast("binary")).alias("digest"))


@query(
    """SELECT event_id, event_type, json_extract_string(props, '$.k')::BIGINT AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL"""
)
def json_events_explode(table, spark):
    """Keys of nested JSON as rows."""
    rows = table("events").select("event_id", "event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "v"))
    return rows.where("key = 'k'").select("event_id", "event_type", F.expr("try_cast(v AS bigint)").alias("k"))
