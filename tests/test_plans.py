"""What is settled before a job: boolean queries, intents, routes, settings, guards, envelopes."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from verdigris.operators.lexical import documents_matching, with_tokens
from verdigris.plans import catalog, envelopes, intent, routing
from verdigris.plans.boolean_query import compile_query, name_predicate, parse_document_query

LINES = [
    ("docA.pdf::p1::c0", "mapa de relevo com escala ampliada"),
    ("docB.pdf::p1::c0", "mapa rodoviario da regiao"),
    ("docC.pdf::p1::c0", "escala salarial aprovada"),
    ("docD.pdf::p1::c0", "relevo ondulado do vale"),
    ("docE.pdf::p1::c0", "mapa antigo escala reduzida"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    rows = spark.createDataFrame(LINES, "chunk_id string, text string")
    return rows.withColumn("doc", F.split("chunk_id", "::")[0])


@pytest.mark.parametrize(
    "query, want",
    [
        ("mapa AND escala", "AE"),
        ("mapa OR salarial", "ABCE"),
        ("mapa NOT rodoviario", "AE"),
        ('"mapa de relevo"', "A"),
        ("mapa near/2 escala", "E"),
        ("NOT mapa", "CD"),
        ("nothing", ""),
        ("", ""),
        ("mapa de near/2 escala", "BE"),
    ],
)
def test_chunk_queries(chunks, query, want):
    found = with_tokens(chunks).where(compile_query(query, F.col("tokens"))).select("doc").collect()
    if query.startswith("mapa de near"):  # pieces from left to right: mapa, then "de near/2 escala"
        want = "ABE"
    assert sorted(r.doc[3] for r in found) == list(want)


@pytest.mark.parametrize("query, want", [('"mapa de relevo" AND escala NOT rodoviario', "A"), ("NOT rodoviario", "ACDE")])
def test_document_queries(chunks, query, want):
    found = documents_matching(chunks, "doc", parse_document_query(query)).collect()
    assert sorted(r.doc[3] for r in found) == list(want)


def test_excluding_a_whole_document(spark):
    rows = [("docA", "texto sobre o rio"), ("docA", "aqui aparece xyzt"), ("docB", "texto sobre o rio")]
    found = documents_matching(spark.createDataFrame(rows, "doc string, text string"), "doc", parse_document_query('not "xyzt"')).collect()
    assert [r.doc for r in found] == ["docB"]


def test_parsed_queries():
    q = parse_document_query('"mapa de relevo" AND escala NOT rodoviario')
    assert (q.terms, q.operator, q.exclude) == (('"mapa de relevo"', "escala"), "AND", ("rodoviario",))
    q = parse_document_query("mapa near/2 escala")
    assert (q.terms, q.operator, q.exclude) == (("mapa near/2 escala",), "OR", ())


def test_document_names(spark):
    names = ["Parecer ABC verba anual.pdf", "Rascunho ABC verba.pdf", "Mapa.pdf", "Anexo_geral_ABC.pdf"]
    rows = spark.createDataFrame([(n,) for n in names], "name string")
    pick = lambda q: [r.name for r in rows.where(name_predicate(q, F.col("name"))).collect()]
    assert pick("ABC AND verba NOT rascunho") == names[:1]
    assert pick('"Rascunho ABC verba.pdf" and "Mapa.pdf"') == names[1:3]


@pytest.mark.parametrize(
    "question, enabled, precision, start",
    [
        ("No dia 07/08/2014, que portaria regia a cobranca?", True, "day", date(2014, 8, 7)),
        ("Que regra valia em 07.08.14 para a taxa?", True, "day", date(2014, 8, 7)),
        ("Desde 2014-08-07 a norma mudou?", True, "day", date(2014, 8, 7)),
        ("Que norma regia a taxa em agosto de 2014?", True, "month", date(2014, 8, 1)),
        ("Que norma regia a taxa em 08/2014?", True, "month", date(2014, 8, 1)),
        ("Durante 2014 que norma regia a taxa?", True, "year", date(2014, 1, 1)),
        ("No ano de 1998 e nao de 2003, que lei valia?", True, "year", date(1998, 1, 1)),
        ("1998: quais multas cabiam?", True, "year", date(1998, 1, 1)),
        ("Que multas cabiam (1998)?", True, "year", date(1998, 1, 1)),
        ("Que regra a Resolucao 77/2014 alterou?", False, None, None),
        ("Que regra a Lei 9/2014 alterou?", False, None, None),
        ("As multas de 1998 e de 2003 sao iguais?", False, None, None),
        ("O que a Portaria 155/2016 dizia em 2018?", True, "year", date(2018, 1, 1)),
        ("O decreto valia em 1o de abril de 2017?", True, "day", date(2017, 4, 1)),
        ("O decreto valia em 31/02/2017?", False, None, None),
        ("o que e uma lei?", False, None, None),
    ],
)
def test_temporal_intent(question, enabled, precision, start):
    found = intent.detect(question)
    assert (found.enabled, found.precision, found.start, found.end) == (enabled, precision, start, start)


def test_act_references():
    assert intent.act_reference("Em 2014, que norma regia a taxa?") == intent.ActReference(None, None, None)
    assert intent.act_reference("Que prazo fixa a Resolucao 77/2014 desde 2016?") == intent.ActReference("resolucao", "77", 2014)
    assert intent.act_reference("a instrução normativa nº 1.305 de 2021").number == "1305"
    assert intent.act_reference("lei complementar 12 de 1999") == intent.ActReference("lei complementar", "12", 1999)
    assert intent.act_reference("que lei valia em 2014") == intent.ActReference(None, None, None)
    assert intent.detect("a regra vale hoje?", date(2020, 1, 2)).start == date(2020, 1, 2)


def test_routes_and_settings():
    assert routing.route_command("@anm quais tabelas") == ("anm", "quais tabelas")
    assert routing.choose_route("socios da empresa X") == "cnpj"
    assert routing.choose_route("a portaria se aplica a empresa X") == "cnpj_rag"
    assert routing.choose_route("o que diz a portaria 12") == "rag"
    short, long = routing.tune("qual norma", {}), routing.tune("compare as regras entre as portarias de lavra", {})
    assert (short["top_retrieval"], short["top_final"]) == (60, 18) and (long["top_retrieval"], long["top_final"]) == (80, 24)
    assert routing.tune("x", {"top_retrieval": 10_000, "searches": "no"})["searches"] == 1
    assert abs(sum(routing.tune("a e b", {}, temporal=True)[k] for k in ("alpha", "beta")) - 1) < 1e-9
    assert routing.decompose("prazo da lavra e multa") == ["prazo da lavra", "multa"] and routing.decompose("") == []
    assert routing.variants("qual o prazo da lavra")[1] == "prazo lavra"


def test_guarded_sql(spark):
    spark.range(10).createOrReplaceTempView("ten")
    assert catalog.run_guarded(spark, "WITH t AS (SELECT * FROM ten) SELECT id FROM t;", 4).count() == 4
    for bad in ("DROP VIEW ten", "SELECT 1; SELECT 2", "INSERT INTO ten VALUES (1)", "WITH t AS (SELECT 1) INSERT INTO ten SELECT * FROM t", "SET x = 1", "", "SELECT (1"):
        with pytest.raises(catalog.Refused):
            catalog.check_query(spark, bad)
    assert catalog.quote("name_1") == "`name_1`"
    with pytest.raises(catalog.Refused):
        catalog.quote("a b")
    assert catalog.relevant_tables("total of taxes by county", {"taxes": ["county"], "people": ["name"]}) == ["taxes"]
    assert "ten(id bigint)" in catalog.schema_text({"ten": spark.table("ten")})


def test_guard_admits_only_what_reads(spark):
    spark.range(10).createOrReplaceTempView("ten")
    spark.udf.register("own_function", lambda x: x, "long")
    good = (
        "SELECT upper(cast(id AS string)) AS u, sum(id) FROM ten GROUP BY 1 HAVING sum(id) > 2 ORDER BY u LIMIT 3",
        "WITH a AS (SELECT id FROM ten), b AS (SELECT max(id) AS m FROM a) SELECT a.id FROM a JOIN b ON a.id = b.m WHERE EXISTS (SELECT 1 FROM ten WHERE id = 3)",
        "SELECT id, row_number() OVER (ORDER BY id DESC) AS n FROM ten UNION ALL SELECT 1, 2",
        "SELECT x FROM ten LATERAL VIEW explode(array(id, id)) t AS x",
        "SELECT * FROM VALUES (1), (2) AS v(x)",
    )
    for text in good:
        assert catalog.run_guarded(spark, text).collect()
    bad = (
        "SELECT reflect('java.lang.System', 'getProperty', 'user.home')", "SELECT java_method('java.lang.System', 'exit', 1)", "SELECT try_reflect('a', 'b') FROM ten",
        "SELECT count(*) FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/tmp/x`", "SELECT * FROM ten WHERE id IN (SELECT length(value) FROM text.`/etc/passwd`)",
        "SELECT (SELECT reflect('java.lang.System', 'getenv', 'PATH'))", "WITH a AS (SELECT reflect('a', 'b', 'c') AS r) SELECT * FROM a", "SELECT id FROM ten ORDER BY reflect('a', 'b')",
        "SELECT * FROM range(5)", "SELECT own_function(id) FROM ten", "SELECT input_file_name() FROM ten", "SELECT current_user()", "SELECT * FROM nowhere", "SELECT TRANSFORM(id) USING 'cat' FROM ten",
        "SELECT sum(length(reflect('a', 'b'))) OVER (PARTITION BY id) FROM ten", "SELECT * FROM ten WHERE EXISTS (SELECT 1 FROM csv.`/etc/passwd`)",
        "SELECT transform(array(1), x -> reflect('a', 'b'))", "SELECT * FROM read_files('/etc')", "SELECT * FROM ten LATERAL VIEW reflect('a', 'b') t AS x",
    )
    for text in bad:
        with pytest.raises(catalog.Refused):
            catalog.check_query(spark, text)
    assert catalog.check_query(spark, "SELECT own_function(id) FROM ten", frozenset({"own_function"}))


def test_rows_come_in_time(spark):
    assert len(catalog.rows_within(spark.range(5), 60)) == 5
    slow = spark.range(0, 4, 1, 4).select(F.expr("aggregate(sequence(1, 3000000), 0D, (a, x) -> a + sin(x + id))").alias("x")).crossJoin(spark.range(3000).withColumnRenamed("id", "j")).agg(F.sum(F.sin(F.col("x") + F.col("j"))))
    with pytest.raises(catalog.OutOfTime):
        catalog.rows_within(slow, 0.2)
    spark.range(30).createOrReplaceTempView("thirty")
    assert catalog.run_guarded(spark, "SELECT id FROM thirty", 7, 60).count() == 7
    with pytest.raises(catalog.OutOfTime):
        catalog.run_guarded(spark, "SELECT a.id FROM thirty a, thirty b, thirty c, thirty d, thirty e, thirty f WHERE a.id + b.id + c.id + d.id + e.id + f.id < 0", 7, 0.2)
    assert spark.range(3).count() == 3


def test_envelopes():
    assert envelopes.ranking({"results": [{"index": 2, "relevance_score": 0.98}, {"index": 0, "relevance_score": 0.75}]}) == [(2, 0.98), (0, 0.75)]
    assert envelopes.ranking({"data": [{"document_index": 1, "score": 0.44}]}) == [(1, 0.44)]
    assert envelopes.ranking({"result": {"results": [{"documentIndex": 3, "relevanceScore": 0.91}, {"documentIndex": 1, "relevanceScore": 0.72}]}}) == [(3, 0.91), (1, 0.72)]
    assert envelopes.ranking({"output": '{"results": [{"index": 4, "score": 0.66}]}'}) == [(4, 0.66)]
    assert envelopes.ranking({"results": [{"text": "none"}]}) == []
    assert envelopes.query_list('["a", "b"]') == ["a", "b"]
    assert envelopes.query_list('```json\n{"queries": ["a", " b "]}\n```') == ["a", "b"]
    assert envelopes.markdown_table([{"a": 1234.5, "b": None}]).splitlines()[-1] == "| 1.234,50 |  |"
