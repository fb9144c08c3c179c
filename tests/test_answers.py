"""Evidence, document routes and registry answers."""

from datetime import date

from pyspark.sql import functions as F

from verdigris.operators import evidence
from verdigris.plans import documents, pipeline, registry_answers
from verdigris.plans.questions import Profile


def test_titles_periods_and_evidence(spark):
    rows = spark.createDataFrame(
        [("portaria", "12", 2018, "x.pdf", date(2020, 1, 1), date(2020, 12, 31)), (None, None, None, "y.pdf", date(2020, 2, 1), date(2020, 2, 29)), ("", "", None, None, None, date(2020, 1, 5))],
        "kind string, number string, year int, name string, a date, b date",
    )
    got = rows.select(evidence.act_title(*[F.col(c) for c in ("kind", "number", "year", "name")]).alias("t"), evidence.period_text(F.col("a"), F.col("b")).alias("p")).collect()
    assert [(r.t, r.p) for r in got] == [("Portaria 12/2018", "2020"), ("y.pdf", "02/2020"), ("", "até 05/01/2020")]
    block = spark.range(1).select(evidence.evidence_block(F.lit("Base_A"), F.lit("d.pdf"), F.lit(3), F.lit(None).cast("string"), F.lit("a\n b")).alias("v")).first().v
    assert block == "Base: Base_A | Documento: d.pdf | Página: 3\na b"
    scores = spark.createDataFrame([("Lei de rejeitos", "uso"), ("outra", "nada")], "t string, x string").select(evidence.question_overlap("rejeitos", F.col("t"), F.col("x")).alias("s"))
    assert [round(r.s, 2) for r in scores.collect()] == [1.45, 0.0]
    groups = spark.createDataFrame([("g", "A", 1), ("g", "B", 2), ("g", "A", 3)], "g string, t string, o int")
    assert evidence.group_summary(groups, "g", "t", "o").first().titles == "A; B"
    checks = evidence.reference_checks(spark.createDataFrame([(1, "veja o Art. 5 da lei"), (2, "Art. 55")], "id int, text string"), "id", "text", ["5", "9"])
    assert [(r.reference, r.id) for r in checks.collect()] == [("5", 1)]


def test_document_routes(spark):
    names = spark.createDataFrame([("Lei 12-2018.pdf",), ("Portaria_12_2018.pdf",), ("Decreto 7_2001.pdf",)], "name string")
    assert documents.docs_directive('@docs "a b.pdf" c.pdf o que diz?') == (["a b.pdf", "c.pdf"], "o que diz?")
    assert documents.docs_directive("sem") == ([], "sem")
    found = {r.wanted: r.name for r in documents.resolve_documents(names, "name", ["lei 12 2018", "decreto", "2018", "none"]).collect()}
    assert found == {"lei 12 2018": "Lei 12-2018.pdf", "decreto": "Decreto 7_2001.pdf"}
    assert documents.resolve_documents(names, "name", []).count() == 0
    assert [r.name for r in documents.route_by_act(names, "name", "a Portaria 12/2018 vale?").collect()] == ["Portaria_12_2018.pdf"]
    assert documents.route_by_act(names, "name", "Em 2018?").count() == 0
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, v array<double>")
    assert [r.id for r in documents.route_by_vector(vectors, "id", "v", [0.9, 0.1]).collect()] == [1]
    assert documents.route_by_vector(vectors, "id", "v", [0.7, 0.7]).count() == 0


def test_registry_answers(spark):
    companies = spark.createDataFrame([("11111111", "ALFA MINERACAO LTDA"), ("22222222", "BETA SA"), ("33333333", "GAMA ME")], "cnpj_basico string, razao_social string")
    establishments = spark.createDataFrame(
        [("11111111", "0001", "91", "MG", "0710301", "02"), ("11111111", "0002", "72", "SP", "0710301", "08"), ("22222222", "0001", "00", "MG", "0710301", "02")],
        "cnpj_basico string, cnpj_ordem string, cnpj_dv string, uf string, cnae_fiscal_principal string, situacao_cadastral string",
    )
    partners = spark.createDataFrame(
        [("11111111", "***123456**", "ANA", "20200101"), ("22222222", "***123456**", "ANA", "20210101"), ("22222222", "000000", "BIA", "20190101"), ("33333333", "", "bia ", "20190101")],
        "cnpj_basico string, cnpj_cpf_do_socio string, nome_socio string, data_entrada_sociedade string",
    )
    activities = spark.createDataFrame([("0710301", "minerio de ferro")], "codigo string, descricao string")
    ask = lambda text: registry_answers.answer(registry_answers.understand(text), companies, establishments, partners, activities)
    row = ask("cnpj 11.111.111/0001-91").first()
    assert (row.cnpj, row.razao_social, row.cnae_descricao) == ("11.111.111/0001-91", "ALFA MINERACAO LTDA", "minerio de ferro")
    assert [r.nome_socio for r in ask("quem sao os socios de 22222222").collect()] == ["ANA", "BIA"]
    assert [r.cnpj_ordem for r in ask("estabelecimentos de 11111111").collect()] == ["0001", "0002"]
    assert ask("quantas empresas ativas em MG").first().total == 2
    assert {r.uf: r.total for r in ask("empresas por UF do cnae 0710301").collect()} == {"MG": 2, "SP": 1}
    assert {r.cnpj_basico for r in ask("outras empresas com os mesmos socios de 11111111").collect()} == {"22222222"}
    assert {r.cnpj_basico for r in ask('de quais empresas e socio "Ana"? empresas do socio').collect()} == {"11111111", "22222222"}
    found = ask('qual a relacao entre "Alfa Mineracao" e "Gama"').collect()
    assert [r.path for r in found] == [["11111111", "doc:123456", "22222222", "name:BIA", "33333333"]]
    assert ask("beta").first().cnpj_basico == "22222222"


ACTS = [
    (1, "a.pdf", "taxa de pesca cobrada por barco", date(2010, 1, 1), date(2014, 12, 31), "revogado", True, 2),
    (2, "b.pdf", "taxa de pesca cobrada por tonelada", date(2015, 1, 1), None, "vigente", True, None),
    (3, "c.pdf", "taxa de pesca em debate", None, None, "desconhecido", False, None),
    (4, "d.pdf", "taxa de pesca esportiva", date(2012, 1, 1), None, "parcialmente_revogado", True, None),
    (5, "e.pdf", "assunto alheio", date(2000, 1, 1), None, "vigente", True, None),
]


def test_answers_hold_at_the_time_asked_for(spark):
    docs = spark.createDataFrame(ACTS, "id int, doc string, text string, start date, end date, status string, normative boolean, revoked_by int")
    acts = pipeline.ActColumns()
    ask = lambda q, rows=docs, **more: {r.id: r for r in pipeline.ask(rows, q, "id", "doc", "text", acts=acts, **more).collect()}
    then = ask("Em 2013, qual a taxa de pesca por barco?")
    assert set(then) == {1, 2, 4} and then[1].part == "active" and then[2].part == "pool"
    assert "vigente_na_data_e_revogada_posteriormente" in then[1].evidence
    assert {i for i, r in ask("Em 2016, qual a taxa de pesca?").items() if r.part == "active"} == {2, 4}
    assert set(ask("qual a taxa de pesca")) == {1, 2, 3, 4}  # no time is asked for
    filler = spark.createDataFrame([(100 + i, "z.pdf", f"assunto alheio {i}", None, None, "desconhecido", False, None) for i in range(8)], docs.schema)
    lone = docs.where("id in (1, 2)").withColumn("text", F.when(F.col("id") == 2, "tonelada de pesca").otherwise("taxa por barco"))
    heirs = ask("Em 2016, qual taxa por barco de pesca?", lone.unionByName(filler))
    assert {(i, r.part) for i, r in heirs.items()} == {(2, "active"), (1, "revoked")}
    old = docs.where("id = 1").withColumn("revoked_by", F.lit(None).cast("int"))
    assert ask("Em 2016, qual a taxa de pesca por barco?", old.unionByName(filler)) == {}  # withheld: what is found isn't in force
    # Only the revoked act is found, so the act that revoked it stands in for it.
    gone = docs.where("id in (1, 2)").withColumn("text", F.when(F.col("id") == 2, "outra taxada").otherwise("taxa por barco"))
    assert {(i, r.part) for i, r in ask("Em 2016, qual taxa por barco?", gone.unionByName(filler)).items()} == {(2, "successor"), (1, "revoked")}


def test_questions_become_several_searches(spark):
    profile = Profile("pesca", (("taxa",), ("pesca",)), ("multa de pesca",))
    made = pipeline.asked_queries("qual a taxa e o risco da pesca", {"max_variants": 20}, [profile])
    assert made[0] == "qual a taxa e o risco da pesca" and "multa de pesca" in made and len(made) == len({m.lower() for m in made})
    assert len(pipeline.asked_queries("qual a taxa", {"max_variants": 2})) == 2
    docs = spark.createDataFrame([(r[0], r[1], r[2], "direta" if r[0] == 3 else "") for r in ACTS], "id int, doc string, text string, relation string").withColumn("none", F.lit("")).withColumn("main", F.lit(False))
    domain = pipeline.DomainColumns("relation", "none", "none", "main", ("pesca",), ("norma",))
    got = pipeline.ask(docs, "taxa de pesca", "id", "doc", "text", domain=domain).orderBy("rank").collect()
    assert got[0].id == 3 and {r.id for r in got} == {1, 2, 3, 4}
