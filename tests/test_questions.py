"""What questions ask for, catalogue answers, and the small helpers beside them."""

import pytest
from pyspark.sql import functions as F

from verdigris.functions import text as X
from verdigris.operators import classification, ranking, registry
from verdigris.operators import revocations as V
from verdigris.plans import catalogue_answers as A
from verdigris.plans import questions as Q
from verdigris.sources import readers


def test_classes_and_intents():
    assert Q.classify("quantos documentos por uf") == "hybrid_sql_rag" and Q.classify("o que diz a portaria") == "rag_only"
    assert Q.classify("vínculo entre pessoas") == "graph_only" and Q.classify("qual a maior") == Q.classify("") == "sql_only"
    assert Q.intents("Quantas vezes e em quais documentos?") == ["term_frequency", "term_documents"] and Q.intents("x") == ["rag_query"]
    profile = Q.Profile("p", (("multa", "sancao"), ("relatorio",), ("omissao",)), ("multa relatorio",))
    assert Q.profile_of("sanção por falta do relatório", [profile]) is profile and Q.profile_of("multa", [profile]) is None
    assert Q.domain_intent("a lavra de areia", ("lavra",), ("norma",)) == Q.DomainIntent(True, True, False)
    assert Q.domain_intent("que norma vale", ("lavra",), ("norma",)) == Q.DomainIntent(True, False, True)
    assert not Q.domain_intent("que norma vale " + "sempre " * 14, ("lavra",), ("norma",)).enabled
    assert Q.expand("o risco") == "o risco risco impacto perigo ameaca dano potencial" and Q.expand("nada") == "nada"


def test_terms():
    assert Q.asked_term('Quantas vezes aparece "Meia Volta"?') == "meia volta" and Q.asked_term("quantas vezes aparece barragem") == "barragem"
    assert Q.query_terms('"Dois Nomes" AND custo NOT 2019 "dois nomes" Custo') == ["dois nomes", "custo"]
    assert Q.query_terms('solto "aberto') == ["solto", "aberto"] and Q.query_terms("") == []
    assert Q.active_terms(["a OR b", "B and c"]) == ["a", "b", "c"] and Q.unique_fold(["A", "a", "b"]) == ["A", "b"]
    assert Q.is_quoted('"x"') and not Q.is_quoted('"') and Q.unquoted(' "x y" ') == "x y" and Q.unquoted("z") == "z"
    assert Q.excludes_only("NOT x") and not Q.excludes_only("y NOT x") and not Q.excludes_only("")
    assert Q.fill("{a} and {b}", {"a": 1}) == "1 and {b}"


def test_answers_as_texts():
    text = "# Resposta\n\nSim.\n\n---\n\n# Evidencia\n\nPagina 3"
    assert Q.split_answer(text) == ("Sim.", "Pagina 3") and Q.split_answer("so isto") == ("so isto", "")
    told = "**Razao social:** Alfa Mineral\n- **CNPJ:** 12\n\n| CNPJ | Nome |\n|---|---|\n| 99 | Beta Rochas |\n| 77 | alfa mineral |\n**Nome fantasia:** nao informado"
    assert Q.registry_terms(told) == ["Alfa Mineral", "12", "Nome", "Beta Rochas"] and Q.registry_terms(told, 1) == ["Alfa Mineral"]
    assert "Termos para a busca: Alfa Mineral; 12" in Q.documents_after_registry("quem?", told)
    assert "Termos para a consulta: quem?" in Q.registry_after_documents("quem?", "nada")
    both = Q.joined_answers({"Um": text, "Dois": "x"})
    assert both.index("## Um\n\nSim.") < both.index("## Dois\n\nx") < both.index("# Evidencia") and "Sem evidencia detalhada." in both


@pytest.fixture(scope="module")
def shelves(spark):
    datasets = spark.createDataFrame([(1, "Barragens", "ANM", "u"), (2, "Outros", "X", "v")], "id int, title string, organization_title string, source_url string").withColumn("name", F.col("title"))
    resources = spark.createDataFrame(
        [(1, "cadastro", "CSV", "anm_barragem", 5, "u1"), (2, "mapa", "PDF", None, None, "u2"), (9, "solto", "CSV", None, 0, "u3")],
        "dataset_id int, name string, format string, table_name string, imported_rows int, url string",
    )
    cfem = spark.createDataFrame([("A", "1.234,50", "2020"), ("A", "0,50", "2021"), ("B", "7", "2020"), ("", "9", "2020")], "municipio string, valor string, ano string")
    return {"anm_cfem": cfem, "anm_barragem": cfem.limit(1), "datasets": datasets}, datasets, resources


def test_catalogue_answers(shelves):
    tables, datasets, resources = shelves
    ask = lambda q: A.answer(q, tables, datasets, resources)
    assert "2 datasets, 3 recursos, 1 recursos importados" in ask("o que ha aqui") and "anm_cfem" in ask("o que ha aqui")
    assert "situação das barragens" in ask("qual o esquema") and "municipio, valor, ano" in ask("quais tabelas")
    label, sums = A.grouped_sum(tables["anm_cfem"], "cfem por municipio")
    assert label == "Municipio" and [tuple(r) for r in sums.collect()] == [("A", 1235.0), ("B", 7.0)]
    assert "| A |" in ask("soma da cfem por municipio") and A.grouped_sum(tables["anm_cfem"], "por substancia") is None
    assert [r.name for r in A.resources_of(resources, datasets, "quais recursos barragens csv").collect()] == ["cadastro"]
    assert [r.name for r in A.resources_of(resources, datasets).collect()] == ["solto", "cadastro", "mapa"]
    assert "cadastro" in ask("recursos: cadastro csv") and "Barragens" in ask("quais datasets") and "1.234,50" in ask("amostra de anm_cfem")
    assert [r.title for r in datasets.where(A.owned_by(F.col("title"), F.col("name"), F.col("organization_title"), "anm")).collect()] == ["Barragens"]
    assert A.data_tables(["resources", "b", "a", "sqlite_x"]) == ["a", "b"] and A.asked_table("a barragem", ["anm_cfem", "anm_barragem"]) == "anm_barragem"
    assert A.describe_column("CNPJ_raiz") == "número de registro da empresa" and A.aliases("anm_cfem_2020") == ["anm cfem 2020", "cfem 2020", "anm cfem"]

    def load(source):
        if source is None:
            raise ValueError("no source")
        return source

    assert A.import_all({"a": 3, "b": None}, load, lambda name, rows: rows) == [{"resource": "a", "rows": 3, "error": None}, {"resource": "b", "rows": 0, "error": "ValueError: no source"}]


def test_heads_of_revoked_acts(spark):
    rows = [
        ("Norma 1\n\nRevogada pela Portaria nº 12/2019, de 3 de maio de 2019\nArt. 1", ("revogado", "line", "portaria", "12", 2019, "2019-05-03")),
        ("x\n" * 12 + "Parcialmente revogado pela Lei 77 de 4 de maio de 2001", ("parcialmente_revogado", "inline", "lei", "77", 2001, "2001-05-04")),
        ("nada disso", None),
        (None, None),
    ]
    frame = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", V.head_revocation(F.col("t")).alias("h"))
    for r in frame.collect():
        want = rows[r.i][1]
        assert (r.h and (r.h.status, r.h.mode, r.h.kind, r.h.number, r.h.year, str(r.h.date))) == want
    stamped = spark.createDataFrame([("3/4/2020 10:15  Portaria\n 5",), ("Portaria",)], "t string").select(V.without_stamp(F.col("t")), V.stamp_date(F.col("t"))).collect()
    assert [(r[0], r[1] and str(r[1])) for r in stamped] == [("Portaria 5", "2020-04-03"), ("Portaria", None)]


def test_revokers_by_all_criteria(spark):
    mentions = spark.createDataFrame([("d1", "portaria 12 2019", "portaria", "12", 2019)], "doc string, said string, kind string, number string, year int")
    acts = spark.createDataFrame(
        [("d1", "portaria 12 2019", "x", "portaria", "12", 2019), ("t1", "outra", "Portaria 12/2019", "portaria", "12", 2019), ("t2", "a portaria 12 2019 b", None, "portaria", "12", 2019), ("t3", "lei", "", "lei", "12", 2019)],
        "target string, name string, title string, kind string, number string, year int",
    )
    assert [tuple(r) for r in V.best_revokers(mentions, acts, "doc").collect()] == [("d1", "t2", 70 + 20 + 15 + 10 + 1)]
    first, docs = V.representatives(spark.createDataFrame([("a", 2, "lei", 1, 2000), ("a", 1, "lei", 1, 2000), ("b", 1, "lei", 1, 2000), ("c", 1, None, 1, 2000)], "d string, n int, k string, m int, y int"), "d", "n", ["k", "m", "y"])
    assert {(r.d, r.n) for r in first.collect()} == {("a", 1), ("b", 1), ("c", 1)} and docs.first().docs == ["a", "b"]


def test_paths_match_a_breadth_first_search(spark):
    import random

    rng = random.Random(4)
    pairs = sorted({(rng.randint(1, 60), rng.randint(1, 25)) for _ in range(110)} | {(c, 99) for c in range(1, 40)})
    edges = spark.createDataFrame(pairs, "c int, p int")
    for most, per_partner in ((5, 10), (None, None)):
        tried = {p: sorted(c for c, q in pairs if q == p)[:per_partner] for _, p in pairs}
        seen, frontier, want = {3}, {3: ["3"]}, []
        for hop in (1, 2, 3):
            steps = [(o, [*path, str(p), str(o)]) for at, path in frontier.items() for c, p in pairs if c == at for o in tried[p] if o not in seen]
            want += [(path, hop) for o, path in steps if o in (55, 60)]
            frontier = {}
            for o, path in steps:
                if o not in (55, 60):
                    frontier[o] = min(frontier.get(o, path), path)
            seen |= set(frontier)
        want = sorted(want, key=lambda x: (x[1], x[0]))[:most]
        got = registry.relationship_paths(edges, [3], [55, 60], "c", "p", 3, most, per_partner, once=True).collect()
        assert sorted(((list(r.path), r.hops) for r in got), key=lambda x: (x[1], x[0])) == want and want


def test_reranking_that_fails_keeps_the_order(spark):
    ranked = spark.createDataFrame([(1, 3.0, 1), (2, 2.0, 2), (3, 1.0, 3)], "id int, score double, rank int")
    rows, why = ranking.rerank_or_keep(ranked, lambda df: 1 / 0, 2)
    assert [r.id for r in rows.orderBy("rank").collect()] == [1, 2] and why.startswith("ZeroDivisionError")
    answers = spark.createDataFrame([(3, 0.9), (2, 0.5)], "id int, score double")
    blended = ranking.blended(ranked, answers, 3, "id").orderBy("rank").collect()
    assert [(r.id, r.score) for r in blended] == [(3, 1.0), (2, 0.7), (1, 3.0)]
    text = spark.createDataFrame([("d", None, 3, "body"), (None, "", None, None)], "doc string, titulo string, page int, text string")
    assert [r[0] for r in text.select(ranking.rerank_text(text.columns)).collect()] == ["doc: d\npage: 3\n\nbody", ""]


def test_urls_names_and_files(spark, tmp_path):
    urls = [("http://x/y?tipo=POR&amp;numeroAto=12&valorAno=2019&orgao=A%20B&cod_menu=7",), ("http://x/y?tipo=POR",)]
    got = spark.createDataFrame(urls, "u string").select(X.act_of_url(F.col("u")).alias("a")).collect()
    assert tuple(got[0].a) == ("POR", "12", "000", "2019", "A B", "566", "7") and got[1].a is None
    assert spark.createDataFrame([(" a | b",), (None,)], "u string").select(X.first_url(F.col("u"))).collect() == [("a",), ("",)]
    assert [readers.registry_table(n) for n in ("dir/Empresas0.zip", "K3241.ESTABELE", "Socios1.zip", "other.csv")] == ["empresas", None, "socios", None]
    (tmp_path / "b").mkdir()
    (tmp_path / "a").mkdir()
    (tmp_path / "two.csv").write_text("x")
    assert readers.first_present(str(tmp_path), ("one.csv", "two.csv")).endswith("two.csv") and readers.first_present(str(tmp_path), ("one.csv",)) is None
    assert readers.bases_in(str(tmp_path)) == ["a", "b"] and readers.bases_in(str(tmp_path / "none")) == []


def test_ladder_of_relations(spark):
    rows = [
        ("portaria sobre lavra", "", "", "", "", "direta", "alta"),
        ("norma", "trata da anm", "anm", "", "", "indireta", "media"),
        ("norma", "nada", "", "", "lei 1", "referenciada", "media"),
        ("norma", "nada", "", "", "", "sem_relacao_identificada", "baixa"),
        ("imposto", "", "", "legislacao_consolidada_mineracao", "recursos minerais", "direta", "alta"),
    ]
    frame = spark.createDataFrame(rows, "titulo string, ementa string, orgao string, collection_slug string, textos_referencia_origem string, want string, sure string")
    got = classification.classify(frame).collect()
    assert [(r.relation, r.confidence) for r in got] == [(r.want, r.sure) for r in got]
    assert got[0].area == "minerario" and got[1].family == "institucional_anm_dnpm" and got[4].family == "mineracao_geral"


def test_heads_are_read_once(spark):
    """The best chunk and the number of chunks come from one aggregation; a text without the words goes no further."""
    rows = spark.createDataFrame([(1, 7, "Revogada  pela\tPortaria nº 3/2001"), (2, 7, "Esta norma, revogada pela Portaria nº 12/2001. Art. 1"), (3, 7, "Norma em vigor."), (4, None, "Revogada pela Lei 1/2000"), (5, 8, None)], "c int, d int, t string")
    read = rows.select("c", "d", V.head_revocation(F.col("t")).alias("h"))
    chunks = read.select("c", "d", F.lower("h.said").alias("said"), "h.mode", "h.kind", "h.number", "h.year", "h.date", F.lit(1).alias("confidence"))
    best = V.best_rows(chunks, "d", "c")
    assert [(r.d, r.c, r.said, r["mode"], r.number, r.year, r.chunks, r.quality) for r in best.collect()] == [(7, 1, "portaria nº 3/2001", "line", "3", 2001, 2, "alta")]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan
