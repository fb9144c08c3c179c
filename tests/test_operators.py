"""Operators on small tables, with the rows that go wrong first."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from verdigris.functions import dates, legal, text
from verdigris.operators import context, curation, enrichment, ranking, registry, temporal


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_text_functions(spark):
    assert one(spark, text.normalize(F.lit("  Resolução\n Nº 12 Ação "))) == "resolucao no 12 acao"
    assert one(spark, text.alnum_key(F.lit("docs/Lei nº 12.PDF"))) == "leino12"
    assert one(spark, text.fix_mojibake(F.lit("resoluÃ§Ã£o"))) == "resolução"
    assert one(spark, text.company_id(F.lit("12345678000190"))) == "12.345.678/0001-90"
    assert one(spark, text.locale_number(F.lit("1.234,56"))) == 1234.56 and one(spark, text.locale_number(F.lit("n/d"))) == 0
    assert one(spark, text.strip_tags(F.lit("<p>a &amp; b</p><script>x</script> c"))) == "a & b c"
    assert one(spark, text.match_score(["alfa", "mineracao"], text.company_tokens(F.lit("ALFA Mineração Ltda")))) == 20
    assert one(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_dates(spark):
    assert one(spark, dates.day_month_year(F.lit("em 12 de maio de 2016"))) == date(2016, 5, 12)
    assert one(spark, dates.day_month_year(F.lit("31/02/2016"))) is None
    assert one(spark, dates.day_month_year(F.lit("1/3/49"))) == date(2049, 3, 1)
    assert one(spark, dates.advance(F.to_date(F.lit("2024-01-31")), F.lit(1), F.lit("month"))) == date(2024, 2, 29)
    assert one(spark, dates.first_business_day(F.to_date(F.lit("2024-06-20")))) == date(2024, 6, 3)
    assert one(spark, dates.iso_date(F.lit("2019-13-01"))) is None


def test_legal_texts(spark):
    assert one(spark, legal.event_type(F.lit("Fica revogada a Portaria 1"))) == "revogacao"
    assert one(spark, legal.event_direction(F.lit("(Revogado pela Lei 2)"))) == "passiva"
    assert one(spark, legal.quantity(F.lit("cento e oitenta"))) == 180 and one(spark, legal.quantity(F.lit("mil e duzentos"))) == 1200
    assert one(spark, legal.quantity(F.lit("alguns"))) is None
    start = one(spark, legal.relative_start(F.lit("Esta Lei entra em vigor após decorridos cento e oitenta dias.")))
    assert (start.amount, start.unit) == (180, "day")
    assert one(spark, legal.explicit_start(F.lit("entra em vigor em 1º de julho de 2020."))) == date(2020, 7, 1)
    assert one(spark, legal.publication_date(F.lit("Assinada em 1/1/2020\nPublicada no DOU de 05/01/2020"))) == date(2020, 1, 5)
    assert one(spark, legal.highlight(F.lit("A lavra e o la"), ["lavra", "la"])) == "A **lavra** e o la"
    assert one(spark, legal.article_references(F.lit("Art. 5 e artigo 7, art. 5"))) == ["5", "7"]
    paragraphs = F.array(F.lit("PORTARIA Nº 1, DE 2020"), F.lit("curta"), F.lit("Dispõe sobre o aproveitamento de rejeitos de lavra."))
    assert one(spark, legal.ementa(paragraphs)).startswith("Dispõe")


@pytest.mark.parametrize(
    "start, end, status, day, active, label",
    [
        ("2018-01-01", "2019-03-20", "revogado", "2019-03-12", True, "vigente_na_data_e_revogada_posteriormente"),
        ("2018-01-01", "2019-03-20", "revogado", "2019-04-01", False, "revogada_antes_do_periodo"),
        ("2019-06-01", None, "vigente", "2019-01-01", False, "ainda_nao_vigente_no_periodo"),
        (None, None, "vigente", "2019-01-01", True, "vigente_na_data"),
        ("2018", "2019", "Revogada", "2019-12-31", True, "vigente_na_data_e_revogada_posteriormente"),
        ("junk", None, "", "2019-01-01", False, "nao_identificado"),
    ],
)
def test_validity(spark, start, end, status, day, active, label):
    row = spark.createDataFrame([(start, end, status, day)], "s string, e string, t string, d string")
    s, e, t, d = temporal.effective_start(F.col("s")), temporal.effective_end(F.col("e")), temporal.canonical_status(F.col("t")), F.to_date("d")
    got = row.select(temporal.active_in(s, e, t, d, d).alias("a"), temporal.status_in(s, e, t, d, d).alias("l")).first()
    assert (got.a, got.l) == (active, label)


def test_heads_and_partial_revocations(spark):
    assert one(spark, temporal.header_status(F.lit("PORTARIA 1\n(Parcialmente revogada pela Lei 2)"))) == "parcialmente_revogado"
    assert one(spark, temporal.header_status(F.lit("nao revogada pela Lei 2"))) is None
    assert one(spark, temporal.effective_status(F.lit("vigente"), F.lit("texto"), F.lit(True))) == "parcialmente_revogado"
    assert temporal.budgets(20) == (13, 7) and temporal.budgets(1) == (1, 1)


def test_successors(spark):
    rows = [("revoked::1", "old", "2002-12-27", "2016-05-12", "revogado", "successor_doc", 0.0), ("successor::1", "successor_doc", "2016-05-13", None, "vigente", None, 0.5), ("successor::2", "successor_doc", "2016-05-13", None, "vigente", None, 0.0)]
    acts = spark.createDataFrame(rows, "chunk_id string, doc_id string, s string, e string, status string, by string, o double")
    day = F.to_date(F.lit("2016-05-17"))
    active = temporal.active_in(temporal.effective_start(F.col("s")), temporal.effective_end(F.col("e")), F.col("status"), day, day)
    found = temporal.successors(acts.where("status = 'revogado'"), acts, "by", "doc_id", active, F.col("o"), 4, ["chunk_id"])
    assert [r.chunk_id for r in found.collect()] == ["successor::1"]


def test_domain_policy(spark):
    rows = [(0.8, "context", "", "", "", False), (0.6, "main", "direta", "", "minerario", True)]
    frame = spark.createDataFrame(rows, "score double, id string, relation string, family string, area string, main boolean")
    columns = [F.col(c) for c in ("relation", "family", "area", "main")]
    boosted = frame.withColumn("score", F.col("score") * ranking.domain_factor(*columns, True)).orderBy(F.desc("score"))
    assert [r.id for r in boosted.collect()] == ["main", "context"]
    scored = frame.withColumn("category", ranking.domain_category(*columns))
    kept = ranking.reserve_coverage(scored.where("id = 'context'"), scored, 5, "id", F.col("category") == "principal")
    assert {r.id for r in kept.collect()} == {"context", "main"}


def test_rankings(spark):
    assert ranking.normal_weights(-1, 0) == (0.7, 0.3) and len(ranking.weight_profiles(0.7, 0.3, 3)) == 3
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ranking.bm25_topk(empty, ["a"], 5, "doc_id").count() == 0
    same = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, score double")
    assert {r.x for r in ranking.minmax(same, "score", "x").collect()} == {1.0}
    zero = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "id long, v array<double>")
    assert [r.score for r in ranking.vector_topk(zero, [1.0, 0.0], 2, "id", "v").collect()] == [1.0, 0.0]


def brute_mmr(scores, k, keep=0.7):
    chosen, left = [0], list(range(1, len(scores)))
    while left and len(chosen) < k:
        best, at = -1, None
        for i in left:
            value = keep * scores[i] - (1 - keep) * max(abs(scores[i] - scores[j]) for j in chosen)
            if value > best:
                best, at = value, i
        if at is None:
            break
        chosen.append(at)
        left.remove(at)
    return chosen


def test_mmr_matches_brute_force(spark):
    import random

    rng = random.Random(1)
    lists = [sorted((round(rng.uniform(-2, rng.choice([2, 5])), 2) for _ in range(rng.randint(1, 30))), reverse=True) for _ in range(200)] + [[3.0] * 700]
    frame = spark.createDataFrame([(n, i, score) for n, scores in enumerate(lists) for i, score in enumerate(scores)], "g int, id int, score double")
    for k in (12, 600):
        got = {}
        for r in ranking.mmr(frame, k, "id", "g").orderBy("g", "rank").collect():
            got.setdefault(r.g, []).append(r.id)
        assert got == {n: brute_mmr(scores, k) for n, scores in enumerate(lists)}
    alone = ranking.mmr(frame.where("g = 5").drop("g"), 12, "id").orderBy("rank").collect()
    assert [r.id for r in alone] == brute_mmr(lists[5], 12) and alone[0].asDict().keys() == {"id", "score", "rank"}
    assert ranking.mmr(frame.limit(0), 3, "id", "g").count() == 0


def test_chunks(spark):
    assert context.split_text("") == [] and context.split_text("short") == ["short"]
    provisions = "\n".join(f"Art. {i} " + "palavra " * 60 for i in range(1, 12))
    chunks = context.split_text(provisions)
    assert len(chunks) > 1 and all(len(c) <= 1800 + 480 for c in chunks)
    assert all(f"Art. {i} " in "".join(chunks) for i in range(1, 12))
    blob = "x" * 5000
    assert [len(c) for c in context.split_text(blob)] == [1800, 1800, 1800, 500]
    tiny = "\n\n".join(["a" * 200] * 20)
    assert context.split_text(tiny)[1].startswith("a" * 200)
    rows = context.chunk_documents(spark.createDataFrame([(1, None), (2, "b")], "id long, text string"), "id").collect()
    assert [(r.id, r.chunk_id) for r in rows] == [(2, "2::c0")]


def brute_pack(rows, budget, per_doc=4, header=40):
    n, order = len(rows), []
    low, high = 0, n - 1
    while low <= high:
        order.append(rows[low])
        if low != high:
            order.append(rows[high])
        low, high = low + 1, high - 1
    docs = {}
    for rank, doc, size in order:
        if len(docs.setdefault(doc, [])) < per_doc:
            docs[doc].append((rank, size))
    used, kept = 0, []
    for held in docs.values():
        if used + header > budget:
            continue
        used += header
        for rank, size in held:
            if used + size > budget:
                break
            used += size
            kept.append(rank)
    return kept


def test_packing_matches_brute_force(spark):
    import random

    rng = random.Random(2)
    for n, budget in ((1, 10), (7, 900), (30, 3000), (25, 100_000)):
        rows = [(i + 1, f"d{rng.randint(0, 5)}", rng.randint(10, 400)) for i in range(n)]
        frame = spark.createDataFrame(rows, "rank int, doc string, size long")
        packed = context.pack_context(frame, "doc", "rank", F.col("size"), budget).orderBy("place").collect()
        assert [r["rank"] for r in packed] == brute_pack(rows, budget)


def test_paths(spark):
    edges = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 9)], "c string, p int")
    found = registry.relationship_paths(edges, ["a"], ["c", "d"], "c", "p", 2).collect()
    assert [(r.path, r.hops) for r in found] == [(["a", "1", "b", "2", "c"], 2)]
    assert registry.clamp(1000) == 100


def test_curation(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "k int, h string")
    new = spark.createDataFrame([(2, "x"), (3, None), (4, "d")], "k int, h string")
    assert {r.k: r.change for r in curation.registry_diff(old, new, "k", "h").collect()} == {1: "removed", 2: "modified", 3: "same", 4: "added"}
    assert curation.delete_documents(old, new, "k").count() == 1
    rows = spark.createDataFrame([("d", date(2020, 1, 9), date(2020, 1, 1)), ("d", date(2019, 12, 31), date(2020, 1, 1)), ("e", date(2019, 1, 1), None)], "doc string, date date, ref date")
    assert {r.doc: r.consensus for r in curation.consensus(rows, "doc", "date", "ref").collect()} == {"d": date(2019, 12, 31), "e": date(2019, 1, 1)}


def test_enrichment(spark):
    chunks = spark.createDataFrame([("Lei 1.pdf", 0, "LEI Nº 1\nPublicada no DOU de 05/01/2020"), ("Lei 1.pdf", 1, "Esta Lei entra em vigor após decorridos 10 dias."), ("x.pdf", 0, "nada")], "doc string, page int, text string")
    metadata = spark.createDataFrame([("lei_1", 7, "Revogada", None, "2021", date(2021, 3, 1), 2021, 2020)], "doc_name string, meta_id int, status string, start_text string, end_text string, revoker_start date, revoker_year int, own_year int")
    got = enrichment.enrich(chunks, metadata).orderBy("doc", "page").collect()
    assert len(got) == 3
    lei = got[0]
    assert (lei.status, lei.published, lei.start, lei.end, lei.vacatio_days, lei.matched) == ("revogado", date(2020, 1, 5), date(2020, 1, 15), date(2021, 3, 1), 10, "normalized")
    assert got[2].matched is None
    acts = spark.createDataFrame([("a", "b", "revogado", None, date(2000, 1, 1), None), ("b", None, "vigente", date(2010, 1, 1), None, None)], "k string, by string, status string, start date, published date, end date")
    assert {r.k: r.end for r in enrichment.propagate_ends(acts, "k", "by").collect()} == {"a": date(2010, 1, 1), "b": None}
    sheet = spark.createDataFrame([("lei1", "2022-02-02", " ")], "doc string, inicio string, fim string")
    base = spark.createDataFrame([("Lei 1.pdf", None, "old")], "doc string, start string, end string")
    assert enrichment.apply_sheet(base, sheet, "doc", {"inicio": "start", "fim": "end"}).first()[1:] == ("2022-02-02", "old")


def test_links_and_paths_are_whole(spark, tmp_path):
    """All companies of a partner, and paths against brute force over all edges, with a table of targets."""
    import random

    from verdigris import catalogue
    from verdigris.operators import registry as G

    spark.createDataFrame([(i, i) for i in range(150)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    lines = spark.createDataFrame([(i, 7, 50.0, "R") for i in range(150)], "l_orderkey long, l_suppkey long, l_quantity double, l_returnflag string")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["linked_companies"](spark, str(tmp_path)).collect()
    assert sorted((r.p, r.c) for r in got) == [(7, c) for c in range(1, 150)]

    rng = random.Random(4)
    pairs = sorted({(rng.randrange(12), rng.randrange(100, 106)) for _ in range(30)})
    edges = spark.createDataFrame(pairs, "c long, p long")
    first, ends = pairs[0][0], {c for c, _ in pairs if c % 3 == 0} - {pairs[0][0]}

    def walk(path):
        if len(path) > 1 and path[-1] in ends:
            yield tuple(path)
        elif len(path) < 5:
            for c, p in pairs:
                if c == path[-1]:
                    for other, via in pairs:
                        if via == p and str(other) not in map(str, path):
                            yield from walk([*path, p, other])

    want = sorted(tuple(map(str, path)) for path in walk([first]))
    table = edges.where(F.col("c").isin(list(ends))).select("c")
    for targets in (table, sorted(ends)):
        assert sorted(tuple(r.path) for r in G.relationship_paths(edges, [first], targets, "c", "p", 2).collect()) == want


def test_fingerprints_gather_no_group(spark):
    import hashlib

    from verdigris.operators import curation as C

    rows = [(s, i, None if i % 7 == 0 else f"t{i % 13}é") for i in range(3000) for s in (("a", None, "b")[i % 3],)] + [("c", None, "x"), ("c", 3, "y")]
    frame = C.fingerprint(spark.createDataFrame(rows, "source string, doc_id long, text string"), "source", "doc_id", "text")
    want = {}
    for source, i, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        n, lines = want.get(source, (0, ""))
        line = "" if i is None else f"{i}\x1f{hashlib.sha256((text or '').encode()).hexdigest()}\n"
        want[source] = (n + 1, lines + line)
    got = {r.source: (r.n_chunks, r.fingerprint) for r in frame.collect()}
    assert got == {k: (n, hashlib.sha256(lines.encode()).hexdigest()) for k, (n, lines) in want.items()}
    assert "collect_list" not in frame._jdf.queryExecution().toString()


def test_new_rows_are_numbered_without_one_window(spark, data):
    import re

    from verdigris import catalogue

    plan = catalogue.QUERIES["index_new_rows"](spark, str(data))._jdf.queryExecution().toString()
    assert not re.search(r"row_number\(\) windowspecdefinition\(k#", plan)
