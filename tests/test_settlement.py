"""Dates, guards and settled ends against plain Python."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from verdigris.operators import settlement as S

ACTS = "key long, by long, published date, start date, end date"


def day(n):
    return date(2020, 1, 1) + timedelta(days=n)


def brute(acts):
    """Settled by recursion; a circle never returns."""
    table = {a[0]: a for a in acts}
    known = {}

    def settle(key, path):
        if key in known:
            return known[key]
        if key in path:
            return None
        _, by, published, start, end = table[key]
        if by is None or by not in table:
            known[key] = (end, None, None, "stated")
            return known[key]
        revoker = settle(by, path | {key})
        if revoker is None or revoker[3] == "circle":
            return None
        who, begins = by, table[by][3]
        if revoker[0] is not None and begins is not None and revoker[0] <= begins and revoker[1] is not None:
            who, begins = revoker[1], revoker[2]
        follows = begins is not None and (published is None or begins >= published)
        known[key] = (begins if follows else end, who, begins, "settled")
        return known[key]

    for a in acts:
        if settle(a[0], frozenset()) is None:
            known[a[0]] = (a[4], None, None, "circle")
    return {k: (v[0], v[1], v[3]) for k, v in known.items()}


def check(spark, acts):
    got = {r.key: (r.settled_end, r.settled_by, r.state) for r in S.settle_ends(spark.createDataFrame(acts, ACTS), "key", "by", "published", "start", "end").collect()}
    assert got == brute(acts)
    return got


def test_chain_of_three_and_a_revoker_never_in_force(spark):
    chain = [(1, 2, day(0), day(1), None), (2, 3, day(10), day(20), None), (3, None, day(30), day(40), day(99))]
    assert check(spark, chain) == {1: (day(20), 2, "settled"), 2: (day(40), 3, "settled"), 3: (day(99), None, "stated")}
    # The second would begin after the third ended it: it never was in force, and the third ends the first too.
    void = [(1, 2, day(0), day(1), None), (2, 3, day(10), day(60), None), (3, None, day(30), day(40), None)]
    assert check(spark, void)[1] == (day(40), 3, "settled")


def test_circles_keep_what_is_stated(spark):
    acts = [(1, 2, day(0), day(1), day(7)), (2, 3, None, day(2), None), (3, 2, None, day(3), None), (4, 4, None, None, day(5)), (5, 9, None, None, day(6)), (6, 5, None, None, None)]
    got = check(spark, acts)
    assert [got[i][2] for i in range(1, 7)] == ["circle", "circle", "circle", "circle", "stated", "settled"] and got[1][0] == day(7)


def test_random_graphs(spark):
    rng = random.Random(5)
    maybe = lambda: rng.choice([None, day(rng.randint(0, 30))])
    acts = [(i, rng.choice([None, rng.randint(0, 160), rng.randint(0, 130)]), maybe(), maybe(), maybe()) for i in range(130)]
    acts[7], acts[8], acts[9] = (7, 8, *acts[7][2:]), (8, 7, *acts[8][2:]), (9, 8, *acts[9][2:])
    got = check(spark, acts)
    assert {v[2] for v in got.values()} == {"stated", "settled", "circle"}
    assert S.settle_ends(spark.createDataFrame([], ACTS), "key", "by", "published", "start", "end").count() == 0


def test_publication_comes_from_the_best_bucket(spark):
    long = "x" * 2000
    rows = [
        ("a 2019-05-05", "Publicado no DOU de 03/04/2018", None, 2018), ("a 2019-05-05", "sem data\nDiário Oficial de 3 de maio de 2018 e 01/01/2011", None, None),
        ("b 2017-01-02", f"01/02/2016 {long}", "titulo de 05/06/2017", 2016), ("c", f"{long} 07/08/2015", None, 2000), ("c", f"09/10/2014 {long}", None, 2000), ("d", None, None, 2000),
        ("e", "1/1/1999 e 1/1/2001", "", 2000), ("f", "1/3/2001 e 1/2/1999", "", None), (None, "Publicada em 02/02/2002", None, 2002),
    ]
    got = {r.doc: (r.published, r.bucket) for r in S.publication_dates(spark.createDataFrame(rows, "doc string, text string, title string, year int"), "doc", "text", "title", "year").collect()}
    assert got == {
        "a 2019-05-05": (date(2018, 4, 3), "markers"), "b 2017-01-02": (date(2017, 1, 2), "title"), "c": (date(2014, 10, 9), "head"), "d": (None, None),
        "e": (date(1999, 1, 1), "head"), "f": (date(1999, 2, 1), "head"), None: (date(2002, 2, 2), "markers"),
    }


def test_guards_of_partial_and_inline_revocations(spark):
    cases = [
        (("revogado", "line", False, "vigente", "parcial", None), ("revogado", "total", True)),
        (("revogado", "inline", False, "vigente", "Parcial", None), ("parcialmente_revogado", "parcial", False)),
        (("revogado", "line", True, "vigente", None, True), ("parcialmente_revogado", "parcial", False)),
        (("revogado", "line", False, "revogado", None, True), ("revogado", "total", True)),
        (("revogado", "inline", False, "Vigente", None, None), None),
        (("revogado", "inline", False, "revogado", None, None), ("revogado", "total", True)),
        (("parcialmente_revogado", "inline", True, "vigente", None, None), ("parcialmente_revogado", "parcial", False)),
        ((None, None, None, "vigente", "parcial", True), None),
    ]
    frame = spark.createDataFrame([(i, *c) for i, (c, _) in enumerate(cases)], "i int, said string, mode string, partial boolean, status string, kind string, some boolean")
    for r in frame.select("i", S.believed_revocation(*[F.col(c) for c in ("said", "mode", "partial", "status", "kind", "some")]).alias("b")).collect():
        assert (r.b and tuple(r.b)) == cases[r.i][1], cases[r.i]


def test_acts_without_a_revoker_go_through_no_join(spark, monkeypatch):
    plans, written = [], S.staged
    monkeypatch.setattr(S, "staged", lambda df, name: (plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())), written(df, name))[1])
    acts = [(i, 1 if i % 10 == 3 else None, None, day(1), day(5)) for i in range(50)]
    got = {r.key: r.state for r in S.settle_ends(spark.createDataFrame(acts, ACTS), "key", "by", "published", "start", "end").collect()}
    assert got == {i: "settled" if i % 10 == 3 else "stated" for i in range(50)}
    first = next(p for name, p in plans if name == "settled")
    join = first[first.index("LeftAnti") :]
    assert "Filter isnull(by" not in join and "Filter isnotnull(by" in join and "Filter isnull(by" in first  # nulls of a join are one task's
