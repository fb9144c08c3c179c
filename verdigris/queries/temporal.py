"""Queries over validity in time. Orders stand for acts: ordered is in force, shipped is revoked, one in seven has a bare year."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.functions import dates as D
from verdigris.operators import temporal as T
from verdigris.queries._registry import query

ACTS_SQL = """x AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY l_orderkey),
    r AS (SELECT o_orderkey, o_custkey, o_totalprice,
      CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS start_text,
      CASE WHEN o_orderstatus = 'O' THEN NULL WHEN o_orderkey % 5 = 0 THEN strftime(shipped, '%Y') ELSE strftime(shipped, '%Y-%m-%d') END AS end_text,
      CASE o_orderstatus WHEN 'F' THEN 'Revogado' WHEN 'P' THEN 'Revogação parcial' ELSE 'Em vigor' END AS status_text
      FROM orders LEFT JOIN x ON l_orderkey = o_orderkey),
    a AS (SELECT *, CASE WHEN length(start_text) = 4 THEN make_date(start_text::INT, 1, 1) ELSE start_text::DATE END AS s,
      CASE WHEN length(end_text) = 4 THEN make_date(end_text::INT, 12, 31) ELSE end_text::DATE END AS e,
      CASE status_text WHEN 'Revogado' THEN 'revogado' WHEN 'Em vigor' THEN 'vigente' ELSE 'parcialmente_revogado' END AS status FROM r)"""
ACTIVE_SQL = """coalesce(CASE WHEN s IS NOT NULL AND e IS NOT NULL THEN s <= {b} AND e >= {a} WHEN s IS NOT NULL THEN status <> 'revogado' AND s <= {b}
    WHEN e IS NOT NULL THEN e >= {a} ELSE status IN ('vigente', 'alterado', 'parcialmente_revogado') END, FALSE)"""
DAY = "DATE '1996-07-01'"
DAY_ACTIVE = ACTIVE_SQL.format(a=DAY, b=DAY)
FIRST, LAST = "DATE '1997-01-01'", "DATE '1997-03-31'"


def acts(table):
    """The acts with their texts, interval and status."""
    shipped = table("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("shipped"))
    rows = table("orders").join(shipped, "o_orderkey", "left")
    text = lambda c, year: F.when(year, F.date_format(c, "yyyy")).otherwise(F.date_format(c, "yyyy-MM-dd"))
    status = F.col("o_orderstatus")
    rows = rows.select(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        text("o_orderdate", F.col("o_orderkey") % 7 == 0).alias("start_text"),
        F.when(status != "O", text("shipped", F.col("o_orderkey") % 5 == 0)).alias("end_text"),
        F.when(status == "F", "Revogado").when(status == "P", "Revogação parcial").otherwise("Em vigor").alias("status_text"),
    )
    return rows.withColumns(
        {"s": T.effective_start(F.col("start_text")), "e": T.effective_end(F.col("end_text")), "status": T.canonical_status(F.col("status_text"))}
    )


def _day(text: str):
    return F.to_date(F.lit(text))


def _active(first: str, last: str | None = None):
    return T.active_in(F.col("s"), F.col("e"), F.col("status"), _day(first), _day(last or first))


@query(f"WITH {ACTS_SQL} SELECT o_orderkey, strftime(s, '%Y-%m-%d') AS s, strftime(e, '%Y-%m-%d') AS e, status FROM a")
def effective_interval(table, spark):
    """Intervals from ISO dates and bare years, and canonical status."""
    return acts(table).select("o_orderkey", F.date_format("s", "yyyy-MM-dd").alias("s"), F.date_format("e", "yyyy-MM-dd").alias("e"), "status")


@query(f"WITH {ACTS_SQL} SELECT o_orderkey FROM a WHERE {DAY_ACTIVE}")
def active_as_of(table, spark):
    """Acts in force on a day."""
    return acts(table).where(_active("1996-07-01")).select("o_orderkey")


@query(f"WITH {ACTS_SQL} SELECT o_orderkey FROM a WHERE {ACTIVE_SQL.format(a=FIRST, b=LAST)}")
def active_in_period(table, spark):
    """Acts in force at some time of a period."""
    return acts(table).where(_active("1997-01-01", "1997-03-31")).select("o_orderkey")


@query(
    f"""WITH {ACTS_SQL} SELECT o_orderkey, CASE WHEN {DAY_ACTIVE} THEN CASE status WHEN 'revogado' THEN 'vigente_na_data_e_revogada_posteriormente'
    WHEN 'parcialmente_revogado' THEN 'vigente_na_data_com_revogacao_parcial' ELSE 'vigente_na_data' END
    WHEN s > {DAY} THEN 'ainda_nao_vigente_no_periodo' WHEN status = 'revogado' THEN CASE WHEN e < {DAY} THEN 'revogada_antes_do_periodo' ELSE 'revogada_no_periodo_ou_sem_data_precisa' END
    ELSE 'nao_identificado' END AS label FROM a"""
)
def status_in_period(table, spark):
    """A label of each act's state on a day."""
    label = T.status_in(F.col("s"), F.col("e"), F.col("status"), _day("1996-07-01"), _day("1996-07-01"))
    return acts(table).select("o_orderkey", label.alias("label"))


@query(
    f"""WITH {ACTS_SQL} SELECT count(*)::BIGINT AS n_normative, count(*) FILTER (WHERE {DAY_ACTIVE})::BIGINT AS n_active, count(*) FILTER (WHERE status <> 'vigente')::BIGINT AS n_revoked,
    count(*) > 0 AND count(*) FILTER (WHERE {DAY_ACTIVE}) = 0 AS blocked FROM a"""
)
def temporal_gate(table, spark):
    """Whether an answer would rest on acts that are not in force."""
    return T.temporal_gate(acts(table), F.lit(True), _active("1996-07-01"), F.col("status") != "vigente")


@query(
    f"""WITH {ACTS_SQL}, b AS (SELECT *, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS by_key FROM a),
    k AS (SELECT DISTINCT by_key AS o_orderkey FROM b WHERE status = 'revogado' AND by_key IS NOT NULL)
    SELECT o_orderkey, round(o_totalprice / 1000000, 6) AS overlap FROM a JOIN k USING (o_orderkey) WHERE {DAY_ACTIVE} AND o_totalprice > 0 ORDER BY overlap DESC, o_orderkey LIMIT 25"""
)
def successor_recovery(table, spark):
    """Acts in force that revoked acts name as their successors: a customer's next order."""
    from pyspark.sql import Window

    rows = acts(table).withColumn("by_key", F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")))
    overlap = F.round(F.col("o_totalprice") / 1000000, 6)
    found = T.successors(rows.where("status = 'revogado'"), acts(table), "by_key", "o_orderkey", _active("1996-07-01"), overlap, 25, ["o_orderkey"])
    return found.select("o_orderkey", "overlap")


@query(
    f"""WITH {ACTS_SQL}, z AS (SELECT o_orderkey, o_totalprice AS score, {DAY_ACTIVE} AS active, status <> 'vigente' AS revoked FROM a),
    u AS (SELECT * FROM (SELECT o_orderkey, score, 'active' AS part, 1 AS place FROM z WHERE active ORDER BY score DESC, o_orderkey LIMIT 13)
      UNION ALL SELECT * FROM (SELECT o_orderkey, score, 'revoked', 2 FROM z WHERE revoked ORDER BY score DESC, o_orderkey LIMIT 7)
      UNION ALL SELECT * FROM (SELECT o_orderkey, score, 'pool', 3 FROM z ORDER BY score DESC, o_orderkey LIMIT 40)),
    f AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY place) AS n FROM u QUALIFY n = 1)
    SELECT o_orderkey, row_number() OVER (ORDER BY place, score DESC, o_orderkey)::INT AS rank, part FROM f QUALIFY rank <= 20"""
)
def temporal_selection(table, spark):
    """Twenty rows with places for active and for revoked acts."""
    rows = acts(table).withColumn("score", F.col("o_totalprice"))
    return T.temporal_selection(rows, 20, "o_orderkey", _active("1996-07-01"), F.col("status") != "vigente")


@query(
    r"""WITH t AS (SELECT o_orderkey, 'Publicado em ' || strftime(o_orderdate, '%d/%m/%Y') || ' e em ' || strftime(o_orderdate, '%Y-%m-%d') AS t FROM orders)
    SELECT o_orderkey, regexp_extract(t, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1) AS first_date, 1 AS n_dates FROM t"""
)
def date_extract(table, spark):
    """Dates in texts, in two forms, each once."""
    t = F.concat(F.lit("Publicado em "), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" e em "), F.date_format("o_orderdate", "yyyy-MM-dd"))
    found = table("orders").select("o_orderkey", D.all_dates(t).alias("d"))
    return found.select("o_orderkey", F.date_format(F.col("d")[0], "yyyy-MM-dd").alias("first_date"), F.size("d").alias("n_dates"))


@query(
    """WITH o AS (SELECT o_orderkey, o_orderdate::DATE AS d, o_orderkey % 4 AS n FROM orders), f AS (SELECT *, date_trunc('month', d)::DATE AS m FROM o)
    SELECT o_orderkey, strftime(d + n::INT, '%Y-%m-%d') AS by_day, strftime(d + to_months(n::INT), '%Y-%m-%d') AS by_month, strftime(d + to_years(n::INT), '%Y-%m-%d') AS by_year,
    strftime(m + CASE WHEN dayofweek(m) = 6 THEN 2 WHEN dayofweek(m) = 0 THEN 1 ELSE 0 END, '%Y-%m-%d') AS business FROM f"""
)
def date_arithmetic(table, spark):
    """Dates some days, months and years later, and a month's first business day."""
    d, n = F.to_date("o_orderdate"), F.col("o_orderkey") % 4
    shown = lambda c: F.date_format(c, "yyyy-MM-dd")
    by = {f"by_{u}": shown(D.advance(d, n, F.lit(u))) for u in ("day", "month", "year")}
    return table("orders").select("o_orderkey", *[c.alias(k) for k, c in by.items()], shown(D.first_business_day(d)).alias("business"))
