"""Dates in records and texts: ISO, day/month/year, months by name, bare years."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.functions.text import normalize

#: The months' names without accents, in order.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")


def iso_date(text: Column) -> Column:
    """The date that a text begins with, or null."""
    head = F.substring(F.trim(text), 1, 10)
    return F.when(F.rlike(head, F.lit("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.try_to_date(head, "yyyy-MM-dd"))


def bare_year(text: Column) -> Column:
    """A text that is nothing but a year from 1000 to 2999."""
    return F.when(F.rlike(F.trim(text), F.lit("^[12][0-9]{3}$")), F.trim(text).try_cast("int"))


def full_year(year: Column) -> Column:
    """Two-digit years: 00 to 49 lie in this century, 50 to 99 in the last."""
    return F.when(year < 50, 2000 + year).when(year < 100, 1900 + year).otherwise(year)


def safe_date(year: Column, month: Column, day: Column) -> Column:
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def day_month_year(text: Column) -> Column:
    """``dd/mm/yy(yy)`` or ``dd de month de yyyy``, the first in the text, as a date."""
    t = normalize(text)
    number = r"\b([0-3]?[0-9])[/.-]([01]?[0-9])[/.-]([0-9]{4}|[0-9]{2})\b"
    part = lambda k: F.regexp_extract(t, number, k).try_cast("int")
    names = "|".join(MONTHS)
    words = rf"\b([0-3]?[0-9])o? de ({names}) de ([0-9]{{4}}|[0-9]{{2}})\b"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.regexp_extract(t, words, 2)).cast("int")
    named = lambda k: F.regexp_extract(t, words, k).try_cast("int")
    return F.coalesce(safe_date(full_year(part(3)), part(2), part(1)), safe_date(full_year(named(3)), month, named(1)))


def all_dates(text: Column) -> Column:
    """All ISO and day/month/year dates of a text, each once, in order of form and place."""
    iso = F.regexp_extract_all(text, F.lit(r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b"), F.lit(1))
    local = F.regexp_extract_all(text, F.lit(r"\b([0-3]?[0-9]/[01]?[0-9]/[0-9]{4})\b"), F.lit(1))
    made = F.concat(F.transform(iso, iso_date), F.transform(local, day_month_year))
    return F.array_distinct(F.array_compact(made))


def first_business_day(date: Column) -> Column:
    """The first day of the date's month that is no Saturday or Sunday."""
    first = F.trunc(date, "month")
    return F.date_add(first, F.when(F.dayofweek(first) == 7, 2).when(F.dayofweek(first) == 1, 1).otherwise(0))


def advance(date: Column, amount: Column, unit: Column) -> Column:
    """The date some days, months or years later; months end where the month ends."""
    n = amount.cast("int")
    return F.when(unit == "day", F.date_add(date, n)).when(unit == "month", F.add_months(date, n)).when(unit == "year", F.add_months(date, 12 * n))
