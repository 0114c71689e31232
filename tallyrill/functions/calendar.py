"""Sessions of a United States equity calendar as plain SQL over a date range.

Rules: weekdays; New Year (Sunday moves to Monday, Saturday is not observed), Martin Luther King
day from 1998, Presidents' day, Good Friday, Memorial day, Juneteenth from 2022, Independence day,
Labor day, Thanksgiving, Christmas (Saturday moves to Friday, Sunday to Monday), and special closures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Special closures since 2001.
CLOSURES = ("2001-09-11", "2001-09-12", "2001-09-13", "2001-09-14", "2004-06-11", "2007-01-02", "2012-10-29", "2012-10-30", "2018-12-05", "2025-01-09")


def easter(year: str) -> str:
    """SQL for days from March 22 to Easter Sunday (Gregorian), for integer year."""
    a, c = f"({year} % 19)", f"floor({year} / 100)"
    h = f"((19 * {a} + {c} - floor({c} / 4) - floor(({c} - floor(({c} + 8) / 25) + 1) / 3) + 15) % 30)"
    lval = f"((32 + 2 * ({c} % 4) + 2 * floor(({year} % 100) / 4) - {h} - ({year} % 100) % 4) % 7)"
    m = f"floor(({a} + 11 * {h} + 22 * {lval}) / 451)"
    return f"cast({h} + {lval} - 7 * {m} as int)"


def session_condition(day: str, dow: str, doy_md: str, year: str, dom: str, month: str, easter_day: str) -> str:
    """SQL condition over a date's parts; dow counts from Sunday = 0."""

    def fixed(m: int, d: int, since: int = 0, saturday: bool = True) -> str:
        md = m * 100 + d
        parts = [f"({doy_md} = {md} and {dow} between 1 and 5)", f"({doy_md} = {md + 1} and {dow} = 1)"]
        if saturday:
            parts.append(f"({doy_md} = {md - 1} and {dow} = 5)")
        return f"({year} >= {since} and ({' or '.join(parts)}))"

    def nth(m: int, d: int, n: int, since: int = 0) -> str:
        return f"({year} >= {since} and {month} = {m} and {dow} = {d} and {dom} between {7 * n - 6} and {7 * n})"

    closed = [fixed(1, 1, saturday=False), nth(1, 1, 3, 1998), nth(2, 1, 3), f"({day} = {easter_day})", f"({month} = 5 and {dow} = 1 and {dom} >= 25)", fixed(6, 19, 2022), fixed(7, 4), nth(9, 1, 1), nth(11, 4, 4), fixed(12, 25)]
    special = ", ".join(f"date '{d}'" for d in CLOSURES)
    return f"{dow} between 1 and 5 and not ({' or '.join(closed)}) and {day} not in ({special})"


def spark_condition() -> str:
    good_friday = f"date_add(make_date(year(day), 3, 20), {easter('year(day)')})"
    return session_condition("day", "(dayofweek(day) - 1)", "(month(day) * 100 + day(day))", "year(day)", "day(day)", "month(day)", good_friday)


def is_session(day: Column) -> Column:
    """Whether a date is a session (for a column named ``day``)."""
    return F.expr(spark_condition())


def sessions(spark: SparkSession, first: str, last: str) -> DataFrame:
    """(day): sessions of the closed range."""
    days = spark.sql(f"select explode(sequence(date '{first}', date '{last}')) as day")
    return days.filter(is_session(F.col("day")))


def numbered(days: DataFrame) -> DataFrame:
    """Sessions with their ordinal; a calendar has some 252 rows a year, so one task orders it."""
    return days.withColumn("n", F.row_number().over(Window.orderBy("day")))


def duckdb_sessions(first: str, last: str) -> str:
    good_friday = f"(make_date(year(day), 3, 20) + {easter('year(day)')})::date"
    condition = session_condition("day", "dayofweek(day)", "(month(day) * 100 + day(day))", "year(day)", "day(day)", "month(day)", good_friday)
    return f"(select day from (select unnest(generate_series(date '{first}', date '{last}', interval 1 day))::date as day) where {condition})"
