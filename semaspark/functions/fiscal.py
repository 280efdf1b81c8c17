"""Fiscal calendar: the year starts on February 1 and is named by its end.

Functions of columns stay in generated code; functions of dates are computed on
the driver, so that windows reach the scan as literals.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START_MONTH = 2


def fiscal_year(d: Column) -> Column:
    return F.year(d) + F.when(F.month(d) >= START_MONTH, 1).otherwise(0)


def fiscal_month(d: Column) -> Column:
    return F.pmod(F.month(d) - START_MONTH, F.lit(12)) + 1


def fiscal_quarter(d: Column) -> Column:
    return F.floor((fiscal_month(d) - 1) / 3).cast("int") + 1


def fiscal_year_start(d: Column) -> Column:
    return F.make_date(fiscal_year(d) - 1, F.lit(START_MONTH), F.lit(1))


def fiscal_quarter_start(d: Column) -> Column:
    return F.add_months(fiscal_year_start(d), (fiscal_quarter(d) - 1) * 3)


def quarter_label(d: Column) -> Column:
    return F.concat(F.lit("FY"), fiscal_year(d).cast("string"), F.lit("-Q"), fiscal_quarter(d).cast("string"))


@dataclass(frozen=True)
class Period:
    """A half-open range of dates."""

    start: date
    end: date
    label: str


def _year_of(d: date) -> int:
    return d.year + (d.month >= START_MONTH)


def _shift(d: date, months: int) -> date:
    at = d.year * 12 + d.month - 1 + months
    return date(at // 12, at % 12 + 1, 1)


def fiscal_year_range(year: int) -> Period:
    return Period(date(year - 1, START_MONTH, 1), date(year, START_MONTH, 1), f"FY{year}")


def fiscal_quarter_range(year: int, quarter: int) -> Period:
    start = _shift(date(year - 1, START_MONTH, 1), 3 * (quarter - 1))
    return Period(start, _shift(start, 3), f"FY{year}-Q{quarter}")


def last_completed_fiscal_quarter(as_of: date) -> Period:
    quarter = (as_of.month - START_MONTH) % 12 // 3 + 1
    day = fiscal_quarter_range(_year_of(as_of), quarter).start - timedelta(days=1)
    return fiscal_quarter_range(_year_of(day), (day.month - START_MONTH) % 12 // 3 + 1)


def last_completed_fiscal_year(as_of: date) -> Period:
    return fiscal_year_range(_year_of(as_of) - 1)


def last_completed_month(as_of: date) -> Period:
    end = as_of.replace(day=1)
    start = _shift(end, -1)
    return Period(start, end, start.strftime("%Y-%m"))


def last_calendar_quarter(as_of: date) -> Period:
    end = date(as_of.year, (as_of.month - 1) // 3 * 3 + 1, 1)
    start = _shift(end, -3)
    return Period(start, end, f"{start.year}-Q{(start.month - 1) // 3 + 1}")


def last_calendar_year(as_of: date) -> Period:
    return Period(date(as_of.year - 1, 1, 1), date(as_of.year, 1, 1), str(as_of.year - 1))


def calendar(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day of [start, end) with its fiscal columns."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end - timedelta(days=1)))).alias("calendar_date"))
    d = F.col("calendar_date")
    return days.select(
        d, fiscal_year(d).alias("fiscal_year"), fiscal_quarter(d).alias("fiscal_quarter"), quarter_label(d).alias("fiscal_quarter_label"),
        fiscal_month(d).alias("fiscal_month"), fiscal_year_start(d).alias("fiscal_year_start"), fiscal_quarter_start(d).alias("fiscal_quarter_start"),
    )
