"""Column expressions shared by cleaning, edits and reports. All stay in the JVM."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Band names with their exclusive upper population bounds, the
# largest discount a maker may grant, and the form's date layout.
POPULATION_BANDS = (("Small", 3_700_000), ("Medium", 6_700_000), ("Large", 9_000_000))
TOP_BAND = "Extra Large"
BAND_NAMES = ("Small", "Medium", "Large", "Extra Large")
MAX_DISCOUNT = 0.9
FORM_DATE = "M/d/yyyy"


def city_state(city: Column, state: Column) -> Column:
    """``'city, state'``; null when either part is null."""
    return F.concat(city, F.lit(", "), state)


def full_name(first: Column, last: Column) -> Column:
    """``'first last'``; null when either part is null."""
    return F.concat(first, F.lit(" "), last)


def population_band(population: Column) -> Column:
    """Size band of a population; lower bounds are inclusive, null stays null."""
    band = F.when(population.isNull(), F.lit(None).cast("string"))
    for name, upper in POPULATION_BANDS:
        band = band.when(population < upper, name)
    return band.otherwise(TOP_BAND)


def repair_discount(discount: Column) -> Column:
    """A discount outside [0, 0.9], null or NaN becomes 0.9."""
    return F.when(discount.between(0.0, MAX_DISCOUNT), discount).otherwise(MAX_DISCOUNT)


def parse_form_date(text: Column) -> Column:
    """Date from month/day/year text, padded or not; null if there is no such date."""
    return F.try_to_date(text, FORM_DATE)


def date_from_parts(year: Column, month: Column, day: Column) -> Column:
    """Date from its parts; null if there is no such date."""
    return F.try_to_date(F.format_string("%d-%d-%d", year, month, day), "y-M-d")


def year_month_label(year: Column, month: Column) -> Column:
    """``'1998/08'``."""
    return F.format_string("%d/%02d", year, month)


def in_period(date: Column, year: int | None = None, month: int | None = None) -> Column | None:
    """Condition that ``date`` lies in the year, or month of the year.

    With a year the condition is a half-open date range, so both bounds reach
    the Parquet scan and skip row groups; ``year(date) = …`` would not.
    Returns None when neither part is given.
    """
    if year is None:
        return None if month is None else F.month(date) == month
    first = dt.date(year, month or 1, 1)
    months = 1 if month else 12
    after = first.month - 1 + months
    last = dt.date(first.year + after // 12, after % 12 + 1, 1)
    return (date >= F.lit(first)) & (date < F.lit(last))
