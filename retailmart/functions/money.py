"""Exact amounts of money.

Prices are doubles. An amount is the price in its shortest decimal form, taken to ten places,
times a whole number of units: no rounding of a product of doubles shows in it, it does not
depend on where units were summed, and sums do not depend on the order in which tasks
finish. Only a finished sum becomes a double again. A price that is no such decimal, such as
an infinite one, is an error and never a null; loads reject infinite prices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY_DIGITS = 10
PRICE = f"decimal(20,{MONEY_DIGITS})"
UNITS = "decimal(15,0)"
# A price times units fills it exactly; the sum of two still has all its places.
AMOUNT = f"decimal(36,{MONEY_DIGITS})"


def _exact(value: Column, kind: str) -> Column:
    too_large = F.concat(F.lit("no exact amount of money: "), value.cast("string"))
    fitting = F.coalesce(value.try_cast(kind), F.raise_error(too_large).cast(kind))
    return F.when(value.isNotNull(), fitting)


def amount(price: Column, units: Column) -> Column:
    """The exact price of so many units; null if either is null."""
    return _exact(price, PRICE) * _exact(units, UNITS)


def money_sum(amounts: Column) -> Column:
    """Exact sum of amounts, as an amount."""
    return _exact(F.sum(amounts), AMOUNT)


def money(amounts: Column) -> Column:
    """A finished amount in double."""
    return amounts.cast("double")
