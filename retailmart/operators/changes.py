"""Edits applied as batches.

Every operator takes the current table and a DataFrame of changes with a unique
``change_id`` that gives their order, and returns ``(new_table, results)``;
``results`` has one row per change: ``change_id``, ``accepted``, ``reason``.
The current table is never written to; store the new one under a fresh path.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import date_from_parts, parse_form_date, population_band
from ..schema import TABLES
from .constraints import (
    REASON,
    check_failures,
    first_reason,
    length_failures,
    null_failures,
)

Change = tuple[DataFrame, DataFrame]

ID = "change_id"


def _results(changes: DataFrame) -> DataFrame:
    return changes.select(ID, F.col(REASON).isNull().alias("accepted"), REASON)


def _accept_all(changes: DataFrame) -> DataFrame:
    return _results(changes.withColumn(REASON, F.lit(None).cast("string")))


def _mark(changes: DataFrame, table: DataFrame, keys: Sequence[str], flag: str) -> DataFrame:
    """Flag the changes whose key is in ``table``, which holds each key once."""
    hits = table.select(*keys, F.lit(True).alias(flag))
    return changes.join(hits, list(keys), "left")


def _insert(
    name: str,
    table: DataFrame,
    changes: DataFrame,
    parents: Mapping[str, DataFrame] | None = None,
    failures: Mapping[str, Column] | None = None,
) -> Change:
    """Insert rows: constraints first, then the lowest change_id of each key wins.

    The winners are an aggregate joined back on the unique change_id, so a key
    that fills the batch stays spread over all tasks.
    """
    spec = TABLES[name]
    row = changes.select(
        ID, *(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in spec.schema)
    )
    known = _mark(row, table, spec.primary_key, "_taken")
    broken = {
        **(failures or {}),
        **null_failures(spec.columns),
        **length_failures(spec.text_columns),
        **check_failures(spec.checks),
        "duplicate key": F.col("_taken"),
    }
    for key in spec.foreign_keys:
        known = _mark(known, (parents or {})[key.parent], key.columns, f"_{key.parent}")
        broken[f"no such {key.parent}"] = F.col(f"_{key.parent}").isNull()
    judged = known.withColumn(REASON, first_reason(broken))
    winners = (
        judged.filter(F.col(REASON).isNull())
        .groupBy(*spec.primary_key)
        .agg(F.min(ID).alias(ID))
        .select(ID, F.lit(True).alias("_won"))
    )
    settled = judged.join(winners, ID, "left").withColumn(
        REASON, F.coalesce(REASON, F.when(F.col("_won").isNull(), "duplicate key"))
    )
    added = settled.filter(F.col(REASON).isNull()).select(*spec.columns)
    return table.select(*spec.columns).unionByName(added), _results(settled)


def dated(changes: DataFrame) -> DataFrame:
    """Changes with their CalendarDate as a date, whichever way they give it."""
    if "CalendarDate" not in changes.columns:
        parts = date_from_parts(F.col("year"), F.col("month"), F.col("day"))
        changes = changes.withColumn("CalendarDate", parts)
    if isinstance(changes.schema["CalendarDate"].dataType, T.StringType):
        changes = changes.withColumn("CalendarDate", parse_form_date(F.col("CalendarDate")))
    return changes


def add_holidays(holiday: DataFrame, cdate: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, HolidayName, and CalendarDate (a date, or month/day/year
    text) or the whole numbers year, month and day."""
    changes = dated(changes)
    unreadable = {"no such date": F.col("CalendarDate").isNull()}
    return _insert("Holiday", holiday, changes, {"Cdate": cdate}, unreadable)


def add_managers(manager: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, Email, manager_name, EmploymentStatus."""
    return _insert("Manager", manager, changes)


def remove_managers(manager: DataFrame, assigned: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, Email. Refused while the manager has a store.

    Changes meet the assignments as they are, so that adaptive execution can split an
    Email that fills the batch.
    """
    staffed = assigned.select("Email")
    held = changes.join(staffed, "Email", "left_semi").withColumn(REASON, F.lit("still assigned"))
    free = changes.join(staffed, "Email", "left_anti")
    judged = held.unionByName(free.withColumn(REASON, F.lit(None).cast("string")))
    rest = manager.join(free.select("Email"), "Email", "left_anti")
    return rest.select(*manager.columns), _results(judged)


def _set_status(manager: DataFrame, changes: DataFrame, status: int) -> Change:
    named = changes.select("Email").distinct().withColumn("_named", F.lit(True))
    new_status = F.when(F.col("_named"), F.lit(status)).otherwise(F.col("EmploymentStatus"))
    updated = manager.join(named, "Email", "left").withColumn("EmploymentStatus", new_status)
    return updated.select(*manager.columns), _accept_all(changes)


def activate_managers(manager: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, Email. An unknown Email changes nothing."""
    return _set_status(manager, changes, 1)


def deactivate_managers(manager: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, Email. An unknown Email changes nothing."""
    return _set_status(manager, changes, 0)


def assign_managers(
    assigned: DataFrame, manager: DataFrame, store: DataFrame, changes: DataFrame
) -> Change:
    """``changes``: change_id, Email, StoreNumber."""
    return _insert("AssignedTo", assigned, changes, {"Manager": manager, "Store": store})


def unassign_managers(assigned: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, Email, StoreNumber. No match changes nothing."""
    keys = ["Email", "StoreNumber"]
    rest = assigned.join(changes.select(*keys), keys, "left_anti")
    return rest.select(*assigned.columns), _accept_all(changes)


def update_population(city: DataFrame, changes: DataFrame) -> Change:
    """``changes``: change_id, CityName, State, population.

    The size band follows the population. Of several accepted changes to a city
    the highest change_id stays. An unknown city changes nothing.
    """
    keys = ["CityName", "State"]
    wanted = changes.select(ID, *keys, F.col("population").try_cast("int").alias("population"))
    judged = _mark(wanted, city, keys, "_known").withColumn(
        REASON,
        first_reason(
            {
                "population is no int": F.col("population").isNull(),
                "check population_nonnegative": F.col("_known") & (F.col("population") < 0),
            }
        ),
    )
    latest = (
        judged.filter(F.col(REASON).isNull())
        .groupBy(*keys)
        .agg(F.max_by("population", ID).alias("_population"))
    )
    population = F.coalesce("_population", "population")
    band = F.when(
        F.col("_population").isNotNull(), population_band(F.col("_population"))
    ).otherwise(F.col("city_size"))
    updated = city.join(latest, keys, "left").withColumns(
        {"population": population, "city_size": band}
    )
    return updated.select(*city.columns), _results(judged)


# Each edit with the tables it takes, the edited one first. A change concerns rows of its own key
# alone, so an edit of the slices that hold the keys is the edit of the table.
EDITED: Mapping[Callable[..., Change], tuple[str, ...]] = {
    add_holidays: ("Holiday", "Cdate"),
    add_managers: ("Manager",),
    remove_managers: ("Manager", "AssignedTo"),
    activate_managers: ("Manager",),
    deactivate_managers: ("Manager",),
    assign_managers: ("AssignedTo", "Manager", "Store"),
    unassign_managers: ("AssignedTo",),
    update_population: ("City",),
}
