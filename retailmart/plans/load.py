"""Constraint-checked load of cleaned tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import cache, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..lazy import LazyFrames
from ..operators.cleaning import coerce_types, keep_first
from ..operators.constraints import (
    REASON,
    check_failures,
    check_foreign_keys,
    check_primary_key,
    domain_failures,
    duplicate_key,
    first_reason,
    length_failures,
    no_parent,
    null_failures,
    split_rows,
    union_all,
)
from ..schema import LOAD_ORDER, TABLES, TableSpec
from ..sources.catalog import judged_rows


def _text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*(F.col(name).cast("string").alias(name) for name in columns), REASON)


def _fold(rows: DataFrame, spec: TableSpec) -> tuple[DataFrame, DataFrame]:
    """Each row once, and its repeats as rejects of the primary key."""
    counted = rows.groupBy(*spec.columns).agg(F.count(F.lit(1)).alias("_rows"))
    reason = duplicate_key(spec.primary_key)
    repeats = counted.filter("_rows > 1").withColumn("_rows", F.explode(F.sequence(F.lit(2), F.col("_rows").cast("int"))))
    return counted.select(*spec.columns), repeats.select(*spec.columns, reason.alias(REASON))


def check_table(
    spec: TableSpec,
    table: DataFrame,
    parents: Mapping[str, DataFrame],
    order: Sequence[str] = (),
    cleaned: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Apply every constraint of one table.

    Returns the accepted rows in the stored types, and the rejected rows as text
    with the first constraint they break. Type, null, length and CHECK conditions
    are one pass; then the primary key, then each foreign key.

    ``order`` tells which of two rows with the same key came first; without it the
    smaller row does, and of equal rows one. A caller that has just made a table unique
    on its cleaning key says so with ``cleaned``; then the primary key is only checked
    where it is another one.
    """
    rows, bad = split_rows(table, _row_failures(spec, table))
    rejects = [_text(bad, spec.columns)]
    if not cleaned or set(spec.clean_key) != set(spec.primary_key):
        lines = list(order)
        if not lines:  # of equal rows the first is the same as the others; the rest go by content
            rows, equal = _fold(rows, spec)
            rejects.append(_text(equal, spec.columns))
            lines = [c for c in spec.columns if c not in spec.primary_key]
        if lines:
            rows, bad = check_primary_key(rows, spec.primary_key, lines)
            rejects.append(_text(bad, spec.columns))
    rows = coerce_types(rows, spec.schema)
    if spec.foreign_keys:
        known = [(parents[key.parent], key.columns) for key in spec.foreign_keys]
        rows, bad = check_foreign_keys(rows, known)
        rejects.append(_text(bad, spec.columns))
    return rows, union_all(rejects)


def _row_failures(spec: TableSpec, table: DataFrame) -> dict[str, Column]:
    return {
        **domain_failures(table, spec.schema),
        **null_failures(spec.columns),
        **length_failures(spec.text_columns),
        **check_failures(spec.checks),
    }


def _later_rows(rows: DataFrame, spec: TableSpec, order: Sequence[str]) -> DataFrame:
    """Rows with the reason of those that come after another row of their primary key.

    Repeats of an equal row are counted first, and the winner of a key is found by its
    smallest line, so that no task holds a whole hot key.
    """
    reason, keys = duplicate_key(spec.primary_key), list(spec.primary_key)
    lines = [c for c in order if c not in keys] or [c for c in spec.columns if c not in keys]
    names = [c for c in rows.columns if c != REASON]
    folded = rows.groupBy(*names, REASON).agg(F.count(F.lit(1)).cast("int").alias("_rows"))
    sound = folded.filter(F.col(REASON).isNull())
    first = keep_first(sound, keys, lines) if lines else sound
    won = first.select(*(F.col(c).alias(f"_won_{c}") for c in [*keys, *lines]), F.lit(True).alias("_won"))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in [*keys, *lines]))
    judged = folded.join(won, same, "left").withColumn("_row", F.explode(F.sequence(F.lit(1), F.col("_rows"))))
    later = F.col("_won").isNull() | (F.col("_row") > 1)
    return judged.select(*names, F.when(F.col(REASON).isNull() & later, reason).otherwise(F.col(REASON)).alias(REASON))


def judge_table(
    spec: TableSpec,
    table: DataFrame,
    parents: Mapping[str, DataFrame],
    order: Sequence[str] = (),
    cleaned: bool = False,
    existing: DataFrame | None = None,
) -> DataFrame:
    """Every row of a table with its verdict, as it is stored (``judged_rows``), from one evaluation.

    The constraints and their order are those of ``check_table``: accepted rows have no
    reason, the others the first constraint they break. ``existing`` holds rows that were
    loaded before; their keys are taken. Only rows of such keys are fetched from it.
    """
    extra = [c for c in order if c not in spec.columns]
    rows = table.select(*spec.columns, *extra).withColumn(REASON, first_reason(_row_failures(spec, table)))
    if not cleaned or set(spec.clean_key) != set(spec.primary_key):
        rows = _later_rows(rows, spec, order)
    rows = rows.select(*spec.columns, REASON)
    keys, reason = list(spec.primary_key), F.col(REASON)
    if existing is not None:
        typed = coerce_types(rows.filter(reason.isNull()), spec.schema).select(*keys).distinct()
        taken = existing.select(*keys).join(typed, keys, "left_semi")
        taken = taken.select(*(F.col(c).alias(f"_old_{c}") for c in keys), F.lit(True).alias("_taken"))
        same = reduce(and_, (F.col(c).try_cast(spec.schema[c].dataType) == F.col(f"_old_{c}") for c in keys))
        rows = rows.join(taken, same, "left")
        reason = F.coalesce(reason, F.when(F.col("_taken"), duplicate_key(keys)))
    for number, key in enumerate(spec.foreign_keys):
        known = parents[key.parent].select(
            *(F.col(c).alias(f"_parent{number}_{c}") for c in key.columns), F.lit(True).alias(f"_known{number}")
        )
        same = reduce(and_, (
            F.col(c).try_cast(spec.schema[c].dataType) == F.col(f"_parent{number}_{c}") for c in key.columns
        ))
        rows = rows.join(known, same, "left")
        reason = F.coalesce(reason, F.when(F.col(f"_known{number}").isNull(), no_parent(key.columns)))
    return judged_rows(rows, spec, reason)


def load_tables(
    clean: Mapping[str, DataFrame],
    order: Mapping[str, Sequence[str]] | None = None,
    cleaned: bool = False,
) -> tuple[Mapping[str, DataFrame], Mapping[str, DataFrame]]:
    """Check all tables, parents first: (accepted tables, rejected rows by table)."""

    @cache
    def check(name: str) -> tuple[DataFrame, DataFrame]:
        lines = (order or {}).get(name, ())
        return check_table(TABLES[name], clean[name], tables, lines, cleaned)

    tables = LazyFrames({name: (lambda name=name: check(name)[0]) for name in LOAD_ORDER})
    rejects = LazyFrames({name: (lambda name=name: check(name)[1]) for name in LOAD_ORDER})
    return tables, rejects
