"""Constraint operators. Each splits a table into (accepted, rejected).

Rejected rows carry the broken constraint in the ``reason`` column. Both parts
are lazy, so a caller that ignores the rejects does not pay for them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import cache, partial, reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lazy import LazyFrames
from ..schema import TABLES, TEXT_LIMIT, children_of
from .cleaning import keep_first

REASON = "reason"

Split = tuple[DataFrame, DataFrame]
# Reason -> condition under which a row fails for it.
Failures = Mapping[str, Column]


def null_failures(columns: Sequence[str]) -> dict[str, Column]:
    return {f"null in {name}": F.col(name).isNull() for name in columns}


def length_failures(columns: Sequence[str], limit: int = TEXT_LIMIT) -> dict[str, Column]:
    return {f"{name} longer than {limit}": F.length(name) > limit for name in columns}


def check_failures(checks: Mapping[str, str]) -> dict[str, Column]:
    return {f"check {name}": ~F.expr(condition) for name, condition in checks.items()}


def domain_failures(df: DataFrame, schema: T.StructType) -> dict[str, Column]:
    failures = {}
    for target in schema:
        column, source = F.col(target.name), df.schema[target.name].dataType
        if isinstance(source, (T.DoubleType, T.FloatType)):
            unfit = F.isnan(column) | (F.abs(column) == float("inf")) | column.try_cast(target.dataType).isNull()
        elif source != target.dataType:
            unfit = column.try_cast(target.dataType).isNull()
        else:
            continue
        reason = f"{target.name} is no {target.dataType.simpleString()}"
        failures[reason] = column.isNotNull() & unfit
    return failures


def first_reason(failures: Failures) -> Column:
    """The first reason whose condition holds, or null."""
    return F.coalesce(
        F.lit(None).cast("string"),
        *(F.when(failed, reason) for reason, failed in failures.items()),
    )


def split_rows(df: DataFrame, failures: Failures) -> Split:
    """Split on row-local conditions; the first failing one is the reason."""
    marked = df.withColumn(REASON, first_reason(failures))
    accepted = marked.filter(F.col(REASON).isNull()).drop(REASON)
    return accepted, marked.filter(F.col(REASON).isNotNull())


def check_not_null(df: DataFrame, columns: Sequence[str]) -> Split:
    return split_rows(df, null_failures(columns))


def check_predicate(df: DataFrame, name: str, condition: str) -> Split:
    """An unknown (null) outcome passes, as for a SQL CHECK."""
    return split_rows(df, check_failures({name: condition}))


def check_max_length(df: DataFrame, column: str, limit: int = TEXT_LIMIT) -> Split:
    return split_rows(df, length_failures([column], limit))


def check_domain(df: DataFrame, schema: T.StructType) -> Split:
    """Rows whose values all convert to the schema's types, converted."""
    accepted, rejected = split_rows(df, domain_failures(df, schema))
    casts = {f.name: F.col(f.name).try_cast(f.dataType) for f in schema}
    return accepted.withColumns(casts), rejected


def duplicate_key(keys: Sequence[str]) -> Column:
    return F.lit(f"duplicate key ({', '.join(keys)})")


def check_primary_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    existing: DataFrame | None = None,
) -> Split:
    """First row of each key wins, unless ``existing`` already holds the key.

    ``order`` must be total within a key. The losers come from a join to the
    winners on key and line together, which no two rows share, so no task has to hold a
    whole hot key.
    """
    keys = list(keys)
    duplicate = duplicate_key(keys)
    accepted = keep_first(df, keys, order)
    lines = [*keys, *(c for c in order if c not in keys)]
    won = accepted.select(*(F.col(c).alias(f"_won_{c}") for c in lines))
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(f"_won_{c}")) for c in lines))
    rejected = df.join(won, same, "left_anti")
    if existing is not None:
        taken = existing.select(*keys)
        rejected = rejected.unionByName(accepted.join(taken, keys, "left_semi"))
        accepted = accepted.join(taken, keys, "left_anti")
    return accepted.select(*df.columns), rejected.withColumn(REASON, duplicate)


def no_parent(keys: Sequence[str]) -> str:
    return f"no parent for ({', '.join(keys)})"


def check_foreign_key(child: DataFrame, parent: DataFrame, keys: Sequence[str]) -> Split:
    return check_foreign_keys(child, [(parent, keys)])


def check_foreign_keys(
    child: DataFrame, parents: Sequence[tuple[DataFrame, Sequence[str]]]
) -> Split:
    """Rows whose keys all exist, and the others with the first key that does not.

    Parents hold each key once. The rejects are one pass over the child, whatever
    the number of keys.
    """
    accepted, judged, failures = child, child, {}
    for number, (parent, keys) in enumerate(parents):
        known, flag = parent.select(*keys), f"_parent{number}"
        accepted = accepted.join(known, list(keys), "left_semi")
        judged = judged.join(known.withColumn(flag, F.lit(True)), list(keys), "left")
        failures[no_parent(keys)] = F.col(flag).isNull()
    _, rejected = split_rows(judged, failures)
    return accepted.select(*child.columns), rejected.select(*child.columns, REASON)


def delete_cascade(
    tables: Mapping[str, DataFrame], parent: str, keys: DataFrame
) -> tuple[Mapping[str, DataFrame], DataFrame]:
    """Delete the parent rows with the given keys and all that hangs on them.

    Returns the tables with new versions of those touched, and the keys refused
    because a child that restricts deletion still refers to them. A table is asked for
    when its result or one that depends on it is, so that stored ones load only then.
    """
    spec = TABLES[parent]
    doomed = keys.select(*spec.primary_key)
    refused = doomed.limit(0).withColumn(REASON, F.lit(""))
    for child, key in children_of(parent):
        if key.on_delete == "restrict":
            held = tables[child.name].select(*key.columns)
            blocked = doomed.join(held, list(key.columns), "left_semi")
            refused = refused.unionByName(
                blocked.withColumn(REASON, F.lit(f"referred to by {child.name}"))
            )
            doomed = doomed.join(held, list(key.columns), "left_anti")
    result = {name: partial(tables.__getitem__, name) for name in tables}
    _delete(result, parent, lambda: doomed)
    return LazyFrames(result), refused.distinct()


def _delete(tables: dict[str, Callable[[], DataFrame]], name: str, doomed: Callable[[], DataFrame]) -> None:
    for child, key in children_of(name):
        if key.on_delete == "restrict":
            continue  # no row left that refers to a doomed key
        if children_of(child.name):
            lost = partial(_hanging, tables[child.name], key.columns, doomed, child.primary_key)
            _delete(tables, child.name, cache(lost))
        else:
            tables[child.name] = cache(partial(_without, tables[child.name], key.columns, doomed))
    tables[name] = cache(partial(_without, tables[name], TABLES[name].primary_key, doomed))


def _hanging(
    table: Callable[[], DataFrame], keys: Sequence[str], doomed: Callable[[], DataFrame], own: Sequence[str]
) -> DataFrame:
    return table().join(doomed(), list(keys), "left_semi").select(*own)


def _without(table: Callable[[], DataFrame], keys: Sequence[str], doomed: Callable[[], DataFrame]) -> DataFrame:
    rows = table()
    return rows.join(doomed(), list(keys), "left_anti").select(*rows.columns)


def update_key_cascade(
    tables: Mapping[str, DataFrame], parent: str, old_new: DataFrame
) -> tuple[Mapping[str, DataFrame], DataFrame]:
    """Rename keys of a one-column primary key, in the parent and every child.

    ``old_new`` has the columns ``old`` and ``new``; equal rows count once. Returns
    the tables with new versions of those touched, and the renames refused: a new
    key that is null, too long, taken in the parent, or asked for more than once
    (the smallest old key gets it), and all but the smallest new key of an old one. A
    child is asked for when its result is.
    """
    spec = TABLES[parent]
    (key,) = spec.primary_key
    table = tables[parent]
    present = old_new.join(table.select(F.col(key).alias("old")), "old", "left_semi")
    taken = table.select(F.col(key).alias("new"), F.lit(True).alias("_taken"))
    failures = {
        **null_failures(["new"]),
        **(length_failures(["new"]) if key in spec.text_columns else {}),
        "key already exists": F.col("_taken") & (F.col("old") != F.col("new")),
    }
    free, refused = split_rows(present.join(taken, "new", "left"), failures)
    wanted, again = check_primary_key(free.select("old", "new").distinct(), ["old"], ["new"])
    granted, late = check_primary_key(wanted, ["new"], ["old"])
    refused = refused.select("old", "new", REASON).unionByName(again).unionByName(late)
    columns = {parent: key, **{child.name: foreign.columns[0] for child, foreign in children_of(parent)}}

    def version(name: str) -> DataFrame:
        return _rename(tables[name], columns[name], granted) if name in columns else tables[name]

    return LazyFrames({name: partial(version, name) for name in tables}), refused


def _rename(df: DataFrame, column: str, granted: DataFrame) -> DataFrame:
    renamed = df.join(granted, F.col(column) == F.col("old"), "left")
    values = {column: F.coalesce("new", column)}
    return renamed.select(*(values.get(c, F.col(c)).alias(c) for c in df.columns))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
