"""Cleaning operators: each takes a DataFrame and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def project_rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns under their new names."""
    return df.select(*(F.col(old).alias(new) for old, new in mapping.items()))


def append_columns(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Add computed columns to each row."""
    return df.withColumns(dict(columns))


def with_constant(df: DataFrame, name: str, value) -> DataFrame:
    return df.withColumn(name, F.lit(value))


def drop_nulls(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a null or NaN in any of the columns (all by default)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in line order; ``order`` must be total within a key.

    Both plans cut every map task's output to one row per key before the shuffle,
    so a key holding most of the rows costs one row per task: a hash aggregate
    where order and payload fit its fixed-width buffers, else ranking to 1.
    When the keys are the whole row there is nothing to choose between.
    """
    if set(keys) == set(df.columns):
        return df.select(*keys).distinct()
    payload = [name for name in df.columns if name not in keys and name not in order]
    line = _line_number(df, order)
    if line is not None and all(_fixed_width(df.schema[name].dataType) for name in payload):
        firsts = [F.min_by(name, line).alias(name) for name in payload]
        lines = [F.min(name).alias(name) for name in order]
        return df.groupBy(*keys).agg(*firsts, *lines).select(*df.columns)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_line", rank).filter("_line = 1").drop("_line")


def _fixed_width(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.DateType, T.BooleanType, T.TimestampType))


def _line_number(df: DataFrame, order: Sequence[str]) -> Column | None:
    """The one exact-number order column with nulls first, or None."""
    if len(order) != 1:
        return None
    kind = df.schema[order[0]].dataType
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.col(order[0]).cast("bigint"), F.lit(-(2**63)))
    if isinstance(kind, T.DecimalType) and kind.scale == 0:
        lowest = F.lit(Decimal(1 - 10**kind.precision)).cast(kind)
        return F.coalesce(F.col(order[0]), lowest)
    return None


def keep_range(df: DataFrame, predicate: Column | str) -> DataFrame:
    """Keep rows meeting the condition. Runs after ``keep_first`` by design: a key
    whose first row fails disappears even if a later duplicate would pass."""
    return df.filter(predicate)


def valid_sale_price(
    onsale: DataFrame, product: DataFrame, manufacturer: DataFrame
) -> DataFrame:
    """Drop sale prices above retail or discounted beyond the maker's maximum.

    A price of an unknown product is left in; the foreign key rejects it at load.
    """
    limits = onsale.join(
        product.select("PID", "retail_price", "ManufacturerName"), "PID", "left"
    ).join(manufacturer, "ManufacturerName", "left")
    sale, retail = F.col("SalePrice"), F.col("retail_price")
    discount = F.try_divide(retail - sale, retail)
    too_deep = F.coalesce(discount > F.col("max_discount"), F.lit(False))
    free_item = (retail == 0) & (sale < 0)  # a discount without bound
    invalid = F.coalesce((sale > retail) | too_deep | free_item, F.lit(False))
    return limits.filter(~invalid).select(*onsale.columns)


def coerce_types(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to the schema's columns; what cannot convert becomes null.

    Numbers cast to integers are cut toward zero.
    """
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))
