"""Raw datasets in, cleaned tables out: any file format Spark reads and writes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import LOAD_ORDER, RAW_SCHEMAS, TABLES

# Read and write options by format; dates are written as 2001-02-03.
DATE_FORMAT = "yyyy-MM-dd"
OPTIONS: Mapping[str, Mapping[str, str]] = {
    "csv": {"header": "true", "dateFormat": DATE_FORMAT},
    "json": {"dateFormat": DATE_FORMAT},
}


# Where Spark puts a record of a text file that does not parse at all.
_RECORD = "_corrupt_record"
_TEXT = T.StringType()


def _read(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    options = dict(OPTIONS.get(fmt, {}))
    if fmt == "csv":
        options["enforceSchema"] = "false"  # header names must match the schema
        options["columnPruning"] = "false"  # whole lines are judged, whatever is asked of them
    return spark.read.schema(schema).format(fmt).options(**options).load(path)


def _read_sheet(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """The fields as they are, and the record where it is malformed.

    A format with types of its own keeps them; in others every field is read as text.
    """
    if fmt not in OPTIONS:
        return spark.read.format(fmt).load(path).withColumn(_RECORD, F.lit(None).cast("string"))
    text = [T.StructField(name, _TEXT) for name in (*schema.fieldNames(), _RECORD)]
    return _read(spark, path, fmt, T.StructType(text))


def _converted(sheet: DataFrame, field: T.StructField) -> Column:
    """A field in the schema's type, null where it does not convert.

    A whole number may come as 5.0, and others are cut toward zero.
    """
    value = F.col(field.name)
    if sheet.schema[field.name].dataType == _TEXT:
        if isinstance(field.dataType, T.IntegralType):
            value = value.try_cast("decimal(38,10)")
        elif isinstance(field.dataType, T.DateType):
            return F.to_date(F.try_to_timestamp(value, F.lit(DATE_FORMAT)))
    return value.try_cast(field.dataType)


def read_raw(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The five raw datasets, each in its own folder; a missing one fails the call.

    ``row_id`` holds the line order. A field that does not parse reads as null, and a malformed
    record is left out; ``read_raw_rejects`` shows both.
    """
    found = {}
    for name, schema in RAW_SCHEMAS.items():
        sheet = _read_sheet(spark, f"{directory}/{name}", fmt, schema)
        if fmt in OPTIONS:  # a query of nothing but the record is not allowed, so the line is asked for too
            sheet = sheet.filter(F.col(_RECORD).isNull() | (F.length(schema.fieldNames()[0]) < 0))
        found[name] = sheet.select(*(_converted(sheet, f).alias(f.name) for f in schema))
    return found


def read_raw_rejects(spark: SparkSession, directory: str, fmt: str = "parquet") -> DataFrame:
    """What ``read_raw`` could not read: (dataset, row_id, field, value, reason).

    One row for each field that is there but does not parse, with its text, and one for each
    malformed record, with the whole record and neither row_id nor field.
    """
    found = []
    for name, schema in RAW_SCHEMAS.items():
        sheet = _read_sheet(spark, f"{directory}/{name}", fmt, schema)
        whole = F.col(_RECORD).isNotNull()
        faults = []
        for field in schema:
            bad = F.col(field.name).isNotNull() & _converted(sheet, field).isNull()
            reason = f"{field.name} is no {field.dataType.simpleString()}"
            value = F.col(field.name).cast("string")
            fault = F.struct(F.lit(field.name).alias("field"), value.alias("value"), F.lit(reason).alias("reason"))
            faults.append(F.when(~whole & bad, fault))
        nothing = F.lit(None).cast("string")
        malformed = F.struct(nothing.alias("field"), F.col(_RECORD).alias("value"), F.lit("malformed record").alias("reason"))
        faults.append(F.when(whole, malformed))
        line = F.when(~whole, _converted(sheet, schema["row_id"])).alias("row_id")
        rows = sheet.select(line, F.explode(F.array_compact(F.array(*faults))).alias("fault"))
        found.append(rows.select(F.lit(name).alias("dataset"), "row_id", "fault.*"))
    return reduce(DataFrame.unionByName, found)


def write_clean(tables: Mapping[str, DataFrame], directory: str, fmt: str = "parquet") -> None:
    """Write each cleaned table to its own folder."""
    for name, table in tables.items():
        options = OPTIONS.get(fmt, {})
        table.write.format(fmt).options(**options).mode("overwrite").save(f"{directory}/{name}")


def read_clean(
    spark: SparkSession,
    directory: str,
    fmt: str = "parquet",
    names: Sequence[str] = LOAD_ORDER,
) -> dict[str, DataFrame]:
    """Cleaned tables as written by ``write_clean``."""
    return {
        name: _read(spark, f"{directory}/{name}", fmt, TABLES[name].schema) for name in names
    }
