"""Stored tables: definitions, writes and reads through the session catalog.

A version of a table is one folder, written by one job that deals every judged row to
``verdict=accepted`` or ``verdict=rejected``. The catalog's table reads the accepted part; the
rejected rows, as text, are read from beside it. Folders are numbered, so that a later
application finds the newest finished one by the location alone. Nothing is locked: one
application at a time writes to a location.

Tables that are edited row by row are dealt to slices by a hash of their key, each a folder
``slice=n`` below the verdict, so that an edit overwrites the slices of its keys alone. The
catalog's table reads all of them as one folder.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import TABLES, TableSpec

# Table property of a table that was written in full.
LOADED = "retailmart.loaded"

REASON, REJECTED, VERDICT, SLICE = "reason", "rejected", "verdict", "slice"
_ACCEPTED_PART, _REJECTED_PART = f"{VERDICT}=accepted", f"{VERDICT}=rejected"
_VERSION = re.compile(r"(\d{6,})_(\d+)_[0-9a-f]{32}$")  # number, buckets or slices, and what makes it unique


def _columns(spec: TableSpec, nullable: bool) -> str:
    end = "" if nullable else " NOT NULL"
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}{end}" for f in spec.schema)


def _buckets(spec: TableSpec, buckets: int) -> str:
    if not spec.bucket_by:
        return ""
    sort = f" SORTED BY ({', '.join(spec.sort_by)})" if spec.sort_by else ""
    return f" CLUSTERED BY ({', '.join(spec.bucket_by)}){sort} INTO {buckets} BUCKETS"


def table_ddl(spec: TableSpec, table: str, location: str, buckets: int) -> str:
    ddl = f"CREATE TABLE IF NOT EXISTS {table} ({_columns(spec, nullable=False)}) USING parquet"
    nested = " OPTIONS ('recursiveFileLookup' = 'true')" if spec.slice_by else ""
    return f"{ddl}{nested}{_buckets(spec, buckets)} LOCATION '{location}'"


def _staging_ddl(spec: TableSpec, table: str, folder: str, buckets: int) -> str:
    columns = f"{_columns(spec, nullable=True)}, {REASON} string, {REJECTED} string, {VERDICT} string"
    parts = VERDICT
    if spec.slice_by:
        columns, parts = f"{columns}, {SLICE} int", f"{VERDICT}, {SLICE}"
    ddl = f"CREATE TABLE {table} ({columns}) USING parquet PARTITIONED BY ({parts})"
    return f"{ddl}{_buckets(spec, buckets)} LOCATION '{folder}'"


def _children(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reaches; none if it is not there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def newest_version(spark: SparkSession, location: str, name: str) -> str | None:
    """The folder of the last version of a table that was finished."""
    found = [m for m in map(_VERSION.match, _children(spark, f"{location}/{name}")) if m]
    for match in sorted(found, key=lambda m: (int(m[1]), m[0]), reverse=True):
        folder = f"{location}/{name}/{match[0]}"
        if is_finished(spark, folder):
            return folder
    return None


def is_finished(spark: SparkSession, folder: str) -> bool:
    """Whether a job wrote the folder to its end."""
    return "_SUCCESS" in _children(spark, folder)


def stored_state(spark: SparkSession, database: str, names: Sequence[str]) -> str:
    """A name for what the tables hold now: it changes with every new version and every append."""
    said = []
    for name in names:
        folder = _version_of(spark, _qualified(database, name))[0]
        files = len([f for f in _children(spark, f"{folder}/{_ACCEPTED_PART}") if not f.startswith((".", "_"))])
        said.append(f"{folder.rsplit('/', 1)[1]}:{files}")
    return hashlib.sha256("|".join(said).encode()).hexdigest()[:32]


def _next_version(location: str, name: str, last: str | None, buckets: int) -> str:
    number = int(_VERSION.search(last)[1]) + 1 if last else 1
    return f"{location}/{name}/{number:06d}_{buckets}_{uuid.uuid4().hex}"


def create_tables(spark: SparkSession, database: str, location: str, buckets: int, slices: int = 8) -> None:
    """Create the database and the twelve tables where absent.

    A table whose files are at the location already, from an earlier application, is
    registered as its newest version was left, with the buckets it was written in.

    Sold and OnSale share buckets of (PID, CalendarDate), so pricing sales needs
    no shuffle at query time. The key spreads a hot product over its days and a
    hot day over its products, and one key holds at most one sale per store.
    Buckets are sorted by date, so a date range skips row groups.
    """
    # a catalog may delete a database's folder with it, so the tables lie elsewhere
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}` LOCATION '{location}/_database'")
    for name, spec in TABLES.items():
        table = _qualified(database, name)
        if spark.catalog.tableExists(table):
            continue
        found = newest_version(spark, location, name)
        folder = found or _next_version(location, name, None, slices if spec.slice_by else buckets)
        written = int(_VERSION.search(folder)[2])
        spark.sql(table_ddl(spec, table, f"{folder}/{_ACCEPTED_PART}", written))
        if found:
            _mark_loaded(spark, table)


def _qualified(database: str, name: str) -> str:
    return f"`{database}`.`{name}`"


def _mark_loaded(spark: SparkSession, table: str) -> None:
    spark.sql(f"ALTER TABLE {table} SET TBLPROPERTIES ('{LOADED}' = 'true')")


def _version_of(spark: SparkSession, table: str) -> tuple[str, int]:
    """(folder, buckets or slices) of the version a table reads."""
    shown = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").filter("col_name = 'Location'")
    folder = shown.first()["data_type"].rsplit("/", 1)[0]
    return folder, int(_VERSION.search(folder)[2])


def read_table(spark: SparkSession, database: str, name: str) -> DataFrame:
    return spark.table(_qualified(database, name))


def read_rejects(spark: SparkSession, database: str, name: str) -> DataFrame:
    """The rows that the loads of a table left out: its columns as text, and the reason."""
    stored = _stored_rejects(spark, _version_of(spark, _qualified(database, name))[0])
    columns = TABLES[name].columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    fields = F.from_json(REJECTED, text).alias("row")
    return stored.select(fields, REASON).select(*(F.col(f"row.{c}").alias(c) for c in columns), REASON)


def _stored_rejects(spark: SparkSession, folder: str) -> DataFrame:
    schema = f"{REASON} string, {REJECTED} string"
    if _REJECTED_PART not in _children(spark, folder):
        return empty_rows(spark, schema)
    return spark.read.schema(schema).parquet(f"{folder}/{_REJECTED_PART}")


def empty_rows(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.range(0).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in fields))


def judged_rows(rows: DataFrame, spec: TableSpec, reason: Column | None = None) -> DataFrame:
    """Rows as they are stored: accepted ones in the table's types, others as text with the reason.

    ``reason`` is null for the accepted, and left out where all are.
    """
    why = F.lit(None).cast("string") if reason is None else reason
    text = F.to_json(F.struct(*(F.col(c).cast("string").alias(c) for c in spec.columns)))
    typed = [F.when(why.isNull(), F.col(f.name).try_cast(f.dataType)).alias(f.name) for f in spec.schema]
    return rows.select(*typed, why.alias(REASON), F.when(why.isNotNull(), text).alias(REJECTED))


def write_table(spark: SparkSession, database: str, name: str, rows: DataFrame) -> None:
    """Fill a created table, replacing what it holds; safe to repeat after a failure."""
    write_judged(spark, database, name, judged_rows(rows, TABLES[name]))


def write_judged(
    spark: SparkSession, database: str, name: str, judged: DataFrame, append: bool = False
) -> tuple[int, int]:
    """Store accepted and rejected rows of ``judged_rows`` by one job; returns how many of each.

    The counts are made on the way, and may be too high where a lost executor's work was
    done again.
    """
    table = _qualified(database, name)
    folder, buckets = _version_of(spark, table)
    counts = _insert(spark, database, name, judged, folder, buckets, append)
    _mark_loaded(spark, table)
    spark.catalog.refreshTable(table)
    return counts


def is_loaded(spark: SparkSession, database: str, name: str) -> bool:
    """Whether the table was ever written in full; one that holds no row may be loaded too."""
    shown = spark.sql(f"SHOW TBLPROPERTIES {_qualified(database, name)}")
    return not shown.filter(F.col("key") == LOADED).isEmpty()


def _insert(
    spark: SparkSession, database: str, name: str, judged: DataFrame, folder: str, buckets: int, append: bool
) -> tuple[int, int]:
    """One job; accepted rows go to one writer, so one file, per bucket, rejected ones anywhere."""
    spec, rejected = TABLES[name], F.col(REASON).isNotNull()
    rows = judged.withColumn(VERDICT, F.when(rejected, "rejected").otherwise("accepted"))
    if spec.bucket_by:
        bucket = F.pmod(F.hash(*spec.bucket_by), F.lit(buckets))  # as Spark deals rows to buckets
        anywhere = F.pmod(F.hash(REJECTED), F.lit(buckets))
        rows = rows.repartitionById(buckets, F.when(rejected, anywhere).otherwise(bucket))
    if spec.slice_by:
        anywhere = F.pmod(F.hash(REJECTED), F.lit(buckets))
        rows = rows.withColumn(SLICE, F.when(rejected, anywhere).otherwise(_slice(spec, buckets)))
        rows = rows.repartitionById(buckets, SLICE)
    # after the exchange: adaptive execution takes out what is before one that no row passes
    seen = Observation()
    rows = rows.observe(seen, F.count_if(~rejected).alias("accepted"), F.count_if(rejected).alias("rejected"))
    staging = _qualified(database, f"{name}_{uuid.uuid4().hex}")
    spark.sql(_staging_ddl(spec, staging, folder, buckets))
    try:
        rows.write.insertInto(staging, overwrite=not append)
    finally:
        spark.sql(f"DROP TABLE {staging}")  # external, so the files stay
    counts = seen.get
    return counts["accepted"], counts["rejected"]


def _slice(spec: TableSpec, slices: int) -> Column:
    """The slice of a row's key, read in the types it is stored in."""
    typed = (F.col(c).try_cast(spec.schema[c].dataType) for c in spec.slice_by)
    return F.pmod(F.hash(*typed), F.lit(slices))


def touched_slices(spark: SparkSession, database: str, name: str, keys: DataFrame) -> list[int]:
    """The slices that hold the keys, or would; at most as many as the table has."""
    slices = _version_of(spark, _qualified(database, name))[1]
    found = keys.select(_slice(TABLES[name], slices).alias(SLICE)).distinct()
    return sorted(row[SLICE] for row in found.collect())


def read_slices(spark: SparkSession, database: str, name: str, numbers: Sequence[int]) -> DataFrame:
    """The rows of some slices of a table; no other file is listed or read."""
    accepted = f"{_version_of(spark, _qualified(database, name))[0]}/{_ACCEPTED_PART}"
    schema, present = TABLES[name].schema, set(_children(spark, accepted))
    found = [f"{accepted}/{SLICE}={n}" for n in numbers if f"{SLICE}={n}" in present]
    return spark.read.schema(schema).parquet(*found) if found else empty_rows(spark, schema)


def overwrite_slices(
    spark: SparkSession, database: str, name: str, rows: DataFrame, numbers: Sequence[int]
) -> None:
    """Put ``rows``, which may read the slices of these numbers, in their place; others stay.

    Tasks write beside the table, and lost ones are run again; only when all are through does
    the driver swap the finished slices in. If the driver itself is lost during the swap, a
    slice can be missing: ``replace_table`` is the way that never touches what is stored.
    """
    table, spec = _qualified(database, name), TABLES[name]
    folder, slices = _version_of(spark, table)
    accepted, seen = f"{folder}/{_ACCEPTED_PART}", Observation()
    dealt = rows.select(*spec.columns, _slice(spec, slices).alias(SLICE)).filter(F.col(SLICE).isin(*numbers))
    dealt = dealt.repartitionById(slices, SLICE).observe(seen, F.collect_set(SLICE).alias("filled"))
    swap = dealt.write.partitionBy(SLICE).mode("overwrite").option("partitionOverwriteMode", "dynamic")
    swap.parquet(accepted)
    for number in sorted(set(numbers) - set(seen.get["filled"])):  # no row is left there
        empty_rows(spark, spec.schema).write.mode("overwrite").parquet(f"{accepted}/{SLICE}={number}")
    spark.catalog.refreshTable(table)


def replace_table(
    spark: SparkSession, database: str, location: str, name: str, rows: DataFrame
) -> None:
    """Store a new version of a table in a fresh folder and point the table at it.

    ``rows`` may read the current version, which stays in its folder. The rows that its loads
    left out are kept along.
    """
    table, spec = _qualified(database, name), TABLES[name]
    last, buckets = _version_of(spark, table)
    folder = _next_version(location, name, last, buckets)
    left_out = _stored_rejects(spark, last)
    nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in spec.schema]
    judged = judged_rows(rows, spec).union(left_out.select(*nothing, REASON, REJECTED))
    _insert(spark, database, name, judged, folder, buckets, append=False)
    spark.sql(f"ALTER TABLE {table} SET LOCATION '{folder}/{_ACCEPTED_PART}'")
    _mark_loaded(spark, table)
    spark.catalog.refreshTable(table)
