"""Registered queries: every one reads the test tables, or tables Spark loads from them.

``clean_*``, ``load_*`` and ``reject_*`` run the cleaning and constraint plans on
the raw datasets. Reports and edits read the stored tables, which a session loads
once per test folder (retailmart.plans.warehouse).
"""

from __future__ import annotations

import importlib
import importlib.util
import os
import sys
import uuid
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import duckdb_oracle
from retailmart import functions as fn
from retailmart.operators import changes as edit
from retailmart.operators import cleaning
from retailmart.operators.constraints import (
    check_domain,
    check_foreign_key,
    check_max_length,
    check_not_null,
    check_predicate,
    check_primary_key,
    delete_cascade,
    union_all,
    update_key_cascade,
)
from retailmart.operators.revenue import priced_sales
from retailmart.plans import reports
from retailmart.plans.build import prepare_tables
from retailmart.plans.load import check_table, judge_table
from retailmart.plans.warehouse import Warehouse, shared_folder
from retailmart.schema import LOAD_ORDER, RAW_SCHEMAS, TABLES
from retailmart.sources.files import read_clean, read_raw, read_raw_rejects, write_clean
from retailmart.sources.testdata import LINE_ORDER, raw_from_testdata

Query = Callable[[SparkSession, str], DataFrame]

CATEGORY, STATE, YEAR, MONTH = "ECONOMY", "ASIA", 1998, 8

_WAREHOUSES: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The stored tables of one test folder, loaded once per Spark application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _WAREHOUSES:
        _WAREHOUSES[key] = Warehouse(spark, raw_from_testdata(spark, sf_dir), LINE_ORDER)
    return _WAREHOUSES[key]


def _clean(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return prepare_tables(raw_from_testdata(spark, sf_dir), LINE_ORDER)


def _common_types(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint, as in the SQL."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.IntegralType):
            column = column.cast("bigint")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def _clean_table(name: str) -> Query:
    return lambda spark, sf_dir: _common_types(_clean(spark, sf_dir)[name])


def _checked(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """One cleaned table checked against its stored parents: (accepted, rejected)."""
    return check_table(TABLES[name], _clean(spark, sf_dir)[name], warehouse(spark, sf_dir))


def _load_table(name: str) -> Query:
    return lambda spark, sf_dir: _common_types(_checked(spark, sf_dir, name)[0])


def _rejected(child: str, parent: str, key: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        parents = warehouse(spark, sf_dir)[parent]
        _, rejects = check_foreign_key(_clean(spark, sf_dir)[child], parents, [key])
        return _common_types(rejects)

    return query


def _report(
    function: Callable[..., DataFrame],
    *tables: str,
    **parameters,
) -> Query:
    """A report over stored tables, given by name in the order of its arguments."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = warehouse(spark, sf_dir)
        frame = function(*(stored[name] for name in tables), **parameters)
        return _common_types(frame)

    return query


def _row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.row_counts(warehouse(spark, sf_dir))


def _pivot(*tables: DataFrame) -> DataFrame:
    return reports.revenue_by_population_pivot(reports.revenue_by_population(*tables))


def _view(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = warehouse(spark, sf_dir)
        stored.create_views(CATEGORY)
        return _common_types(stored.view(name))

    return query


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}_{uuid.uuid4().hex}"


def _write_clean(name: str) -> Query:
    """A cleaned table through CSV files in the shared folder."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = _new_folder(spark, "clean")
        write_clean({name: _clean(spark, sf_dir)[name]}, folder, "csv")
        return _common_types(read_clean(spark, folder, "csv", [name])[name])

    return query


def _numbered_raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A raw dataset with the columns of its schema, the line order as one number."""
    line = {
        "stores": F.col("storeid"),
        "products": F.col("productid"),
        "sales": F.floor(F.col("row_id") / 10**10),
        "saleprices": F.floor(F.col("row_id") / 10**10),
        "holidays": F.unix_date("date"),
    }
    numbered = raw_from_testdata(spark, sf_dir)[name].withColumn("row_id", line[name].cast("bigint"))
    return numbered.select(*RAW_SCHEMAS[name].fieldNames())


def _read_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sold cleaned from raw files: the five datasets stored first, then read back."""
    folder = _new_folder(spark, "raw")
    for name in RAW_SCHEMAS:
        _numbered_raw(spark, sf_dir, name).write.parquet(f"{folder}/{name}")
    return _common_types(prepare_tables(read_raw(spark, folder))["Sold"])


def _read_raw_dataset(name: str) -> Query:
    """A raw dataset as it is read from CSV and from Parquet."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = []
        for fmt in ("csv", "parquet"):
            folder = _new_folder(spark, "raw")
            for other, schema in RAW_SCHEMAS.items():
                rows = _numbered_raw(spark, sf_dir, other) if other == name else spark.createDataFrame([], schema)
                rows.write.format(fmt).option("header", True).save(f"{folder}/{other}")
            found.append(read_raw(spark, folder, fmt)[name].withColumn("format", F.lit(fmt)))
        return _common_types(union_all(found))

    return query


def _read_raw_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of JSON lines: sales with numbers and dates that are none, and lines cut short."""
    folder, key = _new_folder(spark, "raw"), F.col("l_orderkey")
    for name in RAW_SCHEMAS:
        if name != "sales":
            _numbered_raw(spark, sf_dir, name).write.json(f"{folder}/{name}")
    row_id, day = key * 10 + F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    store, quantity = F.col("l_suppkey").cast("string"), F.col("l_quantity").cast("int").cast("string")
    fields = F.struct(
        row_id.alias("row_id"),
        F.when(key % 30 == 2, F.concat(F.lit("S"), store)).otherwise(store).alias("storeid"),
        F.col("l_partkey").alias("productid"),
        F.when(key % 35 == 3, F.date_format(day, "dd.MM.yyyy")).otherwise(day.cast("string")).alias("date"),
        F.when(key % 45 == 4, F.lit("many")).otherwise(quantity).alias("quantity"),
    )
    cut = F.format_string('{"row_id":%d,"storeid"', row_id)
    lines = F.when(key % 40 == 1, cut).otherwise(F.to_json(fields))
    _table(spark, sf_dir, "lineitem").select(lines).write.text(f"{folder}/sales")
    return _common_types(read_raw_rejects(spark, folder, "json"))


def _stored_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the loads of all tables rejected and stored, by table and reason."""
    stored = warehouse(spark, sf_dir)
    stored.load_all()
    return union_all(
        [
            stored.rejects(name).groupBy(F.lit(name).alias("name"), "reason").agg(F.count("*").alias("count"))
            for name in LOAD_ORDER
        ]
    )


def _two_batches(spark: SparkSession, sf_dir: str, daily: bool = False) -> Warehouse:
    """A warehouse of its own whose sales came as two batches with keys in common."""
    raw, order = raw_from_testdata(spark, sf_dir), F.floor(F.col("row_id") / 10**11).cast("bigint")
    of_both = [k for k in range(-14, 15) if k % 3 == 0 or k % 5 == 0]  # the order is worked out once a row
    stored = Warehouse(spark, {**raw, "sales": raw["sales"].filter(order % 3 != 0)}, LINE_ORDER)
    stored.load_all()
    if daily:
        stored.daily_revenue()
    stored.append({"sales": raw["sales"].filter((order % 15).isin(of_both))}, LINE_ORDER)
    return stored


def _append_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _common_types(_two_batches(spark, sf_dir)["Sold"])


def _from_daily(function: Callable[..., DataFrame], **parameters) -> Query:
    """A report of revenue from the stored revenue by store and day."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = warehouse(spark, sf_dir)
        frame = function(*(stored[name] for name in _LOCATED), daily=stored.daily_revenue(), **parameters)
        return _common_types(frame)

    return query


def _append_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store revenue from the stored summary after an append moved it."""
    stored = _two_batches(spark, sf_dir, daily=True)
    frame = reports.store_revenue_by_year(*(stored[name] for name in _LOCATED), daily=stored.daily_revenue())
    return _common_types(frame)


def _append_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rejects = _two_batches(spark, sf_dir).rejects("Sold")
    return rejects.groupBy("StoreNumber", "reason").agg(F.count("*").alias("count"))


def _dirty_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores as text, one per customer, that break each constraint now and then."""
    key, text = F.col("c_custkey"), F.col("c_custkey").cast("string")
    number = F.when(key % 17 == 3, F.concat(F.lit("S"), text)).when(key % 17 != 4, (key - key % 2).cast("string"))
    place = F.when(key % 29 == 7, "Nowhere, X").otherwise(F.concat("n_name", F.lit(", "), "r_name"))
    return (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            number.alias("StoreNumber"),
            F.when(key % 19 != 5, F.lpad(text, 12, "0")).alias("phone_number"),
            F.when(key % 23 == 6, F.repeat(F.lit("x"), 51)).otherwise(F.col("c_name")).alias("street_address"),
            place.alias("CityState"),
        )
    )


def _dirty_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products with prices below zero, infinite and none, and makers nobody knows."""
    key = F.col("p_partkey")
    price = F.when(key % 13 == 1, -F.col("p_retailprice")).when(key % 13 == 2, float("inf")).when(key % 13 == 3, float("nan"))
    maker = F.when(key % 11 == 4, "Nobody").when(key % 11 != 5, F.col("p_brand"))
    return _table(spark, sf_dir, "part").select(
        (key - key % 3).alias("PID"), F.lpad(key.cast("string"), 12, "0").alias("product_name"),
        F.when(key % 13 < 1, F.lit(None)).when(key % 13 > 3, F.col("p_retailprice")).otherwise(price).alias("retail_price"),
        maker.alias("ManufacturerName"),
    )


def _load_dirty(name: str, source: Callable[[SparkSession, str], DataFrame], accepted: bool) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        judged = judge_table(TABLES[name], source(spark, sf_dir), warehouse(spark, sf_dir))
        if accepted:
            return _common_types(judged.filter("reason IS NULL").select(*TABLES[name].columns))
        return judged.filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("count"))

    return query


def _stored_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of all tables after the deletion of a maker's cascade was stored."""
    stored = Warehouse(spark, raw_from_testdata(spark, sf_dir), LINE_ORDER)
    stored.load_all()
    doomed = stored["Manufacturer"].filter("ManufacturerName LIKE 'Brand#1%'").select("ManufacturerName")
    stored.replace_all(delete_cascade(stored, "Manufacturer", doomed)[0])
    return union_all(
        [reports.simple_count(stored[name]).select(F.lit(name).alias("name"), "count") for name in LOAD_ORDER]
    )


# ----------------------------------------------------- single operators on raw datasets


def _on_raw(dataset: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _common_types(operator(raw_from_testdata(spark, sf_dir)[dataset]))

    return query


def _first_sales(sales: DataFrame) -> DataFrame:
    keys = ["productid", "date"]
    first = cleaning.keep_first(sales, keys, ["row_id"])
    return first.select(*keys, "storeid", "quantity")


def _names(stores: DataFrame) -> DataFrame:
    return cleaning.append_columns(
        stores.select("storeid", "name", "state", "managerfirstname", "managerlastname"),
        {
            "CityState": fn.city_state(F.col("name"), F.col("state")),
            "manager_name": fn.full_name(
                F.col("managerfirstname"), F.col("managerlastname")
            ),
        },
    )


def _bands(stores: DataFrame) -> DataFrame:
    return stores.select(
        "storeid", fn.population_band(F.col("population")).alias("city_size")
    )


def _discounts(products: DataFrame) -> DataFrame:
    return products.select(
        "productid",
        "categoryname",
        fn.repair_discount(F.col("maxdiscount")).alias("max_discount"),
    )


def _active(stores: DataFrame) -> DataFrame:
    renamed = cleaning.project_rename(stores, {"manageremail": "Email", "storeid": "StoreNumber"})
    return cleaning.with_constant(renamed, "EmploymentStatus", 1)


def _valid_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = _clean(spark, sf_dir)
    offered = cleaning.project_rename(
        raw_from_testdata(spark, sf_dir)["saleprices"],
        {"productid": "PID", "date": "CalendarDate", "saleprice": "SalePrice"},
    )
    return _common_types(
        cleaning.valid_sale_price(offered, clean["Product"], clean["Manufacturer"])
    )


def _coerced(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "l_orderkey bigint, l_quantity int, l_shipdate date, l_returnflag int"
    lines = _table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.col("l_quantity") / -3)
    return _common_types(cleaning.coerce_types(lines, T.StructType.fromDDL(schema)))


def _priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order priority codes such as '1' and '1-', which only partly are numbers."""
    key = F.col("o_orderkey")
    code = F.substring(F.col("o_orderpriority"), F.lit(1), (key % 2 + 1).cast("int"))
    return _table(spark, sf_dir, "orders").select(key.alias("id"), code.alias("code"))


def _domain(part: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        schema = T.StructType.fromDDL("id bigint, code int")
        return _common_types(check_domain(_priorities(spark, sf_dir), schema)[part])

    return query


def _later_sales(sales: DataFrame) -> DataFrame:
    keys = ["storeid", "productid", "date"]
    return check_primary_key(sales, keys, ["row_id"])[1].select(*keys, "quantity", "reason")


def _load_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected rows of the load of all tables, by table and reason."""
    return union_all(
        [
            _checked(spark, sf_dir, name)[1]
            .groupBy(F.lit(name).alias("name"), "reason")
            .agg(F.count("*").alias("count"))
            for name in LOAD_ORDER
        ]
    )


# ------------------------------------------------- change batches, one row per source row


def _mail(letter: str, number) -> Column:
    return F.concat(F.lit(letter), number.cast("string"), F.lit("@example.com"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _half(number) -> Column:
    return F.floor(number / 2).cast("bigint")


def holiday_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, day = F.col("o_orderkey"), F.col("o_orderdate")
    text = (
        F.when(key % 7 == 0, F.date_format(day, "'13/45/'yyyy"))
        .when(key % 2 == 0, F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.date_format(day, "M/d/yyyy"))
    )
    name = F.when(F.month(day) == 7, "Independence Day").otherwise(F.col("o_orderpriority"))
    return _table(spark, sf_dir, "orders").select(
        key.alias("change_id"), text.alias("CalendarDate"), name.alias("HolidayName")
    )


def new_manager_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    mail = F.when(key % 10 == 0, _mail("m", key % 60)).otherwise(_mail("c", _half(key)))
    return _table(spark, sf_dir, "customer").select(
        key.alias("change_id"),
        mail.alias("Email"),
        F.col("c_name").alias("manager_name"),
        (key % 3).alias("EmploymentStatus"),
    )


def old_manager_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    third = F.floor(key / 3).cast("bigint")
    mail = F.when(key % 4 == 0, _mail("m", key % 60)).otherwise(_mail("c", third))
    return _table(spark, sf_dir, "customer").select(
        key.alias("change_id"), mail.alias("Email")
    )


def assignment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    mail = _mail("m", key % 50).alias("Email")
    customer = _table(spark, sf_dir, "customer")
    return customer.select(
        key.alias("change_id"), mail, key.alias("StoreNumber")
    ).unionByName(
        customer.select((-1 - key).alias("change_id"), mail, _half(key).alias("StoreNumber"))
    )


def unassignment_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return _table(spark, sf_dir, "supplier").select(
        key.alias("change_id"),
        _mail("m", key % 40).alias("Email"),
        (key + key % 2).alias("StoreNumber"),
    )


def population_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return (
        _table(spark, sf_dir, "customer")
        .join(_table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(_table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("change_id"),
            F.col("n_name").alias("CityName"),
            F.when(key % 5 == 0, "NOWHERE").otherwise(F.col("r_name")).alias("State"),
            (key * 10007 % 12_000_000 - 1_000_000).alias("population"),
        )
    )


def _edit(
    function: Callable[..., edit.Change],
    tables: tuple[str, ...],
    batch: Callable[[SparkSession, str], DataFrame],
    part: int = 0,
) -> Query:
    """An edit of stored tables: the new table (part 0) or the results (part 1)."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = warehouse(spark, sf_dir)
        outcome = function(*(stored[name] for name in tables), batch(spark, sf_dir))
        return _common_types(outcome[part])

    return query


def _grown_managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    manager = warehouse(spark, sf_dir)["Manager"]
    return edit.add_managers(manager, new_manager_changes(spark, sf_dir))[0]


def _managers(spark: SparkSession, sf_dir: str) -> DataFrame:
    assigned = warehouse(spark, sf_dir)["AssignedTo"]
    return _common_types(reports.managers(_grown_managers(spark, sf_dir), assigned))


def _remove_managers(part: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        assigned = warehouse(spark, sf_dir)["AssignedTo"]
        batch = old_manager_changes(spark, sf_dir)
        grown = _grown_managers(spark, sf_dir)
        return _common_types(edit.remove_managers(grown, assigned, batch)[part])

    return query


def _set_status(function: Callable[..., edit.Change], part: int = 0) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        batch = old_manager_changes(spark, sf_dir)
        return _common_types(function(_grown_managers(spark, sf_dir), batch)[part])

    return query


def _without_cities(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    stored = warehouse(spark, sf_dir)
    doomed = stored["City"].filter("CityName LIKE '%3'").select("CityState")
    return delete_cascade(stored, "City", doomed)[0]


def _delete_cascade(name: str) -> Query:
    return lambda spark, sf_dir: _common_types(_without_cities(spark, sf_dir)[name])


def _delete_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = _without_cities(spark, sf_dir)
    return union_all(
        [
            reports.simple_count(left[name]).select(F.lit(name).alias("name"), "count")
            for name in ("City", "Store", "AssignedTo", "Manager")
        ]
    )


def _delete_cascade_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = warehouse(spark, sf_dir)
    return delete_cascade(stored, "Manager", stored["Manager"].select("Email"))[1]


def _renamed_makers(spark: SparkSession, sf_dir: str) -> tuple:
    """Brand#1… becomes Maker#1…; every other maker asks for a name that is taken."""
    stored = warehouse(spark, sf_dir)
    old = F.col("ManufacturerName")
    new = F.when(old.like("Brand#1%"), F.replace(old, F.lit("Brand"), F.lit("Maker")))
    old_new = stored["Manufacturer"].select(
        old.alias("old"), new.otherwise("Brand#99").alias("new")
    )
    return update_key_cascade(stored, "Manufacturer", old_new)


def _renumbered_sold(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = warehouse(spark, sf_dir)
    number = F.col("StoreNumber")
    old_new = stored["Store"].select(number.alias("old"), (number + 1_000_000).alias("new"))
    return _common_types(update_key_cascade(stored, "Store", old_new)[0]["Sold"])


def _replace_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A population edit stored as the new City, in a warehouse of its own."""
    stored = Warehouse(spark, raw_from_testdata(spark, sf_dir), LINE_ORDER)
    edited, _ = edit.update_population(stored["City"], population_changes(spark, sf_dir))
    stored.replace("City", edited)
    return _common_types(stored["City"])


def _stored_edits(table: str, *steps: tuple[Callable[..., edit.Change], Query], results: bool = False) -> Query:
    """A table after edits were stored in a warehouse of its own, or the results of the last."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        stored = Warehouse(spark, raw_from_testdata(spark, sf_dir), LINE_ORDER)
        for operator, batch in steps:
            last = stored.edit(operator, batch(spark, sf_dir))
        return _common_types(last if results else stored[table])

    return query


# ------------------------------------------------------------------------- registry

_PRICED = ("Sold", "OnSale", "Product")
_LOCATED = (*_PRICED, "Store", "City")
_RANKED = ("Sold", "Store", "City", "BelongTo")
_STAFFED = (*_RANKED, "AssignedTo", "Manager")
_MANAGER_STEPS = (
    (edit.add_managers, new_manager_changes),
    (edit.remove_managers, old_manager_changes),
)


def own_queries() -> dict[str, Query]:
    return {
        **{f"clean_{name.lower()}": _clean_table(name) for name in LOAD_ORDER},
        **{f"load_{name.lower()}": _load_table(name) for name in LOAD_ORDER},
        "reject_fk_store": _rejected("Store", "City", "CityState"),
        "reject_fk_sold": _rejected("Sold", "Store", "StoreNumber"),
        "reject_fk_holiday": _rejected("Holiday", "Cdate", "CalendarDate"),
        "load_rejects": _load_rejects,
        "read_raw": _read_raw,
        **{f"read_raw_{name}": _read_raw_dataset(name) for name in RAW_SCHEMAS},
        "read_raw_rejects": _read_raw_rejects,
        "write_clean": _write_clean("Product"),
        **{f"write_clean_{name.lower()}": _write_clean(name) for name in LOAD_ORDER},
        "stored_rejects": _stored_rejects,
        "append_sold": _append_sold,
        "append_rejects": _append_rejects,
        "append_daily_revenue": _append_daily,
        "daily_store_revenue_by_year": _from_daily(reports.store_revenue_by_year),
        "daily_store_revenue_by_year_asia": _from_daily(reports.store_revenue_by_year, state=STATE),
        "daily_revenue_by_population": _from_daily(reports.revenue_by_population),
        "load_dirty_store": _load_dirty("Store", _dirty_stores, accepted=True),
        "load_dirty_store_rejects": _load_dirty("Store", _dirty_stores, accepted=False),
        "load_dirty_product": _load_dirty("Product", _dirty_prices, accepted=True),
        "load_dirty_product_rejects": _load_dirty("Product", _dirty_prices, accepted=False),
        "drop_nulls": _on_raw("products", cleaning.drop_nulls),
        "keep_first": _on_raw("sales", _first_sales),
        "city_state_and_full_name": _on_raw("stores", _names),
        "population_band": _on_raw("stores", _bands),
        "repair_discount": _on_raw("products", _discounts),
        "keep_range": _on_raw(
            "products", lambda products: cleaning.keep_range(products, "retailprice >= 950")
        ),
        "with_constant": _on_raw("stores", _active),
        "valid_sale_price": _valid_prices,
        "coerce_types": _coerced,
        "check_not_null": _on_raw(
            "products", lambda products: check_not_null(products, ["maxdiscount", "categoryname"])[1]
        ),
        "check_primary_key": _on_raw("sales", _later_sales),
        "check_predicate": _on_raw(
            "products",
            lambda products: check_predicate(products, "range", "maxdiscount <= 0.9D")[1],
        ),
        "check_max_length": _on_raw(
            "products", lambda products: check_max_length(products, "name", 10)[1]
        ),
        "check_domain": _domain(0),
        "check_domain_rejects": _domain(1),
        "row_counts": _row_counts,
        "simple_count": _report(reports.simple_count, "Sold"),
        "manufacturer_product": _report(
            reports.manufacturer_product,
            "Manufacturer",
            "Product",
        ),
        "manufacturer_product_top": _report(
            reports.manufacturer_product, "Manufacturer", "Product", limit=10
        ),
        "manufacturer_product_detail": _report(
            reports.manufacturer_product_detail, "Manufacturer", "Product", "BelongTo"
        ),
        "manufacturer_product_detail_named": _report(
            reports.manufacturer_product_detail,
            "Manufacturer",
            "Product",
            "BelongTo",
            name="Brand#11",
        ),
        "category_report": _report(
            reports.category_report,
            "Category",
            "BelongTo",
            "Product",
            "Manufacturer",
        ),
        "priced_sales": _report(priced_sales, *_PRICED),
        "actual_vs_predicted": _report(
            reports.actual_vs_predicted,
            *_PRICED,
            "BelongTo",
            category=CATEGORY,
        ),
        "states": _report(reports.states, "City"),
        "store_revenue_by_year": _report(
            reports.store_revenue_by_year, *_LOCATED
        ),
        "store_revenue_by_year_asia": _report(
            reports.store_revenue_by_year, *_LOCATED, state=STATE
        ),
        "groundhog": _report(reports.groundhog, "Sold", "BelongTo", category=CATEGORY),
        "year_months": _report(reports.year_months, "Cdate"),
        "sale_years": _report(reports.sale_years, "Sold"),
        "sale_months": _report(reports.sale_months, "Sold"),
        "top_state_per_category": _report(
            reports.top_state_per_category, *_RANKED, year=YEAR, month=MONTH
        ),
        "top_state_all_months": _report(reports.top_state_per_category, *_RANKED),
        "top_state_drilldown": _report(
            reports.top_state_drilldown,
            *_STAFFED,
            state=STATE,
            category=CATEGORY,
            year=YEAR,
            month=MONTH,
        ),
        "top_state_bundle": _report(
            reports.top_state_bundle, *_STAFFED, year=YEAR, month=MONTH
        ),
        "revenue_by_population": _report(
            reports.revenue_by_population, *_LOCATED
        ),
        "revenue_by_population_pivot": _report(_pivot, *_LOCATED),
        "holidays": _report(reports.holidays, "Holiday"),
        "managers": _managers,
        "cities": _report(reports.cities, "City"),
        "view_states": _view("States"),
        "view_groundhog": _view("Report5_ACGroundhog"),
        "view_revenue_by_population": _view("Report7_Before_Pivot"),
        "add_holidays": _edit(edit.add_holidays, ("Holiday", "Cdate"), holiday_changes),
        "add_holidays_results": _edit(
            edit.add_holidays, ("Holiday", "Cdate"), holiday_changes, part=1
        ),
        "add_managers": _edit(edit.add_managers, ("Manager",), new_manager_changes),
        "add_managers_results": _edit(
            edit.add_managers, ("Manager",), new_manager_changes, part=1
        ),
        "remove_managers": _remove_managers(0),
        "remove_managers_results": _remove_managers(1),
        "activate_managers": _set_status(edit.activate_managers),
        "activate_managers_results": _set_status(edit.activate_managers, part=1),
        "deactivate_managers": _set_status(edit.deactivate_managers),
        "deactivate_managers_results": _set_status(edit.deactivate_managers, part=1),
        "assign_managers": _edit(
            edit.assign_managers, ("AssignedTo", "Manager", "Store"), assignment_changes
        ),
        "assign_managers_results": _edit(
            edit.assign_managers, ("AssignedTo", "Manager", "Store"), assignment_changes, part=1
        ),
        "unassign_managers": _edit(
            edit.unassign_managers, ("AssignedTo",), unassignment_changes
        ),
        "unassign_managers_results": _edit(
            edit.unassign_managers, ("AssignedTo",), unassignment_changes, part=1
        ),
        "update_population": _edit(edit.update_population, ("City",), population_changes),
        "update_population_results": _edit(
            edit.update_population, ("City",), population_changes, part=1
        ),
        "replace_table": _replace_table,
        "stored_edit_city": _stored_edits("City", (edit.update_population, population_changes)),
        "stored_edit_holiday": _stored_edits("Holiday", (edit.add_holidays, holiday_changes)),
        "stored_edit_holiday_results": _stored_edits("Holiday", (edit.add_holidays, holiday_changes), results=True),
        "stored_edit_manager": _stored_edits("Manager", *_MANAGER_STEPS),
        "stored_edit_manager_results": _stored_edits("Manager", *_MANAGER_STEPS, results=True),
        "stored_edit_assignedto": _stored_edits(
            "AssignedTo",
            (edit.assign_managers, assignment_changes),
            (edit.unassign_managers, unassignment_changes),
        ),
        "delete_cascade": _delete_cascade("Sold"),
        **{f"delete_cascade_{name.lower()}": _delete_cascade(name) for name in ("City", "Store", "AssignedTo")},
        "stored_cascade": _stored_cascade,
        "delete_cascade_counts": _delete_cascade_counts,
        "delete_cascade_refused": _delete_cascade_refused,
        "update_key_cascade": lambda spark, sf_dir: _renamed_makers(spark, sf_dir)[0]["Product"],
        "update_key_cascade_manufacturer": lambda spark, sf_dir: _renamed_makers(spark, sf_dir)[0]["Manufacturer"],
        "update_key_cascade_refused": lambda spark, sf_dir: _renamed_makers(spark, sf_dir)[1],
        "update_key_cascade_sold": _renumbered_sold,
    }


def _llm_modules() -> list:
    """The modules of the llm subpackage that hold queries; none where it is not there."""
    if importlib.util.find_spec("retailmart.llm") is None:
        return []
    return [importlib.import_module("retailmart.llm.queries")] + [
        importlib.import_module(name)
        for name in ("corpus_pipeline",)
        if importlib.util.find_spec(name) is not None
    ]


def queries() -> dict[str, Query]:
    found = own_queries()
    for module in _llm_modules():
        found |= module.queries()
    return found


def oracle_sql() -> dict[str, str]:
    found = duckdb_oracle.oracle_sql()
    for module in _llm_modules():
        found |= module.oracle_sql()
    return found


def entry(spark: SparkSession) -> DataFrame:
    """Store revenue by year in one state."""
    return queries()["store_revenue_by_year_asia"](spark, "/root/testdata/sf0.001")
