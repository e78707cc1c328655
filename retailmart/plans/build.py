"""The twelve cleaned tables, each built from one raw dataset."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import city_state, full_name, population_band, repair_discount
from ..lazy import LazyFrames
from ..operators.cleaning import (
    append_columns,
    drop_nulls,
    keep_first,
    keep_range,
    project_rename,
    valid_sale_price,
    with_constant,
)
from ..schema import ROW_ORDER, TABLES


def _with_order(mapping: Mapping[str, str], order: Sequence[str]) -> dict[str, str]:
    """Column mapping that also carries the line-order columns."""
    return {**mapping, **{name: name for name in order if name not in mapping}}


def _first_lines(
    df: DataFrame,
    mapping: Mapping[str, str],
    keys: Sequence[str],
    order: Sequence[str],
    required: Sequence[str] | None = None,
) -> DataFrame:
    """Rename, drop incomplete rows, keep the first line of each key."""
    picked = project_rename(df, _with_order(mapping, order))
    complete = drop_nulls(picked, required or list(mapping.values()))
    lines = [mapping.get(name, name) for name in order]
    return keep_first(complete, keys, lines).select(*mapping.values())


def _distinct(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    picked = drop_nulls(project_rename(df, mapping))
    return keep_first(picked, picked.columns, ())


def build_city(stores: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    city = _first_lines(
        stores,
        {"name": "CityName", "state": "State", "population": "population"},
        keys=("CityName", "State"),
        order=order,
    )
    city = append_columns(
        city,
        {
            "CityState": city_state(F.col("CityName"), F.col("State")),
            "city_size": population_band(F.col("population")),
        },
    )
    return keep_range(city, "population > 0").select(*TABLES["City"].columns)


def build_store(stores: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    located = append_columns(stores, {"CityState": city_state(F.col("name"), F.col("state"))})
    return _first_lines(
        located,
        {
            "storeid": "StoreNumber",
            "phone": "phone_number",
            "address": "street_address",
            "CityState": "CityState",
        },
        keys=("StoreNumber",),
        order=order,
    )


def build_manufacturer(products: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    maker = _first_lines(
        products,
        {"manufacturer": "ManufacturerName", "maxdiscount": "max_discount"},
        keys=("ManufacturerName",),
        order=order,
        required=("ManufacturerName",),
    )
    return append_columns(maker, {"max_discount": repair_discount(F.col("max_discount"))})


def build_product(products: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    product = _first_lines(
        products,
        {
            "productid": "PID",
            "name": "product_name",
            "retailprice": "retail_price",
            "manufacturer": "ManufacturerName",
        },
        keys=("PID",),
        order=order,
    )
    return keep_range(product, "retail_price >= 0")


def build_category(products: DataFrame) -> DataFrame:
    return _distinct(products, {"categoryname": "CategoryName"})


def build_belongto(products: DataFrame) -> DataFrame:
    return _distinct(products, {"productid": "PID", "categoryname": "CategoryName"})


def build_cdate(sales: DataFrame) -> DataFrame:
    """Every date in the raw sales, also of sales that cleaning drops."""
    return _distinct(sales, {"date": "CalendarDate"})


def build_holiday(holidays: DataFrame) -> DataFrame:
    return _distinct(holidays, {"date": "CalendarDate", "holidayname": "HolidayName"})


def build_sold(sales: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    sold = _first_lines(
        sales,
        {
            "storeid": "StoreNumber",
            "productid": "PID",
            "date": "CalendarDate",
            "quantity": "quantity",
        },
        keys=("StoreNumber", "PID", "CalendarDate"),
        order=order,
    )
    return keep_range(sold, "quantity > 0")


def build_onsale(
    saleprices: DataFrame,
    product: DataFrame,
    manufacturer: DataFrame,
    order: Sequence[str] = ROW_ORDER,
) -> DataFrame:
    onsale = _first_lines(
        saleprices,
        {"productid": "PID", "date": "CalendarDate", "saleprice": "SalePrice"},
        keys=("PID", "CalendarDate"),
        order=order,
    )
    return valid_sale_price(onsale, product, manufacturer)


def build_manager(stores: DataFrame, order: Sequence[str] = ROW_ORDER) -> DataFrame:
    named = append_columns(
        stores,
        {"manager_name": full_name(F.col("managerfirstname"), F.col("managerlastname"))},
    )
    manager = _first_lines(
        named,
        {"manageremail": "Email", "manager_name": "manager_name"},
        keys=("Email",),
        order=order,
    )
    return with_constant(manager, "EmploymentStatus", 1)


def build_assignedto(stores: DataFrame) -> DataFrame:
    return _distinct(stores, {"manageremail": "Email", "storeid": "StoreNumber"})


# The raw dataset that each table is built from.
DATASETS: Mapping[str, str] = {
    **dict.fromkeys(("City", "Store", "Manager", "AssignedTo"), "stores"),
    **dict.fromkeys(("Manufacturer", "Product", "Category", "BelongTo"), "products"),
    **dict.fromkeys(("Cdate", "Sold"), "sales"),
    "Holiday": "holidays",
    "OnSale": "saleprices",
}


def prepare_tables(
    raw: Mapping[str, DataFrame],
    order: Mapping[str, Sequence[str]] | None = None,
    prices: Mapping[str, DataFrame] | None = None,
) -> Mapping[str, DataFrame]:
    """All cleaned tables, in load order.

    ``order`` names the line-order columns of a raw dataset where they are not
    ``row_id``. ``prices`` holds the Product and Manufacturer that sale prices are
    checked against, by default the cleaned ones. Nothing runs until a table is used.
    """

    def lines(dataset: str) -> tuple[str, ...]:
        return tuple((order or {}).get(dataset, ROW_ORDER))

    def onsale() -> DataFrame:
        known = tables if prices is None else prices
        return build_onsale(
            raw["saleprices"], known["Product"], known["Manufacturer"], lines("saleprices")
        )

    tables = LazyFrames(
        {
            "City": lambda: build_city(raw["stores"], lines("stores")),
            "Store": lambda: build_store(raw["stores"], lines("stores")),
            "Manufacturer": lambda: build_manufacturer(raw["products"], lines("products")),
            "Product": lambda: build_product(raw["products"], lines("products")),
            "Category": lambda: build_category(raw["products"]),
            "BelongTo": lambda: build_belongto(raw["products"]),
            "Cdate": lambda: build_cdate(raw["sales"]),
            "Holiday": lambda: build_holiday(raw["holidays"]),
            "Sold": lambda: build_sold(raw["sales"], lines("sales")),
            "OnSale": onsale,
            "Manager": lambda: build_manager(raw["stores"], lines("stores")),
            "AssignedTo": lambda: build_assignedto(raw["stores"]),
        }
    )
    return tables
