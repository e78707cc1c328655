"""Raw datasets, stored tables, and the keys and constraints between them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import types as T

# Column that carries the line order of a raw dataset read from files.
ROW_ORDER = ("row_id",)

# Longest text a stored column takes.
TEXT_LIMIT = 50

_TEXT, _KEY, _INT = T.StringType(), T.LongType(), T.IntegerType()
_NUMBER, _DATE = T.DoubleType(), T.DateType()


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


# Dataset, table and column names follow the existing data model.
RAW_SCHEMAS: Mapping[str, T.StructType] = {
    "stores": _struct(
        row_id=_KEY,
        storeid=_KEY,
        phone=_TEXT,
        address=_TEXT,
        name=_TEXT,
        state=_TEXT,
        population=_INT,
        managerfirstname=_TEXT,
        managerlastname=_TEXT,
        manageremail=_TEXT,
    ),
    "products": _struct(
        row_id=_KEY,
        productid=_KEY,
        name=_TEXT,
        retailprice=_NUMBER,
        manufacturer=_TEXT,
        maxdiscount=_NUMBER,
        categoryname=_TEXT,
    ),
    "sales": _struct(row_id=_KEY, storeid=_KEY, productid=_KEY, date=_DATE, quantity=_INT),
    "saleprices": _struct(row_id=_KEY, productid=_KEY, date=_DATE, saleprice=_NUMBER),
    "holidays": _struct(row_id=_KEY, date=_DATE, holidayname=_TEXT),
}


@dataclass(frozen=True)
class ForeignKey:
    """Columns that must exist in ``parent``; names are the same on both sides."""

    columns: tuple[str, ...]
    parent: str
    on_delete: str = "cascade"  # or "restrict"


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    primary_key: tuple[str, ...]
    # Columns that cleaning already made unique.
    clean_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    # Constraint name -> SQL condition that every row meets.
    checks: Mapping[str, str] = field(default_factory=dict)
    # Columns the stored files are bucketed and sorted by, for the large tables.
    bucket_by: tuple[str, ...] = ()
    sort_by: tuple[str, ...] = ()
    # Columns by whose hash the stored files of an edited table are dealt to slices.
    slice_by: tuple[str, ...] = ()

    @property
    def columns(self) -> Sequence[str]:
        return self.schema.fieldNames()

    @property
    def text_columns(self) -> Sequence[str]:
        return [f.name for f in self.schema if isinstance(f.dataType, T.StringType)]


_SPECS = [
    TableSpec(
        "City",
        _struct(CityState=_TEXT, CityName=_TEXT, State=_TEXT, population=_INT, city_size=_TEXT),
        primary_key=("CityState",),
        clean_key=("CityName", "State"),
        slice_by=("CityName", "State"),
        checks={"population_nonnegative": "population >= 0"},
    ),
    TableSpec(
        "Store",
        _struct(StoreNumber=_KEY, phone_number=_TEXT, street_address=_TEXT, CityState=_TEXT),
        primary_key=("StoreNumber",),
        clean_key=("StoreNumber",),
        foreign_keys=(ForeignKey(("CityState",), "City"),),
    ),
    TableSpec(
        "Manufacturer",
        _struct(ManufacturerName=_TEXT, max_discount=_NUMBER),
        primary_key=("ManufacturerName",),
        clean_key=("ManufacturerName",),
        checks={"max_discount_range": "max_discount BETWEEN 0.0D AND 0.9D"},
    ),
    TableSpec(
        "Product",
        _struct(PID=_KEY, product_name=_TEXT, retail_price=_NUMBER, ManufacturerName=_TEXT),
        primary_key=("PID",),
        clean_key=("PID",),
        foreign_keys=(ForeignKey(("ManufacturerName",), "Manufacturer"),),
        checks={"retail_price_nonnegative": "retail_price >= 0.0D"},
    ),
    TableSpec(
        "Category",
        _struct(CategoryName=_TEXT),
        primary_key=("CategoryName",),
        clean_key=("CategoryName",),
    ),
    TableSpec(
        "BelongTo",
        _struct(PID=_KEY, CategoryName=_TEXT),
        primary_key=("PID", "CategoryName"),
        clean_key=("PID", "CategoryName"),
        foreign_keys=(
            ForeignKey(("PID",), "Product"),
            ForeignKey(("CategoryName",), "Category"),
        ),
    ),
    TableSpec(
        "Cdate",
        _struct(CalendarDate=_DATE),
        primary_key=("CalendarDate",),
        clean_key=("CalendarDate",),
    ),
    TableSpec(
        "Holiday",
        _struct(CalendarDate=_DATE, HolidayName=_TEXT),
        primary_key=("CalendarDate", "HolidayName"),
        clean_key=("CalendarDate", "HolidayName"),
        slice_by=("CalendarDate", "HolidayName"),
        foreign_keys=(ForeignKey(("CalendarDate",), "Cdate"),),
    ),
    TableSpec(
        "Sold",
        _struct(StoreNumber=_KEY, PID=_KEY, CalendarDate=_DATE, quantity=_INT),
        primary_key=("StoreNumber", "PID", "CalendarDate"),
        clean_key=("StoreNumber", "PID", "CalendarDate"),
        foreign_keys=(
            ForeignKey(("StoreNumber",), "Store"),
            ForeignKey(("PID",), "Product"),
            ForeignKey(("CalendarDate",), "Cdate"),
        ),
        checks={"quantity_nonnegative": "quantity >= 0"},
        bucket_by=("PID", "CalendarDate"),
        sort_by=("CalendarDate",),
    ),
    TableSpec(
        "OnSale",
        _struct(PID=_KEY, CalendarDate=_DATE, SalePrice=_NUMBER),
        primary_key=("PID", "CalendarDate"),
        clean_key=("PID", "CalendarDate"),
        foreign_keys=(
            ForeignKey(("PID",), "Product"),
            ForeignKey(("CalendarDate",), "Cdate"),
        ),
        bucket_by=("PID", "CalendarDate"),
        sort_by=("CalendarDate",),
    ),
    TableSpec(
        "Manager",
        _struct(Email=_TEXT, manager_name=_TEXT, EmploymentStatus=_INT),
        primary_key=("Email",),
        clean_key=("Email",),
        slice_by=("Email",),
        checks={"employment_status_flag": "EmploymentStatus IN (0, 1)"},
    ),
    TableSpec(
        "AssignedTo",
        _struct(Email=_TEXT, StoreNumber=_KEY),
        primary_key=("Email", "StoreNumber"),
        clean_key=("Email", "StoreNumber"),
        slice_by=("Email", "StoreNumber"),
        foreign_keys=(
            ForeignKey(("Email",), "Manager", on_delete="restrict"),
            ForeignKey(("StoreNumber",), "Store"),
        ),
    ),
]

# Every parent comes before its children, so this is also the load order.
TABLES: Mapping[str, TableSpec] = {spec.name: spec for spec in _SPECS}
LOAD_ORDER: Sequence[str] = tuple(TABLES)


def children_of(parent: str) -> list[tuple[TableSpec, ForeignKey]]:
    """Tables holding a foreign key to ``parent``, with that key."""
    return [
        (spec, key)
        for spec in TABLES.values()
        for key in spec.foreign_keys
        if key.parent == parent
    ]


def load_levels() -> list[list[str]]:
    """Tables grouped so that each group needs only the ones before it."""
    depth: dict[str, int] = {}
    for name, spec in TABLES.items():
        depth[name] = 1 + max((depth[key.parent] for key in spec.foreign_keys), default=-1)
    return [
        [name for name in TABLES if depth[name] == level]
        for level in range(max(depth.values()) + 1)
    ]
