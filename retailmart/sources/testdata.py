"""The five raw datasets expressed over the TPC-H-like test tables (FIXTURES.md)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lazy import LazyFrames

# Line-order columns of each dataset; total within every deduplication key.
LINE_ORDER: Mapping[str, Sequence[str]] = {
    "stores": ("storeid",),
    "products": ("productid", "categoryname"),
    "sales": ("row_id",),
    "saleprices": ("row_id",),
    "holidays": ("date", "holidayname"),
}

# The four holidays put into every year.
YEARLY_HOLIDAYS = (
    (1, 1, "New Year"),
    (2, 2, "Groundhog Day"),
    (7, 4, "Independence Day"),
    (12, 25, "Christmas Day"),
)
EXTRA_YEAR = 2030  # a year without sales


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line_id() -> Column:
    """Line order of lineitem as one exact number: order, line number, price in cents.

    38 digits leave room for any order key a table could hold. Order and line alone
    do not identify a line, hence the price.
    """
    line = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("decimal(20,0)")
    cents = F.rint(F.col("l_extendedprice") * 100).cast("bigint")
    return (line * F.lit(Decimal(10**10)) + cents).cast("decimal(38,0)")


def raw_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = (F.col("s_suppkey") % 40).cast("string")
    return (
        _read(spark, sf_dir, "supplier")
        .join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("s_suppkey").alias("storeid"),
            F.concat(F.lit("P-"), F.col("s_suppkey").cast("string")).alias("phone"),
            F.col("s_name").alias("address"),
            F.col("n_name").alias("name"),
            F.col("r_name").alias("state"),
            (F.col("n_nationkey") * 450_000).cast("int").alias("population"),
            F.concat(F.lit("F"), number).alias("managerfirstname"),
            F.concat(F.lit("L"), number).alias("managerlastname"),
            F.concat(F.lit("m"), number, F.lit("@example.com")).alias("manageremail"),
        )
    )


def raw_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.substring("p_brand", 7, 10).cast("int")
    by_type = F.when(F.col("p_size") != 49, F.col("p_type"))
    by_size = F.concat(F.lit("SIZE_"), F.col("p_size").cast("string"))
    categories = F.when(F.col("p_size") % 5 == 0, F.array(by_type, by_size)).otherwise(
        F.array(by_type)
    )
    parts = _read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("productid"),
        F.col("p_name").alias("name"),
        F.col("p_retailprice").alias("retailprice"),
        F.col("p_brand").alias("manufacturer"),
        F.when(brand % 12 != 9, (brand % 12) / F.lit(10.0)).alias("maxdiscount"),
        F.explode(categories).alias("categoryname"),
    )
    idle = spark.range(1).select(
        F.lit(None).cast("bigint").alias("productid"),
        F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("double").alias("retailprice"),
        F.lit("Brand#99").alias("manufacturer"),
        F.lit(0.2).alias("maxdiscount"),
        F.lit("UNUSED").alias("categoryname"),
    )
    return parts.unionByName(idle)


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("storeid"),
        F.col("l_partkey").alias("productid"),
        F.col("l_shipdate").cast("date").alias("date"),
        (F.col("l_quantity").cast("int") - 1).alias("quantity"),
        _line_id().alias("row_id"),
    )


def raw_saleprices(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    tenths = F.rint(F.col("p_retailprice") * 10).cast("bigint")
    discounted = tenths * (10 - F.rint(F.col("l_discount") * 100).cast("int")) / F.lit(100.0)
    above_retail = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    return (
        _read(spark, sf_dir, "lineitem")
        .filter("l_discount > 0")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.col("l_partkey").alias("productid"),
            F.col("l_shipdate").cast("date").alias("date"),
            F.when(above_retail, F.col("p_retailprice") + 10)
            .otherwise(discounted)
            .alias("saleprice"),
            _line_id().alias("row_id"),
        )
    )


def raw_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = (
        _read(spark, sf_dir, "lineitem")
        .select(F.year("l_shipdate").alias("y"))
        .union(spark.range(1).select(F.lit(EXTRA_YEAR).alias("y")))
        .distinct()
    )
    days = F.array(
        *(
            F.struct(
                F.make_date(F.col("y"), F.lit(month), F.lit(day)).alias("date"),
                F.lit(name).alias("holidayname"),
            )
            for month, day, name in YEARLY_HOLIDAYS
        )
    )
    return years.select(F.inline(days))


def raw_from_testdata(spark: SparkSession, sf_dir: str) -> Mapping[str, DataFrame]:
    """All five raw datasets; use with ``LINE_ORDER``."""
    return LazyFrames(
        {
            "stores": lambda: raw_stores(spark, sf_dir),
            "products": lambda: raw_products(spark, sf_dir),
            "sales": lambda: raw_sales(spark, sf_dir),
            "saleprices": lambda: raw_saleprices(spark, sf_dir),
            "holidays": lambda: raw_holidays(spark, sf_dir),
        }
    )
