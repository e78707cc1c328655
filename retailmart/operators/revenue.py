"""Sales with their prices: the core shared by the revenue reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import amount, money


def match_sale_price(sold: DataFrame, onsale: DataFrame) -> DataFrame:
    """Split each sale's quantity into full-price and discounted units.

    Adds SalePrice (0 when there is none), RetailQuantity and SaleQuantity. A sale
    price of exactly 0 is a price. Tables stored in buckets of (PID, CalendarDate)
    join without a shuffle.
    """
    discounted = F.col("SalePrice").isNotNull()
    return sold.join(onsale, ["PID", "CalendarDate"], "left").withColumns(
        {
            "RetailQuantity": F.when(discounted, 0).otherwise(F.col("quantity")),
            "SaleQuantity": F.when(discounted, F.col("quantity")).otherwise(0),
            "SalePrice": F.coalesce("SalePrice", F.lit(0.0)),
        }
    )


def sale_amount():
    """The exact amount of a matched sale, its product's retail_price joined; null without one
    that is needed. A sale is either at full price or at the day's."""
    price = F.when(F.col("RetailQuantity") != 0, F.col("retail_price")).otherwise(F.col("SalePrice"))
    return amount(price, F.col("RetailQuantity") + F.col("SaleQuantity"))


def priced_sales(sold: DataFrame, onsale: DataFrame, product: DataFrame) -> DataFrame:
    """Sales with retail_price, SalePrice, RetailQuantity, SaleQuantity and Revenue."""
    prices = product.select("PID", "retail_price")
    matched = match_sale_price(sold, onsale)
    return matched.join(prices, "PID", "left").withColumn("Revenue", money(sale_amount()))
