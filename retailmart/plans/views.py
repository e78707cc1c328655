"""The three stored views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ..functions.money import AMOUNT, PRICE, UNITS
from .reports import DAYS_PER_YEAR, GROUNDHOG_CATEGORY, groundhog, revenue_by_population, states

# View names. Each with the tables it reads.
VIEW_TABLES: Mapping[str, tuple[str, ...]] = {
    "States": ("City",),
    "Report5_ACGroundhog": ("Sold", "BelongTo"),
    "Report7_Before_Pivot": ("Sold", "OnSale", "Product", "Store", "City"),
}
VIEW_NAMES = tuple(VIEW_TABLES)

# The reports of the same content in SQL, as a view of the catalog needs it.
_VIEW_SQL = {
    "States": "SELECT DISTINCT State FROM {db}.City ORDER BY State",
    "Report5_ACGroundhog": """
        SELECT year(CalendarDate) AS Year, sum(quantity) AS ItemsSold_Annually,
               round(CAST(sum(quantity) AS DOUBLE) / {days}D, 4) AS ItemsSold_DailyOnAverage,
               sum(quantity) FILTER (WHERE month(CalendarDate) = 2 AND day(CalendarDate) = 2)
                   AS ItemsSold_OnGroundhog
        FROM (SELECT PID, CalendarDate, sum(quantity) AS quantity FROM {db}.Sold
              GROUP BY PID, CalendarDate) AS daily
        LEFT SEMI JOIN (SELECT PID FROM {db}.BelongTo WHERE CategoryName = {category}) AS members
            ON daily.PID = members.PID
        GROUP BY year(CalendarDate) ORDER BY Year""",
    "Report7_Before_Pivot": """
        SELECT Year, city_size AS Population_Category,
               CAST(CAST(sum(revenue) AS {amount}) AS DOUBLE) / count(*) AS Average_Revenue
        FROM (SELECT Year, c.CityState, c.city_size, CAST(sum(revenue) AS {amount}) AS revenue
              FROM (SELECT StoreNumber, year(s.CalendarDate) AS Year,
                           CAST(sum(CAST(coalesce(o.SalePrice, p.retail_price) AS {price})
                                    * CAST(s.quantity AS {units})) AS {amount}) AS revenue
                    FROM {db}.Sold AS s
                    LEFT JOIN {db}.OnSale AS o ON s.PID = o.PID AND s.CalendarDate = o.CalendarDate
                    LEFT JOIN {db}.Product AS p ON s.PID = p.PID
                    GROUP BY StoreNumber, year(s.CalendarDate)) AS y
              LEFT JOIN {db}.Store AS st ON y.StoreNumber = st.StoreNumber
              LEFT JOIN {db}.City AS c ON st.CityState = c.CityState
              GROUP BY Year, c.CityState, c.city_size)
        GROUP BY Year, city_size ORDER BY Year, Population_Category DESC""",
}


def create_catalog_views(spark: SparkSession, database: str, category: str = GROUNDHOG_CATEGORY) -> None:
    """Create or replace the views in a database, bound to its tables by name.

    No table is read: an edit, a load or an append shows at the next use of a view.
    """
    literal = "'" + category.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = {"db": f"`{database}`", "category": literal, "days": DAYS_PER_YEAR, "amount": AMOUNT, "price": PRICE, "units": UNITS}
    for name, text in _VIEW_SQL.items():
        spark.sql(f"CREATE OR REPLACE VIEW `{database}`.`{name}` AS {text.format(**values)}")


def create_views(
    tables: Mapping[str, DataFrame], category: str = GROUNDHOG_CATEGORY
) -> None:
    """Register the views for the session, replacing earlier ones. They stay lazy over the tables."""
    frames = (
        states(tables["City"]),
        groundhog(tables["Sold"], tables["BelongTo"], category),
        revenue_by_population(
            tables["Sold"],
            tables["OnSale"],
            tables["Product"],
            tables["Store"],
            tables["City"],
        ),
    )
    for name, frame in zip(VIEW_NAMES, frames):
        frame.createOrReplaceTempView(name)
