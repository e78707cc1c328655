"""Report and lookup queries over the stored tables. Each returns a lazy DataFrame.

Single sales join stored tables one by one, never a join of two: Spark knows the size
of a stored table and broadcasts a small one, but takes a join for the product of
its sides, and would shuffle the sales to meet it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import amount, in_period, money, money_sum, year_month_label
from ..functions.columns import BAND_NAMES
from ..operators.constraints import union_all
from ..operators.revenue import match_sale_price, sale_amount

# The categories, rates and limits the standard reports use.
PREDICTION_CATEGORY = "GPS"
PREDICTION_UPLIFT = 0.75
PREDICTION_THRESHOLD = 5000
GROUNDHOG_CATEGORY = "Air Conditioner"
DAYS_PER_YEAR = 365.0  # leap years included
TOP_MANUFACTURERS = 100
UPLIFT_STEP = Decimal("0.001")
PREDICTED = "decimal(36,13)"  # an amount times an uplift
COUNTED_TABLES = ("Store", "Manufacturer", "Product", "Manager")


def _year():
    return F.year("CalendarDate").alias("Year")


def _month():
    return F.month("CalendarDate").alias("Month")


def _mean_price():
    return money(money_sum(amount(F.col("retail_price"), F.lit(1)))) / F.count("retail_price")


def _broadcast_fits(table: DataFrame) -> bool:
    """Whether Spark would broadcast the table by its size, as far as it is known."""
    plan = table._jdf.queryExecution().optimizedPlan()
    limit = table.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return int(str(plan.stats().sizeInBytes())) <= limit


def simple_count(table: DataFrame) -> DataFrame:
    return table.agg(F.count("*").alias("count"))


def row_counts(
    tables: Mapping[str, DataFrame], names: Sequence[str] = COUNTED_TABLES
) -> DataFrame:
    """One row with one count column per table."""
    counts = union_all(
        [simple_count(tables[name]).withColumn("name", F.lit(name)) for name in names]
    )
    return counts.agg(
        *(F.max(F.when(F.col("name") == n, F.col("count"))).alias(n.lower()) for n in names)
    )


def manufacturer_product(
    manufacturer: DataFrame, product: DataFrame, limit: int | None = TOP_MANUFACTURERS
) -> DataFrame:
    """Product count and retail prices by maker, the dearest makers first."""
    stats = product.groupBy("ManufacturerName").agg(
        F.count("PID").alias("TotalProduct"),
        _mean_price().alias("ave_retail_price"),
        F.min("retail_price").alias("min_retail_price"),
        F.max("retail_price").alias("max_retail_price"),
    )
    ranked = (
        manufacturer.join(stats, "ManufacturerName", "left")
        .withColumn("TotalProduct", F.coalesce("TotalProduct", F.lit(0).cast("bigint")))
        .select("ManufacturerName", "max_discount", *stats.columns[1:])
        .orderBy(F.desc("ave_retail_price"), "ManufacturerName")
    )
    return ranked if limit is None else ranked.limit(limit)


def manufacturer_product_detail(
    manufacturer: DataFrame, product: DataFrame, belongto: DataFrame, name: str | None = None
) -> DataFrame:
    """Products of one maker, or of every maker, with their categories as one text.

    A maker without products keeps one row of nulls. Products are on the left of an inner
    join, which adaptive execution can split where one maker has most of them; makers
    without any come from the distinct names in use.
    """
    makers = manufacturer.select("ManufacturerName")
    if name is not None:
        makers = makers.filter(F.col("ManufacturerName") == name)
    products = product.select("ManufacturerName", "PID", "product_name", "retail_price")
    products = products.join(makers, "ManufacturerName")
    if name is not None:
        belongto = belongto.join(products.select("PID"), "PID", "left_semi")
    names = F.array_join(F.sort_array(F.collect_set("CategoryName")), ",")
    categories = belongto.groupBy("PID").agg(F.nullif(names, F.lit("")).alias("CategoryName"))
    in_use = product.select("ManufacturerName").distinct()
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in products.schema[1:]}
    bare = makers.join(in_use, "ManufacturerName", "left_anti").withColumns(nothing)
    return (
        products.unionByName(bare)
        .join(categories, "PID", "left")
        .select("ManufacturerName", "PID", "product_name", "CategoryName", "retail_price")
        .orderBy("ManufacturerName", F.desc("retail_price"), "PID")
    )


def category_report(
    category: DataFrame, belongto: DataFrame, product: DataFrame, manufacturer: DataFrame
) -> DataFrame:
    """Products, makers and mean retail price of each category, empty ones included."""
    makers = manufacturer.select("ManufacturerName", F.col("ManufacturerName").alias("_maker"))
    stats = (
        belongto.join(product, "PID", "left")
        .join(makers, "ManufacturerName", "left")
        .groupBy("CategoryName")
        .agg(
            F.count("PID").alias("TotalProduct"),
            F.countDistinct("_maker").alias("TotalManufacturer"),
            _mean_price().alias("AvePrice"),
        )
    )
    none = F.lit(0).cast("bigint")
    return (
        category.join(stats, "CategoryName", "left")
        .withColumn("TotalProduct", F.coalesce("TotalProduct", none))
        .withColumn("TotalManufacturer", F.coalesce("TotalManufacturer", none))
        .select("CategoryName", "TotalProduct", "TotalManufacturer", "AvePrice")
        .orderBy("CategoryName")
    )


def _category_days(sold: DataFrame, belongto: DataFrame, category: str) -> DataFrame:
    """Units of a category's products by product and day.

    Stored sales are bucketed by product and day, so the sums need no shuffle. The
    semi join stands above them: Catalyst moves it below where the members are
    small enough to broadcast, and else it meets sums instead of single sales, so
    no hot product can fill a task.
    """
    members = belongto.filter(F.col("CategoryName") == category).select("PID")
    daily = sold.groupBy("PID", "CalendarDate").agg(F.sum("quantity").alias("quantity"))
    return daily.join(members, "PID", "left_semi")


def actual_vs_predicted(
    sold: DataFrame,
    onsale: DataFrame,
    product: DataFrame,
    belongto: DataFrame,
    category: str = PREDICTION_CATEGORY,
    uplift: float = PREDICTION_UPLIFT,
    threshold: float = PREDICTION_THRESHOLD,
) -> DataFrame:
    """Products whose revenue differs from the one predicted without discounts.

    The prediction sells ``uplift`` of the discounted units at full price; it counts to
    three places. A sale
    price holds for a product and day, so sales are summed by those before they
    meet the prices, and products join only the final sums.
    """
    units = (
        match_sale_price(_category_days(sold, belongto, category), onsale)
        .groupBy("PID")
        .agg(
            F.sum("RetailQuantity").alias("TotalUnitsSoldNoDiscount"),
            F.sum("SaleQuantity").alias("TotalUnitsSoldWithDiscount"),
            money_sum(amount(F.col("SalePrice"), F.col("SaleQuantity"))).alias("_discounted"),
        )
    )
    full, discounted = F.col("TotalUnitsSoldNoDiscount"), F.col("TotalUnitsSoldWithDiscount")
    retail, part = F.col("retail_price"), Decimal(str(uplift)).quantize(UPLIFT_STEP)
    predicted = (amount(retail, full) + amount(retail, discounted) * F.lit(part)).cast(PREDICTED)
    actual = (amount(retail, full) + F.col("_discounted")).cast(PREDICTED)
    return (
        units.join(product.select("PID", "product_name", "retail_price"), "PID", "left")
        .withColumns({"TotalUnitsSold": full + discounted, "_actual": actual, "_predicted": predicted})
        .withColumns(
            {
                "ActualRevenue": money(F.col("_actual")),
                "PredictedRevenue": money(F.col("_predicted")),
                "Difference": money(F.col("_actual") - F.col("_predicted")),
            }
        )
        .filter(F.abs("Difference") > threshold)
        .select(
            "PID",
            "product_name",
            "retail_price",
            "TotalUnitsSold",
            "TotalUnitsSoldNoDiscount",
            "TotalUnitsSoldWithDiscount",
            "ActualRevenue",
            "PredictedRevenue",
            "Difference",
        )
        .orderBy(F.desc("Difference"), "PID")
    )


def states(city: DataFrame) -> DataFrame:
    return city.select("State").distinct().orderBy("State")


def _store_years(sold: DataFrame, onsale: DataFrame, product: DataFrame) -> DataFrame:
    """Revenue by store and year, as exact amounts.

    Stored sales meet their sale prices in place, then the prices of their products: where
    these can't be broadcast, by the one shuffle of single sales. Few sales share store, product
    and year, so sums of these would be shuffled as often and wider; adaptive execution splits a
    hot product's sales among tasks.
    """
    matched = match_sale_price(sold, onsale).select(
        "StoreNumber", "PID", _year(), "RetailQuantity", "SaleQuantity", "SalePrice"
    )
    priced = matched.join(product.select("PID", "retail_price"), "PID", "left").withColumn("_amount", sale_amount())
    return priced.groupBy("StoreNumber", "Year").agg(money_sum(F.col("_amount")).alias("_amount"))


def daily_revenue(sold: DataFrame, onsale: DataFrame, product: DataFrame) -> DataFrame:
    """Exact revenue by store and day: (StoreNumber, CalendarDate, amount)."""
    priced = match_sale_price(sold, onsale).join(product.select("PID", "retail_price"), "PID", "left")
    return priced.groupBy("StoreNumber", "CalendarDate").agg(money_sum(sale_amount()).alias("amount"))


def daily_revenue_change(
    new_sold: DataFrame, sold: DataFrame, new_onsale: DataFrame, onsale: DataFrame, product: DataFrame
) -> DataFrame:
    """What appended sales and sale prices add to ``daily_revenue``; may hold several rows a day.

    ``sold`` and ``onsale`` hold the appended rows too. New sales count at the prices known
    before; then every sale of a day that got its price now counts by the difference.
    """
    before = onsale.join(new_onsale.select("PID", "CalendarDate"), ["PID", "CalendarDate"], "left_anti")
    fresh = daily_revenue(new_sold, before, product)
    moved = sold.join(new_onsale, ["PID", "CalendarDate"]).join(product.select("PID", "retail_price"), "PID")
    change = amount(F.col("SalePrice"), F.col("quantity")) - amount(F.col("retail_price"), F.col("quantity"))
    moved = moved.groupBy("StoreNumber", "CalendarDate").agg(money_sum(change).alias("amount"))
    return fresh.unionByName(moved)


def _years_of(daily: DataFrame) -> DataFrame:
    return daily.groupBy("StoreNumber", _year()).agg(money_sum(F.col("amount")).alias("_amount"))


def store_revenue_by_year(
    sold: DataFrame,
    onsale: DataFrame,
    product: DataFrame,
    store: DataFrame,
    city: DataFrame,
    state: str | None = None,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Revenue of each store and year in one state, or in all with a State column.

    Sales of other states leave before any price is looked up where the stores can be
    broadcast. Else a join would shuffle all sales out of their buckets, so they are
    priced and summed in place and the sums of other states leave. Addresses join the
    finished sums. With ``daily``, a stored ``daily_revenue`` of these tables, no sale is read.
    """
    places = city.select("CityState", "CityName", "State")
    if state is not None:
        places = places.filter(F.col("State") == state)
        local = store.join(places, "CityState", "left_semi").select("StoreNumber")
        if daily is not None:
            daily = daily.join(local, "StoreNumber", "left_semi")
        elif _broadcast_fits(store.select("StoreNumber", "CityState")):
            sold = sold.join(local, "StoreNumber", "left_semi")
    years = _store_years(sold, onsale, product) if daily is None else _years_of(daily)
    located = years.join(store, "StoreNumber").join(places, "CityState")
    revenue = money(F.col("_amount")).alias("TotalRevenue")
    columns = ["StoreNumber", "street_address", "CityName", "Year", revenue]
    if state is None:
        columns.insert(0, "State")
    return located.select(*columns).orderBy("Year", F.desc("TotalRevenue"), "StoreNumber")


def groundhog(
    sold: DataFrame,
    belongto: DataFrame,
    category: str = GROUNDHOG_CATEGORY,
    month: int = 2,
    day: int = 2,
) -> DataFrame:
    """Yearly units of a category: total, per day, and on one calendar day.

    A year without a sale on the day shows null there.
    """
    on_day = (F.month("CalendarDate") == month) & (F.dayofmonth("CalendarDate") == day)
    return (
        _category_days(sold, belongto, category)
        .groupBy(_year())
        .agg(
            F.sum("quantity").alias("ItemsSold_Annually"),
            F.sum(F.when(on_day, F.col("quantity"))).alias("ItemsSold_OnGroundhog"),
        )
        .select(
            "Year",
            "ItemsSold_Annually",
            F.round(F.col("ItemsSold_Annually").cast("double") / DAYS_PER_YEAR, 4).alias(
                "ItemsSold_DailyOnAverage"
            ),
            "ItemsSold_OnGroundhog",
        )
        .orderBy("Year")
    )


def year_months(cdate: DataFrame) -> DataFrame:
    return cdate.select(_year(), _month()).distinct().orderBy("Year", "Month")


def sale_years(sold: DataFrame) -> DataFrame:
    return sold.select(_year()).distinct()


def sale_months(sold: DataFrame) -> DataFrame:
    return sold.select(_month()).distinct()


def _period_sales(sold: DataFrame, year: int | None, month: int | None) -> DataFrame:
    period = in_period(F.col("CalendarDate"), year, month)
    return sold if period is None else sold.filter(period)


def _category_sales(
    sold: DataFrame, belongto: DataFrame, year: int | None, month: int | None
) -> DataFrame:
    """Units by category, product, store and open period.

    Sales are summed before they meet the categories, which repeat them, and before the
    shuffle on the product, which may be a hot one.
    """
    units = (
        _period_sales(sold, year, month)
        .groupBy("PID", "StoreNumber", *_periods(year, month))
        .agg(F.sum("quantity").alias("quantity"))
    )
    return units.join(belongto.filter("CategoryName IS NOT NULL"), "PID")


def _periods(year: int | None, month: int | None) -> list:
    """Grouping columns for the parts of the period left open."""
    open_month = [_month()] if month is None else []
    return [_year(), *open_month] if year is None else open_month


def top_state_per_category(
    sold: DataFrame,
    store: DataFrame,
    city: DataFrame,
    belongto: DataFrame,
    year: int | None = None,
    month: int | None = None,
) -> DataFrame:
    """The state selling most units of each category; ties are all kept.

    Without a year or month every year and month in the sales is ranked.
    """
    periods = [c for c, part in (("Year", year), ("Month", month)) if part is None]
    units = (
        _category_states(sold, store, city, belongto, year, month)
        .groupBy("CategoryName", "State", *periods)
        .agg(F.sum("quantity").alias("Quantity"))
    )
    return _leaders(units)


def _category_states(
    sold: DataFrame, store: DataFrame, city: DataFrame, belongto: DataFrame, year: int | None, month: int | None
) -> DataFrame:
    """Units by category, product, state and open period.

    Where stores and cities can be broadcast, sales are summed by product and state, of which
    there are far fewer than of product and store, where they are read.
    """
    places, states_of = store.select("StoreNumber", "CityState"), city.select("CityState", "State")
    if not (_broadcast_fits(places) and _broadcast_fits(states_of)):
        sums = _category_sales(sold, belongto, year, month)
        return sums.join(places, "StoreNumber", "left").join(states_of, "CityState", "left")
    located = _period_sales(sold, year, month).join(places, "StoreNumber", "left").join(states_of, "CityState", "left")
    sums = located.groupBy("PID", "State", *_periods(year, month)).agg(F.sum("quantity").alias("quantity"))
    return sums.join(belongto.filter("CategoryName IS NOT NULL"), "PID")


def _leaders(units: DataFrame) -> DataFrame:
    parts = [c for c in ("Year", "Month") if c in units.columns]
    best = Window.partitionBy("CategoryName", *parts).orderBy(F.desc("Quantity"))
    return (
        units.withColumn("_rank", F.rank().over(best))
        .filter("_rank = 1")
        .select(*parts, "CategoryName", "State", "Quantity")
        .orderBy(*parts, "CategoryName", "State")
    )


def _staffed_stores(
    store: DataFrame, city: DataFrame, assigned: DataFrame, manager: DataFrame
) -> DataFrame:
    """Stores with their city and each active manager."""
    return (
        store.join(city.select("CityState", "CityName", "State"), "CityState")
        .join(assigned, "StoreNumber")
        .join(manager.filter("EmploymentStatus = 1"), "Email")
    )


DRILLDOWN_COLUMNS = ("StoreNumber", "street_address", "CityName", "manager_name", "Email")


def top_state_drilldown(
    sold: DataFrame,
    store: DataFrame,
    city: DataFrame,
    belongto: DataFrame,
    assigned: DataFrame,
    manager: DataFrame,
    state: str,
    category: str,
    year: int,
    month: int,
) -> DataFrame:
    """Stores of a state that sold the category in the month, with active managers."""
    members = belongto.filter(F.col("CategoryName") == category)
    local = city.filter(F.col("State") == state)
    staffed = _staffed_stores(store, local, assigned, manager)
    selling = _period_sales(sold, year, month).join(members, "PID").select("StoreNumber").distinct()
    return (
        staffed.join(selling, "StoreNumber")
        .select(*DRILLDOWN_COLUMNS)
        .distinct()
        .orderBy("StoreNumber", "Email")
    )


LEADER_SALTS = 64


def _with_stores(leaders: DataFrame, selling: DataFrame) -> DataFrame:
    """Leaders with their selling stores, or one row of nulls.

    Most stores may sell for one leader: leaders, which are few, are repeated over salts that
    the stores are dealt to, and those without a store come from an anti join.
    """
    pair = ["CategoryName", "State"]
    salts = F.explode(F.sequence(F.lit(0), F.lit(LEADER_SALTS - 1))).alias("_salt")
    dealt = selling.withColumn("_salt", F.pmod(F.hash("StoreNumber", "Email"), F.lit(LEADER_SALTS)))
    found = dealt.join(leaders.select("*", salts), [*pair, "_salt"]).drop("_salt")
    bare = leaders.join(selling.select(*pair).distinct(), pair, "left_anti")
    return found.unionByName(bare, allowMissingColumns=True)


def top_state_bundle(
    sold: DataFrame,
    store: DataFrame,
    city: DataFrame,
    belongto: DataFrame,
    assigned: DataFrame,
    manager: DataFrame,
    year: int,
    month: int,
) -> DataFrame:
    """Every leading state of a month with its drill-down, in one result.

    A leader whose selling stores have no active manager keeps one row of nulls.
    Units by category and store feed both the ranking and the store lists; with
    the same columns and filters on both sides Spark scans the sales once.
    """
    located = store.join(city, "CityState", "left").select("StoreNumber", "State")
    by_store = (
        _category_sales(sold.filter("StoreNumber IS NOT NULL"), belongto, year, month)
        .groupBy("CategoryName", "StoreNumber")
        .agg(F.sum("quantity").alias("Quantity"))
    )
    leaders = _leaders(
        by_store.join(located, "StoreNumber", "left")
        .groupBy("CategoryName", "State")
        .agg(F.sum("Quantity").alias("Quantity"))
    )
    selling = (
        by_store.filter("Quantity IS NOT NULL")
        .select("CategoryName", "StoreNumber")
        .join(_staffed_stores(store, city, assigned, manager), "StoreNumber")
    )
    return (
        _with_stores(leaders, selling)
        .select(
            "CategoryName",
            year_month_label(F.lit(year), F.lit(month)).alias("YearMonth"),
            "State",
            "Quantity",
            *DRILLDOWN_COLUMNS,
        )
        .distinct()
        .orderBy("CategoryName", "State", "StoreNumber", "Email")
    )


def revenue_by_population(
    sold: DataFrame,
    onsale: DataFrame,
    product: DataFrame,
    store: DataFrame,
    city: DataFrame,
    daily: DataFrame | None = None,
) -> DataFrame:
    """Mean yearly revenue of the cities in each population band.

    The mean is over cities with sales in the year; stores of no known city count as
    one city without a band. With ``daily``, a stored ``daily_revenue`` of these tables, no
    sale is read.
    """
    bands = city.select("CityState", F.col("CityState").alias("_city"), "city_size")
    years = _store_years(sold, onsale, product) if daily is None else _years_of(daily)
    cities = (
        years.join(store.select("StoreNumber", "CityState"), "StoreNumber", "left")
        .join(bands, "CityState", "left")
        .groupBy("Year", "_city", "city_size")
        .agg(money_sum(F.col("_amount")).alias("_amount"))
    )
    return (
        cities.groupBy("Year", F.col("city_size").alias("Population_Category"))
        .agg((money(money_sum(F.col("_amount"))) / F.count("*")).alias("Average_Revenue"))
        .orderBy("Year", F.desc("Population_Category"))
    )


def revenue_by_population_pivot(by_population: DataFrame) -> DataFrame:
    """One row per year, one column per band; a band without cities is null."""
    known = by_population.filter("Population_Category IS NOT NULL AND Average_Revenue IS NOT NULL")
    return (
        known.groupBy("Year")
        .pivot("Population_Category", list(BAND_NAMES))
        .agg(F.avg("Average_Revenue"))
        .orderBy("Year")
    )


def holidays(holiday: DataFrame) -> DataFrame:
    return holiday.select("CalendarDate", "HolidayName")


def managers(manager: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per assignment; a manager without one has a null StoreNumber."""
    return manager.join(assigned, "Email", "left").select(
        "Email", "manager_name", "EmploymentStatus", "StoreNumber"
    )


def cities(city: DataFrame) -> DataFrame:
    return city.select("CityName", "State", "population", "city_size")
