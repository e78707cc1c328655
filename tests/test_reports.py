"""Report edges on hand-made tables."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from retailmart.operators.revenue import priced_sales
from retailmart.plans import reports as r
from retailmart.plans.views import create_views
from retailmart.schema import TABLES

D1, D2 = dt.date(2001, 3, 4), dt.date(2001, 3, 5)


def table(spark, name, data):
    return spark.createDataFrame(data, TABLES[name].schema)


def listed(df, *columns):
    return [tuple(x) for x in df.select(*(columns or df.columns)).collect()]


@pytest.fixture(scope="module")
def t(spark):
    return {
        "City": table(
            spark,
            "City",
            [("A, S", "A", "S", 1, "Small"), ("B, T", "B", "T", 4_000_000, "Medium"), ("C, S", "C", "S", 2, "Small")],
        ),
        "Store": table(
            spark,
            "Store",
            [(1, "p", "a1", "A, S"), (2, "p", "a2", "B, T"), (3, "p", "a3", "gone"), (4, "p", "a4", "C, S")],
        ),
        "Manufacturer": table(spark, "Manufacturer", [("M", 0.5), ("N", 0.1), ("Idle", 0.2)]),
        "Product": table(spark, "Product", [(1, "x", 10.0, "M"), (2, "y", 20.0, "M"), (3, "z", 5.0, "N")]),
        "Category": table(spark, "Category", [("K",), ("L",), ("Empty",)]),
        "BelongTo": table(spark, "BelongTo", [(1, "L"), (1, "K"), (2, "K")]),
        "Cdate": table(spark, "Cdate", [(D1,), (D2,)]),
        "Holiday": table(spark, "Holiday", [(D1, "h")]),
        "Sold": table(
            spark,
            "Sold",
            [
                (1, 1, D1, 5),
                (2, 1, D1, 5),
                (3, 1, D1, 7),
                (1, 2, D2, 4),
                (2, 3, D2, 100),
                (4, 2, dt.date(2002, 2, 2), 1),
            ],
        ),
        "OnSale": table(spark, "OnSale", [(1, D1, 0.0), (2, D2, 15.0)]),
        "Manager": table(spark, "Manager", [("on@x", "On", 1), ("off@x", "Off", 0), ("two@x", "Two", 1), ("free@x", "Free", 1)]),
        "AssignedTo": table(spark, "AssignedTo", [("on@x", 1), ("two@x", 1), ("off@x", 2), ("on@x", 3)]),
    }


def test_price_of_zero_is_a_price(t):
    df = priced_sales(t["Sold"], t["OnSale"], t["Product"]).orderBy("PID", "StoreNumber")
    assert listed(df, "PID", "SalePrice", "RetailQuantity", "SaleQuantity", "Revenue") == [
        (1, 0.0, 0, 5, 0.0),
        (1, 0.0, 0, 5, 0.0),
        (1, 0.0, 0, 7, 0.0),
        (2, 15.0, 0, 4, 60.0),
        (2, 0.0, 1, 0, 20.0),
        (3, 0.0, 100, 0, 500.0),
    ]


def test_row_counts(t):
    assert r.row_counts(t).first().asDict() == {"store": 4, "manufacturer": 3, "product": 3, "manager": 4}
    assert listed(r.simple_count(t["Sold"])) == [(6,)]


def test_manufacturer_without_products_comes_last(t):
    assert listed(r.manufacturer_product(t["Manufacturer"], t["Product"])) == [
        ("M", 0.5, 2, 15.0, 10.0, 20.0),
        ("N", 0.1, 1, 5.0, 5.0, 5.0),
        ("Idle", 0.2, 0, None, None, None),
    ]
    assert len(listed(r.manufacturer_product(t["Manufacturer"], t["Product"], limit=1))) == 1
    assert len(listed(r.manufacturer_product(t["Manufacturer"], t["Product"], limit=None))) == 3


def test_manufacturer_detail(t):
    args = t["Manufacturer"], t["Product"], t["BelongTo"]
    assert listed(r.manufacturer_product_detail(*args)) == [
        ("Idle", None, None, None, None),
        ("M", 2, "y", "K", 20.0),
        ("M", 1, "x", "K,L", 10.0),
        ("N", 3, "z", None, 5.0),
    ]
    assert listed(r.manufacturer_product_detail(*args, name="N"), "PID") == [(3,)]


def test_empty_category_counts_zero(t):
    args = t["Category"], t["BelongTo"], t["Product"], t["Manufacturer"]
    assert listed(r.category_report(*args)) == [("Empty", 0, 0, None), ("K", 2, 1, 15.0), ("L", 1, 1, 10.0)]


def test_actual_vs_predicted_threshold_is_strict(t):
    args = t["Sold"], t["OnSale"], t["Product"], t["BelongTo"]
    # Product 1: 17 units at 0 against 17 * 0.75 * 10; product 2: 4 at 15, 1 at 20.
    rows = listed(r.actual_vs_predicted(*args, category="K", threshold=0))
    assert rows == [(1, "x", 10.0, 17, 0, 17, 0.0, 127.5, -127.5)]
    assert listed(r.actual_vs_predicted(*args, category="K", threshold=-1), "PID") == [(2,), (1,)]
    assert listed(r.actual_vs_predicted(*args, category="K", threshold=127.5)) == []
    assert listed(r.actual_vs_predicted(*args, category="K", uplift=0.5, threshold=0), "Difference") == [(20.0,), (-85.0,)]


def test_store_revenue(t):
    args = t["Sold"], t["OnSale"], t["Product"], t["Store"], t["City"]
    assert listed(r.store_revenue_by_year(*args, state="S")) == [
        (1, "a1", "A", 2001, 60.0),
        (4, "a4", "C", 2002, 20.0),
    ]
    assert listed(r.store_revenue_by_year(*args), "State", "StoreNumber") == [("T", 2), ("S", 1), ("S", 4)]


def test_states(t):
    assert listed(r.states(t["City"])) == [("S",), ("T",)]


def test_groundhog_year_without_the_day_is_null(t):
    assert listed(r.groundhog(t["Sold"], t["BelongTo"], category="K")) == [
        (2001, 21, 0.0575, None),
        (2002, 1, 0.0027, 1),
    ]
    assert listed(r.groundhog(t["Sold"], t["BelongTo"], category="none")) == []


def test_period_lists(t):
    assert listed(r.year_months(t["Cdate"])) == [(2001, 3)]
    assert sorted(listed(r.sale_years(t["Sold"]))) == [(2001,), (2002,)]
    assert sorted(listed(r.sale_months(t["Sold"]))) == [(2,), (3,)]


def test_top_state_null_state_and_ties(t):
    args = t["Store"], t["City"], t["BelongTo"]
    # Store 3 has no city: its state is null and still leads; product 3 has no category.
    assert listed(r.top_state_per_category(t["Sold"], *args, year=2001, month=3)) == [
        ("K", "S", 9),
        ("L", None, 7),
    ]
    tied = t["Sold"].filter("StoreNumber < 3 AND PID = 1")
    assert listed(r.top_state_per_category(tied, *args, year=2001, month=3)) == [
        ("K", "S", 5),
        ("K", "T", 5),
        ("L", "S", 5),
        ("L", "T", 5),
    ]


def test_top_state_open_periods(t):
    args = t["Sold"], t["Store"], t["City"], t["BelongTo"]
    every = r.top_state_per_category(*args)
    assert listed(every) == [(2001, 3, "K", "S", 9), (2001, 3, "L", None, 7), (2002, 2, "K", "S", 1)]
    assert r.top_state_per_category(*args, year=2002).columns == ["Month", "CategoryName", "State", "Quantity"]
    assert listed(r.top_state_per_category(*args, month=2)) == [(2002, "K", "S", 1)]


def test_drilldown_lists_active_managers_only(t):
    args = [t[n] for n in ("Sold", "Store", "City", "BelongTo", "AssignedTo", "Manager")]
    assert listed(r.top_state_drilldown(*args, state="S", category="K", year=2001, month=3)) == [
        (1, "a1", "A", "On", "on@x"),
        (1, "a1", "A", "Two", "two@x"),
    ]
    assert listed(r.top_state_drilldown(*args, state="T", category="K", year=2001, month=3)) == []


def test_bundle_keeps_leaders_without_managers(t):
    args = [t[n] for n in ("Sold", "Store", "City", "BelongTo", "AssignedTo", "Manager")]
    assert listed(r.top_state_bundle(*args, year=2001, month=3)) == [
        ("K", "2001/03", "S", 9, 1, "a1", "A", "On", "on@x"),
        ("K", "2001/03", "S", 9, 1, "a1", "A", "Two", "two@x"),
        ("L", "2001/03", None, 7, None, None, None, None, None),
    ]


def test_revenue_by_population_and_missing_bands(t):
    args = t["Sold"], t["OnSale"], t["Product"], t["Store"], t["City"]
    long = r.revenue_by_population(*args)
    assert listed(long) == [
        (2001, "Small", 60.0),
        (2001, "Medium", 500.0),
        (2001, None, 0.0),
        (2002, "Small", 20.0),
    ]
    assert listed(r.revenue_by_population_pivot(long)) == [
        (2001, 60.0, 500.0, None, None),
        (2002, 20.0, None, None, None),
    ]
    only_null = long.filter("Population_Category IS NULL")
    assert listed(r.revenue_by_population_pivot(only_null)) == []


def test_mean_is_over_cities_that_sold(t, spark):
    sold = table(spark, "Sold", [(1, 3, D1, 2), (4, 3, D1, 1)])
    args = t["OnSale"], t["Product"], t["Store"], t["City"]
    assert listed(r.revenue_by_population(sold, *args)) == [(2001, "Small", 7.5)]


def test_stores_of_unknown_cities_are_one_city(t, spark):
    sold = table(spark, "Sold", [(3, 3, D1, 2), (9, 3, D1, 1)])
    store = t["Store"].union(table(spark, "Store", [(9, "p", "a9", "lost")]))
    args = t["OnSale"], t["Product"], store, t["City"]
    assert listed(r.revenue_by_population(sold, *args)) == [(2001, None, 15.0)]


def test_managers_without_store(t):
    found = sorted(listed(r.managers(t["Manager"], t["AssignedTo"])), key=repr)
    assert ("free@x", "Free", 1, None) in found
    assert len(found) == 5


def test_views_follow_the_tables(t, spark):
    create_views(t, category="K")
    assert listed(spark.table("States")) == [("S",), ("T",)]
    assert spark.table("Report5_ACGroundhog").count() == 2
    assert spark.sql("SELECT * FROM Report7_Before_Pivot").count() == 4
    create_views({**t, "City": t["City"].filter("State = 'T'")}, category="K")
    assert listed(spark.table("States")) == [("T",)]


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
def test_money_of_a_hot_product_is_exact(spark, t, broadcast):
    """Products and sums of doubles would show their rounding."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    prices = {1: 12.679983, 2: 0.1, 3: 987.654321}
    days = [D1 + dt.timedelta(days=k) for k in range(300)]
    sales = [(1 + k % 4, 1 if k % 3 else 2 + k % 2, day, 10_007 * (k + 1)) for k, day in enumerate(days)]
    offers = [(1, day, 11.123457) for day in days[::7]] + [(2, day, 0.070001) for day in days[::5]]
    tables = {
        **t,
        "Sold": table(spark, "Sold", sales),
        "OnSale": table(spark, "OnSale", offers),
        "Product": table(spark, "Product", [(pid, "x", price, "M") for pid, price in prices.items()]),
    }
    offered = {(pid, day): price for pid, day, price in offers}
    exact = {}
    for store, pid, day, units in sales:
        part = Decimal(str(offered.get((pid, day), prices[pid]))) * units
        exact[store, day.year] = exact.get((store, day.year), Decimal(0)) + part
    located = [tables[n] for n in ("Sold", "OnSale", "Product", "Store", "City")]
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
        found = {(x["StoreNumber"], x["Year"]): x["TotalRevenue"] for x in r.store_revenue_by_year(*located).collect()}
        assert found == {key: float(value) for key, value in exact.items() if key[0] != 3}
        cities = r.revenue_by_population(*located).where("Year = 2001 AND Population_Category = 'Small'").first()
        assert cities["Average_Revenue"] == float(exact[1, 2001] + exact[4, 2001]) / 2
        one = r.actual_vs_predicted(*located[:3], t["BelongTo"], category="L", uplift=0.333, threshold=0).first()
        full = sum(q for _, p, d, q in sales if p == 1 and (p, d) not in offered)
        less = sum(q for _, p, d, q in sales if p == 1 and (p, d) in offered)
        retail = Decimal(str(prices[1]))
        predicted = retail * full + retail * less * Decimal("0.333")
        actual = retail * full + Decimal("11.123457") * less
        assert [one[c] for c in ("ActualRevenue", "PredictedRevenue", "Difference")] == [
            float(actual), float(predicted), float(actual - predicted)
        ]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("price", [float("inf"), 1e12])
def test_amounts_that_do_not_fit_are_errors(spark, t, price):
    product = table(spark, "Product", [(1, "x", price, "M"), (2, "y", 20.0, "M"), (3, "z", 5.0, "N")])
    with pytest.raises(Exception, match="no exact amount of money"):
        r.store_revenue_by_year(t["Sold"], t["OnSale"].limit(0), product, t["Store"], t["City"]).collect()


def test_stores_of_one_leader_are_spread(spark):
    """90 % of the stores sell for one leader; no task gets much more than the others."""
    names = "CategoryName string, State string"
    leaders = spark.createDataFrame([("K", "S", 9), ("L", "T", 5), ("M", "U", 1), ("N", None, 2)], f"{names}, Quantity long")
    rows = [("K" if k % 10 else "L", "S" if k % 10 else "T", k, "a@x") for k in range(4000)] + [("M", "S", 1, "a@x"), ("N", None, 1, "a@x")]
    selling = spark.createDataFrame(rows, f"{names}, StoreNumber long, Email string")
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        joined = r._with_stores(leaders, selling)
        tasks = joined.filter("StoreNumber IS NOT NULL").groupBy(F.spark_partition_id()).count().collect()
        sizes = sorted(x["count"] for x in tasks)
        assert len(sizes) == 8 and sizes[-1] < 3 * sizes[len(sizes) // 2]
        assert {(x["CategoryName"], x["State"]) for x in joined.filter("StoreNumber IS NULL").collect()} == {("M", "U"), ("N", None)}
        assert joined.count() == 4002
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
