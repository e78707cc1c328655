import datetime as dt

import pytest
from pyspark.sql import functions as F

from retailmart.operators import constraints as c
from retailmart.plans.load import check_table, load_tables
from retailmart.schema import TABLES

DAY, NEXT = dt.date(2001, 3, 4), dt.date(2001, 3, 5)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def table(spark, name, data):
    return spark.createDataFrame(data, TABLES[name].schema)


@pytest.fixture
def tables(spark):
    return {
        "City": table(spark, "City", [("A, S", "A", "S", 1, "Small"), ("B, S", "B", "S", 1, "Small")]),
        "Store": table(spark, "Store", [(1, "p", "a", "A, S"), (2, "p", "a", "B, S"), (3, "p", "a", "A, S")]),
        "Manufacturer": table(spark, "Manufacturer", [("M", 0.5), ("N", 0.1)]),
        "Product": table(spark, "Product", [(1, "x", 1.0, "M"), (2, "y", 2.0, "N")]),
        "Category": table(spark, "Category", [("K",)]),
        "BelongTo": table(spark, "BelongTo", [(1, "K"), (2, "K")]),
        "Cdate": table(spark, "Cdate", [(DAY,), (NEXT,)]),
        "Holiday": table(spark, "Holiday", [(DAY, "h")]),
        "Sold": table(spark, "Sold", [(1, 1, DAY, 1), (2, 2, DAY, 2), (3, 2, NEXT, 3)]),
        "OnSale": table(spark, "OnSale", [(1, DAY, 0.9)]),
        "Manager": table(spark, "Manager", [("a@x", "A", 1), ("b@x", "B", 1)]),
        "AssignedTo": table(spark, "AssignedTo", [("a@x", 1), ("a@x", 2)]),
    }


def test_not_null(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    accepted, rejected = c.check_not_null(df, ["a", "b"])
    assert rows(accepted) == [(2, "x")]
    assert rows(rejected) == [(1, None, "null in b")]


def test_predicate_bounds_are_inclusive_and_unknown_passes(spark):
    df = spark.createDataFrame([(0.0,), (0.9,), (0.91,), (-0.1,), (None,)], "max_discount double")
    check = TABLES["Manufacturer"].checks["max_discount_range"]
    accepted, rejected = c.check_predicate(df, "max_discount_range", check)
    assert rows(accepted) == [(0.0,), (0.9,), (None,)]
    assert len(rows(rejected)) == 2


def test_max_length(spark):
    df = spark.createDataFrame([("x" * 50,), ("é" * 50,), ("x" * 51,)], "s string")
    accepted, rejected = c.check_max_length(df, "s")
    assert accepted.count() == 2
    assert rows(rejected, "reason") == [("s longer than 50",)]


def test_domain(spark):
    df = spark.createDataFrame([("1", "2001-03-04"), ("x", "2001-03-04"), ("1", "never"), (None, None)], "a string, b string")
    accepted, rejected = c.check_domain(df, spark.createDataFrame([], "a int, b date").schema)
    assert rows(accepted) == [(1, DAY), (None, None)]
    assert rows(rejected, "reason") == [("a is no int",), ("b is no date",)]


def test_loads_reject_infinite_prices(spark, tables):
    rows = table(spark, "Product", [(1, "x", float("inf"), "M"), (2, "y", 2.0, "N"), (3, "z", float("nan"), "N")])
    accepted, rejected = check_table(TABLES["Product"], rows, tables)
    assert [x["PID"] for x in accepted.collect()] == [2]
    assert {(x["PID"], x["reason"]) for x in rejected.collect()} == {
        ("1", "retail_price is no double"), ("3", "retail_price is no double")
    }


def test_domain_rejects_nan(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "a double")
    accepted, rejected = c.check_domain(df, df.schema)
    assert (accepted.count(), rejected.count()) == (1, 1)


def test_primary_key_first_wins_against_batch_and_table(spark):
    df = spark.createDataFrame([(1, 2, "late"), (1, 1, "first"), (2, 1, "taken"), (3, 1, "new")], "k int, line long, v string")
    existing = spark.createDataFrame([(2,)], "k int")
    accepted, rejected = c.check_primary_key(df, ["k"], ["line"], existing)
    assert rows(accepted, "k", "v") == [(1, "first"), (3, "new")]
    assert rows(rejected, "k", "v") == [(1, "late"), (2, "taken")]
    assert rows(rejected, "reason") == [("duplicate key (k)",)] * 2


def test_foreign_key(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    accepted, rejected = c.check_foreign_key(child, spark.createDataFrame([(1,)], "k int"), ["k"])
    assert rows(accepted) == [(1, "a")]
    assert rows(rejected, "v") == [("b",), ("c",)]


def test_load_loses_children_of_lost_parents(spark, tables):
    # A bad population costs the city, its stores, their sales and assignments.
    tables["City"] = table(spark, "City", [("C, S", "C", "S", -1, "Small"), ("B, S", "B", "S", 1, "Small")])
    tables["Store"] = table(spark, "Store", [(1, "p", "a", "C, S"), (2, "p", "a", "B, S")])
    tables["Holiday"] = table(spark, "Holiday", [(DAY, "h"), (dt.date(2030, 1, 1), "h")])
    loaded, rejects = load_tables(tables)
    assert rows(loaded["Store"], "StoreNumber") == [(2,)]
    assert rows(loaded["Sold"]) == [(2, 2, DAY, 2)]
    assert rows(loaded["AssignedTo"]) == [("a@x", 2)]
    assert rows(loaded["Holiday"]) == [(DAY, "h")]
    assert rows(rejects["City"], "reason") == [("check population_nonnegative",)]
    assert rows(rejects["Store"], "StoreNumber", "reason") == [("1", "no parent for (CityState)")]
    assert rows(rejects["Sold"], "StoreNumber") == [("1",), ("3",)]
    assert rejects["Product"].count() == 0


def test_city_key_clash_across_cleaning_keys(spark):
    city = table(spark, "City", [("A, B, C", "A, B", "C", 1, "Small"), ("A, B, C", "A", "B, C", 2, "Small")])
    accepted, rejected = check_table(TABLES["City"], city, {})
    assert rows(accepted, "CityName") == [("A",)]  # no line order: the smaller row
    assert rows(rejected, "CityName", "reason") == [("A, B", "duplicate key (CityState)")]


def test_load_of_uncleaned_rows(spark, tables):
    raw = spark.createDataFrame(
        [("1", "1", "2001-03-04", "5", 2), ("1", "1", "2001-03-04", "4", 1), ("1", "1", "2001-03-05", "-1", 3), ("1", "1", "no", "1", 4), ("1", "9", "2001-03-05", "1", 5)],
        "StoreNumber string, PID string, CalendarDate string, quantity string, line int",
    )
    accepted, rejected = check_table(TABLES["Sold"], raw, tables, order=["line"], cleaned=False)
    assert rows(accepted) == [(1, 1, DAY, 4)]
    assert rows(rejected, "reason") == [
        ("CalendarDate is no date",),
        ("check quantity_nonnegative",),
        ("duplicate key (StoreNumber, PID, CalendarDate)",),
        ("no parent for (PID)",),
    ]


def test_delete_cascade_reaches_grandchildren(spark, tables):
    after, refused = c.delete_cascade(tables, "City", spark.createDataFrame([("A, S",)], "CityState string"))
    assert rows(after["City"], "CityName") == [("B",)]
    assert rows(after["Store"], "StoreNumber") == [(2,)]
    assert rows(after["Sold"], "StoreNumber") == [(2,)]
    assert rows(after["AssignedTo"]) == [("a@x", 2)]
    assert after["Manager"].count() == 2
    assert refused.count() == 0


def test_delete_cascade_of_product_and_date(spark, tables):
    after, _ = c.delete_cascade(tables, "Manufacturer", spark.createDataFrame([("M",)], "ManufacturerName string"))
    assert rows(after["Product"], "PID") == rows(after["BelongTo"], "PID") == [(2,)]
    assert after["OnSale"].count() == 0
    assert rows(after["Sold"], "PID") == [(2,), (2,)]
    after, _ = c.delete_cascade(tables, "Cdate", spark.createDataFrame([(DAY,)], "CalendarDate date"))
    assert rows(after["Sold"], "quantity") == [(3,)]
    assert after["Holiday"].count() == after["OnSale"].count() == 0


def test_delete_of_assigned_manager_is_refused(spark, tables):
    both = tables["Manager"].select("Email")
    after, refused = c.delete_cascade(tables, "Manager", both)
    assert rows(after["Manager"], "Email") == [("a@x",)]
    assert rows(refused) == [("a@x", "referred to by AssignedTo")]
    assert after["AssignedTo"].count() == 2


def test_update_key_cascade(spark, tables):
    old_new = spark.createDataFrame(
        [(1, 11), (2, 3), (3, 11), (9, 99)], "old long, new long"
    )  # to a free key, to a taken one, to one asked for before, of an unknown key
    after, refused = c.update_key_cascade(tables, "Store", old_new)
    assert rows(after["Store"], "StoreNumber") == [(11,), (2,), (3,)]
    assert rows(after["Sold"], "StoreNumber") == [(11,), (2,), (3,)]
    assert rows(after["AssignedTo"]) == [("a@x", 11), ("a@x", 2)]
    assert rows(refused) == [(2, 3, "key already exists"), (3, 11, "duplicate key (new)")]


def test_update_key_cascade_follows_restricted_children(spark, tables):
    old_new = spark.createDataFrame([("a@x", "z@x"), ("b@x", "z" * 51)], "old string, new string")
    after, refused = c.update_key_cascade(tables, "Manager", old_new)
    assert rows(after["AssignedTo"]) == [("z@x", 1), ("z@x", 2)]
    assert rows(refused, "old") == [("b@x",)]
