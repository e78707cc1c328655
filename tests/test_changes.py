import datetime as dt

import pytest

from retailmart.operators import changes as e
from retailmart.schema import TABLES

DAY = dt.date(1998, 7, 4)


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=repr)


def reasons(results):
    accepted = {r["change_id"]: r["accepted"] for r in results.collect()}
    found = {r["change_id"]: r["reason"] for r in results.collect()}
    assert all(accepted[i] == (found[i] is None) for i in found)
    return found


def table(spark, name, data):
    return spark.createDataFrame(data, TABLES[name].schema)


@pytest.fixture
def managers(spark):
    return table(spark, "Manager", [("a@x", "A", 1), ("b@x", "B", 0)])


@pytest.fixture
def assigned(spark):
    return table(spark, "AssignedTo", [("a@x", 1)])


def test_add_holidays(spark):
    cdate = table(spark, "Cdate", [(DAY,), (dt.date(1999, 1, 2),)])
    holiday = table(spark, "Holiday", [(DAY, "Independence Day")])
    batch = spark.createDataFrame(
        [
            (1, "7/4/1998", "Independence Day"),
            (2, "07/04/1998", "Fourth"),
            (3, "01/02/1999", "Day after"),
            (4, "2/3/2030", "Future"),
            (5, "13/45/1999", "Never"),
            (6, "7/4/1998", "Fourth"),
            (7, "1/2/1999", "x" * 51),
            (8, "1/2/1999", None),
        ],
        "change_id long, CalendarDate string, HolidayName string",
    )
    after, results = e.add_holidays(holiday, cdate, batch)
    assert rows(after, "HolidayName") == [("Day after",), ("Fourth",), ("Independence Day",)]
    assert reasons(results) == {
        1: "duplicate key",
        2: None,
        3: None,
        4: "no such Cdate",
        5: "no such date",
        6: "duplicate key",
        7: "HolidayName longer than 50",
        8: "null in HolidayName",
    }


def test_add_holidays_takes_dates(spark):
    cdate = table(spark, "Cdate", [(DAY,)])
    batch = spark.createDataFrame([(1, DAY, "h")], "change_id long, CalendarDate date, HolidayName string")
    after, _ = e.add_holidays(table(spark, "Holiday", []), cdate, batch)
    assert rows(after) == [(DAY, "h")]


def test_add_holidays_takes_date_parts(spark):
    cdate = table(spark, "Cdate", [(DAY,)])
    batch = spark.createDataFrame(
        [(1, 1998, 7, 4, "h"), (2, 1998, 2, 30, "never")],
        "change_id long, year int, month int, day int, HolidayName string",
    )
    after, results = e.add_holidays(table(spark, "Holiday", []), cdate, batch)
    assert rows(after) == [(DAY, "h")]
    assert reasons(results) == {1: None, 2: "no such date"}


def test_add_managers(spark, managers):
    batch = spark.createDataFrame(
        [(3, "c@x", "late", 1), (1, "c@x", "bad", 2), (2, "c@x", "first", 0), (4, "a@x", "again", 1)],
        "change_id long, Email string, manager_name string, EmploymentStatus int",
    )
    after, results = e.add_managers(managers, batch)
    assert rows(after) == [("a@x", "A", 1), ("b@x", "B", 0), ("c@x", "first", 0)]
    assert reasons(results) == {
        1: "check employment_status_flag",
        2: None,
        3: "duplicate key",
        4: "duplicate key",
    }


def test_remove_managers(spark, managers, assigned):
    batch = spark.createDataFrame([(1, "a@x"), (2, "b@x"), (3, "no@x")], "change_id long, Email string")
    after, results = e.remove_managers(managers, assigned, batch)
    assert rows(after, "Email") == [("a@x",)]
    assert reasons(results) == {1: "still assigned", 2: None, 3: None}


def test_remove_manager_assigned_to_many_stores_reports_once(spark, managers):
    many = table(spark, "AssignedTo", [("a@x", n) for n in range(5)])
    batch = spark.createDataFrame([(1, "a@x")], "change_id long, Email string")
    _, results = e.remove_managers(managers, many, batch)
    assert results.count() == 1


def test_activate_and_deactivate(spark, managers):
    batch = spark.createDataFrame([(1, "b@x"), (2, "no@x"), (3, "b@x")], "change_id long, Email string")
    after, results = e.activate_managers(managers, batch)
    assert rows(after) == [("a@x", "A", 1), ("b@x", "B", 1)]
    assert set(reasons(results).values()) == {None}
    after, _ = e.deactivate_managers(after, batch)
    assert rows(after) == [("a@x", "A", 1), ("b@x", "B", 0)]


def test_assign_and_unassign(spark, managers, assigned):
    store = table(spark, "Store", [(1, "p", "a", "c"), (2, "p", "a", "c")])
    batch = spark.createDataFrame(
        [(1, "a@x", 2), (2, "a@x", 1), (3, "b@x", 1), (4, "a@x", 999999), (5, "no@x", 1)],
        "change_id long, Email string, StoreNumber long",
    )
    after, results = e.assign_managers(assigned, managers, store, batch)
    assert rows(after) == [("a@x", 1), ("a@x", 2), ("b@x", 1)]
    assert reasons(results) == {
        1: None,
        2: "duplicate key",
        3: None,
        4: "no such Store",
        5: "no such Manager",
    }
    gone = spark.createDataFrame([(1, "a@x", 1), (2, "b@x", 2)], "change_id long, Email string, StoreNumber long")
    after, results = e.unassign_managers(after, gone)
    assert rows(after) == [("a@x", 2), ("b@x", 1)]
    assert set(reasons(results).values()) == {None}


def test_update_population(spark):
    city = table(spark, "City", [("A, S", "A", "S", 5, "Small"), ("B, S", "B", "S", 5, "Small")])
    batch = spark.createDataFrame(
        [
            (1, "A", "S", "9000000"),
            (3, "A", "S", "3700000"),
            (2, "A", "S", "1"),
            (4, "A", "S", "-1"),
            (5, "B", "S", "many"),
            (6, "Z", "S", "1"),
            (7, "Z", "S", "-1"),
            (8, "B", "S", "0"),
        ],
        "change_id long, CityName string, State string, population string",
    )
    after, results = e.update_population(city, batch)
    assert rows(after, "CityName", "population", "city_size") == [
        ("A", 3_700_000, "Medium"),
        ("B", 0, "Small"),
    ]
    assert reasons(results) == {
        1: None,
        2: None,
        3: None,
        4: "check population_nonnegative",
        5: "population is no int",
        6: None,
        7: None,
        8: None,
    }


def test_one_key_filling_a_batch(spark, managers):
    """A hot key: the lowest change_id still wins and every change is answered."""
    batch = spark.range(1, 20_001).selectExpr(
        "id AS change_id",
        "CASE WHEN id % 3 = 0 THEN 'hot@x' ELSE concat('u', id, '@x') END AS Email",
        "concat('n', id) AS manager_name",
        "1 AS EmploymentStatus",
    )
    after, results = e.add_managers(managers, batch)
    assert rows(after.filter("Email = 'hot@x'"), "manager_name") == [("n3",)]
    assert results.count() == 20_000
    assert results.filter("NOT accepted").count() == 20_000 // 3 - 1
