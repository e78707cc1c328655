"""What the physical plans must and must not contain."""

import contextlib
import io
import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = entry.own_queries()


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def scans(text: str, name: str) -> int:
    return len(re.findall(rf"FileScan parquet \S+\.{name}\[", text))


@contextlib.contextmanager
def broadcast_below(spark, size):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", size)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", QUERIES)
def test_no_python_and_no_cross_joins(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for banned in ("EvalPython", "InPandas", "CartesianProduct", "NestedLoopJoin", "ExistingRDD"):
        assert banned not in text


@pytest.mark.parametrize(
    "name",
    [
        "actual_vs_predicted",
        "store_revenue_by_year",
        "groundhog",
        "top_state_per_category",
        "top_state_all_months",
        "top_state_drilldown",
        "revenue_by_population",
        "revenue_by_population_pivot",
    ],
)
def test_sales_are_read_once(spark, name):
    assert scans(plan(QUERIES[name](spark, SF_DIR)), "sold") == 1


def test_bundle_reuses_its_sales_aggregate(spark):
    df = QUERIES["top_state_bundle"](spark, SF_DIR)
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    assert scans(final, "sold") == 1
    assert "ReusedExchange" in final


@pytest.mark.parametrize(
    "name", ["store_revenue_by_year", "store_revenue_by_year_asia", "revenue_by_population", "priced_sales"]
)
def test_pricing_joins_in_place(spark, name):
    """Even without broadcasts, Sold and OnSale meet without a shuffle of either."""
    with broadcast_below(spark, "-1"):
        text = plan(QUERIES[name](spark, SF_DIR))
    join = text[text.index("SortMergeJoin [PID") :]
    join = join[re.search(r"SortMergeJoin \[PID#\d+L, CalendarDate#\d+\]", join).start() :]
    first_scans = join[: join.index(".onsale[")]
    assert ".sold[" in first_scans
    assert "Exchange" not in first_scans


@pytest.mark.parametrize(
    "name",
    [
        "store_revenue_by_year",
        "store_revenue_by_year_asia",
        "top_state_per_category",
        "top_state_all_months",
        "revenue_by_population",
    ],
)
def test_each_small_table_is_broadcast_by_its_own_size(spark, name):
    """Store times City is estimated far above this bound, each alone below it."""
    with broadcast_below(spark, "200KB"):
        text = plan(QUERIES[name](spark, SF_DIR))
    assert "SortMergeJoin" not in text


@pytest.mark.parametrize("name", ["store_revenue_by_year", "revenue_by_population"])
def test_sales_are_shuffled_once_for_the_price_of_their_product(spark, name):
    """Not summed by store, product and year before, which takes a second, wider shuffle."""
    with broadcast_below(spark, "-1"):
        text = plan(QUERIES[name](spark, SF_DIR))
    before_sales = text[: text.index(".sold[")]
    assert not re.search(r"keys=\[StoreNumber#\d+L, PID#", before_sales)
    assert len(re.findall(r"hashpartitioning\(StoreNumber#\d+L, PID#|hashpartitioning\(PID#\d+L,", before_sales)) == 1


def test_category_filter_meets_sums_when_it_cannot_be_broadcast(spark):
    with broadcast_below(spark, "-1"):
        text = plan(QUERIES["groundhog"](spark, SF_DIR))
    after_scan = text[: text.index(".sold[")].rsplit("Exchange", 1)[1]
    assert "HashAggregate(keys=[PID" in after_scan


@pytest.mark.parametrize("name", ["top_state_per_category", "top_state_drilldown"])
def test_month_reaches_the_scan_as_a_range(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    (line,) = [x for x in text.splitlines() if ".sold[" in x]
    assert "CalendarDate#" in line
    assert "1998-08-01" in line and "1998-09-01" in line


def test_duplicates_are_cut_before_the_shuffle(spark):
    sold = plan(QUERIES["clean_sold"](spark, SF_DIR))
    assert "partial_min_by" in sold.split("Exchange")[1]
    store = plan(QUERIES["clean_product"](spark, SF_DIR))
    assert "Partial" in store.split("Exchange")[1]


def test_scans_read_only_what_they_use(spark):
    text = plan(QUERIES["sale_years"](spark, SF_DIR))
    assert "ReadSchema: struct<CalendarDate:date>" in text
