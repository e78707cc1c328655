"""Row counts worked out for the fixtures before anything was built (FIXTURES.md)."""

import pytest

import __spark_entry__ as entry
from retailmart.plans.build import prepare_tables
from retailmart.plans.load import load_tables
from retailmart.sources.testdata import LINE_ORDER, raw_from_testdata

SF_DIR = "/root/testdata/sf0.01"

RAW = {"stores": 100, "products": 2403, "sales": 60000, "saleprices": 57059, "holidays": 32}
CLEAN = {
    "City": 24,
    "Store": 100,
    "Manufacturer": 26,
    "Product": 2000,
    "Category": 17,
    "BelongTo": 2367,
    "Cdate": 2499,
    "Holiday": 32,
    "Sold": 58846,
    "OnSale": 28196,
    "Manager": 40,
    "AssignedTo": 100,
}
LOADED = {**CLEAN, "Store": 98, "Holiday": 26, "Sold": 57697, "AssignedTo": 98}
REPORTS = {
    "manufacturer_product": 26,
    "category_report": 17,
    "actual_vs_predicted": 246,
    "store_revenue_by_year_asia": 140,
    "groundhog": 7,
    "top_state_per_category": 16,
    "top_state_drilldown": 13,
    "revenue_by_population": 28,
}


@pytest.fixture(scope="module")
def raw(spark):
    return raw_from_testdata(spark, SF_DIR)


@pytest.mark.parametrize("name", RAW)
def test_raw(raw, name):
    assert raw[name].count() == RAW[name]


@pytest.mark.parametrize("name", CLEAN)
def test_clean_and_stored(spark, raw, name):
    assert prepare_tables(raw, LINE_ORDER)[name].count() == CLEAN[name]
    assert entry.warehouse(spark, SF_DIR)[name].count() == LOADED[name]


@pytest.mark.parametrize("name", ["Store", "Holiday", "AssignedTo"])
def test_accepted_and_rejected_add_up(raw, name):
    clean = prepare_tables(raw, LINE_ORDER)
    _, rejects = load_tables(clean)
    assert rejects[name].count() == CLEAN[name] - LOADED[name]


@pytest.mark.parametrize("name", REPORTS)
def test_reports(spark, name):
    assert entry.queries()[name](spark, SF_DIR).count() == REPORTS[name]
