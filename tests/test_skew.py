"""A third of all sales on one product, and a third of those on one store and day."""

import duckdb
import pytest
from compare import TABLES, connect, duck_rows, spark_rows

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"

SKEWED_SALES = f"""
    SELECT * REPLACE (
        CASE WHEN l_orderkey % 3 = 0 THEN 7 ELSE l_partkey END AS l_partkey,
        CASE WHEN l_orderkey % 9 = 0 THEN 4 ELSE l_suppkey END AS l_suppkey,
        CASE WHEN l_orderkey % 9 = 0 THEN TIMESTAMP '1998-08-05' ELSE l_shipdate END
            AS l_shipdate)
    FROM '{SF_DIR}/lineitem.parquet'"""


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb.connect()
    for name in TABLES:
        source = SKEWED_SALES if name == "lineitem" else f"SELECT * FROM '{SF_DIR}/{name}.parquet'"
        con.execute(f"COPY ({source}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("broadcast", ["10MB", "-1"])
@pytest.mark.parametrize(
    "name",
    [
        "clean_sold",
        "clean_onsale",
        "load_sold",
        "reject_fk_sold",
        "priced_sales",
        "actual_vs_predicted",
        "store_revenue_by_year",
        "groundhog",
        "top_state_all_months",
        "top_state_bundle",
        "revenue_by_population_pivot",
        "delete_cascade",
    ],
)
def test_skewed_results(spark, skewed, name, broadcast):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        frame = entry.queries()[name](spark, skewed)
        assert spark_rows(frame) == duck_rows(connect(skewed), entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_hot_duplicates_shrink_before_the_shuffle(spark, skewed):
    """Each map task sends at most one row of the hot key."""
    sales = entry.raw_from_testdata(spark, skewed)["sales"]
    hot = sales.filter("storeid = 4 AND productid = 7 AND date = DATE '1998-08-05'")
    assert hot.count() > 600
    clean = entry.prepare_tables({"sales": sales}, entry.LINE_ORDER)["Sold"]
    assert clean.filter("StoreNumber = 4 AND PID = 7 AND CalendarDate = DATE '1998-08-05'").count() <= 1
