"""The registered queries once more as plain SQL over the test tables.

``CTES`` holds the raw datasets (FIXTURES.md), the cleaned tables and the loaded
ones; ``BODIES`` one statement per registered query. ``oracle_sql`` prefixes each
statement with the CTEs it needs.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------- raw datasets

CTES: dict[str, str] = {
    "raw_stores": """
        SELECT s_suppkey AS storeid, 'P-' || s_suppkey AS phone, s_name AS address,
               n_name AS name, r_name AS state, n_nationkey * 450000 AS population,
               'F' || (s_suppkey % 40) AS managerfirstname,
               'L' || (s_suppkey % 40) AS managerlastname,
               'm' || (s_suppkey % 40) || '@example.com' AS manageremail
        FROM supplier
        JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "raw_products": """
        WITH brands AS (
            SELECT *, CAST(substr(p_brand, 7) AS INT) % 12 AS bn FROM part
        ), priced AS (
            SELECT p_partkey AS productid, p_name AS name, p_retailprice AS retailprice,
                   p_brand AS manufacturer, p_type, p_size,
                   CASE WHEN bn <> 9
                        THEN CAST(bn AS DOUBLE) / CAST(10 AS DOUBLE) END AS maxdiscount
            FROM brands
        )
        SELECT productid, name, retailprice, manufacturer, maxdiscount,
               CASE WHEN p_size <> 49 THEN p_type END AS categoryname
        FROM priced
        UNION ALL
        SELECT productid, name, retailprice, manufacturer, maxdiscount, 'SIZE_' || p_size
        FROM priced WHERE p_size % 5 = 0
        UNION ALL
        SELECT NULL, NULL, NULL, 'Brand#99', CAST(0.2 AS DOUBLE), 'UNUSED'""",
    "raw_sales": """
        SELECT l_suppkey AS storeid, l_partkey AS productid,
               CAST(l_shipdate AS DATE) AS date, CAST(l_quantity AS INT) - 1 AS quantity,
               l_orderkey AS o, l_linenumber AS ln, l_extendedprice AS ep
        FROM lineitem""",
    "raw_saleprices": """
        SELECT l_partkey AS productid, CAST(l_shipdate AS DATE) AS date,
               CASE WHEN l_returnflag = 'R' AND l_linenumber = 1 THEN p_retailprice + 10
                    ELSE CAST(CAST(round(p_retailprice * 10) AS BIGINT)
                              * (10 - CAST(round(l_discount * 100) AS INT)) AS DOUBLE)
                         / CAST(100 AS DOUBLE)
               END AS saleprice,
               l_orderkey AS o, l_linenumber AS ln, l_extendedprice AS ep
        FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_discount > 0""",
    "raw_holidays": """
        SELECT make_date(y, m, d) AS date, holidayname
        FROM (SELECT DISTINCT CAST(year(l_shipdate) AS INT) AS y FROM lineitem
              UNION SELECT 2030) AS years,
             (VALUES (1, 1, 'New Year'), (2, 2, 'Groundhog Day'),
                     (7, 4, 'Independence Day'), (12, 25, 'Christmas Day'))
             AS days(m, d, holidayname)""",
    # ------------------------------------------------------------ cleaned tables
    "clean_city": """
        SELECT name || ', ' || state AS CityState, name AS CityName, state AS State,
               population,
               CASE WHEN population >= 9000000 THEN 'Extra Large'
                    WHEN population >= 6700000 THEN 'Large'
                    WHEN population >= 3700000 THEN 'Medium'
                    ELSE 'Small' END AS city_size
        FROM (SELECT name, state, population FROM raw_stores
              WHERE name IS NOT NULL AND state IS NOT NULL AND population IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY name, state ORDER BY storeid) = 1)
        WHERE population > 0""",
    "clean_store": """
        SELECT storeid AS StoreNumber, phone AS phone_number, address AS street_address,
               name || ', ' || state AS CityState
        FROM raw_stores
        WHERE storeid IS NOT NULL AND phone IS NOT NULL AND address IS NOT NULL
          AND name IS NOT NULL AND state IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY storeid ORDER BY phone) = 1""",
    "clean_manufacturer": """
        SELECT manufacturer AS ManufacturerName,
               CASE WHEN maxdiscount >= 0 AND maxdiscount <= CAST(0.9 AS DOUBLE)
                    THEN maxdiscount ELSE CAST(0.9 AS DOUBLE) END AS max_discount
        FROM raw_products WHERE manufacturer IS NOT NULL
        QUALIFY row_number() OVER (
            PARTITION BY manufacturer ORDER BY productid, categoryname) = 1""",
    "clean_product": """
        SELECT * FROM (
            SELECT productid AS PID, name AS product_name, retailprice AS retail_price,
                   manufacturer AS ManufacturerName
            FROM raw_products
            WHERE productid IS NOT NULL AND name IS NOT NULL AND retailprice IS NOT NULL
              AND manufacturer IS NOT NULL
            QUALIFY row_number() OVER (
                PARTITION BY productid ORDER BY categoryname) = 1)
        WHERE retail_price >= 0""",
    "clean_category": """
        SELECT DISTINCT categoryname AS CategoryName FROM raw_products
        WHERE categoryname IS NOT NULL""",
    "clean_belongto": """
        SELECT DISTINCT productid AS PID, categoryname AS CategoryName FROM raw_products
        WHERE productid IS NOT NULL AND categoryname IS NOT NULL""",
    "clean_cdate": """
        SELECT DISTINCT date AS CalendarDate FROM raw_sales WHERE date IS NOT NULL""",
    "clean_holiday": """
        SELECT DISTINCT date AS CalendarDate, holidayname AS HolidayName FROM raw_holidays
        WHERE date IS NOT NULL AND holidayname IS NOT NULL""",
    "clean_sold": """
        SELECT storeid AS StoreNumber, productid AS PID, date AS CalendarDate, quantity
        FROM (SELECT * FROM raw_sales
              WHERE storeid IS NOT NULL AND productid IS NOT NULL AND date IS NOT NULL
                AND quantity IS NOT NULL
              QUALIFY row_number() OVER (
                  PARTITION BY storeid, productid, date ORDER BY o, ln, ep) = 1)
        WHERE quantity > 0""",
    "clean_onsale": """
        SELECT s.PID, s.CalendarDate, s.SalePrice
        FROM (SELECT productid AS PID, date AS CalendarDate, saleprice AS SalePrice
              FROM raw_saleprices
              WHERE productid IS NOT NULL AND date IS NOT NULL AND saleprice IS NOT NULL
              QUALIFY row_number() OVER (PARTITION BY productid, date ORDER BY o, ln, ep) = 1
             ) AS s
        LEFT JOIN clean_product AS p ON s.PID = p.PID
        LEFT JOIN clean_manufacturer AS m ON p.ManufacturerName = m.ManufacturerName
        WHERE p.PID IS NULL
           OR (s.SalePrice <= p.retail_price
               AND CASE WHEN p.retail_price = 0 THEN s.SalePrice >= 0
                        ELSE (p.retail_price - s.SalePrice) / p.retail_price
                             <= m.max_discount END)""",
    "clean_manager": """
        SELECT manageremail AS Email, managerfirstname || ' ' || managerlastname AS manager_name,
               1 AS EmploymentStatus
        FROM raw_stores
        WHERE manageremail IS NOT NULL AND managerfirstname IS NOT NULL
          AND managerlastname IS NOT NULL
        QUALIFY row_number() OVER (PARTITION BY manageremail ORDER BY storeid) = 1""",
    "clean_assignedto": """
        SELECT DISTINCT manageremail AS Email, storeid AS StoreNumber FROM raw_stores
        WHERE manageremail IS NOT NULL AND storeid IS NOT NULL""",
    # ------------------------------------------------------------- loaded tables
    "loaded_city": """
        SELECT * FROM clean_city
        WHERE population >= 0 AND length(CityState) <= 50 AND length(CityName) <= 50
          AND length(State) <= 50""",
    "loaded_store": """
        SELECT * FROM clean_store
        WHERE CityState IN (SELECT CityState FROM loaded_city)
          AND length(phone_number) <= 50 AND length(street_address) <= 50""",
    "loaded_manufacturer": """
        SELECT * FROM clean_manufacturer
        WHERE max_discount BETWEEN 0 AND CAST(0.9 AS DOUBLE) AND length(ManufacturerName) <= 50""",
    "loaded_product": """
        SELECT * FROM clean_product
        WHERE ManufacturerName IN (SELECT ManufacturerName FROM loaded_manufacturer)
          AND retail_price >= 0 AND length(product_name) <= 50""",
    "loaded_category": """
        SELECT * FROM clean_category WHERE length(CategoryName) <= 50""",
    "loaded_belongto": """
        SELECT * FROM clean_belongto
        WHERE PID IN (SELECT PID FROM loaded_product)
          AND CategoryName IN (SELECT CategoryName FROM loaded_category)""",
    "loaded_cdate": "SELECT * FROM clean_cdate",
    "loaded_holiday": """
        SELECT * FROM clean_holiday
        WHERE CalendarDate IN (SELECT CalendarDate FROM loaded_cdate)
          AND length(HolidayName) <= 50""",
    "loaded_sold": """
        SELECT * FROM clean_sold
        WHERE StoreNumber IN (SELECT StoreNumber FROM loaded_store)
          AND PID IN (SELECT PID FROM loaded_product)
          AND CalendarDate IN (SELECT CalendarDate FROM loaded_cdate)
          AND quantity >= 0""",
    "loaded_onsale": """
        SELECT * FROM clean_onsale
        WHERE PID IN (SELECT PID FROM loaded_product)
          AND CalendarDate IN (SELECT CalendarDate FROM loaded_cdate)""",
    "loaded_manager": """
        SELECT * FROM clean_manager
        WHERE length(Email) <= 50 AND length(manager_name) <= 50
          AND EmploymentStatus IN (0, 1)""",
    "loaded_assignedto": """
        SELECT * FROM clean_assignedto
        WHERE Email IN (SELECT Email FROM loaded_manager)
          AND StoreNumber IN (SELECT StoreNumber FROM loaded_store)""",
    # --------------------------------------------------- shared by several reports
    "joined_prices": """
        SELECT s.*, p.retail_price, o.SalePrice,
               CAST(s.quantity AS DECIMAL(15, 0)) * CAST(CAST(
                   CASE WHEN o.SalePrice IS NULL THEN p.retail_price ELSE o.SalePrice END
                   AS VARCHAR) AS DECIMAL(20, 10)) AS amount
        FROM loaded_sold AS s
        LEFT JOIN loaded_product AS p USING (PID)
        LEFT JOIN loaded_onsale AS o USING (PID, CalendarDate)""",
    "joined_stores": """
        SELECT st.StoreNumber, st.street_address, c.CityState, c.CityName, c.State, c.city_size
        FROM loaded_store AS st LEFT JOIN loaded_city AS c USING (CityState)""",
    "joined_makers": """
        SELECT m.ManufacturerName, p.PID, p.product_name, p.retail_price, b.CategoryName
        FROM loaded_manufacturer AS m
        LEFT JOIN loaded_product AS p USING (ManufacturerName)
        LEFT JOIN loaded_belongto AS b USING (PID)""",
    "joined_units": """
        SELECT year(s.CalendarDate) AS Year, month(s.CalendarDate) AS Month,
               b.CategoryName, l.State, sum(s.quantity) AS Quantity
        FROM loaded_sold AS s
        LEFT JOIN joined_stores AS l USING (StoreNumber)
        LEFT JOIN loaded_belongto AS b USING (PID)
        GROUP BY ALL""",
    "joined_leaders": """
        SELECT u.* FROM joined_units AS u
        JOIN (SELECT Year, Month, CategoryName, max(Quantity) AS best
              FROM joined_units GROUP BY ALL) AS top
          ON u.Year = top.Year AND u.Month = top.Month
         AND u.CategoryName = top.CategoryName AND u.Quantity = top.best""",
    "joined_staff": """
        SELECT DISTINCT year(s.CalendarDate) AS Year, month(s.CalendarDate) AS Month,
               b.CategoryName, l.State, l.StoreNumber, l.street_address, l.CityName,
               m.manager_name, m.Email
        FROM loaded_sold AS s
        JOIN joined_stores AS l USING (StoreNumber)
        JOIN loaded_belongto AS b USING (PID)
        JOIN loaded_assignedto AS a USING (StoreNumber)
        JOIN loaded_manager AS m ON a.Email = m.Email
        WHERE m.EmploymentStatus = 1""",
    "joined_bands": """
        SELECT Year, city_size AS Population_Category,
               CAST(CAST(sum(revenue) AS VARCHAR) AS DOUBLE) / count(*) AS Average_Revenue
        FROM (SELECT year(CalendarDate) AS Year, CityState, city_size, sum(amount) AS revenue
              FROM joined_prices LEFT JOIN joined_stores USING (StoreNumber)
              GROUP BY ALL)
        GROUP BY ALL""",
    # -------------------------------------------------------------- change batches
    "batch_holidays": """
        SELECT o_orderkey AS change_id,
               CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '13/45/%Y')
                    WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m/%d/%Y')
                    ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS CalendarDate,
               CASE WHEN month(o_orderdate) = 7 THEN 'Independence Day'
                    ELSE o_orderpriority END AS HolidayName
        FROM orders""",
    "batch_new_managers": """
        SELECT c_custkey AS change_id,
               CASE WHEN c_custkey % 10 = 0 THEN 'm' || (c_custkey % 60)
                    ELSE 'c' || (c_custkey // 2) END || '@example.com' AS Email,
               c_name AS manager_name, c_custkey % 3 AS EmploymentStatus
        FROM customer""",
    "batch_old_managers": """
        SELECT c_custkey AS change_id,
               CASE WHEN c_custkey % 4 = 0 THEN 'm' || (c_custkey % 60)
                    ELSE 'c' || (c_custkey // 3) END || '@example.com' AS Email
        FROM customer""",
    "batch_assignments": """
        SELECT c_custkey AS change_id, 'm' || (c_custkey % 50) || '@example.com' AS Email,
               c_custkey AS StoreNumber
        FROM customer
        UNION ALL
        SELECT -1 - c_custkey, 'm' || (c_custkey % 50) || '@example.com', c_custkey // 2
        FROM customer""",
    "batch_unassignments": """
        SELECT s_suppkey AS change_id, 'm' || (s_suppkey % 40) || '@example.com' AS Email,
               s_suppkey + s_suppkey % 2 AS StoreNumber
        FROM supplier""",
    "batch_populations": """
        SELECT c_custkey AS change_id, n_name AS CityName,
               CASE WHEN c_custkey % 5 = 0 THEN 'NOWHERE' ELSE r_name END AS State,
               c_custkey * 10007 % 12000000 - 1000000 AS population
        FROM customer
        JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    # The first insert of a key among the changes that break no other rule.
    "judged_holidays": """
        SELECT b.*, d.day,
               CASE WHEN d.day IS NULL THEN 'no such date'
                    WHEN (d.day, b.HolidayName) IN
                         (SELECT (CalendarDate, HolidayName) FROM loaded_holiday)
                    THEN 'duplicate key'
                    WHEN d.day NOT IN (SELECT CalendarDate FROM loaded_cdate)
                    THEN 'no such Cdate' END AS broken
        FROM batch_holidays AS b
        JOIN (SELECT change_id, CAST(try_strptime(CalendarDate, '%m/%d/%Y') AS DATE) AS day
              FROM batch_holidays) AS d USING (change_id)""",
    "settled_holidays": """
        SELECT change_id, day AS CalendarDate, HolidayName,
               coalesce(broken, CASE WHEN row_number() OVER (
                   PARTITION BY broken, day, HolidayName ORDER BY change_id) > 1
                   THEN 'duplicate key' END) AS reason
        FROM judged_holidays""",
    "judged_managers": """
        SELECT *, CASE WHEN EmploymentStatus > 1 THEN 'check employment_status_flag'
                       WHEN Email IN (SELECT Email FROM loaded_manager)
                       THEN 'duplicate key' END AS broken
        FROM batch_new_managers""",
    "settled_managers": """
        SELECT *, coalesce(broken, CASE WHEN row_number() OVER (
                   PARTITION BY broken, Email ORDER BY change_id) > 1
                   THEN 'duplicate key' END) AS reason
        FROM judged_managers""",
    "grown_managers": """
        SELECT * FROM loaded_manager
        UNION ALL
        SELECT Email, manager_name, EmploymentStatus FROM settled_managers
        WHERE reason IS NULL""",
    "judged_assignments": """
        SELECT *, CASE WHEN (Email, StoreNumber) IN
                            (SELECT (Email, StoreNumber) FROM loaded_assignedto)
                       THEN 'duplicate key'
                       WHEN Email NOT IN (SELECT Email FROM loaded_manager)
                       THEN 'no such Manager'
                       WHEN StoreNumber NOT IN (SELECT StoreNumber FROM loaded_store)
                       THEN 'no such Store' END AS broken
        FROM batch_assignments""",
    "settled_assignments": """
        SELECT *, coalesce(broken, CASE WHEN row_number() OVER (
                   PARTITION BY broken, Email, StoreNumber ORDER BY change_id) > 1
                   THEN 'duplicate key' END) AS reason
        FROM judged_assignments""",
    "settled_populations": """
        SELECT b.*, CASE WHEN c.CityName IS NOT NULL AND b.population < 0
                         THEN 'check population_nonnegative' END AS reason
        FROM batch_populations AS b LEFT JOIN loaded_city AS c USING (CityName, State)""",
}

_CTE_NAME = re.compile(
    r"\b(?:raw|clean|loaded|joined|batch|judged|settled|grown)_[a-z_]+\b"
)


def _with(body: str) -> str:
    ordered: list[str] = []

    def visit(sql: str) -> None:
        for name in _CTE_NAME.findall(sql):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                ordered.append(name)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({CTES[name]})" for name in ordered)
    return f"WITH {ctes}\n{body}" if ctes else body


# ------------------------------------------------------------- registered queries

# Table columns in the common types: whole numbers as BIGINT.
_COLUMNS = {
    "city": "CityState, CityName, State, CAST(population AS BIGINT) AS population, city_size",
    "store": "CAST(StoreNumber AS BIGINT) AS StoreNumber, phone_number, street_address, CityState",
    "manufacturer": "ManufacturerName, CAST(max_discount AS DOUBLE) AS max_discount",
    "product": "CAST(PID AS BIGINT) AS PID, product_name, retail_price, ManufacturerName",
    "category": "CategoryName",
    "belongto": "CAST(PID AS BIGINT) AS PID, CategoryName",
    "cdate": "CalendarDate",
    "holiday": "CalendarDate, HolidayName",
    "sold": "CAST(StoreNumber AS BIGINT) AS StoreNumber, CAST(PID AS BIGINT) AS PID,"
    " CalendarDate, CAST(quantity AS BIGINT) AS quantity",
    "onsale": "CAST(PID AS BIGINT) AS PID, CalendarDate, SalePrice",
    "manager": "Email, manager_name, CAST(EmploymentStatus AS BIGINT) AS EmploymentStatus",
    "assignedto": "Email, CAST(StoreNumber AS BIGINT) AS StoreNumber",
}

_RESULTS = "CAST(change_id AS BIGINT) AS change_id, reason IS NULL AS accepted, reason"


def _rejects(table: str, parent: str, key: str) -> str:
    return (
        f"SELECT {_COLUMNS[table]}, 'no parent for ({key})' AS reason FROM clean_{table}"
        f" WHERE {key} NOT IN (SELECT {key} FROM loaded_{parent})"
    )


BODIES: dict[str, str] = {
    **{f"clean_{t}": f"SELECT {cols} FROM clean_{t}" for t, cols in _COLUMNS.items()},
    **{f"load_{t}": f"SELECT {cols} FROM loaded_{t}" for t, cols in _COLUMNS.items()},
    "reject_fk_store": _rejects("store", "city", "CityState"),
    "reject_fk_sold": _rejects("sold", "store", "StoreNumber"),
    "reject_fk_holiday": _rejects("holiday", "cdate", "CalendarDate"),
    "row_counts": """
        SELECT (SELECT count(*) FROM loaded_store) AS store,
               (SELECT count(*) FROM loaded_manufacturer) AS manufacturer,
               (SELECT count(*) FROM loaded_product) AS product,
               (SELECT count(*) FROM loaded_manager) AS manager""",
    "simple_count": "SELECT count(*) AS count FROM loaded_sold",
    "manufacturer_product": """
        SELECT m.ManufacturerName, m.max_discount, count(p.PID) AS TotalProduct,
               CAST(CAST(sum(CAST(CAST(p.retail_price AS VARCHAR) AS DECIMAL(20, 10))) AS VARCHAR) AS DOUBLE)
                   / count(p.retail_price) AS ave_retail_price,
               min(p.retail_price) AS min_retail_price, max(p.retail_price) AS max_retail_price
        FROM loaded_manufacturer AS m LEFT JOIN loaded_product AS p USING (ManufacturerName)
        GROUP BY m.ManufacturerName, m.max_discount
        ORDER BY avg(p.retail_price) DESC NULLS LAST, m.ManufacturerName LIMIT 100""",
    "manufacturer_product_detail": """
        SELECT ManufacturerName, PID, product_name, retail_price,
               string_agg(DISTINCT CategoryName, ',' ORDER BY CategoryName) AS CategoryName
        FROM joined_makers GROUP BY ManufacturerName, PID, product_name, retail_price""",
    "category_report": """
        SELECT c.CategoryName, count(b.PID) AS TotalProduct,
               count(DISTINCT m.ManufacturerName) AS TotalManufacturer,
               CAST(CAST(sum(CAST(CAST(p.retail_price AS VARCHAR) AS DECIMAL(20, 10))) AS VARCHAR) AS DOUBLE)
                   / count(p.retail_price) AS AvePrice
        FROM loaded_category AS c
        LEFT JOIN loaded_belongto AS b USING (CategoryName)
        LEFT JOIN loaded_product AS p ON p.PID = b.PID
        LEFT JOIN loaded_manufacturer AS m ON m.ManufacturerName = p.ManufacturerName
        GROUP BY c.CategoryName""",
    "priced_sales": """
        SELECT StoreNumber, PID, CalendarDate, CAST(quantity AS BIGINT) AS quantity,
               retail_price, coalesce(SalePrice, 0) AS SalePrice,
               CAST(CASE WHEN SalePrice IS NULL THEN quantity ELSE 0 END AS BIGINT)
                   AS RetailQuantity,
               CAST(CASE WHEN SalePrice IS NULL THEN 0 ELSE quantity END AS BIGINT)
                   AS SaleQuantity,
               CAST(CAST(amount AS VARCHAR) AS DOUBLE) AS Revenue
        FROM joined_prices""",
    "actual_vs_predicted": """
        SELECT * FROM (
            SELECT PID, product_name, retail_price,
                   CAST(sum(quantity) AS BIGINT) AS TotalUnitsSold,
                   CAST(coalesce(sum(quantity) FILTER (SalePrice IS NULL), 0) AS BIGINT)
                       AS TotalUnitsSoldNoDiscount,
                   CAST(coalesce(sum(quantity) FILTER (SalePrice IS NOT NULL), 0) AS BIGINT)
                       AS TotalUnitsSoldWithDiscount,
                   CAST(CAST(sum(amount) AS VARCHAR) AS DOUBLE) AS ActualRevenue,
                   CAST(CAST(sum(predicted) AS VARCHAR) AS DOUBLE) AS PredictedRevenue,
                   CAST(CAST(sum(amount - predicted) AS VARCHAR) AS DOUBLE) AS Difference
            FROM (SELECT *, CAST(CAST(retail_price AS VARCHAR) AS DECIMAL(20, 10)) * CAST(quantity AS DECIMAL(10, 0))
                            * CASE WHEN SalePrice IS NULL THEN 1.00 ELSE 0.75 END AS predicted
                  FROM joined_prices)
            JOIN (SELECT PID, product_name FROM loaded_product) USING (PID)
            WHERE PID IN (SELECT PID FROM loaded_belongto WHERE CategoryName = 'ECONOMY')
            GROUP BY PID, product_name, retail_price)
        WHERE abs(Difference) > 5000""",
    "states": "SELECT DISTINCT State FROM loaded_city",
    "store_revenue_by_year": """
        SELECT State, StoreNumber, street_address, CityName, year(CalendarDate) AS Year,
               CAST(CAST(sum(amount) AS VARCHAR) AS DOUBLE) AS TotalRevenue
        FROM joined_prices JOIN joined_stores USING (StoreNumber)
        GROUP BY ALL""",
    "store_revenue_by_year_asia": """
        SELECT StoreNumber, street_address, CityName, year(CalendarDate) AS Year,
               CAST(CAST(sum(amount) AS VARCHAR) AS DOUBLE) AS TotalRevenue
        FROM joined_prices JOIN joined_stores USING (StoreNumber)
        WHERE State = 'ASIA'
        GROUP BY ALL""",
    "groundhog": """
        SELECT Year, CAST(sum(quantity) AS BIGINT) AS ItemsSold_Annually,
               round(CAST(sum(quantity) AS DOUBLE) / CAST(365 AS DOUBLE), 4)
                   AS ItemsSold_DailyOnAverage,
               CAST(sum(quantity) FILTER (day = '02-02') AS BIGINT) AS ItemsSold_OnGroundhog
        FROM (SELECT year(CalendarDate) AS Year, strftime(CalendarDate, '%m-%d') AS day, quantity
              FROM loaded_sold JOIN loaded_belongto USING (PID)
              WHERE CategoryName = 'ECONOMY')
        GROUP BY Year""",
    "year_months": """
        SELECT DISTINCT year(CalendarDate) AS Year, month(CalendarDate) AS Month
        FROM loaded_cdate""",
    "sale_years": "SELECT DISTINCT year(CalendarDate) AS Year FROM loaded_sold",
    "sale_months": "SELECT DISTINCT month(CalendarDate) AS Month FROM loaded_sold",
    "top_state_per_category": """
        SELECT CategoryName, State, CAST(Quantity AS BIGINT) AS Quantity
        FROM joined_leaders WHERE Year = 1998 AND Month = 8""",
    "top_state_all_months": """
        SELECT Year, Month, CategoryName, State, CAST(Quantity AS BIGINT) AS Quantity
        FROM joined_leaders""",
    "top_state_drilldown": """
        SELECT StoreNumber, street_address, CityName, manager_name, Email FROM joined_staff
        WHERE State = 'ASIA' AND CategoryName = 'ECONOMY' AND Year = 1998 AND Month = 8""",
    "top_state_bundle": """
        SELECT w.CategoryName, '1998/08' AS YearMonth, w.State,
               CAST(w.Quantity AS BIGINT) AS Quantity,
               d.StoreNumber, d.street_address, d.CityName, d.manager_name, d.Email
        FROM joined_leaders AS w
        LEFT JOIN joined_staff AS d USING (Year, Month, CategoryName, State)
        WHERE w.Year = 1998 AND w.Month = 8""",
    "revenue_by_population": """
        SELECT Year, Population_Category, Average_Revenue AS Average_Revenue
        FROM joined_bands""",
    "revenue_by_population_pivot": """
        SELECT Year,
               max(Average_Revenue) FILTER (Population_Category = 'Small') AS Small,
               max(Average_Revenue) FILTER (Population_Category = 'Medium') AS Medium,
               max(Average_Revenue) FILTER (Population_Category = 'Large') AS Large,
               max(Average_Revenue) FILTER (Population_Category = 'Extra Large')
                   AS "Extra Large"
        FROM joined_bands WHERE Population_Category IS NOT NULL GROUP BY Year""",
    "holidays": f"SELECT {_COLUMNS['holiday']} FROM loaded_holiday",
    "managers": """
        SELECT m.Email, m.manager_name, CAST(m.EmploymentStatus AS BIGINT) AS EmploymentStatus,
               CAST(a.StoreNumber AS BIGINT) AS StoreNumber
        FROM grown_managers AS m LEFT JOIN loaded_assignedto AS a USING (Email)""",
    "cities": """
        SELECT CityName, State, CAST(population AS BIGINT) AS population, city_size
        FROM loaded_city""",
    "add_holidays": """
        SELECT CalendarDate, HolidayName FROM loaded_holiday
        UNION ALL
        SELECT CalendarDate, HolidayName FROM settled_holidays WHERE reason IS NULL""",
    "add_holidays_results": f"SELECT {_RESULTS} FROM settled_holidays",
    "add_managers": f"SELECT {_COLUMNS['manager']} FROM grown_managers",
    "add_managers_results": f"SELECT {_RESULTS} FROM settled_managers",
    "remove_managers": f"""
        SELECT {_COLUMNS['manager']} FROM grown_managers
        WHERE Email IN (SELECT Email FROM loaded_assignedto)
           OR Email NOT IN (SELECT Email FROM batch_old_managers)""",
    "remove_managers_results": """
        SELECT CAST(change_id AS BIGINT) AS change_id,
               Email NOT IN (SELECT Email FROM loaded_assignedto) AS accepted,
               CASE WHEN Email IN (SELECT Email FROM loaded_assignedto)
                    THEN 'still assigned' END AS reason
        FROM batch_old_managers""",
    "deactivate_managers": """
        SELECT Email, manager_name,
               CAST(CASE WHEN Email IN (SELECT Email FROM batch_old_managers)
                         THEN 0 ELSE EmploymentStatus END AS BIGINT) AS EmploymentStatus
        FROM grown_managers""",
    "activate_managers": """
        SELECT Email, manager_name,
               CAST(CASE WHEN Email IN (SELECT Email FROM batch_old_managers)
                         THEN 1 ELSE EmploymentStatus END AS BIGINT) AS EmploymentStatus
        FROM grown_managers""",
    "assign_managers": """
        SELECT Email, CAST(StoreNumber AS BIGINT) AS StoreNumber FROM loaded_assignedto
        UNION ALL
        SELECT Email, CAST(StoreNumber AS BIGINT) FROM settled_assignments WHERE reason IS NULL""",
    "assign_managers_results": f"SELECT {_RESULTS} FROM settled_assignments",
    "unassign_managers": f"""
        SELECT {_COLUMNS['assignedto']} FROM loaded_assignedto
        WHERE (Email, StoreNumber) NOT IN
              (SELECT (Email, StoreNumber) FROM batch_unassignments)""",
    "update_population": """
        SELECT c.CityState, c.CityName, c.State,
               CAST(coalesce(n.population, c.population) AS BIGINT) AS population,
               CASE WHEN coalesce(n.population, c.population) >= 9000000 THEN 'Extra Large'
                    WHEN coalesce(n.population, c.population) >= 6700000 THEN 'Large'
                    WHEN coalesce(n.population, c.population) >= 3700000 THEN 'Medium'
                    ELSE 'Small' END AS city_size
        FROM loaded_city AS c
        LEFT JOIN (SELECT CityName, State, population FROM settled_populations
                   WHERE reason IS NULL
                   QUALIFY row_number() OVER (
                       PARTITION BY CityName, State ORDER BY change_id DESC) = 1) AS n
          USING (CityName, State)""",
    "update_population_results": f"SELECT {_RESULTS} FROM settled_populations",
    "delete_cascade": f"""
        SELECT {_COLUMNS['sold']} FROM loaded_sold
        WHERE StoreNumber NOT IN (
            SELECT StoreNumber FROM joined_stores WHERE CityName LIKE '%3')""",
    "delete_cascade_counts": """
        SELECT 'City' AS name, count(*) AS count FROM loaded_city WHERE CityName NOT LIKE '%3'
        UNION ALL
        SELECT 'Store', count(*) FROM joined_stores WHERE CityName NOT LIKE '%3'
        UNION ALL
        SELECT 'AssignedTo', count(*) FROM loaded_assignedto
        JOIN joined_stores USING (StoreNumber) WHERE CityName NOT LIKE '%3'
        UNION ALL
        SELECT 'Manager', count(*) FROM loaded_manager""",
    "delete_cascade_refused": """
        SELECT Email, 'referred to by AssignedTo' AS reason FROM loaded_manager
        WHERE Email IN (SELECT Email FROM loaded_assignedto)""",
    "update_key_cascade": """
        SELECT PID, product_name, retail_price,
               CASE WHEN ManufacturerName LIKE 'Brand#1%'
                    THEN replace(ManufacturerName, 'Brand', 'Maker')
                    ELSE ManufacturerName END AS ManufacturerName
        FROM loaded_product""",
    "update_key_cascade_refused": """
        SELECT ManufacturerName AS old, 'Brand#99' AS new,
               CASE WHEN ManufacturerName <> 'Brand#99' THEN 'key already exists' END AS reason
        FROM loaded_manufacturer
        WHERE ManufacturerName NOT LIKE 'Brand#1%' AND ManufacturerName <> 'Brand#99'""",
    "update_key_cascade_sold": """
        SELECT StoreNumber + 1000000 AS StoreNumber, PID, CalendarDate,
               CAST(quantity AS BIGINT) AS quantity
        FROM loaded_sold""",
}
_PRODUCTS = "CAST(productid AS BIGINT) AS productid, name, retailprice, manufacturer, maxdiscount, categoryname"

BODIES |= {
    "load_rejects": """
        SELECT 'Store' AS name, 'no parent for (CityState)' AS reason, count(*) AS count
        FROM clean_store WHERE CityState NOT IN (SELECT CityState FROM loaded_city)
        HAVING count(*) > 0
        UNION ALL
        SELECT 'Holiday', 'no parent for (CalendarDate)', count(*)
        FROM clean_holiday WHERE CalendarDate NOT IN (SELECT CalendarDate FROM loaded_cdate)
        HAVING count(*) > 0
        UNION ALL
        SELECT 'Sold', 'no parent for (StoreNumber)', count(*)
        FROM clean_sold WHERE StoreNumber NOT IN (SELECT StoreNumber FROM loaded_store)
        HAVING count(*) > 0
        UNION ALL
        SELECT 'AssignedTo', 'no parent for (StoreNumber)', count(*)
        FROM clean_assignedto WHERE StoreNumber NOT IN (SELECT StoreNumber FROM loaded_store)
        HAVING count(*) > 0
        UNION ALL
        SELECT 'Product', 'no parent for (ManufacturerName)', count(*)
        FROM clean_product
        WHERE ManufacturerName NOT IN (SELECT ManufacturerName FROM loaded_manufacturer)
        HAVING count(*) > 0
        UNION ALL
        SELECT 'BelongTo', 'no parent for (PID)', count(*)
        FROM clean_belongto WHERE PID NOT IN (SELECT PID FROM loaded_product)
        HAVING count(*) > 0
        UNION ALL
        SELECT 'OnSale', 'no parent for (PID)', count(*)
        FROM clean_onsale WHERE PID NOT IN (SELECT PID FROM loaded_product)
        HAVING count(*) > 0""",
    "drop_nulls": f"""
        SELECT {_PRODUCTS} FROM raw_products
        WHERE productid IS NOT NULL AND maxdiscount IS NOT NULL AND categoryname IS NOT NULL""",
    "keep_first": """
        SELECT productid, date, storeid, CAST(quantity AS BIGINT) AS quantity FROM raw_sales
        QUALIFY row_number() OVER (PARTITION BY productid, date ORDER BY o, ln, ep) = 1""",
    "city_state_and_full_name": """
        SELECT storeid, name, state, managerfirstname, managerlastname,
               name || ', ' || state AS CityState,
               managerfirstname || ' ' || managerlastname AS manager_name
        FROM raw_stores""",
    "population_band": """
        SELECT storeid, CASE WHEN population >= 9000000 THEN 'Extra Large'
                             WHEN population >= 6700000 THEN 'Large'
                             WHEN population >= 3700000 THEN 'Medium'
                             ELSE 'Small' END AS city_size
        FROM raw_stores""",
    "repair_discount": """
        SELECT CAST(productid AS BIGINT) AS productid, categoryname,
               CASE WHEN maxdiscount > CAST(0.9 AS DOUBLE) OR maxdiscount IS NULL
                    THEN CAST(0.9 AS DOUBLE) ELSE maxdiscount END AS max_discount
        FROM raw_products""",
    "keep_range": f"SELECT {_PRODUCTS} FROM raw_products WHERE retailprice >= 950",
    "with_constant": """
        SELECT manageremail AS Email, storeid AS StoreNumber,
               CAST(1 AS BIGINT) AS EmploymentStatus
        FROM raw_stores""",
    "valid_sale_price": """
        SELECT s.productid AS PID, s.date AS CalendarDate, s.saleprice AS SalePrice
        FROM raw_saleprices AS s
        JOIN clean_product AS p ON s.productid = p.PID
        JOIN clean_manufacturer AS m USING (ManufacturerName)
        WHERE s.saleprice <= p.retail_price
          AND (p.retail_price - s.saleprice) / p.retail_price <= m.max_discount""",
    "coerce_types": """
        SELECT l_orderkey, CAST(trunc(l_quantity / -3) AS BIGINT) AS l_quantity,
               CAST(l_shipdate AS DATE) AS l_shipdate, CAST(NULL AS BIGINT) AS l_returnflag
        FROM lineitem""",
    "check_not_null": f"""
        SELECT {_PRODUCTS}, CASE WHEN maxdiscount IS NULL THEN 'null in maxdiscount'
                                 ELSE 'null in categoryname' END AS reason
        FROM raw_products WHERE maxdiscount IS NULL OR categoryname IS NULL""",
    "check_primary_key": """
        SELECT storeid, productid, date, CAST(quantity AS BIGINT) AS quantity,
               'duplicate key (storeid, productid, date)' AS reason
        FROM raw_sales
        QUALIFY row_number() OVER (
            PARTITION BY storeid, productid, date ORDER BY o, ln, ep) > 1""",
    "check_predicate": f"""
        SELECT {_PRODUCTS}, 'check range' AS reason
        FROM raw_products WHERE maxdiscount > CAST(0.9 AS DOUBLE)""",
    "check_max_length": f"""
        SELECT {_PRODUCTS}, 'name longer than 10' AS reason
        FROM raw_products WHERE length(name) > 10""",
    "check_domain": """
        SELECT o_orderkey AS id, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS code
        FROM orders WHERE o_orderkey % 2 = 0""",
    "check_domain_rejects": """
        SELECT o_orderkey AS id, substr(o_orderpriority, 1, 2) AS code,
               'code is no int' AS reason
        FROM orders WHERE o_orderkey % 2 = 1""",
    "activate_managers_results": """
        SELECT CAST(change_id AS BIGINT) AS change_id, true AS accepted,
               CAST(NULL AS VARCHAR) AS reason
        FROM batch_old_managers""",
    "unassign_managers_results": """
        SELECT CAST(change_id AS BIGINT) AS change_id, true AS accepted,
               CAST(NULL AS VARCHAR) AS reason
        FROM batch_unassignments""",
}
BODIES["manufacturer_product_top"] = BODIES["manufacturer_product"].replace("LIMIT 100", "LIMIT 10")
BODIES["manufacturer_product_detail_named"] = f"""
        SELECT * FROM ({BODIES["manufacturer_product_detail"]}) AS every
        WHERE ManufacturerName = 'Brand#11'"""
BODIES["deactivate_managers_results"] = BODIES["activate_managers_results"]
BODIES["read_raw"] = BODIES["clean_sold"]
BODIES["view_states"] = BODIES["states"]
BODIES["view_groundhog"] = BODIES["groundhog"]
BODIES["view_revenue_by_population"] = BODIES["revenue_by_population"]
BODIES["write_clean"] = BODIES["clean_product"]
BODIES["replace_table"] = BODIES["update_population"]
BODIES["stored_edit_city"] = BODIES["update_population"]
BODIES["stored_edit_holiday"] = BODIES["add_holidays"]
BODIES["stored_edit_holiday_results"] = BODIES["add_holidays_results"]
BODIES["stored_edit_manager"] = BODIES["remove_managers"]
BODIES["stored_edit_manager_results"] = BODIES["remove_managers_results"]
BODIES["stored_edit_assignedto"] = f"""
        SELECT * FROM ({BODIES["assign_managers"]}) AS assigned
        WHERE (Email, StoreNumber) NOT IN
              (SELECT (Email, StoreNumber) FROM batch_unassignments)"""

BODIES |= {f"write_clean_{t}": f"SELECT {cols} FROM clean_{t}" for t, cols in _COLUMNS.items()}
BODIES["stored_rejects"] = BODIES["load_rejects"]
for _name in ("store_revenue_by_year", "store_revenue_by_year_asia", "revenue_by_population"):
    BODIES[f"daily_{_name}"] = BODIES[_name]

_FORMATS = "(VALUES ('csv'), ('parquet')) AS formats(format)"
_FIRST_SALES = """
    SELECT storeid AS StoreNumber, productid AS PID, date AS CalendarDate, quantity
    FROM (SELECT * FROM raw_sales WHERE {part}
          QUALIFY row_number() OVER (PARTITION BY storeid, productid, date ORDER BY o, ln, ep) = 1)
    WHERE quantity > 0"""
CTES |= {
    "batch_sold_one": _FIRST_SALES.format(part="o % 3 <> 0"),
    "batch_sold_two": _FIRST_SALES.format(part="o % 3 = 0 OR o % 5 = 0"),
    "judged_sold": """
        SELECT b.*, CASE WHEN b.batch = 2 AND (b.StoreNumber, b.PID, b.CalendarDate) IN (
                             SELECT (StoreNumber, PID, CalendarDate) FROM batch_sold_one
                             WHERE StoreNumber IN (SELECT StoreNumber FROM loaded_store))
                         THEN 'duplicate key (StoreNumber, PID, CalendarDate)'
                         WHEN b.StoreNumber NOT IN (SELECT StoreNumber FROM loaded_store)
                         THEN 'no parent for (StoreNumber)' END AS reason
        FROM (SELECT *, 1 AS batch FROM batch_sold_one
              UNION ALL SELECT *, 2 FROM batch_sold_two) AS b""",
    "raw_dirty_store": """
        SELECT *, try_cast(StoreNumber AS BIGINT) AS n,
               CASE WHEN StoreNumber IS NOT NULL AND try_cast(StoreNumber AS BIGINT) IS NULL
                    THEN 'StoreNumber is no bigint'
                    WHEN StoreNumber IS NULL THEN 'null in StoreNumber'
                    WHEN phone_number IS NULL THEN 'null in phone_number'
                    WHEN length(street_address) > 50 THEN 'street_address longer than 50' END AS broken
        FROM (SELECT CASE WHEN c_custkey % 17 = 3 THEN 'S' || c_custkey
                          WHEN c_custkey % 17 <> 4 THEN CAST(c_custkey - c_custkey % 2 AS VARCHAR) END AS StoreNumber,
                     CASE WHEN c_custkey % 19 <> 5 THEN lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS phone_number,
                     CASE WHEN c_custkey % 23 = 6 THEN repeat('x', 51) ELSE c_name END AS street_address,
                     CASE WHEN c_custkey % 29 = 7 THEN 'Nowhere, X' ELSE n_name || ', ' || r_name END AS CityState
              FROM customer JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey)""",
    "judged_dirty_store": """
        SELECT *, coalesce(broken,
                           CASE WHEN row_number() OVER (PARTITION BY n, broken ORDER BY phone_number) > 1
                                THEN 'duplicate key (StoreNumber)'
                                WHEN CityState NOT IN (SELECT CityState FROM loaded_city)
                                THEN 'no parent for (CityState)' END) AS reason
        FROM raw_dirty_store""",
    "raw_dirty_product": """
        SELECT *, CASE WHEN isnan(retail_price) OR isinf(retail_price) THEN 'retail_price is no double'
                       WHEN retail_price IS NULL THEN 'null in retail_price'
                       WHEN ManufacturerName IS NULL THEN 'null in ManufacturerName'
                       WHEN retail_price < 0 THEN 'check retail_price_nonnegative' END AS broken
        FROM (SELECT p_partkey - p_partkey % 3 AS PID, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS product_name,
                     CASE p_partkey % 13 WHEN 0 THEN NULL WHEN 1 THEN -p_retailprice
                          WHEN 2 THEN CAST('inf' AS DOUBLE) WHEN 3 THEN CAST('nan' AS DOUBLE)
                          ELSE p_retailprice END AS retail_price,
                     CASE p_partkey % 11 WHEN 4 THEN 'Nobody' WHEN 5 THEN NULL ELSE p_brand END AS ManufacturerName
              FROM part)""",
    "judged_dirty_product": """
        SELECT *, coalesce(broken,
                           CASE WHEN row_number() OVER (PARTITION BY PID, broken ORDER BY product_name) > 1
                                THEN 'duplicate key (PID)'
                                WHEN ManufacturerName NOT IN (SELECT ManufacturerName FROM loaded_manufacturer)
                                THEN 'no parent for (ManufacturerName)' END) AS reason
        FROM raw_dirty_product""",
}
BODIES |= {
    "read_raw_stores": f"""
        SELECT CAST(storeid AS BIGINT) AS row_id, CAST(storeid AS BIGINT) AS storeid, phone, address, name, state,
               CAST(population AS BIGINT) AS population, managerfirstname, managerlastname, manageremail, format
        FROM raw_stores, {_FORMATS}""",
    "read_raw_products": f"SELECT CAST(productid AS BIGINT) AS row_id, {_PRODUCTS}, format FROM raw_products, {_FORMATS}",
    "read_raw_sales": f"""
        SELECT CAST(o * 10 + ln AS BIGINT) AS row_id, CAST(storeid AS BIGINT) AS storeid,
               CAST(productid AS BIGINT) AS productid, date, CAST(quantity AS BIGINT) AS quantity, format
        FROM raw_sales, {_FORMATS}""",
    "read_raw_saleprices": f"""
        SELECT CAST(o * 10 + ln AS BIGINT) AS row_id, CAST(productid AS BIGINT) AS productid, date, saleprice, format
        FROM raw_saleprices, {_FORMATS}""",
    "read_raw_holidays": f"""
        SELECT CAST(date - DATE '1970-01-01' AS BIGINT) AS row_id, date, holidayname, format
        FROM raw_holidays, {_FORMATS}""",
    "read_raw_rejects": """
        WITH faults AS (
            SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS row_id, l_orderkey % 40 = 1 AS short,
                   unnest([
                       CASE WHEN l_orderkey % 30 = 2
                            THEN {'field': 'storeid', 'value': 'S' || l_suppkey, 'reason': 'storeid is no bigint'} END,
                       CASE WHEN l_orderkey % 35 = 3
                            THEN {'field': 'date', 'value': strftime(l_shipdate, '%d.%m.%Y'), 'reason': 'date is no date'} END,
                       CASE WHEN l_orderkey % 45 = 4
                            THEN {'field': 'quantity', 'value': 'many', 'reason': 'quantity is no int'} END]) AS f
            FROM lineitem)
        SELECT 'sales' AS dataset, row_id, f.field AS field, f.value AS value, f.reason AS reason
        FROM faults WHERE NOT short AND f IS NOT NULL
        UNION ALL
        SELECT 'sales', NULL, NULL, '{"row_id":' || (l_orderkey * 10 + l_linenumber) || ',"storeid"', 'malformed record'
        FROM lineitem WHERE l_orderkey % 40 = 1""",
    "append_sold": f"SELECT {_COLUMNS['sold']} FROM judged_sold WHERE reason IS NULL",
    "append_daily_revenue": """
        SELECT l.State, s.StoreNumber, l.street_address, l.CityName, year(s.CalendarDate) AS Year,
               CAST(CAST(sum(CAST(s.quantity AS DECIMAL(15, 0)) * CAST(CAST(coalesce(o.SalePrice, p.retail_price)
                   AS VARCHAR) AS DECIMAL(20, 10))) AS VARCHAR) AS DOUBLE) AS TotalRevenue
        FROM judged_sold AS s
        JOIN joined_stores AS l USING (StoreNumber)
        LEFT JOIN loaded_product AS p USING (PID)
        LEFT JOIN (SELECT * FROM loaded_onsale  -- loaded when only the first batch's days were known
                   WHERE CalendarDate IN (SELECT date FROM raw_sales WHERE o % 3 <> 0)) AS o
            USING (PID, CalendarDate)
        WHERE s.reason IS NULL
        GROUP BY ALL""",
    "append_rejects": """
        SELECT CAST(StoreNumber AS VARCHAR) AS StoreNumber, reason, count(*) AS count
        FROM judged_sold WHERE reason IS NOT NULL GROUP BY ALL""",
    "load_dirty_store": """
        SELECT n AS StoreNumber, phone_number, street_address, CityState FROM judged_dirty_store WHERE reason IS NULL""",
    "load_dirty_store_rejects": """
        SELECT reason, count(*) AS count FROM judged_dirty_store WHERE reason IS NOT NULL GROUP BY reason""",
    "load_dirty_product": f"SELECT {_COLUMNS['product']} FROM judged_dirty_product WHERE reason IS NULL",
    "load_dirty_product_rejects": """
        SELECT reason, count(*) AS count FROM judged_dirty_product WHERE reason IS NOT NULL GROUP BY reason""",
    "delete_cascade_city": f"SELECT {_COLUMNS['city']} FROM loaded_city WHERE CityName NOT LIKE '%3'",
    "delete_cascade_store": f"""
        SELECT {_COLUMNS['store']} FROM loaded_store
        WHERE CityState NOT IN (SELECT CityState FROM loaded_city WHERE CityName LIKE '%3')""",
    "delete_cascade_assignedto": f"""
        SELECT {_COLUMNS['assignedto']} FROM loaded_assignedto
        WHERE StoreNumber NOT IN (SELECT StoreNumber FROM joined_stores WHERE CityName LIKE '%3')""",
    "update_key_cascade_manufacturer": """
        SELECT CASE WHEN ManufacturerName LIKE 'Brand#1%'
                    THEN replace(ManufacturerName, 'Brand', 'Maker') ELSE ManufacturerName END AS ManufacturerName,
               CAST(max_discount AS DOUBLE) AS max_discount
        FROM loaded_manufacturer""",
    "stored_cascade": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS count FROM loaded_{name.lower()} WHERE {left}"
        for name, left in {
            **dict.fromkeys(("City", "Store", "Category", "Cdate", "Holiday", "Manager", "AssignedTo"), "TRUE"),
            "Manufacturer": "ManufacturerName NOT LIKE 'Brand#1%'",
            "Product": "ManufacturerName NOT LIKE 'Brand#1%'",
            **dict.fromkeys(
                ("BelongTo", "Sold", "OnSale"),
                "PID NOT IN (SELECT PID FROM loaded_product WHERE ManufacturerName LIKE 'Brand#1%')",
            ),
        }.items()
    ),
}


def oracle_sql() -> dict[str, str]:
    return {name: _with(body) for name, body in BODIES.items()}
