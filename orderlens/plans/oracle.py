"""The same queries in SQL, written independently, to compare results with."""

from __future__ import annotations

SERIES = '"CustomerID", "FacilityID", "ProductID"'
GRAINS = {
    "fine": ("o_custkey", "s_nationkey", "l_partkey", "p_name", "p_brand"),
    "brand": ("c_mktsegment", "n_regionkey", "p_brand", "p_brand", "p_brand"),
    "type": ("c_mktsegment", "n_regionkey", "p_type", "p_type", "p_type"),
}


def lines(grain: str = "brand", name: str = "lines") -> str:
    customer, facility, product, label, category = GRAINS[grain]
    return f"""{name} AS (
      SELECT l_orderkey AS "OrderID", o_orderdate AS "CreateDate", CAST(o_orderdate AS DATE) AS "Date",
             {customer} AS "CustomerID", {facility} AS "FacilityID", {product} AS "ProductID",
             {label} AS "ProductName", {category} AS "CategoryName", l_suppkey AS "VendorID",
             s_name AS "VendorName", l_quantity AS "OrderUnits", l_extendedprice / l_quantity AS "Price"
      FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
        LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey)"""


def damaged(source: str = "lines", name: str = "damaged") -> str:
    return f"""{name} AS (
      SELECT * REPLACE (
        CASE WHEN "OrderID" % 200 = 0 THEN -1.0::DOUBLE ELSE "OrderUnits" END AS "OrderUnits",
        CASE WHEN "OrderID" % 100 = 0 THEN NULL ELSE "ProductName" END AS "ProductName",
        CASE WHEN "OrderID" % 333 = 0 THEN -5.0::DOUBLE ELSE "Price" END AS "Price",
        CASE WHEN "OrderID" % 400 = 0 THEN NULL ELSE "CustomerID" END AS "CustomerID",
        CASE WHEN "OrderID" % 7 = 0 THEN NULL ELSE "FacilityID" END AS "FacilityID")
      FROM {source})"""


DAILY = f"""daily AS (
      SELECT {SERIES}, "Date", SUM("OrderUnits") AS "Quantity" FROM lines GROUP BY ALL)"""

PRODUCTS = """products AS (
      SELECT "ProductID", "ProductName", "CategoryName", "VendorName" FROM (
        SELECT *, row_number() OVER (PARTITION BY "ProductID"
          ORDER BY "ProductName", "CategoryName", "VendorName") AS rn FROM lines) WHERE rn = 1)"""

LONG = """long AS (
      SELECT d."CustomerID" || '_' || d."FacilityID" || '_' || d."ProductID" AS item_id,
             d."Date" AS ts, d."Quantity" AS y, d."CustomerID" AS customer_id,
             d."FacilityID" AS facility_id, d."ProductID" AS product_id,
             p."ProductName" AS product_name, p."CategoryName" AS category_name,
             p."VendorName" AS vendor_name, CAST(isodow(d."Date") - 1 AS INTEGER) AS dow
      FROM daily d LEFT JOIN products p USING ("ProductID"))"""

LOOKUP = f"""relations AS (
      SELECT {SERIES}, count("OrderUnits") AS "OrderCount", min("CreateDate") AS "FirstOrderDate",
             max("CreateDate") AS "LastOrderDate" FROM lines GROUP BY ALL),
    lookup AS (
      SELECT r."ProductID", p."ProductName", p."CategoryName", p."VendorName" AS "vendorName",
             r."CustomerID", r."FacilityID", r."OrderCount", r."FirstOrderDate", r."LastOrderDate"
      FROM relations r LEFT JOIN products p USING ("ProductID"))"""

TOP = f"""ranked AS (
      SELECT *, row_number() OVER (PARTITION BY "CustomerID", "FacilityID"
        ORDER BY "OrderCount" DESC, "ProductID") AS rnk FROM lookup),
    top AS (SELECT * FROM ranked WHERE rnk <= 10)"""

ALL_PRODUCTS = "top AS (SELECT * FROM lookup)"

NEXT = "next_day AS (SELECT CAST(max(o_orderdate) AS DATE) + 1 AS as_of FROM orders)"

SPLIT = """split AS (
      SELECT *, CASE WHEN back <= 14 THEN 'test' ELSE 'train' END AS part FROM (
        SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) AS back,
               count(*) OVER (PARTITION BY item_id) AS n FROM long) WHERE n >= 42)"""


def profile(source: str) -> str:
    def quantiles(suffix: str = "") -> str:
        return ", ".join(
            f"quantile_cont(CAST(y AS DOUBLE), {q}) AS p{n}{suffix}" for n, q in [(10, 0.1), (50, 0.5), (90, 0.9)]
        )

    return f"""by_day AS (SELECT item_id, dow, {quantiles()} FROM {source} GROUP BY item_id, dow),
    overall AS (SELECT item_id, {quantiles('_all')} FROM {source} GROUP BY item_id)"""


def predicted(rows: str, day: str) -> str:
    """SELECT of rows (with item_id and a day) and their forecast."""
    return f"""SELECT r.*, coalesce(b.p10, o.p10_all) AS p10, coalesce(b.p50, o.p50_all) AS p50,
             coalesce(b.p90, o.p90_all) AS p90
      FROM {rows} r JOIN overall o USING (item_id)
        LEFT JOIN by_day b ON b.item_id = r.item_id AND b.dow = isodow(r.{day}) - 1"""


SCORED = f"""train AS (SELECT * FROM split WHERE part = 'train'),
    test AS (SELECT item_id, ts, y, product_name FROM split WHERE part = 'test'),
    {profile('train')},
    scored AS ({predicted('test', 'ts')}),
    stepped AS (SELECT *, abs(y - lag(y) OVER (PARTITION BY item_id ORDER BY ts)) AS step FROM scored)"""

METRICS = """count(*) AS n,
      round(sqrt(avg((y - p50) * (y - p50))), 6) AS rmse,
      round(100 * avg(CASE WHEN y <> 0 THEN abs((y - p50) / y) END), 6) AS mape,
      round(avg(abs(y - p50)), 6) AS mae,
      round(CASE WHEN avg(step) > 0 THEN avg(abs(y - p50)) / avg(step) END, 6) AS mase"""

PAIR_FORECAST = f"""chosen AS (
      SELECT *, "CustomerID" || '_' || "FacilityID" || '_' || "ProductID" AS item_id FROM top),
    {profile('long')},
    days AS (
      SELECT c.item_id, as_of + CAST(i AS INTEGER) AS ds
      FROM chosen c, next_day, generate_series(0, 13) g(i)),
    dated AS ({predicted('days', 'ds')}),
    forecast AS (
      SELECT d.item_id, d.ds, d.p10, d.p50, d.p90, c.* EXCLUDE (item_id)
      FROM dated d JOIN chosen c USING (item_id))"""

RECOMMENDED = f"""per_product AS (
      SELECT {SERIES}, max("ProductName") AS product_name, max("OrderCount") AS oc, avg(p50) AS ap,
             arg_max(p50, ds) - arg_min(p50, ds) AS tr, avg(p90 - p10) AS width
      FROM forecast GROUP BY {SERIES}),
    placed AS (
      SELECT *, ap * 0.7::DOUBLE + (oc / 100.0::DOUBLE) * 0.3::DOUBLE + tr * 0.1::DOUBLE AS score FROM per_product),
    recommended AS (
      SELECT "CustomerID", "FacilityID",
             CAST(row_number() OVER (PARTITION BY "CustomerID", "FacilityID"
               ORDER BY score DESC, "ProductID") AS INTEGER) AS rank,
             product_name, "ProductID" AS product_id,
             CAST(greatest(1, trunc(ap * 1.1::DOUBLE)) AS INTEGER) AS recommended_quantity,
             CAST(trunc(CASE WHEN ap > 0 THEN least(95.0, greatest(50.0, 100 - width / ap * 50)) ELSE 60 END) AS INTEGER) AS confidence,
             as_of + CASE WHEN tr >= 0 THEN 1 ELSE 2 END AS optimal_order_date,
             printf('Predicted avg demand: %.1f, trend: %s, historical orders: %d', ap,
               CASE WHEN tr > 0 THEN 'increasing' WHEN tr = 0 THEN 'stable' ELSE 'decreasing' END, oc) AS reasoning,
             round(score, 6) AS combined_score,
             CASE WHEN tr > 0 THEN 'increasing' WHEN tr = 0 THEN 'stable' ELSE 'decreasing' END AS trend
      FROM placed, next_day QUALIFY rank <= 5)"""

LONG_CHAIN = ", ".join([lines(), DAILY, PRODUCTS, LONG])
LOOKUP_CHAIN = ", ".join([lines(), PRODUCTS, LOOKUP])
SCORED_CHAIN = ", ".join([LONG_CHAIN, SPLIT, SCORED])
PAIR_CHAIN = ", ".join([lines(), DAILY, PRODUCTS, LONG, LOOKUP, ALL_PRODUCTS, NEXT, PAIR_FORECAST])
RECOMMENDED_CHAIN = ", ".join([PAIR_CHAIN, RECOMMENDED])

KEPT = """kept AS (SELECT DISTINCT item_id, customer_id, facility_id, category_name, product_id FROM split),
    customer_codes AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT customer_id AS v FROM kept)),
    facility_codes AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT facility_id AS v FROM kept)),
    category_codes AS (SELECT v, dense_rank() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT category_name AS v FROM kept))"""
KEPT_CHAIN = ", ".join([LONG_CHAIN, SPLIT, KEPT])

HOLIDAY_CASE = """CASE
      WHEN m = 1 AND d = 1 THEN 'New Year''s Day' WHEN m = 6 AND d = 19 THEN 'Juneteenth'
      WHEN m = 7 AND d = 4 THEN 'Independence Day' WHEN m = 11 AND d = 11 THEN 'Veterans Day'
      WHEN m = 12 AND d = 25 THEN 'Christmas Day'
      WHEN m = 1 AND w = 1 AND nth = 3 THEN 'Martin Luther King Jr. Day'
      WHEN m = 2 AND w = 1 AND nth = 3 THEN 'Presidents'' Day'
      WHEN m = 5 AND w = 1 AND d + 7 > 31 THEN 'Memorial Day'
      WHEN m = 9 AND w = 1 AND nth = 1 THEN 'Labor Day'
      WHEN m = 10 AND w = 1 AND nth = 2 THEN 'Columbus Day'
      WHEN m = 11 AND w = 4 AND nth = 4 THEN 'Thanksgiving Day'
      ELSE '' END"""


def _dated(source: str, ts: str, keep: str) -> str:
    return f"""dated AS (
      SELECT {keep}, {ts} AS ts, month({ts}) AS m, day({ts}) AS d, isodow({ts}) AS w,
             (day({ts}) - 1) // 7 + 1 AS nth FROM {source}),
    named AS (SELECT *, {HOLIDAY_CASE} AS holiday FROM dated)"""


def _temporal(source: str, ts: str, keep: str) -> str:
    waves = []
    for name, value, period in [
        ("DayOfWeek", "w - 1", 7),
        ("DayOfMonth", "d - 1", 31),
        ("MonthOfYear", "m - 1", 12),
    ]:
        for f in ("sin", "cos"):
            waves.append(f'round({f}(({value}) * (2 * pi() / {period})), 6) AS "{name}_{f}"')
    return f"""WITH {_dated(source, ts, keep)}
      SELECT {keep}, CAST(year(ts) AS INTEGER) AS "OrderYear", CAST(m AS INTEGER) AS "OrderMonth",
        CAST(d AS INTEGER) AS "OrderDay", CAST(w - 1 AS INTEGER) AS "OrderDayOfWeek",
        CAST(hour(ts) AS INTEGER) AS "OrderHour", {', '.join(waves)},
        CAST(quarter(ts) AS INTEGER) AS "OrderQuarter",
        CAST(CASE WHEN w >= 6 THEN 1 ELSE 0 END AS INTEGER) AS "IsWeekend", CAST(ts AS DATE) AS "Date",
        CAST(CASE WHEN holiday <> '' THEN 1 ELSE 0 END AS INTEGER) AS "IsHoliday", holiday AS "HolidayName"
      FROM named"""


def _patterns(source: str, keys: str) -> str:
    return f"""numbered AS (
      SELECT *, CAST(row_number() OVER (PARTITION BY {keys} ORDER BY "Date") - 1 AS DOUBLE) AS pos FROM {source}),
    stats AS (
      SELECT {keys}, count(*) AS "TotalOrders", avg("Quantity") AS "AvgQuantity",
        stddev_pop("Quantity") AS "StdQuantity", max("Quantity") AS "MaxQuantity",
        min("Quantity") AS "MinQuantity", median("Quantity") AS "MedianQuantity",
        CASE WHEN avg("Quantity") > 0 THEN stddev_pop("Quantity") / avg("Quantity") ELSE 0 END AS "CoefficientOfVariation",
        CASE WHEN count(*) > 2 THEN regr_slope("Quantity", pos) ELSE 0 END AS "TrendSlope",
        CASE WHEN count(*) > 1 THEN date_diff('day', min("Date"), max("Date")) / (count(*) - 1) END AS "AvgDaysBetweenOrders",
        min("Date") AS "FirstOrderDate", max("Date") AS "LastOrderDate"
      FROM numbered GROUP BY {keys})"""


ROUNDED_STATS = ", ".join(
    f'round("{c}", 6) AS "{c}"'
    for c in [
        "AvgQuantity",
        "StdQuantity",
        "MaxQuantity",
        "MinQuantity",
        "MedianQuantity",
        "CoefficientOfVariation",
        "TrendSlope",
        "AvgDaysBetweenOrders",
    ]
)

SIMPLE = f"""simple AS (
      SELECT {SERIES}, count("OrderUnits") AS "TotalOrders", avg("OrderUnits") AS "AvgQuantity",
        coalesce(stddev_samp("OrderUnits"), 0) AS "StdQuantity", max("OrderUnits") AS "MaxQuantity",
        min("OrderUnits") AS "MinQuantity", avg("OrderUnits") AS "MedianQuantity",
        coalesce(coalesce(stddev_samp("OrderUnits"), 0) / avg("OrderUnits"), 0) AS "CoefficientOfVariation",
        0.0::DOUBLE AS "TrendSlope",
        CASE WHEN count(*) > 1 THEN date_diff('day', min("CreateDate"), max("CreateDate")) / (count(*) - 1) ELSE 0.0 END AS "AvgDaysBetweenOrders",
        CAST(min("CreateDate") AS DATE) AS "FirstOrderDate", CAST(max("CreateDate") AS DATE) AS "LastOrderDate"
      FROM lines GROUP BY {SERIES})"""

SIMPLE_SELECT = f"""SELECT {SERIES}, 'Product ' || "ProductID" AS "ProductName", 'General' AS "CategoryName",
      'Vendor' || replace(CAST("ProductID" AS VARCHAR), 'PROD', '') AS "VendorName", "TotalOrders",
      {ROUNDED_STATS}, "FirstOrderDate", "LastOrderDate" FROM simple"""

LOOKUP_SELECT = """SELECT "ProductID", "ProductName", "CategoryName", "vendorName", "CustomerID", "FacilityID",
      "OrderCount", CAST("FirstOrderDate" AS DATE) AS "FirstOrderDate",
      CAST("LastOrderDate" AS DATE) AS "LastOrderDate" FROM"""

ITEMS = """items AS (
      SELECT "ProductID" AS product_id, 'PRODUCT' AS record_type, "ProductName" AS product_name,
        "CategoryName" AS category_name, "VendorName" AS vendor_name, NULL AS customer_facility,
        NULL AS customer_id, NULL AS facility_id, NULL AS base_product_id, NULL::BIGINT AS order_count,
        NULL AS first_order_date, NULL AS last_order_date FROM products
      UNION ALL
      SELECT replace(CAST("ProductID" AS VARCHAR), '#', '\\#') || '#' || replace("CustomerID", '#', '\\#') || '#' || replace(CAST("FacilityID" AS VARCHAR), '#', '\\#'), 'CUSTOMER_PRODUCT', "ProductName",
        "CategoryName", "vendorName", replace("CustomerID", '#', '\\#') || '#' || replace(CAST("FacilityID" AS VARCHAR), '#', '\\#'), "CustomerID",
        CAST("FacilityID" AS VARCHAR), "ProductID", "OrderCount",
        strftime("FirstOrderDate", '%Y-%m-%dT%H:%M:%S'), strftime("LastOrderDate", '%Y-%m-%dT%H:%M:%S')
      FROM lookup)"""

CUSTOMER_DAILY = """totals AS (
      SELECT "CustomerID", "FacilityID", "Date", count(*) AS "TotalItems",
        count(DISTINCT "ProductID") AS "UniqueProducts", sum("OrderUnits") AS "TotalUnits",
        sum("OrderUnits" * "Price") AS "TotalValue" FROM lines GROUP BY ALL)"""

CHECK_NULLS = ["CustomerID", "FacilityID", "ProductID", "CreateDate", "OrderUnits"]


def _null_rows(source: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) - count("{c}") AS null_count, count(*) AS total FROM {source}"""
        for c in CHECK_NULLS
    )


def _checks(source: str) -> str:
    """Check rows (without messages) of a line table."""
    dates = f'SELECT min("Date") AS lo, max("Date") AS hi, count(*) - count("Date") AS bad FROM {source}'
    values = " UNION ALL ".join(
        f"""SELECT '{kind}_values' AS "check", '{c}' AS scope, CAST(count(*) AS DOUBLE) AS "value", 0.0::DOUBLE AS threshold,
          CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END AS status FROM {source} WHERE "{c}" {test}"""
        for c in ("OrderUnits", "Price")
        for kind, test in (("negative", "< 0"), ("zero", "= 0"))
    )
    return f"""
      SELECT 'nulls' AS "check", column_name AS scope, CAST(null_count AS DOUBLE) AS "value", 0.0::DOUBLE AS threshold,
        CASE WHEN null_count > 0 THEN 'warning' ELSE 'ok' END AS status FROM ({_null_rows(source)})
      UNION ALL
      SELECT 'excessive_nulls', column_name, round(100.0 * null_count / total, 6), 10.0,
        CASE WHEN null_count > total * 0.1 THEN 'issue' ELSE 'ok' END FROM ({_null_rows(source)})
      UNION ALL
      SELECT 'invalid_dates', 'CreateDate', CAST(bad AS DOUBLE), 0.0, CASE WHEN bad > 0 THEN 'warning' ELSE 'ok' END FROM ({dates})
      UNION ALL
      SELECT 'dates_too_old', 'CreateDate', CASE WHEN lo < DATE '2001-08-02' - 1825 THEN 1.0 ELSE 0.0 END, 0.0,
        CASE WHEN lo < DATE '2001-08-02' - 1825 THEN 'warning' ELSE 'ok' END FROM ({dates})
      UNION ALL
      SELECT 'dates_too_new', 'CreateDate', CASE WHEN hi > DATE '2001-08-02' + 730 THEN 1.0 ELSE 0.0 END, 0.0,
        CASE WHEN hi > DATE '2001-08-02' + 730 THEN 'warning' ELSE 'ok' END FROM ({dates})
      UNION ALL {values}
      UNION ALL
      SELECT 'one_name_per_product', 'ProductID', CAST(count(*) AS DOUBLE), 0.0,
        CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END
      FROM (SELECT "ProductID" FROM {source} GROUP BY 1 HAVING count(DISTINCT "ProductName") > 1)"""


def _verdict(source: str) -> str:
    return f"""SELECT issues_count, warnings_count,
      CASE WHEN issues_count > 0 THEN 'FAILED' WHEN warnings_count <= 5 THEN 'PASSED' ELSE 'PASSED_WITH_WARNINGS' END AS validation_summary
      FROM (SELECT count(*) FILTER (status = 'issue') AS issues_count,
        count(*) FILTER (status = 'warning') AS warnings_count FROM ({_checks(source)}))"""


def _numeric(source: str, columns: list[str]) -> str:
    parts = []
    for c in columns:
        parts.append(f"""SELECT '{c}' AS column_name, v, quantile_cont(v, 0.25) OVER () AS q1,
          quantile_cont(v, 0.75) OVER () AS q3 FROM (SELECT CAST("{c}" AS DOUBLE) AS v FROM {source})""")
    return "values_of AS (" + " UNION ALL ".join(parts) + ")"


def _value_counts(source: str, columns: list[str]) -> str:
    return "counts AS (" + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, "{c}" AS v, count(*) AS n FROM {source} WHERE "{c}" IS NOT NULL GROUP BY "{c}" """
        for c in columns
    ) + f"), sized AS (SELECT count(*) AS total FROM {source})"


def _rules(source: str) -> str:
    return f"""
      SELECT 'valid_orders' AS rule, 100.0 * count(*) FILTER ("OrderUnits" > 0 AND "Price" > 0) / count(*) AS metric FROM {source}
      UNION ALL SELECT 'facilities_per_customer', avg(n) FROM (SELECT count(DISTINCT "FacilityID") AS n FROM {source} WHERE "CustomerID" IS NOT NULL GROUP BY "CustomerID")
      UNION ALL SELECT 'category_coverage', 100.0 * count(DISTINCT CASE WHEN "CategoryName" IS NOT NULL THEN "ProductID" END) / count(DISTINCT "ProductID") FROM {source}
      UNION ALL SELECT 'date_span', date_diff('day', min("Date"), max("Date")) FROM {source}
      UNION ALL SELECT 'products_per_vendor', avg(n) FROM (SELECT count(DISTINCT "ProductID") AS n FROM {source} GROUP BY "VendorID")"""


def _rules_passed(source: str) -> str:
    return f"""SELECT rule, round(CAST(metric AS DOUBLE), 6) AS metric, CAST(CASE rule
        WHEN 'valid_orders' THEN metric >= 95 WHEN 'facilities_per_customer' THEN metric > 0
        WHEN 'category_coverage' THEN metric >= 90 WHEN 'date_span' THEN metric BETWEEN 30 AND 1095
        ELSE metric >= 1 END AS INTEGER) AS passed FROM ({_rules(source)})"""


def _score(source: str, columns: list[str]) -> str:
    """CTEs ending in ``score``, the quality score of some columns of a table."""
    names = ", ".join(f'"{c}"' for c in columns)
    return f"""facts AS (
      SELECT count(*) AS "rows",
        CAST(4 * count(*) - count("CustomerID") - count("FacilityID") - count("ProductID") - count("CreateDate") AS BIGINT) AS missing_critical,
        count(*) FILTER ("OrderUnits" < 0) AS validity_issues FROM {source}),
    uniques AS (SELECT count(*) AS n FROM (SELECT DISTINCT {names} FROM {source})),
    parts AS (
      SELECT *, "rows" - n AS duplicate_records, 100.0 * ("rows" - n) / "rows" AS duplicate_pct,
        greatest(0, 100 - 100.0 * missing_critical / "rows") AS completeness,
        greatest(0, 100 - 100.0 * validity_issues / "rows") AS validity,
        greatest(0, 100 - 100.0 * ("rows" - n) / "rows") AS consistency FROM facts, uniques),
    score AS (
      SELECT "rows", missing_critical, validity_issues, duplicate_records, round(duplicate_pct, 6) AS duplicate_pct,
        round(completeness, 6) AS completeness, round(validity, 6) AS validity, round(consistency, 6) AS consistency,
        round((completeness + validity + consistency) / 3, 6) AS data_quality_score FROM parts)"""


ADVICE = [
    ("data_quality_score < 70", "Data quality is below acceptable threshold (70%). Immediate attention required."),
    ("duplicate_pct > 5", "High duplicate record percentage detected. Consider data deduplication."),
    ("missing_critical > 0", "Missing values found in critical columns. Data cleaning recommended."),
    ("validity_issues > 0", "Data validity issues detected. Review data formats and business rules."),
]
ADVICE_LIST = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in ADVICE) + "], lambda x: x IS NOT NULL)"
ADVICE_GIVEN = f"""CASE WHEN len({ADVICE_LIST}) > 0 THEN {ADVICE_LIST}
      ELSE ['Data quality is acceptable. Continue with regular monitoring.'] END"""

ORDER_COLUMNS = [
    "OrderID", "CreateDate", "CustomerID", "FacilityID", "ProductID", "ProductName",
    "CategoryName", "VendorID", "VendorName", "OrderUnits", "Price",
]
DAY_COLUMNS = ["CustomerID", "FacilityID", "ProductID", "CreateDate", "OrderUnits"]
TEXT_COLUMNS = ["ProductName", "CategoryName", "VendorName"]

BASELINE = """SELECT "CustomerID", "FacilityID", "ProductID", as_of + CAST(i AS INTEGER) AS ds,
      CAST(base * 0.5 AS DOUBLE) AS p10, CAST(base AS DOUBLE) AS p50, CAST(base * 2 AS DOUBLE) AS p90,
      CAST(base AS DOUBLE) AS "mean"{extra}
      FROM (SELECT *, greatest(1, {base}) AS base FROM top), next_day, generate_series(0, 6) g(i)"""

FEEDBACK = """feed AS (
      SELECT event_id, event_type, user_id, event_id % 97 = 0 AS broken,
        CAST(json_extract_string(props, '$.k') AS INTEGER) % 7 AS k,
        CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 51 = 0 THEN '' ELSE CAST(event_id % 9 AS VARCHAR) END AS facility,
        CASE WHEN event_id % 10 = 0 THEN NULL WHEN event_id % 13 = 0 THEN -value ELSE value END AS quantity
      FROM events)"""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}

    # cleaning and calendar
    q["temporal_features"] = _temporal(
        "lineitem LEFT JOIN orders ON l_orderkey = o_orderkey", "o_orderdate",
        'l_orderkey AS "OrderID", l_partkey AS "ProductID"',
    ).replace('SELECT l_orderkey AS "OrderID", l_partkey AS "ProductID", CAST(year', 'SELECT "OrderID", "ProductID", CAST(year')
    q["temporal_features_hourly"] = _temporal("events", "ts", "event_id").replace("event_id, ts AS ts", "event_id, ts")
    q["holiday_calendar"] = f"""WITH years AS (SELECT DISTINCT year(o_orderdate) AS y FROM orders),
      all_days AS (SELECT y, CAST(unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY)) AS DATE) AS day FROM years),
      {_dated('all_days', 'day', 'y')}
      SELECT CAST(y AS INTEGER) AS "year", ts AS "Date", holiday AS "HolidayName" FROM named WHERE holiday <> ''"""
    q["holiday_flags"] = f"""WITH {_dated('orders', 'o_orderdate', 'o_orderkey')}
      SELECT o_orderkey, CAST(ts AS DATE) AS "Date", holiday AS "HolidayName",
        CAST(CASE WHEN holiday <> '' THEN 1 ELSE 0 END AS INTEGER) AS "IsHoliday" FROM named"""
    q["parse_dates"] = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d')
        WHEN 1 THEN strftime(o_orderdate, '%m/%d/%Y') WHEN 2 THEN strftime(o_orderdate, '%-m/%-d/%y')
        WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
        WHEN 4 THEN strftime(o_orderdate, '%m/%d/%Y %H:%M') WHEN 5 THEN strftime(o_orderdate, '%Y/%m/%d %H:%M')
        WHEN 6 THEN strftime(o_orderdate, '%Y%m%d') WHEN 7 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000')
        WHEN 8 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M') ELSE 'invalid-date' END AS raw,
        CASE WHEN o_orderkey % 10 < 9 THEN CAST(o_orderdate AS DATE) END AS parsed FROM orders"""
    q["default_columns"] = """SELECT 'PROD' || p_partkey AS "ProductID",
        CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'Product PROD' || p_partkey END AS "ProductName",
        CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'General' END AS "CategoryName",
        'Vendor' || p_partkey AS "VendorName" FROM part"""
    q["json_from_text"] = """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1
        ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events"""
    q["feedback_validation"] = f"""WITH {FEEDBACK}
      SELECT event_id, CASE WHEN broken THEN 'INVALID_JSON' WHEN facility IS NULL THEN 'MISSING_FIELDS'
          WHEN facility = '' OR k NOT BETWEEN 1 AND 5 OR event_type = 'error' THEN 'INVALID_FIELD_VALUES' ELSE 'OK' END AS error_code,
        CASE WHEN NOT broken THEN CAST(user_id AS VARCHAR) END AS customer_id,
        CASE WHEN NOT broken THEN facility END AS facility_id,
        CASE WHEN NOT broken THEN CAST(event_id AS VARCHAR) END AS prediction_id,
        CASE WHEN NOT broken THEN k END AS rating,
        round(CASE WHEN NOT broken THEN quantity END, 6) AS actual_quantity,
        CAST(coalesce(NOT broken AND quantity < 0, FALSE) AS INTEGER) AS negative_quantity FROM feed"""

    # demand
    q["daily_demand"] = f"""WITH {lines()}, {DAILY} SELECT * REPLACE (round("Quantity", 6) AS "Quantity") FROM daily"""
    q["daily_demand_count"] = f"""WITH {lines()}
      SELECT {SERIES}, "Date", CAST(count(*) AS DOUBLE) AS "Quantity" FROM lines GROUP BY ALL"""
    q["daily_demand_dense"] = f"""WITH {lines()}, {DAILY},
      spans AS (SELECT {SERIES}, min("Date") AS a, max("Date") AS b FROM daily GROUP BY ALL),
      every AS (SELECT {SERIES}, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS "Date" FROM spans)
      SELECT {SERIES}, count(*) AS n_days, count(*) FILTER (coalesce("Quantity", 0) = 0) AS n_empty,
        round(sum("Quantity"), 6) AS total FROM every LEFT JOIN daily USING ({SERIES}, "Date") GROUP BY {SERIES}"""
    q["daily_demand_enriched"] = f"""WITH {lines()}, {DAILY}, {PRODUCTS}
      SELECT {SERIES}, "Date", round("Quantity", 6) AS "Quantity", "ProductName", "CategoryName", "VendorName"
      FROM daily LEFT JOIN products USING ("ProductID")"""
    q["demand_patterns"] = f"""WITH {lines()}, {DAILY}, {PRODUCTS}, {_patterns('daily', SERIES)}
      SELECT {SERIES}, "ProductName", "CategoryName", "VendorName", "TotalOrders", {ROUNDED_STATS},
        "FirstOrderDate", "LastOrderDate" FROM stats LEFT JOIN products USING ("ProductID")"""
    q["demand_patterns_simple"] = f"WITH {lines('fine')}, {SIMPLE} {SIMPLE_SELECT}"
    q["merge_patterns"] = f"WITH {lines()}, {SIMPLE} {SIMPLE_SELECT}"
    q["merge_patterns_mean"] = f"""WITH {lines()}, {DAILY}, {PRODUCTS},
      yearly AS (SELECT *, year("Date") AS chunk FROM daily), {_patterns('yearly', 'chunk, ' + SERIES)},
      merged AS (SELECT {SERIES}, CAST(sum("TotalOrders") AS BIGINT) AS "TotalOrders", avg("AvgQuantity") AS "AvgQuantity",
        avg("StdQuantity") AS "StdQuantity", max("MaxQuantity") AS "MaxQuantity", min("MinQuantity") AS "MinQuantity",
        avg("MedianQuantity") AS "MedianQuantity", avg("CoefficientOfVariation") AS "CoefficientOfVariation",
        avg("TrendSlope") AS "TrendSlope", avg("AvgDaysBetweenOrders") AS "AvgDaysBetweenOrders",
        min("FirstOrderDate") AS "FirstOrderDate", max("LastOrderDate") AS "LastOrderDate" FROM stats GROUP BY {SERIES})
      SELECT {SERIES}, "ProductName", "CategoryName", "VendorName", "TotalOrders", {ROUNDED_STATS},
        "FirstOrderDate", "LastOrderDate" FROM merged LEFT JOIN products USING ("ProductID")"""
    q["customer_daily"] = f"""WITH {lines()}, {CUSTOMER_DAILY}
      SELECT * REPLACE (round("TotalUnits", 6) AS "TotalUnits", round("TotalValue", 6) AS "TotalValue") FROM totals"""
    metrics = [("TOTAL_UNITS", "TotalUnits"), ("UNIQUE_PRODUCTS", "UniqueProducts"), ("TOTAL_VALUE", "TotalValue")]
    q["customer_forecast_long"] = f"WITH {lines()}, {CUSTOMER_DAILY} " + " UNION ALL ".join(
        f"""SELECT "CustomerID" || '_' || "FacilityID" || '_{m}' AS item_id, "Date" AS "timestamp",
          round(CAST("{c}" AS DOUBLE), 6) AS target_value, "CustomerID" AS customer_id, "FacilityID" AS facility_id,
          '{m}' AS metric_type, CAST(isodow("Date") - 1 AS INTEGER) AS day_of_week,
          CAST(month("Date") AS INTEGER) AS "month" FROM totals"""
        for m, c in metrics
    )
    q["product_forecast_long"] = f"""WITH {LONG_CHAIN}
      SELECT item_id, ts AS "timestamp", round(y, 6) AS target_value, customer_id, facility_id, product_id,
        product_name, category_name, vendor_name, dow AS day_of_week, CAST(month(ts) AS INTEGER) AS "month" FROM long"""

    # lookups
    q["product_lookup"] = f"""WITH {lines('fine')}, {PRODUCTS}
      SELECT "ProductID", "ProductName", "CategoryName", "VendorName" AS "vendorName" FROM products"""
    q["product_lookup_union"] = f"""WITH {lines('brand', 'b')}, {lines('type', 't')}
      SELECT "ProductID", "ProductName", "CategoryName", min("VendorName") AS "vendorName"
      FROM (SELECT * FROM b UNION ALL SELECT * FROM t) GROUP BY 1, 2, 3"""
    q["customer_product_lookup"] = f"WITH {LOOKUP_CHAIN} {LOOKUP_SELECT} lookup"
    q["customer_product_inner"] = f"""WITH {lines('fine')}, {PRODUCTS}, {LOOKUP},
      known AS (SELECT r.*, p_name, p_brand FROM relations r JOIN part ON p_partkey = "ProductID")
      SELECT "ProductID", p_name AS "ProductName", p_brand AS "CategoryName", 'Vendor' || "ProductID" AS "vendorName",
        "CustomerID", "FacilityID", "OrderCount", CAST("FirstOrderDate" AS DATE) AS "FirstOrderDate",
        CAST("LastOrderDate" AS DATE) AS "LastOrderDate" FROM known"""
    q["lookup_items"] = f"WITH {LOOKUP_CHAIN}, {ITEMS} SELECT * FROM items"
    q["lookup_by_customer_facility"] = f"WITH {LOOKUP_CHAIN}, {ITEMS} SELECT * FROM items WHERE customer_facility = 'FURNITURE#2'"
    q["customer_products"] = f"""WITH {LOOKUP_CHAIN} {LOOKUP_SELECT} lookup
      WHERE "CustomerID" = 'FURNITURE' AND "FacilityID" = 2"""
    q["top_products_per_facility"] = f"""WITH {LOOKUP_CHAIN}, {TOP}
      SELECT {SERIES}, "OrderCount", CAST(rnk AS INTEGER) AS rank FROM top"""
    q["distinct_pairs"] = f"""WITH {lines('fine')} SELECT "CustomerID", "FacilityID" FROM lines GROUP BY ALL"""
    q["latest_snapshot"] = """SELECT o_orderkey, o_custkey, round(o_totalprice, 6) AS o_totalprice,
      CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)"""

    # exploration
    q["orders_by_day"] = f"""WITH {lines()} SELECT "Date", count(*) AS "OrderCount" FROM lines GROUP BY 1"""
    q["orders_by_weekday"] = f"""WITH {lines()} SELECT CAST(isodow("Date") - 1 AS INTEGER) AS "DayOfWeek",
      count(*) AS "OrderCount", dayname("Date") AS "DayName" FROM lines GROUP BY 1, 3"""
    q["top_products"] = f"""WITH {lines('fine')} SELECT "ProductID", "ProductName", count(*) AS "OrderCount"
      FROM lines GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20"""
    q["top_series"] = f"""WITH {LONG_CHAIN} SELECT item_id, count(*) AS "OrderCount" FROM long
      GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5"""
    nulls = ", ".join(f'count(*) - count("{c}") AS nulls_{c.lower()}' for c in ORDER_COLUMNS)
    uniques = ", ".join(
        f'count(DISTINCT "{c}") AS unique_{c.lower()}'
        for c in ["CustomerID", "FacilityID", "ProductID", "OrderID", "VendorID"]
    )
    q["dataset_overview"] = f"""WITH {lines()}, {damaged()} SELECT count(*) AS total_records, min("Date") AS start_date,
      max("Date") AS end_date, CAST(date_diff('day', min("Date"), max("Date")) AS INTEGER) AS span_days,
      {nulls}, {uniques}, CAST(11 AS INTEGER) AS total_columns FROM damaged"""
    lengths = f'{lines()}, {DAILY}, lengths AS (SELECT {SERIES}, count(*) AS n FROM daily GROUP BY ALL)'
    q["series_length_stats"] = f"""WITH {lengths} SELECT count(*) AS n_series, round(avg(n), 6) AS avg_length,
      round(median(CAST(n AS DOUBLE)), 6) AS median_length, min(n) AS min_length, max(n) AS max_length FROM lengths"""
    q["series_length_hist"] = f"""WITH {lengths}, edges AS (SELECT CAST(min(n) AS DOUBLE) AS lo, CAST(max(n) AS DOUBLE) AS hi FROM lengths),
      binned AS (SELECT least(29, CAST(floor((n - lo) * 30 / (hi - lo)) AS INTEGER)) AS bin FROM lengths, edges)
      SELECT CAST(i AS INTEGER) AS bin, round(lo + i * (hi - lo) / 30, 6) AS bin_start,
        round(lo + (i + 1) * (hi - lo) / 30, 6) AS bin_end, (SELECT count(*) FROM binned WHERE bin = i) AS n_series
      FROM edges, generate_series(0, 29) g(i)"""

    # quality
    q["dq_nulls"] = f"""WITH {lines()}, {damaged()} SELECT column_name, null_count,
      round(100.0 * null_count / total, 6) AS null_pct,
      CASE WHEN null_count > total * 0.1 THEN 'issue' WHEN null_count > 0 THEN 'warning' ELSE 'ok' END AS status
      FROM ({_null_rows('damaged')})"""
    q["dq_dates"] = """SELECT count(*) FILTER (o_orderkey % 250 = 0) AS invalid_dates,
      min(CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 250 <> 0) AS min_date,
      max(CAST(o_orderdate AS DATE)) FILTER (o_orderkey % 250 <> 0) AS max_date,
      CAST(min_date < DATE '2001-08-02' - 1825 AS INTEGER) AS too_old,
      CAST(max_date > DATE '2001-08-02' + 730 AS INTEGER) AS too_new FROM orders"""
    q["dq_value_checks"] = f"WITH {lines()}, {damaged()} " + " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, '{kind}' AS problem, count(*) AS row_count,
          CASE WHEN count(*) > 0 THEN 'warning' ELSE 'ok' END AS status FROM damaged WHERE "{c}" {test}"""
        for c in ("OrderUnits", "Price")
        for kind, test in (("negative", "< 0"), ("zero", "= 0"))
    )
    q["dq_duplicates"] = f"""WITH {lines()}, uniques AS (SELECT DISTINCT {', '.join(f'"{c}"' for c in DAY_COLUMNS)} FROM lines)
      SELECT t AS total_records, t - u AS duplicate_records, round(100.0 * (t - u) / t, 6) AS duplicate_pct
      FROM (SELECT (SELECT count(*) FROM lines) AS t, (SELECT count(*) FROM uniques) AS u)"""
    q["dq_fd_violations"] = f"""WITH {lines('fine')} SELECT "CategoryName" AS key, count(DISTINCT "ProductName") AS n_values
      FROM lines GROUP BY 1 HAVING count(DISTINCT "ProductName") > 1"""
    q["dq_checks"] = f"WITH {lines()}, {damaged()} " + _checks("damaged")
    q["dq_verdict"] = f"""WITH {lines()}, {damaged()}
      SELECT *, 'clean' AS dataset FROM ({_verdict('lines')}) UNION ALL SELECT *, 'damaged' FROM ({_verdict('damaged')})"""
    numeric = ["OrderID", "VendorID", "OrderUnits", "Price"]
    q["numeric_profile"] = f"""WITH {lines()}, {_numeric('lines', numeric)}
      SELECT column_name, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
        round(max(v), 6) AS max, round(median(v), 6) AS median, round(any_value(q1), 6) AS q25, round(any_value(q3), 6) AS q75,
        round(skewness(v), 6) AS skewness, round(kurtosis(v), 6) AS kurtosis, count(*) FILTER (v = 0) AS zeros,
        count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers
      FROM values_of GROUP BY column_name"""
    q["iqr_outliers"] = f"""WITH {lines()}, {_numeric('lines', ['OrderUnits', 'Price'])}
      SELECT column_name, round(any_value(q1 - 1.5 * (q3 - q1)), 6) AS lower_bound,
        round(any_value(q3 + 1.5 * (q3 - q1)), 6) AS upper_bound,
        count(*) FILTER (v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS outliers FROM values_of GROUP BY column_name"""
    counts = f"{lines('fine')}, {damaged()}, {_value_counts('damaged', TEXT_COLUMNS)}"
    q["categorical_profile"] = f"""WITH {counts},
      placed AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS rn,
        count(*) OVER (PARTITION BY column_name) AS u FROM counts)
      SELECT a.column_name, a.u AS unique_values, a.v AS most_frequent, a.n AS most_frequent_count,
        z.v AS least_frequent, z.n AS least_frequent_count, round(CAST(a.u AS DOUBLE) / total, 6) AS cardinality_ratio
      FROM placed a JOIN placed z ON a.column_name = z.column_name AND a.rn = 1 AND z.rn = z.u, sized"""
    q["categorical_top5"] = f"""WITH {counts}
      SELECT column_name, v AS "value", n, CAST(row_number() OVER (PARTITION BY column_name ORDER BY n DESC, v) AS INTEGER) AS rank
      FROM counts QUALIFY rank <= 5"""
    q["business_rules"] = f"WITH {lines('fine')}, {damaged()} {_rules_passed('damaged')}"
    q["quality_score"] = f"WITH {lines()}, {damaged()}, {_score('damaged', DAY_COLUMNS)} SELECT * FROM score"
    q["quality_recommendations"] = f"""WITH {lines()}, {damaged()}, {_score('damaged', DAY_COLUMNS)}
      SELECT unnest({ADVICE_GIVEN}) AS recommendation FROM score"""
    q["validation_report"] = f"""WITH {lines()}, {damaged()}, {_score('damaged', ORDER_COLUMNS)},
      verdict AS ({_verdict('damaged')}),
      rules AS (SELECT count(*) FILTER (passed = 1) AS business_rules_passed,
        count(*) FILTER (passed = 0) AS business_rules_failed FROM ({_rules_passed('damaged')}))
      SELECT verdict.*, data_quality_score, "rows" AS total_records, rules.*,
        array_to_string({ADVICE_GIVEN}, ' | ') AS recommendations FROM score, verdict, rules"""

    # series
    q["category_codes"] = f"WITH {KEPT_CHAIN} " + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, CAST(v AS VARCHAR) AS \"value\", CAST(code AS INTEGER) AS code FROM {f}_codes"
        for f in ("customer", "facility", "category")
    )
    encoded = """JOIN customer_codes c ON c.v = k.customer_id JOIN facility_codes f ON f.v = k.facility_id
        JOIN category_codes g ON g.v = k.category_name"""
    q["encode_categories"] = f"""WITH {KEPT_CHAIN},
      items AS (SELECT DISTINCT item_id, customer_id, facility_id, category_name FROM long)
      SELECT k.item_id, CAST(least(coalesce(c.code, 0), 3) AS INTEGER) AS customer_cat,
        CAST(least(coalesce(f.code, 0), 49) AS INTEGER) AS facility_cat,
        CAST(least(coalesce(g.code, 0), 23) AS INTEGER) AS category_cat
      FROM items k {encoded.replace('JOIN', 'LEFT JOIN')}"""
    q["series_context"] = f"""WITH {LONG_CHAIN},
      placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts) AS rn, count(*) OVER (PARTITION BY item_id) AS n FROM long)
      SELECT item_id, ts AS "timestamp", round(y, 6) AS target_value, CAST(rn - (n - 28) - 1 AS INTEGER) AS position
      FROM placed WHERE n >= 28 AND rn > n - 28"""
    q["holdout_split"] = f"""WITH {LONG_CHAIN}, {SPLIT}
      SELECT item_id, ts AS "timestamp", round(y, 6) AS target_value, part AS split FROM split"""
    sums = """CAST(count(*) AS INTEGER) AS n_points, round(sum(y), 6) AS target_sum,
        round(sum(dow / 6.0), 6) AS weekday_sum, round(sum((month(ts) - 1) / 11.0), 6) AS month_sum,
        strftime(min(ts), '%Y-%m-%d') AS start"""
    totals = " UNION ALL ".join(
        f"SELECT item_id, '{part}' AS part, {sums} FROM split {where} GROUP BY item_id"
        for part, where in (("train", ""), ("test", "WHERE part = 'train'"))
    )
    q["series_instances"] = f"""WITH {KEPT_CHAIN}, totals AS ({totals})
      SELECT t.*, CAST(c.code AS INTEGER) AS customer_cat, CAST(f.code AS INTEGER) AS facility_cat,
        CAST(g.code AS INTEGER) AS category_cat, k.product_id FROM totals t JOIN kept k USING (item_id) {encoded}"""
    q["inference_instances"] = f"""WITH {LONG_CHAIN},
      placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY item_id) AS n FROM long),
      recent AS (SELECT item_id, ts, y, 28 - back AS position FROM placed WHERE n >= 28 AND back <= 28),
      ends AS (SELECT item_id, min(ts) AS a, max(ts) AS b FROM recent GROUP BY 1),
      every AS (SELECT item_id, ts, y, position FROM recent UNION ALL
        SELECT item_id, b + CAST(i AS INTEGER), NULL, 27 + i FROM ends, generate_series(1, 14) g(i))
      SELECT item_id, strftime(a, '%Y-%m-%d') AS start, CAST(position AS INTEGER) AS position, round(y, 6) AS target,
        round((isodow(ts) - 1) / 6.0, 6) AS weekday_share, round((month(ts) - 1) / 11.0, 6) AS month_share
      FROM every JOIN ends USING (item_id)"""
    q["request_payload"] = f"""WITH {KEPT_CHAIN},
      placed AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY item_id) AS n FROM long),
      recent AS (SELECT item_id, customer_id, facility_id, category_name, strftime(min(ts), '%Y-%m-%d') AS start,
        CAST(count(*) AS INTEGER) AS n_points, round(sum(y), 6) AS target_sum FROM placed WHERE n >= 28 AND back <= 28 GROUP BY ALL)
      SELECT k.item_id, start, n_points, target_sum, CAST(42 AS INTEGER) AS n_days,
        concat_ws(',', coalesce(c.code, 0), coalesce(f.code, 0), coalesce(g.code, 0)) AS cat,
        CAST(100 AS INTEGER) AS num_samples, '0.1,0.5,0.9' AS quantiles
      FROM recent k {encoded.replace('JOIN', 'LEFT JOIN')}"""
    q["series_product_info"] = f"""WITH {LONG_CHAIN} SELECT item_id, count(*) AS length, product_id, product_name, category_name
      FROM long GROUP BY ALL"""

    # forecasts
    q["forecast_calendar"] = f"""WITH {lines()}, {NEXT},
      items AS (SELECT DISTINCT "CustomerID" || '_' || "FacilityID" || '_' || "ProductID" AS item_id FROM lines),
      days AS (SELECT item_id, as_of + CAST(i AS INTEGER) AS ds FROM items, next_day, generate_series(0, 13) g(i))
      SELECT item_id, ds, round((isodow(ds) - 1) / 6.0, 6) AS weekday_share, round((month(ds) - 1) / 11.0, 6) AS month_share FROM days"""
    q["baseline_forecast"] = f"WITH {LOOKUP_CHAIN}, {ALL_PRODUCTS}, {NEXT} " + BASELINE.format(base='"OrderCount" // 10', extra="")
    q["baseline_forecast_fallback"] = f"WITH {LOOKUP_CHAIN}, {ALL_PRODUCTS}, {NEXT} " + BASELINE.format(
        base='"OrderCount"', extra=", CAST(1 AS INTEGER) AS mock_data")
    q["model_forecast_fallback"] = f"""WITH {LOOKUP_CHAIN}, {DAILY}, fit AS (
        SELECT {SERIES}, min("Quantity") AS lo, max("Quantity") AS hi, arg_max("Quantity", "Date") AS y FROM daily GROUP BY ALL)
      SELECT {SERIES}, "ProductName", "OrderCount", DATE '2001-08-02' + CAST(i AS INTEGER) AS ds,
        CASE WHEN y > 40 THEN 0.5 * greatest(1, "OrderCount") ELSE lo END::DOUBLE AS p10,
        CASE WHEN y > 40 THEN greatest(1, "OrderCount") ELSE y END::DOUBLE AS p50,
        CASE WHEN y > 40 THEN 2 * greatest(1, "OrderCount") ELSE hi END::DOUBLE AS p90, CAST(y > 40 AS INTEGER) AS mock_data,
        CASE WHEN y > 40 THEN 'ValueError: last quantity ' || CAST(y AS BIGINT) || ' is out of range' END AS error
      FROM lookup JOIN fit USING ({SERIES}), generate_series(0, 13) g(i) WHERE y <= 40 OR i < 7"""
    future = f"""{LONG_CHAIN}, {NEXT}, {profile('long')},
      days AS (SELECT DISTINCT item_id, as_of + CAST(i AS INTEGER) AS ds, CAST(i AS INTEGER) AS i FROM long, next_day, generate_series(0, 13) g(i)),
      forecast AS ({predicted('days', 'ds')})"""
    forecast_columns = 'item_id, ds, round(p10, 6) AS p10, round(p50, 6) AS p50, round(p90, 6) AS p90, round(p50, 6) AS "mean"'
    q["seasonal_quantile_forecast"] = f"WITH {future} SELECT {forecast_columns} FROM forecast"
    q["quantiles_to_rows"] = f"WITH {future} SELECT {forecast_columns} FROM forecast"
    stats = f"""{SERIES}, round(avg(p10), 6) AS p10_avg, round(avg(p50), 6) AS p50_avg, round(avg(p90), 6) AS p90_avg,
        CASE WHEN arg_max(p50, ds) > arg_min(p50, ds) THEN 'increasing' ELSE 'decreasing' END AS trend,
        round(stddev_pop(p50), 6) AS volatility,
        round(CASE WHEN avg(p50) > 0 THEN greatest(0.0, least(100.0, 100 - avg(p90 - p10) / avg(p50) * 100)) ELSE 50.0 END, 6) AS confidence_score"""
    q["forecast_stats"] = f"WITH {PAIR_CHAIN} SELECT {stats} FROM forecast GROUP BY {SERIES}"
    q["analyst_payload"] = f"""WITH {PAIR_CHAIN}, stats AS (SELECT {stats} FROM forecast GROUP BY {SERIES})
      SELECT {SERIES}, CAST(row_number() OVER (PARTITION BY "CustomerID", "FacilityID" ORDER BY "ProductID") - 1 AS INTEGER) AS position,
        p50_avg, trend, confidence_score FROM stats"""
    q["forecast_insight_stats"] = f"""WITH {SCORED_CHAIN}
      SELECT item_id, CASE WHEN arg_max(p50, ts) > arg_min(p50, ts) THEN 'increasing' ELSE 'decreasing' END AS trend,
        round(CASE WHEN avg(p50) > 0 THEN stddev_pop(p50) / avg(p50) ELSE 0 END, 6) AS volatility,
        round(CASE WHEN avg(p50) > 0 THEN 100 - avg(p90 - p10) / avg(p50) * 100 ELSE 0 END, 6) AS confidence,
        round(avg(p90 - p10), 6) AS confidence_width, round(avg(p50), 6) AS avg_prediction,
        round(max(p50), 6) AS max_prediction, round(min(p50), 6) AS min_prediction FROM scored GROUP BY item_id"""
    q["forecast_accuracy"] = f"WITH {SCORED_CHAIN} SELECT item_id, {METRICS} FROM stepped GROUP BY item_id"
    q["forecast_accuracy_total"] = f"WITH {SCORED_CHAIN} SELECT {METRICS} FROM stepped"
    losses = ", ".join(
        f"round(2 * sum(greatest({s} * (y - p{n}), ({s} - 1) * (y - p{n}))) / sum(abs(y)), 6) AS wql_p{n}"
        for n, s in [(10, "0.1::DOUBLE"), (50, "0.5::DOUBLE"), (90, "0.9::DOUBLE")]
    )
    q["result_records"] = f"""WITH {SCORED_CHAIN}
      SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY ts) - 1 AS INTEGER) AS position,
        round(sqrt(avg((y - p50) * (y - p50)) OVER (PARTITION BY item_id)), 6) AS rmse, round(y, 6) AS actual_values,
        round(p50, 6) AS predicted_values, round(p10, 6) AS p10_values, round(p90, 6) AS p90_values FROM scored"""
    q["quantile_loss"] = f"WITH {SCORED_CHAIN} SELECT {losses}, round(sum(abs(y - p50)) / sum(abs(y)), 6) AS wape FROM scored"

    # recommendations
    q["recommendations"] = f"WITH {RECOMMENDED_CHAIN} SELECT * FROM recommended"
    q["ordering_schedule"] = f"""WITH {RECOMMENDED_CHAIN}
      SELECT "CustomerID", "FacilityID", optimal_order_date AS "date", string_agg(product_name, ', ' ORDER BY rank) AS products,
        CAST(sum(recommended_quantity) AS BIGINT) AS total_items FROM recommended GROUP BY ALL"""
    q["recommendation_insights"] = f"""WITH {RECOMMENDED_CHAIN},
      analyzed AS (SELECT "CustomerID", "FacilityID", count(DISTINCT "ProductID") AS total_products FROM forecast GROUP BY ALL),
      counted AS (SELECT "CustomerID", "FacilityID", count(*) AS recommended, count(*) FILTER (confidence > 80) AS high_confidence,
        avg(confidence) AS ac FROM recommended GROUP BY ALL)
      SELECT "CustomerID", "FacilityID", total_products, recommended, high_confidence, round(ac, 6) AS avg_confidence,
        printf('Analysis based on %d products with varying demand patterns. Consider seasonal factors for procurement planning.', total_products) AS seasonal_trends,
        printf('%d/%d recommendations have high confidence (>80%%). Average confidence: %.1f%%', high_confidence, recommended, ac) AS risk_assessment,
        'Consider consolidating orders by date to reduce procurement costs. Monitor high-volatility products for inventory optimization.' AS cost_optimization
      FROM analyzed JOIN counted USING ("CustomerID", "FacilityID")"""
    q["high_confidence_products"] = f"""WITH {RECOMMENDED_CHAIN}
      SELECT "CustomerID", "FacilityID", count(*) FILTER (confidence > 80) AS high_confidence_products FROM recommended GROUP BY ALL"""
    q["prediction_summary"] = f"""WITH {RECOMMENDED_CHAIN},
      numbered AS (SELECT *, row_number() OVER (PARTITION BY {SERIES} ORDER BY ds) AS rn FROM forecast),
      demand AS (SELECT "CustomerID", "FacilityID", count(DISTINCT "ProductID") AS total_products_analyzed,
        round(sum(p50) FILTER (rn <= 7), 6) AS total_predicted_demand_7days FROM numbered GROUP BY ALL),
      picked AS (SELECT "CustomerID", "FacilityID", count(*) AS recommended_products_count,
        count(*) FILTER (confidence > 80) AS high_confidence_products, round(avg(confidence), 6) AS avg_confidence,
        max(CASE WHEN rank = 1 THEN optimal_order_date END) AS next_suggested_order_date FROM recommended GROUP BY ALL)
      SELECT * FROM demand JOIN picked USING ("CustomerID", "FacilityID")"""
    level = "CASE trend WHEN 'increasing' THEN 3 WHEN 'stable' THEN 2 ELSE 1 END"
    q["procurement_report"] = f"""WITH {RECOMMENDED_CHAIN}
      SELECT * EXCLUDE (reasoning, combined_score), CASE trend WHEN 'increasing' THEN 'High' WHEN 'stable' THEN 'Medium' ELSE 'Low' END AS priority_level,
        {level} AS priority_value FROM recommended"""
    q["procurement_top_quantities"] = f"""WITH {RECOMMENDED_CHAIN}
      SELECT "CustomerID", "FacilityID", product_id, recommended_quantity, confidence FROM recommended
      ORDER BY recommended_quantity DESC, product_id, "CustomerID", "FacilityID" LIMIT 10"""
    q["prediction_bundle"] = f"""WITH {RECOMMENDED_CHAIN},
      sizes AS (SELECT "CustomerID", "FacilityID", CAST(count(DISTINCT "ProductID") AS INTEGER) AS n_products FROM forecast GROUP BY ALL),
      picked AS (SELECT "CustomerID", "FacilityID", CAST(count(*) AS INTEGER) AS n_recommended, arg_min(product_id, rank) AS best_product,
        CAST(arg_min(optimal_order_date, rank) AS VARCHAR) AS first_date, round(avg(confidence), 6) AS avg_confidence FROM recommended GROUP BY ALL)
      SELECT "CustomerID" AS "customerId", "FacilityID" AS "facilityId", as_of AS "timestamp", n_products, n_recommended,
        best_product, first_date, avg_confidence FROM sizes JOIN picked USING ("CustomerID", "FacilityID"), next_day"""
    q["recommendation_defaults"] = f"""WITH {RECOMMENDED_CHAIN},
      analyzed AS (SELECT "CustomerID", "FacilityID", count(DISTINCT "ProductID") AS total FROM forecast GROUP BY ALL),
      counted AS (SELECT "CustomerID", "FacilityID", count(*) AS r, count(*) FILTER (confidence > 80) AS h, avg(confidence) AS ac FROM recommended GROUP BY ALL)
      SELECT "CustomerID" AS "customerId", "FacilityID" AS "facilityId",
        CAST(CASE WHEN "FacilityID" % 3 = 2 THEN r ELSE 0 END AS INTEGER) AS n_recommended,
        CASE "FacilityID" % 3 WHEN 0 THEN 'No trend analysis available' WHEN 1 THEN 'Steady'
          ELSE printf('Analysis based on %d products with varying demand patterns. Consider seasonal factors for procurement planning.', total) END AS seasonal_trends,
        CASE "FacilityID" % 3 WHEN 0 THEN 'Risk assessment unavailable' WHEN 1 THEN 'Risk Assessment unavailable'
          ELSE printf('%d/%d recommendations have high confidence (>80%%). Average confidence: %.1f%%', h, r, ac) END AS risk_assessment,
        CASE "FacilityID" % 3 WHEN 0 THEN 'Cost optimization suggestions unavailable' WHEN 1 THEN 'Cost Optimization unavailable'
          ELSE 'Consider consolidating orders by date to reduce procurement costs. Monitor high-volatility products for inventory optimization.' END AS cost_optimization
      FROM analyzed JOIN counted USING ("CustomerID", "FacilityID")"""

    # run registry
    q["registry_freshness"] = """SELECT user_id AS kind, CAST(max(ts) AS DATE) AS latest_end_time,
      CAST(max(ts) < TIMESTAMP '2024-02-06' - INTERVAL 7 DAY AS INTEGER) AS retrain FROM events GROUP BY 1"""
    q["registry_retention"] = """SELECT user_id AS kind, event_id AS name,
      CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 2 THEN 'keep' ELSE 'delete' END AS action FROM events"""
    q["run_metrics"] = """WITH finals AS (SELECT user_id, event_type, arg_max(value, ts) AS v FROM events GROUP BY 1, 2)
      SELECT user_id AS name, (SELECT CAST(max(ts) AS DATE) FROM events e WHERE e.user_id = f.user_id) AS end_time,
        event_type AS metric, round(v, 6) AS "value" FROM finals f"""
    return q
