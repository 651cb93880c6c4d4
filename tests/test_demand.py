import datetime as dt
import statistics

import pytest
from pyspark.sql import functions as F

from orderlens.operators import demand, explore, lookups, registry
from orderlens.schema import CUSTOMER_PRODUCT_COLUMNS, PATTERN_COLUMNS, SERIES
from orderlens.sources.conform import conform
from orderlens.sources.warehouse import order_lines


@pytest.fixture
def example(spark):
    rows = [
        ("C1", "F1", "P1", "2024-01-01", 10.0),
        ("C1", "F1", "P1", "2024-01-05", 15.0),
        ("C1", "F1", "P2", "2024-01-03", 5.0),
        ("C2", "F2", "P1", "2024-01-02", 20.0),
        ("C2", "F2", "P1", "2024-01-10", 25.0),
    ]
    frame = spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, CreateDate string, OrderUnits double")
    return conform(frame).fillna({"ProductName": "n", "CategoryName": "c", "VendorName": "v"})


def test_patterns_worked_example(example):
    found = demand.demand_patterns(demand.daily_demand(example), demand.product_table(example))
    assert found.columns == PATTERN_COLUMNS
    by = {(r["CustomerID"], r["ProductID"]): r for r in found.collect()}
    a = by["C1", "P1"]
    assert (a["TotalOrders"], a["AvgQuantity"], a["StdQuantity"]) == (2, 12.5, 2.5)
    assert (a["CoefficientOfVariation"], a["TrendSlope"], a["AvgDaysBetweenOrders"]) == (0.2, 0.0, 4.0)
    b = by["C1", "P2"]
    assert (b["TotalOrders"], b["StdQuantity"], b["AvgDaysBetweenOrders"]) == (1, 0.0, None)
    c = by["C2", "P1"]
    assert (c["AvgQuantity"], c["StdQuantity"], c["AvgDaysBetweenOrders"]) == (22.5, 2.5, 8.0)


def test_trend_from_three_days(spark):
    rows = [("C", "F", "P", dt.date(2024, 1, d), float(q)) for d, q in [(9, 5), (1, 1), (5, 3)]]
    daily = spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, Date date, Quantity double")
    assert demand.demand_patterns(daily).first()["TrendSlope"] == pytest.approx(2.0)


def test_simple_patterns_use_lines_and_sample_spread(spark):
    rows = [("C", "F", "PROD7", "2024-01-01", 1.0), ("C", "F", "PROD7", "2024-01-01", 3.0)]
    lines = conform(spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, CreateDate string, OrderUnits double"))
    row = demand.demand_patterns_simple(lines).first()
    assert row["TotalOrders"] == 2 and row["StdQuantity"] == pytest.approx(statistics.stdev([1, 3]))
    assert (row["ProductName"], row["CategoryName"], row["VendorName"]) == ("Product PROD7", "General", "Vendor7")
    assert row["MedianQuantity"] == row["AvgQuantity"] == 2.0 and row["AvgDaysBetweenOrders"] == 0.0


def test_products_with_many_names_do_not_multiply_demand(spark):
    rows = [("C", "F", "P", f"name {i}", "2024-01-0%d" % (i % 3 + 1), 1.0) for i in range(9)]
    lines = conform(spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, ProductName string, CreateDate string, OrderUnits double"))
    products = demand.product_table(lines)
    assert products.count() == 1 and products.first()["ProductName"] == "name 0"
    enriched = demand.enrich(demand.daily_demand(lines), products)
    assert enriched.count() == 3 and enriched.agg(F.sum("Quantity")).first()[0] == 9


def test_null_keys_are_left_out_and_counts_stand_in_for_units(spark):
    rows = [("C", "F", "P", "2024-01-01"), ("C", "F", "P", "2024-01-01"), (None, "F", "P", "2024-01-01"), ("C", "F", "P", "junk")]
    lines = conform(spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, CreateDate string"), fill_absent=False)
    assert [tuple(r) for r in demand.daily_demand(lines).collect()] == [("C", "F", "P", dt.date(2024, 1, 1), 2.0)]


def test_demand_adds_up(spark, folder):
    lines = order_lines(spark, folder)
    total = lines.agg(F.sum("OrderUnits")).first()[0]
    daily = demand.daily_demand(lines)
    assert daily.agg(F.sum("Quantity")).first()[0] == pytest.approx(total)
    assert demand.densify(daily).agg(F.sum("Quantity")).first()[0] == pytest.approx(total)
    totals = demand.customer_daily(lines)
    long = demand.customer_forecast_long(totals)
    assert long.count() == 3 * totals.count()
    units = long.where("metric_type = 'TOTAL_UNITS'").agg(F.sum("target_value")).first()[0]
    assert units == pytest.approx(total)


def test_result_does_not_depend_on_partitions(spark, folder):
    def run(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows = demand.demand_patterns(demand.daily_demand(order_lines(spark, folder, "type"))).collect()
        return sorted((r["CustomerID"], r["FacilityID"], r["ProductID"], r["TotalOrders"], round(r["TrendSlope"], 9)) for r in rows)

    try:
        assert run("1") == run("50")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_merged_states_equal_one_pass(spark, folder):
    lines = order_lines(spark, folder, "type")
    parts = demand.pattern_state(lines.withColumn("chunk", F.pmod("OrderID", F.lit(7))), ["chunk"])
    merged = {tuple(r[c] for c in SERIES): r for r in demand.merge_pattern_states(parts).collect()}
    for row in demand.demand_patterns_simple(lines).collect():
        other = merged[tuple(row[c] for c in SERIES)]
        for name in PATTERN_COLUMNS[6:]:
            if isinstance(row[name], float):
                assert other[name] == pytest.approx(row[name], rel=1e-9, abs=1e-9)
            else:
                assert other[name] == row[name]


def test_one_hot_series(spark):
    """A third of all lines in one series, and on one day of it."""
    n = 30_000
    hot = F.col("id") % 3 == 0
    lines = spark.range(n).select(
        F.when(hot, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 500)).alias("CustomerID"),
        F.lit("f").alias("FacilityID"),
        F.lit("p").alias("ProductID"),
        F.when(hot, F.lit(dt.date(2024, 1, 1))).otherwise(F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") % 30).cast("int"))).alias("Date"),
        F.lit(1.0).alias("OrderUnits"),
    )
    daily = demand.daily_demand(lines)
    assert daily.where("CustomerID = 'hot'").first()["Quantity"] == n / 3
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in plan


def test_lookup_tables(example):
    products = lookups.product_lookup(example)
    table = lookups.customer_product_lookup(lookups.relationships(example), products)
    assert table.columns == CUSTOMER_PRODUCT_COLUMNS
    assert products.columns == ["ProductID", "ProductName", "CategoryName", "vendorName"]
    by_activity = lookups.customer_product_lookup(lookups.relationships_of(demand.daily_activity(example)), products)
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, by_activity.collect()))
    items = lookups.lookup_items(products, table)
    keys = {r["product_id"] for r in items.collect()}
    assert keys == {"P1", "P2", "P1#C1#F1", "P2#C1#F1", "P1#C2#F2"}
    assert lookups.products_of(table, " C1 ", "F1 ").count() == 2
    assert lookups.products_of(table, "C1", "F1", "P2").count() == 1
    best = lookups.top_products(table, 1).where("CustomerID = 'C1'").first()
    assert (best["ProductID"], best["OrderCount"]) == ("P1", 2)


def test_lookup_items_are_unique(spark, example, tmp_path):
    products = lookups.product_lookup(example)
    table = lookups.customer_product_lookup(lookups.relationships(example), products)
    doubled = lookups.lookup_items(products.unionByName(products), table.unionByName(table))
    assert doubled.count() == 5
    lookups.write_lookup_items(doubled, str(tmp_path / "items"))
    back = spark.read.parquet(str(tmp_path / "items"))
    assert lookups.items_of_pair(back, "C1#F1").count() == 2


def test_first_rows(example):
    daily = demand.daily_demand(example)
    assert explore.first_rows(daily, [*SERIES, "Date"], 3).count() == 3


def test_relationships_count_dated_lines_only(spark):
    columns = "CreateDate timestamp, CustomerID string, FacilityID string, ProductID string, OrderUnits double"
    lines = spark.createDataFrame([(dt.datetime(2024, 1, 1, 9), "c", "f", "p", 2.0), (None, "c", "f", "p", 1.0)], columns)
    direct = lookups.relationships(lines).collect()
    assert direct == lookups.relationships_of(demand.daily_activity(lines)).collect()
    assert direct[0]["OrderCount"] == 1
    known = spark.createDataFrame([("q", "n", "g", "v")], "ProductID string, ProductName string, CategoryName string, vendorName string")
    assert lookups.customer_product_lookup(lookups.relationships(lines), known, "inner").count() == 0


def test_retention_of_equal_runs_and_missing_times(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    runs = [("m", "a", day(3)), ("m", "a", day(3)), ("m", "b", day(2)), ("m", "c", day(1)), ("e", "x", None), (None, "y", day(1))]
    found = registry.retention(spark.createDataFrame(runs, "kind string, name string, created timestamp"))
    assert found.columns == ["kind", "name", "created", "action"] and found.count() == 6
    assert {r["name"] for r in found.where("action = 'keep'").collect()} == {"a", "b", "x", "y"}


def test_lookup_keys_with_separators(spark):
    text = "ProductID string, ProductName string, CategoryName string, vendorName string, CustomerID string, FacilityID string"
    kinds = f"{text}, OrderCount bigint, FirstOrderDate timestamp, LastOrderDate timestamp"
    rows = [(p, "n", "g", "v", c, f, 1, None, None) for p, c, f in [("a#b", "c", "d"), ("a", "b#c", "d"), ("a", "b", "c#d")]]
    table = spark.createDataFrame(rows, kinds)
    products = table.select("ProductID", "ProductName", "CategoryName", "vendorName").distinct()
    assert lookups.lookup_items(products, table).where("record_type = 'CUSTOMER_PRODUCT'").count() == 3
