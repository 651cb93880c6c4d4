import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orderlens.operators import quality
from orderlens.operators.quantiles import exact_quantiles, find_quantiles
from orderlens.sources.conform import conform
from orderlens.sources.files import empty_order_lines

AS_OF = dt.date(2025, 1, 1)


def _status(checks, check, scope):
    return checks.where((F.col("check") == check) & (F.col("scope") == scope)).first()["status"]


@pytest.fixture
def base(spark):
    rows = [
        (1, 10, 100, 1000, "a", "x", 5, "v", "07/08/2024", 1.0, 2.0),
        (1, 11, 101, 1001, "b", "x", 5, "v", "07/09/2024", 2.0, 3.0),
        (2, 10, 102, 1000, "a", "x", 6, "w", "08/10/2024", 3.0, 4.0),
    ]
    return spark.createDataFrame(
        rows,
        "CustomerID int, FacilityID int, OrderID int, ProductID int, ProductName string, CategoryName string, "
        "VendorID int, VendorName string, CreateDate string, OrderUnits double, Price double",
    )


def test_clean_table_passes(base):
    checks = quality.validation_checks(base, AS_OF)
    assert {r["status"] for r in checks.collect()} == {"ok"}
    assert quality.verdict(checks).first()["validation_summary"] == "PASSED"
    assert quality.quality_score(base).first()["data_quality_score"] == 100
    assert quality.quality_recommendations(quality.quality_score(base)).count() == 1


def test_missing_columns(base):
    broken = base.drop("CustomerID", "ProductID")
    assert quality.missing_columns(broken) == ["CustomerID", "ProductID"]
    assert quality.verdict(quality.validation_checks(broken, AS_OF)).first()["validation_summary"] == "FAILED"
    raw = base.withColumnRenamed("OrderUnits", "Quantity")
    assert quality.missing_columns(raw, quality.RAW_REQUIRED_COLUMNS) == []


def test_unexpected_type_is_a_warning(base):
    text = base.withColumn("OrderUnits", F.col("OrderUnits").cast("string")).drop("Price")
    assert quality.unexpected_types(text) == [("OrderUnits", "string")]
    assert quality.unexpected_types(base) == []


@pytest.mark.parametrize("share, expected", [(2, "issue"), (3, "issue")])
def test_excessive_nulls(base, share, expected):
    broken = base.withColumn("CustomerID", F.when(F.col("OrderID") >= 100 + share, F.col("CustomerID")))
    checks = quality.validation_checks(broken, AS_OF)
    assert _status(checks, "excessive_nulls", "CustomerID") == expected


def test_bad_dates_and_values(base):
    broken = base.withColumns(
        {
            "CreateDate": F.when(F.col("OrderID") == 100, "invalid-date").otherwise(F.col("CreateDate")),
            "OrderUnits": F.when(F.col("OrderID") == 101, -5.0).otherwise(F.col("OrderUnits")),
            "Price": F.when(F.col("OrderID") == 102, 0.0).otherwise(F.col("Price")),
        }
    )
    checks = quality.validation_checks(broken, AS_OF)
    assert _status(checks, "invalid_dates", "CreateDate") == "warning"
    assert _status(checks, "negative_values", "OrderUnits") == "warning"
    assert _status(checks, "zero_values", "Price") == "warning"
    score = quality.quality_score(broken).first()
    assert score["validity_issues"] == 2
    found = quality.date_checks(broken, dt.date(2035, 1, 1)).first()
    assert found["too_old"] and not found["too_new"] and found["invalid_dates"] == 1


def test_verdict_counts_warnings(spark):
    for n, expected in [(5, "PASSED"), (6, "PASSED_WITH_WARNINGS")]:
        rows = [("c", str(i), 1.0, 0.0, "warning", "") for i in range(n)]
        assert quality.verdict(spark.createDataFrame(rows, quality.CHECK_ROW)).first()["validation_summary"] == expected


def test_duplicates_and_dependencies(base):
    twice = base.unionByName(base.limit(1))
    assert quality.duplicate_rows(twice).first()["duplicate_records"] == 1
    renamed = base.withColumn("ProductName", F.col("OrderID").cast("string"))
    assert [tuple(r) for r in quality.dependency_violations(renamed).collect()] == [(1000, 2)]


def test_empty_table(spark):
    empty = empty_order_lines(spark)
    assert quality.verdict(quality.validation_checks(empty, AS_OF)).first()["validation_summary"] == "PASSED"
    assert quality.quality_score(empty).first()["rows"] == 0
    assert quality.numeric_profile(empty).count() == 0
    assert quality.business_rules(empty).where("passed = 1").count() == 0


def test_text_in_numeric_columns(spark):
    frame = spark.createDataFrame([("1", "x", "2.5"), ("2", "3", "n/a")], "Product_ID string, Quantity string, unit_price string")
    rows = conform(frame).select("ProductID", "OrderUnits", "Price").collect()
    assert [tuple(r) for r in rows] == [("1", None, 2.5), ("2", 3.0, None)]


def test_profile_matches_formulas(spark):
    values = [0.0, 1.0, 1.5, 2.0, 50.0, 3.0, float("nan")]
    frame = spark.createDataFrame([(v,) for v in values], "x double").replace(float("nan"), None)
    row = quality.numeric_profile(frame).first()
    x = np.array(values[:-1])
    n, d = len(x), x - x.mean()
    g1 = (d**3).mean() / (d**2).mean() ** 1.5
    g2 = (d**4).mean() / (d**2).mean() ** 2 - 3
    assert row["n"] == n and row["zeros"] == 1 and row["outliers"] == 1
    assert row["skewness"] == pytest.approx(g1 * math.sqrt(n * (n - 1)) / (n - 2))
    assert row["kurtosis"] == pytest.approx((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    assert row["q25"] == pytest.approx(np.quantile(x, 0.25)) and row["std"] == pytest.approx(x.std(ddof=1))


def test_constant_column_has_no_skewness(spark):
    row = quality.numeric_profile(spark.range(10).select(F.lit(3.0).alias("x"))).first()
    assert row["skewness"] is None and row["kurtosis"] is None and row["median"] == 3.0


@pytest.mark.parametrize("shape", ["uniform", "hot", "heavy", "wide", "few"])
def test_quantiles_by_narrowing(spark, shape):
    """Against numpy, with few buckets so that it takes several passes."""
    rng = np.random.default_rng(5)
    x = {
        "uniform": rng.uniform(-5, 5, 5000),
        "hot": np.where(rng.random(5000) < 0.4, 7.0, rng.normal(0, 100, 5000)),
        "heavy": rng.pareto(0.3, 5000),
        "wide": np.array([-1.7e308, 1.7e308, *rng.normal(0, 1, 200)]),
        "few": rng.integers(0, 3, 5000).astype(float),
    }[shape]
    frame = spark.createDataFrame([(float(v), float(-v)) for v in x], "x double, y double")
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = exact_quantiles(frame, ["x", "y"], probabilities, buckets=64)
    for row in found.collect():
        data = x if row["column"] == "x" else -x
        assert row["value"] == pytest.approx(np.quantile(data, row["probability"]), rel=1e-12)


@pytest.mark.parametrize("shape", ["infinite", "tiny", "magnitudes", "zeros"])
def test_quantiles_of_odd_values_end_in_six_passes(spark, monkeypatch, shape):
    rng = np.random.default_rng(6)
    x = {
        "infinite": np.array([np.inf, np.inf, -np.inf, *rng.normal(0, 1, 198)]),
        "tiny": np.array([0.0, 5e-324, 1e-323, -5e-324, 1e-310]),
        "magnitudes": np.array([s * 10.0**e for e in range(-300, 299) for s in (1, -1)] + [0.0]),
        "zeros": np.array([0.0, -0.0, 0.0]),
    }[shape]
    passes = []
    counted = type(spark.range(1)).collect
    monkeypatch.setattr(type(spark.range(1)), "collect", lambda self: passes.append(1) or counted(self))
    frame = spark.createDataFrame([(float(v),) for v in [*x, float("nan")]] + [(None,)], "x double")
    probabilities = [0.0, 0.25, 0.5, 0.75, 1.0]
    found = find_quantiles(frame, ["x"], probabilities)
    assert len(passes) <= 6 + 1  # and the facts
    ordered = sorted(x.tolist())
    for p in probabilities:
        place = p * (len(ordered) - 1)
        a, b = ordered[int(place)], ordered[-int(-place // 1)] if place % 1 else ordered[int(place)]
        expected = a if a == b else a * (1 - place % 1) + b * (place % 1)
        assert found["x", p] == pytest.approx(expected, rel=1e-12, abs=0)


def test_quantiles_without_values(spark):
    frame = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert find_quantiles(frame, ["x"], [0.5]) == {("x", 0.5): None}


def test_categorical_ties_and_nulls(spark):
    frame = spark.createDataFrame([(v,) for v in ["b", "a", "a", "b", "c", None]], "x string")
    row = quality.categorical_profile(frame).first()
    assert (row["most_frequent"], row["most_frequent_count"]) == ("a", 2)
    assert (row["least_frequent"], row["unique_values"]) == ("c", 3)
    assert row["cardinality_ratio"] == 0.5
    assert [r["value"] for r in quality.categorical_top(frame, k=2).orderBy("rank").collect()] == ["a", "b"]


def test_report_in_one_row(base):
    report = quality.validation_report(base, AS_OF).first()
    assert report["validation_summary"] == "PASSED" and report["total_records"] == 3
    assert report["business_rules_passed"] + report["business_rules_failed"] == 5
    assert quality.column_kinds(base)["total_columns"] == 11
