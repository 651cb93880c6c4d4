import datetime as dt
import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import codes, demand, explore, forecast, recommend, registry, series
from orderlens.plans import pipeline
from orderlens.sources import files
from orderlens.sources.warehouse import order_lines

SERIES_LENGTHS = {"A": 60, "B": 42, "C": 41, "D": 30, "E": 10}


@pytest.fixture(scope="module")
def long(spark):
    """One item per length; y rises by one a day, with orders every second day."""
    rows = []
    for customer, n in SERIES_LENGTHS.items():
        for i in range(n):
            day = dt.date(2024, 1, 1) + dt.timedelta(days=2 * i)
            rows.append((f"{customer}_1_P", day, float(i + 1), customer, 1, "P", "name", f"cat {customer}", "v", day.weekday(), day.month))
    return spark.createDataFrame(
        rows,
        "item_id string, timestamp date, target_value double, customer_id string, facility_id int, "
        "product_id string, product_name string, category_name string, vendor_name string, day_of_week int, month int",
    )


@pytest.fixture(scope="module")
def instances(spark, long):
    rows, mapping = pipeline.training_sets(pipeline.stored_series(long))
    return {(r["part"], r["item_id"]): r for r in rows.collect()}, mapping


def test_instances_of_kept_series_only(instances):
    rows, mapping = instances
    assert {item for _, item in rows} == {"A_1_P", "B_1_P"}
    found = {(r["feature"], r["value"]): r["code"] for r in mapping.collect()}
    assert found == {("customer", "A"): 0, ("customer", "B"): 1, ("facility", "1"): 0,
                     ("category", "cat A"): 0, ("category", "cat B"): 1}
    train, test = rows["train", "B_1_P"], rows["test", "B_1_P"]
    assert train["start"] == test["start"] == "2024-01-01"
    assert train["target"] == [float(i + 1) for i in range(42)] and test["target"] == train["target"][:28]
    assert train["cat"] == [1, 0, 1]
    assert train["dynamic_feat"][0][:2] == [0.0, 2 / 6] and train["dynamic_feat"][1][:1] == [0.0]
    assert [len(f) for f in test["dynamic_feat"]] == [28, 28]
    assert train["product_info"]["customer_id"] == "B"


def test_inference_and_payload(spark, long, instances):
    _, mapping = instances
    frame = series.inference_instances(series.series_arrays(long), mapping)
    rows = {r["item_id"]: r for r in frame.collect()}
    assert set(rows) == {"A_1_P", "B_1_P", "C_1_P", "D_1_P"}
    d = rows["D_1_P"]
    assert len(d["target"]) == 28 and d["target"][0] == 3.0 and d["cat"] == [0, 0, 0]
    assert [len(f) for f in d["dynamic_feat"]] == [42, 42]
    last = dt.date(2024, 1, 1) + dt.timedelta(days=58)
    assert d["dynamic_feat"][0][28] == pytest.approx((last + dt.timedelta(days=1)).weekday() / 6)
    body = json.loads(series.request_payload(frame).first()["payload"])
    assert body["configuration"] == {"num_samples": 100, "output_types": ["quantiles"], "quantiles": ["0.1", "0.5", "0.9"]}
    assert set(body["instances"][0]) == {"start", "target", "cat", "dynamic_feat"}


def test_json_lines_round_trip(spark, instances, long, tmp_path):
    rows, _ = pipeline.training_sets(series.series_arrays(long))
    files.write_instances(rows, str(tmp_path / "i"))
    back = files.read_instances(spark, str(tmp_path / "i" / "part=test"))
    assert back.count() == 2 and back.columns == ["start", "target", "cat", "dynamic_feat", "item_id"]
    extended = series.extend_instances(back.withColumn(
        "dynamic_feat", F.concat("dynamic_feat", F.array(F.array(F.lit(7.0), F.lit(9.0))))), 14)
    row = extended.where("item_id = 'B_1_P'").first()
    assert len(row["dynamic_feat"][0]) == 42 and row["dynamic_feat"][2] == [7.0, 9.0] + [9.0] * 14
    first = dt.date(2024, 1, 1) + dt.timedelta(days=28)
    assert row["dynamic_feat"][0][28] == pytest.approx(first.weekday() / 6)
    assert row["dynamic_feat"][1][28] == pytest.approx((first.month - 1) / 11)


def test_codes_follow_value_order(spark):
    frame = spark.range(1000).select(
        F.concat(F.lit("c"), F.col("id") % 37).alias("customer_id"),
        (F.col("id") % 101).alias("facility_id"),
        (F.col("id") + 2**53).alias("category_name"),
    )
    found = sorted(map(tuple, codes.category_codes(frame).collect()))
    expected = [("customer", v, i) for i, v in enumerate(sorted({f"c{i % 37}" for i in range(1000)}))]
    expected += [("facility", str(i), i) for i in range(101)]  # numbers keep their order, large ones too
    expected += [("category", str(i + 2**53), i) for i in range(1000)]
    assert found == sorted(expected)


def test_codes_stored_and_defaults(spark, instances, tmp_path):
    _, mapping = instances
    empty, defaults = codes.load_codes(spark, str(tmp_path / "none"))
    assert empty.count() == 0 and defaults == [4, 50, 24]
    codes.save_codes(mapping, str(tmp_path / "codes"))
    stored, sizes = codes.load_codes(spark, str(tmp_path / "codes"))
    assert stored.count() == 5 and sizes == [2, 1, 2]
    rows = spark.createDataFrame([("B", 1, "nope")], "customer_id string, facility_id int, category_name string")
    row = codes.encode(rows, stored, [1, 1, 2]).first()
    assert (row["customer_cat"], row["facility_cat"], row["category_cat"]) == (0, 0, 0)


def test_context_and_split(long):
    context = series.series_context(long).where("item_id = 'A_1_P'").orderBy("position").collect()
    assert [r["target_value"] for r in context] == [float(v) for v in range(33, 61)]
    split = series.holdout_split(long)
    counts = {(r["item_id"], r["split"]): r["count"] for r in split.groupBy("item_id", "split").count().collect()}
    assert counts == {("A_1_P", "train"): 46, ("A_1_P", "test"): 14, ("B_1_P", "train"): 28, ("B_1_P", "test"): 14}


def _reference_quantiles(points, day):
    own = [y for d, y in points if d.weekday() == day.weekday()] or [y for _, y in points]
    return [float(np.quantile(own, q)) for q in (0.1, 0.5, 0.9)]


def test_seasonal_forecast_and_model_contract(spark, long):
    short = long.where("item_id = 'E_1_P'").limit(3)
    as_of = dt.date(2024, 6, 1)
    points = [(r["timestamp"], r["target_value"]) for r in short.collect()]
    for row in forecast.seasonal_forecast(short, F.lit(as_of)).collect():
        assert [row["p10"], row["p50"], row["p90"]] == pytest.approx(_reference_quantiles(points, row["ds"]))
        assert row["p10"] <= row["p50"] <= row["p90"] and row["mean"] == row["p50"]

    def last_value(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf["y"].iloc[-1]
        return pd.DataFrame({"item_id": pdf["item_id"].iloc[:1], "ds": [as_of], "p10": [y], "p50": [y], "p90": [y]})

    found = {r["item_id"]: r["p50"] for r in forecast.model_forecast(long, last_value).collect()}
    assert found == {f"{c}_1_P": float(n) for c, n in SERIES_LENGTHS.items()}


def test_accuracy_against_numpy(long):
    scored = forecast.evaluate_holdout(series.holdout_split(long))
    rows = scored.where("item_id = 'A_1_P'").orderBy("timestamp").collect()
    points = [(dt.date(2024, 1, 1) + dt.timedelta(days=2 * i), float(i + 1)) for i in range(46)]
    assert [r["p50"] for r in rows] == pytest.approx([_reference_quantiles(points, r["timestamp"])[1] for r in rows])
    y, p = (np.array([r[c] for r in rows]) for c in ("target_value", "p50"))
    found = forecast.forecast_accuracy(scored).where("item_id = 'A_1_P'").first()
    assert found["rmse"] == pytest.approx(np.sqrt(((y - p) ** 2).mean()))
    assert found["mape"] == pytest.approx(np.abs((y - p) / y).mean() * 100)
    assert found["mase"] == pytest.approx(np.abs(y - p).mean() / np.abs(np.diff(y)).mean())
    record = forecast.result_records(scored).where("item_id = 'A_1_P'").first()
    assert record["actual_values"] == list(y) and record["metrics"]["rmse"] == found["rmse"]
    assert forecast.forecast_accuracy_total(scored).first()["n"] == 28


def test_accuracy_is_null_where_undefined(spark):
    rows = [("i", dt.date(2024, 1, d), 0.0, 1.0) for d in (1, 2)]
    scored = spark.createDataFrame(rows, "item_id string, timestamp date, target_value double, p50 double")
    found = forecast.forecast_accuracy(scored).first()
    assert found["mape"] is None and found["mase"] is None and found["mae"] == 1.0


def test_quantile_arrays_to_rows(spark):
    p50 = [2.5, 2.3, 2.7, 2.1, 2.8, 2.4, 2.2]
    p10, p90 = [v - 1 for v in p50], [v + 1 for v in p50]
    frame = spark.createDataFrame([("i", p10, p50, p90)], "item_id string, p10 array<double>, p50 array<double>, p90 array<double>")
    rows = forecast.quantiles_to_rows(frame, F.lit(dt.date(2024, 1, 1))).orderBy("ds").collect()
    assert [r["p50"] for r in rows] == p50 and rows[-1]["ds"] == dt.date(2024, 1, 7)
    assert forecast.quantiles_to_rows(frame, F.lit(dt.date(2024, 1, 1)), 3).count() == 3


def _lookup(spark, counts):
    return spark.createDataFrame(
        [("c", "f", p, f"name {p}", "cat", "v", n, dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1)) for p, n in counts.items()],
        "CustomerID string, FacilityID string, ProductID string, ProductName string, CategoryName string, "
        "vendorName string, OrderCount long, FirstOrderDate timestamp, LastOrderDate timestamp",
    )


def test_baseline_forecast(spark):
    lookup = _lookup(spark, {"a": 3, "b": 25, **{f"x{i}": 1 for i in range(12)}})
    as_of = F.lit(dt.date(2024, 3, 1))
    rows = forecast.baseline_forecast(lookup, as_of).collect()
    assert len(rows) == 14 * 7 and {r["ProductID"] for r in rows if r["OrderCount"] > 1} == {"a", "b"}
    b = next(r for r in rows if r["ProductID"] == "b")
    assert (b["p10"], b["p50"], b["p90"], b["mean"], b["mock_data"]) == (1.0, 2.0, 4.0, 2.0, False)
    fallback = next(r for r in forecast.fallback_forecast(lookup, as_of).collect() if r["ProductID"] == "b")
    assert fallback["p50"] == 25.0 and fallback["mock_data"]


def test_recommendations_by_hand(spark):
    lookup = _lookup(spark, {"up": 100, "down": 10, "zero": 1}).crossJoin(spark.range(2).withColumnRenamed("id", "i"))
    p50 = F.when(F.col("ProductID") == "up", 10 + 2.5 * F.col("i")).when(F.col("ProductID") == "down", 4 - F.col("i")).otherwise(0.0).cast("double")
    rows = lookup.withColumns({"p50": p50, "p10": p50 * 0.9, "p90": p50 * 1.1, "mean": p50,
                               "ds": F.date_add(F.lit(dt.date(2024, 3, 1)), F.col("i").cast("int"))})
    as_of = F.lit(dt.date(2024, 3, 1))
    outlook = recommend.product_outlook(rows, as_of)
    up, down, zero = recommend.recommendations(outlook).orderBy("rank").collect()
    assert (up["product_id"], up["recommended_quantity"], up["confidence"]) == ("up", 12, 90)
    assert up["optimal_order_date"] == dt.date(2024, 3, 2) and down["optimal_order_date"] == dt.date(2024, 3, 3)
    assert up["reasoning"] == "Predicted avg demand: 11.2, trend: increasing, historical orders: 100"
    assert up["combined_score"] == pytest.approx(11.25 * 0.7 + 0.3 + 2.5 * 0.1)
    assert (zero["confidence"], zero["recommended_quantity"], zero["trend"]) == (60, 1, "stable")
    assert recommend.recommendations(outlook, 1).count() == 1
    schedule = {r["date"]: r for r in recommend.ordering_schedule(recommend.recommendations(outlook)).collect()}
    assert schedule[dt.date(2024, 3, 2)]["products"] == ["name up", "name zero"]
    summary = recommend.prediction_summary(outlook).first()
    assert summary["high_confidence_products"] == 2 and summary["total_predicted_demand_7days"] == 22.5 + 7.0
    counted = recommend.high_confidence_products(rows, recommend.recommendations(outlook)).first()
    assert counted["high_confidence_products"] == 2
    bundle = recommend.prediction_bundle(outlook, as_of).first()
    assert [p["product_id"] for p in bundle["productPredictions"]] == ["up", "down", "zero"]
    assert bundle["productPredictions"][0]["predictions"]["2024-03-02"]["p50"] == 12.5
    plan = bundle["recommendations"]["ordering_schedule"]
    assert [(s["date"], s["products"], s["total_items"]) for s in plan] == [
        ("2024-03-02", ["name up", "name zero"], 13), ("2024-03-03", ["name down"], 3)]
    assert bundle["recommendations"]["insights"]["risk_assessment"].startswith("2/3 recommendations")
    ids = {recommend.prediction_bundle(outlook, as_of).first()["id"] for _ in range(2)}
    assert len(ids) == 1


def test_report_order(spark):
    rows = [("a", "LOW", 90, 1), ("b", "high", 10, 5), ("c", None, 99, 9), ("d", "Medium", 50, 3)]
    frame = spark.createDataFrame(rows, "product_id string, priority_level string, confidence int, recommended_quantity int")
    ids = lambda df: [r["product_id"] for r in df.collect()]
    assert ids(recommend.procurement_report(frame, ["product_id"])) == ["b", "d", "a", "c"]
    assert ids(recommend.procurement_report(frame.drop("priority_level"), ["product_id"])) == ["c", "a", "d", "b"]
    assert ids(recommend.top_quantities(frame, ["product_id"], 2)) == ["c", "b"]


def test_response_defaults(spark):
    answers = spark.createDataFrame(
        [(1, 'ok {"recommended_products": [{"product_id": "p", "confidence": 9}], "insights": {"seasonal_trends": "t"}} bye'), (2, "nothing"), (3, "{}")],
        "i int, response string",
    )
    parsed = recommend.parse_response(answers).select("i", "recommendations.*")
    rows = {r["i"]: r for r in recommend.with_response_defaults(parsed).collect()}
    assert rows[1]["recommended_products"][0]["confidence"] == 9 and rows[1]["ordering_schedule"] == []
    assert rows[1]["insights"]["risk_assessment"] == "Risk Assessment unavailable"
    assert rows[2]["recommended_products"] == [] and rows[2]["insights"]["seasonal_trends"] == "No trend analysis available"
    assert rows[3]["insights"]["cost_optimization"] == "Cost optimization suggestions unavailable"


def test_registry(spark):
    t = dt.datetime(2024, 1, 10)
    runs = spark.createDataFrame(
        [("model", f"m{i}", t + dt.timedelta(days=i)) for i in range(4)] + [("endpoint", "e", t)],
        "kind string, name string, created timestamp",
    )
    kept = {r["name"] for r in registry.retention(runs).where("action = 'keep'").collect()}
    assert kept == {"m2", "m3", "e"}
    fresh = registry.freshness(runs, F.lit(dt.date(2024, 1, 20)), end="created").first()
    assert fresh["latest_end_time"] == dt.datetime(2024, 1, 13) and not fresh["retrain"]
    assert registry.freshness(runs, F.lit(dt.date(2024, 1, 21)), end="created").first()["retrain"]
    assert registry.freshness(runs.limit(0), F.lit(dt.date(2024, 1, 21)), end="created").first()["retrain"]
    metrics = spark.createDataFrame(
        [("r1", "loss", 2.0, t), ("r1", "loss", 1.0, t + dt.timedelta(hours=1)), ("r2", "rmse", 3.0, t + dt.timedelta(days=1))],
        "name string, metric string, value double, end_time timestamp",
    )
    rows = registry.run_metrics(metrics).collect()
    assert [(r["name"], r["metrics"]) for r in rows] == [("r2", {"rmse": 3.0}), ("r1", {"loss": 1.0})]


def test_evaluation_job(spark, folder):
    daily = demand.daily_demand(order_lines(spark, folder, "type"))
    per_series, total = pipeline.evaluate(demand.product_forecast_long(daily))
    lengths = explore.series_lengths(daily, ["CustomerID", "FacilityID", "ProductID"])
    assert per_series.count() == lengths.where("length >= 42").count() == 22
    assert total.first()["n"] == 22 * 14


def test_ids_with_separators_do_not_mix_series(spark):
    """(a_b, c, p) and (a, b_c, p), with the same days, stay two series in every step."""
    ids = [("a_b", "c", "p", 1.0), ("a", "b_c", "p", 100.0), ("a\\", "_b_c", "p", 7.0)]
    day = dt.date(2024, 1, 1)
    rows = [(*i[:3], day + dt.timedelta(days=n), i[3] + n % 7) for i in ids for n in range(42)]
    daily = spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, Date date, Quantity double")
    long = demand.product_forecast_long(daily)
    assert long.select("item_id").distinct().count() == 3
    split = series.holdout_split(long)
    assert {r["count"] for r in split.where("split = 'test'").groupBy("customer_id").count().collect()} == {14}
    accuracy = forecast.forecast_accuracy(forecast.evaluate_holdout(split)).collect()
    assert len(accuracy) == 3 and all(r["n"] == 14 and r["rmse"] == 0 for r in accuracy)
    assert series.series_context(long).groupBy("item_id").count().where("count = 28").count() == 3
    assert series.product_info(long).count() == 3
    plain = spark.range(1).select(demand.item_id(F.lit("x"), F.lit("1"), F.lit("p")).alias("i")).first()
    assert plain["i"] == "x_1_p"


def test_training_runs_keep_their_codes(spark, tmp_path):
    root = str(tmp_path)
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(days=i)

    def arrays(facilities):
        rows = [
            (f"c_{f}_p", day(i), float(i), "c", f, "p", "name", cat) for f, cat in facilities for i in range(45)
        ]
        schema = "item_id string, timestamp timestamp, target_value double, customer_id string, facility_id string, product_id string, product_name string, category_name string"
        return pipeline.stored_series(spark.createDataFrame(rows, schema))

    def found():
        return {(r.feature, r.value): r.code for r in pipeline.read_training_run(spark, root)["codes"].collect()}

    with pytest.raises(FileNotFoundError):
        pipeline.read_training_run(spark, root)
    pipeline.store_training_sets(arrays([("f2", "dairy"), ("f5", "meat")]), root, "run-1")
    first = found()
    assert first == {("customer", "c"): 0, ("facility", "f2"): 0, ("facility", "f5"): 1, ("category", "dairy"): 0, ("category", "meat"): 1}
    # f2 is gone, f1 and f3 are new: they get the next numbers although they sort first
    later = arrays([("f1", "bread"), ("f3", "meat"), ("f5", "dairy")])
    new = {("facility", "f1"): 2, ("facility", "f3"): 3, ("category", "bread"): 2}
    for _ in range(2):  # the same run again gives the same codes
        pipeline.store_training_sets(later, root, "run-2")
        assert found() == {**first, **new}
    run = pipeline.read_training_run(spark, root)
    cats = {r.item_id: r.cat for r in run["train"].collect()}
    assert cats == {"c_f1_p": [0, 2, 2], "c_f3_p": [0, 3, 1], "c_f5_p": [0, 1, 0]}
    assert run["test"].count() == 3 and len(run["test"].first().target) == 31
    assert sorted(map(tuple, run["product_mapping"].collect())) == [(f"c_{f}_p", "p", "name", c) for f, c in [("f1", "bread"), ("f3", "meat"), ("f5", "dairy")]]
