"""Files in and out, the batch jobs, and the streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from orderlens.operators import demand
from orderlens.operators.feedback import parse_feedback, validate_feedback
from orderlens.plans import pipeline
from orderlens.schema import ORDER_LINE, SERIES
from orderlens.sources import files
from orderlens.sources.conform import conform
from orderlens.sources.warehouse import order_lines
from orderlens.streaming import demand as demand_stream
from orderlens.streaming import feedback as feedback_stream
from orderlens.streaming import ingest

HEADER = ["PortalID", "Create Date", "customer_id", "FacilityID", "ProductID", "Quantity", "UnitPrice", "OrderID", "CategoryName", "ProductName"]


def _write_csv(path, rows, header=HEADER):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(header), *[",".join(map(str, r)) for r in rows]]) + "\n")


def _raw(n, start=0):
    return [
        ("P1", f"2/{i % 28 + 1}/25", f"C{i % 3}", i % 2, 1876 + i % 4, i % 5 + 1, 4.97, i, "P1", '"BINAXNOW: CARD, 2"')
        for i in range(start, start + n)
    ]


def test_csv_is_conformed(spark, tmp_path):
    _write_csv(tmp_path / "in" / "a.csv", _raw(3))
    frame = files.read_orders_csv(spark, str(tmp_path / "in"))
    assert frame.schema == ORDER_LINE
    row = frame.where("OrderID = '1'").first()
    assert row["CreateDate"] == dt.datetime(2025, 2, 2) and row["ProductName"] == "BINAXNOW: CARD, 2"
    assert (row["OrderUnits"], row["Price"], row["VendorName"]) == (2.0, 4.97, None)
    assert files.unknown_columns(files.read_raw_csv(spark, str(tmp_path / "in"))) == ["PortalID"]


def test_first_present_spelling_wins(spark):
    frame = spark.createDataFrame([("a", "b", "c"), (None, "b", "c")], "ProductName string, `product description` string, Product_ID string")
    assert [r["ProductName"] for r in conform(frame).collect()] == ["b", "b"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "lookup")
    empty, relations = files.read_latest_lookups(spark, root)
    assert empty.count() == 0 and relations.columns == files.CUSTOMER_PRODUCT_TABLE.names
    frame = spark.createDataFrame([("p", "n", "c", "v")], files.PRODUCT_TABLE)
    table = f"{root}/lookup/product_lookup"
    files.write_snapshot(frame, table, "2024-01-01-00-00-00")
    files.write_snapshot(frame.withColumn("ProductID", F.lit("q")), table, "2024-01-02-00-00-00")
    files.write_snapshot(frame.withColumn("ProductID", F.lit("r")), table, "2024-01-02-00-00-00")
    assert files.read_latest_lookups(spark, root)[0].count() == 0  # nothing is committed
    files.commit_run(spark, root, "2024-01-02-00-00-00", ["lookup/product_lookup", "lookup/customer_product_lookup"])
    assert [r["ProductID"] for r in files.read_latest_lookups(spark, root)[0].collect()] == ["r"]
    every = files.read_snapshots(spark, table, files.PRODUCT_TABLE)
    assert every.count() == 2
    assert "PartitionFilters: [isnotnull(run_ts" in files.latest_only(every)._jdf.queryExecution().executedPlan().toString()


def test_report_paths():
    assert files.report_paths("processed/2024/x.csv") == ("validation/2024/x_validation.json", "validation/2024/x_summary.json")


def test_joins_left_out_change_nothing(spark, folder):
    whole = order_lines(spark, folder).select("ProductID", "OrderUnits")
    narrow = order_lines(spark, folder, columns=["ProductID", "OrderUnits"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, narrow.collect()))
    plan = narrow._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan and "l_quantity" in plan and "l_tax" not in plan


def test_build_outputs_and_recommend(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    lines = conform(order_lines(spark, folder, "type"))
    written = pipeline.build_outputs(lines, root, "run-1")
    assert len(written) == 8 and pipeline.build_outputs(lines.limit(0), str(tmp_path / "none"), "r") == []
    pipeline.build_outputs(lines, root, "run-1")  # again: replaces, does not add
    activity = spark.read.parquet(f"{root}/processed/daily_activity")
    assert activity.agg(F.sum("Lines")).first()[0] == lines.count()
    lookup = pipeline.latest_lookup(spark, root)
    assert lookup.count() == 150
    products = files.read_latest_lookups(spark, root)[0]
    as_of, activity = F.lit(dt.date(2001, 8, 2)), activity.drop("run_ts")
    bundles = [
        sorted(map(str, pipeline.recommend_pairs(activity, products, as_of, relations).collect()))
        for relations in (None, lookup)
    ]
    assert len(bundles[0]) == 25 and bundles[0] == bundles[1]
    summary = pipeline.validate_lines(lines, dt.date(2001, 8, 2), str(tmp_path / "report")).first()
    assert summary["validation_summary"] == "PASSED" and summary["total_records"] == 6000


def test_stream_of_files(spark, tmp_path):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    _write_csv(inbox / "a.csv", _raw(40))
    (inbox / "notes.txt").write_text("not an order file\n")

    def run():
        ingest.ingest_orders(ingest.raw_order_files(spark, str(inbox), HEADER, 1), out, mark).awaitTermination()

    run()
    run()  # nothing new: nothing happens
    _write_csv(inbox / "b.csv", _raw(30, 40))
    run()
    lines = spark.read.parquet(f"{out}/processed/order_lines")
    assert {r["run_ts"]: r["count"] for r in lines.groupBy("run_ts").count().collect()} == {ingest.run_name(0): 40, ingest.run_name(1): 30}
    stored = spark.read.parquet(f"{out}/processed/daily_activity").where(F.col("run_ts") == ingest.run_name(1))
    batch = demand.daily_activity(conform(files.read_raw_csv(spark, str(inbox / "b.csv"))))
    assert sorted(map(tuple, stored.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    assert pipeline.latest_lookup(spark, out).agg(F.sum("OrderCount")).first()[0] == 30

    stream = ingest.written_lines(spark, out)
    ingest.validate_orders(stream, dt.date(2025, 3, 1), str(tmp_path / "v"), str(tmp_path / "mark2")).awaitTermination()
    summary = spark.read.json(f"{tmp_path}/v/{ingest.run_name(0)}/summary").first()
    assert summary["total_records"] == 70


def _feedback_bodies():
    good = '{"customer_id": " 1 ", "facility_id": 2, "prediction_id": "p", "feedback_type": "accuracy", "rating": %s%s}'
    return {
        good % ("5", ', "actual_quantity": "x", "predicted_quantity": -3'): None,
        good % ('"3"', ', "user_id": "u", "product_id": "  "'): None,
        good % ("6", ""): "INVALID_FIELD_VALUES",
        good % ('"bad"', ""): "INVALID_FIELD_VALUES",
        good.replace("accuracy", "gossip") % ("1", ""): "INVALID_FIELD_VALUES",
        good.replace('" 1 "', '" "') % ("1", ""): "INVALID_FIELD_VALUES",
        good % ("null", ""): "MISSING_FIELDS",
        '{"customer_id": 1}': "MISSING_FIELDS",
        "{broken": "INVALID_JSON",
        "": "INVALID_JSON",
    }


def test_feedback_rows(spark):
    cases = _feedback_bodies()
    frame = spark.createDataFrame([(b,) for b in cases], "body string")
    rows = {r["body"]: r for r in validate_feedback(parse_feedback(frame)).collect()}
    assert {b: r["error_code"] for b, r in rows.items()} == cases
    first, second = list(cases)[:2]
    assert rows[first]["customer_id"] == "1" and rows[first]["user_id"] == "anonymous" and rows[first]["comments"] == ""
    assert rows[first]["actual_quantity"] is None and rows[first]["negative_predicted_quantity"]
    assert rows[second]["rating"] == 3 and rows[second]["user_id"] == "u" and rows[second]["product_id"] is None


def test_feedback_stream(spark, tmp_path):
    cases = _feedback_bodies()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(cases) + "\n")
    accepted, rejected = str(tmp_path / "ok"), str(tmp_path / "bad")
    for _ in range(2):
        stream = feedback_stream.feedback_stream(spark.readStream.text(str(tmp_path / "in")))
        feedback_stream.store_feedback(
            stream, accepted, rejected, str(tmp_path / "mark"), F.lit(dt.datetime(2024, 1, 1))
        ).awaitTermination()
    kept = spark.read.parquet(accepted)
    assert kept.count() == 2 and kept.select("id").distinct().count() == 2 and "error_code" not in kept.columns
    assert spark.read.parquet(rejected).count() == len(cases) - 2


@pytest.mark.parametrize("identity", [None, ["OrderID", "ProductID"]])
def test_daily_demand_stream_equals_batch(spark, tmp_path, identity):
    columns = "OrderID string, CreateDate timestamp, CustomerID string, FacilityID string, ProductID string, OrderUnits double"
    lines = [
        (str(i), dt.datetime(2024, 1, 1 + i // 10, i % 24), f"c{i % 2}", "f", f"p{i % 3}", float(i)) for i in range(60)
    ]
    source, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark")
    for i, part in enumerate([lines[40:], lines[:25], lines[25:40]]):  # files go back in time
        again = part[:5] if identity else []  # delivered twice
        spark.createDataFrame(part + again, columns).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(columns).parquet(source)
        daily = demand_stream.daily_demand_stream(stream, identity)
        demand_stream.store_daily_demand(daily, out, mark).awaitTermination()
    batch = demand.daily_demand(spark.createDataFrame(lines, columns))
    names = [*SERIES, "Date", "Quantity"]
    found = demand_stream.current_daily_demand(spark, out)
    assert sorted(map(tuple, found.select(*names).collect())) == sorted(map(tuple, batch.select(*names).collect()))


def test_files_with_different_headers(spark, tmp_path):
    swap = [0, 1, 3, 2, *range(4, len(HEADER))]  # customer and facility
    rows = _raw(3)
    _write_csv(tmp_path / "a.csv", rows)
    _write_csv(tmp_path / "b.csv", [[r[i] for i in swap] for r in rows], [HEADER[i] for i in swap])
    one = files.read_orders_csv(spark, str(tmp_path / "a.csv"))
    both = files.read_orders_csv(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert sorted(map(str, both.collect())) == sorted(map(str, one.collect() * 2))
    with pytest.raises(Exception, match="(?i)header"):
        files.read_orders_csv(spark, str(tmp_path / "*.csv")).collect()
