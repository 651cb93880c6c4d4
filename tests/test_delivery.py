"""Cut runs, keyed point reads, models that fail, the whole report, compaction and re-delivered files."""

import datetime as dt
import shutil

import pandas as pd
import pytest
from pyspark.sql import functions as F

from orderlens.operators import explore, forecast, lookups, quality, recommend
from orderlens.plans import pipeline
from orderlens.plans.catalog import _damaged
from orderlens.schema import SERIES
from orderlens.sources import files
from orderlens.sources.conform import conform
from orderlens.sources.stages import stored
from orderlens.sources.warehouse import order_lines
from orderlens.streaming import demand as demand_stream
from orderlens.streaming import ingest

DAY = dt.date(2001, 8, 2)
HEADER = ["CreateDate", "CustomerID", "FacilityID", "ProductID", "Quantity", "UnitPrice", "OrderID"]


def _plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def lines(spark, folder):
    return conform(order_lines(spark, folder, "type")).cache()


@pytest.fixture(scope="module")
def built(spark, lines, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("built"))
    pipeline.build_outputs(lines, root, "run-1")
    return root


def test_a_cut_run_is_not_seen(spark, lines, tmp_path, monkeypatch):
    root = str(tmp_path)
    pipeline.build_outputs(lines, root, "run-1")
    renamed = lines.withColumn("ProductID", F.concat(F.lit("new-"), "ProductID"))

    def cut(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(lookups, "customer_product_lookup", cut)
        with pytest.raises(RuntimeError):
            pipeline.build_outputs(renamed, root, "run-2")
    assert "run-2" in {r[0] for r in spark.read.parquet(f"{root}/lookup/product_lookup").select("run_ts").distinct().collect()}
    products, relations = files.read_latest_lookups(spark, root)
    assert products.count() and not products.where("ProductID LIKE 'new-%'").count()
    assert relations.join(products, "ProductID", "left_anti").count() == 0
    # the same run again, cut while it replaces its tables: its commit is withdrawn first
    pipeline.build_outputs(renamed, root, "run-2")
    assert files.committed_run(spark, root) == "run-2"
    with monkeypatch.context() as broken:
        broken.setattr(lookups, "customer_product_lookup", cut)
        with pytest.raises(RuntimeError):
            pipeline.build_outputs(lines, root, "run-2")
    assert files.committed_run(spark, root) == "run-1"
    # a run without a usable line commits, and leaves the lookups of the run before
    pipeline.build_outputs(lines.withColumn("ProductID", F.lit(None).cast("string")), root, "run-3")
    assert files.committed_run(spark, root) == "run-3"
    assert files.read_latest_lookups(spark, root)[0].count() == products.count()


def test_point_read_reaches_the_scan(spark, built):
    stored = files.read_lookup_items(spark, f"{built}/lookup/items", "run-1")
    products, relations = files.read_latest_lookups(spark, built)
    items = lookups.lookup_items(products, relations)
    assert sorted(map(str, stored.select(*items.columns).collect())) == sorted(map(str, items.collect()))
    key = items.where("customer_facility IS NOT NULL").agg(F.max("customer_facility")).first()[0]
    found = lookups.items_of_pair(stored, key)
    assert sorted(map(str, found.select(*items.columns).collect())) == sorted(map(str, lookups.items_of_pair(items, key).collect()))
    assert f"EqualTo(customer_facility,{key})" in _plan(found) and "PartitionFilters: [" in _plan(found)
    assert "Exchange" not in _plan(found)


def test_a_failing_series_takes_the_fallback(spark):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(4)]
    rows = [(f"c{i}", "f", f"p{j}", day, 2.0 + j, 3, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 4)) for i in range(2) for j in range(5) for day in days]
    activity = spark.createDataFrame(rows, "CustomerID string, FacilityID string, ProductID string, Date date, Quantity double, Lines bigint, FirstTime timestamp, LastTime timestamp")
    products = spark.createDataFrame([(f"p{j}", f"name {j}", "cat", "v") for j in range(5)], files.PRODUCT_TABLE)

    def model(series):
        kind = series["item_id"].iloc[0]
        out = pd.DataFrame({"ds": pd.date_range("2024-01-05", periods=3), "p10": 1.0, "p50": series["y"].iloc[-1], "p90": 9.0})
        if kind.endswith("p1"):
            raise KeyError("no such series")
        if kind.endswith("p2"):
            return out.iloc[:0]
        if kind.endswith("p3"):
            return pd.concat([out, out])
        if kind == "c1_f_p4":
            return out.assign(p90=None)
        return out

    as_of = F.lit(dt.date(2024, 1, 5))
    got = pipeline.forecast_pairs(activity, products, as_of, model=model).collect()
    bad = {("c0", "p1"), ("c1", "p1"), ("c0", "p2"), ("c1", "p2"), ("c0", "p3"), ("c1", "p3"), ("c1", "p4")}
    for c in ("c0", "c1"):
        for j in range(5):
            mine = sorted((r for r in got if (r.CustomerID, r.ProductID) == (c, f"p{j}")), key=lambda r: r.ds)
            assert {r.ProductName for r in mine} == {f"name {j}"} and {r.OrderCount for r in mine} == {12}
            if (c, f"p{j}") in bad:
                assert len(mine) == 7 and all((r.p10, r.p50, r.p90, r["mean"], r.mock_data) == (6.0, 12.0, 24.0, 12.0, True) for r in mine)
                assert mine[0].ds == dt.date(2024, 1, 5) and ("KeyError" if j == 1 else "ValueError") in mine[0].error
            else:
                assert len(mine) == 3 and all((r.p50, r.mock_data, r.error) == (2.0 + j, False, None) for r in mine)
    bundles = pipeline.recommend_pairs(activity, products, as_of, model=model).collect()
    flags = {(b.customerId, p.product_id): p.mock_data for b in bundles for p in b.productPredictions}
    assert {k for k, v in flags.items() if v} == bad and len(flags) == 10
    none = forecast.model_outcomes(activity.limit(0).select(*SERIES, F.lit("x").alias("item_id"), F.col("Date").alias("ds"), F.col("Quantity").alias("y")), model, SERIES)
    assert none.count() == 0


def test_whole_report(spark, lines, tmp_path):
    summary = pipeline.validate_lines(_damaged(lines), DAY, str(tmp_path)).first()
    read = lambda part: spark.read.json(f"{tmp_path}/{part}")
    rules = read("rules")
    assert summary["business_rules_passed"] + summary["business_rules_failed"] == rules.count() == 5
    assert {r["column_name"] for r in read("distributions").collect()} >= {"OrderUnits", "Price"}
    assert {r["column_name"] for r in read("categories").collect()} >= {"ProductName", "CategoryName"}
    assert read("category_values").where("rank > 5").count() == 0 and read("statistics").count() >= 1
    assert read("checks").where("status = 'warning'").count() == summary["warnings_count"]


def test_rules_take_one_scan_and_digests_no_wide_exchange(spark, lines):
    raw = stored(_damaged(lines), "lines")
    assert _plan(quality.business_rules(raw)).count("FileScan") == 1
    for frame in (quality.duplicate_rows(raw), quality.quality_score(raw)):
        plan = _plan(frame)
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
        # one exchange, by the digest alone; what is added up beside it are counts
        assert plan.count("FileScan") == 1 and len(exchanges) == 1 and "_groupingexpression" in exchanges[0]
        partial = next(line for line in plan.splitlines() if "partial_count(1)" in line)
        shuffled = partial.split("output=")[1]
        assert not any(name in shuffled for name in ("ProductName", "Price", "OrderUnits", "CreateDate"))


def test_digests_tell_rows_apart(spark):
    rows = [("a", "b", 0.0, None), ("a", "b", -0.0, None), ("ab", "", 0.0, None), ("ab", None, 0.0, None), (None, "ab", 0.0, None), ("-", None, 0.0, None), (None, "-", 0.0, None)]
    rows += [("t", "t", 1.0, dt.datetime(2024, 1, 1, 0, 0, 0, k)) for k in (1, 2, 1)] + [("t", "t", float("nan"), None)] * 2
    frame = spark.createDataFrame(rows, "a string, b string, c double, t timestamp")
    found = quality.duplicate_rows(frame).first()
    plain = frame.count() - frame.distinct().count()
    assert (found.total_records, found.duplicate_records) == (12, plain) and plain == 3
    assert quality.duplicate_rows(frame.limit(0)).first().duplicate_records == 0
    score = quality.quality_score(frame.limit(0)).first()
    assert (score.rows, score.consistency, score.completeness) == (0, 100.0, 0.0)


def _write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join([",".join(HEADER), *[",".join(map(str, r)) for r in rows]]) + "\n")


def _rows(n, start=0):
    return [(f"2/{i % 28 + 1}/25", f"C{i % 3}", i % 2, 1876 + i % 4, i % 5 + 1, 4.97, i) for i in range(start, start + n)]


def _totals(frame):
    return sorted(map(tuple, frame.select(*SERIES, "Date", "Quantity").collect()))


@pytest.mark.parametrize("identity", [None, ["OrderID", *SERIES]])
def test_compaction_changes_no_total(spark, tmp_path, identity):
    inbox, out, mark = tmp_path / "in", str(tmp_path / "daily"), str(tmp_path / "mark")

    def run():
        lines = ingest.raw_order_files(spark, str(inbox), HEADER, 1)
        demand_stream.store_daily_demand(demand_stream.daily_demand_stream(lines, identity), out, mark).awaitTermination()
        return _totals(demand_stream.current_daily_demand(spark, out))

    def expected():
        one = conform(files.read_raw_csv(spark, str(inbox)))
        one = one.dropDuplicates(identity) if identity else one
        return sorted(tuple(r) for r in one.groupBy(*SERIES, F.to_date("CreateDate").alias("Date")).agg(F.sum("OrderUnits")).collect())

    _write(inbox / "a.csv", _rows(30))
    assert run() == expected()
    assert demand_stream.compact_daily_demand(spark, out) == ingest.run_name(0)
    assert demand_stream.compact_daily_demand(spark, out) is None
    _write(inbox / "b.csv", _rows(30, 20))  # ten lines again
    assert run() == expected()
    shutil.copytree(f"{out}/batch={ingest.run_name(1)}", tmp_path / "copy")
    assert demand_stream.compact_daily_demand(spark, out) == ingest.run_name(1)
    assert _totals(demand_stream.current_daily_demand(spark, out)) == expected()
    # the last batch is delivered again after it was covered: it is replaced by the same lines
    again = spark.read.parquet(str(tmp_path / "copy"))
    again.write.mode("overwrite").parquet(f"{out}/batch={ingest.run_name(1)}")
    assert _totals(demand_stream.current_daily_demand(spark, out)) == expected()
    # a generation whose write has not ended is not read
    again.write.parquet(f"{out}_generations/through={ingest.run_name(7)}")
    (tmp_path / "daily_generations" / f"through={ingest.run_name(7)}" / "_SUCCESS").unlink()
    _write(inbox / "c.csv", _rows(5, 50))
    assert run() == expected()
    covered = {f.split("/")[-2] for f in demand_stream.current_daily_demand(spark, out).inputFiles()}
    assert covered == {f"through={ingest.run_name(1)}", f"batch={ingest.run_name(2)}"}


def test_a_file_under_a_new_name_counts_once(spark, tmp_path):
    inbox, out, ledger, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ledger"), str(tmp_path / "mark")

    def run(batch_files=1):
        stream = ingest.raw_order_files(spark, str(inbox), HEADER, batch_files, with_file=True)
        ingest.ingest_orders(stream, out, mark, ledger).awaitTermination()
        return spark.read.parquet(f"{out}/processed/order_lines").count()

    _write(inbox / "a.csv", _rows(20))
    assert run() == 20
    _write(inbox / "b.csv", list(reversed(_rows(20))))  # the same lines in another order
    _write(inbox / "c.csv", _rows(20) + _rows(1))  # one line twice: another content
    assert run() == 41
    _write(inbox / "d.csv", _rows(3, 90))
    _write(inbox / "e.csv", _rows(3, 90))
    assert run(9) == 44
    seen = spark.read.schema(ingest.LEDGER).parquet(ledger)
    first = {r.source_file.split("/")[-1]: r.first_file and r.first_file.split("/")[-1] for r in seen.collect()}
    assert first == {"a.csv": None, "b.csv": "a.csv", "c.csv": None, "d.csv": None, "e.csv": "d.csv"}
    # a batch that is repeated decides as before
    batch = ingest.raw_order_files(spark, str(inbox), HEADER, with_file=True).schema
    lines = spark.read.option("header", True).csv(str(inbox / "a.csv")).withColumn(ingest.SOURCE_FILE, F.lit("x/a.csv"))
    lines = conform(lines, keep=(ingest.SOURCE_FILE,))
    assert lines.schema.names == batch.names
    assert ingest.delivered_once(lines, str(tmp_path / "other"), 0).count() == 20
    assert ingest.delivered_once(lines, str(tmp_path / "other"), 0).count() == 20
    assert ingest.delivered_once(lines.withColumn(ingest.SOURCE_FILE, F.lit("y")), str(tmp_path / "other"), 1).count() == 0
    assert ingest.delivered_once(lines.limit(0), str(tmp_path / "other"), 2).count() == 0


def test_a_pair_of_very_many_products(spark):
    """Top products and counts of a hot pair, beside a small one, without ranking all of its products."""
    n = 100_000
    hot = spark.range(n).select(F.lit("c").alias("CustomerID"), F.lit("f").alias("FacilityID"), F.format_string("p%06d", "id").alias("ProductID"), ((F.col("id") * 7919) % n).cast("double").alias("p50"))
    cold = spark.range(3).select(F.lit("d").alias("CustomerID"), F.lit("f").alias("FacilityID"), F.format_string("p%d", "id").alias("ProductID"), F.lit(2.0).alias("p50"))
    rows = hot.union(cold).select("*", (F.col("p50") / 2).alias("p10"), (F.col("p50") * 2).alias("p90"), F.col("p50").alias("mean"), F.lit(DAY).alias("ds"), F.lit("n").alias("ProductName"), F.lit(4).alias("OrderCount"))
    outlook = recommend.product_outlook(rows, F.lit(DAY))
    chosen = recommend.recommendations(outlook)
    got = {(r.CustomerID, r["rank"]): r.product_id for r in chosen.collect()}
    values = sorted(((-(i * 7919 % n), f"p{i:06d}") for i in range(n)))[:5]
    assert [got["c", k] for k in range(1, 6)] == [p for _, p in values]
    assert [got.get(("d", k)) for k in range(1, 5)] == ["p0", "p1", "p2", None]
    summary = {r.CustomerID: r for r in recommend.prediction_summary(outlook).collect()}
    assert (summary["c"].total_products_analyzed, summary["c"].recommended_products_count) == (n, 5)
    assert (summary["d"].total_products_analyzed, summary["d"].recommended_products_count) == (3, 3)
    assert summary["c"].total_predicted_demand_7days == sum(range(n)) and summary["d"].total_predicted_demand_7days == 6.0
    plan = _plan(recommend.prediction_summary(outlook))
    assert "WindowGroupLimit" in _plan(chosen) and "WindowGroupLimit" in plan
    # each window stands on a group limit that was applied before its exchange
    assert plan.count("WindowGroupLimit") >= 2 and plan.count("Final") >= 1 and plan.count("Partial") >= 1


MIXED = {
    "a.csv": "CreateDate,CustomerID,FacilityID,ProductID,Quantity\n2024-01-01,C1,F1,P1,2\n2024-01-02,C1,F1,P1,3\n",
    "b [1].csv": "product_id,Create Date,customer_id,FacilityID,Quantity,Note\nP1,2024-01-03,C1,F1,4,hello\n",
    "c.csv": "CreateDate,CustomerID,FacilityID,ProductID,Quantity\n2024-01-04,C1,F1,P2,5\n",
    "empty.csv": "\n",
    "no_bytes.csv": "",  # holds nothing; Spark's file listing passes over it
    "twice.csv": "ProductID,CreateDate,productid\nP1,2024-01-01,P2\n",
    "other.csv": "name,colour\nx,red\n",
    "bytes.csv": b"\xff\xfe\x00\x01\n",
    "endless.csv": "x" * 200_000,
}


@pytest.fixture
def mixed(tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for name, content in MIXED.items():
        (inbox / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return inbox


def test_files_with_mixed_headers(spark, mixed):
    paths = [*files.order_file_names(spark, str(mixed)), f"{mixed}/gone.csv"]
    lines, issues = files.read_order_files(spark, paths, file_column="file")
    got = {(str(r.CreateDate)[:10], r.CustomerID, r.ProductID, r.file.rsplit("/", 1)[1]) for r in lines.collect()}
    assert got == {
        ("2024-01-01", "C1", "P1", "a.csv"),
        ("2024-01-02", "C1", "P1", "a.csv"),
        ("2024-01-03", "C1", "P1", "b%20%5B1%5D.csv"),
        ("2024-01-04", "C1", "P2", "c.csv"),
    }
    reasons = {r.path.rsplit("/", 1)[1]: r.issue for r in issues.collect()}
    assert reasons.keys() == {"empty.csv", "twice.csv", "other.csv", "bytes.csv", "endless.csv", "gone.csv"}
    assert reasons["twice.csv"] == "a column name occurs twice" and "CreateDate" in reasons["other.csv"]
    # files with the same header share a scan
    assert _plan(lines).count("FileScan csv") == 2
    none, _ = files.read_order_files(spark, [f"{mixed}/empty.csv"])
    assert none.count() == 0 and none.columns == conform(none).columns


@pytest.mark.parametrize("with_ledger", [False, True])
def test_a_bad_file_does_not_stop_the_stream(spark, mixed, tmp_path, with_ledger):
    root, bad = str(tmp_path / "out"), str(tmp_path / "bad")
    ledger = str(tmp_path / "ledger") if with_ledger else None

    def run():
        names = ingest.arriving_files(spark, str(mixed), 3)
        ingest.ingest_order_files(names, root, str(tmp_path / "at"), bad, ledger).awaitTermination()

    run()
    (mixed / "late.csv").write_text("Quantity,ProductID,CreateDate,CustomerID,FacilityID\n7,P3,2024-01-05,C2,F1\n")
    (mixed / "later.csv").write_text("nothing\n")
    (mixed / "again.csv").write_text(MIXED["a.csv"])
    run()
    lines = spark.read.parquet(f"{root}/processed/order_lines")
    days = sorted(str(r.CreateDate)[8:10] for r in lines.collect())
    assert days == (["01", "02", "03", "04", "05"] if with_ledger else ["01", "01", "02", "02", "03", "04", "05"])
    assert {r.path.rsplit("/", 1)[1] for r in spark.read.schema(files.FILE_ISSUE).json(bad).collect()} == {
        "empty.csv", "twice.csv", "other.csv", "bytes.csv", "endless.csv", "later.csv"
    }


def test_overview_takes_one_reduction(spark, lines):
    got = explore.dataset_overview(lines)
    plan = _plan(got)
    assert "Expand" not in plan
    row = got.first()
    assert row.total_records == lines.count()
    assert row.unique_productid == lines.select("ProductID").where("ProductID IS NOT NULL").distinct().count()
    none = explore.dataset_overview(lines.limit(0)).first()
    assert (none.total_records, none.unique_orderid, none.nulls_orderid, none.start_date) == (0, 0, 0, None)
