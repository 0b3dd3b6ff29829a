"""Stored tables: CSV round trip, appends, upsert by partition, constraints, streams, display text."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.functions import text
from ledgerlark.operators import cleaning, dashboard, predictions, report
from ledgerlark.plans.lineage import scratch_path
from ledgerlark.schemas import CLEAN_LINES, PREDICTIONS
from ledgerlark.sources import tables as store
from ledgerlark.streaming import incremental


def scored(spark, rows):
    built = [(c, Decimal(p), int(Decimal(p) > Decimal("0.5")), risk, datetime(2011, 12, day)) for c, p, risk, day in rows]
    return spark.createDataFrame(built, PREDICTIONS)


def stored_files(spark, path):
    files = spark.read.parquet(path).select(F.input_file_name()).distinct().collect()
    found = {}
    for (name,) in files:
        found.setdefault(int(name.split("bucket=")[1].split("/")[0]), set()).add(name)
    return found


def test_upsert_replaces_inserts_and_refuses_nothing(spark):
    path = scratch_path(spark, "predictions")
    with pytest.raises(FileNotFoundError):
        store.read_current(spark, path)
    assert len(store.upsert_predictions(spark, path, scored(spark, [(1, "0.1", "LOW", 1), (2, "0.9", "HIGH", 1)]))) == 2
    updates = scored(spark, [(2, "0.2", "LOW", 2), (3, "0.6", "MEDIUM", 2), (3, "0.7", "MEDIUM", 3)])
    assert len(store.upsert_predictions(spark, path, updates)) == 2
    current = {row.customer_id: row for row in store.read_current(spark, path).collect()}
    assert {c: str(r.churn_probability) for c, r in current.items()} == {1: "0.100000", 2: "0.200000", 3: "0.700000"}
    with pytest.raises(ValueError):
        store.upsert_predictions(spark, path, scored(spark, []))
    stored = store.read_current(spark, path)
    assert stored.columns == PREDICTIONS.fieldNames() and stored.count() == 3


def test_untouched_partitions_keep_their_files(spark):
    path = scratch_path(spark, "predictions")
    every = store.upsert_predictions(spark, path, scored(spark, [(c, "0.1", "LOW", 1) for c in range(1, 300)]))
    assert every == sorted(set(every)) and len(every) > 50
    before = stored_files(spark, path)
    touched = store.upsert_predictions(spark, path, scored(spark, [(1, "0.9", "HIGH", 2), (5000, "0.9", "HIGH", 2)]))
    after = stored_files(spark, path)
    assert 1 <= len(touched) <= 2
    assert {bucket for bucket in after if before.get(bucket) != after[bucket]} == set(touched)
    found = {r.customer_id: str(r.churn_probability) for r in store.read_current(spark, path).collect()}
    assert len(found) == 300 and (found[1], found[5000], found[2]) == ("0.900000", "0.900000", "0.100000")


def test_upsert_reads_touched_partitions_only(spark):
    path = scratch_path(spark, "predictions")
    store.upsert_predictions(spark, path, scored(spark, [(c, "0.1", "LOW", 1) for c in range(1, 300)]))
    plan = store._stored_buckets(spark, path, [3, 4])._jdf.queryExecution().toString()
    assert "PartitionFilters: [bucket" in plan and "IN (3,4)" in plan


def test_interrupted_upsert_leaves_the_old_rows(spark, monkeypatch):
    path = scratch_path(spark, "predictions")
    store.upsert_predictions(spark, path, scored(spark, [(1, "0.1", "LOW", 1)]))

    def fails(*arguments):
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "merge_predictions", fails)
    with pytest.raises(RuntimeError):
        store.upsert_predictions(spark, path, scored(spark, [(1, "0.9", "HIGH", 2)]))
    assert [str(r.churn_probability) for r in store.read_current(spark, path).collect()] == ["0.100000"]


def test_coverage(spark):
    modeling = spark.createDataFrame([(1,), (2,)], "customer_id bigint")
    part = predictions.prediction_coverage(modeling, scored(spark, [(1, "0.1", "LOW", 1)])).first()
    assert (part.modeling_customers, part.prediction_customers, part.missing_predictions, part.valid) == (2, 1, 1, False)
    full = predictions.prediction_coverage(modeling, scored(spark, [(1, "0.1", "LOW", 1), (2, "0.9", "HIGH", 1)])).first()
    assert full.valid


def test_constraints(spark):
    keyed = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (7, "c")], "customer_id bigint, v string")
    known = spark.createDataFrame([(1,)], "customer_id bigint")
    row = store.table_constraints(keyed, "customer_id", ["v"], known).first()
    assert (row.total_rows, row.non_null_ids, row.unique_ids, row.null_v, row.missing_references) == (4, 3, 2, 1, 1)


def clean(spark):
    rows = [
        ("1", "A", ' say "hi", twice ', 2, datetime(2010, 1, 1, 8), Decimal("1.5"), 5, "UK", Decimal("3.00"), False, False, False),
        ("2", "B", None, 1, datetime(2010, 1, 2), Decimal("2"), None, None, Decimal("2.00"), False, False, False),
    ]
    return spark.createDataFrame(rows, CLEAN_LINES)


def test_csv_round_trip_keeps_blanks_quotes_and_nulls(spark):
    path = scratch_path(spark, "csv")
    store.write_clean_csv(clean(spark), path)
    back = store.read_clean_csv(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, clean(spark).collect()))
    assert store.read_clean_csv(spark, path, 1).count() == 1


def test_csv_round_trip_keeps_line_breaks(spark):
    path = scratch_path(spark, "csv")
    broken = clean(spark).withColumn("description", F.lit('two\nlines, "quoted" 50% \\ %0A\r\nend'))
    store.write_clean_csv(broken, path)
    assert sorted(map(tuple, store.read_clean_csv(spark, path).collect())) == sorted(map(tuple, broken.collect()))


EXTRACT = """Invoice,StockCode,Description,Quantity,InvoiceDate,Price,Customer ID,Country
489434,85048,"15CM ""BALL"", 20",6.0,2009-12-01 07:45:00,6.95,13085.0,UK
489435,22350,"two
lines",6,2009-12-01 07:46:00,2.1,,UK
,22350,no invoice,1,2009-12-01 07:46:00,2.1,13085,UK
489436,,no code,1,2009-12-01 07:46:00,2.1,13085,UK
489437,1,bad,1.5,yesterday,cheap,13085.5,UK
"""


def test_extracts_written_as_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text(EXTRACT)
    text = store.read_raw_text(spark, [str(tmp_path)], multi_line=True)
    lost = {row.column_name: row.cells for row in store.unreadable_cells(text).collect()}
    assert lost == {"Quantity": 1, "InvoiceDate": 1, "Price": 1, "Customer ID": 1}
    rows = {r.Invoice: r for r in store.read_raw_sheets(spark, [str(tmp_path)], multi_line=True).collect()}
    assert rows["489434"]["Customer ID"] == 13085 and rows["489434"].Quantity == 6
    assert rows["489435"].Description == "two\nlines" and rows["489435"]["Customer ID"] is None
    for raw in (text, store.read_raw_sheets(spark, [str(tmp_path)], multi_line=True)):
        lines = cleaning.clean(raw)
        assert {r.invoice for r in lines.collect()} == {"489434", "489435", "489437"}
        assert {r.invoice for r in cleaning.customer_lines(cleaning.sales_lines(lines)).collect()} == {"489434"}
        typed = cleaning.typed_lines(raw)
        assert {r.reject_reason for r in cleaning.rejected_lines(typed).collect()} == {"missing_invoice", "missing_stock_code"}
        report = cleaning.cleaning_report(typed).first()
        assert (report.missing_invoices, report.missing_stock_codes, report.missing_dates, report.total_rows) == (1, 1, 1, 5)
        checks = {r.rule: r.violations for r in cleaning.quality_checks(typed).collect()}
        assert checks["invoice_present"] == checks["stock_code_present"] == 1


def test_lines_partitioned_by_month(spark):
    path = scratch_path(spark, "lines")
    store.write_lines(clean(spark), path)
    assert spark.read.parquet(path).where("invoice_month = '2010-01'").count() == 2


def test_line_numbers_are_unique(spark):
    lines = clean(spark).unionByName(clean(spark)).repartition(3)
    ids = [row.transaction_id for row in store.number_lines(lines, after=100).collect()]
    assert len(set(ids)) == 4 and min(ids) > 100


def test_materialized_bucketed_table(spark):
    spark.sql("DROP TABLE IF EXISTS bucketed_lines")
    path = scratch_path(spark, "warehouse")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS scratch LOCATION '{path}'")
    store.materialize(clean(spark), "scratch.bucketed_lines", "stock_code", 4)
    assert spark.table("scratch.bucketed_lines").count() == 2
    spark.sql("DROP TABLE scratch.bucketed_lines")


def test_stream_appends_each_file_once(spark):
    source, target, checkpoint = (scratch_path(spark, name) for name in ("in", "out", "cp"))
    clean(spark).write.options(**store.CSV_OPTIONS).csv(source)
    incremental.append_new_files(spark, source, target, checkpoint)
    incremental.append_new_files(spark, source, target, checkpoint)
    assert spark.read.parquet(target).count() == 2
    clean(spark).write.mode("append").options(**store.CSV_OPTIONS).csv(source)
    incremental.append_new_files(spark, source, target, checkpoint)
    assert spark.read.parquet(target).count() == 4


def test_stream_upserts(spark):
    source, root, checkpoint = (scratch_path(spark, name) for name in ("in", "root", "cp"))
    scored(spark, [(1, "0.1", "LOW", 1)]).write.parquet(source)
    stream = spark.readStream.schema(PREDICTIONS).parquet(source)
    incremental.upsert_stream(stream, root, checkpoint).awaitTermination()
    assert store.read_current(spark, root).count() == 1


def test_display_text(spark):
    frame = spark.createDataFrame([(1234.5, 0.12345, None, 9876543, datetime(2011, 1, 2, 3, 4))], "a double, b double, c double, d bigint, e timestamp_ntz")
    row = dashboard.display_table(
        frame, {"a": "currency", "b": "percent", "c": "days", "d": "thousands", "e": "minute"}, {"a": "Revenue"}
    ).first()
    assert tuple(row) == ("£1,234.50", "12.35%", "N/A", "9,876,543", "2011-01-02 03:04")
    assert set(text.FORMATS) == {"currency", "thousands", "percent", "days", "minute"}


def test_peaks_prefer_the_first_month(spark):
    rows = [("2011-01-01", 5, 2), ("2011-02-01", 5, 9), ("2011-03-01", 1, 9)]
    monthly = spark.createDataFrame(rows, "m string, revenue int, orders int").select(F.col("m").cast("date").alias("month"), "revenue", "orders")
    row = dashboard.peak_months(monthly).first()
    assert (str(row.highest_revenue_month), str(row.highest_order_month)) == ("2011-01-01", "2011-02-01")


def test_json_safe(spark):
    nan, inf = float("nan"), float("inf")
    frame = spark.createDataFrame(
        [(nan, [1.0, -inf], (inf, datetime(2011, 1, 2, 3, 4, 5)), {"k": nan})],
        "a double, b array<double>, c struct<x: double, t: timestamp_ntz>, d map<string, double>",
    )
    row = report.json_safe(frame).first()
    assert row.a is None and row.b == [1.0, None] and row.d == {"k": None}
    assert row.c.x is None and row.c.t == "2011-01-02T03:04:05"


def test_grounding_rules(spark):
    customers = spark.createDataFrame([(17,)], "customer_id bigint")
    products = spark.createDataFrame([("23843",)], "stock_code string")
    good = "LOW < 50% MEDIUM >= 50% and < 75% HIGH >= 75% Customer 17 bought Stock Code 23843 for £5"
    texts = spark.createDataFrame(
        [("good", good), ("bad", "Customer 23843 and Customer 99 paid $5 and $6 for Stock Code 1X")], "report_id string, text string"
    )
    found = {(r.report_id, r.rule): r.violations for r in report.report_grounding_check(texts, customers, products).collect()}
    assert all(count == 0 for (name, _), count in found.items() if name == "good")
    assert found[("bad", "no_foreign_currency")] == 2
    assert found[("bad", "customers_exist")] == 2
    assert found[("bad", "codes_not_called_customers")] == 1
    assert found[("bad", "stock_codes_exist")] == 1
    assert found[("bad", "thresholds_worded")] == 3


def test_amounts_need_a_figure(spark):
    figures = spark.createDataFrame([("1234.50",), ("99.99",), (None,)], "amount string")
    texts = spark.createDataFrame(
        [("good", "£1,234.50 and £ 100, again £1234.50"), ("bad", "£1,234.51, £1,235, £98 and $7"), ("none", "no money"), ("null", None)],
        "report_id string, text string",
    )
    found = {r.report_id: (r.amounts, r.unsupported, r.passed) for r in report.report_amounts_check(texts, figures).collect()}
    assert found == {"good": (3, 0, True), "bad": (3, 2, False), "none": (0, 0, True), "null": (0, 0, True)}
