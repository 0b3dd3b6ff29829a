from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import audit, cleaning
from ledgerlark.schemas import CLEAN_LINES, TRANSACTIONS
from ledgerlark.sources import tables as store

HEADER = ["Invoice", "StockCode", "Description", "Quantity", "InvoiceDate", "Price", "Customer ID", "Country"]
ROWS = [
    ("c123", "A1 ", " Mug", "-2", "2010-01-05 10:00:00", "2.5", "17.0", " UK "),
    (" C5", "A1", "Mug", "3", "2010-01-05 10:00:00", "2.5", "17", "UK"),
    ("7", "B\t", None, "1", "not a date", "0", None, "UK"),
    ("8", "B", "Tray", "1", "2010-02-01 00:00:00", "-1", "18", None),
    ("9", "B", "Tray", "4", "2010-02-01 00:00:00", "1.25", "18.5", "UK"),
    ("9", "B", "Tray", "4", "2010-02-01 00:00:00", "1.25", "18.5", "UK"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, ", ".join(f"`{name}` string" for name in HEADER))


def test_names_and_types(raw):
    lines = cleaning.clean(raw)
    assert set(lines.columns) == set(CLEAN_LINES.fieldNames())
    found = {row.invoice: row for row in lines.collect()}
    assert len(found) == 5
    assert found["c123"].is_cancellation and found["C5"].is_cancellation and not found["9"].is_cancellation
    assert found["c123"].is_return and found["c123"].revenue == Decimal("-5.00")
    assert found["c123"].customer_id == 17 and found["C5"].customer_id == 17
    assert found["9"].customer_id is None
    assert found["7"].invoice_date is None and found["7"].stock_code == "B"
    assert found["7"].description == "Unknown Product"
    assert found["8"].country is None and found["8"].invalid_price_flag


def test_filters(raw):
    lines = cleaning.clean(raw)
    assert {r.invoice for r in cleaning.positive_price_lines(lines).collect()} == {"c123", "C5", "9"}
    assert {r.invoice for r in cleaning.sales_lines(lines).collect()} == {"9"}
    assert cleaning.customer_lines(cleaning.sales_lines(lines)).count() == 0


def test_quality_checks_find_each_fault(spark, raw):
    checks = {row.rule: row for row in cleaning.quality_checks(cleaning.clean(raw)).collect()}
    assert checks["customer_id_present"].violations == 2
    assert checks["quantity_positive"].violations == 1
    assert checks["price_positive"].violations == 2
    assert checks["revenue_matches"].passed and checks["not_empty"].passed
    empty = {row.rule: row for row in cleaning.quality_checks(cleaning.clean(raw).limit(0)).collect()}
    assert not empty["not_empty"].passed
    lacking = {r.rule: r for r in cleaning.quality_checks(cleaning.clean(raw).withColumn("x", F.lit(1))).collect()}
    assert lacking["required_columns"].passed


def test_collation_groups_without_case(spark):
    rows = [("a1", "x", "UK", "1"), ("A1", "X", "uk", "2")]
    frame = spark.createDataFrame(rows, "stock_code string, description string, country string, invoice string")
    assert frame.select("stock_code").distinct().count() == 2
    folded = cleaning.with_collation(frame)
    assert folded.select("stock_code").distinct().count() == 1
    assert folded.groupBy("country").count().count() == 1


def test_report_over_nothing_is_zero(raw):
    row = cleaning.cleaning_report(cleaning.clean(raw).limit(0)).first()
    assert set(row) == {0}


def test_duplicates_treat_nulls_as_equal(spark):
    frame = spark.createDataFrame([(None, 1), (None, 1), (2, 1)], "a int, b int")
    assert tuple(audit.duplicate_count(frame).first()) == (1, 3)
    assert audit.duplicate_rows(frame).collect()[0].extra_copies == 1


def test_schema_of_loaded_lines(raw):
    from ledgerlark.sources.tables import prepare_lines_for_load

    loaded = prepare_lines_for_load(cleaning.clean(raw))
    assert [(f.name, f.dataType) for f in loaded.schema] == [(f.name, f.dataType) for f in TRANSACTIONS]


def test_describe_mixed_columns(spark):
    rows = [("b", None, 1), ("b", None, 2), ("a", None, 3), ("a", None, None), (None, None, 10)]
    frame = spark.createDataFrame(rows, "t string, nothing string, n int")
    found = {row.column_name: row for row in audit.describe_all(frame, ["t", "nothing", "n"]).collect()}
    assert (found["t"].value_count, found["t"].unique_values, found["t"].top_value, found["t"].top_count) == (4, 2, "a", 2)
    assert (found["nothing"].value_count, found["nothing"].top_value, found["nothing"].top_count) == (0, None, None)
    assert (found["n"].value_count, found["n"].mean_value, found["n"].p50, found["n"].max_value) == (4, 4.0, 2.5, 10.0)
    assert found["n"].top_value is None and found["t"].mean_value is None


def test_lines_are_shuffled_once_until_they_are_stored_by_month(spark, raw, tmp_path):
    """Equal rows and months meet by one shuffle, and no aggregate holds all rows of a task before it."""
    many = spark.createDataFrame(ROWS * 2 + ROWS[:1] * 50, raw.schema)
    lines = cleaning.clean(many)
    monthly = lines.withColumn("month", F.date_format("invoice_date", "yyyy-MM"))
    plan = monthly._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange ") == 1
    assert plan.index("HashAggregate") < plan.index("Exchange ") and "HashAggregate" not in plan[plan.index("Exchange "):]
    store.write_lines(lines, str(tmp_path / "lines"), dealt=True)
    found = store.read_lines(spark, str(tmp_path / "lines"))
    once = cleaning.clean(raw)
    assert found.count() == once.count() == 5
    assert found.select(*once.columns).exceptAll(once).count() == 0
