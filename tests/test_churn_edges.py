"""Window edges, same-day orders, one-order customers and empty tables."""

from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlark.operators import churn, features, rfm, sales
from ledgerlark.schemas import CHURN_MODELING, CLEAN_LINES

CUTOFF, END = "2011-09-10", "2011-12-09"


def lines(spark, rows):
    """(customer, invoice, stock code, time, quantity, price) rows as clean lines."""
    built = [
        (
            invoice, stock, "thing", quantity, datetime.fromisoformat(when), Decimal(price), customer, "UK",
            Decimal(quantity) * Decimal(price), False, False, quantity < 0,
        )
        for customer, invoice, stock, when, quantity, price in rows
    ]
    return spark.createDataFrame(built, CLEAN_LINES)


@pytest.fixture(scope="module")
def same_day(spark):
    return lines(
        spark,
        [
            (1, "a", "p", "2011-01-01 09:00:00", 1, "10"),
            (1, "b", "q", "2011-01-01 12:00:00", 2, "10"),
            (1, "c", "p", "2011-01-05 09:00:00", 3, "10"),
            (2, "d", "p", "2011-02-01 09:00:00", 1, "7"),
        ],
    )


def joined_summary(spark, frame):
    """The fan-out by its definition: gaps joined back to orders on customer and day."""
    churn.customer_orders(frame, CUTOFF).createOrReplaceTempView("edge_orders")
    return spark.sql(
        """
        WITH gaps AS (SELECT customer_id, order_date, datediff(order_date, lag(order_date) OVER
                        (PARTITION BY customer_id ORDER BY order_date)) AS gap FROM edge_orders)
        SELECT customer_id, count(*) AS frequency, sum(order_revenue) AS monetary, avg(gap) AS gap
        FROM gaps JOIN edge_orders USING (customer_id, order_date) GROUP BY customer_id
        """
    )


def test_fan_out_is_kept_and_corrected(spark, same_day):
    kept = {row.customer_id: row for row in churn.churn_features(same_day, CUTOFF).collect()}
    exact = {row.customer_id: row for row in churn.churn_features_exact(same_day, CUTOFF).collect()}
    assert kept[1].frequency == 5 and exact[1].frequency == 3
    assert kept[1].monetary_value == Decimal("90.00") and exact[1].monetary_value == Decimal("60.00")
    assert exact[1].average_order_gap == Decimal("2.00")
    assert kept[2].average_order_gap is None and exact[2].average_order_gap is None
    assert kept[1].unique_products == 2 and kept[1].customer_tenure_days == 4
    expected = {row.customer_id: row for row in joined_summary(spark, same_day).collect()}
    for customer, row in expected.items():
        assert kept[customer].frequency == row.frequency and kept[customer].monetary_value == row.monetary
        if row.gap is not None:
            assert float(kept[customer].average_order_gap) == pytest.approx(row.gap, abs=0.005)


def test_gap_rows(same_day):
    gaps = churn.order_gaps(churn.customer_orders(same_day, CUTOFF)).where("customer_id = 1")
    assert {row.invoice: row.order_gap for row in gaps.collect()} == {"a": None, "b": 0, "c": 4}


def test_mean_gap_equals_the_lagged_mean(spark, same_day):
    found = {row.customer_id: row.average_order_gap for row in features.average_order_gap(same_day).collect()}
    assert found == {1: 2.0}


def test_window_edges_are_midnights(spark):
    edge = lines(
        spark,
        [
            (1, "a", "p", "2011-09-10 00:00:00", 1, "1"),
            (2, "b", "p", "2011-09-10 00:00:01", 1, "1"),
            (3, "c", "p", "2011-12-09 00:00:00", 1, "1"),
            (4, "d", "p", "2011-12-09 00:00:01", 1, "1"),
        ],
    )
    labels = {row.customer_id: row.churned for row in churn.churn_labels(edge, CUTOFF, END).collect()}
    assert labels == {1: 1, 2: 0, 3: 0, 4: 1}
    known = churn.churn_features(edge, CUTOFF)
    assert [row.customer_id for row in known.collect()] == [1]
    counted = churn.feature_label_counts(known, churn.churn_labels(edge, CUTOFF, END)).first()
    assert counted.total_feature_customers == 1 and counted.customers_without_label == 0
    modeling = churn.churn_modeling(known, churn.churn_labels(edge, CUTOFF, END))
    assert modeling.columns == CHURN_MODELING.fieldNames()


def test_zero_revenue_gives_no_rate(spark):
    table = lines(spark, [(1, "a", "p", "2011-01-01 00:00:00", 2, "0"), (1, "b", "p", "2011-01-02 00:00:00", -2, "0")])
    row = features.customer_features(table).first()
    assert row.return_value_rate is None and row.return_line_items == 1 and row.average_order_gap == Decimal("1.00")


def test_empty_lines_give_zeros(spark):
    empty = lines(spark, [])
    modeling = spark.createDataFrame([], CHURN_MODELING)
    row = sales.executive_kpis(sales.order_table(sales.report_totals(empty)), modeling).first()
    assert row.total_customers == row.total_orders == row.total_quantity == row.churned_customers == 0
    assert row.average_order_value == 0.0 and row.churn_rate == 0.0 and row.first_transaction_date is None
    assert sales.returns_summary(empty, True).first().returned_value == 0
    assert features.customer_features(empty).count() == 0


def test_recency_counts_from_the_last_line_of_all(spark):
    table = lines(spark, [(1, "a", "p", "2011-01-01 09:00:00", 1, "5"), (None, "b", "p", "2011-01-21 09:00:00", 1, "5")])
    assert features.customer_features(table).first().recency_days == 21
    assert features.customer_metrics(table).count() == 1


def test_few_customers_get_scores(spark):
    table = lines(spark, [(c, str(c), "p", f"2011-01-0{c} 00:00:00", 1, "5") for c in (1, 2, 3, 4)])
    scored = {r.customer_id: r for r in rfm.customer_rfm(features.customer_features(table)).collect()}
    assert [scored[c].m_score for c in (1, 2, 3, 4)] == [1, 2, 3, 4]
    assert scored[4].r_score == 4 and scored[4].customer_segment == "Champions"


def test_lookup_takes_repeated_and_unknown_ids(spark, same_day):
    ids = spark.createDataFrame([(1,), (1,), (3,), (None,)], "customer_id bigint")
    found = sales.purchase_history(same_day, ids, 2).collect()
    assert len(found) == 2 and {row.customer_id for row in found} == {1}
    assert {row.customer_id for row in sales.customer_purchase_trend(same_day, ids).collect()} == {1}


def test_constant_feature_histogram(spark):
    frame = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert [tuple(row) for row in churn.feature_histogram(frame, ["x"]).collect()] == [("x", 16, 2)]


def test_segments_by_rule(spark):
    cases = {
        (5, 5, 5): "Champions", (4, 3, 5): "Loyal Customers", (5, 2, 5): "New / Promising", (2, 3, 3): "At Risk",
        (1, 2, 5): "Lost / Inactive", (3, 5, 5): "Potential Loyalists", (5, 4, 2): "Potential Loyalists",
    }
    frame = spark.createDataFrame([(*scores, name) for scores, name in cases.items()], "r_score int, f_score int, m_score int, name string")
    assert rfm.rfm_segment(frame).where(F.col("customer_segment") != F.col("name")).count() == 0
