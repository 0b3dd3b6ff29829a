"""What the plans of stored tables, reports and lookups read and shuffle."""

import re

import pytest

from ledgerlark.operators import audit, churn, cleaning, lookup, sales
from ledgerlark.plans import checks, lineage, registry
from ledgerlark.plans.tables import Tables, tables

SF_DIR = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def scans(frame, folder):
    return len(re.findall(rf"Location: InMemoryFileIndex \[[^\]]*{folder}", plan(frame)))


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark, SF_DIR)


@pytest.mark.parametrize("build", [churn.churn_features, churn.churn_features_exact, churn.customer_orders])
def test_churn_features_read_known_months_once(t, build):
    text = plan(build(t.monthly_customer_lines, t.cutoff))
    assert scans(build(t.monthly_customer_lines, t.cutoff), "clean-lines") == 1
    assert re.search(r"PartitionFilters: \[.*invoice_month#\d+ <= 2001-05", text)


def test_month_filter_changes_nothing(t):
    whole = churn.churn_features(t.customer_lines, t.cutoff)
    pruned = churn.churn_features(t.monthly_customer_lines, t.cutoff)
    assert whole.exceptAll(pruned).count() == pruned.exceptAll(whole).count() == 0 and whole.count() > 0


def test_tables_that_group_every_line_are_built_in_small_tasks(t):
    """Their aggregates hold about a row for each line, so a task reads and gathers few; what is stored is of the main session."""
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    for frame in (t.raw_aside, t.build_features(), t.build_features_with_returns(), t.build_churn_features()):
        assert [frame.sparkSession.conf.get(name) for name in settings] == [lineage.LINE_BYTES] * 2
        assert int(frame.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= lineage.LINE_PARTITIONS
    usual = [t.spark.conf.get(name) for name in settings]
    for frame in (t.features, t.churn_features, t.customers):
        assert [frame.sparkSession.conf.get(name) for name in settings] == usual != [lineage.LINE_BYTES] * 2


def test_lookup_takes_customers_from_features(spark):
    """A lookup groups lines for the features only, which hold the customer dimension too."""
    fresh = Tables(spark, SF_DIR)
    assert registry._customer_360(fresh).count() > 0
    assert "features" in vars(fresh) and "customers" not in vars(fresh)
    assert fresh.scored_customers.schema.simpleString() == fresh.customers.schema.simpleString()
    assert fresh.scored_customers.exceptAll(fresh.customers).count() == fresh.customers.exceptAll(fresh.scored_customers).count() == 0


def test_reports_count_without_copying_rows(t):
    reports = [
        sales.executive_kpis(t.orders, t.modeling), sales.monthly_revenue(t.orders), sales.monthly_revenue_detail(t.orders),
        sales.country_summary(t.orders), sales.country_revenue(t.orders), sales.year_month_revenue(t.orders),
    ]
    for report in reports:
        assert "Expand" not in plan(report) and scans(report, "clean-lines") == 0
        assert "kind" in re.search(r"PartitionFilters: \[(.*)\]", plan(report)).group(1)


def test_report_totals_scan_lines_once(t):
    assert scans(sales.report_totals(t.sales), "clean-lines") == 1
    blocks = registry._report_blocks(t)
    assert all(scans(frame, "clean-lines") == 0 for frame, _ in blocks.values())


def test_orders_across_months_and_countries(spark):
    """An invoice or a customer in several groups counts once in each, null countries in theirs."""
    rows = [(1, "a", "2011-01-31", "UK"), (1, "a", "2011-02-01", "UK"), (1, "a", "2011-02-01", None), (2, "a", "2011-02-03", "UK"), (2, "b", "2011-02-03", None), (None, "c", "2011-02-03", "UK")]
    table = spark.createDataFrame([(c, i, "p", "d", 2, d, "5", k) for c, i, d, k in rows], "customer_id bigint, invoice string, stock_code string, description string, quantity int, d string, r string, country string")
    lines = table.selectExpr("*", "cast(d as timestamp_ntz) invoice_date", "cast(r as decimal(14,2)) revenue")
    totals = lineage.cut(sales.report_totals(lines))
    orders = sales.order_table(totals)
    months = {str(r.month): (r.orders, r.customers, r.quantity) for r in sales.monthly_revenue_detail(orders).collect()}
    assert months == {"2011-01-01": (1, 1, 2), "2011-02-01": (2, 2, 8)}
    countries = {r.country: (r.orders, r.customers) for r in sales.country_summary(orders).collect()}
    assert countries == {"UK": (1, 2), None: (2, 2)}
    (product,) = sales.product_table(totals).collect()
    assert (product.orders, product.quantity) == (3, 12)


def test_bucketed_tables_join_without_a_shuffle(spark, t):
    joined = registry._joined_by_bucket(t)
    text = plan(joined)
    assert "SortMergeJoin" in text and "Exchange" not in text and text.count("Bucketed: true") == 2
    assert joined.count() == t.modeling.count()


def test_observed_counts_cost_no_scan(t):
    assert scans(audit.missing_table(t.written_raw[1](), t.raw.columns), "raw-lines") == 0
    checks = cleaning.quality_table(t.written_clean[1]())
    assert scans(checks, "clean-lines") == 0
    assert {r.rule: r.violations for r in checks.collect()} == {r.rule: r.violations for r in cleaning.quality_checks(t.sales).collect()}


def test_observed_counts_of_faulty_and_empty_lines(spark, t):
    for lines in (cleaning.clean(t.raw_aside.limit(0)), cleaning.typed_lines(registry._without_keys(t.raw_aside))):
        seen, counts = lineage.observed(spark, lines, cleaning.quality_measures(lines.columns, cleaning.is_sale()))
        stored = spark.read.parquet(written(seen))
        wanted = cleaning.quality_checks(cleaning.sales_lines(stored))
        assert cleaning.quality_table(counts()).exceptAll(wanted).count() == 0


def written(frame):
    path = lineage.scratch_path(frame.sparkSession, "seen")
    frame.write.parquet(path)
    return path


def test_models_fit_after_observed_writes(t):
    """Observing a write leaves the session fit for model pipelines."""
    assert t.written_clean[1]().count() == 1
    assert checks.logistic_model(t.split, t.logistic).first().at_rest


def test_sketches_are_read_instead_of_orders(t):
    estimate = sales.estimated_counts(t.count_sketches, "country")
    assert scans(estimate, "report-totals") == scans(estimate, "clean-lines") == 0 and scans(estimate, "count-sketches") == 1
    exact = {r.country: r for r in sales.exact_counts(t.orders, "country").collect()}
    for row in estimate.collect():
        assert abs(row.customers - exact[row.country].customers) <= 0.03 * exact[row.country].customers
        assert abs(row.orders - exact[row.country].orders) <= 0.03 * exact[row.country].orders


def test_parameters_are_bound(spark, t):
    assert lookup.purchases(spark, t.sales, []).count() == 0
    (first,) = t.customers.orderBy("customer_id").limit(1).collect()
    found = lookup.purchases(spark, t.sales, [first.customer_id, -5], 2).collect()
    assert len(found) == 2 and {r.customer_id for r in found} == {first.customer_id}
    one = lookup.profile(spark, [first.customer_id], t.customers, t.rfm, t.predictions)
    assert one.count() == 1
    assert lookup.profile(spark, [first.customer_id], t.customers, t.rfm, t.predictions, 2.0).count() == 0
