"""Churn labels, churn features and the modelling table.

The cut-off is a midnight timestamp: lines later on the cut-off day belong to the
label window, lines later on the last day to neither window.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions.exact import count_if, mean, rounded_ratio
from ledgerlark.operators.sales import churn_population, identified
from ledgerlark.schemas import GAP, MODEL_FEATURES, MONEY

# The study's feature cut-off and end of the label window.
DEFAULT_CUTOFF = "2011-09-10"
DEFAULT_END = "2011-12-09"


def _midnight(day):
    return F.lit(day).cast("timestamp_ntz")


def churn_labels(lines, cutoff=DEFAULT_CUTOFF, end=DEFAULT_END):
    """Per identified customer: lines inside the label window, churned = 1 if there are none."""
    future = (F.col("invoice_date") > _midnight(cutoff)) & (F.col("invoice_date") <= _midnight(end))
    counted = identified(lines).groupBy("customer_id").agg(count_if(future).alias("future_purchase_lines"))
    return counted.select(
        "customer_id",
        F.when(F.col("future_purchase_lines") == 0, 1).otherwise(0).alias("churned"),
        "future_purchase_lines",
    )


def label_counts(labels):
    """Customers per label, next to the overall churn rate in percent."""
    counts = labels.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"))
    rate = labels.agg(rounded_ratio(F.sum("churned"), F.count(F.lit(1)), 100)).scalar()
    return counts.withColumn("churn_rate", rate).orderBy("churned")


def _known_lines(lines, cutoff):
    """Lines up to the cut-off. Lines stored by month are read up to its month only: a
    condition on the date alone would open every file."""
    known = identified(lines).where(F.col("invoice_date") <= _midnight(cutoff))
    if "invoice_month" in lines.columns:
        known = known.where(F.col("invoice_month") <= F.lit(str(cutoff)[:7]))
    return known


def customer_orders(lines, cutoff=DEFAULT_CUTOFF):
    """Per (customer, invoice) up to the cut-off: day of the first line and order revenue."""
    return _known_lines(lines, cutoff).groupBy("customer_id", "invoice").agg(
        F.to_date(F.min("invoice_date")).alias("order_date"), F.sum("revenue").cast(MONEY).alias("order_revenue")
    )


def order_day_totals(orders):
    """Orders per customer and day with the previous order day.

    The window runs over days, not orders, so its groups cannot exceed the number
    of days in the data, however many orders one customer placed.
    """
    days = orders.groupBy("customer_id", "order_date").agg(
        F.count(F.lit(1)).alias("orders"),
        F.sum("order_revenue").alias("day_revenue"),
        F.min("invoice").alias("first_invoice"),
    )
    by_day = Window.partitionBy("customer_id").orderBy("order_date")
    return days.withColumn("day_gap", F.datediff("order_date", F.lag("order_date").over(by_day)))


def order_gaps(orders):
    """Days since the customer's previous order, in (day, invoice) order; null for the first.

    Only the first invoice of a day can have a gap, the others follow at distance 0.
    """
    days = order_day_totals(orders).select("customer_id", "order_date", "first_invoice", "day_gap")
    gap = F.when(F.col("invoice") == F.col("first_invoice"), F.col("day_gap")).otherwise(0)
    return orders.join(days, ["customer_id", "order_date"]).select(
        "customer_id", "invoice", "order_date", gap.alias("order_gap")
    )


def _customer_days(lines, cutoff):
    """Per customer and order day the orders and their revenue, and in one row without a day the
    products and units: two groupings of one scan.

    Grouping sets make order rows (customer, invoice) and product rows (customer, stock code) of each
    line before the shuffle; a customer with most lines is spread by invoice and code. The day's
    row then carries the previous order day; a window runs over at most the days of the data.
    """
    both = [[F.col("customer_id"), F.col("invoice")], [F.col("customer_id"), F.col("stock_code")]]
    first = _known_lines(lines, cutoff).groupingSets(both, F.col("customer_id"), F.col("invoice"), F.col("stock_code")).agg(
        (F.grouping("stock_code") == 1).alias("is_order"),
        F.to_date(F.min("invoice_date")).alias("day"),
        F.sum("revenue").cast(MONEY).alias("revenue"),
        F.sum("quantity").alias("quantity"),
    )
    order = F.col("is_order")
    days = first.groupBy("customer_id", F.when(order, F.col("day")).alias("order_date")).agg(
        count_if(order).alias("orders"),
        F.sum(F.when(order, F.col("revenue"))).alias("day_revenue"),
        count_if(~order & F.col("stock_code").isNotNull()).alias("products"),
        F.sum(F.when(~order, F.col("quantity"))).alias("quantity"),
    )
    # the row without a day comes first, so the first day's gap is null
    by_day = Window.partitionBy("customer_id").orderBy("order_date")
    return days.withColumn("day_gap", F.datediff("order_date", F.lag("order_date").over(by_day)))


def _feature_table(lines, cutoff, **summary):
    """``summary``: how frequency, value, gap sum and gap count follow from a customer's days."""
    totals = _customer_days(lines, cutoff).groupBy("customer_id").agg(
        F.min("order_date").alias("first_day"),
        F.max("order_date").alias("last_day"),
        F.sum("products").alias("unique_products"),
        F.sum("quantity").alias("total_quantity"),
        *[column.alias(name) for name, column in summary.items()],
    )
    return totals.select(
        "customer_id",
        F.datediff(F.lit(cutoff).cast("date"), "last_day").alias("recency_days"),
        "frequency",
        F.round("monetary_value", 2).cast(MONEY).alias("monetary_value"),
        rounded_ratio("monetary_value", "frequency").alias("average_order_value"),
        "unique_products",
        "total_quantity",
        rounded_ratio("gap_sum", "gap_count").cast(GAP).alias("average_order_gap"),
        F.datediff("last_day", "first_day").alias("customer_tenure_days"),
    )


def churn_features(lines, cutoff=DEFAULT_CUTOFF):
    """Churn features with the published fan-out kept.

    There, gap rows are joined back to orders on (customer, day), which is not a
    key: n orders on one day become n x n rows, each order's revenue counts n
    times, and the day's gap counts n times among n x n gap values. Those sums
    follow from n and the day totals, so no joined rows are produced.
    """
    n = F.col("orders")
    first_day = F.col("day_gap").isNull()
    return _feature_table(
        lines,
        cutoff,
        frequency=F.sum(n * n),
        monetary_value=F.sum(n * F.col("day_revenue")),
        gap_sum=F.sum(n * F.coalesce("day_gap", F.lit(0))),
        gap_count=F.sum(F.when(first_day, n * (n - 1)).otherwise(n * n)),
    )


def churn_features_exact(lines, cutoff=DEFAULT_CUTOFF):
    """Churn features with every order counted once."""
    return _feature_table(
        lines,
        cutoff,
        frequency=F.sum("orders"),
        monetary_value=F.sum("day_revenue"),
        gap_sum=F.datediff(F.max("order_date"), F.min("order_date")),
        gap_count=F.sum("orders") - 1,
    )


def _ranges(df, columns):
    measures = []
    for name, column in columns.items():
        measures += [F.min(column).alias(f"min_{name}"), F.max(column).alias(f"max_{name}")]
    return df.agg(*measures)


def churn_feature_ranges(features):
    return _ranges(features, {"recency": "recency_days", "frequency": "frequency", "monetary": "monetary_value"})


def modeling_ranges(modeling):
    return _ranges(
        modeling,
        {
            "recency": "recency_days",
            "frequency": "frequency",
            "monetary": "monetary_value",
            "aov": "average_order_value",
            "tenure": "customer_tenure_days",
        },
    )


def feature_label_counts(features, labels):
    """Feature customers with a label, by label, and those without one."""
    matched = features.select("customer_id").join(labels.select("customer_id", "churned"), "customer_id", "left")
    return matched.agg(
        F.count("churned").alias("total_feature_customers"),
        count_if(F.col("churned") == 1).alias("churned"),
        count_if(F.col("churned") == 0).alias("active"),
        count_if(F.col("churned").isNull()).alias("customers_without_label"),
    )


def churn_modeling(features, labels):
    """Features and label of every customer that has both."""
    return features.join(labels.select("customer_id", "churned"), "customer_id").select(
        "customer_id", *MODEL_FEATURES, "churned"
    )


def modeling_label_share(modeling):
    counts = modeling.groupBy("churned").agg(F.count(F.lit(1)).alias("customers"))
    total = counts.agg(F.sum("customers")).scalar()
    return counts.withColumn("percentage", rounded_ratio("customers", total, 100)).orderBy("churned")


def _status():
    return F.when(F.col("churned") == 1, "Churned").otherwise("Active")


def churn_distribution(modeling):
    return modeling_label_share(modeling).select(_status().alias("status"), "customers", "percentage")


def churn_population_summary(modeling):
    return churn_population(modeling)


def churn_feature_statistics(modeling):
    """Per label: customers and the mean of every feature."""
    averaged = {
        "avg_recency": "recency_days",
        "avg_frequency": "frequency",
        "avg_monetary_value": "monetary_value",
        "avg_order_value": "average_order_value",
        "avg_unique_products": "unique_products",
        "avg_quantity": "total_quantity",
        "avg_total_quantity": "total_quantity",
        "avg_order_gap": "average_order_gap",
        "avg_tenure": "customer_tenure_days",
    }
    return (
        modeling.groupBy("churned")
        .agg(F.count(F.lit(1)).alias("customers"), *[mean(column).alias(name) for name, column in averaged.items()])
        .select(_status().alias("status"), "churned", "customers", *averaged)
        .orderBy("churned")
    )


def feature_skew(modeling, columns=MODEL_FEATURES):
    """Bias-corrected sample skewness per feature, largest first. The built-in is the
    population form; the factor sqrt(n(n-1))/(n-2) corrects it."""
    entries = []
    for name in columns:
        value = F.col(name).cast("double")
        n = F.count(value).cast("double")
        corrected = F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)
        entries.append(F.struct(F.lit(name).alias("feature"), F.when(n > 2, corrected).alias("skew")))
    rows = modeling.agg(F.array(*entries).alias("entries")).select(F.inline("entries"))
    return rows.orderBy(F.desc_nulls_last("skew"), "feature")


def feature_histogram(modeling, columns=MODEL_FEATURES, bins=30):
    """Equal-width bins between each feature's minimum and maximum, the last one closed.
    A constant feature gets a unit-wide range around its value. Empty bins are absent."""
    bounds = modeling.agg(
        F.create_map(
            *[
                part
                for name in columns
                for part in (
                    F.lit(name),
                    F.struct(
                        F.min(F.col(name).cast("double")).alias("low"), F.max(F.col(name).cast("double")).alias("high")
                    ),
                )
            ]
        ).alias("bounds")
    ).scalar()
    values = modeling.select(*[F.col(name).cast("double").alias(name) for name in columns]).unpivot(
        [], list(columns), "feature", "value"
    )
    placed = values.where(F.col("value").isNotNull()).withColumn("range", bounds[F.col("feature")])
    flat = F.col("range.low") == F.col("range.high")
    low = F.when(flat, F.col("range.low") - 0.5).otherwise(F.col("range.low"))
    high = F.when(flat, F.col("range.high") + 0.5).otherwise(F.col("range.high"))
    number = F.least(F.floor((F.col("value") - low) * bins / (high - low)) + 1, F.lit(bins)).cast("int")
    return placed.groupBy("feature", number.alias("bin")).agg(F.count(F.lit(1)).alias("rows")).orderBy("feature", "bin")

