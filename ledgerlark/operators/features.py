"""Per-customer behaviour features.

Everything per customer is built in steps (customer, invoice, day) ->
(customer, invoice) -> customer. Each step is a map-side combined aggregate, so a
customer with most of all lines is reduced before its rows meet in one task.
"""

from pyspark.sql import functions as F

from ledgerlark.functions.exact import count_if, ratio, rounded_money_rate, rounded_ratio
from ledgerlark.operators.sales import identified
from ledgerlark.schemas import GAP, MONEY, PRICE


def analysis_date(lines):
    """One day after the last line, time of day kept."""
    return lines.agg((F.max("invoice_date") + F.expr("INTERVAL 1 DAY")).alias("analysis_date"))


def _returned(value):
    return F.sum(F.when(F.col("quantity") < 0, value))


def order_days(lines):
    """One row per (customer, invoice, calendar day) with everything later steps add up."""
    units = F.abs("quantity")
    return (
        identified(lines)
        .groupBy("customer_id", "invoice", F.to_date("invoice_date").alias("order_date"))
        .agg(
            F.min("invoice_date").alias("first_date"),
            F.max("invoice_date").alias("last_date"),
            F.max("country").alias("country"),
            F.sum("revenue").alias("revenue"),
            F.sum("quantity").alias("quantity"),
            count_if(F.col("quantity") < 0).alias("return_lines"),
            _returned(units).alias("returned_units"),
            _returned(units * F.col("price")).alias("returned_value"),
        )
    )


def order_dates(lines):
    return (
        identified(lines)
        .select("customer_id", "invoice", F.to_date("invoice_date").alias("order_date"))
        .distinct()
    )


def _per_customer(lines):
    invoices = order_days(lines).groupBy("customer_id", "invoice").agg(
        F.count(F.lit(1)).alias("days"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
        F.max("country").alias("country"),
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.sum("return_lines").alias("return_lines"),
        F.sum("returned_units").alias("returned_units"),
        F.sum("returned_value").alias("returned_value"),
    )
    return invoices.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.sum("days").alias("order_rows"),
        F.min("first_date").alias("first_purchase_date"),
        F.max("last_date").alias("last_purchase_date"),
        F.max("country").alias("country"),
        F.sum("revenue").cast(MONEY).alias("monetary_value"),
        F.sum("quantity").alias("total_quantity"),
        F.sum("return_lines").alias("return_line_items"),
        F.coalesce(F.sum("returned_units"), F.lit(0)).cast("bigint").alias("returned_quantity"),
        F.round(F.coalesce(F.sum("returned_value"), F.lit(0)), 2).cast(MONEY).alias("returned_value"),
    )


def products_per_customer(lines):
    """Distinct products of each customer: pairs first, so that no customer's products meet in one task unreduced."""
    pairs = identified(lines).select("customer_id", "stock_code").distinct()
    return pairs.groupBy("customer_id").agg(F.count("stock_code").alias("unique_products"))


def _with_recency(customers, lines):
    today = analysis_date(lines).scalar()
    return customers.withColumns(
        {
            "recency_days": F.datediff(today, "last_purchase_date"),
            "customer_tenure_days": F.datediff("last_purchase_date", "first_purchase_date"),
            "average_order_value": rounded_ratio("monetary_value", "frequency"),
        }
    )


def customer_metrics(lines):
    """Dates, orders, revenue, products and units of each identified customer."""
    customers = _per_customer(lines).join(products_per_customer(lines), "customer_id")
    return _with_recency(customers, lines).select(
        "customer_id", "first_purchase_date", "last_purchase_date", "frequency", "monetary_value",
        "average_order_value", "unique_products", "total_quantity", "recency_days", "customer_tenure_days",
    )


def average_order_gap(lines):
    """Mean days between consecutive order rows; customers with one order row are absent.

    The gaps between sorted days add up to last minus first, so the mean needs no
    window over a customer's orders.
    """
    spans = order_dates(lines).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("n"), F.datediff(F.max("order_date"), F.min("order_date")).alias("span")
    )
    return spans.where(F.col("n") > 1).select(
        "customer_id", ratio("span", F.col("n") - 1).alias("average_order_gap")
    )


def return_metrics(lines):
    """Return lines, units and value of customers that returned something."""
    return (
        identified(lines)
        .where(F.col("quantity") < 0)
        .groupBy("customer_id")
        .agg(
            F.count(F.lit(1)).alias("return_line_items"),
            F.sum(F.abs("quantity")).alias("returned_quantity"),
            F.round(F.sum(F.abs("quantity") * F.col("price")), 2).cast(MONEY).alias("returned_value"),
        )
    )


def customer_features(lines):
    """The full feature table, one row per identified customer."""
    customers = _per_customer(lines).join(products_per_customer(lines), "customer_id")
    span = F.datediff("last_purchase_date", "first_purchase_date")
    return _with_recency(customers, lines).select(
        "customer_id",
        "country",
        "first_purchase_date",
        "last_purchase_date",
        "recency_days",
        "frequency",
        "monetary_value",
        "average_order_value",
        "unique_products",
        "total_quantity",
        F.when(F.col("order_rows") > 1, rounded_ratio(span, F.col("order_rows") - 1)).cast(GAP).alias("average_order_gap"),
        "return_line_items",
        "returned_quantity",
        "returned_value",
        rounded_money_rate("returned_value", "monetary_value").alias("return_value_rate"),
        "customer_tenure_days",
    )


def feature_null_audit(features):
    audited = {
        "null_recency": "recency_days",
        "null_frequency": "frequency",
        "null_monetary": "monetary_value",
        "null_aov": "average_order_value",
        "null_products": "unique_products",
        "null_tenure": "customer_tenure_days",
    }
    return features.agg(*[count_if(F.col(column).isNull()).alias(name) for name, column in audited.items()])


def customers_with_returns(features):
    return features.agg(
        count_if(F.col("return_line_items") > 0).alias("customers_with_returns"),
        count_if(F.col("returned_quantity") > 0).alias("customers_with_returned_qty"),
        count_if(F.col("returned_value") > 0).alias("customers_with_returned_value"),
        F.max("return_value_rate").alias("max_return_rate"),
    )


def feature_row_count(df):
    return df.agg(F.count(F.lit(1)).alias("customers"))


def feature_sample(df, n=10):
    return df.orderBy("customer_id").limit(n)


def customers_dim(lines):
    """Customer dimension derived from the lines."""
    return customers_of_features(_per_customer(lines))


def customers_of_features(features):
    """The same as columns of the feature table of those lines, for jobs that need that too."""
    return features.select(
        "customer_id",
        "country",
        "first_purchase_date",
        "last_purchase_date",
        F.col("frequency").alias("total_orders"),
        F.col("monetary_value").alias("total_revenue"),
    )


def products_dim(lines):
    """Product dimension derived from the lines."""
    return (
        lines.groupBy("stock_code")
        .agg(
            F.max("description").alias("description"),
            F.sum("price").alias("prices"),
            F.count("price").alias("n"),
            F.sum("quantity").alias("total_quantity"),
            F.sum("revenue").cast(MONEY).alias("total_revenue"),
        )
        .select(
            "stock_code",
            "description",
            F.round(F.col("prices").cast("decimal(24,4)") / F.col("n").cast("decimal(18,0)"), 4)
            .cast(PRICE)
            .alias("average_price"),
            "total_quantity",
            "total_revenue",
        )
    )
