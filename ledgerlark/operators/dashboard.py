"""Figures the dashboard derives from the reports; data only."""

from pyspark.sql import functions as F

from ledgerlark.functions.exact import ratio
from ledgerlark.functions.text import FORMATS
from ledgerlark.operators.cleaning import UNKNOWN_DESCRIPTION
from ledgerlark.operators.rfm import rfm_segments
from ledgerlark.schemas import MONEY


def peak_months(monthly):
    """The months of highest revenue and most orders, the earliest of equals."""
    earliest = -F.unix_date("month")
    peaks = monthly.agg(
        F.max_by(F.struct("month", "revenue"), F.struct("revenue", earliest)).alias("by_revenue"),
        F.max_by(F.struct("month", "orders"), F.struct("orders", earliest)).alias("by_orders"),
    )
    return peaks.select(
        F.col("by_revenue.month").alias("highest_revenue_month"),
        F.col("by_revenue.revenue").alias("highest_revenue"),
        F.col("by_orders.month").alias("highest_order_month"),
        F.col("by_orders.orders").alias("highest_orders"),
    )


def monthly_series(monthly):
    """Revenue, orders, customers and units as (month, series, value) rows."""
    names = ["revenue", "orders", "customers", "quantity"]
    values = monthly.select("month", *[F.col(name).cast(MONEY).alias(name) for name in names])
    return values.unpivot(["month"], names, "series", "value").orderBy("series", "month")


def monthly_total_units(monthly):
    return monthly.agg(F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("total_quantity"))


def top_countries(country, n=10):
    """The leading countries by revenue and by customers, as two ranked lists."""
    def ranked(measure):
        leading = country.orderBy(F.desc(measure), "country").limit(n)
        return leading.select(F.lit(measure).alias("ranking"), "country", F.col(measure).cast(MONEY).alias("value"))

    return ranked("revenue").unionByName(ranked("customers"))


def product_labels(products, measure="revenue", n=10):
    """Leading products with a short label."""
    text = F.substring(F.coalesce("description", F.lit(UNKNOWN_DESCRIPTION)), 1, 40)
    return (
        products.orderBy(F.desc(measure), "stock_code", "description")
        .limit(n)
        .select(F.concat(F.col("stock_code"), F.lit(" — "), text).alias("product"), F.col(measure).alias(measure))
    )


def business_takeaways(country, by_revenue, by_quantity):
    """Leading country, leading product and highest-volume product in one row."""
    first_country = country.agg(F.max_by(F.struct("country", "revenue"), "revenue").alias("c"))
    product = by_revenue.agg(F.max_by(F.struct("stock_code", "revenue"), "revenue").alias("p")).scalar()
    volume = by_quantity.agg(F.max_by(F.struct("stock_code", "quantity"), "quantity").alias("q")).scalar()
    return first_country.withColumns({"p": product, "q": volume}).select(
        F.col("c.country").alias("leading_country"),
        F.col("c.revenue").alias("leading_country_revenue"),
        F.col("p.stock_code").alias("leading_product"),
        F.col("p.revenue").alias("leading_product_revenue"),
        F.col("q.stock_code").alias("highest_volume_product"),
        F.col("q.quantity").alias("highest_volume_units"),
    )


def risk_share(distribution):
    """Each risk level's share of all predictions, next to the number at high risk."""
    totals = distribution.agg(
        F.struct(
            F.sum("customers").alias("all"),
            F.coalesce(F.sum(F.when(F.col("risk_level") == "HIGH", F.col("customers"))), F.lit(0)).alias("high"),
        ).alias("t")
    ).scalar()
    return distribution.withColumn("t", totals).select(
        "risk_level",
        "customers",
        F.coalesce(ratio("customers", "t.all"), F.lit(0.0)).alias("share"),
        F.col("t.high").alias("high_risk_customers"),
    )


def segment_overview(rfm):
    return rfm_segments(rfm).select("segment", "customers", "revenue")


def behavior_comparison(statistics):
    """Active against churned customers under display names."""
    # Display names.
    names = {
        "status": "Status",
        "customers": "Customers",
        "avg_recency": "Avg Recency",
        "avg_frequency": "Avg Frequency",
        "avg_monetary_value": "Avg Monetary Value",
        "avg_order_value": "Avg Order Value",
        "avg_unique_products": "Avg Unique Products",
        "avg_quantity": "Avg Quantity",
        "avg_order_gap": "Avg Order Gap",
        "avg_tenure": "Avg Tenure",
    }
    return statistics.select(*[F.col(name).alias(shown) for name, shown in names.items()])


def display_table(df, formats, names=None):
    """Columns as display text: ``formats`` maps a column to a kind of text, ``names`` renames."""
    shown = df.withColumns({column: FORMATS[kind](F.col(column)) for column, kind in formats.items()})
    return shown.withColumnsRenamed(names or {})


def prediction_label(predictions):
    text = F.when(F.col("prediction") == 1, "Likely to Churn").otherwise("Likely to Stay")
    return predictions.withColumn("prediction_text", text)
