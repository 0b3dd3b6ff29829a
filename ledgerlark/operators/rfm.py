"""RFM scores, segments and segment reports."""

from pyspark.sql import functions as F

from ledgerlark.functions import ranking
from ledgerlark.functions.exact import count_if, mean, money_sum, ratio, rounded_mean, rounded_ratio
from ledgerlark.plans.lineage import cut


def rfm_scores(features, k=5):
    """Quintile scores: recent, frequent and valuable customers score high. Ties go
    by customer id. ``features`` should be a stored table."""
    return ranking.add_ntile(
        features,
        k,
        "customer_id",
        {
            "r_score": -F.col("recency_days"),
            "f_score": F.col("frequency"),
            "m_score": F.col("monetary_value"),
        },
    )


def rfm_score_code(scored):
    return scored.withColumn("rfm_score", F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")]))


# Segment names and score bounds, in order of precedence, and the name of all others.
SEGMENT_RULES = [
    ("Champions", "r_score >= 4 AND f_score >= 4 AND m_score >= 4"),
    ("Loyal Customers", "r_score >= 4 AND f_score >= 3 AND m_score >= 3"),
    ("New / Promising", "r_score >= 4 AND f_score <= 2"),
    ("At Risk", "r_score <= 2 AND f_score >= 3 AND m_score >= 3"),
    ("Lost / Inactive", "r_score <= 2 AND f_score <= 2"),
]
OTHER_SEGMENT = "Potential Loyalists"


def rfm_segment(scored):
    """Name the segment of each score combination; the first matching rule wins."""
    named = [F.when(F.expr(rule), F.lit(name)) for name, rule in SEGMENT_RULES]
    return scored.withColumn("customer_segment", F.coalesce(*named, F.lit(OTHER_SEGMENT)))


def customer_rfm(features, k=5):
    """Features with scores, score code and segment. The features are stored first:
    scoring scans them several times."""
    return rfm_segment(rfm_score_code(rfm_scores(cut(features, "features"), k)))


def rfm_lookup(rfm, ids):
    wanted = ids.select("customer_id").distinct()
    return rfm.join(wanted, "customer_id", "left_semi").select(
        "customer_id", "recency_days", "frequency", "monetary_value", "average_order_value",
        "r_score", "f_score", "m_score", "customer_segment",
    )


def segment_revenue(rfm):
    return (
        rfm.groupBy("customer_segment")
        .agg(F.count(F.lit(1)).alias("customers"), money_sum("monetary_value").alias("revenue"))
        .orderBy(F.desc("revenue"), "customer_segment")
    )


def segment_share(rfm):
    counts = rfm.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))
    total = counts.agg(F.sum("customers")).scalar()
    return counts.withColumn("customer_percentage", rounded_ratio("customers", total, 100)).orderBy(
        F.desc("customers"), "customer_segment"
    )


def segment_profile(rfm):
    """Rounded averages per segment."""
    averaged = {
        "avg_recency": "recency_days",
        "avg_frequency": "frequency",
        "avg_monetary": "monetary_value",
        "avg_aov": "average_order_value",
        "avg_unique_products": "unique_products",
        "avg_order_gap": "average_order_gap",
    }
    return (
        rfm.groupBy("customer_segment")
        .agg(*[rounded_mean(column).alias(name) for name, column in averaged.items()])
        .orderBy(F.desc("avg_monetary"), "customer_segment")
    )


def rfm_segments(rfm):
    """Customers, revenue and unrounded averages per segment."""
    averaged = {
        "avg_recency": "recency_days",
        "avg_frequency": "frequency",
        "avg_monetary_value": "monetary_value",
        "avg_order_value": "average_order_value",
        "avg_unique_products": "unique_products",
        "avg_order_gap": "average_order_gap",
    }
    return (
        rfm.groupBy(F.col("customer_segment").alias("segment"))
        .agg(
            F.count(F.lit(1)).alias("customers"),
            money_sum("monetary_value").alias("revenue"),
            *[mean(column).alias(name) for name, column in averaged.items()],
        )
        .orderBy(F.desc("revenue"), "segment")
    )


def score_distribution(rfm):
    """Customers per value of each score."""
    scores = rfm.select("r_score", "f_score", "m_score").unpivot(
        [], ["r_score", "f_score", "m_score"], "score_name", "score"
    )
    return scores.groupBy("score_name", "score").agg(F.count(F.lit(1)).alias("customers")).orderBy("score_name", "score")


def top_monetary_customers(rfm, n=20):
    return (
        rfm.select(
            "customer_id", "country", "frequency", "monetary_value", "average_order_value", "recency_days", "customer_segment"
        )
        .orderBy(F.desc("monetary_value"), "customer_id")
        .limit(n)
    )


def most_inactive_customers(rfm, n=20):
    return (
        rfm.select("customer_id", "country", "recency_days", "frequency", "monetary_value", "customer_segment")
        .orderBy(F.desc("recency_days"), "customer_id")
        .limit(n)
    )


def one_order_customers(rfm):
    """Customers with a single order, per segment, next to their overall number."""
    counts = rfm.where(F.col("frequency") == 1).groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"))
    total = counts.agg(F.sum("customers")).scalar()
    return counts.withColumn("one_order_customers", total).orderBy(F.desc("customers"), "customer_segment")


def order_gap_stats(rfm):
    return rfm.agg(
        F.min("average_order_gap").alias("min_gap"),
        rounded_mean("average_order_gap").alias("avg_gap"),
        F.max("average_order_gap").alias("max_gap"),
        count_if(F.col("average_order_gap").isNull()).alias("customers_without_gap"),
    )


def gap_missing_by_frequency(rfm):
    return (
        rfm.groupBy("frequency")
        .agg(F.count(F.lit(1)).alias("customers"), count_if(F.col("average_order_gap").isNull()).alias("missing_gap"))
        .orderBy("frequency")
    )


def return_rate_by_segment(rfm):
    return (
        rfm.groupBy("customer_segment")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            rounded_mean("return_value_rate").alias("avg_return_rate"),
            F.max("return_value_rate").alias("max_return_rate"),
        )
        .orderBy(F.desc("avg_return_rate"), "customer_segment")
    )


def rfm_sample(rfm, n=20):
    """First customers by id with scores; ``segment`` is another name of the segment column."""
    return (
        rfm.select(
            "customer_id", "r_score", "f_score", "m_score", "rfm_score", "monetary_value",
            F.col("customer_segment").alias("segment"),
        )
        .orderBy("customer_id")
        .limit(n)
    )


def segment_counts(rfm):
    """Customers per segment with their share, most frequent first."""
    counts = rfm.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("rows"))
    total = counts.agg(F.sum("rows")).scalar()
    return counts.withColumn("share", ratio(F.col("rows") * 100, total)).orderBy(F.desc("rows"), "customer_segment")
