"""Reports over stored predictions."""

from pyspark.sql import functions as F

from ledgerlark.functions.exact import mean
from ledgerlark.schemas import MODEL_FEATURES

# Fixed value: the order in which risk levels are listed.
RISK_ORDER = ["LOW", "MEDIUM", "HIGH"]


def risk_distribution(predictions):
    """Customers and probabilities per risk level, in risk order, unknown levels first."""
    place = F.array_position(F.array(*[F.lit(level) for level in RISK_ORDER]), F.col("risk_level"))
    return (
        predictions.groupBy("risk_level")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            mean("churn_probability").alias("avg_probability"),
            F.max("churn_probability").alias("max_probability"),
            F.min("churn_probability").alias("min_probability"),
        )
        .orderBy(place, "risk_level")
    )


def churn_risk_customers(predictions, modeling, n=20):
    """The ``n`` customers most likely to churn, with their behaviour."""
    return (
        predictions.join(modeling.select("customer_id", *MODEL_FEATURES), "customer_id")
        .select(
            "customer_id", F.col("churn_probability").cast("double").alias("churn_probability"),
            F.col("prediction").cast("int").alias("prediction"), "risk_level", "prediction_date", *MODEL_FEATURES,
        )
        .orderBy(F.desc("churn_probability"), "customer_id")
        .limit(n)
    )


def high_risk_customers(predictions, modeling, n=20):
    return churn_risk_customers(predictions.where(F.col("risk_level") == "HIGH"), modeling, n)


def prediction_status(predictions):
    return predictions.agg(
        F.count(F.lit(1)).alias("prediction_count"),
        F.min("prediction_date").alias("earliest_prediction"),
        F.max("prediction_date").alias("latest_prediction"),
    )


def prediction_coverage(modeling, predictions):
    """Whether every modelling customer has a prediction and there are no others in number."""
    scored = predictions.select("customer_id", F.lit(1).alias("scored")).dropDuplicates(["customer_id"])
    matched = modeling.select("customer_id").join(scored, "customer_id", "left")
    stored = predictions.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = matched.agg(
        F.count(F.lit(1)).alias("modeling_customers"), F.count_if(F.col("scored").isNull()).alias("missing_predictions")
    ).withColumn("prediction_customers", stored)
    valid = (F.col("modeling_customers") == F.col("prediction_customers")) & (F.col("missing_predictions") == 0)
    return counts.withColumn("valid", valid)
