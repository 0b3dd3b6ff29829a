"""Declared schemas of every stored table. Nothing is inferred from data.

Declared source precisions above Spark's maximum of 38 are clamped to 38;
unsigned and wide integer decimals become BIGINT.
"""

from pyspark.sql import types as T

MONEY = T.DecimalType(38, 2)
PRICE = T.DecimalType(12, 4)
LINE_REVENUE = T.DecimalType(14, 2)
GAP = T.DecimalType(13, 2)
PROBABILITY = T.DecimalType(8, 6)


def _schema(*columns):
    return T.StructType([T.StructField(name, dtype, nullable) for name, dtype, nullable in columns])


RAW_LINES = _schema(
    ("Invoice", T.StringType(), True),
    ("StockCode", T.StringType(), True),
    ("Description", T.StringType(), True),
    ("Quantity", T.IntegerType(), True),
    ("InvoiceDate", T.TimestampNTZType(), True),
    ("Price", PRICE, True),
    ("Customer ID", T.LongType(), True),
    ("Country", T.StringType(), True),
)

CLEAN_LINES = _schema(
    ("invoice", T.StringType(), False),
    ("stock_code", T.StringType(), False),
    ("description", T.StringType(), True),
    ("quantity", T.IntegerType(), False),
    ("invoice_date", T.TimestampNTZType(), True),
    ("price", PRICE, False),
    ("customer_id", T.LongType(), True),
    ("country", T.StringType(), True),
    ("revenue", LINE_REVENUE, False),
    ("invalid_price_flag", T.BooleanType(), True),
    ("is_cancellation", T.BooleanType(), True),
    ("is_return", T.BooleanType(), True),
)

# The eleven columns the load step keeps, in table order.
TRANSACTIONS = _schema(
    ("invoice", T.StringType(), False),
    ("stock_code", T.StringType(), False),
    ("description", T.StringType(), True),
    ("quantity", T.IntegerType(), False),
    ("invoice_date", T.TimestampNTZType(), False),
    ("price", PRICE, False),
    ("customer_id", T.LongType(), True),
    ("country", T.StringType(), True),
    ("revenue", LINE_REVENUE, False),
    ("is_cancellation", T.BooleanType(), True),
    ("is_return", T.BooleanType(), True),
)

CUSTOMERS = _schema(
    ("customer_id", T.LongType(), False),
    ("country", T.StringType(), True),
    ("first_purchase_date", T.TimestampNTZType(), True),
    ("last_purchase_date", T.TimestampNTZType(), True),
    ("total_orders", T.LongType(), True),
    ("total_revenue", MONEY, True),
)

PRODUCTS = _schema(
    ("stock_code", T.StringType(), False),
    ("description", T.StringType(), True),
    ("average_price", PRICE, True),
    ("total_quantity", T.LongType(), True),
    ("total_revenue", MONEY, True),
)

CUSTOMER_FEATURES = _schema(
    ("customer_id", T.LongType(), False),
    ("country", T.StringType(), True),
    ("first_purchase_date", T.TimestampNTZType(), True),
    ("last_purchase_date", T.TimestampNTZType(), True),
    ("recency_days", T.IntegerType(), True),
    ("frequency", T.LongType(), False),
    ("monetary_value", MONEY, True),
    ("average_order_value", MONEY, True),
    ("unique_products", T.LongType(), False),
    ("total_quantity", T.LongType(), True),
    ("average_order_gap", GAP, True),
    ("return_line_items", T.LongType(), False),
    ("returned_quantity", T.LongType(), False),
    ("returned_value", MONEY, False),
    ("return_value_rate", MONEY, True),
    ("customer_tenure_days", T.IntegerType(), True),
)

CUSTOMER_RFM = T.StructType(
    CUSTOMER_FEATURES.fields
    + _schema(
        ("r_score", T.IntegerType(), False),
        ("f_score", T.IntegerType(), False),
        ("m_score", T.IntegerType(), False),
        ("rfm_score", T.StringType(), True),
        ("customer_segment", T.StringType(), True),
    ).fields
)

CHURN_FEATURES = _schema(
    ("customer_id", T.LongType(), False),
    ("recency_days", T.IntegerType(), True),
    ("frequency", T.LongType(), False),
    ("monetary_value", MONEY, True),
    ("average_order_value", MONEY, True),
    ("unique_products", T.LongType(), False),
    ("total_quantity", T.LongType(), True),
    ("average_order_gap", GAP, True),
    ("customer_tenure_days", T.IntegerType(), True),
)

CHURN_LABELS = _schema(
    ("customer_id", T.LongType(), False),
    ("churned", T.IntegerType(), False),
    ("future_purchase_lines", T.LongType(), False),
)

CHURN_MODELING = T.StructType(CHURN_FEATURES.fields + [T.StructField("churned", T.IntegerType(), False)])

PREDICTIONS = _schema(
    ("customer_id", T.LongType(), False),
    ("churn_probability", PROBABILITY, False),
    ("prediction", T.ByteType(), False),
    ("risk_level", T.StringType(), False),
    ("prediction_date", T.TimestampNTZType(), False),
)

# Model input, in the order the model is trained on.
MODEL_FEATURES = [
    "recency_days",
    "frequency",
    "monetary_value",
    "average_order_value",
    "unique_products",
    "total_quantity",
    "average_order_gap",
    "customer_tenure_days",
]
