"""Lookups of a few customers as SQL with bound parameters.

The statements are fixed texts; ids and limits are passed as arguments, never formatted
into them, and the tables are given as frames. For many customers ``sales`` and ``scoring`` take
a table of ids instead.
"""

PURCHASES = """
    SELECT * FROM (
        SELECT customer_id,
               row_number() OVER (
                   PARTITION BY customer_id ORDER BY invoice_date DESC, invoice, stock_code, quantity, price, description
               ) AS position,
               invoice, invoice_date, stock_code, description, quantity, price, revenue
        FROM {lines} WHERE array_contains(CAST(:ids AS ARRAY<BIGINT>), customer_id)
    ) WHERE position <= :n
"""

TREND = """
    SELECT customer_id, month, count(*) AS orders, sum(quantity) AS quantity, CAST(sum(revenue) AS DECIMAL(38,2)) AS revenue
    FROM (
        SELECT customer_id, CAST(date_trunc('month', invoice_date) AS DATE) AS month, invoice,
               sum(quantity) AS quantity, sum(revenue) AS revenue
        FROM {lines} WHERE array_contains(CAST(:ids AS ARRAY<BIGINT>), customer_id) GROUP BY ALL
    ) GROUP BY customer_id, month
"""

PROFILE = """
    SELECT c.customer_id, c.country, r.rfm_score, r.customer_segment, p.churn_probability, p.risk_level
    FROM {customers} c LEFT JOIN {rfm} r ON c.customer_id = r.customer_id LEFT JOIN {predictions} p ON c.customer_id = p.customer_id
    WHERE array_contains(CAST(:ids AS ARRAY<BIGINT>), c.customer_id) AND (:least IS NULL OR p.churn_probability >= CAST(:least AS DOUBLE))
"""


def purchases(spark, lines, ids, n=20):
    """Latest ``n`` lines of each of the customers ``ids``."""
    return spark.sql(PURCHASES, args={"ids": list(ids), "n": n}, lines=lines)


def trend(spark, lines, ids):
    """Orders, units and revenue per month of the customers ``ids``."""
    return spark.sql(TREND, args={"ids": list(ids)}, lines=lines)


def profile(spark, ids, customers, rfm, predictions, least=None):
    """Country, segment and prediction of the customers ``ids``, those of a probability of ``least`` on if given."""
    args = {"ids": list(ids), "least": least}
    return spark.sql(PROFILE, args=args, customers=customers, rfm=rfm, predictions=predictions)
