"""SQL counterparts of the registered queries, for an independent engine.

The statements follow the plain relational definition of each result (windows,
self-joins, scalar subqueries) rather than the way the Spark jobs compute it.
Rounded quotients are written in exact integer arithmetic, because that engine's
decimal division yields a double.
"""

from ledgerlark.operators import rfm, scoring
from ledgerlark.schemas import MODEL_FEATURES

BASE = """base AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, p.p_name, p.p_retailprice, n.n_name
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey),
one AS (
  SELECT concat(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'C' ELSE ' ' END, CAST(l_orderkey AS STRING)) AS invoice,
         concat(CAST(l_partkey AS STRING), ' ') AS stockcode,
         CASE WHEN l_partkey % 50 = 0 THEN NULL ELSE concat(' ', p_name) END AS description,
         CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS INT) ELSE CAST(l_quantity AS INT) END AS quantity,
         o_orderdate + l_linenumber * INTERVAL '1' HOUR AS invoicedate,
         CAST(CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 0 ELSE p_retailprice END AS DECIMAL(12,4)) AS price,
         CASE WHEN l_orderkey % 20 = 7 THEN NULL ELSE o_custkey END AS customer_id,
         concat(n_name, ' ') AS country,
         l_orderkey
  FROM base),
raw_lines AS (
  SELECT invoice, stockcode, description, quantity, invoicedate, price, customer_id, country FROM one
  UNION ALL
  SELECT invoice, stockcode, description, quantity, invoicedate, price, customer_id, country FROM one WHERE l_orderkey % 100 = 0),
typed_lines AS (
  SELECT trim(invoice) AS invoice, trim(stockcode) AS stockcode, trim(description) AS description,
         quantity, invoicedate, price, customer_id, trim(country) AS country
  FROM raw_lines),
clean_lines AS (
  SELECT DISTINCT trim(invoice) AS invoice, trim(stockcode) AS stock_code,
         coalesce(trim(description), 'Unknown Product') AS description,
         quantity, invoicedate AS invoice_date, price, customer_id, trim(country) AS country,
         CAST(quantity * price AS DECIMAL(14,2)) AS revenue,
         price <= 0 AS invalid_price_flag,
         substr(upper(trim(invoice)), 1, 1) = 'C' AS is_cancellation,
         quantity < 0 AS is_return
  FROM raw_lines),
sales_lines AS (
  SELECT * FROM clean_lines WHERE price > 0 AND quantity > 0 AND NOT is_cancellation),
customer_lines AS (
  SELECT * FROM sales_lines WHERE customer_id IS NOT NULL)"""


def cents(expression):
    """A money sum as an integer number of hundredths."""
    return f"CAST(sum(CAST({expression} * 100 AS BIGINT)) AS HUGEINT)"


def half_up(numerator, denominator, target="DECIMAL(38,2)"):
    """``numerator`` hundredths over ``denominator``, rounded half up to hundredths."""
    top, bottom = f"CAST({numerator} AS HUGEINT)", f"CAST({denominator} AS HUGEINT)"
    quotient = f"(2*abs({top})+abs({bottom}))//(2*abs({bottom}))"
    signed = f"sign({top})*sign({bottom})*({quotient})"
    return (
        f"CAST(CASE WHEN {bottom} = 0 THEN NULL ELSE "
        f"CAST({signed} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) END AS {target})"
    )


def half_up_mean(column, money=False):
    top = cents(column) if money else f"sum({column})*100"
    return half_up(top, f"count({column})")


def mean(column):
    return f"CAST(sum({column}) AS DOUBLE) / count({column})"


def money(expression):
    return f"CAST({expression} AS DECIMAL(38,2))"


def big(expression):
    return f"CAST({expression} AS BIGINT)"


def features(source, prefix):
    """customer_features over ``source`` as CTE ``{prefix}_features``."""
    return f"""{prefix}_metrics AS (
  SELECT customer_id, max(country) AS country, min(invoice_date) AS first_purchase_date, max(invoice_date) AS last_purchase_date,
         count(DISTINCT invoice) AS frequency, {money('sum(revenue)')} AS monetary_value,
         {half_up(cents('revenue'), 'count(DISTINCT invoice)')} AS average_order_value,
         count(DISTINCT stock_code) AS unique_products, {big('sum(quantity)')} AS total_quantity,
         {cents('revenue')} AS revenue_cents
  FROM {source} WHERE customer_id IS NOT NULL GROUP BY customer_id),
{prefix}_order_dates AS (
  SELECT DISTINCT customer_id, invoice, CAST(invoice_date AS DATE) AS order_date FROM {source} WHERE customer_id IS NOT NULL),
{prefix}_order_gaps AS (
  SELECT customer_id, order_date, lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date) AS previous_order_date
  FROM {prefix}_order_dates),
{prefix}_customer_gap AS (
  SELECT customer_id, {mean('order_date - previous_order_date')} AS average_order_gap,
         {half_up('sum(order_date - previous_order_date)*100', 'count(*)', 'DECIMAL(13,2)')} AS rounded_gap
  FROM {prefix}_order_gaps WHERE previous_order_date IS NOT NULL GROUP BY customer_id),
{prefix}_return_metrics AS (
  SELECT customer_id, count(*) AS return_line_items, {big('sum(abs(quantity))')} AS returned_quantity,
         {half_up('sum(CAST(abs(quantity)*price*10000 AS BIGINT))', '100')} AS returned_value
  FROM {source} WHERE customer_id IS NOT NULL AND quantity < 0 GROUP BY customer_id),
{prefix}_features AS (
  SELECT m.customer_id, m.country, m.first_purchase_date, m.last_purchase_date,
         CAST(date_diff('day', CAST(m.last_purchase_date AS DATE),
              CAST((SELECT max(invoice_date) + INTERVAL 1 DAY FROM {source}) AS DATE)) AS INT) AS recency_days,
         m.frequency, m.monetary_value, m.average_order_value, m.unique_products, m.total_quantity,
         g.rounded_gap AS average_order_gap,
         coalesce(r.return_line_items, 0) AS return_line_items, coalesce(r.returned_quantity, 0) AS returned_quantity,
         coalesce(r.returned_value, CAST(0 AS DECIMAL(38,2))) AS returned_value,
         {half_up('coalesce(CAST(r.returned_value * 100 AS BIGINT), 0) * 10000', 'm.revenue_cents')} AS return_value_rate,
         CAST(date_diff('day', CAST(m.first_purchase_date AS DATE), CAST(m.last_purchase_date AS DATE)) AS INT) AS customer_tenure_days
  FROM {prefix}_metrics m
  LEFT JOIN {prefix}_customer_gap g ON m.customer_id = g.customer_id
  LEFT JOIN {prefix}_return_metrics r ON m.customer_id = r.customer_id)"""


SEGMENT_CASE = (
    "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rfm.SEGMENT_RULES) + f" ELSE '{rfm.OTHER_SEGMENT}' END"
)
RFM = f"""rfm_scored AS (
  SELECT f.*, CAST(ntile(5) OVER (ORDER BY recency_days DESC, customer_id) AS INT) AS r_score,
         CAST(ntile(5) OVER (ORDER BY frequency, customer_id) AS INT) AS f_score,
         CAST(ntile(5) OVER (ORDER BY monetary_value, customer_id) AS INT) AS m_score
  FROM sold_features f),
customer_rfm AS (
  SELECT *, concat(r_score, f_score, m_score) AS rfm_score,
         {SEGMENT_CASE} AS customer_segment
  FROM rfm_scored)"""

CHURN = f"""churn_labels AS (
  SELECT c.customer_id,
         CAST(CASE WHEN count(CASE WHEN t.invoice_date > TIMESTAMP '2001-05-03' AND t.invoice_date <= TIMESTAMP '2001-08-01' THEN 1 END) = 0
              THEN 1 ELSE 0 END AS INT) AS churned,
         count(CASE WHEN t.invoice_date > TIMESTAMP '2001-05-03' AND t.invoice_date <= TIMESTAMP '2001-08-01' THEN 1 END) AS future_purchase_lines
  FROM (SELECT DISTINCT customer_id FROM customer_lines) c
  LEFT JOIN customer_lines t ON c.customer_id = t.customer_id
  GROUP BY c.customer_id),
customer_orders AS (
  SELECT customer_id, invoice, CAST(min(invoice_date) AS DATE) AS order_date, sum(revenue) AS order_revenue
  FROM customer_lines WHERE invoice_date <= TIMESTAMP '2001-05-03' GROUP BY customer_id, invoice),
order_gaps AS (
  SELECT customer_id, invoice, order_date,
         order_date - lag(order_date) OVER (PARTITION BY customer_id ORDER BY order_date, invoice) AS order_gap
  FROM customer_orders),
fanned_summary AS (
  SELECT customer_id, min(order_date) AS first_day, max(order_date) AS last_day, count(*) AS frequency,
         sum(order_revenue) AS monetary_value, {cents('order_revenue')} AS monetary_cents,
         CAST(sum(order_gap) AS HUGEINT) AS gap_sum, count(order_gap) AS gap_count
  FROM (SELECT g.customer_id, g.order_date, g.order_gap, o.order_revenue
        FROM order_gaps g JOIN customer_orders o USING (customer_id, order_date)) GROUP BY customer_id),
exact_summary AS (
  SELECT customer_id, min(order_date) AS first_day, max(order_date) AS last_day, count(*) AS frequency,
         sum(order_revenue) AS monetary_value, {cents('order_revenue')} AS monetary_cents,
         CAST(sum(order_gap) AS HUGEINT) AS gap_sum, count(order_gap) AS gap_count
  FROM (SELECT g.*, o.order_revenue FROM order_gaps g JOIN customer_orders o USING (customer_id, invoice)) GROUP BY customer_id),
product_summary AS (
  SELECT customer_id, count(DISTINCT stock_code) AS unique_products, {big('sum(quantity)')} AS total_quantity
  FROM customer_lines WHERE invoice_date <= TIMESTAMP '2001-05-03' GROUP BY customer_id)"""


def _feature_table(name, summary):
    return f"""{name} AS (
  SELECT s.customer_id, CAST(date_diff('day', s.last_day, DATE '2001-05-03') AS INT) AS recency_days, s.frequency,
         {money('s.monetary_value')} AS monetary_value, {half_up('s.monetary_cents', 's.frequency')} AS average_order_value,
         p.unique_products, p.total_quantity,
         {half_up('s.gap_sum * 100', 's.gap_count', 'DECIMAL(13,2)')} AS average_order_gap,
         CAST(date_diff('day', s.first_day, s.last_day) AS INT) AS customer_tenure_days
  FROM {summary} s JOIN product_summary p ON s.customer_id = p.customer_id)"""


MODELING = f"""{_feature_table('churn_features', 'fanned_summary')},
{_feature_table('churn_features_exact', 'exact_summary')},
churn_modeling AS (
  SELECT f.*, l.churned FROM churn_features f JOIN churn_labels l ON f.customer_id = l.customer_id)"""

PREDICTIONS = """pseudo_predictions AS (
  SELECT customer_id,
         CAST(((customer_id * 7919) % 1000) / 1000.0 AS DECIMAL(8,6)) AS churn_probability,
         CAST(CASE WHEN (customer_id * 7919) % 1000 > 500 THEN 1 ELSE 0 END AS TINYINT) AS prediction,
         CASE WHEN (customer_id * 7919) % 1000 >= 750 THEN 'HIGH'
              WHEN (customer_id * 7919) % 1000 >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         TIMESTAMP '2001-08-01 00:00:00' AS prediction_date
  FROM (SELECT DISTINCT customer_id FROM customer_lines WHERE invoice_date <= TIMESTAMP '2001-05-03'))"""

DIMENSIONS = f"""customers AS (
  SELECT customer_id, max(country) AS country, min(invoice_date) AS first_purchase_date, max(invoice_date) AS last_purchase_date,
         count(DISTINCT invoice) AS total_orders, {money('sum(revenue)')} AS total_revenue
  FROM customer_lines GROUP BY customer_id),
products AS (
  SELECT stock_code, max(description) AS description,
         CAST(CAST((2*CAST(sum(CAST(price*10000 AS BIGINT)) AS HUGEINT)+count(price))//(2*count(price)) AS DECIMAL(18,0))
              * CAST(0.0001 AS DECIMAL(5,4)) AS DECIMAL(12,4)) AS average_price,
         {big('sum(quantity)')} AS total_quantity, {money('sum(revenue)')} AS total_revenue
  FROM sales_lines GROUP BY stock_code)"""

# Pieces in the order they may refer to each other.
PIECES = {
    "base": BASE,
    "sold": features("sales_lines", "sold"),
    "kept": features("clean_lines", "kept"),
    "rfm": RFM,
    "churn": CHURN,
    "modeling": MODELING,
    "predictions": PREDICTIONS,
    "dimensions": DIMENSIONS,
}

_NEEDS = {
    "rfm": ["sold"],
    "modeling": ["churn"],
}


def statement(select, *pieces, ctes=""):
    """``select`` behind the named CTE pieces and what they depend on."""
    wanted = {"base"}
    for piece in pieces:
        wanted.update([piece, *_NEEDS.get(piece, [])])
    parts = [text for name, text in PIECES.items() if name in wanted]
    if ctes:
        parts.append(ctes)
    return "WITH " + ",\n".join(parts) + "\n" + select


def audit_queries():
    raw_columns = {
        "invoice": "string", "stockcode": "string", "description": "string", "quantity": "int",
        "invoicedate": "timestamp_ntz", "price": "decimal(12,4)", "customer_id": "bigint", "country": "string",
    }
    every = ", ".join(raw_columns)
    order = "invoicedate, invoice, stockcode, quantity, price, description, customer_id, country"

    def per_column(template):
        return " UNION ALL ".join(template.format(c=c, t=t) for c, t in raw_columns.items())

    shape = per_column(
        "SELECT '{c}' AS column_name, '{t}' AS data_type, count({c}) AS non_null, count(*) AS row_count, "
        "CAST(8 AS INT) AS column_count FROM raw_lines"
    )
    missing = per_column(
        "SELECT '{c}' AS column_name, count(*) - count({c}) AS missing_count, "
        + half_up("(count(*) - count({c})) * 10000", "count(*)")
        + " AS missing_percentage FROM raw_lines"
    )
    descending = ", ".join(f"{c} DESC NULLS LAST" for c in order.split(", "))
    ascending = ", ".join(f"{c} ASC NULLS FIRST" for c in order.split(", "))

    def numeric_summary(column, source):
        value = f"CAST({column} AS DOUBLE)"
        return (
            f"SELECT '{column}' AS column_name, count({column}) AS value_count, CAST(NULL AS BIGINT) AS unique_values, "
            f"CAST(NULL AS VARCHAR) AS top_value, CAST(NULL AS BIGINT) AS top_count, {mean(column)} AS mean_value, "
            f"round(stddev_samp({value}), 4) AS std_value, CAST(min({column}) AS DOUBLE) AS min_value, "
            f"quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.5) AS p50, quantile_cont({value}, 0.75) AS p75, "
            f"CAST(max({column}) AS DOUBLE) AS max_value FROM {source}"
        )

    def text_summary(column, source):
        nulls = ", ".join(
            f"CAST(NULL AS DOUBLE) AS {n}" for n in ("mean_value", "std_value", "min_value", "p25", "p50", "p75", "max_value")
        )
        top = f"FROM {source} WHERE {column} IS NOT NULL GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1"
        return (
            f"SELECT '{column}' AS column_name, count({column}) AS value_count, count(DISTINCT {column}) AS unique_values, "
            f"(SELECT {column} {top}) AS top_value, (SELECT count(*) {top}) AS top_count, {nulls} FROM {source}"
        )

    summary = " UNION ALL ".join(
        [numeric_summary(c, "raw_lines") for c in ("quantity", "price")]
        + [text_summary(c, "raw_lines") for c in ("invoice", "stockcode", "description", "country")]
    )
    profile = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS null_rows FROM raw_lines"
        for c in ("customer_id", "country", "stockcode")
    )
    value = "CAST(quantity * price AS DOUBLE)"
    return {
        "table_shape": statement(shape),
        "table_samples": statement(
            f"SELECT * FROM (SELECT {every}, 'head' AS part FROM raw_lines ORDER BY {ascending} LIMIT 5) "
            f"UNION ALL SELECT * FROM (SELECT {every}, 'tail' AS part FROM raw_lines ORDER BY {descending} LIMIT 5)"
        ),
        "missing_summary": statement(missing),
        "missing_summary_observed": statement(missing),
        "describe_all": statement(summary),
        "duplicate_count": statement(
            f"SELECT CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT {every} FROM raw_lines)) AS BIGINT) AS duplicate_rows, "
            "count(*) AS total_rows FROM raw_lines"
        ),
        "duplicate_rows": statement(
            f"SELECT {every}, count(*) - 1 AS extra_copies FROM raw_lines GROUP BY {every} HAVING count(*) > 1"
        ),
        "distinct_profile": statement(profile),
        "distinct_values": statement("SELECT DISTINCT churned FROM churn_modeling", "modeling"),
        "date_range": statement(
            "SELECT min(invoice_date) AS first_date, max(invoice_date) AS last_date, "
            "CAST(date_diff('day', CAST(min(invoice_date) AS DATE), CAST(max(invoice_date) AS DATE)) AS INT) AS total_days FROM sales_lines"
        ),
        **dict.fromkeys(("invalid_value_counts", "invalid_value_counts_observed"), statement(
            "SELECT count(*) FILTER (quantity < 0) AS negative_quantity, count(*) FILTER (price <= 0) AS nonpositive_price, "
            "CAST(coalesce(sum(CASE WHEN price <= 0 THEN quantity * price END), 0) AS DECIMAL(38,4)) AS nonpositive_price_revenue FROM raw_lines"
        )),
        "invalid_value_rows": statement(
            f"SELECT {every} FROM raw_lines WHERE price <= 0 ORDER BY {ascending} LIMIT 20"
        ),
        "value_counts": statement(
            "SELECT country, count(*) AS rows, count(*) * 100.0::DOUBLE / (SELECT count(country) FROM raw_lines) AS share "
            "FROM raw_lines WHERE country IS NOT NULL GROUP BY country ORDER BY rows DESC, country LIMIT 20"
        ),
        "cancellation_audit": statement(
            "SELECT count(*) FILTER (invoice LIKE 'C%') AS cancellation_rows, count(*) FILTER (invoice NOT LIKE 'C%') AS other_rows, "
            "count(*) FILTER (invoice LIKE 'C%' AND quantity < 0) AS cancelled_negative_quantity, "
            "count(*) FILTER (invoice LIKE 'C%' AND quantity > 0) AS cancelled_positive_quantity FROM raw_lines"
        ),
        "crosstab_cancel_return": statement(
            "SELECT invoice LIKE 'C%' AS is_cancelled, count(*) FILTER (NOT quantity < 0) AS quantity_not_negative, "
            "count(*) FILTER (quantity < 0) AS quantity_negative FROM raw_lines GROUP BY 1"
        ),
        "revenue_profile": statement(
            "SELECT CAST(sum(quantity * price) AS DECIMAL(38,4)) AS total_revenue, count(*) AS value_count, "
            f"{mean('quantity * price')} AS mean_value, round(stddev_samp({value}), 4) AS std_value, "
            f"min({value}) AS min_value, quantile_cont({value}, 0.25) AS p25, quantile_cont({value}, 0.5) AS p50, "
            f"quantile_cont({value}, 0.75) AS p75, max({value}) AS max_value FROM raw_lines"
        ),
        "row_and_customer_counts": statement(
            "SELECT count(*) AS row_count, count(DISTINCT customer_id) AS customers FROM sales_lines"
        ),
    }


TYPED = "invoice, stockcode, description, quantity, invoicedate, price, customer_id, country"
CLEAN = (
    "invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, revenue, "
    "invalid_price_flag, is_cancellation, is_return"
)
LOADED = (
    "invoice, stock_code, description, quantity, invoice_date, price, customer_id, country, revenue, is_cancellation, is_return"
)


# Typed lines with gaps: no invoice where 13 pieces were sold, no stock code where 17 were.
_FAULTY = """(SELECT CASE WHEN quantity <> 13 THEN invoice END AS invoice, CASE WHEN quantity <> 17 THEN stockcode END AS stock_code,
    coalesce(description, 'Unknown Product') AS description, quantity, invoicedate AS invoice_date, price, customer_id, country
    FROM typed_lines)"""


def _report(source):
    return f"""SELECT count(*) FILTER (customer_id IS NULL) AS missing_ids, count(*) FILTER (invoice_date IS NULL) AS missing_dates,
        count(*) FILTER (invoice IS NULL) AS missing_invoices, count(*) FILTER (stock_code IS NULL) AS missing_stock_codes,
        count(*) FILTER (price <= 0) AS invalid_prices, count(*) FILTER (quantity <= 0) AS invalid_quantities,
        CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM {source} AS d)) AS BIGINT) AS duplicate_rows,
        count(*) AS total_rows, count(DISTINCT customer_id) AS unique_customers FROM {source} AS r"""


def cleaning_queries():
    rules = [
        ("not_empty", "CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT)"),
        ("required_columns", "count(*) FILTER (false)"),
        ("invoice_present", "count(*) FILTER (invoice IS NULL)"),
        ("stock_code_present", "count(*) FILTER (stock_code IS NULL)"),
        ("customer_id_present", "count(*) FILTER (customer_id IS NULL)"),
        ("quantity_positive", "count(*) FILTER (quantity <= 0)"),
        ("price_positive", "count(*) FILTER (price <= 0)"),
        ("revenue_matches", "count(*) FILTER (abs(revenue - quantity * price) >= 0.01)"),
    ]
    checks = " UNION ALL ".join(
        f"SELECT '{name}' AS rule, {count} AS violations, {count} = 0 AS passed FROM sales_lines" for name, count in rules
    )
    return {
        "normalize_columns": statement(f"SELECT {TYPED} FROM raw_lines"),
        "standardize_types": statement(f"SELECT {TYPED} FROM typed_lines"),
        "drop_duplicate_lines": statement(f"SELECT DISTINCT {TYPED} FROM typed_lines"),
        "fill_description": statement(
            f"SELECT {TYPED.replace('description', chr(39).join(['coalesce(description, ', 'Unknown Product', ') AS description']))} FROM typed_lines"
        ),
        "flag_lines": statement(f"SELECT {CLEAN} FROM clean_lines"),
        "positive_price_lines": statement(f"SELECT {CLEAN} FROM clean_lines WHERE price > 0"),
        "sales_lines": statement(f"SELECT {CLEAN} FROM sales_lines"),
        "customer_lines": statement(f"SELECT {CLEAN} FROM customer_lines"),
        "cleaning_report": statement(_report("customer_lines")),
        "cleaning_report_faulty": statement(_report(_FAULTY)),
        "rejected_line_counts": statement(
            "SELECT CASE WHEN invoice IS NULL THEN 'missing_invoice' ELSE 'missing_stock_code' END AS reject_reason, count(*) AS lines "
            f"FROM {_FAULTY} WHERE invoice IS NULL OR stock_code IS NULL GROUP BY 1"
        ),
        "quality_checks": statement(checks),
        "quality_checks_observed": statement(checks),
    }


MIXED_CASE = """mixed AS (
  SELECT stock_code, CASE WHEN quantity % 2 = 0 THEN upper(country) ELSE country END AS country,
         CASE WHEN quantity % 2 = 0 THEN upper(description) ELSE description END AS description, quantity, revenue FROM sales_lines)"""
FEW = """few AS (
  SELECT DISTINCT customer_id FROM customer_lines WHERE invoice_date > TIMESTAMP '2001-05-03' ORDER BY customer_id LIMIT 10)"""


def sales_queries():
    month = "CAST(date_trunc('month', invoice_date) AS DATE)"
    revenue, units = money("sum(revenue)"), big("sum(quantity)")
    orders, buyers = "count(DISTINCT invoice)", "count(DISTINCT customer_id)"
    product = (
        f"SELECT stock_code, description, {orders} AS orders, {units} AS quantity, {revenue} AS revenue "
        "FROM sales_lines GROUP BY stock_code, description ORDER BY "
    )
    returned = (
        f"count(*) AS return_rows, {big('coalesce(sum(abs(quantity)), 0)')} AS returned_quantity, "
        f"{money('coalesce(sum(abs(revenue)), 0)')} AS returned_value FROM clean_lines WHERE quantity < 0"
    )
    return {
        "executive_kpis": statement(
            f"""SELECT t.*, c.churn_rate, c.churned_customers, c.active_customers FROM
            (SELECT {buyers} AS total_customers, {orders} AS total_orders, {units} AS total_quantity, {revenue} AS total_revenue,
                    CAST(sum(revenue) AS DOUBLE) / {orders} AS average_order_value,
                    min(invoice_date) AS first_transaction_date, max(invoice_date) AS last_transaction_date
             FROM sales_lines WHERE customer_id IS NOT NULL) t,
            (SELECT {mean('churned')} AS churn_rate, {big('sum(churned)')} AS churned_customers,
                    {big('sum(CASE WHEN churned = 0 THEN 1 ELSE 0 END)')} AS active_customers FROM churn_modeling) c""",
            "modeling",
        ),
        "monthly_revenue": statement(
            f"SELECT {month} AS month, {revenue} AS revenue, {orders} AS orders, {buyers} AS customers "
            "FROM sales_lines WHERE customer_id IS NOT NULL GROUP BY 1"
        ),
        "monthly_revenue_detail": statement(
            f"SELECT {month} AS month, {revenue} AS revenue, {orders} AS orders, {buyers} AS customers, {units} AS quantity "
            "FROM sales_lines WHERE customer_id IS NOT NULL GROUP BY 1"
        ),
        "year_month_revenue": statement(
            "SELECT CAST(year(invoice_date) AS INT) AS year, CAST(month(invoice_date) AS INT) AS month, "
            f"{revenue} AS revenue FROM sales_lines GROUP BY 1, 2"
        ),
        "country_summary": statement(
            f"SELECT country, {buyers} AS customers, {orders} AS orders, {revenue} AS revenue "
            "FROM sales_lines WHERE customer_id IS NOT NULL GROUP BY country"
        ),
        "country_revenue": statement(
            f"SELECT country, {buyers} AS customers, {orders} AS orders, {units} AS quantity, {revenue} AS revenue "
            "FROM sales_lines WHERE customer_id IS NOT NULL AND country IS NOT NULL GROUP BY country"
        ),
        "customer_countries": statement(
            f"SELECT country, {buyers} AS customers FROM customers WHERE country IS NOT NULL GROUP BY country", "dimensions"
        ),
        "top_customers": statement(
            f"SELECT customer_id, {orders} AS orders, {units} AS units, {revenue} AS revenue FROM sales_lines "
            "WHERE customer_id IS NOT NULL GROUP BY customer_id ORDER BY revenue DESC, customer_id LIMIT 20"
        ),
        "product_revenue": statement(product + "revenue DESC, stock_code, description LIMIT 20"),
        "product_quantity": statement(product + "quantity DESC, stock_code, description LIMIT 20"),
        "returns_summary": statement(f"SELECT {returned}"),
        "returns_summary_identified": statement(
            f"SELECT count(DISTINCT customer_id) AS customers_with_returns, {returned} AND customer_id IS NOT NULL"
        ),
        "distinct_counts_by_quarter": statement(
            f"SELECT CAST(date_trunc('quarter', invoice_date) AS DATE) AS quarter, {buyers} AS customers, {orders} AS orders, "
            "true AS customers_close, true AS orders_close FROM sales_lines WHERE customer_id IS NOT NULL GROUP BY 1"
        ),
        "country_totals_any_case": statement(
            f"SELECT lower(country) AS country, count(*) AS lines, {units} AS quantity, {revenue} AS revenue FROM mixed GROUP BY country COLLATE NOCASE, lower(country)",
            ctes=MIXED_CASE,
        ),
        "product_totals_any_case": statement(
            f"SELECT lower(stock_code) AS stock_code, lower(description) AS description, count(*) AS lines, {units} AS quantity, {revenue} AS revenue "
            "FROM mixed GROUP BY lower(stock_code), lower(description)",
            ctes=MIXED_CASE,
        ),
        "product_units_any_case": statement(
            f"SELECT p.stock_code, p.description, {units} AS quantity FROM (SELECT DISTINCT stock_code, description FROM sales_lines) p "
            "JOIN mixed m ON p.stock_code = m.stock_code AND p.description COLLATE NOCASE = m.description COLLATE NOCASE GROUP BY ALL",
            ctes=MIXED_CASE,
        ),
        "customer_purchases_sql": statement(
            "SELECT customer_id, CAST(position AS INT) AS position, invoice, invoice_date, stock_code, description, quantity, price, revenue FROM ("
            "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date DESC, invoice, stock_code, quantity, price, description) AS position "
            "FROM sales_lines WHERE customer_id IN (SELECT customer_id FROM few)) WHERE position <= 5",
            ctes=FEW,
        ),
        "customer_trend_sql": statement(
            f"SELECT customer_id, {month} AS month, {orders} AS orders, {units} AS quantity, {revenue} AS revenue "
            "FROM sales_lines WHERE customer_id IN (SELECT customer_id FROM few) GROUP BY 1, 2",
            ctes=FEW,
        ),
        "customer_profile_sql": statement(
            "SELECT c.customer_id, c.country, r.rfm_score, r.customer_segment, p.churn_probability, p.risk_level FROM customers c "
            "LEFT JOIN customer_rfm r ON c.customer_id = r.customer_id LEFT JOIN pseudo_predictions p ON c.customer_id = p.customer_id "
            "WHERE c.customer_id IN (SELECT customer_id FROM few) AND p.churn_probability >= 0.25",
            "rfm", "dimensions", "predictions", ctes=FEW,
        ),
        "purchase_history": statement(
            "SELECT customer_id, CAST(position AS INT) AS position, invoice, invoice_date, stock_code, description, quantity, price, revenue FROM ("
            "SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY invoice_date DESC, invoice, stock_code, quantity, price, description) AS position "
            "FROM sales_lines WHERE customer_id IN (SELECT customer_id FROM churn_modeling)) WHERE position <= 20",
            "modeling",
        ),
        "customer_purchase_trend": statement(
            f"SELECT customer_id, {month} AS month, {orders} AS orders, {units} AS quantity, {revenue} AS revenue "
            "FROM sales_lines WHERE customer_id IN (SELECT customer_id FROM churn_modeling) GROUP BY 1, 2",
            "modeling",
        ),
    }


def feature_queries():
    return {
        "analysis_date": statement("SELECT max(invoice_date) + INTERVAL 1 DAY AS analysis_date FROM sales_lines"),
        "customer_metrics": statement(
            "SELECT customer_id, first_purchase_date, last_purchase_date, frequency, monetary_value, average_order_value, "
            "unique_products, total_quantity, recency_days, customer_tenure_days FROM sold_features",
            "sold",
        ),
        "order_dates": statement("SELECT * FROM sold_order_dates", "sold"),
        "average_order_gap": statement("SELECT customer_id, average_order_gap FROM sold_customer_gap", "sold"),
        "return_metrics": statement("SELECT * FROM kept_return_metrics", "kept"),
        "customer_features": statement("SELECT * FROM sold_features", "sold"),
        "customer_features_with_returns": statement("SELECT * FROM kept_features", "kept"),
        "feature_null_audit": statement(
            "SELECT count(*) FILTER (recency_days IS NULL) AS null_recency, count(*) FILTER (frequency IS NULL) AS null_frequency, "
            "count(*) FILTER (monetary_value IS NULL) AS null_monetary, count(*) FILTER (average_order_value IS NULL) AS null_aov, "
            "count(*) FILTER (unique_products IS NULL) AS null_products, count(*) FILTER (customer_tenure_days IS NULL) AS null_tenure "
            "FROM sold_features",
            "sold",
        ),
        "customers_with_returns": statement(
            "SELECT count(*) FILTER (return_line_items > 0) AS customers_with_returns, "
            "count(*) FILTER (returned_quantity > 0) AS customers_with_returned_qty, "
            "count(*) FILTER (returned_value > 0) AS customers_with_returned_value, "
            "max(return_value_rate) AS max_return_rate FROM kept_features",
            "kept",
        ),
        "feature_row_count": statement("SELECT count(*) AS customers FROM sold_features", "sold"),
        "feature_sample": statement("SELECT * FROM sold_features ORDER BY customer_id LIMIT 10", "sold"),
        "customers_dim": statement("SELECT * FROM customers", "dimensions"),
        "products_dim": statement("SELECT * FROM products", "dimensions"),
    }


def rfm_queries():
    plain_rounded = {
        "avg_recency": ("recency_days", False), "avg_frequency": ("frequency", False), "avg_monetary": ("monetary_value", True),
        "avg_aov": ("average_order_value", True), "avg_unique_products": ("unique_products", False),
        "avg_order_gap": ("average_order_gap", True),
    }
    rounded = ", ".join(f"{half_up_mean(c, m)} AS {n}" for n, (c, m) in plain_rounded.items())
    unrounded = ", ".join(
        f"{mean(c)} AS {n}"
        for n, c in {
            "avg_recency": "recency_days", "avg_frequency": "frequency", "avg_monetary_value": "monetary_value",
            "avg_order_value": "average_order_value", "avg_unique_products": "unique_products", "avg_order_gap": "average_order_gap",
        }.items()
    )
    scores = " UNION ALL ".join(
        f"SELECT '{s}' AS score_name, {s} AS score, count(*) AS customers FROM customer_rfm GROUP BY {s}"
        for s in ("r_score", "f_score", "m_score")
    )
    queries = {
        "rfm_scores": "SELECT customer_id, r_score, f_score, m_score FROM customer_rfm",
        "rfm_score_code": "SELECT customer_id, r_score, f_score, m_score, rfm_score FROM customer_rfm",
        "rfm_segment": "SELECT customer_id, rfm_score, customer_segment FROM customer_rfm",
        "customer_rfm": "SELECT * FROM customer_rfm",
        "rfm_lookup": (
            "SELECT customer_id, recency_days, frequency, monetary_value, average_order_value, r_score, f_score, m_score, "
            "customer_segment FROM customer_rfm WHERE customer_id IN (SELECT customer_id FROM customer_lines WHERE invoice_date > TIMESTAMP '2001-05-03')"
        ),
        "segment_revenue": (
            f"SELECT customer_segment, count(*) AS customers, {money('sum(monetary_value)')} AS revenue FROM customer_rfm GROUP BY 1"
        ),
        "segment_share": (
            f"SELECT customer_segment, count(*) AS customers, {half_up('count(*) * 10000', '(SELECT count(*) FROM customer_rfm)')} "
            "AS customer_percentage FROM customer_rfm GROUP BY 1"
        ),
        "segment_profile": f"SELECT customer_segment, {rounded} FROM customer_rfm GROUP BY 1",
        "rfm_segments": (
            f"SELECT customer_segment AS segment, count(*) AS customers, {money('sum(monetary_value)')} AS revenue, {unrounded} "
            "FROM customer_rfm GROUP BY 1"
        ),
        "score_distribution": scores,
        "top_monetary_customers": (
            "SELECT customer_id, country, frequency, monetary_value, average_order_value, recency_days, customer_segment "
            "FROM customer_rfm ORDER BY monetary_value DESC, customer_id LIMIT 20"
        ),
        "most_inactive_customers": (
            "SELECT customer_id, country, recency_days, frequency, monetary_value, customer_segment "
            "FROM customer_rfm ORDER BY recency_days DESC, customer_id LIMIT 20"
        ),
        "one_order_customers": (
            "SELECT customer_segment, count(*) AS customers, (SELECT count(*) FROM customer_rfm WHERE frequency = 1) AS one_order_customers "
            "FROM customer_rfm WHERE frequency = 1 GROUP BY 1"
        ),
        "order_gap_stats": (
            f"SELECT min(average_order_gap) AS min_gap, {half_up_mean('average_order_gap', True)} AS avg_gap, "
            "max(average_order_gap) AS max_gap, count(*) FILTER (average_order_gap IS NULL) AS customers_without_gap FROM customer_rfm"
        ),
        "gap_missing_by_frequency": (
            "SELECT frequency, count(*) AS customers, count(*) FILTER (average_order_gap IS NULL) AS missing_gap FROM customer_rfm GROUP BY 1"
        ),
        "rfm_sample": (
            "SELECT customer_id, r_score, f_score, m_score, rfm_score, monetary_value, customer_segment AS segment "
            "FROM customer_rfm ORDER BY customer_id LIMIT 20"
        ),
        "segment_counts": (
            "SELECT customer_segment, count(*) AS rows, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM customer_rfm) AS share "
            "FROM customer_rfm GROUP BY 1"
        ),
    }
    built = {name: statement(sql, "rfm") for name, sql in queries.items()}
    built["return_rate_by_segment"] = statement(
        f"SELECT customer_segment, count(*) AS customers, {half_up_mean('return_value_rate', True)} AS avg_return_rate, "
        "max(return_value_rate) AS max_return_rate FROM customer_rfm GROUP BY 1",
        "kept", "rfm",
    ).replace("FROM sold_features f", "FROM kept_features f")
    return built


def churn_queries():
    def ranges(columns, source):
        return "SELECT " + ", ".join(f"min({c}) AS min_{n}, max({c}) AS max_{n}" for n, c in columns.items()) + f" FROM {source}"

    stats = {
        "avg_recency": "recency_days", "avg_frequency": "frequency", "avg_monetary_value": "monetary_value",
        "avg_order_value": "average_order_value", "avg_unique_products": "unique_products", "avg_quantity": "total_quantity",
        "avg_total_quantity": "total_quantity", "avg_order_gap": "average_order_gap", "avg_tenure": "customer_tenure_days",
    }
    status = "CASE WHEN churned = 1 THEN 'Churned' ELSE 'Active' END AS status"
    skew = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, round(skewness(CAST({c} AS DOUBLE)), 6) AS skew FROM churn_modeling" for c in MODEL_FEATURES
    )
    histogram = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(least(floor((v - lo) * 30 / (hi - lo)) + 1, 30) AS INT) AS bin, count(*) AS rows FROM "
        f"(SELECT CAST({c} AS DOUBLE) AS v, (SELECT CAST(min({c}) AS DOUBLE) FROM churn_modeling) AS lo, "
        f"(SELECT CAST(max({c}) AS DOUBLE) FROM churn_modeling) AS hi FROM churn_modeling WHERE {c} IS NOT NULL) GROUP BY 2"
        for c in MODEL_FEATURES
    )
    basic = {"recency": "recency_days", "frequency": "frequency", "monetary": "monetary_value"}
    more = {**basic, "aov": "average_order_value", "tenure": "customer_tenure_days"}
    population = (
        f"SELECT count(*) AS total_customers, {big('sum(churned)')} AS churned_customers, "
        f"count(*) FILTER (churned = 0) AS active_customers, {mean('churned')} AS churn_rate FROM churn_modeling"
    )
    share = half_up("count(*) * 10000", "(SELECT count(*) FROM churn_modeling)")
    queries = {
        "churn_labels": "SELECT * FROM churn_labels",
        "label_counts": (
            f"SELECT churned, count(*) AS customers, (SELECT {half_up('sum(churned) * 10000', 'count(*)')} FROM churn_labels) AS churn_rate "
            "FROM churn_labels GROUP BY churned"
        ),
        "customer_orders": f"SELECT customer_id, invoice, order_date, {money('order_revenue')} AS order_revenue FROM customer_orders",
        "order_gaps": "SELECT customer_id, invoice, order_date, CAST(order_gap AS INT) AS order_gap FROM order_gaps",
        "churn_features": "SELECT * FROM churn_features",
        "churn_features_exact": "SELECT * FROM churn_features_exact",
        "churn_feature_ranges": ranges(basic, "churn_features"),
        "feature_label_counts": (
            "SELECT count(l.churned) AS total_feature_customers, count(*) FILTER (l.churned = 1) AS churned, "
            "count(*) FILTER (l.churned = 0) AS active, count(*) FILTER (l.customer_id IS NULL) AS customers_without_label "
            "FROM churn_features f LEFT JOIN churn_labels l ON f.customer_id = l.customer_id"
        ),
        "churn_modeling": "SELECT * FROM churn_modeling",
        "modeling_label_share": f"SELECT churned, count(*) AS customers, {share} AS percentage FROM churn_modeling GROUP BY churned",
        "modeling_ranges": ranges(more, "churn_modeling"),
        "churn_distribution": f"SELECT {status}, count(*) AS customers, {share} AS percentage FROM churn_modeling GROUP BY churned",
        "churn_population_summary": population,
        "churn_feature_statistics": (
            f"SELECT {status}, churned, count(*) AS customers, "
            + ", ".join(f"{mean(c)} AS {n}" for n, c in stats.items())
            + " FROM churn_modeling GROUP BY churned"
        ),
        "feature_skew": skew,
        "feature_histogram": histogram,
    }
    return {name: statement(sql, "modeling") for name, sql in queries.items()}


FRESH = """buyers AS (SELECT DISTINCT customer_id FROM customer_lines WHERE invoice_date > TIMESTAMP '2001-05-03'),
fresh AS (
  SELECT customer_id, CAST(((customer_id * 104729) % 1000) / 1000.0 AS DECIMAL(8,6)) AS churn_probability,
         CAST(CASE WHEN (customer_id * 104729) % 1000 > 500 THEN 1 ELSE 0 END AS TINYINT) AS prediction,
         CASE WHEN (customer_id * 104729) % 1000 >= 750 THEN 'HIGH'
              WHEN (customer_id * 104729) % 1000 >= 500 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
         TIMESTAMP '2001-08-02 00:00:00' AS prediction_date
  FROM buyers)"""


def source_queries():
    required = ["churn_probability", "prediction", "risk_level", "prediction_date"]
    nulls = ", ".join(f"count(*) FILTER ({c} IS NULL) AS null_{c}" for c in required)
    return {
        "read_raw_sheets": statement(f"SELECT {TYPED} FROM raw_lines"),
        "unreadable_cells": statement(
            "SELECT 'Quantity' AS column_name, count(*) FILTER (false) AS cells FROM raw_lines "
            "UNION ALL SELECT 'InvoiceDate', count(*) FILTER (quantity = 13) FROM raw_lines "
            "UNION ALL SELECT 'Price', count(*) FILTER (false) FROM raw_lines "
            "UNION ALL SELECT 'Customer ID', count(*) FILTER (quantity = 17) FROM raw_lines"
        ),
        "read_clean_csv": statement(f"SELECT {CLEAN} FROM sales_lines"),
        "write_clean_csv": statement(f"SELECT {CLEAN} FROM customer_lines"),
        "prepare_lines_for_load": statement(f"SELECT {LOADED} FROM sales_lines"),
        "append_lines": statement(f"SELECT {LOADED} FROM sales_lines"),
        "bucketed_modeling": statement("SELECT * FROM churn_modeling", "modeling"),
        "materialize": statement("SELECT * FROM sold_features", "sold"),
        "update_columns": statement("SELECT customer_id, r_score, f_score, m_score, rfm_score FROM customer_rfm", "rfm"),
        "upsert_predictions": statement(
            "SELECT * FROM pseudo_predictions WHERE customer_id NOT IN (SELECT customer_id FROM fresh) UNION ALL SELECT * FROM fresh",
            "predictions", ctes=FRESH,
        ),
        "read_predictions": statement(
            "SELECT customer_id, CAST(churn_probability AS DOUBLE) AS churn_probability, CAST(prediction AS INT) AS prediction, "
            "risk_level, prediction_date FROM pseudo_predictions",
            "predictions",
        ),
        "table_constraints": statement(
            "SELECT count(*) AS total_rows, count(customer_id) AS non_null_ids, count(DISTINCT customer_id) AS unique_ids, "
            f"{nulls}, (SELECT count(*) FROM fresh f LEFT JOIN churn_modeling m ON f.customer_id = m.customer_id "
            "WHERE m.customer_id IS NULL) AS missing_references FROM fresh",
            "modeling", ctes=FRESH,
        ),
    }


# Fixed values of the split hash: the high part of an id is folded into the low one.
_LOW = "((customer_id % 2147483648 + 2147483648) % 2147483648)"
_HIGH = f"(((customer_id - {_LOW}) // 2147483648 % 2147483648 + 2147483648) % 2147483648)"
_HASH = f"((({_LOW} + {_HIGH} * 1640531527 % 2147483648) % 2147483648) * 2654435761 + 42) % 4294967296"
SPLIT = f"""split AS (
  SELECT *, row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, customer_id)
            <= ceil(count(*) OVER (PARTITION BY churned) * 0.2) AS is_test
  FROM churn_modeling)"""


FOLDED = f"""folded AS (
  SELECT *, CAST((row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, customer_id) - 1) % 5 AS INT) AS fold
  FROM split WHERE NOT is_test)"""
BOOSTED_NAMES = ("boosted_1", "boosted_2", "boosted_3", "boosted_4")


def _histogram():
    """Sampled training rows by feature and bin with the first gradients. A value's bin is the
    number of bounds below it; bounds are the greatest values of 255 parts of equal counts, but the last."""
    from ledgerlark.operators.boosting import BINS, UNIT, row_sample

    factor, offset = row_sample(0)
    share = "(SELECT avg(CAST(churned AS DOUBLE)) FROM split WHERE NOT is_test)"
    sampled = f"NOT is_test AND (CAST({_HASH} AS HUGEINT) * {factor} + {offset}) % 4294967296 < {int(0.8 * (1 << 32))}"
    parts = []
    for name in MODEL_FEATURES:
        value = f"CAST({name} AS DOUBLE)"
        bounds = (
            f"(SELECT list(top ORDER BY top)[:-2] AS tops FROM (SELECT max(v) AS top FROM (SELECT {value} AS v, "
            f"(count(*) OVER (ORDER BY {value}) * {BINS} + count(*) OVER () - 1) // count(*) OVER () AS place "
            f"FROM split WHERE NOT is_test AND {name} IS NOT NULL) AS placed GROUP BY place) AS ends)"
        )
        parts.append(
            f"SELECT '{name}' AS feature, CAST(CASE WHEN {name} IS NULL THEN -1 ELSE len(list_filter(tops, lambda top: top < {value})) END AS INT) AS bin, "
            f"CAST(round(({share} - churned) * {UNIT}) AS BIGINT) AS gradient, CAST(round({share} * (1 - {share}) * {UNIT}) AS BIGINT) AS hessian "
            f"FROM split, {bounds} AS bounds WHERE {sampled}"
        )
    return " UNION ALL ".join(parts)


def training_queries():
    counts = ", ".join(
        f"count(*) FILTER ({test} is_test AND churned = {label}) AS {part}_{name}"
        for part, test in (("train", "NOT"), ("test", ""))
        for label, name in ((1, "churned"), (0, "active"))
    )
    medians = ", ".join(f"(SELECT quantile_cont(CAST({c} AS DOUBLE), 0.5) FROM split WHERE NOT is_test) AS {c}" for c in MODEL_FEATURES)
    filled = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), m.{c}) AS {c}" for c in MODEL_FEATURES)
    imputed = f"{SPLIT},\nmedians AS (SELECT {medians}),\nimputed AS (SELECT s.customer_id, s.is_test, {filled} FROM split s, medians m)"
    scaled = ", ".join(
        f"round(({c} - (SELECT avg({c}) FROM imputed WHERE NOT is_test)) / (SELECT stddev_pop({c}) FROM imputed WHERE NOT is_test), 6) AS {c}"
        for c in MODEL_FEATURES
    )
    logged = ", ".join(
        f"round(ln(1 + {c}), 9) AS {c}" for c in MODEL_FEATURES if c not in ("recency_days", "customer_tenure_days")
    )
    judged = """judged AS (
  SELECT p.*, l.churned FROM pseudo_predictions p JOIN churn_labels l ON p.customer_id = l.customer_id),
cells AS (
  SELECT count(*) FILTER (churned = 0 AND prediction = 0) AS tn, count(*) FILTER (churned = 0 AND prediction = 1) AS fp,
         count(*) FILTER (churned = 1 AND prediction = 0) AS fn, count(*) FILTER (churned = 1 AND prediction = 1) AS tp FROM judged),
ranks AS (
  SELECT churned, rank() OVER (ORDER BY churn_probability) + (count(*) OVER (PARTITION BY churn_probability) - 1) / 2.0 AS place
  FROM judged),
class_scores AS (
  SELECT '0' AS class, CAST(tn AS DOUBLE)/(tn+fn) AS precision, CAST(tn AS DOUBLE)/(tn+fp) AS recall,
         CAST(2*tn AS DOUBLE)/(2*tn+fn+fp) AS f1_score, tn+fp AS support FROM cells
  UNION ALL
  SELECT '1', CAST(tp AS DOUBLE)/(tp+fp), CAST(tp AS DOUBLE)/(tp+fn), CAST(2*tp AS DOUBLE)/(2*tp+fp+fn), tp+fn FROM cells)"""
    pair = "CAST((SELECT count(*) FROM judged WHERE churned = 1) AS DOUBLE)"
    other = "CAST((SELECT count(*) FROM judged WHERE churned = 0) AS DOUBLE)"
    ordered = f"max(CASE WHEN class = '0' THEN {{c}} END)"

    def both(c):
        zero, one = ordered.format(c=c), f"max(CASE WHEN class = '1' THEN {c} END)"
        n0, n1 = "max(CASE WHEN class = '0' THEN support END)", "max(CASE WHEN class = '1' THEN support END)"
        return f"({zero} + {one}) / 2", f"({zero} * {n0} + {one} * {n1}) / sum(support)"

    names = ("precision", "recall", "f1_score")
    macro = ", ".join(f"{both(c)[0]} AS {c}" for c in names)
    weighted = ", ".join(f"{both(c)[1]} AS {c}" for c in names)
    return {
        "stratified_split": statement("SELECT customer_id, churned, is_test FROM split", "modeling", ctes=SPLIT),
        "split_summary": statement(
            "SELECT is_test, churned, count(*) AS rows, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY is_test) AS share "
            "FROM split GROUP BY is_test, churned",
            "modeling", ctes=SPLIT,
        ),
        "impute_median": statement(f"SELECT customer_id, {', '.join(MODEL_FEATURES)} FROM imputed", "modeling", ctes=imputed),
        "standard_scale": statement(f"SELECT customer_id, {scaled} FROM imputed", "modeling", ctes=imputed),
        "log1p_features": statement(f"SELECT customer_id, {logged} FROM imputed", "modeling", ctes=imputed),
        "binary_metrics": statement(
            "SELECT CAST(tp + tn AS DOUBLE)/(tp+tn+fp+fn) AS accuracy, CAST(tp AS DOUBLE)/(tp+fp) AS precision, "
            "CAST(tp AS DOUBLE)/(tp+fn) AS recall, CAST(2*tp AS DOUBLE)/(2*tp+fp+fn) AS f1_score, "
            f"((SELECT CAST(sum(place) AS DOUBLE) FROM ranks WHERE churned = 1) - {pair} * ({pair} + 1) / 2) / ({pair} * {other}) AS roc_auc FROM cells",
            "churn", "predictions", ctes=judged,
        ),
        "classification_report": statement(
            "SELECT * FROM class_scores UNION ALL "
            "SELECT 'accuracy', CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn), CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn), CAST(tp+tn AS DOUBLE)/(tp+tn+fp+fn), tp+tn+fp+fn FROM cells UNION ALL "
            f"SELECT 'macro avg', {macro}, CAST(sum(support) AS BIGINT) FROM class_scores UNION ALL "
            f"SELECT 'weighted avg', {weighted}, CAST(sum(support) AS BIGINT) FROM class_scores",
            "churn", "predictions", ctes=judged,
        ),
        "confusion_matrix": statement(
            "SELECT CAST(0 AS INT) AS actual, tn AS predicted_0, fp AS predicted_1 FROM cells UNION ALL SELECT 1, fn, tp FROM cells",
            "churn", "predictions", ctes=judged,
        ),
        "feature_importance": "SELECT * FROM (VALUES "
        + ", ".join(f"('{name}', true, true)" for name in MODEL_FEATURES)
        + ") AS t(feature, is_share, adds_up)",
        **{
            name: statement(f"SELECT {counts}, true AS beats_share, true AS auc_holds, true AS {proof} FROM split", "modeling", ctes=SPLIT)
            for name, proof in (
                ("train_logistic", "at_rest"), ("train_logistic_log", "at_rest"), ("train_final", "size_holds"),
                ("train_random_forest", "size_holds"), ("train_boosted", "size_holds"),
            )
        },
        **{
            name: statement(
                "SELECT model, count(*) FILTER (NOT is_test) AS train_rows, count(*) FILTER (is_test) AS test_rows, true AS bounded "
                f"FROM split, (VALUES {', '.join(f"('{model}')" for model in models)}) AS m(model) GROUP BY model",
                "modeling", ctes=SPLIT,
            )
            for name, models in (("train_test_auc", ("logistic", "logistic_log", "final")), ("config_sweep", BOOSTED_NAMES))
        },
        **{
            name: statement(
                "SELECT model, fold, count(*) AS held_out_rows, CAST((SELECT count(*) FROM folded) - count(*) AS BIGINT) AS train_rows, "
                f"true AS bounded FROM folded, (VALUES {', '.join(f"('{model}')" for model in models)}) AS m(model) GROUP BY model, fold",
                "modeling", ctes=f"{SPLIT},\n{FOLDED}",
            )
            for name, models in (("cross_validate", ("logistic",)), ("cv_config_sweep", BOOSTED_NAMES))
        },
        "boosting_root_histogram": statement(
            f"SELECT feature, bin, count(*) AS rows, CAST(sum(gradient) AS BIGINT) AS gradient, CAST(sum(hessian) AS BIGINT) AS hessian FROM ({_histogram()}) AS binned "
            "GROUP BY feature, bin",
            "modeling", ctes=SPLIT,
        ),
        "model_metrics_table": statement(
            "SELECT 'boosted trees' AS model, count(*) AS total_customers, count(*) FILTER (churned = 1) AS churned_customers, "
            "count(*) FILTER (churned = 0) AS active_customers, CAST(sum(churned) AS DOUBLE) / count(churned) AS churn_rate, "
            "count(*) FILTER (is_test) AS test_rows, true AS whole FROM split",
            "modeling", ctes=SPLIT,
        ),
        "score_customers": statement(
            "SELECT customer_id, true AS level_holds, true AS class_holds, true AS stored_holds, "
            "TIMESTAMP '2001-08-01 00:00:00' AS prediction_date FROM churn_modeling",
            "modeling",
        ),
        "scored_prediction_coverage": statement(
            "SELECT count(*) AS modeling_customers, count(*) AS prediction_customers, CAST(0 AS BIGINT) AS missing_predictions, true AS valid "
            "FROM churn_modeling",
            "modeling",
        ),
        "attributions": statement(
            " UNION ALL ".join(
                f"SELECT s.customer_id, '{c}' AS feature, CAST(s.{c} AS DOUBLE) AS feature_value, "
                f"coalesce(CAST(s.{c} AS DOUBLE), m.{c}) AS model_value, true AS adds_up FROM split s, medians m"
                for c in MODEL_FEATURES
            ),
            "modeling", ctes=f"{SPLIT},\nmedians AS (SELECT {medians})",
        ),
        "stratified_kfold": statement(
            f"SELECT customer_id, churned, CAST((row_number() OVER (PARTITION BY churned ORDER BY {_HASH}, customer_id) - 1) % 5 AS INT) AS fold "
            "FROM split WHERE NOT is_test",
            "modeling", ctes=SPLIT,
        ),
    }


def _attributions():
    from ledgerlark.plans.tables import LINEAR_WEIGHTS

    return "attributed AS (" + " UNION ALL ".join(
        f"SELECT customer_id, '{c}' AS feature, coalesce(CAST({c} AS DOUBLE), middle) AS feature_value, "
        f"CAST({w!r} AS DOUBLE) * (coalesce(CAST({c} AS DOUBLE), middle) - middle) AS shap_value "
        f"FROM churn_modeling, (SELECT {mean(c)} AS middle FROM churn_modeling)"
        for c, w in LINEAR_WEIGHTS.items()
    ) + """),
drivers AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY shap_value DESC, feature) AS INT) AS position
  FROM attributed WHERE shap_value > 0),
protective AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY shap_value, feature) AS INT) AS position
  FROM attributed WHERE shap_value < 0)"""


ACTIONS = (
    "CASE risk_level " + " ".join(f"WHEN '{level}' THEN '{text}'" for level, text in scoring.RECOMMENDATIONS.items()) + " END AS recommendation"
)


def scoring_queries():
    # A reloaded model must score every customer exactly as before.
    unchanged = (
        "SELECT count(*) AS customers, CAST(0 AS DOUBLE) AS max_probability_difference, CAST(0 AS BIGINT) AS class_differences "
        "FROM churn_modeling"
    )
    ranked = "SELECT customer_id, position, feature, feature_value, shap_value FROM {} WHERE position <= 3"

    def names(source):
        return (
            f"(SELECT string_agg(feature, ', ' ORDER BY position) FROM {source} d WHERE d.customer_id = b.customer_id AND d.position <= 3)"
        )

    return {
        "save_model": statement(unchanged, "modeling"),
        "prediction_roundtrip": statement(unchanged, "modeling"),
        "risk_level": statement("SELECT customer_id, churn_probability, risk_level FROM pseudo_predictions", "predictions"),
        "linear_attributions": statement("SELECT * FROM attributed", "modeling", ctes=_attributions()),
        "top_drivers": statement(ranked.format("drivers"), "modeling", ctes=_attributions()),
        "protective_factors": statement(ranked.format("protective"), "modeling", ctes=_attributions()),
        "attribution_summary": statement(
            "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY abs(shap_value) DESC, feature) AS INT) AS position, "
            "CASE WHEN shap_value > 0 THEN 'Increases churn risk' ELSE 'Decreases churn risk' END AS impact FROM attributed) WHERE position <= 5",
            "modeling", ctes=_attributions(),
        ),
        "mean_absolute_attribution": statement(
            "SELECT feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap FROM attributed GROUP BY feature",
            "modeling", ctes=_attributions(),
        ),
        "recommendation": statement(f"SELECT customer_id, risk_level, {ACTIONS} FROM pseudo_predictions", "predictions"),
        "customer_360_model": statement(
            f"""SELECT b.customer_id, c.country, {', '.join('f.' + c for c in MODEL_FEATURES)}, r.rfm_score, r.customer_segment,
                m.customer_id IS NOT NULL AS predicted, m.customer_id IS NOT NULL AS explained, true AS drivers_hold, true AS advised
                FROM (SELECT DISTINCT customer_id FROM customer_lines WHERE invoice_date > TIMESTAMP '2001-05-03') b
                LEFT JOIN customers c ON b.customer_id = c.customer_id
                LEFT JOIN churn_features f ON b.customer_id = f.customer_id
                LEFT JOIN customer_rfm r ON b.customer_id = r.customer_id
                LEFT JOIN churn_modeling m ON b.customer_id = m.customer_id""",
            "modeling", "rfm", "dimensions",
        ),
        "customer_360": statement(
            f"""SELECT b.customer_id, c.country, c.first_purchase_date, c.last_purchase_date, c.total_orders, c.total_revenue,
                {', '.join('f.' + c for c in MODEL_FEATURES)}, r.r_score, r.f_score, r.m_score, r.rfm_score, r.customer_segment,
                p.churn_probability, p.prediction, p.risk_level, {ACTIONS.replace('CASE risk_level', 'CASE p.risk_level')},
                {names('drivers')} AS churn_drivers, {names('protective')} AS protective_factors
                FROM (SELECT DISTINCT customer_id FROM customer_lines WHERE invoice_date > TIMESTAMP '2001-05-03') b
                LEFT JOIN customers c ON b.customer_id = c.customer_id
                LEFT JOIN churn_features f ON b.customer_id = f.customer_id
                LEFT JOIN customer_rfm r ON b.customer_id = r.customer_id
                LEFT JOIN pseudo_predictions p ON b.customer_id = p.customer_id""",
            "modeling", "rfm", "dimensions", "predictions", ctes=_attributions(),
        ),
    }


def prediction_queries():
    joined = (
        "SELECT p.customer_id, CAST(p.churn_probability AS DOUBLE) AS churn_probability, CAST(p.prediction AS INT) AS prediction, "
        f"p.risk_level, p.prediction_date, {', '.join('f.' + c for c in MODEL_FEATURES)} "
        "FROM pseudo_predictions p JOIN churn_modeling f ON p.customer_id = f.customer_id"
    )
    last = " ORDER BY p.churn_probability DESC, p.customer_id LIMIT 20"
    return {
        "risk_distribution": statement(
            f"SELECT risk_level, count(*) AS customers, {mean('churn_probability')} AS avg_probability, "
            "max(churn_probability) AS max_probability, min(churn_probability) AS min_probability FROM pseudo_predictions GROUP BY risk_level",
            "predictions",
        ),
        "churn_risk_customers": statement(joined + last, "predictions", "modeling"),
        "high_risk_customers": statement(joined + " WHERE p.risk_level = 'HIGH'" + last, "predictions", "modeling"),
        "prediction_status": statement(
            "SELECT count(*) AS prediction_count, min(prediction_date) AS earliest_prediction, max(prediction_date) AS latest_prediction FROM pseudo_predictions",
            "predictions",
        ),
        "model_prediction_reports": statement(
            "SELECT * FROM (VALUES ('risk_distribution', 0), ('churn_risk_customers', 20), ('high_risk_customers', -1), ('prediction_status', 0), "
            "('risk_share', 0), ('display_table', -1), ('prediction_label', 0)) AS r(report, most), "
            "LATERAL (SELECT CASE WHEN most < 0 THEN NULL WHEN most = 0 THEN count(*) ELSE least(most, count(*)) END AS customers, true AS holds "
            "FROM churn_modeling) AS c",
            "modeling",
        ).replace("SELECT * FROM (VALUES", "SELECT report, customers, holds FROM (VALUES"),
        "prediction_coverage": statement(
            "SELECT *, modeling_customers = prediction_customers AND missing_predictions = 0 AS valid FROM ("
            "SELECT (SELECT count(*) FROM churn_modeling) AS modeling_customers, (SELECT count(*) FROM fresh) AS prediction_customers, "
            "(SELECT count(*) FROM churn_modeling m LEFT JOIN fresh p ON m.customer_id = p.customer_id WHERE p.customer_id IS NULL) AS missing_predictions)",
            "modeling", ctes=FRESH,
        ),
    }


def dashboard_queries():
    revenue, units = money("sum(revenue)"), big("sum(quantity)")
    monthly = f"""monthly AS (
  SELECT CAST(date_trunc('month', invoice_date) AS DATE) AS month, {revenue} AS revenue, count(DISTINCT invoice) AS orders,
         count(DISTINCT customer_id) AS customers, {units} AS quantity
  FROM sales_lines WHERE customer_id IS NOT NULL GROUP BY 1)"""
    country = f"""country AS (
  SELECT country, {revenue} AS revenue, count(DISTINCT customer_id) AS customers FROM sales_lines
  WHERE customer_id IS NOT NULL AND country IS NOT NULL GROUP BY country),
product AS (
  SELECT stock_code, description, {revenue} AS revenue, {units} AS quantity FROM sales_lines GROUP BY stock_code, description)"""
    series = " UNION ALL ".join(
        f"SELECT month, '{c}' AS series, {money(c)} AS value FROM monthly" for c in ("revenue", "orders", "customers", "quantity")
    )
    first = "(SELECT {} FROM {} ORDER BY {} LIMIT 1)"
    label = "concat(stock_code, ' — ', substr(coalesce(description, 'Unknown Product'), 1, 40)) AS product"
    ranking = (
        "SELECT * FROM (SELECT '{c}' AS ranking, country, CAST({c} AS DECIMAL(38,2)) AS value FROM country ORDER BY {c} DESC, country LIMIT 10)"
    )
    stats = {
        "Avg Recency": "recency_days", "Avg Frequency": "frequency", "Avg Monetary Value": "monetary_value",
        "Avg Order Value": "average_order_value", "Avg Unique Products": "unique_products", "Avg Quantity": "total_quantity",
        "Avg Order Gap": "average_order_gap", "Avg Tenure": "customer_tenure_days",
    }
    return {
        "peak_months": statement(
            f"SELECT {first.format('month', 'monthly', 'revenue DESC, month')} AS highest_revenue_month, "
            f"{first.format('revenue', 'monthly', 'revenue DESC, month')} AS highest_revenue, "
            f"{first.format('month', 'monthly', 'orders DESC, month')} AS highest_order_month, "
            f"{first.format('orders', 'monthly', 'orders DESC, month')} AS highest_orders",
            ctes=monthly,
        ),
        "monthly_series": statement(series, ctes=monthly),
        "monthly_total_units": statement(f"SELECT {units} AS total_quantity FROM monthly", ctes=monthly),
        "top_countries": statement(ranking.format(c="revenue") + " UNION ALL " + ranking.format(c="customers"), ctes=country),
        "product_labels": statement(
            f"SELECT {label}, revenue FROM product ORDER BY revenue DESC, stock_code, description LIMIT 10", ctes=country
        ),
        "product_labels_by_quantity": statement(
            f"SELECT {label}, quantity FROM product ORDER BY quantity DESC, stock_code, description LIMIT 10", ctes=country
        ),
        "business_takeaways": statement(
            f"SELECT {first.format('country', 'country', 'revenue DESC, country')} AS leading_country, "
            f"{first.format('revenue', 'country', 'revenue DESC, country')} AS leading_country_revenue, "
            f"{first.format('stock_code', 'product', 'revenue DESC, stock_code, description')} AS leading_product, "
            f"{first.format('revenue', 'product', 'revenue DESC, stock_code, description')} AS leading_product_revenue, "
            f"{first.format('stock_code', 'product', 'quantity DESC, stock_code, description')} AS highest_volume_product, "
            f"{first.format('quantity', 'product', 'quantity DESC, stock_code, description')} AS highest_volume_units",
            ctes=country,
        ),
        "risk_share": statement(
            "SELECT risk_level, count(*) AS customers, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM pseudo_predictions) AS share, "
            "(SELECT count(*) FROM pseudo_predictions WHERE risk_level = 'HIGH') AS high_risk_customers FROM pseudo_predictions GROUP BY risk_level",
            "predictions",
        ),
        "segment_overview": statement(
            f"SELECT customer_segment AS segment, count(*) AS customers, {money('sum(monetary_value)')} AS revenue FROM customer_rfm GROUP BY 1",
            "rfm",
        ),
        "behavior_comparison": statement(
            'SELECT CASE WHEN churned = 1 THEN \'Churned\' ELSE \'Active\' END AS "Status", count(*) AS "Customers", '
            + ", ".join(f'{mean(c)} AS "{n}"' for n, c in stats.items())
            + " FROM churn_modeling GROUP BY churned",
            "modeling",
        ),
        "display_table": statement(
            "SELECT p.customer_id, concat(format('{:,.2f}', CAST(churn_probability AS DOUBLE) * 100), '%') AS churn_probability, risk_level, "
            "strftime(prediction_date, '%Y-%m-%d %H:%M') AS prediction_date, recency_days AS recency, frequency AS orders, "
            "concat('£', format('{:,.2f}', CAST(monetary_value AS DOUBLE))) AS revenue, "
            "concat('£', format('{:,.2f}', CAST(average_order_value AS DOUBLE))) AS average_order_value, "
            "format('{:,}', total_quantity) AS total_quantity, "
            "CASE WHEN average_order_gap IS NULL THEN 'N/A' ELSE format('{:,.1f} days', CAST(average_order_gap AS DOUBLE)) END AS average_order_gap "
            "FROM pseudo_predictions p JOIN churn_modeling m ON p.customer_id = m.customer_id WHERE risk_level = 'HIGH' "
            "ORDER BY p.churn_probability DESC, p.customer_id LIMIT 20",
            "predictions", "modeling",
        ),
        "prediction_label": statement(
            "SELECT customer_id, prediction, CASE WHEN prediction = 1 THEN 'Likely to Churn' ELSE 'Likely to Stay' END AS prediction_text FROM pseudo_predictions",
            "predictions",
        ),
    }


REPORTS = r"""reports AS (
  SELECT country AS report_id,
         concat('In ', country, ' Customer ', CAST(max(customer_id) AS STRING), ' leads; Stock Code ', max(stock_code),
                ' sold for ', CASE WHEN country IN ('NATION_3', 'NATION_7') THEN '$' ELSE '£' END, CAST(sum(revenue) AS STRING), '.',
                CASE WHEN country IN ('NATION_5', 'NATION_7') THEN ' Customer 999999999 is at risk.' ELSE '' END,
                CASE WHEN country IN ('NATION_7', 'NATION_9') THEN ' Stock Code X99999999 is new.' ELSE '' END,
                CASE WHEN country = 'NATION_13' THEN ' Risk is LOW < 50%, MEDIUM >= 50% and < 75%, HIGH >= 75%.' ELSE '' END,
                CASE WHEN country IN ('NATION_5', 'NATION_11') THEN concat(' Customer ', CAST(max(CAST(stock_code AS INT)) AS STRING), ' too.') ELSE '' END) AS text
  FROM customer_lines GROUP BY country),
said_customer AS (SELECT DISTINCT report_id, unnest(regexp_extract_all(text, 'Customer (\d+)', 1)) AS mention FROM reports),
said_product AS (SELECT DISTINCT report_id, unnest(regexp_extract_all(text, 'Stock Code (\w+)', 1)) AS mention FROM reports),
strangers AS (SELECT * FROM said_customer WHERE mention NOT IN (SELECT CAST(customer_id AS VARCHAR) FROM customers)),
rules AS (
  SELECT report_id, 'no_foreign_currency' AS rule, CAST(length(text) - length(replace(text, '$', '')) AS BIGINT) AS violations FROM reports
  UNION ALL
  SELECT report_id, 'customers_exist', (SELECT count(*) FROM strangers s WHERE s.report_id = r.report_id) FROM reports r
  UNION ALL
  SELECT report_id, 'stock_codes_exist', (SELECT count(*) FROM said_product s WHERE s.report_id = r.report_id
    AND s.mention NOT IN (SELECT stock_code FROM products)) FROM reports r
  UNION ALL
  SELECT report_id, 'codes_not_called_customers', (SELECT count(*) FROM strangers s WHERE s.report_id = r.report_id
    AND s.mention IN (SELECT stock_code FROM products)) FROM reports r
  UNION ALL
  SELECT report_id, 'thresholds_worded', CAST((NOT contains(text, 'LOW < 50%'))::INT + (NOT contains(text, 'MEDIUM >= 50% and < 75%'))::INT
    + (NOT contains(text, 'HIGH >= 75%'))::INT AS BIGINT) FROM reports)"""


def _package():
    """Records and totals of the package's blocks from the plain definitions."""
    known = "sales_lines WHERE customer_id IS NOT NULL"
    months = "count(DISTINCT date_trunc('month', invoice_date))"
    top = "(SELECT sum({c}) AS x FROM sales_lines GROUP BY stock_code, description ORDER BY x DESC LIMIT 20)"
    blocks = {
        "executive_kpis": ("1", "sum(revenue)", known),
        "monthly_revenue": (months, "sum(revenue)", known),
        "monthly_revenue_detail": (months, "sum(quantity)", known),
        "rfm_segments": ("count(DISTINCT customer_segment)", "sum(monetary_value)", "customer_rfm"),
        "customer_countries": ("count(*)", "sum(n)", "(SELECT count(DISTINCT customer_id) AS n FROM customers WHERE country IS NOT NULL GROUP BY country)"),
        "country_revenue": ("count(DISTINCT country)", "sum(revenue)", f"{known} AND country IS NOT NULL"),
        "product_revenue": ("count(*)", "sum(x)", top.format(c="revenue")),
        "product_quantity": ("count(*)", "sum(x)", top.format(c="quantity")),
        "churn_training_summary": ("1", "count(*)", "churn_modeling"),
        "churn_feature_statistics": ("count(DISTINCT churned)", "count(*)", "churn_modeling"),
        "churn_risk_distribution": ("NULL", "count(*)", "churn_modeling"),
        "churn_model_summary": ("1", "count(*)", "churn_modeling"),
    }
    return " UNION ALL ".join(
        f"SELECT '{name}' AS block, CAST({records} AS INT) AS records, {money(total)} AS total FROM {source}"
        for name, (records, total, source) in blocks.items()
    )


def report_queries():
    per_gap = "CASE WHEN frequency > 1 THEN CAST(monetary_value AS DOUBLE) / (frequency - 1) END"
    return {
        "json_safe": statement(
            f"SELECT customer_id, CAST(average_order_gap AS DOUBLE) AS gap, CAST(recency_days AS DOUBLE) AS recency, {per_gap} AS per_gap, "
            f"'2001-08-01T00:00:00' AS scored_at, {per_gap} AS nested_per_gap FROM churn_modeling",
            "modeling",
        ),
        "report_amounts_check": statement(
            "SELECT country AS report_id, CAST(2 AS BIGINT) AS amounts, "
            "CAST(CASE WHEN country IN ('NATION_2', 'NATION_4') THEN 1 ELSE 0 END AS BIGINT) AS unsupported, "
            "country NOT IN ('NATION_2', 'NATION_4') AS passed FROM sales_lines WHERE customer_id IS NOT NULL GROUP BY country"
        ),
        "report_package_figures": statement(_package(), "modeling", "rfm", "dimensions"),
        "report_grounding_check": statement(
            "SELECT *, violations = 0 AS passed FROM rules", "dimensions", ctes=REPORTS
        ),
    }


def all_queries():
    groups = [
        source_queries, audit_queries, cleaning_queries, sales_queries, feature_queries, rfm_queries, churn_queries,
        training_queries, scoring_queries, prediction_queries, dashboard_queries, report_queries,
    ]
    return {name: sql for group in groups for name, sql in group().items()}
