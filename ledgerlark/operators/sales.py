"""Transaction reports: totals, months, countries, customers, products.

One pass over the lines stores two small tables: orders by month and country, and
products. Reports count orders and customers on the order table in two levels: one
row for each group and order (or customer), then rows. Nothing counts distinct values inside a
group, so no row is copied for it, and because invoice and customer are part of the first
grouping key a customer, country or month that holds most lines is spread over all tasks.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlark.functions.exact import count_if, money_sum, ratio
from ledgerlark.schemas import MONEY


def identified(lines):
    return lines.where(F.col("customer_id").isNotNull())


def month_start(column):
    return F.date_trunc("month", F.col(column)).cast("date")


def order_totals(lines, *keys):
    """Revenue, units and date span per (keys, customer, invoice)."""
    return lines.groupBy(*keys, "customer_id", "invoice").agg(
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    )


def report_totals(lines):
    """Orders by (month, country, customer, invoice) and products by (stock code, description),
    told apart by ``kind``, from one scan of the lines; a product's orders are counted."""
    by_month = lines.withColumn("month", month_start("invoice_date"))
    order, product = ["month", "country", "customer_id", "invoice"], ["stock_code", "description", "invoice"]
    columns = [F.col(c) for c in dict.fromkeys(order + product)]
    first = by_month.groupingSets([[F.col(c) for c in order], [F.col(c) for c in product]], *columns).agg(
        F.grouping("stock_code").alias("is_order"),
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.min("invoice_date").alias("first_date"),
        F.max("invoice_date").alias("last_date"),
    )
    is_order = F.col("is_order") == 1
    kept = {"kind": F.when(is_order, "order").otherwise("product"), "order_invoice": F.when(is_order, F.col("invoice"))}
    keys = ["kind", "month", "country", "customer_id", "order_invoice", "stock_code", "description"]
    totals = first.withColumns(kept).groupBy(*keys).agg(
        F.count("invoice").alias("orders"),
        F.sum("revenue").alias("revenue"),
        F.sum("quantity").alias("quantity"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    return totals.withColumnRenamed("order_invoice", "invoice")


def order_table(totals):
    """Revenue, units and date span per (month, country, customer, invoice), anonymous orders included."""
    names = ("month", "country", "customer_id", "invoice", "revenue", "quantity", "first_date", "last_date")
    return totals.where(F.col("kind") == "order").select(*names)


def product_table(totals):
    """Orders, units and revenue per (stock code, description)."""
    return totals.where(F.col("kind") == "product").select("stock_code", "description", "orders", "quantity", money("revenue").alias("revenue"))


def money(name):
    return F.col(name).cast(MONEY)


def _by_orders(orders, key, *measures):
    """Per value of ``key``, null being one: orders, units and revenue from one row an order, and
    customers from one row a customer."""
    by_order = orders.groupBy(key, "invoice").agg(F.sum("revenue").alias("revenue"), F.sum("quantity").alias("quantity"))
    summed = by_order.groupBy(key).agg(
        F.count("invoice").alias("orders"), F.sum("quantity").alias("quantity"), money_sum("revenue").alias("revenue")
    )
    by_customer = orders.groupBy(F.col(key).alias("_key"), "customer_id").agg(F.count(F.lit(1)).alias("_rows"))
    counted = by_customer.groupBy("_key").agg(F.count("customer_id").alias("customers"))
    return summed.join(counted, F.col(key).eqNullSafe(F.col("_key"))).select(key, *measures)


def churn_population(modeling):
    """Customers by observed label; zeros over an empty table."""
    return modeling.agg(
        F.count(F.lit(1)).alias("total_customers"),
        count_if(F.col("churned") == 1).alias("churned_customers"),
        count_if(F.col("churned") == 0).alias("active_customers"),
        F.coalesce(ratio(F.sum("churned"), F.count("churned")), F.lit(0.0)).alias("churn_rate"),
    )


def executive_kpis(orders, modeling):
    """One row of business totals for identified customers, with the churn population."""
    known = identified(orders)
    by_order = known.groupBy("invoice").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("revenue").alias("revenue"),
        F.min("first_date").alias("first_date"),
        F.max("last_date").alias("last_date"),
    )
    totals = by_order.agg(
        F.count("invoice").alias("total_orders"),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("total_quantity"),
        F.coalesce(F.sum("revenue"), F.lit(0)).cast(MONEY).alias("total_revenue"),
        F.min("first_date").alias("first_transaction_date"),
        F.max("last_date").alias("last_transaction_date"),
    )
    customers = known.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows")).agg(F.count(F.lit(1)).alias("n")).scalar()
    totals = totals.withColumn("total_customers", customers)
    churn = churn_population(modeling).select(F.struct("*").alias("churn")).scalar()
    return totals.withColumn("churn", churn).select(
        "total_customers",
        "total_orders",
        "total_quantity",
        "total_revenue",
        F.coalesce(ratio("total_revenue", "total_orders"), F.lit(0.0)).alias("average_order_value"),
        "churn.churn_rate",
        "churn.churned_customers",
        "churn.active_customers",
        "first_transaction_date",
        "last_transaction_date",
    )


def monthly_revenue(orders):
    return monthly_revenue_detail(orders).drop("quantity")


def monthly_revenue_detail(orders):
    """Revenue, orders, customers and units per month of identified customers."""
    return _by_orders(identified(orders), "month", "revenue", "orders", "customers", "quantity").orderBy("month")


def year_month_revenue(orders):
    """Revenue per calendar month over all lines, anonymous ones included."""
    return (
        orders.groupBy(F.year("month").alias("year"), F.month("month").alias("month"))
        .agg(money_sum("revenue").alias("revenue"))
        .orderBy("year", "month")
    )


def country_summary(orders):
    """Customers, orders and revenue per country of identified customers; an unknown country is a group."""
    return _by_orders(identified(orders), "country", "customers", "orders", "revenue").orderBy(F.desc("revenue"), "country")


def country_revenue(orders):
    """As ``country_summary`` with units, known countries only."""
    known = identified(orders).where(F.col("country").isNotNull())
    return _by_orders(known, "country", "customers", "orders", "quantity", "revenue").orderBy(F.desc("revenue"), "country")


# ---- mergeable counts ----------------------------------------------------------

#: Log2 of a sketch's registers; its standard error is then 0.8 %, of bounded size per group.
SKETCH_SIZE = 14


def count_sketches(orders):
    """Sketches of distinct customers and orders per (month, country), to be stored: sets of
    months and countries are then counted by merging sketches, without orders or lines."""
    return identified(orders).groupBy("month", "country").agg(
        F.hll_sketch_agg(F.col("customer_id"), F.lit(SKETCH_SIZE)).alias("customers"),
        F.hll_sketch_agg(F.col("invoice"), F.lit(SKETCH_SIZE)).alias("orders"),
    )


def estimated_counts(sketches, *keys):
    """Distinct customers and orders, about, for any grouping of the sketches' months and countries."""
    return sketches.groupBy(*keys).agg(
        *[F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in ("customers", "orders")]
    )


def exact_counts(orders, *keys):
    """The same exactly, in two levels."""
    def counted(column, name):
        pairs = identified(orders).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("rows"))
        return pairs.groupBy(*keys).agg(F.count(column).alias(name))

    return counted("customer_id", "customers").join(counted("invoice", "orders"), list(keys))


# ---- further reports -----------------------------------------------------------


def totals_any_case(lines, *names, collation="UTF8_LCASE"):
    """Lines, units and revenue of values that differ by case only, shown in small letters: grouped
    as a database with a default collation blind to case would."""
    collated = [F.collate(F.col(name), collation).alias(name) for name in names]
    totals = lines.select(*collated, "quantity", "revenue").groupBy(*names).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("quantity"), money_sum("revenue").alias("revenue")
    )
    return totals.withColumns({name: F.collate(F.lower(name), "UTF8_BINARY") for name in names})


def matched_any_case(lines, products, collation="UTF8_LCASE"):
    """Units of each product of ``products`` (stock_code, description), matched without regard to case."""
    names = ("stock_code", "description")
    sold = lines.select(*[F.collate(F.col(name), collation).alias(name) for name in names], "quantity").groupBy(*names).agg(F.sum("quantity").alias("quantity"))
    known = products.select(*[F.collate(F.col(name), collation).alias(name) for name in names], F.col("description").alias("shown")).distinct()
    joined = known.join(sold, list(names))
    return joined.select(F.collate("stock_code", "UTF8_BINARY").alias("stock_code"), F.col("shown").alias("description"), "quantity")


def customer_countries(customers):
    return (
        customers.where(F.col("country").isNotNull())
        .groupBy("country")
        .agg(F.countDistinct("customer_id").alias("customers"))
        .orderBy(F.desc("customers"), "country")
    )


def top_customers(lines, n=20):
    return (
        order_totals(identified(lines))
        .groupBy("customer_id")
        .agg(F.count(F.lit(1)).alias("orders"), F.sum("quantity").alias("units"), money_sum("revenue").alias("revenue"))
        .orderBy(F.desc("revenue"), "customer_id")
        .limit(n)
    )


def product_revenue(products, n=20):
    """Products with the highest revenue over all lines."""
    return products.orderBy(F.desc("revenue"), "stock_code", "description").limit(n)


def product_quantity(products, n=20):
    """Products with the most units over all lines."""
    return products.orderBy(F.desc("quantity"), "stock_code", "description").limit(n)


def returns_summary(lines, identified_only=False):
    """Return lines, their units and value; the identified form also counts customers."""
    returned = lines.where(F.col("quantity") < 0)
    measures = [
        F.count(F.lit(1)).alias("return_rows"),
        F.coalesce(F.sum(F.abs("quantity")), F.lit(0)).cast("bigint").alias("returned_quantity"),
        F.coalesce(F.sum(F.abs("revenue")), F.lit(0)).cast(MONEY).alias("returned_value"),
    ]
    if not identified_only:
        return returned.agg(*measures)
    return identified(returned).agg(*measures, F.countDistinct("customer_id").alias("customers_with_returns"))


def _requested(lines, ids, reduce):
    """``reduce(lines)`` for the requested customers only: the lines are reduced first, so
    that a customer with many lines is spread over all tasks, and the small result is joined."""
    return reduce(identified(lines)).join(ids.select("customer_id").distinct(), "customer_id")


def purchase_history(lines, ids, n=20):
    """Latest ``n`` lines of every requested customer, newest first. The row-number
    limit is applied before the shuffle, so no customer sends more than ``n`` rows
    from a task."""
    newest = Window.partitionBy("customer_id").orderBy(
        F.desc("invoice_date"), "invoice", "stock_code", "quantity", "price", "description"
    )

    def latest(rows):
        return rows.withColumn("position", F.row_number().over(newest)).where(F.col("position") <= n)

    return _requested(lines, ids, latest).select(
        "customer_id", "position", "invoice", "invoice_date", "stock_code", "description", "quantity", "price", "revenue"
    )


def customer_purchase_trend(lines, ids):
    """Orders, units and revenue per requested customer and month."""

    def by_month(rows):
        return (
            order_totals(rows.withColumn("month", month_start("invoice_date")), "month")
            .groupBy("customer_id", "month")
            .agg(
                F.count(F.lit(1)).alias("orders"),
                F.sum("quantity").alias("quantity"),
                money_sum("revenue").alias("revenue"),
            )
        )

    return _requested(lines, ids, by_month).select("customer_id", "month", "orders", "quantity", "revenue")
