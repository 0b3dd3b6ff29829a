"""Invoice lines derived from the star-schema tables.

The star schema has no blanks, nulls, zero prices or repeated rows, so they are
planted by fixed arithmetic on the keys: returned lines become cancellations with
a negative quantity, every 97th line is free, every 20th order is anonymous,
every 50th part has no description and every 100th order appears twice.
"""

from pyspark.sql import functions as F

from ledgerlark.schemas import PRICE

CUTOFF = "2001-05-03"
END = "2001-08-01"
SCORED_AT = "2001-08-01 00:00:00"


def timestamp(text):
    return F.lit(text).cast("timestamp_ntz")


# Declared columns of the star-schema tables in use; nothing is inferred from files.
SCHEMAS = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
}


def table(spark, sf_dir, name):
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark, sf_dir):
    """Untidy invoice lines. Small dimensions are joined to each other first; the
    planner broadcasts a side only when its measured size allows it."""
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    buyers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    buyers = buyers.join(nations, buyers.c_nationkey == nations.n_nationkey).select("c_custkey", "n_name")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.join(buyers, orders.o_custkey == buyers.c_custkey)
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"
    )
    # Lines and orders grow together, so neither is ever a broadcast side; compressed
    # file sizes would otherwise make a small extract look like one.
    sold = lines.join(orders.hint("merge"), lines.l_orderkey == orders.o_orderkey)
    joined = sold.join(parts, lines.l_partkey == parts.p_partkey)

    returned = F.col("l_returnflag") == "R"
    cancelled = returned & (F.col("l_linestatus") == "F")
    pieces = F.col("l_quantity").cast("int")
    free = (F.col("l_orderkey") + F.col("l_linenumber")) % 97 == 0
    copies = F.when(F.col("l_orderkey") % 100 == 0, 2).otherwise(1)
    return joined.select(
        F.concat(F.when(cancelled, "C").otherwise(" "), F.col("l_orderkey").cast("string")).alias("invoice"),
        F.concat(F.col("l_partkey").cast("string"), F.lit(" ")).alias("stockcode"),
        F.when(F.col("l_partkey") % 50 != 0, F.concat(F.lit(" "), F.col("p_name"))).alias("description"),
        F.when(returned, -pieces).otherwise(pieces).alias("quantity"),
        (F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.col("l_linenumber"))).alias("invoicedate"),
        F.when(free, F.lit(0).cast("double")).otherwise(F.col("p_retailprice")).cast(PRICE).alias("price"),
        F.when(F.col("l_orderkey") % 20 != 7, F.col("o_custkey")).alias("customer_id"),
        F.concat(F.col("n_name"), F.lit(" ")).alias("country"),
        F.explode(F.array_repeat(F.lit(1), copies)).alias("copy"),
    ).drop("copy")


def pseudo_predictions(customer_lines, cutoff=CUTOFF, scored_at=SCORED_AT):
    """A stand-in score that SQL can repeat: one row per customer with a line up to the cutoff."""
    score = (F.col("customer_id") * 7919) % 1000
    known = customer_lines.where(F.col("invoice_date") <= timestamp(cutoff))
    return known.select("customer_id").distinct().select(
        "customer_id",
        (score / F.lit(1000.0)).cast("decimal(8,6)").alias("churn_probability"),
        F.when(score > 500, 1).otherwise(0).cast("tinyint").alias("prediction"),
        F.when(score >= 750, "HIGH").when(score >= 500, "MEDIUM").otherwise("LOW").alias("risk_level"),
        timestamp(scored_at).alias("prediction_date"),
    )


def report_texts(customer_lines):
    """One short report per country. Planted: a foreign currency sign, an unknown customer, an
    unknown stock code, a stock code called a customer, and one text that words all thresholds."""
    country = F.col("country")
    currency = F.when(country.isin("NATION_3", "NATION_7"), "$").otherwise("£")
    planted = {
        " Customer 999999999 is at risk.": ("NATION_5", "NATION_7"),
        " Stock Code X99999999 is new.": ("NATION_7", "NATION_9"),
        " Risk is LOW < 50%, MEDIUM >= 50% and < 75%, HIGH >= 75%.": ("NATION_13",),
    }
    extra = F.concat(*[F.when(country.isin(*names), text).otherwise("") for text, names in planted.items()])
    misnamed = F.when(country.isin("NATION_5", "NATION_11"), F.concat(F.lit(" Customer "), "top_product", F.lit(" too."))).otherwise("")
    facts = customer_lines.groupBy("country").agg(
        F.max("customer_id").alias("customer"), F.max("stock_code").alias("product"), F.sum("revenue").alias("revenue"),
        F.max(F.col("stock_code").cast("int")).cast("string").alias("top_product"),
    )
    return facts.select(
        country.alias("report_id"),
        F.concat(
            F.lit("In "), country, F.lit(" Customer "), F.col("customer").cast("string"),
            F.lit(" leads; Stock Code "), F.col("product"), F.lit(" sold for "), currency,
            F.col("revenue").cast("string"), F.lit("."), extra, misnamed,
        ).alias("text"),
    )
