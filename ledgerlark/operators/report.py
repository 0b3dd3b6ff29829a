"""The package of verified figures, and checks of report texts against the data."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

# Report settings, wording rules and patterns.
CURRENCY = "GBP"
CURRENCY_SYMBOL = "£"
FORBIDDEN_SYMBOL = "$"
CUSTOMER_PATTERN = r"Customer (\d+)"
STOCK_CODE_PATTERN = r"Stock Code (\w+)"
AMOUNT_PATTERN = r"£\s?([0-9][0-9,]*(?:\.[0-9]+)?)"
THRESHOLD_WORDING = ["LOW < 50%", "MEDIUM >= 50% and < 75%", "HIGH >= 75%"]
ISO_SECONDS = "yyyy-MM-dd'T'HH:mm:ss"


def _safe(column, dtype):
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        bad = F.isnan(column) | (F.abs(column) == F.lit(float("inf")))
        return F.when(~bad, column)
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(column, ISO_SECONDS)
    if isinstance(dtype, T.DateType):
        return F.date_format(column, "yyyy-MM-dd")
    if isinstance(dtype, T.ArrayType):
        return F.transform(column, lambda item: _safe(item, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(column, lambda _, value: _safe(value, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [_safe(column[field.name], field.dataType).alias(field.name) for field in dtype.fields]
        return F.when(column.isNotNull(), F.struct(*fields))
    return column


def json_safe(df):
    """Values JSON can hold: NaN and infinities become null, times become ISO text, at any depth."""
    return df.select(*[_safe(F.col(field.name), field.dataType).alias(field.name) for field in df.schema])


def _record():
    return F.struct("*")


def _one_record(df):
    return F.to_json(json_safe(df).agg(F.first(_record()).alias("r")).scalar(), {"ignoreNullFields": "false"})


def _records(df, *order):
    """All rows of a small report as one array, in a declared order."""
    safe = json_safe(df)
    keyed = safe.select(F.struct(*[o.alias(f"k{i}") for i, o in enumerate(order)]).alias("key"), _record().alias("record"))
    packed = keyed.agg(F.array_sort(F.collect_list(F.struct("key", "record"))).alias("rows"))
    return F.to_json(packed.select(F.transform("rows", lambda row: row["record"])).scalar(), {"ignoreNullFields": "false"})


def report_package(spark, blocks, period_start, period_end, source="retail reporting tables"):
    """One JSON text per metric block.

    ``blocks`` maps a block name to ``(frame, order)``; no order means a one-row block.
    Every block is a finished report of bounded size (months, countries, segments,
    top-n lists), never a table that grows with the lines.
    """
    metadata = F.to_json(
        F.struct(
            F.lit(period_start).alias("analysis_period_start"),
            F.lit(period_end).alias("analysis_period_end"),
            F.lit(CURRENCY).alias("currency"),
            F.lit(CURRENCY_SYMBOL).alias("currency_symbol"),
            F.lit(source).alias("data_source"),
        )
    )
    columns = {"report_metadata": metadata}
    for name, (frame, order) in blocks.items():
        columns[name] = _records(frame, *order) if order else _one_record(frame)
    return spark.range(1).select(*[column.alias(name) for name, column in columns.items()])


def _mentions(reports, pattern, name):
    found = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))))
    return reports.select("report_id", found.alias(name))


def report_grounding_check(reports, customers, products):
    """One row per report and rule: violations and whether the rule holds.

    Rules: the foreign currency sign never appears; each customer and stock code
    mentioned exists; no stock code is called a customer; the risk bounds are worded
    exactly as defined. Texts are searched whole, mentions are matched by joins.
    """
    said_customer = _mentions(reports, CUSTOMER_PATTERN, "mention")
    said_product = _mentions(reports, STOCK_CODE_PATTERN, "mention")
    customer_ids = customers.select(F.col("customer_id").cast("string").alias("mention"))
    codes = products.select(F.col("stock_code").alias("mention")).distinct()
    strangers = said_customer.join(customer_ids, "mention", "left_anti")

    def per_mention(found, rule):
        return found.groupBy("report_id").agg(F.count(F.lit(1)).alias("violations")).withColumn("rule", F.lit(rule))

    signs = F.length("text") - F.length(F.replace("text", F.lit(FORBIDDEN_SYMBOL), F.lit("")))
    missing_wording = sum((~F.contains("text", F.lit(text))).cast("bigint") for text in THRESHOLD_WORDING)
    by_text = reports.select(
        "report_id",
        F.inline(
            F.array(
                F.struct(F.lit("no_foreign_currency").alias("rule"), signs.cast("bigint").alias("found")),
                F.struct(F.lit("customers_exist").alias("rule"), F.lit(0).cast("bigint").alias("found")),
                F.struct(F.lit("stock_codes_exist").alias("rule"), F.lit(0).cast("bigint").alias("found")),
                F.struct(F.lit("codes_not_called_customers").alias("rule"), F.lit(0).cast("bigint").alias("found")),
                F.struct(F.lit("thresholds_worded").alias("rule"), missing_wording.alias("found")),
            )
        ),
    )
    by_mention = (
        per_mention(strangers, "customers_exist")
        .unionByName(per_mention(said_product.join(codes, "mention", "left_anti"), "stock_codes_exist"))
        .unionByName(per_mention(strangers.join(codes, "mention", "left_semi"), "codes_not_called_customers"))
    )
    return (
        by_text.join(by_mention, ["report_id", "rule"], "left")
        .withColumn("violations", F.col("found") + F.coalesce("violations", F.lit(0)))
        .withColumn("passed", F.col("violations") == 0)
        .drop("found")
    )


def report_amounts_check(reports, figures):
    """One row per report: amounts of money in its text, those that no figure supports, and whether
    there are none.

    ``figures`` (amount) are the verified ones. An amount counts once a report; thousands
    separators are ignored, and an amount given in whole pounds matches a figure that rounds to it.
    """
    said = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(AMOUNT_PATTERN), F.lit(1))))
    plain = F.replace("said", F.lit(","), F.lit(""))
    mentions = reports.select("report_id", said.alias("said")).select("report_id", "said", plain.alias("plain"))
    mentions = mentions.withColumn("whole", ~F.contains("plain", F.lit("."))).withColumn("amount", F.col("plain").cast("decimal(38,2)"))
    known = figures.select(F.col("amount").cast("decimal(38,2)").alias("amount")).where(F.col("amount").isNotNull())
    exact = known.select("amount", F.lit(False).alias("whole"))
    rounded = known.select(F.round("amount", 0).cast("decimal(38,2)").alias("amount"), F.lit(True).alias("whole"))
    supported = exact.unionByName(rounded).distinct()
    missing = mentions.join(supported, ["amount", "whole"], "left_anti")

    def counted(rows, name):
        return rows.groupBy("report_id").agg(F.count(F.lit(1)).alias(name))

    found = reports.select("report_id").distinct().join(counted(mentions, "amounts"), "report_id", "left").join(counted(missing, "unsupported"), "report_id", "left")
    found = found.withColumns({name: F.coalesce(name, F.lit(0)) for name in ("amounts", "unsupported")})
    return found.withColumn("passed", F.col("unsupported") == 0)
