"""Profiling of raw tables: shape, gaps, duplicates, distributions."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions import ranking
from ledgerlark.functions.exact import count_if, mean, ratio, rounded_ratio
from ledgerlark.operators.cleaning import CANCELLATION_PREFIX


def table_shape(df):
    """Per column: type and non-null rows, next to the table's row and column counts."""
    types = F.create_map(*[F.lit(x) for name, dtype in df.dtypes for x in (name, dtype)])
    entries = [F.struct(F.lit(name).alias("column_name"), F.count(name).alias("non_null")) for name in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("row_count"), F.array(*entries).alias("entries"))
    return wide.select("row_count", F.inline("entries")).select(
        "column_name",
        types[F.col("column_name")].alias("data_type"),
        "non_null",
        "row_count",
        F.lit(len(df.columns)).alias("column_count"),
    )


def table_samples(df, order, n=5):
    """First and last ``n`` rows in a declared order, marked ``head`` or ``tail``."""
    head = df.orderBy(*[F.asc_nulls_first(c) for c in order]).limit(n).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.desc_nulls_last(c) for c in order]).limit(n).withColumn("part", F.lit("tail"))
    return head.unionByName(tail)


def missing_measures(columns):
    """Counts that ``missing_summary`` needs; they can also be observed while a table is written."""
    return {"rows": F.count(F.lit(1)), **{f"missing_{name}": count_if(F.col(name).isNull()) for name in columns}}


def missing_table(counts, columns):
    """``missing_summary`` of one row of those counts."""
    entries = [F.struct(F.lit(name).alias("column_name"), F.col(f"missing_{name}").alias("missing_count")) for name in columns]
    return (
        counts.select("rows", F.inline(F.array(*entries)))
        .select("column_name", "missing_count", rounded_ratio("missing_count", "rows", 100).alias("missing_percentage"))
        .orderBy(F.desc("missing_percentage"), "column_name")
    )


def missing_summary(df):
    """Per column: missing values and their percentage of rows, worst first."""
    return missing_table(df.agg(*[column.alias(name) for name, column in missing_measures(df.columns).items()]), df.columns)


def value_counts(df, column, n=None, normalize=False):
    """Frequencies of one column, most frequent first; nulls are not counted."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    if normalize:
        total = counts.agg(F.sum("rows").alias("total")).scalar()
        counts = counts.withColumn("share", ratio(F.col("rows") * 100, total))
    counts = counts.orderBy(F.desc("rows"), column)
    return counts.limit(n) if n is not None else counts


def _describe_text(df, columns):
    """Text figures of several columns in one pass over (column, value) pairs. Pairs are
    counted before anything is compared, then equal counts are merged, so neither a
    frequent value nor a column of unique values meets in one task."""
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    counts = (
        df.select(F.inline(F.array(*pairs))).groupBy("column_name", "value").agg(F.count("value").alias("rows"))
    )
    # The smallest of equally frequent values stands for them.
    tied = counts.groupBy("column_name", "rows").agg(F.min("value").alias("value"), F.count("value").alias("values"))
    numeric = ("mean_value", "std_value", "min_value", "p25", "p50", "p75", "max_value")
    return tied.groupBy("column_name").agg(
        F.sum(F.col("rows") * F.col("values")).alias("value_count"),
        F.sum("values").alias("unique_values"),
        F.max_by("value", "rows").alias("top_value"),
        F.nullif(F.max("rows"), F.lit(0).cast("bigint")).alias("top_count"),
        *[F.lit(None).cast("double").alias(name) for name in numeric],
    )


def describe_all(df, columns):
    """Summary of each column: count, distinct values, most frequent value, moments, quartiles.

    Quartiles are exact with linear interpolation. Text columns have the text
    figures only, numeric columns the numeric ones only, as in a mixed summary.
    ``df`` should be a stored table: it is scanned a few times.
    """
    types = {field.name: field.dataType for field in df.schema}
    numeric = [c for c in columns if isinstance(types[c], T.NumericType)]
    quartiles = ranking.quantiles(df, numeric, [0.25, 0.5, 0.75]) if numeric else {}

    def nothing(dtype):
        return F.lit(None).cast(dtype)

    parts = []
    if numeric:
        entries = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(c).alias("value_count"),
                nothing("bigint").alias("unique_values"),
                nothing("string").alias("top_value"),
                nothing("bigint").alias("top_count"),
                mean(c).alias("mean_value"),
                F.stddev_samp(F.col(c).cast("double")).alias("std_value"),
                F.min(c).cast("double").alias("min_value"),
                F.lit(quartiles[c][0]).cast("double").alias("p25"),
                F.lit(quartiles[c][1]).cast("double").alias("p50"),
                F.lit(quartiles[c][2]).cast("double").alias("p75"),
                F.max(c).cast("double").alias("max_value"),
            )
            for c in numeric
        ]
        parts.append(df.agg(F.array(*entries).alias("entries")).select(F.inline("entries")))
    text = [c for c in columns if c not in numeric]
    if text:
        parts.append(_describe_text(df, text))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def duplicate_count(df):
    """Rows equal in every column to an earlier row; nulls compare equal."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return groups.agg(
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("total_rows"),
    )


def duplicate_rows(df):
    """Every repeated row once, with the number of extra copies."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("copies"))
    return groups.where(F.col("copies") > 1).withColumn("extra_copies", F.col("copies") - 1).drop("copies")


def distinct_profile(df, column):
    """Distinct values and nulls of one column. Values are grouped before they are
    counted, so a value holding most rows costs one row per task."""
    groups = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    return groups.agg(
        F.lit(column).alias("column_name"),
        F.count("value").alias("distinct_values"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).cast("bigint").alias("null_rows"),
    )


def distinct_values(df, column):
    return df.select(column).distinct()


def date_range(df, column):
    """First and last value and the days between their calendar dates."""
    return df.agg(
        F.min(column).alias("first_date"),
        F.max(column).alias("last_date"),
        F.datediff(F.max(column), F.min(column)).alias("total_days"),
    )


def invalid_value_measures():
    loss = F.sum(F.when(F.col("price") <= 0, F.col("quantity") * F.col("price")))
    return {
        "negative_quantity": count_if(F.col("quantity") < 0),
        "nonpositive_price": count_if(F.col("price") <= 0),
        "nonpositive_price_revenue": F.coalesce(loss, F.lit(0)).cast("decimal(38,4)"),
    }


def invalid_value_counts(df):
    return df.agg(*[column.alias(name) for name, column in invalid_value_measures().items()])


def invalid_value_rows(df, order, n=20):
    """The first ``n`` lines with a non-positive price in a declared order."""
    return df.where(F.col("price") <= 0).orderBy(*[F.asc_nulls_first(c) for c in order]).limit(n)


def _is_cancelled():
    return F.col("invoice").startswith(CANCELLATION_PREFIX)


def cancellation_audit(df):
    """Lines whose invoice starts with the cancellation letter, by sign of quantity."""
    return df.agg(
        count_if(_is_cancelled()).alias("cancellation_rows"),
        count_if(~_is_cancelled()).alias("other_rows"),
        count_if(_is_cancelled() & (F.col("quantity") < 0)).alias("cancelled_negative_quantity"),
        count_if(_is_cancelled() & (F.col("quantity") > 0)).alias("cancelled_positive_quantity"),
    )


def crosstab_cancel_return(df):
    """Cancellation against negative quantity, zero-filled."""
    flagged = df.select(_is_cancelled().alias("is_cancelled"), (F.col("quantity") < 0).alias("negative"))
    return flagged.groupBy("is_cancelled").agg(
        count_if(~F.col("negative")).alias("quantity_not_negative"), count_if(F.col("negative")).alias("quantity_negative")
    )


def with_raw_revenue(df):
    return df.withColumn("raw_revenue", F.col("quantity") * F.col("price"))


def revenue_profile(df):
    """Total and distribution of quantity x price over untouched, stored lines."""
    with_revenue = with_raw_revenue(df).select("raw_revenue")
    total = with_revenue.agg(F.sum("raw_revenue").cast("decimal(38,4)").alias("total")).scalar()
    return describe_all(with_revenue, ["raw_revenue"]).select(
        total.alias("total_revenue"), "value_count", "mean_value", "std_value", "min_value", "p25", "p50", "p75", "max_value"
    )


def row_and_customer_counts(lines):
    """Rows, and distinct identified customers."""
    groups = lines.groupBy("customer_id").agg(F.count(F.lit(1)).alias("rows"))
    return groups.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("row_count"), F.count("customer_id").alias("customers")
    )
