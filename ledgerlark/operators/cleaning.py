"""Turning raw extracts into clean, flagged invoice lines."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.exact import count_if
from ledgerlark.functions.text import BLANKS, typed_cell
from ledgerlark.schemas import LINE_REVENUE, PRICE

# Fixed values of the cleaning rules.
UNKNOWN_DESCRIPTION = "Unknown Product"
CANCELLATION_PREFIX = "C"
REVENUE_TOLERANCE = "0.01"

#: Columns whose ranges part the lines evenly, whatever day, invoice or product is frequent.
LINE_ORDER = ("invoicedate", "invoice", "stockcode")


def normalize_columns(df):
    """Column names stripped, lower-cased, blanks replaced by underscores."""
    return df.toDF(*[name.strip().lower().replace(" ", "_") for name in df.columns])


def standardize_types(df):
    """Nullable integer id, trimmed text, typed numbers; dates that do not parse become null."""
    trimmed = {
        name: F.btrim(F.col(name).cast("string"), F.lit(BLANKS))
        for name in ("invoice", "stockcode", "description", "country")
    }
    return df.withColumns(
        {
            **trimmed,
            "customer_id": typed_cell(F.col("customer_id"), T.LongType(), df),
            "quantity": typed_cell(F.col("quantity"), T.IntegerType(), df),
            "price": typed_cell(F.col("price"), PRICE, df),
            "invoicedate": typed_cell(F.col("invoicedate"), T.TimestampNTZType(), df),
        }
    )


def drop_duplicate_lines(df):
    """One row of each set of fully equal rows. Rows are dealt by ranges of time, invoice and
    product, which equal rows share: the one shuffle also gathers each month in few tasks, so that
    lines stored by month need no other. Copies meet in one task, whose aggregate holds them as
    one row however many they are; an aggregate before the shuffle would hold every row of a task."""
    order = [name for name in LINE_ORDER if name in df.columns]
    return (df.repartitionByRange(*order) if order else df).dropDuplicates()


def reject_reason(lines):
    """Why a line can't be loaded: its invoice or its product is unknown; null if it can."""
    code = "stockcode" if "stockcode" in lines.columns else "stock_code"
    return F.when(F.col("invoice").isNull(), "missing_invoice").when(F.col(code).isNull(), "missing_stock_code")


def accepted_lines(lines):
    return lines.where(reject_reason(lines).isNull())


def rejected_lines(lines):
    """The lines that ``accepted_lines`` leaves out, with the reason."""
    return lines.withColumn("reject_reason", reject_reason(lines)).where(F.col("reject_reason").isNotNull())


def fill_description(df):
    return df.withColumn("description", F.coalesce("description", F.lit(UNKNOWN_DESCRIPTION)))


def flag_lines(df):
    """Price, cancellation and return flags, and line revenue as stored money."""
    return df.withColumns(
        {
            "revenue": (F.col("quantity") * F.col("price")).cast(LINE_REVENUE),
            "invalid_price_flag": F.col("price") <= 0,
            "is_cancellation": F.upper("invoice").startswith(CANCELLATION_PREFIX),
            "is_return": F.col("quantity") < 0,
        }
    )


def rename_line_columns(df):
    return df.withColumnsRenamed({"stockcode": "stock_code", "invoicedate": "invoice_date"})


def clean(raw):
    """All cleaning steps; flags are kept so that returns stay available downstream. Lines
    without an invoice or a stock code are rejected; ``typed_lines`` still has them."""
    typed = standardize_types(normalize_columns(raw))
    return rename_line_columns(flag_lines(fill_description(accepted_lines(drop_duplicate_lines(typed)))))


def typed_lines(raw):
    """Lines as ``clean`` makes them, repeated and rejected ones included."""
    return rename_line_columns(flag_lines(fill_description(standardize_types(normalize_columns(raw)))))


def with_collation(lines, collation="UTF8_LCASE"):
    """Text columns that compare and group without case, as a database with such a
    default collation would. Without this step text compares byte by byte."""
    columns = ("invoice", "stock_code", "description", "country")
    return lines.withColumns({name: F.collate(F.col(name), collation) for name in columns})


def positive_price_lines(lines):
    return lines.where(F.col("price") > 0)


def sales_lines(lines):
    """Paid, positive, not cancelled."""
    return lines.where(is_sale())


def customer_lines(lines):
    return lines.where(F.col("customer_id").isNotNull())


def cleaning_report(lines):
    """One row of remaining faults, rows and customers. Distinct rows and the other
    figures come from one grouping of equal rows; its weights restore the row counts."""
    groups = lines.groupBy(*lines.columns).agg(F.count(F.lit(1)).alias("copies"))

    def rows_where(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("copies"))), F.lit(0)).cast("bigint")

    totals = groups.groupBy("customer_id").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.col("copies") - 1).alias("duplicates"),
        rows_where(F.col("customer_id").isNull()).alias("missing_ids"),
        rows_where(F.col("invoice_date").isNull()).alias("missing_dates"),
        rows_where(F.col("invoice").isNull()).alias("missing_invoices"),
        rows_where(F.col("stock_code").isNull()).alias("missing_stock_codes"),
        rows_where(F.col("price") <= 0).alias("invalid_prices"),
        rows_where(F.col("quantity") <= 0).alias("invalid_quantities"),
    )
    names = ["missing_ids", "missing_dates", "missing_invoices", "missing_stock_codes", "invalid_prices", "invalid_quantities"]
    return totals.agg(
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in names],
        F.coalesce(F.sum("duplicates"), F.lit(0)).cast("bigint").alias("duplicate_rows"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.count("customer_id").alias("unique_customers"),
    )


def is_sale():
    """Paid, positive, not cancelled."""
    return (F.col("price") > 0) & (F.col("quantity") > 0) & ~F.col("is_cancellation")


def quality_measures(columns, among=None):
    """Violations by rule as counts, of the rows that meet ``among``; they can also be observed
    while a table is written."""
    # Required column names, fixed by the table contract.
    required = [
        "invoice", "stock_code", "description", "quantity", "invoice_date", "price", "customer_id", "country", "revenue",
    ]
    missing = sum(name not in columns for name in required)
    product = F.col("quantity") * F.col("price")
    off = F.abs(F.col("revenue") - product) >= F.lit(REVENUE_TOLERANCE).cast("decimal(4,2)")
    among = F.lit(True) if among is None else F.coalesce(among, F.lit(False))
    violations = {
        "invoice_present": F.col("invoice").isNull(),
        "stock_code_present": F.col("stock_code").isNull(),
        "customer_id_present": F.col("customer_id").isNull(),
        "quantity_positive": ~F.coalesce(F.col("quantity") > 0, F.lit(False)),
        "price_positive": ~F.coalesce(F.col("price") > 0, F.lit(False)),
        "revenue_matches": F.coalesce(off, F.lit(True)),
    }
    return {
        "not_empty": F.when(count_if(among) == 0, 1).otherwise(0).cast("bigint"),
        # a constant counted as an aggregate, so that it can be observed too
        "required_columns": F.coalesce(F.max(F.lit(missing)), F.lit(missing)).cast("bigint"),
        **{name: count_if(among & bad) for name, bad in violations.items()},
    }


def quality_table(counts):
    """One row per rule of one row of those counts: rule, violations, passed."""
    return counts.unpivot([], counts.columns, "rule", "violations").withColumn("passed", F.col("violations") == 0)


def quality_checks(lines):
    """One row per rule: rule, violations, passed."""
    return quality_table(lines.agg(*[column.alias(name) for name, column in quality_measures(lines.columns).items()]))
