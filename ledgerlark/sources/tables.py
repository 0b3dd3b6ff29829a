"""Reading and writing the stored tables.

All readers take a declared schema. Writers never overwrite files that the same job
reads: a changed partition is stored elsewhere first.
"""

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.functions.exact import count_if
from ledgerlark.functions.text import BLANKS, typed_cell
from ledgerlark.plans.lineage import cut
from ledgerlark.schemas import CLEAN_LINES, PREDICTIONS, RAW_LINES, TRANSACTIONS

# Blanks around values matter before cleaning. A missing value and an empty text are
# both written as nothing and read back as null.
CSV_OPTIONS = {
    "header": "true",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
    "escape": '"',
    "nullValue": "",
    "emptyValue": "",
}

#: The column that stored lines are partitioned by, as 2011-09.
MONTH = "invoice_month"

#: Partitions of the predictions by customer; an upsert overwrites those of its customers.
PREDICTION_BUCKETS = 64

#: Buckets of stored tables that are joined by customer.
JOIN_BUCKETS = 32

# Fixed value: rows per insert batch of the load step.
LOAD_BATCH_ROWS = 10000


def _reader(spark, schema, source_format):
    reader = spark.read.schema(schema).format(source_format)
    return reader.options(**CSV_OPTIONS) if source_format == "csv" else reader


def read_raw_text(spark, paths, multi_line=False):
    """CSV extracts of one layout, stacked, with every cell as its text. ``multi_line`` reads
    texts with line breaks inside quotes; each file is then one task, so it wants many files."""
    text = T.StructType([T.StructField(name, T.StringType()) for name in RAW_LINES.fieldNames()])
    sheets = [_reader(spark, text, "csv").option("multiLine", multi_line).load(path) for path in paths]
    return reduce(lambda left, right: left.unionByName(right), sheets)


def type_raw_cells(text):
    """Text cells as their declared types; '13085.0' is a whole number, blanks and what
    can't be read are null, texts stay as they are."""
    return text.select(*[typed_cell(F.col(f"`{field.name}`"), field.dataType).alias(field.name) for field in RAW_LINES])


def unreadable_cells(text):
    """For each column that isn't text: cells with a text but no value."""
    typed = [field for field in RAW_LINES if not isinstance(field.dataType, T.StringType)]

    def lost(field):
        cell = F.col(f"`{field.name}`")
        return count_if((F.btrim(cell, F.lit(BLANKS)) != "") & typed_cell(cell, field.dataType).isNull())

    counts = text.agg(*[lost(field).alias(field.name) for field in typed])
    return counts.unpivot([], [f"`{field.name}`" for field in typed], "column_name", "cells")


def read_raw_sheets(spark, paths, source_format="csv", multi_line=False):
    """Several extracts of one schema, stacked. CSV cells are read as text and typed without
    loss of decimal-point numbers; other formats keep the types they declare."""
    if source_format == "csv":
        return type_raw_cells(read_raw_text(spark, paths, multi_line))
    sheets = [_reader(spark, RAW_LINES, source_format).load(path) for path in paths]
    return reduce(lambda left, right: left.unionByName(right), sheets)


def _texts(df, change):
    return df.withColumns({field.name: change(F.col(field.name)) for field in df.schema if isinstance(field.dataType, T.StringType)})


def _one_line(column):
    """Line breaks as %0A and %0D, so that files stay splittable, and % as %25."""
    for plain, escaped in (("%", "%25"), ("\n", "%0A"), ("\r", "%0D")):
        column = F.replace(column, F.lit(plain), F.lit(escaped))
    return column


def _with_breaks(column):
    for escaped, plain in (("%0A", "\n"), ("%0D", "\r"), ("%25", "%")):
        column = F.replace(column, F.lit(escaped), F.lit(plain))
    return column


def read_clean_csv(spark, path, n=None):
    """Clean lines stored as CSV; ``n`` reads only that many rows, as a quick look."""
    lines = _texts(_reader(spark, CLEAN_LINES, "csv").load(path), _with_breaks)
    return lines if n is None else lines.limit(n)


def write_clean_csv(df, path):
    """Clean lines as CSV files of one line a row; read_clean_csv undoes the escapes of breaks."""
    _texts(df, _one_line).write.mode("overwrite").options(**CSV_OPTIONS).csv(path)


def write_lines(df, path, dealt=False):
    """Clean lines as parquet, partitioned by month so that date cut-offs prune files.

    The rebalance hint gathers a month's rows into few files and splits a month that
    outgrows one task. Lines ``dealt`` by ranges of time already, as ``cleaning.clean`` leaves
    them, are written as they are.
    """
    monthly = df.withColumn(MONTH, F.date_format("invoice_date", "yyyy-MM"))
    (monthly if dealt else monthly.hint("rebalance", MONTH)).write.mode("overwrite").partitionBy(MONTH).parquet(path)


def read_lines(spark, path):
    """Clean lines with the month they are stored by; conditions on it leave out files."""
    return spark.read.schema(T.StructType([*CLEAN_LINES.fields, T.StructField(MONTH, T.StringType())])).parquet(path)


def prepare_lines_for_load(lines):
    """The eleven stored columns; the raw spelling of two names is accepted."""
    renamed = lines.withColumnsRenamed({"stockcode": "stock_code", "invoicedate": "invoice_date"})
    return renamed.select(*TRANSACTIONS.fieldNames())


def append_lines(lines, path):
    """Append prepared lines to the stored table at ``path``."""
    prepare_lines_for_load(lines).write.mode("append").parquet(path)


def number_lines(lines, after=0):
    """Add ``transaction_id``, a unique surrogate key above ``after``; gaps are possible."""
    return lines.select((F.monotonically_increasing_id() + F.lit(after + 1)).alias("transaction_id"), "*")


def append_lines_jdbc(lines, url, table, properties=None):
    """Append prepared lines to a database table in batched inserts."""
    prepare_lines_for_load(lines).write.option("batchsize", LOAD_BATCH_ROWS).jdbc(
        url, table, mode="append", properties=properties or {}
    )


def materialize(df, target, bucket_by=None, buckets=None, path=None):
    """Store a derived table at a path, or as a catalog table bucketed on a join key (at ``path``, if
    given). Rows are dealt to their buckets first, so that a bucket is one file and not one a task;
    tables of as many buckets on the same key then join without a shuffle."""
    if bucket_by is None:
        df.write.mode("overwrite").parquet(target)
        return
    dealt = df.repartition(buckets, bucket_by).write.mode("overwrite").bucketBy(buckets, bucket_by).sortBy(bucket_by)
    (dealt.option("path", path) if path else dealt).saveAsTable(target)


def update_columns(df, assignments):
    """Add or replace computed columns: ``{name: column}``."""
    return df.withColumns(assignments)


def table_constraints(df, key, required=(), reference=None):
    """Key, not-null and foreign-key conditions as data, one row.

    Keys are grouped before they are counted, so a repeated key costs one row per task.
    """
    groups = df.groupBy(F.col(key).alias("key")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(F.col(name).isNull()).alias(f"null_{name}") for name in required],
    )

    def total(column):
        return F.coalesce(F.sum(column), F.lit(0)).cast("bigint")

    checked = groups.agg(
        total("rows").alias("total_rows"),
        total(F.when(F.col("key").isNotNull(), F.col("rows"))).alias("non_null_ids"),
        F.count("key").alias("unique_ids"),
        *[total(f"null_{name}").alias(f"null_{name}") for name in required],
    )
    if reference is None:
        return checked
    present = df.where(F.col(key).isNotNull())
    orphans = present.join(reference.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n"))
    return checked.withColumn("missing_references", orphans.scalar())


def merge_predictions(target, updates, key="customer_id"):
    """``target`` with rows inserted or wholly replaced by ``updates``; of several
    updates of one key the most recently scored one counts."""
    columns = PREDICTIONS.fieldNames()
    newest = F.max_by(F.struct(*columns), F.struct("prediction_date", "churn_probability", "prediction"))
    latest = updates.groupBy(F.col(key).alias("_key")).agg(newest.alias("row")).select("row.*")
    kept = target.select(*columns).join(latest.select(key), key, "left_anti")
    return kept.select(*columns).unionByName(latest)


def _prediction_bucket(buckets):
    return F.pmod(F.xxhash64("customer_id"), F.lit(buckets)).cast("int")


def read_current(spark, path):
    """The stored predictions, one row a customer."""
    stored = T.StructType([*PREDICTIONS.fields, T.StructField("bucket", T.IntegerType())])
    try:
        return spark.read.schema(stored).parquet(path).drop("bucket")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no predictions at {path}") from error
        raise


def _stored_buckets(spark, path, touched):
    """Rows of the touched partitions; other partitions' files are not listed for the scan."""
    stored = T.StructType([*PREDICTIONS.fields, T.StructField("bucket", T.IntegerType())])
    try:
        table = spark.read.schema(stored).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], PREDICTIONS)
        raise
    return table.where(F.col("bucket").isin(touched)).drop("bucket")


def upsert_predictions(spark, path, updates, buckets=PREDICTION_BUCKETS):
    """Insert or replace predictions by customer; the partitions written, by number.

    The table is partitioned by a hash of the customer. Partitions that the updates touch
    are merged by a join, stored on their own, and then replace the old ones by a dynamic
    partition overwrite; the files of all other partitions stay as they are. There is one writer
    at a time, as with any plain folder of files, and ``buckets`` is the same in every call.
    """
    updates = cut(updates.select(*PREDICTIONS.fieldNames()).where(F.col("customer_id").isNotNull()), "updates")
    bucket = _prediction_bucket(buckets)
    touched = sorted(row[0] for row in updates.select(bucket).distinct().collect())
    if not touched:
        raise ValueError("no predictions to save")
    # stored before the overwrite, which must not read the files that it replaces
    merged = cut(merge_predictions(_stored_buckets(spark, path, touched), updates), "merged")
    (
        merged.withColumn("bucket", bucket)
        .hint("rebalance", "bucket")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    return touched


def read_predictions(predictions, n=None):
    """Stored predictions as plain numbers, most likely to churn first."""
    typed = predictions.select(
        "customer_id",
        F.col("churn_probability").cast("double").alias("churn_probability"),
        F.col("prediction").cast("int").alias("prediction"),
        "risk_level",
        "prediction_date",
    ).orderBy(F.desc("churn_probability"), "customer_id")
    return typed if n is None else typed.limit(n)
