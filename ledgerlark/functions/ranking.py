"""Exact ranks, quantiles and equal-size buckets without a single-task sort.

An unpartitioned window moves the whole table into one task. The helpers here find the
few order statistics that are needed by one plan for every size: equal rows are counted,
the counted rows are cut into ranges of about equal size, one for each shuffle partition,
and stored with the number of their range; sums per range tell which range holds a wanted
rank, and only that range is ordered. A value that many rows share is one counted row, so
no range grows with it. Values are compared in their own type.
"""

from math import ceil, floor

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlark.plans.lineage import cut

#: Rows that one task ranks by hash.
HASH_ROWS = 100_000


def _types(table, values):
    """A type for each name: whole numbers as bigint, fractions as double, decimals as they are."""
    kinds = {}
    for name, column in values.items():
        kind = table.select(column.alias("v")).schema["v"].dataType
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            kinds[name] = "double"
        else:
            kinds[name] = kind.simpleString() if isinstance(kind, T.DecimalType) else "bigint"
    return kinds


def _counted(table, values, key, dtype):
    """Rows of one type counted: name, value, key (0 without one), n; null values dropped."""
    key_column = key if key is not None else F.lit(0).cast("bigint")
    entries = [
        F.struct(F.lit(name).alias("name"), column.cast(dtype).alias("value"), key_column.cast("bigint").alias("key"))
        for name, column in values.items()
    ]
    long = table.select(F.inline(F.array(*entries))).where(F.col("value").isNotNull())
    return long.groupBy("name", "value", "key").agg(F.count(F.lit(1)).alias("n"))


def in_ranges(frame, *order, name="ordered"):
    """``frame`` stored with a column ``range``: rows of lower ranges come before in ``order``."""
    partitions = int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(frame.repartitionByRange(partitions, *order).withColumn("range", F.spark_partition_id()), name)


def _is_at_most(value, key, bound):
    bound_value, bound_key = bound
    same = value == F.lit(bound_value)
    return (value < F.lit(bound_value)) | (same & (key <= F.lit(bound_key)))


def _pick(counted, ranks):
    """The (value, key) at each wanted rank of each name."""
    ranged = in_ranges(counted, "name", "value", "key")
    sums = {}
    # one row for each name and range
    for row in ranged.groupBy("name", "range").agg(F.sum("n").alias("n")).collect():
        sums.setdefault(row.name, []).append((row.range, row.n))
    wanted = {}  # (name, range): {rank inside: rank}
    for name, name_ranks in ranks.items():
        below = 0
        for number, n in sorted(sums.get(name, [])):
            inside = {rank - below: rank for rank in name_ranks if below < rank <= below + n}
            if inside:
                wanted[(name, number)] = inside
            below += n
    places = F.lit(False)
    for name, number in wanted:
        places = places | ((F.col("name") == name) & (F.col("range") == number))
    ordered = Window.partitionBy("name", "range").orderBy("value", "key").rowsBetween(Window.unboundedPreceding, 0)
    counts = ranged.where(places).withColumn("upto", F.sum("n").over(ordered))
    hit = F.lit(False)
    for (name, number), inside in wanted.items():
        for rank in inside:
            hit = hit | ((F.col("name") == name) & (F.col("range") == number) & (F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    found = {}
    for row in counts.where(hit).collect():
        for inside, rank in wanted[(row.name, row.range)].items():
            if row.upto - row.n < inside <= row.upto:
                found[(row.name, rank)] = (row.value, row.key)
    return found


def non_null_counts(table, values):
    row = table.agg(*[F.count(column).alias(name) for name, column in values.items()]).first()
    return {name: row[name] for name in values}


def order_statistics(table, values, ranks, sizes, key=None):
    """``{(name, rank): (value, key)}`` for 1-based ranks in (value, key) order.

    ``values`` maps a name to a column expression, ``ranks`` a name to the wanted
    ranks, ``sizes`` a name to its count of non-null values. ``table`` should be a
    stored table: it is scanned once for each type among the values.
    """
    ranks = {name: {rank for rank in rs if 1 <= rank <= sizes[name]} for name, rs in ranks.items()}
    ranks = {name: rs for name, rs in ranks.items() if rs}
    found, kinds = {}, _types(table, {name: values[name] for name in ranks})
    for dtype in sorted(set(kinds.values())):
        own = [name for name in ranks if kinds[name] == dtype]
        found |= _pick(_counted(table, {name: values[name] for name in own}, key, dtype), {name: ranks[name] for name in own})
    return found


def add_ntile(table, buckets, key, orderings):
    """Add NTILE(``buckets``) columns over the whole table.

    ``orderings`` maps an output column to the ascending value it ranks by (negate
    the value for a descending rank); ``key`` is the unique tie-break. The first
    ``N mod buckets`` buckets hold one row more. Given the exact last row of every
    bucket, assigning a row is a projection: the table itself is never shuffled.
    """
    sizes = non_null_counts(table, orderings)
    ends = {}
    for name, n in sizes.items():
        small, extra = divmod(n, buckets)
        ends[name] = [b * small + min(b, extra) for b in range(1, buckets)]
    found = order_statistics(table, orderings, ends, sizes, F.col(key))
    kinds = _types(table, orderings)
    columns = {}
    for name, value in orderings.items():
        bucket = F.lit(1)
        for end in ends[name]:
            if (name, end) in found:
                after = ~_is_at_most(value.cast(kinds[name]), F.col(key), found[(name, end)])
                bucket = bucket + after.cast("int")
        columns[name] = bucket.cast("int")
    return table.withColumns(columns)


def quantiles(table, columns, probabilities):
    """Exact quantiles with linear interpolation: ``{column: [float or None, ...]}``."""
    values = {name: F.col(name) for name in columns}
    sizes = non_null_counts(table, values)
    ranks = {}
    for name, n in sizes.items():
        positions = [(n - 1) * p for p in probabilities] if n else []
        ranks[name] = sorted({r for x in positions for r in (floor(x) + 1, ceil(x) + 1)})
    found = order_statistics(table, values, ranks, sizes)
    result = {}
    for name, n in sizes.items():
        result[name] = []
        for p in probabilities:
            if not n:
                result[name].append(None)
                continue
            x = (n - 1) * p
            low = float(found[(name, floor(x) + 1)][0])
            high = float(found[(name, ceil(x) + 1)][0])
            result[name].append(low + (high - low) * (x - floor(x)))
    return result


def portable_hash(column, seed):
    """A 32-bit multiplicative hash that any SQL engine can repeat in BIGINT arithmetic.
    The high part of a key is folded into its low part first."""
    # Fixed values of the hash.
    multiplier, modulus, key_modulus, fold = 2654435761, 4294967296, 2147483648, 1640531527
    key = column.cast("bigint")
    low = F.pmod(key, F.lit(key_modulus))
    high = F.pmod(F.call_function("div", key - low, F.lit(key_modulus)), F.lit(key_modulus))
    folded = (low + high * F.lit(fold) % F.lit(key_modulus)) % F.lit(key_modulus)
    return (folded * F.lit(multiplier) + F.lit(seed)) % F.lit(modulus)


def add_hash_rank(df, group, key, seed, name="hash_rank"):
    """1-based rank inside ``group`` in (hash of key, key) order.

    The hash spreads keys evenly, so cutting it into equal ranges, as many as the rows
    need for ``HASH_ROWS`` in each, gives balanced windows however few groups there are;
    the ranges' start ranks are one row for each group and range.
    """
    width = 4294967296 // max(1, ceil(df.count() / HASH_ROWS)) + 1
    tagged = df.withColumn("_hash", portable_hash(F.col(key), seed)).withColumn(
        "_range", F.floor(F.col("_hash") / F.lit(width)).cast("int")
    )
    earlier = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        tagged.groupBy(group, "_range")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            F.col(group).alias("_group"),
            F.col("_range").alias("_start_range"),
            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
        )
    )
    inside = Window.partitionBy(group, "_range").orderBy("_hash", key)
    return (
        tagged.withColumn("_inside", F.row_number().over(inside))
        .join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_start_range")))
        .withColumn(name, (F.col("_start") + F.col("_inside")).cast("bigint"))
        .drop("_hash", "_range", "_inside", "_group", "_start_range", "_start")
    )
