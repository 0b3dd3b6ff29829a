"""Vectors of one length, ready for tasks."""

from pyspark.sql import functions as F


def usable(frame, column="embedding"):
    """Whether a vector is whole: neither null nor empty, no null or non-finite part."""
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & ~bad, F.lit(False))


def padded(frame, column="embedding"):
    """``frame`` with its vectors as doubles of the longest vector's length; shorter
    ones get zeros, which changes neither lengths nor products. Also that length."""
    length = frame.agg(F.max(F.size(column)).alias("n")).first()["n"] or 0
    values = F.transform(column, lambda x: x.cast("double"))
    zeros = F.array_repeat(F.lit(0.0), F.lit(length) - F.size(column))
    return frame.withColumn(column, F.concat(values, zeros)), length
