"""Ratios and averages with fixed rounding rules.

Money stays decimal through every sum. A quotient the reports round is taken as
a decimal with at least eleven fractional digits and rounded half up once; a
quotient they leave unrounded is a double of two exactly summed operands. Either
way the value does not depend on the order in which partitions are merged.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlark.schemas import MONEY

COUNT = "decimal(18,0)"


def _col(value):
    return value if isinstance(value, Column) else F.col(value)


def rounded_ratio(numerator, denominator, scale_up=1):
    """``numerator * scale_up / denominator`` to 2 decimals, null for a zero denominator.
    The denominator is a count."""
    top = (_col(numerator) * F.lit(scale_up)).cast("decimal(27,2)")
    bottom = F.nullif(_col(denominator).cast(COUNT), F.lit(0).cast(COUNT))
    return F.round(top / bottom, 2).cast(MONEY)


def rounded_money_rate(numerator, denominator):
    """``numerator / denominator * 100`` to 2 decimals for two money amounts."""
    top = (_col(numerator) * F.lit(100)).cast("decimal(26,2)")
    bottom = _col(denominator).cast("decimal(24,2)")
    return F.round(top / F.nullif(bottom, F.lit(0).cast("decimal(24,2)")), 2).cast(MONEY)


def rounded_mean(value):
    """Mean of a numeric column to 2 decimals, nulls ignored."""
    value = _col(value)
    return rounded_ratio(F.sum(value), F.count(value))


def mean(value):
    """Unrounded mean as a double, nulls ignored, null over no rows."""
    value = _col(value)
    return F.try_divide(F.sum(value).cast("double"), F.count(value).cast("double"))


def ratio(numerator, denominator):
    """Unrounded quotient as a double, null for a zero denominator."""
    return F.try_divide(_col(numerator).cast("double"), _col(denominator).cast("double"))


def money_sum(value):
    return F.sum(_col(value)).cast(MONEY)


def count_if(condition):
    """Rows meeting a condition; 0 over no rows."""
    return F.count_if(condition)
