"""Numbers and dates from text cells, and their display text."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space around cells.
BLANKS = " \t\n\r\x0b\x0c"

# Currency sign, placeholder and date pattern of the displayed tables.
CURRENCY_SIGN = "£"
MISSING_TEXT = "N/A"
MINUTE_PATTERN = "yyyy-MM-dd HH:mm"


def typed_cell(column, dtype, frame=None):
    """A cell as ``dtype``; text such as '12346.0' counts as a whole number, '1.5' and junk
    become null. ``frame`` tells whether the column is text; without it, it is."""
    if frame is not None and not isinstance(frame.select(column.alias("cell")).schema["cell"].dataType, T.StringType):
        return column.try_cast(dtype)
    if isinstance(dtype, T.StringType):
        return column
    cell = F.btrim(column, F.lit(BLANKS))
    if isinstance(dtype, T.IntegralType):
        number = cell.try_cast("decimal(38,6)")
        return F.when(number == F.floor(number), number).try_cast(dtype)
    return cell.try_cast(dtype)


def currency(column):
    return F.concat(F.lit(CURRENCY_SIGN), F.format_number(column, 2))


def thousands(column):
    return F.format_number(column, 0)


def percent(column):
    """A share such as 0.125 as ``12.50%``."""
    return F.concat(F.format_number(column * 100, 2), F.lit("%"))


def days(column):
    """One decimal and the unit, or the placeholder."""
    return F.coalesce(F.concat(F.format_number(column.cast("double"), 1), F.lit(" days")), F.lit(MISSING_TEXT))


def minute(column):
    return F.date_format(column, MINUTE_PATTERN)


FORMATS = {"currency": currency, "thousands": thousands, "percent": percent, "days": days, "minute": minute}
