"""Amounts of money from texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def amount(text: Column) -> Column:
    """The amount in a price text as a double, whatever its currency sign, separators and blanks; null if there is none.

    Both '1,234.50' and '1 234,50' are read; a comma before exactly two final digits is a decimal comma unless a dot follows.
    Null for null, empty and other texts, among them such without digits.
    """
    bare = F.translate(F.replace(F.upper(text), F.lit("ZAR"), F.lit("")), "R$€£ \t\r\n\u00a0\u2009\u202f", "")
    decimal_comma = F.rlike(bare, F.lit(r"^-?[0-9]+(\.[0-9]{3})*,[0-9]{1,2}$"))
    dotted = F.when(~F.contains(bare, F.lit(",")), bare).when(decimal_comma, F.translate(bare, ",.", ".")).otherwise(F.translate(bare, ",", ""))
    return F.when(F.rlike(dotted, F.lit(r"^-?[0-9]+(\.[0-9]+)?$")), dotted.try_cast("double"))
