"""Column helpers that settle types once, so that every query states money and counts the same way."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def money(expr: Column | str) -> Column:
    """An exact two-place decimal: sums do not depend on the order of the rows."""
    return (F.expr(expr) if isinstance(expr, str) else expr).cast("decimal(18,2)")


def exact_sum(expr: Column | str) -> Column:
    """Order-independent sum of two-place amounts, as a double."""
    return F.sum(money(expr)).cast("double")


def n_rows() -> Column:
    return F.count(F.lit(1))


__all__ = ["exact_sum", "money", "n_rows"]
