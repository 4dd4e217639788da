"""The relational operators, each a thin declarative step that Catalyst plans.

Predicates and expressions are Columns or SQL strings. All follow standard SQL: three-valued logic, NULL keys match
nothing, an aggregate of no rows is NULL (COUNT is 0), and what cannot be evaluated is an error, never ``false``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.expr(x) if isinstance(x, str) else x


def project(df: DataFrame, *exprs: Column | str, **named: Column | str) -> DataFrame:
    """Columns, literals and expressions, in the order given; keywords name computed columns."""
    return df.select(*[_col(e) for e in exprs], *[_col(e).alias(k) for k, e in named.items()])


def apply_filter(df: DataFrame, *conditions: Column | str) -> DataFrame:
    """Rows for which every condition is true (not false, not unknown)."""
    return df.filter(reduce(lambda a, b: a & b, map(_col, conditions))) if conditions else df


def project_filter(df: DataFrame, condition: Column | str, *exprs: Column | str) -> DataFrame:
    """Filter then project in one step; Catalyst fuses stacks of these into a single codegen span."""
    return project(apply_filter(df, condition), *exprs)


def join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column | str, how: str = "inner") -> DataFrame:
    """Equi- or theta-join. A list of names is USING; a condition may name its sides in either order.

    No strategy is hinted: below the broadcast threshold Spark ships the small side, above it sorts and merges, and
    adaptive execution splits partitions that a hot key has swollen.
    """
    return left.join(right, list(on) if not isinstance(on, (str, Column)) else _col(on), how)


def semi_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column | str) -> DataFrame:
    return join(left, right, on, "left_semi")


def anti_join(left: DataFrame, right: DataFrame, on: Sequence[str] | Column | str) -> DataFrame:
    return join(left, right, on, "left_anti")


def aggregate(df: DataFrame, by: Sequence[Column | str] = (), having: Column | str | None = None, **aggs: Column | str) -> DataFrame:
    """Group and aggregate, partially on each side of the shuffle; *having* filters the groups."""
    keys = [F.col(k) if isinstance(k, str) else k for k in by]
    out = df.groupBy(*keys).agg(*[_col(e).alias(k) for k, e in aggs.items()]) if aggs else df.select(*keys).distinct()
    return out if having is None else out.filter(_col(having))


def distinct(df: DataFrame, *cols: str) -> DataFrame:
    return (df.select(*cols) if cols else df).distinct()


def sort(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Order by ``"col"``, ``"col desc"``, ``"col asc nulls last"`` …; NULLs are smallest unless a key says otherwise."""
    return df.orderBy(*[_sort_key(k) for k in keys])


def _sort_key(key: str | Column) -> Column:
    if isinstance(key, Column):
        return key
    words = key.lower().split()
    c = F.col(key.split()[0])
    desc, last, first = "desc" in words, words[-2:] == ["nulls", "last"], words[-2:] == ["nulls", "first"]
    if desc:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_last() if last else c.asc_nulls_first()


def top(df: DataFrame, n: int, *keys: str | Column, offset: int = 0) -> DataFrame:
    """The first *n* rows after *offset* in the given order (TakeOrderedAndProject, no global sort)."""
    ordered = sort(df, *keys) if keys else df
    return ordered.offset(offset).limit(n) if offset else ordered.limit(n)


def union_rows(left: DataFrame, right: DataFrame, keep_all: bool = True) -> DataFrame:
    return left.unionByName(right) if keep_all else left.unionByName(right).distinct()


def intersect_rows(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    return left.intersectAll(right) if keep_all else left.intersect(right)


def except_rows(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    return left.exceptAll(right) if keep_all else left.subtract(right)


def page_by_key(df: DataFrame, key: str, after: object = None, rows: int = 100) -> DataFrame:
    """One page of a table in key order: the counterpart of reading a table block by block."""
    start = df if after is None else df.filter(F.col(key) > F.lit(after))
    return start.orderBy(F.col(key).asc_nulls_first()).limit(rows)
