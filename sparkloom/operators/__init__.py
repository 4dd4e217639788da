"""DataFrame → DataFrame operators."""

from sparkloom.operators.index import ClusteredIndex
from sparkloom.operators.relational import (
    aggregate,
    anti_join,
    apply_filter,
    distinct,
    except_rows,
    intersect_rows,
    join,
    page_by_key,
    project,
    project_filter,
    semi_join,
    sort,
    top,
    union_rows,
)

__all__ = ["ClusteredIndex", "aggregate", "anti_join", "apply_filter", "distinct", "except_rows", "intersect_rows", "join", "page_by_key", "project", "project_filter", "semi_join", "sort", "top", "union_rows"]
