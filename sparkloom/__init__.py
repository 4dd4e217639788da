"""A relational analytics engine expressed in the DataFrame and SQL APIs of Spark."""

from sparkloom.plans.engine import Engine
from sparkloom.sources.catalog import Catalog

__all__ = ["Catalog", "Engine"]
