"""Reading directories of tables: typed-header CSV, JSON lines or documents, Parquet."""

from sparkloom.sources.catalog import Catalog
from sparkloom.sources.csv import parse_header, read_typed_csv, write_typed_csv

__all__ = ["Catalog", "parse_header", "read_typed_csv", "write_typed_csv"]
