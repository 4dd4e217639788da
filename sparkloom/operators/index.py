"""Point and range lookup on one column, served by data layout instead of a tree.

``create`` writes a copy of the table that is range-partitioned and sorted on the column. Row-group minima and maxima
then let the scan skip everything outside the wanted range for ``= < <= > >=``; the tree's fan-out has its
counterpart in the rows per row group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.workspace import fresh_path

OPS = {
    "=": lambda c, v: c == v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
}


class ClusteredIndex:
    """A clustered copy of one table on one column."""

    def __init__(self, spark: SparkSession, table: str, column: str, path: str, schema, key_type, more: tuple[str, ...] = ()):
        self.spark, self.table, self.column, self.path, self._schema, self.key_type = spark, table, column, path, schema, key_type
        #: Folders of rows inserted later, each sorted in itself.
        self.more = more

    @property
    def name(self) -> str:
        return f"{self.table}_{self.column}_index"

    @classmethod
    def create(cls, df: DataFrame, table: str, column: str, partitions: int | None = None, block_bytes: int = 1 << 20, path: str | None = None) -> ClusteredIndex:
        """Write the clustered copy; *block_bytes* bounds a Parquet row group, the unit that a lookup can skip."""
        if column not in df.columns:
            raise KeyError(f"{table} has no column {column!r}")
        path = path or fresh_path(df.sparkSession, f"{table}_{column}_index")
        cls._write(df, column, partitions, block_bytes, path)
        return cls(df.sparkSession, table, column, path, df.schema, df.schema[column].dataType)

    @staticmethod
    def _write(df: DataFrame, column: str, partitions: int | None, block_bytes: int, path: str) -> None:
        dealt = df.repartitionByRange(partitions, column) if partitions else df.repartitionByRange(column)
        (dealt.sortWithinPartitions(F.col(column).asc_nulls_first())
            .write.option("parquet.block.size", block_bytes).option("parquet.page.row.count.limit", 2000)
            .parquet(path))

    def insert(self, rows: DataFrame, partitions: int | None = None, block_bytes: int = 1 << 20) -> ClusteredIndex:
        """A new version with *rows* as well; only they are sorted and written. Keys may repeat or be null."""
        path = fresh_path(self.spark, f"{self.name}_more")
        self._write(rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) for f in self._schema]), self.column, partitions, block_bytes, path)
        return ClusteredIndex(self.spark, self.table, self.column, self.path, self._schema, self.key_type, (*self.more, path))

    def scan(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.path, *self.more)

    def lookup(self, op: str, value: object, *columns: str) -> DataFrame:
        """Rows with ``column op value``; the literal is cast to the key's type so that the filter reaches the scan."""
        if op not in OPS:
            raise ValueError(f"no index lookup for {op!r}")
        hit: Column = OPS[op](F.col(self.column), F.lit(value).cast(self.key_type))
        out = self.scan().filter(hit)
        return out.select(*columns) if columns else out

    def between(self, low: object, high: object) -> DataFrame:
        return self.scan().filter(F.col(self.column).between(F.lit(low).cast(self.key_type), F.lit(high).cast(self.key_type)))

    def keys(self) -> DataFrame:
        """The distinct non-null keys in ascending order."""
        return self.scan().select(self.column).na.drop().distinct().orderBy(self.column)

    def files(self) -> DataFrame:
        """Per file: rows, smallest and largest key."""
        return self.scan().groupBy(F.input_file_name().alias("file")).agg(F.count(F.lit(1)).alias("n_rows"), F.min(self.column).alias("min_key"), F.max(self.column).alias("max_key"))

    def delete(self, value: object) -> ClusteredIndex:
        """A new version without the rows whose key equals *value*; the old files stay readable."""
        key = F.col(self.column)
        kept = self.scan().filter(key.isNull() | (key != F.lit(value).cast(self.key_type)))
        return ClusteredIndex.create(kept, self.table, self.column)
